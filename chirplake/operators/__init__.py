"""DataFrame operators: filters, joins, aggregates, chunks, samples, geometry."""
