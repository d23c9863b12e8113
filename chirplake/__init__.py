"""A catalogue of field recordings, and soundscape analytics over it, as Spark DataFrames."""
