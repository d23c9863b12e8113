"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.functions import arrays, dsp, timefns
from chirplake.operators import aggregates, chunks, filters, geometry, ingest, joins, mixed, sampling
from chirplake.plans import soundscape
from chirplake.plans.collection import Collection
from chirplake.schema import TABLES
from chirplake.sources import statements
from chirplake.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ZONE, START = "America/Mexico_City", "01-01-2024 00:00:00"
PROPS = {"json_columns": ("props",)}


def query(sql: str | None = None):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            names = f.__code__.co_varnames[: f.__code__.co_argcount]
            return f(*[spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names])

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return add


def seconds(column: str = "ts"):
    return timefns.as_seconds(F.col(column))


CELL = "((round_even((((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) % 86400) + 86400) % 86400 / 3600, 0)) % 24)::BIGINT"


def celled(events: DataFrame) -> DataFrame:
    return events.withColumn("timeCell", timefns.time_cell(seconds(), timefns.start_seconds(START, "UTC")))


@query("SELECT event_id, event_type, value FROM events WHERE (event_type IN ('view', 'click') OR value >= 50.0) AND NOT (user_id < 20) AND user_id <> 77 AND value <= 90")
def filter_and_or_not(events):
    q = {"$and": [{"$or": [{"event_type": {"$in": ["view", "click"]}}, {"value": {"$gte": 50.0}}]}, {"$not": {"user_id": {"$lt": 20}}}], "user_id": {"$ne": 77}, "value": {"$lte": 90}}
    return filters.find(events, q).select("event_id", "event_type", "value")


@query("SELECT event_id, props FROM events WHERE (props::JSON ->> '$.k')::BIGINT > 10 AND (props::JSON ->> '$.k')::BIGINT <= 60")
def filter_json_path(events):
    return filters.find(events, {"props.k": {"$gt": 10, "$lte": 60}}, **PROPS).select("event_id", "props")


@query("SELECT count(*) AS n FROM events WHERE (props::JSON ->> '$.k') IS NOT NULL")
def filter_json_text_above_numbers(events):
    """A text literal stands above all numbers."""
    return filters.find(events, {"props.k": {"$lt": "a"}}, **PROPS).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64 AND label = 3")
def filter_array_size(embeddings):
    return filters.find(embeddings, {"embedding": {"$size": 64}, "label": 3}).select("vec_id", "label")


@query("SELECT vec_id FROM embeddings WHERE embedding[1] > 0")
def filter_array_item(embeddings):
    return filters.find(embeddings, {"embedding[0]": {"$gt": 0}}).select("vec_id")


@query("SELECT count(*) AS n FROM events WHERE (props::JSON ->> '$.none') <> 'x' OR NOT ((props::JSON ->> '$.none') = 'x')")
def filter_missing_path(events):
    return filters.find(events, {"$or": [{"props.none": {"$ne": "x"}}, {"$not": {"props.none": "x"}}]}, **PROPS).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_custkey = 7")
def filter_where_and_query(orders):
    return filters.find(orders, {"o_orderstatus": "O"}, where="o_totalprice > 100000", orid=7, id_column="o_custkey").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS \"k\" FROM events")
def project_dotted(events):
    return events.select("event_id", filters.json_value("props", "k", "bigint").alias("k"))


@query("SELECT doc_id, CASE WHEN instr(source, '/') = 0 THEN 'media/' || source ELSE source END AS path FROM documents")
def path_resolution(documents):
    return documents.select("doc_id", arrays.resolve_path(F.col("source"), "media").alias("path"))


@query("SELECT count(*) AS count FROM documents WHERE lang = 'en' AND n_chars > 100")
def count_filtered(documents):
    return aggregates.count(documents, {"lang": "en", "n_chars": {"$gt": 100}})


@query("SELECT DISTINCT lang FROM documents")
def distinct_levels(documents):
    return aggregates.field_levels(documents, F.col("lang"), "lang")


@query("SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s")
def level_combinations(documents):
    return aggregates.combinations(documents, ["lang", "source"])


SITED = "(SELECT event_id, props::JSON ->> '$.k' AS k FROM events)"


def sited(events: DataFrame) -> DataFrame:
    """Events as recordings whose metadata has a path below ``site``."""
    kept = events.select(F.col("event_id").alias("orid"), F.struct(F.lit(60.0).alias("duration")).alias("media_info"), F.concat(F.lit('{"site":'), F.col("props"), F.lit("}")).alias("metadata"))
    return soundscape.project_metadata(kept, ["site.k"])


@query(f"SELECT k AS site, count(*) AS count FROM {SITED} GROUP BY 1")
def dotted_groups(events):
    """Groups by a metadata path, through the soundscape's nodes."""
    s = soundscape.Soundscape("s", sited(events), {"globalParams": {"groupFields": ["site.k"]}})
    return s.get_groups().select(F.col("`site.k`").alias("site"), "count")


@query(f"SELECT event_id, k AS site FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5(event_id::VARCHAR), event_id) AS r FROM {SITED} WHERE k IS NOT NULL) WHERE r <= 2")
def dotted_sample(events):
    """A sample of each group of a metadata path."""
    return sampling.stratified_sample(sited(events), ["site.k"], 2).select(F.col("orid").alias("event_id"), F.col("`site.k`").alias("site"))


@query("SELECT lang, source, count(*) AS count FROM documents GROUP BY lang, source")
def group_counts(documents):
    return aggregates.group_counts(documents, ["lang", "source"])


@query("""
    SELECT 'k' AS field, CASE WHEN bool_and(json_type(props::JSON, '$.k') IN ('BIGINT', 'UBIGINT')) THEN 'bigint' ELSE 'string' END AS type
    FROM (SELECT props FROM events ORDER BY event_id LIMIT 10)""")
def infer_types(events):
    """Types of metadata paths from ten rows."""
    kinds = soundscape.infer_types(events.select(F.col("event_id").alias("orid"), F.col("props").alias("metadata")), ["k"])
    return events.sparkSession.createDataFrame(list(kinds.items()), "field string, type string")


def line_notes(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("orid"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_returnflag").alias("notetype"),
        F.col("l_discount").alias("start_time"), F.col("l_tax").alias("end_time"), F.col("l_quantity").alias("min_freq"), F.col("l_extendedprice").alias("max_freq"),
    )


@query("""
    SELECT o_orderkey AS orid, count(*) AS n, round(min(l_quantity), 6) AS low, round(max(l_extendedprice), 6) AS high
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderkey""")
def annotated_single(lineitem, orders):
    media = orders.select(F.col("o_orderkey").alias("orid"), F.struct("o_totalprice").alias("media_info"))
    nested = joins.annotated(line_notes(lineitem), media, {"notetype": "R"})
    return nested.select("orid", F.size("data").cast("long").alias("n"), F.round(F.array_min("data.min_freq"), 6).alias("low"), F.round(F.array_max("data.max_freq"), 6).alias("high"))


@query("SELECT conv_id AS orid, count(DISTINCT role) AS groups, count(*) AS notes FROM conversations GROUP BY conv_id")
def annotated_grouped(conversations):
    notes = conversations.select(F.col("conv_id").alias("orid"), F.col("turn").alias("id"), "role", F.col("text").alias("label"))
    media = notes.select("orid").distinct().withColumn("media_info", F.lit(None).cast("string"))
    nested = joins.annotated(notes, media, None, (), ("orid", "role"))
    members = F.aggregate(F.transform("data", lambda g: F.size(g.data).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return nested.select("orid", F.size("data").cast("long").alias("groups"), members.alias("notes"))


@query("""
    SELECT l_orderkey AS orid, l_returnflag AS notetype, min(l_discount) AS start_time, max(l_tax) AS end_time,
           min(l_quantity) AS min_freq, max(l_extendedprice) AS max_freq, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def group_bbox(lineitem):
    return geometry.limits(line_notes(lineitem), ["orid", "notetype"])


@query("SELECT doc_id, md5 FROM (SELECT doc_id, md5(text) AS md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_wins_dedupe(documents):
    return aggregates.first_wins(documents.select("doc_id", F.md5("text").alias("md5")), "md5", "doc_id")


def recorded(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as (records, media) of a store for each language: some without a timeexp, some whose file can't be read."""
    path = F.concat_ws("/", "source", "doc_id")
    store = F.struct(F.md5("lang").alias("hash"), F.lit("direct").alias("type"), F.lit("{}").alias("conf"), F.lit("{}").alias("metadata"))
    metadata = F.to_json(F.struct(path.alias("path"), F.when(F.col("doc_id") % 7 != 0, 1.0).alias("timeexp"), "doc_id"))
    records = documents.select(store.alias("datastore"), F.struct(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("fkey")).alias("source"), metadata.alias("metadata"))
    media = documents.where("doc_id % 5 <> 0").select(
        path.alias("path"), F.md5("text").alias("md5"), F.col("n_chars").alias("filesize"), F.lit(8000).alias("samplerate"), F.lit(2).alias("sampwidth"),
        F.lit(1).alias("nchannels"), F.col("n_chars").alias("nframes"),
    )
    return records, media


def empty_tables(df: DataFrame) -> dict[str, DataFrame]:
    return {name: df.sparkSession.createDataFrame([], kind) for name, kind in TABLES.items()}


INSERTED = """(SELECT doc_id, md5(text) AS md5, n_chars, CASE WHEN doc_id % 7 = 0 THEN 'no timeexp' WHEN doc_id % 5 = 0 THEN 'file can''t be read'
    WHEN row_number() OVER (PARTITION BY md5(text), doc_id % 7 = 0 OR doc_id % 5 = 0 ORDER BY md5(lang), doc_id) > 1 THEN 'md5 is there already' END AS reason, lang FROM documents)"""


@query(f"SELECT doc_id, reason FROM {INSERTED} WHERE reason IS NOT NULL")
def insert_rejects(documents):
    """Records that an insert leaves out, with the reason."""
    screened = ingest.screen(*recorded(documents), ingest.known_in(empty_tables(documents)))
    return ingest.rejected(screened).select(filters.json_value("record", "doc_id", "bigint").alias("doc_id"), "reason")


@query(f"SELECT doc_id, md5, row_number() OVER (ORDER BY md5(lang), doc_id) AS orid, n_chars / 8000.0::DOUBLE AS duration FROM {INSERTED} WHERE reason IS NULL")
def insert_parsed(documents):
    """Ids and media info of what an insert takes."""
    parsed = ingest.insert(empty_tables(documents), *recorded(documents))[0]["parsed"]
    return parsed.select(filters.json_value("metadata", "doc_id", "bigint").alias("doc_id"), "md5", "orid", F.col("media_info.duration").alias("duration"))


def scratch(df: DataFrame, name: str) -> str:
    """A new place in the shared folder."""
    return f"{ingest.shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query(f"""
    WITH g AS (SELECT *, row_number() OVER (ORDER BY md5(lang), doc_id) AS first FROM {INSERTED} WHERE reason IS NULL)
    SELECT doc_id, CASE WHEN n_chars > 3000 THEN (SELECT count(*) FROM g) + row_number() OVER (PARTITION BY n_chars > 3000 ORDER BY md5(lang), doc_id) ELSE first END AS orid,
           CASE WHEN n_chars <= 3000 AND doc_id < 100 THEN 'moved' ELSE concat_ws('/', source, doc_id) END AS path
    FROM g JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""")
def stored_changes(documents):
    """A stored collection after an insert, a change, a removal, and the same insert again; as another session opens it."""
    path = scratch(documents, "collection")
    col = Collection(documents.sparkSession, "documents", path, buckets=8).insert_media(*recorded(documents))
    col.update_field("path", "moved", {"metadata.doc_id": {"$lt": 100}})
    col.drop_media({"media_info.filesize": {"$gt": 3000}})
    col.insert_media(*recorded(documents))
    parsed = Collection(documents.sparkSession, "documents", path).tables["parsed"]
    return parsed.select(filters.json_value("metadata", "doc_id", "bigint").alias("doc_id"), "orid", "path")


@query("SELECT event_id FROM events WHERE (props::JSON ->> '$.k')::BIGINT > 10 AND NOT ((props::JSON ->> '$.k')::BIGINT BETWEEN 30 AND 60 OR event_type = 'view')")
def shredded_filter(events):
    """A filter on a JSON path that a store keeps in typed columns."""
    store = Store(events.sparkSession, scratch(events, "store"), 8)
    store.snapshot["shred"] = ["metadata.k"]
    rows = [F.col("event_id").alias("orid"), F.col("event_type").alias("path"), F.col("props").alias("metadata")]
    have = {"orid", "path", "metadata"}
    store.append({"parsed": events.select(*rows, *[F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["parsed"] if f.name not in have])})
    q = {"metadata.k": {"$gt": 10}, "$not": {"$or": [{"metadata.k": {"$gte": 30, "$lte": 60}}, {"path": "view"}]}}
    return filters.find(store.table("parsed", wide=True), q, shredded=store.shredded()).select(F.col("orid").alias("event_id"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def statement_dump(conversations):
    """Rows that were written as SQL statements and read back by byte ranges."""
    path = scratch(conversations, "dump")
    statements.write_statements({"conversations": conversations}, path)
    return statements.read_statements(conversations.sparkSession, path, {"conversations": conversations.schema}, 1 << 20)["conversations"]


@query("""
    WITH o AS (SELECT l_quantity::DOUBLE AS w, sum(l_quantity::DOUBLE) OVER (ORDER BY l_orderkey, l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) - l_quantity::DOUBLE / 2 AS middle, sum(l_quantity::DOUBLE) OVER () AS total FROM lineitem),
    t AS (SELECT w, least(floor(middle / (total / ceil(total / 50000)))::BIGINT, ceil(total / 50000)::BIGINT - 1) AS task FROM o)
    SELECT task, count(*) AS n, sum(w) AS weight FROM t GROUP BY task""")
def dealt_by_weight(lineitem):
    """Rows of tasks of about equal weight, in order."""
    weighed = lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("w"))
    tasks = aggregates.dealt(weighed, "w", ["l_orderkey", "l_linenumber", "w"], 50_000, number="task")
    return tasks.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"))


@query("""
    SELECT l_orderkey AS orid, l_linenumber::DOUBLE AS start_time, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS id
    FROM lineitem WHERE l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linenumber <> 3)""")
def annotate_ids(lineitem):
    """Annotations with ids; of unknown type, or without a geometry where one is needed, they are rejected."""
    kind = F.when(F.col("l_returnflag") == "R", "bbox").when(F.col("l_returnflag") == "A", "weak").otherwise("other")
    start, empty = F.col("l_linenumber").cast("double"), F.lit("{}")
    notes = lineitem.select(
        kind.alias("notetype"), F.col("l_orderkey").alias("orid"), start.alias("start_time"), (start + 1).alias("end_time"), F.lit(1.0).alias("duration"),
        F.col("l_extendedprice").alias("max_freq"), F.col("l_discount").alias("min_freq"), F.when(F.col("l_linenumber") != 3, "POINT (0 0)").alias("wkt"),
        empty.alias("label"), empty.alias("groups"), empty.alias("metadata"),
    )
    return ingest.annotate(empty_tables(lineitem), notes)[0]["annotations"].select("orid", "start_time", "id")


@query("""
    SELECT o_orderkey AS orid, count(l_orderkey) AS notes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderstatus <> 'F' GROUP BY o_orderkey""")
def delete_matches(orders, lineitem):
    """What a removal leaves: recordings, and their annotations with them."""
    status = F.to_json(F.struct(F.col("o_orderstatus").alias("status")))
    kinds = {"orid": F.col("o_orderkey"), "metadata": status}
    parsed = orders.select(*[kinds.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["parsed"]])
    original = parsed.select(F.col("orid").alias("id"), F.lit(None).cast("string").alias("source"), "metadata")
    kinds = {"orid": F.col("l_orderkey"), "id": F.col("l_linenumber")}
    notes = lineitem.select(*[kinds.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["annotations"]])
    left, _ = ingest.remove(empty_tables(orders) | {"parsed": parsed, "original": original, "annotations": notes}, {"metadata.status": "F"})
    counted = left["annotations"].groupBy("orid").agg(F.count(F.lit(1)).alias("notes"))
    kept = left["parsed"].join(left["original"].select(F.col("id").alias("orid")), "orid", "left_semi")
    return kept.select("orid").join(counted, "orid", "left").select("orid", F.coalesce("notes", F.lit(0)).alias("notes"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_field(orders):
    return ingest.update_field(orders, "o_orderpriority", "done", {"o_orderstatus": "F"}).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def orids_semi(orders, lineitem):
    ids = lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.with_ids(orders, ids, "o_orderkey").select("o_orderkey", "o_custkey")


HOURLY = "(SELECT floor(epoch_us(ts) / 3600000000)::BIGINT - 473352 AS timeCell, round(avg(value), 6) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1)"


HOURS = f"(SELECT unnest(generate_series(min(timeCell), max(timeCell))) AS i FROM {HOURLY})"


def hourly(events: DataFrame) -> tuple[DataFrame, int, int]:
    """(purchases with their hour, the first and the last hour that has any)."""
    rows = events.where("event_type = 'purchase'").withColumn("timeCell", F.floor(seconds() / 3600) - 473352)
    ends = rows.agg(F.min("timeCell"), F.max("timeCell")).first()
    return rows, ends[0] or 0, ends[1] or 0


@query(f"SELECT g.i AS timeCell, coalesce(h.value, -1000) AS value FROM {HOURS} g LEFT JOIN {HOURLY} h ON g.i = h.timeCell")
def densify_cells(events):
    rows, low, high = hourly(events)
    mean = aggregates.cell_stats(rows, ["timeCell"], ["value"]).select("timeCell", F.round("value", 6).alias("value"))
    return aggregates.densify(mean, low, high)


@query(f"SELECT g.i AS timeCell FROM {HOURS} g ANTI JOIN {HOURLY} h ON g.i = h.timeCell")
def missing_cells(events):
    return aggregates.missing_cells(*hourly(events))


@query(f"""
    SELECT i AS timeCell, strftime(TIMESTAMP '2024-01-01' + (i - a) * INTERVAL 1 HOUR, '%d %b %H:%M') AS label
    FROM {HOURS} h, (SELECT min(i) AS a, max(i) AS b FROM {HOURS}) WHERE (i - a) % greatest((b - a + 1) // 12, 1) = 0""")
def axis_labels(events):
    """Places and texts of about twelve labels on the axis of hours."""
    _, low, high = hourly(events)
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return timefns.axis_labels(events.sparkSession, low, high, 12, start, 3600, "dd MMM HH:mm")


@query(f"""
    SELECT event_id, epoch(date_trunc('second', ts) AT TIME ZONE '{ZONE}') AS "absStart", round(epoch(date_trunc('second', ts) AT TIME ZONE '{ZONE}') + value, 6) AS "absStop",
           strftime(ts, '%Y-%m-%d %H:%M:%S') || '-06:00' AS "standardStart" FROM events""")
def time_fields(events):
    """Time fields of recordings whose text of the time is in whole seconds."""
    fields = timefns.time_fields(F.date_format("ts", "dd-MM-yyyy HH:mm:ss"), F.lit(ZONE), F.col("value"))
    return events.select("event_id", fields["absStart"].alias("absStart"), F.round(fields["absStop"], 6).alias("absStop"), fields["standardStart"].alias("standardStart"))


@query(f"SELECT event_id, {CELL} AS \"timeCell\" FROM events")
def time_cell(events):
    return celled(events).select("event_id", "timeCell")


@query("SELECT event_id, round_even((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600, 0)::BIGINT AS \"timeCell_incr\" FROM events")
def time_cell_incremental(events):
    return events.select("event_id", timefns.time_cell(seconds(), timefns.start_seconds(START, "UTC"), 3600, None).alias("timeCell_incr"))


@query(f"SELECT {CELL} AS \"timeCell\", count(event_id) AS count FROM events WHERE event_type IN ('view', 'click') AND (props::JSON ->> '$.k')::BIGINT >= 10 GROUP BY 1")
def crono_counts(events):
    """Calendar counts of a filtered fragment: filter, cell, count."""
    chosen = filters.find(events, {"$and": [{"event_type": {"$in": ["view", "click"]}}, {"props.k": {"$gte": 10}}]}, **PROPS)
    return aggregates.crono_counts(celled(chosen), orid="event_id")


@query(f"SELECT DISTINCT {CELL} AS \"timeCell\", strftime(TIMESTAMP '2024-01-01' + {CELL} * INTERVAL 1 HOUR, '%H:%M:%S') AS label FROM events")
def cell_label(events):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return celled(events).select("timeCell", timefns.cell_label(F.col("timeCell"), start).alias("label")).distinct()


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-07 18:00:00'")
def time_range(events):
    inside = timefns.in_range(seconds(), ("05-01-2024 00:00:00", "07-01-2024 12:00:00"), ZONE)
    return events.where(inside).select("event_id", "ts")


def stats_sql(f: str) -> str:
    return f"SELECT {CELL} AS \"timeCell\", event_type, round({f}(coalesce(value, 0)), 6) AS value FROM events GROUP BY 1, 2"


@query(stats_sql("avg"))
def cell_mean(events):
    return aggregates.cell_stats(celled(events), ["timeCell", "event_type"], ["value"]).withColumn("value", F.round("value", 6))


@query(stats_sql("stddev_samp"))
def cell_std(events):
    return aggregates.cell_stats(celled(events), ["timeCell", "event_type"], ["value"], "std").withColumn("value", F.round("value", 6))


@query(f"""
    WITH m AS (SELECT {CELL} AS c, avg(value) AS value, avg((props::JSON ->> '$.k')::DOUBLE) AS k FROM events GROUP BY 1),
    d AS (SELECT g.i AS c, m.value, m.k FROM generate_series(0, 23) g(i) LEFT JOIN m ON g.i = m.c),
    l AS (SELECT c, 'value' AS level, value FROM d UNION ALL SELECT c, 'k', k FROM d)
    SELECT c AS "timeCell", level, round(value, 6) AS value, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS norm FROM l""")
def crono_matrix_norm(events):
    valued = celled(events).withColumn("k", filters.json_value("props", "k", "double"))
    m = aggregates.crono_matrix(valued, ["value", "k"], 0, 23)
    return m.select("timeCell", "level", F.round("value", 6).alias("value"), F.round("norm", 6).alias("norm"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[14:33], lambda x: x::DOUBLE)), 4) + 0.0 AS band FROM embeddings")
def freq_band_levels(embeddings):
    low, high = arrays.level_range((2000, 5000), 0, 10000, 64)
    return embeddings.select("vec_id", F.round(arrays.bands(F.col("embedding"), [(low, high + 1)])[0], 4).alias("band"))


@query("""
    SELECT doc_id, (i * 1000)::DOUBLE AS start, least((i + 1) * 1000, n_chars)::DOUBLE AS stop,
           doc_id || '-' || (i * 1000)::DOUBLE || '-' || least((i + 1) * 1000, n_chars)::DOUBLE AS "chunkId"
    FROM (SELECT doc_id, n_chars, unnest(generate_series(0, round_even(n_chars / 1000, 0)::BIGINT - 1)) AS i FROM documents)""")
def chunk_explode(documents):
    media = documents.select(F.col("doc_id"), F.col("n_chars").cast("double").alias("fileDuration"))
    return chunks.split_time(media, 1000, orid="doc_id").select("doc_id", F.col("chunkFileStart").alias("start"), F.col("chunkFileStop").alias("stop"), "chunkId")


@query("""
    WITH c AS (SELECT doc_id, n_chars, 12 AS size, (n_chars // 80 + 2)::INT AS frames, unnest(generate_series(0, round_even(n_chars / 1000, 0)::BIGINT - 1)) AS i FROM documents),
    f AS (SELECT *, least(round_even(frames / n_chars::DOUBLE * (i * 1000)::DOUBLE, 0)::INT, frames - 1) AS first FROM c)
    SELECT doc_id, i::BIGINT AS i, first, least(first + size, frames - 1) AS stop, round((least(first + size, frames - 1) - first) / size, 6) AS weight FROM f""")
def chunk_weight(documents):
    media = documents.select("doc_id", F.col("n_chars").cast("double").alias("fileDuration"))
    c = chunks.split_time(media, 1000, orid="doc_id")
    frames = (F.floor(F.col("fileDuration") / 80) + 2).cast("int")
    first, stop, weight = chunks.frame_range(frames, F.col("fileDuration"), F.col("chunkFileStart"), F.lit(12))
    return c.select("doc_id", (F.col("chunkFileStart") / 1000).cast("long").alias("i"), first.alias("first"), stop.alias("stop"), F.round(weight, 6).alias("weight"))


@query("""
    WITH n AS (SELECT doc_id, n_chars::DOUBLE AS d, CASE WHEN n_chars < 1000 OR n_chars / 1000 <= 1.5 THEN 1 ELSE n_chars // 1000 + (n_chars / 1000 - n_chars // 1000 >= 0.5)::INT END AS n FROM documents),
    c AS (SELECT doc_id, d, n, unnest(generate_series(0, n - 1)) AS i FROM n)
    SELECT doc_id, i::INT AS number, (i * 1000)::DOUBLE AS start, CASE WHEN n = 1 THEN d ELSE least((i + 1) * 1000, d) END AS stop FROM c""")
def write_chunks_limits(documents):
    limits = chunks.export_limits(documents.select("doc_id", F.col("n_chars").alias("duration")), 1000, 1.5)
    return limits.select("doc_id", "number", F.col("tlimits")[0].alias("start"), F.col("tlimits")[1].alias("stop"))


BAND_CUTS = [(i * 8, i * 8 + 8) for i in range(8)]


@query("SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(embedding[{a + 1}:{b}], lambda x: x::DOUBLE)), 4) + 0.0 AS e_{i}" for i, (a, b) in enumerate(BAND_CUTS)) + " FROM embeddings")
def band_energy(embeddings):
    bands = arrays.bands(F.col("embedding"), BAND_CUTS)
    return embeddings.select("vec_id", *[F.round(b, 4).alias(f"e_{i}") for i, b in enumerate(bands)])


@query("SELECT vec_id, round((embedding[1]::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE), 5) AS norm FROM embeddings")
def minmax_norm(embeddings):
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return embeddings.select("vec_id", F.round(F.get(arrays.min_max_norm(doubles), F.lit(0)), 5).alias("norm"))


@query("""
    WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    y AS (SELECT vec_id, i, v >= 0 AS p, lag(v >= 0) OVER (PARTITION BY vec_id ORDER BY i) AS q FROM x)
    SELECT vec_id, round(count(*) FILTER (q IS NOT NULL AND p <> q) / count(*), 6) AS zcr FROM y GROUP BY vec_id""")
def zero_crossings(embeddings):
    return embeddings.select("vec_id", F.round(arrays.zero_crossing_rate(F.col("embedding")), 6).alias("zcr"))


@query("""
    WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    k AS (SELECT unnest(generate_series(0, 32)) AS k)
    SELECT vec_id, k, round(sqrt(pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)), 4) AS magnitude FROM x, k GROUP BY vec_id, k""")
def dft_magnitude(embeddings):
    from chirplake.functions.dsp import magnitudes

    return embeddings.select("vec_id", F.posexplode(magnitudes("embedding")).alias("k", "m")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("m", 4).alias("magnitude"))


@query(f"""
    SELECT event_id, event_type, "timeCell" FROM (SELECT event_id, event_type, {CELL} AS "timeCell",
        row_number() OVER (PARTITION BY {CELL}, event_type ORDER BY md5(event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= 3""")
def stratified_sample(events):
    return sampling.stratified_sample(celled(events), ["timeCell", "event_type"], 3, key="event_id").select("event_id", "event_type", "timeCell")


@query(f"""
    WITH e AS (SELECT event_id, event_type, {CELL} AS c FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY c, event_type ORDER BY md5(event_id::VARCHAR), event_id) AS r, count(*) OVER (PARTITION BY c, event_type) AS n FROM e),
    d AS (SELECT DISTINCT c, event_type, d, ('0x' || substr(md5('0:' || c || ':' || event_type || ':' || d), 1, 12))::BIGINT % n + 1 AS pick FROM r, (VALUES (1), (2), (3)) v(d) WHERE n > 3)
    SELECT event_id, event_type, c AS "timeCell" FROM r JOIN d USING (c, event_type) WHERE r = pick UNION ALL SELECT event_id, event_type, c FROM r WHERE n <= 3""")
def sample_with_replacement(events):
    return sampling.stratified_sample(celled(events), ["timeCell", "event_type"], 3, True, key="event_id").select("event_id", "event_type", "timeCell")


@query("""
    WITH b AS (SELECT quantile_cont(embedding[1]::DOUBLE, [0.2, 0.6]) AS p, quantile_cont(embedding[2]::DOUBLE, [0.2, 0.6]) AS q, quantile_cont(embedding[3]::DOUBLE, [0.2, 0.6]) AS r FROM embeddings)
    SELECT vec_id, (embedding[1]::DOUBLE BETWEEN p[1] AND p[2])::INT + (embedding[2]::DOUBLE BETWEEN q[1] AND q[2])::INT + (embedding[3]::DOUBLE BETWEEN r[1] AND r[2])::INT AS score
    FROM embeddings, b ORDER BY score DESC, vec_id LIMIT 20""")
def percentile_band_topn(embeddings):
    e = embeddings.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e_{i}") for i in range(3)])
    return aggregates.top_scores(aggregates.percentile_scores(e, ["e_0", "e_1", "e_2"], (20, 60)), 20, ["vec_id"]).select("vec_id", "score")


GROUPED = """(SELECT event_type, user_id % 3 AS part, quantile_cont(value, [0.1, 0.5, 0.995]) AS q FROM events GROUP BY ALL)"""


@query(f"SELECT event_type, part::BIGINT AS part, unnest([0, 1, 2])::INT AS percentile, unnest(q) AS value FROM {GROUPED} WHERE q IS NOT NULL")
def percentile_groups(events):
    """Exact percentiles of every group in two passes."""
    rows = events.withColumn("part", F.col("user_id") % 3)
    return aggregates.percentile_table(rows, ["value"], (10, 50, 99.5), ["event_type", "part"]).select("event_type", F.col("part").cast("long").alias("part"), "percentile", "value")


@query("""
    WITH b AS (SELECT label, quantile_cont(embedding[1]::DOUBLE, [0.2, 0.6]) AS p, quantile_cont(embedding[2]::DOUBLE, [0.2, 0.6]) AS q FROM embeddings GROUP BY label),
    s AS (SELECT vec_id, e.label, (embedding[1]::DOUBLE BETWEEN p[1] AND p[2])::INT + (embedding[2]::DOUBLE BETWEEN q[1] AND q[2])::INT AS score
          FROM embeddings e JOIN b ON e.label IS NOT DISTINCT FROM b.label)
    SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, vec_id) AS r FROM s) WHERE r <= 3""")
def percentile_top_by_group(embeddings):
    """The rows of each group whose values lie most often between the group's percentiles."""
    e = embeddings.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e_{i}") for i in range(2)])
    scored = aggregates.percentile_scores(e, ["e_0", "e_1"], (20, 60), ["label"])
    return aggregates.top_scores(scored, 3, ["vec_id"], ["label"]).select("vec_id", "label", "score")


#: A sample of a frame of 16 around frame f (hop 8) of 64: mirrored at the ends, or held there.
MIRRORED = "embedding[CASE WHEN abs(f * 8 + n - 8) >= 64 THEN 126 - abs(f * 8 + n - 8) ELSE abs(f * 8 + n - 8) END + 1]::DOUBLE"
HELD = "embedding[least(greatest(f * 8 + n - 8, 0), 63) + 1]"


@query(f"""
    SELECT vec_id, f::INT AS frame, k::INT AS bin, round(sqrt(
        pow(list_sum(list_transform(range(16), lambda n: {MIRRORED} * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * cos(2 * pi() * k * n / 16))), 2)
        + pow(list_sum(list_transform(range(16), lambda n: {MIRRORED} * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * sin(2 * pi() * k * n / 16))), 2)), 5) AS magnitude
    FROM embeddings, range(9) a(f), range(9) b(k)""")
def spectrogram(embeddings):
    """Spectrograms of signals, by the function of the getters."""

    @F.pandas_udf("array<array<double>>")
    def spectra(signals: pd.Series) -> pd.Series:
        return signals.map(lambda x: list(dsp.spectrogram(np.asarray(x, float), 16, 8)))

    bins = embeddings.select("vec_id", F.posexplode(spectra("embedding")).alias("bin", "row"))
    return bins.select("vec_id", "bin", F.posexplode("row").alias("frame", "v")).select("vec_id", "frame", "bin", F.round("v", 5).alias("magnitude"))


@query(f"""
    SELECT vec_id, f::INT AS frame, list_sum(list_transform(range(16), lambda n: CASE WHEN f * 8 + n > 0 AND ({HELD} < 0) <> ({HELD.replace('n - 8', 'n - 9')} < 0) THEN 1.0::DOUBLE ELSE 0 END)) / 16 AS zcr
    FROM embeddings, range(9) a(f)""")
def zcr_frames(embeddings):
    """Share of sign changes in each frame, by the function of the getters."""

    @F.pandas_udf("array<double>")
    def rates(signals: pd.Series) -> pd.Series:
        return signals.map(lambda x: dsp.zcr(np.asarray(x, float), 16, 8))

    return embeddings.select("vec_id", F.posexplode(rates("embedding")).alias("frame", "zcr"))


@query()
def mixed_model(lineitem):
    """Fixed effects of a mixed model of prices by quantity, with a random intercept for each supplier."""
    rows = lineitem.select((F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_quantity") / 10).alias("quantity"), "l_suppkey")
    model = mixed.fit_mixed(rows, "price", ["quantity"], "l_suppkey")
    return lineitem.sparkSession.createDataFrame(model.summary(), "name string, estimate double, error double, ratio double")


@query("""
    SELECT doc_id, CASE WHEN b < 70 THEN 'train' WHEN b < 90 THEN 'test' ELSE 'validation' END AS split, fold
    FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS b, ('0x' || substr(md5(doc_id::VARCHAR), 9, 8))::BIGINT % 5 AS fold FROM documents)""")
def dataset_split(documents):
    return sampling.dataset_split(documents.select("doc_id"), "doc_id").select("doc_id", "split", "fold")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, (props::JSON ->> '$.k')::BIGINT * 2 AS twice FROM events")
def parse_append(events):
    ingest.register_parser("twice", lambda d, key: {**d, "twice": d[key] * 2})
    parsed = events.withColumn("metadata", ingest.run_parsers(F.col("props"), [{"function": "twice", "kwargs": {"key": "k"}}]))
    return parsed.select("event_id", filters.json_value("metadata", "k", "bigint").alias("k"), filters.json_value("metadata", "twice", "bigint").alias("twice"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: (embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2)), 4) + 0.0 AS total FROM embeddings")
def mean_channels(embeddings):
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    mean = arrays.channel_mean(F.array(F.slice(doubles, 1, 32), F.slice(doubles, 33, 32)))
    return embeddings.select("vec_id", F.round(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT p_partkey, regexp_replace(translate(translate(p_name, '_', ''), ' ', '_'), '[^\\p{L}\\p{N}_]', '', 'g') AS name FROM part")
def plain_names(part):
    return part.select("p_partkey", arrays.plain_name(F.col("p_name")).alias("name"))


@query("SELECT doc_id, list_transform(range(0, 5), lambda k: k * (n_chars + 1000) / 8.0) AS freqs FROM documents")
def bin_frequencies(documents):
    """Centre frequencies of recordings, each of a sample rate of its own."""
    return documents.select("doc_id", arrays.frequencies(F.col("n_chars") + 1000, 8).alias("freqs"))


@query(f"SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events")
def dense_ids(events):
    numbered = ingest.dense_ids(events.select("event_id"), "id", ["event_id"])
    return numbered.agg(F.count(F.lit(1)).alias("n"), (F.min("id") - 1).alias("first"), (F.max("id") - 1).alias("last"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS id FROM events")
def dense_ids_rows(events):
    """Each row's id, so that gaps, repeats and a wrong order show."""
    return ingest.dense_ids(events.select("event_id"), "id", ["event_id"]).select("event_id", "id")


@query(f"SELECT {CELL} AS \"timeCell\", user_id, count(*) AS count FROM events GROUP BY 1, 2")
def soundscape_groups(events):
    """Groups and cells of a fragment through the soundscape's nodes."""
    fragment = events.select(F.col("event_id").alias("orid"), "user_id", F.lit(60.0).alias("fileDuration"), seconds().alias("absStart"))
    config = {"globalParams": {"groupFields": ["user_id"]}, "cronoParams": {"startDate": START, "timeZone": "UTC"}, "energyParams": {"tStep": 60}}
    s = soundscape.Soundscape("s", fragment, config)
    return s.get_splits().groupBy("timeCell", "user_id").agg(F.count(F.lit(1)).alias("count"))
