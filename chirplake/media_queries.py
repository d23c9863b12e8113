"""Queries over recordings that the tables become: audio files, collections, soundscapes and datasets of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.functions import timefns
from chirplake.operators import filters, geometry, ingest, joins
from chirplake.plans.collection import Collection, TimedCollection
from chirplake.plans.dataset import Dataset
from chirplake.plans.soundscape import Soundscape, audio_splits
from chirplake.queries import HELD, INSERTED, ZONE, empty_tables, line_notes, query, recorded, scratch
from chirplake.schema import TABLES
from chirplake.sources import readers, writers
from chirplake.streaming import ingest as streams

RATE = 64
VECTORS = "(SELECT * FROM embeddings WHERE embedding IS NOT NULL)"
#: What 16 bits leave of a sample.
KEPT = "round_even(({x})::DOUBLE * 32767, 0)::DOUBLE / 32768"
MIRRORED = KEPT.format(x="embedding[CASE WHEN abs(f * 8 + n - 8) >= 64 THEN 126 - abs(f * 8 + n - 8) ELSE abs(f * 8 + n - 8) END + 1]")
MAGNITUDE = f"""sqrt(pow(list_sum(list_transform(range(16), lambda n: {MIRRORED} * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * cos(2 * pi() * k * n / 16))), 2)
    + pow(list_sum(list_transform(range(16), lambda n: {MIRRORED} * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * sin(2 * pi() * k * n / 16))), 2))"""


def files(embeddings: DataFrame) -> str:
    """A folder of WAV files: each vector as a second of sound."""
    folder = scratch(embeddings, "wav")
    writers.write_signals(embeddings.where("embedding IS NOT NULL").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("signal")), folder, RATE).count()
    return folder


def name_of(path: str = "path"):
    return F.regexp_extract(path, r"(\d+)\.wav$", 1).cast("long").alias("vec_id")


def recordings(embeddings: DataFrame, path: str | None = None) -> Collection:
    """A collection of those files."""
    media = readers.wav_files(embeddings.sparkSession, files(embeddings))
    store = F.struct(*[F.lit(v).alias(k) for k, v in (("hash", "wav"), ("type", "direct"), ("conf", "{}"), ("metadata", "{}"))])
    metadata = F.to_json(F.struct("path", F.lit(1.0).alias("timeexp"), name_of()))
    records = media.select(store.alias("datastore"), F.struct(F.lpad(name_of().cast("string"), 12, "0").alias("fkey")).alias("source"), metadata.alias("metadata"))
    return Collection(embeddings.sparkSession, "recordings", path, buckets=4).insert_media(records, media)


def vec_id(column: str = "metadata"):
    return filters.json_value(column, "vec_id", "bigint").alias("vec_id")


@query(f"SELECT vec_id, 172 AS filesize, {RATE} AS samplerate, 1 AS nchannels, 2 AS sampwidth, 64 AS nframes FROM {VECTORS}")
def media_headers(embeddings):
    """Headers of files, through the media source."""
    return readers.wav_files(embeddings.sparkSession, files(embeddings)).select(name_of(), "filesize", "samplerate", "nchannels", "sampwidth", "nframes")


@query(f"SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS orid, 1.0::DOUBLE AS duration, 172 AS filesize, true AS hashed FROM {VECTORS}")
def media_info(embeddings):
    """What a collection keeps of its files, the md5 that Spark works out of their bytes among it."""
    col = recordings(embeddings)
    bytes_of = embeddings.sparkSession.read.format("binaryFile").load(col.tables["parsed"].select("path").first()[0].rpartition("/")[0])
    sums = bytes_of.select(F.md5("content").alias("sum"), name_of())
    return col.get_media().select(vec_id(), "orid", "md5", "media_info").join(sums, "vec_id").select("vec_id", "orid", "media_info.duration", "media_info.filesize", (F.col("md5") == F.col("sum")).alias("hashed"))


@query(f"SELECT vec_id, i::INT AS i, {KEPT.format(x='embedding[i + 17]')} AS v FROM {VECTORS}, range(32) t(i)")
def signal_windows(embeddings):
    """The samples of a window of each recording, of which only the window is read."""
    col = recordings(embeddings)
    signals = col.get_signals(mask=(0.25, 0.75)).join(col.get_metadata(), "orid")
    return signals.select(vec_id(), F.posexplode("signal").alias("i", "v"))


@query(f"SELECT vec_id, f::INT AS frame, k::INT AS bin, k * {RATE} / 16.0::DOUBLE AS freq, round({MAGNITUDE}, 5) AS magnitude FROM {VECTORS}, range(9) a(f), range(9) b(k)")
def recording_spectra(embeddings):
    """Spectrograms of recordings, by the getter of a collection."""
    col = recordings(embeddings)
    specs = col.get_specs(n_fft=16, hop=8).join(col.get_metadata(), "orid")
    bins = specs.select(vec_id(), F.posexplode(F.arrays_zip("freqs", "spec")).alias("bin", "z"))
    return bins.select("vec_id", "bin", F.col("z.freqs").alias("freq"), F.posexplode("z.spec").alias("frame", "v")).select("vec_id", "frame", "bin", "freq", F.round("v", 5).alias("magnitude"))


@query(f"""
    SELECT vec_id, f::INT AS frame, list_sum(list_transform(range(16), lambda n: CASE WHEN f * 8 + n > 0
        AND ({KEPT.format(x=HELD)} < 0) <> ({KEPT.format(x=HELD.replace('n - 8', 'n - 9'))} < 0) THEN 1.0::DOUBLE ELSE 0 END)) / 16 AS zcr
    FROM {VECTORS}, range(9) a(f)""")
def recording_zcr(embeddings):
    """Share of sign changes in each frame, by the getter of a collection; a small negative sample is a zero without a sign."""
    col = recordings(embeddings)
    return col.get_zcr(frame_length=16, hop=8).join(col.get_metadata(), "orid").select(vec_id(), F.posexplode("zcr").alias("frame", "zcr"))


ENERGIES = f"""
    SELECT vec_id, b::INT AS band, round(sum({MAGNITUDE}), 4) AS energy
    FROM {VECTORS}, range(7) a(f), range(8) c(k), (SELECT unnest([0, 1, 2, 3]) AS b) WHERE k // 2 = b GROUP BY vec_id, b"""


@query(ENERGIES)
def audio_energies(embeddings):
    """Energies of a soundscape's splits, of files dealt to tasks by size, through a node that is kept."""
    col = recordings(embeddings)
    fragment = col.get_media().select("orid", vec_id(), F.col("media_info.duration").alias("fileDuration"), F.lit(0.0).alias("absStart"), "media_info")
    config = {"energyParams": {"tStep": 1, "n_fft": 16, "hop_length": 8, "fBins": 4, "fLimits": (0, 32)}, "globalParams": {"npartitions": 4}}
    scape = Soundscape("s", fragment, config, scratch(embeddings, "soundscape"), audio_splits)
    scape.get_splits(keep=True)
    levels = F.array(*[F.col(f"e_{i}") for i in range(4)])
    return scape.get_node("splits").select("vec_id", F.posexplode(levels).alias("band", "energy")).withColumn("energy", F.round("energy", 4))


@query(f"SELECT vec_id, n::INT AS number, 16 AS nframes, n * 0.25::DOUBLE AS start FROM {VECTORS}, range(4) t(n)")
def exported_chunks(embeddings):
    """Recordings cut into files of a quarter of a second, as the media source reads them back."""
    col = recordings(embeddings)
    folder = scratch(embeddings, "chunks")
    chunks = ingest.stored(col.write_chunks(folder, chop=0.25)).join(col.get_metadata(), "orid").select(vec_id(), "number", F.get("tlimits", F.lit(0)).alias("start"), F.element_at(F.split("path", "/chunks-"), -1).alias("place"))
    back = readers.wav_files(embeddings.sparkSession, folder).select(F.element_at(F.split("path", "/chunks-"), -1).alias("place"), "nframes")
    return chunks.join(back, "place").select("vec_id", "number", "nframes", "start")


@query(f"SELECT vec_id, true AS copied, true AS listed FROM {VECTORS}")
def media_bundle(embeddings):
    """Copies of media by md5, and the list that is exported with them."""
    spark = embeddings.sparkSession
    col = recordings(embeddings)
    folder = scratch(embeddings, "bag")
    col.doggy_bag(folder)
    kept = readers.wav_files(spark, f"{folder}/media").select("md5", F.concat("md5", F.lit(".wav")).alias("fname"), (F.instr("path", F.col("md5")) > 0).alias("copied"))
    listed = spark.read.csv(f"{folder}/metadata.csv", sep="|", header=True).select("fname", F.lit(True).alias("listed"))
    rows = col.get_media().select("md5", vec_id())
    return rows.join(kept, "md5").join(listed, "fname").select("vec_id", "copied", "listed")


@query(f"""
    WITH n AS (SELECT vec_id, (vec_id % 8) / 16.0::DOUBLE AS a, 0.25 + (vec_id % 8) / 16.0::DOUBLE AS b, (vec_id % 5) * 4.0::DOUBLE AS low, 12 + (vec_id % 5) * 4.0::DOUBLE AS high FROM {VECTORS})
    SELECT vec_id, floor(a * 9)::INT AS start, least(greatest(ceil(b * 9), floor(a * 9) + 1), 9)::INT AS stop, floor(low / 32 * 9)::INT AS low,
           least(greatest(ceil(high / 32 * 9), floor(low / 32 * 9) + 1), 9)::INT AS high FROM n""")
def annotation_windows(embeddings):
    """Bins of the box of an annotation of each recording, and that its spectrogram and mask are of that size."""
    col = recordings(embeddings)
    ids = col.get_metadata().select("orid", vec_id())
    part, place = F.col("vec_id") % 8 / 16.0, F.col("vec_id") % 5 * 4.0
    notes = ids.select(
        "orid", F.lit("bbox").alias("notetype"), part.alias("start_time"), (part + 0.25).alias("end_time"), F.lit(0.25).alias("duration"), place.alias("min_freq"), (place + 12.0).alias("max_freq"),
        F.lit("x").alias("wkt"), *[F.lit("{}").alias(c) for c in ("label", "groups", "metadata")],
    )
    windows = col.annotate(notes).get_annotation_matrices(n_fft=16, hop=8)
    sized = (F.size("spec") == F.col("high") - F.col("low")) & (F.size(F.get("mask", F.lit(0))) == F.col("stop") - F.col("start"))
    return windows.where(sized).join(ids, "orid").select("vec_id", "start", "stop", "low", "high")


@query(f"SELECT vec_id, 1 AS n, 1.0::DOUBLE AS duration FROM {VECTORS}")
def streamed_media(embeddings):
    """Files that a stream inserts into a stored collection, and again after it lost its checkpoint: each is there once."""
    spark, folder, path = embeddings.sparkSession, files(embeddings), scratch(embeddings, "streamed")
    for _ in range(2):
        col = Collection(spark, "streamed", path, buckets=4)
        streams.insert(streams.files(spark, folder), col, "wav", scratch(embeddings, "stream"), scratch(embeddings, "rejects")).awaitTermination()
    parsed = Collection(spark, "streamed", path).tables["parsed"].select(name_of(), "media_info.duration")
    return parsed.groupBy("vec_id", "duration").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("""
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, ((round_even((epoch(ts) % 86400) / 3600, 0)) % 24)::BIGINT AS "timeCell", count(*) AS count FROM events GROUP BY ALL""")
def windowed_cells(events):
    """Counts by day and calendar cell, as a stream of events has them."""
    return streams.cell_counts(events.select("ts"), "ts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "timeCell", "count")


# catalogues


def catalogue(documents: DataFrame) -> Collection:
    """Documents as the recordings of a collection in the session."""
    return Collection(documents.sparkSession, "documents").insert_media(*recorded(documents))


def doc_id(column: str = "metadata"):
    return filters.json_value(column, "doc_id", "bigint").alias("doc_id")


TAKEN = f"(SELECT *, row_number() OVER (ORDER BY md5(lang), doc_id) AS orid FROM {INSERTED} WHERE reason IS NULL)"


@query(f"""
    WITH a AS (SELECT g.*, source < 'src15' AS one FROM {INSERTED.replace("PARTITION BY md5(text)", "PARTITION BY source < 'src15', md5(text)")} g JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE reason IS NULL),
    b AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY md5(lang), doc_id) AS own FROM a)
    SELECT doc_id, CASE WHEN one THEN own ELSE own + (SELECT count(*) FROM b WHERE one) END AS orid
    FROM b WHERE one OR md5 NOT IN (SELECT md5 FROM b WHERE one)""")
def merged_catalogues(documents):
    """Two catalogues of the documents' sources as one: ids follow on, media that the first has are left out."""
    first, second = (catalogue(documents.where(w)) for w in ("source < 'src15'", "NOT (source < 'src15')"))
    return first.merge(second).tables["parsed"].select(doc_id(), "orid")


@query(f"SELECT doc_id, CASE WHEN lang = 'en' THEN 2 WHEN n_chars > 2000 THEN 1 ELSE 0 END::BIGINT AS mark, CASE WHEN lang = 'en' OR n_chars <= 2000 THEN 1 ELSE 2 END AS steps FROM {TAKEN}")
def transformed_metadata(documents):
    """Parsers over stored metadata where a filter holds, then over the original metadata of others."""
    ingest.register_parser("mark", lambda d, value: {**d, "mark": value})
    step = lambda v: [{"function": "mark", "kwargs": {"value": v}}]
    records, media = recorded(documents)
    records = records.withColumn("metadata", F.concat(F.expr("substring(metadata, 1, length(metadata) - 1)"), F.lit(',"lang":"'), F.when(F.col("datastore.hash") == F.md5(F.lit("en")), "en").otherwise("other"), F.lit('"}')))
    col = Collection(documents.sparkSession, "documents").insert_media(records, media, step(0))
    col.transform_metadata(step(1), "append", {"media_info.filesize": {"$gt": 2000}})
    col.transform_metadata(step(2), "overwrite", {"metadata.lang": "en"})
    return col.tables["parsed"].select(doc_id(), filters.json_value("metadata", "mark", "bigint").alias("mark"), F.size("parse_seq").alias("steps"))


@query(f"""
    SELECT event_id, row_number() OVER (ORDER BY event_id) AS orid, epoch(date_trunc('second', ts) AT TIME ZONE '{ZONE}') AS "absStart",
           epoch(date_trunc('second', ts) AT TIME ZONE '{ZONE}') + 2 AS "absStop" FROM events""")
def timed_insert(events):
    """Recordings with absolute time: of each event, two seconds long."""
    path = F.concat(F.lit("/e/"), F.col("event_id"))
    store = F.struct(*[F.lit(v).alias(k) for k, v in (("hash", "h"), ("type", "direct"), ("conf", "{}"), ("metadata", "{}"))])
    metadata = F.to_json(F.struct(path.alias("path"), F.lit(1.0).alias("timeexp"), F.date_format("ts", "dd-MM-yyyy HH:mm:ss").alias("datetime"), F.lit(ZONE).alias("timezone"), "event_id"))
    records = events.select(store.alias("datastore"), F.struct(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("fkey")).alias("source"), metadata.alias("metadata"))
    media = events.select(path.alias("path"), F.md5(path).alias("md5"), F.lit(1).cast("long").alias("filesize"), *[F.lit(v).alias(k) for k, v in (("samplerate", 8000), ("sampwidth", 2), ("nchannels", 1), ("nframes", 16000))])
    parsed = TimedCollection(events.sparkSession, "timed").insert_media(records, media).tables["parsed"]
    number = lambda k: filters.json_value("metadata", k, "double").alias(k)
    return parsed.select(filters.json_value("metadata", "event_id", "bigint").alias("event_id"), "orid", number("absStart"), number("absStop"))


@query(f"""
    SELECT event_id, epoch(date_trunc('second', ts) AT TIME ZONE '{ZONE}') AS "absStart" FROM events""")
def built_time(events):
    """Time fields of recordings that were stored without them."""
    metadata = F.to_json(F.struct(F.date_format("ts", "dd-MM-yyyy HH:mm:ss").alias("datetime"), F.lit(ZONE).alias("timezone"), "event_id"))
    info = F.struct(*[(F.lit(1.5) if f.name == "duration" else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["parsed"]["media_info"].dataType])
    have = {"orid": F.col("event_id"), "metadata": metadata, "media_info": info}
    parsed = events.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["parsed"]])
    after = ingest.build_time({**empty_tables(events), "parsed": parsed})["parsed"]
    return after.select(filters.json_value("metadata", "event_id", "bigint").alias("event_id"), filters.json_value("metadata", "absStart", "double").alias("absStart"))


@query("SELECT row_number() OVER (ORDER BY hash) AS id, hash, 'direct' AS type FROM (SELECT DISTINCT md5(lang) AS hash FROM documents)")
def datastores_by_hash(documents):
    """Datastores of an insert: each once, by the hash of its description."""
    return catalogue(documents).tables["datastores"].select("id", "hash", "type")


@query(f"SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS size, max(orid) AS top FROM {TAKEN} GROUP BY lang")
def free_select(documents):
    """Any SQL after ``SELECT`` over the tables of a collection."""
    col = catalogue(documents)
    rows = col.select("p.orid, p.media_info.filesize AS size, d.hash FROM {parsed} p JOIN {original} o ON p.orid = o.id JOIN {datastores} d ON get_json_object(o.source, '$.source_id') = d.id")
    names = documents.select("lang", F.md5("lang").alias("hash")).distinct()
    return rows.join(names, "hash").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("orid").alias("top"))


@query(f"""
    SELECT doc_id, orid, CASE WHEN b < 60 THEN 'a' ELSE 'b' END AS split, fold FROM (
        SELECT *, ('0x' || substr(md5(orid::VARCHAR), 1, 8))::BIGINT % 100 AS b, ('0x' || substr(md5(orid::VARCHAR), 9, 8))::BIGINT % 3 AS fold FROM {TAKEN}) WHERE n_chars > 500""")
def dataset_media(documents):
    """The recordings of a dataset, with their split and fold."""
    config = {"globalParams": {"collectionFilter": {"media_info.filesize": {"$gt": 500}}, "groupingFields": ["doc_id"]}, "splittingParams": {"folds": 3, "splits": {"a": 60, "b": 40}}}
    media = Dataset(catalogue(documents), "d", scratch(documents, "dataset"), config).get_media()
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "orid", "split", "fold")


@query(f"SELECT doc_id, orid, concat_ws('/', source, doc_id) AS path FROM {TAKEN} JOIN (SELECT doc_id, source FROM documents) USING (doc_id)")
def dumped_collection(documents):
    """A collection that was dumped, and opened from the dump."""
    path = scratch(documents, "dump")
    catalogue(documents).dump(path)
    return Collection(documents.sparkSession, "documents", path).get_media().select(doc_id(), "orid", "path")


@query("SELECT lang, source, count(*) AS count FROM documents WHERE lang = 'en' GROUP BY lang, source ORDER BY source")
def soundscape_group(documents):
    """Groups of a soundscape in order of their keys, those of one language, if it has any."""
    fragment = documents.select(F.col("doc_id").alias("orid"), "lang", "source", (F.col("n_chars") / 10.0).alias("fileDuration"))
    scape = Soundscape("s", fragment, {"globalParams": {"groupFields": ("lang", "source")}})
    if not scape.group_exists({"lang": "en"}):
        return scape.get_groups().limit(0)
    return filters.in_group(scape.get_groups(), {"lang": "en"}).orderBy("source")


@query("SELECT l_orderkey AS orid, l_returnflag AS kind, l_linenumber::BIGINT AS id, round(l_discount, 6) AS start_time, round(l_extendedprice, 6) AS max_freq FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A')")
def note_rows(lineitem, orders):
    """Annotations of recordings, nested by group, as rows again; of two groups of theirs."""
    media = orders.select(F.col("o_orderkey").alias("orid"), F.struct("o_totalprice").alias("media_info"))
    nested = joins.annotated(line_notes(lineitem), media, None, (), ("notetype",))
    rows = geometry.select_notes(geometry.notes(nested), groups={"gkey_notetype": ["R", "A"]})
    return rows.select("orid", F.col("gkey_notetype").alias("kind"), "id", F.round("start_time", 6).alias("start_time"), F.round("max_freq", 6).alias("max_freq"))


@query("SELECT conv_id AS orid, count(*) AS notes, string_agg(turn::VARCHAR, ',' ORDER BY turn, length(text)) AS turns FROM conversations GROUP BY conv_id")
def note_geometries(conversations):
    """Vertices of the annotations of each recording, in order of id."""
    verts = F.array(F.array(F.col("turn").cast("double"), F.length("text").cast("double")))
    rows = conversations.select(F.col("conv_id").alias("orid"), F.col("turn").alias("id"), verts.alias("verts"))
    grouped = geometry.geometries(rows, ["orid"])
    turns = F.array_join(F.transform("verts", lambda v: F.get(F.get(v, F.lit(0)), F.lit(0)).cast("int").cast("string")), ",")
    return grouped.select("orid", F.size("verts").cast("long").alias("notes"), turns.alias("turns"))


@query(f"SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def display_time(events):
    """The same instants as wall time of another zone."""
    return events.select("event_id", F.date_format(timefns.transform_time(F.col("ts"), ZONE), "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("SELECT event_id, event_type FROM events")
def find_all(events):
    """No filter: all rows."""
    return filters.find(events, None).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE (props::JSON ->> '$.k')::BIGINT < 50 AND value > 10 AND event_type <> 'view'")
def routed_keys(events):
    """Keys that go to JSON text, to a struct and to a plain column, by their first segment."""
    rows = events.select("event_id", "event_type", F.struct("value").alias("media_info"), F.col("props").alias("metadata"))
    return filters.find(rows, {"metadata.k": {"$lt": 50}, "media_info.value": {"$gt": 10}, "event_type": {"$ne": "view"}}).select("event_id")
