"""Schemas of the catalogue tables and of rejected records."""

from __future__ import annotations

from pyspark.sql import types as T

#: Kinds of annotation; those with a geometry need its frequency limits and its text.
NOTE_TYPES = ("weak", "interval", "bbox", "linestring", "multilinestring", "polygon", "multipolygon")
GEOMETRIES = NOTE_TYPES[2:]

#: Columns that hold JSON text.
JSON_COLUMNS = ("metadata", "label", "groups", "conf", "source")

LONG, INT, DOUBLE, TEXT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


MEDIA_INFO = struct(path=TEXT, filesize=LONG, timeexp=DOUBLE, samplerate=INT, sampwidth=INT, length=LONG, nchannels=INT, duration=DOUBLE, md5=TEXT)
PARSER = struct(path=TEXT, function=TEXT, kwargs=TEXT, original_path=TEXT, creation=TEXT)

TABLES = {
    "datastores": struct(id=LONG, hash=TEXT, type=TEXT, conf=TEXT, metadata=TEXT),
    "original": struct(id=LONG, source=TEXT, metadata=TEXT),
    "parsed": struct(orid=LONG, md5=TEXT, path=TEXT, original_path=TEXT, parse_seq=T.ArrayType(PARSER), media_info=MEDIA_INFO, metadata=TEXT),
    "annotations": struct(
        id=LONG, notetype=TEXT, orid=LONG, file_start=DOUBLE, file_end=DOUBLE, start_time=DOUBLE, end_time=DOUBLE, duration=DOUBLE,
        max_freq=DOUBLE, min_freq=DOUBLE, verts=T.ArrayType(T.ArrayType(DOUBLE)), wkt=TEXT, label=TEXT, groups=TEXT, metadata=TEXT,
    ),
}
REJECTS = struct(record=TEXT, reason=TEXT)
