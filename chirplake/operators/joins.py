"""Recordings with their annotations, nested; and set-like joins on ids."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.operators.filters import find, json_value

NOTE_FIELDS = (
    "id", "notetype", "orid", "file_start", "file_end", "start_time", "end_time", "duration", "max_freq", "min_freq", "verts", "wkt",
    "label", "groups", "metadata",
)


def annotated(
    annotations: DataFrame,
    parsed: DataFrame,
    query: dict | None = None,
    media_fields: tuple[str, ...] = (),
    subgroup: tuple[str, ...] = (),
    **options: Any,
) -> DataFrame:
    """(orid, media_info, media fields, data): each recording with the annotations that a query selects, as a list.

    Without a subgroup an element of data is an annotation. With one, an element is a group: its key values and its
    annotations. A subgroup key is a column or a path of a JSON column; ``orid`` is always a key and may be left out.
    Lists are in order of id.
    """
    notes = find(annotations, query, **options).where(F.col("orid").isNotNull())  # those of no recording have no place
    names = [c for c in NOTE_FIELDS if c in notes.columns]
    note = F.struct(*[F.col(c) for c in names])
    keys = [k for k in subgroup if k != "orid"]
    if keys:
        columns = [_key(notes, k).alias("gkey_" + k.replace(".", "_")) for k in keys]
        grouped = notes.select(*columns, F.col("orid"), note.alias("note")).groupBy("orid", *[f"gkey_{k.replace('.', '_')}" for k in keys])
        groups = grouped.agg(F.array_sort(F.collect_list("note")).alias("data"))
        note = F.struct(*[F.col(f"gkey_{k.replace('.', '_')}") for k in keys], F.lit("group").alias("atype"), F.col("data"))
        notes = groups.select("orid", note.alias("note"))
    else:
        notes = notes.select("orid", F.struct(*[F.col(c) for c in names if c == "id"], F.lit("single").alias("atype"), *[F.col(c) for c in names if c != "id"]).alias("note"))
    lists = notes.groupBy("orid").agg(F.array_sort(F.collect_list("note")).alias("data"))
    media = parsed.select("orid", "media_info", *[F.col(c) for c in media_fields if c not in ("orid", "media_info")])
    return media.join(lists, "orid")


def _key(df: DataFrame, key: str) -> Column:
    first, _, rest = key.partition(".")
    return json_value(first, rest) if rest and key not in df.columns else F.col(key)


def with_ids(df: DataFrame, ids: DataFrame, column: str = "orid") -> DataFrame:
    """Rows whose id is among others'."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, column: str = "orid") -> DataFrame:
    """Rows whose id isn't among others'."""
    return df.join(ids.select(column).distinct(), column, "left_anti")
