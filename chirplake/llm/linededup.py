"""Line dedup by overlapping windows of three lines; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 3
BLANKS = " \t\r\x0b\x0c"


def windows(docs: DataFrame) -> DataFrame:
    """(id, tie, k, at, h, g): every window of SPAN lines that aren't blank; k counts such lines, at has the line numbers."""
    numbered = F.transform(F.split("text", "\n", -1), lambda l, i: F.struct(F.btrim(l, F.lit(BLANKS)).alias("l"), i.alias("i")))
    x = docs.select("id", "tie", F.filter(numbered, lambda s: s.l != "").alias("s")).where(F.size("s") >= SPAN)

    def window(k: Column) -> Column:
        three = [F.get("s", k + j) for j in range(SPAN)]
        lines = [s.l for s in three]
        return F.struct(k.alias("k"), F.array(*[s.i for s in three]).alias("at"), F.xxhash64(*lines).alias("h"), F.hash(*lines).alias("g"))

    return x.select("id", "tie", F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - SPAN), window)).alias("w")).select("id", "tie", "w.*")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, text, removed): each row of ``docs`` as a struct, its text without repeated passages, and lines removed.

    Lines end at ``\\n``. Windows are three consecutive lines that aren't blank, compared without the white space at
    their ends; hashed to 96 bits, they are counted over all documents. Where a window repeats, its first occurrence (by
    doc_id, then position) stays, and the lines of all later ones go, overlaps merged; a later one that runs into the
    first of the same document loses the lines after that one's end only. Blank lines stay.

    A null text stays null with 0 removed; texts of fewer than three such lines stay. Rows of the same doc_id and text
    count as one document, rows of the same doc_id only as two; null ids come last. A text of which all lines go becomes
    empty. Rows out are rows in, whatever other columns are called; an empty table gives an empty table. A window that
    any share of the lines has is counted map-side and then joined, where adaptive execution splits it.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    all_windows = windows(rows.select("id", "tie", "text"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "tie", "k")
    repeated = all_windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first")
    later = all_windows.join(repeated, ["h", "g"]).where(place > F.col("first"))
    own = F.expr("id <=> first.id AND tie = first.tie")
    goes = F.filter("at", lambda i, j: ~own | (F.col("k") + j >= F.col("first.k") + SPAN))
    gone = later.select("id", "tie", F.explode(goes).alias("i")).groupBy("id", "tie").agg(F.collect_set("i").alias("gone"))
    out = rows.alias("r").join(gone.alias("g"), F.expr("r.id <=> g.id AND r.tie = g.tie"), "left")
    lines = F.split("r.text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return out.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("r.text")).otherwise(kept).alias("text"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("removed"),
    )
