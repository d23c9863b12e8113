"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from chirplake.llm.shared import WORD, forget, saved

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the times that a document may be taken.
BUDGET, REPEATS = 1.5, 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from one (source, source_size) row per source.

    Shares by weight that would exceed ``repeats`` times their source are set to that; what they leave is shared anew by
    weight. The level at which that ends is found in one pass over the sources in order of size per weight.
    """
    order = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    x = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * repeats)
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    x = x.withColumn("before", F.coalesce(F.sum("cap").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("left", F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("level", (F.lit(float(budget)) * F.sum("source_size").over(everything) - F.col("before")) / F.col("left"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    x = x.withColumn("level", F.max(fits).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return x.select("source", "source_size", target.alias("target"))


def words(text: str = "text") -> Column:
    """Size of a text in words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def starts(x: DataFrame, offsets: DataFrame, *last: Column | str) -> DataFrame:
    """``x`` with its source's numbers and ``start``, the words of its source before it.

    Sums run over hash bins of a source, so that a source with any share of the rows has no task of its own.
    """
    order = Window.partitionBy(*PLACE).orderBy("key", "size", *last)
    own = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("own", own).join(offsets, PLACE).withColumn("start", F.col("offset") + F.col("own")).drop("own", "offset")


#: Never null, so that sums and join need the rows together in one way only.
PLACE = ["kind", "none", "bin"]


def finish(copy: Column) -> Column:
    """Virtual finish time of a copy of a document: its source's words up to its end over the source's target."""
    return (F.col("start") + F.col("size") + copy * F.col("source_size")) / F.col("target")


def last_served(copies: DataFrame, budget: float) -> Row | None:
    """(time, none, kind) of the last copy within the budget, none if there is none.

    The copies are range-sorted by finish time over all sources and written in that order with the part that each is in;
    the words of all parts before it, and of the copies before it in its part, are what the queue has served by then.
    """
    placed = copies.repartitionByRange("time", "none", "kind").withColumn("part", F.spark_partition_id())
    placed = saved(placed.sortWithinPartitions("time", "none", "kind"), "mix-queue")
    parts = placed.groupBy("part").agg(F.sum("size").alias("words"))
    before = parts.select("part", (F.sum("words").over(Window.orderBy("part")) - F.col("words")).alias("before"))  # a row a part
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("time", "none", "kind"))
    queue = placed.withColumn("inside", inside).join(F.broadcast(before), "part")
    last = queue.where(F.col("before") + F.col("inside") <= budget).agg(F.max(F.struct("time", "none", "kind")).alias("cut")).first()["cut"]
    forget(placed)
    return last


def plan_mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(row, mix): each row of ``docs`` as a struct, and struct mix: size, source_size, target, start, copies.

    Within its source each document has a place in a shuffle by md5 of its id; ``start`` is the source's words before
    it. A second copy of every document follows the first copies. A copy's virtual finish time is (words of its source up
    to its end) / target. All copies are range-sorted by finish time and cut where the words of those before it and its own
    go beyond the total budget: so the mix has the budget within one document, and each source is within about one
    document of its target, as each waits for its next one to finish.

    Nulls: a null text has size 0, a null source is the last source, null ids are shuffled by a hash of the row. Documents
    without words are never taken. Repeated rows are documents of their own. An empty table gives an empty table.
    """
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("~"), F.xxhash64(*docs.columns).cast("string"))))
    kind = F.coalesce(F.col(source).cast("string"), F.lit(""))
    x = docs.select(F.struct(*docs.columns).alias("row"), size.alias("size"), kind.alias("kind"), F.col(source).isNull().alias("none"), key.alias("key"))
    x = x.withColumn("bin", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    narrow = saved(x.select(*PLACE, "key", "size", F.xxhash64("row").alias("tie")), "mix-sizes")
    bins = saved(narrow.groupBy(*PLACE).agg(F.sum("size").alias("words")), "mix-bins")
    before = F.sum("words").over(Window.partitionBy("kind", "none").orderBy("bin")) - F.col("words")
    named = bins.groupBy("kind", "none").agg(F.sum("words").alias("source_size")).select(F.when(~F.col("none"), F.col("kind")).alias("source"), "source_size")
    targets = source_targets(named).select(F.coalesce("source", F.lit("")).alias("kind"), F.col("source").isNull().alias("none"), "source_size", "target")
    offsets = bins.select(*PLACE, before.alias("offset")).join(targets, ["kind", "none"])
    times = F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), finish)
    copies = starts(narrow.where("size > 0"), offsets, "tie").select("kind", "none", "size", F.explode(times).alias("time"))
    total = float(bins.agg(F.sum("words")).first()[0] or 0)
    last = last_served(copies, total * min(BUDGET, REPEATS))
    forget(narrow)
    taken = F.lit(0)
    if last:
        cut = F.struct(F.lit(last["time"]).alias("time"), F.lit(last["none"]).alias("none"), F.lit(last["kind"]).alias("kind"))
        for c in range(REPEATS):
            taken = taken + (F.struct(finish(F.lit(c)).alias("time"), "none", "kind") <= cut).cast("int")
    copies = F.when(F.col("size") > 0, taken).otherwise(0)
    x = starts(x, offsets, F.xxhash64("row"))
    return x.select("row", F.struct("size", "source_size", "target", "start", copies.alias("copies")).alias("mix"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, globally range-sorted by virtual finish time.

    Same columns as ``docs``; cases as in :func:`plan_mix`.
    """
    planned = plan_mix(docs, words(text), doc_id, source).where("mix.copies > 0")
    taken = planned.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("mix.copies") - 1)))
    time = (F.col("mix.start") + F.col("mix.size") + F.col("copy") * F.col("mix.source_size")) / F.col("mix.target")
    return taken.orderBy(time, F.col(f"row.{doc_id}")).select("row.*")
