"""Counts, levels, cell statistics, dense domains, percentiles and scores."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.operators.filters import find, quoted

#: What a cell without rows has in a dense matrix.
MISSING = -1000.0


def count(df: DataFrame, query: dict | None = None, where: str | None = None, **options: Any) -> DataFrame:
    """One row: how many rows a filter selects."""
    return find(df, query, where, **options).agg(F.count(F.lit(1)).alias("count"))


def field_levels(df: DataFrame, field: Column, name: str) -> DataFrame:
    """Distinct values of a field; null is a level."""
    return df.select(field.alias(name)).distinct()


def combinations(df: DataFrame, fields: list[str]) -> DataFrame:
    """Every combination of the levels that fields have, also those without rows."""
    out = field_levels(df, F.col(quoted(fields[0])), fields[0])
    for f in fields[1:]:
        out = out.crossJoin(field_levels(df, F.col(quoted(f)), f))
    return out


def group_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of each group; a field is a column's whole name, dots included."""
    return df.groupBy(*[F.col(quoted(f)) for f in fields]).agg(F.count(F.lit(1)).alias("count"))


def crono_counts(splits: DataFrame, cell: str = "timeCell", orid: str = "orid") -> DataFrame:
    """Rows with an id in each calendar cell."""
    return splits.groupBy(cell).agg(F.count(orid).alias("count"))


def cell_stats(df: DataFrame, keys: list[str], values: list[str], stat: str = "mean") -> DataFrame:
    """Mean, std (sample) or variance of each value in each cell; a missing value counts as 0, as in a filled matrix."""
    how = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp}[stat]
    return df.groupBy(*keys).agg(*[how(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(v) for v in values])


def densify(cells: DataFrame, low: int, high: int, cell: str = "timeCell", fill: float = MISSING) -> DataFrame:
    """One row for each cell from low to high, both included, filled where there is none."""
    domain = cells.sparkSession.range(low, high + 1).withColumnRenamed("id", cell)
    rest = [c for c in cells.columns if c != cell]
    return domain.join(cells, cell, "left").select(cell, *[F.coalesce(c, F.lit(fill)).alias(c) for c in rest])


def missing_cells(df: DataFrame, low: int, high: int, cell: str = "timeCell") -> DataFrame:
    """Cells of a range that have no rows."""
    domain = df.sparkSession.range(low, high + 1).withColumnRenamed("id", cell)
    return domain.join(df.select(cell).distinct(), cell, "left_anti")


def crono_matrix(df: DataFrame, values: list[str], low: int, high: int, cell: str = "timeCell", stat: str = "mean") -> DataFrame:
    """(cell, level, value, norm): statistics by cell and level, dense, and scaled by their extremes; missing cells are
    null in norm.

    The extremes are one row, joined back, so nothing is gathered in one task.
    """
    long = densify(cell_stats(df, [cell], values, stat), low, high, cell).unpivot(cell, values, "level", "value")
    ends = long.where(F.col("value") != MISSING).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = (F.col("value") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))
    return long.crossJoin(F.broadcast(ends)).select(cell, "level", F.when(F.col("value") != MISSING, F.col("value")).alias("value"), F.when(F.col("value") != MISSING, scaled).alias("norm"))


#: Partitions that rows are dealt to at most, where shares are numbered.
DEALT_PARTITIONS = 1000


def dealt(df: DataFrame, weight: str, order: list[str], most: int, tasks: int = 1, number: str | None = None) -> DataFrame:
    """``df`` in shares of about equal weight, at most about ``most`` each, in an order; at least ``tasks`` of them.

    Rows are laid end to end: weights are summed up inside the parts of a range sort, and what the parts before hold is
    added. The share of a row is where its middle lies, so a share has more than its part of the whole by one row at most.
    A share is a partition. With ``number`` a column of that name has the share of a row, and a partition has a run of shares
    once there are more of them than ``DEALT_PARTITIONS``: shares of a fixed weight are as many as the rows allow, and tasks
    needn't be.
    """
    from chirplake.operators.ingest import stored

    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sums = parts.groupBy("_part").agg(F.sum(weight).alias("w"))
    total = sums.agg(F.sum("w")).first()[0] or 0
    n = max(int(-(-total // most)), tasks)
    before = sums.select("_part", (F.sum("w").over(Window.orderBy("_part")) - F.col("w")).alias("_before"))  # a row for each part
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy("_at"))
    place = F.col("_before") + inside - F.col(weight) / 2
    task = F.least(F.greatest(F.floor(place / F.lit(max(float(total) / n, 1e-300))), F.lit(0)), F.lit(n - 1)).cast("int")
    placed = parts.join(F.broadcast(before), "_part").withColumn("_task", task)
    if number is None:
        return placed.repartitionById(n, F.col("_task")).sortWithinPartitions(*order).select(*df.columns)
    run = -(-n // DEALT_PARTITIONS)
    some = placed.repartitionById(-(-n // run), F.floor(F.col("_task") / run).cast("int"))
    return some.sortWithinPartitions(*order).select(*df.columns, F.col("_task").cast("long").alias(number))


#: Rank error of a sketch is the rows over this; the exact values are looked for within twice that.
ACCURACY = 100_000


def percentile_table(df: DataFrame, values: list[str], percentiles: tuple[float, ...], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, level, percentile, value): exact percentiles, between ranks by proportion, of each of the values in each group.

    ``level`` and ``percentile`` are places in the lists given. All values and groups go through two passes together, and
    nothing is run before the result is: sketches that are merged map-side bracket each percentile, then what lies below a
    bracket is counted and the distinct values inside it, a share of 4 / ACCURACY of a group's rows, are ranked. So no
    buffer holds all values of a group. Nulls don't count; where all of a group's values are null, there is no row.
    """
    names = [f"_k{i}" for i in range(len(by))]
    doubles = F.array(*[F.col(quoted(v)).cast("double") for v in values])
    long = df.select(*[F.col(quoted(c)).alias(k) for c, k in zip(by, names, strict=True)], F.posexplode(doubles).alias("level", "v")).where("v IS NOT NULL")
    slack = 2.0 / ACCURACY
    around = [min(max(p / 100.0 + s, 0.0), 1.0) for p in percentiles for s in (-slack, slack)]
    sketched = long.groupBy(*names, "level").agg(F.count("v").alias("n"), F.percentile_approx("v", around, ACCURACY).alias("ends"))
    at = lambda j: (F.lit(percentiles[j] / 100.0) * (F.col("n") - 1)).alias("at")
    end = lambda j, name: F.get("ends", F.lit(j)).alias(name)
    brackets = F.array(*[F.struct(F.lit(j).alias("percentile"), at(j), end(2 * j, "low"), end(2 * j + 1, "high")) for j in range(len(percentiles))])
    found = sketched.select(*[F.col(k).alias(f"_b{k}") for k in names], F.col("level").alias("_level"), brackets.alias("brackets"))
    found = found if by else F.broadcast(found)  # a row for each value, if there are no groups
    met = long.join(found, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in names], F.col("level") == F.col("_level")))
    seen = met.select(*names, "level", "v", F.explode("brackets").alias("b"))
    side = F.when(F.col("v") < F.col("b.low"), -1).when(F.col("v") > F.col("b.high"), 1).otherwise(0).alias("side")
    inside = F.when((F.col("v") >= F.col("b.low")) & (F.col("v") <= F.col("b.high")), F.col("v"))
    # what lies outside a bracket is one row for each task; of it the value next to the bracket may be wanted, as ranks are rounded
    nearest = F.when(F.col("side") < 0, F.max("v")).otherwise(F.min("v"))
    counted = seen.select(*names, "level", "v", "b.percentile", "b.at", side, inside.alias("inside")).groupBy(*names, "level", "percentile", "at", "side", "inside")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), nearest.alias("v"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*names, "level", "percentile").orderBy("side", "v")))
    step = lambda k: F.min(F.when(F.col("upto") > F.floor("at") + k, F.col("v")))
    got = upto.groupBy(*names, "level", "percentile", "at").agg(step(0).alias("low"), step(1).alias("high"))
    part = F.col("at") - F.floor("at")
    value = F.when(part > 0, (F.floor("at") + 1 - F.col("at")) * F.col("low") + part * F.col("high")).otherwise(F.col("low"))
    return got.select(*[F.col(k).alias(c) for c, k in zip(by, names, strict=True)], "level", "percentile", value.alias("value"))


def exact_percentiles(df: DataFrame, values: list[str], percentiles: tuple[float, ...]) -> list[list[float]]:
    """The percentiles of each of the values as numbers on the driver; see :func:`percentile_table`."""
    out: list[list[float]] = [[None] * len(percentiles) for _ in values]
    for r in percentile_table(df, values, percentiles).collect():
        out[r["level"]][r["percentile"]] = r["value"]
    return out


def percentile_scores(df: DataFrame, values: list[str], percentiles: tuple[float, float], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``df`` with score: how many of the values lie between their percentiles in the row's group, both included.

    Null if any value is null. Nothing is run before the result is.
    """
    table = percentile_table(df, values, percentiles, [*by])
    names = [f"_k{i}" for i in range(len(by))]
    table = table.toDF(*names, "level", "percentile", "value")
    ends = table.groupBy(*names, "level").agg(*[F.max(F.when(F.col("percentile") == j, F.col("value"))).alias(c) for j, c in ((0, "low"), (1, "high"))])
    limits = ends.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("low", "high")))).alias("_limits"))
    doubles = F.array(*[F.col(quoted(v)).cast("double") for v in values])
    limit = lambda i: F.element_at("_limits", i)
    inside = F.transform(doubles, lambda v, i: v.between(limit(i)["low"], limit(i)["high"]).cast("int"))
    on = reduce(and_, [F.col(quoted(c)).eqNullSafe(F.col(k)) for c, k in zip(by, names, strict=True)], F.lit(True))
    joined = df.join(limits if by else F.broadcast(limits), on, "left")  # one row, if there are no groups
    return joined.select(*[F.col(quoted(c)) for c in df.columns], F.aggregate(inside, F.lit(0), lambda a, x: a + x).alias("score"))


def top_scores(scored: DataFrame, n: int, ties: list[str], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The n rows of the highest score, of each group if there are any, ties by the columns given.

    Spark keeps n rows of a group in each task before it brings them together.
    """
    order = [F.desc("score"), *ties]
    if not by:
        return scored.orderBy(*order).limit(n)
    ranked = scored.withColumn("_rank", F.row_number().over(Window.partitionBy(*[F.col(quoted(c)) for c in by]).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without a key are dropped. Ranks are cut map-side, so a hot key stays small."""
    ranked = df.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.where("_rank = 1").drop("_rank")
