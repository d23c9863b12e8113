"""Samples that are the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chirplake.operators.filters import quoted


def stratified_sample(df: DataFrame, fields: list[str], size: int = -1, replace: bool = False, key: str = "orid", seed: int = 0) -> DataFrame:
    """At most ``size`` rows of each group of the fields that ``df`` has; -1 is all rows. Groups with a null are dropped.

    A field is a column's whole name, dots included.

    Rows are in order of a hash of ``key``. Without replacement the first come; ranks are cut before the shuffle, so a
    group of any size sends few rows. With replacement a group larger than ``size`` is drawn from ``size`` times.
    """
    if size < 0:
        return df
    plain = {f"_g{i}": f for i, f in enumerate(f for f in fields if f in df.columns)}
    known = df.withColumns({g: F.col(quoted(f)) for g, f in plain.items()})
    fields, columns = list(plain), [F.col(quoted(c)) for c in df.columns]
    for g in fields:
        known = known.where(F.col(g).isNotNull())
    order = F.md5(F.concat_ws(":", F.lit(str(seed)) if seed else F.lit(None).cast("string"), F.col(quoted(key)).cast("string")))
    ranked = known.withColumn("_rank", F.row_number().over(Window.partitionBy(*fields).orderBy(order, F.col(quoted(key)))))
    if not replace:
        return ranked.where(F.col("_rank") <= size).select(*columns)
    sizes = known.groupBy(*fields).agg(F.count(F.lit(1)).alias("_n"))
    draw = F.explode(F.when(F.col("_n") > size, F.sequence(F.lit(1), F.lit(size))).otherwise(F.array(F.lit(0))))
    draws = sizes.withColumn("_d", draw)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(g).cast("string") for g in fields], F.col("_d").cast("string")))
    pick = (F.conv(F.substring(place, 1, 12), 16, 10).cast("long") % F.col("_n")).cast("int") + 1
    drawn = draws.where("_d > 0").withColumn("_rank", pick).drop("_n", "_d")
    taken = ranked.join(drawn, [*fields, "_rank"]).select(*columns)
    small = known.join(sizes.where(F.col("_n") <= size), fields).select(*columns) if fields else known.limit(0).select(*columns)
    return taken.union(small)


def dataset_split(df: DataFrame, key: str, shares: dict[str, int] | None = None, folds: int = 5) -> DataFrame:
    """``df`` with split and fold from a hash of the key: the same row always falls in the same part."""
    shares = shares or {"train": 70, "test": 20, "validation": 10}
    if sum(shares.values()) != 100:
        raise ValueError("the shares must add up to 100")
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    split, upto = None, 0
    for name, share in shares.items():
        upto += share
        split = F.when(bucket < upto, name) if split is None else split.when(bucket < upto, name)
    fold = F.conv(F.substring(F.md5(F.col(key).cast("string")), 9, 8), 16, 10).cast("long") % folds
    return df.withColumn("split", split).withColumn("fold", fold)
