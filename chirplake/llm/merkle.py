"""Merkle manifest: leaves by group in order, levels built bottom-up and stored, proofs pushed top-down from parents to children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.llm.shared import few, forget, saved

#: Consecutive nodes that become one.
FAN = 3
#: A step of a proof: the node's place in its run, and the digests of the others in the run, left to right.
PROOF = "array<struct<place int, others binary>>"


def digest(text: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(text, 256)


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(*fields: Column) -> Column:
    """Digest of fields, each as ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _run_digest() -> Column:
    """What the nodes of a run become."""
    return F.unhex(digest(F.array_join(F.transform("kids", lambda k: hexed(k["hash"])), "")))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and a proof lead to."""

    def step(at: Column, e: Column) -> Column:
        size, before = F.octet_length(e["others"]), e["place"] * 32
        left = e["others"].substr(F.lit(1), before)
        right = e["others"].substr(before + 1, size - before)
        return digest(F.concat(hexed(left), at, hexed(right)))

    return F.aggregate(proof, start, step)


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's digests (hex), lowest level first."""
    return digest(F.array_join(F.transform(proof, lambda e: hexed(e["others"])), ""))


def positions(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``pos``, their place from 0 in an order over all of them; the stored table that they are read from).

    Rows are range-sorted and stored with their place in their part; what the parts before hold is added. The window has
    a row a part.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "merkle-order")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "_part").withColumn("pos", F.col("before") + F.col("_at")).drop("_part", "_at", "before"), placed


def build(nodes: DataFrame) -> list[DataFrame]:
    """The levels of trees, lowest first, each a stored table of runs (tree, n, idx, kids).

    ``nodes`` are the leaves (tree, n, idx, hash, row): a tree has n of them with idx from 0. ``kids`` are the nodes of a
    run, in order; idx is the place of what they become. A tree takes part in a level as long as it has many nodes there.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, size = [], 1
    while size < most:
        kid = F.struct(*[c for c in ("idx", "hash", "row") if c in nodes.columns])
        runs = nodes.where(F.col("n") > size).withColumn("kid", kid).withColumn("idx", F.floor(F.col("idx") / FAN))
        runs = saved(runs.groupBy("tree", "n", "idx").agg(F.sort_array(F.collect_list("kid")).alias("kids")), "merkle-level")
        levels.append(runs)
        nodes = runs.select("tree", "n", "idx", _run_digest().alias("hash"))
        size *= FAN
    return levels


def tops(levels: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """(tree, n, hash): what remains of each tree; its only leaf itself where it has one."""
    out, size = nodes.where("n = 1").select("tree", "n", "hash"), 1
    for runs in levels:
        last = (F.col("n") > size) & (F.col("n") <= size * FAN)
        out = out.unionByName(runs.where(last).select("tree", "n", _run_digest().alias("hash")))
        size *= FAN
    return out


def push(levels: list[DataFrame], nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((row, hash, proof, up) for every leaf, the stored tables it reads): each child puts its siblings before its parent's proof.

    ``roots`` (tree, n, proof, up) has what each tree's top inherits; ``up`` is handed down as it is. A level joins its
    stored runs with what the level above came to, a row of each for a run, so no key of the join repeats. Levels are
    deleted as they have been pushed through, but the lowest.
    """
    above = roots.limit(0).select("tree", F.lit(0).cast("long").alias("idx"), "proof", "up")
    stored: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        size = FAN**k
        own = roots.where((F.col("n") > size) & (F.col("n") <= size * FAN)).select("tree", F.lit(0).cast("long").alias("idx"), "proof", "up")
        runs = levels[k].drop("n").join(above.unionByName(own), ["tree", "idx"])
        child = runs.select("tree", "proof", "up", F.col("kids.hash").alias("all"), F.posexplode("kids").alias("place", "kid"))
        others = F.unhex(F.array_join(F.transform(F.filter("all", lambda x, i: i != F.col("place")), F.hex), ""))
        longer = F.concat(F.array(F.struct(F.col("place"), others.alias("others"))).cast(PROOF), F.col("proof"))
        if k:
            above = saved(child.select("tree", "kid.idx", longer.alias("proof"), "up"), "merkle-push")
            forget(*stored, levels[k])
            stored = [above]
        else:
            above = child.select("kid.row", "kid.hash", longer.alias("proof"), "up")
    lone = nodes.where("n = 1").join(roots.where("n = 1").drop("n"), "tree").select("row", "hash", "proof", "up")
    return (lone.unionByName(above) if levels else lone), [*stored, *levels[:1]]


def manifest(rows: DataFrame, leaf: Column, carry: dict[str, Column], order: str = "doc_id", group: str = "source") -> DataFrame:
    """(row, leaf, subroot, root, proof): a leaf for each row, proved under the subroot of its group and the root of all.

    ``row`` has the columns of ``carry``. Leaves of a group ascend by ``order``, nulls first, then by digest; rows alike
    in both are interchangeable. Groups ascend bytewise, null first. Every three consecutive nodes become their digest
    until one remains; an empty table has no rows, and no root. Digests are hex; :func:`fold` leads from a leaf and its
    proof to the root. Texts are read once, to hash them; levels hold digests and ``row``. Clashing names are kept apart.
    """
    spark = rows.sparkSession
    row = F.struct(*[c.alias(name) for name, c in carry.items()])
    leaves = saved(
        rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.unhex(leaf).alias("hash"), row.alias("row")).withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves"
    )
    placed, _ = positions(leaves, ["g", "o", "hash", "tie"])
    forget(leaves)
    groups = saved(placed.groupBy("g").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    ordered, order_table = positions(groups, ["first"])
    trees = saved(ordered.select("g", "first", "n", F.col("pos").alias("tree")), "merkle-trees")
    forget(groups, order_table)
    joined = placed.join(few(trees.withColumnRenamed("g", "_g")), F.col("g").eqNullSafe(F.col("_g")))
    nodes = joined.select("tree", "n", (F.col("pos") - F.col("first")).alias("idx"), "hash", "row")
    levels = build(nodes)

    heads = saved(tops(levels, nodes), "merkle-tops")
    many = heads.count()
    upper = heads.select(F.lit(0).cast("long").alias("tree"), F.lit(many).cast("long").alias("n"), F.col("tree").alias("idx"), "hash", F.struct("tree", "n").alias("row"))
    upper_levels = build(upper)
    first = tops(upper_levels, upper).select(hexed(F.col("hash"))).first()
    root = first[0] if first else None

    nothing = F.array().cast(PROOF)
    top = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(many).cast("long").alias("n"), nothing.alias("proof"), F.lit(None).cast("binary").alias("up"))
    known, read = push(upper_levels, upper, top)
    roots = saved(known.select("row.tree", "row.n", "proof", F.col("hash").alias("up")), "merkle-roots")
    forget(heads, *read)
    proved, _ = push(levels, nodes, roots)
    return proved.select("row", hexed(F.col("hash")).alias("leaf"), hexed(F.col("up")).alias("subroot"), F.lit(root).cast("string").alias("root"), "proof")


def verify(proved: DataFrame, start: Column) -> DataFrame:
    """``proved`` with folded_root, from ``start`` (a leaf worked out anew) and the stored proof, and whether it is the root."""
    folded = proved.withColumn("folded_root", fold(start, F.col("proof")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
