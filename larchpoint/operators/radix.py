"""Radix trees: equal buckets of points in Z-order, and the binary hierarchy over the buckets' codes.

The hierarchy needs no iteration. Every leaf spells its code's prefixes; a prefix whose leaves continue with both bits
is an internal node, its range the span of its leaves and its split the last leaf that continues with 0. Leaves with
equal codes are told apart by further prefixes of their index. A node's ancestors are the internal nodes among its own
prefixes, so levels and parents are one equi-join and one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchpoint.functions import morton
from larchpoint.functions.morton import Bounds
from larchpoint.sources.points import infer_bounds
from larchpoint.storage import keep, with_rank

#: Bits of a code, and of a leaf's index behind it.
CODE, INDEX = 63, 40


def sort_points(points: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Points with code and pos, their place by code, then id."""
    box = bounds or infer_bounds(points)
    return with_rank(morton.with_code(points, box), ["code", "id"])


def bucket(sorted_points: DataFrame, leaf_size: int) -> DataFrame:
    """Points with the leaf they belong to."""
    if leaf_size < 1:
        raise ValueError("leaf_size must be positive")
    return sorted_points.withColumn("leaf", F.floor(F.col("pos") / leaf_size).cast("long"))


def leaves(bucketed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """leaf, code of its first point, lo and hi (inclusive)."""
    return bucketed.groupBy(*by, "leaf").agg(F.min("code").alias("code"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def _prefixes(rows: DataFrame, upto: str) -> DataFrame:
    """A row for each shorter prefix (p, pfx, ext) of (code, leaf); upto: how many."""
    deep = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.expr(upto))))
    return deep.withColumns(
        {
            "pfx": F.expr(f"CASE WHEN p >= {CODE} THEN code WHEN p = 0 THEN 0L ELSE shiftright(code, {CODE} - p) END"),
            "ext": F.expr(f"CASE WHEN p > {CODE} THEN shiftright(first, {CODE + INDEX} - p) ELSE 0L END"),
        }
    )


def hierarchy(leaf_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """node_id, parent, left, right, is_leaf, level, first, last (leaves), lo, hi (points, inclusive).

    by: columns that tell trees apart; all trees are built at once, each over its own leaves, numbered from 0.
    """
    leaf_rows = keep(leaf_rows)
    if by:
        size = leaf_rows.groupBy(*by).agg((F.count("*") - 1).alias("inner"))
        leaf_rows = keep(leaf_rows.join(size, list(by)))
        single = not leaf_rows.where("inner = 0").isEmpty()
    else:
        leaf_rows = leaf_rows.withColumn("inner", F.lit(leaf_rows.count() - 1).cast("long"))
        single = leaf_rows.count() == 1
    by = [*by, "inner"]
    inner = F.col("inner")
    ends = leaf_rows.select(*by, "leaf", "lo", "hi")
    twins = leaf_rows.groupBy(*by, "code").agg(F.count("*").alias("n")).where("n > 1").select(*by, "code", F.lit(True).alias("twin"))
    flagged = leaf_rows.select(*by, F.col("leaf").alias("first"), F.col("leaf").alias("last"), "code").join(twins, [*by, "code"], "left").withColumn("len", F.when(F.col("twin"), CODE + INDEX).otherwise(CODE))
    flagged = keep(flagged.select(*by, "code", "first", "last", "len"))
    spelled = _prefixes(flagged, "len - 1")
    bit = F.expr(f"CASE WHEN p >= {CODE} THEN shiftright(first, {CODE + INDEX - 1} - p) & 1 ELSE shiftright(code, {CODE - 1} - p) & 1 END")
    split = F.max(F.when(F.col("bit") == 0, F.col("first")))
    groups = spelled.withColumn("bit", bit).groupBy(*by, "p", "pfx", "ext").agg(F.min("first").alias("first"), F.max("first").alias("last"), split.alias("split"), F.min("code").alias("code"), F.min("bit").alias("b0"), F.max("bit").alias("b1"))
    internal = keep(groups.where("b0 = 0 AND b1 = 1").drop("b0", "b1"))
    every = internal.select(*by, "code", "first", "last", F.col("p").alias("len"), "split").where("len > 0").unionByName(flagged.withColumn("split", F.lit(None).cast("long")))
    above = internal.select(*by, "p", "pfx", "ext", F.struct("p", "split", F.col("first").alias("pf"), F.col("last").alias("pl")).alias("up"))
    found = _prefixes(every, "len - 1").join(above, [*by, "p", "pfx", "ext"]).groupBy(*by, "first", "last", "len", "split").agg(F.count("*").alias("level"), F.max("up").alias("up"))
    root = internal.where(F.col("last") - F.col("first") == inner).select(*by, "first", "last", F.col("p").alias("len"), "split", F.lit(0).cast("long").alias("level"), F.lit(None).cast(found.schema["up"].dataType).alias("up"))
    if single:
        alone = leaf_rows.where("inner = 0").select(*by, F.col("leaf").alias("first"), F.col("leaf").alias("last"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("split"), F.lit(0).cast("long").alias("level"), F.lit(None).cast(found.schema["up"].dataType).alias("up"))
        root = root.unionByName(alone)
    rows = found.join(root.select(*by, "first", "last"), [*by, "first", "last"], "left_anti").unionByName(root)
    is_leaf = F.col("split").isNull()
    node = F.when(F.col("up").isNull(), 0).when(is_leaf, inner + F.col("first")).when(F.col("up.split") == F.col("last"), F.col("last")).otherwise(F.col("first")).cast("long")
    child = lambda edge, at: F.when(is_leaf, -1).when(F.col(edge) == at, inner + at).otherwise(at).cast("long")
    rows = keep(rows.withColumns({"node_id": node, "is_leaf": is_leaf, "left": child("first", F.col("split")), "right": child("last", F.col("split") + 1)}))
    parents = rows.select(*by, F.col("first").alias("pf"), F.col("last").alias("pl"), F.col("node_id").alias("parent")).where("pf < pl")
    rows = rows.withColumns({"pf": F.col("up.pf"), "pl": F.col("up.pl")}).join(parents, [*by, "pf", "pl"], "left")
    low, high = ends.select(*by, F.col("leaf").alias("first"), "lo"), ends.select(*by, F.col("leaf").alias("last"), "hi")
    rows = rows.join(low, [*by, "first"]).join(high, [*by, "last"])
    return rows.select(*by[:-1], "node_id", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), "left", "right", "is_leaf", "level", "first", "last", "lo", "hi")


#: Leaves are summed up in blocks of FAN, FAN * FAN and so on.
FAN = 8


def over_leaves(nodes: DataFrame, values: DataFrame, merge: dict[str, Callable[[str], Column]], by: Sequence[str] = ()) -> DataFrame:
    """For every node, merge[c](c) of the columns c of its leaves' values (leaf, ...), which must merge in any order.

    Values are merged in blocks of FAN ** j leaves; a node takes the few blocks that make up its range. So there are
    rows for leaves times their depth in blocks, reduced before any shuffle, and no row or key holds a node's leaves. by: as in hierarchy().
    """
    top = nodes.agg(F.max("last")).head()[0]
    levels = [j for j in range(64) if FAN**j <= max(1, top or 0) + 1]
    level = F.explode(F.array(*map(F.lit, levels)))
    size = F.pow(F.lit(float(FAN)), F.col("j")).cast("long")
    blocks = values.withColumn("j", level).withColumn("block", F.floor(F.col("leaf") / size).cast("long"))
    blocks = blocks.groupBy(*by, "j", "block").agg(*(f(c).alias(c) for c, f in merge.items()))
    # Whole blocks of level j within the range are a to b - 1, whole blocks of the next level up to; what they cover
    # is left to that level.
    wide = nodes.select(*by, "node_id", "first", "last").withColumn("j", level)
    whole = lambda x: {"a": F.ceil(F.col("first") / x).cast("long"), "b": F.floor((F.col("last") + 1) / x).cast("long")}
    wide = wide.withColumns(whole(size)).where("a < b").withColumns({"up_" + n: c for n, c in whole(size * FAN).items()})
    some = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    a, b, x, y = F.col("a"), F.col("b"), F.col("up_a") * FAN, F.col("up_b") * FAN
    parts = F.when(F.col("up_a") < F.col("up_b"), F.concat(some(a, x), some(y, b))).otherwise(some(a, b))
    taken = wide.select(*by, "node_id", "j", F.explode(parts).alias("block"))
    return taken.join(blocks, [*by, "j", "block"]).groupBy(*by, "node_id").agg(*(f(c).alias(c) for c, f in merge.items()))


def with_slot(nodes: DataFrame) -> DataFrame:
    """Adds slot: the place of a node among those of its level, by node_id. Ranks are over all nodes, so that half the
    nodes in one level don't meet in one task."""
    from pyspark.sql import Window

    counts = nodes.groupBy("level").agg(F.count("*").alias("n"))
    start = counts.select("level", (F.sum("n").over(Window.orderBy("level")) - F.col("n")).alias("start"))  # a row a level
    return with_rank(nodes, ["level", "node_id"], "slot").join(start, "level").withColumn("slot", F.col("slot") - F.col("start")).drop("start")
