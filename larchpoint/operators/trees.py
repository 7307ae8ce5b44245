"""Other trees over points: static radix, fixed depth, leaf k-d."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchpoint.functions import morton
from larchpoint.functions.morton import Bounds
from larchpoint.operators import radix
from larchpoint.sources.points import infer_bounds
from larchpoint.storage import keep, with_rank

NODE = ["node_id", "parent", "left", "right", "is_leaf", "level", "first", "last", "lo", "hi"]


def balanced(spark, leaves: int) -> DataFrame:
    """The balanced topology over a number of leaves, a function of that number alone: NODE without lo and hi.

    Internal ids are in preorder. A node over k leaves has k - 1 internal nodes, so a right child's id follows from the
    size of its left sibling, and each level of the tree is one projection of the level above.
    """
    inner = leaves - 1
    level = spark.range(1).select(F.lit(0).cast("long").alias("node_id"), F.lit(-1).cast("long").alias("parent"), F.lit(0).cast("long").alias("first"), F.lit(leaves).cast("long").alias("end"), F.lit(0).cast("long").alias("level"))
    out = level
    depth = max(0, (leaves - 1).bit_length())
    for n in range(depth):
        mid = F.floor((F.col("first") + F.col("end")) / 2).cast("long")
        wide = level.where(F.col("end") - F.col("first") > 1).withColumn("mid", mid)
        child = lambda a, b, first_id: F.struct(F.when(b - a == 1, inner + a).otherwise(first_id).cast("long").alias("node_id"), F.col("node_id").alias("parent"), a.alias("first"), b.alias("end"), F.lit(n + 1).cast("long").alias("level"))  # noqa: E731, B023
        two = F.array(child(F.col("first"), F.col("mid"), F.col("node_id") + 1), child(F.col("mid"), F.col("end"), F.col("node_id") + F.col("mid") - F.col("first")))
        level = wide.select(F.explode(two).alias("c")).select("c.*")
        if n % 6 == 5:
            level = keep(level)  # plans stay short
        out = out.unionByName(level)
    is_leaf = F.col("end") - F.col("first") == 1
    mid = F.floor((F.col("first") + F.col("end")) / 2).cast("long")
    left = F.when(is_leaf, -1).when(mid - F.col("first") == 1, inner + F.col("first")).otherwise(F.col("node_id") + 1).cast("long")
    right = F.when(is_leaf, -1).when(F.col("end") - mid == 1, inner + mid).otherwise(F.col("node_id") + mid - F.col("first")).cast("long")
    return out.select("node_id", "parent", left.alias("left"), right.alias("right"), is_leaf.alias("is_leaf"), "level", "first", (F.col("end") - 1).alias("last"))


def with_ranges(nodes: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    low, high = leaf_rows.select(F.col("leaf").alias("first"), "lo"), leaf_rows.select(F.col("leaf").alias("last"), "hi")
    return nodes.join(low, "first").join(high, "last").select(NODE)


def static_radix(bucketed: DataFrame) -> DataFrame:
    """Radix buckets under a balanced hierarchy."""
    leaf_rows = keep(radix.leaves(bucketed))
    return with_ranges(balanced(bucketed.sparkSession, leaf_rows.count()), leaf_rows)


def refresh_static(points: DataFrame, nodes: DataFrame, leaf_size: int, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """New positions under an old static topology: (bucketed points, nodes). The number of leaves must be the same."""
    bucketed = keep(radix.bucket(radix.sort_points(points, bounds), leaf_size))
    leaf_rows = keep(radix.leaves(bucketed))
    if leaf_rows.count() != nodes.where("is_leaf").count():
        raise ValueError("the number of leaves has changed")
    return bucketed, with_ranges(nodes.drop("lo", "hi"), leaf_rows)


def fixed_depth_level(n: int, target: int, limit: int = morton.BITS) -> int:
    """Least depth with at least ceil(n / target) cells."""
    need, depth = -(-n // target), 0
    while 8**depth < need and depth < limit:
        depth += 1
    return depth


def fixed_depth(points: DataFrame, target_leaf_points: int, bounds: Bounds | None = None, max_depth: int | None = None, drop_empty: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(points with pos and leaf, leaves, depth): every cell of the depth is a leaf, empty ones have hi = lo - 1.

    leaves: leaf, code, depth, n, lo, hi.
    """
    if target_leaf_points < 1:
        raise ValueError("target_leaf_points must be positive")
    rows = keep(radix.sort_points(points, bounds or infer_bounds(points)))
    depth = fixed_depth_level(rows.count(), target_leaf_points, min(morton.BITS, max_depth if max_depth is not None else morton.BITS))
    shift = 3 * (morton.BITS - depth)
    rows = rows.withColumn("cell", F.shiftright("code", shift))
    held = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("pos").alias("lo"))
    cells = held if drop_empty else points.sparkSession.range(8**depth).select(F.col("id").alias("cell")).join(held, "cell", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    # An empty cell starts where the points of the cells before it end.
    start = F.coalesce("lo", F.coalesce(F.sum(n).over(Window.partitionBy("block").orderBy("cell")), F.lit(0)) - n + F.col("before"))
    cells = cells.withColumn("block", F.shiftright("cell", 12))
    sizes = cells.groupBy("block").agg(F.sum(n).alias("size"))  # 4096 cells a row
    before = sizes.select("block", (F.sum("size").over(Window.orderBy("block")) - F.col("size")).alias("before"))
    cells = cells.join(before, "block").withColumns({"n": n, "lo": start})
    leaf_rows = cells.select(F.col("cell").alias("leaf"), F.shiftleft("cell", shift).alias("code"), F.lit(depth).alias("depth"), "n", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))
    if drop_empty:
        leaf_rows = with_rank(leaf_rows.withColumnRenamed("leaf", "cell"), ["cell"], "leaf")
        rows = rows.join(leaf_rows.select("cell", "leaf"), "cell")
        return rows.drop("cell"), leaf_rows.drop("cell"), depth
    return rows.withColumnRenamed("cell", "leaf"), leaf_rows, depth


def refined(bucketed: DataFrame, leaf_rows: DataFrame, levels: int = 2, aspect: float = 8.0, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Points and leaves of a fixed depth with long cells cut into their octants, up to `levels` times.

    A cell is cut if its points' longest side exceeds `aspect` times the shortest and they lie in two octants or more.
    Only octants with points remain, and those of `least` points or fewer aren't cut again. Empty leaves stay. Leaves
    are numbered by first point, then code. A round is one aggregation by cell and one join.
    """
    rows = bucketed.join(leaf_rows.select("leaf", F.col("code").alias("cell"), "depth"), "leaf").drop("leaf")
    depth = F.col("depth")
    for nth in range(levels):
        octant = morton.octant(F.col("code"), depth + 1)
        sides = [F.max(a) - F.min(a) for a in "xyz"]
        cells = rows.where(depth < morton.BITS).groupBy("cell", "depth").agg(F.count("*").alias("n"), F.greatest(*sides).alias("long"), F.greatest(F.least(*sides), F.lit(1e-12)).alias("short"), F.min(octant).alias("o0"), F.max(octant).alias("o1"))
        wide = cells.where((F.col("long") / F.col("short") > aspect) & (F.col("o0") < F.col("o1")) & (F.col("n") > (least if nth else 0)))
        rows = rows.join(wide.select("cell", "depth", F.lit(1).alias("cut")), ["cell", "depth"], "left").withColumn("depth", depth + F.coalesce("cut", F.lit(0)))
        rows = keep(rows.withColumn("cell", F.when(F.col("cut").isNotNull(), morton.prefix(F.col("code"), depth)).otherwise(F.col("cell"))).drop("cut"))
    held = rows.groupBy("cell", "depth").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    empty = leaf_rows.where("n = 0").select(F.col("code").alias("cell"), "depth", "n", "lo", "hi")
    out = keep(with_rank(held.unionByName(empty), ["lo", "cell"], "leaf"))
    rows = rows.join(out.where("n > 0").select("cell", "depth", "leaf"), ["cell", "depth"]).drop("cell", "depth")
    return rows, out.withColumnRenamed("cell", "code").select("leaf", "code", "depth", "n", "lo", "hi")


def kd_depth(n: int, leaf_size: int) -> int:
    """Levels of splits so that leaves hold leaf_size points at most, none of them empty."""
    if n <= leaf_size:
        return 0
    return min((-(-n // leaf_size) - 1).bit_length(), n.bit_length() - 1)


def leaf_kd(points: DataFrame, leaf_size: int) -> tuple[DataFrame, DataFrame]:
    """(points with pos and leaf, nodes with split_dim): median splits of the widest side, all points in leaves.

    Every level is one aggregation and one ranking within buckets. A bucket's rank is a window over the bucket; to keep
    the first levels, whose buckets hold much of the table, off single tasks, ranks come from range partitions.
    """
    if leaf_size < 1:
        raise ValueError("leaf_size must be positive")
    rows = keep(points.withColumn("bucket", F.lit(0).cast("long")))
    n = rows.count()
    depth = kd_depth(n, leaf_size)
    splits = None
    for level in range(depth):
        sides = rows.groupBy("bucket").agg(*(F.max(a) - F.min(a) for a in "xyz"), F.count("*").alias("n")).toDF("bucket", "sx", "sy", "sz", "n")
        widest = F.when((F.col("sx") >= F.col("sy")) & (F.col("sx") >= F.col("sz")), 0).when(F.col("sy") >= F.col("sz"), 1).otherwise(2)
        sides = keep(sides.select("bucket", widest.alias("dim"), "n"))  # 2^level rows
        halves = sides.select("bucket", F.ceil(F.col("n") / 2).alias("half"))
        coord = F.when(F.col("dim") == 0, F.col("x")).when(F.col("dim") == 1, F.col("y")).otherwise(F.col("z"))
        ranked = with_rank(rows.join(sides.select("bucket", "dim"), "bucket").withColumn("coord", coord), ["bucket", "coord", "id"], "_r")
        start = ranked.groupBy("bucket").agg(F.min("_r").alias("start"))
        ranked = ranked.join(start, "bucket").join(halves, "bucket")
        within = F.col("_r") - F.col("start")
        ranked = keep(ranked.withColumn("within", within))
        cut = F.least(F.col("half"), F.lit(n - 1))
        value = ranked.where(F.col("within") == cut).select("bucket", F.col("coord").alias("split_value"))
        here = sides.join(value, "bucket", "left").select((F.col("bucket") + (1 << level) - 1).alias("node_id"), F.col("dim").alias("split_dim"), "split_value")
        splits = here if splits is None else splits.unionByName(here)
        rows = ranked.withColumn("bucket", F.col("bucket") * 2 + (F.col("within") >= F.col("half")).cast("long")).select(*rows.columns)
    bucketed = keep(with_rank(rows.withColumnRenamed("bucket", "leaf"), ["leaf", "id"]))
    ends = bucketed.groupBy("leaf").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    inner, ids = (1 << depth) - 1, F.col("id")
    level = F.floor(F.log2(ids + 1)).cast("long")
    below = (F.lit(depth) - level).cast("int")
    first = F.call_function("shiftleft", ids + 1, below) - (1 << depth)
    heap = points.sparkSession.range(2 * inner + 1).select(
        ids.alias("node_id"),
        F.when(ids == 0, -1).otherwise(F.floor((ids - 1) / 2)).cast("long").alias("parent"),
        F.when(ids < inner, 2 * ids + 1).otherwise(-1).cast("long").alias("left"),
        F.when(ids < inner, 2 * ids + 2).otherwise(-1).cast("long").alias("right"),
        (ids >= inner).alias("is_leaf"),
        level.alias("level"),
        first.alias("first"),
        (first + F.call_function("shiftleft", F.lit(1).cast("long"), below) - 1).alias("last"),
    )
    nodes = with_ranges(heap, ends)
    if splits is None:
        return bucketed, nodes.withColumns({"split_dim": F.lit(-1), "split_value": F.lit(None).cast("double")})
    return bucketed, nodes.join(splits, "node_id", "left").withColumn("split_dim", F.coalesce("split_dim", F.lit(-1)))


def _left_size(n: Column) -> Column:
    """Points below the left child of a left-balanced node over n: only its last level may be short, at the right. 0 for n = 1."""
    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(n)) - 2, F.lit(0)).cast("int"))
    return half - 1 + F.least(n - 2 * half + 1, half)


def heap_kd(points: DataFrame, leaf_size: int) -> tuple[DataFrame, DataFrame]:
    """(points with node and pos, nodes): the left-balanced k-d tree in which each inner node holds one point, its pivot.

    nodes: node_id (heap number), parent, is_leaf, n (points at and below), lo and hi (their places in inorder,
    inclusive), split_dim, split_value and pivot (the id of the inner node's point; all -1 or null at leaves). A node
    of leaf_size points or fewer is a leaf, its points in order of id. A node splits its widest side, the first of
    equal ones; points at one coordinate go by id. Without points there are no nodes.

    As points lie in inner nodes, a walk over leaves loses pairs: this tree serves searches and layouts only. A level
    is one aggregation and one ranking over range partitions, so that the first nodes don't fill one task.
    """
    if leaf_size < 1:
        raise ValueError("leaf_size must be positive")
    active = keep(points.withColumns({"node": F.lit(0).cast("long"), "start": F.lit(0).cast("long")}))
    size, placed, nodes = active.count(), [], []
    none = {"split_dim": F.lit(-1), "split_value": F.lit(None).cast("double"), "pivot": F.lit(-1).cast("long")}
    while not active.isEmpty():
        sides = active.groupBy("node", "start").agg(*((F.max(a) - F.min(a)).alias(f"s{a}") for a in "xyz"), F.count("*").alias("n"))
        widest = F.when((F.col("sx") >= F.col("sy")) & (F.col("sx") >= F.col("sz")), 0).when(F.col("sy") >= F.col("sz"), 1).otherwise(2)
        sides = keep(sides.select("node", "start", "n", F.when(F.col("n") > leaf_size, widest).alias("dim")))
        coord = F.when(F.col("dim") == 0, F.col("x")).when(F.col("dim") == 1, F.col("y")).when(F.col("dim") == 2, F.col("z"))
        ranked = with_rank(active.join(sides.select("node", "dim"), "node").withColumn("coord", coord).drop("dim"), ["node", "coord", "id"], "_r")
        first = ranked.groupBy("node").agg(F.min("_r").alias("first"))
        ranked = ranked.join(first, "node").join(sides.select("node", "n", "dim"), "node").withColumns({"within": F.col("_r") - F.col("first"), "cut": _left_size(F.col("n"))})
        ranked = keep(ranked.drop("_r", "first"))
        here, place = [c for c in points.columns], (F.col("start") + F.col("within")).alias("pos")
        placed.append(ranked.where("dim IS NULL OR within = cut").select(*here, "node", place))
        ends = ("n", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1).alias("hi"))
        parent = F.when(F.col("node") == 0, -1).otherwise(F.floor((F.col("node") - 1) / 2)).cast("long").alias("parent")
        nodes.append(sides.where("dim IS NULL").select(F.col("node").alias("node_id"), parent, F.lit(True).alias("is_leaf"), *ends, *(c.alias(k) for k, c in none.items())))
        nodes.append(ranked.where("dim IS NOT NULL AND within = cut").select(F.col("node").alias("node_id"), parent, F.lit(False).alias("is_leaf"), *ends, F.col("dim").alias("split_dim"), F.col("coord").alias("split_value"), F.col("id").alias("pivot")))
        right = F.col("within") > F.col("cut")
        active = keep(ranked.where("dim IS NOT NULL AND within <> cut").select(*here, (F.col("node") * 2 + F.when(right, 2).otherwise(1)).alias("node"), (F.col("start") + F.when(right, F.col("cut") + 1).otherwise(0)).alias("start")))
    if not size:
        empty = active.withColumn("pos", F.col("start"))
        ids = F.col("node")
        return empty.select(*points.columns, "node", "pos"), empty.select(ids.alias("node_id"), ids.alias("parent"), F.lit(True).alias("is_leaf"), ids.alias("n"), ids.alias("lo"), ids.alias("hi"), *(c.alias(k) for k, c in none.items()))
    return reduce(DataFrame.unionByName, placed), reduce(DataFrame.unionByName, nodes)
