"""Explicit octrees: the cells that a binary hierarchy spans, with parents, children and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchpoint.functions import morton
from larchpoint.functions.morton import Bounds
from larchpoint.operators.walk import Rules, Walk
from larchpoint.operators.walk import walk as dual_walk


def leaf_cells(bucketed: DataFrame) -> DataFrame:
    """leaf, code, depth: the smallest cell that holds a leaf's points."""
    ends = bucketed.groupBy("leaf").agg(F.min("code").alias("a"), F.max("code").alias("b"))
    depth = morton.common_depth(F.col("a"), F.col("b"))
    return ends.select("leaf", morton.prefix(F.col("a"), depth).alias("code"), depth.alias("depth"), "a", "b")


def cells(bucketed: DataFrame) -> DataFrame:
    """oct_id, parent, octant, code, depth, lo, hi, is_leaf, n_children.

    Cells are those of the leaves and the smallest cells around two neighbouring leaves, ordered by depth, then code.
    """
    from larchpoint.storage import keep, with_rank

    leaf = keep(leaf_cells(bucketed))
    after = leaf.select((F.col("leaf") - 1).alias("leaf"), F.col("code").alias("next"), F.col("depth").alias("next_depth"))
    depth = F.least(morton.common_depth(F.col("code"), F.col("next")), F.col("depth"), F.col("next_depth"))
    shared = leaf.join(after, "leaf").select(morton.prefix(F.col("code"), depth).alias("code"), depth.alias("depth"))
    own = keep(with_rank(leaf.select("code", "depth").unionByName(shared).distinct(), ["depth", "code"], "oct_id"))
    above = own.select(F.explode(F.sequence(F.lit(0), F.lit(morton.BITS))).alias("d"), "oct_id", "code", "depth").where("d < depth")
    above = above.withColumn("prefix", morton.prefix(F.col("code"), F.col("d")))
    held = own.select(F.col("oct_id").alias("parent"), F.col("code").alias("prefix"), F.col("depth").alias("d"))
    parents = above.join(held, ["prefix", "d"]).groupBy("oct_id").agg(F.max_by("parent", "d").alias("parent"), F.max("d").alias("parent_depth"))
    # A leaf lies in its cell and in all cells around it. In deeper cells lie some of its points only, and only if a
    # neighbouring leaf's cell is deeper.
    ends = bucketed.groupBy("leaf").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    whole = leaf.join(ends, "leaf").select("code", "lo", "hi", F.explode(F.sequence(F.lit(0).cast(leaf.schema["depth"].dataType), F.col("depth"))).alias("depth"))
    beside = leaf.select(F.explode(F.array(F.col("leaf") - 1, F.col("leaf") + 1)).alias("leaf"), F.col("depth").alias("reach")).groupBy("leaf").agg(F.max("reach").alias("reach"))
    cut = leaf.select("leaf", "depth").join(beside, "leaf").where("reach > depth")
    some = bucketed.select("leaf", "code", "pos").join(cut, "leaf").select("code", F.col("pos").alias("lo"), F.col("pos").alias("hi"), F.explode(F.sequence(F.col("depth") + 1, F.col("reach"))).alias("depth"))
    places = whole.unionByName(some).withColumn("code", morton.prefix(F.col("code"), F.col("depth"))).groupBy("code", "depth").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    span = places.join(own.select("code", "depth", "oct_id"), ["code", "depth"]).select("oct_id", "lo", "hi")
    rows = own.join(parents, "oct_id", "left").join(span, "oct_id")
    kids = parents.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "oct_id")
    rows = rows.join(kids, "oct_id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    octant = F.when(F.col("parent").isNull(), -1).otherwise(morton.octant(F.col("code"), F.col("parent_depth") + 1)).cast("int")
    return rows.select("oct_id", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), octant.alias("octant"), "code", F.col("depth").cast("int").alias("depth"), "lo", "hi", (F.col("n_children") == 0).alias("is_leaf"), F.col("n_children").cast("long").alias("n_children"))


def boxes(octree: DataFrame, box: Bounds) -> DataFrame:
    """Centre and half extents of every cell."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth").cast("int")).cast("double")
    at = morton.axes(F.call_function("shiftright", F.col("code"), (63 - 3 * F.col("depth")).cast("int")))
    out = octree
    for a, c, low, span in zip("xyz", at, box.low, box.span, strict=True):
        out = out.withColumns({f"c{a}": F.lit(low) + (c.cast("double") + 0.5) * (F.lit(span) / size), f"h{a}": F.lit(0.5 * span) / size})
    return out.select("oct_id", "cx", "cy", "cz", "hx", "hy", "hz", F.sqrt(F.col("hx") * F.col("hx") + F.col("hy") * F.col("hy") + F.col("hz") * F.col("hz")).alias("radius"), F.greatest("hx", "hy", "hz").alias("max_extent"))


def radix_to_octree(nodes: DataFrame, bucketed: DataFrame, octree: DataFrame) -> DataFrame:
    """(node_id, oct_id): the cell around each node of the binary hierarchy."""
    leaf = leaf_cells(bucketed)
    ends = nodes.join(leaf.select(F.col("leaf").alias("first"), "a", F.col("code").alias("ca"), F.col("depth").alias("da")), "first").join(leaf.select(F.col("leaf").alias("last"), F.col("code").alias("cb"), F.col("depth").alias("db")), "last")
    depth = F.when(F.col("is_leaf"), F.col("da")).otherwise(F.least(morton.common_depth(F.col("ca"), F.col("cb")), F.col("da"), F.col("db")))
    keyed = ends.withColumn("depth", depth).withColumn("code", morton.prefix(F.col("a"), F.col("depth")))
    return keyed.join(octree.select("oct_id", "code", "depth"), ["code", "depth"]).select("node_id", "oct_id")


def far_pairs(far: DataFrame, mapping: DataFrame) -> DataFrame:
    """Far pairs of the binary walk between cells."""
    t = mapping.select(F.col("node_id").alias("target"), F.col("oct_id").alias("oct_target"))
    s = mapping.select(F.col("node_id").alias("source"), F.col("oct_id").alias("oct_source"))
    return far.join(t, "target").join(s, "source").select("oct_target", "oct_source", "target", "source")


def walk(octree: DataFrame, box: Bounds, rules: Rules | None = None) -> Walk:
    """The dual-tree walk over the cells themselves: a pair that isn't accepted is refined into the children of its
    larger cell, a cell with itself into all pairs of its children. Boxes are the cells', not those of their points."""
    kids = octree.where("parent >= 0").groupBy(F.col("parent").alias("node_id")).agg(F.sort_array(F.collect_list("oct_id")).alias("kids"))  # 8 at most
    nodes = octree.select(F.col("oct_id").alias("node_id")).join(kids, "node_id", "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<bigint>")))
    return dual_walk(nodes, boxes(octree, box).withColumnRenamed("oct_id", "node_id"), rules)
