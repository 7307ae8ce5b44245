"""Boxes of nodes: unions of their points' boxes, or Z-order cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchpoint.functions import morton
from larchpoint.functions.morton import Bounds
from larchpoint.operators.radix import over_leaves, with_slot

#: Half extents are this at least.
LEAST = 1e-6


def from_boxes(boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """node_id and x0..z1 -> centre, half extents, radius, largest half extent."""
    rows = boxes.withColumns({f"c{a}": (F.col(f"{a}0") + F.col(f"{a}1")) * 0.5 for a in "xyz"})
    rows = rows.withColumns({f"h{a}": F.greatest((F.col(f"{a}1") - F.col(f"{a}0")) * 0.5, F.lit(LEAST)) for a in "xyz"})
    square = F.col("hx") * F.col("hx") + F.col("hy") * F.col("hy") + F.col("hz") * F.col("hz")
    return rows.select(*by, "node_id", "cx", "cy", "cz", "hx", "hy", "hz", F.sqrt(square).alias("radius"), F.greatest("hx", "hy", "hz").alias("max_extent"))


def leaf_boxes(bucketed: DataFrame, radius: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """leaf and x0..z1; radius: a column that widens every point's box."""
    r = F.col(radius) if radius else F.lit(0.0)
    return bucketed.groupBy(*by, "leaf").agg(*(F.min(F.col(a) - r).alias(f"{a}0") for a in "xyz"), *(F.max(F.col(a) + r).alias(f"{a}1") for a in "xyz"))


def cell_boxes(leaf_rows: DataFrame, box: Bounds) -> DataFrame:
    """leaf and x0..z1 of leaves that are Z-order cells (leaf, code, depth), empty ones included."""
    depth = F.col("depth").cast("int")
    cells = F.call_function("shiftleft", F.lit(1).cast("long"), depth).cast("double")
    rows = leaf_rows.withColumns({f"j{a}": c for a, c in zip("xyz", morton.axes(F.call_function("shiftright", F.col("code"), (63 - 3 * F.col("depth")).cast("int"))), strict=True)})
    sides = {f"{a}{k}": F.lit(low) + (F.col(f"j{a}") + k).cast("double") * (F.lit(span) / cells) for a, low, span in zip("xyz", box.low, box.span, strict=True) for k in (0, 1)}
    return rows.select("leaf", *(c.alias(n) for n, c in sides.items()))


def from_leaf_boxes(boxes: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Geometry of every node from its leaves' boxes: only leaves are merged, never points."""
    merge = {f"{a}{k}": f for a in "xyz" for k, f in enumerate((F.min, F.max))}
    return from_boxes(over_leaves(nodes, boxes, merge, by), by)


def geometry(bucketed: DataFrame, nodes: DataFrame, radius: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Geometry of every node; points are reduced to leaf boxes first. by: columns that tell trees apart."""
    return from_leaf_boxes(leaf_boxes(bucketed, radius, by), nodes, by)


def level_major(geom: DataFrame, nodes: DataFrame) -> DataFrame:
    """Geometry with each node's level and its slot among the nodes of that level."""
    return geom.join(with_slot(nodes.select("node_id", "level")), "node_id")
