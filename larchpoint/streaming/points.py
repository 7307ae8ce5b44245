"""Streams of points: counts of Z-order cells by time window, and a tree that follows each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from larchpoint.functions import morton
from larchpoint.functions.morton import Bounds
from larchpoint.plans.prepared import Tree, refresh
from larchpoint.sources.points import require_fields


def cell_counts(points: DataFrame, bounds: Bounds, depth: int, time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Per window and occupied cell of a depth: n and mass. Rows later than `late` behind the newest are left out.

    points(x, y, z, mass, time), streamed or not; partial counts are made before the shuffle, so a full cell is no hot key.
    """
    require_fields(points, ("x", "y", "z", "mass", time), "the stream")
    coded = morton.with_code(points, bounds)
    rows = coded.withWatermark(time, late).groupBy(F.window(time, window), F.shiftright("code", 3 * (morton.BITS - depth)).alias("cell"))
    return rows.agg(F.count("*").alias("n"), F.sum("mass").alias("mass")).select(F.col("window.start").alias("start"), "cell", "n", "mass")


def follow(stream: DataFrame, tree: Tree, fn: Callable[[Tree, int], None]) -> DataStreamWriter:
    """Each batch holds new positions of all points; fn gets the static tree refreshed with them, and the batch's number."""
    if tree.options.mode != "static_radix":
        raise ValueError("only static trees can follow a stream")

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            fn(refresh(tree, batch), number)

    return stream.writeStream.foreachBatch(each)
