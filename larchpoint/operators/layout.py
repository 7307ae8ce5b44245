"""Other layouts of far and near pairs: dense slots, displacement classes, growth reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larchpoint.functions.morton import Bounds
from larchpoint.operators.radix import with_slot
from larchpoint.storage import keep, with_rank


def dense(far: DataFrame, nodes: DataFrame, geom: DataFrame) -> DataFrame:
    """target, source, level, slot of the target in its level, k-th source of the target, displacement."""
    slots = with_slot(nodes.select("node_id", "level")).withColumnRenamed("node_id", "target")
    t = geom.select(F.col("node_id").alias("target"), *(F.col(f"c{a}").alias(f"t{a}") for a in "xyz"))
    s = geom.select(F.col("node_id").alias("source"), *(F.col(f"c{a}").alias(f"s{a}") for a in "xyz"))
    k = F.row_number().over(Window.partitionBy("target").orderBy("source")) - 1
    rows = far.select("target", "source").join(slots, "target").withColumn("k", k).join(t, "target").join(s, "source")
    return rows.select("target", "source", "level", "slot", "k", *((F.col(f"t{a}") - F.col(f"s{a}")).alias(f"d{a}") for a in "xyz"))


def displacement_classes(far: DataFrame, nodes: DataFrame, geom: DataFrame, box: Bounds) -> DataFrame:
    """Far pairs with their class: levels of both nodes and displacement in cells of the target's level."""
    level = nodes.select("node_id", "level")
    t = geom.join(level, "node_id").select(F.col("node_id").alias("target"), F.col("level").alias("target_level"), *(F.col(f"c{a}").alias(f"t{a}") for a in "xyz"))
    s = geom.join(level, "node_id").select(F.col("node_id").alias("source"), F.col("level").alias("source_level"), *(F.col(f"c{a}").alias(f"s{a}") for a in "xyz"))
    rows = far.select("target", "source").join(t, "target").join(s, "source")
    for a, span in zip("xyz", box.span, strict=True):
        cell = F.greatest(F.lit(span) / F.pow(F.lit(2.0), F.col("target_level")), F.lit(1e-12))
        rows = rows.withColumn(f"i{a}", F.rint((F.col(f"t{a}") - F.col(f"s{a}")) / cell).cast("long"))
    return rows.select("target", "source", "target_level", "source_level", "ix", "iy", "iz")


def class_table(classified: DataFrame) -> DataFrame:
    """One row a class, numbered in order of its key."""
    key = ["target_level", "source_level", "ix", "iy", "iz"]
    return with_rank(classified.groupBy(*key).agg(F.count("*").alias("n_pairs")), key, "class_id")


def growth(near: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """The leaves with the most near leaves, with the largest, mean and upper median count over all leaves."""
    counts = nodes.where("is_leaf").select(F.col("node_id").alias("target")).join(near.groupBy("target").agg(F.count("*").alias("n")), "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("n"))
    hist = counts.groupBy("n").agg(F.count("*").alias("c"))
    ranked = hist.withColumn("upto", F.sum("c").over(Window.orderBy("n")))  # as many rows as there are different counts
    stats = counts.agg(F.max("n").alias("max_n"), F.avg("n").alias("mean_n"), F.count("*").alias("leaves"))
    median = ranked.crossJoin(stats).where(F.col("upto") > F.floor(F.col("leaves") / 2)).agg(F.min("n").alias("median_n"))
    best = counts.orderBy(F.desc("n"), "target").limit(top)
    return best.crossJoin(stats).crossJoin(median).select("target", "n", "max_n", "mean_n", "median_n")


def csr(pairs: DataFrame, key: str = "target", value: str = "source") -> DataFrame:
    """Compressed rows of a pair table: key, value, k (value's place within its key's row), count and first (the row's
    length and its first place), row (the key's place among the keys with pairs)."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1
    ranked = keep(with_rank(pairs.groupBy(key).agg(F.count("*").alias("count")), [key], "row"))
    return pairs.select(key, value, k.alias("k")).join(starts(ranked, "row", "count"), key)


def starts(rows: DataFrame, rank: str, size: str, name: str = "first") -> DataFrame:
    """Adds the sum of size over the rows before each, in order of rank (0, 1, ...): sums within blocks of ranks are
    windows of 4,096 rows, and the blocks' sums are added up in one."""
    block = F.shiftright(rank, 12)
    sizes = rows.groupBy(block.alias("_block")).agg(F.sum(size).alias("_size"))
    before = sizes.select("_block", (F.sum("_size").over(Window.orderBy("_block")) - F.col("_size")).alias("_before"))
    own = F.sum(size).over(Window.partitionBy("_block").orderBy(rank)) - F.col(size)
    placed = rows.withColumn("_block", block).withColumn("_own", own).join(before, "_block")
    return placed.withColumn(name, F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")


def target_blocks(pairs: DataFrame, width: int, key: str = "target", value: str = "source") -> DataFrame:
    """csr() with block, numbered through: each row of sources is cut into blocks of `width` places, none shared."""
    if width < 1:
        raise ValueError("width must be positive")
    rows = keep(csr(pairs, key, value))
    blocks = F.ceil(F.col("count") / width).cast("long")
    first = starts(rows.where("k = 0").select(key, "row", blocks.alias("blocks")), "row", "blocks", "first_block")
    return rows.join(first.select(key, "first_block"), key).withColumn("block", F.col("first_block") + F.floor(F.col("k") / width).cast("long")).drop("first_block")


def level_major(far: DataFrame, nodes: DataFrame) -> DataFrame:
    """Far pairs with the level of their target, their place by (level, target, source), and the place of their level's
    first pair."""
    rows = far.select("target", "source").join(nodes.select(F.col("node_id").alias("target"), F.col("level").alias("target_level")), "target")
    ranked = with_rank(rows, ["target_level", "target", "source"], "place")
    first = ranked.groupBy("target_level").agg(F.min("place").alias("level_start"))  # a row a level
    return ranked.join(first, "target_level")
