"""Intermediate results in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that isn't set, a local session gets one on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            root = "file:///tmp/checkpoints/larchpoint"
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df, written once and read back: this cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Delete the files of what keep() returned, once nothing reads them any more."""
    for df in kept:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_rank(df: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """Adds each row's place in the total order of keys, from 0.

    Rows are range-partitioned and sorted within partitions; a partition's offset is the number of rows before it. So
    no task sees more than its share, unlike row_number() over the whole table.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    placed = keep(placed.withColumns({"_part": F.shiftright("_m", 33), "_nth": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(before, "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")
