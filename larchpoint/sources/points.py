"""Weighted point sets: points(id, x, y, z, mass) from tables, and the boxes around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from larchpoint.functions.morton import Bounds

POINTS = StructType([StructField("id", LongType()), *(StructField(c, DoubleType()) for c in ("x", "y", "z", "mass"))])


def missing_fields(df: DataFrame, fields: tuple[str, ...]) -> list[str]:
    return [f for f in fields if f not in df.columns]


def require_fields(df: DataFrame, fields: tuple[str, ...], what: str) -> DataFrame:
    if missing := missing_fields(df, fields):
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def from_table(df: DataFrame, id_: str, x: str, y: str, z: str, mass: str = "1.0") -> DataFrame:
    """Points from SQL expressions over df; rows with a null coordinate are no points."""
    points = df.selectExpr(f"cast({id_} as bigint) id", *(f"cast({e} as double) {n}" for e, n in ((x, "x"), (y, "y"), (z, "z"), (mass, "mass"))))
    return points.where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of each vector, with mass 1 + label."""
    return from_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding[0]", "embedding[1]", "embedding[2]", "1 + label")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, value and time of each event, each scaled to [0, 1]."""
    rows = from_table(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "user_id", "value", "unix_micros(cast(ts as timestamp))")
    box = exact_bounds(rows)
    scaled = {c: (F.col(c) - a) / (b - a) for c, a, b in zip("xyz", box.low, box.high, strict=True)}
    return rows.withColumns(scaled)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many points in few places."""
    return from_table(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "p_size", "0", "0", "p_retailprice")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, p array<double>: whole vectors."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("cast(vec_id as bigint) id", "cast(embedding as array<double>) p")


def write(points: DataFrame, path: str) -> None:
    points.write.parquet(path)


def exact_bounds(points: DataFrame) -> Bounds:
    r = points.agg(*(f(c) for f in (F.min, F.max) for c in "xyz")).head()
    if r[0] is None:
        raise ValueError("there are no points")
    return Bounds(tuple(r[:3]), tuple(r[3:]))


def infer_bounds(points: DataFrame) -> Bounds:
    """The points' box, wider by 5 % on every side, 1e-6 at least."""
    box = exact_bounds(points)
    pad = [max(0.05 * s, 1e-6) for s in box.span]
    return Bounds(tuple(a - p for a, p in zip(box.low, pad, strict=True)), tuple(b + p for b, p in zip(box.high, pad, strict=True)))


def global_bounds(points: DataFrame) -> Bounds:
    """The box over all domains, wider by a millionth; a flat side counts as 1."""
    box = exact_bounds(points)
    pad = [1e-6 * (s or 1.0) for s in box.span]
    return Bounds(tuple(a - p for a, p in zip(box.low, pad, strict=True)), tuple(b + p for b, p in zip(box.high, pad, strict=True)))
