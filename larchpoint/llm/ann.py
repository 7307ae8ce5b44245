"""Nearest neighbours by inner product: a block matrix join over int8 product tiles.

Vectors are quantised to int8 with a scale each. A tile of integer products gives every score up to an error bound
that follows from the norms of the vectors and of what quantisation left over. Pairs whose upper bound reaches the
k-th best lower bound survive, are recomputed in double precision on the original vectors, and merged into the
queries' heaps. So the neighbours found are exact.

Vectors that are null, zero, empty or hold null or non-finite components, or have no id, take no part. Ties go to the
smaller vec_id; with fewer than k candidates all are returned; repeated rows (the same id twice) count as often as they occur, but a query
never finds its own id. Vectors of other lengths aren't compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from larchpoint.llm.blocks import Best, search
from larchpoint.llm.common import table

#: Queries of one tile.
TILE = 512
#: Components of which a tile's products are exact in float32.
DIMENSIONS = 1024
#: Room for rounding in the scaling and the bounds, which are doubles, relative to the norms' product and components.
SLACK = 1e-12


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, norms of the quantised vectors, norms of what is left over."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back**2).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def integer_products(q: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Products of int8 rows, exact: float32 holds 1040 products of 127 * 127, and doubles the sum of such blocks."""
    total = np.zeros((len(q), columns.shape[1]))
    for d in range(0, len(columns), DIMENSIONS):
        total += q[:, d : d + DIMENSIONS].astype(np.float32) @ columns[d : d + DIMENSIONS]
    return total


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added component by component in order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Tiles:
    def __init__(self, dim: int, ids: np.ndarray, data: np.ndarray, k: int):
        self.ids, self.data, self.k = ids, data, k
        self.norm = np.sqrt((data**2).sum(axis=1))
        self.q, self.scale, self.back, self.rest = quantise(data)
        self.best = Best(len(ids), k, np.float64)
        self.survivors = self.pairs = 0

    def add(self, ids: np.ndarray, data: np.ndarray) -> None:
        q, scale, back, rest = quantise(data)
        norm = np.sqrt((data**2).sum(axis=1))
        columns = q.T.astype(np.float32)
        for i in range(0, len(self.ids), TILE):
            rows = slice(i, i + TILE)
            close = integer_products(self.q[rows], columns) * self.scale[rows, None] * scale
            # <x,y> - <x',y'> = <x, y - y'> + <x - x', y'>
            error = self.norm[rows, None] * rest + self.rest[rows, None] * back + SLACK * (1 + self.q.shape[1]) * self.norm[rows, None] * norm
            own = self.ids[rows, None] == ids
            low = np.where(own, -np.inf, close - error)
            least = self.best.floor()[rows]
            if len(ids) >= self.k:
                least = np.maximum(least, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            a, b = np.nonzero((close + error >= least[:, None]) & ~own)
            self.survivors, self.pairs = self.survivors + len(a), self.pairs + own.size
            for j in range(0, len(a), 1 << 18):
                x, y = a[j : j + (1 << 18)] + i, b[j : j + (1 << 18)]
                self.best.merge(x, ids[y], products(self.data[x], data[y]))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.best.result(self.ids)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k rows with the largest inner product for each row whose vec_id is divisible by `every`."""
    return search(vectors, every, lambda m: (m != 0).any(axis=1), lambda dim, ids, data: Tiles(dim, ids, data, k), k, "double")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 20, 20)


#: The same rows in DuckDB.
OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda t: t[1] * t[2])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
