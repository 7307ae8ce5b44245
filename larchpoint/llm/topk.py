"""Exact top-k search: columnar branch and bound over integer vectors.

A block of candidates is held column by column. A query takes the columns in the order of its own largest components,
a block of dimensions at a time, and accumulates inner products and the candidates' remaining mass, the squares of the
components still to come. After each block, the remaining masses of query and candidate bound what a candidate can add;
candidates that can't reach the query's k-th best score are dropped, and those left are compacted.

Components are floor(256 x), x as double. Scores are exact integers: a pair whose products could pass 2^52 is computed
with Python integers, all others with doubles that hold them exactly. The result's type has 64 bits: larger scores are
clamped to it and then are ties. Vectors that are null, empty or hold null or non-finite components, or have no id,
take no part; zero vectors do. Ties go to the smaller vec_id; with fewer than k candidates all are returned; repeated
rows count as often as they occur, but a query never finds its own id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from larchpoint.llm.blocks import Best, search
from larchpoint.llm.common import table

#: Dimensions accumulated between two bounds.
DIMENSIONS = 8
EXACT = 2.0**52


class Columns:
    """Queries with their best candidates so far; touched of pairs * dim components have been read."""

    def __init__(self, dim: int, ids: np.ndarray, data: np.ndarray, k: int, block: int = DIMENSIONS):
        self.ids, self.k, self.dim, self.block = ids, k, dim, block
        self.v = np.floor(256 * data)
        self.norm = self.norms(self.v)
        self.best = Best(len(ids), k, np.int64)
        self.touched = self.pairs = 0

    def norms(self, v: np.ndarray) -> np.ndarray:
        """Norms, rounded up."""
        with np.errstate(over="ignore"):
            return np.sqrt((v**2).sum(axis=1)) * (1 + 1e-9)

    def add(self, ids: np.ndarray, data: np.ndarray) -> None:
        v = np.floor(256 * data)
        norm = self.norms(v)
        columns = np.ascontiguousarray(v.T)
        with np.errstate(over="ignore", invalid="ignore"):
            for x in range(len(self.ids)):
                other = ids != self.ids[x]
                plain = self.norm[x] * norm < EXACT
                self.pairs += len(ids)
                self.bounded(x, np.flatnonzero(other & plain), ids, columns, norm)
                if not plain.all():
                    self.exactly(x, np.flatnonzero(other & ~plain), ids, v)

    def bounded(self, x: int, alive: np.ndarray, ids: np.ndarray, columns: np.ndarray, norm: np.ndarray) -> None:
        q = self.v[x]
        order = np.argsort(-np.abs(q), kind="stable")
        # What the query's components from each block on can give, rounded up.
        mass = np.sqrt(np.append(np.cumsum((q[order] ** 2)[::-1])[::-1], 0.0)) * (1 + 1e-9)
        total, left = np.zeros(len(alive)), norm[alive] ** 2
        full = self.best.vec[x, -1] != np.iinfo(np.int64).max
        for lo in [*range(0, self.dim, self.block), self.dim]:  # at last with no block
            reach = mass[lo] * np.sqrt(np.maximum(left, 0))  # nothing after the last block
            least = float(self.best.floor()[x])
            if not full and len(alive) >= self.k:  # the k-th best lower bound among those left
                least = max(least, np.partition(total - reach, len(alive) - self.k)[len(alive) - self.k])
            good = total + reach >= least
            if not good.all():
                alive, total, left = alive[good], total[good], left[good]
            some = order[lo : lo + self.block]
            self.touched += len(some) * len(alive)
            whole = len(alive) == columns.shape[1]
            part = columns[some] if whole else columns[some].take(alive, axis=1)
            total += q[some] @ part
            left -= np.einsum("ij,ij->j", part, part)
        self.best.merge(np.full(len(alive), x), ids[alive], total.astype(np.int64))

    def exactly(self, x: int, y: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        mine = [int(c) for c in self.v[x]]
        score = [max(-(2**63) + 1, min(2**63 - 1, sum(a * int(b) for a, b in zip(mine, v[j], strict=True)))) for j in y]
        self.best.merge(np.full(len(y), x), ids[y], np.array(score, np.int64))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.best.result(self.ids)


def top(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k rows with the largest integer inner product for each row whose vec_id is divisible by `every`."""
    return search(vectors, every, lambda m: np.ones(len(m), bool), lambda dim, ids, data: Columns(dim, ids, data, k), k, "long")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 5, 50)


#: The same rows in DuckDB.
OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
