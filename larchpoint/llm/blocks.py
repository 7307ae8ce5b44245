"""Vectors in blocks: the plan that both vector searches share.

Valid vectors are packed into matrices of at most BLOCK_ROWS rows. Queries form H groups of at most GROUP_QUERIES
vectors and GROUP_BYTES bytes, candidates G groups; a task holds one query group with its best candidates so far and reads one candidate
group block by block. Its memory is bounded whatever the table's size, and each of the G results per query has at most
k rows; these are merged by rank. G and H follow from a count of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larchpoint.llm.common import bound_batches, column

BLOCK_ROWS = 4096
#: Queries, and bytes of queries, of one task.
GROUP_QUERIES = 65_536
GROUP_BYTES = 64 << 20
#: Candidates of one task.
GROUP_ROWS = 16_384


def pack(vectors: DataFrame, valid: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """vec_id, embedding -> blocks of equally long vectors: dim, query (bool), ids and data as bytes of longs and doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, query, group, other = (column(batch, x) for x in ("vec_id", "query", "part", "embedding"))
            values, offsets = other.values, other.offsets.to_numpy()
            whole = np.diff(offsets)
            flat = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)  # null components become NaN
            ok = ~np.asarray(other.is_null()) & (whole > 0) & ~np.asarray(ids.is_null())
            ids, query, group = ids.fill_null(0).to_numpy(), np.asarray(query.fill_null(False)), group.to_numpy()
            rows = []
            for dim in np.unique(whole[ok]):
                at = np.flatnonzero(ok & (whole == dim))
                m = flat[(offsets[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)
                with np.errstate(all="ignore"):
                    good = np.isfinite(m).all(axis=1) & valid(m)
                at, m = at[good], m[good]
                for g in np.unique(group[at]):
                    for q in (True, False):
                        mine = np.flatnonzero((query[at] == q) & (group[at] == g))
                        if len(mine):
                            rows.append((int(dim), q, int(g), ids[at[mine]].astype("<i8").tobytes(), m[mine].astype("<f8").tobytes()))
            if rows:
                dim, q, g, i, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(dim, pa.int32()), pa.array(q), pa.array(g, pa.int32()), pa.array(i, pa.binary()), pa.array(d, pa.binary())], ["dim", "query", "part", "ids", "data"])

    bound_batches(vectors.sparkSession)
    return vectors.mapInArrow(run, "dim int, query boolean, part int, ids binary, data binary")


def search(vectors: DataFrame, every: int, valid, engine: Callable, k: int, score_type: str) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score.

    engine(dim, ids, data) makes an object for a query group with add(ids, data) for each block of candidates and
    result() -> query ids, candidate ids, scores. Vectors are compared with those of their own length.
    """
    rows, size = vectors.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("vec_id") % every == 0, F.size("embedding"))), F.lit(0))).head()
    h = max(1, -(-rows // every // GROUP_QUERIES), -(-8 * size // GROUP_BYTES))
    g = max(1, -(-rows // GROUP_ROWS))
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), (F.col("vec_id") % every == 0).alias("query"))
    # Queries of a group must meet every candidate group, and candidates every query group.
    put = F.when(F.col("query"), F.pmod(F.xxhash64(F.lit(1), "vec_id", "embedding"), F.lit(h))).otherwise(0).cast("int")
    as_queries = pack(plain.where("query").select("vec_id", "embedding", "query", put.alias("part")), valid)
    as_candidates = pack(plain.select("vec_id", "embedding", F.lit(False).alias("query"), F.pmod(F.xxhash64(F.lit(2), "vec_id", "embedding"), F.lit(g)).cast("int").alias("part")), valid)
    left = as_queries.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))).select("dim", "query", F.col("part").alias("h"), F.col("other").alias("g"), "ids", "data")
    right = as_candidates.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).select("dim", "query", F.col("other").alias("h"), F.col("part").alias("g"), "ids", "data")
    both = left.unionByName(right).repartition(max(1, g * h), "h", "g", "dim").sortWithinPartitions("h", "g", "dim", F.desc("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids_held, work = None, [], [], None
        block: list[tuple] = []  # candidates not yet compared

        def flush():
            if block:
                ids, data = (np.concatenate(x) for x in zip(*block, strict=True))
                for i in range(0, len(ids), BLOCK_ROWS):
                    work.add(ids[i : i + BLOCK_ROWS], data[i : i + BLOCK_ROWS])
                block.clear()

        def start():
            if held:
                return engine(key[2], np.concatenate(ids_held), np.concatenate(held))
            return None

        def out(work):
            if work is None:
                return []
            flush()
            q, v, s = work.result()
            if not len(q):
                return []
            return [pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64() if score_type == "long" else pa.float64())], ["query_id", "vec_id", "score"])]

        for batch in batches:
            for r in batch.to_pylist():
                if (r["h"], r["g"], r["dim"]) != key:
                    yield from out(work)
                    key, held, ids_held, work = (r["h"], r["g"], r["dim"]), [], [], None
                ids, data = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["data"], "<f8").reshape(-1, r["dim"])
                if r["query"]:
                    held.append(data)
                    ids_held.append(ids)
                elif held:
                    work = work or start()
                    block.append((ids, data))
                    if sum(len(x) for x, _ in block) >= BLOCK_ROWS or sum(x.nbytes for _, x in block) >= GROUP_BYTES // 4:
                        flush()
        yield from out(work)

    found = both.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The k best of each of n queries: a heap per query, kept as sorted rows of one matrix."""

    def __init__(self, n: int, k: int, kind: type):
        self.low = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        self.k, self.score, self.vec = k, np.full((n, k), self.low, kind), np.full((n, k), np.iinfo(np.int64).max)

    def merge(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """Take in candidates: q (ascending row numbers), vec, score."""
        if not len(q):
            return
        rows, first, count = np.unique(q, return_index=True, return_counts=True)
        wide = int(count.max())
        s, v = np.full((len(rows), self.k + wide), self.low, self.score.dtype), np.full((len(rows), self.k + wide), np.iinfo(np.int64).max)
        s[:, : self.k], v[:, : self.k] = self.score[rows], self.vec[rows]
        at, col = np.repeat(np.arange(len(rows)), count), self.k + np.arange(len(q)) - np.repeat(first, count)
        s[at, col], v[at, col] = score, vec
        order = np.lexsort((v, -s if s.dtype != np.int64 else ~s), axis=1)[:, : self.k]
        self.score[rows], self.vec[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)

    def floor(self) -> np.ndarray:
        """Each query's k-th best score so far."""
        return self.score[:, -1]

    def result(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = self.vec != np.iinfo(np.int64).max
        return np.repeat(ids, there.sum(axis=1)), self.vec[there], self.score[there]
