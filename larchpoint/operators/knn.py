"""Nearest neighbours and radius counts over vectors of any dimension, exact, in blocks.

Points and queries are put in Z-order of their first three components and cut into groups of GROUP rows; a task compares
one group of each, so it holds two bounded blocks. Only groups are compared whose boxes are close enough: for a radius,
closer than it; for nearest neighbours, closer than what each query's k-th neighbour within the closest group allows.
The best k of each task are merged by rank. Where most pairs of groups remain, as in many dimensions, a task holds a
block of queries instead and all points pass by it in tiles, so there is no row for each query and group.

Within blocks a product of matrices in single precision gives every squared distance up to a bound on its error. Pairs
that the bound leaves undecided are computed again in double precision, component by component, so results are those
of plain distances. Rows are (id, p array<double>).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larchpoint.functions import morton
from larchpoint.functions.morton import Bounds
from larchpoint.session import ship
from larchpoint.sources.points import infer_bounds
from larchpoint.storage import keep, with_rank

GROUP = 8192
#: Queries and points of one product of matrices; points of one tile in bytes; bytes of a task's queries.
ROWS, COLUMNS, TILE, HELD = 512, 1024, 16 << 20, 64 << 20
#: Tasks that a search of everything is cut into, at least.
TASKS = 64
#: Share of the pairs of groups above which all are compared in tiles.
MOST = 0.5
#: Half a unit in the last place of single precision, and components beyond which it isn't used.
HALF, LARGE = 2.0**-24, 1e15


def as_vectors(points: DataFrame) -> DataFrame:
    return points.select("id", F.array("x", "y", "z").alias("p"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, added component by component in order."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        x = a[:, d, None] - b[:, d]
        out += x * x
    return out


def grouped(rows: DataFrame, box: Bounds) -> DataFrame:
    """Rows with g, their group along the curve."""
    at = {a: F.coalesce(F.try_element_at("p", F.lit(i)), F.lit(0.0)) for i, a in enumerate("xyz", 1)}
    placed = with_rank(morton.with_code(rows.withColumns(at), box), ["code", "id"])
    return keep(placed.withColumn("g", F.floor(F.col("pos") / GROUP).cast("int")).drop("pos", "code", *"xyz"))


def boxes(rows: DataFrame) -> DataFrame:
    """g, lo, hi: a row for GROUP rows."""
    dims = rows.select(F.size("p")).head()[0]
    side = lambda f: F.array(*(f(F.col("p")[i]) for i in range(dims)))
    return keep(rows.groupBy("g").agg(side(F.min).alias("lo"), side(F.max).alias("hi")))


def apart(points: DataFrame, queries: DataFrame) -> DataFrame:
    """g, h, d2: squared distances between the boxes of groups, one row for GROUP * GROUP pairs of rows."""
    right = queries.select(F.col("g").alias("h"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    gap = F.zip_with(F.zip_with("lo", "qhi", lambda a, b: a - b), F.zip_with("qlo", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return points.crossJoin(right).select("g", "h", F.aggregate(gap, F.lit(0.0), lambda total, x: total + x * x).alias("d2"))


#: Room for rounding in distances to boxes.
SLACK = 1 + 1e-9


def close(queries: DataFrame, pairs: DataFrame, points: DataFrame, limit: Column) -> DataFrame:
    """Queries with every group g of the pairs (g, h) of their group h whose box (from points) is within a squared limit."""
    rows = queries.withColumnRenamed("g", "h").join(pairs, "h").join(points, "g")
    gap = F.zip_with(F.zip_with("lo", "p", lambda a, x: a - x), F.zip_with("p", "hi", lambda x, b: x - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    d2 = F.aggregate(gap, F.lit(0.0), lambda total, x: total + x * x)
    return keep(rows.where(d2 <= limit * SLACK).drop("lo", "hi"))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise squared distances, added as in distances()."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        x = a[:, d] - b[:, d]
        out += x * x
    return out


def same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places i, j with a[i] = b[j], by i."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]]


class Block:
    """A block of queries that points pass by.

    take(rows, columns, out, norm, room) gets out = |p|^2 - 2 <q, p> of queries and points moved by one centre, in single
    precision: the squared distance is within room of out + norm. Rows or points with a component that isn't finite
    or is beyond LARGE go to plain(rows, columns, squared distances).
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, drop: bool):
        self.ids, self.q, self.drop = ids, q, drop
        usual = (np.abs(q) <= LARGE).all(axis=1)
        self.usual, self.odd = np.flatnonzero(usual), np.flatnonzero(~usual)
        some = q[self.usual]
        self.centre = some.mean(axis=0) if len(some) else np.zeros(q.shape[1])
        self.side = np.abs(some).max(initial=0.0)
        moved = some - self.centre
        self.norm = (moved * moved).sum(axis=1)
        self.left = np.hstack([-2 * moved, np.ones((len(moved), 1))]).astype(np.float32)

    def add(self, ids: np.ndarray, p: np.ndarray) -> None:
        dims = p.shape[1]
        self.pi, self.p, self.twins = ids, p, same(self.ids, ids) if self.drop else None
        usual = (np.abs(p) <= LARGE).all(axis=1)
        with np.errstate(all="ignore"):
            for rows, cols in ((self.odd, np.arange(len(p))), (self.usual, np.flatnonzero(~usual))):
                for i in range(0, len(rows), ROWS):
                    for j in range(0, len(cols), COLUMNS):
                        a, b = rows[i : i + ROWS], cols[j : j + COLUMNS]
                        self.plain(a, b, distances(self.q[a], p[b]))
        at = np.flatnonzero(usual)
        moved = p[at] - self.centre
        norm = (moved * moved).sum(axis=1)
        order = np.argsort(norm, kind="stable")  # points of like norms have like errors
        at, moved, norm = at[order], moved[order], norm[order]
        # Rounding of the product and its terms; of the centred components (squared, over HALF); and underflow.
        share = 2 * (dims + 8) * HALF
        least = dims * (2.0**-76 * max(self.side, np.abs(p[at]).max(initial=0.0)) ** 2 + 1e-37)
        for j in range(0, len(at), COLUMNS):
            cols = slice(j, j + COLUMNS)
            right = np.ascontiguousarray(np.hstack([moved[cols], norm[cols, None]]).astype(np.float32).T)
            for i in range(0, len(self.usual), ROWS):
                rows = slice(i, i + ROWS)
                self.take(self.usual[rows], at[cols], self.left[rows] @ right, self.norm[rows], share * (self.norm[rows] + norm[cols].max()) + least)
        self.finish()

    def finish(self) -> None:
        """After all points of one add()."""


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))[:, None]


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))[:, None]


def _each(mask: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.packbits(mask, axis=1)).sum(axis=1, dtype=np.int64)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero, for few of many: bytes of eight places each are searched first."""
    bits = np.packbits(mask, axis=1)
    a, b = np.nonzero(bits)
    nth, bit = np.nonzero(np.unpackbits(bits[a, b][:, None], axis=1))
    return a[nth], b[nth] * 8 + bit


class Nearest(Block):
    """The k nearest points of each query, no farther than its bound: a sorted row for each query."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, drop: bool, bound: np.ndarray | None = None):
        super().__init__(ids, q, drop)
        self.k, self.bound = k, np.full(len(ids), np.inf) if bound is None else bound.astype(float)
        self.d2, self.found = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def take(self, rows: np.ndarray, cols: np.ndarray, out: np.ndarray, norm: np.ndarray, room: np.ndarray) -> None:
        bound = self.bound[rows]
        if np.isinf(bound).any():
            own = int(np.bincount(self.twins[0]).max(initial=0)) if self.drop else 0
            if self.k + own <= len(cols):  # so many points are no farther than this
                kth = np.partition(out, self.k + own - 1, axis=1)[:, self.k + own - 1]
                bound = np.minimum(bound, kth + norm + room)
        a, b = _where(out <= _up(bound - norm + room))
        for i in range(0, len(a), 1 << 17):
            x, y = rows[a[i : i + (1 << 17)]], cols[b[i : i + (1 << 17)]]
            self.merge(x, y, exact(self.q[x], self.p[y]))

    def plain(self, rows: np.ndarray, cols: np.ndarray, d2: np.ndarray) -> None:
        a, b = np.nonzero(d2 <= self.bound[rows, None])
        self.merge(rows[a], cols[b], d2[a, b])

    def merge(self, x: np.ndarray, y: np.ndarray, d2: np.ndarray) -> None:
        """Candidates: queries in ascending order, points, squared distances."""
        fit = (d2 <= self.bound[x]) & np.isfinite(d2)
        if self.drop:
            fit &= self.ids[x] != self.pi[y]
        x, y, d2 = x[fit], y[fit], d2[fit]
        if not len(x):
            return
        rows, first, n = np.unique(x, return_index=True, return_counts=True)
        wide = self.k + int(n.max())
        d, v = np.full((len(rows), wide), np.inf), np.full((len(rows), wide), np.iinfo(np.int64).max)
        d[:, : self.k], v[:, : self.k] = self.d2[rows], self.found[rows]
        at, col = np.repeat(np.arange(len(rows)), n), self.k + np.arange(len(x)) - np.repeat(first, n)
        d[at, col], v[at, col] = d2, self.pi[y]
        order = np.lexsort((v, d), axis=1)[:, : self.k]
        self.d2[rows], self.found[rows] = np.take_along_axis(d, order, 1), np.take_along_axis(v, order, 1)
        self.bound[rows] = np.minimum(self.bound[rows], self.d2[rows, -1])

    def result(self) -> pa.RecordBatch:
        there = np.isfinite(self.d2)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, there.sum(axis=1))), pa.array(self.found[there]), pa.array(self.d2[there])], ["query_id", "id", "d2"])


class Counts(Block):
    """How many points are within each query's radii."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, drop: bool, radii: np.ndarray):
        super().__init__(ids, q, drop)
        self.radii, self.r2, self.n = radii, radii * radii, np.zeros(radii.shape, np.int64)

    def take(self, rows: np.ndarray, cols: np.ndarray, out: np.ndarray, norm: np.ndarray, room: np.ndarray) -> None:
        for r in range(self.r2.shape[1]):
            r2 = self.r2[rows, r]
            may = out <= _up(r2 - norm + room)
            sure = out <= _down(r2 - norm - room)
            n = _each(sure)
            open_ = np.flatnonzero(_each(may) > n)
            self.n[rows, r] += n
            if len(open_):
                a, b = _where(may[open_] & ~sure[open_])
                a = open_[a]
                for i in range(0, len(a), 1 << 17):
                    x, y = a[i : i + (1 << 17)], b[i : i + (1 << 17)]
                    within = exact(self.q[rows[x]], self.p[cols[y]]) <= r2[x]
                    self.n[rows, r] += np.bincount(x[within], minlength=len(rows))

    def plain(self, rows: np.ndarray, cols: np.ndarray, d2: np.ndarray) -> None:
        for r in range(self.r2.shape[1]):
            self.n[rows, r] += (d2 <= self.r2[rows, r, None]).sum(axis=1)

    def finish(self) -> None:
        if self.drop:
            a, b = self.twins
            with np.errstate(all="ignore"):
                d2 = exact(self.q[a], self.p[b])
            for r in range(self.r2.shape[1]):
                self.n[:, r] -= np.bincount(a[d2 <= self.r2[a, r]], minlength=len(self.n))

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.radii.shape[1])), pa.array(self.radii.ravel()), pa.array(self.n.ravel())], ["query_id", "radius", "n"])


def _values(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of equally long arrays of numbers as a matrix; null numbers become NaN."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _compare(queries: DataFrame, points: DataFrame, work: Callable[..., Block], schema: str, extra: list[str] = [], in_groups: bool = False) -> DataFrame:  # noqa: B006
    """work(query ids, query vectors, columns of extra) for the queries of a group, with the points of a group added.
    in_groups: points are in groups g, and queries have a row for every group g they need, by their own group h; else
    groups are made by hash, and every pair of groups is compared."""
    ship(points.sparkSession)
    none = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in extra]
    if in_groups:
        left = queries.select(F.lit(True).alias("q"), "g", "h", "id", "p", *extra)
        right = points.join(queries.select("g", "h").distinct(), "g").select(F.lit(False).alias("q"), "g", "h", "id", "p", *none)
        both = left.unionByName(right).repartition("g", "h").sortWithinPartitions("g", "h", F.desc("q"))
    else:
        n, m = points.count(), queries.count()
        g, h = max(1, -(-n // GROUP)), max(1, -(-m // GROUP))
        if n <= GROUP and m > 256:  # few points: more, smaller groups of queries
            h = max(h, min(8, m // 256))
        right = points.select(F.lit(False).alias("q"), F.pmod(F.xxhash64("id"), F.lit(g)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"), "id", "p", *none)
        left = queries.select(F.lit(True).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g"), F.pmod(F.xxhash64("id"), F.lit(h)).cast("int").alias("h"), "id", "p", *extra)
        both = left.unionByName(right.select(left.columns)).repartition(g * h, "g", "h").sortWithinPartitions("g", "h", F.desc("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held)
            q = t["q"].to_numpy()
            ids = t["id"].to_numpy()
            v = _values(t["p"].combine_chunks())
            if not q.any() or q.all():
                return
            block = work(ids[q], v[q], *(_values(t[c].combine_chunks().filter(pa.array(q))) for c in extra))
            block.add(ids[~q], v[~q])
            yield block.result()

        for batch in batches:
            g, h = batch.column("g").to_numpy(), batch.column("h").to_numpy()
            cut = np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if a == b:
                    continue
                if (g[a], h[a]) != key:
                    yield from out()
                    key, held = (g[a], h[a]), []
                held.append(batch.slice(a, b - a))
        yield from out()

    return both.mapInArrow(run, schema)


def _tiles(rows: DataFrame, parts: int, extra: list[str]) -> DataFrame:
    """part, single, ids, data, more: a few of the rows of one part, as bytes of longs and numbers. single: their vectors
    are kept in single precision, without loss; more: the columns of extra."""

    def tiles(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        part, ids, v = (_values(t[c].combine_chunks()) for c in ("part", "id", "p"))
        more = [_values(t[c].combine_chunks()).reshape(len(ids), -1) for c in extra]
        more = np.hstack(more) if more else np.zeros((len(ids), 0))
        with np.errstate(all="ignore"):
            short = v.astype(np.float32)
            single = bool((short == v).all())
        data = short if single else v
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order])) + 1
        for at in np.split(order, cut):
            cells = [[int(part[at[0]])], [single], [ids[at].astype("<i8").tobytes()], [data[at].tobytes()], [more[at].astype("<f8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "single", "ids", "data", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= TILE:
                yield from tiles(held)
                held = []
        if held:
            yield from tiles(held)

    put = F.pmod(F.xxhash64("id", "p"), F.lit(parts)).cast("int")
    return rows.select(put.alias("part"), "id", "p", *extra).mapInArrow(run, "part int, single boolean, ids binary, data binary, more binary")


def _everything(queries: DataFrame, points: DataFrame, work: Callable[..., Block], schema: str, extra: list[str] = [], width: int = 1) -> DataFrame:  # noqa: B006
    """work(query ids, query vectors, columns of extra) for blocks of queries, with all points added tile by tile.

    A task has a block of queries, of GROUP rows and up, and one of a few parts of the points; its memory is bounded
    whatever their number. Blocks grow with the table up to HELD bytes, so that points are copied few times and a
    query has few partial results. width: numbers of a query's result.
    """
    spark = points.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TILE // 2))
    n, m = points.count(), queries.count()
    dims = queries.select(F.size("p")).head()[0]
    most = max(256, min(4 * GROUP, HELD // (12 * dims + 24 * width)))
    h = max(1, -(-m // max(min(GROUP, most), min(most, m // 32))))
    g = max(1, min(-(-n // GROUP), -(-max(TASKS, 4 * spark.sparkContext.defaultParallelism) // h)))
    left, right = _tiles(queries, h, extra), _tiles(points, g, [])
    left = left.select(F.lit(True).alias("q"), F.col("part").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g"), "single", "ids", "data", "more")
    right = right.select(F.lit(False).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"), F.col("part").alias("g"), "single", "ids", "data", "more")
    both = left.unionByName(right).withColumn("task", F.col("h") * g + F.col("g")).repartitionById(g * h, "task").sortWithinPartitions("task", F.desc("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, held = None, None, []

        def close() -> None:
            nonlocal block
            if held and isinstance(block, list):
                ids, v, more = (np.concatenate(x) for x in zip(*block, strict=True))
                block = work(ids, v, *([more] if extra else []))
            if held:
                block.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if r["task"] != task:
                    close()
                    if isinstance(block, Block):
                        yield block.result()
                    task, block = r["task"], []
                ids = np.frombuffer(r["ids"], "<i8")
                v = np.frombuffer(r["data"], "<f4" if r["single"] else "<f8").reshape(len(ids), -1).astype(float)
                if r["q"]:
                    block.append((ids, v, np.frombuffer(r["more"], "<f8").reshape(len(ids), -1)))
                elif block:
                    held.append((ids, v))
                    if sum(len(x) for x, _ in held) >= GROUP or sum(x.nbytes for _, x in held) >= TILE:
                        close()
        close()
        if isinstance(block, Block):
            yield block.result()

    return both.mapInArrow(run, schema)


def nearest(points: DataFrame, queries: DataFrame | None = None, k: int = 8, exclude_self: bool = False, squared: bool = False) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k nearest points of each query, ties by id.

    exclude_self drops the point with the query's own id; it holds only if the points are their own queries.
    """
    n = points.count()
    own = queries is None
    if k < 1 or k > n - (1 if exclude_self and own else 0):
        raise ValueError("k must be between 1 and the number of points")
    drop = exclude_self and own

    def best(ids: np.ndarray, q: np.ndarray, bound: np.ndarray | None = None) -> Block:
        return Nearest(ids, q, k, drop, None if bound is None else bound.ravel())

    schema = "query_id long, id long, d2 double"
    if n <= GROUP:
        rows = _compare(points if own else queries, points, best, schema)
    else:
        placed, asked, box, far = _placed(points, None if own else queries)
        first = keep(far.groupBy("h").agg(F.min_by("g", F.struct("d2", F.abs(F.col("g") - F.col("h")))).alias("g")))
        near = keep(_compare(asked.withColumnRenamed("g", "h").join(first, "h"), placed, best, schema, [], True))
        bound = near.groupBy("query_id").agg(F.max("d2").alias("bound"), F.count("*").alias("n"))
        bound = bound.select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("bound")).alias("bound"))
        asked = keep(asked.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
        widest = asked.groupBy(F.col("g").alias("h")).agg(F.max("bound").alias("bound"))
        others = far.join(widest, "h").where(F.col("d2") <= F.col("bound") * SLACK).join(first, ["g", "h"], "left_anti").select("g", "h")
        if others.count() > MOST * far.count():
            rows = _everything(asked, placed, best, schema, ["bound"], k)
        else:
            rows = near.unionByName(_compare(close(asked, others, box, F.col("bound")), placed, best, schema, ["bound"], True))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id"))
    out = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "id", (F.col("d2") if squared else F.sqrt("d2")).alias("distance"))


def _placed(points: DataFrame, queries: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Points and queries in groups along the curve, the points' boxes, and the distances between the groups' boxes."""
    at = {a: F.coalesce(F.try_element_at("p", F.lit(i)), F.lit(0.0)) for i, a in enumerate("xyz", 1)}
    box = infer_bounds(points.withColumns(at))
    placed = grouped(points, box)
    asked = placed if queries is None else grouped(queries, box)
    own = boxes(placed)
    return placed, asked, own, keep(apart(own, own if queries is None else boxes(asked)))


def build_and_query(points: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    return nearest(points, queries, k)


def count_within(points: DataFrame, radius: float | list[float] | None = None, queries: DataFrame | None = None, include_self: bool = True) -> DataFrame:
    """query_id, radius, n: points within a radius of each query (inclusive), for one radius, for several, or, if
    radius is None, for the radii in the queries' column `radii`."""
    own = queries is None
    if radius is not None:
        radii = [float(radius)] if isinstance(radius, (int, float)) else [float(r) for r in radius]
        if any(r < 0 for r in radii):
            raise ValueError("a radius can't be negative")
        asked = (points if own else queries).select("id", "p", F.array(*map(F.lit, radii)).alias("radii"))
    else:
        asked = queries
    drop = own and not include_self

    def count(ids: np.ndarray, q: np.ndarray, radii: np.ndarray) -> Block:
        return Counts(ids, q, drop, radii)

    schema = "query_id long, radius double, n long"
    if points.count() <= GROUP:
        found = _compare(asked, points, count, schema, ["radii"])
    else:
        placed, asked, box, far = _placed(points, asked)
        r = F.array_max("radii")
        widest = asked.groupBy(F.col("g").alias("h")).agg(F.max(r).alias("r"))
        pairs = far.join(widest, "h").where(F.col("d2") <= F.col("r") * F.col("r") * SLACK).select("g", "h")
        if pairs.count() > MOST * far.count():
            found = _everything(asked, placed, count, schema, ["radii"], asked.select(F.max(F.size("radii"))).head()[0])
        else:
            found = _compare(close(asked, pairs, box, r * r), placed, count, schema, ["radii"], True)
        # Queries that are close to no group have a row too.
        found = found.unionByName(asked.select(F.col("id").alias("query_id"), F.explode("radii").alias("radius"), F.lit(0).cast("long").alias("n")))
    return found.groupBy("query_id", "radius").agg(F.sum("n").alias("n"))
