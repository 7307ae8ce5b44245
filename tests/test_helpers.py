"""Index arithmetic, layouts and small operators against plain Python."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from larchpoint.operators import domains, layout, moments, radix, trees
from larchpoint.sources import points
from larchpoint.storage import forget, keep, shared_folder

from .test_trees import cloud, frame


def test_multi_indices_by_counting():
    for order in range(6):
        every = [m for m in itertools.product(range(order + 1), repeat=3) if sum(m) == order]
        assert sorted(moments.multi_indices(order)) == sorted(every) and moments.level_size(order) == len(every)
        assert moments.level_offset(order) == sum(moments.level_size(o) for o in range(order))
        assert moments.total_coefficients(order) == len(moments.all_indices(order))
        for n, m in enumerate(moments.multi_indices(order)):
            assert moments.triangular_index(*m) == n and moments.index_factorial(m) == math.prod(map(math.factorial, m))


def test_packed_moments_come_back(spark):
    names = [moments.name(m) for m in moments.all_indices(2)]
    row = spark.createDataFrame([tuple(float(i) for i in range(10))], ", ".join(f"{n} double" for n in names))
    packed = row.select(moments.pack([F.col(n) for n in names]).alias("p"))
    assert packed.select(*(c.alias(n) for n, c in moments.unpack(F.col("p"), 2).items())).collect() == row.collect()


def test_values_of_leaves_are_merged_for_every_range(spark):
    leaf = spark.createDataFrame([(i, float(i * i % 97), i) for i in range(600)], "leaf long, a double, b long")
    ranges = [(0, 599), (0, 0), (599, 599), (1, 598), (7, 8), (8, 15), (63, 512), (64, 575), (100, 101), (510, 514)]
    nodes = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(ranges)], "node_id long, first long, last long")
    got = {r["node_id"]: (r["a"], r["b"]) for r in radix.over_leaves(nodes, leaf, {"a": F.sum, "b": F.max}).collect()}
    assert got == {n: (sum(float(i * i % 97) for i in range(a, b + 1)), b) for n, (a, b) in enumerate(ranges)}


def test_compressed_rows(spark):
    pairs = [(3, 5), (3, 1), (1, 9), (7, 2), (3, 4)]
    rows = layout.csr(spark.createDataFrame(pairs, "target long, source long")).collect()
    assert sorted((r["target"], r["k"], r["source"], r["count"]) for r in rows) == [(1, 0, 9, 1), (3, 0, 1, 3), (3, 1, 4, 3), (3, 2, 5, 3), (7, 0, 2, 1)]


def test_blocks_of_sources(spark):
    pairs = [(t, s) for t, n in ((4, 7), (9, 1), (2, 4), (5, 3)) for s in range(n)]
    rows = layout.target_blocks(spark.createDataFrame(pairs, "target long, source long"), 3).collect()
    want, block, first = [], -1, 0
    for row, (t, n) in enumerate(((2, 4), (4, 7), (5, 3), (9, 1))):
        for s in range(n):
            block += s % 3 == 0
            want.append((t, s, s, n, first, row, block))
        first += n
    assert sorted((r["target"], r["source"], r["k"], r["count"], r["first"], r["row"], r["block"]) for r in rows) == want


def test_sums_before_each_row_across_blocks(spark):
    rows = spark.range(10_000).select("id", (F.col("id") % 7).alias("n"))
    got = {r["id"]: r["first"] for r in layout.starts(rows, "id", "n").collect()}
    total = 0
    for i in range(10_000):
        assert got[i] == total
        total += i % 7


def test_dense_moments_come_back(spark):
    packed = spark.createDataFrame([([float(i + 1) for i in range(20)],)], "p array<double>")
    row = packed.select("p", moments.densify(F.col("p"), 3).alias("d")).select("p", "d", moments.from_dense(F.col("d"), 3).alias("q")).head()
    assert row["p"] == row["q"] and len(row["d"]) == 64
    for n, (i, j, k) in enumerate(moments.all_indices(3)):
        assert row["d"][(i * 4 + j) * 4 + k] == n + 1.0
    assert sum(x != 0 for x in row["d"]) == 20


def test_single_owner_and_places_in_aligned_domains(spark):
    df = frame(spark, cloud("uniform", 60))
    rows = keep(domains.nth_in_domain(domains.decompose(df, 3, points.infer_bounds(df), align_level=1)))
    for d, n in rows.groupBy("domain").count().collect():
        assert sorted(r["local"] for r in rows.where(F.col("domain") == d).collect()) == list(range(n))
    bucketed = keep(radix.bucket(radix.sort_points(df), 4))
    nodes = radix.hierarchy(radix.leaves(bucketed))
    of = {i: i // 5 for i in range(15)}
    owner = {r["node_id"]: r["domain"] for r in domains.single_owner(nodes, spark.createDataFrame(list(of.items()), "leaf long, domain long")).collect()}
    for r in nodes.collect():
        below = {of[i] for i in range(r["first"], r["last"] + 1)}
        assert owner[r["node_id"]] == (below.pop() if len(below) == 1 else -1)


def test_thin_slabs_are_refined(spark):
    flat = cloud("uniform", 200)
    flat[:, 2] *= 1e-3
    rows, leaf, depth = trees.fixed_depth(frame(spark, flat), 8)
    after, found = trees.refined(rows, leaf, 3, 4.0)
    every = found.orderBy("leaf").collect()
    assert max(r["depth"] for r in every) > depth and sum(r["n"] for r in every) == after.count() == 200
    assert all(b["lo"] == a["hi"] + 1 for a, b in zip(every, every[1:], strict=False))
    assert after.join(found, "leaf").where("pos < lo OR pos > hi").isEmpty()


def test_points_are_written_and_kept_tables_deleted(spark, tmp_path):
    df = frame(spark, cloud("uniform", 10))
    points.write(df, f"file://{tmp_path}/points")
    assert spark.read.parquet(f"file://{tmp_path}/points").count() == 10
    kept = keep(df)
    assert kept.count() == 10 and kept.kept_at.startswith(shared_folder(spark).rsplit("/", 1)[0])
    forget(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(kept.kept_at)
