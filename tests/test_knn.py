"""Searches in many groups against all distances, and how few groups they compare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larchpoint.operators import knn


def cloud(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, p array<double>")


def points(kind: str) -> np.ndarray:
    rng = np.random.default_rng(5)
    if kind == "ties":
        return rng.integers(0, 4, (300, 3)).astype(float)
    if kind == "plane":
        return rng.normal(size=(300, 2))
    if kind == "clusters":
        return np.repeat(rng.normal(size=(6, 3)) * 20, 50, axis=0) + rng.normal(size=(300, 3))
    return rng.normal(size=(300, 8))


@pytest.fixture(params=["ties", "plane", "clusters", "wide"])
def data(request, monkeypatch):
    monkeypatch.setattr(knn, "GROUP", 25)
    return points(request.param)


def test_nearest_in_groups(spark, data):
    df, d = cloud(spark, data), knn.distances(data, data)
    np.fill_diagonal(d, np.inf)
    want = [(q, r + 1, int(i)) for q, row in enumerate(d) for r, i in enumerate(np.lexsort((np.arange(len(row)), row))[:30])]
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in knn.nearest(df, k=30, exclude_self=True).collect()) == want
    asked = data[:40] + 0.25
    d = knn.distances(asked, data)
    want = [(q, r + 1, int(i), float(np.sqrt(row[i]))) for q, row in enumerate(d) for r, i in enumerate(np.lexsort((np.arange(len(row)), row))[:3])]
    assert sorted(map(tuple, knn.build_and_query(df, cloud(spark, asked), 3).collect())) == want


def test_counts_in_groups(spark, data):
    df, d = cloud(spark, data), knn.distances(data, data)
    want = sorted((q, r, int((row <= r * r).sum())) for q, row in enumerate(d) for r in (0.0, 1.0, 2.5))
    assert sorted(map(tuple, knn.count_within(df, [0.0, 1.0, 2.5]).collect())) == want
    asked = cloud(spark, data[:30] + 500).withColumn("radii", F.array(F.lit(0.5), F.col("id").cast("double")))  # each its own
    far = knn.distances(data[:30] + 500, data)
    want = sorted({(q, r, int((far[q] <= r * r).sum())) for q in range(30) for r in (0.5, float(q))})
    assert sorted(map(tuple, knn.count_within(df, None, asked).collect())) == want


def test_few_groups_are_compared(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP", 25)
    compared = []
    plain = knn._compare
    monkeypatch.setattr(knn, "_compare", lambda *a: compared.append(a[0]) or plain(*a))
    df = cloud(spark, np.random.default_rng(1).uniform(size=(2000, 3)))
    knn.nearest(df, k=4)
    knn.count_within(df, 0.05)
    first, rest, counted = (x.count() for x in compared)  # a row for each query and group
    assert first == 2000 and rest < 0.15 * 2000 * 80 and counted < 0.1 * 2000 * 80


def test_most_groups_are_compared_in_tiles(spark, monkeypatch):
    """In many dimensions all pairs of groups remain; then there is no row for each query and group."""
    monkeypatch.setattr(knn, "GROUP", 50)
    compared = []
    plain = knn._compare
    monkeypatch.setattr(knn, "_compare", lambda *a: compared.append(a[0].count()) or plain(*a))
    x = np.random.default_rng(2).normal(size=(600, 16))
    df, d = cloud(spark, x), knn.distances(x, x)
    want = [(q, r + 1, int(i)) for q, row in enumerate(d) for r, i in enumerate(np.lexsort((np.arange(len(row)), row))[:5])]
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in knn.nearest(df, k=5).collect()) == want
    want = sorted((q, r, int((row <= r * r).sum()) - 1) for q, row in enumerate(d) for r in (4.0, 5.5))
    assert sorted(map(tuple, knn.count_within(df, [4.0, 5.5], include_self=False).collect())) == want
    assert compared == [600]  # each query with its own group


@pytest.mark.parametrize("kind", ["far off", "large and small", "not finite", "lattice"])
def test_blocks_equal_plain_distances(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 5))
    if kind == "far off":
        x += 1e7
    elif kind == "large and small":
        x *= 10.0 ** rng.integers(-30, 18, (700, 1))
    elif kind == "not finite":
        x[::9, 1], x[::31, 2], x[::50] = np.nan, np.inf, 1e200
    else:
        x = rng.integers(0, 3, (700, 5)) * 0.1  # many at the radius itself, or equally far
    ids = rng.permutation(700).astype(np.int64)
    with np.errstate(all="ignore"):
        d = knn.distances(x, x)
    np.fill_diagonal(d, np.inf)
    near, within = knn.Nearest(ids, x, 6, True), knn.Counts(ids, x, True, np.tile([0.2, 1.5], (700, 1)))
    for at in np.array_split(np.arange(700), 3):
        near.add(ids[at], x[at])
        within.add(ids[at], x[at])
    d[~np.isfinite(d)] = np.inf
    order = np.array([np.lexsort((ids, row))[:6] for row in d])
    best = np.take_along_axis(d, order, 1)
    assert (near.d2 == best).all() and (near.found[np.isfinite(best)] == ids[order][np.isfinite(best)]).all()
    assert (within.n == np.stack([(d <= r * r).sum(axis=1) for r in (0.2, 1.5)], 1)).all()
