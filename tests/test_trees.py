"""Properties of trees, walks and domains on uniform, clustered and tie-heavy clouds, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larchpoint.functions import morton
from larchpoint.operators import cells, domains, geometry, knn, layout, moments, radix, trees, walk
from larchpoint.plans import queries
from larchpoint.plans import prepared as prep
from larchpoint.sources import points
from larchpoint.storage import keep
from larchpoint.streaming.points import cell_counts, follow

SCHEMA = "id long, x double, y double, z double, mass double"


def cloud(kind: str, n: int = 300) -> np.ndarray:
    rng = np.random.default_rng(4)
    if kind == "same":
        return np.zeros((16, 3))
    if kind == "ties":
        return rng.integers(0, 3, (n, 3)).astype(float)
    p = rng.uniform(-1, 1, (n, 3))
    if kind == "clustered":
        r = rng.uniform(0, 1, n) ** (1 / 3)
        p = p / np.linalg.norm(p, axis=1)[:, None] * (r / (1 - 0.85 * r))[:, None]
    return p


def frame(spark, p: np.ndarray):
    return keep(spark.createDataFrame([(i, *map(float, x), 0.5 + i % 3) for i, x in enumerate(p)], SCHEMA))


CLOUDS = ["uniform", "clustered", "ties", "same"]
TREES = [("radix", "adaptive"), ("radix", "static_radix"), ("radix", "fixed_depth"), ("kdtree", "adaptive"), ("octree", "adaptive")]


def covered(nodes, found, n: int) -> np.ndarray:
    """How often far and near pairs, and leaves with themselves, cover each pair of points."""
    at = {r["node_id"]: (r["lo"], r["hi"] + 1) for r in nodes.collect()}
    out = np.zeros((n, n), int)
    for r in [*found.far.collect(), *found.near.collect()]:
        (a, b), (c, d) = at[r["target"]], at[r["source"]]
        out[a:b, c:d] += 1
    for r in nodes.where("is_leaf").collect():
        a, b = at[r["node_id"]]
        out[a:b, a:b] += 1
    return out


@pytest.mark.parametrize(("kind", "tree"), [(k, t) for k in CLOUDS for t in TREES if t == TREES[0] or k in ("clustered", "same") and t[0] != "octree" or k == "ties" and t[0] == "octree"])
def test_walk_covers_every_pair_once(spark, kind, tree):
    p = cloud(kind)
    made = prep.prepare(frame(spark, p), tree[0], prep.Options(leaf_size=8, mode=tree[1], target_leaf_points=8))
    assert (covered(made.tree.nodes, made.walk, len(p)) == 1).all()
    rows = {r["node_id"]: r for r in made.tree.nodes.collect()}
    assert [i for i, r in rows.items() if r["parent"] < 0] == [0]
    for i, r in rows.items():
        if not r["is_leaf"]:
            a, b = rows[r["left"]], rows[r["right"]]
            assert a["parent"] == b["parent"] == i and (a["first"], b["last"]) == (r["first"], r["last"]) and a["last"] + 1 == b["first"] and a["level"] == r["level"] + 1


@pytest.mark.parametrize("criterion", walk.CRITERIA)
def test_join_rounds_equal_tasks_and_criterion_holds(spark, criterion):
    t = prep.build(frame(spark, cloud("clustered")), options=prep.Options(leaf_size=8))
    geom = keep(t.geometry())
    rules = walk.Rules(0.6, criterion)
    few, many = walk.walk(t.nodes, geom, rules), walk.walk(t.nodes, geom, rules, broadcast_nodes=0)
    for side in ("far", "near"):
        a, b = (sorted(map(tuple, getattr(w, side).collect())) for w in (few, many))
        assert a == b and {x[:2] for x in a} == {(x[1], x[0]) for x in a}
    assert few.stats.collect() == many.stats.collect()
    g = {r["node_id"]: r for r in geom.collect()}
    for r in few.far.collect():
        a, b = g[r["target"]], g[r["source"]]
        d2 = sum((a[c] - b[c]) ** 2 for c in ("cx", "cy", "cz"))
        e = "max_extent" if criterion == "bh" else "radius"
        reach = max(a[e], b[e]) + 0.6 * min(a[e], b[e]) if criterion == "engblom" else a[e] + b[e]
        assert reach**2 <= 0.36 * d2 * (1 + 1e-12)


def test_policy_that_drops_pairs_is_refused(spark):
    t = prep.build(frame(spark, cloud("uniform")), options=prep.Options(leaf_size=8))
    for limit in (walk.NODES, 0):
        with pytest.raises(Exception, match="policy"):
            walk.walk(t.nodes, t.geometry(), walk.Rules(policy=lambda p: (p.select(p.mac_ok, walk.ACCEPT, walk.REFINE), p.select(p.mac_ok, 0, -1))), broadcast_nodes=limit).pairs.count()


def test_geometry_holds_balls_and_moments_are_sums(spark):
    p = cloud("clustered")
    t = prep.build(frame(spark, p).withColumn("r", F.lit(0.1)), options=prep.Options(leaf_size=8))
    placed = t.points.orderBy("pos").toPandas()
    nodes = {r["node_id"]: r for r in t.nodes.collect()}
    for r in t.geometry("r").collect():
        mine = placed.iloc[nodes[r["node_id"]]["lo"] : nodes[r["node_id"]]["hi"] + 1]
        for a in "xyz":
            assert r[f"c{a}"] - r[f"h{a}"] <= mine[a].min() - 0.1 + 1e-9 and r[f"c{a}"] + r[f"h{a}"] >= mine[a].max() + 0.1 - 1e-9
    for r in t.multipoles(3).collect():
        mine = placed.iloc[nodes[r["node_id"]]["lo"] : nodes[r["node_id"]]["hi"] + 1]
        d = mine[["x", "y", "z"]].to_numpy() - np.array([r["comx"], r["comy"], r["comz"]])
        for m in moments.all_indices(3):
            want = (mine["mass"].to_numpy() * (d ** np.array(m)).prod(axis=1)).sum()
            assert abs(r[moments.name(m)] - want) < 1e-6 * max(1, abs(want), np.abs(d).max() ** 3 * mine["mass"].sum())


def test_trace_free_tensors_have_no_trace(spark):
    t = prep.build(frame(spark, cloud("uniform", 60)), options=prep.Options(leaf_size=8))
    own = t.multipoles(4)
    for order, k in ((2, "q"), (3, "o"), (4, "h")):
        q = own.select(*(c.alias(n) for n, c in moments.trace_free(order).items())).head().asDict()
        name = lambda *i: k + "".join(map(str, sorted(i)))  # noqa: B023, E731
        for rest in {2: [()], 3: [(0,), (1,), (2,)], 4: [(0, 0), (0, 1), (1, 2)]}[order]:
            assert abs(sum(q[name(i, i, *rest)] for i in range(3))) < 1e-8 * max(1, *map(abs, q.values()))


def test_codes_come_back(spark):
    p = cloud("uniform")
    df = frame(spark, p)
    box = points.infer_bounds(df)
    coded = df.withColumn("code", morton.encode(F.col("x"), F.col("y"), F.col("z"), box))
    back = coded.select("x", "y", "z", *(c.alias(f"b{a}") for a, c in zip("xyz", morton.decode(F.col("code"), box), strict=True)))
    assert all(abs(r[a] - r[f"b{a}"]) < 1e-5 for r in back.collect() for a in "xyz")


@pytest.mark.parametrize("kind", CLOUDS)
def test_leaf_kd_splits_at_medians(spark, kind):
    p = cloud(kind)
    rows, nodes = trees.leaf_kd(frame(spark, p), 8)
    want, todo = {}, [(0, list(range(len(p))))]
    inner = (1 << trees.kd_depth(len(p), 8)) - 1
    while todo:
        node, ids = todo.pop()
        if node >= inner:
            want |= dict.fromkeys(ids, node - inner)
            continue
        side = np.ptp(p[ids], axis=0)
        ids.sort(key=lambda i: (p[i][int(side.argmax())], i))  # noqa: B023
        half = -(-len(ids) // 2)
        todo += [(2 * node + 1, ids[:half]), (2 * node + 2, ids[half:])]
    assert {r["id"]: r["leaf"] for r in rows.collect()} == want
    assert nodes.where("is_leaf").count() == len(set(want.values()))


def test_balancing_cuts_large_leaves_beside_small_ones(spark):
    """A dense corner beside sparse cells: without balancing, leaves that touch differ by several levels."""
    rng = np.random.default_rng(6)
    p = np.concatenate((0.49 + 0.005 * rng.uniform(size=(200, 3)), rng.uniform(size=(40, 3)), [[0.0] * 3, [1.0] * 3]))
    df = frame(spark, p)
    placed = keep(cells.place(df, cells.grid_of(df, 6)))

    def steps(balanced: bool) -> tuple[int, int]:
        """Largest difference of level between leaves that touch, and the points of all leaves."""
        found = [(r["level"], r["cell"], r["n"]) for r in cells.adaptive_cells(placed, 6, 12, balanced).where("is_leaf AND n > 0").collect()]
        boxes = []
        for level, cell, _ in found:
            at = [sum((cell >> (3 * i + a) & 1) << i for i in range(level)) << (6 - level) for a in range(3)]
            boxes.append((level, at, 1 << (6 - level)))
        touch = [abs(m - n) for k, (m, x, u) in enumerate(boxes) for n, y, v in boxes[:k] if all(x[a] <= y[a] + v and y[a] <= x[a] + u for a in range(3))]
        return max(touch), sum(n for *_, n in found)

    assert steps(False)[0] > 1 and steps(True)[0] <= 1
    assert steps(False)[1] == steps(True)[1] == len(p)


def test_adaptive_lists_cover_every_pair_once(spark):
    p = cloud("clustered", 400)
    df = frame(spark, p)
    placed = keep(cells.place(df, cells.grid_of(df, 3)))
    c = keep(cells.adaptive_cells(placed, 3, 12, True))
    rows = {(r["level"], r["cell"]): r for r in c.collect()}
    where = [(r["id"], [rows[level, r["cell"] >> 3 * (3 - level)]["cell_id"] for level in range(4) if (level, r["cell"] >> 3 * (3 - level)) in rows]) for r in placed.collect()]
    leaf = {i: at[-1] for i, at in where}
    over = {}
    for i, at in where:
        for x in at:
            over.setdefault(x, []).append(i)
    out = np.zeros((len(p), len(p)), int)
    for r in cells.near_list(c).collect():
        out[np.ix_(over.get(r["target"], []), over.get(r["source"], []))] += 1
    for r in cells.v_list(c).collect():
        out[np.ix_(over.get(r["target"], []), over.get(r["source"], []))] += 1
    for x in set(leaf.values()):
        out[np.ix_(over[x], over[x])] += 1
    assert (out == 1).all()
    tiles = cells.tiles(c, 5)
    assert tiles.agg(F.sum("n")).head()[0] == len(p) and tiles.agg(F.max("n")).head()[0] <= 5


def test_knn_and_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP", 64)
    p = cloud("ties", 200)
    v = keep(knn.as_vectors(frame(spark, p)))
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    got = {(r["query_id"], r["rank"]): r["id"] for r in knn.nearest(v, k=5, exclude_self=True).collect()}
    for i in range(len(p)):
        order = [j for j in np.lexsort((np.arange(len(p)), d2[i])) if j != i][:5]
        assert [got[i, k] for k in range(1, 6)] == order
    n = {(r["query_id"], r["radius"]): r["n"] for r in knn.count_within(v, [0.0, 1.0, 1.5]).collect()}
    assert all(n[i, r] == (d2[i] <= r * r).sum() for i in range(len(p)) for r in (0.0, 1.0, 1.5))
    for bad in (0, 201):
        with pytest.raises(ValueError):
            knn.nearest(v, k=bad)
    with pytest.raises(ValueError):
        knn.count_within(v, -1.0)


def test_domains_cover_all_pairs_through_halos(spark):
    p = cloud("clustered", 240)
    df = frame(spark, p)
    box = points.infer_bounds(df)
    split = keep(domains.decompose(df, 3, box, equalize=True))
    assert sorted(r["count"] for r in split.groupBy("domain").count().collect()) == [80, 80, 80]
    front = keep(domains.frontier(split, 8))
    assert front.agg(F.sum("n")).head()[0] == 240
    local, remote = domains.local_tree(split, 1, 8), domains.remote_tree(front, 1, box)
    found = domains.classify(local, remote)
    pairs = found.far.select("target", "source").unionByName(found.near.select("target", "source"))
    ends = local.nodes.select(F.col("node_id").alias("target"), (F.col("hi") - F.col("lo") + 1).alias("n"))
    leaf = remote[1].select(F.explode(F.sequence("first", "last")).alias("leaf"), "node_id").withColumnRenamed("node_id", "source").join(remote[0].select("leaf", "domain", "own_leaf"), "leaf").join(front.select("domain", F.col("leaf").alias("own_leaf"), F.col("n").alias("m")), ["domain", "own_leaf"])
    assert pairs.join(ends, "target").join(leaf, "source").agg(F.sum(F.col("n") * F.col("m"))).head()[0] == 80 * 160
    halo = domains.import_halo(found.near, remote[0], remote[1], split, 8)
    wanted = found.near.select("source").distinct().join(leaf, "source").select("domain", "own_leaf").distinct()
    assert halo.count() == wanted.join(front.select("domain", F.col("leaf").alias("own_leaf"), "n"), ["domain", "own_leaf"]).agg(F.sum("n")).head()[0]
    assert halo.where("domain = 1").isEmpty() and halo.count() == halo.select("gid").distinct().count()
    snapped = domains.decompose(df, 3, box, align_level=2)
    assert snapped.select(F.shiftright("code", 57).alias("c"), "domain").distinct().groupBy("c").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError):
        domains.decompose(df, 3, box, equalize=True, align_level=1)


@pytest.mark.parametrize("kind", ["clustered", "ties"])
def test_forest_equals_trees_of_one_domain(spark, kind):
    df = frame(spark, cloud(kind, 90))
    # Domain 3 has one leaf only.
    split = keep(domains.decompose(df, 3, points.infer_bounds(df), equalize=True).withColumn("domain", F.when((F.col("domain") == 2) & (F.col("local") < 4), 3).otherwise(F.col("domain")).cast("long")))
    first = split.groupBy("domain").agg(F.min("pos").alias("first"))
    split = keep(split.join(first, "domain").withColumn("local", F.col("pos") - F.col("first")).drop("first"))
    every = domains.forest(split, 4)
    box = points.infer_bounds(df)
    front = keep(domains.frontier(split, 4))
    halos = sorted((r["viewer"], r["gid"]) for r in domains.halos(split, 4, box).collect())
    for k in (0, 2, 3):
        one = domains.local_tree(split, k, 4)
        for a, b in ((one.nodes, every.nodes), (one.geom, every.geom)):
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.where(F.col("domain") == k).select(*a.columns).collect()))
        remote = domains.remote_tree(front, k, box)
        halo = domains.import_halo(domains.classify(one, remote).near, remote[0], remote[1], split, 4)
        assert sorted(r["gid"] for r in halo.collect()) == [gid for v, gid in halos if v == k]


@pytest.mark.parametrize(("kind", "n", "size"), [("uniform", 20, 1), ("clustered", 77, 8), ("ties", 64, 12), ("same", 16, 3), ("uniform", 5, 8)])
def test_heap_kd_holds_pivots_between_halves(spark, kind, n, size):
    p = cloud(kind, n)
    rows, nodes = trees.heap_kd(frame(spark, p), size)
    rows, nodes = rows.collect(), {r["node_id"]: r for r in nodes.collect()}
    at = {r["pos"]: r for r in rows}
    assert sorted(at) == list(range(len(p))) and sorted(r["id"] for r in rows) == list(range(len(p)))
    for i, r in nodes.items():
        assert r["n"] == r["hi"] - r["lo"] + 1 and r["is_leaf"] == (r["n"] <= size) and (i == 0 or r["parent"] == (i - 1) // 2)
        if r["is_leaf"]:
            assert {at[x]["node"] for x in range(r["lo"], r["hi"] + 1)} == {i}
            continue
        inside = np.array([p[at[x]["id"]] for x in range(r["lo"], r["hi"] + 1)])
        assert r["split_dim"] == int(np.argmax(np.ptp(inside, axis=0)))
        left, right = nodes[2 * i + 1], nodes.get(2 * i + 2)
        middle = left["hi"] + 1
        assert at[middle]["id"] == r["pivot"] and at[middle]["node"] == i and left["lo"] == r["lo"] and (right["lo"], right["hi"]) == (middle + 1, r["hi"]) if right else r["n"] == 2
        values = inside[:, r["split_dim"]]
        cut = middle - r["lo"]
        assert values[cut] == r["split_value"] and (values[:cut] <= r["split_value"]).all() and (values[cut:] >= r["split_value"]).all()


def test_heap_kd_without_points(spark):
    rows, nodes = trees.heap_kd(frame(spark, cloud("uniform", 3)).limit(0), 4)
    assert rows.isEmpty() and nodes.isEmpty() and {"node", "pos"} < set(rows.columns) and "pivot" in nodes.columns


def test_queries_pair_and_own_all_domains(spark):
    sf = "/root/testdata/sf0.001"
    pairs = keep(queries.ALL["cross_owner"](spark, sf))
    assert pairs.where("owner NOT IN (target_domain, source_domain)").isEmpty()
    rows = queries.split(spark, sf)
    nodes = [domains.local_tree(rows, k, queries.LEAF).nodes.select(F.lit(k).alias("domain"), "node_id", (F.col("hi") - F.col("lo") + 1).alias("n")) for k in range(queries.DOMAINS)]
    nodes = nodes[0].union(nodes[1]).union(nodes[2]).union(nodes[3])
    t, s = (nodes.select(F.col("domain").alias(f"{x}_domain"), F.col("node_id").alias(x), F.col("n").alias(f"n_{x}")) for x in ("target", "source"))
    covered = pairs.join(t, ["target_domain", "target"]).join(s, ["source_domain", "source"]).groupBy("target_domain", "source_domain").agg(F.sum(F.col("n_target") * F.col("n_source")).alias("n"))
    size = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    assert {(r[0], r[1]): r["n"] for r in covered.collect()} == {(a, b): size[a] * size[b] for a in size for b in size if a != b}


def test_halo_of_every_viewer(spark):
    found = keep(queries.ALL["halo_import"](spark, "/root/testdata/sf0.001"))
    assert {r["viewer"] for r in found.select("viewer").distinct().collect()} == set(range(queries.DOMAINS))
    assert found.where("viewer = domain").isEmpty() and found.count() == found.select("viewer", "gid").distinct().count()


def test_registry_options_and_lookups(spark):
    df = frame(spark, cloud("uniform", 100))
    with pytest.raises(ValueError):
        prep.build(df, "kdtree", prep.Options(mode="fixed_depth"))
    with pytest.raises(ValueError):
        prep.build(df.drop("mass"))
    with pytest.raises(ValueError):
        prep.register_tree_builder("radix", prep.build)
    prep.register_tree_builder("mine", lambda p, o: prep.build(p, "radix", o), overwrite=True)
    assert "mine" in prep.available_tree_types()
    made = prep.prepare(df, "mine", prep.Options(leaf_size=8))
    with pytest.raises(ValueError):
        made.tree.neighbours_of(made.walk, 0)
    leaf = made.tree.nodes.where("is_leaf").head()["node_id"]
    assert made.tree.neighbours_of(made.walk, leaf).count() == made.walk.near.where(f"target = {leaf}").count()
    assert layout.csr(made.walk.near).agg(F.sum(F.lit(1))).head()[0] == made.walk.near.count()
    assert geometry.level_major(made.geometry, made.tree.nodes).where("slot = 0").count() == made.tree.nodes.select("level").distinct().count()
    assert prep.KD_RADIUS_SCALE == prep.build(df, "kdtree").rules(walk.Rules(criterion="dehnen")).radius_scale


def test_static_tree_follows_a_stream(spark, tmp_path):
    p = cloud("uniform", 100)
    df = frame(spark, p)
    tree = prep.build(df, options=prep.Options(mode="static_radix", leaf_size=8))
    df.withColumn("x", -F.col("x")).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = follow(stream, tree, lambda t, n: seen.append((n, t.nodes.count(), t.geometry().count()))).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [(0, tree.nodes.count(), tree.nodes.count())]
    with pytest.raises(ValueError):
        prep.refresh(tree, df.limit(50))


def test_streamed_cell_counts_equal_the_batch(spark, tmp_path):
    df = frame(spark, cloud("uniform", 200)).withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    df.write.parquet(str(tmp_path / "in"))
    box = points.infer_bounds(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = cell_counts(stream, box, 1).writeStream.outputMode("complete").format("memory").queryName("cells").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, cell_counts(df, box, 1).collect()))
