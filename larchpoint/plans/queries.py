"""Queries over the tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchpoint.functions import morton
from larchpoint.operators import cells, domains, geometry, knn, layout, moments, octree, radix, trees, walk
from larchpoint.plans import oracle as sql
from larchpoint.plans import prepared as prep
from larchpoint.sources import points
from larchpoint.storage import keep

#: The clouds that queries run on, and the size of leaves.
LEAF, EVENT_LEAF, THETA = 8, 128, 0.6
DEPTH, ADAPTIVE_LEAF, TILE = 3, 16, 8
DOMAINS = 4
#: Sides of a refined cell's points, longest to shortest.
ASPECT = 3.0
#: Sources of a target in a block.
BLOCK = 4

Query = Callable[[SparkSession, str], DataFrame]


class Prepared:
    """A cloud's tree and geometry, made when asked for."""

    def __init__(self, cloud: DataFrame, leaf: int = LEAF):
        self.cloud = keep(cloud)
        self.box = points.infer_bounds(self.cloud)
        self.points = keep(radix.bucket(radix.sort_points(self.cloud, self.box), leaf))

    @cached_property
    def nodes(self) -> DataFrame:
        return keep(radix.hierarchy(radix.leaves(self.points)))

    @cached_property
    def geom(self) -> DataFrame:
        return keep(geometry.geometry(self.points, self.nodes))

    def walk(self, criterion: str = "bh", **more) -> walk.Walk:
        return walk.walk(self.nodes, self.geom, walk.Rules(THETA, criterion, **more))


def emb(s: SparkSession, d: str) -> Prepared:
    return Prepared(points.embeddings(s, d))


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def bounds_rows(s: SparkSession, d: str) -> DataFrame:
    cloud = points.embeddings(s, d)
    a, b = points.infer_bounds(cloud), points.global_bounds(cloud)
    return s.createDataFrame([(*a.low, *a.high, *b.low, *b.high)], ", ".join(f"{k}{n}{i} double" for k in "ig" for i in "01" for n in "xyz"))


def encode(s: SparkSession, d: str) -> DataFrame:
    cloud = points.events(s, d)
    return morton.with_code(cloud, points.infer_bounds(cloud)).select("id", "code")


def decode(s: SparkSession, d: str) -> DataFrame:
    cloud = points.embeddings(s, d)
    box = points.infer_bounds(cloud)
    rows = morton.with_code(cloud, box).select("id", "code")
    return rows.select("id", *(c.alias(a) for a, c in zip("xyz", morton.decode(F.col("code"), box), strict=True)))


def prefixes(s: SparkSession, d: str) -> DataFrame:
    rows = keep(radix.sort_points(points.embeddings(s, d)).select("id", "pos", "code"))
    after = rows.select((F.col("pos") - 1).alias("pos"), F.col("code").alias("next"))
    a, b, five = F.col("code"), F.col("next"), F.lit(5)
    return rows.join(after, "pos").select("id", morton.common_prefix(a, b).cast("long").alias("shared_bits"), morton.common_depth(a, b).cast("long").alias("shared_depth"), morton.prefix(a, five).alias("prefix5"), morton.octant(a, five).cast("long").alias("octant5"), morton.address(a, five).alias("address5"))


def leaf_rows(s: SparkSession, d: str) -> DataFrame:
    return radix.leaves(radix.bucket(radix.sort_points(points.events(s, d)), EVENT_LEAF))


def leaf_geometry(s: SparkSession, d: str) -> DataFrame:
    rows = radix.bucket(radix.sort_points(points.events(s, d)), EVENT_LEAF)
    return geometry.leaf_boxes(rows)


def policy(p: walk.Pair) -> tuple:
    """Tags accepted pairs by which end is larger."""
    near = p.target_leaf & p.source_leaf & p.different & ~p.mac_ok
    return p.select(p.mac_ok, walk.ACCEPT, p.select(near, walk.NEAR, walk.REFINE)), p.select(p.target_extent > p.source_extent, 1, 0)


def m2m(s: SparkSession, d: str) -> DataFrame:
    p = emb(s, d)
    own = keep(moments.multipoles(p.points, p.nodes, 2))
    names = [moments.name(m) for m in moments.all_indices(2)]
    return rounded(moments.from_children(own, p.nodes, 2).select("node_id", *names), names, 5)


def quadrupoles(s: SparkSession, d: str) -> DataFrame:
    p = emb(s, d)
    own = moments.multipoles(p.points, p.nodes, 2)
    q = moments.trace_free(2)
    return rounded(own.select("node_id", *(c.alias(n) for n, c in q.items())), list(q), 5)


def trace_free(s: SparkSession, d: str, order: int) -> DataFrame:
    p = emb(s, d)
    q = moments.trace_free(order)
    return rounded(moments.multipoles(p.points, p.nodes, order).select("node_id", *(c.alias(n) for n, c in q.items())), list(q), 4)


def multipole(s: SparkSession, d: str, order: int) -> DataFrame:
    p = emb(s, d)
    names = [moments.name(m) for m in moments.all_indices(order)]
    return rounded(moments.multipoles(p.points, p.nodes, order).select("node_id", *names), names, 5)


def grown(s: SparkSession, d: str) -> DataFrame:
    p = emb(s, d)
    return rounded(layout.growth(p.walk().near, p.nodes, 10), ["mean_n"])


def classes(s: SparkSession, d: str) -> DataFrame:
    p = emb(s, d)
    return layout.class_table(layout.displacement_classes(p.walk().far, p.nodes, p.geom, p.box))


def octrees(s: SparkSession, d: str) -> tuple[Prepared, DataFrame]:
    p = emb(s, d)
    return p, keep(octree.cells(p.points))


def octree_far(s: SparkSession, d: str) -> DataFrame:
    p, o = octrees(s, d)
    return octree.far_pairs(p.walk().far, octree.radix_to_octree(p.nodes, p.points, o)).select("oct_target", "oct_source")


def octree_walk(s: SparkSession, d: str) -> walk.Walk:
    p, o = octrees(s, d)
    return octree.walk(o, p.box, walk.Rules(THETA))


def placed(s: SparkSession, d: str) -> DataFrame:
    cloud = points.embeddings(s, d)
    return keep(cells.place(cloud, cells.grid_of(cloud, DEPTH)))


def cell_columns(df: DataFrame) -> DataFrame:
    return df.select("cell_id", F.col("level").cast("long").alias("level"), "cell", "n", *(["is_leaf"] if "is_leaf" in df.columns else []))


def tile_pairs(s: SparkSession, d: str) -> DataFrame:
    c = keep(cells.adaptive_cells(placed(s, d), DEPTH, ADAPTIVE_LEAF, True))
    return cells.tile_sources(keep(cells.tiles(c, TILE)), cells.near_list(c))


def split(s: SparkSession, d: str) -> DataFrame:
    cloud = points.embeddings(s, d)
    return keep(domains.decompose(cloud, DOMAINS, points.infer_bounds(cloud), equalize=True))


def frontier(s: SparkSession, d: str) -> DataFrame:
    return rounded(domains.frontier(split(s, d), LEAF), ["mass", "comx", "comy", "comz", "radius"])


def crossed(s: SparkSession, d: str, mutual: bool = False) -> DataFrame:
    """The pairs of the walk of every domain against every other: target_domain, source_domain, target, source, kind."""
    trees_ = domains.forest(split(s, d), LEAF)
    pairs = s.createDataFrame(list(permutations(range(DOMAINS), 2)), "target_tree long, source_tree long")
    found = domains.walk_forests(trees_, trees_, pairs, walk.Rules(THETA, mutual=mutual))
    return found.toDF("target_domain", "source_domain", "target", "source", "kind")


def owned(s: SparkSession, d: str) -> DataFrame:
    """The pairs of crossed and the domain that handles each."""
    return crossed(s, d).withColumn("owner", domains.owners("target_domain", "target", "source_domain", "source"))


def mutual_owned(s: SparkSession, d: str) -> DataFrame:
    """The pairs of the mutual walk that the target's domain handles."""
    return domains.handled(crossed(s, d, mutual=True))


def domain_node_moments(s: SparkSession, d: str) -> DataFrame:
    """Mass and centre of every node of every domain's tree."""
    t = domains.forest(split(s, d), LEAF)
    return rounded(moments.mass_moments(t.points, t.nodes, ["domain"]), ["mass", "comx", "comy", "comz"])


def domain_nodes(s: SparkSession, d: str) -> DataFrame:
    """The nodes of every domain's tree."""
    return domains.forest(split(s, d), LEAF).nodes.select("domain", "node_id", "parent", "left", "right", "is_leaf", "level", "lo", "hi")


def halo(s: SparkSession, d: str) -> DataFrame:
    """The halo of every domain, the viewer."""
    rows = split(s, d)
    return domains.halos(rows, LEAF, points.infer_bounds(rows), walk.Rules(THETA))


def returned(s: SparkSession, d: str) -> DataFrame:
    """What the viewers' imported points owe to their owners: each point pulls its viewer's centre of mass with a force
    that grows with the distance, and its owner gets the opposite."""
    rows = split(s, d)
    top = domains.top_moments(rows).where("domain >= 0").select(F.col("domain").alias("viewer"), F.col("mass").alias("vmass"), *(F.col(f"com{a}").alias(f"v{a}") for a in "xyz"))
    held = halo(s, d).select("viewer", "gid", "id").join(rows.select("id", "x", "y", "z", "mass"), "id").join(top, "viewer")
    forces = held.select("gid", *((F.col("mass") * F.col("vmass") * (F.col(a) - F.col(f"v{a}"))).alias(f"f{a}") for a in "xyz"))
    return rounded(domains.reverse_halo(forces), ["fx", "fy", "fz"], 5)


def coarse_nodes(s: SparkSession, d: str) -> DataFrame:
    """The coarse tree over the leaves of all domains, and the domain that owns all leaves below a node."""
    rows = split(s, d)
    entries, nodes, geom = domains.coarse_tree(domains.frontier(rows, LEAF), points.infer_bounds(rows))
    owner = domains.single_owner(nodes, entries.select("leaf", "domain")).withColumnRenamed("domain", "owner")
    return rounded(node_columns(nodes).join(owner, "node_id").join(geom.select("node_id", "cx", "cy", "cz", "radius"), "node_id"), ["cx", "cy", "cz", "radius"])


def near_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = layout.target_blocks(emb(s, d).walk().near, BLOCK)
    return rows.select("target", "source", F.col("k").cast("long").alias("k"), F.col("count").alias("n"), F.col("first").alias("first_place"), F.col("row").alias("nth_target"), "block")


def far_by_level(s: SparkSession, d: str) -> DataFrame:
    p = emb(s, d)
    return layout.level_major(p.walk().far, p.nodes)


def coefficients(df: DataFrame, values: str, digits: int = 5) -> DataFrame:
    """node_id, slot, value: an array's elements by place."""
    rows = df.select("node_id", F.posexplode(values).alias("slot", "value"))
    return rounded(rows.withColumn("slot", F.col("slot").cast("long")), ["value"], digits)


def packed_moments(s: SparkSession, d: str) -> DataFrame:
    p = emb(s, d)
    return coefficients(moments.packed_multipoles(p.points, p.nodes, 3), "packed")


def dense_moments(s: SparkSession, d: str) -> DataFrame:
    p = emb(s, d)
    return coefficients(moments.packed_multipoles(p.points, p.nodes, 2).withColumn("dense", moments.densify(F.col("packed"), 2)), "dense")


def moment_layout(s: SparkSession, d: str) -> DataFrame:
    """Where the coefficient of each multi-index up to order 4 is kept."""
    rows = [(sum(m), *m, moments.triangular_index(*m), moments.level_offset(sum(m)) + moments.triangular_index(*m), moments.level_size(sum(m)), moments.index_factorial(m)) for m in moments.all_indices(4)]
    return s.createDataFrame(rows, "order_ long, i long, j long, k long, nth long, place long, size long, factorial long")


def heap_nodes(s: SparkSession, d: str) -> DataFrame:
    return trees.heap_kd(points.embeddings(s, d), LEAF)[1].select("node_id", "parent", "is_leaf", "n", "lo", "hi", F.col("split_dim").cast("long").alias("split_dim"), "split_value", "pivot")


def heap_points(s: SparkSession, d: str) -> DataFrame:
    return trees.heap_kd(points.embeddings(s, d), LEAF)[0].select("id", "node", "pos")


def view(s: SparkSession, d: str) -> DataFrame:
    rows = cells.execution_view(placed(s, d), DEPTH)
    return rows.select(*(F.col(c).cast("long").alias(c) for c in rows.columns))


def fixed_cells(s: SparkSession, d: str) -> DataFrame:
    _, leaf, _ = trees.fixed_depth(points.embeddings(s, d), 8)
    return leaf.select("leaf", "code", F.col("depth").cast("long").alias("depth"), "n", "lo", "hi")


def refined_cells(s: SparkSession, d: str) -> DataFrame:
    rows, leaf, _ = trees.fixed_depth(points.embeddings(s, d), LEAF)
    leaf = trees.refined(rows, leaf, 2, ASPECT)[1]
    return leaf.select("leaf", "code", F.col("depth").cast("long").alias("depth"), "n", "lo", "hi")


def kd_nodes(s: SparkSession, d: str) -> DataFrame:
    return trees.leaf_kd(points.embeddings(s, d), LEAF)[1].select("node_id", "parent", "is_leaf", "level", "lo", "hi", F.col("split_dim").cast("long").alias("split_dim"), "split_value")


def kd_walk(s: SparkSession, d: str) -> DataFrame:
    rows, nodes = trees.leaf_kd(points.embeddings(s, d), LEAF)
    nodes = keep(nodes)
    return walk.walk(nodes, geometry.geometry(rows, nodes), walk.Rules(THETA, "dehnen", 1.2)).stats


def static_walk(s: SparkSession, d: str) -> DataFrame:
    p = emb(s, d)
    nodes = keep(trees.static_radix(p.points))
    return walk.walk(nodes, geometry.geometry(p.points, nodes), walk.Rules(THETA)).stats


def events_walk(s: SparkSession, d: str) -> DataFrame:
    return Prepared(points.events(s, d), EVENT_LEAF).walk().stats


def prepared(s: SparkSession, d: str) -> DataFrame:
    return prep.prepare(points.embeddings(s, d)).walk.stats


def fixed_depth_walk(s: SparkSession, d: str) -> DataFrame:
    return prep.prepare(points.embeddings(s, d), "radix", prep.Options(mode="fixed_depth", target_leaf_points=8)).walk.stats


def fixed_depth_boxes(s: SparkSession, d: str) -> DataFrame:
    t = prep.build(points.embeddings(s, d), "radix", prep.Options(mode="fixed_depth", target_leaf_points=8))
    return rounded(geometry.cell_boxes(t.leaves, t.bounds), [f"{a}{k}" for k in "01" for a in "xyz"], 9)


def event_cells(s: SparkSession, d: str) -> DataFrame:
    """The batch form of the streamed counts."""
    from larchpoint.streaming.points import cell_counts

    rows = points.events(s, d)
    box = points.infer_bounds(rows)
    times = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    out = cell_counts(rows.join(times, "id"), box, 2, window="1 day")
    return out.select(F.unix_micros("start").alias("start"), "cell", "n", "mass")


def neighbours(s: SparkSession, d: str, **options) -> DataFrame:
    v = points.vectors(s, d)
    return rounded(knn.nearest(keep(v), None, 8, **options), ["distance"])


def counted(s: SparkSession, d: str, radius, **options) -> DataFrame:
    return knn.count_within(keep(points.vectors(s, d)), radius, **options)


def node_columns(df: DataFrame) -> DataFrame:
    return df.select("node_id", "parent", "left", "right", "is_leaf", "level", "lo", "hi")


ALL: dict[str, Query] = {
    "bounds": bounds_rows,
    "morton_encode": encode,
    "morton_decode": decode,
    "morton_prefix": prefixes,
    "leaf_buckets": leaf_rows,
    "leaf_geometry": leaf_geometry,
    "radix_nodes": lambda s, d: node_columns(emb(s, d).nodes),
    "node_geometry": lambda s, d: emb(s, d).geom,
    "level_major_geometry": lambda s, d: (lambda p: geometry.level_major(p.geom, p.nodes).select("node_id", "level", F.col("slot").cast("int").alias("slot"), "cx", "cy", "cz"))(emb(s, d)),
    "mass_moments": lambda s, d: (lambda p: rounded(moments.mass_moments(p.points, p.nodes), ["mass", "comx", "comy", "comz"]))(emb(s, d)),
    "multipole_o2": partial(multipole, order=2),
    "multipole_o4": partial(multipole, order=4),
    "quadrupole_stf": quadrupoles,
    "octupole_stf": partial(trace_free, order=3),
    "hexadecapole_stf": partial(trace_free, order=4),
    "m2m_check": m2m,
    "walk_far_bh": lambda s, d: emb(s, d).walk().far.select("target", "source"),
    "walk_near_bh": lambda s, d: emb(s, d).walk().near,
    "walk_far_dehnen": lambda s, d: emb(s, d).walk("dehnen").far.select("target", "source"),
    "walk_far_engblom": lambda s, d: emb(s, d).walk("engblom").far.select("target", "source"),
    "walk_policy_tags": lambda s, d: emb(s, d).walk(policy=policy).far,
    "walk_mutual": lambda s, d: emb(s, d).walk(mutual=True).pairs.where(F.col("action") != walk.REFINE).select("a", "b", F.col("action").alias("kind")),
    "walk_stats": lambda s, d: emb(s, d).walk().stats,
    "walk_stats_events": events_walk,
    "grouped_classes": classes,
    "dense_slots": lambda s, d: (lambda p: rounded(layout.dense(p.walk().far, p.nodes, p.geom).withColumn("slot", F.col("slot").cast("int")), ["dx", "dy", "dz"], 12))(emb(s, d)),
    "neighbor_growth_topk": grown,
    "fixed_depth_leaves": fixed_cells,
    "fixed_depth_refined": refined_cells,
    "static_radix_nodes": lambda s, d: node_columns(trees.static_radix(emb(s, d).points)),
    "static_radix_walk": static_walk,
    "leaf_kd": kd_nodes,
    "leaf_kd_walk": kd_walk,
    "octree_nodes": lambda s, d: octrees(s, d)[1].select("code", F.col("depth").cast("long").alias("depth"), "oct_id", "lo", "hi", "is_leaf", "n_children"),
    "octree_boxes": lambda s, d: (lambda po: rounded(octree.boxes(po[1], po[0].box), ["cx", "cy", "cz", "hx", "hy", "hz", "radius", "max_extent"], 9))(octrees(s, d)),
    "radix_to_oct": lambda s, d: (lambda po: octree.radix_to_octree(po[0].nodes, po[0].points, po[1]))(octrees(s, d)),
    "octree_far": octree_far,
    "octree_walk_far": lambda s, d: octree_walk(s, d).far.select("target", "source"),
    "octree_walk_near": lambda s, d: octree_walk(s, d).near,
    "octree_walk_stats": lambda s, d: octree_walk(s, d).stats,
    "octree_parents": lambda s, d: octrees(s, d)[1].select("oct_id", "parent", "octant"),
    "uniform_cells": lambda s, d: cell_columns(cells.uniform_cells(placed(s, d), DEPTH)),
    "uniform_u": lambda s, d: cells.u_list(keep(cells.uniform_cells(placed(s, d), DEPTH)), DEPTH),
    "uniform_v": lambda s, d: cells.v_list(keep(cells.uniform_cells(placed(s, d), DEPTH))),
    "dense_cells": lambda s, d: cell_columns(cells.dense_cells(placed(s, d), DEPTH)),
    "adaptive_cells": lambda s, d: cell_columns(cells.adaptive_cells(placed(s, d), DEPTH, ADAPTIVE_LEAF)),
    "adaptive_balanced": lambda s, d: cell_columns(cells.adaptive_cells(placed(s, d), DEPTH, ADAPTIVE_LEAF, True)),
    "adaptive_near": lambda s, d: cells.near_list(cells.adaptive_cells(placed(s, d), DEPTH, ADAPTIVE_LEAF, True)),
    "adaptive_v": lambda s, d: cells.v_list(keep(cells.adaptive_cells(placed(s, d), DEPTH, ADAPTIVE_LEAF, True))),
    "nearfield_tiles": lambda s, d: cells.tiles(cells.adaptive_cells(placed(s, d), DEPTH, ADAPTIVE_LEAF, True), TILE),
    "nearfield_tile_sources": tile_pairs,
    "knn": neighbours,
    "knn_exclude_self": partial(neighbours, exclude_self=True),
    "radius_count": partial(counted, radius=1.0),
    "radius_count_multi": partial(counted, radius=[0.5, 1.25], include_self=False),
    "sfc_domains": lambda s, d: rounded(domains.report(split(s, d)), ["mass"]),
    "equalize": lambda s, d: split(s, d).select("id", "domain", "local"),
    "domain_moments": lambda s, d: rounded(domains.top_moments(split(s, d)), ["mass", "comx", "comy", "comz"]),
    "coarse_frontier": frontier,
    "cross_walk": crossed,
    "cross_mutual_owned": mutual_owned,
    "domain_nodes": domain_nodes,
    "domain_node_moments": domain_node_moments,
    "halo_import": halo,
    "cross_owner": owned,
    "reverse_halo": returned,
    "coarse_nodes": coarse_nodes,
    "near_blocks": near_blocks,
    "far_by_level": far_by_level,
    "moments_packed": packed_moments,
    "moments_dense": dense_moments,
    "moment_layout": moment_layout,
    "heap_kd": heap_nodes,
    "heap_kd_points": heap_points,
    "uniform_view": view,
    "prepared": prepared,
    "fixed_depth_walk": fixed_depth_walk,
    "fixed_depth_boxes": fixed_depth_boxes,
    "event_cells": event_cells,
}

_NODES = "SELECT node_id, parent, lft AS \"left\", rgt AS \"right\", is_leaf, level, lo, hi FROM nd"
_TREE = sql.tree("emb", LEAF)
_R6 = lambda *c: ", ".join(f"round({x}, 6) + 0 AS {x}" for x in c)
_CELLS = sql.placed("emb", DEPTH) + sql.levels(DEPTH)
_ADAPTIVE = _CELLS + sql.adaptive(DEPTH, ADAPTIVE_LEAF, True)
_VECTORS = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings), dd AS (SELECT a.id AS query_id, b.id, list_sum(list_transform(list_zip(a.p, b.p), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d2 FROM v a, v b)"
_BOUNDS = ", ".join([f"min({a}) - greatest(0.05::DOUBLE * (max({a}) - min({a})), 1e-6::DOUBLE) AS i{a}0, max({a}) + greatest(0.05::DOUBLE * (max({a}) - min({a})), 1e-6::DOUBLE) AS i{a}1, min({a}) - 1e-6::DOUBLE * (CASE WHEN max({a}) = min({a}) THEN 1 ELSE max({a}) - min({a}) END) AS g{a}0, max({a}) + 1e-6::DOUBLE * (CASE WHEN max({a}) = min({a}) THEN 1 ELSE max({a}) - min({a}) END) AS g{a}1" for a in "xyz"])
_DOMAINS = sql.decomposed("emb", DOMAINS)
_LOCAL = ", ".join(
    f"bk{k} AS (SELECT *, local // {LEAF} AS leaf FROM dm WHERE domain = {k}), lv{k} AS (SELECT leaf, min(code) AS code, min(local) AS lo, max(local) AS hi FROM bk{k} GROUP BY leaf)" for k in (0, 1)
)


def _renamed(text: str, k: int) -> str:
    """The CTEs of a tree with names of their own."""
    import re

    return re.sub(r"\b(nl|dl|it0|rg|rg2|rg3|nd|gm|bk)\b", rf"\g<1>{k}", text).replace("pos BETWEEN", "local BETWEEN").replace(f"bk{k}.pos", f"bk{k}.local")


def _walk(kind: str, select: str) -> str:
    return sql.recursive(_TREE + sql.walk(kind, THETA), select)


def _pairs(kind: str = "bh") -> tuple[str, str]:
    """(CTEs of the walk of nd0 against nd1, whether its pairs t, s are far)."""
    ext, ok = sql.criterion(kind, THETA)
    ok = f"(({sql.D2}) > 0 AND {ok.replace('d2', f'({sql.D2})')})"
    leaf = "(t.lft < 0 AND s.lft < 0)"
    sides = ", ".join(f"wn{k} AS (SELECT nd{k}.node_id, lft, rgt, {ext} AS ext, cx, cy, cz FROM nd{k} JOIN gm{k} USING (node_id))" for k in (0, 1))
    pairs = f"""w AS (SELECT CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b UNION ALL SELECT k.p, k.q FROM (
      SELECT unnest(CASE WHEN t.lft >= 0 AND (s.lft < 0 OR t.ext >= s.ext) THEN [{{'p': t.lft, 'q': s.node_id}}, {{'p': t.rgt, 'q': s.node_id}}] ELSE [{{'p': t.node_id, 'q': s.lft}}, {{'p': t.node_id, 'q': s.rgt}}] END) AS k
      FROM w JOIN wn0 t ON t.node_id = w.a JOIN wn1 s ON s.node_id = w.b WHERE NOT {ok} AND NOT {leaf}))"""
    return f"{sides}, {pairs}", ok


def _cross(kind: str = "bh") -> str:
    pairs, ok = _pairs(kind)
    leaf = "(t.lft < 0 AND s.lft < 0)"
    trees_ = ", ".join(_renamed(sql.hierarchy(f"lv{k}") + "," + sql.GEOM, k) for k in (0, 1))
    return sql.recursive(f"{_DOMAINS}, {_LOCAL}, {trees_}, {pairs}", f"SELECT w.a AS target, w.b AS source, CAST(CASE WHEN {ok} THEN 0 ELSE 1 END AS BIGINT) AS kind FROM w JOIN wn0 t ON t.node_id = w.a JOIN wn1 s ON s.node_id = w.b WHERE {ok} OR {leaf}")


def _cross_all(kind: str = "bh") -> str:
    """_cross() for every ordered pair of domains."""
    import re

    one = lambda a, b: re.sub(r"\bWHERE domain = ([01])\b", lambda m: f"WHERE domain = {(a, b)[int(m[1])]}", _cross(kind))
    return " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS target_domain, CAST({b} AS BIGINT) AS source_domain, * FROM ({one(a, b)})" for a, b in permutations(range(DOMAINS), 2))


def _coarse(where: str = "") -> str:
    """CTEs ce (the domains' leaves in order along the curve), and its tree as nd1, with balls as gm1."""
    balls = sql.GEOM.replace("min(x)", "min(x - r)").replace("max(x)", "max(x + r)").replace("min(y)", "min(y - r)").replace("max(y)", "max(y + r)").replace("min(z)", "min(z - r)").replace("max(z)", "max(z + r)")
    return f"""ft AS (SELECT domain, local // {LEAF} AS own, sum(mass * x) / sum(mass) AS x, sum(mass * y) / sum(mass) AS y, sum(mass * z) / sum(mass) AS z FROM dm GROUP BY ALL),
fu AS (SELECT *, sqrt((SELECT max((p.x - ft.x) * (p.x - ft.x) + (p.y - ft.y) * (p.y - ft.y) + (p.z - ft.z) * (p.z - ft.z)) FROM dm p WHERE p.domain = ft.domain AND p.local // {LEAF} = ft.own)) AS r FROM ft{where}),
fb AS (SELECT * FROM fu, box), {sql.interleave('fb', 'fc', *map(sql.grid, 'xyz'))},
bk1 AS (SELECT *, row_number() OVER (ORDER BY code, domain, own) - 1 AS local FROM fc),
lv1 AS (SELECT local AS leaf, code, local AS lo, local AS hi FROM bk1), {_renamed(sql.hierarchy('lv1') + ',' + balls, 1)}"""


def _halo(select: str) -> str:
    """Over hl(viewer, domain, local, id, x, y, z, mass): the points that each viewer imports."""
    pairs, ok = _pairs()
    own = f"{_LOCAL.split(', bk1')[0]}, {_renamed(sql.hierarchy('lv0') + ',' + sql.GEOM, 0)}"
    near = f"SELECT DISTINCT b.domain, b.own FROM w JOIN wn0 t ON t.node_id = w.a JOIN wn1 s ON s.node_id = w.b JOIN nd1 n ON n.node_id = w.b JOIN bk1 b ON b.local = n.lo WHERE NOT {ok} AND t.lft < 0 AND s.lft < 0"
    one = lambda k: sql.recursive(f"{_DOMAINS}, {own}, {_coarse(' WHERE ft.domain <> 0')}, {pairs}", f"SELECT CAST({k} AS BIGINT) AS viewer, dm.* FROM dm JOIN ({near}) f ON f.domain = dm.domain AND f.own = dm.local // {LEAF}").replace("domain = 0", f"domain = {k}").replace("domain <> 0", f"domain <> {k}")
    return f"WITH hl AS ({' UNION ALL '.join(f'SELECT * FROM ({one(k)})' for k in range(DOMAINS))}), {_DOMAINS} {select}"


def _kd(rounds: int = 12) -> str:
    """CTEs of the leaf k-d tree for up to {rounds} levels: kb (points with bucket), bk, nd and ks (splits)."""
    out = f"""{sql.CLOUDS['emb']}, kc AS (SELECT count(*) AS total FROM pts),
dp AS (SELECT CAST(CASE WHEN total <= {LEAF} THEN 0 ELSE least(length(bin((total + {LEAF - 1}) // {LEAF} - 1)), length(bin(total)) - 1) END AS BIGINT) AS d, total FROM kc),
k0 AS (SELECT id, x, y, z, mass, CAST(0 AS BIGINT) AS bucket FROM pts)"""
    for i in range(rounds):
        out += f""",
d{i} AS (SELECT bucket, count(*) AS n, CAST({_WIDEST} AS BIGINT) AS dim FROM k{i} GROUP BY bucket),
r{i} AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY coord, id) - 1 AS w FROM (SELECT k.*, n, dim, CASE dim WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS coord FROM k{i} k JOIN d{i} USING (bucket), dp WHERE dp.d > {i})),
k{i + 1} AS (SELECT id, x, y, z, mass, bucket * 2 + CAST(w >= (n + 1) // 2 AS BIGINT) AS bucket FROM r{i} UNION ALL SELECT k.* FROM k{i} k, dp WHERE dp.d <= {i})"""
    splits = " UNION ALL ".join(f"SELECT bucket + {2**i - 1} AS node_id, dim AS split_dim, max(coord) FILTER (w = (n + 1) // 2) AS split_value FROM r{i} GROUP BY bucket, dim" for i in range(rounds))
    return out + f""",
bk AS (SELECT *, row_number() OVER (ORDER BY bucket, id) - 1 AS pos FROM k{rounds}),
en AS (SELECT bucket AS leaf, min(pos) AS lo, max(pos) AS hi FROM bk GROUP BY bucket),
hp AS (SELECT node_id, length(bin(node_id + 1)) - 1 AS level, CAST(1 AS BIGINT) << d AS leaves, CAST(1 AS BIGINT) << (d - length(bin(node_id + 1)) + 1) AS below FROM (SELECT unnest(range(2 * (CAST(1 AS BIGINT) << d) - 1)) AS node_id, d FROM dp)),
nd AS (SELECT h.node_id, CASE WHEN h.node_id = 0 THEN -1 ELSE (h.node_id - 1) // 2 END AS parent, h.node_id >= leaves - 1 AS is_leaf, CAST(level AS BIGINT) AS level, CASE WHEN h.node_id < leaves - 1 THEN 2 * h.node_id + 1 ELSE -1 END AS lft, CASE WHEN h.node_id < leaves - 1 THEN 2 * h.node_id + 2 ELSE -1 END AS rgt, a.lo, b.hi
  FROM hp h JOIN en a ON a.leaf = (h.node_id + 1) * below - leaves JOIN en b ON b.leaf = (h.node_id + 2) * below - leaves - 1),
ks AS ({splits})"""


def _heap(rounds: int = 14) -> str:
    """CTEs of the heap k-d tree for up to {rounds} levels: hn (nodes) and hq (points)."""
    out = f"{sql.CLOUDS['emb']}, h0 AS (SELECT id, x, y, z, CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS start FROM pts)"
    for i in range(rounds):
        half = "(CAST(1 AS BIGINT) << (length(bin(n)) - 2))"
        out += f""",
d{i} AS (SELECT node, count(*) AS n, CASE WHEN count(*) <= {LEAF} THEN -1 ELSE CAST({_WIDEST} AS BIGINT) END AS dim FROM h{i} GROUP BY node),
r{i} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY coord, id) - 1 AS w, CASE WHEN dim >= 0 THEN {half} - 1 + least(n - 2 * {half} + 1, {half}) END AS cut FROM (SELECT h.*, n, dim, CASE dim WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN z END AS coord FROM h{i} h JOIN d{i} USING (node))),
h{i + 1} AS (SELECT id, x, y, z, CASE WHEN w < cut THEN 2 * node + 1 ELSE 2 * node + 2 END AS node, CASE WHEN w < cut THEN start ELSE start + cut + 1 END AS start FROM r{i} WHERE dim >= 0 AND w <> cut)"""
    every = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(rounds))
    return out + f""", hr AS ({every}),
hq AS (SELECT id, node, start + w AS pos FROM hr WHERE dim < 0 OR w = cut),
hn AS (SELECT node AS node_id, CASE WHEN node = 0 THEN -1 ELSE (node - 1) // 2 END AS parent, dim < 0 AS is_leaf, n, start AS lo, start + n - 1 AS hi, dim AS split_dim, CASE WHEN dim >= 0 THEN coord END AS split_value, CASE WHEN dim >= 0 THEN id ELSE -1 END AS pivot
  FROM hr WHERE CASE WHEN dim < 0 THEN w = 0 ELSE w = cut END)"""


_WIDEST = "CASE WHEN max(x) - min(x) >= max(y) - min(y) AND max(x) - min(x) >= max(z) - min(z) THEN 0 WHEN max(y) - min(y) >= max(z) - min(z) THEN 1 ELSE 2 END"


def _octree_walk(select: str) -> str:
    return sql.recursive(f"{sql.bucketed('emb', LEAF)}, {sql.OCTREE}, {_OCT_PARENTS}, {_OCT_BOXES}{sql.cell_walk('bh', THETA)}", select)


def _each_domain(select: str) -> str:
    """The rows of every domain's tree (nd0 over bk0)."""
    one = lambda k: f"WITH {_DOMAINS}, {_LOCAL.split(', bk1')[0]}, {_renamed(sql.hierarchy('lv0'), 0)} {select}".replace("WHERE domain = 0", f"WHERE domain = {k}")
    return " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS domain, * FROM ({one(k)})" for k in range(DOMAINS))


_OCT_PARENTS = "op AS (SELECT a.oct_id, max_by(b.oct_id, b.d) AS parent, max(b.d) AS pd FROM o a JOIN o b ON b.d < a.d AND (a.code >> (63 - 3 * b.d)) << (63 - 3 * b.d) = b.code GROUP BY a.oct_id)"
_OCT_BOXES = f"""oc AS (SELECT oct_id, pow(2.0::DOUBLE, d) AS k, code >> (63 - 3 * d) AS cell FROM o), {sql.deinterleave('oc', 'oj', 'cell')},
ob AS (SELECT oct_id, {', '.join(f"{a}0 + (j{a} + 0.5::DOUBLE) * (({a}1 - {a}0) / k) AS c{a}, 0.5::DOUBLE * ({a}1 - {a}0) / k AS h{a}" for a in 'xyz')} FROM oj, box)"""
_DEC = sql.deinterleave("cd", "dj")
_F32 = lambda a: f"{a}0 + CAST(CAST(j{a} AS FLOAT) / CAST({morton.TOP} AS FLOAT) AS DOUBLE) * ({a}1 - {a}0) AS {a}"
_SHARED = "CASE WHEN code = nxt THEN 64 ELSE 64 - length(bin(xor(code, nxt))) END"
_STATS = "SELECT CAST(count(*) FILTER (ok) AS BIGINT) AS accepted, CAST(count(*) FILTER (NOT ok AND NOT refined) AS BIGINT) AS near, CAST(count(*) FILTER (refined) AS BIGINT) AS refined, CAST(max(round) + 1 AS BIGINT) AS rounds FROM pr"

_STATIC = f"""{sql.bucketed('emb', LEAF)}, k AS (SELECT count(*) AS n FROM lv),
b(node_id, parent, a, e, level) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), n, CAST(0 AS BIGINT) FROM k
  UNION ALL SELECT CASE WHEN x.e - x.a = 1 THEN n - 1 + x.a WHEN x.lower THEN node_id + 1 ELSE node_id + (b.a + b.e) // 2 - b.a END, node_id, x.a, x.e, level + 1
  FROM (SELECT *, unnest([{{'a': a, 'e': (a + e) // 2, 'lower': true}}, {{'a': (a + e) // 2, 'e': e, 'lower': false}}]) AS x FROM b, k WHERE e - a > 1) b),
nd AS (SELECT b.node_id, b.parent, coalesce(min(c.node_id) FILTER (c.a = b.a), -1) AS lft, coalesce(min(c.node_id) FILTER (c.e = b.e), -1) AS rgt, b.e - b.a = 1 AS is_leaf, b.level, u.lo, v.hi
FROM b LEFT JOIN b c ON c.parent = b.node_id JOIN lv u ON u.leaf = b.a JOIN lv v ON v.leaf = b.e - 1 GROUP BY ALL)"""
_FIXED = f"""{sql.coded('emb')}, np AS (SELECT CAST(ceil(count(*) / 8.0) AS BIGINT) AS need FROM cd), dp AS (SELECT min(d) AS d FROM range(22) r(d), np WHERE pow(8, d) >= need)"""

def _refined() -> str:
    """Leaves of the fixed depth, cut where they are long, in two rounds."""
    out = f"""WITH {_FIXED}, c0 AS (SELECT *, row_number() OVER (ORDER BY code, id) - 1 AS pos, (code >> (63 - 3 * d)) << (63 - 3 * d) AS cell, CAST(d AS BIGINT) AS depth FROM cd, dp)"""
    for k in range(2):
        octant = "(code >> (60 - 3 * depth)) & 7"
        side = lambda a: f"max({a}) - min({a})"
        sides = ", ".join(map(side, "xyz"))
        out += f""", s{k} AS (SELECT cell, depth, greatest({sides}) / greatest(least({sides}), 1e-12::DOUBLE) > {ASPECT} AND min({octant}) < max({octant}){' AND count(*) > 2' if k else ''} AS cut FROM c{k} GROUP BY cell, depth),
c{k + 1} AS (SELECT * EXCLUDE (cell, depth, cut), CASE WHEN cut THEN (code >> (60 - 3 * depth)) << (60 - 3 * depth) ELSE cell END AS cell, depth + CAST(cut AS BIGINT) AS depth FROM c{k} JOIN s{k} USING (cell, depth))"""
    out += """, h AS (SELECT cell AS code, depth, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM c2 GROUP BY cell, depth),
z AS (SELECT r.cell << CAST(63 - 3 * d AS BIGINT) AS code, CAST(d AS BIGINT) AS depth FROM (SELECT unnest(range(CAST(pow(8, d) AS BIGINT))) AS cell, d FROM dp) r WHERE NOT EXISTS (SELECT 1 FROM cd WHERE code >> CAST(63 - 3 * d AS BIGINT) = r.cell)),
u AS (SELECT * FROM h UNION ALL SELECT z.code, z.depth, 0, (SELECT count(*) FROM cd WHERE cd.code < z.code), (SELECT count(*) FROM cd WHERE cd.code < z.code) - 1 FROM z)
SELECT row_number() OVER (ORDER BY lo, code) - 1 AS leaf, code, depth, n, lo, hi FROM u"""
    return out


SQL: dict[str, str] = {
    "bounds": f"WITH {sql.EMB} SELECT {_BOUNDS} FROM pts",
    "morton_encode": f"WITH {sql.coded('events')} SELECT id, code FROM cd",
    "morton_decode": f"WITH {sql.coded('emb')}, {_DEC} SELECT id, {_F32('x')}, {_F32('y')}, {_F32('z')} FROM dj",
    "morton_prefix": f"""WITH {sql.coded('emb')}, o AS (SELECT id, code, lead(code) OVER (ORDER BY code, id) AS nxt FROM cd)
SELECT id, {_SHARED} AS shared_bits, CASE WHEN code = nxt THEN 21 ELSE ({_SHARED} - 1) // 3 END AS shared_depth, (code >> 48) << 48 AS prefix5, (code >> 48) & 7 AS octant5, 4681 + (code >> 48) AS address5 FROM o WHERE nxt IS NOT NULL""",
    "leaf_buckets": f"WITH {sql.bucketed('events', EVENT_LEAF)} SELECT leaf, code, lo, hi FROM lv",
    "leaf_geometry": f"WITH {sql.bucketed('events', EVENT_LEAF)} SELECT leaf, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM bk GROUP BY leaf",
    "radix_nodes": f"WITH {_TREE} {_NODES}",
    "node_geometry": f"WITH {_TREE} SELECT node_id, cx, cy, cz, hx, hy, hz, radius, max_extent FROM gm",
    "level_major_geometry": f"WITH {_TREE} SELECT node_id, level, CAST(row_number() OVER (PARTITION BY level ORDER BY node_id) - 1 AS INTEGER) AS slot, cx, cy, cz FROM gm JOIN nd USING (node_id)",
    "mass_moments": f"WITH {_TREE}, mm AS (SELECT node_id, sum(mass) AS mass, sum(mass * x) / sum(mass) AS comx, sum(mass * y) / sum(mass) AS comy, sum(mass * z) / sum(mass) AS comz FROM nd JOIN bk ON bk.pos BETWEEN nd.lo AND nd.hi GROUP BY node_id) SELECT node_id, {_R6('mass', 'comx', 'comy', 'comz')} FROM mm",
    "multipole_o2": f"WITH {_TREE} {sql.central(2)}",
    "multipole_o4": f"WITH {_TREE} {sql.central(4)}",
    "octupole_stf": f"WITH {_TREE}, cn AS ({sql.central(3, 15)}) SELECT node_id, {sql.stf(3)} FROM cn",
    "hexadecapole_stf": f"WITH {_TREE}, cn AS ({sql.central(4, 15)}) SELECT node_id, {sql.stf(4)} FROM cn",
    "m2m_check": f"WITH {_TREE} SELECT c.* FROM ({sql.central(2)}) c JOIN nd USING (node_id) WHERE NOT is_leaf",
    "walk_far_bh": _walk("bh", sql.FAR),
    "walk_near_bh": _walk("bh", sql.NEAR),
    "walk_far_dehnen": _walk("dehnen", sql.FAR),
    "walk_far_engblom": _walk("engblom", sql.FAR),
    "walk_policy_tags": _walk("bh", "SELECT a AS target, b AS source, CAST(text > sext AS BIGINT) AS tag FROM pr WHERE ok UNION ALL SELECT b, a, CAST(sext > text AS BIGINT) FROM pr WHERE ok"),
    "walk_mutual": _walk("mutual", "SELECT a, b, CAST(CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS kind FROM pr WHERE NOT refined"),
    "walk_stats": _walk("bh", _STATS),
    "walk_stats_events": sql.recursive(sql.tree("events", EVENT_LEAF) + sql.walk("bh", THETA), _STATS),
    "grouped_classes": _walk("bh", f"""SELECT *, row_number() OVER (ORDER BY target_level, source_level, ix, iy, iz) - 1 AS class_id FROM (SELECT target_level, source_level, ix, iy, iz, count(*) AS n_pairs FROM (
      SELECT t.level AS target_level, s.level AS source_level, {', '.join(f"CAST(round_even((g.c{a} - h.c{a}) / greatest(({a}1 - {a}0) / pow(2.0::DOUBLE, t.level), 1e-12::DOUBLE), 0) AS BIGINT) AS i{a}" for a in 'xyz')}
      FROM ({sql.FAR}) f JOIN nd t ON t.node_id = f.target JOIN nd s ON s.node_id = f.source JOIN gm g ON g.node_id = f.target JOIN gm h ON h.node_id = f.source, box) GROUP BY ALL)"""),
    "dense_slots": _walk("bh", f"""SELECT f.target, f.source, s.level, s.slot, CAST(row_number() OVER (PARTITION BY f.target ORDER BY f.source) - 1 AS INTEGER) AS k, {', '.join(f'round(g.c{a} - h.c{a}, 12) + 0 AS d{a}' for a in 'xyz')}
      FROM ({sql.FAR}) f JOIN (SELECT node_id, level, CAST(row_number() OVER (PARTITION BY level ORDER BY node_id) - 1 AS INTEGER) AS slot FROM nd) s ON s.node_id = f.target JOIN gm g ON g.node_id = f.target JOIN gm h ON h.node_id = f.source"""),
    "neighbor_growth_topk": _walk("bh", f"""SELECT node_id AS target, n, (SELECT max(n) FROM q) AS max_n, (SELECT round(avg(n), 6) FROM q) AS mean_n, (SELECT n FROM q ORDER BY n LIMIT 1 OFFSET (SELECT count(*) // 2 FROM q)) AS median_n FROM q ORDER BY n DESC, node_id LIMIT 10""").replace("\nSELECT node_id AS target", f", q AS (SELECT node_id, count(f.source) AS n FROM nd LEFT JOIN ({sql.NEAR}) f ON f.target = nd.node_id WHERE is_leaf GROUP BY node_id)\nSELECT node_id AS target"),
    "static_radix_nodes": f"WITH RECURSIVE {_STATIC} {_NODES}",
    "static_radix_walk": sql.recursive(f"{_STATIC}, {sql.GEOM}{sql.walk('bh', THETA)}", _STATS),
    "fixed_depth_leaves": f"""WITH {sql.coded('emb')}, np AS (SELECT CAST(ceil(count(*) / 8.0) AS BIGINT) AS need FROM cd), dp AS (SELECT min(d) AS d FROM range(22) r(d), np WHERE pow(8, d) >= need),
h AS (SELECT code >> CAST(63 - 3 * d AS BIGINT) AS leaf, count(*) AS n FROM cd, dp GROUP BY 1),
c AS (SELECT r.leaf, coalesce(n, 0) AS n FROM (SELECT unnest(range(CAST(pow(8, d) AS BIGINT))) AS leaf FROM dp) r LEFT JOIN h USING (leaf))
SELECT leaf, leaf << CAST(63 - 3 * d AS BIGINT) AS code, CAST(d AS BIGINT) AS depth, n, CAST(sum(n) OVER w - n AS BIGINT) AS lo, CAST(sum(n) OVER w - 1 AS BIGINT) AS hi FROM c, dp WINDOW w AS (ORDER BY leaf)""",
    "octree_nodes": f"""WITH {sql.bucketed('emb', LEAF)}, {sql.OCTREE},
p AS (SELECT a.oct_id, max_by(b.oct_id, b.d) AS parent FROM o a JOIN o b ON b.d < a.d AND (a.code >> (63 - 3 * b.d)) << (63 - 3 * b.d) = b.code GROUP BY a.oct_id)
SELECT code, CAST(d AS BIGINT) AS depth, oct_id, (SELECT min(pos) FROM bk WHERE bk.code >> (63 - 3 * d) = o.code >> (63 - 3 * d)) AS lo, (SELECT max(pos) FROM bk WHERE bk.code >> (63 - 3 * d) = o.code >> (63 - 3 * d)) AS hi,
  NOT EXISTS (SELECT 1 FROM p WHERE p.parent = o.oct_id) AS is_leaf, (SELECT count(*) FROM p WHERE p.parent = o.oct_id) AS n_children FROM o""",
    "uniform_cells": f"WITH {_CELLS}{sql.NUMBERED} SELECT cell_id, level, cell, n FROM nc",
    "uniform_u": f"WITH {_CELLS}{sql.NUMBERED} SELECT a.cell_id AS target, b.cell_id AS source FROM nc a JOIN nc b ON a.level = {DEPTH} AND b.level = {DEPTH} AND {sql.TOUCH}",
    "uniform_v": f"WITH {_CELLS}{sql.NUMBERED} SELECT a.cell_id AS target, b.cell_id AS source FROM nc a JOIN nc b ON a.level = b.level AND a.level > 0 AND NOT ({sql.TOUCH}) AND abs((a.jx >> 1) - (b.jx >> 1)) <= 1 AND abs((a.jy >> 1) - (b.jy >> 1)) <= 1 AND abs((a.jz >> 1) - (b.jz >> 1)) <= 1",
    "dense_cells": f"WITH {_CELLS}, every AS (SELECT l AS level, unnest(range(CAST(pow(8, l) AS BIGINT))) AS cell FROM range({DEPTH + 1}) r(l)) SELECT row_number() OVER (ORDER BY level, cell) - 1 AS cell_id, level, cell, coalesce(n, 0) AS n FROM every LEFT JOIN lc USING (level, cell)",
    "adaptive_cells": f"WITH {_CELLS}{sql.adaptive(DEPTH, ADAPTIVE_LEAF, False)} SELECT cell_id, level, cell, n, is_leaf FROM ad",
    "adaptive_balanced": f"WITH {_ADAPTIVE} SELECT cell_id, level, cell, n, is_leaf FROM ad",
    "adaptive_near": f"WITH {_ADAPTIVE} {sql.ADAPTIVE_NEAR}",
    "adaptive_v": f"WITH {_ADAPTIVE} SELECT a.cell_id AS target, b.cell_id AS source FROM ad a JOIN ad b ON a.level = b.level AND a.level > 0 AND NOT ({sql.TOUCH}) AND abs((a.jx >> 1) - (b.jx >> 1)) <= 1 AND abs((a.jy >> 1) - (b.jy >> 1)) <= 1 AND abs((a.jz >> 1) - (b.jz >> 1)) <= 1",
    "nearfield_tiles": f"WITH {_ADAPTIVE} SELECT cell_id, nth, least({TILE}, n - nth * {TILE}) AS n, row_number() OVER (ORDER BY cell_id, nth) - 1 AS tile_id FROM (SELECT cell_id, n, unnest(range((n + {TILE - 1}) // {TILE})) AS nth FROM ad WHERE is_leaf AND n > 0)",
    "nearfield_tile_sources": f"WITH {_ADAPTIVE}, tl AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id, nth) - 1 AS tile_id FROM (SELECT cell_id, unnest(range((n + {TILE - 1}) // {TILE})) AS nth FROM ad WHERE is_leaf AND n > 0)), nr AS ({sql.ADAPTIVE_NEAR} UNION ALL SELECT cell_id, cell_id FROM ad WHERE is_leaf) SELECT t.tile_id AS target_tile, s.tile_id AS source_tile FROM nr JOIN tl t ON t.cell_id = nr.target JOIN tl s ON s.cell_id = nr.source WHERE t.tile_id <> s.tile_id",
    "knn": f"{_VECTORS} SELECT query_id, rank, id, round(sqrt(d2), 6) AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS INTEGER) AS rank FROM dd) WHERE rank <= 8",
    "knn_exclude_self": f"{_VECTORS} SELECT query_id, rank, id, round(sqrt(d2), 6) AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS INTEGER) AS rank FROM dd WHERE query_id <> id) WHERE rank <= 8",
    "radius_count": f"{_VECTORS} SELECT query_id, 1.0::DOUBLE AS radius, count(*) FILTER (d2 <= 1.0) AS n FROM dd GROUP BY query_id",
    "radius_count_multi": f"{_VECTORS} SELECT query_id, CAST(radius AS DOUBLE) AS radius, count(*) FILTER (d2 <= radius * radius AND query_id <> id) AS n FROM dd, (VALUES (0.5), (1.25)) r(radius) GROUP BY query_id, radius",
    "sfc_domains": f"WITH {_DOMAINS} SELECT domain, count(*) AS n, min(code) AS lo_code, max(code) AS hi_code, round(sum(mass), 6) AS mass FROM dm GROUP BY domain",
    "equalize": f"WITH {_DOMAINS} SELECT id, domain, local FROM dm",
    "domain_moments": f"WITH {_DOMAINS}, g AS (SELECT domain, mass, x, y, z FROM dm UNION ALL SELECT -1, mass, x, y, z FROM dm), h AS (SELECT domain, sum(mass) AS mass, sum(mass * x) / sum(mass) AS comx, sum(mass * y) / sum(mass) AS comy, sum(mass * z) / sum(mass) AS comz FROM g GROUP BY domain) SELECT domain, {_R6('mass', 'comx', 'comy', 'comz')} FROM h",
    "coarse_frontier": f"WITH {_DOMAINS}, g AS (SELECT *, local // {LEAF} AS leaf FROM dm), h AS (SELECT domain, leaf, count(*) AS n, min(local) AS lo, max(local) AS hi, sum(mass) AS mass, sum(mass * x) / sum(mass) AS comx, sum(mass * y) / sum(mass) AS comy, sum(mass * z) / sum(mass) AS comz FROM g GROUP BY domain, leaf), i AS (SELECT h.*, sqrt((SELECT max((x - comx) * (x - comx) + (y - comy) * (y - comy) + (z - comz) * (z - comz)) FROM g WHERE g.domain = h.domain AND g.leaf = h.leaf)) AS radius FROM h) SELECT domain, leaf, n, lo, hi, {_R6('mass', 'comx', 'comy', 'comz', 'radius')} FROM i",
    "cross_walk": _cross_all(),
    "cross_mutual_owned": f"SELECT * FROM ({_cross_all('mutual')}) WHERE target_domain = CASE WHEN (target + source) % 2 = 0 THEN least(target_domain, source_domain) ELSE greatest(target_domain, source_domain) END",
    "domain_nodes": _each_domain('SELECT node_id, parent, lft AS "left", rgt AS "right", is_leaf, level, lo, hi FROM nd0'),
    "domain_node_moments": _each_domain(f"SELECT node_id, {_R6('mass', 'comx', 'comy', 'comz')} FROM (SELECT node_id, sum(mass) AS mass, sum(mass * x) / sum(mass) AS comx, sum(mass * y) / sum(mass) AS comy, sum(mass * z) / sum(mass) AS comz FROM nd0 JOIN bk0 ON bk0.local BETWEEN nd0.lo AND nd0.hi GROUP BY node_id)"),
    "cross_owner": f"SELECT *, CASE WHEN (target + source) % 2 = 0 THEN least(target_domain, source_domain) ELSE greatest(target_domain, source_domain) END AS owner FROM ({_cross_all()})",
    "quadrupole_stf": f"WITH {_TREE}, cn AS ({sql.central(2, 15)}) SELECT node_id, " + ", ".join(f"round(3 * {m}{' - (m200 + m020 + m002)' if i == j else ''}, 5) + 0 AS q{i}{j}" for i, j, m in ((0, 0, "m200"), (0, 1, "m110"), (0, 2, "m101"), (1, 1, "m020"), (1, 2, "m011"), (2, 2, "m002"))) + " FROM cn",
    "octree_boxes": f"""WITH {sql.bucketed('emb', LEAF)}, {sql.OCTREE}, oc AS (SELECT oct_id, pow(2.0::DOUBLE, d) AS k, code >> (63 - 3 * d) AS cell FROM o), {sql.deinterleave('oc', 'oj', 'cell')},
ob AS (SELECT oct_id, {', '.join(f"{a}0 + (j{a} + 0.5::DOUBLE) * (({a}1 - {a}0) / k) AS c{a}, 0.5::DOUBLE * ({a}1 - {a}0) / k AS h{a}" for a in 'xyz')} FROM oj, box)
SELECT oct_id, {', '.join(f"round({c}, 9) + 0 AS {n}" for c, n in [*((f"{k}{a}", f"{k}{a}") for k in 'ch' for a in 'xyz'), ('sqrt(hx * hx + hy * hy + hz * hz)', 'radius'), ('greatest(hx, hy, hz)', 'max_extent')])} FROM ob""",
    "radix_to_oct": f"WITH {_TREE}, {sql.OCTREE}{sql.TO_OCTREE} SELECT node_id, oct_id FROM mp",
    "octree_far": sql.recursive(_TREE + sql.walk("bh", THETA) + ", " + sql.OCTREE + sql.TO_OCTREE, f"SELECT t.oct_id AS oct_target, s.oct_id AS oct_source FROM ({sql.FAR}) x JOIN mp t ON t.node_id = x.target JOIN mp s ON s.node_id = x.source"),
    "fixed_depth_boxes": f"""WITH {_FIXED}, cl AS (SELECT unnest(range(CAST(pow(8, d) AS BIGINT))) AS leaf, pow(2.0::DOUBLE, d) AS k FROM dp), {sql.deinterleave('cl', 'cj', 'leaf')}
SELECT leaf, {', '.join(f"round({a}0 + (j{a} + {e}) * (({a}1 - {a}0) / k), 9) + 0 AS {a}{e}" for a in 'xyz' for e in (0, 1))} FROM cj, box""",
    "fixed_depth_refined": _refined(),
    "octree_walk_far": _octree_walk(sql.FAR),
    "octree_walk_near": _octree_walk(sql.NEAR),
    "octree_walk_stats": _octree_walk(_STATS),
    "octree_parents": f"WITH {sql.bucketed('emb', LEAF)}, {sql.OCTREE}, {_OCT_PARENTS} SELECT o.oct_id, coalesce(parent, -1) AS parent, CAST(CASE WHEN parent IS NULL THEN -1 ELSE (code >> (60 - 3 * pd)) & 7 END AS INTEGER) AS octant FROM o LEFT JOIN op USING (oct_id)",
    "prepared": sql.recursive(sql.tree("emb", 16) + sql.walk("bh", THETA), _STATS),
    "event_cells": f"WITH {sql.coded('events')} SELECT epoch_us(time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01')) AS start, code >> 57 AS cell, count(*) AS n, sum(mass) AS mass FROM cd JOIN events ON event_id = id GROUP BY 1, 2",
    "reverse_halo": _halo(f"""SELECT hl.domain, hl.local, {', '.join(f'round(sum(-(mass * vmass * ({a} - v{a}))), 5) + 0 AS f{a}' for a in 'xyz')} FROM hl JOIN (SELECT domain AS viewer, sum(mass) AS vmass, sum(mass * x) / sum(mass) AS vx, sum(mass * y) / sum(mass) AS vy, sum(mass * z) / sum(mass) AS vz FROM dm GROUP BY domain) USING (viewer) GROUP BY ALL"""),
    "halo_import": _halo(f"SELECT domain * {domains.STRIDE} + local AS gid, domain, local // {LEAF} AS leaf, local, id, viewer FROM hl"),
    "coarse_nodes": f"""WITH {_DOMAINS}, {_coarse()} SELECT node_id, parent, lft AS "left", rgt AS "right", is_leaf, level, nd1.lo, nd1.hi, (SELECT CASE WHEN min(domain) = max(domain) THEN min(domain) ELSE -1 END FROM bk1 WHERE local BETWEEN nd1.lo AND nd1.hi) AS owner, {_R6('cx', 'cy', 'cz', 'radius')} FROM nd1 JOIN gm1 USING (node_id)""",
    "near_blocks": _walk("bh", f"""SELECT target, source, k, n, place - k AS first_place, nth_target, sum(CAST(k % {BLOCK} = 0 AS BIGINT)) OVER (ORDER BY target, source)::BIGINT - 1 AS block FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) - 1 AS k, count(*) OVER (PARTITION BY target) AS n, row_number() OVER (ORDER BY target, source) - 1 AS place, dense_rank() OVER (ORDER BY target) - 1 AS nth_target FROM ({sql.NEAR}))"""),
    "far_by_level": _walk("bh", f"SELECT target, source, level AS target_level, row_number() OVER (ORDER BY level, target, source) - 1 AS place, rank() OVER (ORDER BY level) - 1 AS level_start FROM ({sql.FAR}) JOIN nd ON node_id = target"),
    "moments_packed": f"WITH {_TREE}, cn AS ({sql.central(3)}) SELECT node_id, unnest(range({moments.total_coefficients(3)})) AS slot, unnest([{', '.join(moments.name(m) for m in moments.all_indices(3))}]) AS value FROM cn",
    "moments_dense": f"WITH {_TREE}, cn AS ({sql.central(2)}) SELECT node_id, unnest(range(27)) AS slot, unnest([{', '.join(f'm{i}{j}{k}' if i + j + k <= 2 else '0.0::DOUBLE' for i in range(3) for j in range(3) for k in range(3))}]) AS value FROM cn",
    "moment_layout": "SELECT o AS order_, i, j, o - i - j AS k, row_number() OVER (PARTITION BY o ORDER BY i DESC, j DESC) - 1 AS nth, row_number() OVER (ORDER BY o, i DESC, j DESC) - 1 AS place, count(*) OVER (PARTITION BY o) AS size, CAST(factorial(CAST(i AS INTEGER)) * factorial(CAST(j AS INTEGER)) * factorial(CAST(o - i - j AS INTEGER)) AS BIGINT) AS factorial FROM range(5) a(o), range(5) b(i), range(5) c(j) WHERE i + j <= o",
    "leaf_kd": f"WITH {_kd()} SELECT node_id, parent, is_leaf, level, lo, hi, coalesce(split_dim, -1) AS split_dim, split_value FROM nd LEFT JOIN ks USING (node_id)",
    "leaf_kd_walk": sql.recursive(_kd() + "," + sql.GEOM + sql.walk("dehnen", THETA).replace("radius AS ext", "radius * 1.2::DOUBLE AS ext"), _STATS),
    "heap_kd": f"WITH {_heap()} SELECT * FROM hn",
    "heap_kd_points": f"WITH {_heap()} SELECT * FROM hq",
    "uniform_view": f"""WITH {_CELLS}{sql.NUMBERED} SELECT a.cell_id, a.level, a.cell, a.n, coalesce(p.cell_id, -1) AS parent, CASE WHEN p.cell_id IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY p.cell_id ORDER BY a.cell_id) - 1 END AS nth,
  (SELECT count(*) FROM nc c WHERE c.level = a.level + 1 AND c.cell >> 3 = a.cell) AS n_children, coalesce((SELECT min(cell_id) FROM nc c WHERE c.level = a.level + 1 AND c.cell >> 3 = a.cell), -1) AS first_child,
  (SELECT count(*) FROM pl WHERE pl.code < a.cell << CAST(3 * ({DEPTH} - a.level) AS BIGINT)) AS lo, (SELECT count(*) FROM pl WHERE pl.code < (a.cell + 1) << CAST(3 * ({DEPTH} - a.level) AS BIGINT)) - 1 AS hi, (SELECT min(cell_id) FROM nc c WHERE c.level = a.level) AS level_start
FROM nc a LEFT JOIN nc p ON p.level = a.level - 1 AND p.cell = a.cell >> 3""",
    "fixed_depth_walk": sql.recursive(f"""{_FIXED}, fc AS (SELECT unnest(range(CAST(pow(8, d) AS BIGINT))) AS leaf, pow(2.0::DOUBLE, d) AS k, d FROM dp), {sql.deinterleave('fc', 'cj', 'leaf')},
lb AS (SELECT leaf, {', '.join(f"{a}0 + (j{a} + {e}) * (({a}1 - {a}0) / k) AS b{a}{e}" for a in 'xyz' for e in (0, 1))} FROM cj, box),
lv AS (SELECT leaf, leaf << CAST(63 - 3 * d AS BIGINT) AS code, (SELECT count(*) FROM cd WHERE cd.code >> CAST(63 - 3 * fc.d AS BIGINT) < fc.leaf) AS lo, (SELECT count(*) FROM cd WHERE cd.code >> CAST(63 - 3 * fc.d AS BIGINT) <= fc.leaf) - 1 AS hi FROM fc), {sql.hierarchy()},
gm AS (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS radius, greatest(hx, hy, hz) AS max_extent FROM (SELECT node_id, {', '.join(f"(min(b{a}0) + max(b{a}1)) * 0.5::DOUBLE AS c{a}, greatest((max(b{a}1) - min(b{a}0)) * 0.5::DOUBLE, 1e-6::DOUBLE) AS h{a}" for a in 'xyz')} FROM nd JOIN lb ON lb.leaf BETWEEN nd.first AND nd.last GROUP BY node_id)){sql.walk('bh', THETA)}""", _STATS),
}


def queries() -> dict[str, Query]:
    return dict(ALL)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
