"""Points split into contiguous domains along the Z-order curve, and what domains exchange.

Spark's range partitioning takes the place of sample sort, and joins the place of exchanges; `domain` is a column of
every table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larchpoint.functions import morton
from larchpoint.functions.morton import Bounds
from larchpoint.operators import geometry, radix
from larchpoint.operators.walk import NEAR, REFINE, Rules, Walk, walk
from larchpoint.storage import keep, with_rank

#: A particle's global number is its domain times this, plus its place there.
STRIDE = 1 << 40


def equalized(sorted_points: DataFrame, n_domains: int) -> DataFrame:
    """Points with `domain`: sizes differ by one at most, the first domains being the larger."""
    n = sorted_points.count()
    size, more = divmod(n, n_domains)
    edge = more * (size + 1)
    domain = F.when(F.col("pos") < edge, F.floor(F.col("pos") / (size + 1))).otherwise(F.lit(more) + F.floor((F.col("pos") - edge) / max(size, 1)))
    start = F.col("domain") * size + F.least(F.col("domain"), F.lit(more))
    return sorted_points.withColumn("domain", domain.cast("long")).withColumn("local", F.col("pos") - start)


def aligned(sorted_points: DataFrame, n_domains: int, level: int) -> DataFrame:
    """Points with `domain`, whose borders are edges of cells of a level."""
    cell = F.shiftright("code", 3 * (morton.BITS - level))
    n = sorted_points.count()
    first = sorted_points.groupBy(cell.alias("cell")).agg(F.min("pos").alias("at"))
    domain = first.select("cell", F.least(F.floor(F.col("at") * n_domains / n), F.lit(n_domains - 1)).cast("long").alias("domain"))
    return sorted_points.withColumn("cell", cell).join(domain, "cell").drop("cell")


def decompose(points: DataFrame, n_domains: int, bounds: Bounds, equalize: bool = False, align_level: int | None = None) -> DataFrame:
    if equalize and align_level is not None:
        raise ValueError("equalize and align_level exclude each other")
    rows = keep(radix.sort_points(points, bounds))
    return aligned(rows, n_domains, align_level) if align_level is not None else equalized(rows, n_domains)


def report(decomposed: DataFrame) -> DataFrame:
    """domain, n, lowest and highest code, mass."""
    return decomposed.groupBy("domain").agg(F.count("*").alias("n"), F.min("code").alias("lo_code"), F.max("code").alias("hi_code"), F.sum("mass").alias("mass"))


@dataclass
class LocalTree:
    points: DataFrame
    nodes: DataFrame
    geom: DataFrame


def local_tree(decomposed: DataFrame, domain: int, leaf_size: int) -> LocalTree:
    """A domain's own radix tree."""
    own = decomposed.where(F.col("domain") == domain)
    rows = keep(radix.bucket(own.withColumn("pos", F.col("local")), leaf_size))
    nodes = keep(radix.hierarchy(radix.leaves(rows)))
    return LocalTree(rows, nodes, keep(geometry.geometry(rows, nodes)))


def forest(decomposed: DataFrame, leaf_size: int) -> LocalTree:
    """The radix trees of all domains at once, told apart by the column domain."""
    rows = keep(radix.bucket(decomposed.withColumn("pos", F.col("local")), leaf_size))
    nodes = keep(radix.hierarchy(radix.leaves(rows, ["domain"]), ["domain"]))
    return LocalTree(rows, nodes, keep(geometry.geometry(rows, nodes, by=["domain"])))


def numbered(nodes: DataFrame, tree: str) -> DataFrame:
    """The nodes of a forest with ids of their own (g), tree by tree, and their children's (gleft, gright; -1)."""
    sizes = nodes.groupBy(tree).agg(F.count("*").alias("size"))  # a row a tree
    base = F.sum("size").over(Window.orderBy(tree)) - F.col("size")
    rows = nodes.join(sizes.select(tree, base.alias("base")), tree)
    child = lambda c: F.when(F.col(c) < 0, -1).otherwise(F.col("base") + F.col(c)).cast("long").alias("g" + c)
    return rows.select(tree, "node_id", (F.col("base") + F.col("node_id")).alias("g"), "parent", child("left"), child("right"))


def walk_forests(targets: LocalTree, sources: LocalTree, pairs: DataFrame, rules: Rules | None = None, tree: str = "domain") -> DataFrame:
    """The walks of many pairs of trees as one: target_tree, source_tree, target, source, action (ACCEPT or NEAR).

    pairs: target_tree, source_tree, the values of column `tree` that tell the trees of both forests apart.
    """
    sides = []
    for x, f in (("target", targets), ("source", sources)):
        ids = keep(numbered(f.nodes, tree))
        nodes = ids.select(F.col("g").alias("node_id"), F.col("gleft").alias("left"), F.col("gright").alias("right"))
        geom = f.geom.join(ids.select(tree, "node_id", "g"), [tree, "node_id"]).drop(tree, "node_id").withColumnRenamed("g", "node_id")
        names = ids.select(F.col(tree).alias(f"{x}_tree"), F.col("node_id").alias(x), F.col("g").alias(f"g_{x}"))
        roots = ids.where("parent < 0").select(F.col(tree).alias(f"{x}_tree"), F.col("g").alias(x[0]))
        sides.append((nodes, geom, names, roots))
    (tn, tg, t_names, t_roots), (sn, sg, s_names, s_roots) = sides
    roots = pairs.join(t_roots, "target_tree").join(s_roots, "source_tree").select(F.col("t").alias("a"), F.col("s").alias("b"))
    found = walk(tn, tg, rules, (sn, sg), roots=roots).pairs.where(F.col("action") != REFINE)
    rows = found.select(F.col("a").alias("g_target"), F.col("b").alias("g_source"), "action")
    return rows.join(t_names, "g_target").join(s_names, "g_source").select("target_tree", "source_tree", "target", "source", "action")


def frontier(decomposed: DataFrame, leaf_size: int) -> DataFrame:
    """Per domain and leaf: n, first and last point, mass, centre of mass, and the largest distance from it."""
    rows = decomposed.withColumn("leaf", F.floor(F.col("local") / leaf_size).cast("long"))
    sums = rows.groupBy("domain", "leaf").agg(F.count("*").alias("n"), F.min("local").alias("lo"), F.max("local").alias("hi"), F.sum("mass").alias("mass"), *(F.sum(F.col("mass") * F.col(a)).alias(f"s{a}") for a in "xyz"))
    sums = sums.select("domain", "leaf", "n", "lo", "hi", "mass", *(F.when(F.col("mass") != 0, F.col(f"s{a}") / F.col("mass")).otherwise(0.0).alias(f"com{a}") for a in "xyz"))
    d2 = sum(((F.col(a) - F.col(f"com{a}")) * (F.col(a) - F.col(f"com{a}")) for a in "xyz"), F.lit(0.0))
    far = rows.join(sums.select("domain", "leaf", "comx", "comy", "comz"), ["domain", "leaf"]).groupBy("domain", "leaf").agg(F.sqrt(F.max(d2)).alias("radius"))
    return sums.join(far, ["domain", "leaf"])


def coarse_tree(front: DataFrame, bounds: Bounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, nodes, geometry) of the radix tree over all frontier leaves, one leaf each; the leaves' balls are
    their extents, and a node's box holds the balls below it."""
    points = front.select((F.col("domain") * STRIDE + F.col("leaf")).alias("id"), *(F.col(f"com{a}").alias(a) for a in "xyz"), "mass", "radius", "domain", F.col("leaf").alias("own_leaf"))
    rows = keep(radix.bucket(radix.sort_points(points, bounds), 1))
    nodes = keep(radix.hierarchy(radix.leaves(rows)))
    return rows, nodes, keep(geometry.geometry(rows, nodes, "radius"))


def remote_tree(front: DataFrame, domain: int, bounds: Bounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The coarse tree that a domain sees: all leaves but its own."""
    return coarse_tree(front.where(F.col("domain") != domain), bounds)


def remote_forest(front: DataFrame, bounds: Bounds) -> tuple[DataFrame, LocalTree]:
    """(entries, trees): the coarse trees that all domains see, told apart by the column viewer.

    Every frontier leaf is in the tree of each domain but its own; domains are as many rows as there are domains.
    """
    viewers = front.select(F.col("domain").alias("viewer")).distinct()
    seen = front.join(F.broadcast(viewers), F.col("viewer") != F.col("domain"))  # a row a domain
    points = seen.select("viewer", (F.col("domain") * STRIDE + F.col("leaf")).alias("id"), *(F.col(f"com{a}").alias(a) for a in "xyz"), "mass", "radius", "domain", F.col("leaf").alias("own_leaf"))
    ranked = with_rank(morton.with_code(points, bounds), ["viewer", "code", "id"])
    first = ranked.groupBy("viewer").agg(F.min("pos").alias("first"))
    rows = keep(radix.bucket(ranked.join(first, "viewer").withColumn("pos", F.col("pos") - F.col("first")).drop("first"), 1))
    nodes = keep(radix.hierarchy(radix.leaves(rows, ["viewer"]), ["viewer"]))
    return rows, LocalTree(rows, nodes, keep(geometry.geometry(rows, nodes, "radius", ["viewer"])))


def halos(decomposed: DataFrame, leaf_size: int, bounds: Bounds, rules: Rules | None = None) -> DataFrame:
    """import_halo() of every domain, the viewer: gid, domain, leaf, local, id, viewer."""
    local = forest(decomposed, leaf_size)
    entries, remote = remote_forest(keep(frontier(decomposed, leaf_size)), bounds)
    local = LocalTree(*(df.withColumnRenamed("domain", "viewer") for df in (local.points, local.nodes, local.geom)))
    viewers = local.nodes.where("parent < 0").select(F.col("viewer").alias("target_tree"), F.col("viewer").alias("source_tree"))
    near = walk_forests(local, remote, viewers, rules, "viewer").where(F.col("action") == NEAR)
    needed = near.select(F.col("source_tree").alias("viewer"), F.col("source").alias("node_id")).distinct()
    leaf = remote.nodes.where("is_leaf").select("viewer", "node_id", F.col("first").alias("leaf")).join(entries.select("viewer", "leaf", "domain", "own_leaf"), ["viewer", "leaf"]).drop("leaf")
    wanted = needed.join(leaf, ["viewer", "node_id"]).select("viewer", "domain", F.col("own_leaf").alias("leaf"))
    rows = decomposed.withColumn("leaf", F.floor(F.col("local") / leaf_size).cast("long"))
    return rows.join(wanted, ["domain", "leaf"]).select((F.col("domain") * STRIDE + F.col("local")).alias("gid"), "domain", "leaf", "local", "id", "viewer")


def classify(local: LocalTree, remote: tuple[DataFrame, DataFrame, DataFrame], rules: Rules | None = None) -> Walk:
    """Pairs of a domain's nodes with remote ones."""
    return walk(local.nodes, local.geom, rules, (remote[1], remote[2]))


def import_halo(near: DataFrame, remote_entries: DataFrame, remote_nodes: DataFrame, decomposed: DataFrame, leaf_size: int) -> DataFrame:
    """The points of all remote leaves near to some local leaf, each once: gid, domain, leaf, local, id."""
    needed = near.select(F.col("source").alias("node_id")).distinct()
    leaf = remote_nodes.where("is_leaf").select("node_id", F.col("first").alias("leaf")).join(remote_entries.select("leaf", "domain", "own_leaf"), "leaf").drop("leaf")
    wanted = needed.join(leaf, "node_id").select("domain", F.col("own_leaf").alias("leaf"))
    rows = decomposed.withColumn("leaf", F.floor(F.col("local") / leaf_size).cast("long"))
    return rows.join(wanted, ["domain", "leaf"], "left_semi").select((F.col("domain") * STRIDE + F.col("local")).alias("gid"), "domain", "leaf", "local", "id")


def owners(a_domain: str, a_index: str, b_domain: str, b_index: str):
    """The domain that handles a pair: of the ends in order of (domain, index), the lower for an even index sum."""
    first = (F.col(a_domain) < F.col(b_domain)) | ((F.col(a_domain) == F.col(b_domain)) & (F.col(a_index) <= F.col(b_index)))
    low, high = F.when(first, F.col(a_domain)).otherwise(F.col(b_domain)), F.when(first, F.col(b_domain)).otherwise(F.col(a_domain))
    return F.when((F.col(a_index) + F.col(b_index)) % 2 == 0, low).otherwise(high)


def handled(pairs: DataFrame) -> DataFrame:
    """The pairs (target_domain, source_domain, target, source, ...) that the target's domain handles: over both
    directions of a walk, every pair once."""
    return pairs.where(owners("target_domain", "target", "source_domain", "source") == F.col("target_domain"))


def single_owner(nodes: DataFrame, leaf_domains: DataFrame) -> DataFrame:
    """node_id, domain: the domain that owns all leaves below a node, or -1. leaf_domains: leaf, domain."""
    rows = radix.over_leaves(nodes, leaf_domains.select("leaf", F.col("domain").alias("a"), F.col("domain").alias("b")), {"a": F.min, "b": F.max})
    return rows.select("node_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(-1).alias("domain"))


def reverse_halo(forces: DataFrame) -> DataFrame:
    """Sums what was computed for imported points at the points' owners. forces: gid, fx, fy, fz."""
    rows = forces.groupBy("gid").agg(*(F.sum(-F.col(f"f{a}")).alias(f"f{a}") for a in "xyz"))
    return rows.select(F.floor(F.col("gid") / STRIDE).cast("long").alias("domain"), (F.col("gid") % STRIDE).alias("local"), "fx", "fy", "fz")


def top_moments(decomposed: DataFrame) -> DataFrame:
    """Mass and centre of mass of every domain and of all (domain -1)."""
    sums = decomposed.groupBy("domain").agg(F.sum("mass").alias("mass"), *(F.sum(F.col("mass") * F.col(a)).alias(f"s{a}") for a in "xyz"))
    every = sums.unionByName(sums.agg(F.sum("mass").alias("mass"), *(F.sum(f"s{a}").alias(f"s{a}") for a in "xyz")).withColumn("domain", F.lit(-1).cast("long")))
    return every.select("domain", "mass", *(F.when(F.col("mass") != 0, F.col(f"s{a}") / F.col("mass")).otherwise(0.0).alias(f"com{a}") for a in "xyz"))


def nth_in_domain(decomposed: DataFrame) -> DataFrame:
    """The place of points in aligned domains, which don't follow from arithmetic."""
    start = decomposed.groupBy("domain").agg(F.min("pos").alias("start"))
    return decomposed.join(start, "domain").withColumn("local", F.col("pos") - F.col("start")).drop("start")


