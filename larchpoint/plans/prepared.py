"""Trees by name with their options, and everything that queries need of a tree, prepared at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from larchpoint.functions.morton import Bounds
from larchpoint.operators import geometry, moments, octree, radix, trees
from larchpoint.operators.walk import Rules, Walk, walk
from larchpoint.sources.points import infer_bounds, require_fields
from larchpoint.storage import keep

#: Build modes by kind of tree.
MODES = {"radix": ("adaptive", "fixed_depth", "static_radix"), "octree": ("adaptive", "fixed_depth"), "kdtree": ("adaptive",)}
#: Balls around k-d nodes are larger than their boxes suggest; this replaces a radius scale of 1.
KD_RADIUS_SCALE = 1.2


@dataclass(frozen=True)
class Options:
    """leaf_size holds for buckets; target_leaf_points and max_depth for trees of a fixed depth."""

    leaf_size: int = 16
    mode: str = "adaptive"
    bounds: Bounds | None = None
    target_leaf_points: int = 16
    max_depth: int | None = None
    drop_empty: bool = False


@dataclass
class Tree:
    """points(id, x, y, z, mass, pos, leaf), nodes and what follows from them."""

    kind: str
    options: Options
    bounds: Bounds
    points: DataFrame
    nodes: DataFrame
    leaves: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def geometry(self, radius: str | None = None) -> DataFrame:
        """Boxes of nodes. Trees of a fixed depth have their cells' boxes, unless points have radii."""
        if self.options.mode == "fixed_depth" and radius is None:
            return geometry.from_leaf_boxes(geometry.cell_boxes(self.leaves, self.bounds), self.nodes)
        return geometry.geometry(self.points, self.nodes, radius)

    def mass_moments(self) -> DataFrame:
        return moments.mass_moments(self.points, self.nodes)

    def multipoles(self, order: int, centres: DataFrame | None = None) -> DataFrame:
        return moments.multipoles(self.points, self.nodes, order, centres)

    def rules(self, rules: Rules) -> Rules:
        return replace(rules, radius_scale=KD_RADIUS_SCALE) if self.kind == "kdtree" and rules.criterion == "dehnen" and rules.radius_scale == 1.0 else rules

    def walk(self, rules: Rules | None = None, geom: DataFrame | None = None) -> Walk:
        return walk(self.nodes, self.geometry() if geom is None else geom, self.rules(rules or Rules()))

    def interactions_of(self, found: Walk, node_id: int) -> DataFrame:
        return found.far.where(f"target = {int(node_id)}")

    def neighbours_of(self, found: Walk, leaf_node: int) -> DataFrame:
        if self.nodes.where(f"node_id = {int(leaf_node)} AND is_leaf").isEmpty():
            raise ValueError(f"node {leaf_node} is no leaf")
        return found.near.where(f"target = {int(leaf_node)}")


def _radix(points: DataFrame, o: Options) -> Tree:
    box = o.bounds or infer_bounds(points)
    if o.mode == "fixed_depth":
        rows, leaf_rows, _ = trees.fixed_depth(points, o.target_leaf_points, box, o.max_depth, o.drop_empty)
        rows, leaf_rows = keep(rows), keep(leaf_rows)
        return Tree("radix", o, box, rows, keep(radix.hierarchy(leaf_rows.select("leaf", "code", "lo", "hi"))), leaf_rows)
    rows = keep(radix.bucket(radix.sort_points(points, box), o.leaf_size))
    nodes = trees.static_radix(rows) if o.mode == "static_radix" else radix.hierarchy(radix.leaves(rows))
    return Tree("radix", o, box, rows, keep(nodes), radix.leaves(rows))


def _octree(points: DataFrame, o: Options) -> Tree:
    base = _radix(points, o)
    held = keep(octree.cells(base.points))
    mapping = keep(octree.radix_to_octree(base.nodes, base.points, held)) if o.mode == "adaptive" else None
    return replace(base, kind="octree", extra={"cells": held} | ({"mapping": mapping} if mapping is not None else {}))


def _kd(points: DataFrame, o: Options) -> Tree:
    rows, nodes = trees.leaf_kd(points, o.leaf_size)
    nodes = keep(nodes)
    return Tree("kdtree", o, o.bounds or infer_bounds(points), rows, nodes, nodes.where("is_leaf").selectExpr("first leaf", "lo", "hi"))


_builders: dict[str, Callable[[DataFrame, Options], Tree]] = {"radix": _radix, "octree": _octree, "kdtree": _kd}


def register_tree_builder(kind: str, builder: Callable[[DataFrame, Options], Tree], overwrite: bool = False) -> None:
    if kind in _builders and not overwrite:
        raise ValueError(f"there is a builder for {kind}")
    _builders[kind] = builder


def available_tree_types() -> list[str]:
    return sorted(_builders)


def build(points: DataFrame, kind: str = "radix", options: Options | None = None) -> Tree:
    """A tree over points(id, x, y, z, mass)."""
    o = options or Options()
    if kind not in _builders:
        raise ValueError(f"unknown tree {kind}; there are {', '.join(available_tree_types())}")
    if o.mode not in MODES.get(kind, (o.mode,)):
        raise ValueError(f"{kind} trees have no mode {o.mode}")
    require_fields(points, ("id", "x", "y", "z", "mass"), "the point table")
    return _builders[kind](keep(points), o)


def refresh(tree: Tree, points: DataFrame) -> Tree:
    """New positions under the topology of a static tree."""
    if tree.options.mode != "static_radix":
        raise ValueError("only static trees can be refreshed")
    rows, nodes = trees.refresh_static(points, tree.nodes, tree.options.leaf_size, tree.bounds)
    return replace(tree, points=rows, nodes=keep(nodes), leaves=radix.leaves(rows))


@dataclass
class Prepared:
    tree: Tree
    geometry: DataFrame
    walk: Walk


def prepare(points: DataFrame, kind: str = "radix", options: Options | None = None, rules: Rules | None = None) -> Prepared:
    """Tree, geometry, far and near pairs in one go."""
    tree = build(points, kind, options)
    geom = keep(tree.geometry())
    return Prepared(tree, geom, tree.walk(rules, geom))
