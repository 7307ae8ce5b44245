"""Dual-tree walks: pairs of nodes that are far enough apart to interact as wholes, and pairs of leaves that aren't.

A walk is a recursive theta self-join. Starting with (root, root), every pair is accepted (far), near (two leaves) or
refined. There are two ways to run it, with the same result:

* `in_tasks`: if the nodes are few (NODES, a bound on what is broadcast), a few rounds on the driver grow a frontier
  of at most FRONTIER pairs, which tasks then finish, each on its own share, in numpy.
* `by_rounds`: otherwise each round joins the frontier with the node table twice; Spark picks the joins.

Far pairs are rows (target, source, tag), both directions; near pairs are rows (target, source) of leaves, without
(leaf, leaf).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larchpoint.session import ship
from larchpoint.storage import forget, keep

ACCEPT, NEAR, REFINE = 0, 1, 2
NODES = 500_000
FRONTIER = 20_000
#: Pairs of the frontier that a task gets, and pairs judged at once.
SHARE, CHUNK = 1_000, 1 << 16
CRITERIA = ("bh", "dehnen", "engblom")


@dataclass(frozen=True)
class Rules:
    """How pairs are judged. policy(pair) -> (action, tag) sees a Pair from both sides; both must agree."""

    theta: float = 0.6
    criterion: str = "bh"
    radius_scale: float = 1.0
    mutual: bool = False
    policy: Callable | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.criterion not in CRITERIA:
            raise ValueError(f"unknown criterion {self.criterion}")


@dataclass
class Pair:
    """What a policy sees: arrays or Columns. select(condition, a, b) works for either."""

    target: object
    source: object
    distance2: object
    target_extent: object
    source_extent: object
    target_leaf: object
    source_leaf: object
    mac_ok: object
    different: object
    select: Callable

    def swapped(self) -> Pair:
        return Pair(self.source, self.target, self.distance2, self.source_extent, self.target_extent, self.source_leaf, self.target_leaf, self.mac_ok, self.different, self.select)


def default_policy(p: Pair) -> tuple:
    near = p.target_leaf & p.source_leaf & p.different & ~p.mac_ok
    return p.select(p.mac_ok, ACCEPT, p.select(near, NEAR, REFINE)), p.select(p.mac_ok, -1, -1)


def mac_nodes(nodes: DataFrame, geom: DataFrame, rules: Rules) -> DataFrame:
    """node_id, kids, ext, cx, cy, cz. Nodes have left and right, or the sorted ids of all their children in kids."""
    ext = F.col("max_extent") if rules.criterion == "bh" else F.col("radius")
    if rules.criterion == "dehnen":
        ext = ext * F.lit(float(rules.radius_scale))
    kids = F.col("kids") if "kids" in nodes.columns else F.filter(F.array("left", "right"), lambda x: x >= 0)
    return nodes.join(geom, "node_id").select("node_id", kids.alias("kids"), ext.alias("ext"), "cx", "cy", "cz")


def accepted(rules: Rules, d2, a, b, larger, smaller):
    """The acceptance criterion over arrays or Columns, without its guards."""
    theta2 = rules.theta * rules.theta
    if rules.mutual:
        return theta2 * d2 > (a + b) * (a + b)
    if rules.criterion == "engblom":
        left = larger(a, b) + math.sqrt(theta2) * smaller(a, b)
        return left * left <= theta2 * d2
    return (a + b) * (a + b) <= theta2 * d2


# -- numpy


@dataclass
class Nodes:
    kids: np.ndarray  # a row of children for each node, -1 where there is none
    ext: np.ndarray
    centre: np.ndarray

    @classmethod
    def collect(cls, rows: DataFrame) -> Nodes:
        t = rows.toArrow().sort_by("node_id")
        if t.num_rows and t["node_id"][-1].as_py() != t.num_rows - 1:
            raise ValueError("node ids must run from 0")
        held = t["kids"].combine_chunks()
        many = held.value_lengths().to_numpy()
        kids = np.full((len(many), max(1, int(many.max(initial=0)))), -1, np.int64)
        kids[np.repeat(np.arange(len(many)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] = held.flatten().to_numpy()
        return cls(kids, t["ext"].to_numpy(), np.stack([t[c].to_numpy() for c in ("cx", "cy", "cz")], 1))

    def root(self) -> int:
        return int(np.setdiff1d(np.arange(len(self.kids)), self.kids.ravel())[0])


def step(t: Nodes, s: Nodes, a: np.ndarray, b: np.ndarray, rules: Rules, cross: bool) -> tuple[np.ndarray, ...]:
    """action, forward tag, reverse tag and the next frontier of pairs (a, b)."""
    d = t.centre[a] - s.centre[b]
    d2 = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]
    ea, eb = t.ext[a], s.ext[b]
    different = np.ones(len(a), bool) if cross else a != b
    ok = different & (d2 > 0) & accepted(rules, d2, ea, eb, np.maximum, np.minimum)
    leaf_a, leaf_b = t.kids[a, 0] < 0, s.kids[b, 0] < 0
    pair = Pair(a, b, d2, ea, eb, leaf_a, leaf_b, ok, different, np.where)
    policy = rules.policy or default_policy
    action, tag = policy(pair)
    back_tag = tag
    if rules.policy and not cross:
        back, back_tag = policy(pair.swapped())
        action = np.where(action == back, action, REFINE)
    action = np.broadcast_to(action, a.shape)
    if cross:  # two leaves at one place are near, even where a self pair would be dropped
        action = np.where(leaf_a & leaf_b & ~ok & (action == REFINE), NEAR, action) if not rules.policy else action
    bad = (action == NEAR) & ~(leaf_a & leaf_b) | (action == REFINE) & leaf_a & leaf_b & different
    if bad.any():
        raise ValueError("a policy must name leaf pairs near or accept them, and name no other pair near")
    go = action == REFINE
    a, b, ea, eb, leaf_a, leaf_b, same = a[go], b[go], ea[go], eb[go], leaf_a[go], leaf_b[go], ~different[go]
    both = same & ~leaf_a
    split_a = ~both & ~leaf_a & ~same & (leaf_b | (ea >= eb))
    split_b = ~both & ~leaf_b & ~same & ~split_a
    parts = []
    for i in range(t.kids.shape[1]):
        parts += [(t.kids[a[both], i], t.kids[a[both], j]) for j in range(i, t.kids.shape[1])]
        parts.append((t.kids[a[split_a], i], b[split_a]))
    parts += [(a[split_b], s.kids[b[split_b], i]) for i in range(s.kids.shape[1])]
    na, nb = (np.concatenate(x) for x in zip(*parts, strict=True))
    there = (na >= 0) & (nb >= 0)
    na, nb = na[there], nb[there]
    if not cross:
        na, nb = np.minimum(na, nb), np.maximum(na, nb)
    return action, np.broadcast_to(tag, action.shape), np.broadcast_to(back_tag, action.shape), na, nb


def _rows(a: np.ndarray, b: np.ndarray, action: np.ndarray, tag: np.ndarray, back: np.ndarray, number: int) -> pa.RecordBatch:
    done = action != REFINE
    n = int(done.sum())
    arrays = [pa.array(x.astype(np.int64)) for x in (a[done], b[done], action[done], tag[done], back[done])]
    if refined := int((~done).sum()):  # one row that counts the refined pairs
        arrays = [pa.concat_arrays([x, pa.array([v], pa.int64())]) for x, v in zip(arrays, (-1, -1, REFINE, refined, 0), strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(n + bool(refined), number), pa.int64())], ["a", "b", "action", "tag", "back_tag", "round"])


SCHEMA = "a long, b long, action long, tag long, back_tag long, round long"


def in_tasks(targets: DataFrame, sources: DataFrame | None, rules: Rules, roots: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, action, tag, back_tag, round); rows of action REFINE count refined pairs in tag."""
    spark = targets.sparkSession
    ship(spark)
    cross = sources is not None
    t = Nodes.collect(targets)
    s = Nodes.collect(sources) if cross else t
    done, number = [], 0
    if roots is None:
        a, b = np.array([t.root()]), np.array([s.root()])
    else:
        held = roots.select("a", "b").toArrow()  # pairs of trees
        a, b = held["a"].to_numpy(), held["b"].to_numpy()
    while len(a) and len(a) < FRONTIER and sum(x.num_rows for x in done) < 4 * FRONTIER:
        action, tag, back, na, nb = step(t, s, a, b, rules, cross)
        done.append(_rows(a, b, action, tag, back, number))
        a, b, number = na, nb, number + 1
    first = spark.createDataFrame(pa.Table.from_batches(done), SCHEMA) if done else spark.createDataFrame([], SCHEMA)
    if not len(a):
        return first
    sent = spark.sparkContext.broadcast((t, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, s = sent.value
        for batch in batches:
            # Depth first, CHUNK pairs at a time: what waits is bounded by CHUNK, a step's pairs and the walk's depth.
            waiting = [(*(batch.column(i).to_numpy() for i in range(2)), number)]
            while waiting:
                a, b, at = waiting.pop()
                if len(a) > CHUNK:
                    waiting.append((a[CHUNK:], b[CHUNK:], at))
                    a, b = a[:CHUNK], b[:CHUNK]
                action, tag, back, na, nb = step(t, s, a, b, rules, cross)
                yield _rows(a, b, action, tag, back, at)
                if len(na):
                    waiting.append((na, nb, at + 1))

    frontier = spark.createDataFrame(pa.table({"a": a, "b": b}), "a long, b long").repartition(max(spark.sparkContext.defaultParallelism, len(a) // SHARE))
    return first.unionByName(frontier.mapInArrow(run, SCHEMA))


# -- joins


def by_rounds(targets: DataFrame, sources: DataFrame | None, rules: Rules, roots: DataFrame | None = None) -> DataFrame:
    """The same as in_tasks, one join round after the other."""
    cross = sources is not None
    side = lambda df, x: df.select(*(F.col(c).alias(f"{x}_{c}") for c in ("node_id", "kids", "ext", "cx", "cy", "cz")))
    targets = keep(targets)
    sources = keep(sources) if cross else targets
    t, s = side(targets, "a"), side(sources, "b")
    kids = lambda df: df.select(F.explode("kids").alias("node_id"))
    root = lambda df: df.select("node_id").join(kids(df), "node_id", "left_anti")
    frontier = keep(roots.select("a", "b")) if roots is not None else root(targets).select(F.col("node_id").alias("a")).crossJoin(root(sources).select(F.col("node_id").alias("b")))  # one row each
    out, number = None, 0
    select = lambda c, x, y: F.when(c, x).otherwise(y)
    while True:
        rows = frontier.join(t, F.col("a") == F.col("a_node_id")).join(s, F.col("b") == F.col("b_node_id"))
        d = [F.col(f"a_c{x}") - F.col(f"b_c{x}") for x in "xyz"]
        rows = rows.withColumn("d2", (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2])
        ea, eb = F.col("a_ext"), F.col("b_ext")
        different = F.lit(True) if cross else F.col("a") != F.col("b")
        ok = different & (F.col("d2") > 0) & accepted(rules, F.col("d2"), ea, eb, F.greatest, F.least)
        leaf_a, leaf_b = F.size("a_kids") == 0, F.size("b_kids") == 0
        pair = Pair(F.col("a"), F.col("b"), F.col("d2"), ea, eb, leaf_a, leaf_b, ok, different, select)
        policy = rules.policy or default_policy
        action, tag = policy(pair)
        back, back_tag = policy(pair.swapped()) if rules.policy and not cross else (action, tag)
        action = F.when(action == back, action).otherwise(REFINE)
        if cross and not rules.policy:
            action = F.when(leaf_a & leaf_b & ~ok, NEAR).otherwise(action)
        rows = keep(rows.withColumns({"action": action.cast("long"), "tag": tag.cast("long"), "back_tag": back_tag.cast("long")}))
        bad = (F.col("action") == NEAR) & ~(leaf_a & leaf_b) | (F.col("action") == REFINE) & leaf_a & leaf_b & different
        if rules.policy and not rows.where(bad).isEmpty():
            raise ValueError("a policy must name leaf pairs near or accept them, and name no other pair near")
        if number or roots is not None:
            forget(frontier)
        done = rows.where(F.col("action") != REFINE).select("a", "b", "action", "tag", "back_tag", F.lit(number).cast("long").alias("round"))
        going = rows.where(F.col("action") == REFINE)
        count = going.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(REFINE).cast("long").alias("action"), F.col("n").alias("tag"), F.lit(0).cast("long").alias("back_tag"), F.lit(number).cast("long").alias("round")).where("tag > 0")
        part = done.unionByName(count)
        out = part if out is None else out.unionByName(part)
        same = ~different
        both = same & ~leaf_a
        split_a = ~same & ~leaf_a & (leaf_b | (ea >= eb))
        split_b = ~same & ~leaf_b & ~split_a
        pair_of = lambda p, q: F.struct(p.alias("a"), q.alias("b"))
        inner = F.flatten(F.transform("a_kids", lambda p: F.transform(F.filter("a_kids", lambda q: q >= p), lambda q: pair_of(p, q))))
        down_a = F.transform("a_kids", lambda p: pair_of(p, F.col("b")))
        down_b = F.transform("b_kids", lambda q: pair_of(F.col("a"), q))
        nxt = F.when(both, inner).when(split_a, down_a).when(split_b, down_b)
        new = going.select(F.explode(nxt).alias("n")).select("n.a", "n.b")
        frontier = keep(new if cross else new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        if frontier.isEmpty():
            return out
        number += 1


@dataclass
class Walk:
    """far(target, source, tag), near(target, source), and pairs(a, b, action, ...), each pair once."""

    pairs: DataFrame
    cross: bool

    @property
    def far(self) -> DataFrame:
        rows = self.pairs.where(F.col("action") == ACCEPT)
        one = rows.select(F.col("a").alias("target"), F.col("b").alias("source"), "tag")
        return one if self.cross else one.unionByName(rows.select(F.col("b").alias("target"), F.col("a").alias("source"), F.col("back_tag").alias("tag")))

    @property
    def near(self) -> DataFrame:
        rows = self.pairs.where(F.col("action") == NEAR)
        one = rows.select(F.col("a").alias("target"), F.col("b").alias("source"))
        return one if self.cross else one.unionByName(rows.select(F.col("b").alias("target"), F.col("a").alias("source")))

    @property
    def stats(self) -> DataFrame:
        """accepted, near and refined pairs, each counted once, and rounds."""
        n = lambda k, c=1: F.coalesce(F.sum(F.when(F.col("action") == k, c)), F.lit(0)).cast("long")
        return self.pairs.agg(n(ACCEPT).alias("accepted"), n(NEAR).alias("near"), n(REFINE, F.col("tag")).alias("refined"), (F.max("round") + 1).alias("rounds"))


def walk(nodes: DataFrame, geom: DataFrame, rules: Rules | None = None, sources: tuple[DataFrame, DataFrame] | None = None, broadcast_nodes: int = NODES, roots: DataFrame | None = None) -> Walk:
    """A tree against itself, or against the tree `sources` (nodes, geom): ordered (target, source) pairs then. With
    roots (a, b), the nodes are those of many trees, and the walk starts at these pairs of roots."""
    rules = rules or Rules()
    t = keep(mac_nodes(nodes, geom, rules))
    s = keep(mac_nodes(*sources, rules)) if sources else None
    few = t.count() + (s.count() if s is not None else 0) <= broadcast_nodes
    return Walk(keep((in_tasks if few else by_rounds)(t, s, rules, roots)), sources is not None)
