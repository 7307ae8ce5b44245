"""Masses, centres of mass and multipole moments of nodes, and their translation."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchpoint.operators.radix import over_leaves


def multi_indices(order: int) -> list[tuple[int, int, int]]:
    """(i, j, k) with i + j + k = order, i falling, then j."""
    return [(i, j, order - i - j) for i in range(order, -1, -1) for j in range(order - i, -1, -1)]


def all_indices(order: int) -> list[tuple[int, int, int]]:
    return [m for o in range(order + 1) for m in multi_indices(o)]


def level_size(order: int) -> int:
    return (order + 1) * (order + 2) // 2


def level_offset(order: int) -> int:
    return order * (order + 1) * (order + 2) // 6


def total_coefficients(order: int) -> int:
    return level_offset(order + 1)


def triangular_index(i: int, j: int, k: int) -> int:
    """Place of (i, j, k) among the packed coefficients of its order."""
    return multi_indices(i + j + k).index((i, j, k))


def index_factorial(m: tuple[int, int, int]) -> int:
    return factorial(m[0]) * factorial(m[1]) * factorial(m[2])


def name(m: tuple[int, int, int]) -> str:
    return "m" + "".join(map(str, m))


def power(v: tuple[Column, Column, Column], m: tuple[int, int, int]) -> Column | None:
    """x^i y^j z^k as products; None for 1."""
    out = None
    for x, n in zip(v, m, strict=True):
        for _ in range(n):
            out = x if out is None else out * x
    return out


def pack(columns: list[Column]) -> Column:
    return F.array(*columns)


def unpack(packed: Column, order: int) -> dict[str, Column]:
    """Columns by name from packed coefficients of orders up to `order`."""
    return {name(m): F.element_at(packed, i + 1) for i, m in enumerate(all_indices(order))}


def densify(packed: Column, order: int) -> Column:
    """The (order + 1)^3 coefficients in order of (i, j, k) from packed ones; 0 where i + j + k > order."""
    at = {m: n + 1 for n, m in enumerate(all_indices(order))}
    side = range(order + 1)
    return F.array(*(F.element_at(packed, at[i, j, k]) if (i, j, k) in at else F.lit(0.0) for i in side for j in side for k in side))


def from_dense(dense: Column, order: int) -> Column:
    """Packed coefficients from the dense ones of densify()."""
    w = order + 1
    return F.array(*(F.element_at(dense, (i * w + j) * w + k + 1) for i, j, k in all_indices(order)))


def packed_multipoles(bucketed: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """node_id, centre of mass, and the moments about it as one array, packed by order."""
    rows = multipoles(bucketed, nodes, order)
    return rows.select("node_id", "comx", "comy", "comz", pack([F.col(name(m)) for m in all_indices(order)]).alias("packed"))


def mass_moments(bucketed: DataFrame, nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """node_id, mass, comx, comy, comz; without mass the centre is 0. by: columns that tell trees apart."""
    sums = bucketed.groupBy(*by, "leaf").agg(F.sum("mass").alias("mass"), *(F.sum(F.col("mass") * F.col(a)).alias(f"s{a}") for a in "xyz"))
    total = over_leaves(nodes, sums, dict.fromkeys(("mass", "sx", "sy", "sz"), F.sum), by)
    return total.select(*by, "node_id", "mass", *(F.when(F.col("mass") != 0, F.col(f"s{a}") / F.col("mass")).otherwise(0.0).alias(f"com{a}") for a in "xyz"))


def raw_moments(bucketed: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """node_id and the sums of mass * x^i y^j z^k up to an order, about the origin."""
    v = (F.col("x"), F.col("y"), F.col("z"))
    term = lambda m: F.col("mass") if power(v, m) is None else F.col("mass") * power(v, m)
    names = [name(m) for m in all_indices(order)]
    sums = bucketed.groupBy("leaf").agg(*(F.sum(term(m)).alias(name(m)) for m in all_indices(order)))
    return over_leaves(nodes, sums, dict.fromkeys(names, F.sum))


def translated(order: int, delta: tuple[Column, Column, Column], source: str = "") -> dict[str, Column]:
    """Moments about a point from moments about another: delta is the old centre minus the new one."""
    out = {}
    for a in all_indices(order):
        total = None
        for b in all_indices(sum(a)):
            if all(y <= x for x, y in zip(a, b, strict=True)):
                c = comb(a[0], b[0]) * comb(a[1], b[1]) * comb(a[2], b[2])
                shift = power(delta, tuple(x - y for x, y in zip(a, b, strict=True)))  # type: ignore[arg-type]
                term = F.col(source + name(b)) * F.lit(float(c))
                term = term if shift is None else term * shift
                total = term if total is None else total + term
        out[name(a)] = total
    return out


def multipoles(bucketed: DataFrame, nodes: DataFrame, order: int, centres: DataFrame | None = None) -> DataFrame:
    """Moments about each node's centre of mass, or about given centres (node_id, x, y, z)."""
    if not 0 <= order <= 4:
        raise ValueError("order must be 0 to 4")
    raw = raw_moments(bucketed, nodes, max(order, 1))
    if centres is None:
        mass = F.col("m000")
        rows = raw.withColumns({f"com{a}": F.when(mass != 0, F.col(n) / mass).otherwise(0.0) for a, n in zip("xyz", ("m100", "m010", "m001"), strict=True)})
    else:
        rows = raw.join(centres.select("node_id", *(F.col(a).alias(f"com{a}") for a in "xyz")), "node_id")
    delta = tuple(-F.col(f"com{a}") for a in "xyz")
    moved = translated(order, delta)  # type: ignore[arg-type]
    return rows.select("node_id", "comx", "comy", "comz", *(c.alias(n) for n, c in moved.items()))


def from_children(moments: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """Moments of internal nodes about their centres, from their two children's moments."""
    names = [name(m) for m in all_indices(order)]
    links = nodes.where("NOT is_leaf").select("node_id", F.explode(F.array("left", "right")).alias("child"))
    child = moments.select(F.col("node_id").alias("child"), *(F.col(f"com{a}").alias(f"c{a}") for a in "xyz"), *(F.col(n).alias(f"c_{n}") for n in names))
    own = moments.select("node_id", "comx", "comy", "comz")
    rows = links.join(child, "child").join(own, "node_id")
    delta = tuple(F.col(f"c{a}") - F.col(f"com{a}") for a in "xyz")
    moved = translated(order, delta, "c_")  # type: ignore[arg-type]
    return rows.select("node_id", *(c.alias(n) for n, c in moved.items())).groupBy("node_id").agg(*(F.sum(n).alias(n) for n in names))


def trace_free(order: int) -> dict[str, Column]:
    """Symmetric trace-free tensors of order 2 to 4 over columns of central moments, by tensor component."""
    axis = {(i,): tuple(int(i == a) for a in range(3)) for i in range(3)}
    at = lambda *i: F.col(name(tuple(sum(axis[(x,)][a] for x in i) for a in range(3))))  # type: ignore[arg-type]
    same = lambda a, b: 1.0 if a == b else 0.0
    out = {}
    if order == 2:
        trace = at(0, 0) + at(1, 1) + at(2, 2)
        for i in range(3):
            for j in range(i, 3):
                out[f"q{i}{j}"] = 3.0 * at(i, j) - same(i, j) * trace
    elif order == 3:
        t = [at(i, 0, 0) + at(i, 1, 1) + at(i, 2, 2) for i in range(3)]
        for i in range(3):
            for j in range(i, 3):
                for k in range(j, 3):
                    out[f"o{i}{j}{k}"] = 5.0 * at(i, j, k) - (same(i, j) * t[k] + same(i, k) * t[j] + same(j, k) * t[i])
    elif order == 4:
        t = {(i, j): at(i, j, 0, 0) + at(i, j, 1, 1) + at(i, j, 2, 2) for i in range(3) for j in range(3)}
        tt = t[0, 0] + t[1, 1] + t[2, 2]
        for i in range(3):
            for j in range(i, 3):
                for k in range(j, 3):
                    for m in range(k, 3):
                        pairs = same(i, j) * t[k, m] + same(i, k) * t[j, m] + same(i, m) * t[j, k] + same(j, k) * t[i, m] + same(j, m) * t[i, k] + same(k, m) * t[i, j]
                        twice = same(i, j) * same(k, m) + same(i, k) * same(j, m) + same(i, m) * same(j, k)
                        out[f"h{i}{j}{k}{m}"] = 35.0 * at(i, j, k, m) - 5.0 * pairs + twice * tt
    else:
        raise ValueError("order must be 2, 3 or 4")
    return out
