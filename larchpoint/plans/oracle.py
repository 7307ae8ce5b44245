"""The same results in DuckDB's SQL, written independently of the DataFrame plans."""

from __future__ import annotations

import itertools

from larchpoint.functions.morton import TOP
from larchpoint.operators.moments import all_indices, name

_STEPS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))

EMB = "pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z, CAST(1 + label AS DOUBLE) mass FROM embeddings)"
EVENTS = """raw AS (SELECT event_id AS id, CAST(user_id AS DOUBLE) x, CAST(value AS DOUBLE) y, CAST(epoch_us(ts) AS DOUBLE) z FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL),
pts AS (SELECT id, (x - (SELECT min(x) FROM raw)) / ((SELECT max(x) FROM raw) - (SELECT min(x) FROM raw)) x, (y - (SELECT min(y) FROM raw)) / ((SELECT max(y) FROM raw) - (SELECT min(y) FROM raw)) y, (z - (SELECT min(z) FROM raw)) / ((SELECT max(z) FROM raw) - (SELECT min(z) FROM raw)) z, CAST(1 AS DOUBLE) mass FROM raw)"""
PARTS = "pts AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) x, CAST(0 AS DOUBLE) y, CAST(0 AS DOUBLE) z, CAST(p_retailprice AS DOUBLE) mass FROM part)"
CLOUDS = {"emb": EMB, "events": EVENTS, "parts": PARTS}


#: Macros can't be defined in a query, so bit interleaving goes step by step through columns.
def interleave(source: str, out: str, x: str, y: str, z: str) -> str:
    """CTEs that add column code to a table from integer coordinates."""
    steps = [f"{out}_0 AS (SELECT *, ({x}) & {TOP} AS ix, ({y}) & {TOP} AS iy, ({z}) & {TOP} AS iz FROM {source})"]
    for n, (s, m) in enumerate(_STEPS, 1):
        cols = ", ".join(f"((i{a} | ((i{a} & {m >> s}) << {s})) & {m}) AS i{a}" for a in "xyz")
        steps.append(f"{out}_{n} AS (SELECT * EXCLUDE (ix, iy, iz), {cols} FROM {out}_{n - 1})")
    steps.append(f"{out} AS (SELECT * EXCLUDE (ix, iy, iz), ix + 2 * iy + 4 * iz AS code FROM {out}_{len(_STEPS)})")
    return ",\n".join(steps)


def deinterleave(source: str, out: str, code: str = "code") -> str:
    """CTEs that add columns jx, jy, jz of a code."""
    masks = [TOP, *(m for _, m in _STEPS)]
    steps = [f"{out}_0 AS (SELECT *, ({code}) & {masks[-1]} AS jx, (({code}) >> 1) & {masks[-1]} AS jy, (({code}) >> 2) & {masks[-1]} AS jz FROM {source})"]
    for n, ((s, _), m) in enumerate(zip(reversed(_STEPS), reversed(masks[:-1]), strict=True), 1):
        cols = ", ".join(f"((j{a} | (j{a} >> {s})) & {m}) AS j{a}" for a in "xyz")
        steps.append(f"{out}_{n} AS (SELECT * EXCLUDE (jx, jy, jz), {cols} FROM {out}_{n - 1})")
    steps.append(f"{out} AS (SELECT * FROM {out}_{len(_STEPS)})")
    return ",\n".join(steps)


BOX = "box AS (SELECT " + ", ".join(f"min({a}) - greatest(CAST(0.05 AS DOUBLE) * (max({a}) - min({a})), CAST(1e-6 AS DOUBLE)) {a}0, max({a}) + greatest(CAST(0.05 AS DOUBLE) * (max({a}) - min({a})), CAST(1e-6 AS DOUBLE)) {a}1" for a in "xyz") + " FROM pts)"


def grid(a: str) -> str:
    return f"CAST(round_even(least(greatest(({a} - {a}0) / ({a}1 - {a}0), CAST(0 AS DOUBLE)), CAST('0.9999999999999999' AS DOUBLE)) * CAST({TOP} AS DOUBLE), 0) AS BIGINT)"


def coded(cloud: str) -> str:
    return f"{CLOUDS[cloud]},\n{BOX},\npb AS (SELECT * FROM pts, box),\n" + interleave("pb", "cd", grid("x"), grid("y"), grid("z"))


def bucketed(cloud: str, leaf: int) -> str:
    return coded(cloud) + f""",
bk AS (SELECT *, pos // {leaf} AS leaf FROM (SELECT id, x, y, z, mass, code, row_number() OVER (ORDER BY code, id) - 1 AS pos FROM cd)),
lv AS (SELECT leaf, min(code) AS code, min(pos) AS lo, max(pos) AS hi FROM bk GROUP BY leaf)"""


def hierarchy(source: str = "lv") -> str:
    """nd(node_id, parent, lft, rgt, is_leaf, level, first, last, lo, hi) over leaves (leaf, code, lo, hi)."""
    return f"""
nl AS (SELECT count(*) AS n FROM {source}),
dl AS (SELECT leaf AS s, CASE WHEN code <> nxt THEN 64 - length(bin(xor(code, nxt))) ELSE 128 - length(bin(xor(leaf, leaf + 1))) END AS d
       FROM (SELECT leaf, code, lead(code) OVER (ORDER BY leaf) AS nxt FROM {source}) WHERE nxt IS NOT NULL),
it0 AS (SELECT a.s, coalesce((SELECT max(t.s) FROM dl t WHERE t.s < a.s AND t.d < a.d) + 1, 0) AS first,
              coalesce((SELECT min(t.s) FROM dl t WHERE t.s > a.s AND t.d < a.d), (SELECT n - 1 FROM nl)) AS last FROM dl a),
rg AS (SELECT s, first, last FROM it0 UNION ALL SELECT NULL, leaf, leaf FROM {source}),
rg2 AS (SELECT r.*, coalesce(l.d, -1) AS dleft, coalesce(h.d, -1) AS dright FROM rg r LEFT JOIN dl l ON l.s = r.first - 1 LEFT JOIN dl h ON h.s = r.last),
rg3 AS (SELECT s, first, last, CASE WHEN first = 0 AND last = n - 1 THEN NULL WHEN dright > dleft THEN last ELSE first - 1 END AS ps,
         CASE WHEN first = 0 AND last = n - 1 THEN 0 WHEN s IS NULL THEN n - 1 + first WHEN dright > dleft THEN last ELSE first END AS node_id, n FROM rg2, nl),
nd AS (SELECT r.node_id, coalesce(p.node_id, -1) AS parent,
         CASE WHEN r.s IS NULL THEN -1 WHEN r.s = r.first THEN r.n - 1 + r.s ELSE r.s END AS lft,
         CASE WHEN r.s IS NULL THEN -1 WHEN r.s + 1 = r.last THEN r.n + r.s ELSE r.s + 1 END AS rgt,
         r.s IS NULL AS is_leaf,
         (SELECT count(*) FROM it0 u WHERE u.first <= r.first AND u.last >= r.last AND u.last - u.first > r.last - r.first) AS level,
         r.first, r.last, a.lo, b.hi
       FROM rg3 r LEFT JOIN rg3 p ON p.s = r.ps JOIN {source} a ON a.leaf = r.first JOIN {source} b ON b.leaf = r.last)"""


GEOM = """
gm AS (SELECT node_id, cx, cy, cz, hx, hy, hz, sqrt(hx * hx + hy * hy + hz * hz) AS radius, greatest(hx, hy, hz) AS max_extent FROM (
  SELECT node_id, (min(x) + max(x)) * 0.5::DOUBLE AS cx, (min(y) + max(y)) * 0.5::DOUBLE AS cy, (min(z) + max(z)) * 0.5::DOUBLE AS cz,
    greatest((max(x) - min(x)) * 0.5::DOUBLE, 1e-6::DOUBLE) AS hx, greatest((max(y) - min(y)) * 0.5::DOUBLE, 1e-6::DOUBLE) AS hy, greatest((max(z) - min(z)) * 0.5::DOUBLE, 1e-6::DOUBLE) AS hz
  FROM nd JOIN bk ON bk.pos BETWEEN nd.lo AND nd.hi GROUP BY node_id))"""


def tree(cloud: str, leaf: int) -> str:
    return bucketed(cloud, leaf) + "," + hierarchy() + "," + GEOM


def criterion(kind: str, theta: float, scale: float = 1.0) -> tuple[str, str]:
    """(extent column, acceptance of pairs t, s with d2)."""
    t2 = repr(theta * theta) + "::DOUBLE"
    if kind == "engblom":
        root = repr((theta * theta) ** 0.5) + "::DOUBLE"
        left = f"(greatest(t.ext, s.ext) + {root} * least(t.ext, s.ext))"
        return "radius", f"{left} * {left} <= {t2} * d2"
    if kind == "mutual":
        return "max_extent", f"{t2} * d2 > (t.ext + s.ext) * (t.ext + s.ext)"
    return ("radius" if kind == "dehnen" else "max_extent"), f"(t.ext + s.ext) * (t.ext + s.ext) <= {t2} * d2"


D2 = "((t.cx - s.cx) * (t.cx - s.cx) + (t.cy - s.cy) * (t.cy - s.cy)) + (t.cz - s.cz) * (t.cz - s.cz)"


def walk(kind: str, theta: float) -> str:
    """pr(a, b, ok, refined): all pairs of the walk."""
    ext, ok = criterion(kind, theta)
    ok = ok.replace("d2", f"({D2})")
    good = f"(t.node_id <> s.node_id AND ({D2}) > 0 AND {ok})"
    leaf = "(t.lft < 0 AND s.lft < 0 AND t.node_id <> s.node_id)"
    return f""",
wn AS (SELECT nd.node_id, lft, rgt, {ext} AS ext, cx, cy, cz FROM nd JOIN gm USING (node_id)),
w AS (
  SELECT CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, 0 AS round
  UNION ALL
  SELECT least(k.p, k.q), greatest(k.p, k.q), round + 1 FROM (
    SELECT w.round, unnest(CASE
      WHEN t.node_id = s.node_id AND t.lft < 0 THEN []
      WHEN t.node_id = s.node_id THEN [{{'p': t.lft, 'q': t.lft}}, {{'p': t.lft, 'q': t.rgt}}, {{'p': t.rgt, 'q': t.rgt}}]
      WHEN t.lft >= 0 AND (s.lft < 0 OR t.ext >= s.ext) THEN [{{'p': t.lft, 'q': s.node_id}}, {{'p': t.rgt, 'q': s.node_id}}]
      ELSE [{{'p': t.node_id, 'q': s.lft}}, {{'p': t.node_id, 'q': s.rgt}}] END) AS k
    FROM w JOIN wn t ON t.node_id = w.a JOIN wn s ON s.node_id = w.b WHERE NOT {good} AND NOT {leaf})
),
pr AS (SELECT w.a, w.b, w.round, {good} AS ok, NOT {good} AND NOT {leaf} AS refined, t.ext AS text, s.ext AS sext FROM w JOIN wn t ON t.node_id = w.a JOIN wn s ON s.node_id = w.b)"""


def cell_walk(kind: str, theta: float) -> str:
    """pr(a, b, ok, refined): all pairs of the walk over cells with up to 8 children, from op (parents) and ob (boxes)."""
    ext, ok = criterion(kind, theta)
    ok = ok.replace("d2", f"({D2})")
    good = f"(t.node_id <> s.node_id AND ({D2}) > 0 AND {ok})"
    leaf = "(len(t.kids) = 0 AND len(s.kids) = 0 AND t.node_id <> s.node_id)"
    size = "greatest(hx, hy, hz)" if ext == "max_extent" else "sqrt(hx * hx + hy * hy + hz * hz)"
    return f""",
wn AS (SELECT oct_id AS node_id, coalesce(kids, []) AS kids, {size} AS ext, cx, cy, cz FROM ob LEFT JOIN (SELECT parent AS oct_id, list(oct_id ORDER BY oct_id) AS kids FROM op GROUP BY parent) USING (oct_id)),
w AS (
  SELECT (SELECT min(oct_id) FROM ob) AS a, (SELECT min(oct_id) FROM ob) AS b, 0 AS round
  UNION ALL
  SELECT least(k.p, k.q), greatest(k.p, k.q), round + 1 FROM (
    SELECT w.round, unnest(CASE
      WHEN t.node_id = s.node_id THEN flatten(list_transform(t.kids, lambda x: list_transform(list_filter(t.kids, lambda y: y >= x), lambda y: {{'p': x, 'q': y}})))
      WHEN len(t.kids) > 0 AND (len(s.kids) = 0 OR t.ext >= s.ext) THEN list_transform(t.kids, lambda x: {{'p': x, 'q': s.node_id}})
      ELSE list_transform(s.kids, lambda y: {{'p': t.node_id, 'q': y}}) END) AS k
    FROM w JOIN wn t ON t.node_id = w.a JOIN wn s ON s.node_id = w.b WHERE NOT {good} AND NOT {leaf})
),
pr AS (SELECT w.a, w.b, w.round, {good} AS ok, NOT {good} AND NOT {leaf} AS refined, t.ext AS text, s.ext AS sext FROM w JOIN wn t ON t.node_id = w.a JOIN wn s ON s.node_id = w.b)"""


def recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


FAR = "SELECT a AS target, b AS source FROM pr WHERE ok UNION ALL SELECT b, a FROM pr WHERE ok"
NEAR = "SELECT a AS target, b AS source FROM pr WHERE NOT ok AND NOT refined UNION ALL SELECT b, a FROM pr WHERE NOT ok AND NOT refined"


def central(order: int, digits: int = 5) -> str:
    """Moments about the centre of mass, straight from the points, rounded."""
    term = lambda m: " * ".join(["mass", *("(x - comx)",) * m[0], *("(y - comy)",) * m[1], *("(z - comz)",) * m[2]])
    sums = ", ".join(f"round(sum({term(m)}), {digits}) + 0 AS {name(m)}" for m in all_indices(order))
    return f"""SELECT node_id, {sums} FROM (
  SELECT nd.node_id, x, y, z, mass, sum(mass * x) OVER w / sum(mass) OVER w AS comx, sum(mass * y) OVER w / sum(mass) OVER w AS comy, sum(mass * z) OVER w / sum(mass) OVER w AS comz
  FROM nd JOIN bk ON bk.pos BETWEEN nd.lo AND nd.hi WINDOW w AS (PARTITION BY nd.node_id)) GROUP BY node_id"""


def stf(order: int, digits: int = 4) -> str:
    """Components of the trace-free tensor of order 3 or 4, from moments by name: traces are spelled out as sums."""
    of = lambda i: "m" + "".join(str(i.count(a)) for a in (0, 1, 2))
    trace = lambda i: "(" + " + ".join(of((*i, a, a)) for a in (0, 1, 2)) + ")"
    out = []
    for i in (x for x in itertools.product((0, 1, 2), repeat=order) if list(x) == sorted(x)):
        minus = [trace(tuple(x for n, x in enumerate(i) if n not in pair)) for pair in itertools.combinations(range(order), 2) if i[pair[0]] == i[pair[1]]]
        text = f"{2 * order - 1} * {of(i)}" if order == 3 else f"35 * {of(i)}"
        text += "".join(f" - {1 if order == 3 else 5} * {t}" for t in minus)
        if order == 4:
            both = sum(i[a] == i[b] and i[c] == i[d] for a, b, c, d in ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2)))
            text += f" + {both} * (m400 + m040 + m004 + 2 * m220 + 2 * m202 + 2 * m022)" if both else ""
        out.append(f"round({text}, {digits}) + 0 AS {'oh'[order - 3]}{''.join(map(str, i))}")
    return ", ".join(out)


CUBE = "cube AS (SELECT min(x) x0, min(y) y0, min(z) z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) * (1 + 1e-6::DOUBLE) AS span FROM pts)"


def placed(cloud: str, depth: int) -> str:
    at = lambda a: f"CAST(least(greatest(floor(({a} - {a}0) / span * {float(2**depth)}::DOUBLE), 0), {2**depth - 1}) AS BIGINT)"
    return f"{CLOUDS[cloud]},\n{CUBE},\npq AS (SELECT * FROM pts, cube),\n" + interleave("pq", "pl", at("x"), at("y"), at("z"))


def levels(depth: int) -> str:
    """uc(level, cell, n, jx, jy, jz) of occupied cells."""
    return f""",
lc AS (SELECT level, cell, count(*) AS n FROM (SELECT l AS level, code >> (3 * ({depth} - l)) AS cell FROM pl, range({depth + 1}) r(l)) GROUP BY level, cell),
""" + deinterleave("lc", "uc", "cell")


NUMBERED = """,
nc AS (SELECT *, row_number() OVER (ORDER BY level, cell) - 1 AS cell_id FROM uc)"""

TOUCH = "abs(a.jx - b.jx) <= 1 AND abs(a.jy - b.jy) <= 1 AND abs(a.jz - b.jz) <= 1"


def adaptive(depth: int, leaf: int, balance: bool) -> str:
    """ad(level, cell, n, is_leaf, jx, jy, jz, cell_id)."""
    out = f""",
s0 AS (SELECT u.level, u.cell FROM uc u LEFT JOIN uc p ON p.level = u.level - 1 AND p.cell = u.cell >> 3 WHERE u.level = 0 OR p.n > {leaf})"""
    for i in range(depth if balance else 0):
        out += f""",
{deinterleave(f"s{i}", f"j{i}", "cell")},
g{i} AS (SELECT DISTINCT level - 2 AS level, cell >> 6 AS cell FROM s{i} WHERE level > 1),
{deinterleave(f"g{i}", f"h{i}", "cell")},
c{i} AS (SELECT DISTINCT a.level, a.cell FROM j{i} a JOIN h{i} b ON a.level = b.level AND {TOUCH} AND a.cell <> b.cell
        WHERE a.level < {depth} AND NOT EXISTS (SELECT 1 FROM s{i} k WHERE k.level = a.level + 1 AND k.cell >> 3 = a.cell)),
s{i + 1} AS (SELECT level, cell FROM s{i} UNION SELECT level + 1, cell * 8 + o FROM c{i}, range(8) r(o))"""
    last = f"s{depth if balance else 0}"
    return out + f""",
ac AS (SELECT s.level, s.cell, coalesce(u.n, 0) AS n, NOT EXISTS (SELECT 1 FROM {last} k WHERE k.level = s.level + 1 AND k.cell >> 3 = s.cell) AS is_leaf,
       row_number() OVER (ORDER BY s.level, s.cell) - 1 AS cell_id FROM {last} s LEFT JOIN uc u ON u.level = s.level AND u.cell = s.cell),
{deinterleave("ac", "ad", "cell")}"""


#: Leaves of any two levels touch if the finer one's ancestor at the coarser level touches the coarser one.
ADAPTIVE_NEAR = """SELECT a.cell_id AS target, b.cell_id AS source FROM ad a JOIN ad b ON a.is_leaf AND b.is_leaf AND a.cell_id <> b.cell_id
  AND abs((a.jx >> CAST(greatest(a.level - b.level, 0) AS BIGINT)) - (b.jx >> CAST(greatest(b.level - a.level, 0) AS BIGINT))) <= 1
  AND abs((a.jy >> CAST(greatest(a.level - b.level, 0) AS BIGINT)) - (b.jy >> CAST(greatest(b.level - a.level, 0) AS BIGINT))) <= 1
  AND abs((a.jz >> CAST(greatest(a.level - b.level, 0) AS BIGINT)) - (b.jz >> CAST(greatest(b.level - a.level, 0) AS BIGINT))) <= 1"""


#: Octree cells o(code, d, oct_id) over bk, and f: leaf, its first and last code, and the depth of its cell.
OCTREE = """e AS (SELECT leaf, min(code) AS a, max(code) AS b FROM bk GROUP BY leaf),
f AS (SELECT *, CASE WHEN a = b THEN 21 ELSE (63 - length(bin(xor(a, b)))) // 3 END AS d FROM e), g AS (SELECT leaf, (a >> (63 - 3 * d)) << (63 - 3 * d) AS code, d, lead((a >> (63 - 3 * d)) << (63 - 3 * d)) OVER (ORDER BY leaf) AS nxt, lead(d) OVER (ORDER BY leaf) AS nd FROM f),
l AS (SELECT code, least(d, nd, CASE WHEN code = nxt THEN 21 ELSE (63 - length(bin(xor(code, nxt)))) // 3 END) AS d FROM g WHERE nxt IS NOT NULL),
u AS (SELECT code, d FROM g UNION SELECT (code >> (63 - 3 * d)) << (63 - 3 * d), d FROM l),
o AS (SELECT *, row_number() OVER (ORDER BY d, code) - 1 AS oct_id FROM u)"""

#: mp(node_id, oct_id): the deepest cell around all of a node's leaves.
TO_OCTREE = """,
mp AS (SELECT node_id, max_by(o.oct_id, o.d) AS oct_id FROM (SELECT nd.node_id, min(e.a) AS a, max(e.b) AS b FROM nd JOIN e ON e.leaf BETWEEN nd.first AND nd.last GROUP BY nd.node_id) n
  JOIN o ON (n.a >> (63 - 3 * o.d)) << (63 - 3 * o.d) = o.code AND (n.b >> (63 - 3 * o.d)) << (63 - 3 * o.d) = o.code GROUP BY node_id)"""


def decomposed(cloud: str, n: int) -> str:
    return coded(cloud) + f""",
so AS (SELECT id, x, y, z, mass, code, row_number() OVER (ORDER BY code, id) - 1 AS pos, count(*) OVER () AS total FROM cd),
dm AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos) - 1 AS local FROM (
  SELECT * EXCLUDE (total), CASE WHEN pos < (total % {n}) * (total // {n} + 1) THEN pos // (total // {n} + 1)
         ELSE total % {n} + (pos - (total % {n}) * (total // {n} + 1)) // (total // {n}) END AS domain FROM so))"""
