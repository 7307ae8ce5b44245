"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

A document is the set of its distinct word shingles. One permutation (sigma) maps a shingle to 32 bits; a second one
(pi), applied to the value shifted circularly by k, gives coordinate k of the signature. So two permutations generate
all ROWS x BANDS coordinates. Equal sets are one node. Nodes that share a band are candidates:

1. In every band's group the smallest node is compared with all others (a star, linear in the group).
2. Connected components of the confirmed links are found.
3. Stars that still hold nodes of several components are compared in full: two nodes that share a band share its
   smallest node, so they are in its star. First by signatures, in blocks of about SIGNATURE_BLOCK nodes: only nodes
   go on whose signature is close to one of another component. Their sets are compared in blocks of about STAR_BLOCK
   nodes: a task counts the common shingles of two blocks by matrix products, and only links that join components are
   emitted, at most one for each node. No pair is cut off.

Links are confirmed on whole sets, computed from whole texts. Verification deals the members of a hub over salted
groups, each with a copy of the hub's text, so no task holds a large group.

All joins are sort-merge joins at every size: Spark takes hubs dealt over salts for as small as they were before, and
would build tables of them in the driver that don't fit there.

Null texts and texts without words have an empty set and are linked with nothing. With fewer words than a shingle has,
the sequence of words is one shingle. Rows without doc_id take no part and are their own component (null). Rows that
repeat a doc_id count as one document with several texts: what one of them is linked with, all are, empty texts
included. The component's id is its smallest doc_id, so ties can't arise. A banding miss has probability below 1e-7 for
a link at the threshold (32 bands of 4 rows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchpoint.llm.common import bound_batches, column, forget, keep, map_batches, table

BANDS, ROWS = 32, 4
#: Rows of a hub's bands for which there is one group of members, tasks that a star's rows are dealt over.
SALT = 1024
STAR_SALTS = 64
#: Nodes of a star compared together, by signatures and by sets; shingles of one matrix.
SIGNATURE_BLOCK = 384
STAR_BLOCK = 256
#: How far below the similarity the share of equal coordinates of a link may lie.
MARGIN = 0.25
FEATURES = 4096
SHINGLE_WORDS = 5
#: Similarity as a fraction of integers.
SIMILAR = (80, 100)
MEMORY = 300_000
BLOCK = 1 << 15

_known: dict[bytes, int] = {}


def word_hash(word: bytes) -> int:
    h = _known.get(word)
    if h is None:
        if len(_known) >= MEMORY:
            _known.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            _known[word] = h
    return h


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(word_hash, words), np.uint64, len(words))
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS * ROWS minima for each set, none of them empty."""
    k = BANDS * ROWS
    out = np.full((len(sets), k), 0xFFFFFFFF, np.uint32)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= BLOCK):
            total += len(sets[last])
            last += 1
        sigma = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(x) for x in sets[first : last - 1])])
        x, y = np.empty_like(sigma), np.empty_like(sigma)
        for i in range(k):
            np.add(sigma, np.uint32(i), out=x)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[first:last, i] = np.minimum.reduceat(x, starts)
        first = last
    return out


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, print (128 bits of the set, null if empty), sig array<int>."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = [shingles(x, n) for x in column(batch, "text").to_pylist()]
        sig = iter(signatures([x for x in every if len(x)]).view(np.int32)) if any(map(len, every)) else iter(())
        prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in every]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(map(len, every), pa.int64()), pa.array(prints, pa.binary()), pa.array([next(sig) if len(x) else None for x in every], pa.list_(pa.int32()))], ["doc_id", "n_shingles", "print", "sig"])

    return map_batches(docs, run, "doc_id long, n_shingles long, print binary, sig array<int>")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stars of nodes that share a band: (hub, id, salt) of their members, and (hub, salt) of all groups of members.

    A hub's groups follow from the rows of its bands, at most BANDS for each hub, so members never meet by hub.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, ROWS)))
    bands = nodes.select("id", F.explode(keys).alias("band"))
    shared = keep(bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("n")).where("hub < last").drop("last"))
    groups = keep(shared.groupBy("hub").agg(F.ceil(F.sum("n") / SALT).cast("long").alias("salts")))
    at = shared.select("band", "hub").join(groups.hint("merge"), "hub")
    members = bands.join(at.hint("merge"), "band").where("id <> hub")
    members = keep(members.select("hub", "id", F.pmod(F.xxhash64("id"), "salts").alias("salt")).distinct())
    return members, groups.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))


def verify(pairs: DataFrame, groups: DataFrame, texts: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (hub, id) whose sets are similar enough. pairs and groups: from candidates(); texts: id, text."""
    members = pairs.join(texts.hint("merge"), "id").select("hub", "salt", "id", "text")
    there = groups.join(pairs.select("hub", "salt").distinct().hint("merge"), ["hub", "salt"])
    hubs = there.join(texts.withColumnRenamed("id", "hub").hint("merge"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("id"), "text")
    both = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("id").asc_nulls_first())
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            for hub, salt, id_, text in zip(*(column(batch, c).to_pylist() for c in ("hub", "salt", "id", "text")), strict=True):
                if (hub, salt) != key:
                    key, held = (hub, salt), []
                mine = shingles(text, n)
                if id_ is None:
                    held.append(mine)
                    continue
                for other in held:
                    small, large = sorted((len(mine), len(other)))
                    if small and similar[1] * small >= similar[0] * large:
                        same = len(np.intersect1d(mine, other, assume_unique=True))
                        if similar[1] * same >= similar[0] * (small + large - same):
                            found.append((hub, id_))
                            break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["hub", "id"])

    return both.mapInArrow(run, "hub long, id long")


def dealt(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """rows (hub, id, ...) with the columns of their hub; a hub's rows are dealt over STAR_SALTS tasks."""
    salted = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(STAR_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(STAR_SALTS)).cast("int")).join(salted.hint("merge"), ["hub", "salt"]).drop("salt")


def open_stars(tested: DataFrame, labels: DataFrame) -> DataFrame:
    """hub, id, label, n of all nodes of the stars that hold nodes of several components, the hubs among them."""
    tested = tested.select("hub", "id")
    rows = keep(labelled(tested.unionByName(tested.select("hub", F.col("hub").alias("id")).distinct()), labels))
    several = rows.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    return dealt(rows, several.select("hub", "n"))


def in_blocks(stars: DataFrame, size: int) -> DataFrame:
    """Each row of a star for every pair of blocks it is in: own block, and the blocks i <= j that a task compares."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    rows = stars.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return rows.select("hub", "id", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def by_blocks(both: DataFrame, value: str, compare) -> DataFrame:
    """hub, id from compare(rows of two blocks: id, label, whether in the first, value; whether it is one block)."""
    both = both.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    bound_batches(both.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> list[pa.RecordBatch]:
            found = [x if len(x) == 2 else (key[0], *x) for x in compare(held, key[1] == key[2])] if held else []
            return [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["hub", "id"])] if found else []

        for batch in batches:
            for *at, id_, label, own, x in zip(*(column(batch, c).to_pylist() for c in ("hub", "i", "j", "id", "label", "own", value)), strict=True):
                if at != key:
                    yield from out()
                    key, held = at, []
                held.append((id_, label, own == key[1], x))
        yield from out()

    return both.select("hub", "i", "j", "id", "label", "own", value).mapInArrow(run, "hub long, id long")


def promising(stars: DataFrame, nodes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The rows of stars with a node of another component in their star whose signature is close enough: MARGIN below
    the share of equal coordinates that a link has on average, so that no link in 10^9 is lost."""
    least = BANDS * ROWS * (similar[0] / similar[1] - MARGIN)

    def compare(rows: list[tuple], inside: bool) -> list[tuple[int]]:
        sig, label = np.array([r[3] for r in rows], np.int32), np.array([r[1] for r in rows])
        first = np.array([r[2] for r in rows])
        a, b = (np.flatnonzero(first), np.flatnonzero(first if inside else ~first))
        same = np.zeros((len(a), len(b)), np.uint8 if sig.shape[1] < 256 else np.uint16)
        for c in range(sig.shape[1]):
            same += sig[a, c][:, None] == sig[b, c]
        close = (same >= least) & (label[a][:, None] != label[b])
        return [(rows[x][0],) for x in {*a[close.any(axis=1)].tolist(), *b[close.any(axis=0)].tolist()}]

    rows = in_blocks(stars, SIGNATURE_BLOCK).join(nodes.select("id", "sig").hint("merge"), "id")
    return by_blocks(rows, "sig", compare).distinct()


def compare_stars(stars: DataFrame, texts: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """Links between components within a star. A star is cut into blocks; a task compares two blocks, or one in itself."""

    def compare(rows: list[tuple], inside: bool) -> list[tuple[int, int]]:
        return between([(*r[:3], shingles(r[3], n)) for r in rows], inside, similar)

    return by_blocks(in_blocks(stars, STAR_BLOCK).join(texts.hint("merge"), "id"), "text", compare)


def between(rows: list[tuple], inside: bool, similar: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join the components of rows (id, label, whether in the first block, set): enough to connect all that
    are linked, not every one."""
    rows = [r for r in rows if len(r[3])]
    if len({r[1] for r in rows}) < 2:
        return []
    sizes = np.array([len(r[3]) for r in rows], np.float32)
    _, feature, times = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(rows)), sizes.astype(np.int64))
    several = times[feature] > 1
    feature, who = feature[several], who[several]
    names = np.cumsum(times > 1)
    feature = names[feature] - 1
    order = np.argsort(feature, kind="stable")
    feature, who = feature[order], who[order]
    same = np.zeros((len(rows), len(rows)), np.float32)
    total = int(feature[-1]) + 1 if len(feature) else 0
    for lo in range(0, total, FEATURES):
        a, b = np.searchsorted(feature, [lo, lo + FEATURES])
        part = np.zeros((len(rows), min(FEATURES, total - lo)), np.float32)
        part[who[a:b], feature[a:b] - lo] = 1
        same += part @ part.T
    union = sizes[:, None] + sizes - same
    label, first = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    linked = (similar[1] * same.astype(np.float64) >= similar[0] * union.astype(np.float64)) & (label[:, None] != label)
    if not inside:
        linked &= first[:, None] & ~first
    parent = {int(x): int(x) for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(*np.nonzero(linked), strict=True):
        a, b = root(int(label[x])), root(int(label[y]))
        if a != b:
            parent[a] = b
            out.append((min(rows[x][0], rows[y][0]), max(rows[x][0], rows[y][0])))
    return out


def components(links: DataFrame) -> DataFrame:
    """id, label: for every node of the links the smallest node it is connected with (alternating large and small stars)."""
    edges = keep(links.select(F.greatest("hub", "id").alias("u"), F.least("hub", "id").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # Large star: every node passes its smallest neighbour to its larger ones.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: and to its smaller ones, itself included.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, keep(small)
        forget(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        state = tuple(now)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their id, by default the id itself."""
    return rows.join(labels.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    every = keep(sets(docs, n))
    nodes = keep(every.where("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    rows = keep(every.select("doc_id", "n_shingles", "print").join(nodes.select("print", "id").hint("merge"), "print", "left").drop("print"))
    forget(every)
    # Texts of one doc_id belong together: all its nodes are linked with the least, and its empty texts go with them.
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("id").isNull()).alias("empty")).where("lo < hi OR empty AND lo IS NOT NULL")
    several = keep(several.select("doc_id", "lo"))
    own = rows.where("id IS NOT NULL").join(several.hint("merge"), "doc_id").where("id <> lo").select(F.col("lo").alias("hub"), "id").distinct()
    tested, groups = candidates(nodes)
    # Texts of all candidates, once; by sorting at every size, as the candidates grow with the corpus.
    ids = tested.select(F.explode(F.array("hub", "id")).alias("doc_id")).distinct()
    texts = keep(docs.join(ids.hint("merge"), "doc_id").select(F.col("doc_id").alias("id"), "text").distinct())
    links = keep(verify(tested, groups, texts, n, similar).unionByName(own))
    labels = components(links)
    stars = keep(open_stars(tested, labels))
    near = keep(promising(stars, nodes, similar))
    if not near.isEmpty():
        some = near.groupBy("hub").agg(F.count("*").alias("n"))
        chosen = dealt(stars.drop("n").join(near.hint("merge"), ["hub", "id"]), some)
        more = keep(compare_stars(chosen, texts, n, similar))
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    forget(tested, texts, stars, near, nodes)
    rows = rows.join(several.hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("id", "lo").alias("id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return labelled(rows, labels).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2)


#: The same rows in DuckDB, by all pairs that share a shingle, where no doc_id repeats.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT g, row_number() OVER () AS g_id FROM (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
t AS (SELECT doc_id, g_id FROM s JOIN k USING (g)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM t a JOIN t b ON a.g_id = b.g_id AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, coalesce(m.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
