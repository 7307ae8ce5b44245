"""Removal of repeated passages: column-wise construction of a collection's BWT and common prefixes.

A byte goes if it is covered by a string of LENGTH bytes that also starts elsewhere, in the same document or another.

Suffixes of the whole corpus needn't be sorted in one place, as only prefixes of LENGTH bytes matter. Every window of
LENGTH bytes belongs to its least gram of GRAM bytes (by hash). Neighbouring windows with the same least gram form a
segment, so equal windows lie in segments of the same gram, wherever they start. Segments of one gram are a bucket:

1. Copies of one segment enter as one string that counts as often as it occurs (by a digest of 128 bits, with partial
   aggregation, so a passage in a third of all rows is no hot key). All windows of a string that counts twice or more
   are repeats. A gram seen once holds none.
2. The strings of a bucket form a collection, several small buckets one together. Its transform is built column by
   column from the right: each round inserts one symbol of every document, by LF mapping, into the Burrows-Wheeler
   transform, and updates the longest common prefixes (up to LENGTH) from range minima of the last round. A symbol is a
   word of WORD bytes, so a string is read as WORD documents, one for each place of the first word; a collection then
   takes a WORD-th of the rounds. A window is a repeat if its suffix shares LENGTH bytes with a neighbour: nothing else
   decides. Windows whose 64-bit hash occurs once in the collection can't be repeats and are left out beforehand.
   Columns over SPILL_BYTES are written and read sequentially, as files in the shared folder.
3. A bucket of more than HOT strings is split by a longer gram: the bytes that all windows have in common whose first
   gram lies in the same range of places, 64 wide. Equal windows have equal places and equal such bytes. Parts are
   strings of buckets of their own, which are counted and compared as above; those still larger are split again, by
   ranges of 16, 4 and 1. No window is ever counted by itself before its bucket has been split four times.

Joins with tables that grow with the corpus are sort-merge joins at every size; nothing but models of fixed size is
broadcast.

Null texts count as empty; texts shorter than LENGTH keep all bytes; very long texts are cut in segments like others.
Repeated rows repeat each other's windows, so they lose them all. Rows are told apart by doc_id and text, so rows that
repeat a doc_id, or have none, but differ in their texts lose only what each of them repeats. Order has no effect.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchpoint.llm.common import bound_batches, column, forget, keep, map_batches, shared_folder, table

LENGTH = 200
GRAM = 24
#: Bytes of a symbol at most.
WORD = 8
#: Windows of a segment at most.
RUN = 256
#: Strings of a bucket that meet in one task, and the places that further grams hold together when it has more.
HOT = 1024
PLACES = (64, 16, 4, 1)
#: Bytes of the buckets compared at once, bytes of a column in memory.
BATCH = 1 << 21
SPILL_BYTES = 8 << 20
#: Neighbours of which the least common prefix is kept.
BLOCK = 64

_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(b: np.ndarray, length: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of all strings of `length` bytes, by doubling."""
    out, done = None, 0
    power, width, h = np.uint64(factor), 1, _BYTES[b]
    with np.errstate(over="ignore"):
        while True:
            if length & width:
                if out is None:
                    out, done = h[: len(b) - length + 1 + (length - width)], width
                    at_power = power
                else:
                    out = out[: len(b) - done - width + 1] + at_power * h[done : done + len(b) - done - width + 1]
                    at_power = at_power * power
                    done += width
            if width * 2 > length:
                break
            h = h[:-width] + power * h[width:]
            power = power * power
            width *= 2
        out = out[: len(b) - length + 1]
        out = out ^ (out >> np.uint64(32))
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    size, m = 1, h
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - size :]) if size < width else m


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Of every segment: least gram (long), digest (two longs), start, windows, whether the gram repeats in these data."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    b = np.frombuffer(data, np.uint8)
    h = rolling(b, gram)
    m = least(h, length - gram + 1)
    start = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
    windows = np.diff(np.append(start, len(m)))
    if windows.max() > run:
        parts = -(-windows // run)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, windows = np.repeat(start, parts) + nth * run, np.repeat(windows, parts) - nth * run
        windows = np.minimum(windows, run)
    key = m[start]
    small = np.sort(h[h <= key.max()])
    tied = np.searchsorted(small, key, "right") - np.searchsorted(small, key, "left") > 1
    kind = np.frombuffer(b"".join(digest(data[a:e]) for a, e in zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True)), np.int64).reshape(-1, 2)
    return key.view(np.int64), kind, start, windows, tied


def parts_of(data: bytes, key: int, places: int, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, bytes]]:
    """(first window, one past the last, longer gram) of the parts of a segment whose least gram is key.

    A window's place is how far after its start its first such gram stands. Windows of a part have the same first gram
    and places in one range; the longer gram is what all windows have in common whose place is in that range.
    """
    b = np.frombuffer(data, np.uint8)
    found = np.flatnonzero(rolling(b, gram).view(np.int64) == key)
    start = np.arange(len(b) - length + 1)
    x = found[np.searchsorted(found, start)]
    nth = (x - start) // places
    edge = np.flatnonzero((x[1:] != x[:-1]) | (nth[1:] != nth[:-1])) + 1
    first = [0, *edge.tolist()]
    # A range reaches up to length - gram, so the last one may hold fewer places and have more in common.
    out = []
    for a, e in zip(first, [*edge.tolist(), len(start)], strict=True):
        low = int(nth[a]) * places
        high = min(low + places, length - gram + 1) - 1
        common = int(x[a]) - low
        out.append((a, e, digest(low.to_bytes(4, "little") + data[common : common + length - (high - low)])))
    return out


class Store:
    """A column: in memory, or in a sequential file of the shared folder when it is large."""

    def __init__(self, spill: int, folder: str | None):
        self.spill, self.folder, self.held, self.path = spill if folder else 1 << 62, folder, None, None

    def files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, x: np.ndarray) -> None:
        old = self.path
        self.held, self.path = x, None
        if x.nbytes > self.spill:
            system, root = self.files()
            system.create_dir(root, recursive=True)
            self.path, self.kind, self.held = f"{root}/{uuid.uuid4().hex}", x.dtype, None
            with system.open_output_stream(self.path) as file:
                file.write(memoryview(x).cast("B"))
        if old:
            self.files()[0].delete_file(old)

    def read(self) -> np.ndarray:
        if self.held is not None:
            return self.held
        with self.files()[0].open_input_stream(self.path) as file:
            return np.frombuffer(file.read(), self.kind)

    def drop(self) -> None:
        if self.path:
            self.files()[0].delete_file(self.path)
            self.path = None


def range_minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) of every range, none of them empty. x has one entry more than any range reaches."""
    out = np.empty(len(lo), x.dtype)
    far = hi - lo > 4 * BLOCK

    def direct(a: np.ndarray, e: np.ndarray) -> np.ndarray:
        by = np.argsort(a)
        pairs = np.empty(2 * len(a), np.int64)
        pairs[::2], pairs[1::2] = a[by], e[by]
        found = np.empty(len(a), x.dtype)
        found[by] = np.minimum.reduceat(x, pairs)[::2]
        return found

    if not far.all():
        out[~far] = direct(lo[~far], hi[~far])
    if far.any():
        lo, hi = lo[far], hi[far]
        whole = len(x) // BLOCK
        table = [x[: whole * BLOCK].reshape(whole, BLOCK).min(axis=1)]
        while 2 << (len(table) - 1) <= whole:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        a, e = -(-lo // BLOCK), hi // BLOCK
        level = np.log2(e - a).astype(np.int64)
        middle = np.empty(len(lo), x.dtype)
        for n in np.unique(level).tolist():
            at = level == n
            middle[at] = np.minimum(table[n][a[at]], table[n][e[at] - (1 << n)])
        ends = np.minimum(direct(lo, np.maximum(a * BLOCK, lo + 1)), direct(np.minimum(e * BLOCK, hi - 1), hi))
        out[far] = np.minimum(middle, ends)
    return out


def transform(codes: np.ndarray, length: np.ndarray, cap: int, spill: int = SPILL_BYTES, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The BWT of a collection (0: a document's beginning), common prefixes with the suffix before (at most cap), and the
    order of its symbols, from which LF steps follow.

    codes: the symbols of all documents, from 1; length: symbols of each document.
    """
    n = len(length)
    end, kind = np.cumsum(length), np.uint8 if cap < 255 else np.uint16
    # A place in the BWT and its symbol, as one number: sorted, these are the symbols' places one symbol after the other.
    bits = max(1, int(len(codes) + n).bit_length())
    mask = np.int64((1 << bits) - 1)
    places, lcp = Store(spill, folder), Store(spill, folder)
    symbol = np.zeros(n, np.int64)
    full = length > 0
    symbol[full] = codes[end[full] - 1]
    places.write(np.sort((symbol << bits) | np.arange(n)))
    lcp.write(np.zeros(n + 1, kind))  # one more, so that ranges may end after the last
    active = at = np.flatnonzero(full)
    c, j = symbol[full], 0
    while len(active):
        j += 1
        held, lc = places.read(), lcp.read()
        finished = int(np.searchsorted(held, np.int64(1) << bits))
        mine = (c << bits) | at
        by = np.argsort(mine)
        i = np.empty(len(by), np.int64)
        i[by] = np.searchsorted(held, mine[by])
        new = n + i - finished
        # Neighbours in the new order that start with the same symbol, and the range minima between their tails.
        before, after = held[np.maximum(i - 1, 0)], held[np.minimum(i + 1, len(held) - 1)]
        has_before = (i > 0) & (before >> bits == c)
        has_after = (i + 1 < len(held)) & (after >> bits == c)
        lo = np.concatenate(((before[has_before] & mask) + 1, at[has_after] + 1))
        hi = np.concatenate((at[has_before] + 1, (after[has_after] & mask) + 1))
        common = np.minimum(range_minima(lc, lo, hi), cap - 1) + 1 if len(lo) else np.zeros(0, kind)
        k = int(has_before.sum())
        left = length[active] > j
        more = np.zeros(len(active), np.int64)
        more[left] = codes[end[active[left]] - j - 1]
        # Old places move behind the new ones before them; the new symbols join the places of their kind.
        size = len(held) + len(active)
        old = np.ones(size, bool)
        old[new] = False
        moved = (held & ~mask) | np.flatnonzero(old)[held & mask]
        fresh = np.sort((more << bits) | new)
        put = np.searchsorted(moved, fresh) + np.arange(len(fresh))
        behind = np.ones(size, bool)
        behind[put] = False
        held = np.empty(size, np.int64)
        held[behind], held[put] = moved, fresh
        l2 = np.zeros(size + 1, kind)
        l2[:-1][old] = lc[:-1]
        l2[new] = 0
        l2[new[has_before]] = common[:k]
        l2[new[has_after] + 1] = common[k:]
        places.write(held)
        lcp.write(l2)
        active, at, c = active[left], new[left], more[left]
    held, lc = places.read(), lcp.read()
    places.drop()
    lcp.drop()
    order = held & mask
    b = np.empty(len(held), np.int64)
    b[order] = held >> bits
    return b, lc, order


def repeated(strings: list[bytes], length: int = LENGTH, spill: int = SPILL_BYTES, folder: str | None = None) -> list[np.ndarray]:
    """For each string, which of its windows of `length` bytes also start elsewhere in the collection."""
    size = np.array([len(x) for x in strings], np.int64)
    windows = np.maximum(0, size - length + 1)
    ends = np.cumsum(np.concatenate(([0], windows)))
    flat = np.zeros(ends[-1], bool)
    word = next(w for w in (8, 4, 2, 1) if w <= WORD and length % w == 0)
    # Document f of a string holds its words from byte f on, one after the other.
    shift = np.tile(np.arange(word), len(strings))
    which = np.repeat(np.arange(len(strings)), word)
    n = np.where(windows[which] > shift, (size[which] - shift) // word, 0)
    which, shift, n = which[n > 0], shift[n > 0], n[n > 0]
    if not len(n):
        return [flat[a:e] for a, e in zip(ends, ends[1:], strict=False)]
    data = b"".join(strings)
    first = (np.cumsum(size) - size)[which] + shift
    offset = np.repeat(first, n) + word * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    views = [np.frombuffer(data, f"<u{word}", (len(data) - f) // word, f) for f in range(word)] if len(data) >= word else []
    every = np.zeros(len(data), f"<u{word}")
    for f, view in enumerate(views):
        every[f::word][: len(view)] = view
    used, codes = np.unique(every[offset], return_inverse=True)
    b, lcp, order = transform(codes.astype(np.int64) + 1, n, length // word, spill, folder)
    place = np.empty(len(b), np.int64)
    place[order] = np.arange(len(b))
    step = len(n) + place - int(np.count_nonzero(b == 0))
    again = np.maximum(lcp[:-1], lcp[1:]) >= length // word
    at, doc = np.arange(len(n)), np.arange(len(n))
    for done in range(int(n.max()) + 1):
        if done >= length // word:
            flat[ends[which[doc]] + shift[doc] + word * (n[doc] - done)] = again[at]
        go = n[doc] > done
        at, doc = step[at[go]], doc[go]
    return [flat[a:e] for a, e in zip(ends, ends[1:], strict=False)]


def seen_twice(h: np.ndarray) -> np.ndarray:
    """Which of the numbers occur more than once."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.empty(len(h), bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return out


def pieces_of(strings: list[bytes], length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    """(string, first window, bytes) of the runs of windows that may repeat, as their hashes occur more than once."""
    size = np.array([len(x) for x in strings])
    data = b"".join(strings)
    windows = size - length + 1
    first = np.cumsum(windows) - windows
    nth = np.arange(windows.sum()) - np.repeat(first, windows)
    who = np.repeat(np.arange(len(strings)), windows)
    begin = np.repeat(np.cumsum(size) - size, windows) + nth
    maybe = seen_twice(rolling(np.frombuffer(data, np.uint8), length)[begin])
    edge = np.flatnonzero((maybe[1:] != maybe[:-1]) | (who[1:] != who[:-1])) + 1
    a, e = np.concatenate(([0], edge)), np.concatenate((edge, [len(maybe)]))
    a, e = a[maybe[a]], e[maybe[a]]
    return [(w, lo, data[x : y + length]) for w, lo, x, y in zip(who[a].tolist(), nth[a].tolist(), begin[a].tolist(), begin[e - 1].tolist(), strict=True)]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and one past the last of every run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


class Collection:
    """Strings of several buckets whose windows are decided together."""

    def __init__(self, length: int = LENGTH, batch: int = BATCH, spill: int = SPILL_BYTES, folder: str | None = None):
        self.length, self.batch, self.spill, self.folder = length, batch, spill, folder
        self.held: list[tuple] = []
        self.bytes = 0

    def add(self, rows: list[tuple[tuple | None, bytes]]) -> Iterator[tuple]:
        """A whole bucket: (what to return with a repeat; None for strings that count twice anyway, bytes)."""
        for w, lo, data in pieces_of([data for _, data in rows], self.length):
            self.held.append((rows[w][0], lo, data))
            self.bytes += len(data)
        if self.bytes >= self.batch:
            yield from self.result()

    def result(self) -> Iterator[tuple]:
        """(row, first window, one past the last) of runs of repeats."""
        if any(row is not None for row, *_ in self.held):
            for (row, lo, _), mask in zip(self.held, repeated([data for *_, data in self.held], self.length, self.spill, self.folder), strict=True):
                if row is not None:
                    yield from ((row, lo + a, lo + e) for a, e in runs(mask))
        self.held, self.bytes = [], 0


NAME = ["id", "mark"]
RANGES = "id long, mark long, lo long, hi long"
STRING = "gram long, key long, n long, id long, mark long, start long, data binary"


def compare(strings: DataFrame, length: int, batch: int, spill: int) -> DataFrame:
    """Repeats among the strings of each bucket. strings: as STRING; those with n > 1 are known to be repeats."""
    folder = shared_folder(strings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Collection(length, batch, spill, folder)
        bucket: list[tuple] = []
        last = None

        def out(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            rows = [(*row[:2], row[2] + a, row[2] + e - 1 + length) for row, a, e in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["id", "mark", "lo", "hi"])

        for b in batches:
            for key, n, *row, data in zip(*(column(b, c).to_pylist() for c in ("key", "n", "id", "mark", "start", "data")), strict=True):
                if key != last and bucket:
                    yield from out(work.add(bucket))
                    bucket = []
                last = key
                bucket.append((row if n == 1 else None, data))
        if bucket:
            yield from out(work.add(bucket))
        yield from out(work.result())

    bound_batches(strings.sparkSession)
    near = strings.repartition("key").sortWithinPartitions("key")
    return near.select("key", "n", "id", "mark", "start", "data").mapInArrow(run, RANGES)


def split(strings: DataFrame, places: int, length: int, gram: int) -> DataFrame:
    """The parts of strings by a longer gram: as STRING, with the digest (one, two) of the part."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for g, n, id_, mark, start, data in zip(*(column(batch, c).to_pylist() for c in ("gram", "n", "id", "mark", "start", "data")), strict=True):
            for a, e, longer in parts_of(data, g, places, length, gram):
                part = data[a : e - 1 + length]
                one, two = np.frombuffer(digest(longer + part), np.int64).tolist()
                rows.append((g, int.from_bytes(longer[:8], "little", signed=True), n, id_, mark, start + a, part, one, two))
        kinds = [pa.int64()] * 6 + [pa.binary()] + [pa.int64()] * 2
        names = ["gram", "key", "n", "id", "mark", "start", "data", "one", "two"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names)

    return map_batches(strings, cut, f"{STRING}, one long, two long")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, batch: int = BATCH, spill: int = SPILL_BYTES) -> list[DataFrame]:
    """Byte ranges to remove, [lo, hi), which may overlap, as kept tables. docs: id, mark, text; rows equal in id and mark are equal."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for id_, mark, text in zip(*(column(b, c).to_pylist() for c in ("id", "mark", "text")), strict=True):
            key, kind, start, windows, tied = segments((text or "").encode("utf-8", "surrogatepass"), length, gram)
            if len(key):
                parts.append((key, kind[:, 0], kind[:, 1], np.full(len(key), id_), np.full(len(key), mark), start, windows.astype(np.int32), tied))
        if not parts:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["gram", "one", "two", "id", "mark", "start", "windows", "tied"])

    every = keep(map_batches(docs, cut, "gram long, one long, two long, id long, mark long, start long, windows int, tied boolean"))
    kind = ["gram", "one", "two"]
    classes = keep(every.groupBy(*kind).agg(F.count("*").alias("n"), F.max(F.col("tied").cast("int")).alias("tied"), *(F.first(c).alias(c) for c in ("id", "mark", "start", "windows"))))
    grams = classes.groupBy("gram").agg(F.sum("n").alias("total"), F.max("tied").alias("any_tied"), F.count("*").alias("strings"), F.min("n").alias("least_n")).where("total > 1 OR any_tied = 1")
    known = keep(classes.drop("tied").join(grams.hint("merge"), "gram"))
    forget(classes)
    # Strings that count twice or more: every occurrence is a repeat as a whole.
    found = [keep(every.join(known.where("n > 1").select(*kind).hint("merge"), kind).select(*NAME, F.col("start").alias("lo"), (F.col("start") + F.col("windows") + length - 1).alias("hi")).distinct())]
    forget(every)
    # The others need their bytes, and so do those that they may share windows with.
    asked = known.where("least_n = 1 AND (strings > 1 OR any_tied = 1)")
    places = asked.groupBy(*NAME).agg(F.collect_set(F.struct("gram", "n", "start", "windows", (F.col("strings") > hot).alias("hot"))).alias("places"))

    def fetch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for id_, mark, text, places in zip(*(column(b, c).to_pylist() for c in ("id", "mark", "text", "places")), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for p in places:
                rows.append((p["gram"], p["gram"], p["n"], id_, mark, p["start"], data[p["start"] : p["start"] + p["windows"] + length - 1], p["hot"]))
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], ["gram", "key", "n", "id", "mark", "start", "data", "hot"])

    texts = docs.dropDuplicates(NAME).join(places.hint("merge"), NAME)
    strings = keep(map_batches(texts, fetch, f"{STRING}, hot boolean"))
    forget(known)
    found.append(keep(compare(strings.where("NOT hot").drop("hot"), length, batch, spill)))
    done, strings = [strings], strings.where("hot").drop("hot")
    for width in PLACES:
        if strings.isEmpty():
            break
        parts = keep(split(strings, width, length, gram))
        kind = ["key", "one", "two"]
        classes = keep(parts.groupBy(*kind).agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("gram", *NAME, "start", "data"))))
        found.append(keep(parts.where("n = 1").join(classes.where("n > 1").select(*kind).hint("merge"), kind).select(*NAME, F.col("start").alias("lo"), (F.col("start") + F.length("data")).alias("hi"))))
        buckets = classes.groupBy("key").agg(F.count("*").alias("strings"), F.min("n").alias("least_n")).where("strings > 1 AND least_n = 1")
        strings = keep(classes.join(buckets.hint("merge"), "key").select(*(x.split()[0] for x in STRING.split(", ")), (F.col("strings") > hot).alias("hot")))
        found.append(keep(compare(strings.where("NOT hot").drop("hot"), length, batch, spill)))
        done += [parts, classes, strings]
        strings = strings.where("hot").drop("hot")
    forget(*done)
    return found


def with_ranges(docs: DataFrame, length: int, gram: int, hot: int, batch: int, spill: int) -> DataFrame:
    """docs with a column __ranges of the ranges to remove."""
    named = docs.withColumns({"__id": F.coalesce(docs["doc_id"].cast("long"), F.lit(0)), "__mark": F.xxhash64(docs["doc_id"].isNull(), docs["text"])})
    plain = named.select(F.col("__id").alias("id"), F.col("__mark").alias("mark"), "text")
    parts = repeats(plain, length, gram, hot, batch, spill)
    found = keep(reduce(DataFrame.unionByName, parts).groupBy(*NAME).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))).toDF("__id", "__mark", "__ranges")
    forget(*parts)
    return named.join(found.hint("merge"), ["__id", "__mark"], "left").drop("__id", "__mark")


def remove(data: bytes, ranges: list[dict] | None) -> tuple[bytes, int]:
    """The bytes left, and the number of maximal removed runs."""
    out, at, spans = [], 0, 0
    end = 0
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
        if lo >= len(data):
            break
        if lo > end or not spans:
            spans += 1
        if lo > at:
            out.append(data[at:lo])
        end = at = max(at, min(hi, len(data)))
    return b"".join([*out, data[at:]]), spans


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, batch: int = BATCH, spill: int = SPILL_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, ranges in zip(column(batch, "text").to_pylist(), column(batch, "__ranges").to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            left, spans = remove(data, ranges)
            rows.append((len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest()))
        a, b, c, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return map_batches(with_ranges(plain, length, gram, hot, batch, spill), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages removed from `text`; a character that loses a byte goes as a whole; null stays null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None or not r else remove(t.encode("utf-8", "surrogatepass"), r)[0].decode("utf-8", "ignore") for t, r in zip(column(batch, "text").to_pylist(), column(batch, "__ranges").to_pylist(), strict=True)]
        batch = batch.drop_columns(["__ranges"])
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    joined = with_ranges(docs, length, GRAM, HOT, BATCH, SPILL_BYTES)
    return map_batches(joined.select(*docs.columns, "__ranges"), run, docs.schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
