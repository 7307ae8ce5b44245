"""Packing documents into training sequences: shortest pack first over the histogram of lengths.

A document's ids, by the tokenizers library and with an end id, are cut into whole sequences and one rest. Lengths are
placed longest first, each into the open packs with the most room until none has room for it, then into new packs that
are filled with it. Only counts of packs with the same filling are updated, so the work on the driver depends on the sequence length and not on the number of documents. Pieces find
their place by their rank among the pieces of their length; ranks come from counts by task and length, so no length,
however frequent, meets in one task.

Nulls count as empty texts (one piece holding the end id), very long texts make many whole pieces, repeated rows are
packed each for itself, and no documents make no sequence. Ties between pieces of one length are resolved by the
order of the input.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larchpoint.llm.bpe import held_by_tokenizers, own_pattern, ranks_from_json
from larchpoint.llm.common import bound_batches, column, keep, table, texts_of

SEQUENCE = 2048
END_ID = 1


class Library:
    """Ids as the tokenizers library gives them. The merges run in a faster engine, with the vocabulary of the file and
    the character classes of that library; special strings in a text stand for their ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks, _, self.special = ranks_from_json(path)
        tokens = sorted(ranks, key=ranks.get)
        self.id_of = np.array([ranks[x] for x in tokens], "<u4")
        self.engine = tiktoken.Encoding("own", pat_str=own_pattern(pattern, held_by_tokenizers), mergeable_ranks={x: n for n, x in enumerate(tokens)}, special_tokens={})
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.at_special is None or not self.at_special.search(text):
            return self.id_of[np.array(self.engine.encode_ordinary(text), np.int64)].tobytes()
        return b"".join(np.array(self.special[x], "<u4").tobytes() if x in self.special else self.encode(x) for x in self.at_special.split(text))


@lru_cache(maxsize=2)
def library(path: str, pattern: str) -> Library:
    """A worker's tokenizer, made once."""
    return Library(path, pattern)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): where the pieces of each length go.

    The piece of rank r goes to sequence first sequence + r - first rank.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free ids of a pack -> (first sequence, number of packs)
    entries, next_sequence = [], 0

    def place(length: int, rank: int, first: int, count: int, free: int) -> None:
        entries.append((length, rank, rank + count - 1, first, size - free))
        if free > length:
            room.setdefault(free - length, []).append((first, count))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, rank = histogram[length], 0
        while left and room and (free := max(room)) >= length:
            groups = room.pop(free)
            while groups and left:
                first, count = groups.pop()
                used = min(left, count)
                if used < count:
                    groups.append((first + used, count - used))
                place(length, rank, first, used, free)
                left, rank = left - used, rank + used
            if groups:
                room[free] = groups + room.get(free, [])
        if left:
            # New packs take as many pieces as fit, one layer of pieces after the other; the last pack may get fewer.
            each = size // length
            packs, last = -(-left // each), (left - 1) % each + 1
            for nth in range(each):
                count = packs if nth < last else packs - 1
                if count:
                    entries.append((length, rank, rank + count - 1, next_sequence, nth * length))
                    rank += count
            for first, count, filled in ((next_sequence, packs - 1, each), (next_sequence + packs - 1, 1, last)):
                if count and size > filled * length:
                    room.setdefault(size - filled * length, []).append((first, count))
            next_sequence += packs
    return entries


def pieces(docs: DataFrame, vocabulary: str, pattern: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their rank among those of their length in the same task."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task, seen = library(vocabulary, pattern), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = c.encode(text) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    rows.append((task, doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, int(seen[length])))
                    seen[length] += 1
            names = ["task", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return plain.mapInArrow(run, "task long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long")


def pack(docs: DataFrame, vocabulary: str, pattern: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = keep(pieces(docs, vocabulary, pattern, size, end_id))
    counts = keep(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    entries = np.array(sorted(plan(histogram, size)), np.int64).reshape(-1, 5)
    lengths = entries[:, 0]
    # Ranks of all lengths on one line, for one binary search.
    first_rank = np.zeros(size + 2, np.int64)
    for length in range(1, size + 1):
        first_rank[length + 1] = first_rank[length] + histogram.get(length, 0)
    line = entries[:, 1] + first_rank[lengths] if len(entries) else np.zeros(0, np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((line, entries, first_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, entries, first_rank = sent.value
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "rank").to_numpy()
            found = entries[np.searchsorted(line, first_rank[length] + rank, "right") - 1]
            arrays = [column(batch, x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut.join(before.hint("merge"), ["task", "length"])  # the counts grow with the tasks, so they aren't broadcast
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
