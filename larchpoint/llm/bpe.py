"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut where a boundary of the pre-tokenizer pattern is certain (before a space that follows a visible
character), and the pattern's matches are pre-tokens; what stands on either side of these cuts is encoded alone. Every
pre-token is halved recursively down to LEAF_BYTES bytes, one by default. Two encoded neighbours are joined by
re-encoding a window around their boundary. The window grows until both tokens next to it are stable: a pair of tokens
is stable if encoding its bytes gives back that pair, and a sequence in which every neighbouring pair is stable is the
encoding of its bytes. Windows are encoded by own merges, lowest rank first. Decoding concatenates the tokens' bytes up
a tree of FAN branches.

The pattern's character classes are those of the library that the vocabulary file is for: it is asked once for all
code points that a class holds, so every version of it is matched, whatever Unicode tables it has.

Nulls encode as empty texts, empty texts as no token; very long pre-tokens cost O(n log n); repeated rows and ties
have no effect, as every text is encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larchpoint.llm.common import column, map_batches, table, texts_of

#: Bytes of a leaf of the tree, and branches of the tree that decodes.
LEAF_BYTES = 1
FAN = 16
#: Entries of each of a worker's memories of what it has encoded, which are emptied when full, and the bytes of parts
#: of pre-tokens that are remembered.
MEMORY = 400_000
SUBTREE_BYTES = 10
#: Bytes from which a window is merged with a heap.
LONG = 64
#: Characters of the texts that are encoded together.
GROUP_CHARS = 1 << 20
#: Longer chunks aren't remembered.
REMEMBERED_CHARS = 48


def ranks_from_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def ranks_from_json(path: str) -> tuple[dict[bytes, int], dict[tuple[int, int], tuple[int, int]], dict[str, int]]:
    """Of a tokenizers file with a byte-level BPE: ids by bytes, (rank, id) by pair of ids, ids of the special strings."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {x["content"]: x["id"] for x in data["added_tokens"]}
    vocab = {token: n for token, n in data["model"]["vocab"].items() if token not in special}
    merges = {}
    for rank, pair in enumerate(data["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a], vocab[b]] = rank, vocab[a + b]
    return {bytes(byte_of[c] for c in token): n for token, n in vocab.items()}, merges, special


def held_by_tiktoken(kind: str, every: str) -> str:
    import tiktoken

    plain = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(plain.encode_ordinary(every)).decode()  # what the pattern doesn't match is passed over


def held_by_tokenizers(kind: str, every: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    return "".join(x for x, _ in pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(every))


@lru_cache(maxsize=16)
def ranges(kind: str, held_by: Callable[[str, str], str]) -> str:
    """The characters of a class, such as a general category, as ranges for a set of Python's re."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    c = np.frombuffer(held_by(kind, every).encode("utf-32-le"), "<u4")
    first = np.concatenate(([True], np.diff(c) != 1))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(c[first].tolist(), c[np.append(first[1:], True)].tolist(), strict=True))


def own_pattern(pattern: str, held_by: Callable[[str, str], str]) -> str:
    """The pattern with its classes spelled out."""
    out, inside = [], False
    for m in re.finditer(r"\\p\{\w+\}|\\[sS]|\\.|.", pattern, re.DOTALL):
        x = m[0]
        if x == r"\S":
            out.append(f"[^{ranges(chr(92) + 's', held_by)}]")
        elif x == r"\s" or x.startswith(r"\p"):
            out.append(ranges(x, held_by) if inside else f"[{ranges(x, held_by)}]")
        else:
            inside = (inside or x == "[") and x != "]"
            out.append(x)
    return "".join(out)


class Codec:
    """Encodes texts to ids, kept as little-endian unsigned 32-bit integers, and decodes them. A chunk is what stands
    between two certain cuts; chunks are remembered, so a frequent one is encoded once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: dict[tuple[int, int], tuple[int, int]] | None = None, special: dict[str, int] | None = None, leaf_bytes: int = LEAF_BYTES):
        """merges: (rank, id) of the pairs of ids that merge; without it, any two tokens merge whose bytes are a token."""
        held_by = held_by_tiktoken if merges is None else held_by_tokenizers
        blank = ranges(r"\s", held_by)
        self.cut, self.blanks = re.compile(f"(?<=[^{blank}])(?= )"), re.compile(f"[{blank}] ")
        self.special = special or {}
        self.special_ids = {x: struct.pack("<I", n) for x, n in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.leaf, self.ranks, self.merges, self.every_pair = max(1, leaf_bytes), ranks, merges or {}, merges is None
        self.pattern = re.compile(own_pattern(pattern, held_by))
        if self.pattern.groups:
            raise ValueError("the pattern must have no groups that capture")
        self.token_bytes: list[bytes] = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, n in ranks.items():
            self.token_bytes[n] = token
        for token, n in self.special.items():
            self.token_bytes[n] = token.encode()
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.known: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.subtrees: dict[bytes, tuple[int, ...]] = {}
        self.joins = 0

    # -- merges

    def merged(self, a: int, b: int) -> tuple[int, int] | None:
        """Rank and id of what two tokens merge to."""
        found = self.merges.get((a, b), 0)
        if found == 0:
            if not self.every_pair:
                return None
            n = self.ranks.get(self.token_bytes[a] + self.token_bytes[b])
            found = None if n is None else (n, n)
            if len(self.merges) >= 4 * MEMORY:
                self.merges.clear()
            self.merges[a, b] = found
        return found

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of the bytes of a window: the leftmost pair of the lowest rank merges, until none can."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > LONG:
            return self.merge_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = self.merged(ids[i], ids[i + 1])
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return tuple(ids)

    def merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap of pairs."""
        after, before, heap = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)], []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.merged(ids[i], ids[after[i]])) is not None:
                heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]], found[1]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return tuple(x for x in ids if x >= 0)

    def window(self, data: bytes) -> tuple[int, ...]:
        if (found := self.windows.get(data)) is None:
            found = self.merge(data)
            if len(data) <= REMEMBERED_CHARS:
                if len(self.windows) >= MEMORY:
                    self.windows.clear()
                self.windows[data] = found
        return found

    # -- the tree over one pre-token

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token, or of a part of one."""
        size = len(data)
        if size <= self.leaf:
            return self.window(data)
        if size > SUBTREE_BYTES:
            half = size // 2
            return self.join(self.piece(data[:half]), self.piece(data[half:]))
        if (found := self.subtrees.get(data)) is None:
            half = size // 2
            found = self.join(self.piece(data[:half]), self.piece(data[half:]))
            if len(self.subtrees) >= MEMORY:
                self.subtrees.clear()
            self.subtrees[data] = found
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the bytes of left and right together, both being encodings."""
        self.joins += 1
        spelled, stable = self.token_bytes, self.stable
        window = self.window(spelled[left[-1]] + spelled[right[0]])
        more_left = len(left) > 1 and not stable(left[-2], window[0])
        more_right = len(right) > 1 and not stable(window[-1], right[1])
        a = b = 1
        while more_left or more_right:
            a = min(len(left), 2 * a) if more_left else a
            b = min(len(right), 2 * b) if more_right else b
            window = self.window(b"".join([spelled[x] for x in left[-a:]] + [spelled[x] for x in right[:b]]))
            more_left = a < len(left) and not stable(left[-a - 1], window[0])
            more_right = b < len(right) and not stable(window[-1], right[b])
        return left[: len(left) - a] + window + right[b:]

    def stable(self, one: int, two: int) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        found = self.window(self.token_bytes[one] + self.token_bytes[two])
        return len(found) == 2 and found[0] == one

    # -- texts

    def unknown(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that aren't remembered."""
        out = []
        for chunk in chunks:
            found = []
            for x in self.pattern.findall(chunk):
                if (ids := self.pretokens.get(x)) is None:
                    numbers = self.piece(x.encode())
                    ids = struct.pack(f"<{len(numbers)}I", *numbers)
                    if len(x) <= REMEMBERED_CHARS:
                        if len(self.pretokens) >= MEMORY:
                            self.pretokens.clear()
                        self.pretokens[x] = ids
                found.append(ids)
            out.append(b"".join(found))
        return out

    def chunks(self, text: str) -> list[str]:
        if self.blanks.search(text):
            return self.cut.split(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def parts(self, text: str) -> list[str]:
        """A text's chunks, and the special strings in it."""
        if self.at_special is None or not self.at_special.search(text):
            return self.chunks(text)
        return [y for x in self.at_special.split(text) for y in ([x] if x in self.special else self.chunks(x))]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; strings of special tokens stand for their ids if the codec has any."""
        out, first = [], 0
        while first < len(texts):
            last, chars = first, 0
            while last < len(texts) and (last == first or chars + len(texts[last]) <= GROUP_CHARS):
                chars += len(texts[last])
                last += 1
            cut = [self.parts(x) for x in texts[first:last]]
            if len(self.known) > MEMORY:
                self.known = {}
            ids = [list(map(self.known.get, x)) for x in cut]
            holes = [(row, i, x[i]) for x, row in zip(cut, ids, strict=True) if None in row for i, y in enumerate(row) if y is None]
            asked = list({x for *_, x in holes}.difference(self.special))
            found = dict(zip(asked, self.unknown(asked), strict=True)) | self.special_ids
            for row, i, x in holes:
                row[i] = found[x]
            out += [b"".join(row) for row in ids]
            self.known.update((x, y) for x, y in found.items() if len(x) <= REMEMBERED_CHARS)
            first = last
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        parts = [self.token_bytes[x] for x in ids]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
        return parts[0] if parts else b""


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """A worker's codec for a vocabulary file, made once: files that end in .json are for tokenizers, others for tiktoken."""
    if path.endswith(".json"):
        ranks, merges, special = ranks_from_json(path)
        return Codec(ranks, pattern, merges, special)
    return Codec(ranks_from_tiktoken(path), pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>: each text's token ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary, pattern)
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode_many(texts_of(batch))]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(plain, run, "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, data binary: the bytes of each row's ids (null: none)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary, pattern)
        data = [c.decode(x or []) for x in column(batch, "ids").to_pylist()]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    plain = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids"))
    return map_batches(plain, run, "doc_id long, data binary").withColumnRenamed("doc_id", id_col)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document: token count, digest of the ids, digest of the bytes decoded from the ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(vocabulary, pattern)
        counts, ids_sha, bytes_sha = [], [], []
        for packed in c.encode_many(texts_of(batch)):
            ids = np.frombuffer(packed, "<u4").tolist()
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            bytes_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return map_batches(plain, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
