"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, neighbouring words and words one apart of a text, hashed to HASH_BITS bits. Every
coordinate has its own learning rate, and L1 keeps most weights at zero, so the model is a short sorted list that is
broadcast. Training runs in one task over a bounded sample, TRAIN_ROWS labelled documents and TRAIN_BYTES bytes of
their grams, chosen by a hash of their id; scoring covers every whole text.

Null and empty texts get the score of the intercept; documents without a label can be scored but aren't learned from;
with labels of one class only, or none, the score is the smoothed share of toxic rows. Repeated rows are scored each
for itself; several labels of one document count each. Ties between equal scores need no order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchpoint.llm.common import column, map_batches, table, texts_of
from larchpoint.llm.langid import held_out

#: Bounds of the training sample.
TRAIN_ROWS = 16_000
TRAIN_BYTES = 192 << 20
HASH_BITS = 40
#: Features of fewer training documents are left at zero.
MIN_DOCS = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.1
THRESHOLD = 0.3
MEMORY = 300_000

_WORD = re.compile(r"\w+")
_known: dict[str, int] = {}


def word_hash(word: str) -> int:
    h = _known.get(word)
    if h is None:
        if len(_known) >= MEMORY:
            _known.clear()
        h = _known[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h


def features(text: str) -> np.ndarray:
    """Hashes of all grams of a text, repeated ones included."""
    words = _WORD.findall(text.lower())
    w = np.fromiter(map(word_hash, words), np.uint64, len(words))
    pair = lambda a, b, k: (a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    grams = np.concatenate((w, pair(w[:-1], w[1:], 1), pair(w[:-2], w[2:], 2)))
    grams *= np.uint64(0xD6E8FEB86659FD93)
    return grams >> np.uint64(64 - HASH_BITS)


def train(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes and weights of the coordinates that aren't zero, and the intercept."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    start = float(np.log(share / (1 - share)))
    empty = np.zeros(0, np.uint64), np.zeros(0), start
    if not len(labels) or labels.min() == labels.max():
        return empty
    keys, docs = np.unique(np.concatenate(rows), return_counts=True)
    keys = keys[docs >= min(MIN_DOCS, max(1, len(rows) // 50))]
    if not len(keys):
        return empty
    at = []
    for x in rows:
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        at.append(i[keys[i] == x])
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    bias, bias_n = start, 1.0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for d in order.permutation(len(rows)):
            i = at[d]
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-max(-35.0, min(35.0, bias + w.sum()))))
            g = p - labels[d]
            sigma = (np.sqrt(ni + g * g) - root) / ALPHA
            z[i] = zi + g - sigma * w
            n[i] = ni + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    used = np.flatnonzero(w)
    return keys[used], w[used], float(bias)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """docs: doc_id, text; labels: doc_id, toxic. Returns what train() does."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < (0.95 * train_rows / n if n > 0.95 * train_rows else 2.0)).limit(train_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # at most train_rows rows of two numbers

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [np.unique(features(x)).tobytes() for x in texts_of(batch)]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), pa.array(data, pa.binary())], ["doc_id", "toxic", "grams"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:  # in the order of the draw; what doesn't fit the bound is passed over
            for d, t, g in zip(*(column(b, c).to_pylist() for c in ("doc_id", "toxic", "grams")), strict=True):
                if size + len(g) <= train_bytes:
                    held.append((d, t, g))
                    size += len(g)
        held.sort()
        keys, w, bias = train([np.frombuffer(g, np.uint64) for *_, g in held], np.array([t for _, t, _ in held], float))
        yield pa.RecordBatch.from_arrays([pa.array([*keys.astype(np.int64), -1]), pa.array([*w, bias])], ["key", "weight"])

    out = map_batches(sample, grams, "doc_id long, toxic int, grams binary").repartition(1).sortWithinPartitions(draw, "doc_id", "toxic").mapInArrow(learn, "key long, weight double").toArrow()
    keys, w = out["key"].to_numpy(), out["weight"].to_numpy()
    bias = float(w[keys == -1][0]) if (keys == -1).any() else 0.0
    order = np.argsort(keys[keys != -1])
    return keys[keys != -1][order].astype(np.uint64), w[keys != -1][order], bias


def score_texts(texts: list[str], keys: np.ndarray, w: np.ndarray, bias: float, seen: np.ndarray) -> list[float]:
    mask = np.uint64(len(seen) - 1)
    out = []
    for text in texts:
        x = features(text)
        x = np.unique(x[seen[(x & mask).astype(np.int64)]])
        total = bias
        if len(x) and len(keys):
            i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            total += float(w[i[keys[i] == x]].sum())
        out.append(float(1 / (1 + np.exp(-max(-35.0, min(35.0, total))))))
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out (passed through), score, predicted."""
    keys, w, bias = model
    seen = np.zeros(1 << 18, bool)
    seen[(keys & np.uint64(len(seen) - 1)).astype(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast((keys, w, bias, seen))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array(score_texts(texts_of(batch), *sent.value), float)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(docs.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = held_out(docs["doc_id"], 4, 2)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), fold.alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels")
    model = fit(rows.where(~F.col("held_out")), labels.where(~held_out(labels["doc_id"], 4, 2)).select("doc_id", "toxic"))
    return score(rows, model)
