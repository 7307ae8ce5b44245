"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, runs of other characters count as one space. The matrix of log probabilities has a row per
hash bucket and a column per language, and a prior that follows the languages' shares; it is broadcast (its size is fixed
by BUCKETS and MAX_LANGUAGES) and batches of texts are scored in numpy as sparse rows.

The model is fitted on a bounded sample, TRAIN_DOCS documents of each language; every text is scored whole. Every value
of lang is learned; more than MAX_LANGUAGES are an error, as none may be left out. Null texts and texts without a
letter are `und` with score 0, as is every text if nothing can be learned. Ties go to the first
language in alphabetical order. Repeated rows count and return as often as they occur.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from larchpoint.llm.common import column, map_batches, table

#: Hash buckets, orders of n-grams, additive smoothing.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Bound of the training sample: documents of each language.
TRAIN_DOCS = 1500
#: Bound of the matrix: languages that can be learned (128 MB of float32).
MAX_LANGUAGES = 512
#: n-grams scored at once.
BLOCK = 1 << 18


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 32 for all other characters."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> np.ndarray:
    """Buckets of a text's n-grams; none if it has no letter."""
    c = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = c == 32
    if blank.all():
        return np.zeros(0, np.int64)
    c = c[~(blank & np.concatenate(([True], blank[:-1])))]
    c = np.concatenate((np.array([32], np.uint32), c, np.array([32], np.uint32)) if c[-1] != 32 else (np.array([32], np.uint32), c))
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x85EBCA6B)
            out.append((x >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1))
    return np.concatenate(out)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the matrix of log probabilities and the log priors, from rows of text and lang."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    if not counts:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    langs = sorted(counts)
    prior = np.log(np.array([counts[x] for x in langs]) / sum(counts.values()))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / counts[lang]))])
    # Equal texts get equal numbers, so a large group of copies is in the sample as a whole or not at all: the id takes part.
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(F.col("lang").isin(langs)).where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0)))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = {}
        for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            total[lang] = total.get(lang, 0) + np.bincount(grams(text), minlength=BUCKETS)
        rows = [(lang, b, n[b]) for lang, n in total.items() for b in [np.flatnonzero(n)]]
        return pa.RecordBatch.from_arrays([pa.array([lang for lang, b, _ in rows for _ in range(len(b))]), pa.array(np.concatenate([b for _, b, _ in rows])), pa.array(np.concatenate([n for *_, n in rows]))], ["lang", "bucket", "n"])

    found = map_batches(sample.select("lang", "text"), count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((BUCKETS, len(langs)))
    at = {x: i for i, x in enumerate(langs)}
    n[found["bucket"].to_numpy(), [at[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    n += SMOOTHING
    return langs, np.log(n / n.sum(axis=0)).astype(np.float32), prior


def score_texts(texts: list[str | None], langs: list[str], logp: np.ndarray, prior: np.ndarray) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for text in texts:
        g = grams(text) if text and langs else ()
        if not len(g):
            names.append("und")
            scores.append(0.0)
            continue
        total = prior.copy()
        for i in range(0, len(g), BLOCK):
            total += logp[g[i : i + BLOCK]].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        names.append(langs[best])
        scores.append(float(1 / np.exp(total - total[best]).sum()))
    return names, scores


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """docs with columns lang_pred and score added; all columns of docs are kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = score_texts(column(batch, "text").to_pylist(), *sent.value)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    plain = docs.drop("lang_pred", "score")
    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_batches(plain, run, schema)


def fold_of_language(docs: DataFrame) -> Column:
    return held_out(docs["doc_id"], 5, 0)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~fold_of_language(docs)).select("doc_id", "text", "lang"))
    plain = docs.select("doc_id", fold_of_language(docs).alias("held_out"), "text")
    return predict(plain, model).drop("text")
