import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from larchpoint.llm import langid, minhash, pii, suffixdedup

from .helpers import DOCS, clashing, linked_components, odd_rows, removed, words
from .test_text import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against brute force on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = dict(corpus_pipeline.STAGES)
    known = names["language"](spark, docs, SF)
    model = langid.fit(docs.where(~langid.fold_of_language(docs)))
    rows = docs.collect()
    found = dict(zip([r["doc_id"] for r in rows], zip(*langid.score_texts([r["text"] for r in rows], *model)), strict=True))
    assert {r["doc_id"] for r in known.collect()} == {i for i, (lang, _) in found.items() if lang != "und"}
    single = names["near_duplicates"](spark, known, SF)
    texts = {r["doc_id"]: r["text"] for r in known.collect()}
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in linked_components(texts, minhash.SHINGLE_WORDS).items() if i == c}
    short = names["repeats"](spark, single, SF)
    before = single.orderBy("doc_id").collect()
    after = {r["doc_id"]: r for r in short.collect()}
    for r, (left, _) in zip(before, removed([r["text"] for r in before], suffixdedup.LENGTH), strict=True):
        assert after[r["doc_id"]]["text"] == (left.decode("utf-8", "ignore") if r["text"] is not None else None)
        assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])
    clean = names["personal_data"](spark, short, SF)
    assert all(not pii.base_spans(r["text"] or "") for r in clean.collect())
    assert all(x.columns == docs.columns for x in (known, single, short, clean))
    check_packing(names["packing"](spark, clean, SF).collect(), {r["doc_id"]: r["text"] for r in clean.collect()}, 2048)


def test_rows_that_share_an_id_leave_as_one(spark):
    rows = [(3, words(1, 50), "en", "a", 1), (7, words(1, 50), "en", "a", 1), (7, words(2, 50), "en", "a", 1), (9, words(3, 50), "en", "a", 1)]
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, DOCS), SF)
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 9]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, empty):
    docs = clashing(spark.createDataFrame(odd_rows(), DOCS)).where(F.lit(not empty))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        rows = out.count()
        assert rows == 0 if empty else rows > 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
