import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larchpoint.llm import minhash, suffixdedup

from .helpers import DOCS, clashing, linked_components, odd_rows, removed, words

SF = "/root/testdata/sf0.001"


def near_copies() -> list[tuple[int, str]]:
    r = random.Random(5)
    rows = []
    for g in range(6):
        base = words(100 + g, 80).split()
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice("xyz") * r.randint(1, 3)
            rows.append((len(rows) + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("n", [1, 2, 5])
def test_minhash_equals_all_pairs(spark, n):
    rows = [(i, t) for i, t, *_ in odd_rows() if i is not None and i != 7] + [(100 + i, t) for i, t in near_copies()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()}
    assert got == linked_components(dict(rows), n)


def test_minhash_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = linked_components({r["doc_id"]: r["text"] for r in docs.collect()}, 2)
    got = minhash.op7_minhash(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_nulls_repeats_clashes_and_no_rows(spark):
    docs = clashing(spark.createDataFrame(odd_rows(), DOCS))
    out = minhash.near_duplicates(docs, 2)
    rows = out.collect()
    assert len(rows) == len(odd_rows()) and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    at = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert at[1]["component_id"] == at[2]["component_id"] == at[3]["component_id"] == 1 and not at[3]["kept"]
    assert at[4]["n_shingles"] == at[5]["n_shingles"] == 0 and at[4]["kept"] and at[5]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_texts_of_one_document_share_a_component(spark):
    a, b, c, d = (words(40 + i, 60) for i in range(4))
    rows = [(3, a), (7, a), (7, b), (9, c), (9, d), (11, d), (12, b + " more"), (13, c), (7, ""), (20, ""), (20, None), (9, c), (None, b)]
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    want = {3: 3, 7: 3, 12: 3, 9: 9, 11: 9, 13: 9, 20: 20, None: None}
    assert got == sorted((str(i), want[i], i in (3, 9, 20, None)) for i, _ in rows)


def test_stars_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_BLOCK", 4)
    monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", 5)
    monkeypatch.setattr(minhash, "SALT", 3)
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == linked_components(dict(rows), 2)


def executions(store) -> list:
    every = store.executionsList()
    return [every.apply(i) for i in range(every.size())]


def test_near_duplicates_build_no_table_in_the_driver(spark, monkeypatch):
    """Every join is a sort-merge join, also where Spark takes a side for small."""
    monkeypatch.setattr(minhash, "STAR_BLOCK", 4)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    last = max((x.executionId() for x in executions(store)), default=-1)
    stages = []
    for name in ("components", "open_stars", "compare_stars"):
        monkeypatch.setattr(minhash, name, lambda *a, f=getattr(minhash, name), name=name: stages.append(name) or f(*a))
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == linked_components(dict(rows), 2)
    assert {*stages} == {"components", "open_stars", "compare_stars"}
    bus.waitUntilEmpty()
    plans = [x.physicalPlanDescription() for x in executions(store) if x.executionId() > last]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def brute_repeats(strings: list[bytes], length: int) -> list[np.ndarray]:
    every = [s[i : i + length] for s in strings for i in range(len(s) - length + 1)]
    return [np.array([every.count(s[i : i + length]) > 1 for i in range(len(s) - length + 1)], bool) for s in strings]


def test_transform_finds_every_repeated_window(tmp_path):
    r = random.Random(3)
    for trial in range(80):
        length = r.choice([1, 2, 3, 5, 8, 12, 16, 40])  # symbols of 1, 2, 4 and 8 bytes
        letters = b"ab" if trial % 3 else bytes(range(256))
        strings = [bytes(r.choice(letters) for _ in range(r.randint(length, 30 + 2 * length))) for _ in range(r.randint(1, 8))]
        if trial % 2:
            strings += [s[2:] for s in strings if len(s) > length + 2]
        want = brute_repeats(strings, length)
        got = suffixdedup.repeated(strings, length, r.choice([0, 1 << 20]), f"file://{tmp_path}/columns")  # 0: every column in a file
        assert all((x == y).all() for x, y in zip(want, got, strict=True))
        marks = [np.zeros(len(w), bool) for w in want]
        work = suffixdedup.Collection(length, r.choice([1, 1 << 20]))
        for w, a, e in [*work.add(list(enumerate(strings))), *work.result()]:
            marks[w][a:e] = True
        assert all((x == y).all() for x, y in zip(want, marks, strict=True))
    assert not list((tmp_path / "columns").iterdir())  # columns are deleted


def test_range_minima_over_short_and_long_ranges():
    x = np.random.default_rng(1).integers(0, 200, 5000).astype(np.uint8)
    lo, hi = np.sort(np.random.default_rng(2).choice(4999, (2, 400)), axis=0)
    hi = np.maximum(hi, lo + 1)
    assert suffixdedup.range_minima(x, lo, hi).tolist() == [int(x[a:e].min()) for a, e in zip(lo, hi, strict=True)]


@pytest.mark.parametrize("places", suffixdedup.PLACES)
def test_equal_windows_fall_into_parts_of_one_longer_gram(places):
    r, length, gram = random.Random(places), 40, 8
    core = bytes(r.choice(b"abcd") for _ in range(60))
    seen: dict[bytes, set[bytes]] = {}
    for _ in range(40):
        data = bytes(r.choice(b"abcd") for _ in range(30)) + core + bytes(r.choice(b"abcd") for _ in range(30))
        key, _, start, windows, _ = suffixdedup.segments(data, length, gram)
        for k, a, n in zip(key.tolist(), start.tolist(), windows.tolist(), strict=True):
            string, done = data[a : a + n + length - 1], 0
            for first, last, longer in suffixdedup.parts_of(string, k, places, length, gram):
                assert first == done
                done = last
                for i in range(first, last):
                    seen.setdefault(string[i : i + length], set()).add(longer)
            assert done == n
    assert all(len(x) == 1 for x in seen.values()) and len(seen) < 40 * 81


@pytest.mark.parametrize("hot", [0, 3, 1024])
def test_repeats_equal_brute_force(spark, hot):
    """Also with buckets that are hot at every split: one line in 60 contexts, one passage in 60."""
    texts = [t for _, t in near_copies()] + [t for i, t, *_ in odd_rows() if i != 6] + ["ab" * 300, "a" * 500, "é漢" * 60]
    line, passage = words(70, 6)[:30], words(71, 40)
    texts += [f"{words(500 + i, 9)} {line} {words(600 + i, 9)}" for i in range(60)] + [f"{words(700 + i, 9)} {passage} {words(800 + i // 2, 9)}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffixdedup.digests(docs, 40, 8, hot, 1 << 12, 1 << 10).collect()}
    for i, (left, spans) in enumerate(removed(texts, 40)):
        r = got[i]
        size = len((texts[i] or "").encode())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, size - len(left), spans, hashlib.sha256(left).hexdigest())


def test_repeats_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in suffixdedup.op5_suffix_dedup(spark, SF).collect()}
    for r, (left, spans) in zip(docs, removed([r["text"] for r in docs], 200), strict=True):
        assert (got[r["doc_id"]]["n_spans"], got[r["doc_id"]]["kept_sha256"]) == (spans, hashlib.sha256(left).hexdigest())


def test_rows_that_share_an_id_keep_what_only_another_repeats(spark):
    x, y = words(31, 60)[:300], words(32, 60)[:300]
    rows = [(3, x), (7, x), (7, y), (None, y + "!"), (None, words(33, 60)), (None, None), (8, words(34, 60))] + [(9, words(35, 60))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), hashlib.sha256(left).hexdigest(), n) for (i, _), (left, n) in zip(rows, removed([t for _, t in rows], 200), strict=True))
    assert sorted((str(r["doc_id"]), r["kept_sha256"], r["n_spans"]) for r in suffixdedup.digests(docs).collect()) == want


def test_repeats_with_nulls_clashes_and_no_rows(spark):
    docs = clashing(spark.createDataFrame(odd_rows(), DOCS))
    out = suffixdedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert rows[1] == rows[2] == "" and rows[4] is None and rows[10] == "one"
    assert len(rows[6]) == len(words(2, 20_000))
    assert suffixdedup.without_repeats(docs.where(F.lit(False))).count() == 0
