import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larchpoint.llm import bpe, langid, packing, pii, toxicity

from .helpers import DOCS, clashing, odd_rows, words

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def odd(spark):
    return clashing(spark.createDataFrame(odd_rows(), DOCS))


HARD = ["", " ", "  a  b ", "\n\n x\t\ty ", "a" * 5000, "ab" * 3000, "don't we'll", "x" * 31 + " " + "1" * 70, "🙂" * 200, "é漢字 " * 50, "<|endoftext|> and <|endoftext|>", "   　x", words(9, 3000)]


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = HARD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect():
        text = texts[r["doc_id"]] or ""
        ids = other.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def strange(seed: int) -> str:
    """A text with characters of all planes, many of them blanks, digits and letters that libraries classify differently."""
    r, out = random.Random(seed), []
    for _ in range(r.randint(1, 24)):
        x = r.random()
        if x < 0.2:
            out.append(r.choice(" \t\n\r\x0b\x0c\x1c\x85\xa0\u1680\u180e\u2003\u2028\u3000"))
        elif x < 0.4:
            out.append(chr(r.randrange(33, 127)))
        else:
            c = r.randrange(0x80, 0x800) if x < 0.5 else r.randrange(0x110000) if x < 0.8 else r.randrange(0x10000)
            out.append(chr(c) if not 0xD800 <= c < 0xE000 else "\ufffd")
    return "".join(out)


PLANES = "\U00018f9a\u9d15\U00011ee8\U0001c9a7\u4cb1\U0001ce9c\uc95d\u307d\u690d\U00013a5d"


@pytest.mark.parametrize("leaf", [1, 4])
def test_strange_texts_get_the_ids_of_the_libraries(leaf):
    import tiktoken
    from tokenizers import Tokenizer

    ranks, merges, special = bpe.ranks_from_json(JSON)
    one, two = bpe.Codec(bpe.ranks_from_tiktoken(RANKS), public_tokenizers.PATTERN, leaf_bytes=leaf), bpe.Codec(ranks, public_tokenizers.PATTERN, merges, special, leaf)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_from_tiktoken(RANKS), special_tokens={})
    third, packer = Tokenizer.from_file(JSON), packing.Library(JSON, public_tokenizers.PATTERN)
    assert len(one.encode(PLANES)) == 4 * len(other.encode_ordinary(PLANES)) == 4 * 34
    for seed in range(50_000):
        text = strange(seed) + ("<|endoftext|>" + strange(-seed) if seed % 9 == 0 else "")
        assert list(memoryview(one.encode(text)).cast("I")) == other.encode_ordinary(text)
        want = third.encode(text, add_special_tokens=False).ids
        assert list(memoryview(two.encode(text)).cast("I")) == want == list(memoryview(packer.encode(text)).cast("I"))
        assert one.decode(other.encode_ordinary(text)) == text.encode()


def test_every_token_is_the_encoding_of_its_bytes():
    """What makes stable pairs a proof; the tree joins parts for every pre-token of more than one byte."""
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    assert all(c.piece(token) == (n,) for token, n in c.ranks.items()) and c.joins > 10_000
    ranks, merges, special = bpe.ranks_from_json(JSON)
    c = bpe.Codec(ranks, public_tokenizers.PATTERN, merges, special)
    assert all(c.piece(token) == (n,) for token, n in c.ranks.items())


def test_memories_are_emptied_when_full(monkeypatch):
    import tiktoken

    for name, value in (("MEMORY", 20), ("GROUP_CHARS", 50), ("LONG", 3)):
        monkeypatch.setattr(bpe, name, value)
    ranks = bpe.ranks_from_tiktoken(RANKS)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c, texts = bpe.Codec(ranks, public_tokenizers.PATTERN), [words(i, 40) for i in range(20)] + HARD[:6]
    assert [list(memoryview(x).cast("I")) for x in c.encode_many(texts)] == [other.encode_ordinary(x) for x in texts]


@pytest.mark.parametrize("leaf", [1, 2, 3, 8])
def test_small_leaves_join_to_the_same_tokens(leaf):
    import tiktoken

    ranks = bpe.ranks_from_tiktoken(RANKS)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(ranks, public_tokenizers.PATTERN, leaf_bytes=leaf)
    for text in HARD:
        assert list(memoryview(c.encode(text)).cast("I")) == other.encode_ordinary(text)


def test_bpe_round_trip_with_nulls_and_no_rows(spark):
    docs = odd(spark)
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN)
    want = sorted((str(i), (t or "").encode()) for i, t, *_ in odd_rows())
    assert sorted((str(r["doc_id"]), bytes(r["data"])) for r in back.collect()) == want
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def check_packing(rows, texts, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    at, filled = {}, {}
    for r in rows:
        at.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(at) == set(texts)
    for doc_id, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        start = 0
        for r in sorted(at[doc_id], key=lambda r: r["start"]):
            assert r["start"] == start and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + r["length"]]))
            start += r["length"]
        assert start == len(ids)
    assert sorted(filled) == list(range(len(filled)))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return sum(r["length"] for r in rows) / (len(filled) * size)


def test_packing_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert check_packing(packing.op10_packing(spark, SF).collect(), texts, 2048) > 0.98


def test_packing_of_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 7]
    out = packing.pack(clashing(spark.createDataFrame(rows, DOCS)), JSON, public_tokenizers.PATTERN, 64).collect()
    check_packing(out, {r[0]: r[1] for r in rows}, 64)
    assert len(packing.pack(odd(spark), JSON, public_tokenizers.PATTERN, 64).collect()) > len(out)
    assert packing.pack(odd(spark).limit(0), JSON, public_tokenizers.PATTERN).count() == 0


def test_plan_places_every_piece_once():
    for histogram in ({}, {5: 3}, {10: 1, 7: 4, 3: 9, 2: 2, 1: 30}, {6: 5, 4: 5}):
        used = {}
        for length, first, last, sequence, offset in packing.plan(histogram, 10):
            for rank in range(first, last + 1):
                used.setdefault(sequence + rank - first, []).append((offset, length))
        assert sum(map(len, used.values())) == sum(histogram.values())
        for places in used.values():
            places.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(n for _, n in places) <= 10


@pytest.mark.parametrize(
    ("histogram", "sequences"),
    [({1000: 1, 100: 10}, 1), ({150: 300}, 24), ({2000: 7, 48: 5, 20: 1000}, 17), ({2048: 3, 1500: 40, 700: 60, 30: 5000, 9: 100}, 127)],
)
def test_plan_fills_packs_with_a_hot_length(histogram, sequences):
    """One short length holds a third of the rows or more."""
    used = {}
    for length, first, last, sequence, offset in packing.plan(histogram, 2048):
        for rank in range(first, last + 1):
            used.setdefault(sequence + rank - first, []).append((offset, length))
    assert sum(map(len, used.values())) == sum(histogram.values()) and sorted(used) == list(range(len(used)))
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 2048
    assert len(used) == sequences


def test_language_is_found_in_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.op6_langid(spark, SF).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).head()
    assert n > 100 and right / n > 0.95
    assert langid.op6_langid(spark, SF).count() == docs.count()


def test_language_with_nulls_clashes_and_no_rows(spark):
    docs = odd(spark)
    out = langid.predict(docs, langid.fit(docs))
    rows = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert out.count() == docs.count() and rows[1]["lang_pred"] in ("en", "de", "fr")
    assert [(rows[i]["lang_pred"], rows[i]["score"]) for i in (4, 5, 8)] == [("und", 0.0)] * 3
    empty = docs.limit(0)
    assert langid.predict(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, langid.fit(empty)).count() == 0


def test_language_equals_plain_naive_bayes(spark):
    """The same model in plain Python: counts in dictionaries, a prior, no sample, no matrix."""
    r = random.Random(4)
    tongues = {"aa": "abc de", "bb": "bcd ef", "cc": "cé漢 ab"}
    rows = [(i, "".join(r.choice(tongues[lang]) for _ in range(r.randint(1, 30))), lang) for i, lang in enumerate(["aa"] * 30 + ["bb"] * 10 + ["cc"] * 5 + ["dd"] * 0)]
    rows += [(100, "same", "aa"), (101, "same", "bb"), (102, None, "zz"), (103, "xyz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = [(t, lang) for _, t, lang in rows if t is not None and lang is not None]
    counts = {lang: {} for _, lang in known}
    for text, lang in known:
        for g in langid.grams(text).tolist():
            counts[lang][g] = counts[lang].get(g, 0) + 1
    total = {lang: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for lang, c in counts.items()}
    share = {lang: sum(x == lang for _, x in known) / len(known) for lang in counts}
    for row in langid.predict(docs, langid.fit(docs)).collect():
        gs = langid.grams(row["text"] or "").tolist()
        if not gs:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        logs = {lang: math.log(share[lang]) + sum(math.log((counts[lang].get(g, 0) + langid.SMOOTHING) / total[lang]) for g in gs) for lang in counts}
        best = max(logs.values())
        assert logs[row["lang_pred"]] > best - 1e-3
        assert abs(row["score"] - 1 / sum(math.exp(x - best) for x in logs.values())) < 1e-3


def test_more_languages_than_fit_are_an_error_and_ties_go_by_name(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same text", x) for i, x in enumerate("dcba")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()} == {"a"}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        langid.fit(docs)


def auc(rows) -> float:
    good, bad = [s for s, t in rows if t], [s for s, t in rows if not t]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").where("toxic IS NOT NULL")
    scored = toxicity.op2_toxicity(spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    assert auc([(r["score"], r["toxic"]) for r in rows]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_with_nulls_and_no_rows(spark):
    docs = odd(spark).withColumn("held_out", F.lit(False))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1")):
        out = toxicity.score(docs, toxicity.fit(docs, known)).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def plain_ftrl(rows: list[set[int]], labels: list[int]) -> tuple[dict[int, float], float]:
    """The model of toxicity.train() with one dictionary for each coordinate's state."""
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    bias, bias_n = math.log(share / (1 - share)), 1.0
    seen: dict[int, int] = {}
    for x in rows:
        for g in x:
            seen[g] = seen.get(g, 0) + 1
    used = {g for g, n in seen.items() if n >= min(toxicity.MIN_DOCS, max(1, len(rows) // 50))}
    z, n = dict.fromkeys(used, 0.0), dict.fromkeys(used, 0.0)

    def weight(g: int) -> float:
        if abs(z[g]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[g]) - z[g]) / ((toxicity.BETA + math.sqrt(n[g])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for d in order.permutation(len(rows)):
            mine = rows[d] & used
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + sum(weight(g) for g in mine)))))
            slope = p - labels[d]
            for g in mine:
                w = weight(g)
                z[g] += slope - (math.sqrt(n[g] + slope * slope) - math.sqrt(n[g])) / toxicity.ALPHA * w
                n[g] += slope * slope
            bias_n += slope * slope
            bias -= toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias_n)) * slope
    return {g: w for g in used if (w := weight(g))}, bias


def test_toxicity_equals_plain_ftrl(spark):
    bad = words(77, 4)
    texts = [words(i, 20) + (f" {bad} " if i % 3 == 0 else " ") + words(i + 500, 5) for i in range(150)]
    labels = [int(i % 3 == 0 or i % 31 == 0) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.lit(False))
    known = clashing(spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    weights, bias = plain_ftrl([set(toxicity.features(t).tolist()) for t in texts], labels)
    assert weights
    for r in toxicity.score(docs, toxicity.fit(docs, known)).collect():
        total = bias + sum(weights.get(g, 0.0) for g in set(toxicity.features(texts[r["doc_id"]]).tolist()))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_toxicity_training_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, words(i, 20 if i else 30_000)) for i in range(60)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    known = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (1, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, known, train_bytes=20_000)).count() == 60
    keys, w, bias = toxicity.fit(docs, known, train_bytes=0)
    assert not len(keys) and abs(bias) < 1e-9


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """The base kinds straight from their patterns."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t or "" for _, t, *_ in odd_rows()]
    texts += ["a@b.c.d@e.f", "x..y@-.-.z", "1.2.3.4.5.6.7.8.9", "256.1.1.1.1 1.1.1.256", "4111-1111 1111--1111", "+1 (234) 567-8901 +12345678901234567", "a@b@c.d", "@x.y", "00001.2.3.4", "4111111111111111" * 3, "1" * 400 + ".2.3.4"]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)


def disclosing() -> list[tuple[int, str]]:
    rows = [(i, f"{words(i, 5)} zeppelinmeister {words(i + 50, 2)} boss{i % 2}@corp.example {words(i + 90, 6)}") for i in range(20)]
    return rows + [(100 + i, words(i, 30)) for i in range(60)] + [(200, "the Zeppelinmeister alone")]


def test_terms_near_one_entity_are_spans(spark):
    rows = [(i, t.replace("boss1", "boss0")) for i, t in disclosing()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert got[200]["n_term"] == 1 and got[200]["spans"] == "term:4:19" and got[200]["n_email"] == 0
    assert got[0]["n_email"] == 1 and got[100]["n_term"] == 0
    joined = {r["doc_id"]: r for r in pii.find(docs, limit=0).collect()}  # the same through a join
    assert joined == got
    nameless = docs.unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    assert sorted(r["spans"] for r in pii.find(nameless, limit=0).collect()) == sorted(2 * [r["spans"] for r in got.values()])
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert text[200] == "the  alone" and "[EMAIL]" in text[0] and "corp" not in text[0]


def test_terms_on_other_lines_short_and_with_digits_are_spans(spark):
    rows = [(i, f"{words(i, 5)}\nBob r2d2x9\n{words(i + 50, 2)}\nboss@corp.example\n{words(i + 90, 6)}") for i in range(20)]
    rows += [(100 + i, words(i, 30)) for i in range(60)] + [(200, "bob and R2D2X9 alone, 12345")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200]["spans"] == "term:0:3,term:8:14"


def test_pii_with_nulls_clashes_and_no_rows(spark):
    docs = odd(spark)
    found = pii.find(docs).collect()
    at = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert len(found) == docs.count() and (at[8]["n_ip"], at[8]["n_card"], at[8]["n_phone"], at[7]["n_email"]) == (1, 1, 1, 1)
    assert at[4]["spans"] == at[5]["spans"] == ""
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert pii.find(docs.limit(0)).count() == pii.sanitise(docs.limit(0)).count() == 0
