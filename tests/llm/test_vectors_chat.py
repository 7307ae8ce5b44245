import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larchpoint.llm import ann, blocks, chat, topk

SF = "/root/testdata/sf0.001"
ROWS = [(i, [math.sin(i * k + k) for k in range(1, 20)]) for i in range(400)]
ROWS += [(400, [0.0] * 19), (420, None), (440, [float("nan")] + [1.0] * 18), (460, [None] + [1.0] * 18), (480, [float("inf")] * 19), (None, [1.0] * 19), (500, []), (520, [1.0, 2.0]), (540, [2.0, 1.0]), (20, ROWS[20][1]), (20, ROWS[20][1]), (600, ROWS[5][1]), (620, ROWS[5][1])]


def brute(rows, every, k, score, zero):
    ok = [(i, x) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x) and (zero or any(x))]
    out = []
    for i, x in ok:
        if i % every == 0:
            found = sorted((-score(x, y), j) for j, y in ok if j != i and len(y) == len(x))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def in_order(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def whole(x, y):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(x, y, strict=True))


def once(rows):  # a query that occurs several times is asked several times
    return [r for n, r in enumerate(rows) if r[0] != 20 or n == 20]


@pytest.mark.parametrize("group", [64, 16_384])
def test_nearest_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(blocks, "GROUP_ROWS", group)
    monkeypatch.setattr(blocks, "GROUP_QUERIES", group)
    monkeypatch.setattr(blocks, "GROUP_BYTES", 10 * group)
    df = spark.createDataFrame(once(ROWS), "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    assert sorted(map(tuple, ann.nearest(df, 20, 20).collect())) == brute(once(ROWS), 20, 20, in_order, False)


@pytest.mark.parametrize("group", [64, 16_384])
def test_top_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(blocks, "GROUP_ROWS", group)
    df = spark.createDataFrame(once(ROWS), "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    assert sorted(map(tuple, topk.top(df, 5, 20).collect())) == brute(once(ROWS), 20, 5, whole, True)


def test_huge_components_and_repeated_ids(spark):
    rows = [(0, [1e6, 3e4]), (1, [1e6, 2e4]), (2, [1e30, 1.0])]
    got = sorted(map(tuple, topk.top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got[0] == (0, 1, 2, 2**63 - 1) and got[1] == (0, 2, 1, whole(rows[0][1], rows[1][1]))
    df = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>")
    assert ann.nearest(df).where("query_id = vec_id").isEmpty() and topk.top(df.limit(0)).count() == ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 40")).count() == 0


def test_pruning_skips_work():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64)) * np.linspace(3, 0.1, 64)
    t = ann.Tiles(64, np.arange(20), x[:20], 20)
    t.add(np.arange(2000), x)
    assert t.survivors < 0.1 * t.pairs
    c = topk.Columns(64, np.arange(5), x[:5], 5)
    c.add(np.arange(2000), x)
    assert c.touched < 0.5 * 64 * c.pairs


def test_pruning_skips_work_on_the_table(spark):
    """Vectors of the table have equal energy in all dimensions; a query's own largest components come first."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    asked = ids % 50 == 0
    c = topk.Columns(64, ids[asked], x[asked], 5)
    for i in range(0, len(ids), 500):
        c.add(ids[i : i + 500], x[i : i + 500])
    assert c.touched < 0.5 * 64 * c.pairs
    q, v, s = c.result()
    want = np.floor(256 * x[asked]) @ np.floor(256 * x).T
    want[ids[asked][:, None] == ids] = -np.inf
    assert s.tolist() == np.sort(want, axis=1)[:, ::-1][:, :5].ravel().tolist()


def test_wide_vectors_and_many_copies_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(blocks, "GROUP_BYTES", 100_000)
    rng = np.random.default_rng(3)
    wide = [(i, rng.normal(size=3000).tolist()) for i in range(60)]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top(df, 3, 20).collect())) == brute(wide, 20, 3, whole, True)
    got = sorted(map(tuple, ann.nearest(df, 3, 20).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in brute(wide, 20, 3, in_order, False)]
    copies = [(1, [1.0, 2.0])] * 500 + [(40, [2.0, 1.0]), (60, [1.0, 1.0])]
    df = spark.createDataFrame(copies, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top(df, 5, 20).collect())) == brute(copies, 20, 5, whole, True)
    assert sorted(map(tuple, ann.nearest(df, 5, 20).collect())) == brute(copies, 20, 5, in_order, False)


def test_only_huge_pairs_are_computed_apart(spark):
    rows = [(i, [float(i), 1.0]) for i in range(0, 40)] + [(50, [1e9, -1e9]), (51, [-3e8, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top(df, 5, 10).collect())) == brute(rows, 10, 5, whole, True)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


HARD = [
    (1, 2, "assistant", "b <|im_end|>"), (1, 1, "user", "a \\<| \\\\<\\|"), (1, 3, "assistant", "c"), (1, 4, "user", None), (1, 5, "assistant", ""),
    (2, 1, "assistant", chat.HOSTILE), (2, 1, "assistant", chat.HOSTILE), (2, 2, "us\ner<|im_start|>", "<|im_sep|>\n"), (2, None, None, "first"), (None, 1, "user", "x"), (3, 1, "assistant", "y" * 200_000),
]


def test_turns_are_read_back(spark):
    out = chat.format_turns(turns(spark, HARD).withColumn("t", F.lit(1)).withColumn("segments", F.lit(2)))
    rows = {r["conv_id"]: r for r in out.withColumn("back", chat.read_turns(F.col("formatted"))).collect()}
    for conv, r in rows.items():
        mine = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in HARD if c == conv))
        assert [(x["role"], x["text"]) for x in r["back"]] == [(role, text) for _, _, role, text in mine]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert sum(s["text"].count("<|im_start|>") for s in r["segments"] if s["loss"]) == 0
    assert rows[1]["formatted"].count(chat.START) == 4 and rows[2]["formatted"].count(chat.START) == 3
    assert chat.format_turns(turns(spark, [])).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = chat.op1_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
