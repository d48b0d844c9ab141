"""Best matches by shared words against counting every pair."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork.operators import lexical as lx


def corpus(seed, n, vocabulary=400, size=40):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, [f"w{x}" for x in rng.choices(range(vocabulary), weights, k=rng.randint(0, size))]) for i in range(n)]


def plain(rows, asked, k, least=1):
    out = []
    for q, words in asked:
        hits = sorted(((-len(set(words) & set(w)), i) for i, w in rows if i != q and w is not None and len(set(words) & set(w)) >= least))
        out += [(q, r, i, -h) for r, (h, i) in enumerate(hits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 4, 30, 1000])
def test_top_shared(spark, k):
    rows = [*corpus(k, 250), (900, None), (901, []), (902, ["w0"] * 5), (903, ["w1", None])]
    asked = [r for r in rows if r[0] % 10 == 0 and r[1] is not None] + [(5000, ["w0", "w3", "w9"]), (5001, ["never"])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, words array<string>, word string")
    queries = spark.createDataFrame([(*r, 1) for r in asked], "query_id long, words array<string>, n int")
    clean = [(i, w if w is None else [x for x in w if x]) for i, w in rows]
    assert sorted(map(tuple, lx.top_shared(queries, df, k).collect())) == plain(clean, asked, k)
    for least in (1, 2, 7):
        got = sorted(map(tuple, lx.sharing(queries, df, least).collect()))
        assert got == sorted((q, i, h) for q, _, i, h in plain(clean, asked, 10**6, least))
    assert lx.top_shared(queries.limit(0), df, k).count() == 0 and lx.top_shared(queries, df.limit(0), k).count() == 0


def test_frequent_words_are_not_joined(spark):
    """Where similar rows exist, far fewer rows meet than pairs that share a word, or than queries times rows."""
    rng = random.Random(2)
    base = [[f"r{g}_{i}" for i in range(20)] for g in range(60)]
    common = [f"c{i}" for i in range(12)]
    rows = [(i, base[i % 60] + common + [f"u{i}"]) for i in range(1200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, words array<string>")
    queries = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    ordered = lx.by_rarity(queries, df)
    asked = ordered.select(F.explode(F.slice("ordered", 1, F.size("ordered") - 16)).alias("x"))  # ten others share 32 words: half of that is skipped
    met = asked.agg(F.sum("x.n")).first()[0]
    whole = ordered.select(F.explode("ordered").alias("x")).agg(F.sum("x.n")).first()[0]
    assert met < whole / 4 and met < 120 * 1200
    got = lx.top_shared(queries, df, 10).collect()
    assert len(got) == 1200 and {r["hits"] for r in got} == {32} and all(r["id"] % 60 == r["query_id"] % 60 for r in got)


def test_no_posting_is_joined(spark):
    """Blocks meet in a product; neither words nor pairs are exploded, joined by word or shuffled."""
    df = spark.createDataFrame(corpus(1, 30), "id long, words array<string>")
    text = lx.sharing(df.withColumnRenamed("id", "query_id"), df, 2)._jdf.queryExecution().executedPlan().toString()
    assert ("CartesianProduct" in text or "BroadcastNestedLoopJoin" in text) and "Generate" not in text and "hashpartitioning" not in text


@pytest.mark.parametrize(("rows_most", "words_most", "cells", "added"), [(7, 1 << 20, 1 << 21, 1 << 21), (8192, 5, 1, 1), (50, 100, 300, 40), (1, 1, 64, 1 << 21)])
def test_blocks_of_any_size(monkeypatch, rows_most, words_most, cells, added):
    """Limits of blocks and of tables of counts change the work, not the result; a row of more words than a block takes is read whole."""
    for name, value in (("BLOCK_WORDS", words_most), ("CELLS", cells), ("ADDED", added)):
        monkeypatch.setattr(lx, name, value)
    monkeypatch.setattr(lx, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    rows = [(i, sorted({int(w[1:]) for w in words})) for i, words in corpus(5, 120)]
    random.Random(1).shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.list_(pa.int64()))], names=["id", "h"]) for part in (rows[:50], rows[50:50], rows[50:])]
    packed = list(lx._packed(iter(batches), rows_most))
    assert sum(len(b.column(1)[0].as_py()) // 8 for b in packed) == sum(bool(w) for _, w in rows)
    pairs = [pa.RecordBatch.from_arrays([*a.columns, *b.columns[1:]], names=list("abcdefghi")) for a in packed for b in packed]
    asked = [r for r in rows if r[1]]
    got = [x for b in lx._all_of(3)(iter(pairs)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == sorted((q, i, h) for q, _, i, h in plain(rows, asked, 10**6, 3))
    got = [x for b in lx._best_of(4)(iter(pairs)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == sorted((q, i, h) for q, _, i, h in plain(rows, asked, 4))
