"""Exact search over grids of blocks against plain sorting."""

import numpy as np
import pytest

from glosswork.operators import vectors as vec


def plain(queries, corpus, k, not_itself=True):
    out = {}
    for q, v in queries:
        scores = [(float(np.sum(np.array(v, np.float32).astype(float) * np.array(w, np.float32).astype(float))), i) for i, w in corpus if w is not None and not (not_itself and i == q)]
        scores = [s for s in scores if np.isfinite(s[0])]
        out[q] = (len(scores), sum(s for s, _ in scores), sorted(scores, key=lambda s: (-s[0], s[1]))[:k])
    return out


def check(spark, queries, corpus, k, **options):
    a = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    b = spark.createDataFrame([(*r, 7) for r in corpus], "id long, embedding array<float>, query_id int").repartition(3)
    got = {r["query_id"]: r for r in vec.search(a, b, k, **options).collect()}
    want = plain(queries, corpus, k, options.get("not_itself", True))
    assert sorted(got) == sorted(want)
    for q, (n, total, top) in want.items():
        assert got[q]["n"] == n and got[q]["total"] == pytest.approx(total)
        assert [(pytest.approx(s), i) for s, i in top] == [tuple(t) for t in got[q]["top"]]


@pytest.mark.parametrize("broadcast", [0, 2])
@pytest.mark.parametrize("k", [1, 5, 60])
def test_any_grid(spark, monkeypatch, broadcast, k):
    rng = np.random.default_rng(k)
    corpus = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(120)]  # many ties
    corpus += [(500, None), (501, [float("nan"), 1.0, 1.0]), (502, [float("inf"), 0.0, 0.0]), (503, corpus[0][1])]
    queries = [(i, v) for i, v in corpus[:40]] + [(1000, [1.0, 1.0, 1.0])]
    check(spark, queries, corpus, k, broadcast_blocks=broadcast, task_rows=50)
    monkeypatch.setattr(vec, "QUERY_BLOCK", 7)  # seven queries to a block
    check(spark, queries, corpus, k, broadcast_blocks=broadcast, task_rows=50, not_itself=False)


def test_plan_does_not_grow_with_queries(spark, monkeypatch):
    corpus = spark.range(300).selectExpr("id", "array(cast(id % 7 as float), 1.0f) as embedding")
    monkeypatch.setattr(vec, "QUERY_BLOCK", 10)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else Spark broadcasts what it finds small
    plans = []
    try:
        for n in (50, 290):
            df = vec.search(corpus.limit(n).withColumnRenamed("id", "query_id"), corpus, 3)
            plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plans[0] == plans[1]


def test_no_rows(spark):
    corpus = spark.createDataFrame([], "id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert [tuple(r) for r in vec.search(queries, corpus).collect()] == [(1, 0, 0.0, [])]
    assert vec.search(queries.limit(0), corpus.union(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"))).count() == 0


def test_batches_of_blocks_are_bounded(spark):
    """A search bounds the bytes of the batches that Python is handed, however many blocks a task reads."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    vec.search(df.withColumnRenamed("id", "query_id"), df, 1)
    assert int(spark.conf.get(name)) <= 16 << 20


def test_cosine_table_loads_and_bounds_batches(spark):
    """The table is made at all, and the batches of blocks that Python is handed are bounded by bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0])], "id long, embedding array<float>")
    table = vec.pair_scores(df.withColumnRenamed("id", "query_id"), df, cosine=True)
    assert int(spark.conf.get(name)) <= 16 << 20
    assert sorted((r.query_id, r.id, round(r.score, 9)) for r in table.collect()) == [(1, 2, 0.8), (2, 1, 0.8)]


def test_product_table_loads(spark):
    """The table of plain products is made at all, over vectors of either precision and a row without one."""
    a = spark.createDataFrame([(1, [3.0, 4.0])], "query_id long, embedding array<double>")
    b = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.5, 2.0]), (3, None)], "id long, embedding array<float>")
    assert sorted(map(tuple, vec.pair_scores(a, b).collect())) == [(1, 2, 9.5), (1, 3, None)]
