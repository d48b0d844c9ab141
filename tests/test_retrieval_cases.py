"""Hand-computed retrieval cases: metrics, score statistics, gates and bands."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from glosswork.operators import evaluate as ev
from glosswork.operators import vectors as vec

RNG = random.Random(21)
#: Scores of queries over nine items in steps of a 32nd, so that ties occur, and the items that answer each span.
SCORES = {q: [RNG.randint(-32, 32) / 32 for _ in range(9)] for q in range(25)}
GOLD = sorted({(q, RNG.randint(0, 2), RNG.randint(0, 8)) for q in range(22) for _ in range(RNG.randint(1, 4))})


def plain_measures(query, cutoff=5):
    """First relevant rank, reciprocal rank, recall and span recall of a query, by sorting."""
    best = sorted(range(9), key=lambda i: (-SCORES[query][i], i))[:cutoff]
    own = [(s, i) for q, s, i in GOLD if q == query]
    ids, spans = {i for _, i in own}, {s for s, _ in own}
    first = next((r for r, i in enumerate(best, 1) if i in ids), None)
    return first, 1 / first if first else 0.0, len(ids & set(best)) / len(ids), len({s for s, i in own if i in best}) / len(spans)


def search(spark, scores, k=5):
    corpus = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(9)]) for i in range(9)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(100 + q, s) for q, s in scores.items()], "query_id long, embedding array<float>")
    return vec.search(queries, corpus, k)


def test_metrics(spark):
    ranks = vec.ranking(search(spark, SCORES))
    gold = spark.createDataFrame([(100 + q, s, i) for q, s, i in GOLD], "query_id long, span_id int, id long")
    rows = ev.per_query(ranks, gold)
    want = {q: plain_measures(q) for q in {q for q, _, _ in GOLD}}
    got = {r.query_id - 100: (r.first_relevant_rank, r.reciprocal_rank, r.recall, r.span_recall) for r in rows.collect()}
    assert got == {q: pytest.approx(w) for q, w in want.items()}
    t = ev.totals(rows).first()
    assert (t.queries, t.hit1, t.hit3, t.hit5) == (len(want), *(sum(w[0] is not None and w[0] <= k for w in want.values()) for k in (1, 3, 5)))
    for name, at in (("mrr", 1), ("recall", 2), ("span_recall", 3)):
        assert t[name] == pytest.approx(sum(w[at] for w in want.values()) / len(want), abs=1e-6)
    spans = [len({s for q, s, _ in GOLD if q == x}) for x in want]
    assert t.total_spans == sum(spans) and t.covered_spans == round(sum(w[3] * k for w, k in zip(want.values(), spans, strict=True)))


def test_no_queries_give_zero_ratios(spark):
    ranks = spark.createDataFrame([], "query_id long, rank long, id long")
    gold = spark.createDataFrame([], "query_id long, span_id int, id long")
    t = ev.totals(ev.per_query(ranks, gold)).first()
    assert (t.queries, t.mrr, t.span_coverage) == (0, 0.0, 0.0)


def test_statistics_follow_the_whole_corpus(spark):
    for r in vec.score_statistics(search(spark, SCORES)).collect():
        s = sorted(SCORES[r.query_id - 100], reverse=True)
        assert (r.top1_score, r.corpus_mean_score) == pytest.approx((s[0], sum(s) / 9))
        assert (r.score_gap, r.top1_minus_top2, r.top1_minus_top5) == pytest.approx((s[0] - sum(s) / 9, s[0] - s[1], s[0] - s[4]))
        assert r.top5_std == pytest.approx(statistics.pstdev(s[:5]))


def test_small_corpus_has_no_margins(spark):
    corpus = spark.createDataFrame([(0, [1.0])], "id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [0.5])], "query_id long, embedding array<float>")
    r = ev.gate(vec.score_statistics(vec.search(queries, corpus, 5))).first()
    assert r.top1_minus_top2 is None and r.top1_minus_top5 is None and r.top5_std is None
    assert r.verdict == "PASS"


def test_ties_go_to_the_smaller_id(spark):
    corpus = spark.createDataFrame([(i, [1.0]) for i in (5, 3, 4, 1, 2)], "id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(9, [1.0])], "query_id long, embedding array<float>")
    assert [r.id for r in vec.ranking(vec.search(queries, corpus, 3)).orderBy("rank").collect()] == [1, 2, 3]


def test_bands_and_gate_are_inclusive_upwards(spark):
    stats = spark.createDataFrame([(0.0179,), (0.018,), (0.0239,), (0.024,)], "score_gap double").withColumn("top1_minus_top5", F.lit(0.0183))
    assert [r.band for r in ev.band(stats).orderBy("score_gap").collect()] == ["refuse", "hedge", "hedge", "answer"]
    assert {r.verdict for r in ev.gate(stats).collect()} == {"PASS"}
    with pytest.raises(ValueError):
        ev.band(stats, 0.5, 0.2)


def test_order_of_rows_changes_nothing(spark):
    a = vec.ranking(search(spark, SCORES)).collect()
    corpus = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(9)]) for i in reversed(range(9))], "id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(100 + q, s) for q, s in SCORES.items()], "query_id long, embedding array<float>")
    assert sorted(a) == sorted(vec.ranking(vec.search(queries, corpus, 5)).collect())


def test_sweep_equals_counting(spark):
    values = [(0.1, True), (0.2, False), (0.2, True), (0.3, False)]
    got = ev.sweep(spark.createDataFrame(values, "value double, found boolean"), spark.createDataFrame([(0.2,), (0.25,)], "threshold double"))
    want = {t: (sum(f and v >= t for v, f in values), sum(not f and v < t for v, f in values)) for t in (0.2, 0.25)}
    assert {r.threshold: (r.kept, r.blocked) for r in got.collect()} == want


def test_sweep_over_many_values_and_none(spark):
    rng = random.Random(4)
    values = [(rng.randrange(300) / 100, rng.random() < 0.4) for _ in range(2000)]
    marks = [i / 50 - 0.1 for i in range(170)]
    shape = spark.createDataFrame(marks, "double").toDF("threshold")
    rows = spark.createDataFrame(values, "value double, found boolean")
    want = {t: (sum(f and v >= t for v, f in values), sum(not f and v < t for v, f in values)) for t in marks}
    assert {r.threshold: (r.kept, r.blocked) for r in ev.sweep(rows, shape).collect()} == want
    assert {(r.kept, r.found_total, r.blocked, r.absent_total) for r in ev.sweep(rows.where("false"), shape).collect()} == {(0, 0, 0, 0)}


def test_nearest_rank_rounds_half_to_even(spark):
    r = ev.nearest_rank(spark.createDataFrame([("a", x) for x in range(6)], "g string, v int"), "g", "v").first()
    assert (r.p10, r.p25, r.p50, r.p75) == (0, 1, 2, 4)  # 0.5, 1.25, 2.5, 3.75
