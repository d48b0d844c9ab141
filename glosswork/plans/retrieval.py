"""Vector retrieval, gates and retrieval measures over ``embeddings``.

The stated query set is every row whose id is divisible by 100, searched against all
rows but itself; vectors of the same label count as relevant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators import evaluate as ev
from glosswork.operators import vectors as vec
from glosswork.operators.order import quantiles
from glosswork.sources.tables import table

#: Margin that tells this table's queries apart; the default passes all of them.
MARGIN = 0.07


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _corpus(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding", "label")


def _found(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    return vec.search(_queries(spark, d), _corpus(spark, d), k)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return vec.score_statistics(_found(spark, d))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Relevant ids by label; the span of an id is one of three."""
    q = _queries(spark, d).select("query_id", "label")
    c = _corpus(spark, d).select("id", "label", (F.col("id") % 3).alias("span_id"))
    return q.join(c, "label").where("id != query_id").select("query_id", "span_id", "id")


def _per_query(spark: SparkSession, d: str) -> DataFrame:
    items = _corpus(spark, d).select("id", "label", (F.col("id") % 3).alias("span_id"))
    return ev.per_query_of_classes(vec.ranking(_found(spark, d)), _queries(spark, d).select("query_id", "label"), items, "label")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vec.ranking(_found(spark, d))).withColumnRenamed("id", "vec_id")


def cross_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vec.pair_scores(_queries(spark, d), _corpus(spark, d))).withColumnRenamed("id", "vec_id")


def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vec.pair_scores(_queries(spark, d), _corpus(spark, d), cosine=True)).withColumnRenamed("id", "vec_id")


def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_stats(spark, d))


def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.gate(_stats(spark, d), threshold=MARGIN).select("query_id", "top1_minus_top5", "verdict"))


def gate_band(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.band(_stats(spark, d), 0.36, 0.42).select("query_id", "score_gap", "band"))


def ir_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_per_query(spark, d))


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ev.totals(_per_query(spark, d))


def ir_metrics_scored(spark: SparkSession, d: str) -> DataFrame:
    """Measures over queries with gold only, here those whose label is even; the others are counted apart."""
    q = _queries(spark, d)
    scored = ev.totals(_per_query(spark, d).join(q.where("label % 2 = 0").select("query_id"), "query_id", "left_semi"))
    return scored.crossJoin(F.broadcast(q.agg(F.expr("count_if(label % 2 != 0)").alias("refuse_only"))))


def gate_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts against labels: quality 1 expects an answer, 0 a refusal."""
    expected = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("quality") == 1, "ANSWER").otherwise("REFUSE").alias("expected"))
    return ev.agreement(ev.gate(_stats(spark, d), threshold=MARGIN).join(expected, "query_id"))


def _before(spark: SparkSession, d: str) -> DataFrame:
    """Statistics over the smaller corpus of labels below 5, as they were before the rest came in."""
    return vec.score_statistics(vec.search(_queries(spark, d), _corpus(spark, d).where("label < 5"), 5))


def gap_decomposition(spark: SparkSession, d: str) -> DataFrame:
    old = _before(spark, d).select("query_id", F.col("top1_score").alias("t"), F.col("corpus_mean_score").alias("m"), F.col("score_gap").alias("g"))
    out = _stats(spark, d).join(old, "query_id").select(
        "query_id", (F.col("top1_score") - F.col("t")).alias("d_top1"), (F.col("m") - F.col("corpus_mean_score")).alias("d_mean_drop"), (F.col("score_gap") - F.col("g")).alias("d_gap")
    )
    return _rounded(out.withColumn("moved", F.col("d_top1") > 0.001))


def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    """Each query's gap and its change against a baseline that had no queries of the new labels (from 5): null there."""
    old = _before(spark, d).join(_queries(spark, d).where("label < 5").select("query_id"), "query_id", "left_semi").select("query_id", F.col("score_gap").alias("old_gap"))
    return _rounded(_stats(spark, d).select("query_id", "score_gap").join(old, "query_id", "left").withColumn("delta", F.col("score_gap") - F.col("old_gap")))


def slot_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of the top 5: rows of the new part of the corpus (label from 5), rows of the query's own label, and the gate before and after."""
    ranks = vec.ranking(_found(spark, d)).join(_corpus(spark, d).select("id", "label"), "id").join(_queries(spark, d).select("query_id", F.col("label").alias("slot")), "query_id")
    seen = ranks.groupBy("query_id").agg(F.expr("count_if(label >= 5)").alias("new_in_top5"), F.expr("count_if(label = slot)").alias("on_target"))
    gate = lambda s, n: ev.gate(s, threshold=MARGIN).select("query_id", F.col("verdict").alias(n))
    return seen.join(gate(_before(spark, d), "gate_before"), "query_id").join(gate(_stats(spark, d), "gate_after"), "query_id")


def miss_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    groups = _corpus(spark, d).select("id", F.col("label").alias("grp"))
    return ev.misses(vec.ranking(_found(spark, d)), _per_query(spark, d), groups)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ev.outcome(_per_query(spark, d)).join(_stats(spark, d), "query_id")


def signal_summary(spark: SparkSession, d: str) -> DataFrame:
    gap = F.col("score_gap")
    return _rounded(_outcomes(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min(gap).alias("lo"), F.max(gap).alias("hi"), F.avg(gap).alias("mean"), (100.0 * F.count_if(gap >= 0.4) / F.count(F.lit(1))).alias("pct_from_04")))


def median_by_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(quantiles(_outcomes(spark, d), "outcome", "score_gap", {"median_gap": 0.5}, between=True))


def nearest_rank_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of document length for each language."""
    return ev.nearest_rank(table(spark, d, "documents").select("lang", "n_chars"), "lang", "n_chars")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of queries (found) and of their reversed vectors, which the corpus doesn't cover (absent), to four places."""
    gap = F.round("score_gap", 4).alias("value")
    return _stats(spark, d).select(gap, F.lit(True).alias("found")).unionByName(_absent(spark, d).select(gap, F.lit(False).alias("found")))


def _absent(spark: SparkSession, d: str) -> DataFrame:
    reversed_queries = _queries(spark, d).select("query_id", F.reverse("embedding").alias("embedding"))
    return vec.score_statistics(vec.search(reversed_queries, _corpus(spark, d), 5))


def ooc_probe(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_absent(spark, d).drop("top5_std"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(20, 61).select((F.col("id") / 100).alias("threshold"))
    return ev.sweep(_gaps(spark, d), grid)


def tradeoff_curve(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds from the data: the absent values and five percent above the largest."""
    gaps = _gaps(spark, d)
    absent = gaps.where("not found")
    marks = absent.select(F.col("value").alias("threshold")).unionByName(absent.agg(F.round(F.max("value") * 1.05, 4).alias("threshold")).where("threshold is not null")).distinct()
    return ev.sweep(gaps, marks)


def separability(spark: SparkSession, d: str) -> DataFrame:
    """Least found gap, greatest absent gap, whether they separate and the midpoint."""
    return _gaps(spark, d).agg(F.min(F.when(F.col("found"), F.col("value"))).alias("min_found"), F.max(F.when(~F.col("found"), F.col("value"))).alias("max_absent")).select(
        "min_found", "max_absent", (F.col("min_found") > F.col("max_absent")).alias("separable"), F.round((F.col("min_found") + F.col("max_absent")) / 2, 6).alias("midpoint")
    )


def gold_missing_check(spark: SparkSession, d: str) -> DataFrame:
    """Queries without gold that aren't marked as missing. Gold: found in the top 5 under the query's label; label 3 is marked missing."""
    gold = _per_query(spark, d).where("first_relevant_rank is not null")
    q = _queries(spark, d).select("query_id", F.when(F.col("label") == 3, "missing").otherwise("answerable").alias("coverage"))
    return q.join(gold, "query_id", "left_anti").where("coverage != 'missing'").select("query_id", "coverage")


_Q = """q AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0)"""
_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _scores_sql(name: str, vector: str = "q.embedding", where: str = "TRUE") -> str:
    return f"""s{name} AS (SELECT q.query_id, c.vec_id, c.label, {_DOT.format(a=vector, b='c.embedding')} AS score
  FROM q JOIN embeddings c ON c.vec_id <> q.query_id WHERE {where}),
r{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s{name}),
st{name} AS (SELECT query_id, max(score) AS top1_score, avg(score) AS corpus_mean_score, max(score) - avg(score) AS score_gap,
  max(score) - max(CASE WHEN rank = 2 THEN score END) AS top1_minus_top2, max(score) - max(CASE WHEN rank = 5 THEN score END) AS top1_minus_top5,
  CASE WHEN count(*) >= 5 THEN stddev_pop(CASE WHEN rank <= 5 THEN score END) END AS top5_std FROM r{name} GROUP BY query_id)"""


_BASE = f"WITH {_Q}, {_scores_sql('')}"
_GOLD = """g AS (SELECT q.query_id, c.vec_id % 3 AS span_id, c.vec_id FROM q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.query_id)"""
_PER_QUERY = """p AS (SELECT g.query_id, count(DISTINCT g.vec_id) AS relevant_count, count(DISTINCT g.span_id) AS span_count,
  min(r.rank) AS first_relevant_rank, coalesce(1.0 / min(r.rank), 0.0) AS reciprocal_rank,
  count(DISTINCT r.vec_id) / count(DISTINCT g.vec_id) AS recall,
  count(DISTINCT CASE WHEN r.vec_id IS NOT NULL THEN g.span_id END) AS covered_spans,
  count(DISTINCT CASE WHEN r.vec_id IS NOT NULL THEN g.span_id END) / count(DISTINCT g.span_id) AS span_recall
  FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.vec_id = g.vec_id AND r.rank <= 5 GROUP BY g.query_id)"""
_TOTALS = """count(*) AS queries, count(*) FILTER (WHERE first_relevant_rank <= 1) AS hit1, count(*) FILTER (WHERE first_relevant_rank <= 3) AS hit3,
  count(*) FILTER (WHERE first_relevant_rank <= 5) AS hit5, round(coalesce(avg(reciprocal_rank), 0.0), 6) AS mrr, round(coalesce(avg(recall), 0.0), 6) AS recall,
  round(coalesce(avg(span_recall), 0.0), 6) AS span_recall, CAST(coalesce(sum(covered_spans), 0) AS BIGINT) AS covered_spans, CAST(coalesce(sum(span_count), 0) AS BIGINT) AS total_spans,
  round(coalesce(sum(covered_spans) / nullif(sum(span_count), 0), 0.0), 6) AS span_coverage"""
_FULL = f"{_BASE}, {_GOLD}, {_PER_QUERY}"
_OUTCOME = f"""{_FULL}, o AS (SELECT p.*, st.* EXCLUDE (query_id), CASE WHEN first_relevant_rank = 1 THEN 'top1' WHEN first_relevant_rank <= 5 THEN 'lower' ELSE 'missed' END AS outcome
  FROM p JOIN st USING (query_id))"""
_GAPS = f"""WITH {_Q}, {_scores_sql('')}, {_scores_sql('x', 'list_reverse(q.embedding)')},
v AS (SELECT round(score_gap, 4) AS value, TRUE AS found FROM st UNION ALL SELECT round(score_gap, 4), FALSE FROM stx)"""
_SWEEP = """SELECT threshold, count(*) FILTER (WHERE found AND value >= threshold) AS kept, count(*) FILTER (WHERE found) AS found_total,
  count(*) FILTER (WHERE NOT found AND value < threshold) AS blocked, count(*) FILTER (WHERE NOT found) AS absent_total FROM v, t GROUP BY threshold"""
_OLD = f"WITH {_Q}, {_scores_sql('')}, {_scores_sql('o', where='c.label < 5')}"

QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, cross_scores, cosine_scores, score_stats, gate_verdict, gate_band, ir_per_query, ir_metrics, ir_metrics_scored, gate_agreement, gap_decomposition,
        baseline_delta, slot_coverage, miss_diagnosis, signal_summary, median_by_outcome, nearest_rank_quantiles, ooc_probe, threshold_sweep, tradeoff_curve, separability, gold_missing_check,
    )
}
ORACLES = {
    "dense_topk": f"{_BASE} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5",
    "cross_scores": f"{_BASE} SELECT query_id, vec_id, round(score, 6) AS score FROM s",
    "cosine_scores": f"""WITH {_Q} SELECT q.query_id, c.vec_id, round({_DOT.format(a='q.embedding', b='c.embedding')} /
        (sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({_DOT.format(a='c.embedding', b='c.embedding')})), 6) AS score FROM q JOIN embeddings c ON c.vec_id <> q.query_id""",
    "score_stats": f"""{_BASE} SELECT query_id, round(top1_score, 6) AS top1_score, round(corpus_mean_score, 6) AS corpus_mean_score, round(score_gap, 6) AS score_gap,
        round(top1_minus_top2, 6) AS top1_minus_top2, round(top1_minus_top5, 6) AS top1_minus_top5, round(top5_std, 6) AS top5_std FROM st""",
    "gate_verdict": f"{_BASE} SELECT query_id, round(top1_minus_top5, 6) AS top1_minus_top5, CASE WHEN top1_minus_top5 IS NULL OR top1_minus_top5 >= {MARGIN} THEN 'PASS' ELSE 'REFUSE' END AS verdict FROM st",
    "gate_band": f"{_BASE} SELECT query_id, round(score_gap, 6) AS score_gap, CASE WHEN score_gap < 0.36 THEN 'refuse' WHEN score_gap < 0.42 THEN 'hedge' ELSE 'answer' END AS band FROM st",
    "ir_per_query": f"{_FULL} SELECT query_id, relevant_count, span_count, first_relevant_rank, round(reciprocal_rank, 6) AS reciprocal_rank, round(recall, 6) AS recall, covered_spans, round(span_recall, 6) AS span_recall FROM p",
    "ir_metrics": f"{_FULL} SELECT {_TOTALS} FROM p",
    "ir_metrics_scored": f"{_FULL} SELECT {_TOTALS}, (SELECT count(*) FROM q WHERE label % 2 <> 0) AS refuse_only FROM p WHERE query_id IN (SELECT query_id FROM q WHERE label % 2 = 0)",
    "gate_agreement": f"""{_BASE}, e AS (SELECT CASE WHEN l.quality = 1 THEN 'ANSWER' ELSE 'REFUSE' END AS expected, CASE WHEN top1_minus_top5 IS NULL OR top1_minus_top5 >= {MARGIN} THEN 'PASS' ELSE 'REFUSE' END AS verdict
        FROM st JOIN labels l ON l.doc_id = st.query_id) SELECT count(*) AS fixtures, count(*) FILTER (WHERE (verdict = 'PASS') = (expected = 'ANSWER')) AS agreed,
        greatest(count(*) FILTER (WHERE expected = 'ANSWER'), count(*) FILTER (WHERE expected <> 'ANSWER')) AS majority_baseline FROM e""",
    "gap_decomposition": f"""{_OLD} SELECT st.query_id, round(st.top1_score - sto.top1_score, 6) AS d_top1, round(sto.corpus_mean_score - st.corpus_mean_score, 6) AS d_mean_drop,
        round(st.score_gap - sto.score_gap, 6) AS d_gap, st.top1_score - sto.top1_score > 0.001 AS moved FROM st JOIN sto USING (query_id)""",
    "baseline_delta": f"""{_OLD} SELECT st.query_id, round(st.score_gap, 6) AS score_gap, round(sto.score_gap, 6) AS old_gap, round(st.score_gap - sto.score_gap, 6) AS delta
        FROM st LEFT JOIN (sto JOIN q USING (query_id)) ON sto.query_id = st.query_id AND q.label < 5""",
    "slot_coverage": f"""{_OLD} SELECT r.query_id, count(*) FILTER (WHERE r.label >= 5) AS new_in_top5, count(*) FILTER (WHERE r.label = q.label) AS on_target,
        CASE WHEN any_value(sto.top1_minus_top5) IS NULL OR any_value(sto.top1_minus_top5) >= {MARGIN} THEN 'PASS' ELSE 'REFUSE' END AS gate_before,
        CASE WHEN any_value(st.top1_minus_top5) IS NULL OR any_value(st.top1_minus_top5) >= {MARGIN} THEN 'PASS' ELSE 'REFUSE' END AS gate_after
        FROM r JOIN q USING (query_id) JOIN st USING (query_id) JOIN sto USING (query_id) WHERE r.rank <= 5 GROUP BY r.query_id""",
    "miss_diagnosis": f"""{_FULL} SELECT p.query_id, p.first_relevant_rank, t.label AS top_group, f.label AS gold_group,
        CASE WHEN p.first_relevant_rank IS NULL THEN 'MISSED' WHEN f.label = t.label THEN 'SAME' ELSE 'DIFF' END AS verdict
        FROM p LEFT JOIN r t ON t.query_id = p.query_id AND t.rank = 1 LEFT JOIN r f ON f.query_id = p.query_id AND f.rank = p.first_relevant_rank
        WHERE p.first_relevant_rank IS NULL OR p.first_relevant_rank <> 1""",
    "signal_summary": f"{_OUTCOME} SELECT outcome, count(*) AS n, round(min(score_gap), 6) AS lo, round(max(score_gap), 6) AS hi, round(avg(score_gap), 6) AS mean, round(100.0 * count(*) FILTER (WHERE score_gap >= 0.4) / count(*), 6) AS pct_from_04 FROM o GROUP BY outcome",
    "median_by_outcome": f"{_OUTCOME} SELECT outcome, count(*) AS n, round(quantile_cont(score_gap, 0.5), 6) AS median_gap FROM o GROUP BY outcome",
    "nearest_rank_quantiles": """WITH l AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang)
        SELECT lang, len(v) AS n, v[CAST(round_even(0.10 * (len(v) - 1), 0) AS BIGINT) + 1] AS p10, v[CAST(round_even(0.25 * (len(v) - 1), 0) AS BIGINT) + 1] AS p25,
        v[CAST(round_even(0.50 * (len(v) - 1), 0) AS BIGINT) + 1] AS p50, v[CAST(round_even(0.75 * (len(v) - 1), 0) AS BIGINT) + 1] AS p75 FROM l""",
    "ooc_probe": f"""WITH {_Q}, {_scores_sql('', 'list_reverse(q.embedding)')} SELECT query_id, round(top1_score, 6) AS top1_score, round(corpus_mean_score, 6) AS corpus_mean_score,
        round(score_gap, 6) AS score_gap, round(top1_minus_top2, 6) AS top1_minus_top2, round(top1_minus_top5, 6) AS top1_minus_top5 FROM st""",
    "threshold_sweep": f"{_GAPS}, t AS (SELECT i / 100 AS threshold FROM range(20, 61) AS x(i)) {_SWEEP}",
    "tradeoff_curve": f"{_GAPS}, t AS (SELECT DISTINCT value AS threshold FROM v WHERE NOT found UNION SELECT round(max(value) * 1.05, 4) FROM v WHERE NOT found) {_SWEEP}",
    "separability": f"""{_GAPS}, a AS (SELECT min(value) FILTER (WHERE found) AS min_found, max(value) FILTER (WHERE NOT found) AS max_absent FROM v)
        SELECT min_found, max_absent, min_found > max_absent AS separable, round((min_found + max_absent) / 2, 6) AS midpoint FROM a""",
    "gold_missing_check": f"""{_FULL} SELECT query_id, 'answerable' AS coverage FROM q WHERE label <> 3 AND query_id NOT IN (SELECT query_id FROM p WHERE first_relevant_rank IS NOT NULL)""",
}
