"""Gates on score statistics and retrieval measures. Every function maps DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as tx
from glosswork.operators.durable import written
from glosswork.operators.order import quantiles
from glosswork.operators.sampling import running

#: Default threshold of each gate signal, and the two bounds of the bands.
GATE_THRESHOLDS = {"score_gap": 0.024, "top1_minus_top2": 0.011, "top1_minus_top5": 0.0183}
REFUSE_BELOW, ANSWER_FROM = 0.018, 0.024


def gate(stats: DataFrame, signal: str = "top1_minus_top5", threshold: float | None = None) -> DataFrame:
    """Add verdict: PASS from the threshold on, else REFUSE; a missing signal passes."""
    limit = GATE_THRESHOLDS[signal] if threshold is None else threshold
    value = F.col(signal)
    return stats.withColumn("verdict", F.when(value.isNull() | (value >= limit), "PASS").otherwise("REFUSE"))


def band(stats: DataFrame, refuse_below: float = REFUSE_BELOW, answer_from: float = ANSWER_FROM, signal: str = "score_gap") -> DataFrame:
    """Add band: refuse, hedge or answer; a value on a bound belongs to the upper band."""
    if not 0 <= refuse_below <= answer_from:
        raise ValueError("0 <= refuse_below <= answer_from must hold")
    value = F.col(signal)
    return stats.withColumn("band", F.when(value < refuse_below, "refuse").when(value < answer_from, "hedge").otherwise("answer"))


def per_query(ranks: DataFrame, gold: DataFrame, cutoff: int = 5) -> DataFrame:
    """One row per query with gold: first relevant rank, reciprocal rank, recall and span recall at ``cutoff``.

    ``ranks`` is (query_id, rank, id), ``gold`` (query_id, span_id, id): the ids that answer each span.
    """
    relevant = gold.groupBy("query_id").agg(F.countDistinct("id").alias("relevant_count"), F.countDistinct("span_id").alias("span_count"))
    hits = ranks.where(F.col("rank") <= cutoff).join(gold, ["query_id", "id"])
    met = hits.groupBy("query_id").agg(F.min("rank").alias("first_relevant_rank"), F.countDistinct("id").alias("found"), F.countDistinct("span_id").alias("covered_spans"))
    return _measured(relevant, met)


def _measured(relevant: DataFrame, met: DataFrame) -> DataFrame:
    none = lambda c: F.coalesce(c, F.lit(0))
    return relevant.join(met, "query_id", "left").select(
        "query_id",
        "relevant_count",
        "span_count",
        "first_relevant_rank",
        F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        (none("found") / F.col("relevant_count")).alias("recall"),
        none("covered_spans").alias("covered_spans"),
        (none("covered_spans") / F.col("span_count")).alias("span_recall"),
    )


def per_query_of_classes(ranks: DataFrame, queries: DataFrame, items: DataFrame, cls: str, cutoff: int = 5) -> DataFrame:
    """``per_query`` where all items of a query's class but itself are gold: (id, cls, span_id) and (query_id, cls).

    Gold is counted by class and span and looked up for what was found, so it is never listed for each query.
    """
    spans = items.groupBy(cls, "span_id").agg(F.count(F.lit(1)).alias("k"))
    whole = spans.groupBy(cls).agg(F.sum("k").alias("_n"), F.count(F.lit(1)).alias("_spans"))
    own = queries.join(items.select(F.col("id").alias("query_id"), F.col("span_id").alias("_own"), F.col(cls).alias("_class")), "query_id", "left")
    alone = spans.where("k = 1").select(cls, F.col("span_id").alias("_own"), F.lit(1).alias("_alone"))
    inside = F.coalesce(F.col("_class") == F.col(cls), F.lit(False))
    many = own.join(whole, cls).join(alone, [cls, "_own"], "left").select(
        "query_id", cls, (F.col("_n") - inside.cast("int")).alias("relevant_count"), (F.col("_spans") - F.coalesce(F.when(inside, F.col("_alone")), F.lit(0))).alias("span_count")
    ).where("relevant_count > 0")
    hits = ranks.where(F.col("rank") <= cutoff).where("id != query_id").join(many.select("query_id", cls), "query_id").join(items, ["id", cls])
    met = hits.groupBy("query_id").agg(F.min("rank").alias("first_relevant_rank"), F.count(F.lit(1)).alias("found"), F.size(F.collect_set("span_id")).cast("long").alias("covered_spans"))
    return _measured(many.drop(cls), met)


def totals(rows: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row over all queries: hits, mean reciprocal rank, recall and span measures; ratios of nothing are zero."""
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n)
    hits = [F.count_if(F.col("first_relevant_rank") <= k).alias(f"hit{k}") for k in cutoffs]
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        *hits,
        mean("reciprocal_rank", "mrr"),
        mean("recall", "recall"),
        mean("span_recall", "span_recall"),
        F.coalesce(F.sum("covered_spans"), F.lit(0)).alias("covered_spans"),
        F.coalesce(F.sum("span_count"), F.lit(0)).alias("total_spans"),
        F.round(F.coalesce(F.try_divide(F.sum("covered_spans"), F.sum("span_count")), F.lit(0.0)), 6).alias("span_coverage"),
    )


def agreement(verdicts: DataFrame) -> DataFrame:
    """One row: how often verdict (PASS, REFUSE) and expected (ANSWER, REFUSE) agree, and what the majority would get."""
    agrees = (F.col("verdict") == "PASS") == (F.col("expected") == "ANSWER")
    answers = F.count_if(F.col("expected") == "ANSWER")
    return verdicts.agg(
        F.count(F.lit(1)).alias("fixtures"),
        F.count_if(agrees).alias("agreed"),
        F.greatest(answers, F.count(F.lit(1)) - answers).alias("majority_baseline"),
    )


def outcome(rows: DataFrame, cutoff: int = 5) -> DataFrame:
    """Add outcome: top1, lower (found by ``cutoff`` but not first) or missed."""
    rank = F.col("first_relevant_rank")
    return rows.withColumn("outcome", F.when(rank == 1, "top1").when(rank <= cutoff, "lower").otherwise("missed"))


def sweep(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each threshold, how many found values stay (value >= threshold) and how many absent ones go.

    ``values`` has value and found (boolean). Values are pre-aggregated, sorted once by ranges and met with the
    thresholds through running sums, so no pair of value and threshold is formed and no task holds all values.
    """
    marks = thresholds.select(F.col("threshold").alias("v"), F.lit(0).alias("f"), F.lit(0).alias("a"), F.lit(True).alias("mark")).distinct()
    counted = written(values.groupBy("value", "found").count())
    points = counted.select(F.col("value").alias("v"), F.when(F.col("found"), F.col("count")).otherwise(0).alias("f"), F.when(~F.col("found"), F.col("count")).otherwise(0).alias("a"), F.lit(False).alias("mark"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    whole = counted.agg(total(F.col("found")).alias("found_total"), total(~F.col("found")).alias("absent_total"))
    run = running(marks.unionByName(points), ["f", "a"], "v", F.desc("mark")).where("mark").select("v", F.col("upto_f").alias("below_found"), F.col("upto_a").alias("below_absent"))
    return run.crossJoin(F.broadcast(whole)).select(F.col("v").alias("threshold"), (F.col("found_total") - F.col("below_found")).alias("kept"), "found_total", F.col("below_absent").alias("blocked"), "absent_total")


def nearest_rank(values: DataFrame, group: str, value: str, fractions: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75)) -> DataFrame:
    """Quantiles by nearest rank, the index f * (n - 1) rounded half to even, for each group. Nulls don't count."""
    return quantiles(values, group, value, {f"p{round(f * 100)}": f for f in fractions})


def misses(ranks: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Queries whose first hit is not at rank 1: SAME or DIFF by the groups of rank 1 and first hit, else MISSED.

    ``groups`` is (id, grp); ``rows`` has query_id and first_relevant_rank.
    """
    ranked = ranks.join(groups, "id", "left")
    first = ranked.where("rank = 1").select("query_id", F.col("grp").alias("top_group"))
    late = rows.where("first_relevant_rank is null or first_relevant_rank != 1").select("query_id", "first_relevant_rank")
    gold = ranked.select("query_id", F.col("rank").alias("first_relevant_rank"), F.col("grp").alias("gold_group"))
    joined = late.join(first, "query_id", "left").join(gold, ["query_id", "first_relevant_rank"], "left")
    return joined.withColumn("verdict", F.when(F.col("first_relevant_rank").isNull(), "MISSED").when(F.col("gold_group") == F.col("top_group"), "SAME").otherwise("DIFF"))


def gold_coverage(queries: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, coverage, refs, gold, verdict): whether each query's given gold can be used.

    ``queries`` has query_id and coverage, ``gold`` rows (query_id, chunk_id) as they were given, ``chunks`` the ids (chunk_id) that may be found. ``refs`` are
    a query's distinct references, ``gold`` those that are chunks. Verdict: ``gold`` with some; ``none expected`` without any where coverage says ``missing``,
    as nothing to be found is the right answer there; else ``error``, a null coverage included: gold that dwindles in silence makes measures look better.
    """
    refs = gold.select("query_id", "chunk_id").distinct().join(chunks.select("chunk_id", F.lit(1).alias("_held")).distinct(), "chunk_id", "left")
    counted = refs.groupBy("query_id").agg(F.count(F.lit(1)).alias("refs"), F.count("_held").alias("gold"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = queries.join(counted, "query_id", "left").select("query_id", "coverage", zero("refs"), zero("gold"))
    return rows.withColumn("verdict", F.when(F.col("gold") > 0, "gold").when(F.col("coverage") == "missing", "none expected").otherwise("error"))


def keyword_presence(found: DataFrame, queries: DataFrame, corpus: DataFrame, keywords: list[str]) -> DataFrame:
    """(query_id, word, ranks, in_corpus, verdict): where each keyword stands in what each query found, literally.

    ``found`` has query_id, rank and id, ``corpus`` id and text. Verdict: ``found`` if a result holds the word; ``ranking`` if only other texts of the
    corpus do; ``collection`` if none does. ``ranks`` are joined by bars. A query that found nothing has every word too. Keywords are a short list; texts are read once.
    """
    held = corpus.select("id", tx.matching(F.col("text"), keywords).alias("_m"))
    everywhere = held.select(F.explode("_m").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("in_corpus"))
    met = found.join(held, "id").select("query_id", "rank", F.explode("_m").alias("word")).groupBy("query_id", "word").agg(F.array_join(F.array_sort(F.collect_list("rank")).cast("array<string>"), "|").alias("ranks"))
    every = queries.select("query_id", F.explode(F.array(*[F.lit(w) for w in keywords])).alias("word"))
    rows = every.join(met, ["query_id", "word"], "left").join(F.broadcast(everywhere), "word", "left")  # a row for each keyword
    verdict = F.when(F.col("ranks").isNotNull(), "found").when(F.col("in_corpus") > 0, "ranking").otherwise("collection")
    return rows.select("query_id", "word", F.coalesce("ranks", F.lit("")).alias("ranks"), F.coalesce("in_corpus", F.lit(0)).cast("long").alias("in_corpus"), verdict.alias("verdict"))
