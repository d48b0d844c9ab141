"""Intervals and points in time: overlap joins, assignment, as-of lookup, merging, gaps.

All joins need an equality key; where a key's intervals are many, bins of time join
the key, so that no task meets all pairs of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.operators.scan import HOT_ROWS, Scan, latest, previous, running

def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_size: int) -> DataFrame:
    """Pairs of (key, id, start, end) and (key, other_id, other_start, other_end) that share more than an instant.

    Adds overlap, and coefficient: the overlap over the shorter length. Intervals are dealt to the bins they
    touch; a pair that meets in several bins counts in its first only.
    """
    bins = lambda s, e: F.explode(F.sequence(F.expr(f"`{s}` div {bin_size}"), F.greatest(F.expr(f"`{s}` div {bin_size}"), F.expr(f"(`{e}` - 1) div {bin_size}"))))
    a = left.withColumn("_bin", bins("start", "end"))
    b = right.withColumn("_bin", bins("other_start", "other_end"))
    start, end = F.greatest("start", "other_start"), F.least("end", "other_end")
    shorter = F.least(F.col("end") - F.col("start"), F.col("other_end") - F.col("other_start"))
    return (
        a.join(b, [key, "_bin"])
        .where((start < end) & (F.col("_bin") == F.floor(start / bin_size)))
        .drop("_bin")
        .withColumns({"overlap": end - start, "coefficient": F.try_divide(end - start, shorter)})
    )


def close_open_ends(marks: DataFrame, key: str, start: str, last: DataFrame) -> DataFrame:
    """Give each mark an ``end``: the next mark's start, or for the last the key's value in ``last`` (key, last)."""
    after = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return marks.join(last, key, "left").withColumn("end", F.coalesce(after, F.col("last"), F.col(start))).drop("last")


def assign(segments: DataFrame, chapters: DataFrame, key: str, bin_size: int) -> DataFrame:
    """Each segment (key, id, start, end) with the index of its chapter (key, idx, chapter_start, chapter_end).

    The chapter of the largest overlap, ties to the lower index; without overlap the one that the start touches; before
    the first chapter the first, after the last the last; else the nearest. Chapters of a key don't overlap, so a segment that meets none lies
    between two that a sort finds; pairs are formed within bins only.
    """
    parts = chapters.select(key, F.col("idx").alias("other_id"), F.col("chapter_start").alias("other_start"), F.col("chapter_end").alias("other_end"))
    met = overlap_join(segments.select(key, "id", "start", "end"), parts, key, bin_size)
    best = met.groupBy(key, "id").agg(F.min(F.struct((-F.col("overlap")).alias("lap"), F.col("other_id").alias("idx"))).alias("best"))
    rest = segments.select(key, "id", "start", "end").join(best.select(key, "id", "best"), [key, "id"], "left")
    one = F.struct("chapter_start", "chapter_end", "idx")
    points = rest.withColumns({"_at": F.col("start"), "_kind": F.lit(1)}).unionByName(
        chapters.select(key, F.col("chapter_start").alias("_at"), F.lit(0).alias("_kind"), one.alias("_c"), F.lag(one).over(Window.partitionBy(key).orderBy("chapter_start", "chapter_end", "idx")).alias("_p")), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("_at", "_kind", F.col("_c.chapter_end"), F.col("_c.idx"))
    later = Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("_kind"), F.desc(F.col("_c.chapter_end")), F.desc(F.col("_c.idx")))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    near = points.withColumns({"_before": F.last("_c", ignorenulls=True).over(upto(order)), "_prior": F.last("_p", ignorenulls=True).over(upto(order)), "_after": F.last("_c", ignorenulls=True).over(upto(later))}).where("_kind = 1")
    away = lambda c: F.when(F.col("start").between(F.col(f"{c}.chapter_start"), F.col(f"{c}.chapter_end")), 0).otherwise(F.least(F.abs(F.col("start") - F.col(f"{c}.chapter_start")), F.abs(F.col("start") - F.col(f"{c}.chapter_end"))))
    nearest = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(away(c).alias("away"), F.col(f"{c}.idx").alias("idx"))) for c in ("_prior", "_before", "_after")])))
    found = near.withColumn("_n", nearest)
    index = F.coalesce("best.idx", "_n.idx")
    return found.select(key, "id", "start", "end", index.alias("chapter_index"), F.when(index.isNotNull(), F.coalesce(-F.col("best.lap"), F.lit(0))).alias("overlap"))


def as_of(points: DataFrame, events: DataFrame, key: str, at: str, value: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Each point with the value of the latest event of its key at or before it, null if there is none.

    ``points`` and ``events`` both have key and ``at``; a scan of their union, no pair is formed. A key of more than ``hot_rows`` rows is
    read in ranges of time.
    """
    both = points.withColumn("_kind", F.lit(1)).unionByName(events.select(key, at, F.col(value).alias("_value"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    scan = Scan(both, key, [at, "_kind"], hot_rows)
    return scan.done(latest(scan, scan.rows, "_value", value)).where("_kind = 1").drop("_kind", "_value")


def merge(spans: DataFrame, key: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Unions of overlapping or touching (key, start, end): start, end and how many were merged.

    The reach of all earlier spans is carried from range to range of a key of more than ``hot_rows`` spans, and so is the number of the island.
    """
    scan = Scan(spans.select(key, "start", "end"), key, ["start", "end"], hot_rows)
    reached = running(scan, scan.rows, "end", "_reach", "max", before=True)
    marked = reached.withColumn("_new", F.when(F.col("start") <= F.col("_reach"), 0).otherwise(1))
    numbered = running(scan, marked, "_new", "_island")
    return numbered.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("_island")


def cut(text: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, text) without the merged ``spans`` (id, start, end), offsets from 0: the pieces between them, in order."""
    merged = merge(spans.withColumnRenamed("id", "key"), "key").withColumnRenamed("key", "id")
    cuts = merged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    pieces = F.expr(
        """aggregate(cuts, named_struct('at', 0L, 'out', ''), (a, c) -> named_struct('at', cast(c.end as bigint),
           'out', concat(a.out, substring(text, cast(a.at + 1 as int), cast(greatest(c.start - a.at, 0) as int)))),
           a -> concat(a.out, substring(text, cast(a.at + 1 as int), length(text))))"""
    )
    return text.join(cuts, "id", "left").select("id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(pieces).alias("text"))


def gaps(rows: DataFrame, key: str, start: str, end: str, least: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add gap (to the end of the row before) and soft_before: whether it is ``least`` or more. A key of more than ``hot_rows`` rows is read in ranges."""
    scan = Scan(rows, key, [start, end], hot_rows)
    gap = previous(scan, scan.rows, end, "_e").withColumn("gap", F.col(start) - F.col("_e")).drop("_e")
    return scan.done(gap).withColumn("soft_before", F.coalesce(F.col("gap") >= least, F.lit(False)))
