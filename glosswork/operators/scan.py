"""Segmented scans with carry: what a row takes from the rows before it under its key, even where one key holds most rows.

A window by key puts all rows of a key in one task. Here only keys of bounded size are left to
that; rows of greater ones are dealt to ranges of their order, each range is read by itself, and what it leaves for the next, a
row for each range and key, is combined in order and carried in. Any state with an associative combination will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.operators.durable import written

#: Rows of a key up to which one task reads them all.
HOT_ROWS = 1_000_000
#: Columns that a scan adds to rows: the range (-1: the whole key), and the place within it among rows that tie.
RANGE, PLACE = "_range", "_place"


class Scan:
    """Rows in an order under a key, hot keys in ranges.

    ``rows`` are the rows with RANGE and PLACE; windows over ``window`` see the rows of a range and key; ``carry`` gives what came before.
    Rows that tie in ``order`` keep one arbitrary order throughout. A null key is a key, nulls in the order come first. Without hot keys nothing is
    written and every range is a whole key.
    """

    def __init__(self, rows: DataFrame, key: str, order: list[str], hot_rows: int | None = HOT_ROWS) -> None:
        self.key, self.order = key, order
        self.window = Window.partitionBy(RANGE, key).orderBy(*order, PLACE)
        whole = {RANGE: F.lit(-1), PLACE: F.lit(0).cast("long")}
        hot = None
        if hot_rows is not None:
            hot = written(rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select("_k"))  # rows / hot_rows keys at most
        self.split = hot is not None and not hot.isEmpty()
        if not self.split:
            self.rows = rows.withColumns(whole)
            return
        same = F.col(key).eqNullSafe(F.col("_k"))
        ranged = (
            rows.join(F.broadcast(hot), same, "left_semi")
            .withColumn("_tie", F.monotonically_increasing_id())
            .repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, *order, "_tie")
            .sortWithinPartitions(key, *order, "_tie")
            .drop("_tie")
            .withColumns({RANGE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
        )
        # ranges are drawn from samples, which need not come out the same twice
        self.rows = rows.join(F.broadcast(hot), same, "left_anti").withColumns(whole).unionByName(written(ranged))

    def carry(self, rows: DataFrame, name: str, summary: dict[str, Column], combine: Callable[[dict, dict], dict]) -> DataFrame:
        """Add ``name``: a struct of what all earlier ranges of the row's key sum up to, null in the first.

        ``summary`` are aggregates over the rows of one range and key (order-dependent ones by ``place``); ``combine`` takes the
        sums of two stretches, the earlier first. ``rows`` are this scan's, with more columns if you like.
        """
        fields = F.struct(*[c.alias(f) for f, c in summary.items()])
        kind = rows.where("false").agg(fields.alias("s")).schema["s"].dataType
        if not self.split:
            return rows.withColumn(name, F.lit(None).cast(kind))
        parts = rows.where(F.col(RANGE) >= 0).groupBy(RANGE, F.col(self.key).alias("_k")).agg(fields.alias("s"), F.min(PLACE).alias("_first"))
        state, before, into = None, None, []
        for r in sorted(parts.collect(), key=lambda r: (r[RANGE], r["_first"])):  # a row for each range and hot key
            if before is None or before[0] != r["_k"]:
                state = None
            if state is not None:
                into.append((r[RANGE], r["_k"], tuple(state[f] for f in summary)))
            found = r["s"].asDict(recursive=False)
            state, before = found if state is None else combine(state, found), (r["_k"],)
        carried = rows.sparkSession.createDataFrame(into, f"_r int, _k {rows.schema[self.key].dataType.simpleString()}, `{name}` {kind.simpleString()}")
        return rows.join(F.broadcast(carried), (F.col(RANGE) == F.col("_r")) & F.col(self.key).eqNullSafe(F.col("_k")), "left").drop("_r", "_k")

    def place(self) -> Column:
        """What orders the rows of one range and key; for ``max_by`` and ``min_by``."""
        return F.struct(*self.order, PLACE)

    def done(self, rows: DataFrame) -> DataFrame:
        return rows.drop(RANGE, PLACE)


def latest(scan: Scan, rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: the last value that isn't null up to the row, itself included."""
    inside = F.last(value, ignorenulls=True).over(scan.window.rowsBetween(Window.unboundedPreceding, 0))
    last = {"value": F.max_by(value, F.when(F.col(value).isNotNull(), scan.place()))}
    carried = scan.carry(rows, "_c", last, lambda a, b: a if b["value"] is None else b)
    return carried.withColumn(name, F.coalesce(inside, F.col("_c.value"))).drop("_c")


def previous(scan: Scan, rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: the value of the row before, null for a key's first."""
    held = F.lag(F.struct(F.col(value).alias("value"))).over(scan.window)
    carried = scan.carry(rows, "_c", {"value": F.max_by(F.struct(F.col(value).alias("value")), scan.place())}, lambda a, b: b)
    return carried.withColumn(name, F.coalesce(held, F.col("_c.value"))["value"]).drop("_c")


def running(scan: Scan, rows: DataFrame, value: str, name: str, how: str = "sum", *, before: bool = False) -> DataFrame:
    """Add ``name``: sum, max or min of ``value`` up to the row; with ``before`` without the row itself. Nulls don't count."""
    of = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    join = {"sum": lambda a, b: a + b, "max": max, "min": min}[how]
    both = lambda a, b: {"value": a["value"] if b["value"] is None else b["value"] if a["value"] is None else join(a["value"], b["value"])}
    inside = of(value).over(scan.window.rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    carried = scan.carry(rows, "_c", {"value": of(value)}, both)
    put = {"sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": F.greatest, "min": F.least}[how]
    return carried.withColumn("_i", inside).withColumn(name, put(F.col("_c.value"), F.col("_i"))).drop("_c", "_i")
