"""Exact order statistics of many groups at once, by narrowing ranges of values: no group's values meet in one task or row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.operators.durable import written

#: Bins that a range is cut into each round, and values of a range that may be gathered in a row in the end.
BINS, GATHERED = 256, 10_000


def at_ranks(rows: DataFrame, targets: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """(g, name, value): the value at each target's rank, counted from 0, among the values of its group.

    ``rows`` has g and v, v neither null nor infinite; ``targets`` has g, name, rank, and lo, hi and n of its group. Every round counts the values of
    each open range in BINS bins, merged where rows are read, and goes on with the bin that holds the rank, from its least value to its greatest.
    Ranges of one value are settled, those of ``gathered`` values at most are sorted in a row. Ranks out of range give nothing.
    """
    open_, settled = written(targets), None
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("lo") == F.col("_at")) & (F.col("hi") == F.col("_to"))
    ranged = lambda df: df.withColumnsRenamed({"g": "_g", "lo": "_at", "hi": "_to"})
    met = lambda ranges: rows.alias("r").join(ranges.alias("t"), F.col("r.g").eqNullSafe(F.col("t.g")) & F.col("r.v").between(F.col("t.lo"), F.col("t.hi"))).select("t.g", "lo", "hi", "v")
    while True:
        wide = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > gathered))
        narrow = open_.where((F.col("lo") == F.col("hi")) | (F.col("n") <= gathered))
        settled = narrow if settled is None else settled.unionByName(narrow)
        if wide.isEmpty():
            break
        half = lambda c: F.col(c).cast("double") / 2  # noqa: E731  so that differences stay finite
        bin_ = F.least(F.floor((half("v") - half("lo")) / (half("hi") - half("lo")) * BINS), F.lit(BINS - 1))
        bins = met(wide.select("g", "lo", "hi").distinct()).groupBy("g", "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        below = F.coalesce(F.sum("_n").over(Window.partitionBy("g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BINS rows
        inside = (F.col("rank") >= F.col("_below")) & (F.col("rank") < F.col("_below") + F.col("_n"))
        joined = wide.join(ranged(bins.withColumn("_below", below)), same & inside)
        open_ = written(joined.select("g", "name", (F.col("rank") - F.col("_below")).alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_n").alias("n")))
    one = settled.where(F.col("lo") == F.col("hi")).select("g", "name", F.col("lo").alias("value"))
    few = settled.where(F.col("lo") < F.col("hi"))
    listed = met(few.select("g", "lo", "hi").distinct()).groupBy("g", "lo", "hi").agg(F.array_sort(F.collect_list("v")).alias("_v"))
    picked = few.join(ranged(listed), same).select("g", "name", F.get("_v", F.col("rank").cast("int")).alias("value"))
    return one.unionByName(picked).where("value is not null")


def quantiles(values: DataFrame, group: str, value: str, fractions: dict[str, float], *, between: bool = False, gathered: int = GATHERED) -> DataFrame:
    """(group, n, one column for each name of ``fractions``): exact quantiles of each group.

    By nearest rank, the index f * (n - 1) rounded half to even; with ``between`` the mean of both neighbours, weighted by their distance to it, as a double. Nulls
    and what isn't finite don't count; a null group is a group; one without values is left out.
    """
    finite = values.select(F.col(group).alias("g"), F.col(value).alias("v")).where(F.col("v").isNotNull())
    if values.schema[value].dataType.typeName() in ("double", "float"):
        finite = finite.where(F.abs(F.col("v")) < F.lit(float("inf")))
    rows = written(finite)
    sums = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    index = lambda f: F.lit(float(f)) * (F.col("n") - 1)
    wanted = [(name, how(index(f))) for name, f in fractions.items() for name, how in (((name, F.bround),) if not between else ((f"{name} low", F.floor), (f"{name} high", F.ceil)))]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in wanted]))
    found = at_ranks(rows, sums.select("g", "lo", "hi", "n", each.alias("t")).select("g", "t.name", "t.rank", "lo", "hi", "n"), gathered)
    wide = found.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name, _ in wanted])
    joined = sums.select("g", "n").join(wide.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
    if not between:
        return joined.select(F.col("g").alias(group), "n", *fractions)
    mixed = lambda name, f: F.col(f"{name} low") + (F.col(f"{name} high") - F.col(f"{name} low")) * (index(f) - F.floor(index(f)))
    return joined.select(F.col("g").alias(group), "n", *[mixed(name, f).cast("double").alias(name) for name, f in fractions.items()])
