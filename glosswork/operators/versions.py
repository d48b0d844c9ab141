"""Versions of a corpus: a tree of digests for each, and what changed between two by going down where they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.operators.durable import written

#: Characters of the hashed key that name a leaf: 16 to this power leaves.
DEPTH = 4


def rows_of(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, leaf, digest): where each row hangs and what it holds; nulls and empty texts differ. Keys must not repeat."""
    held = F.sha2(F.concat(*[F.coalesce(F.concat(F.lit("1"), F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")), F.lit("0")) for f in fields]), 256)
    return df.select(F.col(key).alias("key"), F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, DEPTH).alias("leaf"), held.alias("digest"))


def tree(rows: DataFrame) -> DataFrame:
    """(prefix, level, rows, digest): a node for each prefix of the leaves that hold rows, the root's empty; a small table to keep with the corpus.

    A node's digest depends on the rows under it, not on their order: two sums of 64-bit hashes, so it is merged where rows are read.
    """
    one = F.concat_ws("|", F.col("key").cast("string"), "digest")
    leaves = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.xxhash64(one, F.lit(seed)).cast("decimal(38,0)")).alias(f"_s{seed}") for seed in (1, 2)])
    levels = leaves.select(F.explode(F.expr(f"transform(sequence(0, {DEPTH}), n -> substring(leaf, 1, n))")).alias("prefix"), "rows", "_s1", "_s2")
    summed = levels.groupBy("prefix").agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in ("_s1", "_s2")])
    return summed.select("prefix", F.length("prefix").alias("level"), "rows", F.sha2(F.concat_ws("|", "rows", "_s1", "_s2"), 256).alias("digest"))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(leaf) of the leaves under which two trees differ, found from the root down: below a node that agrees nothing is looked at."""
    spark, open_ = old.sparkSession, None
    for level in range(DEPTH + 1):
        sides = [t.where(F.col("level") == level).select("prefix", F.col("digest").alias(f"_{i}")) for i, t in enumerate((old, new))]
        if open_ is not None:
            sides = [s.join(open_, F.substring("prefix", 1, level - 1) == F.col("_p"), "left_semi") for s in sides]
        found = sides[0].join(sides[1], "prefix", "full_outer").where(~F.col("_0").eqNullSafe(F.col("_1")))
        open_ = written(found.select(F.col("prefix").alias("_p")))
        if open_.isEmpty():
            return spark.createDataFrame([], "leaf string")
    return open_.withColumnRenamed("_p", "leaf")


def changes(old: DataFrame, new: DataFrame, old_tree: DataFrame | None = None, new_tree: DataFrame | None = None) -> DataFrame:
    """(key, change): keys that were added, changed or removed between two versions given by ``rows_of``.

    Trees that were kept are passed in; others are built. Only rows of leaves that differ are compared. With rows written by leaf
    (``partitionBy`` or sorted), the scan skips the others.
    """
    leaves = differing(old_tree if old_tree is not None else tree(old), new_tree if new_tree is not None else tree(new))
    sides = [v.join(leaves, "leaf", "left_semi").select("key", F.col("digest").alias(f"_{i}")) for i, v in enumerate((old, new))]
    change = F.when(F.col("_0").isNull(), "added").when(F.col("_1").isNull(), "removed").when(F.col("_0") != F.col("_1"), "changed")
    return sides[0].join(sides[1], "key", "full_outer").withColumn("change", change).where("change is not null").select("key", "change")
