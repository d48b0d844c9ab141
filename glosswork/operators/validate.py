"""Checks as tables of violations: (key, rule). An empty table means that all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each key and rule that it breaks."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def single_setting(df: DataFrame, group: str, *settings: str) -> DataFrame:
    """(group, variants, mixed): how many settings a group mixes, absent ones counting as a variant."""
    return df.groupBy(group).agg(F.countDistinct(F.to_json(F.struct(*settings), {"ignoreNullFields": "false"})).alias("variants")).withColumn("mixed", F.col("variants") > 1)


def require(violations: DataFrame, what: str) -> None:
    """Raise with the first violations, if there are any."""
    if found := violations.limit(5).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")
