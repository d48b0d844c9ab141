"""Records of answered questions: band, guard, gate, evidence, prompt, an injected client, and the guard on what it says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.operators import curate as cu
from glosswork.operators import lexicon as lx
from glosswork.operators.durable import written

#: A client takes (query_id, prompt) and returns (query_id, raw), a null raw where it has no answer.
Client = Callable[[DataFrame], DataFrame]


def column_client(answer: Callable[[Column], Column]) -> Client:
    """A client that is an expression over the prompt."""
    return lambda prompts: prompts.select("query_id", answer(F.col("prompt")).alias("raw"))


def function_client(answer: Callable[[str], str | None]) -> Client:
    """A client that is a Python function from a prompt to a text, called in batches on executors."""

    def call(prompts: DataFrame) -> DataFrame:
        asked = F.pandas_udf(lambda s: s.map(answer, na_action="ignore"), "string")
        return prompts.select("query_id", asked("prompt").alias("raw"))

    return call


def dry_run(prompts: DataFrame) -> DataFrame:
    """The client that is used where there is none: it answers nothing."""
    return prompts.select("query_id", F.lit(None).cast("string").alias("raw"))


def records(
    questions: DataFrame, vector: DataFrame, graph: DataFrame, client: Client, terms: list[str], markers: list[str], allowed: list[str], profile: str = "", passed: str = "PASS"
) -> DataFrame:
    """(query_id, band, status, gate_verdict, evidence, prompt, answer, guard): a record of every question.

    ``questions`` has query_id, question, guarded (the text that the input guard reads), band and verdict (of the gate); ``vector`` and ``graph``
    have query_id, ordinal, chunk_id, header, text and citable. In this order:

    - band ``refuse``: status refused; nothing else is done.
    - the input guard blocks: status blocked; the answer is the system's own refusal, which the output guard lets through.
    - where the gate passes, evidence of the graph follows that of the vectors, each chunk once; gate_verdict is null before.
    - the prompt goes to ``client`` once; its answers are written, so that none is asked for twice. Without one the status is unanswered.
    - the output guard reads what it says: status answered, and the text with what the guard makes of it.
    """
    safe = lx.guard_input(F.coalesce("guarded", F.lit("")), terms, allowed)["blocked"]
    begun = questions.withColumn("status", F.when(F.col("band") == "refuse", "refused").when(safe, "blocked"))
    asked = begun.where("status is null").select("query_id", "question", "band", "verdict")
    listed = lambda df, net: df.select("query_id", F.lit(net).alias("net"), "ordinal", "chunk_id", "header", "text", "citable")
    both = listed(vector, 0).join(asked.select("query_id"), "query_id", "left_semi").unionByName(listed(graph, 1).join(asked.where(F.col("verdict") == passed).select("query_id"), "query_id", "left_semi"))
    place = F.struct("net", "ordinal")
    once = both.groupBy("query_id", "chunk_id").agg(F.min(place).alias("at"), F.min_by(F.struct("header", "text", "citable"), place).alias("c"))
    evidence = once.select("query_id", (F.col("at.net") * 1_000_000 + F.col("at.ordinal")).alias("ordinal"), "chunk_id", "c.*")
    prompts = cu.prompts(asked.select("query_id", "question", "band"), evidence, profile).select("query_id", "prompt")
    said = written(client(prompts).select("query_id", "raw"))
    ids = evidence.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))), lambda x: x["chunk_id"]).alias("evidence"))
    joined = begun.join(said, "query_id", "left").join(prompts, "query_id", "left").join(ids, "query_id", "left")
    joined = joined.withColumn("status", F.coalesce("status", F.when(F.col("raw").isNull(), "unanswered").otherwise("answered")))
    text = F.when(F.col("status") == "blocked", F.lit(lx.REFUSAL)).otherwise(F.col("raw"))
    guard = F.when(text.isNotNull(), lx.guard_output(text, terms, markers, allowed, F.col("status") == "blocked"))
    gate = F.when(F.col("status").isin("answered", "unanswered"), F.col("verdict"))
    return joined.withColumn("guard", guard).select("query_id", "band", "status", gate.alias("gate_verdict"), "evidence", "prompt", F.col("guard.text").alias("answer"), "guard")
