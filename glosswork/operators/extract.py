"""Entity extraction by an injected client: prompts, one retry, checks and tallies.

A client is any function from a prompt to a text; nothing here knows a service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.operators.durable import ship, written

SCHEMA = "struct<entities: array<struct<name: string, type: string, normalized_from: string, evidence: string, confidence: string>>, relations: array<struct<source: string, target: string, type: string, evidence: string, confidence: string>>>"
CONFIDENCE = ("high", "medium", "low")


def prompt(text: Column, entity_types: list[str], relation_types: list[str]) -> Column:
    """What the client is asked about a text."""
    return F.concat(F.lit(f"Return JSON with entities ({', '.join(entity_types)}) and relations ({', '.join(relation_types)}) of this text; quote the text as evidence.\n\n"), text)


def body(raw: Column) -> Column:
    """The JSON of an answer, without a code fence around it."""
    return F.regexp_replace(F.trim(raw), r"(?s)^```(?:json)?\s*|\s*```$", "")


def grounded(evidence: Column, text: Column) -> Column:
    """Whether the evidence stands in the text, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    return (bare(evidence) != "") & F.contains(bare(text), bare(evidence))


def violations(answers: DataFrame, entity_types: list[str], relation_types: list[str]) -> DataFrame:
    """(chunk_id, rule) of every rule that an answer (chunk_id, text, raw) breaks; (chunk_id, parsed) is in ``parse``."""
    rows = parse(answers)
    text = F.col("text")
    names = F.transform("parsed.entities", lambda e: e["name"])
    odd = lambda c, allowed: c.isNull() | ~c.isin(*allowed)
    rules = {
        "not an object of entities and relations": F.col("parsed").isNull() | F.col("parsed.entities").isNull() | F.col("parsed.relations").isNull(),
        "entity without a name": F.exists("parsed.entities", lambda e: F.coalesce(e["name"], F.lit("")) == ""),
        "unknown entity type": F.exists("parsed.entities", lambda e: odd(e["type"], entity_types)),
        "unknown relation type": F.exists("parsed.relations", lambda r: odd(r["type"], relation_types)),
        "unknown confidence": F.exists("parsed.entities", lambda e: odd(e["confidence"], CONFIDENCE)) | F.exists("parsed.relations", lambda r: odd(r["confidence"], CONFIDENCE)),
        "relation end is no entity": F.exists("parsed.relations", lambda r: ~F.array_contains(names, r["source"]) | ~F.array_contains(names, r["target"])),
        "evidence not in the text": F.exists("parsed.entities", lambda e: ~F.coalesce(grounded(e["evidence"], text), F.lit(False))) | F.exists("parsed.relations", lambda r: ~F.coalesce(grounded(r["evidence"], text), F.lit(False))),
    }
    return rows.select("chunk_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))).alias("rule"))


def parse(answers: DataFrame) -> DataFrame:
    """Add parsed, null where the answer is no JSON object."""
    return answers.withColumn("parsed", F.from_json(body(F.col("raw")), SCHEMA))


def ask(chunks: DataFrame, client: Callable[[str, int], str], attempt: int) -> DataFrame:
    """(chunk_id, text, raw, attempt, prompt_words, answer_words): one call for each row of (chunk_id, text, prompt)."""
    ship(chunks.sparkSession)
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("prompt").to_pylist()
            raw = [client(p, attempt) for p in asked]
            count = lambda texts: pa.array([len(t.split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), batch.column("text"), pa.array(raw, pa.string()), pa.array([attempt] * len(raw), pa.int32()), count(asked), count(raw)],
                names=["chunk_id", "text", "raw", "attempt", "prompt_words", "answer_words"],
            )

    return chunks.select("chunk_id", "text", "prompt").mapInArrow(run, f"chunk_id {kind}, text string, raw string, attempt int, prompt_words long, answer_words long")


def extract(chunks: DataFrame, client: Callable[[str, int], str], entity_types: list[str], relation_types: list[str], attempts: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, quarantine, tallies) over chunks (chunk_id, text).

    What breaks a rule is asked again, up to ``attempts`` times, then set aside with its rules. Every attempt's answers are
    written, so that no row is asked twice for one attempt.
    """
    todo = chunks.select("chunk_id", "text").withColumn("prompt", prompt(F.col("text"), entity_types, relation_types))
    good, log, bad = None, None, None
    for n in range(1, attempts + 1):
        answers = written(ask(todo, client, n))
        bad = written(violations(answers, entity_types, relation_types))
        passed = parse(answers.join(bad.select("chunk_id").distinct(), "chunk_id", "left_anti")).select("chunk_id", "parsed", "attempt")
        good = passed if good is None else good.unionByName(passed)
        one = answers.select("attempt", "prompt_words", "answer_words")
        log = one if log is None else log.unionByName(one)
        todo = todo.join(bad.select("chunk_id").distinct(), "chunk_id", "left_semi")
    quarantine = bad.groupBy("chunk_id").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    tallies = log.groupBy("attempt").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_words").alias("prompt_words"), F.sum("answer_words").alias("answer_words"))
    return good, quarantine, tallies
