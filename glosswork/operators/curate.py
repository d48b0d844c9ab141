"""Ledgers, evidence and records: upserts, sibling expansion, ordered merges, fingerprints, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions.text import squash


def keep(df: DataFrame, keys: list[str], *order: F.Column) -> DataFrame:
    """Of each key the first row in ``order``, by an aggregate that merges where rows are read."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_m"))
    return best.select(*keys, *[F.col(f"_m._row.{c}").alias(c) for c in rest])


def ledger_merge(ledger: DataFrame, metadata: DataFrame, key: str, refreshed: list[str], human: dict[str, str], candidate: F.Column) -> DataFrame:
    """Upsert: known rows take the ``refreshed`` columns and keep the ``human`` ones; new rows come in if ``candidate``, with the human defaults."""
    new = metadata.select(key, *[F.col(c).alias(f"_{c}") for c in refreshed], candidate.alias("_candidate"))
    joined = ledger.withColumn("_known", F.lit(True)).join(new, key, "full_outer").where("_known or _candidate")
    known = F.col("_known").isNotNull()
    return joined.select(
        key,
        *[F.coalesce(f"_{c}", c).alias(c) for c in refreshed],
        *[F.when(known, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in human.items()],
    )


def expand_siblings(evidence: DataFrame, answers: DataFrame, cap: int = 10) -> DataFrame:
    """Evidence (query_id, rank, chunk_id, qa_id, is_question) with the answers of its questions appended.

    ``answers`` is (qa_id, chunk_index, chunk_id). A question brings its first ``cap`` answers in their order, after all that
    was there; an answer already there isn't repeated; a question without answers goes. Returns query_id, ordinal, chunk_id,
    appended. Expanding the result again changes nothing.
    """
    first = answers.withColumn("nth", F.row_number().over(Window.partitionBy("qa_id").orderBy("chunk_index", "chunk_id"))).where(f"nth <= {cap}")
    questions = evidence.where("is_question").select("query_id", "rank", "qa_id")
    more = questions.join(first.select("qa_id", "nth", "chunk_id"), "qa_id").select("query_id", F.lit(1).alias("later"), "rank", "nth", "chunk_id")
    orphans = questions.join(answers, "qa_id", "left_anti").select("query_id", "rank")
    stay = evidence.join(orphans, ["query_id", "rank"], "left_anti").select("query_id", F.lit(0).alias("later"), "rank", F.lit(0).alias("nth"), "chunk_id")
    once = keep(stay.unionByName(more), ["query_id", "chunk_id"], F.col("later"), F.col("rank"), F.col("nth"))
    order = Window.partitionBy("query_id").orderBy("later", "rank", "nth", "chunk_id")
    return once.select("query_id", F.row_number().over(order).cast("long").alias("ordinal"), "chunk_id", (F.col("later") == 1).alias("appended"))


def ordered_merge(*lists: DataFrame) -> DataFrame:
    """(query_id, ordinal, id): lists (query_id, rank, id) one after the other, each id once, at its first place."""
    every = None
    for i, part in enumerate(lists):
        part = part.select("query_id", F.lit(i).alias("list"), "rank", "id")
        every = part if every is None else every.unionByName(part)
    once = keep(every, ["query_id", "id"], F.col("list"), F.col("rank"))
    return once.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "rank", "id")).cast("long").alias("ordinal"), "id")


def ordered_distinct(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, values): distinct values of a key in the order they first appear."""
    first = df.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_f"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", value))), lambda x: x[value]).alias("values"))


def fingerprint(df: DataFrame, key: str, text: str, prefix: int = 4) -> DataFrame:
    """(n, fingerprint) of a table, whatever the order of its rows.

    A null key or text counts, and not as an empty one. Rows are hashed with their keys, hashes are gathered by their first ``prefix`` hex digits and hashed in order, and so
    are the groups' hashes: a tree, so that no task holds all rows.
    """
    end = lambda c: F.coalesce(F.concat(F.col(c).cast("string").cast("binary"), F.unhex(F.lit("00"))), F.unhex(F.lit("01")))
    row = F.sha2(F.concat(end(key), end(text)), 256)
    leaves = df.select(row.alias("h")).groupBy(F.left("h", F.lit(prefix)).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("g"))
    return leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "g"))), lambda x: x["g"]), ""), 256).alias("fingerprint"))


def citations(evidence: DataFrame) -> DataFrame:
    """(query_id, number, chunk_id): which chunk each number of a prompt stands for, from evidence (query_id, ordinal, chunk_id, citable)."""
    order = Window.partitionBy("query_id").orderBy("ordinal")
    return evidence.where("citable").select("query_id", F.row_number().over(order).cast("long").alias("number"), "chunk_id")


def normalise_questions(rows: DataFrame, key: list[str], question: str = "question", least: int = 40) -> DataFrame:
    """Add question (squashed, end marks of a list and quotes off) and reason: empty, short, seen before (an earlier row of ``key`` says the same), else null.

    Rows come from a model and may hold anything: nulls are empty ones. The first row of a question is found by an aggregate that merges
    where rows are read, so a question that a model repeats without end costs a row a task.
    """
    text = F.regexp_replace(squash(F.coalesce(F.col(question), F.lit(""))), r"^(?:[-*•]|\d+[.)])\s+|^[\"'“]|[\"'”]$", "")
    clean = rows.withColumn(question, text).withColumn("_same", F.lower(F.regexp_replace(question, r"\s", "")))
    usable = F.length(question) >= least
    first = clean.where(usable).groupBy("_same").agg(F.min(F.struct(*key)).alias("_first"))
    marked = clean.join(first, "_same", "left")
    reason = F.when(F.col(question) == "", "empty").when(~usable, "short").when(F.struct(*key) != F.col("_first"), "seen before")
    return marked.withColumn("reason", reason).drop("_same", "_first")


RULES = "Answer from the sources only.\nCite sources by their numbers.\nSay so if they do not answer the question."
HEDGE_RULE = "The sources match weakly; say how sure the answer is."
CONTEXT_RULE = "Cases are context and must not be cited."


def prompts(questions: DataFrame, evidence: DataFrame, profile: str = "") -> DataFrame:
    """(query_id, prompt): rules, the reader's ``profile`` if there is one, numbered sources that may be cited, unnumbered cases, the question.

    ``questions`` is (query_id, question, band), ``evidence`` (query_id, ordinal, header, text, citable). Only what
    may be cited gets a number, from 1 without gaps.
    """
    order = Window.partitionBy("query_id", "citable").orderBy("ordinal")
    part = F.when(F.col("citable"), F.concat(F.lit("["), F.row_number().over(order).cast("string"), F.lit("] "), "header", F.lit("\n"), "text")).otherwise(F.concat(F.lit("("), "header", F.lit(")\n"), "text"))
    lines = evidence.withColumn("_n", F.row_number().over(order)).withColumn("_t", part)
    gathered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ordinal", "_t")))), lambda x: x["_t"]), "\n\n")
    blocks = lines.groupBy("query_id").agg(gathered(F.col("citable")).alias("_s"), gathered(~F.col("citable")).alias("_c"))
    joined = questions.join(blocks, "query_id", "left")
    cases = F.coalesce("_c", F.lit(""))
    text = F.concat(
        F.lit(RULES),
        F.when(F.col("band") == "hedge", F.lit("\n" + HEDGE_RULE)).otherwise(""),
        F.when(cases != "", F.lit("\n" + CONTEXT_RULE)).otherwise(""),
        F.lit(f"\n\nReader:\n{profile}" if profile else ""),
        F.lit("\n\nSources:\n"),
        F.coalesce("_s", F.lit("")),
        F.when(cases != "", F.concat(F.lit("\n\nCases:\n"), cases)).otherwise(""),
        F.lit("\n\nQuestion: "),
        "question",
    )
    return joined.select("query_id", text.alias("prompt"))


def backfill(records: DataFrame, answers: DataFrame, version: str) -> DataFrame:
    """(query_id, status, answer) for records and unknown answers: filled, kept, pending or why an answer can't go in.

    ``records`` is (query_id, prompt_version, band, answer, generated), ``answers`` (query_id, text). The checks come in this
    order: unknown id, another prompt version, a band that never asked, a place already taken.
    """
    joined = records.withColumn("_r", F.lit(True)).join(answers.withColumn("_a", F.lit(True)), "query_id", "full_outer")
    has, known = F.col("_a").isNotNull(), F.col("_r").isNotNull()
    taken = F.coalesce(F.col("answer") != "", F.lit(False)) & F.col("generated")
    status = (
        F.when(has & ~known, "unknown").when(has & (F.col("prompt_version") != version), "version mismatch").when(has & (F.col("band") == "refuse"), "refused band").when(has & taken, "occupied").when(has, "filled")
        .when(F.col("generated") & ~F.coalesce(F.col("answer") != "", F.lit(False)), "pending").otherwise("kept")
    )
    return joined.select("query_id", status.alias("status"), F.when(status == "filled", F.col("text")).otherwise(F.col("answer")).alias("answer"))
