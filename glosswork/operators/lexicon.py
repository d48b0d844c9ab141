"""Lexicons and guards: literal term matching, input and output verdicts, lexicon building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import matching
from glosswork.operators.containment import contained

#: Terms, and their bytes, compared inside one expression; larger lexicons go through ``term_hits``.
INLINE_TERMS, INLINE_BYTES = 32, 1 << 20
DISCLAIMER = " [This is general information.]"
REFUSAL = "This question is outside what can be answered here."


def load_terms(terms: list[str], least: int = 2) -> list[str]:
    """Terms of at least ``least`` characters, longest first, ties in input order, each once."""
    return sorted(dict.fromkeys(t for t in terms if len(t) >= least), key=lambda t: -len(t))


def term_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term), once each, of every literal containment, for lexicons of any size.

    ``texts`` is (id, text), ``terms`` (term). Up to INLINE_TERMS terms are tested inside one Spark expression;
    more meet the texts by rare runs of characters (``containment.contained``).
    """
    wanted = terms.select("term").where("length(term) > 0").distinct()
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n <= INLINE_TERMS and size <= INLINE_BYTES:
        return texts.select("id", F.explode(matching(F.col("text"), sorted(r[0] for r in wanted.collect()))).alias("term")).distinct()
    return contained(texts, wanted)


def guard_input(text: Column, terms: list[str], allowed: list[str] | None = None) -> Column:
    """Struct blocked, matched_terms, whitelist_matched: any term blocks, unless an allowed term is there as well."""
    hits, free = matching(text, terms), matching(text, allowed or [])
    return F.struct(((F.size(hits) > 0) & (F.size(free) == 0)).alias("blocked"), hits.alias("matched_terms"), free.alias("whitelist_matched"))


def guard_output(text: Column, terms: list[str], markers: list[str], allowed: list[str] | None = None, authored: Column | None = None) -> Column:
    """Struct blocked, text, matched_terms, matched_markers, whitelist_revoked.

    A term with a marker is blocked, a term alone gets the disclaimer, anything else passes. An allowed
    term lets the text pass, but a marker takes that back. Text marked as authored by the system is not looked at.
    """
    own = F.coalesce(authored, F.lit(False)) if authored is not None else F.lit(False)
    hits, marks, free = matching(text, terms), matching(text, markers), matching(text, allowed or [])
    excused = (F.size(free) > 0) & (F.size(marks) == 0)
    named = (F.size(hits) > 0) & ~excused & ~own
    blocked = named & (F.size(marks) > 0)
    out = F.when(blocked, F.lit(REFUSAL)).when(named, F.concat(text, F.lit(DISCLAIMER))).otherwise(text)
    none = F.array().cast("array<string>")
    return F.struct(
        blocked.alias("blocked"),
        out.alias("text"),
        F.when(own, none).otherwise(hits).alias("matched_terms"),
        F.when(own, none).otherwise(marks).alias("matched_markers"),
        ((F.size(free) > 0) & (F.size(marks) > 0) & ~own).alias("whitelist_revoked"),
    )


def build_lexicon(entities: DataFrame, types: list[str]) -> DataFrame:
    """(type, terms, n): the sorted distinct names of each wanted type, from rows (name, type)."""
    kept = entities.where(F.col("type").isin(*types) & (F.length("name") > 0)).select("type", "name").distinct()
    return kept.groupBy("type").agg(F.array_sort(F.collect_list("name")).alias("terms"), F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of a guard over rows (in_corpus, reason, blocked): blocks outside the corpus, false and true positives inside."""
    outside, inside = ~F.col("in_corpus"), F.col("in_corpus")
    return rows.agg(
        F.count_if(outside).alias("block_total"),
        F.count_if(outside & F.col("blocked")).alias("block_count"),
        F.count_if(inside).alias("fixture_total"),
        F.count_if(inside & F.col("blocked") & (F.col("reason") != "GUARDED")).alias("false_positives"),
        F.count_if(inside & F.col("blocked") & (F.col("reason") == "GUARDED")).alias("true_positives"),
    )


def deletions(word: str, most: str) -> Column:
    """Array of the distinct strings that are left of a word when up to ``most`` (SQL, 0 to 2) of its characters go."""
    once = "transform(sequence(1, length(x)), i -> concat(substring(x, 1, i - 1), substring(x, i + 1)))"
    step = f"flatten(transform(a, x -> if(length(x) = 0, array(x), {once})))"
    return F.expr(f"array_distinct(aggregate(sequence(1, 2), array({word}), (a, n) -> if(n > {most}, a, array_distinct(concat(a, {step})))))")


#: How far a term may be from a word: one edit up to SHORT characters, else two.
SHORT = 4


def nearest(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, term, distance): the nearest of ``terms`` (term) to each distinct word (word) within its bound of edits, ties by the term's order.

    Two strings that are d edits apart have a string in common that either becomes by losing d characters at most; so words and
    terms meet by what is left of them, and what meets is measured. Neither list is broadcast or held whole; a string of n characters
    stands for n squared over two rows. Null words and terms, and words that no term is near, are left out.
    """
    bound = F.when(F.length("word") <= SHORT, 1).otherwise(2)
    asked = words.select("word").where("word is not null").distinct().withColumn("_most", bound)
    held = terms.select("term").where("term is not null").distinct()
    left = asked.withColumn("_left", F.explode(deletions("word", "_most")))
    met = held.withColumn("_left", F.explode(deletions("term", "2"))).join(left, "_left").where(F.abs(F.length("word") - F.length("term")) <= F.col("_most"))
    near = met.select("word", "term", "_most").distinct().withColumn("distance", F.levenshtein("word", "term")).where("distance <= _most")
    return near.groupBy("word").agg(F.min(F.struct("distance", "term")).alias("m")).select("word", "m.term", "m.distance")
