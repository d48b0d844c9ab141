"""Text functions: Column in, Column out, all inside Spark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest length of a sentence that is kept.
SENTENCE_CHARS = (10, 400)
#: White space that engines agree on, with the two wide blanks that plain \s misses.
WHITE = r"[\s\x{00A0}\x{3000}]+"


def squash(text: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def sentences(text: Column, least: int = SENTENCE_CHARS[0], most: int = SENTENCE_CHARS[1]) -> Column:
    """Array of squashed sentences, split after end marks and at line ends; too short and too long ones go."""
    parts = F.split(text, r"(?<=[.!?…])\s+|\n+")
    return F.filter(F.transform(parts, squash), lambda s: F.length(s).between(least, most))


def words(text: Column) -> Column:
    """Array of white-space separated words."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def matching(text: Column, terms: list[str]) -> Column:
    """Array of the terms, in their order, that the text contains literally."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)) if terms else F.array().cast("array<string>")


def contains_any(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)) if terms else F.lit(False)


def labels(*pairs: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def occurrences(text: Column, term: str) -> Column:
    """How often a literal term occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def positions(text: Column, term: str) -> Column:
    """Where a literal term begins, from 1, without overlap."""
    sizes = F.transform(F.split(text, rf"\Q{term}\E", -1), lambda x: F.length(x))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
    before_last = F.slice(sizes, 1, F.size(sizes) - 1)
    return F.aggregate(before_last, start, lambda a, n: F.struct((a["at"] + n + len(term)).alias("at"), F.concat(a["found"], F.array(a["at"] + n)).alias("found")), lambda a: a["found"])


def snippet(text: Column, limit: int = 60) -> Column:
    """Squashed and cut with an ellipsis beyond ``limit`` characters."""
    flat = squash(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def unescape(text: Column, closed: bool = False) -> Column:
    """All named and numeric character references decoded, then squashed. Only texts with an ampersand go through Python, in Arrow batches.

    With ``closed`` a reference counts only if a semicolon ends it; without, some old names do without one, as browsers read them.
    """
    import html.entities
    import re

    whole = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")

    def reference(m: re.Match) -> str:
        return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map((lambda t: whole.sub(reference, t)) if closed else html.unescape, na_action="ignore")

    marked = F.contains(text, F.lit("&"))
    return squash(F.when(marked, decoded(F.when(marked, text))).otherwise(text))


def short_id(identifier: Column, size: int = 8) -> Column:
    """The last ``size`` characters of an identifier, enough to tell rows of a report apart."""
    return F.right(identifier.cast("string"), F.lit(size))


def deep_link(base: Column, start_ms: Column) -> Column:
    """An address that begins at a time: whole seconds as a parameter t, after a question mark or an ampersand; no time, no parameter."""
    mark = F.when(F.contains(base, F.lit("?")), F.lit("&t=")).otherwise(F.lit("?t="))
    return F.when(start_ms.isNull(), base).otherwise(F.concat(base, mark, F.floor(start_ms / 1000).cast("string"), F.lit("s")))


def strip_tags(html: Column) -> Column:
    return squash(F.regexp_replace(html, "<[^>]+>", " "))


def clock_to_ms(text: Column) -> Column:
    """hh:mm:ss.mmm as milliseconds; null if malformed or out of range."""
    pattern = r"^(\d{2,}):(\d{2}):(\d{2})\.(\d{3})$"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("bigint")
    hours, minutes, seconds, ms = (part(i) for i in (1, 2, 3, 4))
    return F.when((minutes < 60) & (seconds < 60), ((hours * 60 + minutes) * 60 + seconds) * 1000 + ms)


def ms_to_clock(ms: Column) -> Column:
    """Milliseconds as hh:mm:ss.mmm."""
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    whole = F.floor(ms / 1000)
    hours = F.floor(whole / 3600).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def iso_seconds(text: Column) -> Column:
    """An ISO-8601 duration of days, hours, minutes and seconds as seconds; parts that lack count zero."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+){unit}", 1).try_cast("bigint"), F.lit(0))
    return part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S")


def strip_suffix(word: Column, suffixes: list[str], least_stem: int = 2) -> Column:
    """The word without its longest listed suffix, if at least ``least_stem`` characters remain."""
    out = None
    for s in sorted(suffixes, key=lambda s: (-len(s), s)):
        hit = F.endswith(word, F.lit(s)) & (F.length(word) >= len(s) + least_stem)
        stem = F.left(word, F.length(word) - len(s))
        out = F.when(hit, stem) if out is None else out.when(hit, stem)
    return out.otherwise(word) if out is not None else word


def tail_words(text: Column, term: str, n: int = 2, least: int = 3) -> Column:
    """The last ``n`` words after the first occurrence of ``term``, without end marks; null if shorter than ``least``."""
    at = F.instr(text, term)
    rest = words(F.substring(text, at + len(term), F.length(text)))
    tail = F.regexp_replace(F.array_join(F.slice(rest, F.greatest(F.size(rest) - n + 1, F.lit(1)), n), " "), r"[.!?,…]+$", "")
    return F.when((at > 0) & (F.length(tail) >= least), tail)


def keywords(text: Column, stop: list[str], suffixes: list[str], least: int = 2) -> Column:
    """Distinct keywords in order: letter runs, lower-cased, without stop words, one suffix off."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    kept = F.filter(tokens, lambda w: (F.length(w) >= least) & ~w.isin(*stop))
    return F.array_distinct(F.filter(F.transform(kept, lambda w: strip_suffix(w, suffixes)), lambda w: F.length(w) >= least))


def chunk_id(prefix: str, *fields: tuple[str, Column]) -> Column:
    """A content address: SHA-256 over a JSON object whose keys stand in the given order, nulls included."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in fields]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix), F.sha2(body, 256))
