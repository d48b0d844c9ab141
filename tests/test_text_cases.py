"""Text functions and guards on small cases."""

import html

import pytest
from pyspark.sql import functions as F

from glosswork.functions import text as tx
from glosswork.operators import lexicon as lx
from glosswork.operators import vectors as vec


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_sentences(spark):
    text = "First one here.  Second one there!\nno mark at all\n\nshort. Is it?"
    assert one(spark, tx.sentences(F.col("t")), t=text) == ["First one here.", "Second one there!", "no mark at all"]


@pytest.mark.parametrize(("text", "ms"), [("00:00:01.500", 1500), ("01:00:00.000", 3_600_000), ("100:00:00.001", 360_000_001), ("00:60:00.000", None), ("00:00:60.000", None), ("bad", None)])
def test_clock(spark, text, ms):
    assert one(spark, tx.clock_to_ms(F.col("t")), t=text) == ms
    if ms is not None:
        assert one(spark, tx.ms_to_clock(F.col("m")), m=ms) == text


@pytest.mark.parametrize(("text", "seconds"), [("PT1H2M3S", 3723), ("P1DT1S", 86401), ("PT5M", 300), ("", 0)])
def test_duration(spark, text, seconds):
    assert one(spark, tx.iso_seconds(F.col("t")), t=text) == seconds


def test_occurrences_and_snippet(spark):
    assert one(spark, tx.occurrences(F.col("t"), "aa"), t="aaaaa") == 2
    assert one(spark, tx.snippet(F.col("t"), 5), t="  ab \n cdefg") == "ab cd…"


def test_suffix_needs_a_stem(spark):
    assert one(spark, tx.strip_suffix(F.col("w"), ["ing", "g"]), w="sing") == "sin"
    assert one(spark, tx.strip_suffix(F.col("w"), ["ing", "g"]), w="walking") == "walk"


def test_literal_match_is_no_pattern(spark):
    assert one(spark, tx.matching(F.col("t"), ["a%", "100%"]), t="100% sure, a b") == ["100%"]


def test_address_keeps_nulls_and_order(spark):
    import hashlib

    got = one(spark, tx.chunk_id("c-", ("b", F.lit(1)), ("a", F.lit(None).cast("string")), ("t", F.lit("한"))))
    assert got == "c-" + hashlib.sha256('{"b":1,"a":null,"t":"한"}'.encode()).hexdigest()


def test_lexicon_is_longest_first():
    assert lx.load_terms(["ab", "a", "abcd", "abc", "ab"]) == ["abcd", "abc", "ab"]


def guard(spark, text, **k):
    return one(spark, lx.guard_output(F.col("t"), ["pill"], ["take"], **k), t=text)


def test_output_guard(spark):
    assert guard(spark, "take a pill").blocked
    alone = guard(spark, "a pill")
    assert not alone.blocked and alone.text == "a pill" + lx.DISCLAIMER
    assert guard(spark, "take a walk").text == "take a walk"
    assert guard(spark, "a pill walk", allowed=["walk"]).text == "a pill walk"
    revoked = guard(spark, "take a pill walk", allowed=["walk"])
    assert revoked.blocked and revoked.whitelist_revoked
    assert guard(spark, "take a pill", authored=F.lit(True)).text == "take a pill"


def test_input_guard(spark):
    assert one(spark, lx.guard_input(F.col("t"), ["pill"]), t="a pill").blocked
    assert not one(spark, lx.guard_input(F.col("t"), ["pill"], ["walk"]), t="pill walk").blocked


def test_term_hits_agree_for_small_and_large_lexicons(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "xyz"), (3, None), (4, "")], "id long, text string")
    terms = spark.createDataFrame([("bcd",), ("z",), ("q",), ("",)], "term string")
    small = sorted(tuple(r) for r in lx.term_hits(texts, terms).collect())
    monkeypatch.setattr(lx, "INLINE_TERMS", 1)
    assert small == [(1, "bcd"), (2, "z")] == sorted(tuple(r) for r in lx.term_hits(texts, terms).collect())


@pytest.mark.parametrize("text", ["a &amp;lt; b", "&copy;&eacute;&#233;&#xE9;&notit;", "no mark", "&unknown; & &#0;", "", None, "x&nbsp;y"])
def test_all_references_are_decoded(spark, text):
    want = None if text is None else " ".join(html.unescape(text).replace("\xa0", " ").split())
    assert one(spark, tx.unescape(F.col("t")), t=text) == want


def test_links_and_short_ids(spark):
    df = spark.createDataFrame([("u?v=1", 61_999, "chunk-0123456789"), ("u", 0, "ab"), ("u", None, None)], "b string, ms long, id string")
    got = df.select(tx.deep_link(F.col("b"), F.col("ms")).alias("l"), tx.short_id(F.col("id")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("u?v=1&t=61s", "23456789"), ("u?t=0s", "ab"), ("u", None)]


def test_encoder_puts_roles_first(spark):
    df = spark.createDataFrame([(1, "x y"), (2, None)], "id long, text string")
    bare = {r.id: r.embedding for r in vec.hash_encode(df.selectExpr("id", "concat('query: ', coalesce(text, '')) as text"), 32).collect()}
    assert bare == {r.id: r.embedding for r in vec.hash_encode(df, 32, "query").collect()}
    assert bare != {r.id: r.embedding for r in vec.hash_encode(df, 32, "passage").collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in bare.values())


def test_lines_keep_their_figures(spark):
    """A line isn't trimmed of the digits of its own place; blanks around it go."""
    from glosswork.plans import text as plan

    df = spark.createDataFrame([(1, "0997 a 0\n1219 b 1\n  c  \n3\n\n 5x5"), (2, None)], "doc_id long, text string")
    assert [(r.pos, r.line) for r in plan.lines(df).orderBy("pos").collect()] == [(1, "0997 a 0"), (2, "1219 b 1"), (3, "c"), (4, "3"), (5, "5x5")]


@pytest.mark.parametrize(("text", "want"), [("ver&amp</title> &lt;b&gt;", "ver&amp</title> <b>"), ("&ampx; &amp;lt; &#233; &#xE9; &eacute; &x;", "&ampx; &lt; \u00e9 \u00e9 \u00e9 &x;"), ("&nbsp; &copy", "&copy"), (None, None)])
def test_closed_references_only(spark, text, want):
    assert one(spark, tx.unescape(F.col("t"), closed=True), t=text) == want


def test_words_near_marks_carry_no_text(spark):
    """The plan explodes what was found only, so that a long text isn't repeated for each of its words."""
    from glosswork.plans import text as plan

    texts = [["ab"] * 6 + ["trash"] + ["cd"] * 4 + ["ef", "gh"], ["no", "mark"], ["x1", "stupid", "stup", "idiot", "longword", "Q"], None]
    df = spark.createDataFrame([(w,) for w in texts], "w array<string>")
    got = sorted(r.word for r in plan.near_unknown(df, ["trash", "idiot"], ["trash", "stupid", "idiot"]).collect())
    want = []
    for w in filter(None, texts):
        for p, x in enumerate(w):
            near = w[max(1, p - 4) - 1 : max(1, p - 4) + 10]
            if x.isascii() and x.isalpha() and x.islower() and 2 <= len(x) <= 6 and {"trash", "idiot"} & set(near) and not any(t in x or x in t for t in ("trash", "stupid", "idiot")):
                want.append(x)
    assert got == sorted(want) and got
    long = spark.range(1).select(F.expr("concat(array('trash'), array_repeat('ab', 200000))").alias("w"))
    assert plan.near_unknown(long, ["trash"], []).count() == 6


@pytest.mark.parametrize("cosine", [False, True])
def test_whole_score_table_in_blocks(spark, cosine, monkeypatch):
    """Every pair once, nulls and zero vectors too, over several blocks; the plan has no pair of arrays to fold in rows."""
    import math

    monkeypatch.setattr(vec, "TABLE_QUERIES", 3)
    monkeypatch.setattr(vec, "TABLE_ROWS", 4)
    rows = [(i, [float(i % 5), -1.5, i / 7]) for i in range(20)] + [(20, [0.0, 0.0, 0.0]), (21, None)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = corpus.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    table = vec.pair_scores(queries, corpus, cosine=cosine)
    assert "aggregate(" not in table._jdf.queryExecution().toString()
    got = {(r.query_id, r.id): r.score for r in table.collect()}
    held = dict(r for r in [tuple(r) for r in corpus.collect()])
    assert set(got) == {(q, i) for q in held if q % 3 == 0 for i in held if i != q}
    for (q, i), score in got.items():
        a, b = held[q], held[i]
        size = None if a is None or b is None else math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        want = None if size is None or (cosine and size == 0) else sum(x * y for x, y in zip(a, b)) / (size if cosine else 1)
        assert score is None and want is None or abs(score - want) < 1e-12


def test_encoder_reads_each_word_once(spark):
    """Against a plain version; the plan hashes words once, not once a dimension."""
    import numpy as np

    df = spark.createDataFrame([(1, "x y x, Z"), (2, None), (3, " "), (4, "a " * 50_000)], "id long, text string")
    encoded = vec.hash_encode(df, 16)
    assert encoded._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 2
    got = {r.id: r.embedding for r in encoded.collect()}
    codes = {w: tuple(spark.range(1).select(F.expr(f"pmod(xxhash64('{w}'), 16)"), F.expr(f"pmod(xxhash64('{w}', 1), 2)")).first()) for w in "xyza"}
    for i, words in ((1, "x y x z"), (2, ""), (3, ""), (4, "a " * 50_000)):
        v = np.zeros(16)
        for w in words.split():
            v[codes[w][0]] += 1 if codes[w][1] == 0 else -1
        size = np.sqrt((v * v).sum())
        assert np.allclose(got[i], v / size if size else v, atol=1e-6)
