"""Literal containment by anchors against Python's ``in``, at odd lengths, with repeats, and with a million terms."""

import random

import pytest
from pyspark.sql import functions as F

from glosswork.operators import containment as ct


def plain(texts, terms):
    return sorted({(i, t) for i, x in texts for t in terms if x and t and t in x}, key=str)


def found(spark, texts, terms):
    rows = ct.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert len(rows) == len(set(rows))
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("alphabet", ["ab", "aé𝄞漢 \n"])
def test_equals_plain_containment(spark, monkeypatch, alphabet):
    monkeypatch.setattr(ct, "BLOCK", 40)
    monkeypatch.setattr(ct, "STRETCH", 50)
    monkeypatch.setattr(ct, "HOT_COUNT", 1)
    monkeypatch.setattr(ct, "COUNTED_SHARE", 2)
    rng = random.Random(len(alphabet))
    draw = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [(i, draw(rng.choice([0, 1, 5, 39, 40, 41, 200, 700]))) for i in range(40)] + [(None, "abé"), (7, draw(60)), (3, None)]
    terms = [draw(rng.randint(1, 12)) for _ in range(60)] + ["", None, "a", "a"]
    for _, x in texts:
        if x and len(x) > 150:
            at, n = rng.randrange(len(x) - 1), rng.choice([20, 33, 49, 51, 120, 690])
            terms.append(x[at : at + n])
    assert found(spark, texts, terms) == plain(texts, terms)


def test_overlapping_vocabularies(spark):
    a, b = ["pass", "moron", "a", "xyz", "", None, "a"], ["password", "moron", "yz", "ss", "q", None]
    rows = ct.overlapping(*(spark.createDataFrame([(t,) for t in v], "term string") for v in (a, b))).collect()
    want = {(x, y) for x in a for y in b if x and y and (x in y or y in x)}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_nothing_asked_and_nothing_there(spark):
    assert found(spark, [(1, "a")], [None, ""]) == []
    assert found(spark, [], ["a"]) == []
    assert found(spark, [(1, None), (2, "")], ["a", "bc"]) == []


def test_a_million_terms_without_python_or_broadcast_terms(spark):
    terms = spark.range(1_000_000).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 14).alias("term"))
    texts = spark.range(400).select("id", F.concat(F.lit("x " * 40), F.sha2(F.col("id").cast("string"), 256).substr(1, 14), F.lit(" y")).alias("text"))
    hits = ct.contained(texts, terms)
    assert "Python" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.agg(F.count_if(F.expr("substring(sha2(cast(id as string), 256), 1, 14) = term")), F.count(F.lit(1))).first()[:] == (400, 400)


def test_vocabularies_are_made_once(spark, small):
    """What reads a vocabulary again reads the written one, not the documents."""
    from glosswork.plans import text as plan

    assert "regexp_extract_all" not in plan.vocab_overlap(spark, small)._jdf.queryExecution().executedPlan().toString()
