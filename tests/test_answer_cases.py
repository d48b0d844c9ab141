"""Records, given gold and keywords on hand-made rows."""

import pytest

from glosswork.operators import answer as an
from glosswork.operators import evaluate as ev
from glosswork.operators import lexicon as lx

EVIDENCE = "query_id int, ordinal long, chunk_id string, header string, text string, citable boolean"


@pytest.fixture(scope="module")
def tables(spark):
    questions = [(1, "one?", "one?", "refuse", "REFUSE"), (2, "two?", "a bad word?", "answer", "PASS"), (3, "three?", "three?", "hedge", "REFUSE"), (4, "four?", "four?", "answer", "PASS"), (5, "five?", None, "answer", "PASS")]
    vector = [(q, i, f"c{q}{i}", f"h{i}", f"text {q}{i}", i != 2) for q in (1, 2, 3, 4) for i in (1, 2)]
    graph = [(q, 1, "g1", "hg", "graph text", True) for q in (1, 2, 3, 4)] + [(4, 2, "c41", "h1", "text 41", True)]
    return (
        spark.createDataFrame(questions, "query_id int, question string, guarded string, band string, verdict string"),
        spark.createDataFrame(vector, EVIDENCE),
        spark.createDataFrame(graph, EVIDENCE),
    )


def run(tables, client):
    return {r["query_id"]: r for r in an.records(*tables, client, ["bad", "drug"], ["dose"], ["fine"]).collect()}


def test_records_in_every_state(tables):
    said = {"three?": "take the drug dose", "four?": "the drug is known", "five?": None}
    got = run(tables, an.function_client(lambda prompt: said[prompt.rsplit("Question: ", 1)[1]]))
    assert {q: r["status"] for q, r in got.items()} == {1: "refused", 2: "blocked", 3: "answered", 4: "answered", 5: "unanswered"}
    assert (got[1]["answer"], got[1]["prompt"], got[1]["gate_verdict"], got[1]["guard"]) == (None,) * 4
    assert got[2]["answer"] == lx.REFUSAL and not got[2]["guard"]["blocked"] and got[2]["guard"]["matched_terms"] == []
    assert got[3]["answer"] == lx.REFUSAL and got[3]["guard"]["blocked"] and got[3]["evidence"] == ["c31", "c32"] and got[3]["gate_verdict"] == "REFUSE"
    assert got[4]["answer"] == "the drug is known" + lx.DISCLAIMER and got[4]["evidence"] == ["c41", "c42", "g1"]
    assert "graph text" in got[4]["prompt"] and "graph text" not in got[3]["prompt"]
    assert got[5]["answer"] is None and got[5]["evidence"] is None and got[5]["prompt"].endswith("Question: five?")


def test_clients(tables):
    assert {r["status"] for r in run(tables, an.dry_run).values()} == {"refused", "blocked", "unanswered"}
    from pyspark.sql import functions as F

    got = run(tables, an.column_client(lambda p: F.right(p, F.lit(5))))
    assert (got[4]["answer"], got[5]["answer"]) == ("four?", "five?")


def test_each_prompt_is_asked_once(spark, tables, tmp_path):
    mark = str(tmp_path)

    def answer(prompt):
        import os
        import uuid

        open(os.path.join(mark, uuid.uuid4().hex), "w").close()
        return "ok"

    out = an.records(*tables, an.function_client(answer), ["bad"], [], [])
    out.count(), out.collect()
    assert len(list(tmp_path.iterdir())) == 3


def test_gold_coverage(spark):
    queries = spark.createDataFrame([(1, None), (2, "missing"), (3, "partial"), (4, "missing"), (5, "partial")], "query_id int, coverage string")
    gold = spark.createDataFrame([(1, "a"), (1, "a"), (1, "zz"), (3, "zz"), (4, "b"), (9, "a")], "query_id int, chunk_id string")
    chunks = spark.createDataFrame([("a",), ("b",), ("b",)], "chunk_id string")
    got = sorted((tuple(r) for r in ev.gold_coverage(queries, gold, chunks).collect()), key=lambda r: r[0])
    assert got == [(1, None, 2, 1, "gold"), (2, "missing", 0, 0, "none expected"), (3, "partial", 1, 0, "error"), (4, "missing", 1, 1, "gold"), (5, "partial", 0, 0, "error")]


def test_keyword_presence(spark):
    corpus = spark.createDataFrame([(1, "the cat"), (2, "a dog"), (3, "cat and dog"), (4, None)], "id int, text string")
    found = spark.createDataFrame([(10, 1, 3), (10, 2, 1), (11, 1, 4)], "query_id int, rank int, id int")
    queries = spark.createDataFrame([(10,), (11,), (12,)], "query_id int")
    got = {(r["query_id"], r["word"]): (r["ranks"], r["in_corpus"], r["verdict"]) for r in ev.keyword_presence(found, queries, corpus, ["cat", "dog", "cow"]).collect()}
    assert got[10, "cat"] == ("1|2", 2, "found") and got[10, "dog"] == ("1", 2, "found")
    assert got[11, "dog"] == got[12, "dog"] == ("", 2, "ranking") and got[12, "cow"] == ("", 0, "collection") and len(got) == 9


def test_answer_records_search_once(spark, small, monkeypatch):
    """Band, gate and ranks read one search of vectors, and the second net is asked only for questions that it may answer."""
    from glosswork.operators import evaluate as ev
    from glosswork.operators import lexical
    from glosswork.operators import vectors as vec
    from glosswork.plans import answers
    from glosswork.plans import retrieval as rt

    searches, asked, search, shared = [], [], vec.search, lexical.top_shared
    stats = rt._stats(spark, small)
    want = {r.query_id for r in ev.band(stats, 0.36, 0.42).where("band != 'refuse'").where(f"score_gap >= {answers.GATE}").collect()}
    monkeypatch.setattr(vec, "search", lambda *a, **k: searches.append(1) or search(*a, **k))
    monkeypatch.setattr(lexical, "top_shared", lambda q, r, k: asked.extend(x.query_id for x in q.select("query_id").collect()) or shared(q, r, k))
    answers.answer_records(spark, small)
    assert len(searches) == 1 and set(asked) <= want
