"""Ledgers, siblings, merges, fingerprints, samples and graphs on small cases."""

import random

from pyspark.sql import functions as F

from glosswork.operators import curate as cu
from glosswork.operators import graph as gr
from glosswork.operators import sampling as sa


def siblings(spark, evidence, answers, cap=10):
    e = spark.createDataFrame([(1, i, *x) for i, x in enumerate(evidence)], "query_id int, rank int, chunk_id string, qa_id string, is_question boolean")
    a = spark.createDataFrame(answers, "qa_id string, chunk_index int, chunk_id string")
    return [r.chunk_id for r in cu.expand_siblings(e, a, cap).orderBy("ordinal").collect()]


def test_siblings(spark):
    d0, q, a = ("d0", None, False), ("q", "Q", True), ("a", "Q", False)
    assert siblings(spark, [d0, q], [("Q", 1, "a")]) == ["d0", "q", "a"]
    assert siblings(spark, [a, q], [("Q", 1, "a")]) == ["a", "q"]
    assert siblings(spark, [q], [("Q", i, f"a{i}") for i in (3, 1, 2)]) == ["q", "a1", "a2", "a3"]
    assert len(siblings(spark, [q], [("Q", i, f"a{i:02}") for i in range(12)])) == 11
    assert siblings(spark, [d0, q], [("R", 1, "x")]) == ["d0"]
    once = siblings(spark, [d0, q], [("Q", 1, "a")])
    again = [(c, "Q" if c == "q" else None, c == "q") for c in once]
    assert siblings(spark, again, [("Q", 1, "a")]) == once


def test_ledger(spark):
    schema = "id string, title string, classification string, review_status string, review_reason string"
    ledger = spark.createDataFrame([("a", "old", "CANDIDATE", "APPROVED", "good"), ("z", "gone", "CANDIDATE", "PENDING", "")], schema)
    meta = spark.createDataFrame([("a", "new", "REVIEW"), ("b", "fresh", "CANDIDATE"), ("c", "no", "EXCLUDE")], "id string, title string, classification string")

    def merge(ledger):
        return cu.ledger_merge(ledger, meta, "id", ["title", "classification"], {"review_status": "PENDING", "review_reason": ""}, F.col("classification") == "CANDIDATE")

    got = sorted(tuple(r) for r in merge(ledger).collect())
    assert got == [("a", "new", "REVIEW", "APPROVED", "good"), ("b", "fresh", "CANDIDATE", "PENDING", ""), ("z", "gone", "CANDIDATE", "PENDING", "")]
    assert sorted(tuple(r) for r in merge(spark.createDataFrame(got, schema)).collect()) == got


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(i, f"text {i}") for i in range(50)]
    f = lambda r: cu.fingerprint(spark.createDataFrame(r, "id int, text string").repartition(3), "id", "text").first().fingerprint
    assert f(rows) == f(rows[::-1]) != f([*rows[:-1], (49, "other")])


def test_prompt_numbers_what_may_be_cited(spark):
    q = spark.createDataFrame([(1, "why?", "hedge")], "query_id int, question string, band string")
    e = spark.createDataFrame([(1, 1, "h1", "t1", True), (1, 2, "h2", "t2", False), (1, 3, "h3", "t3", True)], "query_id int, ordinal int, header string, text string, citable boolean")
    text = cu.prompts(q, e).first().prompt
    assert "[1] h1\nt1\n\n[2] h3\nt3" in text and "Cases:\n(h2)\nt2" in text and cu.HEDGE_RULE in text and text.endswith("Question: why?")


def test_backfill(spark):
    r = spark.createDataFrame([("a", "v2", "answer", None, True), ("b", "v1", "answer", None, True), ("c", "v2", "refuse", None, False), ("d", "v2", "answer", "x", True), ("e", "v2", "answer", "", True)], "query_id string, prompt_version string, band string, answer string, generated boolean")
    a = spark.createDataFrame([(k, "new") for k in "abcdz"], "query_id string, text string")
    got = {x.query_id: (x.status, x.answer) for x in cu.backfill(r, a, "v2").collect()}
    assert got == {"a": ("filled", "new"), "b": ("version mismatch", None), "c": ("refused band", None), "d": ("occupied", "x"), "e": ("pending", ""), "z": ("unknown", None)}


def test_stratified_shares(spark):
    rows = [(i, "a") for i in range(2)] + [(10 + i, "b") for i in range(20)] + [(40 + i, "c") for i in range(20)]
    got = sa.stratified(spark.createDataFrame(rows, "id int, s string"), "id", ["s"], 11, 1)
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {"a": 2, "b": 5, "c": 4}
    everything = sa.stratified(spark.createDataFrame(rows, "id int, s string"), "id", ["s"], 100, 1)
    assert everything.count() == len(rows)


def test_numbers(spark):
    df = spark.createDataFrame([(i,) for i in range(99, -1, -1)], "id int").repartition(7)
    assert all(r.row_number == r.id + 1 for r in sa.number(df, "id").collect())
    assert [r.id for r in sa.systematic(df, "id", 7).orderBy("id").collect()] == [i * 14 for i in range(7)]


def test_walk_paths_and_components(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "d", "u"), ("x", "y", "t")], "source string, target string, type string").withColumn("edge", F.concat("source", "target"))
    near, touched = gr.walk(spark.createDataFrame([("b",)], "node string"), gr.adjacency(edges), 2)
    assert {r.node: r.hop for r in near.collect()} == {"b": 0, "a": 1, "c": 1, "d": 2}
    assert {r.edge: r.hop for r in touched.collect()} == {"ab": 1, "bc": 1, "cd": 2}
    assert sorted(r.path for r in gr.incoming_paths(edges, "c", ["t"]).collect()) == ["a -[t]-> b -[t]-> c", "b -[t]-> c"]
    nodes = spark.createDataFrame([(n,) for n in "abcdxyz"], "node string")
    assert {r.node: r.component for r in gr.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "z"}


def test_long_chain_settles(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1, i) for i in range(n)], "source long, target long, edge long")
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)], "node long")
    assert {r.component for r in gr.components(nodes, edges).collect()} == {0}


def test_fold_takes_the_last_type_of_a_chunk(spark):
    e = spark.createDataFrame([("k", 1, "x", "one"), ("k", 2, "x", "two"), ("k", 3, "y2", "one")], "chunk string, pos int, name string, type string")
    r = spark.createDataFrame([("k", "x", "y2", "t"), ("k", "x", "q", "t"), ("k", "x", "y2", "odd")], "chunk string, source string, target string, type string")
    nodes, edges, bad = gr.fold(e, r, spark.createDataFrame([("y2", "y")], "surface string, canonical string"), ["t"])
    assert {(n.node, n.type, tuple(n.aliases)) for n in nodes.collect()} == {("x", "one", ()), ("x", "two", ()), ("y", "one", ("y2",))}
    assert [(x.source, x.source_type, x.target) for x in edges.collect()] == [("x", "two", "y")]
    assert sorted(b.reason for b in bad.collect()) == ["not an entity of this chunk", "unknown type"]


def plain_components(nodes, edges):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(0, i) for i in range(1, 300, 9)]
    edges = spark.createDataFrame([(a, b, str(i)) for i, (a, b) in enumerate(pairs)], "source long, target long, edge string")
    got = gr.components(spark.createDataFrame([(i,) for i in range(300)], "node long"), edges)
    assert {r.node: r.component for r in got.collect()} == plain_components(range(300), pairs)
    none = edges.where("false")
    assert {r.component for r in gr.components(spark.createDataFrame([(1,), (2,)], "node long"), none).collect()} == {1, 2}


def test_components_query(spark, small):
    from glosswork.plans import graphs

    nodes = [r.node for r in graphs._nodes(spark, small).collect()]
    pairs = [(r.source, r.target) for r in graphs._edges(spark, small).collect()]
    assert {r.node: r.component for r in graphs.components(spark, small).collect()} == plain_components(nodes, pairs)


def test_degrees_density_upsert(spark):
    nodes = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u"), ("d", "u")], "node string, type string")
    edges = spark.createDataFrame([("a", "b", "1"), ("a", "c", "2"), ("a", "c", "3"), ("c", "c", "4")], "source string, target string, edge string")
    got = {r.type: (r.nodes, r.isolated, r.orphan_rate, r.largest, r.mean) for r in gr.degrees(nodes, edges).collect()}
    assert got == {"t": (2, 0, 0.0, 3, 2.0), "u": (2, 1, 0.5, 4, 2.0)}
    assert tuple(gr.density(nodes, edges).first()) == (4, 2, round(2 / 12, 9))
    assert gr.density(nodes.where("false"), edges.where("false")).first().density == 0.0
    old = spark.createDataFrame([("a", 1, 9), (None, 1, 1)], "k string, n long, first long")
    new = spark.createDataFrame([("a", 2, 3), ("b", 1, 5), (None, 4, 2)], "k string, n long, first long")
    assert {tuple(r) for r in gr.upsert(old, new, ["k"], ["n"], ["first"]).collect()} == {("a", 3, 3), ("b", 1, 5), (None, 5, 1)}


def test_fingerprints_of_nulls(spark):
    make = lambda *rows: cu.fingerprint(spark.createDataFrame(rows, "k long, t string"), "k", "t").first().fingerprint
    seen = [make((1, "a"), (2, None)), make((1, "a"), (7, None)), make((1, "a")), make((1, "a"), (2, "")), make((1, "a"), (None, ""))]
    assert len(set(seen)) == len(seen) and make((2, None), (1, "a")) == seen[0]


def test_questions_of_a_model(spark):
    ask = "what does it take to bake good bread at home"
    rows = [(1, f"- {ask}"), (2, f'"{ask.upper()}"'), (3, None), (4, "why"), (5, "10. how long does it have to rest in the fridge"), (6, " ")]
    got = cu.normalise_questions(spark.createDataFrame(rows, "id int, question string"), ["id"])
    assert {r.id: r.reason for r in got.collect()} == {1: None, 2: "seen before", 3: "empty", 4: "short", 5: None, 6: "empty"}
    assert {r.question for r in got.where("id = 5").collect()} == {"how long does it have to rest in the fridge"}


def test_citations(spark):
    rows = [(1, 1, "a", False), (1, 2, "b", True), (1, 5, "c", True), (2, 1, "a", True)]
    got = cu.citations(spark.createDataFrame(rows, "query_id int, ordinal int, chunk_id string, citable boolean"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "b"), (1, 2, "c"), (2, 1, "a")]


def test_fold_looks_ends_up_once(spark):
    """Edges and what is unresolved come from one look-up of all ends, and counts of nodes from plain aggregates; nulls are names and types like any other."""
    e = spark.createDataFrame([(1, 1, "a", "t"), (1, 2, "a2", "t"), (2, 1, "a2", "t"), (2, 2, None, "t"), (3, 1, "b", None), (None, 1, "b", None), (4, 1, "a", "u")], "chunk int, pos int, name string, type string")
    r = spark.createDataFrame([(1, "a2", "a", "k"), (2, "a2", "a", "k"), (1, "a", "a2", "x")], "chunk int, source string, target string, type string")
    nodes, edges, bad = gr.fold(e, r, spark.createDataFrame([("a2", "a"), ("c", "a")], "surface string, canonical string"), ["k"])
    assert {(n.node, n.type): (n.chunks, n.first_chunk, n.aliases) for n in nodes.collect()} == {("a", "t"): (2, 1, ["a2"]), (None, "t"): (1, 2, []), ("b", None): (1, 3, []), ("a", "u"): (1, 4, [])}
    assert [tuple(x) for x in edges.collect()] == [("a", "t", "k", "a", "t", 1, 1)]
    assert sorted(map(tuple, bad.collect())) == [(1, "a", "a2", "x", "unknown type"), (2, "a2", "a", "k", "not an entity of this chunk")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(edges) + plan(bad) and "Expand" not in plan(nodes)


def test_components_aggregate_longs_only(spark):
    """Names are linked by numbers, so no round sorts strings; numbers that meet are drawn anew."""
    rng = random.Random(8)
    pairs = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(40)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(70)], "node string")
    drawn = []

    def few(seed, name):  # the first two draws give many names one number
        drawn.append(1)
        return F.when(seed < 2, F.xxhash64(seed, name) % 5).otherwise(F.xxhash64(seed, name))

    got = gr.components(nodes, edges, few)
    assert {r.node: r.component for r in got.collect()} == plain_components([f"n{i}" for i in range(70)], pairs) and len(drawn) > 3
    numbers = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "u long, v long")
    roots = {r.node: r.root for r in gr.connected_numbers(numbers).collect()}
    assert roots[1] == roots[2] == roots[3] != roots[7] == roots[9]


def test_pairs_are_dealt_by_their_number(spark, small, monkeypatch):
    """As many tasks fold pairs as line items ask for."""
    from glosswork.plans import graphs

    monkeypatch.setattr(graphs, "PAIR_ROWS", 500)
    items = spark.read.parquet(f"{small}/lineitem.parquet")
    got = graphs._pairs(spark, small)
    assert got.rdd.getNumPartitions() == -(-items.count() // 500)
    assert got.count() == items.select("l_suppkey", "l_partkey").distinct().count()
