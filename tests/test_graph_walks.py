"""Walks of many questions against one plain walk for each, and names in questions against every pair."""

import random

import pytest

from glosswork.operators import graph as gr


def plain_walk(seeds, edges, hops):
    near = {}
    for e, a, b in edges:
        near.setdefault(a, []).append((b, e))
        near.setdefault(b, []).append((a, e))
    reached, touched, frontier = {s: 0 for s in seeds}, {}, set(seeds)
    for hop in range(1, hops + 1):
        step = {(b, e) for a in frontier for b, e in near.get(a, [])}
        for _, e in step:
            touched.setdefault(e, hop)
        frontier = {b for b, _ in step if b not in reached}
        reached.update(dict.fromkeys(frontier, hop))
    return reached, touched


@pytest.mark.parametrize("hub", [2, 100_000])
@pytest.mark.parametrize("hops", [1, 3])
def test_walks(spark, hub, hops):
    rng = random.Random(hub + hops)
    edges = [(f"e{i}", 0 if i % 3 == 0 else rng.randint(0, 40), rng.randint(0, 40)) for i in range(60)]  # node 0 is a hub; loops and repeats occur
    seeds = [(q, rng.randint(0, 60)) for q in range(8) for _ in range(2)] + [(3, 3), (3, 3)]
    near = gr.adjacency(spark.createDataFrame(edges, "edge string, source int, target int"))
    nodes, touched = gr.walk_each(spark.createDataFrame(seeds, "query_id int, node int"), near, hops, hub)
    got_nodes, got_edges = sorted(map(tuple, nodes.collect())), sorted(map(tuple, touched.collect()))
    want_nodes, want_edges = [], []
    for q in {s[0] for s in seeds}:
        reached, seen = plain_walk({n for k, n in seeds if k == q}, edges, hops)
        want_nodes += [(q, n, h) for n, h in reached.items()]
        want_edges += [(q, e, h) for e, h in seen.items()]
    assert got_nodes == sorted(want_nodes) and got_edges == sorted(want_edges)


def test_mentions(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    names = [(i, word(rng.randint(1, 12))) for i in range(150)] + [(500, None), (501, "abc"), (502, "abc")]
    asked = [(i, word(rng.randint(0, 40))) for i in range(30)] + [(100, None), (101, "xabcx"), (102, "ab"), (103, names[7][1])]
    got = gr.mentions(spark.createDataFrame(asked, "query_id int, question string"), spark.createDataFrame(names, "node int, name string"), 3, 5)
    want = sorted((q, n) for q, t in asked for n, name in names if t is not None and name is not None and len(name) >= 3 and name in t)
    assert sorted(map(tuple, got.collect())) == want and (101, 502) in want


def test_common_names_are_dealt(spark):
    """A name of many nodes that many questions hold comes from several tasks; nodes of two names come once."""
    names = [(i, "bolt") for i in range(50)] + [(i, "nut bolt") for i in range(45, 55)] + [(7, "bolt"), (99, "unasked")]
    asked = [(q, "which nut bolt?" if q % 2 else "a bolt") for q in range(20)]
    got = gr.mentions(spark.createDataFrame(asked, "query_id int, question string"), spark.createDataFrame(names, "node int, name string"), 3, 5, name_rows=100)
    want = sorted((q, n) for q in range(20) for n in range(55 if q % 2 else 50))
    assert sorted(map(tuple, got.collect())) == want


def test_search_walks_once_for_a_name(spark, monkeypatch):
    """The evidence of questions, each from all nodes that it names, though walks are made for names."""
    rng = random.Random(9)
    edges = [(f"e{i}", rng.randint(0, 30), rng.randint(0, 30)) for i in range(35)]
    names = [(i, ["red", "blue", "old", "cold", "new"][i % 5]) for i in range(12)] + [(40, "lone")]
    asked = [(1, "a red one"), (2, "red and blue"), (3, "cold"), (4, "none"), (5, "lone"), (6, "a red one"), (7, None)]
    frame = spark.createDataFrame
    n, e = frame(names, "node int, name string"), frame(edges, "edge string, source int, target int")
    node_chunks, edge_chunks = frame([(i, i % 17) for i in range(41)], "node int, chunk int"), frame([(x, int(x[1:]) % 23) for x, _, _ in edges], "edge string, chunk int")
    q = frame(asked, "query_id int, question string")
    plain = gr.evidence(*gr.walk_each(gr.mentions(q, n), gr.adjacency(e), 2), node_chunks, edge_chunks)
    seeds, walk = [], gr.walk_each
    monkeypatch.setattr(gr, "walk_each", lambda s, *a: seeds.append(s.count()) or walk(s, *a))
    got = gr.search(q, n, gr.adjacency(e), node_chunks, edge_chunks, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert seeds == [sum(any(m in (t or "") for _, t in asked) for _, m in names)]  # each name once, however many questions


@pytest.mark.parametrize("hub", [2, 100_000])
def test_packed_walks(spark, hub):
    """64 questions to a row, as bits: the same walks, and no more rows for 60 questions of the same seeds than for one."""
    rng = random.Random(hub)
    edges = [(f"e{i}", 0 if i % 3 == 0 else rng.randint(0, 40), rng.randint(0, 40)) for i in range(60)]
    seeds = [(q, rng.randint(0, 60)) for q in range(1, 140) for _ in range(2)] + [(63, 3), (127, 3), (127, 3)]
    near = gr.adjacency(spark.createDataFrame(edges, "edge string, source int, target int"))
    asked = spark.createDataFrame(seeds, "query_id long, node int")
    for packed, plain, key in zip(gr.walk_each(asked, near, 2, hub, True), gr.walk_each(asked, near, 2, hub), ("node", "edge"), strict=True):
        got = {}
        for r in packed.collect():
            for i in range(64):
                if r["mask"] >> i & 1:
                    at = (r["block"] * 64 + i, r[key])
                    got[at] = min(r["hop"], got.get(at, 9))
        assert got == {(r["query_id"], r[key]): r["hop"] for r in plain.collect()}
    same = spark.range(60).selectExpr("id as query_id", "0 as node")
    counts = lambda s: [df.count() for df in gr.walk_each(s, near, 2, hub, True)]
    assert counts(same) == counts(same.where("query_id = 0"))


def test_search_of_many_names(spark):
    """Names of several blocks, sets of names that questions share, a name inside another one."""
    rng = random.Random(4)
    edges = [(f"e{i}", rng.randint(0, 119), rng.randint(0, 119)) for i in range(150)]
    names = [(i, f"<n{i}>" if i < 90 else "n7>") for i in range(100)] + [(110, None), (5, "<n6>")]
    asked = [(q, " ".join(f"<n{rng.randint(0, 99)}>" for _ in range(q % 4))) for q in range(150)] + [(200, "<n7>"), (201, "<n7>"), (202, None)]
    frame = spark.createDataFrame
    q, n, e = frame(asked, "query_id int, question string"), frame(names, "node int, name string"), frame(edges, "edge string, source int, target int")
    node_chunks, edge_chunks = frame([(i, f"c{i % 31}") for i in range(120)], "node int, chunk string"), frame([(x, f"c{int(x[1:]) % 40}") for x, _, _ in edges], "edge string, chunk string")
    plain = gr.evidence(*gr.walk_each(gr.mentions(q, n), gr.adjacency(e), 2), node_chunks, edge_chunks)
    got = gr.search(q, n, gr.adjacency(e), node_chunks, edge_chunks, 2)
    assert got.columns == ["query_id", "chunk", "kind", "hop", "key"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select(*got.columns).collect()))
    assert gr.search(q.where("query_id = 202"), n, gr.adjacency(e), node_chunks, edge_chunks, 2).count() == 0
