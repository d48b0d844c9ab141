"""Exact copies, fingerprints and similar documents against plain versions."""

import hashlib
import random
import re

import numpy as np
import oracle
import pytest
import xxhash

from glosswork.llm import exact_dedup as ex
from glosswork.llm import queries, similar
from glosswork.llm import simhash as sh
from glosswork.operators.graph import connected

SCHEMA = "doc_id long, text string, extra string, fp string, rid long, component string"
ODD = [(5, None), (3, ""), (4, " \t"), (1, "Ab c"), (2, "ab  C"), (2, "ab  C"), (None, "Ab \n c"), (7, "x"), (8, "long " * 3000 + "end"), (9, "long " * 3000 + "end"), (10, "ab C")]


@pytest.fixture
def table(spark, tmp_path):
    def make(rows):
        df = spark.createDataFrame([(i, t, "e", "f", 1, "c") for i, t in rows], SCHEMA)
        path = f"{tmp_path}/{random.random()}"
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


def test_hash_combines():
    powers = ex._powers()
    rng = random.Random(4)
    for size in (0, 1, 5, 16384, 16385, 70_000):
        data = rng.randbytes(size)
        plain = [0, 0]
        for b in data:
            for k in (0, 1):
                plain[k] = (plain[k] * ex.BASES[k] + b + 1) % ex.PRIMES[k]
        assert ex.hash_bytes(data, powers) == tuple(plain)
        cut = size // 3
        left, right = (*ex.hash_bytes(data[:cut], powers), cut), (*ex.hash_bytes(data[cut:], powers), size - cut)
        assert ex.combine(left, right) == (*plain, size)


def test_parts_do_not_matter(table, monkeypatch):
    whole = {(r.doc_id, r.text_sha256): (r.fp1, r.fp2, r.nbytes) for r in ex.fingerprints(table(ODD)).collect()}
    monkeypatch.setattr(ex, "PART", 7)
    assert whole == {(r.doc_id, r.text_sha256): (r.fp1, r.fp2, r.nbytes) for r in ex.fingerprints(table(ODD)).collect()}


def plain_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        same = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        known = [j for j in same if j is not None]
        out.append((i, min(known) if known else None, len(same), hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_exact(table):
    got = ex.exact_duplicates(table(ODD)).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(plain_exact(ODD), key=key)
    assert sum(r.kept for r in got) == len({x[3] for x in plain_exact(ODD)})
    stay = ex.drop_exact_duplicates(table(ODD))
    assert set(stay.columns) == {"doc_id", "text", "extra", "fp", "rid", "component"}
    assert sorted(r.doc_id for r in stay.collect()) == sorted({x[1] for x in plain_exact(ODD)})


def test_one_fingerprint_for_two_texts(table):
    """With bases of 1 a hash is the sum of bytes, so anagrams collide; only the comparison tells them apart."""
    long = "long " * 250_000
    rows = [(1, "abc"), (2, "cab"), (3, "abc"), (4, "zz"), (5, "bca"), (6, "cab"), (7, long + "ab"), (8, long + "ba"), (9, long + "ab"), (10, "ab" + long)]
    prints = {r.doc_id: (r.fp1, r.fp2, r.nbytes) for r in ex.fingerprints(table(rows), bases=(1, 1)).collect()}
    assert prints[1] == prints[2] == prints[5] and prints[7] == prints[8]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in ex.exact_duplicates(table(rows), bases=(1, 1)).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 6: (2, 2), 4: (4, 1), 5: (5, 1), 7: (7, 2), 9: (7, 2), 8: (8, 1), 10: (10, 1)}
    assert got == {r.doc_id: (r.keep_id, r.group_size) for r in ex.exact_duplicates(table(rows)).collect()}


def test_empty_tables(table):
    none = table([(1, "a")]).where("false")
    assert ex.exact_duplicates(none).count() == 0
    assert sh.near_duplicates(none).count() == 0
    assert similar.similar_documents(none).count() == 0


def plain_simhash(text, words=3):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", ["", "one", "Two Words", "É ÀB c d e f", "a b c " * 50, "x\x1cy z\x0bw q", "  lead and trail  "])
def test_simhash(text):
    assert sh.simhash(text.encode()) == plain_simhash(text)


def test_slabs_add_up(monkeypatch):
    text = " ".join(str(i * i) for i in range(200))
    whole = sh.simhash(text.encode())
    monkeypatch.setattr(sh, "SLAB", 7)
    assert sh.simhash(text.encode()) == whole


def plain_components(fps):
    comp = list(range(len(fps)))
    while True:
        new = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == comp:
            return comp
        comp = new


@pytest.mark.parametrize("limit", [64, 2])
def test_links_connect_all_within_three_bits(spark, monkeypatch, limit):
    monkeypatch.setattr(sh, "PAIRS_UP_TO", limit)
    rng = random.Random(limit)
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(14):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = sh.links(nodes)
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in edges.collect())
    roots = {r.node: r.root for r in connected(edges).collect()}
    got = [roots.get(x, x) for x in signed]
    want = plain_components(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_near_duplicates(table):
    got = {(r.doc_id, r.rid): r for r in sh.near_duplicates(table(ODD)).collect()}
    assert len(got) == len(ODD)
    assert {r.component_id for r in got.values() if r.doc_id in (3, 4, 5)} == {3}
    assert {r.component_id for r in got.values() if r.doc_id in (1, 2, None, 10)} == {1}
    assert all(r.fp & (2**64 - 1) == plain_simhash(dict((i, t) for i, t in ODD)[r.doc_id]) for r in got.values())


def test_query_equals_brute_force(spark, small):
    rows = queries.QUERIES["op1_simhash"](spark, small).collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    ids = np.array([r.doc_id for r in rows])
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)) <= 3
    comp = ids.copy()
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    assert comp.tolist() == [r.component_id for r in rows]


def test_exact_query_equals_sql(spark, small):
    assert oracle.compare(spark, oracle.connect(small), small, queries.QUERIES["op4_exact_dedup"], queries.ORACLES["op4_exact_dedup"]) == ""


def jaccard(a, b):
    s = [set(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_similar_documents(table):
    rng = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(500)]
    for k in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for j in range(5):
            w = list(base)
            for at in rng.sample(range(150), (0, 1, 2, 3, 15)[j]):
                w[at] = "other"
            rows.append((k * 10 + j, " ".join(w)))
    comp = {r.doc_id: r.component for r in similar.similar_documents(table(rows)).collect()}
    for i, a in rows:
        for j, b in rows:
            if i < j and i // 10 == j // 10 and jaccard(a, b) >= 0.85:
                assert comp[i] == comp[j]
            if i // 10 != j // 10:
                assert comp[i] != comp[j]
    for k in range(12):  # fifteen changed words leave too little in common
        assert comp[k * 10 + 4] != comp[k * 10]
    assert sorted(r.doc_id for r in similar.drop_similar(table(rows)).collect()) == sorted(x for k in range(12) for x in (k * 10, k * 10 + 4))


def test_crowded_entries_still_join(table):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)]
    assert len({r.component for r in similar.similar_documents(table(rows)).collect()}) == 1


def test_rows_keep_their_places_when_executors_change(spark, table):
    from glosswork.llm import common

    common.bound_batches(spark)
    held = spark.conf.get(common.SPLITS)
    assert int(held) >= 8
    common.bound_batches(spark)
    assert spark.conf.get(common.SPLITS) == held
