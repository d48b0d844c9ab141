"""Runs against every start and period, and the query against SQL."""

import hashlib
import random
import zlib

import oracle
import pytest

from glosswork.llm import periodic as pr
from glosswork.llm import queries


def plain_runs(words):
    """Every maximal stretch of every period, by definition."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(words):
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    line = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(runs), *four, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def random_words(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        unit = [b"%d" % rng.randint(0, rng.choice([1, 2, 5, 40])) for _ in range(rng.randint(1, 9))]
        out += (unit * rng.randint(1, 7))[: rng.randint(1, 60)]
    return out


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(0, 1) for _ in range(rng.randint(0, 30))]
        assert pr.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_runs_are_those_of_every_start_and_period():
    rng = random.Random(12)
    texts = [random_words(rng) for _ in range(3000)] + [[], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4, [b"a", b"b", b"a", b"b", b"a", b"b", b"a"]]
    assert pr.runs_of(texts) == [plain_runs(t) for t in texts]


def test_words_outside_repeated_grams_survive_nowhere():
    assert pr.GRAM == 5
    words = [b"%d" % i for i in range(1000)]
    assert pr.runs_of([words, words]) == [[], []]  # another document's grams don't count


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 6), (4, "x " * 6), (None, "a b c " * 4), (6, "y" * 100_000), (7, "p q r s t u " * 20_000), (8, "a b " * 9)]
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], "doc_id int, text string, collapsed string, n_runs int")
    got = sorted(pr.scan(df, with_runs=True, with_text=True).collect(), key=str)
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        if len(words) > 1000:
            continue
        want.append((i, len(words), *plain_row(words)))
    short = [tuple(r)[:-2] for r in got if r["n_words"] <= 1000]
    assert sorted(short, key=str) == sorted(want, key=str)
    long = next(r for r in got if r["n_words"] == 120_000)
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["collapsed"]) == (1, 0, 120_000, 6, "p q r s t u")
    assert [tuple(x) for x in next(r for r in got if r["doc_id"] is None)["runs"]] == [(0, 12, 3)]
    assert pr.scan(df.limit(0)).count() == 0
    strings = spark.createDataFrame([("k", "z " * 7)], "name string, body string")
    assert pr.scan(strings, "name", "body").first()["length"] == 7


def test_groups_of_texts_change_nothing(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole = sorted(map(tuple, pr.scan(docs).collect()))
    monkeypatch.setattr(pr, "GROUP_BYTES", 1)
    assert sorted(map(tuple, pr.scan(docs).collect())) == whole


def test_query_against_every_start_and_period(spark, small):
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, small).collect()))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((i, *plain_row(plain_planted(i, t))) for i, t in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_query_against_sql(spark, small):
    name = "op12_periodic_runs"
    assert oracle.compare(spark, oracle.connect(small), small, queries.QUERIES[name], queries.ORACLES[name]) == ""


@pytest.mark.parametrize("text", [None, "", "  ", "one", "a b c d e f g h"])
def test_planting_like_plain(spark, text):
    ids = list(range(60))
    got = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").select("doc_id", pr.planted().alias("t")).collect()
    assert all((t or "").encode().split() == plain_planted(i, text) for i, t in got)
