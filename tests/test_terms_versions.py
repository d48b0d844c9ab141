"""Nearest terms against every pair, and versions against plain sets."""

import random

from glosswork.operators import lexicon as lx
from glosswork.operators import versions as vs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest(spark):
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    words, terms = [word() for _ in range(120)] + [None, ""], [word() for _ in range(90)] + [None, "", "a"]
    got = lx.nearest(spark.createDataFrame([(w, 1) for w in words], "word string, term int"), spark.createDataFrame([(t,) for t in terms], "term string"))
    want = []
    for w in {w for w in words if w is not None}:
        near = min(((edits(w, t), t) for t in terms if t is not None and edits(w, t) <= (1 if len(w) <= 4 else 2)), default=None)
        want += [(w, near[1], near[0])] if near else []
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_changes(spark):
    rng = random.Random(3)
    old = {i: (rng.choice(["a", "b", "", None]), rng.choice(["x", None])) for i in range(500)}
    new = dict(old)
    for i in rng.sample(sorted(new), 20):
        del new[i]
    for i in rng.sample(sorted(new), 15):
        new[i] = ("other", new[i][1])
    new |= {1000 + i: ("n", None) for i in range(10)}
    new[next(i for i in new if new[i][0] == "")] = (None, "x")
    frame = lambda v: vs.rows_of(spark.createDataFrame([(i, *r, 0) for i, r in v.items()], "id long, t string, u string, leaf int"), "id", ["t", "u"])
    a, b = frame(old), frame(new)
    want = sorted([(i, "removed") for i in old if i not in new] + [(i, "added") for i in new if i not in old] + [(i, "changed") for i in new if i in old and old[i] != new[i]])
    assert sorted(map(tuple, vs.changes(a, b).collect())) == want
    assert vs.changes(a, a).count() == 0 and vs.changes(a, a.limit(0)).count() == len(old)
    trees = [vs.tree(a), vs.tree(b)]
    leaves = vs.differing(*trees)
    assert 0 < leaves.count() <= len(want)  # only those leaves are read
    root = [t.where("level = 0").first() for t in trees]
    assert [r["rows"] for r in root] == [len(old), len(new)] and root[0]["digest"] != root[1]["digest"]


def test_fields_do_not_run_together(spark):
    df = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc"), (3, None, "abc"), (4, "", "abc")], "id int, t string, u string")
    assert vs.rows_of(df, "id", ["t", "u"]).select("digest").distinct().count() == 4
