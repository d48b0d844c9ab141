"""Scans with carry against plain loops, with any number of hot keys, ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from glosswork.operators import intervals as iv
from glosswork.operators import scan as sc
from glosswork.operators import sequence as sq


def random_rows(seed, n=400):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["warm"] * 2 + ["a", "b", None]
    return [(rng.choice(keys), i, rng.randint(0, 500), rng.choice([None, *range(30)])) for i in range(n)]


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture
def ranges(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


@pytest.mark.parametrize("hot", [None, 1, 50, 10_000])
def test_latest_previous_and_running(spark, ranges, hot):
    rows = random_rows(1)
    df = spark.createDataFrame(rows, "k string, id long, at long, v long")
    scan = sc.Scan(df, "k", ["at", "id"], hot)
    assert scan.split == (hot in (1, 50))
    out = sc.latest(scan, scan.rows, "v", "last")
    out = sc.previous(scan, out, "v", "before")
    for how in ("sum", "max", "min"):
        out = sc.running(scan, sc.running(scan, out, "v", how, how), "v", f"{how}_b", how, before=True)
    got = {r["id"]: r for r in scan.done(out).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        group.sort(key=lambda r: (r[2], r[1]))
        for i, (_, id_, _, _) in enumerate(group):
            upto, prior = [r[3] for r in group[: i + 1] if r[3] is not None], [r[3] for r in group[:i] if r[3] is not None]
            want = [upto[-1] if upto else None, group[i - 1][3] if i else None]
            for f in (sum, max, min):
                want += [f(upto) if upto else None, f(prior) if prior else None]
            r = got[id_]
            assert [r[c] for c in ("last", "before", "sum", "sum_b", "max", "max_b", "min", "min_b")] == want


def test_one_key_spreads_over_all_tasks(spark, ranges):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(5).alias("at"), "id")  # one key, one time
    scan = sc.Scan(df, "k", ["at"], 1000)
    sizes = [r[1] for r in scan.rows.groupBy(sc.RANGE).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 2 * 20_000 / 7
    out = scan.done(sc.running(scan, scan.rows.withColumn("one", F.lit(1)), "one", "n"))
    assert sorted(r[0] for r in out.select("n").collect()) == list(range(1, 20_001))


def test_any_combination(spark, ranges):
    """Best sum of neighbouring rows: a state of four numbers with its own combination."""
    rng = random.Random(4)
    values = [rng.randint(-9, 9) for _ in range(300)]
    scan = sc.Scan(spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i long, v long"), "k", ["i"], 5)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])  # of one range
    fold = F.aggregate(ordered, F.struct(*[F.lit(0).cast("long").alias(c) for c in ("now", "best")]), lambda a, v: F.struct(F.greatest(a["now"] + v, F.lit(0)).alias("now"), F.greatest(a["best"], a["now"] + v).alias("best")))
    head = F.aggregate(ordered, F.struct(*[F.lit(0).cast("long").alias(c) for c in ("now", "best")]), lambda a, v: F.struct((a["now"] + v).alias("now"), F.greatest(a["best"], a["now"] + v).alias("best")))
    both = lambda a, b: {"total": a["total"] + b["total"], "head": max(a["head"], a["total"] + b["head"]), "tail": max(b["tail"], b["total"] + a["tail"]), "best": max(a["best"], b["best"], a["tail"] + b["head"])}
    parts = {"total": F.sum("v"), "head": head["best"], "tail": fold["now"], "best": fold["best"]}
    out = scan.carry(scan.rows, "c", parts, both)
    last = out.where("c is not null").groupBy("c").agg(F.min("i").alias("i")).collect()
    assert len(last) >= 4
    for r in last:
        part, best = values[: r["i"]], 0
        for a in range(len(part)):
            for b in range(a, len(part) + 1):
                best = max(best, sum(part[a:b]))
        assert r["c"]["best"] == best and r["c"]["total"] == sum(part)


@pytest.mark.parametrize("hot", [None, 1, 40])
def test_intervals(spark, ranges, hot):
    rng = random.Random(9)
    spans = [(k, s, s + rng.randint(0, 12), i) for i, (k, _, s, _) in enumerate(random_rows(2))]
    df = spark.createDataFrame(spans, "k string, start long, end long, id long")
    want = []
    for k, group in by_key(spans).items():
        merged = []
        for _, s, e, _ in sorted(group, key=lambda r: r[1:3]):
            if merged and s <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(e, merged[-1][1]), merged[-1][2] + 1]
            else:
                merged.append([s, e, 1])
        want += [(k, *m) for m in merged]
    assert sorted(map(tuple, iv.merge(df, "k", hot).select("k", "start", "end", "parts").collect()), key=str) == sorted(want, key=str)
    gap = iv.gaps(df, "k", "start", "end", 5, hot).collect()
    for k, group in by_key(spans).items():
        mine = sorted((r for r in gap if r["k"] == k), key=lambda r: (r["start"], r["end"]))
        ends = [r[2] for r in sorted(group, key=lambda r: r[1:3])]
        assert [r["gap"] for r in mine] == [None, *(r["start"] - e for r, e in zip(mine[1:], ends, strict=False))]
        assert all(r["soft_before"] == (r["gap"] is not None and r["gap"] >= 5) for r in mine)
    events = [(k, s, i) for k, s, _, i in spans if i % 3 == 0]
    points = [(k, s, i) for k, s, _, i in spans if i % 3]
    found = iv.as_of(spark.createDataFrame(points, "k string, at long, id long"), spark.createDataFrame(events, "k string, at long, v long"), "k", "at", "v", hot).collect()
    assert len(found) == len(points)
    for r in found:
        times = [(t, v) for k, t, v in events if k == r["k"] and t <= r["at"]]
        assert (r["v"] is None) == (not times) and (not times or r["v"] in [v for t, v in times if t == max(times)[0]])


def test_rolling_captions_of_a_hot_key(spark, ranges):
    rng = random.Random(6)
    cues = [("k", i, [rng.choice("ab") for _ in range(rng.randint(0, 4))]) for i in range(200)]
    df = spark.createDataFrame(cues, "doc_id string, cue long, words array<string>")
    plain, split = (sorted(map(tuple, sq.rolling(df, hot_rows=h).select("cue", "kind", "emitted").collect())) for h in (None, 10))
    assert plain == split
    text = df.select("doc_id", "cue", F.array_join("words", "").alias("text"))
    for f in (lambda h: sq.prefix_growth(text, "doc_id", "cue", hot_rows=h), lambda h: sq.collapse_repeats(text, "doc_id", "cue", "text", hot_rows=h)):
        assert sorted(map(str, f(None).collect())) == sorted(map(str, f(10).collect()))
