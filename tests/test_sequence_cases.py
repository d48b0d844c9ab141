"""Captions, chunks, chapters and intervals on hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from glosswork.operators import intervals as iv
from glosswork.operators import sequence as sq


def plain_rolling(cues):
    """What each cue adds to the one before, word by word."""
    out, last = [], []
    for words in cues:
        shared = max(k for k in range(min(len(last), len(words)) + 1) if k == 0 or last[-k:] == words[:k])
        out.append(None if not words or words == last or shared == len(words) else " ".join(words[shared:]))
        last = words
    return out


def test_rolling_captions(spark):
    rng, rows, want = random.Random(12), [], {}
    for doc in range(12):
        cues, flow = [], [rng.choice("rstuv") for _ in range(60)]
        for i in range(30):
            cues.append(flow[i : i + rng.randint(0, 4)])
        rows += [(doc, i, c) for i, c in enumerate(cues)]
        want[doc] = plain_rolling(cues)
    df = sq.rolling(spark.createDataFrame(rows, "doc_id int, cue int, words array<string>"))
    for doc, emitted in want.items():
        assert [r.emitted for r in df.where(F.col("doc_id") == doc).orderBy("cue").collect()] == emitted
    for r in sq.rolling_diagnostics(df).collect():
        assert (r.total_cues, r.output_segments) == (30, sum(x is not None for x in want[r.doc_id]))
        assert r.final_word_count == sum(len(x.split()) for x in want[r.doc_id] if x)


def test_empty_cue_resets(spark):
    df = sq.rolling(spark.createDataFrame([(1, 0, ["a"]), (1, 1, []), (1, 2, ["a"])], "doc_id int, cue int, words array<string>"))
    assert [r.kind for r in df.orderBy("cue").collect()] == ["new", "empty", "new"]


def plain_chunks(rows, target, least, most, gap=1200):
    """Chunks by trying, for each beginning, every end in turn: the rule that holds first decides."""
    texts, n, s, out = [r[3] for r in rows], len(rows), 0, []
    size = lambda a, b: sum(map(len, texts[a:b])) + b - a - 1
    pause = lambda j: j < n and rows[j][1] - rows[j - 1][2] >= gap
    stop = lambda j: texts[j - 1].rstrip()[-1:] in set(".!?…")
    while s < n:
        end, soft = n, None
        for j in range(s + 1, n + 1):
            if stop(j) and size(s, j) >= least:
                soft = j
            if size(s, j) >= target and soft:
                end = soft
                break
            if j == n:
                break
            if pause(j) and size(s, j) >= least:
                soft = j
            if size(s, j) >= target and (soft or texts[j].startswith(">>")) or size(s, j) + 1 + len(texts[j]) > most:
                end = soft or j
                break
        out.append((s, end))
        s = end
    if len(out) > 1 and size(*out[-1]) < least and size(*out[-2]) + size(*out[-1]) <= most:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return [" ".join(texts[a:b]) for a, b in out]


@pytest.mark.parametrize("sizes", [(30, 12, 40), (25, 25, 60), (9, 1, 14), (40, 10, 41)])
def test_segment_chunks_follow_the_rules(spark, sizes):
    rng, rows = random.Random(sum(sizes)), []
    for key in range(40):
        at = 0
        for i in range(rng.randint(1, 40)):
            start = at + rng.choice([0, 0, 300, 1199, 1200, 5000])
            at = start + rng.randint(1, 900)
            text = rng.choice(["", "", ">>"]) + "q" * rng.randint(0, 22) + rng.choice(["", "", "", ".", "? ", "…"])
            rows.append((key, i, start, at, text))
    df = sq.chunk_segments(spark.createDataFrame(rows, "doc long, idx long, start_ms long, end_ms long, text string").repartition(3), "doc", *sizes)
    got = df.orderBy("doc", "chunk_index").collect()
    for key in range(40):
        own = [r[1:] for r in rows if r[0] == key]
        mine = [r for r in got if r.doc == key]
        assert [r.text for r in mine] == plain_chunks(own, *sizes)
        assert [r.chunk_index for r in mine] == list(range(len(mine)))
        assert [(r.first_idx, r.start_ms) for r in mine] == [(r.first_idx, own[r.first_idx][1]) for r in mine] and mine[-1].last_idx == len(own) - 1


def test_packing(spark):
    got = spark.createDataFrame([(["aaaa", "bb", "cccccc", "d"],)], "u array<string>").select(sq.pack_units("u", 7, 9).alias("x")).first().x
    assert got == ["aaaa bb", "cccccc d"]
    assert spark.createDataFrame([([],)], "u array<string>").select(sq.pack_units("u", 7, 9).alias("x")).first().x == []


def test_chapters(spark):
    """Against every chapter tried for every segment, over chapters that touch or leave gaps."""
    rng, chapters, segments, want = random.Random(17), [], [], {}
    for v in range(12):
        at, own = rng.randint(0, 50), []
        for idx in range(rng.randint(0, 6)):
            at += rng.choice([0, 0, 30])
            own.append((idx, at, at + rng.randint(1, 60)))
            at = own[-1][2]
        chapters += [(v, *c) for c in own]
        for i in range(40):
            start = rng.randint(-20, at + 40)
            end = start + rng.randint(0, 50)
            segments.append((v, i, start, end))
            lap = lambda c: max(0, min(end, c[2]) - max(start, c[1]))  # noqa: B023, E731
            away = lambda c: 0 if c[1] <= start <= c[2] else min(abs(start - c[1]), abs(start - c[2]))  # noqa: B023, E731
            best = min(own, key=lambda c: (-lap(c), 0 if lap(c) else away(c), c[0]), default=None)  # noqa: B023
            want[v, i] = (best[0], lap(best)) if best else (None, None)
    df = spark.createDataFrame(segments, "v int, id int, start long, end long")
    for size in (7, 1000):
        got = iv.assign(df, spark.createDataFrame(chapters, "v int, idx int, chapter_start long, chapter_end long"), "v", size)
        assert {(r.v, r.id): (r.chapter_index, r.overlap) for r in got.collect()} == want


def test_open_ends_close(spark):
    marks = spark.createDataFrame([(1, 0, 100), (1, 1, 200), (2, 0, 5)], "v int, idx int, chapter_start long")
    last = spark.createDataFrame([(1, 320)], "v int, last long")
    assert sorted((r.v, r.idx, r.end) for r in iv.close_open_ends(marks, "v", "chapter_start", last).collect()) == [(1, 0, 200), (1, 1, 320), (2, 0, 5)]


def test_overlap_join_counts_each_pair_once(spark):
    a = [(1, i, s, e) for i, (s, e) in enumerate([(0, 100), (50, 60), (95, 300), (7, 7)])]
    left = spark.createDataFrame(a, "k int, id int, start long, end long")
    right = left.select("k", F.col("id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    want = sorted((x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in a if max(x[2], y[2]) < min(x[3], y[3]))
    for size in (10, 37, 1000):
        assert sorted((r.id, r.other_id, r.overlap) for r in iv.overlap_join(left, right, "k", size).collect()) == want


def test_overlapping_spans_are_merged_before_cutting(spark):
    text = spark.createDataFrame([(1, "0123456789"), (2, "abc")], "id int, text string")
    spans = spark.createDataFrame([(1, 2, 5), (1, 4, 7), (1, 9, 10)], "id int, start long, end long")
    assert sorted((r.id, r.text) for r in iv.cut(text, spans).collect()) == [(1, "0178"), (2, "abc")]


def test_fold_rollups(spark):
    """Against a loop over lines: of two lines in a row of which one goes on from the other, the longer stays."""
    rng, rows, want = random.Random(3), [], {}
    for key in range(30):
        lines = ["".join(rng.choice("xy") for _ in range(rng.randint(0, 4))) for _ in range(12)]
        kept = []
        for line in lines:
            if kept and (kept[-1].endswith(line) or line.startswith(kept[-1])):
                kept[-1] = max(kept[-1], line, key=len)
            else:
                kept.append(line)
        rows.append((key, lines))
        want[key] = kept
    got = sq.fold_rollups(spark.createDataFrame(rows, "id int, lines array<string>"))
    assert {r.id: r.lines for r in got.collect()} == want


def test_parents_go_to_the_next_section_with_text(spark):
    lines = [(1, i, t, h) for i, (t, h) in enumerate([("H1", True), ("H2", True), ("text", False), ("H3", True), ("more", False)])]
    found = sq.sections(spark.createDataFrame(lines, "d int, pos int, line string, h boolean"), "d", "pos", "h")
    assert [(r.heading_path, r.body) for r in sq.carry_parents(found, "d").orderBy("section").collect()] == [(["H1", "H2"], "text"), (["H3"], "more")]


def test_ingest_log_reads_whole_lines(spark, tmp_path):
    """A second line that begins with 1 keeps it: its date is dropped as one, and its 41 characters are no heading."""
    from glosswork.plans import sequences as plan

    texts = ["first line of it\n1999-01-02 some news of that day that was", "first line of it\n1" + "x" * 40, None]
    spark.createDataFrame([(i, t, "en", "s", 9) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, plan.ingest_log(spark, str(tmp_path)).collect())) == [(0, 2, 1, 1, 2), (1, 2, 0, 1, 2), (2, 0, 0, 0, 0)]


def test_rolling_within_rows_is_rolling(spark):
    """Cues that lie in their row's array give what cues in rows give, of any length, and nothing is shuffled."""
    rng = random.Random(3)
    docs = []
    for doc in range(40):
        cues = [[]]
        for _ in range(rng.randint(0, 12)):
            last, cut = cues[-1], rng.randint(0, 14)
            cues.append(rng.choice([last, [], last[cut:] + [rng.choice("ab") for _ in range(rng.randint(0, 14))], last[:cut], [rng.choice("ab") for _ in range(rng.randint(0, 5))]]))
        docs.append((doc, [(i, c) for i, c in enumerate(cues[1:])]))
    df = spark.createDataFrame(docs, "doc_id int, cues array<struct<cue: int, words: array<string>>>")
    got = sq.rolling_within(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    flat = spark.createDataFrame([(d, i, c) for d, cues in docs for i, c in cues], "doc_id int, cue int, words array<string>")
    want = sorted(((d, i, e) for d, cues in docs for (i, _), e in zip(cues, plain_rolling([c for _, c in cues]), strict=True)), key=str)
    left, right = (sorted(map(tuple, x.select("doc_id", "cue", "emitted", "kind").collect()), key=str) for x in (got, sq.rolling(flat)))
    assert left == right and sorted((r[:3] for r in left), key=str) == want
    assert {r[3] for r in left} == {"empty", "duplicate", "no_new", "overlap", "new"}


@pytest.mark.parametrize("name", ["rolling_dedup", "rolling_counts"])
def test_rolling_queries_shuffle_no_cues(spark, small, name):
    from glosswork.plans import sequences as plan

    text = plan.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and text.count("Exchange") == (name == "rolling_counts")
