"""Language model, toxicity and neighbours against plain versions and held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from glosswork.llm import ann, lm, queries
from glosswork.llm import toxicity as tox

LOWER = lambda t: (t or "").encode().translate(lm._LOWER).split() + [b"</s>"]


def plain_scores(rows):
    """{row: (base, score)} for rows (text, train), by exact expectation-maximisation over single events."""
    words = [(LOWER(t), train) for t, train in rows]
    c = Counter(w for ws, train in words if train for w in ws)
    pair = Counter(p for ws, train in words if train for p in zip([None, *ws], ws, strict=False))
    n, v, docs = sum(c.values()), len(c), sum(train for _, train in words)
    events = defaultdict(list)
    for ws, train in words:
        if train:
            for a, b in zip([None, *ws], ws, strict=False):
                c1 = (docs if a is None else c[a]) - 1
                events[int(math.log2(c1)) + 1 if c1 else 0].append(((pair[a, b] - 1) / c1 if c1 else 0, (c[b] - 1) / max(1, n - 1), 1 / (v + 1)))
    mixes = {}
    for k, e in events.items():
        e, m = np.array(e), np.full(3, 1 / 3)
        for _ in range(lm.EM_ROUNDS):
            q = e * m
            m = (q / q.sum(axis=1)[:, None]).sum(axis=0) + 1e-3
            m /= m.sum()
        mixes[k] = m
    out = []
    for ws, _ in words:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        out.append((base, mixes, c, pair, n, v, docs))
    return out


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 50]) for _ in range(rng.randint(0, 120))), bool(i % 7 != 2)) for i in range(150)]
    rows += [(150, None, True), (151, "", False), (152, " \n", True), (153, "new words only", False), (3, rows[3][1], True), (None, "w1 w2", True)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train boolean, score string")
    df.coalesce(2).write.parquet(f"{tmp_path}/c")
    return rows, spark.read.parquet(f"{tmp_path}/c")


def test_counts_and_base(spark, corpus):
    rows, df = corpus
    got = lm.score_documents(df, df["train"]).collect()
    assert len(got) == len(rows)
    c = Counter(w for _, t, train in rows if train for w in LOWER(t))
    n, v = sum(c.values()), len(c)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        ws = LOWER(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert -math.inf < r.score < 0


def test_scores_follow_exact_weights(corpus):
    rows, df = corpus
    got = {(r.doc_id, r.rid): r for r in lm.score_documents(df, df["train"]).collect()}
    _, mixes, c, pair, n, v, docs = plain_scores([(t, train) for _, t, train in rows])[0]
    texts = {i: t for i, t, _ in rows}
    for r in got.values():
        ws, want = LOWER(texts[r.doc_id]), 0.0
        for a, b in zip([None, *ws], ws, strict=False):
            c1 = docs if a is None else c[a]
            k = int(math.log2(c1)) + 1 if c1 else 0
            m = mixes[max(x for x in mixes if x <= k)].copy()  # a bucket without events takes the next smaller one's
            if not c1:
                m[0] = 0
                m /= m.sum()
            want += math.log10(m[0] * (pair[a, b] / c1 if c1 else 0) + m[1] * c[b] / n + m[2] / (v + 1))
        assert r.score == pytest.approx(want, rel=1e-3)


def test_small_estimates_keep_apart():
    p = 2.0 ** -np.arange(0, 60, 0.25)
    assert (np.diff(lm._bin(p)) == 2).all() and lm._bin(np.array([0.0]))[0] == 0 < lm._bin(p)[0]


def test_weights_of_a_corpus_of_any_size():
    """Estimates far below one in four thousand million weigh what they are, against a uniform one that is smaller still."""
    events = [(3, 1000, 0.0, 2.0**-40), (3, 1000, 0.0, 2.0**-44)]
    tallies = [((b << 2 * lm.BIN_BITS) | int(lm._bin(np.array([x]))[0]), n, y * n, x * n) for b, n, y, x in events]
    weights = lm.learn_weights(tallies, 2**50)
    assert weights[3, 1] > 0.99


def test_blocks_and_segments_change_nothing(corpus):
    _, df = corpus
    key = lambda r: (r.rid, r.n_tokens, r.n_known, round(r.score, 6))
    a = sorted(map(key, lm.score_documents(df, df["train"]).collect()))
    b = sorted(map(key, lm.score_documents(df, df["train"], block_tokens=70, segment_tokens=9).collect()))
    assert a == b


def test_no_training_rows_and_no_rows(spark, corpus):
    from pyspark.sql import functions as F

    _, df = corpus
    got = lm.score_documents(df, F.lit(None).cast("boolean")).collect()
    assert {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}
    assert lm.score_documents(df.where("false"), F.lit(True)).count() == 0


def test_model_beats_the_base_on_held_out_texts(spark, small):
    got = queries.QUERIES["op5_deleted_interpolation"](spark, small).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_gradient():
    m = tox.Model.start({b"bad": 1})
    for k in m.weights:
        m.weights[k] = m.weights[k].astype(np.float64)
    words, rows = [b"bad", b"the", b"abc"], np.full((2, tox.WINDOW), 3)
    rows[0, :5], rows[1, :2] = [0, 1, 2, 1, 0], [1, 2]
    y, cost = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = 1 / (1 + np.exp(-m.run(m.inputs(words)[0].astype(np.float64), rows)))
        return -np.mean(np.where(y > 0, np.log(p), np.log(1 - p)))

    for k, g in m.gradient(words, rows, y, cost).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        w, old = m.weights[k], m.weights[k][at]
        w[at] = old + 1e-3
        up = loss()
        w[at] = old - 1e-3
        down = loss()
        w[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-6)


def plain_logit(m, words):
    """The network read aloud: one window, one number at a time."""
    w, size = m.weights, tox.HIDDEN
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    inputs = []
    for word in words:
        marked = b"^" + word + b"$"
        codes = [((((marked[i] << 16) | (marked[i + 1] << 8) | marked[i + 2]) * 2654435761) % 2**32 >> 7) % tox.TRIGRAMS for i in range(len(word))]
        inputs.append([sum(float(w["char"][c][k]) for c in codes) / len(codes) + float(w["word"][m.vocabulary.get(word, 0)][k]) for k in range(tox.EMBED)])
    states = [[] for _ in words]
    for d, order in (("f", range(len(words))), ("b", reversed(range(len(words))))):
        h = [0.0] * size
        for t in order:
            given = [sum(x * float(w[f"x{d}"][i][j]) for i, x in enumerate(inputs[t])) + float(w[f"c{d}"][j]) for j in range(3 * size)]
            own = [sum(h[i] * float(w[f"h{d}"][i][j]) for i in range(size)) for j in range(3 * size)]
            reset = [sigmoid(given[j] + own[j]) for j in range(size)]
            stay = [sigmoid(given[size + j] + own[size + j]) for j in range(size)]
            new = [math.tanh(given[2 * size + j] + reset[j] * own[2 * size + j]) for j in range(size)]
            h = [stay[j] * h[j] + (1 - stay[j]) * new[j] for j in range(size)]
            states[t] += h
    look = [sum(math.tanh(sum(s[i] * float(w["a"][i][k]) for i in range(2 * size)) + float(w["ab"][k])) * float(w["v"][k]) for k in range(tox.ATTEND)) for s in states]
    share = [math.exp(x - max(look)) for x in look]
    return sum(share[t] / sum(share) * states[t][i] * float(w["o"][i]) for t in range(len(words)) for i in range(2 * size)) + float(w["ob"][0])


def test_network_equals_plain_loops():
    m, rng = tox.Model.start({b"bad": 1, b"the": 2}, seed=3), random.Random(1)
    m.weights["word"][:] = np.random.default_rng(5).standard_normal(m.weights["word"].shape)
    words = [b"bad", b"the", b"a", "é".encode(), b"longerword", b"x9"]
    for n in (1, 5, tox.WINDOW):
        text = [rng.choice(words) for _ in range(n)]
        assert m.logits([text])[0] == pytest.approx(plain_logit(m, text), abs=2e-4)
    text = [rng.choice(words) for _ in range(90)]
    starts = [*range(0, 90 - tox.WINDOW, tox.STRIDE), 90 - tox.WINDOW]
    assert m.logits([text])[0] == pytest.approx(max(plain_logit(m, text[i : i + tox.WINDOW]) for i in starts), abs=2e-4)


def test_segments_have_the_windows_of_the_whole():
    starts = lambda a, b: {a + i for i in [*range(0, max(1, b - a - tox.WINDOW), tox.STRIDE), max(0, b - a - tox.WINDOW)]}
    size = 4 * tox.STRIDE + tox.WINDOW - tox.STRIDE
    for n in [*range(0, 400), 1000]:
        cut = tox.segments(n, size)
        assert all(b - a <= size for a, b in cut)
        assert set().union(*(starts(a, b) for a, b in cut)) == starts(0, n)


def test_a_long_text_is_read_whole(model, monkeypatch):
    texts = ["c1 " * 700 + "vile scum vilest", "c2 " * 900, "vile scum " + "c1 " * 500]
    whole = model.score(texts)
    monkeypatch.setattr(tox, "segments", lambda n, cut=tox.segments: cut(n, 6 * tox.STRIDE + tox.WINDOW - tox.STRIDE))
    assert model.score(texts) == pytest.approx(whole, abs=1e-5)
    assert whole[0] > 0.5 > whole[1]


SOME = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not SOME.is_dir(), reason="no table with enough labels")
def test_toxic_documents_of_the_held_out_fold(spark):
    """Of held-out labelled documents, by the query itself. Some labels are wrong: what counts as toxic has a word that only toxic documents of the other folds have, and often."""
    texts = {r.doc_id: tox.words_of(r.text) for r in spark.read.parquet(f"{SOME}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SOME}/labels.parquet").collect() if r.doc_id in texts}
    got = {r.doc_id: r for r in queries.QUERIES["op6_toxicity"](spark, str(SOME)).collect()}
    seen = {t: Counter(w for d, x in labels.items() if x == t and not got[d].held_out for w in set(texts[d])) for t in (0, 1)}
    telling = {w for w, k in seen[1].items() if k >= 40 and seen[0][w] == 0}
    held = [(t, not telling.isdisjoint(texts[d]), got[d].predicted) for d, t in labels.items() if got[d].held_out]
    toxic, clean = [p for t, told, p in held if t == 1 and told], [p for t, _, p in held if t == 0]
    assert len(telling) >= 5 and len(toxic) > 30
    assert sum(toxic) >= 0.95 * len(toxic) and sum(clean) <= 0.03 * len(clean)
    # against the labels themselves, wrong ones and documents without a telling word included
    every = [p for t, _, p in held if t == 1]
    assert sum(every) >= 0.7 * len(every) and sum(every) >= 0.85 * (sum(every) + sum(clean))


def test_labels_of_any_key(spark):
    docs = spark.createDataFrame([(str(i), f"text {i}") for i in range(40)] + [("3", "again"), (None, "x"), ("50", None)], "doc_id string, text string")
    labels = spark.createDataFrame([(str(i), i % 2) for i in range(60)] + [(None, 1), ("1", None), ("2", 1)], "doc_id string, toxic int")
    texts, toxic = tox.training_sample(docs, labels)
    known = {str(i): int(i % 2 or i == 2) for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    assert len(texts) == len(known) and toxic.sum() == sum(known.values())
    assert tox.training_sample(docs.where("false"), labels)[0] == tox.training_sample(docs, labels.where("false"))[0] == []


def toxic_texts(rows):
    """Texts of which every third holds a word of its own class."""
    rng = random.Random(8)
    words = [" ".join(rng.choice(["c1", "c2", "c3", "c4", "c5"]) for _ in range(rng.randint(5, 70))) for _ in range(rows)]
    return [(i, w + (" vile scum " + w if i % 3 == 0 else "")) for i, w in enumerate(words)]


@pytest.mark.parametrize("several", [False, True])
def test_every_label_trains(spark, monkeypatch, several):
    """What a bound on documents or characters would leave out decides: long texts, and more documents than a sample of three of each class."""
    monkeypatch.setattr(tox, "TOXIC_DOCS", 3)
    monkeypatch.setattr(tox, "CLEAN_DOCS", 3)
    monkeypatch.setattr(tox, "TRAIN_CHARS", 10)
    if several:  # blocks, and a join by shuffle
        monkeypatch.setattr(tox, "BLOCK_WINDOWS", 400)
        monkeypatch.setattr(tox, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(tox, "LEAST_STEPS", 0)
    rows = toxic_texts(1500)
    docs = spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(9_000, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = tox.learn(docs, labels)
    score = model.score([t for _, t in rows])
    held = [(i % 3 == 0, p >= 0.5) for (i, _), p in zip(rows, score, strict=True) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_pipeline_learns_from_every_label(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp

    monkeypatch.setattr(tox, "TRAIN_CHARS", 10)
    rows = toxic_texts(600)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r.doc_id for r in cp.drop_toxic(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    assert len(left ^ {i for i, _ in rows if i % 3}) <= 0.05 * len(rows)


def test_pipeline_learns_from_the_fold_that_op6_holds_out(spark, tmp_path):
    """Only that fold has labels here, so a model that left it out would know nothing and drop nothing."""
    import corpus_pipeline as cp

    rows = toxic_texts(1500)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    known = [(i, int(i % 3 == 0)) for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    spark.createDataFrame(known, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r.doc_id for r in cp.drop_toxic(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    assert len(left ^ {i for i, _ in rows if i % 3}) <= 0.05 * len(rows)


def test_labelled_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(3, "again"), (None, "x"), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (1, None), (2, 1), (7, 5)], "doc_id long, toxic int")
    known = {i: int(i % 2 or i == 2) for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    wanted = sorted((t or "", known[i]) for i, t in [(r.doc_id, r.text) for r in docs.collect()] if i in known)
    for most in (tox.BROADCAST_BYTES, 0):
        monkeypatch.setattr(tox, "BROADCAST_BYTES", most)
        assert sorted((r.text or "", r.toxic) for r in tox.labelled(docs, labels).collect()) == wanted
    texts = docs.select("doc_id", "text")
    assert {r.doc_id for r in tox.marked(texts, labels.select("doc_id").where("doc_id < 5")).collect()} == set(range(5))
    assert tox.learn(docs.where("false"), labels).score(["x"])[0] < 0.5


def test_trigrams_stay_inside_words():
    code, begin = tox.trigrams([b"abc", b"d"])
    assert begin.tolist() == [0, 3] and len(code) == 4
    assert tox.trigrams([b"d"])[0].tolist() == code[3:].tolist()
    assert tox.trigrams([b"abc"])[0].tolist() == code[:3].tolist()


def test_windows_cover_every_word():
    docs = [[], [b"a"] * 5, [str(i).encode() for i in range(100)]]
    words, rows, first = tox.windows(docs)
    seen = {words[j] for j in rows[first[2] :].reshape(-1) if j < len(words)}
    assert seen == set(docs[2]) and len(rows) - first[2] == -(-(100 - tox.WINDOW) // tox.STRIDE) + 1
    assert (rows[0] == len(words)).all()


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    clean = [f"c{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(900):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 90))]
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "vileness", "vilest", "scum"]))
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    return tox.train(texts, np.array(labels))


def test_toxic_words_are_found_anywhere(model):
    clean = " ".join(["c1 c2 c3"] * 400)
    at_end = clean + " vile scum vilest"
    score = model.score([clean, at_end, "vile scum vilest " + clean, None, "", " "])
    assert score[0] < 0.5 and score[1] > 0.5 and score[2] > 0.5
    assert (score[3:] < 0.5).all() and score[3] == score[4] == score[5]


def test_scoring_keeps_rows(spark, model):
    df = spark.createDataFrame([(1, "vile scum", "a"), (1, "vile scum", "a"), (2, None, "b"), (None, "c1 c2", "c")], "doc_id long, text string, score string")
    got = tox.score_documents(df, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    stay = tox.keep_clean(df, model)
    assert stay.columns == df.columns and sorted(r.score for r in stay.collect()) == ["b", "c"]
    assert tox.score_documents(df.where("false"), model).count() == 0


def test_one_class_or_none():
    assert tox.train([], np.array([])).score(["x", None]).max() < 0.5
    assert tox.train(["a", "b"], np.array([1, 1])).score(["x"])[0] > 0.5


def test_toxicity_query(spark, small):
    got = queries.QUERIES["op6_toxicity"](spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def brute(rows, queries_, k):
    out = {}
    for q, v in queries_:
        s = sorted((-float(np.dot(np.array(v, np.float32).astype(float), np.array(x, np.float32).astype(float))), i) for i, x in rows if i != q)
        out[q] = [(i, -d) for d, i in s[:k]]
    return out


def test_search_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    good += [(200 + i, good[7][1]) for i in range(60)]
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (905, []), (906, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + odd], "vec_id long, embedding array<float>, score string").repartition(3)
    asked = [r for r in good + odd if r[0] % 20 == 0]
    got = defaultdict(list)
    for r in ann.search(ann.build_index(df, least_shards=3), df.where("vec_id % 20 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute(good, [a for a in asked if a[0] < 900], 20)
    assert set(got) == set(want)
    for q, w in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert len({m[1] for m in mine} & {i for i, _ in w}) >= 18
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)


def test_scores_come_from_the_vectors_as_they_came(spark):
    """Doubles that differ beyond a float's precision."""
    rows = [(i, [1.0 + i * 1e-12, 0.5]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(ann.build_index(df, least_shards=2), df.where("vec_id % 20 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q, v in ((q, dict(rows)[q]) for q in (0, 20)):
        want = sorted(((-(np.array(v) @ np.array(x)), i) for i, x in rows if i != q))[:20]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, pytest.approx(-s, rel=1e-15)) for s, i in want]


def test_more_neighbours_than_the_index_keeps(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="keeps 21"):
        ann.search(ann.build_index(df), df, k=21)
    assert ann.search(ann.build_index(df, keep=41), df.where("vec_id = 0"), k=40).count() == 40


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0]), (5, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(ann.build_index(df), df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 5, 3.0), (0, 2, 20, 0.0), (20, 1, 5, 2.0), (20, 2, 0, 0.0)]
    none = df.where("false")
    assert ann.search(ann.build_index(none), none).count() == 0


def test_recall_of_the_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = defaultdict(set)
    for r in queries.QUERIES["op9_pruned_graph_search"](spark, small).collect():
        got[r.query_id].add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.95 * sum(len(w) for w in want.values())
