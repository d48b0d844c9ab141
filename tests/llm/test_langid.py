"""Labels against a plain Viterbi, held-out accuracy, mixed texts, scripts."""

import random
import zlib

import numpy as np
import pytest

from glosswork.llm import langid as li
from glosswork.llm import queries


def plain_viterbi(scores, switch):
    """Best path over one text's rows of scores, in double precision."""
    n, m = scores.shape
    value, back = scores[0].astype(float), []
    for t in range(1, n):
        leader = int(np.argmax(value))
        came = [k if value[k] >= value[leader] - switch else leader for k in range(m)]
        value = np.array([max(value[k], value[leader] - switch) + scores[t, k] for k in range(m)])
        back.append(came)
    path = [int(np.argmax(value))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_paths_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(13)
    for langs in (1, 2, 4):
        scores = (rng.integers(-20, 1, (50, langs)) / 2).astype(np.float32)
        sizes = rng.integers(0, 40, 60)
        ids = rng.integers(0, 50, sizes.sum())
        got, at = li.viterbi(ids, sizes, scores, 6.0), 0
        for n in sizes.tolist():
            if n:
                assert got[at : at + n].tolist() == plain_viterbi(scores[ids[at : at + n]], 6.0)
            at += n
    assert li.viterbi(np.zeros(0, np.int64), np.zeros(0, np.int64), scores).tolist() == []


def test_features():
    grams, begin, script = li.features(["ab", "я", "ab"], 1 << 16)
    assert len(grams) == 2 + 1 + 2 and begin.tolist() == [0, 2, 3]
    assert grams[:2].tolist() == grams[3:].tolist()
    assert [li.SCRIPTS[k][0] for k in script] == ["latin", "cyrillic", "latin"]
    assert li.scripts_of(np.array([0x20, 0x2C00, 0x4E2D])).tolist() == [len(li.SCRIPTS), len(li.SCRIPTS), [s[0] for s in li.SCRIPTS].index("han")]
    assert all(a[2] < b[1] for a, b in zip(li.SCRIPTS, li.SCRIPTS[1:], strict=False))


@pytest.fixture(scope="module")
def model(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return li.train(docs.where(~li.held_out()))


def test_query_on_the_held_out_fold(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text").collect()
    got = {r[0]: r for r in queries.QUERIES["op13_viterbi_language"](spark, small).collect()}
    assert sorted(got) == sorted(r[0] for r in docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    with_letters = [r for r in docs if any(c.isalpha() for c in r["text"] or "")]
    assert all(got[r[0]]["lang_pred"] == li.UNDETERMINED for r in docs if r not in with_letters)
    held = [r for r in with_letters if got[r[0]]["held_out"]]
    assert len(held) > 20
    assert sum(got[r[0]]["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.97


def test_labels_are_learned_from_other_rows_only(spark, small):
    """Other languages, sources or ids of held-out rows change no prediction."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(li.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (li.train(d.where(~li.held_out())) for d in (docs, changed))
    assert a.languages == b.languages and (a.logs == b.logs).all()


def test_mixed_texts(spark, small, model):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 400")
    some = {r["lang"]: r["text"] for r in docs.select("lang", "text").collect()}
    rng, rows, want = random.Random(3), [], []
    names = sorted(some)
    for i in range(30):
        x, y = rng.sample(names, 2)
        left, right = some[x][:250].rsplit(" ", 1)[0], some[y][150:400].split(" ", 1)[1]
        rows.append((i, f"{left} 12, {right}"))
        want.append((x, y, len(left)))
    got = li.spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    hits = 0
    for i, (x, y, cut) in enumerate(want):
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["span"])
        assert [r["span"] for r in mine] == list(range(len(mine)))
        assert all(a["end"] <= b["start"] for a, b in zip(mine, mine[1:], strict=False))
        hits += [r["lang"] for r in mine] == [x, y] and abs(mine[0]["end"] - cut) < 40
    assert hits >= 24


def test_scripts_narrow_candidates(spark):
    rows = [(i, lang, text) for i in range(8) for lang, text in (("ru", "привет как дела мир"), ("bg", "здравей как си свят"), ("en", "hello how are you world"), ("el", "γεια σου κόσμε"))]
    m = li.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert m.languages == ["bg", "el", "en", "ru"]
    scores = m.scores(["привет", "hello", "κόσμε", "שלום"])
    assert (scores > -1e5).tolist() == [[True, False, False, True], [False, False, True, False], [False, True, False, False], [True] * 4]
    texts = [(1, "привет мир"), (2, "hello"), (3, "שלום"), (4, "привет как дела hello how are you world hello how are you")]
    got = dict((r[0], r[1]) for r in li.identify(spark.createDataFrame(texts, "doc_id long, text string"), m).collect())
    assert (got[1], got[2], got[4]) == ("ru", "en", "en") and got[3] in m.languages


def test_odd_rows(spark, model):
    rows = [(None, None), ("a", ""), ("b", " 123 ?! \n"), ("c", "the"), ("c", "the"), ("d", "the and " * 30_000), ("e", "́ ²"), ("f", "İ İ the")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "key string, body string, doc_id int, lang_pred string")
    got = sorted(map(tuple, li.identify(df, model, "key", "body").collect()), key=str)
    assert [r[0] for r in got].count("c") == 2 and len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[None] == by["a"] == by["b"] == by["e"] == (li.UNDETERMINED, 0.0)
    assert by["d"][0] == "en" and by["c"][0] in model.languages
    assert li.spans(df, model, "key", "body").where("doc_id = 'f'").agg({"end": "max"}).first()[0] == 7
    assert li.identify(df.limit(0), model, "key", "body").count() == 0
    nothing = li.train(spark.createDataFrame([(1, None, "x"), (2, "en", None)], "doc_id long, lang string, text string"))
    assert nothing.languages == []
    assert {r[1] for r in li.identify(df, nothing, "key", "body").collect()} == {li.UNDETERMINED}
    assert li.spans(df, nothing, "key", "body").count() == 0


def test_many_languages_shrink_the_table(spark, monkeypatch):
    rows = [(i, f"l{i}", f"word{i} " * 3) for i in range(5)]
    monkeypatch.setattr(li, "MODEL_BYTES", 5 * 4 * 2048)
    assert li.train(spark.createDataFrame(rows, "doc_id long, lang string, text string")).logs.shape == (2048, 5)


def test_sample_is_bounded(spark):
    rows = [(i, "en", f"common{'abcdefghij'[i % 10]}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    few = li.train(df, per_language=5)
    assert np.isfinite(few.logs).all()
    assert (np.exp(few.logs) > 1.5 * np.exp(few.logs).min()).sum() <= 5 * 9
