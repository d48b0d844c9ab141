"""The pipeline's stages, each on what its predecessor kept."""

import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from glosswork.llm.simhash import shingle_hashes, tokens_of


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    out = [spark.read.parquet(f"{small}/documents.parquet")]
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], small).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_documents_keep_their_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    counts = [df.count() for df in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_toxic_documents_go(spark, small, stages):
    toxic = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1").collect()}
    left = {r.doc_id for r in stages[1].collect()}
    before = {r.doc_id for r in stages[0].collect()}
    clean = before - toxic
    assert len(clean & left) >= 0.9 * len(clean)
    # of documents labelled toxic, held-out ones and wrong labels included: 6 of 11 in this table, where 4 have none of the words that mark the others
    assert len(toxic & before) >= 5 and len((toxic & before) - left) >= 0.5 * len(toxic & before)


def test_no_copies_are_left(stages):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    before, after = stages[1].collect(), stages[2].collect()
    first = {}
    for r in before:
        first[norm(r.text)] = min(r.doc_id, first.get(norm(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(first.values())


def test_similar_documents_go(stages):
    sets = {r.doc_id: set(shingle_hashes(*tokens_of((r.text or "").encode()), 5).tolist()) for r in stages[2].collect()}
    left = {r.doc_id for r in stages[3].collect()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for gone in set(sets) - left:
        assert any(near(gone, other) for other in sets if other != gone)
    missed = [(a, b) for a in left for b in left if a < b and sets[a] and near(a, b)]
    assert missed == []


def test_all_that_stays_is_packed(stages):
    rows = stages[4].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[3].collect()}
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == tokens


def test_pieces_hold_their_ids(stages):
    """The ids of each document, in order, are those of the tokenizers library and the end."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = {}
    for r in stages[4].collect():
        parts.setdefault(r.doc_id, []).append((r.start, r.length, r.ids))
    for d in stages[3].collect():
        held = sorted(parts[d.doc_id])
        assert all(n == len(ids) for _, n, ids in held)
        assert [i for _, _, ids in held for i in ids] == [*library.encode(d.text or "", add_special_tokens=False).ids, 0]


def test_run_equals_the_stages(spark, small, stages):
    key = lambda df: sorted((r.doc_id, r.doc_tokens, r.start == 0) for r in df.where("start = 0").collect())
    assert key(cp.run(spark, small)) == key(stages[4])


def test_stages_on_odd_rows(spark, small, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and columns named like the operators' own."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "rid", "_rid", "component", "score", "norm", "part", "probe", "node", "u", "key"]
    long = "word " * 40_000
    rows = [(1, None), (2, ""), (2, ""), (3, " \n"), (None, "only text"), (4, long), (5, long + "end"), (6, "a b c d e f"), (7, "A  b c d e f"), (None, None)]
    df = spark.createDataFrame([(i, t, None, "s", None, *[str(k)] * 10) for k, (i, t) in enumerate(rows)], ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    for empty in (False, True):
        docs = df.where("false") if empty else df
        docs.write.parquet(f"{tmp_path}/{empty}/0")
        docs = spark.read.parquet(f"{tmp_path}/{empty}/0")
        for i, (_, stage) in enumerate(cp.STAGES, 1):
            stage(spark, docs, small).write.parquet(f"{tmp_path}/{empty}/{i}")
            kept, docs = docs, spark.read.schema(docs.schema).parquet(f"{tmp_path}/{empty}/{i}") if i < len(cp.STAGES) else spark.read.parquet(f"{tmp_path}/{empty}/{i}")
            if i < len(cp.STAGES):
                assert docs.columns == names and docs.count() <= kept.count()
        if empty:
            assert docs.count() == 0
        else:
            left = sorted(((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()), key=str)
            assert [x[1] for x in left] == [1, 4, 5, 6, None]
            assert docs.select("doc_id").distinct().count() == 5
