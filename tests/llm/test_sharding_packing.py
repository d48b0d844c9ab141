"""The permutation, shards and windows."""

import zlib
from collections import Counter

import numpy as np
import oracle
import pytest

from glosswork.llm import packing as pk
from glosswork.llm import queries
from glosswork.llm import sharding as sd
from glosswork.llm import vocab

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    places = sd.permute(np.arange(n), n, 3)
    assert sorted(places.tolist()) == list(range(n))
    assert sd.unpermute(places, n, 3).tolist() == list(range(n))
    assert n < 17 or places.tolist() != sd.permute(np.arange(n), n, 4).tolist()
    for row in range(0, n, max(1, n // 7)):
        assert sd.row_at(*sd.locate(row, n, 4, 3), n, 4, 3) == row


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 65_537, (1 << 40) + 3, 1 << 61])
def test_spark_permutes_like_numpy(spark, n):
    rows = sorted({*range(min(n, 500)), *(n - 1 - i for i in range(min(n, 500)))})
    df = spark.createDataFrame([(i,) for i in rows], "row long")
    got = {r.row: r.place for r in df.select("row", sd.permuted("row", n, 3).alias("place")).collect()}
    assert [got[i] for i in rows] == sd.permute(np.array(rows), n, 3).tolist()
    assert sd.unpermute(np.array([got[i] for i in rows]), n, 3).tolist() == rows


def test_more_rows_than_the_network_holds():
    with pytest.raises(ValueError, match="more rows"):
        sd.permute(np.arange(2), 1 << 62)


def test_sharding_query_equals_sql(spark, small):
    assert oracle.compare(spark, oracle.connect(small), small, queries.QUERIES["op8_feistel_sharding"], queries.ORACLES["op8_feistel_sharding"]) == ""


def test_shards(spark):
    rows = [(None, "a", 9), (2, None, 9), (2, None, 9), (2, None, 9), *[(i, "t", 9) for i in range(40)]]
    df = spark.createDataFrame(rows, "doc_id int, text string, SLOT int").repartition(5)
    got = sd.shard_rows(df, ["doc_id", "text"], 4, 1).collect()
    assert len(got) == len(rows)
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in sizes.items())
    assert all((r.shard, r.slot) == sd.locate(r.row_number, len(rows), 4, 1) for r in got)
    again = sd.shard_rows(df.repartition(2), ["doc_id", "text"], 4, 1).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)
    assert sd.shard_rows(df.where("false"), ["doc_id"], 4, 1).count() == 0


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id int, text string")
    sd.write_shards(sd.shard_rows(df, ["doc_id"], 3, 2), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().count() == 3


def test_sharding_query(spark, small):
    got = queries.QUERIES["op8_feistel_sharding"](spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    order = sorted(texts)
    assert all((r.shard, r.slot) == sd.locate(order.index(r.doc_id), len(order)) for r in got)


def plain_level(counts, size, window, cut):
    """The level whose filling leaves the least sum of squares, worked out from whole sums."""
    choices = []
    for level in [0, *[h for h in range(1, window) if counts[h]]]:
        after, passes = list(counts), level + size > window
        if level:
            after[level] -= 1
        left = level + size - window if passes else level + size
        if left < window:
            after[left] += 1
        choices.append((sum(c * c for c in after) + cut * passes, passes, -level))
    return -min(choices)[2]


def test_levels_follow_the_sum_of_squares():
    rng = np.random.default_rng(1)
    for cut in (0, 3, 8):
        p = pk.Packer(window=32, cut=cut)
        for i in range(300):
            size = int(rng.integers(1, 32))
            assert p.level_for(size) == plain_level(p.count.tolist(), size, 32, cut)
            p.add(i, np.zeros(size, "<u4"))


@pytest.mark.parametrize("cut", [8, 0])
def test_packer_places_each_id_once(cut):
    rng = np.random.default_rng(cut)
    p = pk.Packer(window=64, cut=cut)
    sizes = [int(x) for x in rng.integers(1, 200, 300)] + [40] * 500 + [33] * 500
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype="<u4"))
        assert p.n_open == p.count.sum() <= 63 * (cut // 2 + 2)
    p.finish()
    rows = p.take()
    for i, n in enumerate(sizes):
        own = sorted((r for r in rows if r[0] == i), key=lambda r: r[1])
        assert np.concatenate([r[2] for r in own]).tolist() == list(range(n))
    filled = Counter()
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        assert r[5] == filled[r[4]]
        filled[r[4]] += len(r[2])
    assert sum(v != 64 for v in filled.values()) <= 1
    assert max(filled.values()) <= 64


def test_padding():
    assert [pk.padding(n) for n in (1024, 512, 1, 1000, 700)] == [0, 0, 0, 24, 324]


def test_pack_odd_rows(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "<|endoftext|> a", "x"), (4, "word " * 3000, "x"), (None, "é\x00日本", "x"), (5, " " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = pk.pack(df.coalesce(1), TOKENIZER).collect()
    for key in {r[0] for r in rows}:
        texts = [r[1] or "" for r in rows if r[0] == key]
        want = t.encode(texts[0], add_special_tokens=False).ids + [pk.END]
        own = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(want) * len(texts)
        if len(texts) == 1:
            assert [x for r in own for x in r.ids] == want
            assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want) for r in own)
    assert pk.pack(df.where("false"), TOKENIZER).count() == 0


def test_same_ids_as_the_library(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    data = open(TOKENIZER, "rb").read()
    for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect():
        assert vocab.encode_like_tokenizers(data, r.text) == t.encode(r.text, add_special_tokens=False).ids


def test_a_text_the_matcher_gives_up_on_goes_to_the_library(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    data, text = open(TOKENIZER, "rb").read(), "a b"

    class Broken:
        def __init__(self, error):
            self.error = error

        def encode_ordinary(self, text):
            raise self.error

    panic = type("PanicException", (BaseException,), {"__module__": "pyo3_runtime"})
    monkeypatch.setattr(vocab, "encoding", lambda *a: Broken(panic("stack")))
    assert vocab.encode_like_tokenizers(data, text) == tokenizers.Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    for other in (ValueError("x"), KeyboardInterrupt(), GeneratorExit()):
        monkeypatch.setattr(vocab, "encoding", lambda *a, e=other: Broken(e))
        with pytest.raises(type(other)):
            vocab.encode_like_tokenizers(data, text)


def test_packing_query(spark, small):
    got = queries.QUERIES["op2_sum_of_squares_packing"](spark, small).collect()
    tokens = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(tokens.values())
    filled = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert sum(v != 1024 for v in filled.values()) <= 8
