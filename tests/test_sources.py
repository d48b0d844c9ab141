"""Files in and out, captions, paged services and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.operators import sequence as sq
from glosswork.sources import files
from glosswork.streaming import batches

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "t": "a"}\n\n{"id": 2, "t": null, "more": 3}\n')
    assert sorted(r.id for r in files.read_jsonl(spark, str(p), SCHEMA).collect()) == [1, 2]
    p.write_text('{"id": 1}\n[broken\n')
    with pytest.raises(ValueError, match="not a record"):
        files.read_jsonl(spark, str(p), SCHEMA)
    assert files.read_jsonl(spark, str(p), SCHEMA, strict=False).count() == 1


def test_csv_with_mark(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("﻿video_id,title\na,\"x, \"\"y\"\"\nz\"\n".encode())
    assert [tuple(r) for r in files.read_csv(spark, str(p), ["video_id"]).collect()] == [("a", 'x, "y"\nz')]
    with pytest.raises(ValueError, match="missing"):
        files.read_csv(spark, str(p), ["other"])


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    files.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(tuple(r)[:2] for r in files.read_jsonl(spark, f"{tmp_path}/j", SCHEMA).select("id", "t").collect()) == [(1, "a"), (2, None)]
    files.write_csv(df.withColumn("x", F.lit(1)), f"{tmp_path}/c", ["id"])
    assert files.read_csv(spark, f"{tmp_path}/c", ["id"]).columns == ["id"]
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfid") for p in (tmp_path / "c").glob("part-*"))


def test_tsv(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("a\t1\n\nb\tx\n")
    assert [tuple(r) for r in files.read_tsv(spark, str(p), "k string, n int").collect()] == [("a", 1), ("b", None)]
    p.write_text("a\t1\t2\n")
    with pytest.raises(ValueError, match="3 fields"):
        files.read_tsv(spark, str(p), "k string, n int")


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": 1,\n "queries": [{"id": 1, "q": "x\\ny"}, {"id": 2}]}')
    assert sorted(tuple(r)[1:] for r in files.read_records(spark, str(tmp_path), "queries", "id long, q string").collect()) == [(1, "x\ny"), (2, None)]
    (tmp_path / "b.json").write_text('{"answers": []}')
    with pytest.raises(ValueError, match="no array"):
        files.read_records(spark, str(tmp_path), "queries", "id long, q string")


def test_documents_have_no_timeline(spark):
    df = spark.createDataFrame([(1, 2)], "id int, START_MS int")
    with pytest.raises(ValueError, match="start_ms"):
        files.forbid_columns(df, ["start_ms"])
    assert files.forbid_columns(df, ["end_ms"]) is df


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "one", "text": ""}\n{"url": "u", "body": "B"}\nbroken\n{"content": "C"}\n')
    (tmp_path / "b.json").write_text('[{"id": 7, "text": "T"}]')
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.png").write_text("no")
    got = {(r.doc_id, r.text) for r in files.read_mixed(spark, str(tmp_path)).collect()}
    assert got == {("u", "B"), ("a#3", "C"), ("7", "T"), ("c#0", "plain")}


def test_captions(spark):
    text = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000 align:start\n<c>one</c> two\nthree\n\n00:03.000 --> 00:04.500\n\n00:00:05.000 --> 00:00:06.000\nfour\n"
    got = files.parse_captions(spark.createDataFrame([("v", text)], "id string, text string")).orderBy("cue_index").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(1000, 2000, "one two three"), (3000, 4500, ""), (5000, 6000, "four")]


def test_overwrite_guard(spark):
    rows = spark.createDataFrame([("a", ""), ("b", "kept")], "q string, answer string")
    with pytest.raises(ValueError, match="b"):
        files.refuse_overwrite(rows, "q", "answer")
    files.refuse_overwrite(rows.where("q = 'a'"), "q", "answer")


def test_paged(spark, tmp_path):
    def fetch(page):
        (tmp_path / str(page)).touch()
        return [(page * 2 + i, f"p{page}") for i in range(2)] if page != 3 else []

    got = files.paged(spark, 50, fetch, "id long, name string", wave=4)
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"p{i // 2}") for i in range(6)]
    assert sorted(int(p.name) for p in tmp_path.iterdir()) == [0, 1, 2, 3]
    assert files.paged(spark, 0, fetch, "id long, name string").count() == 0


def test_pdf_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one\n\n two \fthree")
    (tmp_path / "in" / "b.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"not read")
    got = files.read_pdf(spark, str(tmp_path), lambda content: content.decode().split("\f"))
    assert sorted((r.file.rsplit("/", 1)[1], r.page, r.line_number, r.line) for r in got.collect()) == [("a.pdf", 1, 1, "one"), ("a.pdf", 1, 3, "two"), ("a.pdf", 2, 1, "three")]
    with pytest.raises(Exception, match=r"(a|b)\.pdf: not readable"):
        files.read_pdf(spark, str(tmp_path), lambda content: content.decode()[99].split()).collect()


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    cues = spark.createDataFrame([(d, i, w.split()) for d in (1, 2) for i, w in enumerate(("A", "A B", "B C", ""))], "doc_id int, cue int, words array<string>")
    cues.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(cues.schema).parquet(f"{tmp_path}/in")
    query = batches.each_batch(stream, sq.rolling, f"{tmp_path}/out", f"{tmp_path}/mark")
    query.awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "cue", "emitted")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, sq.rolling(cues).select("doc_id", "cue", "emitted").collect()), key=str)


def test_first_of_key_in_a_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:{s:02d}") for k, s in ((1, 1), (1, 2), (2, 3), (1, 4), (3, 5))]
    table = spark.createDataFrame(rows, "k int, at string").select("k", F.col("at").cast("timestamp").alias("at"))
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = batches.first_of_key(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), ["k"], "at", "1 hour")
    batches.each_batch(stream, lambda df: df, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
