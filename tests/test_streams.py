"""Streams cut into many batches, with late rows, against the table of all rows."""

import random
from datetime import datetime, timedelta

import pytest

from glosswork.operators import sequence as sq
from glosswork.streaming import batches as st

START = datetime(2024, 1, 1)


def feed(spark, folder, rows, schema, files):
    """One file for each batch, in order of their numbers."""
    for n, part in enumerate(files):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{folder}/in-{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")


def drain(stream, folder, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(240)
        assert not query.exception()
    finally:
        query.stop()
    return query


def test_rolling_captions_over_batches(spark, tmp_path):
    rng, rows = random.Random(8), []
    for doc in ("a", "b", None):
        flow = [rng.choice("rstuv") for _ in range(60)]
        rows += [(doc, i, START + timedelta(seconds=10 * i), flow[i : i + rng.randint(0, 4)]) for i in range(30)]
    rows[3] = (*rows[3][:3], None)
    # each row comes up to fifty seconds after its time, so batches overlap in time
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] * 10 + rng.randint(0, 50))
    files = [order[i : i + 12] for i in range(0, len(order), 12)]
    rows.append(("end", 0, START + timedelta(days=1), ["x"]))  # a late time lets all others go
    files.append([len(rows) - 1])
    schema = "doc_id string, cue long, at timestamp, words array<string>"
    stream = st.rolling_captions(feed(spark, tmp_path, rows, schema, files), late="1 minute")
    drain(stream, tmp_path, "append", "rolled")
    got = sorted(map(tuple, spark.table("rolled").collect()), key=str)
    table = spark.createDataFrame([(*r[:3], r[3] or []) for r in rows[:-1]], schema)
    assert got == sorted(map(tuple, sq.rolling(table).select("doc_id", "cue", "kind", "emitted").collect()), key=str)
    assert {r[2] for r in got} >= {"empty", "overlap", "new"}


@pytest.mark.parametrize("size", [3, 50])
def test_last_of_key_over_batches(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(rng.choice("abc"), rng.randint(0, 5), i) for i in range(50)]
    files = [list(range(i, min(50, i + size))) for i in range(0, 50, size)][-6:]
    used = [rows[i] for part in files for i in part]
    stream = st.last_of_key(feed(spark, tmp_path, rows, "k string, t long, v long", files), ["k"], ["t"])
    drain(stream, tmp_path, "complete", f"last{size}")
    assert sorted(map(tuple, spark.table(f"last{size}").collect())) == sorted(max((r for r in used if r[0] == k), key=lambda r: r[1:]) for k in {r[0] for r in used})
