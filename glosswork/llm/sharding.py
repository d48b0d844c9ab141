"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in a total order, the number is permuted by a keyed
Feistel network with cycle walking, and the permuted number gives shard and
slot by division. Anyone who knows n and the seed computes where a row went
(``locate``) and which row lies in a place (``row_at``) without any table. The same network
is written for Spark (``permuted``), as plain long arithmetic, and for numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import fresh, materialise, table

ROUNDS = 6
SHARDS = 16
SEED = 20
#: A prime below 2^31 and two factors: products of residues fit a signed 64-bit integer.
PRIME, FACTORS = 2_147_483_647, (1_103_515_245, 1_402_024_253)
#: Steps of a walk that are tried before and after the first look; a step ends outside with a chance of less than one half.
WALK = (6, 122)


def _keys(seed: int) -> list[int]:
    return [((seed + 1) * 1_000_003 + (r + 1) * 15_485_863) * 48_271 % PRIME for r in range(ROUNDS)]


def _halves(n: int) -> tuple[int, int]:
    """Bits of the left and the right half: together the fewest that hold n values."""
    bits = max(2, (max(n, 2) - 1).bit_length())
    if bits > 61:
        raise ValueError("more rows than the network permutes")
    return bits // 2, bits - bits // 2


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A number below 2^31 from one below 2^31, by round and seed."""
    x = (x * FACTORS[0] + key) % PRIME
    x = ((x ^ (x >> 13)) * FACTORS[1] + key) % PRIME
    return x ^ (x >> 16)


def _walk(rows: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    """Rounds in turn change the left half by the right one and the right half by the left one, so halves may differ in width."""
    (a, b), keys = _halves(n), list(enumerate(_keys(seed)))
    out = np.array(rows, np.int64)
    todo = np.arange(len(out))
    while len(todo):  # a value that falls outside 0..n-1 is permuted again
        left, right = out[todo] >> b, out[todo] & ((1 << b) - 1)
        for r, key in reversed(keys) if back else keys:
            if r % 2:
                right = right ^ (_mix(left, key) & ((1 << b) - 1))
            else:
                left = left ^ (_mix(right, key) & ((1 << a) - 1))
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n]
    return out


def permute(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Place of each row number below n in the shuffled order."""
    return _walk(rows, n, seed, back=False)


def unpermute(places: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Row number at each place of the shuffled order."""
    return _walk(places, n, seed, back=True)


def permuted(row: str, n: int, seed: int = SEED) -> Column:
    """``permute`` of a column of row numbers as Spark expressions, which stay in the JVM."""
    a, b = _halves(n)
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    mixed = lambda x, key: let(f"({x} * {FACTORS[0]}L + {key}) % {PRIME}L", "u", let(f"((u ^ shiftright(u, 13)) * {FACTORS[1]}L + {key}) % {PRIME}L", "w", "w ^ shiftright(w, 16)"))
    keys = _keys(seed)
    pairs = ", ".join(f"named_struct('a', {x}L, 'b', {y}L)" for x, y in zip(keys[::2], keys[1::2], strict=True))
    two = let(f"s.l ^ ({mixed('s.r', 'k.a')} & {(1 << a) - 1}L)", "v", f"named_struct('l', v, 'r', s.r ^ ({mixed('v', 'k.b')} & {(1 << b) - 1}L))")  # both rounds of a pair of keys
    once = lambda x: f"aggregate(array({pairs}), named_struct('l', shiftright({x}, {b}), 'r', {x} & {(1 << b) - 1}L), (s, k) -> {two}, s -> shiftleft(s.l, {b}) | s.r)"
    walk = lambda start, times: f"aggregate(array_repeat(0, {times}), {start}, (x, i) -> if(x < {n}L, x, {once('x')}))"
    at = let(walk(once(f"`{row}`"), WALK[0]), "y", f"if(y < {n}L, y, {walk('y', WALK[1])})")
    return F.expr(let(at, "z", f"if(z < {n}L, z, raise_error('a walk did not come back'))"))


def permuted_sql(row: str, n: str, left: str, right: str, steps: int = 64, seed: int = SEED) -> str:
    """``permute`` as DuckDB SQL; ``left`` and ``right`` are columns that hold 2 to the bits of each half."""
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    mixed = lambda x, key: let(f"({x} * {FACTORS[0]} + {key}) % {PRIME}", "u", let(f"(xor(u, u >> 13) * {FACTORS[1]} + {key}) % {PRIME}", "w", "xor(w, w >> 16)"))

    def once(x: str) -> str:
        step = f"{{'l': {x} // {right}, 'r': {x} % {right}}}"
        for r, key in enumerate(_keys(seed)):
            halves = ("s.l", f"xor(s.r, {mixed('s.l', key)} % {right})") if r % 2 else (f"xor(s.l, {mixed('s.r', key)} % {left})", "s.r")
            step = let(step, "s", "{{'l': {}, 'r': {}}}".format(*halves))
        return let(step, "s", f"s.l * {right} + s.r")

    return f"list_reduce(range({steps}), lambda x, i: CASE WHEN x < {n} THEN x ELSE {once('x')} END, {once(row)})"


def locate(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    place = int(permute(np.array([row]), n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """Row number in a slot of a shard."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the order of the columns ``order`` (nulls first); also the count.

    One range shuffle, no global window: rows are ranged by the order columns,
    numbered within their range and shifted by the sizes of the ranges before.
    Rows that tie on every order column are spread over ranges by an arbitrary
    last key, so that a hot key splits; pass enough columns for ties to be rows
    that are the same in all that matters. The ranged rows are written once, as
    ranges drawn from samples need not come out the same twice.
    """
    spark = df.sparkSession
    tie, pid, at = fresh(df, "_tie"), fresh(df, "_pid"), fresh(df, "_at")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(n, *order, tie)
        .sortWithinPartitions(*order, tie)
        .withColumn(pid, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .drop(tie)
    )
    ranged = materialise(ranged)
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(pid).count().collect())  # a row for each partition
    starts, total = [], 0
    for p, k in sizes:
        starts.append((p, total))
        total += k
    shift = fresh(df, "_shift")
    offsets = spark.createDataFrame(starts, f"{pid} int, {shift} long")
    numbered = ranged.join(F.broadcast(offsets), pid).withColumn(name, F.col(shift) + F.col(at))
    return numbered.drop(pid, at, shift), total


def shard_rows(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add row_number, shard and slot: a reproducible shuffle into shards of at most one row's difference.

    Columns of these names in ``df`` are replaced. Rows with nulls, empty or long texts
    and repeated rows are rows like any other; rows that tie on ``order`` may change places; an empty table stays empty.
    Slots are gapless from 0 in every shard.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("row_number", "shard", "slot")])
    numbered, n = number_rows(df, order)
    at = fresh(df, "_place")
    return (
        numbered.withColumn(at, permuted("row_number", max(n, 1), seed))
        .withColumn("shard", (F.col(at) % shards).cast("int"))
        .withColumn("slot", F.expr(f"`{at}` div {shards}"))
        .drop(at)
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write sharded rows as one folder for each shard, in slot order within ranges of slots."""
    (
        sharded.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law ``rows``; only digests of the texts are shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard_rows(docs, ["doc_id", "size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


OP8_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 + 1 AS size, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b, t FROM d, t),
c AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number, count(*) OVER () AS n FROM c),
w AS (SELECT *, greatest(2, len(bin(greatest(n, 2) - 1))) AS bits FROM r),
p AS (SELECT *, CAST(2 ** (bits // 2) AS BIGINT) AS pl, CAST(2 ** (bits - bits // 2) AS BIGINT) AS pr FROM w),
z AS (SELECT *, {permuted_sql("row_number", "n", "pl", "pr")} AS place FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % {SHARDS} AS INTEGER) AS shard, place // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number FROM z
"""
