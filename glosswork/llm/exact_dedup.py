"""Exact deduplication by composable polynomial fingerprints.

A text is cut into parts, every part is hashed on its own, and part hashes
combine by length-shifted arithmetic, h(ab) = h(a) * B^|b| + h(b) modulo a
prime, so parts of a huge document may be hashed anywhere and in any order.
Documents of equal fingerprint are then compared byte by byte, chunk by chunk, and parted where a chunk differs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import bound_batches, fresh, materialise, small_or_shuffled, table

#: Two primes under 2^31, so that a product of residues fits a signed 64-bit integer, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1402024253)
#: Bytes hashed in one step: 255 * 2^31 * 2^14 stays under 2^53, so the float products below are exact.
STEP = 1 << 14
#: Characters of a part.
PART = 1 << 20
#: Bits of the map of fingerprints that occur more than once; its size is fixed (8 MB as longs).
MAP_BITS = 1 << 24


def _powers(bases: tuple[int, int] = BASES) -> np.ndarray:
    rows = []
    for p, b in zip(PRIMES, bases, strict=True):
        row, x = np.empty(STEP), 1
        for i in range(STEP):
            row[STEP - 1 - i] = x
            x = x * b % p
        rows.append(row)
    return np.ascontiguousarray(np.array(rows).T)


def hash_bytes(data: bytes, powers: np.ndarray, bases: tuple[int, int] = BASES) -> tuple[int, int]:
    """Polynomial hashes of a byte string: steps are hashed apart and combined by their lengths."""
    whole = np.frombuffer(data, np.uint8)
    out = [0, 0]
    for i in range(0, len(whole), STEP):
        step = whole[i : i + STEP]
        sums = (step + 1.0) @ powers[STEP - len(step) :]
        for k in (0, 1):
            out[k] = (out[k] * pow(bases[k], len(step), PRIMES[k]) + int(sums[k])) % PRIMES[k]
    return out[0], out[1]


def combine(left: tuple[int, int, int], right: tuple[int, int, int], bases: tuple[int, int] = BASES) -> tuple[int, int, int]:
    """Fingerprint (hash, hash, bytes) of two texts put together, from theirs alone."""
    h = [(left[k] * pow(bases[k], right[2], PRIMES[k]) + right[k]) % PRIMES[k] for k in (0, 1)]
    return h[0], h[1], left[2] + right[2]


def normalised(text) -> F.Column:
    """Runs of ASCII white space become one space; null is empty. Single spaces, the common case, are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _parts(df: DataFrame, text: str) -> DataFrame:
    """A row for each part of each text: (..., part, piece)."""
    pieces = F.when(F.length(text) <= PART, F.array(text)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.expr(f"(length(`{text}`) - 1) div {PART}")),
            lambda i: F.substring(F.col(text), i * PART + 1, F.lit(PART)),
        )
    )
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(pieces).alias("part", "piece"))


def _hash_batches(batches: Iterator[pa.RecordBatch], bases: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    powers = _powers(bases)
    for batch in batches:
        names = [n for n in batch.schema.names if n != "piece"]
        cols = [[], [], [], [], []]
        for value in batch.column("piece"):
            data = value.as_buffer().to_pybytes()
            h1, h2 = hash_bytes(data, powers, bases)
            for c, v in zip(cols, (h1, h2, pow(bases[0], len(data), PRIMES[0]), pow(bases[1], len(data), PRIMES[1]), len(data)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(c, pa.int64()) for c in cols],
            names=[*names, "h1", "h2", "s1", "s2", "n"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bases: tuple[int, int] = BASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, rid, probe, text_sha256, fp1, fp2, nbytes.

    ``rid`` tells rows apart that share doc_id and text. ``probe`` is a native
    64-bit hash of the text that later scans can compute without Python.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("rid"),
        normalised(F.col(text_col)).alias("norm"),
    ).select("doc_id", "rid", F.xxhash64("norm").alias("probe"), F.sha2("norm", 256).alias("text_sha256"), "norm")
    parts = _parts(base, "norm")
    kept = [f for f in parts.schema.fields if f.name != "piece"]
    types = {"bigint": "long"}
    schema = ", ".join(f"`{f.name}` {types.get(f.dataType.simpleString(), f.dataType.simpleString())}" for f in kept)
    hashed = parts.mapInArrow(lambda b: _hash_batches(b, bases), schema + ", h1 long, h2 long, s1 long, s2 long, n long")
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("part", "h1", "h2", "s1", "s2", "n"))),
        zero,
        lambda acc, x: F.struct(
            ((acc.a * x.s1 + x.h1) % PRIMES[0]).alias("a"),
            ((acc.b * x.s2 + x.h2) % PRIMES[1]).alias("b"),
            (acc.n + x.n).alias("n"),
        ),
    )
    return (
        hashed.groupBy("doc_id", "rid", "probe", "text_sha256")
        .agg(folded.alias("f"))
        .select("doc_id", "rid", "probe", "text_sha256", F.col("f.a").alias("fp1"), F.col("f.b").alias("fp2"), F.col("f.n").alias("nbytes"))
    )


def _repeated_map(prints: DataFrame) -> list[int]:
    """Bits of the probes of fingerprints that occur more than once, as at most MAP_BITS / 64 longs."""
    twice = prints.groupBy("fp1", "fp2", "nbytes").agg(F.count(F.lit(1)).alias("k"), F.collect_set("probe").alias("probes"))
    words = (
        twice.where("k > 1")
        .select(F.explode("probes").alias("probe"))
        .select(F.pmod("probe", F.lit(MAP_BITS)).alias("bit"))
        .groupBy(F.expr("cast(bit div 64 as int)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    )
    out = [0] * (MAP_BITS // 64)
    for word, bits in words.collect():  # at most MAP_BITS / 64 rows, whatever the input
        out[word] = bits
    return out


def _repeated_chunks(docs: DataFrame, bits: list[int], bases: tuple[int, int]) -> DataFrame:
    """(rid, fp1, fp2, nbytes, part, piece) of the rows (rid, norm, probe) whose probe is in the map: a superset of the repeated texts, with their fingerprints."""
    share = docs.sparkSession.sparkContext.broadcast(np.array(bits, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(bases)
        for batch in batches:
            probe = batch.column("probe").to_numpy() % MAP_BITS
            seen = (share.value[probe // 64] >> (probe % 64).astype(np.uint64)) & np.uint64(1) == 1
            rows: list[tuple] = []
            for i in np.flatnonzero(seen).tolist():
                text, whole = batch.column("norm")[i].as_py(), (0, 0, 0)
                pieces = [text[a : a + PART] for a in range(0, max(1, len(text)), PART)]
                for data in map(str.encode, pieces):
                    whole = combine(whole, (*hash_bytes(data, powers, bases), len(data)), bases)
                rid = batch.column("rid")[i].as_py()
                rows += [(rid, *whole, n, piece) for n, piece in enumerate(pieces)]
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["rid", "fp1", "fp2", "nbytes", "part", "piece"])

    return docs.mapInArrow(run, "rid long, fp1 long, fp2 long, nbytes long, part int, piece string")


CLASS = ["fp1", "fp2", "nbytes"]


def compare_chunks(docs: DataFrame, prints: DataFrame, text_col: str = "text", bases: tuple[int, int] = BASES) -> DataFrame | None:
    """(rid, variant) of the rows whose fingerprint stands for different texts, rows of one variant being equal; None if there are none.

    Only rows whose fingerprint occurs more than once are compared. Equal chunks of a class merge where they are read
    (map-side), so a class that holds a third of all rows sends one copy of each chunk from each task, and no pairs are formed.
    Classes that hold one text for every chunk, as nearly all do, need nothing more.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), normalised(F.col(text_col)).alias("norm")).withColumn("probe", F.xxhash64("norm"))
    chunks = _repeated_chunks(rows, _repeated_map(prints), bases)
    variants = chunks.groupBy(*CLASS, "part", "piece").agg(F.min("rid").alias("first"))
    differ = materialise(variants.groupBy(*CLASS, "part").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select(*CLASS).distinct())
    if differ.isEmpty():
        return None
    odd = chunks.join(differ, CLASS, "left_semi")
    named = odd.join(odd.groupBy(*CLASS, "part", "piece").agg(F.min("rid").alias("first")), [*CLASS, "part", "piece"])
    return materialise(named.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("part", "first"))).alias("variant")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bases: tuple[int, int] = BASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, rid, keep_id, group_size, kept, text_sha256, fingerprint.

    Texts are equal when identical after white-space normalisation; null counts
    as empty, so null and blank texts of the same form are copies. The row of
    smallest doc_id (null last) stays; of rows that share doc_id and text, one.
    Texts that share a fingerprint but not the bytes are told apart by the comparison; the SHA-256
    takes no part. Texts of any length are compared whole; an empty table gives an empty one. ``docs`` must be a table of files, as it is
    read twice. Other columns are not read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, bases))
    parted = compare_chunks(docs, prints, text_col, bases)
    none = F.lit(None).cast("array<struct<part: int, first: bigint>>")
    prints = prints.withColumn("variant", none) if parted is None else prints.join(parted, "rid", "left")
    prints = prints.withColumn("variant", F.coalesce(F.to_json("variant"), F.lit("")))
    key = [*CLASS, "variant"]
    groups = prints.groupBy(*key).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    several = materialise(groups.where("group_size > 1"))
    joined = prints.join(small_or_shuffled(several, several.count(), 160), key, "left")
    return joined.select(
        "doc_id",
        "rid",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        "text_sha256",
        F.format_string("%08x%08x%x", "fp1", "fp2", "nbytes").alias("fingerprint"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: of equal texts one row. An empty table stays empty.

    Rows are matched by their place in the scan, so ``docs`` must be a table that is
    read the same way each time, as files are; write one that comes from a shuffle or join first. For nulls, ties, repeats and long texts see ``exact_duplicates``.
    """
    gone = materialise(exact_duplicates(docs, id_col, text_col).where("not kept").select("rid"))
    rid = fresh(docs, "_rid")
    gone = small_or_shuffled(gone.withColumnRenamed("rid", rid), gone.count(), 16)
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(gone, rid, "left_anti").drop(rid)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    found = exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""
