"""Near-duplicate detection by SimHash and multi-index hashing.

Fingerprints of 64 bits link at RADIUS = 3 or fewer differing bits. Two
segments of 32 bits index them: of three differing bits one segment holds at
most one, so a fingerprint looks up the small ball (its segment value and the values one bit
away) in each segment's table and verifies the whole distance.

Only distinct fingerprints take part. Where a table entry has so many members
that pairs would grow with its square, members are joined through shared
points of small Hamming balls of the other segment instead, which loses no link's
connection and grows in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import bound_batches, fresh, materialise, small_or_shuffled, table
from glosswork.operators.graph import connected

RADIUS = 3
SEED = 42
#: Members of a table entry up to which its pairs are compared one by one.
PAIRS_UP_TO = 64
#: Shingles whose bits are counted at a time.
SLAB = 1 << 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def tokens_of(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased words joined by single spaces, and where each begins and ends; bytes split at exactly 0x20 and 0x09-0x0D."""
    tokens = data.translate(_LOWER).split()
    length = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(length) - 1
    return b" ".join(tokens), ends - length + 1, ends


def shingle_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """XXH64 of each shingle of a run of words; of fewer words, of them all."""
    words, digest = min(words, max(1, len(starts))), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: Iterator[np.ndarray]) -> int:
    """Fingerprint of hashes given in slabs: the bits that over half of them have; 0 for none."""
    votes, many = np.zeros(64, np.int64), 0
    for h in hashes:
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        many += len(h)
    return int.from_bytes(np.packbits(votes * 2 > many, bitorder="little").tobytes(), "little")


def simhash(data: bytes, words: int = 3) -> int:
    """Fingerprint of a UTF-8 text over its word shingles, repeats included; 0 if it has no word."""
    joined, starts, ends = tokens_of(data)
    slabs = [slice(i, i + SLAB + words - 1) for i in range(0, max(1, len(starts) - words + 1), SLAB)]
    return majority(shingle_hashes(joined, starts[at], ends[at], words) for at in slabs)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, rid, fp) for every row of ``docs``; null and blank texts get fingerprint zero."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(v.as_buffer().to_pybytes(), words) if v.is_valid else 0 for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rid"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "rid", "fp"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, fp long")


def _half(fp: str, seg: int) -> str:
    """The 32-bit segment ``seg`` of a fingerprint, as a non-negative long."""
    return f"({fp} & 4294967295L)" if seg == 0 else f"(shiftrightunsigned({fp}, 32) & 4294967295L)"


#: The 32 single-bit masks.
_MASKS = "transform(sequence(0, 31), k -> shiftleft(1L, k))"


def _balls(prints: DataFrame) -> DataFrame:
    """(seg, value, fp, own): own for the segment's value itself, else a value with one set bit cleared.

    Of two values one bit apart, the one that has the bit set looks up the other, so every pair meets once.
    """
    rows = None
    for seg in (0, 1):
        value = _half("fp", seg)
        ball = f"""explode(concat(array(struct({value} as value, true as own)),
            transform(filter({_MASKS}, m -> ({value} & m) != 0), m -> struct({value} ^ m as value, false as own))))"""
        part = prints.select("fp", F.lit(seg).alias("seg"), F.expr(ball).alias("b")).select("seg", F.col("b.value").alias("value"), "fp", F.col("b.own").alias("own"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, between distinct fingerprints, enough to connect all that lie within RADIUS of each other.

    ``prints`` has a column fp of distinct fingerprints. Every edge returned has
    been verified against the whole distance.
    """
    balls = materialise(_balls(prints))
    # Entries with an owner and another member; members of entries are counted before any is joined.
    size = balls.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("members"), F.count_if("own").alias("owners")).where("owners > 0 and members > 1")
    met = materialise(balls.join(size, ["seg", "value"]))
    key = ["seg", "value"]
    few, many = met.where(f"members <= {PAIRS_UP_TO}"), met.where(f"members > {PAIRS_UP_TO}")
    owners = few.where("own").select(*key, F.col("fp").alias("u"))
    looked = few.select(*key, F.col("fp").alias("v"), "own")
    pairs = (
        owners.join(looked, key)
        .where("(not own or u < v) and bit_count(u ^ v) <= 3")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    )
    return pairs.unionByName(_star_links(many)).distinct()


def _star_links(met: DataFrame) -> DataFrame:
    """Edges inside crowded entries, in proportion to their members.

    Owners of an entry share a segment; of the other segment, two owners that differ in up
    to two bits share a point one bit away at most from both, so all owners around a point
    link to the smallest of them. For three bits, an owner within two bits of a point
    links to that smallest one; a member whose segment is one bit off, within one bit.
    """
    other = f"case when seg = 0 then {_half('fp', 1)} else {_half('fp', 0)} end"
    base = met.select("seg", "value", "fp", "own", F.expr(other).alias("o"))
    one = f"concat(array(o), transform({_MASKS}, m -> o ^ m))"
    two = f"flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> o ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    key = ["seg", "value", "point"]
    hubs = base.where("own").select("seg", "value", "fp", F.expr(f"explode({one})").alias("point")).groupBy(*key).agg(F.min("fp").alias("hub"))
    reach = F.expr(f"explode(case when own then concat({one}, {two}) else {one} end)").alias("point")
    rays = base.select("seg", "value", "fp", reach)
    return (
        rays.join(hubs, key)
        .where("fp != hub and bit_count(fp ^ hub) <= 3")
        .select(F.least("fp", "hub").alias("u"), F.greatest("fp", "hub").alias("v"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, rid, fp, component_id.

    component_id is the smallest doc_id that links reach, the row's own included.
    Null, blank and one-word texts are documents like any other: without words the
    fingerprint is zero, which links as usual. Repeated rows share a component.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(nodes.select("fp")))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = joined.where("root is not null").join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "rid", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component of linked fingerprints the row of smallest doc_id."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, words), "component_id")


def keep_first(docs: DataFrame, found: DataFrame, component: str) -> DataFrame:
    """Of the rows of ``docs`` that ``found`` (doc_id, rid, component) groups, the first of each group by id, null last."""
    found = materialise(found)
    first = found.groupBy(component).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    stay = first.select(F.col("first.rid").alias("rid"))
    gone = materialise(found.select("rid").join(stay, "rid", "left_anti"))
    rid = fresh(docs, "_rid")
    gone = small_or_shuffled(gone.withColumnRenamed("rid", rid), gone.count(), 16)
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(gone, rid, "left_anti").drop(rid)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
