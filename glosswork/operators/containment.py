"""Literal containment of many terms in many texts: rare runs of bytes as anchors, in Spark expressions only.

Neither the terms nor the texts are broadcast or held whole. Each term is found by one run of bytes of its own, its anchor, which
is the rarest among the texts; texts give the runs at all their places, a bounded set of bits takes out those that
are no anchor before anything is shuffled, and what meets is compared literally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.operators.durable import written

#: Bytes of anchors; a term's is the greatest that isn't longer than the term.
SIZES = (1, 2, 4, 8, 16, 32)
#: Bytes of a block, from which runs are read. A place among bytes costs the same wherever it is; one among characters is counted from the start.
BLOCK = 1024
#: Bytes of a stretch, in which a candidate is compared: a very long text is read by many tasks.
STRETCH = 65_536
#: One block in so many counts the runs of the texts. The counts choose anchors, and so the work, not the result.
COUNTED_SHARE = 16
#: Bits of a set for each hash in it, and of all (8 MB); with more hashes more runs pass it, which the join takes out.
BITS_EACH, MOST_BITS = 16, 1 << 26
#: Counted runs from which an anchor is hot and is dealt to SALTS tasks.
HOT_COUNT, SALTS = 10_000, 32


class Bits:
    """What tells of most hashes that they are not among some (``hashes``, column h), in a bounded number of bits; two bits for each."""

    def __init__(self, hashes: DataFrame) -> None:
        spark, n, self.size, self.held = hashes.sparkSession, hashes.count(), 64, None
        if n == 0:
            return
        while self.size < min(BITS_EACH * n, MOST_BITS):
            self.size *= 2
        at = hashes.select(F.explode(F.array(*self._places(F.col("h")))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        every = spark.range(self.size // 64).withColumnRenamed("id", "word").join(words, "word", "left")
        self.held = written(every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("s")).select(F.col("s.bits").alias("words")))

    def _places(self, h: Column) -> list[Column]:
        return [p.bitwiseAND(F.lit(self.size - 1)) for p in (h, F.shiftrightunsigned(h, 32))]

    def may_hold(self, h: Column) -> Column:
        """False only for hashes that aren't there."""
        if self.held is None:
            return F.lit(False)
        words = self.held.scalar()
        one, two = (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in self._places(h))
        return one & two


def runs(rows: DataFrame, column: str, sizes: list[int], *carried: str, share: int = 1) -> DataFrame:
    """(carried, at, size, h): the hash of the bytes from each place (from 0) of a binary column on, for each size.

    At the end of a text the last ones are shorter than their size. With ``share`` only one block in so many is read.
    """
    blocks = rows.select(*carried, F.col(column).alias("_t")).where("length(_t) > 0")
    blocks = blocks.select(*carried, "_t", F.explode(F.expr(f"sequence(0, (length(_t) - 1) div {BLOCK})")).alias("_i"))
    if share > 1:
        blocks = blocks.where(F.pmod(F.xxhash64(*carried, "_i"), F.lit(share)) == 0)
    parts = blocks.select(*carried, "_i", F.expr(f"substring(_t, cast(_i * {BLOCK} + 1 as int), {BLOCK + max(sizes) - 1})").alias("_x"))
    places = parts.select(*carried, "_i", "_x", F.explode(F.expr(f"sequence(1, least({BLOCK}, length(_x)))")).alias("_p"))
    hashed = lambda s: F.xxhash64(F.substring(F.col("_x"), F.col("_p"), F.lit(s)))
    at = (F.col("_i") * BLOCK + F.col("_p") - 1).alias("at")
    if len(sizes) == 1:
        return places.select(*carried, at, F.lit(sizes[0]).alias("size"), hashed(sizes[0]).alias("h"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), hashed(s).alias("h")) for s in sizes]))
    return places.select(*carried, at, each.alias("_g")).select(*carried, "at", "_g.size", "_g.h")


def _anchors(texts: DataFrame, terms: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, h, at, seen): the run of each term (key, term, n, own) that the texts have least, ties to what fewer terms share; and how often it was counted."""
    mine = written(runs(terms, "term", sizes, "key", "n", "own").where("size = own and at + size <= n").select("key", "h", "at"))
    shared = mine.groupBy("h").agg(F.count(F.lit(1)).alias("shared"))
    counted = runs(texts, "text", sizes, "id", share=COUNTED_SHARE).select("h").where(Bits(shared).may_hold(F.col("h")))
    seen = counted.groupBy("h").agg(F.count(F.lit(1)).alias("seen"))
    rarity = mine.join(shared.join(seen, "h", "left"), "h").select("key", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shared", "h", "at").alias("r"))
    return written(rarity.groupBy("key").agg(F.min("r").alias("r")).select("key", "r.h", "r.at", "r.seen"))


def contained(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term), once each, of every term (term) that stands literally in a text (id, text), for any number of terms.

    Rows that share an id are one text's parts: a term in any of them is found once. A null id is an id. Null texts, and null and empty
    terms, give nothing; a term of any length is found in a text of any length. Other columns aren't read.
    """
    kind = texts.schema["text"].dataType
    texts = texts.select("id", F.col("text").cast("binary").alias("text"))
    own = F.greatest(*[F.when(F.length("term") >= s, s).otherwise(1) for s in SIZES])
    named = terms.select(F.col("term").cast("binary").alias("term")).where("length(term) > 0").withColumn("key", F.unhex(F.sha2("term", 256)))
    wanted = written(named.groupBy("key").agg(F.any_value("term").alias("term")).withColumns({"n": F.length("term"), "own": own}))
    found = wanted.agg(F.collect_set("own").alias("sizes"), F.max("n").alias("longest")).first()
    if not found.sizes:
        return texts.select("id", F.col("text").cast(kind).alias("term")).where("false")
    sizes = sorted(found.sizes)
    held = _anchors(texts, wanted, sizes)

    # where an anchor stands: for each text and stretch once, before and after the shuffle
    some, often = Bits(held.select("h").distinct()), Bits(held.where(F.col("seen") >= HOT_COUNT).select("h").distinct())
    stretch = F.floor(F.col("at") / STRETCH).cast("long")
    stood = runs(texts, "text", sizes, "id").where(some.may_hold(F.col("h"))).select("id", stretch.alias("stretch"), "h").distinct()
    salted = stood.withColumn("salt", F.when(often.may_hold(F.col("h")), F.pmod(F.xxhash64("id", "stretch"), F.lit(SALTS)).cast("int")).otherwise(0))
    dealt = held.select("key", "h", "at", F.explode(F.when(often.may_hold(F.col("h")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    # the term itself may begin one stretch before its anchor, or more if it is longer than a stretch
    first = F.floor(F.greatest(F.col("stretch") * STRETCH - F.col("at"), F.lit(0)) / STRETCH).cast("long")
    last = F.floor(F.greatest((F.col("stretch") + 1) * STRETCH - 1 - F.col("at"), F.lit(0)) / STRETCH).cast("long")
    met = salted.join(dealt, ["h", "salt"]).select("id", "key", F.explode(F.sequence(first, last)).alias("stretch")).distinct()
    met = written(met)

    # literal comparison; only texts with a candidate are moved
    few = Bits(met.select(F.xxhash64("id").alias("h")).distinct())
    cut = F.explode(F.expr(f"sequence(0L, (length(text) - 1L) div {STRETCH})")).alias("_n")
    window = F.expr(f"substring(_t, cast(_n * {STRETCH} + 1 as int), {STRETCH + found.longest - 1})").alias("_window")
    pieces = texts.where("length(text) > 0").where(few.may_hold(F.xxhash64("id"))).select(F.col("id").alias("_id"), F.col("text").alias("_t"), cut).select("_id", "_n", window)
    asked = met.join(wanted.select("key", "term"), "key")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("stretch") == F.col("_n"))
    hits = asked.join(pieces, same).where(F.contains("_window", "term")).select("id", "key").distinct()
    return hits.join(wanted.select("key", "term"), "key").select("id", F.col("term").cast(kind).alias("term"))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b), once each, of the terms of two vocabularies (term) of which one contains the other; equal terms do. Null and empty terms have no part."""
    left, right = (written(terms.select("term").where("length(term) > 0").distinct()) for terms in (left, right))  # each is read several times below, what it is made of once
    as_text = lambda terms: terms.select(F.col("term").alias("id"), F.col("term").alias("text"))
    inside = contained(as_text(right), left).select(F.col("term").alias("a"), F.col("id").alias("b"))
    around = contained(as_text(left), right).where("id != term").select(F.col("id").alias("a"), F.col("term").alias("b"))
    return inside.unionByName(around)
