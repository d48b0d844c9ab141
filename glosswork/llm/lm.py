"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

P(w | v) mixes c(vw)/c(v), c(w)/N and 1/(V+1) with weights that depend on the
bucket of c(v), learned by expectation-maximisation on deleted counts: each training event is held out
in turn, by taking it off the counts.

Counts never sit in one place. Texts are cut into blocks of tokens; a block sends each
distinct n-gram once, with its count, to the range of hashes that owns it, and gets
the corpus count back. A frequent n-gram therefore costs one entry for a block, and
what moves grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import bound_batches, grow, materialise, shrink, table

#: Tokens of a block at least and at most: blocks grow with the corpus, so that it makes about BLOCKS of them.
BLOCK_TOKENS, MOST_BLOCK_TOKENS, BLOCKS = 1_000_000, 16_000_000, 4096
#: Distinct n-grams, at most, that a range gets on average.
RANGE_TOKENS = 2_000_000
#: Tokens of a document that lie in one block; a longer one goes on in the next, with its context.
SEGMENT_TOKENS = 1_000_000
START, END = 0, 1
EM_ROUNDS = 60

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FIXED = [xxhash.xxh64_intdigest(b" start"), xxhash.xxh64_intdigest(b" end")]  # no word holds a space


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs; odd, where those of single words are even."""
    with np.errstate(over="ignore"):
        x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(30))) | np.uint64(1)


class Block:
    """Tokens of some segments of documents: ids in order of first sight, each segment led by its context."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.docs: list = []
        self.rids: list[int] = []
        self.train: list[bool] = []
        self.sizes: list[int] = []
        self.ids: list[np.ndarray] = []
        self.tokens = self.train_docs = 0

    def add(self, doc, rid: int, train: bool, context: bytes | None, words: list[bytes], last: bool) -> None:
        number, n = self.numbers, len(words)
        ids = np.empty(n + 1 + last, np.int32)
        ids[0] = START if context is None else number.setdefault(context, len(number) + 2)
        ids[1 : n + 1] = [number.setdefault(w, len(number) + 2) for w in words]
        if last:
            ids[-1] = END
        self.docs.append(doc)
        self.rids.append(rid)
        self.train.append(train)
        self.sizes.append(len(ids))
        self.ids.append(ids)
        self.tokens += len(ids) - 1
        self.train_docs += train and context is None

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh64_intdigest
        return np.array(_FIXED + [digest(w) for w in self.numbers], np.uint64) & ~np.uint64(1)


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int, segment_tokens: int) -> Iterator[pa.RecordBatch]:
    block, count, task = Block(), 0, TaskContext.get().partitionId() << 32
    key_type = pa.int64()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task + count]),
                pa.array([block.tokens]),
                pa.array([sum(s - 1 for s, t in zip(block.sizes, block.train, strict=True) if t)]),
                pa.array([block.train_docs]),
                pa.array([block.docs], pa.list_(key_type)),
                pa.array([block.rids], pa.list_(pa.int64())),
                pa.array([block.train], pa.list_(pa.bool_())),
                pa.array([block.sizes], pa.list_(pa.int32())),
                pa.array([shrink(np.concatenate(block.ids))], pa.binary()),
                pa.array([shrink(block.hashes())], pa.binary()),
            ],
            names=["block", "tokens", "train_tokens", "train_docs", "docs", "rids", "train", "sizes", "ids", "words"],
        )

    for batch in batches:
        key_type = batch.schema.field("doc_id").type
        for doc, rid, train, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "train")), batch.column("text"), strict=True):
            words = (text.as_py() or "").encode().translate(_LOWER).split()
            for i in range(0, max(1, len(words)), segment_tokens):
                part = words[i : i + segment_tokens]
                block.add(doc, rid, train, words[i - 1] if i else None, part, i + segment_tokens >= len(words))
                if block.tokens >= block_tokens:
                    yield out()
                    block, count = Block(), count + 1
    if block.docs:
        yield out()


class Grams:
    """Distinct n-grams of a stored block, sorted by hash; the same wherever it is worked out."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, sizes: np.ndarray, train: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        follows = np.ones(len(ids), bool)
        follows[ends - sizes] = False  # the context that leads a segment is no token of it
        at = np.flatnonzero(follows)
        self.token, self.context = ids[at].astype(np.int64), ids[at - 1].astype(np.int64)
        self.trained = np.repeat(train, sizes)[at]
        code, self.pair = np.unique(self.context * len(words) + self.token, return_inverse=True)
        hashes = np.concatenate([words, pair_hashes(words[code // len(words)], words[code % len(words)])])
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.n_words = len(words)

    def counts(self) -> np.ndarray:
        """Training counts in this block, in the order of the hashes."""
        t = self.trained
        return np.concatenate([np.bincount(self.token[t], minlength=self.n_words), np.bincount(self.pair[t], minlength=len(self.order) - self.n_words)])[self.order]

    def receive(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of words, and of each token's pair."""
        back = np.empty(len(counts), np.int64)
        back[self.order] = counts
        return back[: self.n_words], back[self.n_words :][self.pair]


def _grams(row: dict) -> Grams:
    return Grams(grow(row["ids"], np.int32), grow(row["words"], np.uint64), np.array(row["sizes"], np.int64), np.array(row["train"], bool))


def _asks(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, hashes, counts): what each block sends to each range of hashes."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = _grams(row)
                counts, cut = grams.counts(), [0, *np.searchsorted(grams.sorted, bounds).tolist(), len(grams.sorted)]
                cells = []
                for r in np.flatnonzero(np.diff(cut)).tolist():  # a cell holds an n-gram at least, so cells never outnumber them
                    a, b = cut[r], cut[r + 1]
                    h = grams.sorted[a:b]
                    step = np.concatenate([h[:1], np.diff(h)])
                    cells.append((r, row["block"], shrink(step), shrink(counts[a:b].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["range", "block", "hashes", "counts"],
                )

    return blocks.select("block", "train", "sizes", "ids", "words").mapInArrow(run, "range int, block long, hashes binary, counts binary")


def _answer(asked: pa.Table) -> pa.Table:
    """Corpus counts for every block that asked, and under block -1 how many distinct words were trained on."""
    with np.errstate(over="ignore"):
        hashes = [np.cumsum(grow(v.as_py(), np.uint64), dtype=np.uint64) for v in asked.column("hashes")]
    counts = np.concatenate([grow(v.as_py(), np.int32) for v in asked.column("counts")])
    distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, counts)
    words = int(((distinct & np.uint64(1) == 0) & (total > 0)).sum())
    back, at, out = total[inverse], 0, []
    for h in hashes:
        out.append(shrink(back[at : at + len(h)]))
        at += len(h)
    return pa.table(
        {
            "block": pa.array([*asked.column("block").to_pylist(), -1], pa.int64()),
            "range": pa.array([asked.column("range")[0].as_py()] * (len(out) + 1), pa.int32()),
            "counts": pa.array([*out, b""], pa.binary()),
            "words": pa.array([0] * len(out) + [words], pa.int64()),
        }
    )


def bucket(context: np.ndarray) -> np.ndarray:
    """Bucket of context counts: 0 for none, then one for each doubling."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


#: Bits of an estimate's bin: BINS a doubling, so bins reach far below one over any count.
BIN_BITS, BINS = 11, 8


def _bin(p: np.ndarray) -> np.ndarray:
    """Eighths of a doubling, from 1; 0 for no probability. A bin's events count with their mean, so its width is felt in the second order only."""
    return np.where(p > 0, 1 + np.clip(np.rint(-BINS * np.log2(np.maximum(p, 1e-300))), 0, (1 << BIN_BITS) - 2).astype(np.int64), 0)


def _count_blocks(blocks: DataFrame, answers: DataFrame, n_train: int, n_docs: int) -> DataFrame:
    """Blocks with the counts of each token, and training events tallied by bucket and binned deleted estimates."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.table({n: pa.array([], t) for n, t in types})
        row = rows[0]
        grams = _grams(row)
        cells = sorted(zip(right.column("range").to_pylist(), right.column("counts").to_pylist(), strict=True))
        counts = np.concatenate([grow(c, np.int64) for _, c in cells])
        if len(counts) != len(grams.sorted):
            raise ValueError(f"block {row['block']} asked for {len(grams.sorted)} n-grams and got {len(counts)}")
        word, pair = grams.receive(counts)
        context = np.where(grams.context == START, n_docs, word[grams.context])
        single, t, lengths = word[grams.token], grams.trained, np.array(row["sizes"]) - 1
        c1, c12, c2 = context[t] - 1, pair[t] - 1, single[t] - 1
        p2, p1 = np.where(c1 > 0, c12 / np.maximum(c1, 1), 0.0), c2 / max(1, n_train - 1)
        keys, at, weights = np.unique((bucket(c1) << 2 * BIN_BITS) | (_bin(p2) << BIN_BITS) | _bin(p1), return_inverse=True, return_counts=True)
        tally = [{"key": k, "events": w, "pair": x, "single": y} for k, w, x, y in zip(keys.tolist(), weights.tolist(), np.bincount(at, p2).tolist(), np.bincount(at, p1).tolist(), strict=False)]
        return pa.table(
            {
                "docs": pa.array([row["docs"]], types[0][1]),
                "rids": pa.array([row["rids"]], pa.list_(pa.int64())),
                "sizes": pa.array([row["sizes"]], pa.list_(pa.int32())),
                "lead": pa.array([context[np.cumsum(lengths) - lengths].tolist()], pa.list_(pa.int64())),
                "pair": pa.array([shrink(pair)], pa.binary()),
                "single": pa.array([shrink(single)], pa.binary()),
                "tally": pa.array([tally], types[-1][1]),
            }
        )

    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[blocks.schema["docs"].dataType.elementType.simpleString()]
    types = [("docs", pa.list_(key_type)), ("rids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("lead", pa.list_(pa.int64())), ("pair", pa.binary()), ("single", pa.binary())]
    types.append(("tally", pa.list_(pa.struct([("key", pa.int64()), ("events", pa.int64()), ("pair", pa.float64()), ("single", pa.float64())]))))
    left = blocks.select("block", "docs", "rids", "train", "sizes", "ids", "words")
    docs = left.schema["docs"].dataType.simpleString()
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, f"docs {docs}, rids array<long>, sizes array<int>, lead array<long>, pair binary, single binary, tally array<struct<key: long, events: long, pair: double, single: double>>"
    )


def learn_weights(tallies: list[tuple[int, int, float, float]], words: int) -> np.ndarray:
    """Weights (pair, single, uniform) for each bucket, by expectation-maximisation over tallied deleted events: (key, events, sums of both estimates)."""
    out = np.full((64, 3), 1 / 3)
    if tallies:
        keys, weight, pair, single = (np.array(c) for c in zip(*tallies, strict=True))
        which = keys >> 2 * BIN_BITS
        p = np.stack([pair / weight, single / weight, np.full(len(keys), 1 / (words + 1))], axis=1)
        for b in np.unique(which):
            at = which == b
            q, w, mix = p[at], weight[at].astype(float), np.full(3, 1 / 3)
            for _ in range(EM_ROUNDS):
                share = q * mix
                share *= (w / share.sum(axis=1))[:, None]
                mix = share.sum(axis=0) + 1e-3
                mix /= mix.sum()
            out[b] = mix
        seen = np.unique(which)
        for b in range(1, 64):  # buckets that no event fell in take the next smaller one's
            if b not in seen:
                out[b] = out[b - 1] if b > 1 or 0 in seen else out[b]
    out[0, 0] = 0.0  # an unseen context has no estimate of its own
    out[0] /= out[0].sum()
    return np.maximum(out, [0, 1e-9, 1e-6])


def _score_blocks(counted: DataFrame, weights: np.ndarray, n_train: int, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                pair, single = grow(row["pair"], np.int64), grow(row["single"], np.int64)
                sizes = np.array(row["sizes"]) - 1
                first = np.cumsum(sizes) - sizes
                context = np.concatenate([single[:1], single[:-1]])  # a token's context is the token before it
                context[first] = row["lead"]
                mix = weights[bucket(context)]
                p = mix[:, 0] * (pair / np.maximum(context, 1)) + mix[:, 1] * (single / max(1, n_train)) + mix[:, 2] / (words + 1)
                base = np.log10((single + 1) / (n_train + 1.0 * (words + 1)))
                add = lambda x: np.add.reduceat(np.append(x, 0), first) * (sizes > 0)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("docs")[i].values,
                        batch.column("rids")[i].values,
                        pa.array(sizes.astype(np.int64)),
                        pa.array(add((single > 0).astype(np.int64))),
                        pa.array(add(base)),
                        pa.array(add(np.log10(p))),
                    ],
                    names=["doc_id", "rid", "n_tokens", "n_known", "base_score", "score"],
                )

    kind = counted.schema["docs"].dataType.elementType.simpleString()
    return counted.drop("tally").mapInArrow(run, f"doc_id {kind}, rid long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", block_tokens: int | None = None, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """(doc_id, rid, n_tokens, n_known, train_tokens, base_score, score) for every row; ``train`` is a boolean column.

    A null or blank text is its end alone. Repeated rows count and score each. Without
    training rows every estimate is uniform. Texts of any length are read whole, in segments; an empty table gives an empty one. Other columns are
    not read. Unless ``block_tokens`` is given, blocks follow the size of the texts.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if block_tokens is None:
        size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
        block_tokens = min(MOST_BLOCK_TOKENS, max(BLOCK_TOKENS, size // (6 * BLOCKS)))  # a token takes some six bytes
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = materialise(
        rows.mapInArrow(
            lambda batches: _blocks(batches, block_tokens, segment_tokens),
            f"block long, tokens long, train_tokens long, train_docs long, docs array<{kind}>, rids array<long>, train array<boolean>, sizes array<int>, ids binary, words binary",
        )
    )
    sums = blocks.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_docs")).first()
    tokens, n_train, n_docs = (x or 0 for x in sums)
    if not tokens:
        return rows.select("doc_id", "rid", *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")], *[F.lit(0.0).alias(c) for c in ("base_score", "score")])
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // RANGE_TOKENS))
    asks = _asks(blocks, ranges)
    answers = materialise(asks.groupBy("range").applyInArrow(_answer, "block long, range int, counts binary, words long"))
    words = answers.where("block = -1").agg(F.sum("words")).first()[0] or 0
    counted = materialise(_count_blocks(blocks, answers.where("block >= 0").select("block", "range", "counts"), n_train, n_docs))
    tallies = counted.select(F.inline("tally")).groupBy("key").agg(F.sum("events"), F.sum("pair"), F.sum("single")).collect()  # bins, not events
    weights = learn_weights([tuple(t) for t in tallies], words)
    scored = _score_blocks(counted, weights, n_train, words).groupBy("doc_id", "rid")
    return scored.agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]).withColumn("train_tokens", F.lit(n_train).cast("long"))


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, trained on six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2
    scored = score_documents(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
