"""Byte-level BPE by Spark higher-order functions over distinct pieces.

Texts are cut by the tokenizer's pattern; each block of texts sends its distinct pieces
to the ranges of hashes that own them, so a piece is folded once for the whole corpus.
The fold over its byte array merges the pair of lowest rank until none is left, inside
Spark expressions with the ranks as a literal table. Blocks get the ids back and put their
documents together; decoding concatenates the binary pieces of ids. Texts themselves
are read once and never shuffled: blocks travel as numbers of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glosswork.llm import vocab
from glosswork.llm.common import bound_batches, table

#: Characters of text that make a block, at least and at most (blocks grow with the corpus, so that it makes about BLOCKS of them); a longer text is a block of its own.
BLOCK_CHARS, MOST_BLOCK_CHARS, BLOCKS = 10 << 20, 64 << 20, 4096
#: Characters of the corpus for each range of hashes; there are as many ranges at least as shuffle partitions.
RANGE_CHARS = 5 << 20
#: Bytes of a piece up to which it is folded as it is; a longer one is cut where no merge can reach across.
WHOLE = 48
#: Bytes of an uncuttable piece beyond which the fold's quadratic copying gives way to the library's merge loop.
LONGEST = 2048
#: Rank that stands for no merge; ids lie below.
NONE = 65_536
#: Sizes (primes) of the two halves of the pair table.
P1, P2 = 150_001, 173_021


def pair_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Merges as a two-choice hash table: entry (left * 65536 + right) * 65536 + merged at one of two places, -1 where free.

    Any two pieces whose concatenation is a piece may merge, at that piece's rank.
    """
    if max(ranks.values()) >= NONE:
        raise ValueError("ids must lie below 65536")
    slots = np.full(P1 + P2, -1, np.int64).tolist()
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is None or right is None:
                continue
            entry, at = (left * 65536 + right) * 65536 + rank, None
            for _ in range(10_000):
                key = entry >> 16
                places = (key % P1, P1 + key % P2)
                at = places[0] if at is None or at != places[0] else places[1]
                entry, slots[at] = slots[at], entry
                if entry < 0:
                    break
            else:
                raise ValueError("the pair table is too full")
    return np.array(slots, np.int64)


def cut_table(ranks: dict[bytes, int]) -> np.ndarray:
    """For each pair of adjacent bytes (first * 256 + second), whether some piece holds it; elsewhere no merge reaches across."""
    held = np.zeros(65536, bool)
    for piece in ranks:
        b = np.frombuffer(piece, np.uint8).astype(np.int64)
        held[b[:-1] * 256 + b[1:]] = True
    return held


def cut(piece: bytes, held: np.ndarray) -> list[bytes]:
    """Parts of a long piece that merge each on their own."""
    b = np.frombuffer(piece, np.uint8).astype(np.int64)
    at = (np.flatnonzero(~held[b[:-1] * 256 + b[1:]]) + 1).tolist()
    return [piece[i:j] for i, j in zip([0, *at], [*at, len(piece)], strict=True)]


def _lookup(left: str, right: str) -> str:
    """SQL for the rank of a merge; ``pairs`` is the literal table."""
    key = f"({left} * 65536L + {right})"
    first, second = f"pairs[cast({key} % {P1} as int)]", f"pairs[cast({P1} + {key} % {P2} as int)]"
    return f"cast(if(shiftright({first}, 16) = {key}, {first} & 65535, if(shiftright({second}, 16) = {key}, {second} & 65535, {NONE}L)) as int)"


def encode_sql(ids: str) -> str:
    """SQL that folds an array of byte ids (a lambda variable) into the array of ids left after all merges; names ``pairs``."""
    ranks = f"transform(array_repeat(0, size({ids}) - 1), (x, i) -> {_lookup(f'{ids}[i]', f'{ids}[i + 1]')})"
    left = f"if(p > 1, array({_lookup('a.ids[p - 2]', 'm')}), cast(array() as array<int>))"
    right = f"if(p + 1 < size(a.ids), array({_lookup('m', 'a.ids[p + 1]')}), cast(array() as array<int>))"
    merged = (
        "named_struct('ids', concat(slice(a.ids, 1, p - 1), array(m), slice(a.ids, p + 2, size(a.ids))), "
        f"'ranks', concat(slice(a.ranks, 1, greatest(p - 2, 0)), {left}, {right}, slice(a.ranks, p + 2, size(a.ids))))"
    )
    step = f"transform(array(array_min(a.ranks)), m -> if(m is null or m = {NONE}, a, transform(array(cast(array_position(a.ranks, m) as int)), p -> {merged})[0]))[0]"
    return f"aggregate(array_repeat(0, size({ids}) - 1), named_struct('ids', {ids}, 'ranks', {ranks}), (a, x) -> {step}, a -> a.ids)"


class _Numbers(dict):
    """Numbers for keys in order of first sight."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class _Cutter:
    """Cuts texts into pieces by the pattern, and pieces into the parts that are folded."""

    def __init__(self, pattern: str, data: bytes) -> None:
        self.find = regex.compile(pattern).findall
        ranks = vocab.ranks_of_tiktoken(data)
        self.held = cut_table(ranks)

    def parts(self, piece: str) -> list[bytes]:
        b = piece.encode()
        return [b] if len(b) <= WHOLE else cut(b, self.held)


def shrink(values: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers, compressed."""
    planes = np.ascontiguousarray(values.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def grow(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 34), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int32)


def unbundle(lengths: bytes, data: bytes) -> list[bytes]:
    """Byte strings from their lengths and their bytes end to end, both compressed."""
    ends = np.cumsum(grow(lengths)).tolist()
    whole = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 34)
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, data: bytes, block_chars: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: its documents, each one's pieces by number, and the parts of its distinct pieces in the order of their hashes.

    ``places`` says where each part went, ``cuts`` how many parts fall to each range.
    """
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    cutter, key_type, task, count = _Cutter(pattern, data), pa.int64(), TaskContext.get().partitionId() << 32, 0
    number, docs, orders, chars = _Numbers(), [], [], 0

    def out() -> pa.RecordBatch:
        parts, begin = [], [0]
        for word in number:
            parts += cutter.parts(word)
            begin.append(len(parts))
        hashes = np.array([xxhash.xxh64_intdigest(p) for p in parts], np.uint64)
        order = np.argsort(hashes, kind="stable")
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        cuts = np.diff([0, *np.searchsorted(hashes[order], bounds).tolist(), len(order)])
        parts = [parts[k] for k in order.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task + count]),
                pa.array([docs], pa.list_(key_type)),
                pa.array([[len(o) for o in orders]], pa.list_(pa.int32())),
                pa.array([shrink(np.concatenate(orders)) if orders else b""], pa.binary()),
                pa.array([shrink(np.diff(begin))], pa.binary()),
                pa.array([shrink(places)], pa.binary()),
                pa.array([shrink(cuts)], pa.binary()),
                pa.array([shrink(np.fromiter(map(len, parts), np.int64, len(parts)))], pa.binary()),
                pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(parts))], pa.binary()),
            ],
            names=["block", "docs", "sizes", "orders", "split", "places", "cuts", "lengths", "parts"],
        )

    for batch in batches:
        key_type = batch.schema.field("doc_id").type
        for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = value.as_py() or ""
            pieces = cutter.find(text)
            docs.append(doc)
            orders.append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)))
            chars += len(text) + 1
            if chars >= block_chars:
                yield out()
                number, docs, orders, chars, count = _Numbers(), [], [], 0, count + 1
    if docs:
        yield out()


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and range of hashes: the block's parts there."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, cuts, lengths = batch.column("block")[i].as_py(), grow(batch.column("cuts")[i].as_py()), grow(batch.column("lengths")[i].as_py())
            whole = zstandard.ZstdDecompressor().decompress(batch.column("parts")[i].as_py(), max_output_size=1 << 34)
            ends, at = np.cumsum(cuts).tolist(), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            pack, rows = zstandard.ZstdCompressor(level=1).compress, []
            for r in np.flatnonzero(cuts).tolist():  # a cell holds a part at least, so cells never outnumber them
                a, b = ends[r] - int(cuts[r]), ends[r]
                rows.append((r, block, shrink(lengths[a:b]), pack(whole[at[a] : at[b]])))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["range", "block", "lengths", "parts"])


def _distinct(asked: pa.Table, byte_ids: list[int]) -> pa.Table:
    """One row for a range: byte ids of its distinct parts, and for each block which of them it asked for, in its order."""
    number: dict[bytes, int] = {}
    who = []
    for lengths, parts in zip(asked.column("lengths").to_pylist(), asked.column("parts").to_pylist(), strict=True):
        who.append(shrink(np.array([number.setdefault(p, len(number)) for p in unbundle(lengths, parts)])))
    long = {i: p for p, i in number.items() if len(p) > LONGEST}
    short = [b"" if i in long else p for p, i in number.items()]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in short])]).astype(np.int32)
    flat = np.array(byte_ids, np.int32)[np.frombuffer(b"".join(short), np.uint8)]
    return pa.table(
        {
            "range": asked.column("range").slice(0, 1),
            "words": pa.ListArray.from_arrays(pa.array([0, len(short)], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))),
            "blocks": pa.array([asked.column("block").to_pylist()], pa.list_(pa.int64())),
            "who": pa.array([who], pa.list_(pa.binary())),
            "long": pa.array([list(long.values())], pa.list_(pa.binary())),
            "long_at": pa.array([list(long)], pa.list_(pa.int32())),
        }
    )


def _replies(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[pa.RecordBatch]:
    """A row for each block and range: the ids of the parts it asked for, as counts and numbers."""
    for batch in batches:
        for i in range(batch.num_rows):
            listed = batch.column("ids")[i].values
            begin = np.asarray(listed.offsets, np.int64)  # offsets count from the start of the unsliced values
            flat = listed.values.to_numpy(zero_copy_only=False)
            if long := batch.column("long")[i].as_py():
                parts = [flat[a:b] for a, b in zip(begin, begin[1:], strict=False)]
                for j, raw in zip(batch.column("long_at")[i].as_py(), long, strict=True):
                    parts[j] = np.array(vocab.encoding(data)._core_bpe.encode_single_piece(raw), np.int32)
                flat, begin = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            many, rows = np.diff(begin), []
            for block, who in zip(batch.column("blocks")[i].as_py(), batch.column("who")[i].as_py(), strict=True):
                at = grow(who)
                n = many[at]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows.append((block, batch.column("range")[i].as_py(), shrink(n), shrink(flat[np.repeat(begin[at], n) + inner])))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["block", "range", "counts", "ids"])


def _finish(block: pa.Table, replies: pa.Table, by_id: list[bytes], with_ids: bool, key_type: pa.DataType) -> pa.Table:
    """Documents of a block, from its numbers of pieces and the ids of its parts."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kinds = [key_type, pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * with_ids]
    cols: list[list] = [[] for _ in names]
    text = list(map(str, range(len(by_id))))
    for row in block.to_pylist():
        places = grow(row["places"])
        order = np.empty(len(places), np.int64)
        order[places] = np.arange(len(places))
        cells = sorted(zip(replies.column("range").to_pylist(), replies.column("counts").to_pylist(), replies.column("ids").to_pylist(), strict=True))
        n = np.concatenate([grow(c[1]) for c in cells]) if cells else np.zeros(0, np.int32)
        if len(n) != len(order):
            raise ValueError(f"a block asked for {len(order)} parts and got {len(n)}")
        flat = np.concatenate([grow(c[2]) for c in cells]).tolist() if cells else []
        ends = np.cumsum(n).tolist()
        words, raw = list(map(text.__getitem__, flat)), list(map(by_id.__getitem__, flat))
        line_of, bytes_of, count_of = [""] * len(order), [b""] * len(order), np.zeros(len(order), np.int64)
        count_of[order] = n
        for k, a, b in zip(order.tolist(), [0, *ends], ends, strict=False):
            line_of[k], bytes_of[k] = " ".join(words[a:b]), b"".join(raw[a:b])
        split = grow(row["split"])
        if len(split) != len(order):  # pieces that were cut
            ends = np.cumsum(split)
            begin = (ends - split).tolist()
            count_of = np.add.reduceat(count_of, begin)
            ends = ends.tolist()
            line_of = [" ".join(line_of[a:b]) for a, b in zip(begin, ends, strict=True)]
            bytes_of = [b"".join(bytes_of[a:b]) for a, b in zip(begin, ends, strict=True)]
        numbers, at = grow(row["orders"]) if row["orders"] else np.zeros(0, np.int32), 0
        for doc, size in zip(row["docs"], row["sizes"], strict=True):
            own = numbers[at : at + size]
            at += size
            seq = own.tolist()
            line = " ".join([line_of[k] for k in seq])
            values = [doc, int(count_of[own].sum()), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(b"".join([bytes_of[k] for k in seq])).hexdigest()]
            if with_ids:
                values.append([int(x) for x in line.split()])
            for c, v in zip(cols, values, strict=True):
                c.append(v)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, block_chars: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) for every row and whole text.

    Null counts as empty and has no ids. Rows that repeat are encoded each. Texts of any length are encoded whole; an empty table
    gives an empty one. Other columns are not read. Unless ``block_chars`` is given, blocks follow the size of the texts, and so do ranges of hashes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    file = vocab.share(spark, ranks_file)
    ranks = vocab.ranks_of_tiktoken(file.value)
    pieces = {r: p for p, r in ranks.items()}
    by_id = spark.sparkContext.broadcast([pieces.get(i, b"") for i in range(max(pieces) + 1)])
    byte_ids = [ranks[bytes([b])] for b in range(256)]
    chars = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS)
    block_chars = block_chars or min(MOST_BLOCK_CHARS, max(BLOCK_CHARS, chars // BLOCKS))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    key_type = to_arrow_type(kind)
    kind = kind.simpleString()
    blocks = rows.mapInArrow(
        lambda b: _blocks(b, pattern, file.value, block_chars, ranges),
        f"block long, docs array<{kind}>, sizes array<int>, orders binary, split binary, places binary, cuts binary, lengths binary, parts binary",
    ).repartition(ranges, "block")  # one exchange, read for the asks and again for the documents
    asks = blocks.mapInArrow(_asks, "range int, block long, lengths binary, parts binary")
    distinct = asks.repartition(ranges, "range").groupBy("range").applyInArrow(
        lambda t: _distinct(t, byte_ids), "range int, words array<array<int>>, blocks array<long>, who array<binary>, long array<binary>, long_at array<int>"
    )
    literal = spark.createDataFrame([(pair_table(ranks).tolist(),)], "pairs array<bigint>")
    folded = distinct.withColumn("pairs", literal.scalar()).withColumn("ids", F.expr(f"transform(words, w -> {encode_sql('w')})")).drop("words", "pairs")
    replies = folded.mapInArrow(lambda b: _replies(b, file.value), "block long, range int, counts binary, ids binary")
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda left, right: _finish(left, right, by_id.value, with_ids, key_type), schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
