"""Alignment of two tokenizers' tokens by a sweep over where tokens end.

Both tokenizers read each text; where their tokens end are events (document, side, byte offset,
id), which travel as frames: one side's events within FRAME bytes of a document. Frames are
partitioned by document and sorted by offset, and a machine reads them in that order. All it keeps from one
frame to the next is the open group: tokens after the last offset where both sides ended. Where both end, a group closes,
and each of its A tokens is linked to each of its B tokens.

How many documents hold a linked pair is counted without bringing a pair's documents together: a block
of documents sends each distinct pair once, with its count, to the range of hashes that
owns it and gets the corpus count back; the highest count of each A id is a table no larger than a vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glosswork.llm import vocab
from glosswork.llm.common import bound_batches, grow, materialise, shrink, table

#: Bytes of a document whose events make one frame of a side.
FRAME = 1 << 16
#: Characters of text for each partition of the sweep; there are as many at least as shuffle partitions.
PART_CHARS = 16 << 20
#: Distinct links of a block's documents, at least and at most (blocks grow with the corpus, so that it makes about BLOCKS of them); a document lies in one block.
BLOCK_LINKS, MOST_BLOCK_LINKS, BLOCKS = 3_000_000, 8_000_000, 4096
#: Links of the corpus for each range of hashes; there are as many at least as shuffle partitions.
RANGE_LINKS = 20_000_000
#: Characters of text that are encoded at a time, and bytes of packed events that are swept at a time; a longer text or frame is taken alone.
GROUP_CHARS, SWEPT_BYTES = 1 << 20, 1 << 19
#: Links of one group beyond which its pairs are counted by distinct ids instead of listed.
LISTED = 4096
#: Ids lie below this.
IDS = 1 << 16
A, B = 0, 1

Encoder = Callable[[list[str]], list[list[int]]]

_SQUEEZE, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # one of each for a process: their buffers cost more than a frame


def byte_side(data: bytes) -> tuple[Encoder, list[bytes]]:
    """A byte-level tokenizer file as an encoder of space + text, strings of reserved entries being plain text, and the bytes of its ids."""
    enc = vocab.encoding(data)
    ranks = vocab.ranks_of_json(data)

    def one(text: str) -> list[int]:
        try:
            return enc.encode_ordinary(text)
        except BaseException as e:  # the matcher gives up on very long white space; its panic isn't an Exception
            if (type(e).__module__, type(e).__name__) != vocab.PANIC:
                raise
            return vocab.plain_library(data).encode(text, add_special_tokens=False).ids

    by_id = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        by_id[i] = piece
    return lambda texts: [one(" " + t) for t in texts], by_id


def piece_side(data: bytes) -> tuple[Encoder, list[bytes]]:
    """A sentence-piece model as an encoder of texts (it adds the space), and the bytes of its ids."""
    key = ("pieces", vocab._digest(data))
    if key not in vocab._built:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        by_id = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
        vocab._built[key] = (lambda texts: model.encode(texts, out_type=int, num_threads=1), by_id)
    return vocab._built[key]


def _pack(ends: np.ndarray, ids: np.ndarray) -> bytes:
    """Events of a frame: steps between ends and ids, as byte planes, compressed."""
    steps = np.diff(ends, prepend=0)
    wide = len(steps) > 0 and int(steps[1:].max(initial=0)) > 255
    # the first step counts from the document's start and goes ahead of the rest, which are short as a rule
    head = np.array([len(ends), steps[0] if len(steps) else 0, wide], np.int64).tobytes()
    rest = steps[1:].astype(np.uint32 if wide else np.uint8)
    low, high = (ids & 255).astype(np.uint8), (ids >> 8).astype(np.uint8)
    return head + _SQUEEZE.compress(rest.tobytes() + low.tobytes() + high.tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends and ids of a frame."""
    n, first, wide = np.frombuffer(data, np.int64, 3).tolist()
    raw = _EXPAND.decompress(data[24:], max_output_size=1 << 30)
    kind = np.dtype(np.uint32 if wide else np.uint8)
    cut = (n - 1) * kind.itemsize
    ends = np.cumsum(np.concatenate([[first], np.frombuffer(raw, kind, n - 1)]).astype(np.int64))
    return ends, np.frombuffer(raw, np.uint8, n, cut).astype(np.int32) | np.frombuffer(raw, np.uint8, n, cut + n).astype(np.int32) << 8


def _events(docs: DataFrame, a_file, b_file, id_col: str, text_col: str, frame_bytes: int) -> DataFrame:
    """(rid, doc_id, at, side, events): the frames of both sides in one stream; a document without tokens has one frame without events."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [byte_side(a_file.value), piece_side(b_file.value)]
        lengths = [np.fromiter(map(len, by_id), np.int64, len(by_id)) for _, by_id in sides]
        for batch in batches:
            rids, keys, texts = (batch.column(c) for c in ("rid", "doc_id", "text"))
            i = 0
            while i < batch.num_rows:
                group, size, first = [], 0, i
                while i < batch.num_rows and (not group or size < GROUP_CHARS):
                    group.append(texts[i].as_py() or "")
                    size += len(group[-1])
                    i += 1
                encoded = [encode([t for t in group if t]) for encode, _ in sides]
                at = iter(zip(*encoded, strict=True))
                out = []
                for k, text in enumerate(group, first):
                    rid, found = rids[k].as_py(), next(at) if text else ([], [])
                    whole = b" " + text.encode()
                    ids_of = [np.array(ids, np.int32) for ids in found]
                    ends_of = [np.cumsum(n[ids]) for n, ids in zip(lengths, ids_of, strict=True)]
                    if not text or any(ends[-1] != len(whole) or (check and b"".join(map(by_id.__getitem__, ids)) != whole) for ends, ids, (_, by_id), check in zip(ends_of, found, sides, (False, True), strict=True)):
                        out.append((rid, k, 0, A, b""))  # A's tokens are cut from the text's bytes: their length tells
                        continue
                    for side in (A, B):
                        ids, ends = ids_of[side], ends_of[side]
                        if len(whole) <= frame_bytes:
                            out.append((rid, k, 0, side, _pack(ends, ids)))
                            continue
                        frame = (ends - 1) // frame_bytes
                        cuts = np.flatnonzero(np.diff(frame)) + 1
                        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                            out.append((rid, k, int(frame[lo]), side, _pack(ends[lo:hi], ids[lo:hi])))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), keys.take(pa.array(cols[1])).cast(key_type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int8()), pa.array(cols[4], pa.binary())],
                    names=["rid", "doc_id", "at", "side", "events"],
                )

    return rows.mapInArrow(run, f"rid long, doc_id {kind.simpleString()}, at long, side byte, events binary")


@dataclass
class Closed:
    """Groups that closed: ids of both sides in order, and how many of each every group has; ends are byte offsets."""

    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    ends: np.ndarray


def close(ends_a: np.ndarray, a: np.ndarray, ends_b: np.ndarray, b: np.ndarray) -> tuple[Closed, tuple]:
    """Groups closed by these events, and the events left open."""
    at = np.searchsorted(ends_b, ends_a)
    both = np.zeros(len(ends_a), bool)
    inside = at < len(ends_b)
    both[inside] = ends_b[at[inside]] == ends_a[inside]
    last_a = np.flatnonzero(both)
    last_b = at[last_a]
    i, j = (int(last_a[-1]) + 1, int(last_b[-1]) + 1) if len(last_a) else (0, 0)
    done = Closed(a[:i], b[:j], np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1), ends_a[last_a])
    return done, (ends_a[i:], a[i:], ends_b[j:], b[j:])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of some SWEPT_BYTES at a time."""
    for batch in batches:
        ends = np.cumsum([len(x.as_buffer()) for x in batch.column("events")])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, SWEPT_BYTES + (ends[i - 1] if i else 0), "right")))
            yield batch.slice(i, j - i)
            i = j


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, Closed]]:
    """The machine: frames in order of document and offset become closed groups.

    Yields (documents, the document of each group, groups) for each batch, documents as (rid, key, whether it ends here). What is open
    at the end of a batch is carried to the next. Offsets of a batch are shifted document by document, so that one sweep serves them all.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int32))
    open_, doc, base = (*none, *none), None, 0  # the document that is being read, and what its offsets are shifted by

    for batch in _slices(batches):
        rids, keys, sides, events = batch.column("rid").to_pylist(), batch.column("doc_id"), batch.column("side").to_pylist(), batch.column("events")
        docs, bases, parts, top = [], [], ([open_[0:2]], [open_[2:4]]), int(max([base, *open_[0][-1:], *open_[2][-1:]]))
        if doc is not None:
            docs.append(doc)
            bases.append(base)
        for k, rid in enumerate(rids):
            if doc is None or rid != doc[0]:
                doc, base = (rid, keys[k].as_py()), top
                docs.append(doc)
                bases.append(base)
            data = events[k].as_py()
            if not data:
                continue
            ends, ids = _unpack(data)
            parts[sides[k]].append((ends + base, ids))
            top = max(top, base + int(ends[-1]))  # the next document's offsets lie beyond
        joined = [np.concatenate([p[c] for p in side]) for side in parts for c in (0, 1)]
        done, open_ = close(*joined)
        # a document's last end closes a group, so what is open is the last one's
        start = np.searchsorted(np.array(bases, np.int64), done.ends, "left") - 1
        done.ends = done.ends - np.array(bases, np.int64)[start] if len(bases) else done.ends
        yield docs, start, done
        shift = base  # offsets begin anew in the next batch
        open_ = (open_[0] - shift, open_[1], open_[2] - shift, open_[3])
        base = 0


def _sorted_events(docs: DataFrame, a_file: str, b_file: str, id_col: str, text_col: str, frame_bytes: int) -> tuple[DataFrame, int]:
    """Frames in the order that the machine reads them, and the characters of the corpus."""
    spark = docs.sparkSession
    bound_batches(spark)
    chars = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // PART_CHARS)
    events = _events(docs, vocab.share(spark, a_file), vocab.share(spark, b_file), id_col, text_col, frame_bytes)
    return events.repartition(parts, "rid").sortWithinPartitions("rid", "at", "side"), chars


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME) -> DataFrame:
    """(doc_id, row, group, start, end, a, b): the groups of every row, numbered from 0, with their byte ranges in space + text and the ids of both sides.

    Every A token of a group is linked to every B token of it. ``row`` tells rows apart whose ids repeat. Texts that are null, empty, or that a
    tokenizer doesn't give back byte by byte have no groups. Other columns are not read; ids may be of any type.
    """
    kind = docs.schema[id_col].dataType
    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        went: tuple = (None, 0, 0)  # document, next group, where it starts
        for found, of, done in _swept(batches):
            i = np.concatenate([[0], np.cumsum(done.a_of)]).astype(np.int32)
            j = np.concatenate([[0], np.cumsum(done.b_of)]).astype(np.int32)
            numbers, starts = [], []
            for d, end in zip(of.tolist(), done.ends.tolist(), strict=True):
                if went[0] != found[d][0]:
                    went = (found[d][0], 0, 0)
                numbers.append(went[1])
                starts.append(went[2])
                went = (went[0], went[1] + 1, end)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([found[d][1] for d in of.tolist()], key_type), pa.array([found[d][0] for d in of.tolist()], pa.int64()), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), pa.array(done.ends, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(i), pa.array(done.a, pa.int32())), pa.ListArray.from_arrays(pa.array(j), pa.array(done.b, pa.int32())),
                ],
                names=["doc_id", "row", "group", "start", "end", "a", "b"],
            )

    return _sorted_events(docs, a_file, b_file, id_col, text_col, frame_bytes)[0].mapInArrow(run, f"doc_id {kind.simpleString()}, row long, group long, start long, end long, a array<int>, b array<int>")


def linked(done: Closed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, group, times) of all links: pairs are a * IDS + b. Links of small groups are listed one by one, of others by distinct pair."""
    many = done.a_of * done.b_of
    first_a, first_b = np.cumsum(done.a_of) - done.a_of, np.cumsum(done.b_of) - done.b_of
    small = np.where(many <= LISTED, many, 0)
    group = np.repeat(np.arange(len(many)), small)
    inner = np.arange(len(group)) - np.repeat(np.cumsum(small) - small, small)
    wide = done.b_of[group]
    pairs = done.a[first_a[group] + inner // wide].astype(np.int64) * IDS + done.b[first_b[group] + inner % wide]
    times = np.ones(len(pairs), np.int64)
    more = [(pairs, group, times)]
    for g in np.flatnonzero(many > LISTED).tolist():
        x, nx = np.unique(done.a[first_a[g] : first_a[g] + done.a_of[g]], return_counts=True)
        y, ny = np.unique(done.b[first_b[g] : first_b[g] + done.b_of[g]], return_counts=True)
        p = (x.astype(np.int64)[:, None] * IDS + y[None, :]).ravel()
        more.append((p, np.full(len(p), g), (nx[:, None] * ny[None, :]).ravel()))
    return tuple(np.concatenate(c) for c in zip(*more, strict=True))


#: Every id followed by a comma, a bar, a semicolon or nothing.
_SIGNS = [f"{i}{s}" for s in (",", "|", ";", "") for i in range(IDS)]


def _written(done: Closed, of: np.ndarray) -> list[list[str]]:
    """For each document of ``of`` the texts of its tokens, each with the sign that follows it, in the order of groups, A before B."""
    group_a, group_b = np.repeat(np.arange(len(done.a_of)), done.a_of), np.repeat(np.arange(len(done.b_of)), done.b_of)
    last_a, last_b = np.cumsum(done.a_of), np.cumsum(done.b_of)
    flat = np.empty(len(done.a) + len(done.b), np.int64)
    sign_a, sign_b = np.zeros(len(done.a), np.int64), np.zeros(len(done.b), np.int64)
    sign_a[last_a - 1], sign_b[last_b - 1] = IDS, 2 * IDS
    flat[np.arange(len(done.a)) + (last_b - done.b_of)[group_a]] = done.a + sign_a
    flat[np.arange(len(done.b)) + last_a[group_b]] = done.b + sign_b
    text = list(map(_SIGNS.__getitem__, flat.tolist()))
    ends = (last_a + last_b)[np.flatnonzero(np.diff(of, append=-1))].tolist() if len(of) else []
    return [text[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def _blocks(batches: Iterator[pa.RecordBatch], key_type: pa.DataType, block_links: int) -> Iterator[pa.RecordBatch]:
    """A row for each block of documents: their columns so far, and each one's distinct pairs by number with how often it links them.

    ``pairs`` are the distinct pairs of the block, ordered by hash, and ``counts`` how many of its documents hold each.
    """
    task = None
    held: list[tuple] = []  # rid, key, n_a, n_b, n_groups, n_links, digest, pairs, times
    links = count = 0
    current: list | None = None

    def finish() -> None:
        nonlocal links
        rid, key, n_a, n_b, n_groups, n_links, digest, pairs, times = current
        pair, at = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_inverse=True)
        times = np.bincount(at, np.concatenate([np.zeros(0, np.int64), *times]), len(pair)).astype(np.int64)
        held.append((rid, key, n_a, n_b, n_groups, n_links, digest.hexdigest() if n_groups else "", pair, times))
        links += len(pair)

    def out() -> pa.RecordBatch:
        rids, keys, n_a, n_b, n_groups, n_links, digests, pairs, times = zip(*held, strict=True)
        flat = np.concatenate(pairs)
        distinct, number, docs = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(_hash(distinct), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # a document's pairs in the order of the block's: steps are small
        sizes = np.fromiter(map(len, pairs), np.int64, len(pairs))
        where = number.reshape(-1)
        steps = np.diff(where, prepend=0)
        steps[(np.cumsum(sizes) - sizes)[sizes > 0]] = where[(np.cumsum(sizes) - sizes)[sizes > 0]]
        cols = [
            pa.array([(task << 32) + count], pa.int64()), pa.array([sum(n_links)], pa.int64()), pa.array([list(rids)], pa.list_(pa.int64())), pa.array([list(keys)], pa.list_(key_type)),
            *(pa.array([list(c)], pa.list_(pa.int64())) for c in (n_a, n_b, n_groups, n_links)), pa.array([list(digests)], pa.list_(pa.string())), pa.array([sizes.tolist()], pa.list_(pa.int32())),
            pa.array([shrink(steps.astype(np.int32))], pa.binary()), pa.array([shrink(np.concatenate(times).astype(np.int64))], pa.binary()),
            pa.array([shrink(distinct[order])], pa.binary()), pa.array([shrink(docs[order].astype(np.int32))], pa.binary()), pa.array([shrink(place.astype(np.int32))], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["block", "links", "rids", "docs", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes", "numbers", "times", "pairs", "counts", "places"])

    for found, of, done in _swept(batches):
        if task is None:
            task = TaskContext.get().partitionId()
        pair, group, times = linked(done)
        texts = iter(_written(done, of))
        cut_a, cut_b = np.concatenate([[0], np.cumsum(done.a_of)]), np.concatenate([[0], np.cumsum(done.b_of)])
        bounds = np.searchsorted(of, np.arange(len(found) + 1))
        small = int((done.a_of * done.b_of)[done.a_of * done.b_of <= LISTED].sum())
        at_small = np.searchsorted(group[:small], bounds)
        at_large = small + np.searchsorted(group[small:], bounds)
        for d, (rid, key) in enumerate(found):
            if current is None or current[0] != rid:
                if current is not None:
                    finish()
                    if links >= block_links:
                        yield out()
                        held, links, count = [], 0, count + 1
                current = [rid, key, 0, 0, 0, 0, hashlib.sha256(), [], []]
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            if hi == lo:
                continue
            text = "".join(next(texts))
            current[6].update((";" + text[:-1] if current[4] else text[:-1]).encode())  # the last sign waits for the next group
            current[2] += int(cut_a[hi] - cut_a[lo])
            current[3] += int(cut_b[hi] - cut_b[lo])
            current[4] += hi - lo
            for x, y in ((at_small[d], at_small[d + 1]), (at_large[d], at_large[d + 1])):
                current[5] += int(times[x:y].sum())
                current[7].append(pair[x:y])
                current[8].append(times[x:y])
    if current is not None:
        finish()
    if held:
        yield out()


def _hash(pairs: np.ndarray) -> np.ndarray:
    """Spreads pairs over 64 bits, one to one."""
    with np.errstate(over="ignore"):
        x = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _asks(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, pairs, counts): what each block sends to each range of hashes."""
    limits = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, counts = grow(batch.column("pairs")[i].as_py(), np.int64), grow(batch.column("counts")[i].as_py(), np.int32)
                cut = [0, *np.searchsorted(_hash(pairs), limits).tolist(), len(pairs)]
                cells = [(r, batch.column("block")[i].as_py(), shrink(pairs[cut[r] : cut[r + 1]]), shrink(counts[cut[r] : cut[r + 1]])) for r in np.flatnonzero(np.diff(cut)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "block", "pairs", "counts"])

    return blocks.select("block", "pairs", "counts").mapInArrow(run, "range int, block long, pairs binary, counts binary")


def _answer(asked: pa.Table) -> pa.Table:
    """Corpus counts for every block that asked, and under block -1 the highest count of each A id in this range."""
    pairs = [grow(v, np.int64) for v in asked.column("pairs").to_pylist()]
    counts = np.concatenate([grow(v, np.int32) for v in asked.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.bincount(at, counts, len(distinct)).astype(np.int64)
    heads = np.flatnonzero(np.diff(distinct // IDS, prepend=-1))
    best = np.maximum.reduceat(total, heads)
    back, i, out = total[at], 0, []
    for p in pairs:
        out.append(shrink(back[i : i + len(p)]))
        i += len(p)
    return pa.table(
        {
            "block": pa.array([*asked.column("block").to_pylist(), -1], pa.int64()),
            "range": pa.array([asked.column("range")[0].as_py()] * (len(out) + 1), pa.int32()),
            "counts": pa.array([*out, b""], pa.binary()),
            "best": pa.array([None] * len(out) + [[{"a": a, "count": c} for a, c in zip((distinct[heads] // IDS).tolist(), best.tolist(), strict=True)]], pa.list_(pa.struct([("a", pa.int32()), ("count", pa.int64())]))),
        }
    )


def measure(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME, block_links: int | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    A pair's count is how many rows hold it linked; n_best are the links whose count is the highest of their A id, ties included, count_sum
    sums counts over links. Texts that are null, empty, or that a tokenizer doesn't give back byte by byte have zeros and an empty digest.
    Rows that repeat count each. Texts of any length are read whole: a document's distinct pairs are held at once. An empty table
    gives an empty one; ids of any type, nulls too, pass through; other columns are not read. Unless ``block_links`` is given, blocks
    follow the size of the texts.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    key_type, name = to_arrow_type(kind), kind.simpleString()
    lists = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    events, chars = _sorted_events(docs, a_file, b_file, id_col, text_col, frame_bytes)
    most = block_links or min(MOST_BLOCK_LINKS, max(BLOCK_LINKS, chars // (3 * BLOCKS)))  # a link takes some three characters
    blocks = materialise(
        events.mapInArrow(
            lambda b: _blocks(b, key_type, most), f"block long, links long, rids array<long>, docs array<{name}>, {lists}, digests array<string>, sizes array<int>, numbers binary, times binary, pairs binary, counts binary, places binary"
        )
    )
    links = blocks.agg(F.sum("links")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), links // RANGE_LINKS)
    answers = materialise(_asks(blocks, ranges).groupBy("range").applyInArrow(_answer, "block long, range int, counts binary, best array<struct<a: int, count: long>>"))
    highest = answers.where("block = -1").select(F.inline("best")).groupBy("a").agg(F.max("count")).collect()  # a row for each entry of a vocabulary at most
    table_ = np.zeros(IDS, np.int64)
    for a, c in highest:
        table_[a] = c
    best = spark.sparkContext.broadcast(table_)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(8)]
        for row in left.to_pylist():
            cells = sorted(zip(right.column("range").to_pylist(), right.column("counts").to_pylist(), strict=True))
            counts = np.concatenate([np.zeros(0, np.int64), *(grow(c, np.int64) for _, c in cells)])
            pairs, place, sizes = grow(row["pairs"], np.int64), grow(row["places"], np.int32), np.array(row["sizes"], np.int64)
            if len(counts) != len(pairs):
                raise ValueError(f"a block asked for {len(pairs)} pairs and got {len(counts)}")
            top = counts == best.value[pairs // IDS]
            steps, times = grow(row["numbers"], np.int32).astype(np.int64), grow(row["times"], np.int64)
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            run_up = np.cumsum(steps)
            where = place[run_up - np.repeat(run_up[first] - steps[first], sizes[sizes > 0])] if len(steps) else np.zeros(0, np.int64)
            for c, values in ((5, np.where(top[where], times, 0)), (6, counts[where] * times)):
                sums = np.zeros(len(sizes), np.int64)
                if len(first):
                    sums[sizes > 0] = np.add.reduceat(values, first)
                cols[c] += sums.tolist()
            for c, values in zip((0, 1, 2, 3, 4, 7), (row[n] for n in ("docs", "n_a", "n_b", "n_groups", "n_links", "digests")), strict=True):
                cols[c] += values
        kinds = [key_type, *[pa.int64()] * 6, pa.string()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    left = blocks.select("block", "docs", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes", "numbers", "times", "pairs", "places")
    return left.groupBy("block").cogroup(answers.where("block >= 0").select("block", "range", "counts").groupBy("block")).applyInArrow(
        run, f"doc_id {name}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def op11_event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level entries against sentence pieces."""
    import public_tokenizers

    return measure(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
