"""Sum-of-squares online packing of token ids into windows of fixed length.

Documents come as a stream. What exceeds whole windows is an item; an item of
size s goes to the fill level h whose change h -> h + s (or a new window) leaves the least
sum of squared counts of partially filled windows, which a level array holds. Where an item doesn't fit, its first
part may fill a window up; that is a choice like any other, at a price of CUT on the same sum.
Counts of a level can't grow much beyond the price then, so open windows are bounded by it and the levels.
Every task packs its own stream and leaves one window at most that isn't full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import vocab
from glosswork.llm.common import bound_batches, table

WINDOW = 1024
END = 0
#: What cutting an item costs, in the sum of squares.
CUT = 8
#: Pieces that a task gathers before it hands them on, and with their ids (a window each at most).
PIECES, PIECES_WITH_IDS = 20_000, 2_000


class Packer:
    """Packs a stream of id arrays; ``closed`` collects the pieces of windows that are full."""

    def __init__(self, window: int = WINDOW, cut: int = CUT) -> None:
        self.window, self.cut = window, cut
        self.count = np.zeros(window + 1, np.int64)  # windows at each level
        self.open: list[list[list]] = [[] for _ in range(window + 1)]  # their pieces
        self.n_open = self.sequences = 0
        self.closed: list[tuple] = []

    def level_for(self, size: int) -> int:
        """Level to fill up (0: a new window) for the least sum of squares; ties go to a whole item, then to the fullest.

        At a level that the item passes, its first part fills the window and the rest counts as a window of its own.
        """
        w, n = self.window, self.count
        change = np.full(w, np.iinfo(np.int64).max)
        change[0] = 2 * n[size] + 1
        held = np.flatnonzero(n[1:w]) + 1
        fits, over = held[held <= w - size], held[held > w - size]
        change[fits] = 2 * (n[fits + size] - n[fits] + 1)
        change[w - size] = 1 - 2 * n[w - size] if n[w - size] else change[w - size]  # a window that is full leaves the count
        change[over] = 2 - 2 * n[over] + 2 * n[size + over - w] + self.cut
        whole = change[: w - size + 1]
        best = w - size - int(np.argmin(whole[::-1]))
        if len(over) and change[over].min() < change[best]:
            best = int(over[len(over) - 1 - int(np.argmin(change[over][::-1]))])
        return best

    def add(self, key, ids: np.ndarray) -> None:
        w, start = self.window, 0
        while len(ids) - start >= w:
            self._close([(key, start, ids[start : start + w], len(ids))])
            start += w
        if start < len(ids):
            self._place(key, start, ids[start:], len(ids))

    def _place(self, key, start: int, ids: np.ndarray, total: int) -> None:
        level = self.level_for(len(ids))
        gap = self.window - level
        self._put(level, key, start, ids[:gap], total)
        if gap < len(ids):
            self._place(key, start + gap, ids[gap:], total)

    def _put(self, level: int, key, start: int, ids: np.ndarray, total: int) -> None:
        pieces: list = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        pieces.append((key, start, ids, total))
        if (level := level + len(ids)) == self.window:
            return self._close(pieces)
        self.open[level].append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def _close(self, pieces: list) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.closed.append((key, start, ids, total, self.sequences, offset))
            offset += len(ids)
        self.sequences += 1

    def finish(self) -> None:
        """Lay what open windows hold end to end, cut at window ends; one window at most stays short."""
        rest = [x for level in reversed(self.open) for pieces in level for x in pieces]
        row, filled = [], 0
        for key, start, ids, total in rest:
            while len(ids):
                part = ids[: self.window - filled]
                row.append((key, start, part, total))
                filled, start, ids = filled + len(part), start + len(part), ids[len(part) :]
                if filled == self.window:
                    self._close(row)
                    row, filled = [], 0
        if row:
            self._close(row)
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.n_open = 0

    def take(self) -> list[tuple]:
        out, self.closed = self.closed, []
        return out


def padding(filled: int, window: int = WINDOW) -> int:
    """Pad ids of a sequence: up to the window, none at a power of two."""
    return 0 if filled and filled & (filled - 1) == 0 else window - filled


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is its ids and the end id; a null or empty text is the end id alone, and
    rows that repeat are packed each; an empty table gives no pieces. No shuffle: each task packs the rows it reads, in memory bounded by its open windows
    and its longest text, and a task run again does the same. sequence_id is the task's number above 33 bits
    of the task's own count. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    file = vocab.share(spark, tokenizer)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, data, most = Packer(window), file.value, PIECES_WITH_IDS if with_ids else PIECES
        base = TaskContext.get().partitionId() << 33
        key_type = None

        def out() -> Iterator[pa.RecordBatch]:
            every = packer.take()
            yield from (made(every[i : i + most]) for i in range(0, len(every), most))

        def made(found: list[tuple]) -> pa.RecordBatch:
            cols = [
                pa.array([x[0] for x in found], key_type),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([len(x[2]) for x in found], pa.int64()),
                pa.array([zlib.crc32(x[2]) for x in found], pa.int64()),
                pa.array([x[3] for x in found], pa.int64()),
                pa.array([base + x[4] for x in found], pa.int64()),
                pa.array([x[5] for x in found], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.cumsum([0, *(len(x[2]) for x in found)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[2] for x in found]).astype(np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = vocab.encode_like_tokenizers(data, text.as_py())
                ids.append(END)
                packer.add(key, np.array(ids, "<u4"))
                if len(packer.closed) >= most:
                    yield from out()
            yield from out()
        packer.finish()
        yield from out()

    return rows.mapInArrow(run, schema)


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
