"""Search by shared words: exact counts of what queries and rows share, in a grid of blocks, without listing pairs.

Both sides are packed into blocks where they are read: rows as postings of their words' hashes, sorted, queries as their hashes. A task
takes a block of queries and a share of the rows; it adds up the postings of some queries at a time in a small table of counts
and keeps what is best, or what reaches a least count. Time grows with queries times rows, as the job is; memory doesn't, and no pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.operators.durable import bound_batches, written

#: Queries of a block, rows of a block, and words of either at most (8 bytes each); a row of more words is a block of its own.
QUERY_BLOCK, ROW_BLOCK, BLOCK_WORDS = 2048, 8192, 1 << 20
#: Rows that one task of the grid reads; fewer if tasks would be fewer than cores.
TASK_ROWS = 500_000
#: Cells of a table of counts, and postings that are added to it at a time.
CELLS, ADDED = 1 << 21, 1 << 21


def by_rarity(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, ordered): each query's distinct words that some row holds, rarest first, as (n, word). ``queries`` has query_id and words, ``rows`` id and words."""
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    held = rows.select(F.explode(F.array_distinct("words")).alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(held, "word").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ordered"))


def _hashed(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, h): the 64-bit hashes of each row's distinct words, none of null words."""
    words = F.array_distinct(F.transform(F.array_compact("words"), lambda w: F.xxhash64(w)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(words, F.array().cast("array<long>")).alias("h"))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sizes, hashes) of at most ``most`` rows and BLOCK_WORDS words, of which a single row may have more. Rows without words go."""
    ids, sizes, hashes, rows, words = [], [], [], 0, 0
    for batch in batches:
        each = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        own, ends = batch.column(0).to_numpy()[each > 0], np.concatenate([[0], np.cumsum(each[each > 0])])
        flat, i = batch.column(1).flatten().to_numpy(), 0
        while i < len(own):
            j = min(len(own), i + most - rows, int(np.searchsorted(ends, ends[i] + BLOCK_WORDS - words, "right")) - 1)
            if j <= i and not rows:
                j = i + 1
            if j > i:
                ids.append(own[i:j])
                sizes.append(np.diff(ends[i : j + 1]))
                hashes.append(flat[ends[i] : ends[j]])
                rows, words, i = rows + j - i, words + int(ends[j] - ends[i]), j
            if i < len(own):
                yield np.concatenate(ids), np.concatenate(sizes), np.concatenate(hashes)
                ids, sizes, hashes, rows, words = [], [], [], 0, 0
    if rows:
        yield np.concatenate(ids), np.concatenate(sizes), np.concatenate(hashes)


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(block, ids, words, ends, places): each distinct hash of a block's rows, sorted, where its postings end, and the places of the rows that hold it. Rows are in order of their ids."""
    task = TaskContext.get().partitionId() << 32
    for n, (ids, sizes, hashes) in enumerate(_blocks(batches, most)):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        places = np.repeat(place, sizes)
        by = np.lexsort((places, hashes))
        words, first = np.unique(hashes[by], return_index=True)
        parts = (ids[order].astype(np.int64), words, np.append(first[1:], len(by)).astype(np.int64), places[by])
        yield pa.RecordBatch.from_arrays([pa.array([task + n]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["block", "ids", "words", "ends", "places"])


_PACKED = "block long, ids binary, words binary, ends binary, places binary"


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _tables(asked: tuple, held: tuple) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, counts) of some queries of a block at a time: how many hashes each shares with every row of the other block."""
    (q_ids, q_words, q_ends, q_places), (ids, words, ends, _) = asked, held
    at = np.minimum(np.searchsorted(words, q_words), len(words) - 1)
    first = np.where(at > 0, ends[at - 1], 0)
    size = np.where(words[at] == q_words, ends[at] - first, 0)
    # from words with their queries to queries with their words that the rows have
    word = np.repeat(np.arange(len(q_words)), np.diff(q_ends, prepend=0))
    known = size[word] > 0
    order = np.argsort(q_places[known], kind="stable")
    word, query = word[known][order], q_places[known][order]
    begin = np.searchsorted(query, np.arange(len(q_ids) + 1))
    cost = np.concatenate([[0], np.cumsum(size[word])])[begin]
    low, high = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    i, most = 0, max(1, CELLS // len(ids))
    while i < len(q_ids):
        j = max(i + 1, min(len(q_ids), i + most, int(np.searchsorted(cost, cost[i] + ADDED, "right")) - 1))
        if cost[j] > cost[i]:
            w, q = word[begin[i] : begin[j]], query[begin[i] : begin[j]].astype(np.int64) - i
            cell = held[3][_spread(first[w], size[w])] + np.repeat(q * len(ids), size[w])
            counts = np.bincount(cell, minlength=(j - i) * len(ids)).reshape(j - i, len(ids))
            for r in np.flatnonzero(high[i:j] > low[i:j]):  # the query itself
                counts[r, low[i + r] : high[i + r]] = 0
            yield i, j, counts
        i = j


class _Best:
    """The rows of a block's queries that share most so far, best first, ties by smaller id."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.query, self.hits, self.found = (np.zeros(0, np.int64) for _ in range(3))
        self.bound = np.ones(len(ids), np.int64)  # hits of each query's last place

    def add(self, i: int, j: int, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        least = self.bound[i:j]
        if counts.shape[1] > self.k and np.count_nonzero(counts >= least[:, None]) > 4 * self.k * (j - i):
            least = np.maximum(least, np.partition(counts, counts.shape[1] - self.k, axis=1)[:, counts.shape[1] - self.k])
        q, c = np.nonzero(counts >= least[:, None])
        return q + i, counts[q, c], ids[c]

    def keep(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        query, hits, found = (np.concatenate([own, *new]) for own, new in zip((self.query, self.hits, self.found), zip(*parts, strict=True), strict=True))
        order = np.lexsort((found, -hits, query))
        query, hits, found = query[order], hits[order], found[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.hits, self.found = query[rank < self.k], hits[rank < self.k], found[rank < self.k]
        last = rank == self.k - 1
        self.bound[query[last]] = hits[last]


def _read(row: tuple) -> tuple:
    return tuple(np.frombuffer(x.as_py(), kind) for x, kind in zip(row, (np.int64, np.int64, np.int64, np.int32), strict=True))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, tuple]]:
    for batch in batches:
        for block, *row in zip(*batch.columns, strict=True):
            yield block.as_py(), _read(row[:4]), _read(row[4:])


def _out(query: np.ndarray, found: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (query, found, hits)], names=["query_id", "id", "hits"])


def _best_of(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for block, asked, held in _pairs(batches):
            mine = best.setdefault(block, _Best(asked[0], k))
            parts = [mine.add(i, j, counts, held[0]) for i, j, counts in _tables(asked, held)]
            if parts:
                mine.keep(parts)
        for mine in best.values():
            yield _out(mine.ids[mine.query], mine.found, mine.hits)

    return run


def _all_of(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, asked, held in _pairs(batches):
            for i, _, counts in _tables(asked, held):
                q, c = np.nonzero(counts >= max(least, 1))
                if len(q):
                    yield _out(asked[0][q + i], held[0][c], counts[q, c])

    return run


def _grid(queries: DataFrame, rows: DataFrame, run: Callable) -> DataFrame:
    """(query_id, id, hits) of what ``run`` leaves of every pair of blocks."""
    spark = rows.sparkSession
    bound_batches(spark)
    asked = written(_hashed(queries, "query_id"))
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("h")), F.lit(0)).alias("words")).first()
    blocks = max(1, -(-sizes.n // QUERY_BLOCK), -(-sizes.words // BLOCK_WORDS))
    asked = written(asked.repartition(blocks).mapInArrow(lambda b: _packed(b, QUERY_BLOCK), _PACKED))
    held = written(_hashed(rows, "id").mapInArrow(lambda b: _packed(b, ROW_BLOCK), _PACKED).select(*[F.col(c).alias(f"own_{c}") for c in ("ids", "words", "ends", "places")]))
    each = F.length("own_ids") / 8
    n = held.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    tasks = int(max(1, -(-n // TASK_ROWS), -(-spark.sparkContext.defaultParallelism // blocks)))
    # one partition of the product for each partition of either side
    grid = asked.repartition(blocks).crossJoin(held.repartition(tasks))
    return grid.mapInArrow(run, "query_id long, id long, hits long")


def top_shared(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, hits): the ``k`` other rows that share most distinct words with each query, ties by smaller id; rows that share none don't count.

    ``queries`` has query_id and an array of words, ``rows`` id and words. Null words and null arrays match nothing. Ids must not repeat.
    Words are compared by 64-bit hashes.
    """
    found = _grid(queries, rows, _best_of(k)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("less"), "id"))).alias("top"))
    return found.select("query_id", F.posexplode(F.slice("top", 1, k)).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("hit.id").alias("id"), (-F.col("hit.less")).alias("hits"))


def sharing(queries: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(query_id, id, hits) of all other rows that share at least ``least`` distinct words with a query. See ``top_shared``."""
    return _grid(queries, rows, _all_of(least))
