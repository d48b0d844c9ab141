"""Exact vector search in blocks: scores, ranks and score statistics from one pass over the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.operators.durable import bound_batches, written

#: Queries of a block, rows of a block of the corpus, and bytes of either at most.
QUERY_BLOCK, CORPUS_BLOCK, BLOCK_BYTES = 4096, 8192, 4 << 20
#: Blocks of queries that are broadcast; more meet the corpus as a grid of blocks.
BROADCAST_BLOCKS = 2
#: Rows of the corpus that one task of the grid reads; fewer if tasks would be fewer than cores.
TASK_ROWS = 4_000_000

#: Rows of the corpus that are multiplied with a block's matrix at a time: a table of scores takes 32 MB at most.
SCORED_ROWS = 1024

#: Best first: by score, ties by smaller id.
_BEST_FIRST = """(a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1
    when a.id < b.id then -1 when a.id > b.id then 1 else 0 end"""


def dot(a: str, b: str) -> F.Column:
    """Inner product of two array columns in double precision, for pairs that are few."""
    return F.expr(f"aggregate(zip_with(`{a}`, `{b}`, (x, y) -> cast(x as double) * cast(y as double)), 0D, (t, x) -> t + x)")


_PACKED = "block long, ids binary, vectors binary"


def _packed(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """(block, ids, vectors): the rows of a partition, ``most`` of them to a block; vectors in the precision they came in. Rows without a vector go."""
    wide = rows.schema["embedding"].dataType.elementType.simpleString() == "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, ids, held, rows_held = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task + count]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block", "ids", "vectors"])

        for batch in batches:
            own, flat = batch.column(0).to_numpy().astype(np.int64), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64 if wide else np.float32)
            if not len(own):
                continue
            dims = len(flat) // len(own)
            step = max(1, min(most, BLOCK_BYTES // max(1, dims * flat.itemsize)))
            for i in range(0, len(own), step):
                if ids and rows_held + len(own[i : i + step]) > step:
                    yield out()
                    ids, held, rows_held, count = [], [], 0, count + 1
                ids.append(own[i : i + step])
                held.append(flat[i * dims : (i + step) * dims])
                rows_held += len(ids[-1])
        if ids:
            yield out()

    return rows.where("embedding is not null").select(id_col, "embedding").mapInArrow(run, _PACKED)


def search(queries: DataFrame, corpus: DataFrame, k: int = 5, *, not_itself: bool = True, broadcast_blocks: int = BROADCAST_BLOCKS, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per query: query_id, n, total, top.

    ``queries`` has query_id and embedding, ``corpus`` id and embedding, vectors of one length; rows without a vector take no part. ``n`` and ``total`` are
    the number and the sum of all finite scores, ``top`` the ``k`` best (score, id), best first, ties by smaller id. Both sides are packed into
    blocks; every block of queries meets every block of the corpus on an executor, which keeps the ``k`` best of each query and sends one row for
    each query it met. Up to ``broadcast_blocks`` blocks of queries, of BLOCK_BYTES each, are broadcast; beyond that both tables of blocks are written and a task
    takes a block of queries and some ``task_rows`` of the corpus, so plan and driver don't grow with the queries.
    """
    spark = corpus.sparkSession
    bound_batches(spark)  # a row of the grid holds two blocks: some of them at a time, however many a task reads
    dims = queries.select(F.size("embedding")).where("embedding is not null").first()
    size = 8 if queries.schema["embedding"].dataType.elementType.simpleString() == "double" else 4
    per_block = max(1, min(QUERY_BLOCK, BLOCK_BYTES // max(1, (dims[0] if dims else 1) * size)))
    blocks = max(1, -(-queries.count() // per_block))
    kinds = [queries.schema["embedding"].dataType.elementType.simpleString(), corpus.schema["embedding"].dataType.elementType.simpleString()]
    asked = _packed(queries.repartition(blocks), "query_id", per_block)
    held = _packed(corpus, "id", CORPUS_BLOCK).select(F.col("ids").alias("own"), F.col("vectors").alias("rows"))
    if blocks <= broadcast_blocks:
        grid = held.crossJoin(F.broadcast(asked))
    else:
        tasks = max(-(-corpus.count() // task_rows), -(-spark.sparkContext.defaultParallelism // blocks))
        held, asked = written(held.repartition(tasks)), written(asked)
        # one partition of the product for each partition of either side: as many as there are blocks of queries, times the tasks of the corpus
        grid = asked.repartition(blocks, "block").crossJoin(held.repartition(tasks))
    passes = grid.select("block", "ids", "vectors", "own", "rows").mapInArrow(_scorer(k, not_itself, kinds), "query_id long, n long, total double, top array<struct<score: double, id: bigint>>")
    found = passes.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.flatten(F.collect_list("top")).alias("top"))
    found = found.withColumn("top", F.expr(f"slice(array_sort(top, {_BEST_FIRST}), 1, {k})"))
    if not corpus.isEmpty():
        return found
    nothing = F.array().cast("array<struct<score: double, id: bigint>>")
    return queries.select("query_id", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), nothing.alias("top"))


class _Best:
    """The best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.n, self.total = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        self.score, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, own: np.ndarray) -> None:
        """Take in a table of scores, queries by rows of the corpus; what isn't finite doesn't count."""
        counted = np.isfinite(scores)
        self.n += counted.sum(axis=1)
        self.total += np.where(counted, scores, 0).sum(axis=1)
        scores = np.where(counted, scores, -np.inf)
        keep = min(self.k, scores.shape[1])
        at = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
        limit = np.take_along_axis(scores, at, 1).min(axis=1)
        for q in np.flatnonzero((scores >= limit[:, None]).sum(axis=1) > keep):  # several tie for the last place: smaller ids go first
            near = np.flatnonzero(scores[q] >= limit[q])
            at[q] = near[np.lexsort((own[near], -scores[q, near]))[:keep]]
        score, found = np.hstack([self.score, np.take_along_axis(scores, at, 1)]), np.hstack([self.found, own[at]])
        order = np.lexsort((found, -score), axis=1)[:, : self.k]
        self.score, self.found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)

    def rows(self) -> pa.RecordBatch:
        top = [[{"score": x, "id": i} for x, i in zip(s, f, strict=True) if x > -np.inf] for s, f in zip(self.score.tolist(), self.found.tolist(), strict=True)]
        kind = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.n), pa.array(self.total), pa.array(top, kind)], names=["query_id", "n", "total", "top"])


def _scorer(k: int, not_itself: bool, kinds: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        types = [np.float64 if kind == "double" else np.float32 for kind in kinds]
        for batch in batches:
            for block, ids, vectors, own, rows in zip(*(batch.column(c) for c in range(5)), strict=True):
                ids, own = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(own.as_py(), np.int64)
                held = best.setdefault(block.as_py(), _Best(ids, k))
                matrix = np.frombuffer(vectors.as_py(), types[0]).reshape(len(ids), -1).astype(np.float64)
                rows = np.frombuffer(rows.as_py(), types[1]).reshape(len(own), -1)
                for i in range(0, len(own), SCORED_ROWS):
                    mine = own[i : i + SCORED_ROWS]
                    scores = matrix @ rows[i : i + SCORED_ROWS].T.astype(np.float64)
                    held.add(np.where(mine[None, :] == ids[:, None], -np.inf, scores) if not_itself else scores, mine)
        for held in best.values():
            yield held.rows()

    return run


def ranking(found: DataFrame) -> DataFrame:
    """(query_id, rank, id, score), rank from 1."""
    return found.select("query_id", F.posexplode("top").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("hit.id").alias("id"), F.col("hit.score").alias("score"))


def score_statistics(found: DataFrame) -> DataFrame:
    """Statistics of each query's scores over the whole corpus.

    top1_score, corpus_mean_score, score_gap (their difference), top1_minus_top2, top1_minus_top5 and
    top5_std (of the population); what a corpus is too small for is null. ``found`` needs k >= 5.
    """
    at = lambda i: F.expr(f"try_element_at(top, {i}).score")
    mean = F.expr("try_divide(total, n)")
    five = "transform(slice(top, 1, 5), x -> x.score)"
    average = f"(aggregate({five}, 0D, (t, x) -> t + x) / 5)"
    spread = F.expr(f"sqrt(aggregate({five}, 0D, (t, x) -> t + (x - {average}) * (x - {average})) / 5)")
    return found.select(
        "query_id",
        at(1).alias("top1_score"),
        mean.alias("corpus_mean_score"),
        (at(1) - mean).alias("score_gap"),
        (at(1) - at(2)).alias("top1_minus_top2"),
        (at(1) - at(5)).alias("top1_minus_top5"),
        F.when(F.size("top") >= 5, spread).alias("top5_std"),
    )


#: Queries of a block of the whole score table, and rows of a corpus block: a batch of it has their product of rows.
TABLE_QUERIES, TABLE_ROWS = 64, 2048


def pair_scores(queries: DataFrame, corpus: DataFrame, *, cosine: bool = False) -> DataFrame:
    """(query_id, id, score) of every query with every other row: the whole score table.

    The result itself has queries x corpus rows, so this is for query sets that are stated. Both sides are packed into small blocks, which
    meet as a grid; a task holds one block of either and a batch of TABLE_QUERIES x TABLE_ROWS scores. Products are added up in the order of the
    components, in double precision. A row without a vector has a null score.
    """
    spark = corpus.sparkSession
    bound_batches(spark)
    kinds = [df.schema["embedding"].dataType.elementType.simpleString() for df in (queries, corpus)]
    cores = spark.sparkContext.defaultParallelism
    asked = written(_packed(queries.repartition(max(1, min(cores, -(-queries.count() // TABLE_QUERIES)))), "query_id", TABLE_QUERIES))
    held = written(_packed(corpus.repartition(4 * cores), "id", TABLE_ROWS).select(F.col("ids").alias("own"), F.col("vectors").alias("rows")))
    grid = asked.repartition(max(1, min(4 * cores, asked.count())), "block").crossJoin(held.repartition(4 * cores))
    scored = grid.select("ids", "vectors", "own", "rows").mapInArrow(_pairs(cosine, kinds), "query_id long, id long, score double")
    bare = lambda df, key: df.where("embedding is null").select(key)
    none = F.lit(None).cast("double").alias("score")
    lacking = queries.select("query_id", F.col("embedding").isNull().alias("_q")).crossJoin(bare(corpus, "id"))
    lacking = lacking.select("query_id", "id").unionByName(bare(queries, "query_id").crossJoin(corpus.where("embedding is not null").select("id")))
    return scored.unionByName(lacking.where("id != query_id").select("query_id", "id", none))


def _pairs(cosine: bool, kinds: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [np.float64 if kind == "double" else np.float32 for kind in kinds]
        for batch in batches:
            for ids, vectors, own, rows in zip(*(batch.column(c) for c in range(4)), strict=True):
                ids, own = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(own.as_py(), np.int64)
                a = np.frombuffer(vectors.as_py(), types[0]).reshape(len(ids), -1).T.astype(np.float64)
                b = np.frombuffer(rows.as_py(), types[1]).reshape(len(own), -1).T.astype(np.float64)
                score = np.zeros((len(ids), len(own)))
                for x, y in zip(a, b, strict=True):
                    score += np.multiply.outer(x, y)
                absent = np.zeros(score.shape, bool)
                if cosine:
                    size = lambda m: np.sqrt(np.add.accumulate(m * m)[-1] if len(m) else np.zeros(m.shape[1]))
                    length = np.multiply.outer(size(a), size(b))
                    absent = length == 0
                    score = np.divide(score, length, out=score, where=~absent)
                kept = (ids[:, None] != own[None, :]).ravel()
                columns = [np.repeat(ids, len(own))[kept], np.tile(own, len(ids))[kept]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(score.ravel()[kept], mask=absent.ravel()[kept])], names=["query_id", "id", "score"])

    return run


#: What encoders of asymmetric search expect before a text of each role.
ROLE_PREFIX = {"query": "query: ", "passage": "passage: "}


def hash_encode(texts: DataFrame, dims: int = 64, role: str | None = None) -> DataFrame:
    """(id, embedding): a deterministic encoder that stands in for a model, normalised hashed word counts.

    ``texts`` has id and text; ``role`` puts its prefix before each text. Words hash to a dimension and a sign; a text
    without words gives zeros, and so does a null text without a role.
    """
    texts = texts.withColumn("text", F.concat(F.lit(ROLE_PREFIX[role]), F.coalesce("text", F.lit("")))) if role else texts
    bound_batches(texts.sparkSession)  # texts differ in length by orders of magnitude
    words = F.expr("filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), w -> w != '')")
    codes = F.expr(f"transform(_w, w -> cast(pmod(xxhash64(w), {dims}) * 2 + pmod(xxhash64(w, 1), 2) as int))")  # a dimension, and whether it is taken off
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, held = len(batch), batch.column(1)
            of = np.repeat(np.arange(n), np.diff(held.offsets.to_numpy()))
            counts = np.zeros(n * dims * 2, np.int64)
            np.add.at(counts, of * (dims * 2) + held.flatten().to_numpy(zero_copy_only=False), 1)
            each = counts.reshape(n, dims, 2)
            raw = (each[:, :, 0] - each[:, :, 1]).astype(np.float64)
            norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
            out = np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0).astype(np.float32)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["id", "embedding"])

    coded = texts.select("id", F.coalesce(words, F.array().cast("array<string>")).alias("_w")).select("id", codes.alias("_c"))
    return coded.mapInArrow(run, f"id {kind}, embedding array<float>")
