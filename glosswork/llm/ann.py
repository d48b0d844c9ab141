"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt to shards by a hash. In a shard, greedy searches on the
growing graph propose neighbours, relaxed distance pruning keeps diverse
edges, and reverse edges are pruned the same way. A search runs a beam over every shard's
graph and merges the shards' best. A coordinate that makes all norms equal turns inner
products into distances while the graph is built; scores use the vectors as they came.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm.common import bound_batches, materialise, table

DEGREE, BEAM, RELAX = 48, 96, 1.2
SEARCH_BEAM = 160
#: Distinct vectors of a shard, and queries that search a shard together.
SHARD_VECTORS, QUERY_BLOCK = 5_000, 20_000
LEAST_SHARDS = 24
#: Nodes expanded at a time in each search, and searches run together.
EXPAND, TOGETHER = 4, 256


def beam_search(x: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, inner products), best first, -1 where fewer than ``beam`` were met. ``edges`` is padded with -1."""
    n, b = len(x), len(queries)
    rows = np.arange(b)[:, None]
    start = np.broadcast_to(entry, (b, len(entry)))
    seen = np.zeros((b, n + 1), bool)  # the last column takes the padding
    seen[:, n] = True
    seen[rows, start] = True
    nodes = np.full((b, beam + len(entry)), -1, np.int64)
    score = np.full(nodes.shape, -np.inf, np.float32)
    nodes[:, : len(entry)] = start
    score[:, : len(entry)] = queries @ x[entry].T
    order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
    nodes, score = nodes[rows, order], score[rows, order]
    done = np.zeros(nodes.shape, bool)
    while True:
        open_score = np.where(done | (nodes < 0), -np.inf, score)
        live = np.flatnonzero(open_score.max(axis=1) > -np.inf)
        if not len(live):
            return nodes, score
        r = live[:, None]
        pick = np.argsort(-open_score[live], axis=1, kind="stable")[:, :EXPAND]
        valid = open_score[r, pick] > -np.inf
        done[r, pick] = True
        near = np.where(valid[..., None], edges[nodes[r, pick]], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[r, near]] = -1
        seen[r, near] = True
        got = np.where(near >= 0, np.einsum("brd,bd->br", x[near], queries[live]), -np.inf)
        all_nodes, all_score = np.concatenate([nodes[live], near], axis=1), np.concatenate([score[live], got], axis=1).astype(np.float32)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
        keep = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        own = np.arange(len(live))[:, None]
        nodes[live], score[live], done[live] = all_nodes[own, keep], all_score[own, keep], all_done[own, keep]
        nodes[score == -np.inf] = -1


def robust_prune(x: np.ndarray, at: np.ndarray, candidates: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """Edges (len(at), degree) kept of the candidates, padded with -1: nearest first, without those that a kept one is ``relax`` times nearer to."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == at[:, None]] = -1
    norm = float((x[0] ** 2).sum()) if len(x) else 0.0
    far = np.where(c >= 0, 2 * (norm - np.einsum("bcd,bd->bc", x[c], x[at])), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    rows = np.arange(len(at))[:, None]
    c, far = c[rows, order], far[rows, order]
    vectors = x[c]
    between = 2 * (norm - vectors @ vectors.transpose(0, 2, 1))
    alive, out = c >= 0, np.full((len(at), degree), -1, np.int64)
    for k in range(degree):
        some = np.flatnonzero(alive.any(axis=1))
        if not len(some):
            break
        first = alive[some].argmax(axis=1)
        out[some, k] = c[some, first]
        alive[some] &= relax * between[some, first] > far[some]
        alive[some, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry nodes) over vectors of equal norm: two passes, the second with relaxed pruning."""
    n, rng = len(x), np.random.default_rng(seed)
    edges = np.full((n, degree), -1, np.int64)
    if n > 1:
        first = rng.integers(0, n - 1, (n, min(degree, n - 1)))
        edges[:, : first.shape[1]] = first + (first >= np.arange(n)[:, None])  # never itself
    centre = int(np.argmax(x @ x.mean(axis=0))) if n else 0
    entry = np.unique(np.concatenate([[centre], rng.integers(0, max(n, 1), 7)])) if n else np.zeros(0, np.int64)
    for factor in (1.0, relax):
        order = rng.permutation(n)
        for i in range(0, n, TOGETHER):
            at = order[i : i + TOGETHER]
            found, _ = beam_search(x, edges, entry, x[at], beam)
            edges[at] = robust_prune(x, at, np.concatenate([found, edges[at]], axis=1), factor, degree)
            source, target = np.repeat(at, degree), edges[at].reshape(-1)
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            hit, begin, many = np.unique(target, return_index=True, return_counts=True)
            for s in range(0, len(hit), TOGETHER * 4):
                h, b, m = hit[s : s + TOGETHER * 4], begin[s : s + TOGETHER * 4], many[s : s + TOGETHER * 4]
                back = np.full((len(h), int(m.max())), -1, np.int64)
                inside = np.arange(back.shape[1]) < m[:, None]
                back[inside] = source[np.repeat(b, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                both = np.concatenate([edges[h], back], axis=1)
                both = np.sort(both, axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                few = (both >= 0).sum(axis=1) <= degree
                packed = -np.sort(-both, axis=1)[:, :degree]
                edges[h[few]] = packed[few]
                if (~few).any():
                    edges[h[~few]] = robust_prune(x, h[~few], both[~few], factor, degree)
    return edges, entry


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as they came."""
    flat = vectors.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def equal_norm(x: np.ndarray) -> np.ndarray:
    """A coordinate more, so that all norms are the largest."""
    x = x.astype(np.float64)
    square = (x**2).sum(axis=1)
    more = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0))
    return np.concatenate([x, more[:, None]], axis=1).astype(np.float32)


def searchable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part: no nulls, finite, not zero, of the commonest dimension (of those as common the smallest), as others have no inner product with them.

    Floats stay floats; any other numbers become doubles, so that scores come from the vectors as they were.
    """
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    v = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, e -> e is not null and not isnan(e) and abs(e) < double('infinity')) and exists(embedding, e -> e != 0)"
    )
    most = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("embedding") == (most["d"] if most else 0))


def build_index(vectors: DataFrame, keep: int = 21, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Index of all searchable rows: a row for each distinct vector with shard, ids, keep, embedding, edges, entry.

    ``ids`` are the ``keep`` smallest vec_ids of the vector, all that a search for keep - 1 can
    return: copies tie, and ties go to smaller ids. Copies are cut to those where they are read. Rows that are the same count once. An
    empty table, or one without a searchable vector, gives an empty index. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = searchable(vectors).distinct().withColumn("nth", F.row_number().over(same)).where(f"nth <= {keep}")
    nodes = materialise(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    shards = max(least_shards, -(-nodes.count() // SHARD_VECTORS))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("first", "ascending")])
        x = matrix(part.column("embedding"))
        edges, entry = build_graph(equal_norm(x))
        is_entry = np.zeros(len(x), bool)
        is_entry[entry] = True
        return pa.table(
            {
                "shard": part.column("shard"),
                "node": pa.array(np.arange(len(x)), pa.int32()),
                "ids": part.column("ids"),
                "keep": pa.array(np.full(len(x), keep), pa.int32()),
                "embedding": part.column("embedding"),
                "edges": pa.array([e[e >= 0].astype(np.int32) for e in edges], pa.list_(pa.int32())),
                "entry": pa.array(is_entry),
            }
        )

    kind = nodes.schema["ids"].dataType.simpleString()
    return materialise(
        nodes.withColumn("first", F.col("ids")[0]).groupBy("shard").applyInArrow(run, f"shard int, node int, ids {kind}, keep int, embedding {nodes.schema['embedding'].dataType.simpleString()}, edges array<int>, entry boolean")
    )


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best, not itself; ties go to smaller ids.

    ``queries`` has vec_id and embedding. Query blocks visit every shard; neither a shard
    nor a block grows with the input. ``k`` must lie below the index's ``keep``. Queries that can't take part have no rows, and neither
    has an empty index; where there are fewer candidates than ``k``, all come.
    """
    if (held := index.select("keep").first()) and k >= held[0]:
        raise ValueError(f"an index that keeps {held[0]} ids a vector answers for {held[0] - 1} neighbours at most, not {k}")
    queries = searchable(queries).distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = [r[0] for r in index.select("shard").distinct().collect()]  # a number for each shard
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.array(*[F.lit(s) for s in shards]) if shards else F.expr("array_repeat(0, 0)")))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(own: pa.Table, ask: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not own.num_rows or not ask.num_rows:
            return pa.table(empty)
        own = own.sort_by([("node", "ascending")])
        whole = matrix(own.column("embedding"))
        x = whole.astype(np.float32)
        near, ids = own.column("edges").to_pylist(), own.column("ids").to_pylist()
        edges = np.full((len(x), max(1, max(map(len, near)))), -1, np.int64)
        for i, e in enumerate(near):
            edges[i, : len(e)] = e
        entry = np.flatnonzero(own.column("entry").to_numpy())
        asked_for, qid = matrix(ask.column("embedding")), ask.column("vec_id").to_pylist()
        out_q, out_v, out_s = [], [], []
        q = asked_for.astype(np.float32)
        for i in range(0, len(q), TOGETHER):
            found, _ = beam_search(x, edges, entry, q[i : i + TOGETHER], beam)
            exact = np.einsum("bcd,bd->bc", whole[found].astype(np.float64), asked_for[i : i + TOGETHER].astype(np.float64))
            exact[found < 0] = -np.inf
            best = np.argsort(-exact, axis=1, kind="stable")
            for j in range(len(found)):
                me, took, level = qid[i + j], 0, None
                for c in best[j]:
                    if found[j, c] < 0 or (took >= k and exact[j, c] != level):
                        break  # ties with the last one taken still count
                    for v in ids[found[j, c]][: k + 1]:
                        if v != me:
                            out_q.append(me)
                            out_v.append(v)
                            out_s.append(exact[j, c])
                            took += 1
                    level = exact[j, c]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = held.select("shard", "block", "node", "ids", "embedding", "edges", "entry").groupBy("shard", "block").cogroup(asked.select("shard", "block", "vec_id", "embedding").groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op9_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each twentieth vector among all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(vectors), vectors.where("vec_id % 20 = 0"))
