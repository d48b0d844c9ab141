"""Property graphs as two tables: nodes and edges with where they were read, walks, paths and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.operators.durable import bound_batches, written
from glosswork.operators.sampling import number


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace ``column`` by its canonical name in ``aliases`` (surface, canonical), if it has one."""
    return df.join(aliases.select(F.col("surface").alias(column), "canonical"), column, "left").withColumn(f"{column}_name", F.coalesce("canonical", column)).drop("canonical")


def fold(entities: DataFrame, relations: DataFrame, aliases: DataFrame, edge_types: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved) from entities (chunk, pos, name, type) and relations (chunk, source, target, type).

    A relation's ends get their types from the entities of the same chunk, the last of a name winning; ends that the
    chunk doesn't list and types that aren't known are reported. Nodes are keyed by canonical name and type.
    """
    named = canonical(entities, "name", aliases)
    # Counted in two steps of plain keys and numbers, and aliases apart, as few names have any: nothing is sorted to be counted.
    held = named.select(F.col("name_name").alias("node"), "type", "chunk").distinct().groupBy("node", "type").agg(F.count("chunk").alias("chunks"), F.min("chunk").alias("first_chunk"))
    other = named.where("name != name_name").groupBy(F.col("name_name").alias("_node"), F.col("type").alias("_type")).agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    same = F.col("node").eqNullSafe(F.col("_node")) & F.col("type").eqNullSafe(F.col("_type"))
    nodes = held.join(other, same, "left").select("node", "type", "chunks", "first_chunk", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    # Ends are looked up in one table of the chunks' names, which has their canonical names already.
    kind = named.groupBy("chunk", "name").agg(F.max(F.struct("pos", "type")).alias("last"), F.min("name_name").alias("to"))
    ends = relations
    for side in ("source", "target"):
        ends = ends.join(kind.select("chunk", F.col("name").alias(side), F.col("last.type").alias(f"{side}_type"), F.col("to").alias(f"{side}_name")), ["chunk", side], "left")
    why = F.when(F.col("source_type").isNull() | F.col("target_type").isNull(), "not an entity of this chunk").when(~F.col("type").isin(*edge_types), "unknown type")
    # Written, as edges and what is unresolved would each look all ends up again.
    checked = written(ends.withColumn("reason", why).select("chunk", "source", "source_type", "source_name", "target", "target_type", "target_name", "type", "reason"))
    edges = checked.where("reason is null").groupBy(F.col("source_name").alias("source"), "source_type", "type", F.col("target_name").alias("target"), "target_type").agg(F.count_distinct("chunk").alias("chunks"), F.min("chunk").alias("first_chunk"))
    return nodes, edges, checked.where("reason is not null").select("chunk", "source", "target", "type", "reason")


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, edge): every edge (edge, source, target) from both ends."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "edge")
    return out.unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "edge"))


def walk(seeds: DataFrame, near: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``hops`` of the seeds (node), each with the hop that reached it first.

    Each hop is a join of the nodes that are new with the adjacency, so the walk costs what it reaches.
    """
    reached = seeds.select("node", F.lit(0).alias("hop")).distinct()
    frontier, touched = reached, None
    for hop in range(1, hops + 1):
        step = frontier.select(F.col("node").alias("a")).join(near, "a")
        seen = step.select("edge", F.lit(hop).alias("hop")).distinct()
        touched = seen if touched is None else touched.unionByName(seen)
        frontier = written(step.select(F.col("b").alias("node")).distinct().join(reached, "node", "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached, touched.groupBy("edge").agg(F.min("hop").alias("hop"))


#: Edges of a node beyond which its neighbours are dealt to several tasks.
HUB_EDGES = 100_000


def walk_each(seeds: DataFrame, near: DataFrame, hops: int = 2, hub_edges: int = HUB_EDGES, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """``walk`` for many questions at once: (query_id, node, hop) and (query_id, edge, hop) from seeds (query_id, node).

    The frontier is keyed by question and node, so a hop is one join for all questions, and the walk costs what they reach. The edges of a hub are dealt
    to salts and its rows of the frontier to each of them, so that no task holds a hub's edges times the questions that pass it.
    A seed that no edge touches is reached, and nothing else from it.

    ``packed``: questions are numbers, and 64 of them share a row, as bits: (block, node, hop, mask) and (block, edge, hop, mask), where block is the
    number div 64. The walk then costs what 64 questions reach together. An edge's mask at a hop may hold questions that touched it at an earlier one.
    """
    hubs = written(near.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hub_edges).select("a", F.ceil(F.col("_n") / hub_edges).cast("int").alias("_salts")))  # 2 edges / hub_edges rows at most
    salts = F.coalesce("_salts", F.lit(1))
    dealt = near.join(F.broadcast(hubs), "a", "left").withColumn("_salt", F.pmod(F.xxhash64("edge", "b"), salts).cast("int")).drop("_salts")
    if packed:
        return _walk_packed(seeds, dealt, hubs, hops)
    reached = written(seeds.select("query_id", "node").distinct().withColumn("hop", F.lit(0)))
    frontier, touched = reached, None
    for hop in range(1, hops + 1):
        asked = frontier.select("query_id", F.col("node").alias("a")).join(F.broadcast(hubs), "a", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        step = asked.join(dealt, ["a", "_salt"])
        seen = step.select("query_id", "edge", F.lit(hop).alias("hop")).distinct()
        touched = seen if touched is None else touched.unionByName(seen)
        frontier = written(step.select("query_id", F.col("b").alias("node")).distinct().join(reached, ["query_id", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached, touched.groupBy("query_id", "edge").agg(F.min("hop").alias("hop"))


def _walk_packed(seeds: DataFrame, dealt: DataFrame, hubs: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """``walk_each`` over bits of questions; ``dealt`` are the edges with the salts of ``hubs``."""
    bits, salts = F.bit_or("mask").alias("mask"), F.coalesce("_salts", F.lit(1))
    one = F.expr("shiftleft(1L, cast(pmod(query_id, 64) as int))").alias("mask")
    reached = written(seeds.select(F.floor(F.col("query_id") / 64).alias("block"), "node", one).groupBy("block", "node").agg(bits).select("block", "node", F.lit(0).alias("hop"), "mask"))
    frontier, touched = reached, None
    for hop in range(1, hops + 1):
        asked = frontier.select("block", F.col("node").alias("a"), "mask").join(F.broadcast(hubs), "a", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        step = asked.join(dealt, ["a", "_salt"])
        seen = step.groupBy("block", "edge").agg(bits).select("block", "edge", F.lit(hop).alias("hop"), "mask")
        touched = seen if touched is None else touched.unionByName(seen)
        before = reached.groupBy("block", "node").agg(F.bit_or("mask").alias("_seen"))
        new = step.groupBy("block", F.col("b").alias("node")).agg(bits).join(before, ["block", "node"], "left")
        new = new.select("block", "node", F.lit(hop).alias("hop"), F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0)))).alias("mask"))
        frontier = written(new.where("mask != 0"))
        reached = reached.unionByName(frontier)
    return reached, touched


def named(questions: DataFrame, names: DataFrame, least: int = 3, grams: int = 8) -> DataFrame:
    """(query_id, name): names of nodes (node, name) of ``least`` characters or more that stand in a question (query_id, question), each once.

    A name is looked up by its rarest run of ``grams`` characters, a shorter one by itself, among the runs of the questions; what meets there
    is then compared whole. Names that repeat are looked up once. Null names and questions meet nothing.
    """
    distinct = names.where(F.length("name") >= least).select("name").distinct().withColumn("_q", F.least(F.length("name"), F.lit(grams)))
    runs = distinct.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("_q") + 1))).withColumn("_gram", F.substring("name", F.col("_at"), F.col("_q")))
    rarest = runs.join(runs.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")), "_gram").groupBy("name").agg(F.min(F.struct("_n", "_at", "_gram")).alias("_r"))
    sizes = F.filter(F.array(*[F.lit(n) for n in range(least, grams + 1)]), lambda n: n <= F.length("question"))
    asked = questions.select("query_id", "question", F.explode(sizes).alias("_q")).withColumn("_place", F.explode(F.sequence(F.lit(1), F.length("question") - F.col("_q") + 1)))
    met = asked.withColumn("_gram", F.substring("question", F.col("_place"), F.col("_q"))).join(rarest.select("name", F.col("_r._at").alias("_at"), F.col("_r._gram").alias("_gram")), "_gram")
    start = F.col("_place") - F.col("_at") + 1
    return met.where((start >= 1) & (F.substring("question", F.greatest(start, F.lit(1)), F.length("name")) == F.col("name"))).select("query_id", "name").distinct()


#: Rows that one task makes of a name: beyond, its nodes are dealt to salts.
NAME_ROWS = 2_000_000


def mentions(questions: DataFrame, names: DataFrame, least: int = 3, grams: int = 8, name_rows: int = NAME_ROWS) -> DataFrame:
    """(query_id, node): nodes (node, name) whose name stands in a question (query_id, question), names of ``least`` characters or more.

    A name that many nodes bear and many questions hold makes the product of both: its nodes are dealt to salts by the rows that come of it, and
    its questions to each of them. Only nodes of several names can meet a question twice, so only theirs are made distinct.
    """
    held = written(named(questions, names, least, grams))
    borne = names.where(F.length("name") >= least).select("node", "name").distinct()
    several = borne.groupBy("node").agg(F.count(F.lit(1)).alias("_k"))
    borne = borne.join(several, "node").select("node", "name", (F.col("_k") > 1).alias("_again"))
    sizes = held.groupBy("name").agg(F.count(F.lit(1)).alias("_asked")).join(borne.groupBy("name").agg(F.count(F.lit(1)).alias("_nodes")), "name")
    salts = written(sizes.select("name", F.ceil(F.col("_asked") * F.col("_nodes") / name_rows).cast("int").alias("_salts")))
    dealt = borne.join(salts, "name").withColumn("_salt", F.pmod(F.xxhash64("node"), "_salts").cast("int")).drop("_salts")
    asked = held.join(salts, "name").select("query_id", "name", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    met = dealt.join(asked.hint("shuffle_hash"), ["name", "_salt"])
    return met.where("not _again").select("query_id", "node").unionByName(met.where("_again").select("query_id", "node").distinct())


def evidence(nodes: DataFrame, edges: DataFrame, node_chunks: DataFrame, edge_chunks: DataFrame) -> DataFrame:
    """(chunk, hop, kind, key): chunks of a walk, each at its first place: by hop, nodes (0) before edges (1), then key. Of walks with query_id, for each."""
    by = [c for c in ("query_id",) if c in nodes.columns]
    a = nodes.join(node_chunks, "node").select(*by, "chunk", "hop", F.lit(0).alias("kind"), F.col("node").cast("string").alias("key"))
    b = edges.join(edge_chunks, "edge").select(*by, "chunk", "hop", F.lit(1).alias("kind"), F.col("edge").cast("string").alias("key"))
    # nodes of all hops come before edges of all hops
    return a.unionByName(b).groupBy(*by, "chunk").agg(F.min(F.struct("kind", "hop", "key")).alias("m")).select(*by, "chunk", "m.kind", "m.hop", "m.key")


#: Rows of the result that one task of a search makes, and numbers that it holds at a time to make them.
RESULT_ROWS, HELD_NUMBERS = 5_000_000, 1 << 20


def search(questions: DataFrame, names: DataFrame, near: DataFrame, node_chunks: DataFrame, edge_chunks: DataFrame, hops: int = 2) -> DataFrame:
    """(query_id, chunk, kind, hop, key): ``evidence`` of a walk from all nodes that a question names, for each question.

    A hop is the least of those from each name by itself, and so is a chunk's first place. So names are numbered and walked from, 64 to a row; a chunk
    keeps the places that are the first of any name, and each set of names that questions hold takes the least of its names' places. What is found lies
    by chunk, and a chunk's places are handed out to all questions where they lie: the rows of the result aren't shuffled.
    """
    bound_batches(questions.sparkSession)
    held = written(named(questions, names))
    asked = written(number(held.select("name").distinct(), "name", name="_number"))
    seeds = names.select("node", "name").distinct().join(asked, "name").select(F.col("_number").alias("query_id"), "node")
    nodes, edges = walk_each(seeds, near, hops, HUB_EDGES, True)
    a = nodes.join(node_chunks, "node").select("chunk", F.lit(0).alias("kind"), "hop", F.col("node").cast("string").alias("key"), "block", "mask")
    b = edges.join(edge_chunks, "edge").select("chunk", F.lit(1).alias("kind"), "hop", F.col("edge").cast("string").alias("key"), "block", "mask")
    earlier = Window.partitionBy("block", "chunk").orderBy("kind", "hop", "key").rowsBetween(Window.unboundedPreceding, -1)
    fresh = a.unionByName(b).withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("mask").over(earlier), F.lit(0))))).where("mask != 0")
    places = written(fresh.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("kind", "hop", "key", "block", "mask"))).alias("places")))  # as many as names at most

    wanted = held.join(asked, "name").groupBy("query_id").agg(F.sort_array(F.collect_set("_number")).alias("wanted"))
    sets = written(number(wanted.select("wanted").distinct(), "wanted", name="_set"))
    who = written(wanted.join(sets, "wanted").select("query_id", (F.col("_set") - 1).cast("int").alias("_set")))
    tasks = max(questions.sparkSession.sparkContext.defaultParallelism, -(-places.count() * who.count() // RESULT_ROWS))
    found = places.repartition(tasks).mapInArrow(_firsts([r["wanted"] for r in sets.orderBy("_set").collect()]), f"chunk {places.schema['chunk'].dataType.simpleString()}, places array<struct<kind: int, hop: int, key: string>>, first array<int>")
    met = found.crossJoin(F.broadcast(who)).where("get(first, _set) < size(places)").select("query_id", "chunk", F.expr("get(places, get(first, _set))").alias("place"))
    return met.select("query_id", "chunk", "place.kind", "place.hop", "place.key")


def _firsts(sets: list[list[int]]):
    """Adds to each chunk's places, for each set of names, which of them is the first of any of its names; the largest number if none is."""
    none = np.iinfo(np.int32).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [np.array(s) for s in sets]
        many = max((int(s.max()) for s in wanted), default=0) // 64 * 64 + 64
        for batch in batches:
            step = max(1, HELD_NUMBERS // max(many, len(wanted)))
            for part in (batch.slice(i, step) for i in range(0, len(batch), step)):
                held = part.column("places")
                flat, ends = held.flatten(), held.value_lengths().to_numpy().cumsum()
                begin = np.concatenate([[0], ends[:-1]])
                of = np.repeat(np.arange(len(part)), ends - begin)
                place = np.arange(len(flat)) - begin[of]
                row, bit = np.nonzero(np.unpackbits(flat.field("mask").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                at = np.full((many, len(part)), none, np.int32)
                at[flat.field("block").to_numpy()[row] * 64 + bit, of[row]] = place[row]
                first = np.array([at[s].min(axis=0) for s in wanted], np.int32).reshape(len(wanted), len(part))
                own = pa.StructArray.from_arrays([flat.field(c) for c in ("kind", "hop", "key")], names=["kind", "hop", "key"])
                lists = pa.ListArray.from_arrays(np.append(begin, len(flat)).astype(np.int32), own)
                numbers = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * len(wanted), pa.array(first.T.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("chunk"), lists, numbers], names=["chunk", "places", "first"])

    return run


def incoming_paths(edges: DataFrame, target: str, types: list[str], hops: int = 2) -> DataFrame:
    """(path, length): simple directed paths of allowed types that end at ``target``."""
    allowed = edges.where(F.col("type").isin(*types)).select("source", "target", "type")
    arrow = lambda: F.concat("source", F.lit(" -["), "type", F.lit("]-> "))
    paths = allowed.where(F.col("target") == target).where("source != target").select(F.col("source").alias("head"), F.array("source").alias("trail"), F.concat(arrow(), F.lit(target)).alias("path"))
    out = paths.select("path", F.lit(1).alias("length"))
    for n in range(2, hops + 1):
        step = paths.join(allowed.withColumnRenamed("target", "head"), "head")
        paths = step.where((F.col("source") != target) & ~F.array_contains("trail", F.col("source"))).select(F.col("source").alias("head"), F.concat("trail", F.array("source")).alias("trail"), F.concat(arrow(), "path").alias("path"))
        out = out.unionByName(paths.select("path", F.lit(n).alias("length")))
    return out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per type of node (node, type): nodes, isolated ones and their share, largest and mean degree."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))  # one pass over the edges
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    joined = nodes.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    isolated = F.expr("count_if(degree = 0)")
    return joined.groupBy("type").agg(
        F.count(F.lit(1)).alias("nodes"), isolated.alias("isolated"), F.round(isolated / F.count(F.lit(1)), 6).alias("orphan_rate"), F.max("degree").alias("largest"), F.round(F.avg("degree"), 6).alias("mean")
    )


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges (distinct ordered pairs of different ends) and their share of all ordered pairs, 0.0 below two nodes."""
    pairs = edges.where("source != target").select("source", "target").distinct().agg(F.count(F.lit(1)).alias("edges"))
    count = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(F.broadcast(pairs))
    return count.select("nodes", "edges", F.round(F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes").cast("double") * (F.col("nodes") - 1)), F.lit(0.0)), 9).alias("density"))


def upsert(graph: DataFrame, rows: DataFrame, keys: list[str], add: list[str], least: list[str]) -> DataFrame:
    """``graph`` with ``rows`` merged in by ``keys``: counts in ``add`` are added up, of ``least`` the least stays, new keys come in.

    Nulls in keys are a key like any other. Both sides are reduced where they are read, so a hot key costs a row a task.
    """
    every = graph.select(*keys, *add, *least).unionByName(rows.select(*keys, *add, *least))
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in add], *[F.min(c).alias(c) for c in least])


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is any fixed member of its component.

    Each round hooks every node to its neighbour of least rank, in a random order drawn
    anew each round, and contracts the edges. The rows written shrink with every round, a giant component's too.
    """
    edges = written(edges)
    maps = []
    for r in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        best = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        hook = written(best.select(F.col("u").alias("node"), F.least(rank("u"), F.col("best"))["n"].alias("parent")))
        maps.append(hook)
        a = hook.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = hook.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        edges = written(edges.join(a, "u").join(b, "v").where("pu != pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[-1].select("node", F.col("parent").alias("root"))
    for hook in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("parent"), "root")
        out = hook.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return out


def connected_numbers(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``connected`` for nodes that are longs: (node, root), where root is the same for the nodes of a component and for no others.

    A number's hash of 64 bits is a bijection, so a round's ranks don't tie and are the nodes' names from then on. All that is aggregated are longs,
    which needs no sort and merges where rows are read. A root is the round that settled its component and a name of that round.
    """
    edges = written(edges)
    maps = []
    for r in range(rounds):
        if edges.isEmpty():
            break
        rank = lambda c: F.xxhash64(F.col(c), F.lit(r))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        hook = written(best.select(F.col("u").alias("node"), F.least(rank("u"), "best").alias("parent")))
        maps.append(hook)
        a = hook.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = hook.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        edges = written(edges.join(a, "u").join(b, "v").where("pu != pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    root = lambda r, c: F.struct(F.lit(r).alias("round"), F.col(c).alias("name")).alias("root")
    if not maps:
        return edges.select(F.col("u").alias("node"), root(0, "v"))
    out = maps[-1].select("node", root(len(maps) - 1, "parent"))
    for r, hook in reversed(list(enumerate(maps[:-1]))):
        up = out.select(F.col("node").alias("parent"), F.col("root").alias("up"))
        out = hook.join(up, "parent", "left").select("node", F.coalesce("up", root(r, "parent")).alias("root"))
    return out


def components(nodes: DataFrame, edges: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(node, component): the smallest node of each node's component; a node without edges is its own.

    Nodes are linked by hashes of their names. Should two names share one, all are hashed anew by another seed, so the result is exact.
    """
    some = edges.where("source != target").select("source", "target")
    ends = written(some.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    for seed in range(100):
        number = lambda c: hashed(F.lit(seed), F.col(c))  # noqa: B023, E731
        if ends.groupBy(number("node")).count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("nodes could not be numbered")
    roots = connected_numbers(some.select(number("source").alias("u"), number("target").alias("v")))
    named = written(ends.select("node", number("node").alias("_id")).join(roots.withColumnRenamed("node", "_id"), "_id").select("node", "root"))
    least = named.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.select("node").distinct().join(named.join(least, "root").select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
