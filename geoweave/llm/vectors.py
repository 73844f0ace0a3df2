"""Near-duplicate embeddings by small-world graphs per shard, audited for recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import small, take, tasks, written
from geoweave.llm.components import connected_components, forest
from geoweave.llm.hnsw import Graph, Layer, build

MIN_COSINE = 0.9
# Shards at least, and vectors of a shard at most, which bounds the memory of a task.
SHARDS = 4
SHARD_VECTORS = 100_000
# A shard is given to one task per so many queries, but to no more than keep this many groups of
# queries per task of the session; so copies of a shard do not grow with the table.
PART_QUERIES = 2_048
GROUPS_PER_TASK = 2
# The beam begins at the first number and doubles until the audit finds this share of all links.
BEAM = 48
RECALL = 0.99
# Vectors whose links an audit counts by comparing them with all others: by hash, and of those with links.
AUDITED = 1_024
AUDITED_LINKED = 256
# Single precision may differ by this from the cosine that is checked in double precision.
SLACK = 1e-4


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, not zero, and no component null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix in double precision, scaled to length one."""
    found = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # A power of two first, so that squares of very large or small numbers stay in range.
    found = found / np.exp2(np.floor(np.log2(np.abs(found).max(axis=1, keepdims=True))))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


_GRAPH = "shard int, place int, node bigint, copies bigint, vector array<double>, level int, links array<array<int>>"


def _built(nodes: DataFrame) -> DataFrame:
    """Graphs of shards, one row per vector: its place, its top layer from below, its links layer by layer from below."""

    def run(key, table):
        table = table.combine_chunks().sort_by("node")
        vectors = _matrix(table.column("vector").combine_chunks())
        graph = build(vectors.astype(np.float32))
        n = len(vectors)
        level, links = np.zeros(n, np.int32), [[] for _ in range(n)]
        for up, layer in enumerate(reversed(graph.layers)):
            level[layer.nodes] = up
            for number, row in zip(layer.nodes.tolist(), layer.links, strict=True):
                links[number].append(layer.nodes[row[row >= 0]].astype(np.int32))
        return pa.table(
            {
                "shard": table.column("shard"), "place": pa.array(np.arange(n, dtype=np.int32)), "node": table.column("node"),
                "copies": table.column("copies"), "vector": table.column("vector"), "level": pa.array(level),
                "links": pa.array(links, pa.list_(pa.list_(pa.int32()))),
            }
        )

    return nodes.groupBy("shard").applyInArrow(run, _GRAPH)


def _loaded(rows: pa.Table) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of a shard from its rows in order of place; exact vectors, nodes and copies."""
    exact = _matrix(rows.column("vector").combine_chunks())
    level, links = rows.column("level").to_numpy(), rows.column("links").to_pylist()
    layers = []
    for up in range(int(level.max()), -1, -1):
        nodes = np.flatnonzero(level >= up)
        place = np.full(len(exact), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        rows_of = [links[i][up] for i in nodes]
        wide = np.full((len(nodes), max(1, max(map(len, rows_of)))), -1, np.int64)
        for i, r in enumerate(rows_of):
            wide[i, : len(r)] = place[r]
        layers.append(Layer(nodes, wide))
    return Graph(exact.astype(np.float32), layers), exact, rows.column("node").to_numpy(), rows.column("copies").to_numpy()


def _searched(graphs: DataFrame, nodes: DataFrame, shards: int, parts: int, beam: int, least: float) -> DataFrame:
    """What every query finds in every shard: ``a``, ``b``, ``links``.

    A row with ``links`` has a node and how many other vectors, copies counted, it links with in a shard.
    A row without joins two nodes that links join: at most one per node and batch, not one per link.
    """
    held = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("query", F.lit(0))
    asked = nodes.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("place"), "node", "copies", "vector",
        F.lit(0).alias("level"), F.lit(None).cast("array<array<int>>").alias("links"),
        F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("query"),
    )
    # One group of queries per partition: a hash would put two into one and none into another.
    rows = held.unionByName(asked).repartitionById(shards * parts, F.col("shard") * parts + F.col("part"))
    order = ["shard", "part", "query", "place", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts_held, state = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard, part, query = (table.column(c).to_numpy() for c in ("shard", "part", "query"))
            edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1]), True])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                group = (int(shard[i]), int(part[i]))
                if group != current:
                    current, parts_held, state = group, [], None
                piece = table.slice(i, j - i)
                if not query[i]:
                    parts_held.append(piece)
                elif parts_held or state:
                    if state is None:
                        state, parts_held = _loaded(pa.concat_tables(parts_held)), []
                    yield from answers(piece, *state)

    def answers(asked: pa.Table, graph: Graph, exact: np.ndarray, nodes: np.ndarray, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        mine, node = _matrix(asked.column("vector").combine_chunks()), asked.column("node").to_numpy()
        q, v = graph.search(mine.astype(np.float32), beam, least - SLACK)
        near = np.zeros(len(q), bool)
        for at in range(0, len(q), 1 << 16):
            s = slice(at, at + (1 << 16))
            near[s] = np.einsum("kd,kd->k", mine[q[s]], exact[v[s]]) >= least
        near &= node[q] != nodes[v]
        q, v = q[near], v[near]
        count = np.bincount(q, copies[v], len(node)).astype(np.int64)
        some = np.flatnonzero(count)
        a, b = forest(node[q], nodes[v])
        none = np.full(len(a), -1, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[node[some], a]), pa.array(np.r_[node[some], b]), pa.array(np.r_[count[some], none])], ["a", "b", "links"]
        )

    return rows.sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint, links bigint")


def parts_of(vectors: int, shards: int, at_once: int) -> int:
    """Groups into which the queries of a shard are dealt, which is also how often its graph is sent."""
    return max(1, min(-(-vectors // PART_QUERIES), -(-GROUPS_PER_TASK * at_once // shards)))


def _audit(nodes: DataFrame, found: DataFrame, least: float) -> float:
    """Mean share of its links that was found for an audited vector, all of whose links are counted in blocks.

    Every vector with links weighs the same, so a dense group does not hide vectors with few links. One
    sample is taken by hash, whatever the search found; a second one from vectors for which it found links.
    The lesser mean counts. A sample of vectors without any link says nothing and counts as 1.
    """
    counts = found.where("links >= 0").groupBy("a").agg(F.sum("links").alias("links"))
    some = nodes.join(counts, nodes.node == counts.a, "left").select("node", "vector", F.coalesce("links", F.lit(0)).alias("links"))
    by = F.xxhash64("node", F.lit(5))
    # Bounded: AUDITED and AUDITED_LINKED rows.
    samples = [some.orderBy(by).limit(AUDITED).toArrow(), some.where("links > 0").orderBy(by).limit(AUDITED_LINKED).toArrow()]
    asked = pa.concat_tables(samples).combine_chunks()
    if not len(asked):
        return 1.0
    node = asked.column("node").to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast((node, _matrix(asked.column("vector").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_nodes, asked_vectors = shared.value
        total = np.zeros(len(asked_nodes), np.int64)
        for batch in batches:
            here, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            near = (_matrix(batch.column("vector")) @ asked_vectors.T >= least) & (here[:, None] != asked_nodes)
            total += copies @ near
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "links"])

    true = nodes.mapInArrow(run, "at bigint, links bigint").groupBy("at").agg(F.sum("links").alias("links")).orderBy("at").toArrow()
    shared.unpersist()
    return share_found(asked.column("links").to_numpy(), true.column("links").to_numpy(), len(samples[0]))


def share_found(found: np.ndarray, true: np.ndarray, first: int) -> float:
    """The lesser mean share of found links, of the ``first`` audited vectors and of the others."""
    share = np.minimum(found, true) / np.maximum(true, 1)
    means = [part[here].mean() for part, here in ((share[:first], true[:first] > 0), (share[first:], true[first:] > 0)) if here.any()]
    return float(min(means, default=1.0))


def near_vectors(vectors: DataFrame, least: float = MIN_COSINE, shards: int | None = None, beam: int = BEAM, recall: float = RECALL) -> DataFrame:
    """Links between vectors (``vec_id``, ``embedding``) of cosine ``least`` or more, and what they join.

    Equal vectors are one node with a number of copies. Nodes are dealt over shards by hash; a shard is built
    into a hierarchical navigable small-world graph, and every node is sent through every shard: a beam
    search, then a walk over all neighbours inside the wanted cosine, so a dense group is found
    whole however many it has. Finds are checked by cosine in double precision. Links are counted and
    joined to trees inside the tasks, so what leaves them does not grow with the square of a group.
    An audit compares some vectors with all; while less than ``recall`` of a vector's links was found
    on average, the search runs again with twice the beam, at last over whole shards.

    Result, one row per input row: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id``
    (smallest vec_id reachable, itself included), ``kept`` (whether these are equal). Null and zero vectors
    and those with null or non-finite components link with nothing, and vectors of different length not
    with each other. Repeated ids are vectors of their own. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = take(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    ready = rows.withColumn("ok", usable(F.col("embedding")))
    nodes = written(
        ready.where("ok").groupBy("embedding")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), F.col("embedding").alias("vector"), "first_id", "copies"),
        "vectors_nodes",
    )
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")]
    lengths = nodes.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect()  # one row per length of vectors
    found = None
    for length in lengths:
        part = nodes.where(F.size("vector") == length.n)
        n = shards or max(SHARDS, -(-length["count"] // SHARD_VECTORS))
        dealt = part.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int"))
        graphs = written(_built(dealt.select("shard", "node", "copies", "vector")), "vectors_graphs")
        asked = part.select("node", "copies", "vector")
        parts, width = parts_of(length["count"], n, tasks(spark)), beam
        while True:
            got = written(_searched(graphs, asked, n, parts, width, least), "vectors_found")
            if width >= length["count"] or _audit(asked, got, least) >= recall:
                break
            width *= 2
        found = got if found is None else found.unionByName(got)
    if found is None:
        return rows.select("vec_id", *alone, F.lit(True).alias("kept"))
    edges = found.where("links < 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    joined = connected_components(edges)
    counts = found.where("links >= 0").groupBy("a").agg(F.sum("links").alias("links"))
    named = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = written(
        named.join(lowest, "component").join(counts, named.node == counts.a, "left")
        .select("vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")),
        "vectors_known",
    )
    return (
        ready.withColumn("key", F.when(F.col("ok"), F.col("embedding")))
        .join(small(known, 8 * (lengths[-1].n + 8)), F.col("key") == F.col("vector"), "left")
        .select(
            "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
