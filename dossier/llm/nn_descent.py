"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

The graph starts from cells of random hyperplanes. Every round joins the neighbours of each node
with each other: a task scores the members of one node's list at once, and only pairs better than
what a member has leave it. Queries walk the graph: each round expands the best nodes that a query
has found and not yet expanded.

* Vectors that are null, zero, of another length than most, or hold null or non-finite components
  take no part. Of rows with equal ids the least vector counts; null ids take no part.
* For the graph, vectors get one more component that makes their lengths equal, so that inner
  products order neighbours as distances do. It is kept apart, as what it lacks to the largest
  length, so that vectors far shorter than the longest keep their own scale. Scores are inner products of the vectors as given, in
  double precision.
* Equal scores are ordered by id. Cells and lists have a bounded size, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import settle

NEIGHBOURS = 32
TREES = 10
CELL = 256  # rows that meet at the start
ROUNDS = 4
EMIT = 6  # new neighbours per member and list
BEAM = 48  # nodes that a query expands in a step
POOL = 224  # nodes that a query remembers
STEPS = 8
PIVOTS = 64
LOW = -1e300  # below any product
FOUND = "array<struct<id:long,score:double>>"


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector as array of doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.select(F.col(id).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    return kept.groupBy("id").agg(F.min("v").alias("v"))


def _packed(v: np.ndarray, lack: np.ndarray) -> list[bytes]:
    """Vectors as a scale, ``lack`` and 8-bit components: near enough for the graph and the walk."""
    scale = np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300) / 127
    small = np.rint(v / scale).astype(np.int8)
    head = np.c_[scale, lack].astype("<f4")
    return [s.tobytes() + row.tobytes() for s, row in zip(head, small, strict=True)]


def _unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors without the graph's own component, and what that lacks to the largest length."""
    rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
    head = rows[:, :8].copy().view("<f4")
    return rows[:, 8:].view(np.int8).astype(np.float32) * head[:, :1], head[:, 1]


def prepare(rows: DataFrame) -> DataFrame:
    """(id, v, x): ``x`` has the graph's vector, packed, all of one length."""
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return rows.withColumn("x", F.lit(None).cast("binary"))
    rows = rows.filter(F.size("v") == lengths[0]["d"])
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]

    @F.pandas_udf("binary")
    def lifted(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_list()) if len(v) else np.zeros((0, 1))
        m = m / math.sqrt(most)
        square = (m * m).sum(axis=1)
        return pd.Series(_packed(m, square / (1 + np.sqrt(np.maximum(0, 1 - square)))))  # 1 - sqrt(1 - square)

    return rows.withColumn("x", lifted("v"))


def as_queries(nodes: DataFrame) -> DataFrame:
    """(query_id, q, qx) of nodes: a query has nothing in the graph's own component, so products keep their order."""

    @F.pandas_udf("binary")
    def flat(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_list()) if len(v) else np.zeros((0, 1))
        return pd.Series(_packed(m, np.zeros(len(m))))

    return nodes.select(F.col("id").alias("query_id"), F.col("v").alias("q"), flat("v").alias("qx"))


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Rows of one key after another, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(b"".join(column.to_pylist()), len(column))


def _local(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """For every group (key, id, x, least): the best other members of each member that beat its ``least``."""
    out: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        left, right, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(score)], names=["id", "near", "score"])

    for group in _groups(batches, 0):
        ids = group.column(1).to_numpy()
        x, lack = _matrix(group.column(2))
        least = group.column(3).to_numpy(zero_copy_only=False)
        # The product of the lengthened vectors, less 1: (1 - a)(1 - b) - 1 is the part of the added components.
        score = (x @ x.T - lack[:, None] - lack + np.outer(lack, lack)).astype(np.float32)
        score[ids[:, None] == ids[None, :]] = -np.inf
        k = min(top, len(ids) - 1)
        if k < 1:
            continue
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(score, best, axis=1)
        rows, cols = np.nonzero(value > least[:, None])
        if len(rows):
            out.append((ids[rows], ids[best[rows, cols]], value[rows, cols].astype(np.float64)))
            size += len(rows)
        if size > 200_000:
            yield made()
            out, size = [], 0
    if out:
        yield made()


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct neighbours of every node."""
    one = edges.groupBy("id", "near").agg(F.max("score").alias("score"))
    by = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    return one.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _start(nodes: DataFrame, n: int, neighbours: int, trees: int, seed: int) -> DataFrame:
    """Neighbours inside cells of random hyperplanes; a cell of many rows is dealt into parts of bounded size."""
    bits = max(1, math.ceil(math.log2(max(2, n / CELL))))

    @F.pandas_udf("array<long>")
    def cells(x: pd.Series) -> pd.Series:
        m = _unpacked(b"".join(x), len(x))[0] if len(x) else np.zeros((0, 1))
        rng = np.random.default_rng(seed)
        codes = []
        for _ in range(trees):
            plane = rng.standard_normal((m.shape[1], bits))
            codes.append(((m @ plane) > 0) @ (1 << np.arange(bits)))
        return pd.Series(list(np.stack(codes, axis=1).astype(np.int64)) if len(m) else [])

    told = nodes.select("id", "x", F.posexplode(cells("x")).alias("tree", "cell"))
    sizes = told.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("m"))
    part = F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("m") / CELL))
    dealt = told.join(sizes, ["tree", "cell"]).select(F.xxhash64("tree", "cell", part).alias("key"), "id", "x", F.lit(-9.0).alias("least"))
    return _joined(dealt, neighbours)


def _joined(groups: DataFrame, top: int) -> DataFrame:
    """The local join of every group (key, id, x, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _local(batches, top)

    dealt = groups.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "id", "x", F.col("least").cast("float")).mapInArrow(run, "id long, near long, score double")


def _both_ways(graph: DataFrame, most: int) -> DataFrame:
    """(key, member): nodes with their neighbours, and with the best of those that point at them."""
    by = Window.partitionBy("near").orderBy(F.desc("score"), "id")
    back = graph.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= most)
    return graph.select(F.col("id").alias("key"), F.col("near").alias("member")).unionByName(
        back.select(F.col("near").alias("key"), F.col("id").alias("member"))
    ).distinct()


def build(nodes: DataFrame, neighbours: int = NEIGHBOURS, trees: int = TREES, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """The neighbour graph (id, near, score, rank) of ``nodes`` (id, x)."""
    n = nodes.count()
    graph = settle(_best(_start(nodes, n, neighbours, trees, seed), neighbours), "graph")
    for _ in range(rounds):
        least = graph.filter(F.col("rank") == neighbours).select(F.col("id").alias("member"), F.col("score").alias("least"))
        vectors = nodes.select(F.col("id").alias("member"), "x").join(least, "member", "left")
        lists = _both_ways(graph, neighbours // 2).join(vectors, "member")
        lists = lists.select("key", F.col("member").alias("id"), "x", F.coalesce("least", F.lit(-9.0)).alias("least"))
        found = _joined(lists, EMIT)
        graph = settle(_best(graph.select("id", "near", "score").unionByName(found), neighbours), "graph")
    return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, k: int, steps: int = STEPS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): greedy search from the pivots and the query's own node, if it has one.

    ``queries``: (query_id, q, qx), vector as given and packed; a node with the query's id is not among its results.
    """
    # Every node with the packed vectors of its neighbours: what a walk needs to step on.
    members = _both_ways(graph, neighbours // 2).join(nodes.select(F.col("id").alias("member"), "x"), "member")
    lists = members.groupBy("key").agg(F.collect_list("member").alias("near"), F.collect_list("x").alias("xs"))
    lists = settle(lists, "lists")
    # The longest vectors are near no other one, but have the largest products with half of the queries.
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    by_hash = nodes.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("id", "x")
    pivots = by_hash.union(nodes.orderBy(F.desc(length), "id").limit(PIVOTS).select("id", "x")).distinct().orderBy("id").collect()
    if not pivots:
        return queries.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    ids, table = np.array([p["id"] for p in pivots]), _unpacked(b"".join(bytes(p["x"]) for p in pivots), len(pivots))[0]

    @F.pandas_udf(FOUND)
    def enter(q: pd.Series, own: pd.Series) -> pd.Series:
        score = _unpacked(b"".join(q), len(q))[0] @ table.T
        out = []
        for row, me in zip(score, own, strict=True):
            best = [i for i in np.argsort(-row) if ids[i] != me]
            out.append([{"id": int(ids[i]), "score": float(row[i])} for i in best])
        return pd.Series(out)

    @F.pandas_udf(FOUND)
    def step(q: pd.Series, own: pd.Series, near: pd.Series, xs: pd.Series, least: pd.Series) -> pd.Series:
        out = []
        for a, me, others, x, low in zip(q, own, near, xs, least, strict=True):
            score = _unpacked(b"".join(x), len(x))[0] @ _unpacked(a, 1)[0][0]
            good = np.flatnonzero((score > low) & (others != me))
            out.append([{"id": int(others[i]), "score": float(score[i])} for i in good])
        return pd.Series(out)

    def found(rows: DataFrame, made: Column) -> DataFrame:
        return rows.select("query_id", F.explode(made).alias("f")).select("query_id", "f.id", "f.score")

    def best(pool: DataFrame) -> DataFrame:
        one = pool.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("expanded").alias("expanded"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return one.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= POOL)

    new = F.lit(False).alias("expanded")
    told = queries.select("query_id", "qx")
    start = found(told, enter("qx", "query_id"))
    near = told.join(lists, told["query_id"] == lists["key"])
    near = found(near, step("qx", "query_id", "near", "xs", F.lit(LOW)))
    pool = settle(best(start.unionByName(near).select("*", new)), "pool")
    for _ in range(steps):
        front = pool.filter(~F.col("expanded")).withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
        front = front.filter(F.col("turn") <= BEAM).select("query_id", "id")
        least = pool.filter(F.col("place") == POOL).select("query_id", F.col("score").alias("least"))
        walk = front.join(told.join(least, "query_id", "left"), "query_id").join(lists, F.col("id") == F.col("key"))
        fresh = found(walk, step("qx", "query_id", "near", "xs", F.coalesce("least", F.lit(LOW))))
        done = front.withColumn("now", F.lit(True))
        marked = pool.join(done, ["query_id", "id"], "left").withColumn("expanded", F.col("expanded") | F.coalesce("now", F.lit(False)))
        pool = settle(best(marked.select("query_id", "id", "score", "expanded").unionByName(fresh.select("*", new))), "pool")

    @F.pandas_udf("double")
    def product(q: pd.Series, v: pd.Series) -> pd.Series:
        if not len(q):
            return pd.Series([], dtype="float64")
        return pd.Series((np.stack(q.to_list()) * np.stack(v.to_list())).sum(axis=1))

    exact = pool.select("query_id", "id").join(nodes.select("id", "v"), "id").join(queries.select("query_id", "q"), "query_id")
    exact = exact.select("query_id", F.col("id").alias("vec_id"), product("q", "v").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = exact.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """The ``k`` nearest other rows of those rows whose ``id`` fulfils ``queries``, a condition on ``id``."""
    nodes = settle(prepare(usable(rows, id, vector)), "nodes")
    graph = build(nodes)
    return search(settle(as_queries(nodes.filter(queries)), "queries"), nodes, graph, k)
