"""Exact top-k by cosine (or dot product) between two sets of vectors.

Scores are never rows: blocks of both sides meet inside tasks and only the k best leave them. With a
group, only the best row of each group counts, so k different groups come back wherever k exist.

* queries small (checked): they are broadcast, the corpus streams past without a shuffle, every task
  emits at most k rows per query and a window merges them;
* corpus small (checked): it is broadcast, the queries stream past and are final at once;
* neither: the smaller side is cut by hash into slabs of bounded size that are sent one after
  another. The larger side streams past each of them and is never shuffled by key; the k best per
  slab are written before the next slab is sent.

The side that streams past is dealt evenly to all cores if it is small beside the work (``_spread``).

Dense rows that stream past held queries are clustered inside their block. Centre and radius bound
every score of a cluster, so a cluster below a query's k-th score so far is not compared with it.
Sparse rows meet in tiles: postings of their rarer keys and a product of the most frequent ones in
single precision find the cells that can reach the k-th score, and only those are scored exactly.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.stages import hold, settle, shared_dir
from .blocks import best_for_held, best_for_streamed, index_block, make_block

HELD_BYTES = 64 << 20
TILE_BYTES = 64 << 20

# The side that streams past is dealt to all cores if it has at most so many bytes per core and at least
# so many pairs are to be compared. A small file, however many rows, would otherwise be one task.
SPREAD_BYTES = 256 << 20
SPREAD_PAIRS = 1 << 25
SPREAD_QUERIES = 256

# Where so many pairs of sparse rows are to be compared, the queries meet one of so many corpus rows first: their
# k-th score there is a floor for their lists.
FLOOR_PAIRS = 1 << 28
SAMPLED = 32


def _side(df: DataFrame, id: str, vector: str | tuple[str, str], group: str | None = None) -> DataFrame:
    # Null vectors are dropped inside the blocks: a filter here would be pushed below the projection
    # that computes the vectors and compute them twice.
    names = {"vector": vector} if isinstance(vector, str) else dict(zip(("keys", "values"), vector))
    if group:
        names["group"] = group
    return df.select(F.col(id).alias("id"), *[F.col(c).alias(n) for n, c in names.items()])


def _entry_bytes(side: DataFrame) -> Column:
    """Approximate memory of one row in a block."""
    if "vector" in side.columns:
        return F.size("vector") * 8 + 16
    entry = F.size("keys") * 32 + 16
    if dict(side.dtypes)["keys"] == "array<string>":
        entry = entry + F.octet_length(F.array_join("keys", "")) + F.size("keys") * 64
    return entry


def _measure(side: DataFrame) -> tuple[int, int]:
    row = side.agg(F.count(F.lit(1)).alias("n"), F.sum(_entry_bytes(side)).alias("b")).first()
    return row["n"], row["b"] or 0


def _spread(side: DataFrame, rows: int, size: int, other_rows: int, written: bool = False) -> DataFrame:
    """The side that streams past, dealt to all cores where there is much to compare and little to move.

    Sparse rows are always little beside their work; each part of them becomes tiles.
    """
    cores = side.sparkSession.sparkContext.defaultParallelism
    rounds = max(1, math.ceil(size / (SPREAD_BYTES * cores)))
    if rows * other_rows < SPREAD_PAIRS or (rounds > 1 and "vector" in side.columns):
        return side
    dealt = side.repartition(cores * rounds)
    return settle(dealt, "streamed") if written else dealt


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    corpus_id: str = "person_id",
    vector: str | tuple[str, str] = "embedding",
    normalize: bool = True,
    positive: bool = False,
    group: str | None = None,
    distinct: bool = False,
    held_bytes: int = HELD_BYTES,
    tile_bytes: int = TILE_BYTES,
    compared: Accumulator | None = None,
) -> DataFrame:
    """``(query_id, corpus_id[, group], score, rank)``: the k best corpus rows per query, ties by corpus id.

    ``vector`` is an array column (dense) or a pair of parallel array columns (sparse keys, values).
    ``positive`` drops scores of zero and below, i.e. sparse rows that share no key. ``group`` is a
    corpus column that is handed on; ``distinct`` then takes the best row of each group only, and a
    null group is one group. ``compared`` adds up the work: pairs of dense rows whose score was
    computed, or entries of sparse rows that were multiplied.
    """
    if distinct and group is None:
        raise ValueError("distinct needs a group")
    q, c = _side(queries, query_id, vector), _side(corpus, corpus_id, vector, group)
    types = {"query": q.schema["id"].dataType, "id": c.schema["id"].dataType, "score": T.DoubleType()}
    if group:
        types["group"] = c.schema["group"].dataType
    search = _Search(k, normalize, positive, distinct, types, compared)

    q_rows, q_bytes = _measure(q)
    if q_bytes <= held_bytes:
        if q_rows >= SPREAD_QUERIES:
            c_rows, c_bytes = _measure(c)
            c = _spread(c, c_rows, c_bytes, q_rows)
            if "keys" in q.columns and q_rows * c_rows >= FLOOR_PAIRS:
                q = search.with_floors(q, c, q_rows, q_bytes, max(SAMPLED, math.ceil(c_bytes / HELD_BYTES)))
        found, sent = search.hold_queries(q, c)
        hold(sent)
        found = search.best(found)
    else:
        c_rows, c_bytes = _measure(c)
        if c_bytes <= held_bytes:
            found, sent = search.hold_corpus(_spread(q, q_rows, q_bytes, c_rows), c)
            hold(sent)
            found = search.best(found)
        else:
            if "keys" in q.columns and q_rows * c_rows >= FLOOR_PAIRS:
                q = search.with_floors(q, c, q_rows, q_bytes, max(SAMPLED, math.ceil(c_bytes / HELD_BYTES)))
            queries_are_small = q_bytes <= c_bytes
            n = max(1, math.ceil(min(q_bytes, c_bytes) / tile_bytes))
            # Every slab reads the larger side: dealt out and written once.
            if queries_are_small:
                c = _spread(c, c_rows, c_bytes, q_rows, written=n > 1)
            else:
                q = _spread(q, q_rows, q_bytes, c_rows, written=n > 1)
            found = search.slabs(q, c, queries_are_small, n)
    return found.select(
        F.col("query").alias(query_id),
        F.col("id").alias(corpus_id),
        *([F.col("group").alias(group)] if group else []),
        "score",
        "rank",
    )


class _Search:
    """How blocks meet, for fixed settings."""

    def __init__(self, k: int, normalize: bool, positive: bool, distinct: bool, types: dict, compared: Accumulator | None):
        self.k, self.normalize, self.positive, self.distinct = k, normalize, positive, distinct
        self.grouped, self.compared = "group" in types, compared
        self.schema = T.StructType([T.StructField(n, t) for n, t in types.items()])
        self.arrow = pa.schema([(n, to_arrow_type(t)) for n, t in types.items()])

    def best(self, found: DataFrame) -> DataFrame:
        """The k best of all rows found by the tasks."""
        order = [F.desc("score"), F.asc("id")]
        if self.distinct:
            # Dealt by query once: that serves both windows.
            first = F.row_number().over(Window.partitionBy("query", "group").orderBy(*order))
            found = found.repartition("query").withColumn("_n", first).filter("_n = 1").drop("_n")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
        return found.withColumn("rank", rank).filter(F.col("rank") <= self.k)

    def with_floors(self, q: DataFrame, c: DataFrame, rows: int, size: int, share: int) -> DataFrame:
        """The queries with a score that the k-th of their list reaches: that among one of ``share`` corpus rows."""
        sample = c.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(share)) == 0)
        found, held = self.hold_corpus(_spread(q, rows, size, rows), sample)
        last = self.best(found).filter(F.col("rank") == self.k).select(F.col("query").alias("id"), F.col("score").alias("floor"))
        floors = settle(q.join(last, "id", "left"), "floors")
        held.destroy()
        return floors

    def hold_queries(self, q: DataFrame, c: DataFrame) -> tuple[DataFrame, Broadcast]:
        held = q.sparkSession.sparkContext.broadcast(make_block(q.toArrow(), self.normalize))
        k, normalize, positive, distinct, grouped = self.k, self.normalize, self.positive, self.distinct, self.grouped
        arrow, compared = self.arrow, self.compared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = (make_block(pa.Table.from_batches([b]), normalize) for b in batches)
            best = best_for_held(blocks, held.value, k, positive, distinct, grouped, compared)
            yield from pa.Table.from_pandas(best, arrow, preserve_index=False).to_batches(100_000)

        return c.mapInArrow(run, self.schema), held

    def hold_corpus(self, q: DataFrame, c: DataFrame) -> tuple[DataFrame, Broadcast]:
        held = q.sparkSession.sparkContext.broadcast(make_block(c.toArrow(), self.normalize))
        k, normalize, positive, distinct = self.k, self.normalize, self.positive, self.distinct
        arrow, compared = self.arrow, self.compared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexed = index_block(held.value)
            for b in batches:
                block = make_block(pa.Table.from_batches([b]), normalize)
                best = best_for_streamed(block, indexed, k, positive, distinct, compared)
                yield from pa.Table.from_pandas(best, arrow, preserve_index=False).to_batches(100_000)

        return q.mapInArrow(run, self.schema), held

    def slabs(self, q: DataFrame, c: DataFrame, queries_are_small: bool, n: int) -> DataFrame:
        """Send the smaller side in ``n`` slabs, one after another; the other side is read once per slab."""
        spark, folder = q.sparkSession, f"{shared_dir(q.sparkSession)}/slabs-{uuid.uuid4().hex}"
        slab = F.pmod(F.xxhash64("id"), F.lit(n))
        paths = []
        for i in range(n):
            if queries_are_small:
                found, held = self.hold_queries(q.filter(slab == i), c)
                found = self.best(found).drop("rank")  # all that concerns these queries
            else:
                found, held = self.hold_corpus(q, c.filter(slab == i))
            paths.append(f"{folder}/{i}")
            found.write.parquet(paths[-1])
            held.destroy()
        parts = [spark.read.schema(self.schema).parquet(p) for p in paths]
        return self.best(reduce(DataFrame.unionByName, parts))
