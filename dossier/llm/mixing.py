"""Mixing sources to target weights.

Every source is a stream of words, cut into blocks of a fixed number of words. Each output shard
draws from a multinomial how many slots every source gets; a slot finds its block through a
pseudorandom permutation of the source's blocks, and blocks and slots meet in a join by index.

* A document without words takes no part in the streams and takes 0 words of the mix.
* Null is a source of its own, and the last one. Null texts count as empty.
* Rows that repeat, with equal or null ids, are documents of their own; each has its own place.
* Draws, order and permutations depend on the seed and the ids alone, so reruns agree.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import settle
from .words import WORD
from .words import mix as scramble

BLOCK_WORDS = 1024
SHARDS = 64
CHUNK = 4096  # slots per row before they are spread out
BUCKETS = 1024  # pieces of a source's order whose sizes are summed on their own


@dataclass
class Mix:
    """``documents``: the rows with their place; ``slots``: the blocks that the mix takes;
    ``pieces``: the words of documents in every slot; ``sources``: sizes and targets."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id: str, text: str, source: str) -> Column:
    """The same for rows that are alike in id, text and source; those are interchangeable."""
    return F.xxhash64(F.col(id).cast("string"), F.lit("|"), F.col(text), F.lit("|"), F.col(source))


def shares(sizes: Sequence[int], weights: Sequence[float], repeats: float = 3.0) -> list[float]:
    """Targets that share all words by weight; none above ``repeats`` times its source, the rest is dealt again."""
    total, target = float(sum(sizes)), [0.0] * len(sizes)
    free, left = list(range(len(sizes))), total
    while free and left > 0:
        by = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / by > repeats * sizes[i]]
        for i in full or free:
            target[i] = repeats * float(sizes[i]) if full else left * weights[i] / by
        if not full:
            break
        left -= sum(target[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return target


def draw_counts(quota: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Slots per shard and source: a multinomial draw for each shard from what the quotas leave.

    The chances of a shard follow the quotas that are open, so that all shards together use up
    every quota exactly; a count above its open quota is drawn again among the others.
    """
    rng = np.random.default_rng(seed)
    left = np.array(quota, np.int64)
    out = np.zeros((shards, len(left)), np.int64)
    for s in range(shards):
        want = int(left.sum()) // (shards - s)
        while want:
            drawn = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[s] += drawn
            left -= drawn
            want -= int(drawn.sum())
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 per key: a four-round Feistel network that walks its cycles."""
    out, n = index.astype(np.uint64), size.astype(np.uint64)
    half = np.uint64(1) + np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            with np.errstate(over="ignore"):
                f = scramble(right + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn << 56))
            left, right = right, left ^ (f & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo.copy()
        todo[todo] = out[todo] >= n[todo]
    return out.astype(np.int64)


def mix(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    repeats: int = 3,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = 7,
) -> Mix:
    """Deal the words of ``documents`` so that sources share them by ``weights`` (repeating, in code point order)."""
    spark = documents.sparkSession
    rows = documents.select(
        F.col(id).alias("doc_id"),
        F.col(source).alias("source"),
        count_words(F.col(text)).alias("size"),
        row_key(id, text, source).alias("row_key"),
    ).withColumn("place", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")))
    rows = settle(rows.withColumn("bucket", F.pmod("place", F.lit(BUCKETS)).cast("int")), "mix-rows")

    # One row per source reaches the driver.
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    targets = shares(sizes, [weights[i % len(weights)] for i in range(len(found))], float(repeats))
    # The last slot of a source takes only the words that its target still lacks.
    words = [min(round(t), repeats * n) for t, n in zip(targets, sizes, strict=True)]
    blocks = [math.ceil(n / block_words) for n in sizes]
    quota, last = [], []
    for w, n, b in zip(words, sizes, blocks, strict=True):
        whole, rest = divmod(w, n) if n else (0, 0)
        quota.append(whole * b + math.ceil(rest / block_words))
        last.append(rest)
    counts = draw_counts(quota, shards, seed)
    starts = np.cumsum(counts, axis=0) - counts
    schema = "source_no int, source string, source_size long, target double, n_blocks long, rest long"
    known = spark.createDataFrame(
        [(i, r["source"], sizes[i], targets[i], blocks[i], last[i]) for i, r in enumerate(found)], schema
    )
    dealt = spark.createDataFrame(
        [
            (s, i, int(starts[s, i]), int(counts[s, i]))
            for s in range(shards)
            for i in range(len(found))
            if counts[s, i]
        ],
        "shard int, source_no int, first_slot long, n_slots long",
    )
    slots = _slots(dealt, known, block_words, seed)
    placed = _placed(rows, known)
    pieces = _pieces(placed, block_words)
    joined = slots.join(pieces, ["source_no", "block"]).withColumn(
        "words", F.least(F.col("length"), F.col("block_take") - F.col("at"))
    )
    return Mix(placed, known, slots, joined.filter("words > 0").drop("block_take", "length"))


def _slots(dealt: DataFrame, known: DataFrame, block_words: int, seed: int) -> DataFrame:
    """One row per slot: shard, source, slot number, block and the words it takes of the block."""
    chunks = dealt.join(known.drop("source"), "source_no").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(CHUNK).cast("long"))).alias("chunk")
    )
    # Chunks are dealt out before they unfold: one shard of a hot source may hold most slots.
    chunks = chunks.repartition("source_no", "shard", "chunk")
    each = chunks.select(
        "shard",
        "source_no",
        "n_blocks",
        "rest",
        "source_size",
        F.explode(
            F.sequence(
                F.col("first_slot") + F.col("chunk"),
                F.col("first_slot") + F.least(F.col("n_slots"), F.col("chunk") + CHUNK) - 1,
            )
        ).alias("slot"),
    )

    @F.pandas_udf("long")
    def block_of(slot: pd.Series, n: pd.Series, source: pd.Series) -> pd.Series:
        key = source.to_numpy() * 1_000_003 + seed
        return pd.Series(permute(slot.to_numpy() % n.to_numpy(), n.to_numpy(), key))

    # Whole rounds take every block in permuted order. The last round permutes the blocks that are
    # full and takes as many as the target goes, the very last one in part, so that words are exact;
    # the short block at the end of the stream comes after all of them.
    whole = F.floor(F.col("slot") / F.col("n_blocks")) < F.col("rounds")
    full = F.floor(F.col("source_size") / block_words)
    each = each.join(_rounds(known), "source_no").withColumn("number", F.col("slot") % F.col("n_blocks"))
    dealt_of = F.when(whole, F.col("n_blocks")).otherwise(F.greatest(full, F.lit(1)))
    drawn = whole | (F.col("number") < full)
    block = F.when(drawn, block_of("number", dealt_of, "source_no")).otherwise(F.col("number"))
    take = F.when(whole, F.lit(block_words)).otherwise(F.col("rest") - F.col("number") * block_words)
    return each.select(
        "shard", "source_no", "slot", block.alias("block"), F.least(take, F.lit(block_words)).cast("long").alias("block_take")
    )


def _rounds(known: DataFrame) -> DataFrame:
    """How often every block of a source is taken whole."""
    return known.select("source_no", F.when(F.col("source_size") > 0, F.floor((F.round("target") - F.col("rest")) / F.col("source_size"))).otherwise(0).alias("rounds"))


def _placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Every document with the position of its first word in the stream of its source.

    A hot source is summed in buckets; only the order inside a bucket needs a window.
    """
    numbered = rows.join(known, rows["source"].eqNullSafe(known["source"])).drop(known["source"])
    sums = numbered.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("before"))
    inside = (
        Window.partitionBy("source_no", "bucket")
        .orderBy("place", "doc_id", "size", "row_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        numbered.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["source_no", "bucket"])
        .select(
            "doc_id", "row_key", "source", "size", "source_no", "source_size", "target", (F.col("before") + F.col("inside")).alias("start")
        )
    )


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """Documents cut at block borders: block, place in the block, first word of the document, words."""
    end = F.col("start") + F.col("size") - 1
    cut = placed.filter("size > 0").select(
        "doc_id",
        "row_key",
        "source_no",
        "start",
        "size",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor(end / block_words))).alias("block"),
    )
    left = F.greatest(F.col("start"), F.col("block") * block_words)
    right = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return cut.select(
        "doc_id",
        "row_key",
        "source_no",
        "start",
        "size",
        "block",
        (left - F.col("block") * block_words).alias("at"),
        (left - F.col("start")).alias("first_word"),
        (right - left).alias("length"),
    )


def taken(mixed: Mix) -> DataFrame:
    """Words that the mix takes of every document, repeats counted, and the ``shards`` they go to."""
    sums = mixed.pieces.groupBy("source_no", "start").agg(
        F.sum("words").alias("taken"), F.array_join(F.array_sort(F.collect_set("shard")), ",").alias("shards")
    )
    rows = mixed.documents
    # A document without words shares its start with its successor, and takes nothing.
    return rows.join(sums, ["source_no", "start"], "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.coalesce("shards", F.lit(""))).otherwise("").alias("shards"),
    )


def texts(mixed: Mix, documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as rows of ``documents``: one per document and round, with the words that are taken.

    White space between words that stay neighbours is kept. Rows that are alike share one text.
    """
    round_ = F.floor(F.col("slot") / F.col("n_blocks"))
    spans = (
        mixed.pieces.join(mixed.sources.select("source_no", "n_blocks"), "source_no")
        .groupBy("row_key", "size", "source_no", "start", round_.alias("round"))
        .agg(F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("spans"))
        .select("row_key", "size", "spans")
    )
    names = documents.columns
    # The row travels as one value, so that its columns clash with none of these.
    known = documents.select(row_key(id, text, source).alias("row_key"), F.struct("*").alias("whole")).dropDuplicates(["row_key"])

    @F.pandas_udf("string")
    def cut(whole: pd.Series, size: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, int(n), s) for t, n, s in zip(whole, size, spans, strict=True)], dtype=object)

    joined = known.join(spans, "row_key").withColumn("cut", cut(F.col("whole")[text], F.col("size"), F.col("spans")))
    return joined.select(*(F.col("cut").alias(n) if n == text else F.col("whole")[n].alias(n) for n in names))


_WORD = re.compile(WORD)


def _cut(text: str, size: int, spans) -> str:
    if sum(s["words"] for s in spans) >= size:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    parts, end = [], -1
    for s in spans:
        a, b = s["first_word"], s["first_word"] + s["words"] - 1
        if parts and a == end + 1:
            parts[-1] += text[at[end][1] : at[b][1]]
        else:
            parts.append(text[at[a][0] : at[b][1]])
        end = b
    return "\n".join(parts)
