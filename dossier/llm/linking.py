"""Links between items that share keys, without a row per pair of a large group.

``postings`` says which items carry which key. Two items may be linked only if they share a key;
``verify`` decides. The result is exact for connectivity: every linked pair ends in one component.

In rounds, every key whose items lie in several components elects one of them as its leader, and
every item outside the leader's component turns to the one leader that most of its keys name: at
most one pair per item and round. Most links of a large group of near copies are found so. When a
round finds no link any more, the items that still share a key over components meet in pairs. Keys
with the same items count as one there, so that a pair meets about once, however many keys it shares.

An item without a partner has no row in the result; empty postings give an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import settle
from .components import components

ROUNDS = 4  # only shapes the work: what rounds leave over meets in pairs

PARTS = ("item", "size", "most", "head")


def told(item: str) -> dict[str, Column]:
    """Aggregates over the items of a key that are the same for keys with the same items.

    Where others have them too by chance, keys are taken together that are not the same: more meet, none are lost.
    """
    some = F.shiftrightunsigned(F.xxhash64(item), 32)
    return {"lo": F.min(item), "hi": F.max(item), "total": F.sum(some), "items": F.count(F.lit(1))}


def connect(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    may: Callable[[str, str], Column],
    marks: DataFrame | None = None,
    alike: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """``node`` and ``label`` of every item linked with another one; ``postings`` has distinct rows of a written table.

    ``postings``: (key, item, size, most, head), ``most`` being the largest part of the item that
    another one of at most its size can share; a key joins two items only if it is a ``head`` key of the smaller one.
    ``weight``, if given, is the number of keys that a key stands for.
    ``may(x, y)``: whether the items whose columns start with ``x`` and ``y`` can be linked at all;
    ``verify``: the linked ones among distinct pairs (a, b). ``marks`` (item, mark) and ``alike``, which
    reads the columns ``size`` and ``mark``, rule out more pairs where all items of a key meet.
    """

    def meet(x: str, y: str) -> Column:
        first = F.struct(f"{x}size", f"{x}item") < F.struct(f"{y}size", f"{y}item")
        return may(x, y) & F.when(first, F.col(f"{x}head")).otherwise(F.col(f"{y}head"))

    labels = settle(postings.select(F.col("item").alias("node"), F.col("item").alias("label")).distinct(), "labels")
    rows, tried = postings.withColumn("label", F.col("item")), None
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.lit(1).cast("long"))
    for number in range(ROUNDS):
        # The first leader is the item with the least that is its own, later ones go by hash.
        own = F.round(1 - F.col("most") / F.col("size"), 6) if number == 0 else F.lit(0.0)
        rank = F.struct(own, F.xxhash64("item", F.lit(number)), *PARTS, "label")
        lead = rows.groupBy("key").agg(F.min(rank).alias("lead"))
        lead = lead.select("key", *(F.col(f"lead.{c}").alias(f"other_{c}") for c in (*PARTS, "label")))
        asked = rows.join(lead, "key").filter("label <> other_label").filter(meet("", "other_"))
        votes = asked.groupBy("item", "other_item").agg(F.sum("weight").alias("n"))
        chosen = votes.groupBy("item").agg(F.max(F.struct("n", F.xxhash64("item", "other_item"), "other_item")).alias("m"))
        pairs = _pairs(chosen.select("item", F.col("m.other_item").alias("other_item")))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = settle(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = settle(verify(pairs), "links")
        if links.isEmpty():
            break
        labels = settle(_joined(labels, links), "labels")
        # Keys whose items are all in one component are done.
        named = rows.drop("label").join(labels.select(F.col("node").alias("item"), "label"), "item")
        open_ = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
        rows = settle(named.join(open_, "key"), "open")
    return _met_in_pairs(rows, labels, tried, verify, meet, marks, alike)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links, which are followed between components only."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    edges = links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = components(edges).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return labels.join(merged, "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def _met_in_pairs(rows: DataFrame, labels: DataFrame, tried: DataFrame, verify, meet, marks, alike) -> DataFrame:
    """All items of a key outside the component of one of them with the others of the key."""
    # Keys with the same items, which may have become so in the rounds, are one.
    among = rows.groupBy("key").agg(*(v.alias(k) for k, v in told("item").items()))
    among = among.select("key", F.xxhash64("lo", "hi", "total", "items").alias("among"))
    once = rows.drop("weight").join(among, "key").groupBy("item", "among", *(c for c in PARTS if c not in ("item", "head")), "label")
    rows = settle(once.agg(F.max("head").alias("head")).withColumnRenamed("among", "key"), "once")
    names = [*PARTS, "label"]
    if marks is not None:
        rows, names = settle(rows.join(marks, "item"), "marked"), [*names, "mark"]
    one = F.min(F.struct(F.xxhash64("item"), "label"))["label"]
    main = rows.groupBy("key").agg(one.alias("main"))
    rest = rows.join(main, "key").filter("label <> main").select("key", "main", *(F.col(c).alias(f"other_{c}") for c in names))
    # Two items that are both outside meet from one side.
    wanted = (F.col("label") != F.col("other_label")) & ((F.col("label") == F.col("main")) | (F.col("item") < F.col("other_item"))) & meet("", "other_")
    if marks is not None:
        wanted &= alike("", "other_")
    met = rest.join(rows, "key").filter(wanted).select("item", "other_item")
    pairs = settle(_pairs(met).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = settle(verify(pairs), "links")
    found = labels if links.isEmpty() else _joined(labels, links)
    several = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label")
    return found.join(several, "label", "left_semi").select("node", "label")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("item", "other_item").alias("a"), F.greatest("item", "other_item").alias("b")).distinct()
