"""N-gram Jaccard join by vertical partitioning.

The global order of word n-grams runs from rare to frequent: n-grams that are not frequent come
first, by hash, then the frequent ones by count. Two sets that reach the threshold share an n-gram
in the part of each that the order puts first (the prefix), so only prefixes are joined for
candidates. For these the order is cut into fragments: partial overlaps are counted per fragment
and summed per pair, which gives the exact intersection.

* Null ids take part in no link and have no component; null, empty and blank texts have no set.
* Rows with equal sets form one class, whatever their ids; only classes are joined.
* N-grams are 64-bit hashes of the words (A-Z folded); within a pair 43 bits tell them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import settle
from . import linking
from .words import mix, shingles, slices, utf8

WIDTH = 5
PERCENT = 75
FRAGMENTS = 8  # of the n-grams that are not frequent; the frequent ones are a fragment of their own
FREQUENT = 4  # times in the texts that a task counts together
MAX_FREQUENT = 200_000  # n-grams ordered by count: shapes the order, never the result
KEY_BYTES = 64  # of a key in a broadcast
BITS = 1024  # of a sketch; 128 bytes per document
SENT_BYTES = 32 << 20  # keys up to this size are sent to texts and sets, more meet them in a shuffle


def _signature(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(h + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(h))
    return int(mix(np.array([total]))[0].astype(np.int64))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sorted n-gram sets of slices of a batch (id, text)."""
    data, offsets = utf8(batch.column(1))
    ids = batch.column(0).to_pylist()
    for a, b in slices(offsets):
        h, t = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        cuts = np.searchsorted(t, np.arange(b - a + 1))
        yield ids[a:b], [h[cuts[i] : cuts[i + 1]] for i in range(b - a)]


def sketches(sets: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Parity of the n-grams of every set in ``bits`` places: two sets differ in at least as many n-grams as bits."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for a in range(0, len(sets), 256):
        part = sets[a : a + 256]
        place = (mix(np.concatenate(part) ^ np.uint64(0x6A09E667)) & np.uint64(bits - 1)).astype(np.int64)
        row = np.repeat(np.arange(len(part)), [len(h) for h in part])
        odd = np.bincount(row * bits + place, minlength=len(part) * bits).reshape(len(part), bits) & 1
        out[a : a + 256] = np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)
    return out


def survey(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (id, n, class, row, mark) of all documents and rows (gram, times) of n-grams that a task met often."""
    schema = "id long, n long, class long, gram long, times long, row binary, mark array<long>"

    def rows(ids, n, cls, gram, times, keys=(), marks=()) -> pa.RecordBatch:
        left, right = len(ids), len(gram)
        pad = lambda v, before, after: pa.array([None] * before + list(v) + [None] * after, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                *(pad(c, 0, right) for c in (ids, n, cls)),
                *(pad(c, left, 0) for c in (gram, times)),
                pa.array([*keys, *[None] * right], pa.binary()),
                pa.array([*marks, *[None] * right], pa.list_(pa.int64())),
            ],
            names=["id", "n", "class", "gram", "times", "row", "mark"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def frequent() -> tuple[list, list]:
            gram, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= FREQUENT
            return gram[often].astype(np.int64).tolist(), times[often].tolist()

        for batch in batches:
            at = 0
            for ids, sets in _sets(batch, width):
                keys = batch.column(2).slice(at, len(ids)).to_pylist()
                at += len(ids)
                cls = [_signature(h) if len(h) else None for h in sets]
                for h, c in zip(sets, cls, strict=True):
                    if c is not None and c not in seen:
                        seen.add(c)
                        held.append(h)
                        size += len(h)
                gram, times = [], []
                if size > 2_000_000:
                    (gram, times), held, size, seen = frequent(), [], 0, set()
                yield rows(ids, [len(h) for h in sets], cls, gram, times, keys, list(sketches(sets).view(np.int64)))
        if held:
            yield rows([], [], [], *frequent())

    return documents.mapInArrow(run, schema)


class Order:
    """The global order: n-grams outside ``frequent`` by hash, then the frequent ones by count."""

    def __init__(self, grams: list[int], times: list[int]):
        gram = np.array(grams, np.int64).astype(np.uint64)
        by = np.argsort(gram)
        self.gram = gram[by]
        rank = np.empty(len(gram), np.int64)
        rank[np.lexsort((gram, np.array(times, np.int64)))] = np.arange(len(gram))
        self.rank = rank[by]

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank among the frequent n-grams, or -1."""
        if not len(self.gram):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.gram, h), len(self.gram) - 1)
        return np.where(self.gram[at] == h, self.rank[at], -1)


def _prefix(h: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Positions of the n-grams that come first: one more than may be missing in a linked set.

    With a set of its own size or a larger one a set has to share more: the head of the prefix, of
    the length given, is enough then.
    """
    n = len(h)
    keep = n - -(-percent * n // 100) + 1
    return np.lexsort((h, rank))[:keep], n - -(-2 * percent * n // (100 + percent)) + 1


def _columns(arrays: list[np.ndarray], names: list[str], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(arrays[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + rows]) for x in arrays], names=names)


def prefixes(documents: DataFrame, order, width: int, percent: int) -> DataFrame:
    """(key, item, head, frequent): the n-grams of the prefix of every class, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = order.value, set()
        for batch in batches:
            for _, sets in _sets(batch, width):
                keys, items, heads, often = [], [], [], []
                for h in sets:
                    if not len(h) or (cls := _signature(h)) in seen:
                        continue
                    seen.add(cls)
                    rank = known.ranks(h)
                    first, head = _prefix(h, rank, percent)
                    keys.append(h[first])
                    items.append(np.full(len(first), cls, np.int64))
                    heads.append(np.arange(len(first)) < head)
                    often.append(rank[first] >= 0)
                if keys:
                    arrays = [np.concatenate(keys).astype(np.int64), *map(np.concatenate, (items, heads, often))]
                    yield from _columns(arrays, ["key", "item", "head", "frequent"])

    return documents.mapInArrow(run, "key long, item long, head boolean, frequent boolean")


def segments(documents: DataFrame, order, width: int) -> DataFrame:
    """(class, fragment, grams): the set of every class, cut at fragments of the order; 5 bytes per n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = order.value, set()
        for batch in batches:
            for _, sets in _sets(batch, width):
                out = []
                for h in sets:
                    if not len(h) or (cls := _signature(h)) in seen:
                        continue
                    seen.add(cls)
                    often = known.ranks(h) >= 0
                    rare = h[~often]
                    cuts = np.searchsorted(rare >> np.uint64(61), np.arange(FRAGMENTS + 1))
                    parts = [rare[cuts[f] : cuts[f + 1]] for f in range(FRAGMENTS)] + [h[often]]
                    out += [(cls, f, _packed(p)) for f, p in enumerate(parts) if len(p)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)],
                        names=["class", "fragment", "grams"],
                    )

    return documents.mapInArrow(run, "class long, fragment int, grams binary")


def _packed(h: np.ndarray) -> bytes:
    return ((h >> np.uint64(21)) & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(grams: bytes) -> np.ndarray:
    out = np.zeros((len(grams) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(grams, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared): partial overlaps of the pairs in every fragment, summed per pair."""

    @F.pandas_udf("long")
    def shared(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(left, right, strict=True)
        return pd.Series([len(np.intersect1d(_unpacked(x), _unpacked(y))) for x, y in pairs], dtype="int64")

    one = sets.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("left"))
    two = sets.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("right"))
    partial = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", shared("left", "right").alias("part"))
    return partial.groupBy("a", "b").agg(F.sum("part").alias("shared"))


def group(documents: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable over links, of every document."""
    return components_of(documents, id, text, width, percent).select("doc_id", "n_shingles", "component_id")


def row_key(id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes that rows share only if id and text are equal."""
    known = F.concat_ws("|", F.coalesce(F.col(id).cast("string"), F.lit("")), F.col(text).isNull().cast("string"), F.col(text))
    return F.unhex(F.md5(known.cast("binary")))


def representatives(documents: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group of linked ones, with all its columns: that with the smallest id.

    Of rows that are alike in id and group the one with the smallest key stays, of rows equal in id
    and text that with the smallest other columns. Documents without words are groups of their own
    unless id and text are equal; rows without an id all stay.
    """
    found = components_of(documents, id, text, **options).filter("doc_id = component_id")
    alike = F.coalesce(F.col("label").cast("string").cast("binary"), F.concat(F.lit(b"row"), "row"))
    chosen = found.groupBy(alike.alias("group")).agg(F.min("row").alias("row")).select("row")
    # Each text moves once, by its key; its columns travel as one value and clash with none.
    named = documents.filter(F.col(id).isNotNull()).select(row_key(id, text).alias("row"), F.struct("*").alias("doc"))
    once = named.join(chosen, "row", "left_semi").groupBy("row").agg(F.min("doc").alias("doc")).select("doc.*")
    return once.unionByName(documents.filter(F.col(id).isNull()))


def components_of(documents: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """As ``group``, with ``row``, the key of a row, and ``label``, the same for rows of one component (null: no words)."""
    spark = documents.sparkSession
    read = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), row_key(id, text).alias("row"))
    surveyed = settle(survey(read, width), "survey")
    rows = surveyed.filter("n is not null").select("id", "n", "class", "row")
    often = surveyed.filter("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"))
    often = often.orderBy(F.desc("times"), "gram").limit(MAX_FREQUENT).toPandas()
    order = spark.sparkContext.broadcast(Order(often["gram"].tolist(), often["times"].tolist()))

    # A key of one class leads nowhere, and keys of the same classes count as one: ``among`` tells them. Frequent
    # keys skip the window: one of them may hold a third of all rows.
    named = read.filter("id is not null").select("id", "text")
    first = prefixes(named, order, width, percent)
    both = Window.partitionBy("key")
    told = {k: v.over(both) for k, v in linking.told("item").items()}
    rare = first.filter("not frequent").withColumns(told).filter("lo < hi").withColumn("among", F.xxhash64(*told))
    rest = first.filter("frequent").withColumn("among", F.col("key"))
    near = rare.drop(*told).unionByName(rest).repartition("item")
    near = near.groupBy("item", "among", "key").agg(F.max("head").alias("head"))
    near = near.groupBy("item", F.col("among").alias("key")).agg(F.max("head").alias("head"), F.count(F.lit(1)).alias("weight"))

    # What two linked classes share lies in the prefixes of both, which ``kept`` counts on either
    # side, or behind the prefix that ends first. That may be the prefix of either class, so what is
    # behind it is bounded by the larger class, never by the smaller one.
    sizes = rows.filter("class is not null").select(F.col("class").alias("item"), F.col("n").alias("size")).distinct()
    kept = F.sum("weight").over(Window.partitionBy("item"))
    most = F.expr(f"kept - 1 + ceil({percent} * size / 100)").cast("long")
    near = near.withColumn("kept", kept).join(sizes, "item").withColumn("most", most).drop("kept")
    postings = settle(near, "postings")
    sized = settle(postings.select(F.col("item").alias("class"), F.col("size").alias("n")).distinct(), "sizes")
    # A row of every class, by whose key its text is found again.
    places = settle(rows.filter("class is not null and id is not null").groupBy("class").agg(F.min("row").alias("row")), "places")
    made: list[DataFrame] = []

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Sets of the classes in pairs: made when a class is first asked for, and kept."""
        asked = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        asked = settle(asked, "asked")
        new = asked
        for known in made:
            new = new.join(known.select("class").distinct(), "class", "left_anti")
        new = settle(new.join(places, "class"), "places").select("row")
        if not made or not new.isEmpty():
            texts = read.filter("id is not null").join(sent(new), "row", "left_semi").select("id", "text")
            made.append(settle(segments(texts, order, width).dropDuplicates(["class", "fragment"]), "sets"))
        return reduce(DataFrame.unionByName, made).join(sent(asked), "class", "left_semi")

    def sent(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() * KEY_BYTES <= SENT_BYTES else keys

    # Sketches rule out pairs that merely share a passage, before any set is made or moved.
    marks = surveyed.filter("class is not null and id is not null").groupBy(F.col("class").alias("item")).agg(F.first("mark").alias("mark"))
    marks = settle(marks, "marks")

    def alike(x: str, y: str) -> Column:
        bits = sum((F.bit_count(F.col(f"{x}mark")[i].bitwiseXOR(F.col(f"{y}mark")[i])) for i in range(BITS // 64)), F.lit(0))
        return (100 + percent) * bits <= (100 - percent) * (F.col(f"{x}size") + F.col(f"{y}size"))

    def likely(pairs: DataFrame) -> DataFrame:
        known = marks.join(sized.withColumnRenamed("class", "item"), "item")
        one, two = (known.select(F.col("item").alias(s), F.col("mark").alias(f"{s}_mark"), F.col("n").alias(f"{s}_size")) for s in ("a", "b"))
        return settle(pairs.join(one, "a").join(two, "b").filter(alike("a_", "b_")).select("a", "b"), "likely")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = likely(pairs)
        n = lambda side: sized.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"))
        counted = overlaps(pairs, sets_of(pairs)).join(n("a"), "a").join(n("b"), "b")
        return counted.filter(f"100 * shared >= {percent} * (n_a + n_b - shared)").select("a", "b")

    def may(x: str, y: str) -> Column:
        small, large = F.least(f"{x}size", f"{y}size"), F.greatest(f"{x}size", f"{y}size")
        behind = lambda size: F.ceil(percent * size / 100)
        kept = F.least(*(F.col(f"{s}most") - behind(F.col(f"{s}size")) for s in (x, y)))
        return (100 * small >= percent * large) & ((100 + percent) * (kept + behind(large)) >= percent * (small + large))

    labels = linking.connect(postings, verify, may, marks, alike)

    # Classes that have no link are their own component; its id is the smallest id in it.
    known = rows.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    known = settle(known, "known")
    least = known.filter("class is not null and id is not null").groupBy("label").agg(F.min("id").alias("least"))
    found = known.join(least, "label", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("least", "id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), "row", "label")
