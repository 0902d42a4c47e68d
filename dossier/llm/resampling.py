"""Importance resampling towards a target corpus, over hashed word features.

Words come from an untrained regular expression split of the ``tokenizers`` library, which reads the
text with A-Z lower-cased and gives words with their offsets. Windows of neighbouring offset pairs
are the features, CRC-32 of their bytes names their buckets. Both corpora are counted into
histograms, the gain of a bucket compares its shares in the two, and the gains of a document's
features add up to its weight. Gumbel noise on the weights makes the highest scores a draw.

Texts are split once: the buckets of each document are written to a table, which the counting and
the weighing read. Histograms have a fixed number of buckets, so they fit the driver whatever the
input. Ranks come from a sorted table whose parts are counted, never from one window over all rows.

Defined results: a null or empty text has no features and weighs 0; a null id reads as an empty
string in the noise and comes first among ties; of rows equal in score and id the first one ranks
first; an empty corpus has S (or T) of 0; an empty table gives no rows; other columns of the
documents play no part. Texts longer than ``PIECE`` code points are split in pieces that end between
two words, and windows go on across them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from ..sources.stages import settle

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between two words of an ASCII-lowered text
BUCKETS = 10_000
SCALE = 1000
SEED = 2024
PIECE = 1 << 20
KNOWN = 1 << 17  # words whose bucket a task remembers
FLUSH = 1 << 20  # features of an outgoing batch

FEATURES = "row long, id long, n_words long, buckets array<int>"


def lowered(text: str) -> str:
    """The text with A-Z, and nothing else, in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``limit`` code points that end between two words."""
    gap, at = re.compile(GAP), 0
    while len(text) - at > limit:
        cut = gap.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


class Splitter:
    """Buckets of the feature windows of a text."""

    def __init__(self, width: int = 1, buckets: int = BUCKETS, limit: int = PIECE):
        self.split = pre_tokenizers.Split(Regex(GAP), "removed")
        self.width, self.buckets, self.limit = width, buckets, limit
        self.known: dict[str, int] = {}

    def bucket(self, feature: str) -> int:
        if len(self.known) >= KNOWN:
            self.known.clear()
        found = self.known[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % self.buckets
        return found

    def words(self, text: str) -> Iterator[list[str]]:
        for piece in pieces(lowered(text), self.limit):
            yield [word for word, (start, end) in self.split.pre_tokenize_str(piece) if start < end]

    def __call__(self, text: str | None) -> tuple[int, list[int]]:
        """Number of words, and the bucket of every run of 1 to ``width`` words."""
        found: list[int] = []
        n, before, known = 0, [], self.known
        for words in self.words(text or ""):
            n += len(words)
            found += [known[w] if w in known else self.bucket(w) for w in words]
            if self.width > 1:
                # Windows of more words that end in this piece; they may start in the one before.
                run = before + words
                for size in range(2, self.width + 1):
                    for start in range(max(0, len(before) - size + 1), len(run) - size + 1):
                        found.append(self.bucket(" ".join(run[start : start + size])))
                before = run[-(self.width - 1) :]
        return n, found


def features(docs: DataFrame, id: str | None = "doc_id", text: str = "text", width: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``(row, id, n_words, buckets)`` of every document, as a written table."""
    key = F.col(id).cast("long") if id else F.lit(None).cast("long")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), key.alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(width, buckets)
        for batch in batches:
            first, counts, ends, held = 0, [], [0], []
            for i in range(batch.num_rows):
                n, found = split(batch.column("text")[i].as_py())
                counts.append(n)
                held.append(np.array(found, np.int32))
                ends.append(ends[-1] + len(found))
                if ends[-1] >= FLUSH or i + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held)))
                    own = batch.slice(first, i + 1 - first)
                    columns = [own.column("row"), own.column("id"), pa.array(counts, pa.int64()), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_words", "buckets"])
                    first, counts, ends, held = i + 1, [], [0], []

    return settle(texts.mapInArrow(run, FEATURES), "features")


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists in a row and the offsets of each list in them."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over the whole table: each task adds up its own, at most one row a bucket leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column("buckets"))[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in counted.collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket: the scaled logarithm of its share in the target against that in the source."""
    n = float(len(source))
    big_s, big_t = float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (big_s + n) / ((s + 1.0) * (big_t + n))
    return np.array([math.floor(SCALE * math.log(ratio(float(s), float(t)))) for s, t in zip(source, target, strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(row, id, n_words, n_features, weight)``: the floored mean gain of each document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = flat(batch.column("buckets"))
            size = np.diff(ends).astype(np.int64)
            sums = np.diff(np.r_[0, np.cumsum(gain[values])][ends])
            weight = np.where(size > 0, sums // np.maximum(size, 1), 0)
            columns = [batch.column("row"), batch.column("id"), batch.column("n_words"), pa.array(size), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "row long, id long, n_words long, n_features long, weight long")


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a row, from its id and the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank`` from 1 in the given total order, and ``row`` last.

    The sorted rows are written with their part and place. Ranks are places plus the sizes of the
    parts before, of which there are as many as shuffle partitions.
    """
    placed = settle(rows.sort(*order, "row").withColumn("place", F.monotonically_increasing_id()), "sorted")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.max(at + 1).alias("n")).orderBy("part").collect()
    before = np.cumsum([0, *[r["n"] for r in sizes]])
    starts = [(r["part"], int(b)) for r, b in zip(sizes, before)]
    offsets = rows.sparkSession.createDataFrame(starts, "part long, before long")
    joined = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return joined.withColumn("rank", F.col("before") + at + 1).drop("part", "before", "place")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    width: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of every document; ``rank`` is null for those not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn.
    """
    found = features(docs, id, text, width, buckets)
    wanted = histogram(features(target, None, target_text, width, buckets), buckets)
    scored = weighed(found, gains(histogram(found, buckets), wanted)).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = settle(scored, "scored")
    enough = scored.filter(F.col("n_words") >= least_words)
    most = percent * enough.count() // 100
    placed = ranked(enough, F.desc("score"), F.asc("id"))
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id), "n_features", "weight", "score", "rank")
