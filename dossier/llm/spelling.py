"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and their frequent forms.

Runs of letters are counted over all texts; each task folds its own counts before the exchange.
Frequent words are compared in dense tiles: padded matrices of code points, aligned on the left and
on the right, give the common prefix and suffix of every pair of two blocks at once. A pair is a
single edit exactly if both together reach the longer length minus one.

Which words share a tile: the place of an edit lies in one of the zones of the longer word, and
outside that zone both words agree. So a word enters one tile per zone, for its own length and for
the next one. With two code points per zone and the 90 lower-case letters there are, a tile has at
most 90 * 90 words of one length and 90 of the other, whatever the vocabulary. Words of more than 64
code points have 32 wider zones; a tile of theirs is compared block by block. A pair counts only in
the zone where its common prefix ends, hence once. The key of a tile is a hash: a collision only
adds words to compare.

Defined results: a null text has no words; a null id reads as an empty string; equal counts are
settled by code-point order; repeated rows count as often as they occur; an empty table gives no
rows; other columns of the documents play no part. A text of any length is read whole; one beyond
``PIECE`` code points is scanned without a list of its runs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import settle

RUN = "[a-zÀ-ÿ]"  # letters of a text whose A-Z are in lower case
LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5  # a form occurs at least so many times as often as the word
DELETE = 199  # one run in so many loses a code point
PIECE = 1 << 22
HELD_WORDS = 200_000  # words a task counts before it sends them on
ZONE = 2
ZONES = 32
CELLS = 1 << 21  # code points compared at once
ROWS = 1 << 15
SIDE = 64  # words of a block


def lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(id: int | None, text: str | None, runs: re.Pattern, delete: int = DELETE) -> Iterator[tuple[str, int]]:
    """Words of a text and how often they occur, after the deletion that the hash of id and run decides."""
    if not text:
        return
    text = lowered(text)
    found = Counter(runs.findall(text) if len(text) <= PIECE else (m.group() for m in runs.finditer(text)))
    start = zlib.crc32(f"{'' if id is None else id}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % delete == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def counts(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    delete: int = DELETE,
) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough, as a written table.

    Shorter runs are passed over at once: a deletion never makes a run longer.
    """
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def batch_of(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"{RUN}{{{least_length},}}")
        total: dict[str, int] = {}
        for batch in batches:
            for i, doc in enumerate(batch.column("id").to_pylist()):
                for word, n in words_of(doc, batch.column("text")[i].as_py(), runs, delete):
                    if len(word) >= least_length:
                        total[word] = total.get(word, 0) + n
                if len(total) >= HELD_WORDS:
                    yield batch_of(total)
                    total = {}
        yield batch_of(total)

    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return settle(counted.filter(F.col("n") >= least_count), "words")


def tiles(words: DataFrame) -> DataFrame:
    """One row per word and tile: ``(size, zone, key, word, n)``, the rows of a tile in one partition, sorted."""
    sized = words.withColumn("l", F.length("word")).withColumn("size", F.explode(F.array("l", F.col("l") + 1)))
    wide = sized.withColumn("width", F.expr(f"greatest({ZONE}, cast(ceil(size / {ZONES}) as int))"))
    placed = wide.withColumn("zone", F.expr("explode(sequence(0, size - 1, width))"))
    outside = "substring(word, 1, zone), right(word, size - least(zone + width, size))"
    keyed = placed.withColumn("key", F.expr(f"xxhash64(size, zone, {outside})"))
    rows = keyed.select("size", "zone", "key", "word", "n")
    return rows.repartition("key").sortWithinPartitions("size", "key", "zone")


def matrices(words: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words padded to ``size`` on the right and on the left, and the lengths."""
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    left, right = np.zeros((len(length), size), np.uint32), np.zeros((len(length), size), np.uint32)
    left[row, at] = flat
    right[row, size - 1 - (length[row] - 1 - at)] = flat
    return left, right, length


def compare(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix and suffix of all words of block pairs: ``a`` (k, p) and ``b`` (k, q) hold rows."""
    size = left.shape[1]

    def run(same: np.ndarray) -> np.ndarray:
        return np.where(same.all(-1), size, same.argmin(-1))

    prefix = run(left[a][:, :, None] == left[b][:, None])
    suffix = run((right[a][:, :, None] == right[b][:, None])[..., ::-1])
    return prefix, suffix


def blocks(first: np.ndarray, count: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block pairs that cover all pairs of every tile; tiles of equal size are compared together."""
    for g in np.unique(count):
        starts = first[count == g]
        for i in range(0, g, SIDE):
            for j in range(i, g, SIDE):
                a, b = np.arange(i, min(i + SIDE, g)), np.arange(j, min(j + SIDE, g))
                step = max(1, CELLS // (len(a) * len(b) * size))
                for s in range(0, len(starts), step):
                    part = starts[s : s + step, None]
                    yield part + a, part + b


def near_pairs(size: int, zone: np.ndarray, key: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of single edits among whole tiles of words up to ``size`` code points, each pair once."""
    new = np.r_[True, (key[1:] != key[:-1]) | (zone[1:] != zone[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(key)])
    first, count = first[count > 1], count[count > 1]
    found = [np.zeros((2, 0), np.int64)]
    if len(first):
        left, right, length = matrices(words, size)
        width = max(ZONE, -(-size // ZONES))
        for a, b in blocks(first, count, size):
            prefix, suffix = compare(a, b, left, right)
            ends = prefix - zone[a][:, :, None]
            near = (prefix + suffix >= size - 1) & (ends >= 0) & (ends < width) & (a[:, :, None] < b[:, None])
            near &= np.maximum(length[a][:, :, None], length[b][:, None]) == size
            k, p, q = np.nonzero(near)
            found.append(np.stack([a[k, p], b[k, q]]))
    return tuple(np.concatenate(found, axis=1))


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a task in tables of one word size that end with a tile."""
    held: pa.Table | None = None

    def cuts(t: pa.Table) -> np.ndarray:
        size, key, zone = (t.column(c).to_numpy() for c in ("size", "key", "zone"))
        return np.flatnonzero((size[1:] != size[:-1]) | (key[1:] != key[:-1]) | (zone[1:] != zone[:-1])) + 1

    def by_size(t: pa.Table) -> Iterator[pa.Table]:
        size = t.column("size").to_numpy()
        edges = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1), t.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            # Long words in smaller tables, as far as tiles allow.
            part, rows = t.slice(a, b - a), max(1, min(ROWS, CELLS // int(size[a])))
            ends = [*cuts(part), part.num_rows]
            start = 0
            for at, end in enumerate(ends):
                if end - start >= rows or at + 1 == len(ends):
                    yield part.slice(start, end - start)
                    start = end

    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows:
            at = cuts(held)
            if len(at):
                yield from by_size(held.slice(0, at[-1]))
                held = held.slice(at[-1])
    if held is not None and held.num_rows:
        yield from by_size(held)


def links(words: DataFrame) -> DataFrame:
    """``(word, other, other_n)``: near words, in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_tiles(batches):
            t = t.combine_chunks()
            names, n = t.column("word").chunk(0), t.column("n").chunk(0)
            a, b = near_pairs(t.column("size")[0].as_py(), t.column("zone").to_numpy(), t.column("key").to_numpy(), names)
            x, y = np.r_[a, b], np.r_[b, a]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), names.take(pa.array(y)), n.take(pa.array(y))], ["word", "other", "other_n"])

    return tiles(words).mapInArrow(run, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every word with a form; counts grow along a chain, so chains are short and end."""
    steps = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    ends = steps.select(F.col("word").alias("root"), F.lit(True).alias("open"))
    walked = settle(steps.join(ends, "root", "left").select("word", "root", F.coalesce("open", F.lit(False)).alias("open")), "roots")
    while not walked.filter("open").isEmpty():
        after = walked.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("next_open"))
        moved = walked.filter("open").join(after, "root").select("word", F.col("next").alias("root"), F.col("next_open").alias("open"))
        walked = settle(walked.filter("not open").unionByName(moved), "roots")
    return walked.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``words(word, n)``.

    The form is the near word that occurs most, if it occurs at least ``times`` as often.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = links(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best")["other"].alias("other"), (-F.col("best")["minus"]).alias("most")
    )
    enough = F.col("most") >= times * F.col("n")
    forms = settle(
        joined.select("word", "n", "n_near", F.when(enough, F.col("other")).alias("form"), F.when(enough, F.col("most")).alias("form_n")), "forms"
    )
    found = forms.join(roots(forms), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
