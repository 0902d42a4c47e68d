"""Quality classifier: ordinal regression with cumulative links on graded ratings.

Grades 0 < 1 < ... share one weight vector over hashed text features; ordered thresholds separate
them: P(grade > k) = sigmoid(w.x - t_k). The expected grade and the tail probability of the grades
wanted select documents.

* Features: words (folded), their shapes, and words that repeat their predecessor, hashed; each
  counts once per document, scaled by the logarithm of how often it occurs per word.
* A null or empty text has no features and is scored by the thresholds alone.
* Ratings: rows without a grade are not used; of several for a document the lowest grade holds.
* Rows that repeat a rated id are fitted once, by the smallest text; each row is scored by its own text.
* With no ratings of at least two grades nothing can be fitted: scores are null, everything is kept.
  The same holds for the tail of a grade above all ratings, of which the ratings say nothing.
* Equal texts have equal scores. A text of any length is read whole; an empty table gives no rows.
* Columns of the documents that are called like a score are replaced, unless ``into`` names one new
  column for all scores, which must not be there yet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 15
MAX_RATED = 6000  # rated documents the fit may use: a bounded sample by hash of the id
_SHAPE = re.compile(rb"[a-z\x80-\xff]+|[A-Z]+|[0-9]+")


def _shape(word: bytes) -> bytes:
    return _SHAPE.sub(lambda m: b"A" if m[0][0] < 91 and m[0][0] >= 65 else b"0" if m[0][0] < 58 else b"a", word)[:8]


class Features:
    """Hashed features of texts; remembers the features of words it has met."""

    def __init__(self, dimensions: int = DIMENSIONS, remember: int = 200_000):
        self.size, self.remember = dimensions, remember
        self.known: dict[bytes, tuple[int, int]] = {}

    def _of(self, word: bytes) -> tuple[int, int]:
        import zlib

        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            bare = word.lower().strip(b".,;:!?\"'()*#$%&|")
            found = self.known[word] = (zlib.crc32(bare) % self.size, zlib.crc32(b"\0" + _shape(word)) % self.size)
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        pairs = np.array([self._of(w) for w in words], np.int64)
        same = np.flatnonzero(pairs[1:, 0] == pairs[:-1, 0])
        repeat = np.full(len(same), 1, np.int64)  # feature 1: a word follows itself
        index, count = np.unique(np.concatenate([pairs.ravel(), repeat]), return_counts=True)
        value = np.log1p(count * (1000.0 / len(words))) / np.log(1001)
        return index, value.astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ordered

    def tails(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        z = float(self.weights[index] @ value)
        return 1 / (1 + np.exp(self.thresholds - z))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], dimensions: int = DIMENSIONS, decay: float = 2e-4, steps: int = 250) -> Model | None:
    """Maximum likelihood with weight decay by full-batch Adam; ``rows``: (grade, indices, values)."""
    grades = np.array([g for g, _, _ in rows], np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    levels = np.arange(int(grades.max()))
    index = np.concatenate([i for _, i, _ in rows])
    value = np.concatenate([v for _, _, v in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(i) for _, i, _ in rows])
    above = (grades[:, None] > levels[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    w, t = np.zeros(dimensions), -np.log(share / (1 - share))
    m, v = np.zeros(dimensions + len(t)), np.zeros(dimensions + len(t))
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[index], minlength=len(rows))
        # All cumulative links at once: each is a logistic regression with the shared weights.
        error = 1 / (1 + np.exp(t[None, :] - z[:, None])) - above
        g = np.bincount(index, value * error.sum(axis=1)[row], minlength=dimensions) / len(rows) + decay * w
        gradient = np.concatenate([g, -error.mean(axis=0)])
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[:dimensions], t - move[dimensions:]
        t = np.maximum.accumulate(t)  # thresholds stay ordered
    return Model(w, t)


def train(documents: DataFrame, ratings: DataFrame, id: str = "doc_id", text: str = "text", max_rated: int = MAX_RATED, dimensions: int = DIMENSIONS) -> Model | None:
    """Fit on at most ``max_rated`` documents rated in ``ratings`` (id, grade)."""
    rated = ratings.filter("grade is not null").groupBy(id).agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64(F.col(id)), id).limit(max_rated)
    # One row per rated id, so that the bound on ids bounds what is fitted as well.
    chosen = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(rated.toDF("id", "grade")), "id")
    chosen = chosen.groupBy("id", "grade").agg(F.min("text").alias("text")).select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dimensions)
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()),
                    pa.array([v.tobytes() for _, v in made], pa.binary()),
                ],
                names=["grade", "i", "v"],
            )

    found = chosen.mapInArrow(run, "grade int, i binary, v binary").collect()
    rows = sorted((r["grade"], bytes(r["i"]), bytes(r["v"])) for r in found)
    return fit([(g, np.frombuffer(i, "<i4"), np.frombuffer(v, np.float32)) for g, i, v in rows], dimensions) if rows else None


def score(
    documents: DataFrame,
    model: Model | None,
    least: int,
    threshold: float,
    text: str = "text",
    dimensions: int = DIMENSIONS,
    into: str | None = None,
) -> DataFrame:
    """``documents`` with ``expected_grade``, ``tail_probability`` (of grade ``least`` or more) and ``kept``.

    ``into`` puts the three into one struct column of that name and leaves all others alone.
    """
    if into in documents.columns:
        raise ValueError(f"the documents have a column {into} already")
    if model is None:
        none = F.lit(None).cast("double")
        scores = {"expected_grade": none, "tail_probability": none, "kept": F.lit(True)}
        return _with_scores(documents, scores, into)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("expected double, tail double")
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, known = Features(dimensions), shared.value
        for texts in parts:
            # One text at a time becomes a Python string, never a whole batch.
            tails = np.array([known.tails(*features(t.as_py())) for t in texts]).reshape(len(texts), -1)
            # Every grade is at least 0; of grades above all ratings nothing is known.
            tail = np.ones(len(texts)) if least <= 0 else tails[:, least - 1] if least <= tails.shape[1] else np.full(len(texts), np.nan)
            yield pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tail)], names=["expected", "tail"])

    names = set(documents.columns)
    made = next(n for n in (f"_judged{'_' * i}" for i in range(len(names) + 1)) if n not in names)
    scored = documents.withColumn(made, judge(F.col(text)))
    tail = F.nanvl(F.col(f"{made}.tail"), F.lit(None).cast("double"))
    scores = {"expected_grade": F.col(f"{made}.expected"), "tail_probability": tail, "kept": F.coalesce(tail >= threshold, F.lit(True))}
    return _with_scores(scored, scores, into).drop(made)


def _with_scores(documents: DataFrame, scores: dict[str, Column], into: str | None) -> DataFrame:
    if into:
        return documents.withColumn(into, F.struct(*[c.alias(n) for n, c in scores.items()]))
    return documents.withColumns(scores)


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating of two marks: 0 toxic, 1 poor, 2 good; null if there is no mark."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)
