"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) or abstains (0). Documents with equal votes form one pattern;
expectation-maximisation over the pattern counts of the whole corpus estimates how often each rule
is right, and the posterior probability of being good decides.

* A text that is null or has no words has measures of 0; every rule abstains on it, so it gets the
  prior, and the base rules reject it.
* A document's verdict depends on its votes and the corpus counts, never on its neighbours in a task.
* An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
MEASURES = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "n_lines": pa.int64(),
    "n_upper": pa.int64(),
    "n_letters": pa.int64(),
    "n_stops": pa.int64(),
    "n_marked": pa.int64(),
}
_BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words in windows of ``width`` words that the text holds twice or more."""
    n = len(ids)
    if n <= width:
        return 0
    key = ids[: n - width + 1]
    for k in range(1, width):
        step = int(ids.max()) + 1
        if k > 1 or step >= 1 << 31:
            _, key = np.unique(key, return_inverse=True)  # keeps the product of two keys within 64 bits
        key = key * step + ids[k : n - width + 1 + k]
    _, group, count = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[group] > 1)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + width, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(raw, minlength=256)
    # Letters beyond ASCII start with the bytes C3-CA; lower case is told apart in ASCII only.
    upper, letters = int(count[65:91].sum()), int(count[65:91].sum() + count[97:123].sum())
    return (
        len(words),
        len(text) - sum(text.count(b) for b in _BLANKS),
        sum(text.count(s) for s in SYMBOLS),
        dup,
        repeated_words(ids),
        lines,
        upper,
        letters,
        int(count[[44, 46]].sum()),
        sum(text.count(m) for m in ("!!", " | ", "...", "***", "$$$", "%%%", "&&&", "###")),
    )


def measures(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All measures of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, MEASURES.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *MEASURES])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in MEASURES)
    return documents.select(F.col(id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema)


def _bad(when: Column) -> Column:
    return F.when(when, -1).otherwise(0)


def _good(when: Column) -> Column:
    return F.when(when, 1).otherwise(0)


def _per(n: str, of: str) -> Column:
    return F.col(n) / F.greatest(F.col(of), F.lit(1))




def rules() -> dict[str, Column]:
    """The rules over the measures: each gives -1, 0 or 1, and 0 wherever it has nothing to say."""
    length, stops = _per("word_chars", "n_words"), _per("n_stops", "n_words")
    capitals, symbols = _per("n_upper", "n_letters"), _per("n_symbols", "n_words")
    return {
        "symbols": _bad(symbols > 0.3),
        "marks": _bad(_per("n_marked", "n_words") > 0.2),
        "repeats": _bad(_per("n_repeat_words", "n_words") > 0.4),
        "copied_lines": _bad(_per("n_dup_lines", "n_lines") > 0.3),
        "capitals": _bad(capitals > 0.5),
        "no_sentences": _bad((stops < 0.01) & (F.col("n_words") >= 20)),
        "word_length": _bad((length < 2) | (length > 14)),
        "prose": _good(stops.between(0.03, 0.4) & length.between(3, 9) & (capitals < 0.2) & (symbols < 0.05)),
    }


def vote(measured: DataFrame, voters: Mapping[str, Column] | None = None) -> DataFrame:
    """The measures with ``votes``, one number per rule."""
    voters = rules() if voters is None else voters
    votes = [F.when(F.col("n_words") > 0, v).otherwise(0).cast("int") for v in voters.values()]
    return measured.withColumn("votes", F.array(*votes))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = 0.8, trust: float = 0.9) -> tuple:
    """EM: (prior of good, accuracy of each rule where it votes) from counted vote patterns.

    Rules start with the accuracy ``trust`` and a belief in it worth 1 % of the documents: rules are
    held to be better than chance, which tells the two classes apart from their mirror image.
    """
    votes = np.array([p for p, _ in patterns], float)
    weight = np.array([n for _, n in patterns], float)
    accuracy = np.full(votes.shape[1], trust)
    belief = max(1.0, 0.01 * weight.sum())
    up, down = (votes > 0).T * weight, (votes < 0).T * weight
    for _ in range(rounds):
        p = posterior(votes, prior, accuracy)
        right, cast = up @ p + down @ (1 - p), up.sum(axis=1) + down.sum(axis=1)
        new = np.clip((right + trust * belief) / (cast + belief), 0.5, 0.999)
        moved, accuracy = np.abs(new - accuracy).max(), new
        prior = float(np.clip((weight @ p + 8) / (weight.sum() + 10), 0.05, 0.95))
        if moved < 1e-9:
            break
    return prior, accuracy


def posterior(votes: np.ndarray, prior: float, accuracy: np.ndarray) -> np.ndarray:
    """Probability of being good for each row of votes."""
    log = math.log(prior / (1 - prior)) + votes @ np.log(accuracy / (1 - accuracy))
    return 1 / (1 + np.exp(-log))


def judge(measured: DataFrame, voters: Mapping[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """The measures with the posterior ``quality`` and the verdict ``good``.

    One row per vote pattern reaches the driver, at most 3 to the power of the number of rules; the
    estimated parameters come back as constants, so scoring needs no join.
    """
    voted = vote(measured, voters)
    counted = [(tuple(r["votes"]), r["n"]) for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not counted:
        return voted.withColumns({"quality": F.lit(None).cast("double"), "good": F.lit(True)})
    counted.sort()
    prior, accuracy = estimate(counted)
    log = F.lit(math.log(prior / (1 - prior)))
    for i, a in enumerate(accuracy):
        log = log + F.col("votes")[i] * math.log(a / (1 - a))
    scored = voted.withColumn("quality", 1 / (1 + F.exp(-log)))
    return scored.withColumn("good", F.col("quality") >= threshold)


def base_failed() -> Column:
    """The fixed limits that hold besides the votes."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
