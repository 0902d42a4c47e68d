"""Draws and permutations of the mix decide what is taken; targets and bounds hold for every draw."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(1)
    rows = []
    for i in range(400):
        source = ["a", "b", "c", None][min(i % 7, 3)]
        rows.append((i, " ".join("w" for _ in range(draw.randint(0, 90))), source))
    rows += [(5, "twice the same", "a"), (5, "twice the same", "a"), (None, "no id", "b"), (7, None, "c"), (8, "", None)]
    # Equal ids and sizes with different texts have places of their own.
    rows += [(9, f"equal size {w}", "a") for w in "xyz"]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def plain_targets(sizes, weights, most=3.0):
    """Shares by weight, none above ``most`` times its size."""
    total, held = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        left = total - sum(held.values())
        target = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = [i for i in free if target[i] > most * sizes[i]]
        if not above:
            return [held.get(i, target.get(i)) for i in range(len(sizes))]
        held |= {i: most * sizes[i] for i in above}


def mixed(docs, **options):
    return mixing.taken(mixing.mix(docs, block_words=16, **options)).collect()


def test_targets_hold_and_draws_differ(docs):
    base = mixed(docs)
    sizes = {}
    for r in docs.select("source", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("n")).collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + max(r["n"] or 0, 0)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = plain_targets([sizes[n] for n in names], [1, 2, 3, 1])
    by_target = {}
    for r in base:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["taken"] > 0) == (r["shards"] != "")
        by_target.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert sorted(by_target) == sorted((sizes[n], round(t, 6)) for n, t in zip(names, want, strict=True))
    for (size, target), taken in by_target.items():
        assert sum(taken) == min(round(target), 3 * size)
    again = mixed(docs)
    assert sorted(map(repr, again)) == sorted(map(repr, base))
    for options in ({"seed": 8}, {"shards": 5}):
        other = mixed(docs, **options)
        assert sorted(map(repr, other)) != sorted(map(repr, base))
        sums = {}
        for r in other:
            sums.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
        assert {k: sum(v) for k, v in sums.items()} == {k: sum(v) for k, v in by_target.items()}


def test_the_permutation_decides_the_last_round(docs, monkeypatch):
    base = mixed(docs)
    monkeypatch.setattr(mixing, "permute", lambda slot, n, key: slot)
    plain = mixed(docs)
    assert [r["taken"] for r in sorted(plain, key=repr)] != [r["taken"] for r in sorted(base, key=repr)]
