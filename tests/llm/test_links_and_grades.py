"""Components of similar documents and grades against plain versions, with nulls, repeats and clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import linking, ngram_join, ordinal

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def plain_components(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs))


def edited(words, draw, share):
    return [draw.choice(VOCABULARY) if draw.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


def family(draw, base, n, share):
    """Copies of one text with own edits: near the base, often not near each other."""
    return [" ".join(edited(base, draw, share)) for _ in range(n)]


def test_components_equal_the_plain_version(spark):
    draw = random.Random(5)
    fresh = lambda n: [draw.choice(VOCABULARY) for _ in range(n)]
    texts = [None, "", " \n", "one", "one two", "Two words", "two  WORDS"]
    for share in (0.005, 0.015, 0.025, 0.03):
        texts += family(draw, fresh(120), 40, share)
    # A chain, each one near the next only, and a passage that many texts share.
    chain = fresh(200)
    for _ in range(30):
        chain = chain[4:] + fresh(4)
        texts.append(" ".join(chain))
    passage = fresh(55)
    texts += [" ".join(fresh(draw.randint(0, 80)) + passage + fresh(draw.randint(0, 80))) for _ in range(60)]
    texts += [" ".join(fresh(60)) for _ in range(40)] + ["same text here again and again"] * 30
    draw.shuffle(texts)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, key string, item int").repartition(5)
    got = ngram_join.group(frame)
    assert sorted(tuple(r) for r in got.collect()) == plain_components(docs)


def test_linking_is_exact_for_connectivity(spark):
    draw = random.Random(8)
    sets = [frozenset(draw.sample(range(40 * (i % 6), 40 * (i % 6) + 40), draw.randint(1, 14))) for i in range(150)]
    posted = [(k, i, len(s), len(s), True) for i, s in enumerate(sets) for k in s]
    postings = spark.createDataFrame(posted, "key long, item long, size long, most long, head boolean")
    linked = {(i, j) for j in range(150) for i in range(j) if len(sets[i] & sets[j]) * 2 >= len(sets[i] | sets[j])}
    links = spark.createDataFrame(sorted(linked), "a long, b long")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        assert pairs.distinct().count() == asked[-1]
        return pairs.join(links, ["a", "b"])

    got = {r["node"]: r["label"] for r in linking.connect(postings, verify, lambda x, y: F.lit(True)).collect()}
    parent = list(range(150))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in sorted(linked):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    nodes = {i for pair in linked for i in pair}
    assert got == {i: root(i) for i in nodes}
    none = linking.connect(postings.limit(0), verify, lambda x, y: F.lit(True))
    assert none.columns == ["node", "label"] and none.count() == 0


def test_one_pair_per_item_and_round(spark):
    # One family of which all are linked: the first round settles it.
    posted = [(k, i, 50, 50, True) for i in range(300) for k in range(30)]
    postings = spark.createDataFrame(posted, "key long, item long, size long, most long, head boolean")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs

    got = linking.connect(postings, verify, lambda x, y: F.lit(True)).collect()
    assert len(got) == 300 and {r["label"] for r in got} == {0}
    assert asked[0] == 299 and sum(asked[1:]) == 0


def graded(spark):
    rows = [(i, ("bad " if i % 3 == 0 else "poor " if i % 3 == 1 else "fine ") * 3 + f"t{i}", i % 3, "mine") for i in range(90)]
    return spark.createDataFrame(rows, "doc_id long, text string, grade int, kept string")


def test_scores_leave_other_columns_alone(spark):
    docs = graded(spark)
    model = ordinal.train(docs, docs.select("doc_id", "grade"))
    got = ordinal.score(docs, model, 2, 0.5, into="judged")
    assert got.columns == [*docs.columns, "judged"]
    assert all(r["kept"] == "mine" and r["judged"]["kept"] == (r["grade"] == 2) for r in got.collect())
    with pytest.raises(ValueError, match="judged"):
        ordinal.score(got, model, 2, 0.5, into="judged")


def test_grades_above_all_ratings_are_not_guessed(spark):
    docs = graded(spark)
    model = ordinal.train(docs, docs.filter("grade < 2").select("doc_id", "grade"))
    got = ordinal.score(docs, model, 2, 0.5, into="judged").select("judged.*")
    assert got.filter("tail_probability is not null or not kept").isEmpty() and not got.filter("expected_grade is null").count()
    assert ordinal.score(docs, model, 0, 0.5, into="judged").filter("judged.tail_probability <> 1").isEmpty()
    below = ordinal.score(docs, model, 1, 0.5, into="judged").filter("grade < 2")
    assert below.filter("judged.kept <> (grade = 1)").isEmpty()


def test_the_bound_on_rated_documents_bounds_rows(spark, monkeypatch):
    docs = graded(spark)
    repeated = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("text", F.concat("text", F.lit(" "), "copy"))
    seen = []
    monkeypatch.setattr(ordinal, "fit", lambda rows, dimensions: seen.append(rows))
    ordinal.train(repeated, docs.select("doc_id", "grade"), max_rated=10)
    assert len(seen[0]) == 10
    monkeypatch.undo()
    once = ordinal.train(docs.withColumn("text", F.concat("text", F.lit(" 1"))), docs.select("doc_id", "grade"))
    many = ordinal.train(repeated, docs.select("doc_id", "grade"))
    assert np.allclose(once.weights, many.weights) and np.allclose(once.thresholds, many.thresholds)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for n in (0, 1, 5, 90, 700, 2500):
        for share in (0.0, 0.3, 0.8, 1.0):
            k = int(n * share)
            x = np.unique(np.r_[common[:k], rng.integers(0, 1 << 62, n - k).astype(np.uint64)])
            y = np.unique(np.r_[common[:k], rng.integers(0, 1 << 62, (n - k) // 2).astype(np.uint64)])
            a, b = ngram_join.sketches([x, y] if n else [x[:0], y[:0]])
            bits = sum(int(v).bit_count() for v in a ^ b)
            assert bits <= len(np.setxor1d(x, y))


def test_items_meet_about_once_however_many_keys_they_share(spark, monkeypatch):
    rows = [(k, i, 10, 10, True) for k in range(60) for i in (1, 2, 3)] + [(100 + k, i, 10, 10, True) for k in range(60) for i in (4, 5)]
    postings = spark.createDataFrame(rows, "key long, item long, size long, most long, head boolean")
    met = []
    real = linking._pairs
    monkeypatch.setattr(linking, "_pairs", lambda frame: met.append(frame.count()) or real(frame))
    none = linking.connect(postings, lambda pairs: pairs.filter("false"), lambda x, y: F.lit(True))
    assert none.count() == 0
    assert met[-1] <= 4  # one row for each pair, not for each of its keys
    # The links of pairs that only meet at the end are found, keys of other items stay apart.
    found = linking.connect(postings, lambda pairs: pairs.filter("a <> 4"), lambda x, y: F.lit(True))
    assert {(r.node, r.label) for r in found.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(3)
    for bits in (256, 1024):
        for _ in range(20):
            x, y = (np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(2))
            a, b = ngram_join.sketches([x, y], bits)
            assert a.shape == (bits // 64,)
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
