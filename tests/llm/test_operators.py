"""Operators on small tables with nulls, ties, repeated rows, empty and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import chat, mixing, ngram_join, nn_descent, ordinal, packing, paragraph_dedup, pii, rules, suffix_dedup

DOCS = "doc_id long, text string, source string, size long, row string, id long"
LINE = " ".join(f"w{i}" for i in range(80))
ROWS = [
    (1, LINE, "a", 1, "x", 9),
    (2, LINE, "a", 1, "x", 9),
    (2, LINE, "a", 1, "x", 9),
    (3, LINE.replace("w40", "other"), None, None, None, None),
    (4, None, "b", None, None, None),
    (5, "", None, None, None, None),
    (6, "x " * 5000, "b", None, None, None),
    (7, "write to me@example.com or 10.0.0.1", "c", None, None, None),
    (None, "no id here", "c", None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(docs, none):
    mixed = mixing.mix(docs)
    taken = mixing.taken(mixed).collect()
    assert len(taken) == len(ROWS)
    assert all(0 <= r.taken <= 3 * r["size"] for r in taken)
    assert sorted(map(tuple, taken), key=str) == sorted(map(tuple, mixing.taken(mixing.mix(docs.repartition(3))).collect()), key=str)
    words = mixing.texts(mixed, docs).agg(F.sum(mixing.count_words(F.col("text")))).first()[0]
    assert words == sum(r.taken for r in taken)
    assert mixing.taken(mixing.mix(none)).count() == 0


def test_ngram_join(docs, none):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.group(docs).collect()}
    assert found == {(1, 76, 1), (2, 76, 1), (3, 76, 1), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 7), (None, 1, None)}
    assert ngram_join.group(none).count() == 0


def test_suffix_dedup(docs, none):
    found = {r.doc_id: r for r in suffix_dedup.dedup(docs).collect()}
    assert found[1].n_removed == 0 and found[2].n_removed == found[2].n_bytes and found[4].n_bytes == 0
    assert found[3].n_spans == 2 and found[6].n_removed == 0
    assert found[5].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert suffix_dedup.dedup(none).count() == 0


def test_paragraph_dedup(docs, none):
    left = {r.doc_id: r.text for r in paragraph_dedup.dedup(docs).collect()}
    assert left[1] == LINE and len(left[2].split()) < 20 and left[4] is None and left[5] == ""
    assert paragraph_dedup.dedup(none).count() == 0


def test_packing(docs, none):
    import public_tokenizers as files

    rows = packing.pack(docs, files.path("byte_bpe_50k.json"), length=64).collect()
    by = {}
    for r in rows:
        assert r.length == len(r.ids) // 4
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert {r.doc_tokens for r in rows if r.doc_id == 5} == {1}
    assert packing.pack(none, files.path("byte_bpe_50k.json")).count() == 0


def test_personal_data(docs, none):
    model = pii.train()
    found = docs.withColumn("s", pii.find(docs, model))
    row = found.filter("doc_id = 7").select(pii.listed(F.col("s")), pii.redact(F.col("text"), F.col("s"))).first()
    assert tuple(row) == ("email:9:23,ip:27:35", "write to <EMAIL> or <IP>")
    assert found.filter(F.size("s") > 0).count() == 1
    assert none.withColumn("s", pii.find(none, model)).count() == 0


def test_rules(docs, none):
    judged = {r.doc_id: r for r in rules.judge(rules.measures(docs)).collect()}
    assert judged[4].n_words == 0 and judged[1].n_words == 80 and judged[6].n_repeat_words == 5000
    assert rules.judge(rules.measures(none)).count() == 0


def test_votes_find_the_bad_class():
    patterns = [((0, 0, 1), 900), ((-1, -1, 0), 80), ((0, 0, 0), 20)]
    prior, accuracy = rules.estimate(patterns)
    p = rules.posterior(np.array([v for v, _ in patterns], float), prior, accuracy)
    assert p[0] > 0.9 and p[1] < 0.1


def test_ordinal(spark, none):
    rows = [(i, ("bad " if i % 3 == 0 else "poor " if i % 3 == 1 else "fine ") * 3 + f"t{i}", i % 3) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    ratings = docs.select("doc_id", F.col("kept").alias("grade"))
    model = ordinal.train(docs, ratings)
    assert (np.diff(model.thresholds) >= 0).all()
    scored = ordinal.score(docs.drop("kept"), model, 2, 0.5).collect()
    assert all(r.kept == (r.doc_id % 3 == 2) for r in scored)
    assert ordinal.train(none, ratings.limit(0)) is None
    assert ordinal.score(docs, None, 2, 0.5).filter("kept").count() == 90


def test_chat(spark):
    rows = [(1, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"turn {t} </s> " + "word " * 30) for t in range(9)]
    rows += [(None, None, None, None), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(turns, budget=120, history=40)
    assert windows.filter("conv_id = 1").count() > 2
    heads = [chat.parse(r.formatted)[0] for r in windows.filter("conv_id = 1 and window > 0").collect()]
    assert all(h[1:3] == ("again", "system") for h in heads)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    want = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1)
    assert back[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and back[1].n_turns == 9
    assert back[2].loss_chars == 2 and back[None].n_turns == 1
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 8)))]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] + [0.0] * 6), (None, [1.0] * 8)]
    rows = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    found = nn_descent.nearest(rows, F.col("id") % 20 == 0, k=5).collect()
    x = np.array([v for _, v in vectors])
    hit = 0
    for q in range(0, 400, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert hit >= 90 and len(found) == 100
    assert nn_descent.nearest(rows.limit(0), F.col("id") % 20 == 0).count() == 0


def test_suffix_dedup_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    first, want = {}, {}
    for i, raw in texts:
        for a in range(len(raw) - 49):
            first.setdefault(raw[a : a + 50], i)
    for i, raw in texts:
        gone = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - 49):
            if first[raw[a : a + 50]] < i:
                gone[a : a + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if raw else 0
        want[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert found == want


def components(sets, percent=75):
    """The smallest id reachable over pairs of sets at the threshold, by comparing all pairs."""
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(i for i, s in sets.items() if s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in sets}


def grams(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_ngram_join_finds_extended_documents(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        words = [f"v{i}_{j}" for j in range(104)]
        more = int(rng.integers(10, 34))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + [f"more{i}_{j}" for j in range(more)]))]
    want = components({i: grams(t) for i, t in rows})
    found = ngram_join.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_suffix_dedup_of_a_passage_amid_different_text(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = text(120)
    rows = [(i, text(90) + passage + text(90)) for i in range(300)] + [(300, text(90) + passage[:60] + text(90))]
    docs = spark.createDataFrame(rows, "id long, text string")
    lost = {}
    for r in suffix_dedup.covered(docs, many=50).collect():
        lost.setdefault(r.id, set()).update(range(r.start, r.end))
    first, want = {}, {}
    for i, t in rows:
        for a in range(len(t) - 49):
            if first.setdefault(t[a : a + 50], i) < i:
                want.setdefault(i, set()).update(range(a, a + 50))
    assert lost == want and set(want) == set(range(1, 301))


def test_suffix_dedup_over_small_batches(spark):
    rng = random.Random(17)
    passages = ["".join(rng.choice("abcdef ") for _ in range(90)) for _ in range(5)]
    filler = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 40)))
    rows = [(i, filler() + "".join(rng.choice(passages)[rng.randint(0, 30) :] + filler() for _ in range(2))) for i in range(150)]
    docs = spark.createDataFrame(rows, "id long, text string")
    first, want = {}, {}
    for i, t in rows:
        for a in range(len(t) - 49):
            if first.setdefault(t[a : a + 50], i) < i:
                want.setdefault(i, set()).update(range(a, a + 50))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in (3, 10_000):
            spark.conf.set(name, size)
            lost = {}
            for r in suffix_dedup.covered(docs).collect():
                lost.setdefault(r.id, set()).update(range(r.start, r.end))
            assert lost == want
    finally:
        spark.conf.set(name, before)


def test_nearest_with_a_few_long_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[[7, 1234, 2001]] *= [[80], [300], [100]]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nn_descent.nearest(rows, F.col("id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20].tolist()) & found[q])
    assert hit >= 0.9 * 20 * 150


def test_paragraph_dedup_of_passages_across_lines(spark):
    rng = np.random.default_rng(8)
    own = lambda n: [f"o{x}" for x in rng.integers(0, 1 << 40, n)]
    verse, passage = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(55)]
    short = "\n".join(" ".join(verse[i : i + 5]) for i in range(0, 60, 5))
    rows = [(i, " ".join(own(9)) + "\n" + short + "\n" + " ".join(own(9))) for i in (1, 2, 3)]
    for i, at in ((4, 20), (5, 35), (6, 28)):
        rows.append((i, " ".join(own(12) + passage[:at]) + "\n" + " ".join(passage[at:] + own(12))))
    left = {r.doc_id: r.text.split() for r in paragraph_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {i: t.split() for i, t in rows}
    assert left[1] == words[1] and left[4] == words[4]
    for i in (2, 3, 5, 6):
        gone = [w for w in words[i] if w not in set(left[i])]
        assert len(gone) >= 25 and not any(w.startswith("o") for w in gone)


def test_paragraph_dedup_takes_one_line_of_each_component(spark):
    rng = np.random.default_rng(10)
    base = [[f"b{g}_{i}" for i in range(14)] for g in range(6)]
    lines = []
    for k in range(120):
        line = list(base[k % 6])
        for at in (0, -1)[: k % 3]:
            line[at] = f"x{rng.integers(0, 3)}"
        lines.append(" ".join(line))
    want = components({i: grams(x) for i, x in enumerate(lines)})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for few in (2, 1000):
        gone = {r.doc_id for r in paragraph_dedup.duplicates(docs, few=few).collect()}
        assert gone == {i for i in want if want[i] != i}
