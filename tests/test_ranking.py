import math
import random
from collections import Counter, defaultdict

import pytest
from helpers import rows
from pyspark.sql import functions as F

from dossier.operators import ranking as R
from dossier.operators.numbering import number_rows
from dossier.sources.checks import MissingInput

J = "resume_id string, job_id string, relevance double"
L = "resume_id string, rank int, job_id string"


@pytest.fixture(scope="module")
def golden(spark):
    judgments = spark.createDataFrame([("q1", "j1", 3.0), ("q1", "j3", 1.0), ("q1", "j5", 2.0), ("q2", "j9", 0.0)], J)
    results = spark.createDataFrame(
        [("q1", 1, "j1"), ("q1", 2, "j2"), ("q1", 3, "j3"), ("q1", 4, "j4"), ("q2", 1, "j9"), ("q3", 1, "j1")], L
    )
    return results, judgments


def _scores(results, judgments, **options):
    scored = R.scores(R.judge(results, judgments), judgments, **options)
    return {(r["resume_id"], r["metric"], r["k"]): (r["score"], r["valid"]) for r in scored.collect()}


def test_golden_scores(golden):
    got = {k: (round(s, 6), v) for k, (s, v) in _scores(*golden).items() if k[2] in (3, None)}
    assert got == {
        ("q1", "ndcg", 3): (0.735007, True), ("q2", "ndcg", 3): (0.0, False),
        ("q1", "precision", 3): (0.666667, True), ("q2", "precision", 3): (0.0, True),
        ("q1", "recall", 3): (0.666667, True), ("q2", "recall", 3): (1.0, True),
        ("q1", "mrr", None): (1.0, True), ("q2", "mrr", None): (0.0, True),
        ("q1", "map", None): (0.555556, True), ("q2", "map", None): (1.0, True),
        ("q1", "ari", None): (0.0, True), ("q2", "ari", None): (0.0, True),
        ("q1", "nmi", None): (0.0, True), ("q2", "nmi", None): (0.0, True),
        ("q1", "purity", None): (0.5, True), ("q2", "purity", None): (1.0, True),
    }


def test_golden_averages_and_report(golden):
    averaged = R.evaluate(*golden)
    got = {(r["metric"], r["k"]): round(r["average"], 6) for r in averaged.collect()}
    assert got[("ndcg", 3)] == 0.735007 and got[("precision", 3)] == 0.333333 and got[("recall", 3)] == 0.833333
    assert got[("mrr", None)] == 0.5 and got[("map", None)] == 0.777778 and got[("purity", None)] == 0.75
    report = R.report(*golden, averaged).collect()
    assert [r["metric"] for r in report] == ["ndcg"] * 3 + ["precision"] * 3 + ["recall"] * 3 + ["mrr", "map", "ari", "nmi", "purity"]
    assert {(r["resumes_evaluated"], r["resumes_judged"]) for r in report} == {(3, 2)}


def test_nothing_to_evaluate(golden):
    results, judgments = golden
    for r, j in ((results.limit(0), judgments), (results, judgments.limit(0))):
        averaged = R.evaluate(r, j).collect()
        assert len(averaged) == 14 and {a["average"] for a in averaged} == {0.0}


def test_repeated_jobs_and_empty_lists(spark):
    judgments = spark.createDataFrame([("q", "j1", 1.0), ("e", "j1", 1.0)], J)
    results = spark.createDataFrame([("q", 1, "j1"), ("q", 2, "j1"), ("e", None, None)], L)
    got = _scores(results, judgments)
    assert got[("q", "recall", 3)] == (2.0, True)
    assert got[("e", "precision", 3)] == (0.0, False) and got[("e", "recall", 3)] == (0.0, True)
    assert got[("e", "mrr", None)] == (0.0, True) and got[("e", "purity", None)] == (0.0, True)


def _entropy_like(labels_a, labels_b):
    n = len(labels_a)
    pairs = Counter(zip(labels_a, labels_b))
    a, b = Counter(labels_a), Counter(labels_b)
    c2 = lambda x: x * (x - 1) / 2
    s, sa, sb, total = sum(map(c2, pairs.values())), sum(map(c2, a.values())), sum(map(c2, b.values())), c2(n)
    spread = (sa + sb) / 2 - sa * sb / total
    ari = 1.0 if spread == 0 else (s - sa * sb / total) / spread
    h = lambda c: -sum(x / n * math.log(x / n) for x in c.values())
    mi = h(a) + h(b) - h(pairs)
    nmi = 1.0 if len(a) == len(b) == 1 else 0.0 if mi < 1e-12 else mi / ((h(a) + h(b)) / 2)
    return ari, nmi


def _brute(results, judgments, t, ks):
    """Straight from the metric definitions, one resume at a time."""
    lists, truth = defaultdict(list), defaultdict(dict)
    for r, rank, j in sorted(results, key=lambda x: x[1]):
        lists[r].append(j)
    for r, j, v in judgments:
        truth[r][j] = v
    out = {}
    for r in lists.keys() & truth.keys():
        got, want = lists[r], truth[r]
        relevant = sum(v >= t for v in want.values())
        hit = [want.get(j, -1) >= t for j in got]
        for k in ks:
            ideal = sum(v / math.log2(i + 2) for i, v in enumerate(sorted(want.values(), reverse=True)[:k]))
            dcg = sum(want.get(j, 0) / math.log2(i + 2) for i, j in enumerate(got[:k]))
            out[(r, "ndcg", k)] = dcg / ideal if ideal > 0 else 0.0
            out[(r, "precision", k)] = sum(hit[:k]) / len(got[:k])
            out[(r, "recall", k)] = sum(hit[:k]) / relevant if relevant else 1.0
        out[(r, "mrr", None)] = next((1 / (i + 1) for i, h in enumerate(hit) if h), 0.0)
        out[(r, "map", None)] = (
            sum(sum(hit[: i + 1]) / (i + 1) for i, h in enumerate(hit) if h) / relevant if relevant else 1.0
        )
        label = {j: int(v) if v >= t else 0 for j, v in want.items()}
        bucket = {j: i // 5 + 1 for i, j in enumerate(got)}
        common = sorted(label.keys() & bucket.keys())
        ari, nmi = (0.0, 0.0) if len(common) < 2 else _entropy_like([label[j] for j in common], [bucket[j] for j in common])
        out[(r, "ari", None)], out[(r, "nmi", None)] = ari, nmi
        groups = defaultdict(Counter)
        for i, j in enumerate(got):
            if j in label:
                groups[i // 5][label[j]] += 1
        total = sum(sum(c.values()) for c in groups.values())
        out[(r, "purity", None)] = sum(max(c.values()) for c in groups.values()) / total if total else 0.0
    return out


@pytest.mark.parametrize("t", [1.0, 2.0])
def test_random_lists_with_a_hot_resume(spark, t):
    rng = random.Random(5)
    results, judgments = [], []
    for i in range(25):
        n = 400 if i == 0 else rng.randint(1, 14)
        results += [(f"r{i}", rank, f"j{rng.randint(0, 200 if i == 0 else 15)}") for rank in range(1, n + 1)]
        if i % 6 != 5:
            jobs = rng.sample(range(200 if i == 0 else 15), 120 if i == 0 else rng.randint(1, 12))
            judgments += [(f"r{i}", f"j{j}", float(rng.choice([0, 0, 1, 2, 3]))) for j in jobs]
    want = _brute(results, judgments, t, (3, 5, 10))
    got = _scores(spark.createDataFrame(results, L).repartition(6), spark.createDataFrame(judgments, J), t=t)
    assert got.keys() == want.keys()
    for key, score in want.items():
        assert got[key][0] == pytest.approx(score, abs=1e-9), key


def test_chunks_do_not_change_precision_sums(spark):
    rng = random.Random(1)
    judged = spark.createDataFrame([("h", i, f"j{i}", float(rng.randint(0, 1))) for i in range(1, 500)], "resume_id string, rank long, job_id string, relevance double")
    one = R.precision_sums(judged).first()["precision_sum"]
    assert R.precision_sums(judged, chunk=7).first()["precision_sum"] == pytest.approx(one)


def test_judgments_and_results_are_upserted(spark):
    df = spark.createDataFrame([(1, 7, 0.0, 0), (1, 7, 2.0, 1), (1, 8, 1.0, 2)], "resume_id int, job_id int, relevance double, ord int")
    assert rows(R.load_judgments(df)) == [("1", "7", 2.0), ("1", "8", 1.0)]
    with pytest.raises(MissingInput, match="relevance"):
        R.load_judgments(df.drop("relevance"))
    batches = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "resume_id string, job_id string, batch int")
    assert rows(R.register_results(batches), "resume_id", "job_id") == [("a", "y"), ("b", "z")]


def test_threshold_grid(golden):
    results, judgments = golden
    grid = R.threshold_grid(R.judge(results, judgments), judgments)
    assert {r["threshold"]: round(r["f1"], 6) for r in grid.collect()}[2.0] == 0.214286
    best = R.best_threshold(grid).first()
    assert best["threshold"] == 0.5 and best["f1"] == pytest.approx(0.384615, abs=1e-6)
    nothing = judgments.withColumn("relevance", F.lit(9.0)).withColumn("job_id", F.lit("none"))
    grid = R.threshold_grid(R.judge(results, nothing), nothing)
    assert R.best_threshold(grid).first()["threshold"] == 1.0


def test_sample_judgments(spark):
    titles = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "title string, ord int")
    resumes = spark.range(500).select(F.concat(F.lit("resume_"), "id").alias("resume_id"))
    sample = R.sample_judgments(titles, resumes, jobs_per_resume=7)
    jobs = dict(rows(sample.select("job_id", "job_title").distinct()))
    assert jobs == {f"job_{i}": "bac"[i % 3] for i in range(7)}
    shares = {r["relevance"]: r["count"] / 3500 for r in sample.groupBy("relevance").count().collect()}
    assert shares == pytest.approx({0.0: 0.4, 1.0: 0.3, 2.0: 0.2, 3.0: 0.1}, abs=0.04)
    assert rows(sample) == rows(R.sample_judgments(titles.repartition(3), resumes.repartition(5), jobs_per_resume=7))


def test_number_rows(spark):
    keys = spark.range(1000).select((F.col("id") * 7).alias("key"))
    numbered = number_rows(keys.repartition(6), "key", slots=16)
    assert sorted(r["row_index"] for r in numbered.collect()) == list(range(1000))
    assert rows(numbered) == rows(number_rows(keys.repartition(2), "key", slots=16))
