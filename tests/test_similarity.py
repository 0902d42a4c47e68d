import numpy as np
import pytest
from helpers import rows

from dossier.operators import linking
from dossier.operators.similarity import top_k

STRATEGIES = [{}, {"held_bytes": -1, "tile_bytes": 3000}]


def _vectors(spark, n, seed, id):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, 6)).round(2)
    data[n // 3 : 2 * n // 3] = data[0]  # a third of all rows are copies
    data[n - 1] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"{id} long, embedding array<float>")
    return data.astype(np.float32).astype(float), df


def _expected(q, c, k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    s = np.round(unit(q) @ unit(c).T, 9)
    out = []
    for i in range(len(q)):
        order = sorted(range(len(c)), key=lambda j: (-s[i, j], j))[:k]
        out += [(i, j, float(s[i, j]) + 0.0, r + 1) for r, j in enumerate(order)]
    return sorted(out)


def _same(got, want):
    assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want]
    assert [s for *_, s, _ in got] == pytest.approx([s for *_, s, _ in want])


@pytest.mark.parametrize("k", [1, 7, 300])
@pytest.mark.parametrize("partitions", [1, 5])
def test_dense_against_brute_force(spark, k, partitions):
    q, queries = _vectors(spark, 30, 1, "query_id")
    c, corpus = _vectors(spark, 200, 2, "person_id")
    want = _expected(q, c, k)
    for options in [{}, {"held_bytes": 2500}, {"held_bytes": -1, "tile_bytes": 3000}]:
        got = top_k(queries.repartition(partitions), corpus.repartition(partitions), k, **options)
        _same(sorted(tuple(r) for r in got.collect()), want)


def test_corpus_is_held_when_only_it_is_small(spark):
    q, queries = _vectors(spark, 200, 1, "query_id")
    c, corpus = _vectors(spark, 20, 2, "person_id")
    got = top_k(queries, corpus, 4, held_bytes=20 * 64)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    _same(sorted(tuple(r) for r in got.collect()), _expected(q, c, 4))


@pytest.mark.parametrize("options", [{}, {"held_bytes": 9000}, {"held_bytes": -1, "tile_bytes": 2000}])
@pytest.mark.parametrize("keys", ["int", "string"])
def test_sparse_against_brute_force(spark, options, keys):
    rng = np.random.default_rng(3)
    dense = (rng.random((60, 25)) < 0.2) * rng.integers(1, 5, (60, 25))
    dense[20:40] = dense[3]
    dense[50] = 0
    as_key = (lambda x: f"k{x}") if keys == "string" else int
    data = [(i, [as_key(j) for j in np.nonzero(v)[0]], [float(x) for x in v[v > 0]]) for i, v in enumerate(dense)]
    corpus = spark.createDataFrame(data, f"person_id long, keys array<{keys}>, w array<double>")
    queries = corpus.withColumnRenamed("person_id", "query_id")
    want = _expected(dense.astype(float), dense.astype(float), 9)
    got = top_k(queries.repartition(3), corpus.repartition(4), 9, vector=("keys", "w"), **options)
    _same(sorted(tuple(r) for r in got.collect()), want)
    positive = top_k(queries, corpus, 9, vector=("keys", "w"), positive=True, **options)
    _same(sorted(tuple(r) for r in positive.collect()), [w for w in want if w[2] > 0])


def test_null_vectors_and_text_ids(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0, 1.0])], "person_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query_id string, embedding array<float>")
    assert rows(top_k(queries, corpus, 5), "query_id", "person_id", "rank") == [("q", "a", 1), ("q", "c", 2)]
    assert rows(top_k(queries.limit(0), corpus, 5)) == []


def test_link_by_token_overlap(spark):
    titles = spark.createDataFrame([("data engineer",), ("Data  Lead",), ("zzz",), ("data engineer",), ("",)], "title string")
    jobs = spark.createDataFrame(
        [("job_0", "data analyst", 0), ("job_1", "software engineer", 1), ("job_2", "senior data engineer", 2)],
        "job_id string, job_title string, ord int",
    )
    got = {r["title"]: (r["job_id"], r["overlap"]) for r in linking.link_by_token_overlap(titles, jobs).collect()}
    assert got["data engineer"] == ("job_2", 2) and got["data  lead"] == ("job_0", 1)
    assert got["zzz"][1] == 0 and got["zzz"][0].startswith("title_") and len(got) == 4
    again = {r["title"]: (r["job_id"], r["overlap"]) for r in linking.link_by_token_overlap(titles, jobs, held_bytes=-1).collect()}
    assert again == got


def test_last_job_of_a_title_wins_at_its_first_position(spark):
    jobs = spark.createDataFrame([("a", "Dev X", 0), ("b", "dev y", 1), ("c", "dev x", 2)], "job_id string, job_title string, ord int")
    assert rows(linking.title_map(jobs)) == [("dev x", "c", 0), ("dev y", "b", 1)]
    one = spark.createDataFrame([("dev",)], "title string")
    assert rows(linking.link_by_token_overlap(one, jobs)) == [("dev", "c", 1)]
