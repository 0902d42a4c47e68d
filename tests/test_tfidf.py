import math

import pytest
from helpers import rows
from pyspark.sql import functions as F

from dossier.operators import embedding, tfidf
from dossier.functions import vectors

DOCS = [
    (1, "red apple pie"),
    (2, "red apple tart"),
    (3, "green apple"),
    (4, "the and of"),
    (5, "red red plum"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string")


def test_fit_by_hand(docs):
    model = tfidf.fit(docs, "text", min_df=2, max_df=0.85)
    got = {r["term"]: (r["idx"], r["tf"], r["df"], round(r["idf"], 6)) for r in model.vocabulary.collect()}
    idf = lambda df: round(math.log(6 / (1 + df)) + 1, 6)
    assert got == {"apple": (0, 3, 3, idf(3)), "red": (1, 4, 3, idf(3)), "red apple": (2, 2, 2, idf(2))}
    assert model.n_docs == 5


def test_bounds_are_inclusive_and_cap_breaks_ties_by_term(docs):
    assert "apple" not in tfidf.fit(docs, "text", min_df=1, max_df=0.59).terms
    assert "apple" in tfidf.fit(docs, "text", min_df=1, max_df=0.6).terms
    assert tfidf.fit(docs, "text", min_df=1, max_features=4).terms == ["apple", "apple pie", "red", "red apple"]


def test_weights_by_hand(docs):
    model = tfidf.fit(docs, "text", min_df=2)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf.doc_terms(docs, model, "doc_id", "text").collect()}
    a, b = math.log(6 / 4) + 1, math.log(6 / 3) + 1
    length = math.sqrt(2 * a * a + b * b)
    assert got[(1, "red apple")] == pytest.approx(b / length)
    assert got[(5, "red")] == pytest.approx(1.0)
    assert not any(d == 4 for d, _ in got)


@pytest.mark.parametrize("options", [{}, {"min_df": 2, "max_features": 300}])
def test_joined_vocabulary_gives_the_same(spark, options):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    small = tfidf.fit(docs, "text", **options)
    large = tfidf.fit(docs, "text", broadcast_terms=0, **options)
    assert small.is_small and not large.is_small
    weights = [
        tfidf.doc_terms(docs, m, "doc_id", "text").withColumn("weight", F.round("weight", 9)) for m in (small, large)
    ]
    assert rows(weights[0]) == rows(weights[1])
    texts = [tfidf.weight_text(docs, m, "text", doc_id="doc_id").select("doc_id", "weighted_text") for m in (small, large)]
    assert rows(texts[0]) == rows(texts[1])


def test_repetitions(spark):
    df = spark.createDataFrame([(0.05,), (0.34,), (0.9,), (0.5,)], "w double")
    assert rows(df.select("w", tfidf.repetitions(F.col("w")))) == [(0.05, 1), (0.34, 3), (0.5, 5), (0.9, 5)]


def test_weighted_text_order(spark, docs):
    model = tfidf.fit(docs, "text", min_df=2)
    got = dict(rows(tfidf.weight_text(docs, model, "text"), "doc_id", "weighted_text"))
    assert got[3] == "green apple appleappleappleappleapple"
    assert got[4] == "the and of"
    # Few terms: in term order, whatever their weights.
    assert [w[:3] for w in got[1][len(DOCS[0][1]) + 1 :].split(" ")[:2]] == ["app", "red"]
    many = spark.createDataFrame([(i, " ".join(f"w{j:02d}" for j in range(i, 40))) for i in range(12)], "doc_id int, text string")
    model = tfidf.fit(many, "text", min_df=1, max_df=1.0, ngram_range=(1, 1))
    weights = tfidf.doc_terms(many, model, "doc_id", "text").filter("doc_id = 0").collect()
    heaviest = sorted((r["weight"], r["term"]) for r in weights)[-20:]
    suffix = dict(rows(tfidf.weight_text(many, model, "text"), "doc_id", "weighted_text"))[0][len(" ".join("w00" for _ in range(40))) :]
    assert [t[:3] for t in suffix.split()] == [t for _, t in heaviest]


def test_empty_vocabulary(spark, docs):
    model = tfidf.fit(docs, "text", min_df=50)
    assert model.terms == []
    assert dict(rows(tfidf.weight_text(docs, model, "text"), "doc_id", "weighted_text")) == dict(DOCS)


def test_hashed_embedding(docs):
    embedded = embedding.embed(docs, "text", dim=64)
    got = {r[0]: (r[1], round(r[2], 4)) for r in embedded.select("doc_id", F.size("embedding"), vectors.norm("embedding")).collect()}
    assert set(got.values()) == {(64, 1.0)}
    nothing = embedding.embed(docs.limit(1).withColumn("text", F.lit("")), "text", dim=8).first()["embedding"]
    assert list(nothing) == [0.0] * 8


def test_user_encoder(spark, docs):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = dict(rows(embedding.embed(docs.repartition(3), "text", load_encoder=load, batch_size=2), "doc_id", "embedding"))
    for i, t in DOCS:
        length = math.hypot(len(t), 1.0)
        assert got[i] == pytest.approx([len(t) / length, 1 / length], abs=1e-6)


def test_fit_plan_has_one_exchange_with_partial_aggregation(docs):
    plan = tfidf.term_counts(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_vectorize_has_no_exchange(docs):
    model = tfidf.fit(docs, "text", min_df=2)
    plan = tfidf.weight_text(docs, model, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_unbounded_vocabulary_counts_in_the_row_and_numbers_its_terms(spark):
    from dossier.plans import matching

    texts = [(1, "red apple red"), (1, "red plum"), (2, "green apple"), (3, None), (None, "apple")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    model = tfidf.fit(docs, "text", min_df=1, max_df=1.0, max_features=None)
    # Rows of equal ids are one document.
    found = tfidf.doc_terms(docs, model, "doc_id", "text")
    assert {r["term"]: r["tf"] for r in found.filter("doc_id = 1").collect()} == {
        "red": 3, "apple": 1, "plum": 1, "red apple": 1, "apple red": 1, "red plum": 1
    }
    numbers = {r["term"]: r["idx"] for r in model.numbered.collect()}
    assert sorted(numbers.values()) == list(range(len(numbers)))
    ids = tfidf.doc_term_ids(docs, model, "doc_id", "text")
    assert rows(ids.select("doc_id", "tf", F.round("weight", 9))) == rows(found.select("doc_id", "tf", F.round("weight", 9)))
    # No exchange of every term of every document, and no term in a vector.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(doc_id" in x and "term" in x]
    index = matching.MatchIndex(docs, model, sparse=True)
    assert dict(index.with_vectors(docs, "text", "doc_id").dtypes)["vector_keys"] == "array<bigint>"


def test_terms_of_a_document_are_sorted_without_a_comparator(spark, docs):
    plan = tfidf.term_counts(docs, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
