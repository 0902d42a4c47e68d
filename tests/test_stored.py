"""Stored models, term counts and encodings; exact matching; slabs and clustered blocks."""

import os

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from dossier.operators import encoding_store, lookup, similarity, term_store, tfidf
from dossier.plans import matching
from dossier.sources import sinks, stages

TEXTS = ["java spring services", "java spark pipelines", "spark lake pipelines", "figma layout", "sales calls java", "lake"]


def written(spark, path, ids, mode="append"):
    frame = spark.createDataFrame([(i, f"T{i % 4}", TEXTS[i % len(TEXTS)] + f" w{i}") for i in ids], "person_id int, title string, embedding_text string")
    sinks.write_table(frame.coalesce(2), path, mode=mode)
    return spark.read.parquet(path)


def terms_of(model):
    return rows(model.vocabulary.withColumn("idf", F.round("idf", 9)))


def test_a_second_build_fits_nothing(spark, tmp_path, monkeypatch):
    corpus = written(spark, str(tmp_path / "corpus"), range(12))
    first = matching.build_index(corpus, sparse=True, path=str(tmp_path / "index"), min_df=1)

    def never(*a, **k):
        raise AssertionError("fitted again")

    for module, name in ((matching, "term_counts"), (matching, "fit"), (matching, "choose_terms"), (tfidf, "term_counts")):
        monkeypatch.setattr(module, name, never)
    again = matching.build_index(corpus, sparse=True, path=str(tmp_path / "index"), min_df=1)
    assert terms_of(again.model) == terms_of(first.model) and again.model.n_docs == 12
    query = spark.createDataFrame([(1, "java spark")], "query_id int, text string")
    assert rows(matching.match(query, again)) == rows(matching.match(query, first))
    with pytest.raises(AssertionError, match="fitted again"):
        matching.build_index(corpus, sparse=True, path=str(tmp_path / "index"), min_df=2)


def test_a_grown_corpus_equals_a_fresh_fit(spark, tmp_path):
    path, store = str(tmp_path / "corpus"), str(tmp_path / "store")
    known = 0
    for ids in (range(6), range(6, 20), range(20, 21), ()):
        corpus = written(spark, path, ids) if ids else spark.read.parquet(path)
        stored = term_store.stored_counts(corpus, store)
        files = len([f for f in os.listdir(path) if f.endswith(".parquet")])
        assert stored.counted_files == files - known
        known = files
        assert rows(stored.counts) == rows(tfidf.term_counts(corpus, "embedding_text")) and stored.n_docs == corpus.count()
        fresh = tfidf.fit(corpus, min_df=1)
        assert terms_of(matching.stored_model(corpus, str(tmp_path / "model"), grows=True, min_df=1)) == terms_of(fresh)


def test_removed_and_changed_files_are_counted_again(spark, tmp_path):
    path, store = str(tmp_path / "corpus"), str(tmp_path / "store")
    written(spark, path, range(6))
    term_store.stored_counts(written(spark, path, range(6, 12)), store)
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    away = os.path.join(path, files[0])
    kept = open(away, "rb").read()
    os.unlink(away)
    corpus = spark.read.parquet(path)
    less = term_store.stored_counts(corpus, store)
    assert less.counted_files == len(files) - 1
    assert rows(less.counts) == rows(tfidf.term_counts(corpus, "embedding_text")) and less.n_docs == corpus.count()
    # The file comes back: neither the batch that had it nor the later one may count twice.
    with open(away, "wb") as f:
        f.write(kept)
    corpus = spark.read.parquet(path)
    back = term_store.stored_counts(corpus, store)
    assert back.counted_files == 1
    assert rows(back.counts) == rows(tfidf.term_counts(corpus, "embedding_text")) and back.n_docs == 12


def test_many_batches_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(term_store, "MOST_BATCHES", 2)
    path, store = str(tmp_path / "corpus"), str(tmp_path / "store")
    for i in range(4):
        corpus = written(spark, path, range(3 * i, 3 * i + 3))
        stored = term_store.stored_counts(corpus, store)
        assert stored.n_docs == 3 * i + 3 and rows(stored.counts) == rows(tfidf.term_counts(corpus, "embedding_text"))
    base = os.path.join(store, os.listdir(store)[0])
    assert len(term_store._batches(spark, base)) <= 2


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    path, store = str(tmp_path / "corpus"), str(tmp_path / "store")
    corpus = written(spark, path, range(6))
    term_store.stored_counts(corpus, store)
    base = os.path.join(store, os.listdir(store)[0])
    spark.createDataFrame([("ghost", 5, 5)], "term string, tf long, df long").write.parquet(f"{base}/counts/batch=cut")
    again = term_store.stored_counts(corpus, store)
    assert again.counted_files == 0 and again.counts.filter("term = 'ghost'").isEmpty()


def test_counts_need_files(spark):
    with pytest.raises(ValueError, match="read from files"):
        term_store.stored_counts(spark.createDataFrame([("a",)], "embedding_text string"), "/tmp/unused")


def encoder_of(value):
    def load():
        return lambda texts: np.array([[value, len(t)] for t in texts], dtype=float)

    return load


def test_encoders_never_share_an_index(spark, tmp_path):
    corpus, path = written(spark, str(tmp_path / "corpus"), range(6)), str(tmp_path / "index")
    with pytest.raises(ValueError, match="name"):
        matching.build_index(corpus, encoder_of(1.0), path=path, min_df=1)
    one = matching.build_index(corpus, encoder_of(1.0), path=path, encoder="one", min_df=1)
    two = matching.build_index(corpus, encoder_of(9.0), path=path, encoder="two", min_df=1)
    assert rows(one.corpus, "embedding") != rows(two.corpus, "embedding")
    assert rows(matching.build_index(corpus, encoder_of(5.0), path=path, encoder="one", min_df=1).corpus) == rows(one.corpus)


def test_a_stage_key_covers_the_stages_below(spark, tmp_path):
    graph = stages.StageGraph(spark, str(tmp_path))

    def one():
        return spark.range(1), {"made": 1}

    base = [graph.stage("base", one, {"a": a}, ["input"]) for a in (1, 2, 1)]
    assert [b.reused for b in base] == [False, False, True] and base[2].facts == {"made": 1}
    top = [graph.stage("top", one, {}, [b]) for b in base]
    assert [t.reused for t in top] == [False, False, True] and top[0].key != top[1].key


def test_known_texts_are_not_encoded_again(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            counter.add(len(texts))
            return np.array([[1.0, len(t)] for t in texts])

        return encode

    store = encoding_store.EncodingStore(str(tmp_path / "store"), "counted", load)
    texts = [f"text {i % 50}" + "x" * (i % 50) for i in range(500)] + ["hot"] * 400 + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = store.embed(frame, "text", "v")
    assert counter.value == 52 == store.encoded(spark)
    want = {t: np.array([1.0, len(t or "")]) / np.hypot(1.0, len(t or "")) for t in texts}
    assert got.columns == ["id", "text", "v"] and got.count() == len(texts)
    assert all(np.allclose(r["v"], want[r["text"]], atol=1e-6) for r in got.collect())
    grown = frame.unionByName(spark.createDataFrame([(1000 + i, f"new {i}") for i in range(5)], "id int, text string"))
    assert store.embed(grown, "text", "v").filter("v IS NULL").isEmpty()
    assert counter.value == 57
    other = encoding_store.EncodingStore(str(tmp_path / "store"), "other", load)
    assert other.encoded(spark) == 0


def test_index_takes_known_encodings(spark, tmp_path):
    corpus, store = written(spark, str(tmp_path / "corpus"), range(12)), str(tmp_path / "store")
    plain = matching.build_index(corpus, dim=64, min_df=1)
    kept = matching.build_index(corpus, dim=64, min_df=1, encodings=store)
    assert rows(kept.corpus) == rows(plain.corpus)
    query = spark.createDataFrame([(1, "java spark")], "query_id int, text string")
    assert rows(matching.match(query, kept, exact=True)) == rows(matching.match(query, plain, exact=True))


def test_look_up_spreads_hot_keys(spark):
    frame = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)] + [(-1, None), (-2, "none")], "id int, k string")
    table = stages.settle(frame.filter("k <> 'none'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")))
    got = lookup.look_up(frame, table, ["k"], hot=10)
    want = {r["k"]: r["least"] for r in table.collect()}
    assert got.columns == ["id", "k", "least"] and got.count() == 902
    assert all(r["least"] == want.get(r["k"]) for r in got.collect())


# --- exact matching ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sparse", [True, False])
def test_exact_matching_fills_the_list(spark, sparse):
    # The best 30 rows share one title, so three candidates per wanted match hold one title only.
    data = [(i, "Senior Dev" if i % 2 else "Dev", "java spark " * 3 + f"w{i}") for i in range(30)]
    data += [(100 + i, t, f"java {t} other words here") for i, t in enumerate(["Cook", "Nurse", "Pilot", "Clerk"])]
    corpus = spark.createDataFrame(data, "person_id int, title string, embedding_text string").repartition(3)
    index = matching.build_index(corpus, dim=256, sparse=sparse, min_df=1, max_df=1.0)
    query = spark.createDataFrame([("q", "java spark"), ("none", "zzz"), ("null", None)], "query_id string, text string")
    assert matching.match(query, index, 4).filter("query_id = 'q'").count() == 1
    got = matching.match(query, index, 4, exact=True)
    found = {q: [(r["rank"], r["title"]) for r in sorted(got.filter(F.col("query_id") == q).collect(), key=lambda r: r["rank"])] for q in ("q", "none", "null")}
    assert [r for r, _ in found["q"]] == [1, 2, 3, 4] and found["q"][0][1] == "Dev"
    assert all(len({t for _, t in f}) == 4 for f in found.values())


@pytest.mark.parametrize("options", [{}, {"held_bytes": 9000}, {"held_bytes": -1, "tile_bytes": 2000}])
@pytest.mark.parametrize("dense", [True, False])
def test_best_row_per_group_against_brute_force(spark, options, dense):
    rng = np.random.default_rng(5)
    matrix = (rng.random((80, 12)) < 0.4) * rng.integers(1, 4, (80, 12)).astype(float)
    matrix[30:50] = matrix[7]
    group = [None if i % 9 == 0 else f"g{i % 7}" for i in range(80)]
    if dense:
        data = [(i, [float(x) for x in v], group[i]) for i, v in enumerate(matrix)]
        frame = spark.createDataFrame(data, "person_id long, embedding array<double>, team string")
        vector = "embedding"
    else:
        data = [(i, [int(j) for j in np.nonzero(v)[0]], [float(x) for x in v[v > 0]], group[i]) for i, v in enumerate(matrix)]
        frame = spark.createDataFrame(data, "person_id long, keys array<int>, w array<double>, team string")
        vector = ("keys", "w")
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit @ unit.T, 9)
    want = []
    for i in range(80):
        seen = set()
        for j in sorted(range(80), key=lambda j: (-scores[i, j], j)):
            if group[j] not in seen and len(seen) < 5:
                seen.add(group[j])
                want.append((i, j, group[j], len(seen)))
    queries = frame.withColumnRenamed("person_id", "query_id")
    got = similarity.top_k(queries.repartition(3), frame.repartition(4), 5, vector=vector, group="team", distinct=True, **options)
    assert got.columns == ["query_id", "person_id", "team", "score", "rank"]
    assert sorted((r["query_id"], r["person_id"], r["team"], r["rank"]) for r in got.collect()) == sorted(want, key=lambda w: w[:2])
    with pytest.raises(ValueError, match="group"):
        similarity.top_k(queries, frame, 5, vector=vector, distinct=True)


# --- slabs and clustered blocks ------------------------------------------------------------------------------------


def clustered(spark, n, seed, id):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 5
    rng = np.random.default_rng(seed)
    data = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 16)) * 0.05
    return data, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"{id} long, embedding array<double>")


@pytest.mark.parametrize("options", [{}, {"held_bytes": -1, "tile_bytes": 5000}])
def test_clusters_below_the_list_are_skipped(spark, options):
    q, queries = clustered(spark, 60, 1, "query_id")
    c, corpus = clustered(spark, 4000, 2, "person_id")
    compared = spark.sparkContext.accumulator(0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        got = similarity.top_k(queries, corpus.coalesce(1), 5, compared=compared, **options).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(c).T, 9)
    want = [(i, j) for i in range(60) for j in sorted(range(4000), key=lambda j: (-scores[i, j], j))[:5]]
    assert sorted((r["query_id"], r["person_id"]) for r in got) == sorted(want)
    assert 0 < compared.value < 60 * 4000 / 3


def test_the_larger_side_of_slabs_is_not_shuffled(spark, monkeypatch):
    _, queries = clustered(spark, 30, 1, "query_id")
    _, corpus = clustered(spark, 300, 2, "person_id")
    plans = []
    for name in ("hold_queries", "hold_corpus"):
        plain = getattr(similarity._Search, name)

        def seen(self, q, c, plain=plain):
            found, held = plain(self, q, c)
            plans.append(found._jdf.queryExecution().executedPlan().toString())
            return found, held

        monkeypatch.setattr(similarity._Search, name, seen)
    for left, right in ((queries, corpus), (corpus.toDF("query_id", "embedding"), queries.toDF("person_id", "embedding"))):
        plans.clear()
        similarity.top_k(left, right, 3, held_bytes=-1, tile_bytes=2000).count()
        assert len(plans) > 1 and all("Exchange" not in p for p in plans)


def zipf(spark, n, seed, id):
    """Rows with a few keys that most of them share and many rare ones of larger weight."""
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        frequent = sorted(rng.choice(30, 12, replace=False))
        topic = int(rng.integers(0, 60))
        rare = sorted({100 + topic * 20 + int(x) for x in rng.integers(0, 20, 10)})
        keys = [int(x) for x in frequent] + rare
        values = [float(x) for x in rng.random(12) * 0.3] + [1.0 + float(x) for x in rng.random(len(rare))]
        data.append((i, keys, values))
    return data, spark.createDataFrame(data, f"{id} long, keys array<int>, w array<double>")


@pytest.mark.parametrize("options", [{}, {"held_bytes": 0}, {"held_bytes": 600_000}, {"held_bytes": -1, "tile_bytes": 60_000}])
def test_frequent_keys_are_scored_where_they_can_matter(spark, options):
    q, queries = zipf(spark, 600, 1, "query_id")
    c, corpus = zipf(spark, 3000, 2, "person_id")
    if options == {"held_bytes": 600_000}:  # more queries than corpus rows: the corpus is held
        q, queries, c, corpus = c, corpus.withColumnRenamed("person_id", "query_id"), q, queries.withColumnRenamed("query_id", "person_id")

    def dense(rows_of):
        out = np.zeros((len(rows_of), 1400))
        for i, keys, values in rows_of:
            out[i, keys] = values
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    a, b = dense(q), dense(c)
    scores = np.round(a @ b.T, 9)
    compared = spark.sparkContext.accumulator(0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 400)
    try:
        found = similarity.top_k(queries.coalesce(1), corpus.coalesce(1), 4, vector=("keys", "w"), compared=compared, **options)
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(i, j) for i in range(len(q)) for j in sorted(range(len(c)), key=lambda j: (-scores[i, j], j))[:4]]
    assert sorted((r["query_id"], r["person_id"]) for r in got) == sorted(want)
    shared = sum(int(x) * int(y) for x, y in zip((a > 0).sum(0), (b > 0).sum(0), strict=True))
    assert 0 < compared.value < shared / 3


# --- published batches and bounded files -----------------------------------------------------------------------------


def test_replayed_batches_leave_no_gap_and_no_duplicate(spark, tmp_path):
    from dossier.sources import publish

    out, schema = str(tmp_path / "out"), "id long"
    assert publish.published(spark, out, "t", schema).columns == ["id", "batch"]
    for batch in (0, 1):
        publish.publish({"t": spark.range(3), "u": spark.range(1)}, out, batch)
    spark.range(9).write.parquet(publish.folder(out, "t", 2, "cut"))  # files without a manifest
    publish.publish({"t": spark.range(5), "u": spark.range(1)}, out, 1)
    assert rows(publish.published(spark, out, "t", schema)) == sorted([(i, 0) for i in range(3)] + [(i, 1) for i in range(5)], key=repr)
    assert publish.published(spark, out, "u", schema).count() == 2
    assert len(os.listdir(os.path.join(out, "t", "batch=1"))) == 1


def test_scratch_releases_what_it_settled(spark):
    shared = stages.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    _, queries = clustered(spark, 5, 1, "query_id")
    _, corpus = clustered(spark, 50, 2, "person_id")
    for _ in range(3):
        with stages.scratch(spark) as held:
            assert stages.settle(similarity.top_k(queries, corpus, 3)).count() == 15
            assert len(held.paths) == len(held.broadcasts) == 1
        assert set(os.listdir(shared)) == before
    kept = stages.settle(spark.range(2))
    assert kept.count() == 2 and len(set(os.listdir(shared)) - before) == 1


def test_batches_of_a_stream_leave_nothing_behind(spark, tmp_path):
    from dossier.streaming.match_stream import match_stream, stream_files, stream_matches

    corpus = spark.createDataFrame([(i, f"T{i}", t) for i, t in enumerate(TEXTS)], "person_id int, title string, embedding_text string")
    index = matching.build_index(corpus, sparse=True, min_df=1)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    shared = stages.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    assert stream_matches(spark, out).count() == 0
    for i in range(6):
        (folder / f"f{i}.txt").write_text(TEXTS[i])
    match_stream(str(folder), index, out, str(tmp_path / "progress"), 2, types=["txt"], files_per_batch=1).awaitTermination()
    assert stream_files(spark, out).select("batch").distinct().count() == 6
    assert stream_matches(spark, out).filter("rank = 1").count() == 6
    assert set(os.listdir(shared)) == before


def test_large_files_are_named_and_not_read(spark, tmp_path):
    from dossier.sources import documents

    (tmp_path / "small.txt").write_text("few words")
    (tmp_path / "large.txt").write_text("many words " * 50)
    scan = documents.scan_documents(spark, str(tmp_path), ["txt"])
    found = documents.extract_text(scan, max_bytes=100)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in found.collect()}
    assert got == {"small.txt": ("few words", None), "large.txt": (None, "file of 550 bytes is larger than 100")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan
    whole = spark.createDataFrame([("a.txt", b"x" * 9), ("b.txt", b"x"), ("c.txt", None)], "path string, content binary")
    got = documents.extract_text(whole, max_bytes=5).orderBy("path").collect()
    assert [(r["text"], r["error"]) for r in got] == [(None, "file of 9 bytes is larger than 5"), ("x", None), (None, "no content")]


def test_evaluation_is_written(spark, tmp_path):
    from dossier.plans import evaluation

    corpus = spark.createDataFrame([(i, f"Title {i}", t) for i, t in enumerate(TEXTS)], "person_id int, title string, embedding_text string")
    index = matching.build_index(corpus, sparse=True, min_df=1)
    resumes = spark.range(4).select(F.concat(F.lit("r"), "id").alias("resume_id"))
    out = str(tmp_path / "out")
    done = evaluation.evaluate_matcher(index, resumes=resumes, output=out)
    read = spark.read.json(f"{out}/metrics")
    assert read.count() == done.averages.count() and {r["threshold"] for r in read.collect()} == {done.threshold}
    for name in ("judgments", "results", "scores"):
        assert spark.read.option("header", True).csv(f"{out}/{name}").count() == getattr(done, name).count()


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_title_forms_by_dictionary(spark, held):
    from dossier.operators import titles

    texts = ["Senior Dev", "Dev", "Dev", None, "", "UI/UX Designer"] * 40 + [f"Lead {i} (Remote)" for i in range(2000)]
    frame = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "id int, title string, n string")
    got = titles.with_title_forms(frame, held_bytes=held)
    want = titles.title_forms(frame)
    assert got.columns == want.columns == ["id", "title", "n", "shown_title", "title_key"]
    assert rows(got) == rows(want)
    assert titles.title_dictionary(frame).count() == 2004
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_batch_of_counts_is_read_as_it_is(spark, tmp_path):
    path, store = str(tmp_path / "corpus"), str(tmp_path / "store")
    for part in (["red apple", "red plum"], ["green apple"]):
        spark.createDataFrame([(t,) for t in part], "embedding_text string").coalesce(1).write.mode("append").parquet(path)
        stored = term_store.stored_counts(spark.read.parquet(path), store)
        moved = "Aggregate" in stored.counts._jdf.queryExecution().optimizedPlan().toString()
        assert moved == (len(part) == 1)  # the second batch
    counts = {r["term"]: (r["tf"], r["df"]) for r in stored.counts.collect()}
    assert counts["apple"] == (2, 2) and counts["red"] == (2, 2) and counts["green apple"] == (1, 1)
