"""Registered queries: every operator over whole tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, titles, vectors
from ..operators import collapse, corpus, embedding, linking, numbering, ranking, similarity, tfidf
from ..operators import titles as title_rules
from ..operators.encoding_store import EncodingStore
from ..plans import corpus_build, evaluation, matching
from ..sources import documents, profiles, sinks, stages
from ..streaming import match_stream
from .oracle import METRIC_QUERIES
from .views import table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DOCX_ROWS = 256  # that a task holds at once


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def fresh(spark: SparkSession, name: str) -> str:
    return f"{stages.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _documents(spark, d, *columns) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", *columns)


# ---- sources and sinks


@query
def csv_profiles(spark, d):
    people = view(spark, d, "people").select("person_id", "name", "segment")
    path = sinks.write_table(people, fresh(spark, "people"), "csv")
    return profiles.read_csv(spark, path, ord=None)


@query
def csv_multiline(spark, d):
    path = sinks.write_table(table(spark, d, "conversations"), fresh(spark, "conversations"), "csv")
    read = profiles.read_csv(spark, path, ord=None, key="conv_id", multi_line=True)
    return read.select("conv_id", "turn", "role", "text")


@query
def json_round_trip(spark, d):
    docs = _documents(spark, d, "lang")
    path = sinks.write_json(docs, fresh(spark, "documents"))
    return spark.read.schema(docs.schema).json(path)


@query
def text_round_trip(spark, d):
    cleaned = table(spark, d, "documents").select("lang", text.clean_text("text").alias("text"))
    path = sinks.write_text(cleaned, fresh(spark, "texts"), name="lang")
    return spark.read.text(path).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("value")).alias("n_chars")
    )


@query
def stage_round_trip(spark, d):
    return stages.materialize(table(spark, d, "documents"), fresh(spark, "stage"), {"stage": "documents"})


@query
def corpus_round_trip(spark, d):
    path = sinks.write_table(view(spark, d, "corpus_documents"), fresh(spark, "corpus"))
    read = profiles.read_corpus(spark, path)
    return read.withColumn("person_id", F.col("person_id").cast("int"))


@query
def text_audit(spark, d):
    cleaned = _documents(spark, d).withColumn("text", text.clean_text("text"))
    return cleaned.select("doc_id", *text.text_audit("text"))


@query
def extract_documents(spark, d):
    files = _documents(spark, d).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )
    return documents.extract_text(files)


def _docx(text: str) -> bytes:
    """A word document with the text as its only paragraph."""
    namespace = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{namespace}"><w:body><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word documents in place of texts, few at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, DOCX_ROWS):
            part = batch.slice(a, DOCX_ROWS)
            contents = pa.array([_docx(t) for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("path"), contents], names=["path", "content"])


@query
def extract_docx(spark, d):
    texts = _documents(spark, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text")
    return documents.extract_text(texts.mapInArrow(_packages, "path string, content binary"))


@query
def extract_bounded(spark, d):
    """Texts of all files up to a size; the larger ones are named with an error."""
    files = _documents(spark, d).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )
    return documents.extract_text(files, max_bytes=4000)


@query
def extract_pages(spark, d):
    files = table(spark, d, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.encode("html", "utf-8").alias("content"),
    )
    return documents.audit(documents.extract_text(files))


# ---- text and titles


@query
def clean_text(spark, d):
    return _documents(spark, d).select("doc_id", text.clean_text("text").alias("text"))


@query
def clean_all(spark, d):
    return text.clean_all(table(spark, d, "conversations"), keep=["conv_id"])


@query
def clean_title(spark, d):
    return view(spark, d, "experience").withColumn("title", text.clean_title("title"))


@query
def first_title(spark, d):
    return view(spark, d, "experience").withColumn("title", text.first_title("title"))


@query
def preview(spark, d):
    return _documents(spark, d, "source").select(
        "doc_id",
        text.truncate("text", 200).alias("start"),
        text.preview("text", 100).alias("preview_100"),
        text.preview("source", 4).alias("preview_4"),
    )


@query
def standardize_titles(spark, d):
    return stages.spread(view(spark, d, "titles")).withColumn("title", titles.standardize("title"))


@query
def standardize_titles_thrice(spark, d):
    return stages.spread(view(spark, d, "titles")).withColumn("title", titles.standardize("title", passes=3))


@query
def comparison_key(spark, d):
    return stages.spread(view(spark, d, "titles")).select("person_id", "title", titles.comparison_key("title").alias("title_key"))


# ---- corpus


@query
def title_forms(spark, d):
    """Displayed title and comparison key of every experience row, by a dictionary of the different titles."""
    return title_rules.with_title_forms(view(spark, d, "experience")).drop("title")


def _profiles(spark, d) -> dict[str, DataFrame]:
    return {n: view(spark, d, n) for n in ("people", "abilities", "education", "experience", "person_skills")}


@query
def filter_ids(spark, d):
    return corpus.filter_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", max_id=54928)


@query
def concat_by_key(spark, d):
    return corpus.concat_by_key(view(spark, d, "experience")).join(
        corpus.concat_by_key(view(spark, d, "person_skills")), "person_id"
    )


@query
def join_profiles(spark, d):
    prepared = corpus_build.prepare(_profiles(spark, d))
    people = prepared.pop("people")
    return corpus.join_profiles(people, {n: corpus.concat_by_key(t) for n, t in prepared.items()})


@query
def content_dedup(spark, d):
    docs = _documents(spark, d).withColumn("ord", F.col("doc_id"))
    return corpus.drop_content_duplicates(docs, "doc_id", "ord").drop("ord")


@query
def dedup_statistics(spark, d):
    docs = _documents(spark, d).withColumn("ord", F.col("doc_id"))
    return corpus.dedup_statistics(corpus.drop_content_duplicates(docs, "doc_id", "ord"))


@query
def corpus_build_full(spark, d):
    return corpus_build.build(_profiles(spark, d))


QUERIES["corpus_build"] = QUERIES.pop("corpus_build_full")


@query
def corpus_from_files(spark, d):
    """The corpus of five profile files, which are checked, read and built; rows are in file order."""
    folder = fresh(spark, "profiles")
    for name, rows in _profiles(spark, d).items():
        ordered = rows.orderBy("ord", *[c for c in rows.columns if c != "ord"]).drop("ord")
        sinks.write_table(ordered, f"{folder}/{profiles.PROFILE_FILES[name]}", "csv")
    return corpus_build.build(profiles.read_profiles(spark, folder)).drop("ord")


@query
def corpus_build_thin(spark, d):
    tables = _profiles(spark, d)
    return corpus_build.build({n: tables[n] for n in ("people", "abilities")})


@query
def distinct_titles(spark, d):
    return corpus.distinct_titles(view(spark, d, "experience"))


# ---- TF-IDF, embedding, similarity


@query
def term_counts(spark, d):
    return tfidf.term_counts(_documents(spark, d), "text")


@query
def tfidf_vocabulary(spark, d):
    model = tfidf.fit(_documents(spark, d), "text")
    return model.vocabulary.withColumn("idf", F.round("idf", 6))


@query
def tfidf_vocabulary_uncapped(spark, d):
    vocabulary = tfidf.fit(_documents(spark, d), "text", max_features=None).vocabulary
    return vocabulary.select("term", "tf", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_vocabulary_grown(spark, d):
    """The vocabulary of a corpus that has grown by new files, from stored counts of the files before."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("embedding_text"))
    path, store = fresh(spark, "corpus"), fresh(spark, "model")
    for part in range(2):
        docs.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(path)
        model = matching.stored_model(spark.read.parquet(path), store, grows=True)
    return model.vocabulary.withColumn("idf", F.round("idf", 6))


@query
def tfidf_weights(spark, d):
    docs = _documents(spark, d)
    weights = tfidf.doc_terms(docs, tfidf.fit(docs, "text"), "doc_id", "text")
    return weights.withColumn("weight", F.round("weight", 6))


@query
def top_terms(spark, d):
    docs = _documents(spark, d)
    return tfidf.top_terms(docs, tfidf.fit(docs, "text"), "doc_id", "text").withColumn(
        "weight", F.round("weight", 6)
    )


@query
def weighted_text(spark, d):
    docs = _documents(spark, d)
    return tfidf.weight_text(docs, tfidf.fit(docs, "text"), "text").select("doc_id", "weighted_text")


@query
def embed_documents(spark, d):
    vectors_of = embedding.embed(_documents(spark, d), "text", dim=256)
    # Outer: otherwise a filter on the size of the vectors would be pushed below the scan's redistribution.
    entries = vectors_of.select("doc_id", F.posexplode_outer("embedding").alias("place", "value")).filter("value <> 0")
    return entries.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def embed_documents_once(spark, d):
    """As ``embed_documents``, the texts of a first part being known when all are embedded."""
    store = EncodingStore(fresh(spark, "encodings"), "hashing", dim=256)
    docs = _documents(spark, d)
    store.embed(docs.filter("doc_id % 3 = 0"), "text", "embedding")
    vectors_of = store.embed(docs, "text", "embedding")
    entries = vectors_of.select("doc_id", F.posexplode_outer("embedding").alias("place", "value")).filter("value <> 0")
    return entries.withColumn("value", F.round(F.col("value").cast("double"), 6))


def _vectors(spark, d, id) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(id), "embedding")


@query
def vector_cosine(spark, d):
    left = _vectors(spark, d, "vec_id").withColumn("other", F.col("vec_id") + 1)
    right = _vectors(spark, d, "other").withColumnRenamed("embedding", "next")
    return left.join(right, "other").select(
        "vec_id", "other", F.round(vectors.cosine("embedding", "next"), 6).alias("similarity")
    )


@query
def dense_top_k(spark, d):
    found = similarity.top_k(_vectors(spark, d, "query_id"), _vectors(spark, d, "person_id"), 15)
    return found.withColumn("score", F.round("score", 6))


@query
def sparse_top_k(spark, d):
    docs = _documents(spark, d)
    rows = tfidf.vectorize(docs, tfidf.fit(docs, "text"), "text", "v").select(
        F.col("doc_id").alias("query_id"),
        F.col("doc_id").alias("person_id"),
        F.col("v.idx").alias("keys"),
        F.col("v.weight").alias("values"),
    )
    rows = stages.settle(rows, "vectors")  # both sides of the search read them
    found = similarity.top_k(rows, rows, 5, vector=("keys", "values"), positive=True)
    return found.withColumn("score", F.round("score", 6))


@query
def dense_top_k_slabs(spark, d):
    """As ``dense_top_k`` with neither side small enough to be held whole: four slabs of queries or more."""
    vectors_of = _vectors(spark, d, "query_id")
    slab = vectors_of.count() * 64 * 8 // 4
    found = similarity.top_k(vectors_of, _vectors(spark, d, "person_id"), 15, held_bytes=0, tile_bytes=slab)
    return found.withColumn("score", F.round("score", 6))


@query
def dense_top_k_by_label(spark, d):
    """The five best labels of every vector, each with its nearest vector."""
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("person_id"), "embedding", "label")
    found = similarity.top_k(_vectors(spark, d, "query_id"), corpus, 5, group="label", distinct=True)
    return found.withColumn("score", F.round("score", 6))


# ---- matching


def _dense_matches(spark, d) -> DataFrame:
    found = similarity.top_k(_vectors(spark, d, "query_id"), _vectors(spark, d, "person_id"), 15)
    titled = view(spark, d, "titles").withColumn("embedding_text", F.col("title"))
    return matching.best_matches(found, matching.with_title_keys(titled), 5)


@query
def collapse_titles(spark, d):
    found = similarity.top_k(_vectors(spark, d, "query_id"), _vectors(spark, d, "person_id"), 15)
    rows = found.join(view(spark, d, "titles").drop("ord"), "person_id").withColumn(
        "similarity_percentage", vectors.to_percent("score")
    )
    return collapse.collapse_titles(rows, passes=2).filter("rank <= 5").select("query_id", "person_id", "rank", "title", "similarity_percentage")


@query
def query_summary(spark, d):
    return collapse.query_summary(_dense_matches(spark, d)).withColumn("avg_similarity", F.round("avg_similarity", 6))


@query
def folder_summary(spark, d):
    return collapse.folder_summary(_dense_matches(spark, d))


@query
def overall_summary(spark, d):
    return collapse.overall_summary(_dense_matches(spark, d))


def _index(spark, d, **options) -> matching.MatchIndex:
    return matching.build_index(view(spark, d, "corpus_documents"), **options)


@query
def match_documents(spark, d):
    return matching.match(view(spark, d, "query_documents"), _index(spark, d, sparse=True))


@query
def match_documents_stored(spark, d):
    """Matches of an index that is built, stored and loaded again."""
    corpus = stages.settle(view(spark, d, "corpus_documents"), "corpus")
    path = fresh(spark, "index")
    for _ in range(2):
        index = matching.build_index(corpus, sparse=True, path=path, grows=True)
    return matching.match(view(spark, d, "query_documents"), index)


@query
def match_documents_exact(spark, d):
    return matching.match(view(spark, d, "query_documents"), _index(spark, d, sparse=True), exact=True)


@query
def match_documents_uncapped(spark, d):
    return matching.match(view(spark, d, "query_documents"), _index(spark, d, sparse=True, max_features=None))


def _turn_files(spark, d) -> DataFrame:
    return view(spark, d, "query_documents").select(
        F.concat(F.lit("turn-"), F.col("query_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )


@query
def match_files(spark, d):
    _, matches = matching.match_files(_turn_files(spark, d), _index(spark, d, sparse=True))
    return matches.drop("embedding_text")


@query
def match_embedded(spark, d):
    return matching.match(view(spark, d, "query_documents"), _index(spark, d, dim=256)).drop("embedding_text")


def _conversation_files(spark, d) -> str:
    """One text file per conversation."""
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    return sinks.write_text(whole, fresh(spark, "conversations"), name="conv_id")


@query
def match_folder(spark, d):
    folder = _conversation_files(spark, d)
    result = matching.match_folder(
        f"{folder}/*", _index(spark, d, sparse=True), types=["txt"], output=fresh(spark, "folder")
    )
    return result.overall


@query
def match_arriving_files(spark, d):
    folder, output = _conversation_files(spark, d), fresh(spark, "stream")
    running = match_stream.match_stream(
        f"{folder}/*", _index(spark, d, sparse=True), output, fresh(spark, "progress"), types=["txt"]
    )
    running.awaitTermination()
    conversation = F.regexp_extract("query_id", r"conv_id=(\d+)", 1).cast("long")
    matches = match_stream.stream_matches(spark, output).withColumn("conv_id", conversation)
    return matches.select("conv_id", "rank", "person_id", "title", "similarity_percentage")


# ---- evaluation


def _judgments(spark, d) -> DataFrame:
    return ranking.load_judgments(view(spark, d, "judgment_rows"))


def _judged(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    results, judgments = view(spark, d, "results"), _judgments(spark, d)
    return results, judgments, ranking.judge(results, judgments)


@query
def load_judgments(spark, d):
    return _judgments(spark, d)


@query
def register_results(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("resume_id"),
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.col("o_orderdate").alias("batch"),
    )
    return ranking.register_results(rows)


@query
def judged_results(spark, d):
    return ranking.judge(view(spark, d, "results"), _judgments(spark, d))


def _scores(spark, d, metrics=ranking.METRICS) -> DataFrame:
    _, judgments, judged = _judged(spark, d)
    return ranking.scores(judged, judgments, metrics=metrics)


@query
def evaluation_scores(spark, d):
    return _scores(spark, d).withColumn("score", F.round("score", 6))


def _metric_query(metric: str) -> Query:
    return lambda spark, d: _scores(spark, d, (metric,)).withColumn("score", F.round("score", 6))


QUERIES.update({name: _metric_query(metric) for metric, name in METRIC_QUERIES.items()})


@query
def evaluation_averages(spark, d):
    return ranking.averages(_scores(spark, d)).drop("position").withColumn("average", F.round("average", 6))


@query
def evaluation_report(spark, d):
    results, judgments, judged = _judged(spark, d)
    averaged = ranking.averages(ranking.scores(judged, judgments))
    return ranking.report(results, judgments, averaged).drop("position")


@query
def threshold_grid(spark, d):
    _, judgments, judged = _judged(spark, d)
    grid = ranking.threshold_grid(judged, judgments)
    return grid.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def best_threshold(spark, d):
    _, judgments, judged = _judged(spark, d)
    best = ranking.best_threshold(ranking.threshold_grid(judged, judgments))
    return best.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def sample_judgments(spark, d):
    resumes = view(spark, d, "people").select(F.col("person_id").alias("resume_id"))
    return ranking.sample_judgments(view(spark, d, "titles"), resumes)


@query
def link_titles(spark, d):
    wanted = view(spark, d, "titles").select("title").unionByName(
        table(spark, d, "events").select(F.col("event_type").alias("title"))
    )
    jobs = table(spark, d, "part").select(
        F.col("p_partkey").alias("job_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("job_title"),
        F.col("p_partkey").alias("ord"),
    )
    return linking.link_by_token_overlap(wanted, jobs)


@query
def number_rows(spark, d):
    parts = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keyed = table(spark, d, "lineitem").select(F.concat_ws("|", *parts).alias("k"))
    return numbering.number_rows(keyed, "k").select("k", "row_index")


@query
def evaluate_matcher(spark, d):
    index = _index(spark, d, sparse=True)
    resumes = view(spark, d, "people").select(F.col("person_id").alias("resume_id"))
    return evaluation.evaluate_matcher(index, resumes=resumes).report.drop("position")


@query
def evaluation_outputs(spark, d):
    """The report of an evaluation, read back from what the evaluation writes."""
    index, output = _index(spark, d, sparse=True), fresh(spark, "evaluation")
    resumes = view(spark, d, "people").select(F.col("person_id").alias("resume_id"))
    done = evaluation.evaluate_matcher(index, resumes=resumes, output=output)
    return spark.read.schema(done.report.schema).json(f"{output}/report").drop("position")
