import io
from hashlib import md5
import zipfile

import pytest
from helpers import rows
from pyspark.sql import functions as F

from dossier.operators import collapse
from dossier.plans import evaluation, matching
from dossier.sources import documents, sinks, stages
from dossier.streaming.match_stream import match_stream, stream_matches


def docx(text, header=None):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {ns}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


PEOPLE = [
    (1, "Data Engineer", "python spark pipelines warehouse"),
    (2, "Dev", "java services backend spring"),
    (3, "Developer", "java services backend testing"),
    (4, "UI Designer", "figma layout colour typography"),
    (5, "Sales Rep", "calls customers contracts targets"),
    (6, "Data Engineer", "python airflow pipelines lake"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(PEOPLE, "person_id int, title string, embedding_text string")


@pytest.fixture(scope="module", params=["sparse", "hashed"])
def index(request, corpus):
    return matching.build_index(corpus, dim=512, sparse=request.param == "sparse", min_df=1)


def test_match_finds_the_row_itself(spark, corpus, index):
    queries = corpus.selectExpr("person_id AS query_id", "embedding_text AS text")
    best = matching.match(queries, index).filter("rank = 1").collect()
    assert {r["query_id"]: r["person_id"] for r in best} == {p: p for p, *_ in PEOPLE}
    assert all(r["similarity_percentage"] >= 99.99 for r in best)


def test_near_equal_titles_collapse(spark, index):
    query = spark.createDataFrame([("q", "java services backend")], "query_id string, text string")
    got = matching.match(query, index, 3).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3]
    keys = {"Dev": "developer", "Developer": "developer"}
    titles = [keys.get(r["title"], r["title"]) for r in got]
    assert titles[0] == "developer" and len(set(titles)) == 3


def test_collapse_and_summaries(spark):
    schema = "query_id string, rank int, title string, similarity_percentage double, embedding_text string"
    matches = spark.createDataFrame(
        [("a", 1, "Dev", 90.0, "x" * 300), ("a", 2, "Developer", 88.0, "y"), ("a", 3, "UI Designer", 80.0, "z")], schema
    )
    kept = collapse.collapse_titles(matches)
    assert rows(kept, "rank", "title", "similarity_percentage") == [(1, "Dev", 90.0), (2, "UI Designer", 80.0)]
    assert rows(collapse.query_summary(kept)) == [("a", 85.0, 2)]
    assert rows(collapse.folder_summary(kept))[0] == ("a", "Dev", 90.0, "x" * 200)
    assert rows(collapse.collapse_titles(matches.drop("title"))) == rows(matches.drop("title"))


def test_overall_summary(spark):
    matches = spark.createDataFrame(
        [("A", 90.0), ("A", 80.0), ("B", 60.0), ("B", 70.0)], "query_id string, similarity_percentage double"
    )
    processed = spark.createDataFrame([("A", None), ("B", None), ("C", "bad")], "query_id string, error string")
    assert rows(collapse.overall_summary(matches, processed)) == [(2, 75.0, 85.0, 65.0, 90.0, 60.0, 10.0)]
    none = collapse.overall_summary(matches.limit(0), processed.filter("query_id = 'C'"))
    assert rows(none) == [(0, 0.0, 0.0, 100.0, 0.0, 100.0, 0.0)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("cvs")
    (path / "a.docx").write_bytes(docx("python spark\npipelines 'lake'!"))
    (path / "B.DOCX").write_bytes(docx("calls customers", header="contracts"))
    (path / "bad.docx").write_bytes(b"no zip")
    (path / "c.pdf").write_bytes(b"%PDF java services")
    (path / "old.doc").write_bytes(b"legacy")
    (path / "notes.txt").write_text("ignored by a folder scan")
    (path / "sub").mkdir()
    (path / "sub" / "d.docx").write_bytes(docx("not scanned"))
    return str(path)


def extractors():
    # Local functions travel with the job; those of a test module could not be imported by workers.
    def broken(content):
        raise RuntimeError("no parser")

    return {".pdf": [lambda c: ["", " "], lambda c: c.decode()[5:].split(" ")], ".doc": [broken]}


EXTRACTORS = extractors()


def test_extraction(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in documents.extract_text(documents.scan_documents(spark, folder), EXTRACTORS).collect()}
    assert got["a.docx"] == ("python spark pipelines lake", None)
    assert got["B.DOCX"] == ("contracts calls customers", None)
    assert got["c.pdf"] == ("java services", None)
    assert got["bad.docx"][0] is None and "BadZipFile" in got["bad.docx"][1]
    assert got["old.doc"] == (None, "RuntimeError: no parser")
    assert len(got) == 5


def test_other_types(spark):
    files = spark.createDataFrame(
        [("x.html", b"<style>p{}</style><p>Hi<b>!</b></p><script>no()</script>"), ("y.txt", "café\n2".encode()), ("z.xls", b"")],
        "path string, content binary",
    )
    got = rows(documents.audit(documents.extract_text(files)), "path", "text", "error", "text_hash", "n_chars")
    assert got[0][:3] == ("x.html", "Hi", None)
    assert got[1] == ("y.txt", "café 2", None, md5("café 2".encode()).hexdigest()[:8], 6)
    assert got[2][:3] == ("z.xls", None, "unsupported file format: .xls")


def test_folder(spark, folder, index, tmp_path):
    result = matching.match_folder(folder, index, 2, EXTRACTORS, output=str(tmp_path / "out"))
    assert {r["title"] for r in result.matches.filter("rank = 1").collect()} >= {"Data Engineer", "Sales Rep"}
    overall = result.overall.first()
    assert overall["total_cvs"] == 3
    assert result.extracted.filter("error IS NOT NULL").count() == 2
    saved = spark.read.json(str(tmp_path / "out" / "overall_summary")).first()
    assert saved["average_similarity"] == overall["average_similarity"]
    summary = spark.read.option("header", True).csv(str(tmp_path / "out" / "summary"))
    assert summary.columns == ["cv_file", "match_title", "similarity", "match_details"]
    assert {r["cv_file"] for r in summary.collect()} == {"a.docx", "B.DOCX", "c.pdf"}


def test_stream_equals_batch(spark, folder, index, tmp_path):
    files = documents.scan_documents(spark, folder)
    _, batch = matching.match_files(files, index, 2, EXTRACTORS)
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        match_stream(folder, index, out, str(tmp_path / "progress"), 2, EXTRACTORS, files_per_batch=2).awaitTermination()
    streamed = stream_matches(spark, out)
    assert streamed.select("batch").distinct().count() > 1
    assert rows(streamed.drop("batch")) == rows(batch)


def test_evaluate_matcher(spark, index):
    resumes = spark.range(6).select(F.concat(F.lit("resume_"), "id").alias("resume_id"))
    done = evaluation.evaluate_matcher(index, resumes=resumes)
    averages = {(r["metric"], r["k"]): r["average"] for r in done.averages.collect()}
    assert len(averages) == 14 and all(0 <= averages[("ndcg", k)] for k in (3, 5, 10))
    again = evaluation.evaluate_matcher(index, resumes=resumes)
    assert again.threshold == done.threshold and rows(again.averages) == rows(done.averages)
    untitled = done.judgments.withColumn("ord", F.lit(0))
    fallback = evaluation.evaluate_matcher(index, untitled, threshold=1.0)
    assert all(r["job_id"].startswith(("job_", "title_")) for r in fallback.results.collect())


def test_index_is_reused(spark, corpus, tmp_path):
    source = spark.read.parquet(sinks.write_table(corpus, str(tmp_path / "corpus")))
    path = str(tmp_path / "index")
    first = matching.build_index(source, dim=32, path=path, config={"encoder": "hash"}, min_df=1)
    key = stages.fingerprint(source, {"dim": 32, "sparse": False, "fix_quirks": False, "fit": {"min_df": 1}, "encoder": "hash"})
    meta = stages.read_meta(spark, path, key)
    assert meta["rows"] == 6 and "embedding" in meta["columns"]
    again = matching.build_index(source, dim=32, path=path, config={"encoder": "hash"}, min_df=1)
    assert stages.read_meta(spark, path, key)["created_at"] == meta["created_at"]
    assert rows(first.corpus) == rows(again.corpus)
    matching.build_index(source, dim=16, path=path, config={"encoder": "hash"}, min_df=1)
    assert len(list((tmp_path / "index").iterdir())) == 2


def test_match_equals_brute_force(spark, corpus, index):
    import numpy as np

    texts = [("a", "java spring pipelines"), ("b", "customers figma calls"), ("c", "nothing shared")]
    queries = spark.createDataFrame(texts, "query_id string, text string")

    def dense(df, id):
        out = {}
        for r in df.collect():
            v = np.zeros(2048)
            if index.sparse:
                v[r["vector_keys"]] = r["vector_values"]
            else:
                v[: len(r["embedding"])] = r["embedding"]
            out[r[id]] = v / (np.linalg.norm(v) or 1.0)
        return out

    q, c = dense(index.with_vectors(queries, "text", "query_id"), "query_id"), dense(index.corpus, "person_id")
    titles, found = {p: t for p, t, _ in PEOPLE}, []
    for i, v in q.items():
        scored = sorted(((round(float(v @ w), 9), p) for p, w in c.items()), key=lambda x: (-x[0], x[1]))[:6]
        found += [(i, r + 1, p, titles[p], round(s * 100, 2)) for r, (s, p) in enumerate(scored)]
    schema = "query_id string, rank int, person_id int, title string, similarity_percentage double"
    want = collapse.collapse_titles(spark.createDataFrame(found, schema), passes=2).filter("rank <= 2")
    columns = ("query_id", "rank", "person_id", "title", "similarity_percentage")
    assert rows(matching.match(queries, index, 2), *columns) == rows(want, *columns)


def test_error_of_the_last_extractor_counts(spark):
    def blank(content):
        return "  "

    def broken(content):
        raise RuntimeError("no parser")

    files = spark.createDataFrame([("a.pdf", b"x"), ("b.doc", b"x"), ("c.txt", b"x")], "path string, content binary")
    got = documents.extract_text(files, {".pdf": [blank, broken], ".doc": [broken, blank], ".txt": [blank]}).collect()
    assert {r["path"]: (r["text"], r["error"]) for r in got} == {
        "a.pdf": (None, "RuntimeError: no parser"),
        "b.doc": ("", None),
        "c.txt": ("", None),
    }


def test_blank_texts_are_not_matched(spark, index):
    files = spark.createDataFrame([("a.txt", b" \n "), ("b.txt", b"java spring")], "path string, content binary")
    extracted, matches = matching.match_files(files, index, 2)
    assert extracted.count() == 2 and {r["query_id"] for r in matches.collect()} == {"b.txt"}


@pytest.mark.parametrize("form", [{"max_features": None}, {"broadcast_terms": 1}])
def test_sparse_matching_with_a_joined_vocabulary(spark, corpus, form):
    texts = [("a", "java spring pipelines"), ("b", "customers figma calls"), ("c", "nothing shared"), ("d", None)]
    queries = spark.createDataFrame(texts, "query_id string, text string")
    small = matching.build_index(corpus, sparse=True, min_df=1)
    large = matching.build_index(corpus, sparse=True, min_df=1, **form)
    assert small.model.is_small and not large.model.is_small
    assert rows(matching.match(queries, large)) == rows(matching.match(queries, small))


def test_jobs_at_equal_positions_link_once(spark):
    from dossier.operators.linking import link_by_token_overlap

    jobs = spark.createDataFrame([("j1", "Data Engineer", 0), ("j2", "Sales Rep", 0)], "job_id string, job_title string, ord long")
    titles = spark.createDataFrame([("Data Engineer",), ("sales",), ("pilot",), (None,)], "title string")
    got = {r["title"]: (r["job_id"], r["overlap"]) for r in link_by_token_overlap(titles, jobs).collect()}
    assert got["data engineer"] == ("j1", 2) and got["sales"] == ("j2", 1)
    assert got["pilot"] == ("title_" + md5(b"pilot").hexdigest(), 0)
    assert len(got) == link_by_token_overlap(titles, jobs).count() == 4


def test_extraction_hands_texts_on_before_many_are_held():
    import pyarrow as pa

    from dossier.workload import queries

    size = documents.HELD_CHARACTERS // 2
    files = pa.RecordBatch.from_pylist([{"path": f"{i}.txt", "content": b"x" * size} for i in range(5)] + [{"path": "a.xyz", "content": b""}])
    found = list(documents._extracted(iter([files]), documents.BUILT_IN))
    assert [b.num_rows for b in found] == [2, 2, 2]
    assert found[2].column("error").to_pylist() == [None, "unsupported file format: .xyz"]
    texts = pa.RecordBatch.from_pylist([{"path": f"{i}.docx", "text": f"a & {i}"} for i in range(600)])
    packages = list(queries._packages(iter([texts])))
    assert [b.num_rows for b in packages] == [256, 256, 88]
    assert documents.docx_text(packages[2].column("content")[87].as_py()).strip() == "a & 599"
