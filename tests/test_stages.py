from helpers import rows
from pyspark.sql import functions as F

from dossier.operators.similarity import top_k
from dossier.plans import matching
from dossier.sources import sinks, stages


def test_shared_folder_is_the_clusters(spark):
    assert stages.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_settle_computes_once(spark):
    df = spark.range(100).withColumn("r", F.rand())
    settled = stages.settle(df)
    assert rows(settled) == rows(settled)
    assert "RDD" not in settled._jdf.queryExecution().optimizedPlan().toString()


def test_changed_input_changes_the_stage(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (3, 5):
        sinks.write_table(spark.range(n).toDF("id"), path)
        assert stages.materialize(spark.read.parquet(path), out, {"a": 1}).count() == n
    assert len(list((tmp_path / "out").iterdir())) == 2


def test_unfinished_stage_is_computed_again(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    source = spark.read.parquet(sinks.write_table(spark.range(3).toDF("id"), path))
    key = stages.fingerprint(source, {})
    sinks.write_table(spark.range(1).toDF("id"), f"{out}/{key}/data")  # no meta row
    assert stages.materialize(source, out, {}).count() == 3
    assert stages.read_meta(spark, out, key)["rows"] == 3


def test_nested_columns_in_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\nthere', [1, 2])], "id int, t string, a array<int>")
    path = sinks.write_table(df, str(tmp_path / "t"), "csv")
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    assert rows(read) == [("1", 'say "hi",\nthere', "[1,2]")]


def test_candidates_are_limited_before_the_exchange(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "id long, embedding array<float>")
    found = top_k(vectors, vectors.withColumnRenamed("id", "person_id"), 3, query_id="id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_match_plan_reads_no_vectors_for_titles(spark):
    corpus = spark.createDataFrame([(1, "Dev", "java"), (2, "Cook", "soup")], "person_id int, title string, embedding_text string")
    index = matching.build_index(corpus, sparse=True, min_df=1, max_df=1.0)
    queries = spark.createDataFrame([(7, "java")], "query_id int, text string")
    got = matching.match(queries, index, 1)
    assert rows(got, "query_id", "person_id", "title") == [(7, 1, "Dev")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    titles = [line for line in plan.splitlines() if "FileScan" in line and "title_key" in line]
    assert titles and all("vector_keys" not in line for line in titles)
