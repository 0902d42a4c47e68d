import pytest
from helpers import rows
from pyspark.sql import functions as F

from dossier.operators import corpus as C
from dossier.plans import corpus_build
from dossier.sources import checks, profiles, sinks

FILES = {
    "01_people.csv": "person_id,name,email\n1,Ann,a@x\n2,Bob,b@x\n3,Cy,c@x\n4,Di,d@x\n99999,Zed,z@x\n",
    "02_abilities.csv": 'person_id,ability\n1,"Data ""Mining""!"\n1,SQL\n1,SQL\n2,Sales\n3,Sales\n',
    "03_education.csv": "person_id,institution,degree\n1,MIT,BSc\n",
    "04_experience.csv": 'person_id,title\n1,"Senior Data Scientist; ML Engineer"\n1,Leader\n2,Sales Rep\n3,Sales Rep\n',
    "05_person_skills.csv": "person_id,skill\n1,Python\n1,NA\n2,Excel\n3,Excel\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("profiles")
    for name, content in FILES.items():
        (path / name).write_text(content)
    return str(path)


@pytest.mark.parametrize("partitions", [1, 8])
def test_mini_corpus(spark, folder, partitions):
    tables = {n: t.repartition(partitions) for n, t in profiles.read_profiles(spark, folder).items()}
    corpus = corpus_build.build(tables, max_id=54928)
    columns = ("person_id", "ability", "degree", "title", "skill", "embedding_text")
    assert rows(corpus, *columns) == [
        (1, "Data Mining; SQL", "BSc", "Data Scientist", "Python",
         "Data Mining; SQL | Data ScientistData ScientistData Scientist | Python"),
        (2, "Sales", None, "Sales Rep", "Excel", "Sales | Sales RepSales RepSales Rep | Excel"),
        (4, "Unknown ability", None, "Unknown Title", "Unknown skill",
         "Unknown ability | Unknown TitleUnknown TitleUnknown Title | Unknown skill"),
    ]
    assert rows(corpus_build.statistics(corpus)) == [(4, 1, 25.0)]


def test_missing_tables_are_listed(spark, tmp_path):
    (tmp_path / "01_people.csv").write_text(FILES["01_people.csv"])
    with pytest.raises(checks.MissingInput, match="02_abilities.csv, 03_education.csv, 04"):
        profiles.read_profiles(spark, str(tmp_path))


def test_corpus_columns_are_checked(spark, tmp_path):
    df = spark.createDataFrame([("7", "t")], "person_id string, other string")
    path = sinks.write_table(df, str(tmp_path / "c"), "csv")
    with pytest.raises(checks.MissingInput, match="embedding_text"):
        profiles.read_corpus(spark, path, "csv")
    path = sinks.write_table(df.withColumnRenamed("other", "embedding_text"), str(tmp_path / "d"), "csv")
    assert profiles.read_corpus(spark, path, "csv").dtypes == [("person_id", "bigint"), ("embedding_text", "string")]


def test_csv_order_follows_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("person_id,v\n" + "".join(f"{i % 3},v{i % 50}\n" for i in range(5000)))
    one = C.concat_by_key(profiles.read_csv(spark, str(tmp_path / "a.csv")).repartition(7))
    first_seen = {k: "; ".join(dict.fromkeys(f"v{i % 50}" for i in range(5000) if i % 3 == k)) for k in range(3)}
    assert dict(rows(one)) == first_seen


def test_concat_edge_cases(spark):
    df = spark.createDataFrame(
        [(1, 0, "b"), (1, 1, " "), (1, 2, None), (1, 3, "a"), (1, 4, "b"), (2, 5, "")], "person_id int, ord int, v string"
    )
    assert rows(C.concat_by_key(df)) == [(1, "b; a"), (2, "")]
    assert rows(C.concat_by_key(df, keep_blanks=True)) == [(1, "b;  ; a"), (2, "")]
    assert rows(C.concat_by_key(df.select("ord", "v"))) == rows(df.select("ord", "v"))
    assert rows(C.concat_by_key(df.select("person_id", "ord"))) == [(1,), (2,)]
    empty = C.concat_by_key(df.limit(0))
    assert empty.columns == ["person_id", "v"] and rows(empty) == []


def test_concat_with_a_hot_key(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("person_id"),
        F.col("id").alias("ord"),
        (F.col("id") % 40).cast("string").alias("v"),
    )
    hot = C.concat_by_key(df).filter("person_id = 0").first()["v"].split("; ")
    assert hot == list(dict.fromkeys(str(i % 40) for i in range(0, 30_000, 3)))


def test_dedup_keeps_first_and_nulls_match(spark):
    df = spark.createDataFrame(
        [(5, 1, "x", None), (4, 2, "x", None), (3, 3, "x", "y"), (2, 0, None, None), (1, 9, None, None)],
        "person_id int, ord int, a string, b string",
    )
    kept = C.drop_content_duplicates(df.repartition(4))
    assert rows(kept) == [(2, 0, None, None, 2), (3, 3, "x", "y", 1), (5, 1, "x", None, 2)]
    assert rows(C.drop_content_duplicates(kept.drop("n_copies")).drop("n_copies")) == rows(kept.drop("n_copies"))
    assert rows(C.dedup_statistics(C.drop_content_duplicates(df.limit(0)))) == [(0, 0, 0.0)]


def test_join_profiles_renames_clashes(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "person_id int, v string")
    other = spark.createDataFrame([(1, "c")], "person_id int, v string")
    joined = C.join_profiles(people, {"extra": other})
    assert joined.columns == ["person_id", "v", "extra_v"]
    assert rows(joined) == [(1, "a", "c"), (2, "b", None)]


def test_filter_ids(spark):
    df = spark.createDataFrame([("54928",), ("54929",), ("x",)], "person_id string")
    assert rows(C.filter_ids(df, max_id=54928)) == [("54928",)]
    assert C.filter_ids(df).count() == 3
    large = spark.createDataFrame([("3000000000",), ("60000",)], "person_id string")
    assert C.filter_ids(large, max_id=4_000_000_000).count() == 2
    assert rows(C.filter_ids(df.withColumnRenamed("person_id", "k"))) == rows(df)


def test_filter_reaches_the_scan(spark):
    scan = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey")
    plan = C.filter_ids(scan, "o_orderkey", 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_orderkey,10)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_csv_order_over_splits_and_files(spark, tmp_path):
    values = [f"v{i % 700:03d}" for i in range(20_000)]
    for i, part in enumerate((values[:9000], values[9000:])):
        (tmp_path / f"part-{i}.csv").write_text("person_id,v\n" + "".join(f"1,{v}\n" for v in part))
    whole = tmp_path / "whole.csv"
    whole.write_text("person_id,v\n" + "".join(f"1,{v}\n" for v in values))
    want = "; ".join(dict.fromkeys(values))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for path, kind in ((whole, "bigint"), (tmp_path / "part-*.csv", "struct")):
            read = profiles.read_csv(spark, str(path))
            assert read.rdd.getNumPartitions() > 3 and dict(read.dtypes)["ord"].startswith(kind)
            got = C.concat_by_key(read)
            assert rows(got) == [(1, want)]
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("SortAggregate" in plan) == (kind == "struct")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_from_one_and_several_files_join(spark, folder, tmp_path):
    tables = profiles.read_profiles(spark, folder)
    parts = tables["abilities"].repartition(3).sortWithinPartitions("ord").drop("ord")
    read = profiles.read_csv(spark, sinks.write_table(parts, str(tmp_path / "abilities"), "csv"))
    mixed = corpus_build.build({**tables, "abilities": read})
    assert {r["person_id"] for r in mixed.collect()} == {1, 2, 4}
