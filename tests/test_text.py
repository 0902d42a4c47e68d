import pytest
from helpers import rows

from dossier.functions import terms, text, titles, vectors

TITLES = {
    None: "Unknown Title",
    "": "Unknown Title",
    "Lead": "",
    "Senior Front-End Developer (Remote)": "Frontend Developer",
    "Sr. DevOps Engineer": "DevOps Engineer",
    "MySQL & MongoDB Administrator": "__preserved_1__ / MongoDB Administrator",
    "Java-DevOps Engineer": "Java__preserved_0__ Engineer",
    "Leader": "Er",
    "Internal Auditor": "Al Auditor",
    "SRE Manager": "Manager",
    "UI/UX Designer": "UI / UX Designer",
    "R&D Engineer": "R / D Engineer",
    "Sales and Marketing Manager": "Sales / Marketing Manager",
    "Data Scientist; ML Engineer": "Data Scientist",
    "Contract Java Developer 2": "Java Developer",
    "Software Engineer, Platform": "Software Engineer",
    "Engineer - Java": "Engineer Java",
    "Team Lead Engineer": "Team Engineer",
    "dotnet developer": ".NET Developer",
    ".NET Developer": ".net Developer",
    "myFrontEnd Dev": "My Frontend Dev",
    "Staffing Manager": "Ing Manager",
    "Sri Lanka Guide": "Lanka Guide",
    "CI/CD Engineer": "CI / CD Engineer",
    "Café Manager  and\tHost": "Café Manager / Host",
}

FIXED = {
    "MySQL & MongoDB Administrator": "MySQL / MongoDB Administrator",
    "Java-DevOps Engineer": "Java DevOps Engineer",
    "Leader": "Leader",
    "Internal Auditor": "Internal Auditor",
    "SRE Manager": "SRE Manager",
    "Senior Front-End Developer (Remote)": "Frontend Developer",
    "CI/CD Engineer": "CI/CD Engineer",
    "restapi dotnet Lead": "RESTful API .NET",
}


def _titles(spark, values):
    return spark.createDataFrame([(v, v) for v in values], "raw string, title string")


def test_standardize(spark):
    got = {r[0]: r[1] for r in rows(_titles(spark, TITLES).select("raw", titles.standardize("title")))}
    assert got == TITLES


def test_standardize_fixed_is_idempotent(spark):
    df = _titles(spark, FIXED)
    for passes in (1, 3):
        got = {r[0]: r[1] for r in rows(df.select("raw", titles.standardize("title", passes, fix_quirks=True)))}
        assert got == FIXED


@pytest.mark.parametrize("passes", [2, 3])
def test_passes_equal_repeated_calls(spark, passes):
    df = _titles(spark, TITLES)
    repeated = df
    for _ in range(passes):
        repeated = repeated.withColumn("title", titles.standardize("title"))
    assert rows(df.withColumn("title", titles.standardize("title", passes))) == rows(repeated)


def test_comparison_key(spark):
    df = _titles(spark, ["UI / UX Designer", "Full Time Dev", "Head of the Dev", "", None])
    got = {r[0]: r[1] for r in rows(df.select("raw", titles.comparison_key("title")))}
    assert got == {
        "UI / UX Designer": "user interface user experience designer",
        "Full Time Dev": "fullstack time developer",
        "Head of the Dev": "head of developer",
        "": "",
        None: "",
    }


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "  It's  \"great\"!  "), (2, None), (3, "")], "id int, t string")
    assert rows(df.select("id", text.clean_text("t"))) == [(1, "Its great"), (2, ""), (3, "")]
    assert rows(df.select("id", text.clean_title("t"))) == [(1, "It's \"great\"!"), (2, ""), (3, "")]
    both = df.selectExpr("id", "t", "t AS kept")
    assert rows(text.clean_all(both, keep=["kept"]))[0] == (1, "Its great", "  It's  \"great\"!  ")


def test_first_title_and_preview(spark):
    df = spark.createDataFrame([("A ; B",), (None,), ("x" * 31,), ("y" * 30,)], "t string")
    assert rows(df.select(text.first_title("t")))[0] == ("A",)
    assert (None,) in rows(df.select(text.first_title("t")))
    assert set(rows(df.select(text.preview("t", 30)))) == {("A ; B",), (None,), ("x" * 30 + "...",), ("y" * 30,)}


def test_terms(spark):
    df = spark.createDataFrame([("The Data scientist's big data of été_2 x",), ("",), ("one",)], "t string")
    got = [list(r[0]) for r in df.select(terms.terms("t")).collect()]
    assert got[0] == [
        "data", "scientist", "big", "data", "été_2",
        "data scientist", "scientist big", "big data", "data été_2",
    ]
    assert got[1:] == [[], ["one"]]
    three = [list(r[0]) for r in df.select(terms.terms("t", (), (3, 3))).collect()]
    assert three[0][0] == "the data scientist" and three[1:] == [[], []]


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert terms.ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert rows(df.select(vectors.cosine("a", "b"))) == [(0.0,), (0.96,)]
    assert rows(df.select(vectors.unit("a"))) == [([0.0, 0.0],), ([0.6, 0.8],)]
    percents = spark.createDataFrame([(0.63424,), (0.00125,), (0.00375,)], "s double")
    assert rows(percents.select(vectors.to_percent("s"))) == [(0.12,), (0.38,), (63.42,)]
