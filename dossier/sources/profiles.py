"""Profile tables and the processed corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import require_columns, require_tables

# File and column names of the inputs.
PROFILE_FILES = {
    "people": "01_people.csv",
    "abilities": "02_abilities.csv",
    "education": "03_education.csv",
    "experience": "04_experience.csv",
    "person_skills": "05_person_skills.csv",
}
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
CORPUS_COLUMNS = ["person_id", "embedding_text"]


def source_ordinal(files: Sequence[str]) -> Column:
    """Position of a row in its source, in file order.

    For one file it is a long, which aggregations keep in a hash map: the start of the row's split
    plus its number in the partition. A partition holds fewer rows than a split has bytes, so splits
    do not overlap. Several files need the triple of file, split and row, which sorts the same way.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    if len(files) <= 1:
        return F.col("_metadata.file_block_start") + row
    return F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), row.alias("row")
    )


def read_csv(
    spark: SparkSession,
    path: str,
    ord: str | None = "ord",
    key: str = "person_id",
    null_tokens: Sequence[str] = NULL_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header: all columns text but the integer key, missing-value texts as null.

    Only the header is read up front. ``multi_line`` accepts quoted line breaks but makes every file
    one split, so it stays off unless the data needs it.
    """
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    tokens = list(null_tokens)
    columns = [
        F.col(f"`{c}`").try_cast("bigint").alias(c)
        if c == key
        else F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c)
        for c in raw.columns
    ]
    if ord:
        columns.append(source_ordinal(raw.inputFiles()).alias(ord))
    return raw.select(*columns)


def read_profiles(
    spark: SparkSession, folder: str, files: Mapping[str, str] = PROFILE_FILES, **options
) -> dict[str, DataFrame]:
    """The five profile tables; an error names all files that are missing."""
    tables: dict[str, DataFrame | None] = {}
    for name, file in files.items():
        try:
            tables[name] = read_csv(spark, f"{folder.rstrip('/')}/{file}", **options)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            tables[name] = None
    require_tables({files[name]: table is not None for name, table in tables.items()})
    for name, table in tables.items():
        require_columns(table, ["person_id"], name)
    return tables


def read_corpus(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A processed corpus, checked, with an integer ``person_id``."""
    reader = spark.read
    if format == "csv":
        reader = reader.option("header", True).option("escape", '"')
    corpus = require_columns(reader.format(format).load(path), CORPUS_COLUMNS, "corpus")
    kind = corpus.schema["person_id"].dataType
    return corpus if isinstance(kind, T.IntegralType) else corpus.withColumn("person_id", F.col("person_id").cast("bigint"))
