"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage keeps the columns of the documents, whatever their names, and the last returns pieces of
sequences. Null and empty texts, repeated rows and ids, ties and empty tables have the results that
the operators state: a null or empty text is graded by the thresholds alone, is near to no other, has
no personal data and no words to mix; rows without an id are all kept by the second stage; of rows
equal in id and text one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import mixing, ngram_join, pii, queries
from dossier.sources.stages import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a good grade is high enough; without ratings all of them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    free = next(n for n in (f"judged{'_' * i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    return queries.graded(docs, labels, into=free).filter(F.col(free)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents; rows without an id stay."""
    return ngram_join.representatives(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    spans = pii.find(docs, pii.train(docs))
    clean = pii.redact(F.col("text"), spans)
    return docs.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and round of the mix, with the words that the mix takes."""
    return mixing.texts(mixing.mix(docs), docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return queries.packed(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_join", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix),
    ("pack_tokens", pack),
]

# The classifier, the boosted trees and the tokenizer have no SQL; tests run the operators on small tables (see README).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
