"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_names, chat, mixing, ngram_join, nn_descent, ordinal, packing, paragraph_dedup, pii, resampling, rules, spelling, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TAIL = 0.4  # least probability of a good grade
GOOD = 2  # the grade wanted


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_mix_sources(spark, d):
    return mixing.taken(mixing.mix(table(spark, d, "documents")))


@query
def op2_nearest_neighbours(spark, d):
    return nn_descent.nearest(table(spark, d, "embeddings"), F.col("id") % 20 == 0)


@query
def op3_ngram_join(spark, d):
    return ngram_join.group(table(spark, d, "documents"))


@query
def op4_format_chats(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


@query
def op5_quality_rules(spark, d):
    judged = rules.judge(rules.measures(table(spark, d, "documents")))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.withColumn("base_failed", rules.base_failed()).select(
        *names, "base_failed", (~F.col("base_failed") & F.col("good")).alias("kept"), "quality"
    )


@query
def op6_personal_data(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.find(docs, pii.train(docs)).alias("s"))
    return found.select(
        "doc_id",
        *(pii.count(F.col("s"), k).alias(f"n_{k}") for k in pii.KINDS[:4]),
        F.sha2(pii.listed(F.col("s"), base_only=True), 256).alias("base_sha256"),
        pii.listed(F.col("s")).alias("spans"),
    )


def graded(docs: DataFrame, labels: DataFrame, into: str | None = None) -> DataFrame:
    """Documents with the scores of a classifier fitted on the graded labels."""
    ratings = labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return ordinal.score(docs, ordinal.train(docs, ratings), GOOD, TAIL, into=into)


@query
def op7_quality_classifier(spark, d):
    scored = graded(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))
    return scored.select("doc_id", "expected_grade", "tail_probability", "kept")


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers as files

    return packing.pack(docs, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


@query
def op8_pack_tokens(spark, d):
    return packed(table(spark, d, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op9_suffix_dedup(spark, d):
    return suffix_dedup.dedup(table(spark, d, "documents")).drop("spans")


@query
def op10_paragraph_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    gone = paragraph_dedup.spans(docs)
    marked = docs.select("doc_id", paragraph_dedup.row_key("doc_id", "text").alias("row")).join(gone, "row", "left")
    one = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    found = F.coalesce("spans", F.array().cast(paragraph_dedup.SPANS))
    return marked.select(
        "doc_id",
        F.size(found).cast("long").alias("n_removed"),
        F.aggregate(found, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform(found, one), ",").alias("spans"),
    )


@query
def op11_spelling_variants(spark, d):
    return spelling.variants(spelling.counts(table(spark, d, "documents")))


@query
def op12_importance_resampling(spark, d):
    return resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op13_exact_dedup(spark, d):
    return block_names.groups(table(spark, d, "documents"))
