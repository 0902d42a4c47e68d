"""Title collapse and score summaries over match results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..functions.titles import comparison_key, standardize

DETAIL_CHARACTERS = 200


def collapse_titles(
    matches: DataFrame,
    by: tuple[str, ...] = ("query_id",),
    title: str = "title",
    score: str = "similarity_percentage",
    rank: str = "rank",
    passes: int = 1,
    fix_quirks: bool = False,
) -> DataFrame:
    """Standardize titles, keep the best row per comparison key, rank anew by score.

    Ties go to the earlier rank. Taking the first row per group lets Spark cut each group down to
    one row per task before the exchange. Without a title column the matches come back unchanged.
    """
    if title not in matches.columns:
        return matches
    keyed = matches.withColumn(title, standardize(title, passes, fix_quirks))
    keyed = keyed.withColumn("title_key", comparison_key(title, fix_quirks))
    return keep_best_titles(keyed, by, score=score, rank=rank)


def keep_best_titles(
    matches: DataFrame,
    by: tuple[str, ...] = ("query_id",),
    key: str = "title_key",
    score: str = "similarity_percentage",
    rank: str = "rank",
) -> DataFrame:
    """The best row per key; the key column leaves and the rank starts anew."""
    best = Window.partitionBy(*by, key).orderBy(F.desc(score), rank)
    kept = matches.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", key)
    if not by:
        return kept
    order = Window.partitionBy(*by).orderBy(F.desc(score), rank)
    return kept.withColumn("_rank", F.row_number().over(order)).withColumn(rank, F.col("_rank")).drop("_rank")


def query_summary(matches: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Mean of the rounded similarities per query; null where a query has no match."""
    means = matches.groupBy("query_id").agg(
        F.avg("similarity_percentage").alias("avg_similarity"), F.count(F.lit(1)).alias("n_matches")
    )
    if queries is None:
        return means
    return (
        queries.select("query_id")
        .join(means, "query_id", "left")
        .withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    )


def folder_summary(matches: DataFrame, file: str = "query_id") -> DataFrame:
    """One row per match: file name, title, similarity and the start of the matched text."""
    return matches.select(
        F.element_at(F.split(F.col(file).cast("string"), "/"), -1).alias("cv_file"),
        F.col("title").alias("match_title"),
        F.col("similarity_percentage").alias("similarity"),
        truncate("embedding_text", DETAIL_CHARACTERS).alias("match_details"),
    )


def overall_summary(matches: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Statistics over the per-query means and the single scores.

    ``processed(query_id[, error])`` counts queries that ran without an error, matched or not.
    Highest values start at 0 and lowest ones at 100, also with no scores at all.
    """
    per_query = matches.groupBy("query_id").agg(
        F.avg("similarity_percentage").alias("a"),
        F.max("similarity_percentage").alias("hi"),
        F.min("similarity_percentage").alias("lo"),
    )
    if processed is not None:
        good = processed.filter(F.col("error").isNull()) if "error" in processed.columns else processed
        per_query = good.select("query_id").join(per_query, "query_id", "left")

    def two(c, name):
        return F.bround(c, 2).alias(name)

    return per_query.agg(
        F.count(F.lit(1)).alias("total_cvs"),
        two(F.coalesce(F.avg("a"), F.lit(0.0)), "average_similarity"),
        two(F.greatest(F.coalesce(F.max("a"), F.lit(0.0)), F.lit(0.0)), "highest_avg_similarity"),
        two(F.least(F.coalesce(F.min("a"), F.lit(100.0)), F.lit(100.0)), "lowest_avg_similarity"),
        two(F.greatest(F.coalesce(F.max("hi"), F.lit(0.0)), F.lit(0.0)), "highest_individual_match"),
        two(F.least(F.coalesce(F.min("lo"), F.lit(100.0)), F.lit(100.0)), "lowest_individual_match"),
        two(F.coalesce(F.stddev_pop("a"), F.lit(0.0)), "standard_deviation"),
    )
