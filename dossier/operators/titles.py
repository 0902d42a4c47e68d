"""Title rules run once per different title, not once per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.titles import comparison_key, standardize
from ..sources.stages import settle
from .lookup import HOT
from .similarity import HELD_BYTES

SHOWN_PASSES = 2


def title_forms(df: DataFrame, fix_quirks: bool = False) -> DataFrame:
    """Add ``shown_title``, the title after two more passes of the rules, and its ``title_key``."""
    shown = df.withColumn("shown_title", standardize("title", SHOWN_PASSES, fix_quirks))
    return shown.withColumn("title_key", comparison_key("shown_title", fix_quirks))


def title_dictionary(df: DataFrame, fix_quirks: bool = False) -> DataFrame:
    """``(title, n, shown_title, title_key)`` of the different titles, as a written table; null counts as empty."""
    counted = df.groupBy(F.coalesce("title", F.lit("")).alias("title")).agg(F.count(F.lit(1)).alias("n"))
    # Written between: the rules must not run below the aggregation, where titles are repeated.
    return settle(title_forms(settle(counted, "titles"), fix_quirks), "title-forms")


def with_title_forms(df: DataFrame, fix_quirks: bool = False, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``df`` with the forms of its titles, and without a shuffle of its rows.

    A dictionary of checked size is sent to all rows. Of a larger one only titles with more than
    one in ``HOT`` of all rows are sent, fewer than ``HOT``; the rows of the others apply the rules.
    """
    known = title_dictionary(df, fix_quirks)
    texts = [F.octet_length(c) for c in ("title", "shown_title", "title_key")]
    size, rows = known.agg(
        F.coalesce(F.sum(sum(texts, F.lit(64))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    sent = known if size <= held_bytes else known.filter(F.col("n") > rows / HOT)
    forms = sent.select(F.col("title").alias("_title"), F.struct("shown_title", "title_key").alias("_forms"))
    joined = df.join(F.broadcast(forms), F.coalesce("title", F.lit("")) == F.col("_title"), "left").drop("_title")
    if size <= held_bytes:
        return joined.withColumns({c: F.col("_forms")[c] for c in ("shown_title", "title_key")}).drop("_forms")
    # Rules are evaluated for rows without a known form only.
    unknown = joined.withColumn("_raw", F.col("title")).withColumn("title", F.when(F.col("_forms").isNull(), F.col("title")))
    ruled = title_forms(unknown, fix_quirks)
    found = {c: F.coalesce(F.col("_forms")[c], F.col(c)) for c in ("shown_title", "title_key")}
    return ruled.withColumns(found).withColumn("title", F.col("_raw")).drop("_raw", "_forms")
