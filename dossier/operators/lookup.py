"""Joining many rows with a table of unique keys, some of which a large share of the rows may have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000  # a key with more than this share (1 / HOT) of all rows is sent to all tasks


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str = "n", hot: int = HOT) -> DataFrame:
    """``rows`` with the columns of ``table``, null where it has no such key.

    ``table`` is read twice, so it should be a written one. Its ``count`` says how many rows have each
    key: fewer than ``hot`` keys can have more than their share, and these are broadcast. Their rows
    look for nothing in the join with the other keys and are spread over all its tasks.
    """
    values = [c for c in table.columns if c not in (*keys, count)]
    total = table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).first()["t"]
    often = F.col(count) > total / hot
    early = table.filter(often).select(*keys, F.struct(*values).alias("_early"))
    marked = rows.join(F.broadcast(early), list(keys), "left").withColumn(
        # A hot row gets a number of its own, which no row of the other side has.
        "_part", F.when(F.col("_early").isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1)
    )
    # The count stands in for a constant 0, which would drop out of the keys of the join.
    rest = table.filter(~often).select(*keys, F.when(F.col(count) < 0, F.col(count)).otherwise(F.lit(0).cast("long")).alias("_part"), F.struct(*values).alias("_late"))
    joined = marked.join(rest, [*keys, "_part"], "left")
    found = F.coalesce("_early", "_late")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in values])
