"""Profile tables to one cleaned, de-duplicated text corpus."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_all, first_title
from ..functions.titles import standardize
from ..operators.corpus import (
    PERSONAL_COLUMNS,
    compose_text,
    concat_facts,
    dedup_statistics,
    drop_content_duplicates,
    fill_defaults,
    filter_ids,
    long_facts,
)


def prepare(
    tables: Mapping[str, DataFrame], key: str = "person_id", ord: str = "ord", max_id: int | None = None
) -> dict[str, DataFrame]:
    """Tables without personal columns and out-of-range ids, cleaned, titles cut to the first one.

    Columns leave before they are cleaned, so the scans never read them.
    """
    prepared = {}
    for name, table in tables.items():
        kept = filter_ids(table.drop(*PERSONAL_COLUMNS.get(name, [])), key, max_id)
        cleaned = clean_all(kept, keep=[key, ord])
        if name == "experience" and "title" in cleaned.columns:
            cleaned = cleaned.withColumn("title", first_title("title"))
        prepared[name] = cleaned
    return prepared


def _triple_ordinal(facts: DataFrame) -> DataFrame:
    """Ordinals of tables from one file and from several, in one type."""
    if isinstance(facts.schema["_ord"].dataType, T.StructType):
        return facts
    triple = F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.col("_ord").cast("long").alias("row"))
    return facts.withColumn("_ord", triple)


def joined_profiles(
    prepared: Mapping[str, DataFrame],
    people: str = "people",
    key: str = "person_id",
    ord: str = "ord",
    keep_blanks: bool = False,
) -> DataFrame:
    """People with the concatenated values of all other tables.

    All one-to-many tables go through one aggregation in long form and one left join, instead of an
    aggregation and a join per table.
    """
    base = prepared[people]
    taken, parts, order = set(base.columns), [], []
    for name, table in prepared.items():
        if name == people:
            continue
        fields = {}
        for column in table.columns:
            if column not in (key, ord):
                fields[column] = column if column not in taken else f"{name}_{column}"
                taken.add(fields[column])
        if fields:
            order += fields.values()
            parts.append(long_facts(table, key, ord, fields))
    if not parts:
        return base
    if len({p.schema["_ord"].dataType.simpleString() for p in parts}) > 1:
        parts = [_triple_ordinal(p) for p in parts]
    facts = reduce(DataFrame.unionByName, parts)
    return base.join(concat_facts(facts, key, order, keep_blanks=keep_blanks), key, "left")


def build(
    tables: Mapping[str, DataFrame],
    key: str = "person_id",
    ord: str = "ord",
    max_id: int | None = None,
    keep_blanks: bool = False,
    fix_quirks: bool = False,
) -> DataFrame:
    """The corpus: content columns, standardized ``title``, ``embedding_text`` and ``n_copies``.

    Content duplicates leave before titles are standardized, so titles that only become equal by
    standardization stay apart.
    """
    joined = joined_profiles(prepare(tables, key, ord, max_id), key=key, ord=ord, keep_blanks=keep_blanks)
    unique = drop_content_duplicates(joined, key, ord)
    if "title" in unique.columns:
        unique = unique.withColumn("title", standardize("title", fix_quirks=fix_quirks))
    return fill_defaults(unique).withColumn("embedding_text", compose_text())


def statistics(corpus: DataFrame) -> DataFrame:
    """How many people were merged away by the content dedup."""
    return dedup_statistics(corpus.select(F.col("n_copies")))
