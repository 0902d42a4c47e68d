"""Relational half: cleaning, concatenation per key, left joins, content dedup, the text column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, clean_title

# Constants of the corpus build.
SEPARATOR = "; "
PART_SEPARATOR = " | "
UNKNOWN_ABILITY = "Unknown ability"
UNKNOWN_SKILL = "Unknown skill"
UNKNOWN_TITLE = "Unknown Title"
TITLE_REPEATS = 3
PERSONAL_COLUMNS = {
    "people": ["name", "email", "phone", "linkedin"],
    "education": ["institution", "start_date", "location"],
    "experience": ["firm", "start_date", "end_date", "location"],
}


def filter_ids(df: DataFrame, key: str = "person_id", max_id: int | None = None) -> DataFrame:
    """Keep rows whose integer id is at most ``max_id`` (none: all); frames without the column pass through.

    Only a text id needs a cast; an integer one is compared as it is, so the filter reaches the scan.
    """
    if max_id is None or key not in df.columns:
        return df
    numeric = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return df.filter((F.col(key) if numeric else F.col(key).try_cast("bigint")) <= max_id)


def long_facts(df: DataFrame, key: str, ord: str, fields: Mapping[str, str]) -> DataFrame:
    """One row per (key, field, value): the unpivoted form all concatenations work on."""
    pairs = [F.struct(F.lit(out).alias("field"), F.col(c).cast("string").alias("value")) for c, out in fields.items()]
    return df.select(F.col(key), F.col(ord).alias("_ord"), F.inline(F.array(*pairs)))


def concat_facts(
    facts: DataFrame,
    key: str,
    fields: Iterable[str],
    separator: str = SEPARATOR,
    keep_blanks: bool = False,
) -> DataFrame:
    """Distinct values per key and field in first-seen order, joined by ``separator``.

    Two levels: equal values of a key meet first (combined on the map side, spread over the value),
    so a key that owns a third of all rows only brings its distinct values to the second level.
    A field is null where the key has no row for it, and empty where all its values are blank.
    """
    firsts = facts.groupBy(key, "field", "value").agg(F.min("_ord").alias("_ord"))
    wanted = F.col("value").isNotNull()
    if not keep_blanks:
        wanted = wanted & (F.trim("value") != "")

    def joined(name: str) -> Column:
        mine = F.col("field") == name
        values = F.collect_list(F.when(mine & wanted, F.struct("_ord", "value")))
        ordered = F.transform(F.array_sort(values), lambda x: x["value"])
        return F.when(F.count_if(mine) > 0, F.array_join(ordered, separator)).alias(name)

    return firsts.groupBy(key).agg(*[joined(f) for f in fields])


def concat_by_key(
    df: DataFrame,
    key: str = "person_id",
    ord: str = "ord",
    columns: Sequence[str] | None = None,
    keep_blanks: bool = False,
) -> DataFrame:
    """``concat_facts`` over one table: every column but the key and the ordinal.

    Without the key column the frame comes back unchanged; with nothing but the key, its distinct keys.
    """
    if key not in df.columns:
        return df
    columns = [c for c in (columns or df.columns) if c not in (key, ord)]
    if not columns:
        return df.select(key).distinct()
    facts = long_facts(df, key, ord, {c: c for c in columns})
    return concat_facts(facts, key, columns, keep_blanks=keep_blanks)


def join_profiles(people: DataFrame, tables: Mapping[str, DataFrame], key: str = "person_id") -> DataFrame:
    """Left join of one-row-per-key tables; a repeated column name gets its table's name as prefix.

    All inputs are hashed on the same key, so each is exchanged at most once.
    """
    joined = people
    for name, table in tables.items():
        taken = set(joined.columns) - {key}
        renamed = {c: f"{name}_{c}" for c in table.columns if c in taken}
        joined = joined.join(table.withColumnsRenamed(renamed), key, "left")
    return joined


def drop_content_duplicates(
    df: DataFrame, key: str = "person_id", ord: str = "ord", columns: Sequence[str] | None = None
) -> DataFrame:
    """Keep the first row (by ``ord``) of equal content; nulls are equal to nulls.

    A hash aggregation on the content itself: copies fold on the map side, so a text that makes up
    a third of all rows costs one row per task in the shuffle. ``n_copies`` counts the group. ``ord``
    must be unique: of equal ones any row may stay.
    """
    content = [c for c in (columns or df.columns) if c not in (key, ord)]
    first = df.groupBy(*content).agg(
        F.min_by(key, ord).alias(key), F.min(ord).alias(ord), F.count(F.lit(1)).alias("n_copies")
    )
    order = [c for c in df.columns if c in {key, ord, *content}]
    return first.select(*order, "n_copies")


def dedup_statistics(deduplicated: DataFrame) -> DataFrame:
    """Rows before and removed, and the removed share in percent, from the ``n_copies`` counts."""
    total, kept = F.coalesce(F.sum("n_copies"), F.lit(0)), F.count(F.lit(1))
    share = F.coalesce(F.try_divide((total - kept) * F.lit(100.0), total), F.lit(0.0))
    return deduplicated.agg(
        total.alias("initial_rows"), (total - kept).alias("removed_rows"), F.round(share, 2).alias("removed_percent")
    )


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults for missing ability and skill; an absent title column becomes a constant."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
        for name, default in (("ability", UNKNOWN_ABILITY), ("skill", UNKNOWN_SKILL))
    }
    if "title" not in df.columns:
        filled["title"] = F.lit(UNKNOWN_TITLE)
    return df.withColumns(filled)


def compose_text(
    ability: str = "ability", title: str = "title", skill: str = "skill", title_repeats: int = TITLE_REPEATS
) -> Column:
    """``ability | title*n | skill``; the title copies carry no separator between them."""
    return F.concat_ws(
        PART_SEPARATOR, clean_text(ability), F.repeat(clean_title(title), title_repeats), clean_text(skill)
    )


def distinct_titles(df: DataFrame, title: str = "title", ord: str = "ord") -> DataFrame:
    """Titles with their first position."""
    return df.groupBy(title).agg(F.min(ord).alias("first_ord"))
