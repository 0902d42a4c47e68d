"""Scalar text cleaning, all in built-in functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode whitespace and word characters, spelled out so that Java and RE2 read them alike.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# What collapsing has to change: longer runs, and single characters other than a space. Text that is
# already clean has no match and is passed on as it is.
UNCOLLAPSED = rf"{WHITESPACE}{{2,}}|(?! ){WHITESPACE}"

# Characters that clean_text deletes.
DELETED_CHARACTERS = "'\"!"


def whole_word(pattern: str) -> str:
    """``pattern`` between Unicode word boundaries."""
    return rf"(?<!{WORD})(?:{pattern})(?!{WORD})"


def collapse_whitespace(c: Column) -> Column:
    """Whitespace runs become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(c, UNCOLLAPSED, " "))


def strip(c: Column) -> Column:
    """Remove Unicode whitespace from both ends only."""
    return F.regexp_replace(c, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def clean_text(c: Column | str) -> Column:
    """Delete quotes and exclamation marks, collapse whitespace; null gives an empty string."""
    c = F.col(c) if isinstance(c, str) else c
    kept = F.translate(F.coalesce(c.cast("string"), F.lit("")), DELETED_CHARACTERS, "")
    return collapse_whitespace(kept)


def clean_title(c: Column | str) -> Column:
    """Collapse whitespace only; null gives an empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return collapse_whitespace(F.coalesce(c.cast("string"), F.lit("")))


def clean_all(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """``clean_text`` over every string column except those in ``keep``."""
    keep = set(keep)
    return df.select(
        *[
            clean_text(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType) and f.name not in keep
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def first_title(c: Column | str) -> Column:
    """First entry of a ``;`` list, trimmed; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return strip(F.split_part(c, F.lit(";"), F.lit(1)))


def truncate(c: Column | str, n: int) -> Column:
    """First ``n`` characters, no marker."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c, 1, n)


def preview(c: Column | str, n: int) -> Column:
    """First ``n`` characters and ``...`` when something was cut off."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def text_audit(c: Column | str, n: int = 200) -> list[Column]:
    """Fingerprint, preview and size of a text, for logging what was extracted."""
    c = F.col(c) if isinstance(c, str) else c
    return [
        F.substring(F.md5(c.cast("binary")), 1, 8).alias("text_hash"),
        F.trim(F.regexp_replace(F.substring(c, 1, n), "\n", " ")).alias("text_preview"),
        F.length(c).alias("n_chars"),
    ]
