"""Helpers for building large column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Writing ``when(f(x), g(x)).otherwise(x)`` in a chain doubles the expression at every step.
    Binding ``x`` as a lambda variable keeps the chain linear.
    """
    return F.transform(F.array(value), body)[0]


def literal_strings(values: list[str]) -> Column:
    """A constant string array: one literal that the optimizer folds, not one node per element."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x01".join(values)), "\x01")


# The larger expressions are written as SQL text: one call to the JVM instead of one per node.


def sql_text(value: str) -> str:
    """A raw SQL string literal."""
    return 'r"' + value + '"' if "'" in value else "r'" + value + "'"


def sql_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def sql_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def sql_map(entries: Mapping[str, str]) -> str:
    return "map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in entries.items()) + ")"


def sql_let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_replace(value: str, steps: Iterable[tuple[str, str]]) -> str:
    """Regular expression replacements, one after the other."""
    for pattern, replacement in steps:
        value = f"regexp_replace({value}, {sql_text(pattern)}, {sql_text(replacement)})"
    return value


def literal_ints(values: list[int]) -> Column:
    """A constant integer array, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
