"""Random choices that are the same in every run, on every partitioning and in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(text: Column, sides: Column | int) -> Column:
    """A number from 0 to ``sides - 1`` that depends on the text alone."""
    digest = F.substring(F.md5(text.cast("string").cast("binary")), 1, 8)
    sides = F.lit(sides) if isinstance(sides, int) else sides
    return F.pmod(F.conv(digest, 16, 10).cast("long"), sides)


def seeded(seed: int, *parts: Column | str) -> Column:
    """Text of a draw: the seed and the ids it is made for."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
