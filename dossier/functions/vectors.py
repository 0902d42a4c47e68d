"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(_column(a), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; zero vectors give 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column | str) -> Column:
    """Scaled to length one; a zero vector stays as it is."""

    def scale(v: Column) -> Column:
        length = norm(v)
        return let(
            length,
            lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(
                v.cast("array<double>")
            ),
        )

    return let(_column(a), scale)


def to_percent(similarity: Column | str) -> Column:
    """Similarity as a percentage with two decimals, half to even."""
    return F.bround(_column(similarity).cast("double") * 100, 2)
