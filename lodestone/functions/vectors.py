"""Vector similarities; the three cosines differ on purpose at unequal lengths and zero norms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the common positions."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Partial dot over full norms; null at a zero norm."""
    return dot(a, b) / F.nullif(norm(a), F.lit(0.0)) / F.nullif(norm(b), F.lit(0.0))


def strict_cosine(a: Column, b: Column) -> Column:
    """Cosine that is 0 at unequal lengths or a zero norm."""
    return F.coalesce(F.when(F.size(a) == F.size(b), cosine(a, b)), F.lit(0.0))


def diversity_cosine(a: Column, b: Column) -> Column:
    """Strict cosine moved to 0..1 and clamped (used when diversifying)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (strict_cosine(a, b) + 1) / 2))


def pair_cosine(a: Column, b: Column) -> Column:
    """Strict cosine clamped to 0..1 (used for similar pairs)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), strict_cosine(a, b)))


def valid_embedding(v: Column, most: int = 4096, bound: float = 10.0) -> Column:
    """1 to ``most`` finite numbers within the bound; null is invalid."""
    ok = F.size(v).between(1, most) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) <= bound))
    return F.coalesce(ok, F.lit(False))
