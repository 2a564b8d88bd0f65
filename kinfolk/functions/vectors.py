"""Vector expressions on arrays of double (MAP7, MAP8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; a missing component counts as zero, so unequal lengths are zero-padded."""
    terms = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _divided(v: Column, divisor: Column) -> Column:
    """``v`` by a divisor that is computed once for the row: inside a lambda it would be once for each component."""
    scaled = F.transform(F.array(divisor), lambda d: F.transform(as_double(v), lambda x: x / d))
    return F.when(v.isNotNull(), F.element_at(scaled, 1))


def normalise(v: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    size = norm(as_double(v))
    return _divided(v, F.when(size == 0, F.lit(1.0)).otherwise(size))


def normalise_clipped(v: Column, least: float = 1e-10) -> Column:
    """Unit vector with the divisor held at ``least`` or more, as detectors emit it."""
    return _divided(v, F.greatest(norm(as_double(v)), F.lit(least)))
