"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constant(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty, zero or vectors of different lengths."""
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.coalesce(F.when(good, dot(a, b) / (norm(a) * norm(b))), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine clamped to [-1, 1]; 1 where either norm is zero."""
    return 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))


def angle(a: Column, b: Column) -> Column:
    """Angle in radians, which unlike the cosine distance obeys the triangle inequality."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def normalized(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, i, mean): the component-wise mean of each group, one row for each component, from 0."""
    return df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("mean"))
