"""Facet aggregations over matched rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields alone, arrays with a row for each value, rows without a value left out."""
    out = df.select(*fields)
    for f in fields:
        if isinstance(df.schema[f].dataType, T.ArrayType):
            out = out.withColumn(f, F.explode(f))
    return out.na.drop("any", subset=list(fields))


def terms(df: DataFrame, field: str, size: int | None = 10) -> DataFrame:
    """(key, doc_count) of the most frequent values, by count and then key."""
    counted = _values(df, [field]).groupBy(F.col(field).alias("key")).agg(F.count("*").alias("doc_count")).orderBy(F.desc("doc_count"), "key")
    return counted if size is None else counted.limit(size)


def cardinality(df: DataFrame, field: str, approximate: float | None = None) -> DataFrame:
    """(value): the number of distinct values; with ``approximate`` a sketch of that relative deviation."""
    values = _values(df, [field])
    return values.agg((F.approx_count_distinct(field, approximate) if approximate else F.count_distinct(field)).alias("value"))


def composite(df: DataFrame, sources: Mapping[str, str], size: int = 10, after: Mapping | None = None) -> DataFrame:
    """(<source names>, doc_count): one page of all combinations of values in key order, after the keys ``after``."""
    names, fields = list(sources), list(sources.values())
    counted = _values(df, list(dict.fromkeys(fields))).groupBy(*[F.col(f).alias(n) for n, f in sources.items()]).agg(F.count("*").alias("doc_count"))
    if after:
        later = F.lit(False)
        for k, n in enumerate(names):
            same = reduce(lambda a, b: a & b, [F.col(m) == F.lit(after[m]) for m in names[:k]], F.lit(True))
            later = later | (same & (F.col(n) > F.lit(after[n])))
        counted = counted.where(later)
    return counted.orderBy(*names).limit(size)


def after_key(page: DataFrame, names: Sequence[str]) -> dict | None:
    """The cursor behind a page of ``composite``: its last row's keys."""
    last = page.orderBy(*[F.desc(n) for n in names]).first()
    return None if last is None else {n: last[n] for n in names}


def aggregate(df: DataFrame, requests: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    """Every named aggregation of a request over ``df``."""
    out = {}
    for name, body in requests.items():
        if len(body) != 1:
            raise ValueError(f"aggregation {name} has exactly one kind")
        (kind, spec), = body.items()
        if kind == "terms":
            out[name] = terms(df, spec["field"], spec.get("size", 10))
        elif kind == "cardinality":
            out[name] = cardinality(df, spec["field"])
        elif kind == "composite":
            sources = {n: s["terms"]["field"] for part in spec["sources"] for n, s in part.items()}
            out[name] = composite(df, sources, spec.get("size", 10), spec.get("after"))
        else:
            raise ValueError(f"unknown aggregation {kind!r}: terms, cardinality or composite")
    return out
