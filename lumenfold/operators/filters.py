"""Structured filters: a strict clause parser and one predicate builder for queries and deletes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAUSES = ("term", "terms", "range", "bool", "match_all")
_BOUNDS = ("gte", "gt", "lte", "lt")
_HINTS = {"match": "filters don't score: put text into the query", "exists": "not supported", "prefix": "not supported; use a wildcard query", "wildcard": "a query, not a filter", "filter": "use must"}


class FilterError(ValueError):
    """A filter clause that isn't understood."""


def _typed(df: DataFrame, field: str, mode: str) -> tuple[Column, T.DataType, bool]:
    """Expression, element type and whether the field has several values."""
    kind = df.schema[field].dataType
    many = isinstance(kind, T.ArrayType)
    element = kind.elementType if many else kind
    if mode == "string":
        return (F.transform(F.col(field), lambda x: x.cast("string")) if many else F.col(field).cast("string")), T.StringType(), many
    return F.col(field), element, many


def _literal(value, kind: T.DataType, field: str) -> Column:
    if isinstance(kind, T.BooleanType) and isinstance(value, str):
        if value.lower() not in ("true", "false"):
            raise FilterError(f"{value!r} is no boolean for {field}")
        return F.lit(value.lower() == "true")
    if isinstance(kind, T.NumericType):
        try:
            number = float(value) if isinstance(kind, T.FractionalType) else value if isinstance(value, int) else float(value)
        except (TypeError, ValueError):
            raise FilterError(f"{value!r} is no number for {field}") from None
        return F.lit(int(number) if not isinstance(kind, T.FractionalType) and float(number).is_integer() else number)
    return F.lit(str(value) if isinstance(kind, T.StringType) and not isinstance(value, str) else value).cast(kind)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _each(df: DataFrame, field: str, mode: str, test) -> Column:
    """``test`` on the field's value, or on any of its values; false without one, and for a field the table doesn't have."""
    if field not in df.columns:
        return F.lit(False)
    col, kind, many = _typed(df, field, mode)
    return F.coalesce(F.exists(col, lambda x: F.coalesce(test(x, kind), F.lit(False))) if many else test(col, kind), F.lit(False))


def _mapping(body, what: str) -> Mapping:
    if not isinstance(body, Mapping) or not body:
        raise FilterError(f"{what} needs a mapping of fields")
    return body


def predicate(df: DataFrame, clause: Mapping | None, mode: str = "typed") -> Column:
    """A boolean column (never null) for ``clause``.

    Several fields inside one term, terms or range are alternatives; a row without the field never matches, so must_not keeps
    it. Values are compared by the column's type; ``mode="string"`` compares everything as strings.
    """
    if clause is None:
        return F.lit(True)
    if not isinstance(clause, Mapping) or len(clause) != 1:
        raise FilterError("a clause has exactly one key of " + ", ".join(CLAUSES))
    (kind, body), = clause.items()
    if kind not in CLAUSES:
        raise FilterError(f"unknown clause {kind!r}" + (f": {_HINTS[kind]}" if kind in _HINTS else ""))
    if kind == "match_all":
        return F.lit(True)
    if kind == "term":
        return _any([_each(df, f, mode, lambda x, t, v=v, f=f: x == _literal(v, t, f)) for f, v in _mapping(body, kind).items()])
    if kind == "terms":
        for f, values in _mapping(body, kind).items():
            if not isinstance(values, (list, tuple)):
                raise FilterError(f"terms of {f} are a list")
        return _any([_each(df, f, mode, lambda x, t, vs=vs, f=f: x.isin(*[_literal(v, t, f) for v in vs]) if vs else F.lit(False)) for f, vs in body.items()])
    if kind == "range":
        return _any([_each(df, f, mode, lambda x, t, b=b, f=f: _within(x, t, b, f)) for f, b in _mapping(body, kind).items()])
    return _bool(df, body, mode)


def _within(x: Column, kind: T.DataType, bounds, field: str) -> Column:
    if not isinstance(bounds, Mapping) or set(bounds) - set(_BOUNDS):
        raise FilterError(f"range of {field} takes {', '.join(_BOUNDS)}")
    out = x.isNotNull()
    for name, value in bounds.items():
        if value is not None:
            v = _literal(value, kind, field)
            out = out & {"gte": x >= v, "gt": x > v, "lte": x <= v, "lt": x < v}[name]
    return out


def _bool(df: DataFrame, body, mode: str) -> Column:
    if not isinstance(body, Mapping):
        raise FilterError("bool needs a mapping")
    if unknown := set(body) - {"must", "must_not", "should", "minimum_should_match"}:
        name = sorted(unknown)[0]
        raise FilterError(f"unknown part {name!r} of bool" + (f": {_HINTS[name]}" if name in _HINTS else ""))
    lists = {k: body.get(k) or [] for k in ("must", "must_not", "should")}
    for k, v in lists.items():
        if not isinstance(v, (list, tuple)):
            raise FilterError(f"{k} is a list of clauses")
    out = F.lit(True)
    for c in lists["must"]:
        out = out & predicate(df, c, mode)
    for c in lists["must_not"]:
        out = out & ~predicate(df, c, mode)
    least = body.get("minimum_should_match", 1)
    if not isinstance(least, int) or least < 0:
        raise FilterError("minimum_should_match is a number from 0")
    if lists["should"] and least:
        out = out & (reduce(lambda a, b: a + b, [predicate(df, c, mode).cast("int") for c in lists["should"]]) >= least)
    return out
