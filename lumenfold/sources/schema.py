"""Field roles, and documents as lists of named typed fields."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = {"Text": "string", "Keyword": "string", "Date": "string", "Boolean": "boolean", "Integer": "bigint", "Float": "double", "Vector": "array<float>"}
FIELD = "struct<name: string, field_type: string, value: string>"
_FIELD = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "field_type", "value")])
NATIVE = T.StructType([T.StructField("id", T.StringType()), T.StructField("fields", T.ArrayType(_FIELD))])


def infer_roles(df: DataFrame, declared: Mapping[str, str] | None = None) -> dict[str, str]:
    """A role for each column from its type: strings are Text, arrays of numbers Vector, other arrays and structs Keyword."""
    out = {}
    for f in df.schema.fields:
        t = f.dataType
        if declared and f.name in declared:
            if declared[f.name] not in ROLES:
                raise ValueError(f"unknown role {declared[f.name]!r}")
            out[f.name] = declared[f.name]
        elif isinstance(t, T.BooleanType):
            out[f.name] = "Boolean"
        elif isinstance(t, T.IntegralType):
            out[f.name] = "Integer"
        elif isinstance(t, T.NumericType):
            out[f.name] = "Float"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = "Date"
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType):
            out[f.name] = "Vector"
        else:
            out[f.name] = "Text" if isinstance(t, T.StringType) else "Keyword"
    return out


def typed(native: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Native (id, fields) rows as one column for each field; values that don't parse become null, of repeated fields the first one that does counts."""

    def column(name: str, role: str) -> Column:
        raw = F.transform(F.filter("fields", lambda f: f["name"] == name), lambda f: f["value"])
        each = F.transform(raw, lambda v: F.from_json(v, "array<float>") if role == "Vector" else v.try_cast(ROLES[role]))
        return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0)).alias(name)

    cols = [column(name, role) for name, role in roles.items()]
    return native.select("id", *cols)


def native(df: DataFrame, id_col: str, roles: Mapping[str, str] | None = None) -> DataFrame:
    """Typed rows as (id, fields); null values are left out."""
    roles = roles or {c: r for c, r in infer_roles(df).items() if c != id_col}
    fields = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("name"), F.lit(r).alias("field_type"), (F.to_json(c) if r == "Vector" or isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c).cast("string")).alias("value"))) for c, r in roles.items()]
    return df.select(F.col(id_col).cast("string").alias("id"), F.filter(F.array(*fields), lambda f: f.isNotNull()).cast(f"array<{FIELD}>").alias("fields"))


def field_of(name: str, value) -> dict | None:
    """A native field of a JSON value: lists of 8 and more numbers are vectors, other lists Keyword JSON; null and objects are skipped."""
    if value is None or isinstance(value, dict):
        return None
    if isinstance(value, bool):
        return {"name": name, "field_type": "Boolean", "value": "true" if value else "false"}
    if isinstance(value, int):
        return {"name": name, "field_type": "Integer", "value": str(value)}
    if isinstance(value, float):
        return {"name": name, "field_type": "Float", "value": repr(value)}
    if isinstance(value, list):
        numbers = len(value) >= 8 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value)
        return {"name": name, "field_type": "Vector" if numbers else "Keyword", "value": json.dumps(value)}
    return {"name": name, "field_type": "Text", "value": value}
