"""Order, offset pages and keyset cursors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_keys(df: DataFrame, sort: Sequence[tuple[str, str]] | None, id_col: str, score_col: str = "score", mode: str = "typed") -> list[tuple[Column, bool]]:
    """(expression, descending) of a request's sort, ended by the id.

    Without a sort: score descending. ``mode="typed"`` compares values by type with missing ones last; "string" as strings, missing as "".
    """
    out = []
    for field, order in sort or [("_score", "desc")]:
        if order not in ("asc", "desc"):
            raise ValueError(f"order is asc or desc, not {order!r}")
        name = {"_score": score_col, "_id": id_col}.get(field, field)
        col = F.col(name)
        out.append((F.coalesce(col.cast("string"), F.lit("")) if mode == "string" and field != "_score" else col, order == "desc"))
    if not sort or sort[-1][0] != "_id":
        out.append((F.col(id_col), False))
    return out


def ordered(df: DataFrame, keys: Sequence[tuple[Column, bool]]) -> DataFrame:
    return df.orderBy(*[c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in keys])


def after(keys: Sequence[tuple[Column, bool]], cursor: Sequence) -> Column:
    """Whether a row comes strictly after the ``cursor`` values of all keys, nulls last in either direction."""
    if len(cursor) != len(keys):
        raise ValueError(f"the cursor needs {len(keys)} values, the last being the id")
    out, same = F.lit(False), F.lit(True)
    for (col, down), v in zip(keys, cursor):
        if v is not None:
            later = (col < F.lit(v)) if down else (col > F.lit(v))
            out = out | (same & F.coalesce(later, F.lit(True)))
        same = same & col.eqNullSafe(F.lit(v))
    return out


def page(df: DataFrame, keys: Sequence[tuple[Column, bool]], size: int = 10, offset: int = 0, search_after: Sequence | None = None) -> DataFrame:
    """One page in order; with a cursor the offset is ignored."""
    if search_after is not None:
        return ordered(df.where(after(keys, search_after)), keys).limit(size)
    rows = ordered(df, keys)
    return rows.offset(offset).limit(size) if offset else rows.limit(size)


def total_hits(df: DataFrame, exact: bool = True, cap: int = 10_000) -> DataFrame:
    """(total, relation): the exact count, or one that stops counting beyond ``cap`` and says "gte"."""
    cap = max(1, cap)
    n = (df if exact else df.limit(cap + 1)).agg(F.count("*").alias("n"))
    if exact:
        return n.select(F.col("n").alias("total"), F.lit("eq").alias("relation"))
    return n.select(F.least(F.col("n"), F.lit(cap).cast("bigint")).alias("total"), F.when(F.col("n") > cap, "gte").otherwise("eq").alias("relation"))
