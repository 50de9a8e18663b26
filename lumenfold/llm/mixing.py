"""Mixing sources to target weights by entropy balancing.

Of all document rates whose token sums meet the targets, those closest to uniform in relative entropy are
exponential tilts exp(sum of the multipliers of the document's groups). The multipliers minimise the convex dual;
each Newton iteration is one distributed pass that sums gradient and Hessian over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch
from .tokens import with_words

#: Groups of all balanced columns together; the Hessian has their square.
MAX_GROUPS = 4000


def tempered(tokens: Mapping, power: float) -> dict:
    """Target shares in proportion to tokens ** power; groups without tokens get none."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def _moments(batches: Iterator[pa.RecordBatch], width: int, multipliers: np.ndarray) -> Iterator[pa.RecordBatch]:
    k = len(multipliers)
    cells: dict[int, float] = {}
    for batch in batches:
        t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
        x = [batch.column(c + 1).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(width)]
        w = t * np.exp(sum(multipliers[i] for i in x))
        for a in x:
            for b in x:
                at, where = np.unique(a * k + b, return_inverse=True)
                for c, v in zip(at.tolist(), np.bincount(where, w, len(at)).tolist()):
                    cells[c] = cells.get(c, 0.0) + v
    at = np.array(sorted(cells), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array(at % k), pa.array([cells[c] for c in at.tolist()], pa.float64())], ["i", "j", "v"])


def _least(batches: Iterator[pa.RecordBatch], width: int, multipliers: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tilt = sum(multipliers[batch.column(c).to_numpy(zero_copy_only=False)] for c in range(width))
            yield pa.RecordBatch.from_arrays([pa.array([float(tilt.min())])], ["low"])


class Mix:
    """Fitted multipliers: ``rate`` and ``copies`` are expressions over the balanced columns and the id."""

    def __init__(self, columns: Sequence[str], multipliers: dict[str, dict], scale: float, shares: dict[str, dict], iterations: int):
        self.columns, self.multipliers, self.scale, self.shares, self.iterations = list(columns), multipliers, scale, shares, iterations

    def apply(self, df: DataFrame, id_col: str) -> DataFrame:
        """``df`` with __lf_rate and __lf_copies."""
        tilt: Column = F.lit(0.0)
        for n, c in enumerate(self.columns):
            values = pd.DataFrame([(v, m) for v, m in self.multipliers[c].items()], columns=["v", "m"])
            table = df.sparkSession.createDataFrame(list(values.itertuples(index=False, name=None)), f"__lf_v{n} string, __lf_m{n} double")
            # At most MAX_GROUPS rows.
            df = df.join(F.broadcast(table), df[c].cast("string").eqNullSafe(F.col(f"__lf_v{n}")), "left")
            tilt = tilt + F.coalesce(F.col(f"__lf_m{n}"), F.lit(0.0))
        df = df.withColumn("__lf_rate", F.lit(self.scale) * F.exp(tilt)).drop(*(f"__lf_{x}{n}" for n in range(len(self.columns)) for x in "vm"))
        uniform = F.conv(F.substring(F.md5(F.coalesce(df[id_col].cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
        whole = F.floor(F.col("__lf_rate") + 1e-9)
        return df.withColumn("__lf_copies", (whole + (uniform < F.col("__lf_rate") - whole - 1e-9).cast("int")).cast("int"))


def fit(docs: DataFrame, columns: Sequence[str] = ("source", "lang"), text_col: str = "text", targets: Mapping[str, Mapping] | None = None, power: float = 0.8, budget: float | None = None, tolerance: float = 1e-10, rounds: int = 60) -> tuple[Mix, DataFrame]:
    """Multipliers for ``docs`` and the table of tokens (saved) that they were fitted on.

    ``targets`` has the wanted shares of tokens by column and value (null is a value, too), else tokens to the ``power``. A target for a
    value that has no tokens raises ValueError, as does a value with tokens that has no target. Groups without tokens carry no constraint and get multiplier 0. The rates sum to ``budget`` tokens; by default to as many as make
    the least rate 1, so that no document is left out. Targets that no rates can meet raise ValueError.
    """
    if not 1 <= len(columns):
        raise ValueError("no column to balance")
    scratch = Scratch(docs.sparkSession)
    named = docs.select(*[F.col(c).cast("string").alias(f"c{n}") for n, c in enumerate(columns)], F.col(text_col).alias("t"))
    table = scratch.save(with_words(named, "t", [f"c{n}" for n in range(len(columns))]), "tokens")
    values: dict[str, dict] = {}
    for n, c in enumerate(columns):
        found = table.groupBy(f"c{n}").agg(F.sum("tokens").alias("t")).orderBy(F.col(f"c{n}").asc_nulls_first()).limit(MAX_GROUPS + 1).collect()
        values[c] = {r[0]: int(r[1]) for r in found}
    if (k := sum(map(len, values.values()))) > MAX_GROUPS:
        raise ValueError(f"{k} groups or more; at most {MAX_GROUPS}")
    shares = {c: tempered(values[c], power) if targets is None or c not in targets else dict(targets[c]) for c in columns}
    for c in columns:
        if lost := [v for v, s in shares[c].items() if s > 0 and not values[c].get(v)]:
            raise ValueError(f"{c} {lost[0]!r} has a target but no tokens")
    for c in columns:
        total = sum(shares[c].values())
        if values[c] and sum(values[c].values()) and (total <= 0 or any(s <= 0 for s in shares[c].values()) or {v for v, t in values[c].items() if t} - shares[c].keys()):
            raise ValueError(f"every group of {c} that has tokens needs a positive share")
        shares[c] = {v: s / total for v, s in shares[c].items()} if total else {}
    index = {(c, v): i for i, (c, v) in enumerate((c, v) for c in columns for v in values[c])}
    wanted = np.array([shares[c].get(v, 0.0) for c, v in index])
    m = np.zeros(len(index))
    if not wanted.sum():  # no tokens at all
        return Mix(columns, {c: dict.fromkeys(values[c], 0.0) for c in columns}, 1.0, shares, 0), table
    coded = table.where("tokens > 0").select("tokens", *[f"c{n}" for n in range(len(columns))])
    for n, c in enumerate(columns):
        lookup = docs.sparkSession.createDataFrame([(v, index[c, v]) for v in values[c]], f"v{n} string, x{n} int")
        coded = coded.join(F.broadcast(lookup), F.col(f"c{n}").eqNullSafe(F.col(f"v{n}")))
    coded = scratch.save(coded.select("tokens", *[f"x{n}" for n in range(len(columns))]), "coded")
    done, err, step, before = 0, np.inf, np.zeros(len(m)), np.inf
    for done in range(1, rounds + 1):
        at = m.copy()
        sums = coded.mapInArrow(T.tidy(lambda it: _moments(it, len(columns), at)), "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        hess = np.zeros((len(m), len(m)))
        hess[sums["i"], sums["j"]] = sums["v"]
        total = hess.diagonal().sum() / len(columns)
        p = hess.diagonal() / total
        value = math.log(total) - float(wanted @ m)
        if value > before + 1e-12 and np.abs(step).max() > 1e-12:  # too long a step: half of it
            step /= 2
            m = m - step
            continue
        before, err = value, float(np.abs(p - wanted).max())
        if err < tolerance:
            break
        step = -np.linalg.pinv(hess / total - np.outer(p, p), rcond=1e-12, hermitian=True) @ (p - wanted)
        m = m + step
    if err >= max(tolerance, 1e-6):
        raise ValueError(f"no rates meet these targets: shares are off by {err:.3g} after {done} iterations")
    multipliers = {c: {v: float(m[index[c, v]]) for v in values[c]} for c in columns}
    if budget is None:
        least = coded.select(*[f"x{n}" for n in range(len(columns))]).mapInArrow(T.tidy(lambda it: _least(it, len(columns), m)), "low double")
        low = least.agg(F.min("low")).first()[0]
        scale = math.exp(-low)
    else:
        scale = budget / total
    scratch.drop("coded")
    return Mix(columns, multipliers, scale, shares, done), table


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] = ("source", "lang"), **parameters) -> DataFrame:
    """(doc_id, <columns>, tokens, rate, copies) for every row: its tilted rate and the copies it is rounded to.

    A rate r becomes floor(r) copies and one more where a hash of the id, uniform in [0, 1), is below the rest; so
    rows with the same id and groups round alike. Null ids hash as empty text. Null and empty texts have no tokens: they get their
    groups' rate without counting. For the parameters see ``fit``; other columns are ignored.
    """
    mix, table = fit(docs, columns, text_col, **parameters)
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in columns], F.col(text_col).alias("__lf_body"))
    out = mix.apply(with_words(named, "__lf_body", ["doc_id", *columns]), "doc_id")
    return out.select("doc_id", *columns, "tokens", F.round("__lf_rate", 6).alias("rate"), F.col("__lf_copies").alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] = ("source", "lang"), **parameters) -> DataFrame:
    """``docs`` with each row as many times as ``mixing_plan`` has copies of it; all columns stay as they are.

    Nulls, empty texts, repeated rows and ids are treated as there; an empty table gives an empty one, and extra columns of any name stay.
    """
    mix, _ = fit(docs, columns, text_col, **parameters)
    out = mix.apply(docs, id_col).where("__lf_copies > 0")
    return out.withColumn("__lf_copy", F.explode(F.sequence(F.lit(1), F.col("__lf_copies")))).select(*[out[c] for c in docs.columns])
