"""A quality classifier from trusted positives and unlabelled text.

Minimises the non-negative unbiased risk of positive-unlabelled learning,
``p R_p(+) + max(0, R_u(-) - p R_p(-))``, with a class prior p that is estimated from the data. Features are
shapes of the text, computed over whole documents in one vectorised pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import BROADCAST_IDS
from .scratch import Scratch

#: Classes of bytes: control, space, newline, lower, upper, digit, sentence mark, other mark, non-ASCII.
KINDS = 9
_KIND = np.zeros(256, np.uint8)
_KIND[32] = _KIND[9] = 1
_KIND[10] = _KIND[13] = 2
_KIND[97:123] = 3
_KIND[65:91] = 4
_KIND[48:58] = 5
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 6
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_KIND[128:] = 8
FEATURES = KINDS + KINDS * KINDS + 7


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text: shares of byte classes and of their successions, and shapes of words and lines."""
    n = len(off) - 1
    size = np.diff(off)
    kind = _KIND[data].astype(np.int64)
    owner = np.repeat(np.arange(n), size)
    out = np.zeros((n, FEATURES))
    per = np.maximum(size, 1)[:, None]
    out[:, :KINDS] = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS) / per
    if len(data) > 1:
        same = owner[1:] == owner[:-1]
        pairs = (owner[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:])[same]
        out[:, KINDS : KINDS + KINDS * KINDS] = np.bincount(pairs, minlength=n * KINDS * KINDS).reshape(n, -1) / per
    start, end, first = T.words(data, off)
    count = np.diff(first)
    whose = np.repeat(np.arange(n), count)
    length = end - start
    each = np.maximum(count, 1)
    hashes = T.word_hashes(T.LOWER[data], start, end)
    order = np.lexsort((hashes, whose))
    h, w = hashes[order], whose[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    k = KINDS + KINDS * KINDS
    out[:, k] = np.log1p(count)
    out[:, k + 1] = np.bincount(whose, length, n) / each
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(whose, length.astype(float) ** 2, n) / each - out[:, k + 1] ** 2, 0))
    out[:, k + 3] = np.bincount(w[new], minlength=n) / np.sqrt(each)
    out[:, k + 4] = np.bincount(whose[length <= 3], minlength=n) / each
    s, e, lines = T.runs(data != 10, off)
    codes = T.Prefix(T.CODES[data]).of(s, e)
    of = np.repeat(np.arange(n), np.diff(lines))
    o = np.lexsort((codes, of))
    again = np.zeros(len(o), bool)
    again[1:] = (codes[o][1:] == codes[o][:-1]) & (of[o][1:] == of[o][:-1])
    out[:, k + 5] = np.bincount(of[o][again], (e - s)[o][again], n) / per[:, 0]
    out[:, k + 6] = np.log1p(np.bincount(of, minlength=n)) - np.log1p(count)
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality of each row of features."""
        z = expand((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares, so that both unusually low and high values can count."""
    z = np.clip(z, -6, 6)
    return np.concatenate((z, np.minimum(z * z, 9.0)), 1)


def _descend(grad, weights: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = grad(weights)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weights


def cuts_of(positive: np.ndarray, least: float = 0.2) -> np.ndarray:
    """Scores above which ``estimate_prior`` compares shares: quantiles of held-out positives that leave a share of ``least`` above."""
    return np.quantile(positive, np.linspace(0.0, 1 - least, 41))


def estimate_prior(positive: np.ndarray, above: np.ndarray, total: float) -> float:
    """The share of positives among ``total`` unlabelled rows, of which ``above`` many score at least each of ``cuts_of(positive)``.

    Above any score t the unlabelled hold at least prior * P(positive score >= t); the least ratio of both, over all t,
    bounds the prior from above and meets it where no negative scores that high.
    """
    p = np.array([(positive >= t).mean() for t in cuts_of(positive)])
    return float(np.clip((above / max(total, 1) / p).min(), 0.02, 0.98))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Unlabelled:
    """Sums over unlabelled rows of features, which may be an array here or a table on a cluster."""

    def __init__(self, rows: np.ndarray | DataFrame):
        self.rows = rows

    def sums(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``of`` (a vector for a block of rows) over all blocks."""
        if isinstance(self.rows, np.ndarray):
            return of(self.rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    s = of(_matrix(batch.column(0)))
                    total = s if total is None else total + s
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "s"])

        # As many rows as the vector has entries.
        found = self.rows.select("x").mapInArrow(T.tidy(run), "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").toPandas()
        return found["s"].to_numpy(float)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), FEATURES)


def train(positive: np.ndarray, sample: np.ndarray, unlabelled: Unlabelled | None = None, prior: float | None = None, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, passes: int = 8, seed: int = 3) -> Model:
    """A classifier that minimises the non-negative risk over ``positive`` and all of ``unlabelled`` (by default ``sample``).

    ``sample`` (of the unlabelled) only gives a start: the scale of the features, the prior, and gradient and curvature of
    the final Newton steps are sums over all unlabelled rows, so the minimum is theirs. The prior is estimated with a held-out third of the positives if it isn't given.
    """
    if not len(positive) or not len(sample):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(2 * FEATURES), 0.0, 0.5)
    unlabelled = unlabelled or Unlabelled(sample)
    s = unlabelled.sums(lambda x: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))))
    n = s[0] + len(positive)
    mean = (s[1 : FEATURES + 1] + positive.sum(0)) / n
    scale = np.maximum(np.sqrt(np.maximum((s[FEATURES + 1 :] + (positive**2).sum(0)) / n - mean**2, 0)), 1e-6)
    wide = lambda x: np.concatenate((expand((x - mean) / scale), np.ones((len(x), 1))), 1)
    p, u = wide(positive), wide(sample)
    keep = np.concatenate((np.ones(p.shape[1] - 1), [0.0])) * decay
    if prior is None:
        held = np.random.default_rng(seed).random(len(p)) < 1 / 3
        a = p[~held] if held.any() and not held.all() else p
        b = p[held] if held.any() else p
        # A third of the unlabelled rows, told by their features, is held out too.
        apart = lambda x: (np.abs(x).sum(1) * 4096).astype(np.int64) % 3 == 0
        seen = u[~apart(sample)] if not apart(sample).all() else u
        plain = lambda w: (-(1 - sigmoid(a @ w)) @ a / len(a) + sigmoid(seen @ w) @ seen / len(seen)) / 2 + keep * w
        w = _descend(plain, np.zeros(p.shape[1]), steps // 2, rate)
        cuts = cuts_of(b @ w)

        def above(x: np.ndarray) -> np.ndarray:
            x = x[apart(x)]
            return np.concatenate(([len(x)], (wide(x) @ w >= cuts[:, None]).sum(1))).astype(float)

        total = unlabelled.sums(above)
        prior = estimate_prior(b @ w, total[1:], total[0]) if total[0] else 0.5
    at_p = lambda w: (np.logaddexp(0, p @ w).mean(), sigmoid(p @ w) @ p / len(p))

    def risk(w: np.ndarray, softplus: float, gradient: np.ndarray) -> tuple[float, np.ndarray, bool]:
        """Risk, its gradient, and whether the estimated negative risk is at least 0; below, it overfits, and that part of a step is taken back."""
        loss, g = at_p(w)
        as_negative, g_neg = softplus - prior * loss, gradient - prior * g
        g_pos = prior * (g - p.mean(0))
        value = prior * (loss - p.mean(0) @ w) + max(as_negative, 0.0) + 0.5 * keep @ (w * w)
        return value, (g_pos + g_neg if as_negative >= 0 else -g_neg) + keep * w, as_negative >= 0

    w = _descend(lambda w: risk(w, np.logaddexp(0, u @ w).mean(), sigmoid(u @ w) @ u / len(u))[1], np.zeros(p.shape[1]), steps, rate)

    def block(x: np.ndarray) -> np.ndarray:
        x = wide(x)
        z = x @ w
        s = sigmoid(z)
        return np.concatenate(([np.logaddexp(0, z).sum()], s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()))

    best, size, step = (np.inf, w), 1.0, w
    for _ in range(passes):
        r = unlabelled.sums(block) / s[0]
        value, g, valid = risk(w, r[0], r[1 : len(w) + 1])
        if not valid and not np.isfinite(best[0]):
            w = w / 2  # towards zero weights, where the risk is valid
            continue
        if not valid or value > best[0] + 1e-12:
            size /= 2
            w = best[1] - size * step
            continue
        done = best[0] - value < 1e-9 * abs(value)
        best, size = (value, w), 1.0
        if done:
            break
        step = np.linalg.solve(r[len(w) + 1 :].reshape(len(w), -1) + np.diag(keep + 1e-9), g)
        w = w - step
    w = best[1]
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _save_features(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc_id, x) of every row; x is null for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in T.pieces(batch.column(1)):
                x, some = features(data, off).astype(np.float32), np.diff(off) > 0
                edges = np.concatenate(([0], np.cumsum(some * FEATURES))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges, mask=np.append(~some, False)), pa.array(x[some].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists], ["doc_id", "x"])

    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    return scratch.save(named.mapInArrow(T.tidy(run), "doc_id bigint, x array<float>"), "features")


def _bounded(features: DataFrame, ids: DataFrame, bound: int) -> np.ndarray:
    """Features of the ``bound`` documents among ``ids`` (doc_id) with the least id hashes, one row for each id."""
    chosen = ids.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    some = features.where("x is not null").join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = some.groupBy("doc_id").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    return np.stack(rows["x"].to_list()).astype(float) if len(rows) else np.zeros((0, FEATURES))


def fit(features: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", label_col: str = "quality", positives: int = 3000, start: int = 9000, prior: float | None = None, passes: int = 8) -> Model:
    """A model from at most ``positives`` documents labelled 1 and all documents without a label, of which ``start`` give the first guess."""
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).alias("q"))
    ids = known.select("doc_id").where("doc_id is not null").distinct()
    rest = features.where("x is not null").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")
    rest = scratch.save(rest, "unlabelled")
    model = train(_bounded(features, known.where("q = 1").select("doc_id"), positives), _bounded(rest, rest.select("doc_id"), start), Unlabelled(rest), prior, passes=passes)
    scratch.drop("unlabelled")
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, model: Model | None = None, **parameters) -> DataFrame:
    """(doc_id, score, keep) for every row of ``docs``: the probability of quality, and whether it reaches ``threshold``.

    Features are computed once, over whole texts. The model is ``fit`` on a bounded number of labelled rows and all unlabelled ones. A document with
    any label is not unlabelled; one labelled both 0 and 1 is a trusted positive. Null and empty texts score 0 and take no part in the fit. Null ids
    (unlabelled) and repeated rows come out row by row, as they came in. Without a positive or an unlabelled document with an id every text that isn't
    empty scores 0.5. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    table = _save_features(docs, id_col, text_col, scratch)
    fitted = model or fit(table, labels, scratch, id_col, label_col, **parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            some = np.asarray(batch.column(1).is_valid())
            score[some] = fitted.score(_matrix(batch.column(1).filter(pa.array(some))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= threshold)], ["doc_id", "score", "keep"])

    out = scratch.save(table.mapInArrow(T.tidy(run), "doc_id bigint, score double, keep boolean"), "scores")
    scratch.drop("features")
    return out
