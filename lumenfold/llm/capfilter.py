"""Near-duplicate embeddings by spherical-cap filters of structured random product codes.

The rotated space is cut into blocks with random unit codes each; a filter direction is one code of every
block. Branch and bound over the blocks lists all filters that a vector exceeds the cap height for, and its
nearest ones at least; how many, and of how many filters, follows from simulated pairs at the threshold.

The join takes a code of one block, whose filters are cells: every vector is sent to its nearest ones whole, a slice of the cells
at a time, and those of a cell are compared with each other by blocks of a matrix product. Thus no pair is ever a row, only links are,
and the disk holds one slice. The cosine of the whole vectors decides.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import text as T
from .components import BROADCAST_IDS, components, grouped
from .scratch import Scratch

#: Codes of a block at most.
MAX_CODES = 1024

#: Simulated pairs at the threshold, and the share of them that has to meet on a filter.
PAIRS, MEET = 1000, 0.99

#: Tables of at most so many vectors are one cell. Numbers in all directions of the cells, and in the vectors that a task compares at once, at most.
WHOLE, NUMBERS = 16384, 1 << 22

#: Vectors in a cell at most, in numbers; a fuller one is cut into parts that meet two by two.
CELL = 1 << 23

#: Rows of a slice for each vector, about.
SLICE = 1.0

#: Sides of the tiles of a matrix product.
TILE, WIDE = 512, 1024


def simulated_pairs(dim: int, threshold: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs of unit vectors at a cosine of ``threshold``, in all directions alike."""
    rng = np.random.default_rng([seed, dim, 1])
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return x, x
    z = rng.standard_normal((n, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = min(max(threshold, -1.0), 1.0)
    return x, c * x + math.sqrt(1 - c * c) * z


class ProductCode:
    """Filters for vectors of ``dim`` dimensions, about four for each of ``count`` vectors, of which a vector exceeds about ``hits``.

    ``own`` is how many of its nearest filters a vector has to be listed under even where it exceeds fewer: the least number with which
    simulated pairs at ``threshold`` meet at the rate ``MEET``; where that takes more than twice ``hits``, filters are halved until it doesn't.
    """

    def __init__(self, dim: int, count: int, hits: float, seed: int, threshold: float = 0.9, single: bool = False):
        rng = np.random.default_rng([seed, dim])
        wanted = max(256.0, 4.0 * count)
        blocks = 1
        while blocks < dim and wanted ** (1 / blocks) > MAX_CODES and not single:
            blocks += 1
        # Codes of a single dimension have but two values.
        blocks = 1 if single else min(max(blocks, 2), max(dim // 2, 1))
        most = max(NUMBERS // dim, 1) if single else MAX_CODES
        self.codes = min(most if dim > 1 else 2, math.ceil(wanted ** (1 / blocks)))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [round(i * dim / blocks) for i in range(blocks + 1)]
        self.directions = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = rng.standard_normal((self.codes, b - a))
            # A block's share of a unit direction's length follows its share of the dimensions.
            self.directions.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt((b - a) / dim))
        self.flat: np.ndarray | None = None
        pairs, limit = simulated_pairs(dim, threshold, PAIRS, seed), max(int(2 * hits), 1)
        while True:
            filters = float(self.codes) ** blocks
            # Cells are the nearest ones alone, whatever their height.
            self.height = math.inf if single else NormalDist().inv_cdf(max(1 - hits / filters, 0.5)) / math.sqrt(dim)
            self.own = self._needed(*pairs, limit)
            if self.own <= limit or self.codes == 1:
                break
            self.codes = min(self.codes - 1, math.ceil(self.codes * 0.5 ** (1 / blocks)))
            self.directions = [d[: self.codes] for d in self.directions]

    def _needed(self, x: np.ndarray, y: np.ndarray, limit: int) -> int:
        """The least ``own`` with which the pairs meet at the rate ``MEET``; more than ``limit`` if that isn't enough."""
        step = max(NUMBERS // self.codes, 1)
        (sx, fx), (sy, fy) = (map(np.concatenate, zip(*(self._nearest(self._scores(u[lo : lo + step]), limit) for lo in range(0, len(u), step)))) for u in (x, y))
        place = np.arange(1, sx.shape[1] + 1)
        nx, ny = (np.where(s >= self.height, 0, place) for s in (sx, sy))
        both = np.where(fx[:, :, None] == fy[:, None, :], np.maximum(nx[:, :, None], ny[:, None, :]), limit + 1)
        return int(np.quantile(both.min((1, 2)), MEET, method="higher"))

    def _scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, a:b] @ d.T for a, b, d in zip(self.cuts, self.cuts[1:], self.directions)]

    def _nearest(self, scores: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of the ``n`` nearest filters of each vector, best first; of places i and j in two lists only those with i * j up to n matter."""
        total, code = np.zeros((len(scores[0]), 1)), np.zeros((len(scores[0]), 1), np.int64)
        for s in scores:
            few = min(n, self.codes)
            at = np.argpartition(-s, few - 1, 1)[:, :few]
            at = np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), 1), 1)
            i, j = np.nonzero(np.multiply.outer(np.arange(1, total.shape[1] + 1), np.arange(1, few + 1)) <= n)
            sums, code = total[:, i] + np.take_along_axis(s, at, 1)[:, j], code[:, i] * self.codes + at[:, j]
            best = np.argsort(-sums, 1)[:, :n]
            total, code = np.take_along_axis(sums, best, 1), np.take_along_axis(code, best, 1)
        return total, code

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The ``own`` nearest filters of each vector, for a code of one block."""
        if self.flat is None:
            self.flat = (self.rotation @ self.directions[0].T).astype(np.float32)
            # Scores above this are about three times as many as wanted, and few beside all.
            self.floor = np.float32(NormalDist().inv_cdf(max(1 - 3 * self.own / self.codes, 0.01)) / math.sqrt(len(self.rotation)))
        own = min(self.own, self.codes)
        out = np.empty((len(unit), own), np.int64)
        step = max(NUMBERS // 4 // self.codes, 1)
        for lo in range(0, len(unit), step):
            s = unit[lo : lo + step].astype(np.float32) @ self.flat
            at = np.flatnonzero(s >= self.floor)
            row = at // self.codes
            many = np.bincount(row, minlength=len(s))
            order = np.lexsort((-s.ravel()[at], row))
            begin = np.cumsum(many) - many
            enough = np.flatnonzero(many >= own)
            out[lo + enough] = (at[order[begin[enough][:, None] + np.arange(own)]]) % self.codes
            few = np.flatnonzero(many < own)
            if len(few):
                out[lo + few] = np.argpartition(-s[few], own - 1, 1)[:, :own]
        return out

    def listed(self, unit: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for every filter exceeded by each of the unit vectors, and its ``least`` nearest in any case."""
        scores = self._scores(unit)
        height = np.full(len(unit), self.height)
        if least and len(unit):
            height = np.minimum(height, self._nearest(scores, least)[0][:, -1])
        rest = np.zeros((len(unit), len(scores) + 1))
        for k in range(len(scores) - 1, -1, -1):
            rest[:, k] = rest[:, k + 1] + scores[k].max(1)
        vec, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, s in enumerate(scores):
            parts = []
            for lo in range(0, len(vec), 4096):
                v = vec[lo : lo + 4096]
                sums = total[lo : lo + 4096, None] + s[v]
                i, j = np.nonzero(sums >= (height[v] - rest[v, k + 1] - 1e-12 * (k + 1 < len(scores)))[:, None])
                parts.append((v[i], code[lo + i] * self.codes + j, sums[i, j]))
            vec, code, total = (np.concatenate(x) for x in zip(*parts)) if parts else (vec, code, total)
        return vec, code


@lru_cache(16)
def cell_code(dim: int, count: int, hits: float, seed: int, threshold: float) -> ProductCode:
    """A code of about four times the root of ``count`` cells: to list more costs what comparing in fewer does. ``hits`` / 2 a vector at most."""
    return ProductCode(dim, math.ceil(math.sqrt(count)), hits / 4, seed, threshold, single=True)


def unit_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vector; vectors that are null, empty, zero or not finite are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=0).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[begin[rows][:, None] + np.arange(d)]
        # By the largest component first, so that no square over- or underflows.
        with np.errstate(invalid="ignore", divide="ignore"):
            x = x / np.abs(x).max(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1))
        ok = np.isfinite(norm) & (norm > 0)
        if ok.any():
            yield rows[ok], x[ok] / norm[ok, None]


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _raw(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all vectors out of their bytes, and where each vector's begin (and the end)."""
    edge = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2], kind, int(edge[-1])) if edge[-1] else np.zeros(0, kind)
    return data, edge


def _groups(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length of vector."""
    data, edge = _raw(column, kind)
    size = np.diff(edge)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, data[edge[rows][:, None] + np.arange(d)]


def _prepared(batches: Iterator[pa.RecordBatch], count: int, hits: float, seed: int, threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, v) with equal vectors in one task: (doc_id, null, bytes of v, cells) of one of each, (doc_id, that one's id, null, null) of the others."""
    names = ["doc_id", "rep", "v", "cells"]
    known: dict[bytes, int] = {}
    for batch in batches:
        column = batch.column(1)
        size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=0).astype(np.int64)
        flat, begin = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(size) - size
        ids = batch.column(0).to_numpy()
        for rows, unit in unit_vectors(column):
            dim = unit.shape[1]
            raw = [v.tobytes() for v in flat[begin[rows][:, None] + np.arange(dim)]]
            rep, fresh = ids[rows], np.zeros(len(rows), bool)
            for k, v in enumerate(raw):
                n = len(known)
                rep[k] = known.setdefault(v, int(rep[k]))
                fresh[k] = len(known) > n
            if len(new := np.flatnonzero(fresh)):
                cells = (cell_code(dim, count, hits, seed, threshold).cells(unit[new]) if count > WHOLE else np.zeros((len(new), 1), np.int64)) * 4099 + dim
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[new]]), pa.nulls(len(new), pa.int64()), pa.array([raw[k] for k in new.tolist()], pa.binary()), lists], names)
            if len(old := np.flatnonzero(~fresh)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[old]]), pa.array(rep[old]), pa.nulls(len(old), pa.binary()), pa.nulls(len(old), pa.list_(pa.int64()))], names)


def _led(batches: Iterator[pa.RecordBatch], leads: dict[int, tuple[int, bytes]], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, v, cells) the links (a, b) to the leads of their cells."""
    cell = np.array(sorted(leads))
    for batch in batches:
        lists, length = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
        edge = np.cumsum(length) - length
        for rows, raw in _groups(batch.column(1), kind):
            unit, dim = _unit(raw), raw.shape[1]
            mine = np.array([c for c in cell.tolist() if c % 4099 == dim], np.int64)
            if not len(mine):
                continue
            lead, of = _unit(np.array([np.frombuffer(leads[c][1], kind) for c in mine.tolist()])), np.array([leads[c][0] for c in mine.tolist()])
            size = length[rows].astype(np.int64)
            listed, at = lists[T.ragged(edge[rows], size)], np.repeat(np.arange(len(rows)), size)
            place = np.minimum(np.searchsorted(mine, listed), len(mine) - 1)
            hot = np.flatnonzero(mine[place] == listed)
            for lo in range(0, len(hot), 16384):
                x, y = at[hot[lo : lo + 16384]], place[hot[lo : lo + 16384]]
                near = (unit[x] * lead[y]).sum(1) >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(of[y[near]]), batch.column(0).take(pa.array(rows[x[near]]))], ["a", "b"])


def _spanning(raw: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at a cosine of ``threshold`` or more that connect all rows that such pairs connect, and no more than that takes.

    Single precision rules out pairs below the threshold by more than its error; the others are taken one a row and decided in double precision.
    """
    n, dim = raw.shape
    unit = np.concatenate([_unit(raw[lo : lo + 4096]).astype(np.float32) for lo in range(0, n, 4096)])
    low = np.float32(threshold - 1e-5 - 2e-7 * dim)
    root, links = np.arange(n), []
    room = np.empty(TILE * WIDE, np.float32)
    for i in range(0, n, TILE):
        x = unit[i : i + TILE]
        for j in range(i, n, WIDE):
            y = unit[j : j + WIDE]
            s = np.matmul(x, y.T, out=room[: len(x) * len(y)].reshape(len(x), len(y)))
            if i == j:  # a row is no pair with itself
                np.fill_diagonal(s, -2)
            if s.max() < low:
                continue
            mask = (s >= low) & (root[i : i + len(x), None] != root[None, j : j + len(y)])
            while True:
                at = mask.argmax(1)
                p = np.flatnonzero(mask[np.arange(len(x)), at])
                if not len(p):
                    break
                q = at[p]
                mask[p, q] = False
                good = (_unit(raw[i + p]) * _unit(raw[j + q])).sum(1) >= threshold
                for a, b in zip((i + p[good]).tolist(), (j + q[good]).tolist()):
                    u, v = a, b
                    while root[u] != u:
                        u = root[u]
                    while root[v] != v:
                        v = root[v]
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        links.append((a, b))
                if good.any():
                    while not np.array_equal(up := root[root], root):
                        root = up
                    mask &= root[i : i + len(x), None] != root[None, j : j + len(y)]
    made = np.array(links, np.int64).reshape(-1, 2)
    return made[:, 0], made[:, 1]


def _met(batches: Iterator[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Of (cell, doc_id, v), all of a cell in one task: links (a, b) that connect what pairs of a cell connect."""
    parts: dict[int, list[tuple]] = {}
    for batch in batches:
        cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for rows, raw in _groups(batch.column(2), kind):
            parts.setdefault(raw.shape[1], []).append((cell[rows], ids[rows], raw))
    for d in list(parts):
        cell, ids, raw = (np.concatenate(x) for x in zip(*parts.pop(d)))
        order = np.argsort(cell, kind="stable")
        edge = np.concatenate(([0], np.flatnonzero(np.diff(cell[order])) + 1, [len(cell)]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            at = order[lo:hi]
            if len(at) > 1:
                a, b = _spanning(raw[at], threshold)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[a]]), pa.array(ids[at[b]])], ["a", "b"])


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, hits: float = 32.0, seed: int = 11) -> DataFrame:
    """(vec_id, kept_id, group_size): each vector that duplicates another, with the least id of its group.

    Vectors of the same length are linked at a cosine of ``threshold`` or more; groups are connected components. Two vectors
    at ``threshold`` share a cell with a probability of about ``MEET``, whatever their number and length, and always in a table of up to ``WHOLE``. Equal vectors are always found. Vectors that
    are null, empty, zero or not finite (or hold a null) belong to no group; null ids are left out; rows with the same id are one vector,
    which joins whatever any of its rows joins. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    # Single precision goes on as it is, at half the disk.
    single = isinstance(vectors.select(vector_col).schema[0].dataType.elementType, S.FloatType)
    kind, typed = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    source = vectors.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(vector_col).cast(typed).alias("v")).where("doc_id is not null and v is not null and size(v) > 0")
    count, numbers = source.agg(F.count("*"), F.sum(F.size("v"))).first()

    def parts(numbers: float) -> int:
        """Tasks for a table of so many numbers."""
        return max(math.ceil(numbers / NUMBERS), spark.sparkContext.defaultParallelism)

    def cleared() -> None:
        """What was shuffled so far leaves the disk, before more is."""
        gc.collect()
        spark._jvm.System.gc()

    rows = source.repartition(parts(numbers or 0), F.xxhash64("v")).mapInArrow(T.tidy(lambda it: _prepared(it, count, hits, seed, threshold, kind)), "doc_id bigint, rep bigint, v binary, cells array<bigint>")
    rows = scratch.save(rows, "rows")
    cleared()
    links = [rows.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))]
    reps = rows.where("rep is null").select("doc_id", "v", "cells")
    listed = reps.select("doc_id", (F.length("v") / np.dtype(kind).itemsize).cast("bigint").alias("d"), F.explode("cells").alias("cell"))
    sizes = listed.groupBy("cell").agg(F.count("*").alias("n"), F.first("d").alias("d"))
    # A cell with too many numbers for a task is cut into parts, of which any two meet.
    sizes = scratch.save(sizes.where("n > 1").withColumn("parts", F.when(F.col("n") * F.col("d") <= CELL, 1).otherwise(F.ceil(2 * F.col("n") * F.col("d") / CELL))), "sizes")
    full = {r["cell"]: r["parts"] for r in sizes.where("parts > 1").select("cell", "parts").collect()}
    for k in range(3 if full else 0):
        # Where a cell's vectors all join by way of a lead, nothing of it is left to compare.
        some = spark.createDataFrame([(c,) for c in full], "cell bigint")
        lead = reps.select("doc_id", "v", F.explode("cells").alias("cell")).join(F.broadcast(some), "cell").groupBy("cell").agg(F.min_by(F.struct("doc_id", "v"), F.xxhash64("doc_id", F.lit(k))).alias("x"))
        leads = {r["cell"]: (r["x"]["doc_id"], bytes(r["x"]["v"])) for r in lead.collect()}
        links.append(scratch.save(reps.select("doc_id", "v", "cells").mapInArrow(T.tidy(lambda it: _led(it, leads, threshold, kind)), "a bigint, b bigint"), f"leads{k}"))
        roots = components(reduce(DataFrame.union, links), scratch, f"round{k}").withColumnRenamed("node", "doc_id")
        apart = listed.join(F.broadcast(some), "cell").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")).groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        open_ = {r["cell"] for r in apart.select("cell").collect()}
        closed = full.keys() - open_
        sizes = sizes.where(~F.col("cell").isin(*closed)) if closed else sizes
        full = {c: n for c, n in full.items() if c in open_}
        if not full:
            break
    shut = sizes.agg(F.sum(F.col("n") * F.greatest(F.lit(1), F.col("parts") - 1)), F.sum(F.col("n") * F.col("d") * F.greatest(F.lit(1), F.col("parts") - 1))).first()
    total, numbers = shut[0] or 0, shut[1] or 0
    slices = max(1, math.ceil(total / (SLICE * max(count, 1))))
    cells = F.broadcast(sizes.select("cell", "parts")) if sizes.count() <= BROADCAST_IDS else sizes.select("cell", "parts")
    for k in range(slices):
        mine = reps.select("doc_id", "v", F.explode("cells").alias("cell"))
        if not full:
            mine = mine.where(F.pmod(F.xxhash64("cell"), F.lit(slices)) == k).join(cells, "cell").select("cell", "doc_id", "v")
        else:
            part = F.pmod(F.xxhash64("doc_id", F.lit(1)), "parts").cast("int")
            mine = mine.join(cells, "cell").withColumn("i", part)
            with_one = F.explode(F.expr("if(parts = 1, array(0), filter(sequence(0, cast(parts as int) - 1), j -> j <> i))"))
            mine = mine.select("cell", "doc_id", "v", "i", with_one.alias("j")).select(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "doc_id", "v").where(F.pmod(F.xxhash64("cell"), F.lit(slices)) == k)
        met = mine.repartition(parts(numbers / slices), "cell").mapInArrow(T.tidy(lambda it: _met(it, threshold, kind)), "a bigint, b bigint")
        links.append(scratch.save(met, f"links{k}"))
        del mine, met
        cleared()
    found = grouped(reduce(DataFrame.union, links), scratch)
    scratch.drop("rows", "sizes", *(f"leads{k}" for k in range(3)), *(f"links{k}" for k in range(slices)))
    return found.withColumnRenamed("doc_id", "vec_id")
