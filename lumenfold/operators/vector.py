"""Exact and clustered nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenfold.functions.vectors import angle

#: Bounds of a cluster's size, as the index keeps them.
TARGET, MOST, LEAST = 64, 128, 16
#: Rows of a group that one worker cuts into clusters, and pivots that a larger group is split by.
GROUP, FAN = 20_000, 64
#: Centroids that rows are compared with at once.
ASSIGNED = 50_000


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``dim`` values, and their values."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    rows = np.flatnonzero(size == dim)
    return rows, flat[begin[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))


def with_cosine(df: DataFrame, vector_col: str, query: Sequence[float], name: str = "cosine") -> DataFrame:
    """``df`` with the cosine to ``query``: 0 for null, empty, zero and vectors of another length. Arrow batches, one matrix product each."""
    q = np.asarray(query, float)
    n = np.linalg.norm(q)
    unit = q / n if n > 0 else q
    at = df.columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            rows, x = _matrix(batch.column(at), len(unit))
            norms = np.sqrt((x * x).sum(1))
            with np.errstate(invalid="ignore"):
                out[rows] = np.where(norms > 0, x @ unit / np.where(norms > 0, norms, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def exact_knn(df: DataFrame, id_col: str, vector_col: str, query: Sequence[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """(id, cosine) of the k nearest rows that pass ``where``; ties by id. The filter comes first, so k rows survive it."""
    kept = df if where is None else df.where(where)
    near = with_cosine(kept.where(F.col(vector_col).isNotNull()).select(id_col, vector_col), vector_col, query)
    return near.select(id_col, "cosine").orderBy(F.desc("cosine"), id_col).limit(k)


def pure_score(cosine: Column) -> Column:
    """The score of a query without text."""
    return (cosine + 1.0) * 10.0


def hybrid(lexical: DataFrame, near: DataFrame, id_col: str, weight: float = 0.5) -> DataFrame:
    """(id, score) of the lexical hits: blended with 100 times the cosine where the neighbour list has them, else as they are."""
    both = lexical.select(id_col, "score").join(F.broadcast(near.select(id_col, "cosine")), id_col, "left")  # at most k rows
    return both.select(id_col, F.when(F.col("cosine").isNull(), F.col("score")).otherwise((1 - weight) * F.col("score") + weight * 100.0 * F.col("cosine")).alias("score"))


def bisect(unit: np.ndarray, rng: np.random.Generator, rounds: int = 20, rebalance: int = 10, ratio: float = 2.0) -> np.ndarray:
    """Halves rows by spherical 2-means from a far pair, moving border rows while one side is more than ``ratio`` times the other."""
    a = unit[rng.integers(len(unit))]
    a = unit[np.argmin(unit @ a)]
    b = unit[np.argmin(unit @ a)]
    side = np.zeros(len(unit), bool)
    for _ in range(rounds):
        new = unit @ b > unit @ a
        if np.array_equal(new, side) and new.any():
            break
        side = new
        if side.all() or not side.any():
            break
        a, b = unit[~side].mean(0), unit[side].mean(0)
        a, b = a / max(np.linalg.norm(a), 1e-12), b / max(np.linalg.norm(b), 1e-12)
    margin = unit @ b - unit @ a
    for _ in range(rebalance):
        n = side.sum()
        if min(n, len(side) - n) * ratio >= max(n, len(side) - n):
            return side
        half = np.zeros(len(side), bool)
        small = int(np.ceil(len(side) / (1 + ratio)))
        order = np.argsort(-margin, kind="stable")
        half[order[: small if n < len(side) - n else len(side) - small]] = True
        side = half
    return side


def _clusters(unit: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Labels of clusters of at most ``most`` rows, by recursive bisection."""
    labels, todo, count = np.zeros(len(unit), np.int64), [np.arange(len(unit))], 0
    rng = np.random.default_rng(seed)
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            labels[rows] = count
            count += 1
            continue
        side = bisect(unit[rows], rng)
        if side.all() or not side.any():
            side = np.arange(len(rows)) < len(rows) // 2
        todo += [rows[side], rows[~side]]
    return labels


@dataclass
class ClusterIndex:
    """``members`` (cluster, id, v unit vector) and ``centroids`` (cluster, centroid, radius angle, n)."""

    members: DataFrame
    centroids: DataFrame
    id_col: str

    @staticmethod
    def build(df: DataFrame, id_col: str, vector_col: str, most: int = MOST, group: int = GROUP, seed: int = 7) -> ClusterIndex:
        """Clusters of at most ``most``: rows are split by near pivots, level by level, to groups of about ``group``, and each group by bisection in one worker.

        A level draws up to FAN pivots from each group that is still too large, so nothing that grows with the table reaches the driver. Of rows with one id each is a member.
        """
        rows = df.where(f"size({vector_col}) > 0").select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        kind = rows.schema["id"].dataType.simpleString()
        schema = f"id {kind}, v array<double>, pivot bigint"
        grouped, largest = rows.select("id", _unit("v").alias("v"), F.lit(0).cast("bigint").alias("pivot")), None
        while True:
            sizes = grouped.groupBy("pivot").agg(F.count("*").alias("n"))
            now = sizes.agg(F.max("n")).first()[0] or 0
            if now <= group or now == largest:
                break
            first, largest = largest is None, now
            drawn = Window.partitionBy("pivot").orderBy(F.xxhash64("id", F.lit(seed)), "id")
            pivots = grouped.join(sizes.where(F.col("n") > group), "pivot", "left_semi").withColumn("k", F.row_number().over(drawn)).where(F.col("k") <= FAN).groupBy("pivot").agg(F.sort_array(F.collect_list("v")).alias("near"))
            # The first level has FAN vectors; later ones have as many for each group and meet them by shuffle.
            grouped = grouped.join(F.broadcast(pivots) if first else pivots, "pivot", "left").select("id", "v", "pivot", "near").mapInArrow(_nearest, schema)

        def cut(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("id", kind="stable").reset_index(drop=True)
            labels = _clusters(np.stack(part["v"].to_list()), most, seed) if part["v"].map(len).nunique() == 1 else np.arange(len(part))
            return pd.DataFrame({"cluster": part["pivot"] * (1 << 24) + labels, "id": part["id"], "v": part["v"]})

        members = grouped.groupBy("pivot").applyInPandas(cut, f"cluster bigint, id {kind}, v array<double>")
        return ClusterIndex(members, centroids(members), id_col)

    def save(self, path: str) -> ClusterIndex:
        self.members.repartition("cluster").sortWithinPartitions("cluster").write.mode("overwrite").parquet(f"{path}/members")
        members = self.members.sparkSession.read.parquet(f"{path}/members")
        centroids(members).write.mode("overwrite").parquet(f"{path}/centroids")
        return ClusterIndex(members, members.sparkSession.read.parquet(f"{path}/centroids"), self.id_col)

    @staticmethod
    def open(spark, path: str, id_col: str) -> ClusterIndex:
        return ClusterIndex(spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/centroids"), id_col)

    def probed(self, query: Sequence[float], n_probe: int, per_segment: bool = False) -> DataFrame:
        """(cluster): the ``n_probe`` clusters with the least bound max(0, angle - radius), which no member is nearer than; by plain angle with ``per_segment``."""
        q = F.array(*[F.lit(float(x)) for x in query])
        bound = angle(F.col("centroid"), q) if per_segment else F.greatest(F.lit(0.0), angle(F.col("centroid"), q) - F.col("radius"))
        return self.centroids.withColumn("bound", bound).orderBy("bound", "cluster").limit(n_probe).select("cluster")

    def knn(self, query: Sequence[float], k: int = 10, n_probe: int = 16, where: DataFrame | None = None) -> DataFrame:
        """(id, cosine) of the k nearest members of the probed clusters; ``where`` has the ids that may be returned."""
        found = self.members.join(F.broadcast(self.probed(query, n_probe)), "cluster", "left_semi")  # at most n_probe rows
        if where is not None:
            found = found.join(where.select(F.col(self.id_col).alias("id")), "id", "left_semi")
        return exact_knn(found, "id", "v", query, k).withColumnRenamed("id", self.id_col)

    def proven(self, query: Sequence[float], k: int = 10, n_probe: int = 16, where: DataFrame | None = None) -> DataFrame:
        """(id, cosine) of the exact k nearest: probes are doubled until the clusters left out are all farther, by their bounds, than the k-th found."""
        q = F.array(*[F.lit(float(x)) for x in query])
        bound = F.greatest(F.lit(0.0), angle(F.col("centroid"), q) - F.col("radius"))
        clusters = self.centroids.count()
        while True:
            found = self.knn(query, k, n_probe, where)
            if n_probe >= clusters:
                return found
            rows = found.collect()  # k rows
            if len(rows) == k:
                farthest = float(np.arccos(np.clip(rows[-1]["cosine"], -1, 1)))
                # As near as the k-th counts: it may have the lesser id.
                needed = self.centroids.where(bound <= farthest + 1e-9).count()
                if needed <= n_probe:
                    return self.members.sparkSession.createDataFrame(rows, found.schema)
            n_probe *= 2

    def insert(self, df: DataFrame, id_col: str, vector_col: str) -> ClusterIndex:
        """Adds rows to their nearest clusters; clusters above the bound are cut."""
        new = df.where(f"size({vector_col}) > 0").select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return ClusterIndex(_assign(new, self.centroids).union(self.members), self.centroids, self.id_col).rebalanced()

    def delete(self, ids: DataFrame) -> ClusterIndex:
        members = self.members.join(ids.select(F.col(self.id_col).alias("id")), "id", "left_anti").select("cluster", "id", "v")
        return ClusterIndex(members, centroids(members), self.id_col).rebalanced()

    def rebalanced(self, most: int = MOST, least: int = LEAST, seed: int = 7) -> ClusterIndex:
        """Members of clusters below ``least`` move to the nearest other cluster, then clusters above ``most`` are cut."""
        sizes = self.members.groupBy("cluster").agg(F.count("*").alias("n"))
        small = self.members.join(sizes.where(F.col("n") < least), "cluster", "left_semi")
        large = sizes.where(F.col("n") >= least)
        kept = self.members.join(large, "cluster", "left_semi").select("cluster", "id", "v")
        target = centroids(kept)
        if not large.isEmpty():
            kept = kept.union(_assign(small.select("id", "v"), target))
        else:
            kept = self.members
        kind = kept.schema["id"].dataType.simpleString()

        def cut(part: pd.DataFrame) -> pd.DataFrame:
            if len(part) <= most:
                return part[["cluster", "id", "v"]]
            part = part.sort_values("id", kind="stable").reset_index(drop=True)
            labels = _clusters(np.stack(part["v"].to_list()), most, seed)
            # The part that keeps the number is label 0; the others' numbers depend on the old one only.
            return pd.DataFrame({"cluster": [int(c) if l == 0 else hash((int(c), int(l), len(part))) & ((1 << 62) - 1) for c, l in zip(part["cluster"], labels)], "id": part["id"], "v": part["v"]})

        members = kept.groupBy("cluster").applyInPandas(cut, f"cluster bigint, id {kind}, v array<double>")
        return ClusterIndex(members, centroids(members), self.id_col)

    def reassigned(self) -> ClusterIndex:
        """Every member in the cluster of its nearest centroid."""
        members = _assign(self.members.select("id", "v"), self.centroids)
        return ClusterIndex(members, centroids(members), self.id_col)

    def stats(self) -> DataFrame:
        return self.centroids.agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def centroids(members: DataFrame) -> DataFrame:
    """(cluster, centroid, radius, n): mean of the unit vectors and the largest angle to it."""
    mean = members.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    mean = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return members.join(mean, "cluster").groupBy("cluster").agg(F.first("centroid").alias("centroid"), F.max(angle(F.col("v"), F.col("centroid"))).alias("radius"), F.count("*").alias("n"))


def _unit(name: str) -> Column:
    norm = F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(name, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, pivot, near): a row moves to the nearest of the vectors in ``near``, if there are any."""
    for batch in batches:
        pivot, near, v = batch.column(2).to_pylist(), batch.column(3), batch.column(1)
        known: dict[int, np.ndarray] = {}
        for i, p in enumerate(pivot):
            if p not in known and near[i].is_valid:
                known[p] = np.array([x for x in near[i].as_py() if len(x) == len(v[i])])
        out = np.array(pivot, np.int64)
        for p, c in known.items():
            if len(c):
                at = np.flatnonzero(np.array(pivot) == p)
                rows, x = _matrix(v.take(pa.array(at)), c.shape[1])
                out[at[rows]] = p * FAN + 1 + np.argmax(x @ c.T, 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(out)], ["id", "v", "pivot"])


def _assign(rows: DataFrame, target: DataFrame, most: int = ASSIGNED) -> DataFrame:
    """(cluster, id, v): each row in the cluster of the nearest centroid; ``most`` centroids at a time go to the workers, in one stage without a shuffle."""
    kind = rows.schema["id"].dataType.simpleString()
    parts = -(-target.count() // most)
    if not parts:
        return rows.select(F.lit(0).cast("bigint").alias("cluster"), "id", "v")
    schema = f"cluster bigint, id {kind}, v array<double>, best double"
    out = rows.select(F.lit(0).cast("bigint").alias("cluster"), "id", _unit("v").alias("v"), F.lit(-9.0).alias("best"))
    for k in range(parts):
        near = target.where(F.pmod(F.xxhash64("cluster"), F.lit(parts)) == k).select("cluster", "centroid").orderBy("cluster").collect()

        def run(batches: Iterator[pa.RecordBatch], near=near) -> Iterator[pa.RecordBatch]:
            names, c = np.array([r["cluster"] for r in near], np.int64), np.array([r["centroid"] for r in near])
            for batch in batches:
                cluster, best = (batch.column(j).to_numpy(zero_copy_only=False).copy() for j in (0, 3))
                if len(near):
                    unit = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
                    at, x = _matrix(batch.column(2), unit.shape[1])
                    s = x @ unit.T
                    j = np.argmax(s, 1)
                    found = s[np.arange(len(at)), j]
                    better = found > best[at]
                    cluster[at[better]], best[at[better]] = names[j[better]], found[better]
                yield pa.RecordBatch.from_arrays([pa.array(cluster), batch.column(1), batch.column(2), pa.array(best)], ["cluster", "id", "v", "best"])

        out = out.mapInArrow(run, schema)
    return out.where("best > -9").select("cluster", "id", "v")


def probe_budget(requested: int, clusters: int) -> int:
    """Clusters to look at: as many as requested, or 5 % of all where that is more (20,000 at most)."""
    return max(requested, min(-(-clusters * 5 // 100), 20_000))
