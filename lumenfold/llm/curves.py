"""Approximate nearest neighbours on shifted space-filling curves.

Each curve orders all vectors by the Hilbert key of a random projection with a random shift, range-partitioned in
Spark. A query's candidates are those in its own and the neighbouring blocks of every curve: every vector goes to its block
once a curve, and queries go to all blocks in their reach. The lists of all blocks are merged and ranked by cosine. How many blocks
are looked at follows from the recall that a sample of queries measures against brute force on these data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .capfilter import unit_vectors
from .scratch import Scratch

U = np.uint64
#: Queries that meet a block in one task, and vectors of the block that they are multiplied with at once.
ASKED, AT_ONCE = 2048, 1024


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n x dims), coordinates below 2**bits; dims * bits is 63 at most."""
    x = cells.astype(U).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = U(q - 1)
        for i in range(dims):
            high = (x[i] & U(q)) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], U)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & U(q)) > 0, t ^ U(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], U)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << U(1) | (x[i] >> U(b)) & U(1)
    return key.astype(np.int64)


def curve_keys(unit: np.ndarray, curve: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Hilbert keys of ``unit`` vectors on one curve: its own projection, spread evenly, and shifted in a wider grid."""
    d = unit.shape[1]
    rng = np.random.default_rng([seed, curve, d])
    base = np.linalg.qr(rng.standard_normal((d, min(dims, d))))[0]
    even = 1 / (1 + np.exp(-1.702 * np.sqrt(d) * (unit @ base)))
    shifted = (even + rng.random(base.shape[1])) / 2
    return hilbert_keys(np.minimum((shifted * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def _keys(batches: Iterator[pa.RecordBatch], curves: int, dims: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, unit in unit_vectors(batch.column(1)):
            ids = batch.column(0).take(pa.array(rows))
            for c in range(curves):
                n = len(rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, c, np.int32)), pa.array(np.full(n, unit.shape[1], np.int32)), pa.array(curve_keys(unit, c, dims, bits, seed))], ["id", "curve", "dim", "key"])


def top(queries: np.ndarray, qid: np.ndarray, found: np.ndarray, fid: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (cosine, id) of each query among ``found`` and those ``held`` from before; never the query's own id; ties by id."""
    s = queries @ found.T
    s[qid[:, None] == fid[None, :]] = -9
    if k < len(fid):
        # All that don't round below the k-th, however many; by cosine and id the k best of each query stay.
        least = -np.partition(-s, k - 1, 1)[:, k - 1] - 2e-9
        q, j = np.nonzero(s >= least[:, None])
        o = np.lexsort((fid[j], -np.round(s[q, j], 9), q))
        o = o[np.arange(len(q)) - np.searchsorted(q, q) < k]
        s, ids = s[q[o], j[o]].reshape(len(qid), k), fid[j[o]].reshape(len(qid), k)
    else:
        ids = np.tile(fid, (len(qid), 1))
    if held is not None:
        s, ids = np.concatenate((held[0], s), 1), np.concatenate((held[1], ids), 1)
    o = np.lexsort((ids, -np.round(s, 9)), axis=1)[:, :k]
    return np.take_along_axis(s, o, 1), np.take_along_axis(ids, o, 1)


def _rows(qid: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    s, ids = held
    ok = s > -9
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, ok.sum(1))), pa.array(ids[ok]), pa.array(s[ok])], ["id", "neighbour", "cosine"])


def _brute(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        all_ids = batch.column(0).to_numpy(zero_copy_only=False)
        for rows, unit in unit_vectors(batch.column(1)):
            d = unit.shape[1]
            if d in queries:
                for lo in range(0, len(rows), 4096):
                    held[d] = top(queries[d][1], queries[d][0], unit[lo : lo + 4096], all_ids[rows[lo : lo + 4096]], k, held.get(d))
    for d, best in held.items():
        yield _rows(queries[d][0], best)


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, whether a candidate, id, v) in order of group, its queries first; the k best candidates of each query in each group."""
    group, asked, waiting, held, unit = None, [], [], None, None

    def score() -> None:
        nonlocal held, waiting
        if asked and waiting:
            held = top(unit, np.array([i for i, _ in asked]), np.stack([v for _, v in waiting]), np.array([i for i, _ in waiting]), k, held)
        waiting = []

    for batch in batches:
        groups, candidate, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
        lists = batch.column(3)
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        for i in range(batch.num_rows):
            if groups[i] != group:
                score()
                if held is not None:
                    yield _rows(np.array([x for x, _ in asked]), held)
                group, asked, held, unit = groups[i], [], None, None
            v = flat[at[i] : at[i + 1]]
            if not candidate[i]:
                asked.append((ids[i], v))
            elif asked:  # a block that no query reaches isn't looked at
                unit = np.stack([x for _, x in asked]) if unit is None else unit
                waiting.append((ids[i], v))
                if len(waiting) == AT_ONCE:
                    score()
    score()
    if held is not None:
        yield _rows(np.array([x for x, _ in asked]), held)


def with_copies(ranked: DataFrame, wanted: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of the vectors ``wanted`` (id, rep), from those of one of each set of equal vectors; ``copies`` (id, rep) has the sets of several.

    The k best of a vector lie in its own set and in the k best others by cosine and least id, and are the least ids of each.
    """
    order = F.desc(F.round("cosine", 9)), "neighbour"
    # Slots of k + 1 least ids: a sort within hashed parts of a set first, so that no large set is sorted in one task.
    part = copies.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(Window.partitionBy("rep", "part").orderBy("id"))).where(F.col("n") <= k + 1)
    first = part.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select("rep", F.col("id").alias("copy"))
    others = ranked.join(first.withColumnRenamed("rep", "neighbour"), "neighbour", "left").select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "cosine")
    own = first.join(wanted.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), F.col("copy").alias("neighbour"), F.lit(1.0).alias("cosine"))
    lists = others.union(own).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("n") <= k + 1).select(F.col("id").alias("rep"), "neighbour", "cosine")
    found = wanted.join(lists, "rep").where("id <> neighbour")
    return found.select("id", "neighbour", "cosine", F.row_number().over(Window.partitionBy("id").orderBy(*order)).alias("rank")).where(F.col("rank") <= k)


def cheapest_plan(apart: np.ndarray, blocks: int, recall: float) -> tuple[int, int, int]:
    """(blocks looked at for a query, curves, reach): the cheapest with which the share ``recall`` of the sampled neighbours, ``apart`` by so many blocks on each curve, is in reach."""
    plans = []
    for c in range(1, apart.shape[1] + 1):
        reach = int(np.quantile(apart[:, :c].min(1), recall, method="higher")) if len(apart) else 0
        plans.append((c * min(2 * reach + 1, blocks), c, reach))
    return min(plans)


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 1, recall: float = 0.95, curves: int = 4, dims: int = 8, bits: int = 7, block: int = 256, sample: int = 256, seed: int = 5, told: list | None = None) -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine): the k nearest of every vector whose id is divisible by ``every``, among all, with a mean recall of about ``recall``.

    Up to ``curves`` curves are laid over all vectors. ``sample`` vectors (those with the least id hashes) are answered by brute force, and the
    number of curves and of blocks to either side that is cheapest while the sample's neighbours are within reach at the
    rate ``recall`` is used for all queries; ``told`` gets (blocks looked at for a query, curves, reach, all blocks). On data without structure
    that comes close to comparing each query with all vectors; it is never less.
    Ties go to the lesser id; equal vectors are searched as one, so all of them are found. Vectors that are null, empty, zero or not finite (or hold a null) are no neighbours and have none; null ids are
    left out; of rows with the same id the least vector counts. Vectors of different lengths aren't compared. A query has fewer than k rows only if
    there are too few others in reach. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    source = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    single = scratch.save(source.groupBy("id").agg(F.min("v").alias("v")), "single")
    # Equal vectors are searched as one, that with the least id, and come back at the end.
    source = scratch.save(single.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("c")), "source")
    copies = scratch.save(single.join(source.where("c > 1").select("v", F.col("id").alias("rep")), "v").select("id", "rep"), "copies")
    asking = (F.col("id") % every) == 0
    wanted = source.where((F.col("c") == 1) & asking).select("id", F.col("id").alias("rep")).union(copies.where(asking).select("id", "rep"))
    source = source.select("id", "v")
    keyed = source.mapInArrow(T.tidy(lambda it: _keys(it, curves, dims, bits, seed)), "id bigint, curve int, dim int, key bigint")
    ranged = scratch.save(keyed.repartitionByRange("curve", "dim", "key", "id").sortWithinPartitions("curve", "dim", "key", "id").withColumn("p", F.spark_partition_id()), "ranged")
    # One row for each partition and curve; from these a vector's block on the curve.
    counts = ranged.groupBy("curve", "dim", "p").count().orderBy("curve", "dim", "p").collect()
    before: dict = {}
    offsets = []
    for r in counts:
        c = r["curve"], r["dim"]
        offsets.append((*c, r["p"], before.get(c, 0)))
        before[c] = before.get(c, 0) + r["count"]
    if not offsets:
        return spark.createDataFrame([], "vec_id bigint, neighbour_id bigint, rank int, cosine double")
    table = F.broadcast(spark.createDataFrame(offsets, "curve int, dim int, p int, before bigint"))
    within = Window.partitionBy("curve", "dim", "p").orderBy("key", "id")
    placed = ranged.join(table, ["curve", "dim", "p"]).select("id", "curve", "dim", F.floor((F.col("before") + F.row_number().over(within) - 1) / block).cast("int").alias("block"))
    placed = scratch.save(placed, "placed")
    asked = source.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toPandas()
    queries: dict = {}
    for d in asked["v"].map(len).unique():
        some = asked[asked["v"].map(len) == d]
        queries[int(d)] = some["id"].to_numpy(np.int64), np.concatenate([u for _, u in unit_vectors(pa.array(some["v"].to_list()))])
    best = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "neighbour")
    exact = source.mapInArrow(T.tidy(lambda it: _brute(it, queries, k)), "id bigint, neighbour bigint, cosine double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "neighbour").toPandas()
    near = np.unique(np.concatenate((exact["id"], exact["neighbour"]))) if len(exact) else np.zeros(0, np.int64)
    # At most ``sample`` * (k + 1) ids.
    few = placed.join(F.broadcast(spark.createDataFrame([(int(i),) for i in near], "id bigint")), "id").select("id", "curve", "block").toPandas()
    pos = {(int(i), int(c)): int(b) for i, c, b in few.itertuples(index=False, name=None)}
    apart = np.array([[abs(pos[i, c] - pos[j, c]) for c in range(curves)] for i, j in exact.itertuples(index=False, name=None)], np.int64).reshape(-1, curves)
    blocks = (max(before.values()) - 1) // block + 1
    looked, used, reach = cheapest_plan(apart, blocks, recall)
    if told is not None:
        told.append((looked, used, reach, blocks))
    units = source.mapInArrow(T.tidy(_units), "id bigint, v array<double>")
    own = placed.where(F.col("curve") < used)
    to = F.explode(F.sequence(F.greatest(F.lit(0), F.col("block") - reach), F.least(F.col("block") + reach, F.lit(blocks - 1)))).alias("block")
    # More queries than one task takes come in parts, each of which meets the whole block.
    parts = max(1, -(-(2 * reach + 1) * block // (every * ASKED)))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    sent = own.join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("curve", "dim", to, part, F.lit(False).alias("candidate"), "id")
    rows = own.select("curve", "dim", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("candidate"), "id")
    sent = sent.unionByName(rows).join(units, "id").select(F.xxhash64("curve", "dim", "block", "part").alias("g"), "candidate", "id", "v")
    lists = sent.repartition("g").sortWithinPartitions("g", "candidate").mapInArrow(T.tidy(lambda it: _blocks(it, k)), "id bigint, neighbour bigint, cosine double")
    ranked = lists.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.select("id", "neighbour", "cosine", "rank")
    if not copies.isEmpty():
        ranked = with_copies(ranked, wanted, copies, k)
    return ranked.select(F.col("id").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), "rank", F.round("cosine", 5).alias("cosine"))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, unit in unit_vectors(batch.column(1)):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * unit.shape[1]), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["id", "v"])
