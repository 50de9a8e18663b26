"""Minimax contiguous partition of ordered groups into shards.

The smallest feasible capacity lies between the larger of mean shard and largest group, and mean plus largest
group. Greedy filling with any such capacity puts its k-th cut into a stretch of the running totals about
2 k times the largest group wide, so only those stretches, whose number of groups depends on the shards and not on the
corpus, are needed to check capacities exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .scratch import Scratch
from .tokens import with_words

#: Running totals (8 bytes each) that the driver checks capacities on at once; where more are near possible cuts, these are narrowed down first.
MAX_BOUNDARIES = 20_000_000


def greedy_cuts(totals: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """The running totals at which shards end if each takes as many groups as fit, or None if ``shards`` don't do.

    ``totals`` are the running totals after each group, in order and with the last one; some that no cut can fall on may be missing.
    """
    cuts, at = [], 0
    while at < totals[-1]:
        k = np.searchsorted(totals, at + capacity, "right") - 1
        if k < 0 or totals[k] <= at or len(cuts) == shards:
            return None
        at = int(totals[k])
        cuts.append(at)
    return cuts


def smallest_capacity(totals: np.ndarray, low: int, high: int, shards: int) -> tuple[int, list[int]]:
    """The least feasible capacity between ``low`` and ``high`` by bisection, and its cuts."""
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(totals, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, greedy_cuts(totals, low, shards) or []


def _running(sizes: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``sizes`` in order of key with ``total``, the running total up to and with each group: within range partitions, then over them."""
    ranged = sizes.repartitionByRange(F.col(key)).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("p"))
    ranged = scratch.save(ranged, "ranged")
    parts = ranged.groupBy("p").agg(F.sum("size").alias("s")).orderBy("p").collect()  # one row for each partition
    before, offsets = 0, []
    for r in parts:
        offsets.append((r["p"], before))
        before += r["s"]
    table = F.broadcast(scratch.spark.createDataFrame(offsets, "p int, before bigint"))
    return ranged.join(table, "p").select(key, "size", (F.col("before") + F.sum("size").over(Window.partitionBy("p").orderBy(key))).alias("total"))


def minimax_shards(docs: DataFrame, shards: int = 64, group_col: str = "doc_id", text_col: str = "text", max_boundaries: int = MAX_BOUNDARIES) -> DataFrame:
    """(group, size, shard, capacity) for every value of ``group_col`` in order: contiguous shards whose largest is as small as can be.

    The group column is an integer or a string; rows with the same value are one atomic group, null is a group and comes first. The size is the
    number of words; groups without a word have size 0 and go to the shard that is open after the groups before them
    (the first shard if there are none). ``capacity`` is the least possible largest shard; each shard takes as many groups as
    fit. Fewer shards may be used than allowed. Other columns are ignored. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    scratch = Scratch(docs.sparkSession)
    counted = with_words(docs.select(F.col(group_col).alias("group"), F.col(text_col).alias("__lf_body")), "__lf_body", ["group"])
    sizes = counted.groupBy("group").agg(F.sum("tokens").alias("size"))
    running = scratch.save(_running(sizes, "group", scratch), "running")
    whole, largest = running.agg(F.sum("size"), F.max("size")).first()
    if not whole:
        return running.select("group", "size", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("capacity"))
    low = max(largest, -(-whole // shards))
    high = -(-whole // shards) + largest
    # With a capacity c a shard but the last is filled above c - largest, so cut k is in (k (low - largest), k high].
    spans: list[list[int]] = []
    for k in range(1, shards + 1):
        a, b = k * (low - largest), min(whole, k * high)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        elif a < whole:
            spans.append([a, b])
    scan = running.where("size > 0")
    wanted = _within(scan, spans, whole)
    if wanted.count() > max_boundaries:
        low, high, spans = _narrowed(scan, int(low), int(high), int(whole), shards, max(shards, max_boundaries // 4))
        wanted = _within(scan, spans, whole)
        if (n := wanted.count()) > max_boundaries:
            raise ValueError(f"{n} boundaries to check; raise max_boundaries or ask for fewer than {shards} shards")
    totals = np.sort(wanted.toPandas()["total"].to_numpy(np.int64))
    capacity, cuts = smallest_capacity(totals, int(low), int(high), shards)
    ends = np.array(cuts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.searchsorted(ends, batch.column(2).to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard), pa.array(np.full(len(shard), capacity))], ["group", "size", "shard", "capacity"])

    kind = running.schema["group"].dataType.simpleString()
    return running.select("group", "size", "total").mapInArrow(T.tidy(place), f"group {kind}, size bigint, shard int, capacity bigint")


def _within(scan: DataFrame, spans: list[list[int]], whole: int) -> DataFrame:
    """The running totals that lie in any of the (ascending, disjoint) spans, and the last."""
    starts, ends = np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(0).to_numpy(zero_copy_only=False)
            k = np.searchsorted(starts, total, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(total[((k >= 0) & (total <= ends[k])) | (total == whole)])], ["total"])

    return scan.select("total").mapInArrow(T.tidy(run), "total bigint")


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _narrowed(scan: DataFrame, low: int, high: int, whole: int, shards: int, pieces: int) -> tuple[int, int, list[list[int]]]:
    """Bounds of the least capacity, and spans of the cuts of all capacities between, from the boundaries around each of ``pieces`` equal steps.

    Left out between two kept boundaries are only stretches below one step ``g``. So capacities that do with the kept boundaries do, and those that do
    with all do with the kept ones and g more; a cut is at least where the kept boundaries put it, and below where they put it with g more, plus g.
    """
    g = max(1, whole // pieces)
    crossing = scan.where(F.expr(f"total div {g} > (total - size) div {g}"))
    rows = crossing.select("total", (F.col("total") - F.col("size")).alias("before")).toPandas()
    kept = np.unique(np.concatenate((rows["total"].to_numpy(np.int64), rows["before"].to_numpy(np.int64), [whole])))
    kept = kept[kept > 0]
    best, _ = smallest_capacity(kept, low, high + g, shards)
    low, high = max(low, best - g), min(high, best)
    reach = lambda c: (greedy_cuts(kept, c, 1 << 40) or []) + [whole] * shards
    return low, high, _merged([[a, min(whole, b + g)] for a, b in zip(reach(low)[:shards], reach(high + g)[:shards])])
