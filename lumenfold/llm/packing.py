"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are hashed to independent problems of bounded size. Several islands evolve each problem: a crossover
injects whole well-filled bins of one parent into the other, drops the other's bins that hold any of the same
documents, and best-fits what this displaced. After each epoch an island's elite migrates to its neighbour.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .scratch import Scratch
from .tokens import with_words


#: Copies of a row that are laid out together; how far the order of displaced documents strays from that of their sizes.
PART, NOISE = 1000, 0.3


def best_fit(sizes: list[int], items: list[int], capacity: int, room: list[int], bins: np.ndarray, rng: np.random.Generator | None = None) -> None:
    """Puts ``items``, largest first, into the fullest bin that has room, or a new one; changes ``room`` and ``bins``.

    With ``rng`` sizes count up to NOISE more in the order, so that the same items don't always meet again in the same bins.
    """
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    noise = (1 + NOISE * rng.random(len(items))).tolist() if rng is not None else [1.0] * len(items)
    for _, i in sorted((-sizes[i] * x, i) for i, x in zip(items, noise)):
        s = sizes[i]
        k = bisect_left(free, (s, -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        room[b] = r - s
        if r > s:
            insort(free, (r - s, b))


def crossover(sizes: np.ndarray, listed: list[int], capacity: int, into: np.ndarray, other: np.ndarray, rng: np.random.Generator, share: float = 0.05) -> np.ndarray:
    """A child of ``into`` that has some whole well-filled bins of ``other``."""
    fill = np.bincount(other, sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[good[rng.random(len(good)) < share]] = True
    injected = chosen[other]
    hit = np.zeros(into.max() + 1, bool)
    hit[into[injected]] = True
    displaced = hit[into] & ~injected
    stays = ~hit[into]
    child = np.full(len(sizes), -1)
    kept = np.unique(into[stays], return_inverse=True)[1] if stays.any() else np.zeros(0, int)
    child[stays] = kept
    base = int(kept.max()) + 1 if len(kept) else 0
    child[injected] = np.unique(other[injected], return_inverse=True)[1] + base if injected.any() else 0
    some = child >= 0
    room = (capacity - np.bincount(child[some], sizes[some])).astype(int).tolist() if some.any() else []
    best_fit(listed, np.flatnonzero(displaced).tolist(), capacity, room, child, rng)
    return child


def mutate(sizes: np.ndarray, listed: list[int], capacity: int, parent: np.ndarray, rng: np.random.Generator, share: float = 0.3) -> np.ndarray:
    """Empties the least filled bin and a random ``share`` of the others that aren't full, and best-fits their documents again."""
    fill = np.bincount(parent, sizes)
    gone = (rng.random(len(fill)) < share) & (fill < capacity)
    gone[np.argmin(fill)] = True
    out = gone[parent]
    child = np.full(len(sizes), -1)
    child[~out] = np.unique(parent[~out], return_inverse=True)[1] if (~out).any() else 0
    room = (capacity - np.bincount(child[~out], sizes[~out])).astype(int).tolist() if (~out).any() else []
    items = np.flatnonzero(out).tolist()
    best_fit(listed, items, capacity, room, child, rng)
    return child


def best_possible(total: int, capacity: int) -> float:
    """The fitness of packing where all bins but one are full, which no packing of ``total`` exceeds."""
    full, rest = divmod(total, capacity)
    return (full + (rest / capacity) ** 2) / max(full + (rest > 0), 1)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill: fewer bins and more uneven ones are better."""
    fill = np.bincount(bins, sizes) / capacity
    return float((fill**2).mean()) if len(fill) else 1.0


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], size: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, the best first."""
    listed = sizes.tolist()
    goal = best_possible(int(sizes.sum()), capacity) - 1e-12
    pool = [(fitness(sizes, b, capacity), b) for b in population]
    if not pool:
        first = np.full(len(sizes), -1)
        best_fit(listed, list(range(len(sizes))), capacity, [], first)
        pool.append((fitness(sizes, first, capacity), first))
    while len(pool) < size:
        b = mutate(sizes, listed, capacity, pool[0][1], rng)
        pool.append((fitness(sizes, b, capacity), b))
    pool.sort(key=lambda x: -x[0])
    for _ in range(generations):
        if pool[0][0] >= goal:
            break  # no packing is fitter
        a, b = sorted(rng.choice(len(pool), 2, replace=False))
        child = crossover(sizes, listed, capacity, pool[a][1], pool[b][1], rng)
        if rng.random() < 0.5:
            child = mutate(sizes, listed, capacity, child, rng)
        f = fitness(sizes, child, capacity)
        if f > pool[-1][0] and all(f != x for x, _ in pool):
            pool[-1] = f, child
            pool.sort(key=lambda x: -x[0])
    return [b for _, b in pool]


def _epoch(batches: Iterator[pa.RecordBatch], capacity: int, population: int, generations: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for problem, island, sizes, elites in zip(*(c.to_pylist() for c in batch.columns)):
            sizes = np.array(sizes, np.int64)
            rng = np.random.default_rng([seed, problem & 0x7FFFFFFF, island])
            pool = evolve(sizes, capacity, [np.array(e, np.int64) for e in elites or []], population, generations, rng)
            out.append((problem, island, [b.tolist() for b in pool[:2]], int(pool[0].max(initial=-1)) + 1, fitness(sizes, pool[0], capacity)))
        cols = list(zip(*out)) or [()] * 5
        types = [pa.int64(), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["problem", "island", "elites", "bins", "fitness"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, problem_size: int = 1000, islands: int = 3, epochs: int = 2, generations: int = 30, population: int = 4, seed: int = 1) -> DataFrame:
    """(bin_id, slot, doc_id, start_word, n_words): where every piece of every row's text goes.

    Texts longer than ``capacity`` words are cut into pieces of ``capacity`` and a rest; a full piece is a bin of its own. Every
    word of every row is in exactly one piece, and no bin holds more than ``capacity``. Rows are packed row by row, so repeated rows
    and ids appear as often as they came. Texts without a word (null, empty) have no piece. Null ids are packed like any other.
    Other columns are ignored. A bin holds documents of one problem of about ``problem_size`` pieces. Bins are as few as the search finds, and of as many
    the most uneven ones win, so that room is left in few bins. The result depends on the rows alone, not on their order or partitions: equal fitness goes to the lower island.
    """
    scratch = Scratch(docs.sparkSession)
    counted = with_words(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("__lf_body")), "__lf_body", ["doc_id"]).where("tokens > 0")
    # Rows of one id and size are interchangeable: they are counted, and numbered when they are laid out again, in parts of bounded length.
    same = scratch.save(counted.groupBy("doc_id", "tokens").agg(F.count("*").alias("c")), "same")
    parts = same.select("doc_id", "tokens", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("c") - 1) / PART))).alias("part")).repartition("doc_id", "tokens", "part")
    rows = parts.select("doc_id", "tokens", F.explode(F.sequence(F.col("part") * PART, F.least(F.col("c"), F.col("part") * PART + PART) - 1)).alias("copy"))
    named = F.concat_ws("-", F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "tokens", "copy", "piece")
    full = rows.where(F.col("tokens") >= capacity).select("doc_id", "tokens", "copy", F.explode(F.sequence(F.lit(0), F.floor(F.col("tokens") / capacity).cast("int") - 1)).alias("piece"))
    full = full.select(named.alias("bin_id"), F.lit(0).alias("slot"), "doc_id", (F.col("piece") * capacity).alias("start_word"), F.lit(capacity).alias("n_words"))
    rest = rows.where(F.col("tokens") % capacity > 0).select("doc_id", "tokens", "copy", (F.col("tokens") - F.col("tokens") % capacity).cast("int").alias("start_word"), (F.col("tokens") % capacity).cast("int").alias("n_words"))
    problems = max(1, round((same.where(F.col("tokens") % capacity > 0).agg(F.sum("c")).first()[0] or 0) / problem_size))
    rest = rest.withColumn("problem", F.pmod(F.xxhash64("doc_id", "tokens", "copy"), F.lit(problems)))
    items = rest.groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tokens", "copy", "start_word", "n_words"))).alias("items"))
    items = scratch.save(items, "items")
    isles = items.select("problem", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.n_words").alias("sizes"))
    state = isles.withColumn("elites", F.lit(None).cast("array<array<int>>"))
    for e in range(epochs):
        run = lambda it, e=e: _epoch(it, capacity, population, generations, seed + e)
        state = scratch.save(state.repartition("problem", "island").mapInArrow(T.tidy(run), "problem bigint, island int, elites array<array<int>>, bins int, fitness double"), f"epoch{e}")
        if e + 1 < epochs:
            # An island goes on with its own elite and that of the one before it.
            came = state.select("problem", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("elites", 1, 1).alias("came"))
            state = isles.join(state.select("problem", "island", "elites"), ["problem", "island"]).join(came, ["problem", "island"]).select("problem", "island", "sizes", F.array_distinct(F.concat("elites", "came")).alias("elites"))
    best = state.groupBy("problem").agg(F.min_by(F.col("elites")[0], F.struct("bins", -F.col("fitness"), "island")).alias("bin"))
    placed = items.join(best, "problem").select("problem", F.explode(F.arrays_zip("items", "bin")).alias("z")).select("problem", F.col("z.bin").alias("bin"), "z.items.*")
    placed = placed.withColumn("slot", F.row_number().over(Window.partitionBy("problem", "bin").orderBy("doc_id", "tokens", "copy")) - 1)
    placed = placed.select(F.concat_ws("-", F.lit("p"), "problem", "bin").alias("bin_id"), "slot", "doc_id", "start_word", "n_words")
    return full.unionByName(placed)


def packed_bins(docs: DataFrame, capacity: int = 2048, **parameters) -> DataFrame:
    """One row for each bin of ``pack``: (bin_id, doc_ids, start_words, n_words, total_words), the lists in slot order.

    Nulls, empty and very long texts and repeated rows are treated as there; a null id is a null in ``doc_ids``. An empty table gives no bins.
    """
    parts = pack(docs, capacity=capacity, **parameters)
    bins = parts.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("slot", "doc_id", "start_word", F.col("n_words").alias("n")))).alias("p"), F.sum("n_words").alias("total_words"))
    return bins.select("bin_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.start_word").alias("start_words"), F.col("p.n").alias("n_words"), "total_words")
