"""Connected components of an undirected graph given as a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges up to this number (16 bytes each) are resolved in the driver; more, by rounds of star contraction in Spark.
DRIVER_EDGES = 2_000_000

#: Ids up to this number (about 24 bytes each in a hash table) are broadcast to filter a table of them; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def only(df: DataFrame, key: str, ids: DataFrame, count: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among the ``count`` rows of ``ids`` (a column of the same name)."""
    return df.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, key, "left_semi")


def components(edges: DataFrame, scratch: Scratch, name: str, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a bigint, b bigint); root is the least node of its component.

    Nulls in an edge and loops are ignored. Either way gives the same result.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = scratch.save(edges, f"{name}-e0")
    if (n := edges.count()) <= driver_edges:
        here = edges.toPandas()
        nodes, roots = _union(here["a"].to_numpy(np.int64), here["b"].to_numpy(np.int64)) if n else (np.zeros(0, np.int64),) * 2
        return scratch.save(scratch.spark.createDataFrame(pd.DataFrame({"node": nodes, "root": roots}), "node bigint, root bigint"), f"{name}-cc")
    k = 0
    while True:  # alternating large and small stars; ends when no edge changes
        # Least neighbours are aggregated and joined back, so a node's neighbours are never in one row.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = low.select(F.col("m").alias("a"), "b").union(large.join(low, "b").where("a <> m").select("m", "a")).distinct()
        k += 1
        new = scratch.save(small, f"{name}-e{k}")
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        scratch.drop(f"{name}-e{k - 1}")
        edges = new
        if same:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(root, before):
            return nodes, nodes[root]


def different_buckets(members: DataFrame) -> DataFrame:
    """``members`` (bucket, doc_id) of one of each set of buckets that have the same documents, as often each.

    They are compared by their number, least, greatest and two sums of hashes, so none is collected.
    """
    h = F.xxhash64("doc_id")
    of = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"), F.sum(F.shiftrightunsigned(h, 32)).alias("t"))
    one = of.groupBy("n", "low", "high", "s", "t").agg(F.min("bucket").alias("bucket")).select("bucket")
    return members.join(one, "bucket", "left_semi").select("bucket", "doc_id")


#: Pairs of the last round that are compared as they are; where more would be, buckets are refined first.
PAIRS = 20_000_000


def group_by_buckets(members: DataFrame, alike: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], values: DataFrame, scratch: Scratch, known: DataFrame, star_rounds: int = 3, refine: Callable[[DataFrame], DataFrame] | None = None, most_pairs: int = PAIRS) -> DataFrame:
    """(doc_id, kept_id, group_size) of the components that alike pairs out of common buckets make, with the ``known`` edges.

    ``members`` has (bucket, doc_id), ``values`` (doc_id, ...) what to compare; ``alike`` gets pairs (a, b) and the values of
    the documents in them (twice) and keeps those that are alike. Only connection counts, so
    each document is compared with one lead first, then in ``star_rounds`` rounds with other leads of buckets that
    still hold several components, and whatever is apart after that pair by pair: no partner is left out, however
    large a bucket is. Where that would be more than ``most_pairs``, ``refine`` gets the documents (doc_id) and gives keys (doc_id, key) of which
    alike documents share one at least; the open buckets are split by them, and the rounds begin anew. The result is the same.
    """
    done: list[str] = []
    links: DataFrame | None = None
    name = ""

    def verified(pairs: DataFrame, k: int) -> DataFrame:
        pairs = scratch.save(pairs, f"pairs{name}{k}")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        some = only(values, "doc_id", ids, 2 * pairs.count())
        done.append(f"pairs{name}{k}")
        done.append(f"links{name}{k}")
        return scratch.save(alike(pairs, some, some), f"links{name}{k}")

    def opened(k: int) -> DataFrame:
        """(bucket, doc_id, root, lead) of the buckets that hold several components."""
        roots = components(links, scratch, f"round{name}{k}")
        placed = members.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        apart = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))).alias("lead")).where("low < high").select("bucket", "lead")
        done.append(f"open{name}{k}")
        return scratch.save(placed.join(apart, "bucket"), f"open{name}{k}")

    while True:
        lead = members.groupBy("bucket").agg(F.min("doc_id").alias("lead")).join(members, "bucket").groupBy("doc_id").agg(F.min("lead").alias("lead"))
        first = verified(lead.where("lead <> doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")), 0)
        links = first if links is None else links.union(first)
        for k in range(1, star_rounds + 1):
            rest = opened(k)
            if rest.isEmpty():
                break
            leads = rest.where("doc_id = lead").select("bucket", F.col("root").alias("lead_root")).distinct()
            todo = rest.join(leads, "bucket").where("root <> lead_root").select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b"))
            links = links.union(verified(todo.distinct(), k))
        else:
            rest = opened(star_rounds + 1)
        if rest.isEmpty():
            break
        size = rest.groupBy("bucket").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        if refine is None or name or size <= most_pairs:
            other = rest.select("bucket", F.col("doc_id").alias("b"), F.col("root").alias("r"))
            todo = rest.select("bucket", F.col("doc_id").alias("a"), "root").join(other, "bucket").where("root <> r and a < b").select("a", "b")
            links = links.union(verified(todo.distinct(), star_rounds + 1))
            break
        keys = refine(rest.select("doc_id").distinct())
        name = "-fine"
        fine = scratch.save(rest.join(keys, "doc_id").select(F.xxhash64("bucket", "key").alias("bucket"), "doc_id").distinct(), "fine")
        done.append("fine")
        members = scratch.save(different_buckets(fine.join(fine.groupBy("bucket").count().where("count > 1").select("bucket"), "bucket", "left_semi")), "finer")
        done.append("finer")
    found = grouped(links.union(known), scratch)
    scratch.drop(*done)
    return found


def grouped(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, kept_id, group_size) of all but the least document of each component of ``links`` (a, b)."""
    roots = components(links, scratch, "all")
    sizes = roots.groupBy("root").agg(F.count("*").alias("group_size"))
    return scratch.save(roots.where("node <> root").join(sizes, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"), "group_size"), "result")
