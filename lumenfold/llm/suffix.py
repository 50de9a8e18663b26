"""Passages that occur more than once, by a Burrows-Wheeler transform.

A window is any run of ``length`` words inside one document. Winnowing picks one anchor for every window
(the least hash among its n-grams), equal windows the same one, so a window can only repeat where its anchor
does. The windows that one anchor was picked for form a slice. Slices meet at their anchor's hash; equal
slices need no comparison, and of the differing ones at a shared anchor one copy each is searched: all of
a task's slices are joined into one sequence, its Burrows-Wheeler transform is extended backward breadth
first, interval by interval, which sets common prefix lengths in increasing order, and stops at
``length``. Suffixes whose common prefix is still unset there begin with equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .scratch import Scratch

U = np.uint64
#: Words of slices that one transform is built over.
SYMBOLS = 300_000
UNSET = 1 << 30
#: Differing slices of an anchor that are searched in one task.
CROWD = 4096


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each of the len - w + 1 windows of w values the place of the least, the first of equal ones."""
    n = len(values) - w + 1
    bits = U(max(1, int(len(values)).bit_length()))
    packed = (values >> bits << bits) | np.arange(len(values), dtype=U)
    pad = -len(packed) % w
    blocks = np.concatenate((packed, np.full(pad, U(0xFFFFFFFFFFFFFFFF)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & ((U(1) << bits) - U(1))).astype(np.int64)


def slices(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, first window, windows, anchor hash, content hash) of each slice, and the words' hashes with each row's first."""
    start, end, first = T.words(data, offsets)
    codes = T.word_hashes(data, start, end)
    none = np.zeros(0, np.int64)
    if len(codes) < length:
        return none, none, none, none.view(U), none.view(U), codes, first
    prefix = T.Sequence(codes)
    grams = prefix.of(np.arange(len(codes) - gram + 1), np.arange(gram, len(codes) + 1))
    anchor = sliding_argmin(grams, length - gram + 1)
    row = np.searchsorted(first, np.arange(len(anchor)), "right") - 1
    at = np.flatnonzero(np.arange(len(anchor)) + length <= first[row + 1])
    if not len(at):
        return none, none, none, none.view(U), none.view(U), codes, first
    a = anchor[at]
    cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1))))
    n = np.diff(np.concatenate((cut, [len(at)])))
    lo, p = at[cut], a[cut]
    content = T.mix(prefix.of(lo, lo + n - 1 + length) + T.mix(((p - lo) << 32 | n).astype(U)))
    return row[lo], lo - first[row[lo]], n, grams[p], content, codes, first


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, off in T.pieces(batch.column(1)):
            row, at, n, anchor, content, _, _ = slices(data, off, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), ids[lo:hi].take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "content", "doc_id", "at", "n"])


def _fetch(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The words of the slices asked for: rows of (text, wanted contents)."""
    for batch in batches:
        wanted = batch.column(1)
        for lo, hi, data, off in T.pieces(batch.column(0)):
            row, at, n, anchor, content, codes, first = slices(data, off, length, gram)
            lists = wanted[lo:hi]
            asked = lists.flatten().to_numpy(zero_copy_only=False).view(U)
            owner = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
            both = np.stack((np.concatenate((owner, row)).astype(U), np.concatenate((asked, content))))
            key = T.mix(both[0] * U(T.BASE) + both[1])
            pick = np.flatnonzero(np.isin(key[len(owner) :], key[: len(owner)]))
            begin, size = first[row[pick]] + at[pick], n[pick] - 1 + length
            flat = codes[T.ragged(begin, size)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[pick].view(np.int64)), pa.array(content[pick].view(np.int64)), lists], ["anchor", "content", "words"])


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes, by doubling; they must differ within ``depth`` symbols."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k, n = 1, len(rank)
    while True:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        if k * 2 >= depth:
            return order
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
        k *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` and the one before, or UNSET where it is ``limit`` or more.

    Intervals of the Burrows-Wheeler transform are extended backward, all of one depth at a time; the depth
    of an interval that begins where no value is set yet is the common prefix there.
    """
    n = len(symbols)
    last = symbols[order - 1]  # the sequence is read as a circle
    back = np.empty(n, np.int64)  # row of the suffix that is one symbol longer
    back[np.argsort(last, kind="stable")] = np.arange(n)
    lcp = np.full(n + 1, UNSET, np.int64)
    lcp[0] = lcp[n] = 0
    lo, hi = np.array([0]), np.array([n])
    for depth in range(limit):
        size = hi - lo
        rows = T.ragged(lo, size)
        owner = np.repeat(np.arange(len(lo)), size)
        to = back[rows]
        # Rows of one interval and symbol go to a block of rows in their order.
        o = np.argsort(to, kind="stable")
        to, owner, symbol = to[o], owner[o], last[rows[o]]
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]) | (to[1:] != to[:-1] + 1))))
        lo, hi = to[new], to[np.concatenate((new[1:], [len(to)])) - 1] + 1
        fresh = lcp[hi] == UNSET
        fresh |= hi == n  # the last interval has no successor to set, but may still hold others
        lcp[hi[fresh & (hi < n)]] = depth
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
    return lcp[:n]


def repeats(words: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, sequence, offset) of the windows that occur at more than one place of the sequences."""
    size = np.array([len(w) + 1 for w in words])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    total = int(size.sum())
    codes = np.zeros(total, U)
    inner = np.ones(total, bool)
    inner[begin + size - 1] = False
    codes[inner] = np.concatenate(words)
    symbols = np.empty(total, np.int64)
    symbols[~inner] = np.arange(len(words))
    symbols[inner] = np.unique(codes[inner], return_inverse=True)[1] + len(words)
    order = suffix_array(symbols, int(size.max()) + 1)
    same = common_prefixes(symbols, order, length) >= length
    group = np.cumsum(~same)
    follows = np.concatenate((same[1:], [False]))
    keep = same | follows
    at = order[keep]
    owner = np.searchsorted(begin, at, "right") - 1
    return group[keep], owner, at - begin[owner]


def _search(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor: for each slice content the first place of each of its windows that others share."""
    held: list = []

    def flush(rows: list) -> pa.RecordBatch:
        group, owner, at = repeats([r[2] for r in rows], length)
        doc = np.array([r[3] for r in rows])[owner]
        pos = np.array([r[4] for r in rows])[owner] + at
        o = np.lexsort((pos, doc, group))
        lead = np.concatenate(([True], group[o][1:] != group[o][:-1])) if len(o) else np.zeros(0, bool)
        which = o[lead][np.cumsum(lead) - 1] if len(o) else o
        content = np.array([r[1] for r in rows])[owner[o]]
        return pa.RecordBatch.from_arrays([pa.array(content), pa.array(at[o].astype(np.int32)), pa.array(doc[which]), pa.array(pos[which].astype(np.int32))], ["content", "offset", "first_doc", "first_at"])

    count = 0
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4)]
        lists = batch.column(2)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(U), np.cumsum(np.concatenate(([0], lists.value_lengths().to_numpy(zero_copy_only=False))))
        for i in range(batch.num_rows):
            if count >= SYMBOLS and cols[0][i] != held[-1][0]:
                yield flush(held)
                held, count = [], 0
            held.append((cols[0][i], cols[1][i], flat[ends[i] : ends[i + 1]], cols[2][i], cols[3][i]))
            count += len(held[-1][2])
    if held:
        yield flush(held)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of slices (anchor, content, words, doc_id, at, ...), each with a digest and its place."""
    for batch in batches:
        content, doc, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 4))
        size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        raw, begin = memoryview(batch.column(2).flatten().to_numpy(zero_copy_only=False).tobytes()), np.cumsum(size) - size
        n = size - length + 1
        owner, offset = np.repeat(np.arange(len(n)), n), T.ragged(np.zeros(len(n), np.int64), n)
        keys = [hashlib.blake2b(raw[8 * i : 8 * (i + length)], digest_size=16).digest() for i in (begin[owner] + offset).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(content[owner]), pa.array(offset.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(doc[owner]), pa.array((at[owner] + offset).astype(np.int32))], ["content", "offset", "key", "doc_id", "at"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 30, crowd: int = CROWD) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, first_start_word): the passages whose every window of ``length`` words occurred before.

    Words are separated by ASCII white space and control characters and compared byte by byte. The first
    occurrence of a window is that with the least (doc_id, position); it may lie in the same document. A row
    is a longest run of windows whose first occurrences follow one another in one document, so rows of a
    document may overlap by up to ``length`` - 1 words. Texts with fewer than ``length`` words, empty and null
    ones have no rows; null ids are left out. Rows with the same id count as the same document, and a
    window at the same place of each as the same occurrence. Other columns are ignored. An empty table gives no rows. ``crowd`` bounds what one task searches and
    changes no result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    found = scratch.save(source.mapInArrow(T.tidy(lambda it: _anchors(it, length, gram)), "anchor bigint, content bigint, doc_id bigint, at int, n int"), "found")
    # A lone slice goes no further. All that is asked of an anchor or a content is aggregated and joined back, so none is gathered in a task.
    several = found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    met = scratch.save(found.join(several, "anchor", "left_semi"), "met")
    reps = met.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "at")).alias("rep"))
    reps = reps.join(reps.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor").select("anchor", "content", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.at").alias("rep_at"), "kinds")
    reps = scratch.save(reps, "reps")
    marked = met.join(reps, ["anchor", "content"]).select("content", "doc_id", "at", "n", "rep_doc", "rep_at", (F.col("kinds") > 1).alias("mixed"))
    marked = scratch.save(marked, "slices")
    mixed = marked.where("mixed")
    differing = reps.where("kinds > 1")
    wanted = differing.groupBy(F.col("rep_doc").alias("doc_id")).agg(F.collect_set("content").alias("contents"))
    words = source.join(wanted, "doc_id").select("text", "contents").mapInArrow(T.tidy(lambda it: _fetch(it, length, gram)), "anchor bigint, content bigint, words array<bigint>")
    words = words.join(differing, ["anchor", "content"]).groupBy("anchor", "content").agg(F.first("words").alias("words"), F.first("rep_doc").alias("doc_id"), F.first("rep_at").alias("at"), F.first("kinds").alias("kinds"))
    crowded = not differing.where(F.col("kinds") > crowd).isEmpty()
    if crowded:
        words = scratch.save(words, "words")
    places = "content bigint, offset int, first_doc bigint, first_at int"
    shared = words.where(F.col("kinds") <= crowd).drop("kinds").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(T.tidy(lambda it: _search(it, length)), places)
    if crowded:
        # Where an anchor has more differing slices than a task takes, their windows meet by 128-bit digests instead.
        windows = words.where(F.col("kinds") > crowd).mapInArrow(T.tidy(lambda it: _windows(it, length)), "content bigint, offset int, key binary, doc_id bigint, at int")
        windows = scratch.save(windows, "windows")
        first = windows.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count("*").alias("c")).where("c > 1")
        shared = shared.unionByName(windows.join(first, "key").select("content", "offset", F.col("f.doc_id").alias("first_doc"), F.col("f.at").alias("first_at")))
    shared = scratch.save(shared, "shared")
    # A window is at its own first occurrence, at that of its slice's first copy, or at one found by the search.
    copies = marked.where("not (doc_id = rep_doc and at = rep_at)").select("doc_id", "at", "n", F.col("rep_doc").alias("first_doc"), F.col("rep_at").alias("first_at"), "content", "mixed")
    plain = copies.where("not mixed").select("doc_id", "at", "n", "first_doc", "first_at")
    window = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("offset")
    each = mixed.select("doc_id", "at", "rep_doc", "rep_at", "content", window)
    each = each.join(shared, ["content", "offset"], "left").select("doc_id", (F.col("at") + F.col("offset")).alias("at"), F.lit(1).alias("n"), F.coalesce("first_doc", "rep_doc").alias("first_doc"), F.coalesce("first_at", F.col("rep_at") + F.col("offset")).alias("first_at")).where("doc_id <> first_doc or at <> first_at")
    steps = plain.union(each).distinct()
    run = Window.partitionBy("doc_id").orderBy("at")
    new = (F.lag(F.col("at") + F.col("n")).over(run) != F.col("at")) | (F.lag("first_doc").over(run) != F.col("first_doc")) | (F.lag(F.col("first_at") + F.col("n")).over(run) != F.col("first_at"))
    runs = steps.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(run))
    spans = runs.groupBy("doc_id", "k").agg(F.min("at").alias("start_word"), (F.sum("n") + length - 1).cast("int").alias("n_words"), F.min_by("first_doc", "at").alias("first_doc_id"), F.min_by("first_at", "at").alias("first_start_word"))
    result = scratch.save(spans.drop("k"), "result")
    scratch.drop("found", "met", "reps", "words", "windows", "slices", "shared")
    return result


def cut_words(value: str, spans: list[tuple[int, int]]) -> str:
    """``value`` without the words in the given (first, end) ranges and the white space after each."""
    data = np.frombuffer(value.encode(), np.uint8)
    start, end, _ = T.words(data, np.array([0, len(data)]))
    gone = np.zeros(len(start), bool)
    for a, b in spans:
        gone[a:b] = True
    keep = np.ones(len(data), bool)
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        keep[start[a] : start[b] if b < len(start) else len(data)] = False
    return data[keep].tobytes().decode()


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 30, chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all words removed that a row of ``repeated_passages`` covers; the first occurrence stays.

    The white space after each removed passage goes with it. No row is dropped: a text may become empty.
    ``chars_col``, where there is such a column, is set to the new number of characters of changed texts. Other columns, rows with
    null ids and null texts stay as they are; rows that share an id are all cut at the same words.
    """
    found = repeated_passages(docs, id_col, text_col, length, gram)
    found = found.groupBy(F.col("doc_id").alias("__lf_id")).agg(F.collect_list(F.struct("start_word", (F.col("start_word") + F.col("n_words")).alias("end"))).alias("__lf_spans"))
    joined = docs.join(found, docs[id_col].cast("bigint") == F.col("__lf_id"), "left").drop("__lf_id")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names))
            hit = np.flatnonzero(np.asarray(spans.is_valid()) & np.asarray(batch.column(at).is_valid()))
            columns = batch.columns[:-1]
            if len(hit):
                texts = batch.column(at).to_pylist()
                chars = columns[names.index(chars_col)].to_pylist() if chars_col in names else None
                for i in hit.tolist():
                    texts[i] = cut_words(texts[i], [(s["start_word"], s["end"]) for s in spans[i].as_py()])
                    if chars is not None:
                        chars[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    columns[names.index(chars_col)] = pa.array(chars, columns[names.index(chars_col)].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(T.tidy(run), docs.schema)
