"""Text analysis as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = r"[!-/:-@\[-`{-~]"
#: Runs of ASCII punctuation at either end of a white-space separated word.
_EDGES = rf"(?U)(?<!\S){_MARKS}+|{_MARKS}+(?!\S)"


def tokens(text: Column | str) -> Column:
    """Words of a text: split at Unicode white space, ASCII punctuation trimmed from both ends, in lower case; null for null.

    One regular expression over the whole text and no lambda, so the expression stays inside generated code.
    """
    col = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.regexp_replace(col, _EDGES, "")), r"(?U)\s+"), "")


def query_terms(text: str) -> list[str]:
    """``tokens`` of a query, in the driver."""
    words = (re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w) for w in text.split())
    return [w.lower() for w in words if w]


def term_frequency(words: Column, term: str) -> Column:
    """How often ``term`` is in the array ``words``; 0 for null."""
    return F.coalesce(F.size(words) - F.size(F.array_remove(words, term)), F.lit(0))


def positions(words: Column, term: str) -> Column:
    """Places (from 0) of ``term`` in the array ``words``."""
    hits = F.transform(words, lambda w, i: F.when(w == term, i))
    return F.filter(hits, lambda i: i.isNotNull())


def phrase_starts(places: list[Column], slop: int) -> Column:
    """Whether any place of the first term has those of all others within ``slop`` of where they follow it; each list of ``places`` is found once a row."""

    def shifted(p: Column, i: int) -> Column:
        return F.transform(p, lambda x: x - i)

    if slop == 0:
        return F.size(reduce(F.array_intersect, [shifted(p, i) for i, p in enumerate(places)])) > 0

    def near(i: int, s: Column, row: Column) -> Column:
        return F.exists(row[f"p{i}"], lambda x: F.abs(x - (s + i)) <= slop)

    # Functions of one argument, as Spark passes an index as a second.
    def starts(row: Column) -> Column:
        return F.exists(row["p0"], lambda s: reduce(lambda a, b: a & b, [near(i, s, row) for i in range(1, len(places))], F.lit(True)))

    return F.exists(F.array(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(places)])), starts)


def glob_regex(pattern: str, ignore_case: bool = True) -> str:
    """Anchored regular expression of a glob: * is any run, ? one character, all else itself."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", c) for c in pattern)
    return f"(?s{'iu' if ignore_case else ''})^{body}$"


def highlight(text: Column, terms: list[str], pre: str = "<b>", post: str = "</b>", mode: str = "first") -> Column:
    """``text`` with query terms marked.

    "first" marks the first case-insensitive occurrence of each term in turn, inside words and earlier marks too; "words" marks
    every occurrence that is a whole word, in one pass.
    """
    def quote(term: str) -> str:
        return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)

    pre, post = (x.replace("\\", "\\\\").replace("$", "\\$") for x in (pre, post))
    distinct = list(dict.fromkeys(terms))
    if mode == "words":
        if not distinct:
            return text
        return F.regexp_replace(text, rf"(?iuU)(?<![\w])({'|'.join(map(quote, sorted(distinct, key=len, reverse=True)))})(?![\w])", f"{pre}$1{post}")
    if mode != "first":
        raise ValueError(f"mode is 'first' or 'words', not {mode!r}")
    for t in distinct:
        text = F.regexp_replace(text, rf"(?siu)\A(.*?)({quote(t)})", f"$1{pre}$2{post}")
    return text
