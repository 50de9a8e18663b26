"""One search request as one plan: retrieve, filter, blend, order, page, then fetch the page's fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import highlight, query_terms
from lumenfold.operators import aggs, paging, vector
from lumenfold.operators.filters import predicate
from lumenfold.operators.lexical import Bm25, Corpus
from lumenfold.operators.postings import IndexedCorpus
from lumenfold.operators.vector import ClusterIndex


@dataclass
class Request:
    query_text: str = ""
    max_results: int = 10
    offset: int = 0
    bm25: Bm25 = field(default_factory=Bm25)
    filter: Mapping | None = None
    sort: Sequence[tuple[str, str]] | None = None
    sort_mode: str = "typed"
    search_after: Sequence | None = None
    highlight: Mapping | None = None
    aggs: Mapping | None = None
    agg_scope: str = "matched"
    wildcard: Mapping | None = None
    match_phrase: Mapping | None = None
    knn: Mapping | None = None
    exact_total_hits: bool = False
    total_hits_cap: int = 10_000
    operator: str = "and"
    #: Text fields that ``query_text`` is looked for in; all by default.
    fields: Sequence[str] | None = None


@dataclass
class Result:
    """``page`` has id, score and the fields in order; ``total`` (total, relation); ``aggregations`` by name."""

    page: DataFrame
    total: DataFrame
    aggregations: dict[str, DataFrame]
    hits: DataFrame


def matches(corpus: Corpus | IndexedCorpus, request: Request, clusters: ClusterIndex | None = None) -> DataFrame:
    """(id, score) of every hit. A phrase takes precedence over a wildcard, that over the text; a request without any of these, a filter or knn has no hits.

    ``clusters`` answers knn with ``num_candidates``; without it, or without that number, all vectors are compared.
    """
    rows = corpus.rows
    where = predicate(rows, request.filter) if request.filter is not None else None
    text = query_terms(request.query_text)
    lexical = None
    if request.match_phrase:
        name = request.match_phrase.get("field")
        lexical = corpus.phrase(query_terms(request.match_phrase["phrase"]), request.match_phrase.get("slop", 0), [name] if name else None, request.bm25, where=where)
    elif request.wildcard:
        name = request.wildcard.get("field")
        lexical = corpus.wildcard(request.wildcard["pattern"], [name] if name else None, request.wildcard.get("case_insensitive", True), request.bm25, where)
    elif text:
        lexical = corpus.scored(text, request.operator, request.bm25, where=where, fields=request.fields)
    if request.knn:
        spec = request.knn
        both = where if where is not None else F.lit(True)
        if spec.get("filter") is not None:
            both = both & predicate(rows, spec["filter"])
        if clusters is not None and spec.get("num_candidates"):
            allowed = rows.where(both).select(corpus.id_col) if where is not None or spec.get("filter") is not None else None
            near = clusters.knn(spec["vector"], spec.get("k", 10), vector.probe_budget(spec["num_candidates"], clusters.centroids.count()), allowed).withColumnRenamed(clusters.id_col, corpus.id_col)
        else:
            near = vector.exact_knn(rows, corpus.id_col, spec["field"], spec["vector"], spec.get("k", 10), both)
        if lexical is not None:
            return vector.hybrid(lexical, near, corpus.id_col)
        return near.select(corpus.id_col, vector.pure_score(F.col("cosine")).alias("score"))
    if lexical is not None:
        return lexical
    if where is not None:
        return corpus.filtered(where, request.bm25)
    return rows.where("false").select(corpus.id_col, F.lit(0.0).alias("score"))


#: Rows of a page up to which its ids become a filter of the scan that fetches its fields.
FETCHED = 1000


def search(corpus: Corpus | IndexedCorpus, request: Request, fields: Sequence[str] | None = None, clusters: ClusterIndex | None = None) -> Result:
    """The page with ``fields`` (all of the table's own by default), totals and aggregations of a request.

    A page of up to FETCHED rows is found here and now, and its fields are read by id; totals and aggregations run when they are asked for.
    """
    own = [c for c in corpus.rows.columns if not c.startswith("_tokens_") and c not in ("dl", corpus.id_col)]
    fields = list(fields) if fields is not None else own
    hits = matches(corpus, request, clusters)
    sorted_by = [f for f, _ in request.sort or [] if f not in ("_score", "_id")]
    keyed = hits.join(corpus.rows.select(corpus.id_col, *sorted_by), corpus.id_col) if sorted_by else hits
    keys = paging.sort_keys(keyed, request.sort, corpus.id_col, mode=request.sort_mode)
    page = paging.page(keyed, keys, request.max_results, request.offset, request.search_after).select(corpus.id_col, "score")
    marked = [request.highlight["field"]] if request.highlight else []
    full = corpus.rows.select(corpus.id_col, *dict.fromkeys([*fields, *sorted_by, *marked]))
    if request.max_results <= FETCHED:
        rows = page.collect()
        page = corpus.rows.sparkSession.createDataFrame(rows, page.schema)
        full = full.where(F.col(corpus.id_col).isin([r[0] for r in rows]))
    full = full.join(F.broadcast(page), corpus.id_col)  # max_results rows
    full = paging.ordered(full, paging.sort_keys(full, request.sort, corpus.id_col, mode=request.sort_mode))
    shown = full.select(corpus.id_col, "score", *fields)
    if request.highlight:
        h = request.highlight
        terms = query_terms(request.query_text)
        pre, post = (h.get(k) or [d] for k, d in (("pre_tags", "<b>"), ("post_tags", "</b>")))
        shown = full.select(corpus.id_col, "score", *fields, highlight(F.col(h["field"]), terms, pre[0], post[0], h.get("mode", "first")).alias("highlight"))
    found = corpus.rows if request.agg_scope == "all" else corpus.rows.join(hits.select(corpus.id_col), corpus.id_col, "left_semi")
    return Result(shown, paging.total_hits(hits, request.exact_total_hits, request.total_hits_cap), aggs.aggregate(found, request.aggs or {}), hits)
