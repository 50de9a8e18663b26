"""Registered queries of the retrieval engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import highlight, tokens
from lumenfold.functions.vectors import constant, cosine_distance, mean_vectors
from lumenfold.operators import aggs, paging, vector
from lumenfold.operators.filters import predicate
from lumenfold.operators.lexical import Bm25, Corpus
from lumenfold.operators.postings import IndexedCorpus
from lumenfold.plans.dsl import request_of, response, script_values
from lumenfold.plans.engine import Engine
from lumenfold.plans.search import Request, matches, search
from lumenfold.sources.readers import read_jsonl
from lumenfold.sources.schema import typed
from lumenfold.sources.table import SnapshotTable
from lumenfold.streaming.ingest import ingest, stream_parquet

Query = Callable[[SparkSession, str], DataFrame]
TOP = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, segment: str | None = None) -> Corpus:
    return Corpus.of(table(spark, sf_dir, "documents"), "doc_id", ["text"], segment)


def best(df: DataFrame, n: int | None = TOP) -> DataFrame:
    """(doc_id, score) rounded, the best ``n`` of it by rounded score and id."""
    out = df.select("doc_id", F.round("score", 6).alias("score"))
    return out if n is None else out.orderBy(F.desc("score"), "doc_id").limit(n)


_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """A fresh folder for the tables that a query writes: in spark.checkpoint.dir, or a temporary one, removed at the end, in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a shared folder")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="lumenfold-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        named = _local[0]
    return f"{named.rstrip('/')}/lumenfold-{uuid.uuid4().hex}"


_indexes: dict[tuple[str, str], IndexedCorpus] = {}


def index(spark: SparkSession, sf_dir: str) -> IndexedCorpus:
    """The saved index of the documents: built by the first query of an application that reads it, read by all later ones."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        _indexes[key] = IndexedCorpus(table(spark, sf_dir, "documents"), "doc_id", ["text"], f"{folder(spark)}/index", due=True)
    return _indexes[key]


# -- SQL pieces

TOKENS = r"list_filter(list_transform(regexp_split_to_array({}, '\s+'), lambda w: lower(regexp_replace(w, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g'))), lambda w: w <> '')"
TOK = "t AS (SELECT *, " + TOKENS.format("text") + " AS toks, len(toks) AS dl FROM documents)"


def score_sql(tf: str, df: str, n: str = "n", dl: str = "dl", avgdl: str = "avgdl", k1: float = 1.2, b: float = 0.75) -> str:
    return f"ln(1.0 + ({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)) * {tf} * ({k1}::DOUBLE + 1.0) / ({tf} + {k1}::DOUBLE * (1.0 - {b}::DOUBLE + {b}::DOUBLE * {dl} / {avgdl}))"


def bm25_sql(terms: Sequence[str], operator: str, where: str = "true", limit: int | None = TOP, k1: float = 1.2, b: float = 0.75, segment: str | None = None, factor: float = 1.0) -> str:
    names = list(dict.fromkeys(terms))
    tf = ", ".join(f"len(list_filter(toks, lambda w: w = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(names))
    over = f"PARTITION BY {segment}" if segment else ""
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) OVER ({over}) AS df{i}" for i in range(len(names)))
    total = " + ".join(f"CASE WHEN tf{i} > 0 THEN {terms.count(t)} * ({score_sql(f'tf{i}', f'df{i}', k1=k1, b=b)}) ELSE 0 END" for i, t in enumerate(names))
    hit = (" AND " if operator == "and" else " OR ").join(f"tf{i} > 0" for i in range(len(names)))
    sql = f"WITH {TOK}, f AS (SELECT *, {tf} FROM t), s AS (SELECT *, count(*) OVER ({over}) AS n, avg(dl) OVER ({over}) AS avgdl, {stats} FROM f) SELECT doc_id, round(({total}) * {factor}::DOUBLE, 6) AS score FROM s WHERE ({hit}) AND ({where})"
    return sql if limit is None else f"{sql} ORDER BY score DESC, doc_id LIMIT {limit}"


def phrase_sql(terms: Sequence[str], slop: int) -> str:
    places = [f"list_filter(range(len(toks)), lambda i: toks[i + 1] = '{t}')" for t in terms]
    test = " AND ".join(f"len(list_filter({p}, lambda x: abs(x - (s + {i})) <= {slop})) > 0" for i, p in enumerate(places[1:], 1))
    return bm25_sql(list(terms), "and", f"len(list_filter({places[0]}, lambda s: {test})) > 0", factor=1.5)


def wildcard_sql(rx: str) -> str:
    return f"WITH {TOK}, u AS (SELECT doc_id, dl, unnest(toks) AS term FROM t), p AS (SELECT doc_id, dl, term, count(*)::DOUBLE AS tf FROM u WHERE regexp_full_match(term, '{rx}') GROUP BY ALL), d AS (SELECT *, count(*) OVER (PARTITION BY term) AS df, (SELECT count(*) FROM t) AS n, (SELECT avg(dl) FROM t) AS avgdl FROM p) SELECT doc_id, round(sum({score_sql('tf', 'df')}), 6) AS score FROM d GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {TOP}"


# -- vectors


def query_vector(dim: int = 64) -> list[float]:
    return [round(float(np.sin(3 * i + 1)), 4) for i in range(dim)]


QV = "[" + ", ".join(f"{x}::DOUBLE" for x in query_vector()) + "]"
COS = f"list_cosine_similarity(embedding::DOUBLE[], {QV})"
NEAR = f"SELECT vec_id AS doc_id, {COS} AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 100"


def near(spark: SparkSession, sf_dir: str, k: int, where=None) -> DataFrame:
    return vector.exact_knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(), k, where)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near(spark, sf_dir, 100).withColumnRenamed("vec_id", "doc_id")
    return best(vector.hybrid(index(spark, sf_dir).scored(["in", "the"], "or"), found, "doc_id"), None)


def ann_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.ClusterIndex.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.knn(query_vector(), 10, 1_000_000).select("vec_id", F.round("cosine", 5).alias("cosine"))


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the exact ten among those found with a quarter of the clusters, in one row."""
    clusters = vector.ClusterIndex.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").save(f"{folder(spark)}/index")
    probes = max(1, clusters.centroids.count() // 4)
    exact, found = near(spark, sf_dir, 10).select("vec_id"), clusters.knn(query_vector(), 10, probes).select("vec_id")
    return exact.join(found.withColumn("hit", F.lit(1)), "vec_id", "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def ann_proven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many clusters as it takes to prove by their radii that no other has a nearer member."""
    clusters = vector.ClusterIndex.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").save(f"{folder(spark)}/index")
    return clusters.proven(query_vector(), 10, 4).select("vec_id", F.round("cosine", 5).alias("cosine"))


# -- filters and pages


def kept(name: str, key: str, clause: dict, mode: str = "typed") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.where(predicate(df, clause, mode)).select(key)

    return run


def paged(name: str, key: str, sort: list[tuple[str, str]], show: list[str], mode: str = "typed", **page) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return paging.page(df, paging.sort_keys(df, sort, key, mode=mode), **page).select(*show)

    return run


BOOL = {"bool": {"must": [{"term": {"lang": "en"}}, {"range": {"n_chars": {"gte": 500, "lt": 5000}}}], "must_not": [{"terms": {"source": ["src0", "src1"]}}], "should": [{"term": {"source": "src2"}}, {"range": {"doc_id": {"gte": 100}}}]}}


# -- tables that change


def conversations(spark: SparkSession, sf_dir: str) -> tuple[SnapshotTable, DataFrame]:
    """A table that holds all conversations, and an update of the even ones, twice each."""
    rows = table(spark, sf_dir, "conversations")
    t = SnapshotTable(spark, folder(spark), ["conv_id", "turn"], rows.schema)
    t.upsert(rows)
    even = rows.where("conv_id % 2 = 0")
    first, second = even.withColumn("text", F.lit("old")).withColumn("o", F.lit(1)), even.withColumn("text", F.concat(F.lit("new "), "role")).withColumn("o", F.lit(2))
    return t, first.union(second)


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, new = conversations(spark, sf_dir)
    t.upsert(new, "o")
    return t.read()


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, new = conversations(spark, sf_dir)
    t.upsert(new, "o")
    t.delete_by_query({"term": {"role": "assistant"}})
    t.compact(full=True)
    return t.read()


def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    t = SnapshotTable(spark, folder(spark), ["c_custkey"], rows.schema)
    t.upsert(rows)
    t.patch(rows.where("c_custkey % 3 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment")))
    return t.read()


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    t = SnapshotTable(spark, folder(spark), ["c_custkey"], rows.schema)
    t.upsert(rows)
    t.delete_by_query({"range": {"c_acctbal": {"lt": 0}}})
    return t.read().select("c_custkey")


def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    names = {str(r["n_nationkey"]): r["n_name"] for r in table(spark, sf_dir, "nation").collect()}  # 25 rows
    t = SnapshotTable(spark, folder(spark), ["c_custkey"], rows.schema)
    t.upsert(rows)
    t.update_by_query({"term": {"c_mktsegment": "BUILDING"}}, script_values({"source": "def k = ctx._source.c_nationkey; ctx._source.c_name = params.m[k]", "params": {"m": names}}))
    return t.read().select("c_custkey", "c_name")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, streamed in micro-batches into a table keyed by event."""
    rows, base = table(spark, sf_dir, "events"), folder(spark)
    rows.repartitionByRange(4, "event_id").write.parquet(f"{base}/in")
    t = SnapshotTable(spark, f"{base}/table", ["event_id"], rows.schema)
    ingest(stream_parquet(spark, f"{base}/in", rows.schema, 2), t, f"{base}/checkpoint").awaitTermination()
    return t.read().groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def patched_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several patches of one key in one batch, of different columns and of the same."""
    rows = table(spark, sf_dir, "customer")
    t = SnapshotTable(spark, folder(spark), ["c_custkey"], rows.schema)
    t.upsert(rows)
    none = F.lit(None).cast("string")
    first = rows.where("c_custkey % 3 = 0").select("c_custkey", F.lit("A").alias("c_mktsegment"), none.alias("c_name"), F.lit(1).alias("o"))
    second = rows.where("c_custkey % 3 = 0").select("c_custkey", none.alias("c_mktsegment"), F.lit("B").alias("c_name"), F.lit(2).alias("o"))
    third = rows.where("c_custkey % 6 = 0").select("c_custkey", F.lit("C").alias("c_mktsegment"), none.alias("c_name"), F.lit(3).alias("o"))
    t.patch(third.union(first).union(second), "o")
    return t.read()


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest made anew from the folders, after a merge that left what it replaced."""
    t, new = conversations(spark, sf_dir)
    t.upsert(new, "o")
    t.compact(full=True)
    t.rebuild_manifest(overwrite=True)
    return t.read()


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits and a delete, merged by size; what was deleted before stays away."""
    rows = table(spark, sf_dir, "conversations")
    t = SnapshotTable(spark, folder(spark), ["conv_id", "turn"], rows.schema)
    for k in range(3):
        t.upsert(rows.where(F.col("conv_id") % 3 == k))
    t.delete_by_query({"range": {"turn": {"lt": 1}}})
    t.upsert(rows.where("conv_id % 5 = 0 and turn = 0"))
    t.compact(max_inputs=3, max_rows=10**9)
    return t.read()


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, folder(spark))
    ns = engine.namespace("customers", {"segment": "Keyword"})
    ns.index(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment")))
    ns.delete({"term": {"segment": "BUILDING"}})
    return engine.stats()


def exists_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    t = SnapshotTable(spark, folder(spark), ["doc_id"], rows.schema)
    t.upsert(rows)
    return t.exists(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("doc_id")))


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nations as a bulk body, some updated, one of them twice, and a delete that isn't applied."""
    lines = []
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        lines += [{"index": {"_id": r["n_nationkey"]}}, {"name": r["n_name"], "region": r["n_regionkey"]}]
    for k in (3, 7):
        lines += [{"update": {"_id": k}}, {"doc": {"name": "changed"}}]
    lines += [{"update": {"_id": 7}}, {"doc": {"region": 99}}, {"delete": {"_id": 1}}]
    ns = Engine(spark, folder(spark)).namespace("nations", {"name": "Text", "region": "Integer"})
    ns.bulk([json.dumps(x) for x in lines])
    return ns.table.read().select(F.col("id").cast("int").alias("n_nationkey"), "name", "region")


def jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/lines"
    table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", "n_chars", F.md5("text").alias("text"))).alias("value")).write.text(path)
    rows = typed(read_jsonl(spark, path), {"lang": "Text", "n_chars": "Integer", "text": "Text"})
    return rows.select(F.col("id").cast("bigint").alias("doc_id"), "lang", "n_chars", "text")


def responded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of a response in the DSL's shape, its total on every row."""
    out = response(search(index(spark, sf_dir), request_of(ES_BODY), ["lang"]), "documents", "doc_id")
    rows = [(int(h["_id"]), round(h["_score"], 6), h["_source"]["lang"], out["hits"]["total"]["value"]) for h in out["hits"]["hits"]]
    return spark.createDataFrame(rows, "doc_id bigint, score double, lang string, total bigint")


ES_BODY = {"query": {"bool": {"must": [{"match": {"text": {"query": "the in", "operator": "and"}}}], "filter": [{"term": {"lang": "en"}}, {"range": {"n_chars": {"gte": 1000}}}]}}, "size": TOP}
ES_NESTED = {"query": {"bool": {"must": [{"match": {"text": "the"}}, {"bool": {"should": [{"term": {"lang": "en"}}, {"term": {"lang": "fr"}}]}}, {"bool": {"should": [{"term": {"source": "src1"}}, {"range": {"n_chars": {"lt": 3000}}}]}}]}}}
ES_SHOULD = {"query": {"bool": {"must": {"match": {"text": "the in"}}, "should": [{"term": {"lang": "en"}}, {"range": {"n_chars": {"gte": 2000}}}, {"bool": {"must_not": {"term": {"source": "src2"}}}}], "minimum_should_match": 2, "must_not": [{"term": {"lang": "de"}}]}}}
ES_FIELD = {"query": {"bool": {"should": [{"multi_match": {"query": "building 7", "fields": ["c_mktsegment"]}}]}}}


def dsl(body: dict) -> Query:
    return lambda spark, sf_dir: best(matches(index(spark, sf_dir), request_of(body)))


def field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two text fields: a term counts there alone, lengths are of both."""
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc_id")
    return best(matches(IndexedCorpus.write(rows, "doc_id", ["c_name", "c_mktsegment"], f"{folder(spark)}/index"), request_of(ES_FIELD)))


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole request: text and filter, sorted by a field, second page, with highlights."""
    r = Request("the", 10, 10, filter={"term": {"lang": "en"}}, sort=[("n_chars", "desc")], highlight={"field": "text"})
    return search(index(spark, sf_dir), r, ["n_chars"]).page.select("doc_id", "n_chars", F.round("score", 6).alias("score"), F.md5("highlight").alias("highlight"))


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built for this query alone."""
    made = IndexedCorpus.write(table(spark, sf_dir, "documents"), "doc_id", ["text"], f"{folder(spark)}/index")
    return best(made.scored(["in", "the"], "or"))


def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase comes before a wildcard, and that before the text."""
    r = Request("in", match_phrase={"phrase": "of the"}, wildcard={"pattern": "con*"})
    return best(matches(index(spark, sf_dir), r))


def bm25(terms: Sequence[str], operator: str, **kw) -> Query:
    return lambda spark, sf_dir: best(index(spark, sf_dir).scored(list(terms), operator, **kw))


def wildcard(pattern: str) -> Query:
    return lambda spark, sf_dir: best(index(spark, sf_dir).wildcard(pattern))


def phrase(terms: Sequence[str], slop: int) -> Query:
    return lambda spark, sf_dir: best(index(spark, sf_dir).phrase(list(terms), slop))


def _hits(exact: bool, clause: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "lineitem")
        return paging.total_hits(df.where(predicate(df, clause)), exact, 10_000)

    return run


QUANTITY = {"range": {"l_quantity": {"gte": 10}}}

#: name: (query, SQL)
ALL: dict[str, tuple[Query, str | None]] = {
    "tok_counts": (lambda s, d: corpus(s, d).vocabulary().orderBy(F.desc("df"), "term").limit(50), f"WITH {TOK}, u AS (SELECT doc_id, unnest(list_distinct(toks)) AS term FROM t) SELECT term, count(*) AS df FROM u GROUP BY term ORDER BY df DESC, term LIMIT 50"),
    "doc_lengths": (lambda s, d: corpus(s, d).rows.select("doc_id", F.col("dl").cast("bigint").alias("dl")), f"WITH {TOK} SELECT doc_id, dl FROM t"),
    "corpus_stats": (lambda s, d: corpus(s, d).rows.agg(F.count("*").alias("n"), F.sum(F.col("dl").cast("bigint")).alias("total"), F.round(F.avg("dl"), 6).alias("avgdl")), f"WITH {TOK} SELECT count(*) AS n, sum(dl)::BIGINT AS total, round(avg(dl), 6) AS avgdl FROM t"),
    "page_tokens": (lambda s, d: table(s, d, "pages").select("page_id", F.size(tokens("html")).cast("bigint").alias("n")), "SELECT page_id, len(" + TOKENS.format("html") + ") AS n FROM pages"),
    "bm25_single": (bm25(["the"], "and"), bm25_sql(["the"], "and")),
    "bm25_and": (bm25(["in", "the"], "and"), bm25_sql(["in", "the"], "and")),
    "bm25_or": (bm25(["in", "the"], "or"), bm25_sql(["in", "the"], "or")),
    "bm25_dup_term": (bm25(["the", "the"], "and"), bm25_sql(["the", "the"], "and")),
    "bm25_custom_params": (bm25(["in", "the"], "or", bm25=Bm25(2.0, 0.3)), bm25_sql(["in", "the"], "or", k1=2.0, b=0.3)),
    "bm25_filtered": (lambda s, d: best(index(s, d).scored(["in", "the"], "or", where=F.col("lang") == "en")), bm25_sql(["in", "the"], "or", "lang = 'en'")),
    "bm25_per_segment": (lambda s, d: best(corpus(s, d, "source").scored(["in", "the"], "or")), bm25_sql(["in", "the"], "or", segment="source")),
    "bm25_scan": (lambda s, d: best(corpus(s, d).scored(["in", "the"], "or")), bm25_sql(["in", "the"], "or")),
    "phrase_scan": (lambda s, d: best(corpus(s, d).phrase(["of", "the"], 0)), phrase_sql(["of", "the"], 0)),
    "wildcard_scan": (lambda s, d: best(corpus(s, d).wildcard("con*")), wildcard_sql("con.*")),
    "search_precedence": (precedence, phrase_sql(["of", "the"], 0)),
    "bm25_inverted_index": (built, bm25_sql(["in", "the"], "or")),
    "phrase_exact": (phrase(["of", "the"], 0), phrase_sql(["of", "the"], 0)),
    "phrase_slop2": (phrase(["of", "the"], 2), phrase_sql(["of", "the"], 2)),
    "wildcard_prefix": (wildcard("con*"), wildcard_sql("con.*")),
    "wildcard_infix": (wildcard("*ing*"), wildcard_sql(".*ing.*")),
    "wildcard_qmark": (wildcard("t?e"), wildcard_sql("t.e")),
    "highlight_first": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(highlight(F.col("text"), ["the"])).alias("marked")), "SELECT doc_id, md5(regexp_replace(text, '(?i)(the)', '<b>\\1</b>')) AS marked FROM documents"),
    "filter_term": (kept("documents", "doc_id", {"term": {"lang": "fr", "source": "src3"}}), "SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3'"),
    "filter_terms": (kept("documents", "doc_id", {"terms": {"source": ["src1", "src2"]}}), "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')"),
    "filter_term_numeric": (kept("part", "p_partkey", {"term": {"p_size": 7}}), "SELECT p_partkey FROM part WHERE p_size = 7"),
    "filter_range_num": (kept("orders", "o_orderkey", {"range": {"o_totalprice": {"gte": 100000, "lt": 200000.5}}}), "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000.5"),
    "filter_range_date": (kept("orders", "o_orderkey", {"range": {"o_orderdate": {"gte": "1995-01-01", "lt": "1996-01-01"}}}), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    "filter_bool": (kept("documents", "doc_id", BOOL), "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500 AND n_chars < 5000 AND source NOT IN ('src0', 'src1') AND (source = 'src2' OR doc_id >= 100)"),
    "filter_should_msm": (kept("documents", "doc_id", {"bool": {"should": [{"term": {"lang": "en"}}, {"range": {"n_chars": {"gt": 2000}}}, {"term": {"source": "src4"}}], "minimum_should_match": 2}}), "SELECT doc_id FROM documents WHERE (lang = 'en')::INT + (n_chars > 2000)::INT + (source = 'src4')::INT >= 2"),
    "filter_must_not": (kept("labels", "doc_id", {"bool": {"must_not": [{"term": {"toxic": 1}}]}}), "SELECT doc_id FROM labels WHERE coalesce(toxic, 0) <> 1"),
    "filter_match_all": (kept("nation", "n_nationkey", {"match_all": {}}), "SELECT n_nationkey FROM nation"),
    "filter_only_score": (lambda s, d: best(index(s, d).filtered(F.col("lang") == "de"), None), f"WITH {TOK}, s AS (SELECT *, count(*) OVER () AS n, avg(dl) OVER () AS avgdl FROM t) SELECT doc_id, round({score_sql('1.0::DOUBLE', 'n')}, 6) AS score FROM s WHERE lang = 'de'"),
    "query_less": (lambda s, d: best(matches(index(s, d), Request())), "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false"),
    "total_hits_exact": (_hits(True, QUANTITY), "SELECT count(*) AS total, 'eq' AS relation FROM lineitem WHERE l_quantity >= 10"),
    "total_hits_capped": (_hits(False, QUANTITY), "SELECT least(count(*), 10000) AS total, CASE WHEN count(*) > 10000 THEN 'gte' ELSE 'eq' END AS relation FROM lineitem WHERE l_quantity >= 10"),
    "sort_field_numeric": (paged("part", "p_partkey", [("p_retailprice", "desc")], ["p_partkey", "p_retailprice"], size=25), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25"),
    "sort_field_string_mode": (paged("part", "p_partkey", [("p_size", "asc")], ["p_partkey", "p_size"], mode="string", size=25), "SELECT p_partkey, p_size FROM part ORDER BY coalesce(p_size::VARCHAR, ''), p_partkey LIMIT 25"),
    "sort_multi": (paged("customer", "c_custkey", [("c_mktsegment", "asc"), ("c_acctbal", "desc")], ["c_custkey", "c_mktsegment", "c_acctbal"], size=40), "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 40"),
    "page_offset": (paged("customer", "c_custkey", [("c_acctbal", "desc")], ["c_custkey", "c_acctbal"], size=15, offset=30), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 30"),
    "page_search_after": (paged("customer", "c_custkey", [("c_mktsegment", "asc")], ["c_custkey", "c_mktsegment"], size=20, search_after=["BUILDING", 50]), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'BUILDING' OR (c_mktsegment = 'BUILDING' AND c_custkey > 50) ORDER BY c_mktsegment, c_custkey LIMIT 20"),
    "agg_terms": (lambda s, d: aggs.terms(table(s, d, "events"), "event_type", 3), "SELECT event_type AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "agg_cardinality": (lambda s, d: aggs.cardinality(table(s, d, "events"), "user_id"), "SELECT count(DISTINCT user_id) AS value FROM events"),
    "agg_composite_page1": (lambda s, d: aggs.composite(table(s, d, "orders"), {"status": "o_orderstatus", "priority": "o_orderpriority"}, 5), "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS doc_count FROM orders GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 5"),
    "agg_composite_page2": (lambda s, d: aggs.composite(table(s, d, "orders"), {"status": "o_orderstatus", "priority": "o_orderpriority"}, 5, {"status": "F", "priority": "5-LOW"}), "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS doc_count FROM orders GROUP BY 1, 2 HAVING (status, priority) > ('F', '5-LOW') ORDER BY 1, 2 LIMIT 5"),
    "agg_on_matches": (lambda s, d: search(index(s, d), Request("the", aggs={"langs": {"terms": {"field": "lang"}}})).aggregations["langs"], f"WITH {TOK} SELECT lang AS key, count(*) AS doc_count FROM t WHERE list_contains(toks, 'the') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "knn_exact": (lambda s, d: near(s, d, 10).select("vec_id", F.round("cosine", 5).alias("cosine")), f"SELECT vec_id, round({COS}, 5) AS cosine FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10"),
    "knn_filtered": (lambda s, d: near(s, d, 10, F.col("label") == 3).select("vec_id", F.round("cosine", 5).alias("cosine")), f"SELECT vec_id, round({COS}, 5) AS cosine FROM embeddings WHERE label = 3 ORDER BY {COS} DESC, vec_id LIMIT 10"),
    "knn_score_scaled": (lambda s, d: near(s, d, 10).select("vec_id", F.round(vector.pure_score(F.col("cosine")), 4).alias("score")), f"SELECT vec_id, round(({COS} + 1) * 10, 4) AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10"),
    "hybrid_blend": (hybrid, f"WITH l AS ({bm25_sql(['in', 'the'], 'or', limit=None).replace('round((', '(((').replace(', 6) AS score', ')) AS score')}), k AS ({NEAR}) SELECT doc_id, round(CASE WHEN cosine IS NULL THEN score ELSE 0.5 * score + 50.0 * cosine END, 6) AS score FROM l LEFT JOIN k USING (doc_id)"),
    "knn_ann_full_probe": (ann_full_probe, f"SELECT vec_id, round({COS}, 5) AS cosine FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10"),
    "knn_ann_recall": (ann_recall, None),
    "centroids_mean": (lambda s, d: mean_vectors(table(s, d, "embeddings"), ["label"], "embedding").select("label", F.col("i").cast("bigint").alias("i"), F.round("mean", 5).alias("mean")), "WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, i, round(avg(x), 5) AS mean FROM u GROUP BY label, i"),
    "upsert_last_wins": (upserted, "SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN 'new ' || role ELSE text END AS text FROM conversations"),
    "compact_content": (compacted, "SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN 'new ' || role ELSE text END AS text FROM conversations WHERE role <> 'assistant'"),
    "patch_merge": (patched, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "delete_by_query": (deleted, "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0"),
    "update_by_query": (updated, "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_name END AS c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "exists_split": (exists_split, "SELECT vec_id AS doc_id, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = vec_id) AS found FROM embeddings"),
    "stats": (stats, "SELECT 'customers' AS namespace, count(*) FILTER (c_mktsegment <> 'BUILDING') AS documents, 1 AS segments, 2 AS version FROM customer"),
    "patch_repeated": (patched_twice, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE c_name END AS c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 6 = 0 THEN 'C' WHEN c_custkey % 3 = 0 THEN 'A' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "import_after_compact": (imported, "SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN 'new ' || role ELSE text END AS text FROM conversations"),
    "compact_tiered": (tiered, "SELECT * FROM conversations WHERE turn >= 1 OR (conv_id % 5 = 0 AND turn = 0)"),
    "bulk_body": (bulk, "SELECT n_nationkey, CASE WHEN n_nationkey IN (3, 7) THEN 'changed' ELSE n_name END AS name, CASE WHEN n_nationkey = 7 THEN 99 ELSE n_regionkey END::BIGINT AS region FROM nation"),
    "jsonl_rows": (jsonl, "SELECT doc_id, lang, n_chars, md5(text) AS text FROM documents"),
    "response_hits": (responded, f"WITH s AS ({bm25_sql(['the', 'in'], 'and', 'lang = ' + chr(39) + 'en' + chr(39) + ' AND n_chars >= 1000', None)}) SELECT doc_id, score, 'en' AS lang, (SELECT count(*) FROM s) AS total FROM s ORDER BY score DESC, doc_id LIMIT {TOP}"),
    "cosine_distances": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(cosine_distance(F.col("embedding"), constant(query_vector())), 5).alias("distance")), f"SELECT vec_id, round(1 - {COS}, 5) AS distance FROM embeddings"),
    "knn_ann_budget": (ann_proven, f"SELECT vec_id, round({COS}, 5) AS cosine FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10"),
    "stream_upsert_content": (streamed, "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type"),
    "es_body_nested_bool": (dsl(ES_NESTED), bm25_sql(["the"], "or", "lang IN ('en', 'fr') AND (source = 'src1' OR n_chars < 3000)")),
    "es_body_should_filters": (dsl(ES_SHOULD), bm25_sql(["the", "in"], "or", "(lang = 'en')::INT + (n_chars >= 2000)::INT + (source <> 'src2')::INT >= 2 AND lang <> 'de'")),
    "es_body_field_match": (field_match, f"WITH t AS (SELECT c_custkey AS doc_id, {TOKENS.format('c_mktsegment')} AS seg, len({TOKENS.format('c_name')}) + len({TOKENS.format('c_mktsegment')}) AS dl FROM customer), s AS (SELECT *, list_contains(seg, 'building') AS hit, count(*) OVER () AS n, avg(dl) OVER () AS avgdl, count(*) FILTER (list_contains(seg, 'building')) OVER () AS df FROM t) SELECT doc_id, round({score_sql('1.0::DOUBLE', 'df')}, 6) AS score FROM s WHERE hit ORDER BY score DESC, doc_id LIMIT {TOP}"),
    "es_body_bool_match": (dsl(ES_BODY), bm25_sql(["the", "in"], "and", "lang = 'en' AND n_chars >= 1000")),
    "search_page": (search_page, f"WITH s AS ({bm25_sql(['the'], 'and', limit=None)}) SELECT doc_id, n_chars, score, md5(regexp_replace(text, '(?i)(the)', '<b>\\1</b>')) AS highlight FROM s JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10"),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
