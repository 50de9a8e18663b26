import pytest
from pyspark.sql import functions as F

from lumenfold.functions.text import highlight, query_terms, tokens
from lumenfold.operators import aggs, paging
from lumenfold.operators.filters import FilterError, predicate
from lumenfold.operators.lexical import Corpus
from lumenfold.operators.postings import IndexedCorpus
from lumenfold.plans.dsl import UnsupportedQuery, request_of, response, script_values
from lumenfold.plans.search import Request, matches, search


def corpus(spark, texts, segment=None):
    rows = [(f"d{i}", t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    return Corpus.of(spark.createDataFrame(rows, "id string, content string"), "id", ["content"])


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_tokens_trim_punctuation_and_lower(spark):
    df = spark.createDataFrame([("  \"Hello,\" (World's) -- end. ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens("t")).collect()] == [["hello", "world's", "end"], [], None]
    assert query_terms("\"Hello,\" (World's) --") == ["hello", "world's"]


def test_and_needs_every_term_and_or_any(spark):
    c = corpus(spark, ["contract dispute clause", "contract only", "dispute only", "none", None, ""])
    assert ids(c.scored(["contract", "dispute"])) == ["d0"]
    assert ids(c.scored(["contract", "dispute"], "or")) == ["d0", "d1", "d2"]
    with pytest.raises(ValueError):
        c.scored(["a"], "xor")


def scores(df):
    return {r[0]: round(r["score"], 9) for r in df.collect()}


def test_saved_index_answers_like_the_scan(spark, tmp_path, monkeypatch):
    """Two text fields, filters, all kinds of queries, and nulls."""
    n = [(i, ("alpha " * (i % 7 + 1) + "x" + (" " + "beta " * (i % 5 + 1) if i % 3 else "") + (" gamma " if i % 4 == 0 else "") + " pad" * (i % 11)) if i != 9 else None, "beta alpha" if i % 2 else "Gamma, alpha beta", i % 6) for i in range(60)]
    df = spark.createDataFrame(n + [(100, "", None, 1)], "id int, a string, b string, k int")
    c, index = Corpus.of(df, "id", ["a", "b"]), IndexedCorpus.write(df, "id", ["a", "b"], str(tmp_path / "index"))
    where = F.col("k") > 2
    for terms, op, w, fields in ((["alpha"], "and", None, None), (["alpha", "beta", "gamma"], "and", where, ["a"]), (["alpha", "beta", "gamma"], "or", where, None), (["beta", "beta", "nowhere"], "or", None, ["b"]), (["beta", "nowhere"], "and", None, None), ([], "or", None, None)):
        assert scores(c.scored(terms, op, where=w, fields=fields)) == scores(index.scored(terms, op, where=w, fields=fields))
    for slop, w, fields in ((0, where, None), (1, None, ["b"])):
        assert scores(c.phrase(["beta", "alpha"], slop, fields, where=w)) == scores(index.phrase(["beta", "alpha"], slop, fields, where=w))
    for fields in (None, ["b"]):
        assert scores(c.wildcard("?a*", fields)) == scores(index.wildcard("?a*", fields))
    assert scores(c.phrase(["alpha", "x", "beta"])) == scores(index.phrase(["alpha", "x", "beta"])) != {}
    assert scores(c.filtered(where)) == scores(index.filtered(where))
    bounds = index.bounds(["alpha", "beta"])
    assert all(max(scores(index.scored([t])).values()) <= bounds[t] + 1e-9 for t in bounds)
    monkeypatch.setattr("lumenfold.operators.postings.LISTED", 1)
    assert scores(c.wildcard("*a*")) == scores(index.wildcard("*a*"))
    with pytest.raises(ValueError):
        index.scored(["x"], fields=["k"])
    empty = IndexedCorpus.write(df.where("false"), "id", ["a"], str(tmp_path / "empty"))
    assert scores(empty.scored(["alpha"])) == scores(empty.phrase(["alpha"])) == scores(empty.filtered(F.lit(True))) == {}


def test_index_reads_each_document_once(spark, tmp_path, monkeypatch):
    """One pass over the texts, dealt out from a single partition; long batches are inverted a few words at a time."""
    monkeypatch.setattr("lumenfold.operators.postings.WORDS", 7)
    texts = ["the fox the", "", None, "a fox " * 9, "über den the"]
    seen = spark.sparkContext.accumulator(0)

    def read(i):
        seen.add(1)
        return texts[i]

    df = spark.range(0, 5, 1, 1).select("id", F.udf(read)("id").alias("a"))
    index = IndexedCorpus.write(df, "id", ["a"], str(tmp_path / "index"))
    assert seen.value == 5
    rows = sorted((r["term"], r["id"], r["dl"], r["tf"], list(r["positions"])) for r in index._table("postings").where("term != ''").collect())
    every = [0, 2, 4, 6, 8, 10, 12, 14, 16]
    assert rows == [("a", 3, 18, 9, every), ("den", 4, 3, 1, [1]), ("fox", 0, 3, 1, [1]), ("fox", 3, 18, 9, [x + 1 for x in every]), ("the", 0, 3, 2, [0, 2]), ("the", 4, 3, 1, [2]), ("über", 4, 3, 1, [0])]
    assert index.totals() == (5, 24 / 5)
    assert not index.frequencies([""]) and ids(index.scored([""])) == []


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_indexed_phrase_compares_places_by_document(spark, tmp_path):
    """No row for each place: the same hits as by the scan, also where the terms are all there is."""
    df = spark.createDataFrame([(0, "of the " * 50), (1, "the of x the"), (2, "of x x the"), (3, "the the of"), (4, "of of of"), (5, None)], "id int, a string")
    c, index = Corpus.of(df, "id", ["a"]), IndexedCorpus.write(df, "id", ["a"], str(tmp_path / "index"))
    for terms, slop, hits in ((["of", "the"], 0, [0]), (["of", "the"], 1, [0, 1]), (["of", "the"], 2, [0, 1, 2, 3]), (["of", "of"], 0, [4]), (["of"], 2, [0, 1, 2, 3, 4])):
        assert sorted(scores(index.phrase(terms, slop))) == sorted(scores(c.phrase(terms, slop))) == hits
    assert "Generate" not in plan(index.phrase(["of", "the"], 2))


def test_scanned_phrase_splits_a_text_once_for_hits_and_once_for_statistics(spark):
    found = corpus(spark, ["quick brown fox", "brown quick"]).phrase(["quick", "brown"])
    assert ids(found) == ["d0"] and plan(found).count("split(") == 2


def test_an_index_is_written_when_it_is_read(spark, sf_dir, tmp_path, monkeypatch):
    from lumenfold.queries import ALL

    (tmp_path / "tables").symlink_to(sf_dir)

    def write(*args):
        raise RuntimeError("written")

    monkeypatch.setattr(IndexedCorpus, "write", write)
    assert ALL["query_less"][0](spark, str(tmp_path / "tables")).collect() == []
    with pytest.raises(RuntimeError, match="written"):
        ALL["bm25_single"][0](spark, str(tmp_path / "tables"))


def test_phrase_order_slop_and_boost(spark):
    c = corpus(spark, [("adjacent", "the quick brown fox jumps"), ("scattered", "the quick red and brown fox"), ("turned", "brown quick"), ("missing", "a fox")])
    assert ids(c.phrase(["quick", "brown"])) == ["adjacent"]
    assert ids(c.phrase(["quick", "brown"], 2)) == ["adjacent", "scattered", "turned"]
    plain = {r["id"]: r["score"] for r in c.scored(["quick", "brown"]).collect()}
    assert c.phrase(["quick", "brown"]).first()["score"] == pytest.approx(1.5 * plain["adjacent"])


def test_wildcard_is_a_true_glob(spark):
    c = corpus(spark, ["hello world", "help others", "second contact", "a.b"])
    assert ids(c.wildcard("hel*")) == ["d0", "d1"]
    assert ids(c.wildcard("con*")) == ["d2"]
    assert ids(c.wildcard("a?b")) == ["d3"]


def test_request_precedence_and_query_less(spark):
    c = corpus(spark, ["quick brown", "brown quick", "slow"])
    assert ids(matches(c, Request("slow", match_phrase={"phrase": "quick brown"}, wildcard={"pattern": "s*"}))) == ["d0"]
    assert ids(matches(c, Request("quick", wildcard={"pattern": "s*"}))) == ["d2"]
    assert ids(matches(c, Request())) == []
    assert ids(matches(c, Request(filter={"match_all": {}}))) == ["d0", "d1", "d2"]


def test_pages_are_slices_of_the_whole_order(spark):
    c = corpus(spark, [(f"doc-{i:02d}", "contract " * (i + 1)) for i in range(60)])
    whole = [r["id"] for r in search(c, Request("contract", max_results=100)).page.collect()]
    page = [r["id"] for r in search(c, Request("contract", max_results=10, offset=20)).page.collect()]
    assert len(whole) == 60 and page == whole[20:30]


def test_cursor_visits_every_row_once(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 4 else None) for i in range(20)], "id int, v int")
    for order in ("asc", "desc"):
        keys = paging.sort_keys(df, [("v", order)], "id")
        seen, cursor = [], None
        while rows := paging.page(df, keys, 6, search_after=cursor).collect():
            seen += [r["id"] for r in rows]
            cursor = [rows[-1]["v"], rows[-1]["id"]]
        assert seen == [r["id"] for r in paging.ordered(df, keys).collect()] and len(seen) == 20


def test_total_hits_capped(spark):
    df = spark.range(50)
    assert tuple(paging.total_hits(df, False, 10).first()) == (10, "gte")
    assert tuple(paging.total_hits(df, False, 100).first()) == (50, "eq")
    assert tuple(paging.total_hits(df).first()) == (50, "eq")


@pytest.mark.parametrize("clause", [{"bogus": 1}, {}, {"term": {"a": 1}, "terms": {"a": [1]}}, {"bool": {"filter": []}}, {"must": []}, {"range": {"n": {"above": 1}}}, {"range": {"n": {"gte": "x"}}}, {"terms": {"s": "a"}}])
def test_bad_filters_raise(spark, clause):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    with pytest.raises(FilterError):
        predicate(df, clause)


def test_filters_on_missing_null_and_multivalued_fields(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, ["y"]), (3, "b", None)], "id int, s string, m array<string>")

    def keep(c):
        return sorted(r["id"] for r in df.where(predicate(df, c)).collect())

    assert keep({"term": {"s": "a"}}) == [1]
    assert keep({"bool": {"must_not": [{"term": {"s": "a"}}]}}) == [2, 3]
    assert keep({"term": {"m": "y"}}) == [1, 2]
    assert keep({"term": {"nowhere": 1}}) == []
    assert keep({"bool": {}}) == [1, 2, 3]
    assert keep({"bool": {"should": [{"term": {"s": "a"}}, {"term": {"m": "y"}}], "minimum_should_match": 2}}) == [1]
    assert keep({"bool": {"should": [{"term": {"s": "a"}}], "minimum_should_match": 0}}) == [1, 2, 3]


def test_aggregations(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "k string, v string")
    assert [tuple(r) for r in aggs.terms(df, "k").collect()] == [("a", 2), ("b", 1)]
    assert aggs.cardinality(df, "k").first()["value"] == 2
    pages, after = [], None
    while rows := aggs.composite(df, {"K": "k", "V": "v"}, 2, after).collect():
        pages += [tuple(r) for r in rows]
        after = {"K": rows[-1]["K"], "V": rows[-1]["V"]}
    assert pages == [("a", "x", 1), ("a", "y", 1), ("b", "x", 1)]
    with pytest.raises(ValueError):
        aggs.aggregate(df, {"q": {"percentiles": {}}})


def test_highlight_modes(spark):
    df = spark.createDataFrame([("The breathe of the",)], "t string")
    assert df.select(highlight(F.col("t"), ["the"])).first()[0] == "<b>The</b> breathe of the"
    assert df.select(highlight(F.col("t"), ["the"], mode="words")).first()[0] == "<b>The</b> breathe of <b>the</b>"


def test_dsl_bodies(spark):
    c = corpus(spark, ["quick brown fox", "lazy dog", "the dog barked at the fox"])
    r = request_of({"query": {"match": {"content": "fox"}}, "size": 1, "highlight": {"fields": {"content": {}}}, "aggs": {"n": {"cardinality": {"field": "content"}}}})
    out = response(search(c, r), "idx", "id")
    assert out["hits"]["total"] == {"value": 2, "relation": "eq"} and len(out["hits"]["hits"]) == 1
    assert "<b>fox</b>" in out["hits"]["hits"][0]["highlight"] and out["aggregations"]["n"]["value"] == 2
    for body in ({"query": {"exists": {"field": "a"}}}, {"suggest": {}}, {"query": {"bool": {"filter": [{"prefix": {"a": "b"}}]}}}):
        with pytest.raises(UnsupportedQuery):
            request_of(body)


def test_scripts(spark):
    df = spark.createDataFrame([(1, "k")], "a int, b string")
    values = script_values({"source": "ctx._source.a = 7; ctx._source.b = ctx._source.a", "params": {}})
    assert df.select(values["a"](df)).first()[0] == 7
    with pytest.raises(UnsupportedQuery):
        script_values({"source": "ctx._source.a += 1"})


def test_dsl_keeps_the_structure_of_nested_bools(spark):
    df = spark.createDataFrame([(f"d{i}", "fox", a, b) for i, (a, b) in enumerate([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)])], "id string, content string, a int, b int")
    either = lambda f, *v: {"bool": {"should": [{"term": {f: x}} for x in v]}}
    body = {"query": {"bool": {"must": [{"match": {"content": "fox"}}, either("a", 1, 2), either("b", 2)], "must_not": [{"bool": {"must": [{"term": {"a": 2}}, {"term": {"b": 2}}]}}]}}}
    c = Corpus.of(df, "id", ["content"])
    assert ids(matches(c, request_of(body))) == ["d1"]
    assert ids(matches(c, request_of({"query": {"bool": {"must": [either("a", 1), either("b", 1)]}}}))) == ["d0"]
    with pytest.raises(ValueError):
        matches(c, request_of({"query": {"match": {"a": "fox"}}}))
    for clause in ({"match": {"content": {"query": "fox", "fuzziness": 1}}}, {"multi_match": {"query": "fox", "fields": ["content^2"]}}, {"function_score": {"query": {"match_all": {}}, "functions": []}}, {"bool": {"musty": []}}):
        with pytest.raises(UnsupportedQuery):
            request_of({"query": clause})


def test_dsl_refuses_clauses_it_would_drop():
    text, phrase, glob = {"match": {"content": "fox"}}, {"match_phrase": {"content": "red fox"}}, {"wildcard": {"content": "f*"}}
    near = {"knn": {"v": {"vector": [1.0]}}}
    for pair in ([text, phrase], [phrase, text], [phrase, phrase], [glob, glob], [text, glob], [phrase, glob], [near, near]):
        with pytest.raises(UnsupportedQuery):
            request_of({"query": {"bool": {"must": pair}}})
    with pytest.raises(UnsupportedQuery):
        request_of({"query": near, "knn": {"field": "v", "vector": [1.0]}})
    both = request_of({"query": {"bool": {"must": [text, near]}}})
    assert both.query_text == "fox" and both.knn["field"] == "v"
