import json

import pytest

from lumenfold.plans.engine import Engine

FIELDS = {"title": "Text", "matter": "Keyword", "n": "Integer", "ok": "Boolean", "v": "Vector"}


def test_a_namespace_from_indexing_to_compaction(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    ns = engine.namespace("cases", FIELDS)
    assert ns.search({"query": {"match": {"title": "fox"}}}).page.count() == 0  # nothing was written yet
    ns.index(spark.createDataFrame([("d1", "quick brown fox", "m1", 3), ("d2", "lazy dog", "m1", 5), ("d3", "the dog barked at the fox", "m2", 10)], "id string, title string, matter string, n int"))
    assert [r["id"] for r in ns.query("fox").collect()] == ["d1", "d3"]
    assert ns.count() == 3 and ns.count({"query": {"bool": {"filter": [{"term": {"matter": "m1"}}]}}}) == 2
    out = ns.respond({"query": {"match": {"title": "dog"}}, "sort": [{"n": {"order": "desc"}}]})
    assert [h["_id"] for h in out["hits"]["hits"]] == ["d3", "d2"] and out["hits"]["hits"][0]["_source"]["n"] == 10
    ns.replace(spark.createDataFrame([("d2", "m9")], "id string, matter string"))
    assert ns.respond({"query": {"term": {"matter": "m9"}}})["hits"]["hits"][0]["_source"]["title"] == "lazy dog"
    lines = [json.dumps(x) for x in ({"index": {"_id": "d4"}}, {"title": "first", "n": 1}, {"index": {"_id": "d4"}}, {"title": "second", "n": 2, "ok": True}, {"update": {"_id": "d1"}}, {"doc": {"n": 99}})]
    ns.bulk(lines)
    rows = {r["id"]: r for r in ns.table.read().collect()}
    assert rows["d4"]["title"] == "second" and rows["d4"]["ok"] is True and rows["d1"]["n"] == 99 and rows["d1"]["title"] == "quick brown fox"
    assert ns.exists(["d1", "nope", "d1"]) == (["d1"], ["nope"])
    ns.delete({"range": {"n": {"gte": 99}}})
    ns.update({"term": {"id": "d3"}}, {"source": "ctx._source.matter = 'closed'"})
    assert ns.exists(["d1"]) == ([], ["d1"])
    before = sorted(map(tuple, ns.table.read().select("id", "matter").collect()))
    ns.compact(full=True)
    assert sorted(map(tuple, ns.table.read().select("id", "matter").collect())) == before and ("d3", "closed") in before
    assert engine.names() == ["cases"] and engine.stats().first()["segments"] == 1
    assert ns.stats()["documents"] == 3


def test_neighbours_in_a_namespace(spark, tmp_path):
    ns = Engine(spark, str(tmp_path)).namespace("v", FIELDS)
    ns.index(spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0]), ("c", "x", None)], "id string, title string, v array<float>"))
    hits = ns.search({"knn": {"field": "v", "query_vector": [1.0, 0.1], "k": 1}}).page.collect()
    assert [r["id"] for r in hits] == ["a"] and hits[0]["score"] == pytest.approx(19.95, abs=0.01)


def test_searches_use_what_was_built_for_their_version(spark, tmp_path):
    ns = Engine(spark, str(tmp_path)).namespace("v", FIELDS)
    ns.index(spark.createDataFrame([(f"d{i}", "red fox" if i % 2 else "dog", [float(i), 1.0]) for i in range(40)], "id string, title string, v array<float>"))
    plain = [tuple(r)[:2] for r in ns.query("fox", 40).collect()]
    ns.build_index()
    ns.build_clusters("v")
    assert type(ns.corpus()).__name__ == "IndexedCorpus" and [tuple(r)[:2] for r in ns.query("fox", 40).collect()] == plain
    body = {"knn": {"field": "v", "query_vector": [1.0, 0.5], "k": 3, "num_candidates": 5}}
    assert [r["id"] for r in ns.search(body).page.collect()] == ["d2", "d3", "d4"]
    ns.delete({"term": {"id": "d1"}})
    assert type(ns.corpus()).__name__ == "Corpus" and len(ns.query("fox", 40).collect()) == len(plain) - 1


def test_bad_names_and_roles(spark, tmp_path):
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path)).namespace("../x", FIELDS)
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path)).namespace("x", {"a": "Blob"})
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path)).namespace("x", {"a": "Keyword"}).corpus()
