import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators.vector import ClusterIndex, _assign, exact_knn, probe_budget, with_cosine
from lumenfold.sources.readers import bulk_actions, bulk_items, read_jsonl, read_vector_shards
from lumenfold.sources.schema import field_of, infer_roles, native, typed
from lumenfold.sources.table import Conflict, SnapshotTable
from lumenfold.streaming.ingest import event_counts, ingest, stream_parquet

SCHEMA = "id int, title string, at string"


def rows(t, version=None):
    return sorted(tuple(r) for r in t.read(version).collect())


def test_upsert_patch_delete_compact(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["id"], spark.createDataFrame([], SCHEMA).schema)
    assert rows(t) == []
    t.upsert(spark.createDataFrame([(1, "hello", "old"), (2, "b", "old"), (3, "c", "old")], SCHEMA))
    t.upsert(spark.createDataFrame([(2, "first", "x", 1), (2, "second", "y", 2)], SCHEMA + ", o int"), "o")
    t.patch(spark.createDataFrame([(1, "new"), (9, "only")], "id int, at string"))
    assert rows(t) == [(1, "hello", "new"), (2, "second", "y"), (3, "c", "old"), (9, None, "only")]
    t.delete_by_query({"term": {"id": 3}})
    t.update_by_query({"term": {"id": 2}}, {"title": F.lit("set")})
    before = rows(t)
    assert (2, "set", "y") in before and all(r[0] != 3 for r in before)
    assert t.stats()["segments"] > 1
    t.compact(full=True)
    assert rows(t) == before and t.stats()["segments"] == 1
    assert len(rows(t, 1)) == 3  # an old version stays readable
    t.upsert(spark.createDataFrame([(3, "again", "z")], SCHEMA))
    assert (3, "again", "z") in rows(t)
    found = {r["id"]: r["found"] for r in t.exists(spark.createDataFrame([(1,), (77,)], "id int")).collect()}
    assert found == {1: True, 77: False}


def test_second_writer_gets_a_conflict(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["id"], spark.createDataFrame([], SCHEMA).schema)
    base = t.manifest()
    t.publish(base)
    with pytest.raises(Conflict):
        t.publish(base)
    with pytest.raises(Conflict):
        t.rebuild_manifest()


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    make = lambda: SnapshotTable(spark, str(tmp_path / "t"), ["id"], spark.createDataFrame([], SCHEMA).schema)
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda i: make().upsert(spark.createDataFrame([(i, "w", "x"), (99, f"w{i}", "x")], SCHEMA)), range(4)))
    assert sorted(versions) == [1, 2, 3, 4]
    got = rows(make())
    assert [r[0] for r in got] == [0, 1, 2, 3, 99] and len(make()._list(str(tmp_path / "t/versions"))) == 4
    make().rebuild_manifest(overwrite=True)  # nothing is left of the tries that came second
    assert rows(make()) == got


def test_patches_of_one_key_are_folded(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["id"], spark.createDataFrame([], SCHEMA).schema)
    t.upsert(spark.createDataFrame([(1, "a", "b")], SCHEMA))
    t.patch(spark.createDataFrame([(1, None, "second", 2), (1, "first", "first", 1), (7, "new", None, 1)], SCHEMA + ", o int"), "o")
    assert rows(t) == [(1, "first", "second"), (7, "new", None)]
    t.patch(spark.createDataFrame([(1, "x", None), (1, None, "y"), (1, "z", None)], SCHEMA).coalesce(1))
    assert rows(t)[0] == (1, "z", "y")
    t.upsert(spark.createDataFrame([(1, "p", "p"), (1, "q", "q")], SCHEMA).coalesce(1))
    assert rows(t)[0] == (1, "q", "q")


def test_merges_by_size_retire_deletes_and_survive_an_import(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), ["id"], spark.createDataFrame([], SCHEMA).schema)
    for i in range(4):
        t.upsert(spark.createDataFrame([(i, "a", "b"), (50, f"v{i}", "b")], SCHEMA))
    t.delete_by_query({"term": {"id": 2}})
    before = rows(t)
    assert len(t.merge_inputs()) == 4 and t.merge_inputs(max_bytes=1) == [] and t.needs_compaction(trigger=4)
    t.compact(max_inputs=2)
    assert rows(t) == before and len(t.manifest()["segments"]) == 3
    each = max(s["bytes"] for s in t.manifest()["segments"])
    t.compact(full=True, max_bytes=2 * each)
    assert rows(t) == before and len(t.manifest()["segments"]) == 2 and t.manifest()["deletes"] == []
    t.rebuild_manifest(overwrite=True)
    assert rows(t) == before
    t.vacuum()
    assert rows(t) == before and t.removable() == []
    t.replace_all(spark.createDataFrame([(5, "only", "x")], SCHEMA))
    assert rows(t) == [(5, "only", "x")]


def test_stream_replaces_by_key(spark, tmp_path):
    a = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], SCHEMA)
    a.write.parquet(str(tmp_path / "in"))
    t = SnapshotTable(spark, str(tmp_path / "t"), ["id"], a.schema)
    ingest(stream_parquet(spark, str(tmp_path / "in"), a.schema), t, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(2, "new", "y")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(stream_parquet(spark, str(tmp_path / "in"), a.schema), t, str(tmp_path / "c")).awaitTermination()
    assert rows(t) == [(1, "a", "x"), (2, "new", "y")]


def test_event_counts_plan(spark):
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type")
    assert event_counts(events).first()["n"] == 1


def test_json_lines_bulk_and_shards(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "title": "x", "n": 2, "f": 1.5, "ok": true, "v": [1,2,3,4,5,6,7,8]}\n{"id": "2", "fields": [{"name": "title", "field_type": "Text", "value": "y"}]}\n')
    df = typed(read_jsonl(spark, str(tmp_path / "a.jsonl")), {"title": "Text", "n": "Integer", "f": "Float", "ok": "Boolean", "v": "Vector"})
    assert [tuple(r)[:5] for r in df.orderBy("id").collect()] == [("1", "x", 2, 1.5, True), ("2", "y", None, None, None)]
    up, patch = bulk_actions(spark, [json.dumps(x) for x in ({"index": {"_id": "1"}}, {"a": 1}, {"update": {"_id": "2"}}, {"doc": {"a": 2}})])
    assert (up.count(), patch.count()) == (1, 1)
    body = ['{"delete": {"_id": "1"}}', '{"create": {"_id": "2", "_index": "x"}}', '{"a": 1}']
    assert bulk_items(body) == [{"delete": {"_id": "1", "status": 501, "error": "delete by query instead"}}, {"create": {"_id": "2", "status": 201, "_index": "x"}}]
    assert [r["id"] for r in bulk_actions(spark, body)[0].collect()] == ["2"]
    with pytest.raises(ValueError):
        bulk_actions(spark, ['{"merge": {"_id": "1"}}'])
    np.arange(8, dtype="<f4").tofile(tmp_path / "emb-0.f32")
    (tmp_path / "emb-0.ids").write_text("p\nq\n")
    got = {r["id"]: r["embedding"] for r in read_vector_shards(spark, str(tmp_path / "*.f32"), str(tmp_path / "*.ids"), 4).collect()}
    assert got == {"p": [0, 1, 2, 3], "q": [4, 5, 6, 7]}


def test_field_roles(spark):
    assert field_of("a", True)["field_type"] == "Boolean" and field_of("a", None) is None
    assert field_of("a", [1.0] * 8)["field_type"] == "Vector" and field_of("a", [1.0])["field_type"] == "Keyword"
    df = spark.createDataFrame([(1, "x", [1.0])], "id int, s string, v array<double>")
    assert infer_roles(df) == {"id": "Integer", "s": "Text", "v": "Vector"}
    assert {f["name"] for f in native(df, "id").first()["fields"]} == {"s", "v"}


def test_cosine_of_odd_vectors_and_exact_knn(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0]), (6, [])], "id int, v array<double>")
    got = {r["id"]: round(r["cosine"], 6) for r in with_cosine(df, "v", [1.0, 0.0]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: round(0.5**0.5, 6), 6: 0.0}
    assert [r["id"] for r in exact_knn(df, "id", "v", [1.0, 0.0], 2).collect()] == [1, 5]


def test_cluster_index_recall_insert_delete(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 32)) * 10
    points = [(i, (centres[i % 20] + rng.standard_normal(32) * 0.5).tolist()) for i in range(1000)]
    df = spark.createDataFrame(points, "id int, v array<double>")
    index = ClusterIndex.build(df, "id", "v").save(str(tmp_path / "i"))
    assert index.stats().first()["most"] <= 128
    for q in range(3):
        want = [r["id"] for r in exact_knn(df, "id", "v", points[q][1], 10).collect()]
        assert [r["id"] for r in index.proven(points[q][1], 10, 1).collect()] == want
    hit = 0
    for q in range(5):
        exact = {r["id"] for r in exact_knn(df, "id", "v", points[q][1], 10).collect()}
        hit += len(exact & {r["id"] for r in index.knn(points[q][1], 10, 4).collect()})
    assert hit >= 45
    fewer = index.delete(spark.createDataFrame([(0,)], "id int"))
    assert fewer.members.count() == 999
    more = fewer.insert(spark.createDataFrame([(5000, points[0][1])], "id int, v array<double>"), "id", "v")
    assert more.knn(points[0][1], 1, 3).first()["id"] == 5000
    # Small groups take several levels, and centroids go to the workers in several parts.
    deep = ClusterIndex.build(df, "id", "v", most=20, group=60)
    assert deep.members.count() == 1000 and deep.stats().first()["most"] <= 20
    ids = [r["id"] for r in exact_knn(df, "id", "v", points[3][1], 5).collect()]
    assert [r["id"] for r in deep.knn(points[3][1], 5, 10**6).collect()] == ids
    rows = df.select("id", "v")
    one, many = (sorted(map(tuple, _assign(rows, index.centroids, most).select("id", "cluster").collect())) for most in (10**6, 5))
    assert one == many and len(one) == 1000
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)], "id int, v array<double>")
    assert ClusterIndex.build(same, "id", "v", group=100).stats().first()["most"] <= 128
    assert ClusterIndex.build(df.where("false"), "id", "v").members.count() == 0
    assert (probe_budget(10, 1000), probe_budget(100, 1000), probe_budget(1, 10**7)) == (50, 100, 20_000)
