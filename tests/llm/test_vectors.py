"""Operators over vectors, the quality classifier and the pipeline, against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumenfold.llm import capfilter, curves, quality
from lumenfold.llm.minhash import near_duplicates
from lumenfold.llm.oracles import oracle_sql
from lumenfold.llm.queries import queries
from lumenfold.llm.suffix import repeated_passages

SCHEMA = "vec_id bigint, embedding array<float>, label int"
ODD = [(None, [1.0, 0.0]), (-1, None), (-2, []), (-3, [0.0, 0.0, 0.0, 0.0]), (-4, [float("nan"), 1.0, 0.0, 0.0]), (-5, [None, 1.0, 0.0, 0.0]), (-6, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def crowded(spark, rows):
    return spark.createDataFrame([(i, v, 0, *["x"] * 6) for i, v in rows], SCHEMA + ", bucket string, doc_id string, `id` string, v string, curve string, norm string")


def clustered(n, dim, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8 + 1, dim))
    return [(i, (centres[i // 8] + spread * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


def unit(rows):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# -- 1


@pytest.mark.parametrize("name", ["op1_space_filling_ann", "op2_cap_filter_near_duplicates"])
def test_query_matches_sql(name, same):
    same(queries()[name], oracle_sql()[name])


def test_hilbert_keys_visit_every_cell_in_neighbouring_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = curves.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("spread", [0.25, 30.0])
def test_neighbours_reach_the_recall(spark, spread):
    """Also on vectors without any structure; every row is a query."""
    rows = clustered(2000, 24, 4, spread)
    out = curves.nearest_neighbours(frame(spark, rows + ODD[:6]), k=5, block=64, sample=100).collect()
    s = unit(rows) @ unit(rows).T
    np.fill_diagonal(s, -9)
    exact = np.argsort(-s, axis=1)[:, :5]
    found = {(r["vec_id"], r["neighbour_id"]) for r in out}
    hit = sum((i, int(j)) in found for i in range(len(rows)) for j in exact[i])
    assert hit / exact.size >= 0.9
    assert Counter(Counter(r["vec_id"] for r in out).values()) == {5: 2000}
    for r in out[:200]:
        assert r["cosine"] == pytest.approx(s[r["vec_id"], r["neighbour_id"]], abs=1e-5)


def test_share_of_candidates_falls_with_the_table(spark):
    """Of vectors that lie in groups, a query meets a smaller share the more there are; only queries have rows."""
    shares = []
    for n in (1000, 4000):
        told = []
        rows = clustered(n, 24, 4, 0.1)
        out = curves.nearest_neighbours(frame(spark, rows), k=5, every=50, block=64, told=told).collect()
        (looked, _, _, blocks), = told
        shares.append(looked / blocks)
        s = unit(rows)[::50] @ unit(rows).T
        s[np.arange(len(s)), np.arange(len(s)) * 50] = -9
        exact = np.argsort(-s, axis=1)[:, :5]
        found = {(r["vec_id"], r["neighbour_id"]) for r in out}
        assert {i for i, _ in found} == set(range(0, n, 50))
        assert sum((50 * i, int(j)) in found for i in range(len(s)) for j in exact[i]) >= 0.9 * exact.size
    assert shares[1] < 0.6 * shares[0]


def test_neighbours_of_extreme_norms(spark):
    rows = [(i, [x * f for x in v]) for i, ((_, v), f) in enumerate(zip(clustered(40, 4, 3), itertools.cycle([1.0, 1e200, 1e-200])))] + [(90, [float("inf"), 1.0, 0.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = curves.nearest_neighbours(docs, k=3, every=10)
    assert Counter(r["vec_id"] for r in got.collect()) == {0: 3, 10: 3, 20: 3, 30: 3}
    assert all(r["vec_id"] != 90 and r["kept_id"] != 90 for r in capfilter.near_duplicate_vectors(docs).collect())


def test_neighbours_at_the_edges(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0, 0.0])]
    out = curves.nearest_neighbours(crowded(spark, rows + ODD), k=2).orderBy("vec_id", "rank").collect()
    assert [(r["vec_id"], r["neighbour_id"], r["rank"], r["cosine"]) for r in out] == [(1, 2, 1, 1.0), (1, 3, 2, 1.0), (2, 1, 1, 1.0), (2, 3, 2, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0)]
    assert curves.nearest_neighbours(frame(spark, [])).count() == 0
    assert curves.nearest_neighbours(frame(spark, ODD)).count() == 0


def test_best_keep_the_least_ids_of_many_ties():
    x = np.tile([[0.6, 0.8]], (300, 1))
    ids = np.random.default_rng(3).permutation(300)
    s, found = curves.top(x, ids, x, ids, 10, None)
    assert (found == [[i for i in range(11) if i != q][:10] for q in ids]).all() and np.allclose(s, 1)


def test_equal_vectors_have_the_least_ids_of_their_set(spark):
    """Sets larger than a block, with others as near in another length of the same direction."""
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, (_, v) in enumerate(clustered(400, 16, 6))]
    same, twice = rows[5][1], [2 * x for x in rows[5][1]]
    rows += [(1000 + i, same) for i in range(300)] + [(2000 + i, rows[9][1]) for i in range(3)] + [(-50 - i, twice) for i in range(4)]
    out = curves.nearest_neighbours(frame(spark, [rows[i] for i in rng.permutation(len(rows))]), k=5, block=64, sample=100).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    assert set(got) == {i for i, _ in rows} and {len(v) for v in got.values()} == {5}
    for i in [5, *range(1000, 1300), *range(-53, -49)]:
        assert got[i] == [j for j in (-53, -52, -51, -50, 5, 1000) if j != i][:5]
    for i in (9, 2000, 2001, 2002):
        assert got[i][:3] == [j for j in (9, 2000, 2001, 2002) if j != i]


# -- 2


def groups(rows, threshold):
    s, root = unit(rows) @ unit(rows).T, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in np.argwhere(np.triu(s >= threshold, 1)):
        p, q = sorted((find(rows[x][0]), find(rows[y][0])))
        root[q] = p
    return {(i, find(i)) for i, _ in rows if find(i) != i}


def test_near_vectors_match_brute_force(spark):
    rows = clustered(1200, 64, 9, 0.22)
    out = capfilter.near_duplicate_vectors(frame(spark, rows + ODD[:6])).collect()
    exact = groups(rows, 0.9)
    found = {(r["vec_id"], r["kept_id"]) for r in out}
    # A missed link may leave a vector with another representative; no vector is grouped that has no partner.
    assert len(exact) > 500 and len(found & exact) >= 0.97 * len(exact) and {i for i, _ in found} | {j for _, j in found} <= {i for i, _ in exact} | {j for _, j in exact}
    sizes = Counter(r["kept_id"] for r in out)
    assert all(r["group_size"] == sizes[r["kept_id"]] + 1 for r in out)


def test_filters_hit_about_as_often_as_asked():
    x = np.random.default_rng(0).standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = capfilter.ProductCode(64, 50_000, 32.0, 11)
    vec, cell = code.listed(x)
    assert 16 <= len(vec) / 400 <= 64
    # Branch and bound lists exactly the filters that are exceeded.
    small = capfilter.ProductCode(8, 10, 16.0, 1)
    y = x[:50, :8] / np.linalg.norm(x[:50, :8], axis=1, keepdims=True)
    vec, cell = small.listed(y)
    turned = y @ small.rotation
    scores = [turned[:, a:b] @ d.T for a, b, d in zip(small.cuts, small.cuts[1:], small.directions)]
    total = scores[0]
    for s in scores[1:]:
        total = (total[:, :, None] + s[:, None, :]).reshape(len(y), -1)
    assert set(zip(vec.tolist(), cell.tolist())) == set(map(tuple, np.argwhere(total >= small.height).tolist()))


@pytest.mark.parametrize("dim", [2, 8, 16, 64])
@pytest.mark.parametrize("count", [500, 50_000, 3_000_000])
def test_isolated_pairs_meet_on_a_filter(dim, count):
    """Also where the table is large or vectors are short; every vector has a filter."""
    x, y = capfilter.simulated_pairs(dim, 0.9, 400, 77)
    code = capfilter.ProductCode(dim, count, 32.0, 11)
    of_x, of_y = ({*zip(*map(np.ndarray.tolist, code.listed(u, code.own)))} for u in (x, y))
    assert {i for i, _ in of_x} == {i for i, _ in of_y} == set(range(400))
    assert len({i for i, _ in of_x & of_y}) >= 0.95 * 400
    assert len(of_x) <= 4 * 32 * 400


def test_near_vectors_of_one_id_and_infinities(spark):
    """Another vector of an id that is a copy still joins what it is near to; infinite vectors join nothing."""
    a, b, near_b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.2], [0.0, 1.0, 0.0, 0.25]
    inf = [float("inf"), 0.0, 0.0, 1.0]
    out = capfilter.near_duplicate_vectors(frame(spark, [(1, a), (5, a), (5, b), (9, near_b), (20, inf), (21, inf)])).collect()
    assert {(r["vec_id"], r["kept_id"]) for r in out} == {(5, 1), (9, 1)}


def test_near_vectors_at_the_edges(spark):
    v = [0.3, 0.1, 0.5, 0.2]
    out = capfilter.near_duplicate_vectors(crowded(spark, [(5, v), (3, v), (3, v), (9, [x * 2 for x in v]), (4, [-x for x in v])] + ODD + [(-7, [0.0] * 4)])).collect()
    assert {tuple(r) for r in out} == {(5, 3, 3), (9, 3, 3)}
    assert capfilter.near_duplicate_vectors(frame(spark, [])).count() == 0


# -- 10


def test_features_are_of_each_text_alone():
    from lumenfold.llm import text as T
    import pyarrow as pa

    texts = ["", "A b c.\nA b c.\n", "x" * 100_000, "ä 1 2 3 !!", None, "the quick brown fox"]
    (_, _, data, off), = T.pieces(pa.array(texts))
    whole = quality.features(data, off)
    for t, row in zip(texts, whole):
        (_, _, d, o), = T.pieces(pa.array([t or ""]))
        assert np.allclose(quality.features(d, o)[0], row)
    assert np.isfinite(whole).all()


def test_prior_and_nonnegative_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (6000, quality.FEATURES)), rng.normal(-1.5, 1, (6000, quality.FEATURES))
    good[:, 3:], bad[:, 3:] = rng.normal(0, 1, (6000, quality.FEATURES - 3)), rng.normal(0, 1, (6000, quality.FEATURES - 3))
    for prior in (0.3, 0.7):
        n = int(3000 * prior)
        model = quality.train(good[:1500], np.concatenate((good[2000 : 2000 + n], bad[: 3000 - n])))
        assert abs(model.prior - prior) < 0.12
        assert (model.score(good[5000:]) > 0.5).mean() > 0.9 and (model.score(bad[5000:]) < 0.5).mean() > 0.8


def test_risk_is_at_its_minimum_over_all_unlabelled_rows(spark):
    """The fitted weights against the risk written out anew: no small change of them lowers it. The start comes from a tenth of the rows, which differ from the rest."""
    rng = np.random.default_rng(4)
    k = quality.FEATURES
    positive = rng.normal(0.1, 1, (2000, k))
    rows = np.concatenate((rng.normal(0.1, 1, (400, k)), rng.normal(-0.1, 1, (400, k)), rng.normal(0.1, 1, (3200, k)), rng.normal(-0.1, 1.2, (4000, k)))).astype(np.float32).astype(float)
    table = spark.createDataFrame([(x.tolist(),) for x in rows], "x array<float>").repartition(3)
    decay = 1e-3
    one, other = (quality.train(positive, rows[:800], u, 0.3, decay=decay, passes=12) for u in (quality.Unlabelled(table), quality.Unlabelled(rows)))
    assert np.allclose(one.weights, other.weights, atol=1e-6) and np.allclose(one.mean, np.concatenate((positive, rows)).mean(0))

    def risk(w, b):
        z = lambda x: quality.expand((x - one.mean) / one.scale) @ w + b
        p, u = z(positive), z(rows)
        plus = lambda v: np.log1p(np.exp(-np.abs(v))) + np.maximum(v, 0)
        return 0.3 * plus(-p).mean() + max(0.0, plus(u).mean() - 0.3 * plus(p).mean()) + decay / 2 * (w @ w)

    least = risk(one.weights, one.bias)
    for _ in range(40):
        d = rng.standard_normal(2 * k + 1)
        for size in (0.02, -0.02, 0.3):
            e = size * d / np.linalg.norm(d)
            assert risk(one.weights + e[:-1], one.bias + e[-1]) >= least - 1e-7
    start = quality.train(positive, rows[:800], None, 0.3, decay=decay)
    assert risk(start.weights, start.bias) > least


def test_quality_on_held_out_labels(spark):
    """The model sees labels of one half; accuracy is measured on the other."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    out = {r["doc_id"]: r["keep"] for r in quality.quality_scores(docs, seen).collect()}
    assert len(out) == docs.count()
    held = [(out[r["doc_id"]], r["quality"] == 1) for r in labels.where("doc_id % 2 = 1").collect()]
    good, bad = [k for k, q in held if q], [k for k, q in held if not q]
    assert sum(good) / len(good) >= 0.9 and 1 - sum(bad) / len(bad) >= 0.6


def test_quality_at_the_edges(spark):
    docs = spark.createDataFrame([(1, "fine text", "x"), (1, "fine text", "x"), (None, "x", "x"), (2, None, "x"), (3, "", "x"), (4, "long " * 200_000, "x")], "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = sorted((r["doc_id"] or 0, r["score"], r["keep"]) for r in quality.quality_scores(docs, none).collect())
    assert got == [(0, 0.5, True), (1, 0.5, True), (1, 0.5, True), (2, 0.0, False), (3, 0.0, False), (4, 0.5, True)]
    some = spark.createDataFrame([(1, 1), (None, 1), (77, 1), (3, None)], "doc_id bigint, quality int")
    assert quality.quality_scores(docs, some).count() == 6
    assert quality.quality_scores(docs.where("false"), some).count() == 0


# -- the pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(0)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared = text(70)
    rows = [(i, text(rng.randrange(60, 300)), rng.choice(["en", "de"]), rng.choice("ab")) for i in range(1, 61)]
    rows += [(100 + i, rows[i][1] + " w1", "en", "a") for i in range(5)] + [(200 + i, f"{text(100)} {shared} {text(90)}", "en", "b") for i in range(4)]
    rows += [(300, "you are an idiot and a moron " + text(50), "en", "a"), (301, None, "en", "a"), (302, "", None, None), (None, text(30), "de", "b")]
    spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    ids = lambda df: sorted(r["doc_id"] or -1 for r in df.select("doc_id").collect())
    assert ids(seen["toxicity"][1]) == [i for i in ids(seen["toxicity"][0]) if i != 300]
    assert ids(seen["near_duplicates"][1]) == [i for i in ids(seen["near_duplicates"][0]) if i not in range(100, 105)]
    assert near_duplicates(seen["near_duplicates"][1]).count() == 0
    assert repeated_passages(seen["repeated_passages"][1]).count() == 0
    cut = {r["doc_id"]: r["text"] for r in seen["repeated_passages"][1].collect()}
    assert [shared in (cut[200 + i] or "") for i in range(4)] == [True, False, False, False]
    mixed = Counter(ids(seen["mixing"][1]))
    assert set(mixed) == set(ids(seen["mixing"][0]))  # nothing is lost
    packed = Counter()
    for r in seen["packing"][1].collect():
        assert r["total_words"] == sum(r["n_words"]) <= 2048
        for i, n in zip(r["doc_ids"], r["n_words"]):
            packed[i or -1] += n
    for r in seen["mixing"][1].groupBy("doc_id").agg({"text": "max"}).collect():
        n = len((r[1] or "").split())
        assert packed[r["doc_id"] or -1] == n * mixed[r["doc_id"] or -1]
    direct = corpus_pipeline.run(spark, str(tmp_path))
    assert direct.agg({"total_words": "sum"}).first()[0] == sum(packed.values())


def test_near_vectors_of_a_larger_table_need_little_disk(spark):
    """Shuffles write each vector some times, not each pair; a member of any two is told by its cosine alone."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((20_000, 64))
    x[10_000:10_400] = x[:400] + 0.4 * rng.standard_normal((400, 64))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    docs = frame(spark, rows).repartition(4).cache()
    docs.count()
    written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    found = {(r["vec_id"], r["kept_id"]) for r in capfilter.near_duplicate_vectors(docs).collect()}
    exact = groups(rows, 0.9)
    assert len(exact) > 300 and found <= exact and len(found) >= 0.97 * len(exact)
    assert written() - before < 16 * x.size * 4


@pytest.mark.parametrize("spread", [0.22, 0.05])
def test_full_cells_are_cut_and_lose_nothing(spark, monkeypatch, spread):
    """All vectors in one cell, which is cut into parts of 50; exact for tables as small as this, rounding of the last digits aside."""
    monkeypatch.setattr(capfilter, "CELL", 64 * 100)
    rows = clustered(1200, 64, 9, spread)
    out = capfilter.near_duplicate_vectors(frame(spark, rows + ODD[:6])).collect()
    assert {(r["vec_id"], r["kept_id"]) for r in out} == groups(rows, 0.9)
    whole = [(i, [1.0 + 0.001 * (i % 7), *v[1:]]) for i, v in enumerate([[0.5, 0.25, 0.125, 0.1 + i / 9000] for i in range(900)])]
    monkeypatch.setattr(capfilter, "CELL", 4 * 100)
    assert {tuple(r) for r in capfilter.near_duplicate_vectors(frame(spark, whole)).collect()} == {(i, 0, 900) for i in range(1, 900)}
