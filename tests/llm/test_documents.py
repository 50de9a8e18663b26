"""Operators over documents, each against a brute-force version and at its edges."""

import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenfold.llm import minhash, mixing, packing, sharding, suffix, text, tokencodec, toxicity
from lumenfold.llm.components import components
from lumenfold.llm.oracles import oracle_sql
from lumenfold.llm.queries import queries
from lumenfold.llm.scratch import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside, as extra columns of the input.
CLASH = "bucket string, kept_id bigint, tokens bigint, rate double, copies int, root bigint, a bigint, b bigint, start_word int, problem int, v array<double>, `i` bigint, t string, x0 int"
EXTRA = ("z", 1, 2, 0.5, 3, 4, 5, 6, 7, 8, [1.0], 9, "t", 0)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source) as documents."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


def texts(spark, pairs):
    return frame(spark, [(i, t, "en", "s") for i, t in pairs])


def crowded(spark, pairs):
    return spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in pairs], f"{SCHEMA}, {CLASH}")


def split(t):
    return [w for w in re.split("[\x00-\x20]+", t) if w]


ODD = [(None, "a null id " * 40), (90, None), (91, ""), (92, " \n\t "), (93, "one"), (94, "ä ö ü 漢字  x")]


@pytest.mark.parametrize("name", ["op3_minimax_shards", "op4_entropy_mix", "op5_suffix_repeats", "op9_minhash_near_duplicates"])
def test_query_matches_sql(name, same):
    same(queries()[name], oracle_sql()[name])


# -- words


def test_words_and_ranges():
    data = np.frombuffer("ab  c\n\x00d é".encode(), np.uint8)
    s, e, first = text.words(data, np.array([0, 2, len(data)]))
    assert [bytes(data[i:j]).decode() for i, j in zip(s, e)] == ["ab", "c", "d", "é"] and first.tolist() == [0, 1, 4]


# -- 6


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton_on_all_short_words():
    for a in map("".join, itertools.product("ab", repeat=4)):
        auto = toxicity.Levenshtein(a, 2)
        for n in range(6):
            for b in map("".join, itertools.product("abc", repeat=n)):
                state = auto.start
                for c in b:
                    state = auto.step(state, c)
                assert auto.edits(state) == (d if (d := edits(a, b)) <= 2 else None), (a, b)


def test_lexicon_matches_brute_force():
    rng = random.Random(2)
    lex = toxicity.Lexicon(toxicity.LEXICON, toxicity.ORDINARY)
    terms = list(toxicity.LEXICON)
    found = 0
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", rng.choice("abcdefgst")])
        w = "".join(w)
        near = [(edits(w, t), t) for t in terms if w and (t[0] == w[0] or len(t) >= 6) and edits(w, t) <= toxicity.allowed_edits(t)]
        expected = None if w in toxicity.ORDINARY or not near else (min(near)[1], min(near)[0])
        assert lex.match(w) == expected, w
        data = np.frombuffer(w.encode(), np.uint8)
        if expected:  # whatever matches is a candidate
            found += 1
            assert len(lex.candidates(data, np.array([0]), np.array([len(data)]))) == 1, w
    assert found > 500


def rejected(spark, pairs, **kw):
    return sorted(r["doc_id"] for r in toxicity.toxic_documents(texts(spark, pairs), **kw).collect())


def test_toxic_context(spark):
    filler = "the weather was fine and the meeting went on for a while "
    pairs = [
        (1, filler + "you are an idiot and everyone knows"),
        (2, filler + "she said the word idiot was banned from the forum"),
        (3, filler + 'he wrote "idiot" on the board'),
        (4, filler + "you are a worthles piece of work"),
        (5, filler + "nothing to see here"),
        (6, filler * 3000 + "what a moron"),
        (7, filler + "„idiot“ stood there"),
    ]
    assert rejected(spark, pairs) == [1, 4, 6]
    assert rejected(spark, pairs + ODD) == [1, 4, 6]
    assert rejected(spark, []) == [] and rejected(spark, [(1, "an idiot"), (1, "an idiot")]) == [1, 1]


def test_drop_toxic_keeps_columns_rows_and_nulls(spark):
    docs = crowded(spark, [(1, "an idiot"), (2, "fine"), (2, "fine"), (None, None)])
    out = toxicity.drop_toxic(docs)
    assert out.columns == docs.columns and sorted(r["text"] or "" for r in out.collect()) == ["", "fine", "fine"]


def test_learned_terms_need_contexts(spark):
    rng = random.Random(3)
    toxic = [(i, " ".join(w if rng.random() > 0.06 else "schlimmwort" for w in words(rng, 150).split())) for i in range(20)]
    clean = [(100 + i, words(rng, 150)) for i in range(60)]
    copy = words(rng, 100) + " onlyhere seltsam"
    copies = [(200 + i, copy) for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i, _ in toxic + copies] + [(i, 0) for i, _ in clean] + [(None, 1), (999, 1)], "doc_id bigint, toxic int")
    docs = texts(spark, toxic + clean + copies + ODD)
    assert toxicity.learned_terms(docs, labels) == {"schlimmwort": 0.5}
    assert toxicity.learned_terms(docs, labels.where("false")) == {}
    assert rejected(spark, toxic + clean, lexicon={"schlimmwort": 0.5}) == list(range(20))


def test_terms_of_other_scripts_and_behind_typographic_marks(spark):
    lexicon = {"éle": 1.0, "œuvreux": 1.0, "дурак": 1.0, "idiot": 1.0, "дегенератка": 1.0}
    pairs = [
        (1, "il est éle encore"),
        (2, "un œuvreux ici"),
        (3, "он дурак там"),
        (4, "x —idiot— y"),
        (5, "x idiot… y"),
        (6, "idiot😡 y"),
        (7, "the “idiot” stood there"),
        (8, "you œuvrux there"),
        (9, "you дурк there"),
        (10, "дегенератка"),
        (11, "nothing œ дом é"),
        (12, "‘’ idiot’"),
        (13, "aren’t ’"),
    ]
    assert rejected(spark, pairs, lexicon=lexicon) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 12]
    lex = toxicity.Lexicon(lexicon, frozenset())
    rng = random.Random(5)
    for _ in range(2000):  # whatever matches is a candidate
        w = list(rng.choice(list(lexicon)))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(1, len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", *"eéœд😡"])
        data = np.frombuffer("".join(w).encode(), np.uint8)
        assert not lex.match("".join(w)) or len(lex.candidates(data, np.array([0]), np.array([len(data)]))) == 1, w
    data = np.frombuffer("it’s ‘so’".encode(), np.uint8)
    start, end, _ = text.runs(toxicity.inside(data, np.array([0, len(data)])), np.array([0, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(start, end)] == ["it’s", "so"]


def test_toxicity_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    caught = {r["doc_id"] for r in queries()["op6_toxicity"](spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    toxic, clean = ({r["doc_id"] for r in labels if r["toxic"] == k} for k in (1, 0))
    assert len(caught & toxic) >= 0.6 * len(toxic) and len(caught & clean) <= 0.01 * len(clean)


# -- 9


def grams(t, n=3):
    w = split(t.translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(pairs, threshold=0.5):
    sets = {i: grams(t) for i, t in pairs if t is not None and i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {(i, find(i)) for i in sets if find(i) != i}


def edited(rng, t, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in t.split())


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    pairs = [(i, words(rng, rng.randrange(1, 300), 2000)) for i in range(60)]
    for k in range(25):
        _, t = pairs[k]
        pairs += [(100 + 10 * k + j, edited(rng, t, 0.03)) for j in range(3)]
    pairs += [(1000 + i, pairs[0][1].upper()) for i in range(5)] + ODD
    rng.shuffle(pairs)
    out = minhash.near_duplicates(texts(spark, pairs)).collect()
    assert {(r["doc_id"], r["kept_id"]) for r in out} == groups([p for p in pairs if p[0] is not None])
    sizes = Counter(r["kept_id"] for r in out)
    assert all(r["group_size"] == sizes[r["kept_id"]] + 1 for r in out)


def test_open_buckets_are_split_by_rare_grams(spark):
    """Many documents share half of their words, so buckets stay open; the way with splitting gives what brute force does."""
    rng = random.Random(6)
    shared = words(rng, 40, 10**6)
    pairs = [(i, f"{shared} {words(rng, rng.randrange(30, 60), 10**6)}") for i in range(40)]
    pairs += [(100 + i, edited(rng, pairs[i][1], 0.05)) for i in range(12)] + [(200 + i, edited(rng, pairs[i][1], 0.1)) for i in range(12)]
    for most in (0, 10**9):
        out = minhash.near_duplicates(texts(spark, pairs), bands=60, rows=2, star_rounds=1, most_pairs=most).collect()
        assert {(r["doc_id"], r["kept_id"]) for r in out} == groups(pairs)


def test_large_bucket_of_different_groups_is_split_exactly(spark):
    """All pairs share every band, but only some are alike: whatever the leads leave apart is compared pair by pair."""
    from pyspark.sql import functions as F

    from lumenfold.llm.components import group_by_buckets

    n = 60
    members = spark.createDataFrame([(b, i) for i in range(n) for b in (1, 2)], "bucket bigint, doc_id bigint")
    values = spark.createDataFrame([(i, i % 7) for i in range(n)], "doc_id bigint, v int")

    def alike(pairs, left, right):
        return pairs.join(left.select(F.col("doc_id").alias("a"), F.col("v").alias("x")), "a").join(right.select(F.col("doc_id").alias("b"), F.col("v").alias("y")), "b").where("x = y").select("a", "b")

    known = spark.createDataFrame([], "a bigint, b bigint")
    out = group_by_buckets(members, alike, values, Scratch(spark), known, star_rounds=1).collect()
    assert {(r["doc_id"], r["kept_id"]) for r in out} == {(i, i % 7) for i in range(7, n)}


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(0)
    for size in (1, 3, 50, 2000):
        values = rng.integers(1, 2**63, size, dtype=np.uint64)
        s = minhash.sketch(values, np.array([0, size]), 160)
        assert (s != minhash.EMPTY).all()
    both = rng.integers(1, 2**63, 1500, dtype=np.uint64)
    s = minhash.sketch(np.concatenate((both[:1000], both[500:])), np.array([0, 1000, 2000]), 160)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.12


def test_near_duplicates_at_the_edges(spark):
    long = "word " * 300_000
    out = minhash.near_duplicates(crowded(spark, [(1, long), (2, long), (3, "short one"), (3, "short one"), (4, "Short ONE"), (None, "short one"), (5, None), (6, ""), (7, "")]))
    assert {tuple(r) for r in out.collect()} == {(2, 1, 2), (4, 3, 2)}
    assert minhash.near_duplicates(texts(spark, [])).count() == 0
    docs = crowded(spark, [(1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (5, None)])
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 5]


def thue_morse(a, b, n):
    """A sequence of 2**n and its complement, which collide in every polynomial hash modulo 2**64 from n = 11 on."""
    x, y = [a], [b]
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_no_collisions_of_structured_words_and_texts(spark):
    x, y = ("".join(v) for v in thue_morse("a", "b", 11))
    p, q = (" ".join(v) for v in thue_morse("on", "off", 11))
    out = minhash.near_duplicates(texts(spark, [(1, f"{x} here"), (2, f"{y} here"), (3, p + " end"), (4, q + " end"), (5, p + " end")]), n=2000).collect()
    assert {(r["doc_id"], r["kept_id"]) for r in out} == {(5, 3)}
    data = np.frombuffer(f"{x} {y}".encode(), np.uint8)
    start, end, _ = text.words(data, np.array([0, len(data)]))
    assert len(set(text.word_hashes(data, start, end).tolist())) == 2


def test_texts_of_one_id_all_join(spark):
    rng = random.Random(11)
    one, two = words(rng, 60, 10**6), words(rng, 60, 10**6)
    out = minhash.near_duplicates(texts(spark, [(1, one), (5, one), (5, two), (9, two + " more")])).collect()
    assert {(r["doc_id"], r["kept_id"]) for r in out} == {(5, 1), (9, 1)}


@pytest.mark.parametrize("most", [10**6, 0])
def test_components_either_way(spark, most):
    rng = random.Random(7)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 3), (4, None), (5, 5)] + [(200 + i, 201 + i) for i in range(30)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark), "t", most)
    assert {(r["node"], r["root"]) for r in got.collect()} == {(i, find(i)) for i in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark), "e", most).count() == 0


# -- 5


def passages(pairs, length):
    first, steps = {}, []
    for i, t in sorted((i, t) for i, t in pairs if i is not None and t is not None):
        w = split(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if key in first:
                steps.append((i, k, *first[key]))
            else:
                first[key] = (i, k)
    out = []
    for i, k, fi, fk in steps:
        if out and out[-1][0] == i and k == out[-1][1] + out[-1][2] and fi == out[-1][3] and fk == out[-1][4] + out[-1][2]:
            out[-1][2] += 1
        else:
            out.append([i, k, 1, fi, fk])
    return {(i, k, n + length - 1, fi, fk) for i, k, n, fi, fk in out}


@pytest.mark.parametrize("size", [3, 1000])
def test_repeated_passages_match_brute_force(spark, size):
    rng = random.Random(size)
    shared = [words(rng, rng.randrange(10, 40), size) for _ in range(6)]
    pairs = [(i, " \n".join(rng.choice([words(rng, rng.randrange(1, 30), size), rng.choice(shared)]) for _ in range(rng.randrange(6)))) for i in range(60)]
    pairs += [(500, "same " * 60), (501, "same " * 40), (502, "a b " * 30)] + ODD
    got = suffix.repeated_passages(texts(spark, pairs), length=12, gram=6)
    assert {tuple(r) for r in got.collect()} == passages(pairs, 12)


def test_an_anchor_with_many_differing_slices(spark):
    """One passage in many surroundings, some of which occur again; more slices than a task is to take."""
    rng = random.Random(3)
    core = words(rng, 14, 10**6)
    around = [(words(rng, rng.randrange(8), 10**6), words(rng, rng.randrange(8), 10**6)) for _ in range(25)]
    pairs = [(i, f"{words(rng, 5, 9)} {a} {core} {b} {words(rng, 5, 9)}") for i, (a, b) in enumerate(rng.choices(around, k=50))]
    got = [{tuple(r) for r in suffix.repeated_passages(texts(spark, pairs), length=12, gram=6, crowd=c).collect()} for c in (4, 10**6)]
    assert got[0] == got[1] == passages(pairs, 12)


def test_transform_finds_common_prefixes():
    rng = np.random.default_rng(1)
    for size in (2, 5):
        x = np.concatenate((rng.integers(2, 2 + size, 300), [0], rng.integers(2, 2 + size, 200), [1]))
        order = suffix.suffix_array(x, len(x))
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        got = suffix.common_prefixes(x, order, 6)
        for r in range(1, len(x)):
            a, b = x[order[r - 1] :].tolist(), x[order[r] :].tolist()
            n = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert got[r] == n if n < 6 else got[r] >= 6


def test_drop_repeated_passages(spark):
    rng = random.Random(4)
    p = words(rng, 60, 10**6)
    docs = crowded(spark, [(1, f"alpha  {p}\nomega"), (2, f"beta {p}  tail"), (3, p), (None, p), (4, None), (5, "")])
    out = suffix.drop_repeated_passages(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: f"alpha  {p}\nomega", 2: "beta tail", 3: "", None: p, 4: None, 5: ""}
    changed = {r["doc_id"]: r["n_chars"] for r in out.collect()}
    assert changed[2] == 9 and changed[1] is None
    assert suffix.repeated_passages(texts(spark, [])).count() == 0
    twice = suffix.repeated_passages(texts(spark, [(1, p), (1, p), (2, p)])).collect()
    assert [tuple(r) for r in twice] == [(2, 0, 60, 1, 0)]


def test_very_long_repetition(spark):
    got = suffix.repeated_passages(texts(spark, [(1, "x " * 200_000), (2, words(random.Random(1), 50_000))])).collect()
    # Every window of a constant text has the same first occurrence, so each is a row of its own.
    assert len(got) == 199_950 and {(r["doc_id"], r["n_words"], r["first_doc_id"], r["first_start_word"]) for r in got} == {(1, 50, 1, 0)}


# -- 4


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(1, 200)), rng.choice(["en", "de", None]), rng.choice("abcd")) for i in range(300)]
    rows += [(900, None, "en", "a"), (901, "", "xx", "only"), (None, "some words", "en", "b"), (5, rows[5][1], rows[5][2], rows[5][3])]
    docs = frame(spark, rows)
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == len(rows)
    for column in ("source", "lang"):
        tokens, rated = defaultdict(float), defaultdict(float)
        for r in plan:
            tokens[r[column]] += r["tokens"]
            rated[r[column]] += r["tokens"] * r["rate"]
        share = mixing.tempered(tokens, 0.8)
        total = sum(rated.values())
        for v, s in share.items():
            assert rated[v] / total == pytest.approx(s, abs=2e-6)
    assert all(r["copies"] in (int(r["rate"] + 1e-6), int(r["rate"]) + 1) for r in plan)
    # Rates of one cell are the same: the tilt depends on the document's groups alone.
    assert all(len({r["rate"] for r in g}) == 1 for _, g in itertools.groupby(sorted(plan, key=lambda r: (str(r["source"]), str(r["lang"]))), key=lambda r: (r["source"], r["lang"])))


def test_mixing_budget_targets_and_copies(spark):
    rows = [(i, "w " * 10, "en", "a" if i % 4 else "b") for i in range(400)]
    docs = frame(spark, rows)
    plan = mixing.mixing_plan(docs, columns=("source",), targets={"source": {"a": 0.5, "b": 0.5}}, budget=6000).collect()
    assert {r["source"]: r["rate"] for r in plan} == {"a": 1.0, "b": 3.0}
    out = mixing.mix_sources(docs, columns=("source",), targets={"source": {"a": 0.5, "b": 0.5}}, budget=3000)
    assert out.columns == docs.columns
    n = Counter(r["source"] for r in out.collect())
    assert n["b"] in range(130, 171) and n["a"] in range(110, 191)
    with pytest.raises(ValueError):
        mixing.mixing_plan(docs, columns=("source",), targets={"source": {"a": 1.0}})
    with pytest.raises(ValueError, match="no tokens"):
        mixing.mixing_plan(docs, columns=("source",), targets={"source": {"a": 0.3, "b": 0.2, "code": 0.5}})
    assert mixing.mixing_plan(frame(spark, [])).count() == 0
    assert [r["copies"] for r in mixing.mixing_plan(frame(spark, [(1, None, None, None)])).collect()] == [1]
    crowd = mixing.mix_sources(crowded(spark, [(1, "a b"), (2, None)]))
    assert len(crowd.collect()) == 2 and "x0" in crowd.columns


def test_infeasible_targets_raise(spark):
    rows = [(1, "a b c", "en", "x"), (2, "d e f", "de", "y")]
    with pytest.raises(ValueError):
        mixing.mixing_plan(frame(spark, rows), targets={"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.1, "de": 0.9}})


# -- 8


def placed(parts, pairs, capacity):
    """Checks that every word of every row is placed once and returns the bins' sizes."""
    bins, pieces = defaultdict(list), Counter()
    for r in parts:
        bins[r["bin_id"]].append(r)
        pieces[r["doc_id"], r["start_word"], r["n_words"]] += 1
    assert all(sum(r["n_words"] for r in b) <= capacity for b in bins.values())
    assert all(sorted(r["slot"] for r in b) == list(range(len(b))) for b in bins.values())
    wanted = Counter()
    for i, t in pairs:
        n = len(split(t or ""))
        for s in range(0, n, capacity):
            wanted[i, s, min(capacity, n - s)] += 1
    assert pieces == wanted
    return {k: sum(r["n_words"] for r in b) for k, b in bins.items()}


def test_packing_places_everything(spark):
    rng = random.Random(8)
    pairs = [(i, "w " * rng.randrange(1, 260)) for i in range(300)] + ODD + [(1, "w " * 50), (1, "w " * 50), (2, "w " * 200), (3, "w " * 1000)]
    sizes = placed(packing.pack(texts(spark, pairs), capacity=100, problem_size=60).collect(), pairs, 100)
    assert sum(sizes.values()) / len(sizes) > 95
    assert packing.pack(texts(spark, [])).count() == 0
    assert packing.pack(crowded(spark, [(1, "a b c")])).count() == 1
    bins = packing.packed_bins(texts(spark, [(1, "a b"), (2, "c")])).collect()
    assert [(r["doc_ids"], r["start_words"], r["n_words"], r["total_words"]) for r in bins] == [([1, 2], [0, 0], [2, 1], 3)]


def test_genetic_search_beats_or_meets_best_fit():
    rng = np.random.default_rng(6)
    better = 0
    for trial in range(6):
        sizes = rng.integers(20, 60, 90)
        first = np.full(len(sizes), -1)
        packing.best_fit(sizes.tolist(), list(range(len(sizes))), 100, [], first)
        pool = packing.evolve(sizes, 100, [], 6, 60, np.random.default_rng(trial))
        for b in pool:
            assert (np.bincount(b, sizes) <= 100).all() and (b >= 0).all()
        assert packing.fitness(sizes, pool[0], 100) >= packing.fitness(sizes, first, 100)
        better += packing.fitness(sizes, pool[0], 100) > packing.fitness(sizes, first, 100)
    assert better >= 3


def fewest_bins(sizes, capacity):
    """By dynamic programming over subsets: (bins, fill of the last) of each."""
    best = [(1, 0)] + [(99, 0)] * ((1 << len(sizes)) - 1)
    for s in range(1, 1 << len(sizes)):
        for k, x in enumerate(sizes):
            if s >> k & 1:
                n, f = best[s ^ 1 << k]
                best[s] = min(best[s], (n, f + x) if f + x <= capacity else (n + 1, x))
    return best[-1][0]


def test_genetic_search_reaches_the_optimum_of_small_cases():
    rng = np.random.default_rng(12)
    fitted = found = optimum = 0
    for trial in range(20):
        sizes = rng.integers(15, 70, 12)
        first = np.full(12, -1)
        packing.best_fit(sizes.tolist(), list(range(12)), 100, [], first)
        pool = packing.evolve(sizes, 100, [], 4, 16, np.random.default_rng(trial))
        fitted, found, optimum = fitted + first.max() + 1, found + pool[0].max() + 1, optimum + fewest_bins(sizes.tolist(), 100)
        assert packing.fitness(sizes, pool[0], 100) <= packing.best_possible(int(sizes.sum()), 100) + 1e-12
    assert optimum <= found <= fitted and found <= 1.02 * optimum


def test_packing_depends_on_the_rows_alone(spark):
    rng = random.Random(9)
    pairs = [(rng.choice([None, i]), "w " * rng.randrange(1, 260)) for i in range(200)] + [(7, "w " * 30)] * 2500
    docs = texts(spark, pairs)
    one, two = (sorted(map(tuple, packing.pack(d, capacity=100, problem_size=300).collect()), key=str) for d in (docs, docs.repartition(7).orderBy("text")))
    assert one == two
    placed(packing.pack(docs, capacity=100, problem_size=300).collect(), pairs, 100)


def test_crossover_injects_whole_bins():
    rng = np.random.default_rng(0)
    sizes = rng.integers(10, 90, 40)
    a, b = np.full(40, -1), np.full(40, -1)
    packing.best_fit(sizes.tolist(), list(range(40)), 100, [], a)
    b = packing.mutate(sizes, sizes.tolist(), 100, a, rng, 0.7)
    child = packing.crossover(sizes, sizes.tolist(), 100, a, b, rng)
    assert (child >= 0).all() and (np.bincount(child, sizes) <= 100).all()
    bins = lambda x: {frozenset(np.flatnonzero(x == k).tolist()) for k in np.unique(x)}
    assert len(bins(child) & bins(b)) >= 1


# -- 3


def minimax(sizes, shards):
    """Least largest sum of at most ``shards`` runs, by dynamic programming."""
    best = [0] + [10**9] * len(sizes)
    for _ in range(shards):
        new = best[:]
        for j in range(1, len(sizes) + 1):
            s = 0
            for i in range(j, 0, -1):
                s += sizes[i - 1]
                new[j] = min(new[j], max(best[i - 1], s))
        best = new
    return best[-1]


@pytest.mark.parametrize("shards", [1, 3, 7, 100])
def test_shards_are_minimax(spark, shards):
    rng = random.Random(shards)
    pairs = [(i, "w " * rng.choice([0, 1, 5, 30])) for i in range(40)]
    rows = sharding.minimax_shards(texts(spark, pairs), shards).orderBy("group").collect()
    assert [r["group"] for r in rows] == list(range(40))
    of = [r["shard"] for r in rows]
    assert of == sorted(of) and max(of) < shards
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == rows[0]["capacity"] == minimax([r["size"] for r in rows], shards)


@pytest.mark.parametrize("shards", [2, 5, 9])
def test_shards_with_more_boundaries_than_the_driver_takes(spark, shards):
    """One group is far above the mean shard, so cuts may fall almost anywhere."""
    rng = random.Random(shards)
    pairs = [(i, "w " * (1500 if i == 170 else rng.randrange(0, 30))) for i in range(300)]
    plain, narrowed = (sorted(map(tuple, sharding.minimax_shards(texts(spark, pairs), shards, max_boundaries=m).collect())) for m in (10**6, 240))
    assert plain == narrowed and plain[0][3] == minimax([len(t.split()) for _, t in pairs], shards)


def test_shards_at_the_edges(spark):
    docs = texts(spark, [(None, "a b"), (1, None), (2, ""), (3, "x"), (3, "y z")])
    got = [tuple(r) for r in sharding.minimax_shards(docs, 2).orderBy("group").collect()]
    assert got == [(None, 2, 0, 3), (1, 0, 0, 3), (2, 0, 0, 3), (3, 3, 1, 3)]
    assert sharding.minimax_shards(texts(spark, [])).count() == 0
    assert {r["shard"] for r in sharding.minimax_shards(texts(spark, [(1, ""), (2, None)])).collect()} == {0}
    assert sharding.minimax_shards(crowded(spark, [(1, "a")])).count() == 1
    by_source = sharding.minimax_shards(frame(spark, [(1, "a", "en", "s"), (2, "b", "en", "r"), (3, "c", "en", None)]), 3, "source").orderBy("group").collect()
    assert [(r["group"], r["shard"]) for r in by_source] == [(None, 0), ("r", 1), ("s", 2)]
    with pytest.raises(ValueError):
        sharding.minimax_shards(docs, 0)


# -- 7


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 2, 700)] + [np.zeros(4096, int), np.full(5, 65535), rng.zipf(1.3, 3000).clip(0, 65535), np.tile([5, 6, 7], 900)]
    made = tokencodec.encode(blocks)
    for a, b in zip(blocks, tokencodec.decode(made, [len(b) for b in blocks])):
        assert np.array_equal(a, b)
    assert len(made[-1]) < 200 and len(made[4]) < 200
    for bad in ([np.arange(4097)], [np.array([-1])], [np.array([65536])]):
        with pytest.raises(ValueError):
            tokencodec.encode(bad)


def test_tokenizer_never_trusts_a_hash():
    from lumenfold.llm.queries import _tokenizer

    path, pattern = _tokenizer("byte_bpe_50k.tiktoken")
    words = tokencodec.Tokenizer(path, pattern, most=50)
    enc = tokencodec._encoding(path, pattern)
    x, y = ("".join(v) for v in thue_morse("a", "b", 11))
    rng = random.Random(4)
    for trial in range(30):
        many = [x, y, f" {x} {y} "] + ["".join(rng.choice("abc .é\n") for _ in range(rng.randrange(60))) for _ in range(20)]
        rng.shuffle(many)
        raw = [t.encode() for t in many]
        ids, begin = words.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
        assert [ids[i:j].tolist() for i, j in zip(begin, begin[1:])] == [enc.encode_ordinary(t) for t in many]


def test_codec_is_smaller_than_zlib(spark):
    from lumenfold.llm.queries import _tokenizer

    rows = tokencodec.encode_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), *_tokenizer("byte_bpe_50k.tiktoken")).select("n_tokens", "payload").collect()
    ids = tokencodec.decode([r["payload"] for r in rows], [r["n_tokens"] for r in rows])
    assert sum(len(r["payload"]) for r in rows) < 0.85 * sum(len(zlib.compress(x.astype("<u2").tobytes(), 6)) for x in ids)


def test_documents_encode_and_decode(spark):
    from lumenfold.llm.queries import _tokenizer

    path, pattern = _tokenizer("byte_bpe_50k.tiktoken")
    rng = random.Random(2)
    odd = ["", " ", "  two  spaces ", "a b c", "it's we'll 12 345 !!! …", "é à漢字 emoji 🙂 x", "tab\tnew\nline \n x", "x" * 5000, "word " * 9000]
    pairs = [(i, t) for i, t in enumerate(odd)] + [(100 + i, "".join(rng.choice("ab \n'1.é ") for _ in range(200))) for i in range(50)] + [(7, "again"), (None, "null id"), (8, None)]
    enc = tokencodec._encoding(path, pattern)
    made = tokencodec.encode_documents(crowded(spark, pairs), path, pattern)
    back = defaultdict(list)
    for r in tokencodec.decode_blocks(made).collect():
        back[r["doc_id"]].append((r["block"], list(r["ids"])))
    whole = {i: [x for _, ids in sorted(b) for x in ids] for i, b in back.items() if i != 7}
    assert whole == {i: enc.encode_ordinary(t) for i, t in pairs if t is not None and i != 7}
    assert len(back[7]) == 2 and 8 in back
    for r in made.where("doc_id = 2").collect():
        assert r["checksum"] == zlib.crc32(np.array(enc.encode_ordinary("  two  spaces "), "<u2").tobytes())
    assert made.where("n_tokens > 4096").count() == 0 and made.where("doc_id = 8").count() == 3
    from pyspark.sql import functions as F

    broken = made.where("doc_id = 4").withColumn("checksum", F.col("checksum") + 1)
    with pytest.raises(Exception, match="checksum"):
        tokencodec.decode_blocks(broken).collect()
    assert tokencodec.encode_documents(texts(spark, []), path, pattern).count() == 0


def test_equal_new_stretches_are_looked_up_once():
    from lumenfold.llm.queries import _tokenizer

    class Counted(dict):
        asked = 0

        def __getitem__(self, w):
            Counted.asked += 1
            return super().__getitem__(w)

    path, pattern = _tokenizer("byte_bpe_50k.tiktoken")
    words = tokencodec.Tokenizer(path, pattern)
    words.entry = Counted()
    raw = b"one two three " * 500
    ids, _ = words.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert ids.tolist() == tokencodec._encoding(path, pattern).encode_ordinary(raw.decode())
    assert Counted.asked < 20


def intervals_at(low, wide):
    """Stands for the model: intervals as given, a row of them for each block."""
    return lambda ids, size: (np.array(low, np.uint64).ravel(), np.array(wide, np.uint64).ravel(), np.zeros(len(ids), bool))


def test_carries_pass_runs_of_full_bytes(monkeypatch):
    rng, lows, wides, wanted = random.Random(6), [], [], []
    for lane in range(50):
        value, span, moved, low, wide = 0, 2**64 - 1, 0, [], []
        point = 3 << 62 if lane % 2 else rng.randrange(2**64)
        for step in range(200):
            # Intervals around the point leave open on which side of it the code comes to lie, until one beyond it.
            unit, w = span >> tokencodec.TOTAL, 1 << rng.randrange(10, tokencodec.TOTAL)
            c = min(max(0, (point - value) // unit + (1 if step % 60 == 59 else -(w // 2))), 2**tokencodec.TOTAL - w)
            low.append(c)
            wide.append(w)
            value, span = value + unit * c, unit * w
            if not value <= point < value + span:
                point = value + rng.randrange(span)
            while span < 1 << 56:
                value, span, point, moved = value << 8, span << 8, point << 8, moved + 1
        lows.append(low)
        wides.append(wide)
        wanted.append(value.to_bytes(8 + moved, "big").rstrip(b"\0"))
    assert any(b"\0" * 6 in w for w in wanted)
    monkeypatch.setattr(tokencodec, "_intervals", intervals_at(lows, wides))
    assert tokencodec._payloads(np.zeros(50 * 200, np.int32), np.full(50, 200)) == wanted


def test_a_step_of_the_coder_is_cheap(monkeypatch):
    n, steps, best = 64, 4096, [1e9, 1e9]
    rng = np.random.default_rng(8)
    wide = 1 << rng.integers(18, 38, (n, steps))
    monkeypatch.setattr(tokencodec, "_intervals", intervals_at((2**38 - wide) // 2, wide))
    a, b = np.ones(n, np.uint64), np.ones(n, np.uint64)
    for trial in range(5):
        begin = time.process_time()
        tokencodec._payloads(np.zeros(n * steps, np.int32), np.full(n, steps))
        middle = time.process_time()
        for i in range(28 * steps):
            np.add(a, b, out=a)
        best = [min(best[0], middle - begin), min(best[1], time.process_time() - middle)]
    assert best[0] < best[1], best
