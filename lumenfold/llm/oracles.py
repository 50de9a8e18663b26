"""DuckDB SQL for the operators that SQL can express, as brute force over the whole tables."""

from __future__ import annotations

import string

WORDS = r"list_filter(regexp_split_to_array({}, '[\x00-\x20]+'), lambda w: w <> '')"
#: Only ASCII letters change case.
LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
VECTORS = f"v AS (SELECT vec_id, {UNIT} AS u FROM embeddings)"
#: (node, root) from pairs p (a, b): all that can be reached, and the least of it.
GROUPS = "e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS node, least(a, min(b)) AS root, count(DISTINCT b) AS n FROM r GROUP BY a)"


def neighbours(k: int = 10, every: int = 50) -> str:
    """The exact neighbours of every vector whose id is divisible by ``every``; the approximate search gives the same where all blocks are in reach."""
    return f"WITH {VECTORS}, c AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_inner_product(a.u, b.u) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0), r AS (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, neighbour_id))::INTEGER AS rank FROM c) SELECT vec_id, neighbour_id, rank, round(s, 5) AS cosine FROM r WHERE rank <= {k}"


def near_vectors(threshold: float = 0.9) -> str:
    return f"WITH RECURSIVE {VECTORS}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_inner_product(a.u, b.u) >= {threshold}), {GROUPS} SELECT node AS vec_id, root AS kept_id, n AS group_size FROM g WHERE node <> root"


def shards(n: int = 64) -> str:
    """Bisection, one greedy cut a step, then the cuts of the least capacity."""
    jump = "coalesce(list_max(list_filter(ts, lambda x: x <= pos + {c})), 0)"
    return f"""WITH RECURSIVE g AS (SELECT doc_id, len({WORDS.format('text')})::BIGINT AS size FROM documents),
t AS (SELECT *, (sum(size) OVER (ORDER BY doc_id))::BIGINT AS total FROM g),
k AS (SELECT list(DISTINCT total) AS ts, max(total) AS whole, max(size) AS largest FROM t),
s AS (SELECT greatest(largest, (whole + {n} - 1) // {n}) AS low, (whole + {n} - 1) // {n} + largest AS high, 0::BIGINT AS pos, 0 AS used FROM k
  UNION ALL SELECT CASE WHEN pos < whole AND used = {n} THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN pos >= whole THEN (low + high) // 2 ELSE high END,
    CASE WHEN pos >= whole OR used = {n} THEN 0 ELSE {jump.format(c='(low + high) // 2')} END, CASE WHEN pos >= whole OR used = {n} THEN 0 ELSE used + 1 END FROM s, k WHERE low < high),
c AS (SELECT low AS capacity FROM s WHERE low >= high LIMIT 1),
m AS (SELECT 0 AS shard, 0::BIGINT AS pos, {jump.format(c='capacity').replace('pos +', '')} AS upto FROM k, c UNION ALL SELECT shard + 1, upto, {jump.format(c='capacity').replace('pos +', 'upto +')} FROM m, k, c WHERE upto < whole)
SELECT doc_id, size, shard::INTEGER AS shard, capacity FROM t, c, m WHERE total <= upto AND (total > pos OR (shard = 0 AND total = 0))"""


def mixture(power: float = 0.8, steps: int = 400) -> str:
    """Iterative proportional fitting of the cells' tokens, another way to the same rates as the convex dual."""
    share = "SELECT {0}, pow(sum(t), {1}) / sum(pow(sum(t), {1})) OVER () AS share FROM c GROUP BY {0}"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, lang, len({WORDS.format('text')})::BIGINT AS tokens FROM documents),
c AS (SELECT source, lang, sum(tokens)::DOUBLE AS t FROM d WHERE tokens > 0 GROUP BY source, lang),
a AS ({share.format('source', power)}), b AS ({share.format('lang', power)}),
f AS (SELECT c.source, c.lang, c.t, a.share AS x, b.share AS y FROM c JOIN a ON c.source IS NOT DISTINCT FROM a.source JOIN b ON c.lang IS NOT DISTINCT FROM b.lang),
i AS (SELECT 0 AS k, source, lang, x, y, t, t AS w FROM f
  UNION ALL SELECT k + 1, source, lang, x, y, t, CASE WHEN k % 2 = 0 THEN w * x / sum(w) OVER (PARTITION BY source) ELSE w * y / sum(w) OVER (PARTITION BY lang) END FROM i WHERE k < {steps}),
r AS (SELECT source, lang, (w / t) / min(w / t) OVER () AS rate FROM i WHERE k = {steps}),
u AS (SELECT d.*, r.rate, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, floor(r.rate + 1e-9) AS whole FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, source, lang, tokens, round(rate, 6) AS rate, (whole + (u < rate - whole - 1e-9)::INT)::INTEGER AS copies FROM u"""


def passages(length: int = 50) -> str:
    first = "OVER (PARTITION BY h ORDER BY doc_id, pos)"
    back = "OVER (PARTITION BY doc_id ORDER BY pos)"
    return f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {length - 1})) AS pos FROM w),
h AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + {length}], ' ')) AS h FROM i),
f AS (SELECT doc_id, pos, first_value(doc_id) {first} AS fd, first_value(pos) {first} AS fa FROM h),
d AS (SELECT * FROM f WHERE doc_id <> fd OR pos <> fa),
n AS (SELECT *, CASE WHEN lag(pos) {back} = pos - 1 AND lag(fd) {back} = fd AND lag(fa) {back} = fa - 1 THEN 0 ELSE 1 END AS new FROM d),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM n)
SELECT doc_id, min(pos)::INTEGER AS start_word, (count(*) + {length - 1})::INTEGER AS n_words, min(fd) AS first_doc_id, min(fa)::INTEGER AS first_start_word FROM k GROUP BY doc_id, k"""


def near_documents(n: int = 3, threshold: float = 0.5) -> str:
    """The exact index of every pair; banding may miss some just above the threshold."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) AS pos FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[pos : pos + {n - 1}], ' ') AS gram FROM i),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE c >= {threshold} * (x.n + y.n - c)), {GROUPS}
SELECT node AS doc_id, root AS kept_id, n AS group_size FROM g WHERE node <> root"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_space_filling_ann": neighbours(),
        "op2_cap_filter_near_duplicates": near_vectors(),
        "op3_minimax_shards": shards(),
        "op4_entropy_mix": mixture(),
        "op5_suffix_repeats": passages(),
        "op9_minhash_near_duplicates": near_documents(),
    }
