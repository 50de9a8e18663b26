"""Lexical retrieval with BM25 over token arrays; ``postings`` has the same over a saved index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import glob_regex, phrase_starts, positions, term_frequency, tokens


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def score(self, tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
        """A term's score; 0 where tf, df or n is 0."""
        tf, df, n, dl = (c.cast("double") for c in (tf, df, n, dl))
        idf = F.ln(1.0 + (n - df + 0.5) / (df + 0.5))
        length = F.when(avgdl > 0, dl / avgdl).otherwise(F.lit(1.0))
        value = idf * tf * (self.k1 + 1.0) / (tf + self.k1 * (1.0 - self.b + self.b * length))
        return F.when((tf > 0) & (df > 0) & (n > 0), value).otherwise(F.lit(0.0))


@dataclass
class Corpus:
    """Rows with a token array for each text field and ``dl``, all their tokens together."""

    rows: DataFrame
    id_col: str
    text_cols: list[str]
    segment_col: str | None = None

    @staticmethod
    def of(df: DataFrame, id_col: str, text_cols: Sequence[str], segment_col: str | None = None) -> Corpus:
        """Statistics are of all rows of ``df``, whatever is filtered later; of each segment by itself with ``segment_col``."""
        rows = df
        for c in text_cols:
            rows = rows.withColumn(f"_tokens_{c}", tokens(c))
        rows = rows.withColumn("dl", reduce(lambda a, b: a + b, [F.greatest(F.coalesce(F.size(f"_tokens_{c}"), F.lit(0)), F.lit(0)) for c in text_cols]))
        return Corpus(rows, id_col, list(text_cols), segment_col)

    def words(self, fields: Sequence[str] | None = None) -> list[Column]:
        if unknown := set(fields or ()) - set(self.text_cols):
            raise ValueError(f"{sorted(unknown)[0]!r} is no Text field")
        return [F.col(f"_tokens_{c}") for c in fields or self.text_cols]

    def frequency(self, term: str, fields: Sequence[str] | None = None) -> Column:
        return reduce(lambda a, b: a + b, [term_frequency(w, term) for w in self.words(fields)])

    def vocabulary(self, fields: Sequence[str] | None = None) -> DataFrame:
        """(term, df): documents of each term."""
        every = [self.rows.select(self.id_col, F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(w, F.array().cast("array<string>")) for w in self.words(fields)])))).alias("term"))]
        return every[0].groupBy("term").agg(F.count("*").alias("df"))

    def scored(self, terms: Sequence[str], operator: str = "and", bm25: Bm25 = Bm25(), keep: Sequence[str] = (), where: Column | None = None, fields: Sequence[str] | None = None, match: Column | None = None) -> DataFrame:
        """(id, score, <keep>) of the rows with all ("and") or any ("or") of the terms; a term given twice counts twice.

        One aggregate row of statistics meets the scan by broadcast, so nothing of the corpus is shuffled. Terms beyond a few hundred (a wildcard's) are
        better matched by ``scored_by_vocabulary``. ``where`` is of the table's columns, ``match`` a test of the words.
        """
        if operator not in ("and", "or"):
            raise ValueError(f"operator is 'and' or 'or', not {operator!r}")
        if not terms:
            return self.rows.where("false").select(self.id_col, F.lit(0.0).alias("score"), *keep)
        weights = Counter(terms)
        names = {t: f"_tf{i}" for i, t in enumerate(weights)}
        segment = [self.segment_col] if self.segment_col else []
        used = dict.fromkeys([self.id_col, *keep, *segment])
        slim = self.rows.select(*used, "dl", *[self.frequency(t, fields).alias(n) for t, n in names.items()])
        found = self.rows if where is None else self.rows.where(where)
        tested = [] if match is None else [match.alias("_match")]
        # A generator's row, as a filter of plain columns would be pushed below them and split each text once more for each use of its words.
        found = found.select(*used, F.explode(F.array(F.struct("dl", *[self.frequency(t, fields).alias(n) for t, n in names.items()], *tested))).alias("_row")).select(*used, "_row.*")
        stats = [F.count("*").alias("_n"), F.avg("dl").alias("_avgdl"), *[F.sum((F.col(n) > 0).cast("bigint")).alias(f"_df{n}") for n in names.values()]]
        present = [F.col(n) > 0 for n in names.values()]
        if match is not None:
            found = found.where("_match")
        found = found.where(reduce((lambda a, b: a & b) if operator == "and" else (lambda a, b: a | b), present))
        # One row (or one for each segment) of statistics.
        per = slim.groupBy(*segment).agg(*stats).withColumnRenamed(self.segment_col, "_segment") if segment else None
        joined = found.join(per, F.col(self.segment_col).eqNullSafe(F.col("_segment"))) if segment else found.crossJoin(F.broadcast(slim.agg(*stats)))
        score = reduce(lambda a, b: a + b, [F.lit(float(weights[t])) * bm25.score(F.col(n), F.col(f"_df{n}"), F.col("_n"), F.col("dl"), F.col("_avgdl")) for t, n in names.items()])
        return joined.select(self.id_col, score.alias("score"), *keep)

    def wildcard_terms(self, pattern: str, fields: Sequence[str] | None = None, ignore_case: bool = True) -> DataFrame:
        """(term, df) of the vocabulary that matches a glob."""
        return self.vocabulary(fields).where(F.col("term").rlike(glob_regex(pattern, ignore_case)))

    def wildcard(self, pattern: str, fields: Sequence[str] | None = None, ignore_case: bool = True, bm25: Bm25 = Bm25(), where: Column | None = None) -> DataFrame:
        """(id, score): rows with any word that matches; each expansion scores with its own document frequency.

        Words are filtered by the pattern before anything is shuffled, so the vocabulary is never collected.
        """
        rx = glob_regex(pattern, ignore_case)
        all_words = F.flatten(F.array(*[F.coalesce(w, F.array().cast("array<string>")) for w in self.words(fields)]))
        kept = F.lit(True) if where is None else where
        hits = self.rows.select(self.id_col, "dl", kept.alias("_kept"), F.explode(F.filter(all_words, lambda w: w.rlike(rx))).alias("term"))
        tf = hits.groupBy(self.id_col, "dl", "_kept", "term").agg(F.count("*").alias("tf"))
        scored = tf.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term").where("_kept").crossJoin(F.broadcast(self.rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))))
        return scored.groupBy(self.id_col).agg(F.sum(bm25.score(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"))).alias("score"))

    def phrase(self, terms: Sequence[str], slop: int = 0, fields: Sequence[str] | None = None, bm25: Bm25 = Bm25(), boost: float = 1.5, where: Column | None = None) -> DataFrame:
        """(id, score): rows with the terms in order in one field, each within ``slop`` of its place after the first; BM25 of all times ``boost``."""
        if not terms:
            return self.scored([], keep=())
        in_field = [F.coalesce(phrase_starts([positions(w, t) for t in terms], slop), F.lit(False)) for w in self.words(fields)]
        match = reduce(lambda a, b: a | b, in_field)
        # The cheap test first: positions are only looked at where every term occurs.
        match = F.when(reduce(lambda a, b: a & b, [self.frequency(t) > 0 for t in dict.fromkeys(terms)]), match)
        found = self.scored(terms, "and", bm25, where=where, match=match)
        return found.select(self.id_col, (F.col("score") * boost).alias("score"))

    def filtered(self, where: Column, bm25: Bm25 = Bm25()) -> DataFrame:
        """(id, score) of all rows that pass a filter, scored as one term that every row has once."""
        stats = F.broadcast(self.rows.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avgdl")))
        found = self.rows.where(where).select(self.id_col, "dl").crossJoin(stats)
        return found.select(self.id_col, bm25.score(F.lit(1), F.col("_n"), F.col("_n"), F.col("dl"), F.col("_avgdl")).alias("score"))
