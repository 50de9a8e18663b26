"""Toxic documents: a misspelling-tolerant lexicon with scores from the context of each hit.

A Levenshtein automaton of the word at hand walks the lexicon's trie; a branch ends where the automaton
has no state left. Only words that share a piece with a term (one of d + 1 pieces survives d edits) reach
it, and each distinct word is matched once per worker. A single pass without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch

U = np.uint64
#: Term: weight. From 1, a single unquoted hit is enough for rejection at the default threshold.
LEXICON: dict[str, float] = dict.fromkeys(
    "idiot idiots moron morons stupid loser losers scum scumbag trash worthless pathetic disgusting clown imbecile cretin dimwit nitwit halfwit dumbass jackass asshole bastard bitch douchebag filth vermin degenerate despicable fuck fucking shit motherfucker whore slut cunt retard retarded".split(),
    1.0,
)
#: Ordinary words that are an edit away from a term.
ORDINARY = frozenset((
    "whores where batch crown blown closer lower loner loser's loses losers' lose trashy clowns stupor ideology bench birch butch switch moro moran whole whose shore smut slot slit scam scrum scan shot shut ship retort regard reward bitcoin pathetically path apathetic filthy fifth firth elegant generate degenerated despicably bustard patient verein vereins "
    "duck luck suck buck tuck muck puck ruck yuck funk ducking sucking tucking bucking mucking ducks shirt shift spit suit chit whit sit hit shin shia shim shiv skit sait soit seit smit sum slum swum cum scud slat glut salut blut flut plut slur slug cut count hunt runt punt aunt cant can't cent bunt cult curt cuna "
    "idiom idioms mormon mormons boron morton macron maroon laser leser poser looser lasers posers closers lowers loners crash brash thrash tras flown crowns ditch pitch witch hitch itch fitch dastard tilth termin termine regenerate regenerated regenerates degenerates discussing digesting petard regarded retarder creting").split())
REPORTING = frozenset("said says saying say called calls calling quote quoted quotes quoting word words term terms slur slurs insult insults phrase wrote writes meaning means defined definition example mentioned alleged reported".split())
DIRECTED = frozenset("you your you're youre yourself yours u ur".split())
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
#: Code points from 128 that separate words: punctuation, spaces and symbols. Those above the table are inside.
_SEPARATES = np.array([c > 127 and unicodedata.category(chr(c))[0] in "PZS" for c in range(0x20000)] + [False])


def inside(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to words; a typographic apostrophe does between two others of its row."""
    out = _INSIDE[data]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return out
    b = [np.concatenate((data, np.zeros(3, np.uint8)))[lead + k].astype(np.int64) for k in range(4)]
    size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    low = [x & 63 for x in b]
    point = np.select([size == 2, size == 3], [(b[0] & 31) << 6 | low[1], (b[0] & 15) << 12 | low[1] << 6 | low[2]], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3])
    separates = _SEPARATES[np.minimum(point, len(_SEPARATES) - 1)]
    for k in range(4):
        at = lead[separates & (size > k)] + k
        out[at[at < len(data)]] = False
    at = lead[point == 0x2019]
    at = at[(at > 0) & (at + 3 < len(data)) & ~np.isin(at, off) & ~np.isin(at + 3, off)]
    at = at[out[at - 1] & out[at + 3]]
    for k in range(3):
        out[at + k] = True
    return out


class Levenshtein:
    """The automaton that accepts strings within ``k`` edits of ``word``; a state is a bit set of positions for each number of edits."""

    def __init__(self, word: str, k: int):
        self.end = 1 << len(word)
        self.all = (self.end << 1) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        start = [1]
        for _ in range(k):
            start.append((start[-1] | start[-1] << 1) & self.all)
        self.start = tuple(start)

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        m, out = self.masks.get(c, 0), []
        for e, s in enumerate(state):
            x = (s & m) << 1
            if e:
                x |= state[e - 1] | state[e - 1] << 1 | out[-1] << 1
            out.append(x & self.all)
        return tuple(out)

    def edits(self, state: tuple[int, ...]) -> int | None:
        return next((e for e, s in enumerate(state) if s & self.end), None)


#: Terms that have so many ordinary words around them that only their own spelling counts.
EXACT = frozenset(["whore"])


#: What a hit weighs whose first letter isn't the term's, and the letters of a term from which on there are such hits.
FIRST, FIRST_FROM = 0.9, 6


def allowed_edits(term: str) -> int:
    """Edits that a misspelling of ``term`` may have: none below 5 letters and for terms in EXACT, 1 below 9 letters, else 2."""
    return 0 if len(term) < 5 or term in EXACT else 1 if len(term) < 9 else 2


def _cuts(word: str, n: int) -> list[tuple[int, int]]:
    """Begin and end in bytes of ``n`` pieces of about as many characters, between characters, so that an edit spoils one piece only."""
    edges = [len(word[: round(i * len(word) / n)].encode()) for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


class Lexicon:
    def __init__(self, terms: Mapping[str, float], ordinary: frozenset[str]):
        self.terms, self.ordinary = dict(terms), ordinary
        self.trie: dict = {}
        looked: dict[tuple[str, int, int], dict[bytes, list]] = {}
        self.most = max(map(allowed_edits, self.terms), default=0)

        def note(kind: str, shift: int, piece: bytes, least: int, longest: int, first: int | None) -> None:
            """A word may be near a term if it has ``piece`` there, a length in bytes in that range, and begins with ``first`` (or any byte)."""
            looked.setdefault((kind, shift, len(piece)), {}).setdefault(piece, []).append((least, longest, first))

        for t in self.terms:
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
            b, d = t.encode(), allowed_edits(t)
            widest = max((len(c.encode()) for c in t), default=1)
            # A word of another length has too many edits; one edit changes a length by four bytes at most.
            lengths = len(b) - widest * d, len(b) + 4 * d
            for k, (x, y) in enumerate(_cuts(t, d + 1)):
                if k == 0:
                    note("front", 0, b[:y], *lengths, None)
                elif k == d:
                    note("back", 0, b[x:], *lengths, b[0])
                else:
                    for shift in range(-k * widest, 4 * k + 1):
                        note("front", x + shift, b[x:y], *lengths, b[0])
            if d and len(t) >= FIRST_FROM:
                # With another first letter there is one edit less for the rest.
                rest = t[1:].encode()
                for k, (x, y) in enumerate(_cuts(t[1:], d)):
                    if k == d - 1:
                        note("back", 0, rest[x:], *lengths, None)
                    else:
                        for shift in range(-k * widest, widest + 4 * (k + 1) + 1):
                            note("front", x + shift, rest[x:y], *lengths, None)
        self.looked = {}
        for (kind, shift, n), pieces in looked.items():
            names = sorted(pieces)
            hashes = T.Prefix(T.CODES[np.frombuffer(b"".join(names), np.uint8)]).of(np.arange(len(names)) * n, (np.arange(len(names)) + 1) * n)
            first = np.zeros((len(names), 256), bool)
            for k, name in enumerate(names):
                for _, _, c in pieces[name]:
                    first[k, slice(None) if c is None else c] = True
            bounds = np.array([(min(x for x, _, _ in pieces[name]), max(x for _, x, _ in pieces[name])) for name in names])
            order = np.argsort(hashes)
            self.looked[kind, shift, n] = hashes[order], bounds[order, 0], bounds[order, 1], first[order]
        self.shortest = min((len(t) - allowed_edits(t) for t in self.terms), default=1)
        self.longest = max((len(t.encode()) + 4 * allowed_edits(t) for t in self.terms), default=0)
        self.known: dict[str, tuple[str, int] | None] = {}

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term (the first in alphabetical order of several) and its edits; the first letters agree below FIRST_FROM letters."""
        if word in self.known:
            return self.known[word]
        best: tuple[int, str] | None = None
        if word not in self.ordinary and word:
            auto = Levenshtein(word, self.most)
            stack = [(self.trie, auto.start)]
            while stack:
                node, state = stack.pop()
                for c, below in node.items():
                    if c == "":
                        e = auto.edits(state)
                        if e is not None and e <= allowed_edits(below) and (word[0] == below[0] or len(below) >= FIRST_FROM) and (best is None or (e, below) < best):
                            best = e, below
                    elif any(after := auto.step(state, c)):
                        stack.append((below, after))
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = out = (best[1], best[0]) if best else None
        return out

    def candidates(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Indices of the words that share a piece with a term where few enough edits would leave it."""
        length = end - start
        at = np.flatnonzero((length >= self.shortest) & (length <= self.longest))
        if not len(at):
            return at
        s, e, length = start[at], end[at], length[at]
        prefix, hit, initial = T.Prefix(T.CODES[low]), np.zeros(len(at), bool), low[s]
        for (kind, shift, n), (hashes, least, longest, first) in self.looked.items():
            x = s + shift if kind == "front" else e - n
            ok = np.flatnonzero((x >= s) & (x + n <= e))
            h = prefix.of(x[ok], x[ok] + n)
            p = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            some = np.flatnonzero(hashes[p] == h)
            ok, p = ok[some], p[some]
            hit[ok] |= (length[ok] >= least[p]) & (length[ok] <= longest[p]) & first[p, initial[ok]]
        return at[hit]


def quoted(before: bytes, after: bytes) -> bool:
    """Whether a hit stands between quotation marks on its line, given the text around it."""
    before, after = before[before.rfind(b"\n") + 1 :], after.split(b"\n", 1)[0]
    if before.count(b'"') % 2 and b'"' in after:
        return True
    return any(before.rfind(a) > before.rfind(b) and b in after for a, b in (("“".encode(), "”".encode()), ("«".encode(), "»".encode()), ("„".encode(), "“".encode())))


def window_score(at: list[int], plain: list[float], said: list[float], window: int) -> float:
    """The most that hits within ``window`` words of the first of them add up to; of quoted hits only the heaviest counts."""
    return max((sum(plain[i:j]) + max(said[i:j]) for i in range(len(at)) for j in [next((k for k in range(i, len(at)) if at[k] >= at[i] + window), len(at))]), default=0.0)


def _score(column: pa.Array, lexicon: Lexicon, window: int, near: int, reach: int) -> Iterator[tuple[int, float, list[str]]]:
    """(row, score, terms) of the rows with a hit."""
    for lo, _, data, off in T.pieces(column):
        low = T.LOWER[data]
        start, end, first = T.runs(inside(data, off), off)
        hits: dict[int, list[tuple[int, str, int]]] = {}
        at = lexicon.candidates(low, start, end)
        for i, row in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist()):
            if m := lexicon.match(low[start[i] : end[i]].tobytes().decode("utf-8", "replace")):
                hits.setdefault(row, []).append((i, *m))
        word = lambda k: low[start[k] : end[k]].tobytes().decode("utf-8", "replace")
        for row, found in hits.items():
            plain, said = [], []
            for i, term, edits in found:
                a, b = max(first[row], i - near), min(first[row + 1], i + near + 1)
                weight = lexicon.terms[term] * (1.0, 0.6, 0.4)[edits] * (1.0 if low[start[i]] == term.encode()[0] else FIRST)
                around = {word(k) for k in range(a, b)}
                report = any(word(k) in REPORTING for k in range(a, i))
                if report or quoted(data[max(off[row], start[i] - reach) : start[i]].tobytes(), data[end[i] : min(off[row + 1], end[i] + reach)].tobytes()):
                    plain.append(0.0)
                    said.append(0.25 * weight)
                else:
                    plain.append(weight + 0.5 * bool(around & DIRECTED))
                    said.append(0.0)
            yield lo + row, window_score([i for i, _, _ in found], plain, said, window), sorted({t for _, t, _ in found})


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, h, before, toxic) of the distinct pairs of successive words in each piece; the word itself only where toxic."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, data, off in T.pieces(batch.column(0)):
            low = T.LOWER[data]
            start, end, first = T.runs(inside(data, off), off)
            if not len(start):
                continue
            h = T.word_hashes(low, start, end)
            before = np.concatenate((np.zeros(1, U), h[:-1]))
            begins = first[:-1]
            before[begins[begins < len(h)]] = U(0)
            kind = np.repeat(toxic[lo:hi], np.diff(first))
            at = np.flatnonzero(end - start >= 4)
            key = T.mix(h[at] * U(T.BASE) + before[at] + kind[at].astype(U))
            at = at[np.unique(key, return_index=True)[1]]
            words = [low[start[i] : end[i]].tobytes().decode("utf-8", "replace") if kind[i] else None for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(h[at].view(np.int64)), pa.array(before[at].view(np.int64)), pa.array(kind[at].astype(np.int8))], ["word", "h", "before", "toxic"])


def learned_terms(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = 8000, least: int = 4, ratio: float = 15.0, weight: float = 0.5) -> dict[str, float]:
    """Terms of ``weight`` from at most ``bound`` labelled documents (those with the least id hashes), beside the built-in lexicon.

    A word of four bytes or more is a term if it follows at least ``least`` different words in toxic documents, and
    that is ``ratio`` times as often as in the others, in relation to all pairs of words. Counting what
    goes before it, not documents, keeps copies of one toxic document from making terms of all its words. At weight 0.5 it takes two
    such terms in a window for rejection. Null ids, labels other than 0 and 1 and ids without a document are ignored; of
    several labels of an id the highest counts. No labels give no terms.
    """
    scratch = Scratch(docs.sparkSession)
    chosen = labels.select(F.col(id_col).cast("bigint").alias("i"), F.col(label_col).cast("int").alias("toxic")).where("i is not null and toxic in (0, 1)")
    chosen = chosen.groupBy("i").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("i"), "i").limit(bound)
    # At most ``bound`` rows.
    some = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i").select("t", "toxic")
    pairs = some.mapInArrow(T.tidy(_contexts), "word string, h bigint, before bigint, toxic tinyint").groupBy("h", "before", "toxic").agg(F.max("word").alias("word"))
    pairs = scratch.save(pairs, "contexts")
    total = {r["toxic"]: r["n"] for r in pairs.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    found = pairs.groupBy("h").agg(F.max("word").alias("word"), F.sum(F.col("toxic").cast("bigint")).alias("a"), F.sum((F.col("toxic") == 0).cast("bigint")).alias("b"))
    lift = F.col("a") / total.get(1, 1) * total.get(0, 1) / (F.col("b") + 0.5)
    # As many rows as toxic documents of the bounded sample have such words.
    out = {r["word"]: weight for r in found.where((F.col("a") >= least) & (lift >= ratio)).select("word").collect()}
    scratch.drop("contexts")
    return out


def toxic_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 1.0, lexicon: Mapping[str, float] = LEXICON, ordinary: frozenset[str] = ORDINARY, window: int = 50, near: int = 8, reach: int = 200) -> DataFrame:
    """(doc_id, score, terms, rejected): the documents whose score reaches ``threshold``.

    Words are runs of letters, digits and apostrophes in lower case; punctuation and symbols of Unicode separate them. A word counts as a term within
    ``allowed_edits`` of it and it is no ordinary word; a hit weighs the term's
    weight, times 0.6 at one edit and 0.4 at two, and FIRST where the first letter is another, plus 0.5 where the reader is addressed within ``near``
    words. A hit in quotation marks (within ``reach`` bytes, on one line) or up to ``near`` words after a reporting word
    weighs a quarter, and of those only the heaviest in a window counts. The score is the largest sum over ``window`` words.
    Null and empty texts score nothing. Null ids and repeated rows come out row by row, as they came in.
    Other columns are ignored.
    """
    terms, known = dict(lexicon), frozenset(ordinary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(terms, known)
        for batch in batches:
            found = [x for x in _score(batch.column(1), lex, window, near, reach) if x[1] >= threshold]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([s for _, s, _ in found], pa.float64()), pa.array([t for _, _, t in found], pa.list_(pa.string())), pa.array([True] * len(found), pa.bool_())], ["doc_id", "score", "terms", "rejected"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(T.tidy(run), "doc_id bigint, score double, terms array<string>, rejected boolean")


def drop_toxic(docs: DataFrame, text_col: str = "text", threshold: float = 1.0, lexicon: Mapping[str, float] = LEXICON, ordinary: frozenset[str] = ORDINARY, window: int = 50, near: int = 8, reach: int = 200) -> DataFrame:
    """``docs`` without the rows that ``toxic_documents`` would reject, in one pass; all columns stay as they are."""
    terms, known = dict(lexicon), frozenset(ordinary)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(terms, known)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, s, _ in _score(batch.column(at), lex, window, near, reach) if s >= threshold]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(T.tidy(run), docs.schema)
