"""Toxicity by a learned lexicon, matched with spelling errors.

Terms and stems that toxic documents have and others lack make up a trie. The
Levenshtein automaton of a few errors (a swap of neighbours is one) runs along
the trie, so a word is held against all terms at once; states are worked out when a text first reaches
them. The words around a match tell quotation from abuse, and a logistic model
of the weighted matches gives the score."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import documents, id_and_text, in_batches

#: The model is fitted on so many labelled documents at most, those with the
#: smallest hash of the id; it has all terms that these show.
FIT_TOXIC, FIT_CLEAN = 4_000, 8_000
FOLDS = 5
#: Letters and digits of a term at least.
LEAST = 3
STEMS = (4, 5, 6)
#: Words on either side of a match that make up its context.
WINDOW = 5
#: What a match counts for when quoted or reported, and when it addresses somebody.
QUOTED, ADDRESSED = 0.25, 1.25
#: What a misspelled match counts for beside an exact one.
MISSPELLED = 0.5
#: Words and automaton moves that a process keeps.
KEPT_WORDS, KEPT_MOVES = 600_000, 400_000

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w+|[\"“”„«»‹›]")
_MARKS = frozenset("\"“”„«»‹›")
_REPORTS = frozenset("said says wrote writes called calling quoted quote quotes term word words phrase slur "
                     "dit écrit appelé mot sagte schrieb nannte wort dijo escribió llamó palabra".split())
_ADDRESS = frozenset("you your you're u ur tu toi vous votre du dich dein sie ihr tú tu usted eres".split())


def edits(term: str) -> int:
    """Errors that a term may have."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class Automaton:
    """The intersection of the terms' Levenshtein automata with their trie. A
    state holds, for each node that the word read so far can lead to, the
    fewest errors, and for each (node, letter) the fewest errors with which the
    letter leads to the node as the second of two that are swapped."""

    DEAD = 0

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = ()):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]  # errors allowed to a term that ends here
        self.stem: list[bool] = [False]
        self.room: list[int] = [0]  # most errors allowed to a term below
        for t in terms:
            path = self._path(t)
            self.term[path[-1]] = edits(t)
            for n in path:
                self.room[n] = max(self.room[n], edits(t))
        for s in stems:
            self.stem[self._path(s)[-1]] = True
        self._reset()

    def _path(self, word: str) -> list[int]:
        path = [0]
        for c in word:
            if c not in self.children[path[-1]]:
                self.children[path[-1]][c] = len(self.children)
                self.children.append({})
                self.term.append(-1)
                self.stem.append(False)
                self.room.append(0)
            path.append(self.children[path[-1]][c])
        return path

    def _reset(self) -> None:
        self.states: list[dict] = [{}, self._missing({0: 0})]
        self.known = {frozenset(s.items()): k for k, s in enumerate(self.states)}
        self.moves: list[dict[str, int]] = [{}, {}]
        self.made = 0

    def _missing(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes that letters left out of the word lead to."""
        todo = [(node, e) for node, e in state.items() if type(node) is int]
        while todo:
            node, e = todo.pop()
            if e > state[node]:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and e + 1 < state.get(child, 99):
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return state

    def _move(self, state: int, c: str) -> int:
        if self.made > KEPT_MOVES:
            return -1
        new: dict[int | tuple[int, str], int] = {}
        for node, e in self.states[state].items():
            if type(node) is tuple:
                if node[1] == c:
                    new[node[0]] = min(e, new.get(node[0], 99))
                continue
            if e < self.room[node]:  # a letter too many
                new[node] = min(e + 1, new.get(node, 99))
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.room[child] and cost < new.get(child, 99):
                    new[child] = cost
                if letter != c and (after := self.children[child].get(c)) and e < self.room[after]:
                    new[after, letter] = min(e + 1, new.get((after, letter), 99))
        new = self._missing(new)
        key = frozenset(new.items())
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][c] = self.known[key]
        self.made += 1
        return self.known[key]

    def errors(self, word: str) -> int:
        """The fewest errors with which the word is a term (0 also where it
        starts with a stem), or -1."""
        state, moves = 1, self.moves
        for k, c in enumerate(word):
            to = moves[state].get(c)
            if to is None:
                to = self._move(state, c)
                if to < 0:  # the table is full: start it anew
                    self._reset()
                    return self.errors(word)
            state = to
            if state == self.DEAD:
                return -1
            if k >= 3 and any(e == 0 and self.stem[n] for n, e in self.states[state].items()):
                return 0
        return min((e for n, e in self.states[state].items() if type(n) is int and e <= self.term[n]), default=-1)


@dataclass
class Lexicon:
    """Terms, stems, and words near a term that clean documents use."""

    terms: list[str]
    stems: list[str]
    clean: frozenset[str] = frozenset()
    _automaton: Automaton | None = field(default=None, repr=False)
    _seen: set = field(default_factory=set, repr=False)
    _hits: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "stems": self.stems, "clean": self.clean, "_automaton": None, "_seen": set(), "_hits": {}}

    def hits(self, words: set[str]) -> dict[str, int]:
        """The words that match, with their errors."""
        if self._automaton is None:
            self._automaton = Automaton(self.terms, self.stems)
        if len(self._seen) > KEPT_WORDS:
            self._seen, self._hits = set(), {}
        new = words - self._seen
        for w in new:
            e = self._automaton.errors(w)
            if e == 0 or e > 0 and w not in self.clean:
                self._hits[w] = e
        self._seen |= new
        return {w: self._hits[w] for w in words & self._hits.keys()}


def matches(lexicon: Lexicon, text: str | None, window: int = WINDOW) -> tuple[int, int, int, int, float, float]:
    """n_words, matches, of these with errors and of these quoted, and the
    weights by context of the exact and of the misspelled ones."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = lexicon.hits(set(words))
    if not hits:
        return len(words), 0, 0, 0, 0.0, 0.0
    tokens = _TOKEN.findall(low)
    n = misspelled = quoted = 0
    weight = [0.0, 0.0]
    for k, t in enumerate(tokens):
        if t not in hits:
            continue
        before, after = tokens[max(0, k - window):k], tokens[k + 1:k + 1 + window]
        quote = not _MARKS.isdisjoint(before) and not _MARKS.isdisjoint(after) or not _REPORTS.isdisjoint(before)
        address = not _ADDRESS.isdisjoint(before) or not _ADDRESS.isdisjoint(after)
        n += 1
        misspelled += hits[t] > 0
        quoted += quote
        weight[hits[t] > 0] += QUOTED if quote else ADDRESSED if address else 1.0
    return len(words), n, misspelled, quoted, *weight


def features(m: tuple) -> list[float]:
    weight = m[4] + MISSPELLED * m[5]
    return [1.0, math.log1p(weight), math.log1p(1000 * weight / max(m[0], 1))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; weights of matches are not negative."""
    w = np.zeros(x.shape[1])
    free = np.ones(x.shape[1], bool)
    for _ in range(x.shape[1]):
        w[~free] = 0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            penalty = np.r_[1e-3, np.full(x.shape[1] - 1, ridge)]
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
            step[~free] = 0
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if not (low := free & (w < 0) & (np.arange(len(w)) > 0)).any():
            break
        free &= ~low
    return np.where(free, w, 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Null ids are labelled by nothing and count as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from, at most ``FIT_TOXIC``
    and ``FIT_CLEAN`` of either kind. Ids with both labels teach nothing; of
    rows that repeat an id the one with the least hash of its text counts."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out())
    own = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").withColumn("order", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    # the smallest hashes lie, but for chance, under twice the share that is wanted; so no task has many to sort
    under = {k: min(1.0, 2 * (n + 100) / counts.get(k, 1)) * 2.0 ** 63 for k, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))}
    ids = [own.where((F.col("toxic") == k) & (F.col("order").cast("double") <= under[k])).orderBy("order", "doc_id").limit(n)
           .select("doc_id", "toxic") for k, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    ids = ids[0].union(ids[1])  # FIT_TOXIC + FIT_CLEAN rows at most
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("row"))
    return cut_lineage(rows.select("row.text", "toxic"))


def _terms(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of either kind that have the word, or a
    word with the stem (marked ``*``). Of near copies, which share the smallest
    hash of their word triples, one counts."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for t, y in zip(b.column(0), b.column(1)):
                    w = _WORD.findall((t.as_py() or "").lower())
                    sketch = min((xxhash.xxh64_intdigest(" ".join(x)) for x in zip(w, w[1:], w[2:])), default=0) >> 1
                    words = {x for x in w if len(x) >= LEAST and not x.isdigit()}
                    yield sketch, y.as_py(), [*words, *{f"{x[:n]}*" for x in words for n in STEMS if len(x) >= n}]

        return in_batches(rows(), schema, lambda r: 8 * len(r[2]))

    schema = pa.schema([("sketch", pa.int64()), ("toxic", pa.int32()), ("terms", pa.list_(pa.string()))])
    docs = sample.mapInArrow(words, "sketch bigint, toxic int, terms array<string>").dropDuplicates(["sketch", "toxic"])
    return docs.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights. A term must be in three toxic documents or more,
    be ten times as frequent in toxic ones, and its log-likelihood ratio must
    pass twice the logarithm of the number of terms looked at."""
    sample = _sample(docs, labels)
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, n = kinds.get(1, 0), kinds.get(0, 0)
    if not p or not n:
        return Lexicon([], []), np.array([-30.0 if not p else 30.0, 0, 0])
    found = _terms(sample)
    found = found.withColumn("looked", F.lit(found.count()))
    both = F.col("toxic") + F.col("clean")
    part = lambda k, e: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / e)).otherwise(0.0)
    ratio = 2 * (part("toxic", both * p / (p + n)) + part("clean", both * n / (p + n)))
    odds = (F.col("toxic") / p) / ((F.col("clean") + 0.5) / (n + 1))
    best = (found.where("toxic >= 3").withColumn("ratio", ratio).where((odds >= 10) & (F.col("ratio") >= 2 * F.log("looked")))
            .select("term").collect())  # of FIT_TOXIC documents
    terms = sorted(r["term"] for r in best)
    lexicon = Lexicon([t for t in terms if t[-1] != "*"], [t[:-1] for t in terms if t[-1] == "*"])
    near = sample.where("toxic = 0").mapInArrow(_near_words(lexicon), "word string").distinct().collect()
    lexicon = Lexicon(lexicon.terms, lexicon.stems, frozenset(r["word"] for r in near))
    rows = sample.select(F.lit(0).cast("bigint").alias("doc_id"), "text", "toxic")
    out = rows.mapInArrow(_measured(lexicon, "toxic"), f"{_DDL}, toxic int").drop("doc_id").collect()
    x = np.array([features(r[:6]) for r in out])
    return lexicon, fit(x, np.array([r[6] for r in out], float))


_MEASURES = ("n_words", "n_matches", "n_misspelled", "n_quoted", "exact_weight", "misspelled_weight")
_DDL = "doc_id bigint, n_words bigint, n_matches bigint, n_misspelled bigint, n_quoted bigint, exact_weight double, misspelled_weight double"
_SCHEMA = [("doc_id", pa.int64()), *((c, pa.int64()) for c in _MEASURES[:4]), *((c, pa.float64()) for c in _MEASURES[4:])]


def _near_words(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((w,) for b in batches for t in b.column(0)
                for w, e in lexicon.hits(set(_WORD.findall((t.as_py() or "").lower()))).items() if e > 0)
        return in_batches(rows, pa.schema([("word", pa.string())]))

    return run


def _measured(lexicon: Lexicon, *others: str):
    schema = pa.schema([*_SCHEMA, *((c, pa.int32()) for c in others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((v[0].as_py(), *matches(lexicon, v[1].as_py()), *(x.as_py() for x in v[2:]))
                for b in batches for v in zip(*b.columns, strict=True))
        return in_batches(rows, schema)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted
    and what the score is made of.

    A null text counts as empty, and scores what a text without matches does;
    a null id is held out; repeated rows give repeated rows; what repeated ids
    and conflicting labels teach, :func:`_sample` states; an empty table
    gives none; without labels of both kinds all scores are 0 or 1 alike; other
    columns of ``docs`` are ignored. One pass over all rows after the fit.
    """
    own = id_and_text(docs, id_col, text_col)
    lexicon, w = learn(own, labels)
    out = own.mapInArrow(_measured(lexicon), _DDL)
    weight = F.col("exact_weight") + MISSPELLED * F.col("misspelled_weight")
    x = [F.lit(1.0), F.log1p(weight), F.log1p(1000 * weight / F.greatest("n_words", F.lit(1)))]
    z = sum((F.lit(float(a)) * b for a, b in zip(w, x)), F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return (out.withColumn("held_out", held_out()).withColumn("score", score)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "n_words", "n_matches", "n_misspelled", "n_quoted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that aren't held out."""
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
