import functools
import random
import re
import zlib

import numpy as np
import pytest

from fieldsense.llm import toxicity as X

from . import cases


def distance(a, b):
    """Edit distance in which a swap of neighbours is one error (no letter edited twice)."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


TERMS = ["idiot", "scum", "worthless", "moron", "disgusting", "loser", "stupid", "pathetic", "loserish"]


def test_automaton_equals_edit_distance():
    rnd, automaton = random.Random(1), X.Automaton(TERMS)
    for _ in range(5000):
        w = list(rnd.choice(TERMS))
        for _ in range(rnd.randint(0, 3)):
            k, what = rnd.randrange(len(w) + 1), rnd.random()
            if what < 0.3:
                w[k:k + 2] = w[k:k + 2][::-1]
            elif what < 0.5:
                w.insert(k, rnd.choice("abcdeistu"))
            elif k < len(w) > 1:
                w[k:k + 1] = rnd.choice("abcdeistu") if what < 0.75 else ""
        w = "".join(w)
        assert automaton.errors(w) == min((d for t in TERMS if (d := distance(w, t)) <= X.edits(t)), default=-1), w


def test_named_misspellings():
    automaton = X.Automaton([*TERMS, "trash", "ass"])
    for w in ("idoit", "stpuid", "trahs", "scumm", "sc0m", "scmu", "worhtless", "disgsuting"):
        assert automaton.errors(w) == 1, w
    assert automaton.errors("ass") == 0 and automaton.errors("as") == automaton.errors("asks") == -1


def test_automaton_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(X, "KEPT_MOVES", 50)
    automaton = X.Automaton(TERMS, ["vequ"])
    for w in ["idiot", "idjot", "stupdi", "worthles", "vequilo", "nothing", "disgustin"] * 3:
        assert automaton.errors(w) == (0 if w.startswith("vequ") else min((d for t in TERMS if (d := distance(w, t)) <= X.edits(t)), default=-1))


def test_context():
    lexicon = X.Lexicon(["idiot", "moron"], [])
    plain, quoted = X.matches(lexicon, "what an idiot that one is"), X.matches(lexicon, 'the "idiot" scene of the book')
    said, you = X.matches(lexicon, "he was called idiot by them"), X.matches(lexicon, "you idiot")
    assert quoted[4] == said[4] == X.QUOTED < plain[4] == 1 < you[4] == X.ADDRESSED
    assert X.matches(lexicon, "an idjot")[1:3] == (1, 1)
    assert X.matches(lexicon, None) == X.matches(lexicon, "") == (0, 0, 0, 0, 0.0, 0.0)


def test_fit():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(500), rng.normal(size=500), rng.normal(size=500)])
    y = (x[:, 1] > 0.3).astype(float)
    w = X.fit(x, y)
    assert ((x @ w >= 0) == (y == 1)).mean() > 0.97 and (w[1:] >= 0).all()


def test_edge_cases(spark):
    docs = cases.documents(spark)
    some = spark.createDataFrame([(k, 1, k % 2) for k in range(40)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (some, some.where("toxic = 0"), some.where("false")):
        rows = X.score_toxicity(docs, labels).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)
    assert X.score_toxicity(docs.where("false"), some).count() == 0


def test_repeated_ids_and_conflicting_labels(spark):
    docs = spark.createDataFrame([(k // 3, f"text {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)] + [(3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    taught = [k for k in range(20) if zlib.crc32(str(k).encode()) % 5 and k != 3]
    rows = X._sample(docs, labels).collect()
    assert sorted((int(r.text[5:]) // 3, r.toxic) for r in rows) == [(k, k % 2) for k in taught]


def test_measures_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    lexicon, _ = X.learn(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert lexicon.terms or lexicon.stems

    @functools.cache
    def hit(word):
        if any(word.startswith(s) for s in lexicon.stems):
            return 0
        near = min((e for t in lexicon.terms if abs(len(t) - len(word)) <= 2 and (e := distance(t, word)) <= X.edits(t)), default=-1)
        return -1 if near > 0 and word in lexicon.clean else near

    for row in docs.where("doc_id < 250").collect():
        own = [hit(w) for w in re.findall(r"\w+", (row.text or "").lower())]
        got = X.matches(lexicon, row.text)
        assert got[:3] == (len(own), sum(e >= 0 for e in own), sum(e > 0 for e in own)), row.doc_id


def test_documents_with_misspelled_terms_only(spark):
    """Held-out toxic documents in which every exact match has a swap or a letter changed."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    lexicon, w = X.learn(docs.select("doc_id", "text"), labels)
    rnd, seen, caught = random.Random(8), 0, 0
    for row in docs.join(labels.where("toxic = 1"), "doc_id").where(X.held_out()).select("text").collect():
        def spoil(m):
            word = m[0]
            if len(word) < 4 or lexicon.hits({word.lower()}).get(word.lower()) != 0:
                return word
            k = rnd.choice((1, 2))  # within every stem
            swap = word[k] != word[k + 1] and rnd.random() < 0.5
            return word[:k] + (word[k + 1] + word[k] + word[k + 2:] if swap else "0" + word[k + 1:])
        text = re.sub(r"\w+", spoil, row.text)
        if X.matches(lexicon, row.text)[1]:
            n, of, misspelled = X.matches(lexicon, text)[:3]
            assert of == misspelled
            seen += 1
            caught += np.dot(X.features(X.matches(lexicon, text)), w) >= 0
    print(f"misspelled only: {caught} of {seen}; terms {len(lexicon.terms)}, stems {len(lexicon.stems)}")
    assert seen > 20 and caught >= 0.6 * seen


@pytest.mark.parametrize("sf,least", [("sf0.1", 0.9)])
def test_held_out_accuracy(spark, sf, least):
    d = f"/root/testdata/{sf}"
    rows = X.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= least * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)
