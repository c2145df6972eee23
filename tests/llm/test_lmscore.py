import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsense.llm import lmscore as M

from . import cases

GOOD = {1, 2, 3, 9, 100}


class Plain:
    """The models by plain counting of words and pairs of words."""

    def __init__(self, rows, good):
        self.pairs, self.contexts, self.unigrams = ([Counter(), Counter()] for _ in range(3))
        self.vocabulary = {"</s>"}
        for i, text in rows:
            for m in ((0, 1) if i in good else (1,)):
                for b, w in self.steps(text):
                    self.pairs[m][b, w] += 1
                    self.contexts[m][b] += 1
                    self.unigrams[m][w] += 1
            self.vocabulary |= {w for _, w in self.steps(text)}

    @staticmethod
    def steps(text):
        words = (text or "").lower().split()
        return list(zip(["<s>", *words], [*words, "</s>"])) if words else []

    def probability(self, b, w, m):
        n, v = sum(self.unigrams[m].values()), len(self.vocabulary)
        unigram = (self.unigrams[m][w] + M.FLOOR) / (n + M.FLOOR * v)
        return (self.pairs[m][b, w] + M.PRIOR * unigram) / (self.contexts[m][b] + M.PRIOR)

    def score(self, text):
        s = self.steps(text)
        loss = [sum(-math.log(self.probability(b, w, m)) for b, w in s) / max(1, len(s)) for m in (0, 1)]
        return max(0, len(s) - 1), round(loss[0], 8) + 0.0, round(loss[1], 8) + 0.0, round(loss[0] - loss[1], 8) + 0.0


@pytest.mark.parametrize("chunk_bytes", [M.CHUNK_BYTES, 3000])
def test_documents(spark, chunk_bytes):
    rows = [r for r in cases.texts() if r[0] != 306]
    target = spark.createDataFrame([(k,) for k in (1, 2, 3, 9, 100, 9, None)], "doc_id long")
    got = M.score_documents(cases.documents(spark, rows), target, chunk_bytes=chunk_bytes).collect()
    model = Plain([r[:2] for r in rows], GOOD)
    memo = {t: model.score(t) for t in {r[1] for r in rows}}
    want = [(r[0], *memo[r[1]]) for r in rows]
    assert cases.as_bag((r[0], r[1], *(round(x, 8) + 0.0 for x in r[2:])) for r in got) == cases.as_bag(want)


def test_probabilities_add_up_to_one():
    """Of every context, by the operator's own counting and smoothing."""
    rows = [(k, cases.prose(random.Random(k), 40)) for k in range(30)]
    steps = M.Steps([t for _, t in rows])
    of = dict(zip(steps.keys.tolist(), steps.counts(np.array([float(i in GOOD) for i, _ in rows])).T))
    nexts = np.array(sorted({M.word_key(w) for _, t in rows for w in M.words_of(t)}) + [int(M.END)], np.uint64)
    n_next = np.array([of[int(k)] for k in nexts])
    texts = n_next[-1]
    assert texts.tolist() == [4, 30]
    totals, zero = M.Totals(len(nexts), n_next.sum(axis=0), texts), np.zeros(2, np.int64)
    for before in [int(M.START), *nexts[:-1].tolist()]:
        pairs = np.array([of.get(int(k), zero) for k in M.bigram_keys(np.full(len(nexts), before, np.uint64), nexts)])
        for m in (0, 1):
            context = texts[m] if before == int(M.START) else of[before][m]
            p = np.exp(-totals.losses(pairs[:, m], context, n_next[:, m], m))
            assert p.sum() == pytest.approx(1.0, abs=1e-9)


def test_packing():
    for a in (np.array([], np.uint64), np.array([5], np.uint64), np.arange(0, 1 << 60, 1 << 50, np.uint64), np.arange(300, dtype=np.uint32)):
        assert M.unpack(M.pack(a), a.dtype).tolist() == a.tolist()


def test_empty(spark):
    docs = cases.documents(spark)
    target = spark.createDataFrame([], "doc_id long")
    assert M.score_documents(docs.where("false"), target).count() == 0
    rows = M.score_documents(docs, target).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r.difference) for r in rows)


def test_texts_are_shuffled_once_and_dealt_evenly(spark):
    rows = [(None, "the same text again", None, None, None)] * 3000 + [r for r in cases.texts() if r[0] != 306]
    out = M.score_documents(cases.documents(spark, rows), spark.createDataFrame([(1,)], "doc_id long"), chunk_bytes=4000)
    assert len(out.collect()) == len(rows)
    assert max(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < len(rows) / 4
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_query_tells_good_from_bad(spark):
    d = "/root/testdata/sf0.01"
    rows = M.op4_lm_scoring(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.difference for r in rows if r.quality == q] for q in (1, 0))
    assert sum(g < b for g in good for b in bad) > 0.95 * len(good) * len(bad)
