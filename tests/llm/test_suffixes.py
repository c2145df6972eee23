import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from fieldsense.llm import suffixes as S

from . import cases


def brute(rows, match=S.MATCH):
    """Every string of every text in a dict of the smallest doc_ids."""
    bodies = [(S.NO_ID if r[0] is None else r[0], r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for key, _, b in bodies:
        for p in range(len(b) - match + 1):
            w = b[p:p + match]
            if key < least.get(w, S.NO_ID + 1):
                least[w] = key
    out = []
    for key, doc, b in bodies:
        gone = [False] * len(b)
        reach = 0
        for p in range(len(b) - match + 1):
            if least[b[p:p + match]] < key:
                for q in range(max(p, reach), p + match):
                    gone[q] = True
                reach = p + match
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=11):
    """Documents that share passages, cut and joined at any byte."""
    rnd = random.Random(seed)
    pool = [cases.prose(rnd, rnd.choice((15, 40, 200))) for _ in range(12)]
    rows = []
    for k in range(90):
        parts = [cases.prose(rnd, 20)]
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            parts += [p[a:a + rnd.choice((30, 49, 50, 51, 90, 400))], cases.prose(rnd, rnd.choice((1, 9)))]
        rows.append((rnd.randrange(70), "".join(parts), "en", "a", 1))
    hot = pool[3][:60]
    rows += [(1000 + k, f"{k}{hot}{k * 7}" + ("é" * 60 if k % 9 == 0 else ""), "en", "b", 1) for k in range(200)]
    return rows


def result(spark, rows, parts=5, **kw):
    out = S.remove_repeats(cases.documents(spark, rows).repartition(parts), **kw)
    return cases.as_bag(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_equals_brute_force(spark):
    assert result(spark, cases.texts()) == cases.as_bag(brute(cases.texts()))


@pytest.mark.parametrize("kw", [dict(), dict(batch=64), dict(match=20, gram=9), dict(hot_texts=3)])
def test_shared_passages(spark, kw):
    rows = passages()
    assert result(spark, rows, chunk_bytes=2000, **kw) == cases.as_bag(brute(rows, kw.get("match", S.MATCH)))


def test_nothing_and_little(spark):
    assert result(spark, []) == []
    rows = [(3, "a" * 49, None, None, None), (2, "a" * 49, None, None, None), (1, None, None, None, None), (None, "b" * 50, None, None, None),
            (None, "b" * 50, None, None, None), (7, "c" * 50, None, None, None), (None, "c" * 50, None, None, None)]
    assert result(spark, rows) == cases.as_bag(brute(rows))
    with pytest.raises(ValueError):
        result(spark, rows, match=90)


def test_family_has_logarithmically_many_levels():
    rnd = np.random.default_rng(1)
    family, least = S.Family(), {}
    for k in range(64):
        words = rnd.integers(0, 40, (100, 2)).astype(np.uint64)
        doc = np.sort(rnd.integers(10 * k, 10 * k + 10, 100))
        got = family.add(words.T, doc)
        for w, d in zip(map(tuple, words.tolist()), doc.tolist()):
            least[w] = min(least.get(w, d), d)
        assert got.tolist() == [least[tuple(w)] < d for w, d in zip(words.tolist(), doc.tolist())]
        sizes = [len(x) for x in family.levels]
        assert len(sizes) <= 8 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        for level in family.levels:
            rows = [tuple(w) for w in level.words.T.tolist()]
            assert rows == sorted(set(rows))
    assert sum(map(len, family.levels)) >= len(least)


def test_stretches_hold_every_string_once():
    rnd = random.Random(5)
    texts = [bytes(rnd.choices(b"ab", k=n)) for n in (0, 49, 50, 51, 400, 3, 120)]
    s = S.stretches(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))
    places = defaultdict(list)
    for a, b, t in zip(s.first.tolist(), s.last.tolist(), s.text.tolist()):
        places[t] += range(a, b + 1)
    start = 0
    for k, t in enumerate(texts):
        assert places[k] == list(range(start, start + max(0, len(t) - 49)))
        start += len(t)
    assert (s.last - s.first < 31).all()


def test_texts_are_shuffled_once(spark):
    out = S.text_results(cases.documents(spark).selectExpr("coalesce(doc_id, 0) doc_id", "coalesce(text, '') text"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 2
