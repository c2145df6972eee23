import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from fieldsense.llm import lexical as L

from . import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(rows, queries, k=50):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    big_n, big_l = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    items = defaultdict(set)
    for i, t in queries:
        items[i] |= set(terms(t))
    out = []
    for item, ts in items.items():
        found = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in ts if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


def queries(rnd):
    out = [(k, " ".join(rnd.choices(cases.WORDS, k=rnd.choice((1, 3, 12))))) for k in range(25)]
    return out + [(50, None), (51, ""), (52, "KALO kalo, Té-TÉ!"), (53, "nowhere"), (None, "same one"), (None, "without"), (54, "x" * 70_000)]


def search(spark, rows, qs, **kw):
    items = spark.createDataFrame([(i, t, "clash", "clash") for i, t in qs], "item_id bigint, text string, doc_id string, score string")
    return [tuple(r) for r in L.ranked_search(cases.documents(spark, rows), items, **kw).select("item_id", "rank", "doc_id", "score").collect()]


def test_terms():
    text = "Ab_c9\x00d É x y 😀-z [k]"
    assert [t.decode() for t in L.terms_of(text)] == terms(text)
    assert L.terms_of(None) == []


def test_equals_brute_force(spark):
    rows, qs = cases.texts(), queries(random.Random(2))
    plain = [(r[0], r[1]) for r in rows]
    assert cases.as_bag(search(spark, rows, qs)) == cases.as_bag(brute(plain, qs))
    assert cases.as_bag(search(spark, rows, qs, k=3, per_pass=10)) == cases.as_bag(brute(plain, qs, 3))


def test_blocks_are_skipped_and_nothing_is_lost():
    rnd = random.Random(4)
    words = [b"%d" % i for i in range(300)]
    topics = [rnd.sample(range(300), 25) for _ in range(40)]
    rows = [(i, 30, *np.unique(rnd.choices(topics[i % 40], k=30), return_counts=True)) for i in range(1500)]
    df = Counter(t for r in rows for t in r[2])
    stats = L.Statistics(len(rows), 30 * len(rows), np.array([L.weight(len(rows), df[t]) for t in range(len(words))]))
    qs = [np.array(sorted(rnd.sample(topics[j], 8), key=lambda t: -stats.weights[t])) for j in range(20)]
    asked = L._asked(qs, len(words))
    shard = L.Shard(rows, stats, asked)
    seen = missed = 0
    for q in qs:
        best = L.Best(10)
        b, s = shard.search(q, asked, best)
        seen, missed = seen + b, missed + s
        want = sorted(((-int(shard.matrix[d, q].sum()), d) for d in range(len(rows)) if shard.matrix[d, q].sum() > 0))[:10]
        assert [(-s, i) for s, i in best.found] == want
    assert missed > seen / 4
    for docs, starts, summaries in shard.lists.values():
        assert len(starts) == len(summaries) and (np.diff(np.r_[starts, len(docs)]) > 0).all()


def test_empty_sides(spark):
    assert search(spark, [], [(1, "kalo")]) == []
    assert search(spark, cases.texts(), []) == []
    assert search(spark, [(1, None, None, None, None)], [(1, "kalo")]) == []


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.sql(L.OP12_SQL)
    got = L.op12_lexical_search(spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert cases.as_bag(got.select(want.columns).collect()) == cases.as_bag(want.fetchall())
