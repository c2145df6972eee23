import hashlib
import random
import re

import xxhash

from fieldsense.llm import winnow as W

from . import cases

MASK = (1 << 64) - 1


def rotate(x, j):
    return ((x << j) | (x >> (64 - j))) & MASK


def brute(text, k=W.K, w=W.W):
    units = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    if not units:
        return []
    h = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    grams = [xxhash.xxh64_intdigest(" ".join(units).encode(), 42)] if len(units) < k else []
    for i in range(len(units) - k + 1):
        g = 0
        for j in range(k):
            g ^= rotate(h[i + j], k - 1 - j)
        grams.append(g)
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        best = min((grams[j] & 0xFFFFFFFF, -j) for j in range(i, min(i + w, len(grams))))
        if (best[0], -best[1]) not in out:
            out.append((best[0], -best[1]))
    return out


def likeness(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def text_of(f):
    return " ".join("%X@%d" % x for x in f)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    out = []
    for k, (i, text, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        f, e, n = brute(text), brute(edited), brute(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(f), text_of(e), likeness(f, e), likeness(f, n)))
    return out


def signed(x):
    return x - (x >> 63 << 64)


def test_documents(spark):
    rows = [r for r in cases.texts() if r[0] != 306]
    keyed = [(r[0], r[1] or "", signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))) for r in rows]
    # null ids come last, in chunks by the upper bits of the text's hash
    keyed = [(i, t, (h >> 52, h) if i is None else (0, h)) for i, t, h in keyed]
    want = expected(keyed)
    got = W.fingerprint_edits(cases.documents(spark, rows)).collect()
    assert cases.as_bag(got) == cases.as_bag(want)
    assert W.fingerprint_edits(cases.documents(spark, [])).count() == 0


def test_next_across_chunks_and_gaps(spark):
    rnd = random.Random(3)
    ids = sorted({rnd.choice((rnd.randrange(300), rnd.randrange(10**6), -rnd.randrange(10**9), 10**15 + k)) for k in range(400)})
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    for rows in (1, 7, 1000):
        got = {r.doc_id: r.next_text for r in W.with_next(docs, rows=rows).collect()}
        assert got == {i: f"text {ids[k - 1]}" for k, i in enumerate(ids)}


def test_chunks_stay_small_whatever_the_ids(spark):
    from pyspark.sql import functions as F
    for ids in (range(20_000), [k * 977 for k in range(20_000)], [*range(10_000), *range(10**15, 10**15 + 10_000)], [k**3 - 10**12 for k in range(20_000)]):
        docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        sizes = docs.withColumn("c", W._chunk(docs, "doc_id", 40)).groupBy("c").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("c").collect()
        assert max(r.n for r in sizes) <= 160 and len(sizes) >= 200
        assert all(x.b < y.a for x, y in zip(sizes, sizes[1:]))


def test_a_shared_passage_is_always_found(spark):
    rnd = random.Random(11)
    passage = [rnd.choice(cases.WORDS) + str(k) for k in range(W.K + W.W - 1)]
    rows = [(k, " ".join([*(f"{k}a{j}" for j in range(rnd.randrange(30))), *passage, *(f"{k}b{j}" for j in range(rnd.randrange(30)))])) for k in range(40)]
    out = W.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = set(out[0].hashes)
    assert all(first & set(r.hashes) for r in out)


def test_a_single_row_is_its_own_next(spark):
    r = W.fingerprint_edits(spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.n_chars == 15


def test_no_python_in_the_plan(spark):
    plan = W.op6_winnowing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
