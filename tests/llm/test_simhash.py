import random
import re

import numpy as np
import pytest
import xxhash

from fieldsense.llm import simhash as S

from . import cases


def slow(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, bits):
    """component_id by row, comparing all fingerprints."""
    fps = np.array([f for _, f in pairs], np.uint64)
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits)):
        a, b = root(int(i)), root(int(j))
        parent[max(a, b)] = min(a, b)
    ids = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            ids[root(k)] = min(i, ids.get(root(k), i))
    return [ids.get(root(k)) for k in range(len(pairs))]


def test_fingerprint():
    for text in (None, "", " \n ", "One", "a b c", "A b c D É", "a\x85b c\x1cd e f g h", cases.texts()[3][1], cases.prose(random.Random(4), 70_000)):
        assert S.fingerprint(text) == slow(text), text


def test_golay_code():
    home, near = S._errors(0), S._errors(1)
    assert home.shape == (2048, 1) and (home >= 0).all()
    assert np.bincount((near >= 0).sum(axis=1)).tolist() == [277, 0, 0, 0, 0, 1771]
    assert (S._errors(2) >= 0).sum() == 33649


@pytest.mark.parametrize("blocks", [1, 2])
@pytest.mark.parametrize("flips", range(6))
def test_every_pair_in_reach_meets_at_a_home(flips, blocks):
    rng = np.random.default_rng(flips)
    x = rng.integers(-(1 << 63), (1 << 63) - 1, 400, dtype=np.int64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, flips, replace=False):
            y[k] ^= np.uint64(1 << int(b)).astype(np.int64)
    at, to, own = S.anchors(np.concatenate([x, y]), max(4, flips), blocks)
    homes, all_ = {}, {}
    for i, a, h in zip(at.tolist(), to.tolist(), own.tolist()):
        all_.setdefault(i, set()).add(a)
        if h:
            homes.setdefault(i, set()).add(a)
    assert all(homes[k] & all_[k + 400] for k in range(400))


def test_documents(spark):
    got = S.near_duplicates(cases.documents(spark)).collect()
    rows = cases.texts()
    pairs = [(r[0], S.fingerprint(r[1])) for r in rows]
    want = [(i, f - (f >> 63 << 64), c) for (i, f), c in zip(pairs, groups(pairs, 4))]
    assert cases.as_bag(got) == cases.as_bag(want)
    assert S.near_duplicates(cases.documents(spark, [])).count() == 0


@pytest.mark.parametrize("group,blocks", [(1 << 20, 1), (10, 1), (1 << 20, 2), (10, 2)])
def test_links_in_cells_are_the_same(spark, group, blocks):
    rng = np.random.default_rng(5)
    centre = rng.integers(-(1 << 63), (1 << 63) - 1, 20, dtype=np.int64)
    fps = set()
    for c in centre.tolist():
        for _ in range(12):
            x = c % (1 << 64)
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    distinct = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    links = S.anchor_links(distinct, group=group, blocks=blocks)
    got = {r.node: r.root for r in S.components(links).collect()}
    order = sorted((f - (f >> 63 << 64) for f in fps))
    want = groups([(f, f % (1 << 64)) for f in order], 4)
    assert got == {f: c for f, c in zip(order, want) if f != c}


def test_chain_and_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 30)] + [(2000, 1500)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{1000 + k: 1000 for k in range(1, 30)}, 2000: 1500}


def test_one_document_of_each_group_stays(spark):
    docs = cases.documents(spark)
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    rows = cases.texts()
    want = set(groups([(r[0], S.fingerprint(r[1])) for r in rows], 4))
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_null_and_repeated_ids_lose_no_other_document(spark):
    rnd = random.Random(11)
    a, b, c, d, e = (cases.prose(rnd, 120) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, a), (8, d), (8, e), (8, e), (9, d), (3, d), (None, None), (None, " ")]
    out = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert cases.as_bag(r for r in out if (r.text or "").strip()) == cases.as_bag([(7, a), (None, b), (None, c), (3, d), (8, e)])
    assert len(out) == 6
