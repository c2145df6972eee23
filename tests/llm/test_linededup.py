import random

import pytest

from fieldsense.llm import linededup as L

from . import cases


def brute(rows, depth=3, similarity=0.7, least=2):
    """Texts after the drop, with all lines in memory."""
    order = lambda i: L._NO_ID if i is None else i
    seen = {}
    for i, text in rows:
        for line, leaf in L.lines_of(text, depth, least).items():
            v = seen.setdefault((leaf, line), [order(i), order(i)])
            v[0], v[1] = min(v[0], order(i)), max(v[1], order(i))
    leaves, first = {}, {}
    for (leaf, line), (a, b) in seen.items():
        leaves.setdefault(leaf, []).append((a, line, b))
    for leaf, group in leaves.items():
        group.sort()
        of = L.templates([x[1].split(b" ") for x in group], similarity, depth)
        for k in set(of):
            own = [x for x, o in zip(group, of) if o == k]
            if min(x[0] for x in own) != max(x[2] for x in own):
                first.update({(leaf, x[1]): min(y[0] for y in own) for x in own})
    out = []
    for i, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            t = L.masked(line.encode())
            if len(t) < least or first.get((L.leaf_of(t, depth), b" ".join(t)), order(i)) == order(i):
                kept.append(line)
        out.append((i, None if text is None else "\n".join(kept)))
    return out


def test_fields():
    assert L.masked(b"Sent 42 mails to a@b.c via http://x.y at 10:30") == b"Sent <*> mails to <*> via <*> at <*>".split()
    assert L.masked(b"") == []


def test_templates():
    lines = [x.split() for x in (b"user ann logged in from home today ok", b"user bob logged in from work today ok",
                                 b"user cid logged out of the site now ok", b"user ann logged in from home today ok")]
    assert L.templates(lines, 0.7) == [0, 0, 1, 0]
    assert L.templates([b"own text of me".split(), b"own text of you".split()], 0.7) == [0, 1]
    assert L.templates([b"two words".split(), b"two words".split()], 0.7) == [0, 0]


def test_documents(spark):
    rows = [r[:2] for r in cases.texts() if r[0] != 306]
    rows += [(500 + k, f"Order {k} was sent to the shop of {w} by train.\nOwn text of {w * 3}.") for k, w in enumerate(cases.WORDS[:9])]
    full = [(*r, None, None, 0) for r in rows]
    docs = cases.documents(spark, full)
    out = L.drop_recurring(docs)
    assert out.columns == [*docs.columns, "__lines", "__dropped"]
    assert cases.as_bag(out.select("doc_id", "text").collect()) == cases.as_bag(brute(rows))
    by = {r.doc_id: r for r in out.collect()}
    assert by[500]["__dropped"] == 0 and by[501]["__dropped"] == 1 and by[301].text is None
    assert L.drop_recurring(docs.where("false")).count() == 0


def test_crowded_leaves_are_parted(spark):
    rows = [(k, f"the same start {a} {b} end of line") for k, (a, b) in enumerate((a, b) for a in cases.WORDS[:12] for b in cases.WORDS[:12])]
    rows += [(1000 + k, t) for k, t in rows[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in L.drop_recurring(docs, leaf_lines=20, similarity=1.0).collect()}
    assert all(out[1000 + k] == "" for k in range(40)) and all(out[k] == t for k, t in rows if k < 1000)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = L.op1_line_dedup(spark, f"/root/testdata/{sf}").select("doc_id", "text").collect()
    assert cases.as_bag(got) == cases.as_bag(brute(rows))


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    boiler = "Please read the terms of this site with care.\n"
    sent = "Your parcel {} has left the shop in town today.\n"
    rows = [(None, boiler + f"Own words {w} of a text without any id." + w) for w in ("ab", "cd", "ef")]
    rows += [(None, rows[0][1]), (5, sent.format("one1") + "First text."), (5, sent.format("two2") + "Second text."),
             (9, sent.format("ten3") + "Third text."), (None, None), (None, "")]
    out = [r.text or "" for r in L.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    own = [t.split("\n")[-1] for _, t in rows[:3]]
    with_line = [x for x in out if boiler in x]
    assert len(set(with_line)) == 1  # one text keeps the line, and its copy does if it is that one
    assert sorted(x for x in out if "Own words" in x and x not in with_line) == sorted(
        x for x in [own[0], *own] if not with_line[0].endswith(x))
    assert sum("parcel" in x for x in out) == 1 and "Third text." in out and len(out) == len(rows)
    assert next(x for x in out if "parcel" in x).endswith(("First text.", "Second text."))


def scan(lines, similarity, depth=3):
    known, out = [], []
    for tokens in lines:
        same = [sum(a == b for a, b in zip(t[depth:], tokens[depth:])) for t in known]
        best = max(range(len(known)), key=lambda k: (same[k], -k), default=-1)
        if best >= 0 and same[best] >= similarity * (len(tokens) - depth):
            known[best] = [a if a == b else L.FIELD for a, b in zip(known[best], tokens)]
        else:
            best = len(known)
            known.append(tokens)
        out.append(best)
    return out


@pytest.mark.parametrize("places", [0, 1, 2, 5, 10])
@pytest.mark.parametrize("similarity", [0.0, 0.3, 0.7, 1.0])
def test_indexed_templates_equal_scanned_ones(places, similarity):
    rnd = random.Random(places)
    lines = [[b"a", b"b", b"c", *(rnd.choice((b"the", b"of", *(b"w%d" % k for k in range(6)), L.FIELD)) for _ in range(places))]
             for _ in range(600)]
    want = scan(lines, similarity)
    assert L.templates(lines, similarity, scanned=0) == L.templates(lines, similarity) == want


def test_crowded_leaf_has_the_templates_of_the_tree(spark):
    rnd, words = random.Random(3), [w for w in cases.WORDS if "9" not in w]
    rows = [(k, " ".join(["the", "same", "start", *(rnd.choice(words) for _ in range(10))])) for k in range(500)]
    rows += [(1000 + k, " ".join([*(t := text.split())[:3], "other", *t[4:]])) for k, text in rows[:100]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.drop_recurring(docs, leaf_lines=20).select("doc_id", "text").collect()
    assert cases.as_bag(got) == cases.as_bag(brute(rows))
    assert all(r.text == "" for r in got if r.doc_id >= 1000)
