import random

import numpy as np
import pytest
import sentencepiece

from fieldsense.llm import pieces as P

from . import cases

ODD = ["", " ", "  a\tb\n  c  ", "x 　ﬁ", "é" * 100, "a" * 1000 + " " + "bc" * 300, "\n\n x\n", "日本語テキスト😀", "\x00\x01", "Ünïcode ß"]


@pytest.fixture(scope="module")
def model():
    return P.model_at(P.MODEL)


def texts():
    return [r[1] for r in cases.texts() if r[0] != 306 and r[1]]


def test_without_dropout_it_is_the_plain_encoding(model):
    plain, own = sentencepiece.SentencePieceProcessor(model_file=P.MODEL), P.Encoder(model, 0.0, 0)
    for t in [*ODD, *texts()]:
        if P.SPACE not in t:
            assert own.encode(t).tolist() == plain.encode(t), t[:60]


def test_lossless_and_repeatable(model):
    a, b = P.Encoder(model, 0.3, 9), P.Encoder(model, 0.3, 9)
    for v in range(4):
        for t in [*ODD, *texts(), P.SPACE, f"a{P.SPACE} b {P.SPACE}{P.SPACE}", None]:
            ids = a.encode(t, v).tolist()
            assert P.decode(model, ids) == (t or "")
            assert ids == b.encode_all(["other text", t], [v + 1, v])[1].tolist()


def test_keys_and_seeds_differ(model):
    text = texts()[0]
    of = lambda rate, seed, v: tuple((e := P.Encoder(model, rate, seed)).encode(text, e.dropout.key(v)).tolist())
    assert len({of(0.3, s, v) for s in (1, 2) for v in range(4)}) == 8
    assert len(of(0.5, 1, 0)) > len(of(0.1, 1, 0)) > len(of(0.0, 1, 0))
    assert all(len(model.text[i]) <= 3 for i in of(1.0, 1, 0))


def test_agendas_of_many_chunks_equal_single_ones(model):
    rnd, agendas = random.Random(2), P.Agendas(model)
    chunks = ["".join(rnd.choice("▁theandrouß\U0001f600") for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    for rate in (0.0, 0.2, 1.0):
        d = P.Dropout(rate, 3)
        base = d.bases(d.key(1), 0, len(chunks))
        ids, sizes = agendas.run(chunks, d, base)
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [
            P.ids_of(model, c, d, int(h)).tolist() for c, h in zip(chunks, base)]


def test_kept_chunks_change_nothing(model, monkeypatch):
    """Each chunk's agenda by itself, with the skips of its own place."""
    monkeypatch.setattr(P, "TOGETHER", 50)
    own = P.Encoder(model, 0.2, 4)
    own.chunks.most = 40
    docs = [*ODD, *texts(), f"a{P.SPACE} b {P.SPACE}{P.SPACE}"]
    keys = [own.dropout.key(k) for k in range(len(docs))]
    for t, key, ids in zip(docs, keys, own.encode_all(docs, keys)):
        want, chunks = [], P._CHUNK.findall(" " + t) if t else []
        for c, h in zip(chunks, own.dropout.bases(key, 0, len(chunks))):
            want += own.sign.tolist() if c == P.SPACE else P.ids_of(model, c.replace(" ", P.SPACE), own.dropout, int(h)).tolist()
        assert ids.tolist() == want


def test_a_word_varies_with_document_copy_and_place(model):
    own = P.Encoder(model, 0.1, 0)
    once = lambda ids: tuple(ids.tolist())
    word, n = "internationalisation", 400
    places = own.encode(" ".join([word] * n))
    apart, part = set(), []
    for i in places.tolist():  # a word begins with the piece that has a space
        if part and model.text[i].startswith(b" "):
            apart.add(tuple(part))
            part = []
        part.append(i)
    assert len(apart) > 20
    assert len({once(own.encode(word, own.dropout.key(d))) for d in range(n)}) > 20
    assert len({once(own.encode(word, own.dropout.key(1, c))) for c in range(n)}) > 20


def test_dropout_rate_is_met():
    d = P.Dropout(0.1, 5)
    base = d.key(2)
    assert 0.09 < sum(d.skips(base, k % 50, k) for k in range(20_000)) / 20_000 < 0.11
    with pytest.raises(ValueError):
        P.Dropout(1.5, 0)


def test_documents(spark):
    docs = cases.documents(spark)
    out = P.encode_documents(docs)
    rows = out.collect()
    assert len(rows) == len(cases.texts()) and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    back = P.decode_documents(out).collect()
    assert cases.as_bag(back) == cases.as_bag((r[0], r[1] or "") for r in cases.texts())
    assert {r.n_tokens for r in rows if r.doc_id in (300, 301)} == {0}
    assert P.encode_documents(docs.where("false")).count() == 0
    assert cases.as_bag((r.doc_id, tuple(r.ids)) for r in rows) == cases.as_bag(
        (r.doc_id, tuple(r.ids)) for r in P.encode_documents(docs.repartition(7)).collect())
