"""Removal of byte strings that an earlier document has, by a logarithmic
family of suffix arrays.

Every string of ``MATCH`` bytes belongs to the smallest of its grams (its
anchor), so equal strings have equal anchors, wherever they stand; the strings
in a row with the same anchor form a stretch. Stretches go to the shard of their
anchor, after a first pass that finds the anchors which several texts have; of
an anchor that very many texts have, each string goes to a shard of its own. A
shard takes its stretches in batches of rising doc_id. A batch gets a suffix
array, which is scanned, merged, against the arrays of the levels that exist;
then it becomes a level itself, and levels of equal size are merged, so that
their number is logarithmic and every suffix is moved as often at most."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shard, documents, id_and_text

#: Bytes of a string that counts as a match, and of the grams that anchor it.
MATCH, GRAM = 50, 20
#: Text bytes of a chunk (a task's unit of work) on average, and of a piece whose hashes are held at once.
CHUNK_BYTES, PIECE_BYTES = 8_000_000, 1_000_000
#: Suffixes of a batch, which is the size of the smallest level.
BATCH = 1 << 17
#: Texts from which on an anchor is hot: its strings go to shards of their own.
HOT_TEXTS = 1 << 14
#: Texts that a task remembers having sent.
HELD_TEXTS = 100_000
#: Stands for a null doc_id, which comes last.
NO_ID = (1 << 63) - 1

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MIX = np.uint64(29)
#: Low bits of a sent anchor: the logarithm of how many texts of the chunk have it.
_LOG = np.uint64(4)


# --- anchors and stretches of a piece of text --------------------------------

def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes, from hashes of halves."""
    def joined(h: np.ndarray, step: int) -> np.ndarray:
        left, right = h[:-step] * _A, h[step:]
        left = (left ^ (left >> _MIX)) + right
        left *= _B
        return left ^ (left >> _MIX)

    h, size = (data.astype(np.uint64) + np.uint64(1)) * _B, 1
    while size < gram:
        step = min(size, gram - size)
        if len(h) <= step:
            return np.empty(0, np.uint64)
        h, size = joined(h, step), size + step
    return h


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of every ``width`` values in a row, the leftmost of equals."""
    at, best, size = np.arange(len(values)), values, 1
    while size < width:
        step = min(size, width - size)
        take = best[step:] < best[:-step]
        at, best, size = np.where(take, at[step:], at[:-step]), np.where(take, best[step:], best[:-step]), size + step
    return at


@dataclass
class Stretches:
    """Runs of places whose strings share an anchor: where the first and the
    last of them start, the text they lie in, and the anchor's hash."""

    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    anchor: np.ndarray


def stretches(data: np.ndarray, ends: np.ndarray, match: int = MATCH, gram: int = GRAM) -> Stretches:
    """The stretches of texts that lie end to end in ``data``."""
    none = np.empty(0, np.int64)
    if len(data) < match:
        return Stretches(none, none, none, np.empty(0, np.uint64))
    hashes = gram_hashes(data, gram)
    at = leftmost_least(hashes, match - gram + 1)
    places = np.arange(len(at))
    text = np.searchsorted(ends, places, side="right")
    inside = np.flatnonzero(places + match <= ends[text])  # strings never cross texts
    if not len(inside):
        return Stretches(none, none, none, np.empty(0, np.uint64))
    own_text, own_at = text[inside], at[inside]
    new = np.flatnonzero(np.r_[True, (own_at[1:] != own_at[:-1]) | (own_text[1:] != own_text[:-1])])
    last = np.r_[new[1:], len(inside)] - 1
    return Stretches(inside[new], inside[last], own_text[new], hashes[own_at[new]])


# --- the family of suffix arrays of a shard -----------------------------------

@dataclass
class Level:
    """A suffix array cut to the strings' length: the strings in order, each
    once, as columns of big-endian words, with the smallest doc_id that has it."""

    words: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)


def _order(words: np.ndarray) -> np.ndarray:
    return np.lexsort(words[::-1])


def _starts(words: np.ndarray) -> np.ndarray:
    """Whether a string of a sorted array differs from the one before, that is
    whether their longest common prefix is shorter than a match."""
    return np.r_[True, (words[:, 1:] != words[:, :-1]).any(axis=0)] if words.shape[1] else np.empty(0, bool)


def merged(a: Level, b: Level) -> Level:
    words, doc = np.concatenate([a.words, b.words], axis=1), np.concatenate([a.doc, b.doc])
    order = _order(words)
    words, doc = words[:, order], doc[order]
    new = np.flatnonzero(_starts(words))
    return Level(words[:, new], np.minimum.reduceat(doc, new) if len(new) else doc)


class Family:
    """Levels of geometrically growing size; batches come by rising doc_id."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each string (a column of ``words``) whether a smaller doc_id, of
        this batch or one before, has it; then the batch is a level."""
        order = _order(words)
        ranked = words[:, order]
        new = _starts(ranked)
        group = np.cumsum(new) - 1
        level = Level(ranked[:, new], np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc)
        least = level.doc.copy()
        for older in self.levels:
            found, where = _merge_scan(older, level)
            least[where] = np.minimum(least[where], older.doc[found])
        out = np.empty(len(doc), bool)
        out[order] = least[group] < doc[order]
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merged(a, b))
        return out


def _merge_scan(older: Level, new: Level) -> tuple[np.ndarray, np.ndarray]:
    """The places in both arrays of the strings that both have, which are
    neighbours when the arrays are merged."""
    words = np.concatenate([older.words, new.words], axis=1)
    order = _order(words)
    twin = np.flatnonzero(~_starts(words[:, order]))
    return order[twin - 1], order[twin] - len(older)


def covered_strings(bodies: list[bytes], docs: np.ndarray, match: int = MATCH, batch: int = BATCH) -> list[np.ndarray]:
    """For the bodies of a shard, by rising doc_id, which of their strings a
    smaller doc_id has.

    Strings whose hash no other of the shard has are put aside first; the
    others, batch by batch, go through the suffix arrays, which are exact."""
    counts = np.array([len(b) - match + 1 for b in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum(counts)
    starts = np.repeat(np.cumsum([0, *map(len, bodies[:-1])]) - (ends - counts), counts) + np.arange(counts.sum())
    hashes = gram_hashes(data, match)[starts]
    order = np.argsort(hashes)
    same = np.diff(hashes[order]) == 0
    left = np.sort(order[np.r_[False, same] | np.r_[same, False]])
    covered, doc, family = np.zeros(len(starts), bool), np.repeat(docs, counts), Family()
    view = np.lib.stride_tricks.sliding_window_view(data, match)
    for at in range(0, len(left), batch):
        part = left[at:at + batch]
        wide = np.zeros((len(part), -(-match // 8) * 8), np.uint8)
        wide[:, :match] = view[starts[part]]
        covered[part] = family.add(np.ascontiguousarray(wide.view(">u8").T).astype(np.uint64), doc[part])
    return np.split(covered, ends[:-1])


# --- tasks --------------------------------------------------------------------

class Chunk:
    """The different texts of a chunk by rising doc_id, in pieces whose hashes
    fit into memory."""

    def __init__(self, table: pa.Table, match: int, gram: int):
        self.match, self.gram = match, gram
        best: dict[bytes, int] = {}
        shas, docs = table["sha"].to_pylist(), table["doc_id"].to_numpy()
        for k, sha in enumerate(shas):  # several tasks may have sent the same text
            if sha not in best or docs[k] < docs[best[sha]]:
                best[sha] = k
        rows = sorted(best.values(), key=lambda k: (docs[k], shas[k]))
        self.shas, self.docs, self.rows = [shas[k] for k in rows], docs[rows], rows
        self._bodies = table["body"]

    def pieces(self) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, Stretches]]:
        """(number of the first text, texts, bytes, ends, stretches)."""
        first, held, size = 0, [], 0
        for k, row in enumerate(self.rows):
            held.append(self._bodies[row].as_py())
            size += len(held[-1])
            if size >= PIECE_BYTES or k == len(self.rows) - 1:
                data = np.frombuffer(b"".join(held), np.uint8)
                ends = np.cumsum([len(b) for b in held])
                yield first, held, data, ends, stretches(data, ends, self.match, self.gram)
                first, held, size = k + 1, [], 0

    def anchors(self) -> np.ndarray:
        """The anchors' hashes, each once; the lowest bits have the logarithm of
        how many of the chunk's texts have it, rounded down."""
        found = [(s.anchor >> _LOG, s.text + first) for first, _, _, _, s in self.pieces()]
        if not found:
            return np.empty(0, np.uint64)
        key, text = np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])
        if not len(key):
            return key
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        new_key = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(new_key)
        texts = np.add.reduceat((new_key | np.r_[True, text[1:] != text[:-1]]).astype(np.int64), starts)
        return key[starts] << _LOG | np.minimum(np.log2(texts).astype(np.uint64), np.uint64(15))

    def shared(self, answer: np.ndarray) -> Iterator[tuple[int, list[bytes], np.ndarray, Stretches]]:
        """The pieces with only those stretches whose anchor is in ``answer``,
        (anchor, whether it is hot). A hot anchor's stretches come string by
        string, each with a hash of its own."""
        recurring, hot = answer >> np.uint64(1), (answer & np.uint64(1)) == 1
        for first, held, data, ends, s in self.pieces():
            key = s.anchor >> _LOG
            at = np.minimum(np.searchsorted(recurring, key), max(len(recurring) - 1, 0))
            keep = np.flatnonzero(recurring[at] == key) if len(recurring) else at[:0]
            key, each = key[keep], np.where(hot[at[keep]], s.last[keep] - s.first[keep] + 1, 1) if len(keep) else keep
            out = Stretches(s.first[keep], s.last[keep], s.text[keep], key)
            if each.sum() > len(keep):
                of = np.repeat(np.arange(len(keep)), each)
                place = out.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
                out = Stretches(place, np.where(hot[at[keep]][of], place, out.last[of]), out.text[of], key[of])
            single = np.flatnonzero(hot[at[keep]][np.repeat(np.arange(len(keep)), each)]) if len(keep) else keep
            for k in single.tolist():
                string = data[out.first[k]:out.first[k] + self.match].tobytes()
                out.anchor[k] = np.uint64(int.from_bytes(hashlib.blake2b(string, digest_size=7).digest(), "big"))
            yield first, held, ends, out

    def bodies(self, answer: np.ndarray) -> dict[bytes, tuple[int, int, int]]:
        """Each different stretch with its number, the doc_id of its first text, and its anchor."""
        out: dict[bytes, tuple[int, int, int]] = {}
        for first, held, ends, s in self.shared(answer):
            data, docs = b"".join(held), self.docs[first + s.text]
            for a, b, d, h in zip(s.first.tolist(), (s.last + self.match).tolist(), docs.tolist(), s.anchor.tolist()):
                out.setdefault(data[a:b], (len(out), d, h))
        return out


def _u64(blobs: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(b for b in blobs.to_pylist() if b), np.uint64)


def _send_texts(chunks: int):
    """Rows (chunk, sha, doc_id, body): each text once for each task that has it
    (or so: a task remembers ``HELD_TEXTS``), with the smallest doc_id so far."""
    schema = pa.schema([("chunk", pa.int32()), ("sha", pa.binary()), ("doc_id", pa.int64()), ("body", pa.large_binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            rows, size = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                body = (text.as_py() or "").encode()
                sha = hashlib.sha256(body).digest()
                if seen.get(sha, NO_ID + 1) <= doc:
                    continue
                if len(seen) >= HELD_TEXTS:
                    seen.clear()
                again, seen[sha] = sha in seen, doc
                # of a text that was sent before, only the smaller doc_id
                rows.append((int.from_bytes(sha[:8], "big") % chunks, sha, doc, None if again else body))
                size += 0 if again else len(body)
                if size >= PIECE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return send


def _with_bodies(table: pa.Table) -> pa.Table:
    """The rows of a chunk with the smallest doc_id of each text, and its body."""
    shas, docs, bodies = table["sha"].to_pylist(), table["doc_id"].to_numpy().copy(), table["body"]
    has = np.flatnonzero(bodies.is_valid().to_numpy(zero_copy_only=False))
    at = {shas[k]: k for k in has}
    for k, sha in enumerate(shas):
        docs[at[sha]] = min(docs[at[sha]], docs[k])
    keep = pa.array(sorted(at.values()), pa.int64())
    return pa.table({"sha": table["sha"], "doc_id": pa.array(docs), "body": bodies}).take(keep)


def text_results(own: DataFrame, match: int = MATCH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, batch: int = BATCH,
                 hot_texts: int = HOT_TEXTS) -> DataFrame:
    """(sha, first, n_removed, n_spans, kept_sha256) for each different text of
    (doc_id, text), doc_id without nulls: the smallest doc_id that has the text,
    and what that document loses to smaller ones."""
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(8, math.ceil(total / chunk_bytes))
    # read three times, but shuffled once: the plan reuses the exchange
    texts = (own.mapInArrow(_send_texts(chunks), "chunk int, sha binary, doc_id bigint, body binary")
             .repartition(chunks, "chunk"))

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk, found = key[0].as_py(), Chunk(_with_bodies(table), match, gram).anchors()
        rows = [(s, chunk, found[at].tobytes()) for s, at in by_shard(found >> _LOG, chunks)]
        s, c, keys = zip(*rows) if rows else ((), (), ())
        return pa.table({"shard": pa.array(s, pa.int32()), "chunk": pa.array(c, pa.int32()), "keys": pa.array(keys, pa.binary())})

    def recurring(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, np.uint64) for b in table["keys"].to_pylist()]
        every = np.concatenate(blobs)
        order = np.argsort(every, kind="stable")
        key, texts = every[order] >> _LOG, np.int64(1) << (every[order] & np.uint64(15)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.add.reduceat(texts, starts)
        several = key[starts][total > 1]
        is_hot = (total[total > 1] >= hot_texts).astype(np.uint64)

        def answer(blob: np.ndarray) -> bytes:
            own = blob >> _LOG
            at = np.minimum(np.searchsorted(several, own), max(len(several) - 1, 0))
            found = np.flatnonzero(several[at] == own) if len(several) else at[:0]
            return (own[found] << np.uint64(1) | is_hot[at[found]]).tobytes()

        return pa.table({"chunk": table["chunk"], "keys": pa.array(map(answer, blobs), pa.binary())})

    sent = texts.groupBy("chunk").applyInArrow(anchors, "shard int, chunk int, keys binary")
    hot = sent.groupBy("shard").applyInArrow(recurring, "chunk int, keys binary").where(F.octet_length("keys") > 0)

    def bodies(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["shard", "chunk", "number", "doc_id", "body"]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        rows = []
        if left.num_rows and right.num_rows:
            found = Chunk(_with_bodies(left), match, gram).bodies(np.unique(_u64(right["keys"])))
            own_bodies, facts = list(found), np.array(list(found.values()), np.int64).reshape(-1, 3)
            for s, at in by_shard(facts[:, 2].astype(np.uint64), chunks):
                mine = [own_bodies[k] for k in at]
                sizes = np.array([len(b) for b in mine], np.int64)
                rows.append((s, key[0].as_py(), np.stack([facts[at, 0], sizes]).tobytes(), facts[at, 1].tobytes(), b"".join(mine)))
        cols = list(zip(*rows)) if rows else [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types)})

    def scan(table: pa.Table) -> pa.Table:
        firsts: dict[bytes, int] = {}
        parts = []
        for numbers, ids, body in zip(table["number"].to_pylist(), table["doc_id"].to_pylist(), table["body"].to_pylist()):
            number, sizes = np.frombuffer(numbers, np.int64).reshape(2, -1)
            docs, ends = np.frombuffer(ids, np.int64), np.cumsum(sizes).tolist()
            mine = [body[e - s:e] for e, s in zip(ends, sizes.tolist())]
            parts.append((number, docs, mine))
            for b, d in zip(mine, docs.tolist()):
                if d < firsts.get(b, NO_ID + 1):
                    firsts[b] = d
        every = sorted(firsts.items(), key=lambda x: (x[1], x[0]))
        found = covered_strings([b for b, _ in every], np.array([d for _, d in every], np.int64), match, batch)
        packed = {b: int.from_bytes(np.packbits(f, bitorder="little").tobytes(), "little") for (b, _), f in zip(every, found)}
        masks = []
        for number, docs, mine in parts:
            # a body that a smaller doc_id has too is covered whole
            bits = [packed[b] if firsts[b] == d else (1 << len(b) - match + 1) - 1 for b, d in zip(mine, docs.tolist())]
            masks.append(np.stack([number.astype(np.uint64), np.array(bits, np.uint64)]).tobytes())
        return pa.table({"chunk": table["chunk"], "masks": pa.array(masks, pa.binary())})

    stretched = (texts.groupBy("chunk").cogroup(hot.groupBy("chunk"))
                 .applyInArrow(bodies, "shard int, chunk int, number binary, doc_id binary, body binary"))
    masks = stretched.groupBy("shard").applyInArrow(scan, "chunk int, masks binary")
    answers = hot.select("chunk", "keys", F.lit(None).cast("binary").alias("masks")).unionByName(
        masks.select("chunk", F.lit(None).cast("binary").alias("keys"), "masks"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _RESULT})
        chunk = Chunk(_with_bodies(left), match, gram)
        answer = np.unique(_u64(right["keys"]))
        mask: dict[int, int] = {}
        for blob in right["masks"].to_pylist():
            if blob:
                number, bits = np.frombuffer(blob, np.uint64).reshape(2, -1).tolist()
                mask.update(zip(number, bits))
        known: dict[bytes, tuple[int, int]] = {}
        out = []
        for first, held, ends, s in chunk.shared(answer):
            data, docs = b"".join(held), chunk.docs[first + s.text]
            change = np.zeros(len(data) + 1, np.int32)
            for a, last, d in zip(s.first.tolist(), s.last.tolist(), docs.tolist()):
                number, since = known.setdefault(data[a:last + match], (len(known), d))
                bits = mask[number] if since == d else (1 << last - a + 1) - 1
                while bits:
                    low = bits & -bits
                    run = (bits // low) ^ (bits // low + 1)  # the lowest ones in a row
                    length = run.bit_length() - 1
                    at = a + low.bit_length() - 1
                    change[at] += 1
                    change[at + length - 1 + match] -= 1
                    bits &= ~(((1 << length) - 1) * low)
            gone = np.cumsum(change[:-1]) > 0
            raw = np.frombuffer(data, np.uint8)
            for k, (body, end) in enumerate(zip(held, ends.tolist())):
                lost = gone[end - len(body):end]
                n = int(lost.sum())
                spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if n else 0
                kept = hashlib.sha256(raw[end - len(body):end][~lost].tobytes()).hexdigest() if n else chunk.shas[first + k].hex()
                out.append((chunk.shas[first + k], int(chunk.docs[first + k]), n, spans, kept))
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_RESULT, zip(*out))})

    return (texts.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(cut, "sha binary, first bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))


_RESULT = pa.schema([("sha", pa.binary()), ("first", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, batch: int = BATCH,
                   hot_texts: int = HOT_TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, after every byte is gone that lies in a string of ``match``
    bytes which a document with a smaller doc_id has too.

    ``match`` may be ``gram`` + 63 at most. Strings are judged on the texts as
    given and never cross documents; a string that only the document itself
    repeats stays. A null text counts as empty; a null doc_id is larger than any
    other, and rows of one doc_id (or without) don't take from each other;
    copies of a text lose all of it, if it has ``match`` bytes, to the smallest
    doc_id that has it; an empty table gives no rows; other columns are ignored.
    """
    if not 1 <= gram <= match < gram + 64:
        raise ValueError("a match has from 0 to 63 bytes more than a gram")
    own = id_and_text(docs, id_col, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    filled = own.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text.alias("text"))
    rows = own.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha"))
    found = text_results(filled, match, gram, chunk_bytes, batch, hot_texts)
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("first")) & (F.col("n_bytes") >= match)
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.join(found, "sha").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("bigint").alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without what a smaller doc_id has in 50 bytes or more."""
    return remove_repeats(documents(spark, sf_dir))
