"""SentencePiece BPE with seeded merge-dropout, and its exact decoding.

Merges are taken from an agenda, best score first and leftmost of equals. A
candidate that comes up is skipped when a hash of the seed, the document's id, the
copy's number, the chunk's place in the text, the place in the chunk and the merged
piece falls under the dropout rate. So a word has other segmentations at other places,
in other documents and in other copies, the same on every run.

No merge can cross a border between a character and a following space, nor a
line end, so a text is segmented in such chunks. A process keeps, up to a bound, what
the agenda of a chunk does when nothing is skipped; where the hash skips
none of those merges, this is the segmentation, else the agenda runs anew."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_CHARS, BATCH_ROWS, documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_MASK = (1 << 64) - 1
#: Chunks that a process keeps, and their length at most.
KEPT_CHUNKS, KEPT_CHARS = 300_000, 64
#: Chunks of a text that are worked out together.
TOGETHER = 1 << 16


class PieceModel:
    """The pieces of a byte-fallback BPE model that changes no character."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec, trainer = m.normalizer_spec, m.trainer_spec
        if (trainer.model_type != trainer.BPE or not trainer.byte_fallback or spec.remove_extra_whitespaces
                or spec.precompiled_charsmap or not spec.escape_whitespaces or not spec.add_dummy_prefix):
            raise ValueError(f"{path} is no byte-fallback BPE model that keeps its text")
        kinds = m.SentencePiece
        normal = [(p.piece, i) for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL]
        self.ids = dict(normal)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids) or len(self.bytes) != 256:
            raise ValueError(f"{path} has pieces that cross a word or line border")
        order = sorted((i for _, i in normal), key=lambda i: (-m.pieces[i].score, i))
        self.rank = {i: k for k, i in enumerate(order)}
        # what an id stands for; control pieces stand for nothing
        self.text = [p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in m.pieces]
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])
        self.sizes = np.array([len(t) for t in self.text], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all_text = np.frombuffer(b"".join(self.text), np.uint8)

    def of_symbol(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        return [i] if i is not None else [self.bytes[b] for b in symbol.encode()]


@cache
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start:start + size]`` of each, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Dropout:
    """Decides on a candidate merge by hash alone."""

    def __init__(self, rate: float, seed: int):
        if not 0 <= rate <= 1:
            raise ValueError("the dropout rate lies between 0 and 1")
        self.limit, self.seed = int(rate * (1 << 32)), seed & _MASK

    def key(self, doc_id: int | None, copy: int | None = 0) -> int:
        return xxhash.xxh64_intdigest(f"{doc_id}:{copy or 0}".encode(), self.seed)

    def bases(self, key: int, first: int, n: int) -> np.ndarray:
        """The hash bases of ``n`` chunks in a row."""
        h = np.uint64(key) ^ np.arange(first, first + n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def skips(self, base: int, place: int, piece: int) -> bool:
        h = (base ^ (place * 0x9E3779B97F4A7C15 + piece * 0xC2B2AE3D27D4EB4F)) & _MASK
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & _MASK
        return h >> 32 < self.limit

    def skip_all(self, base: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        h = base ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h >> np.uint64(32) < np.uint64(self.limit)


def segment(model: PieceModel, chunk: str, dropout: Dropout | None = None, base: int = 0) -> list[str]:
    """The chunk's symbols when the agenda is empty. A skipped candidate is
    gone until one of its symbols changes."""
    ids, rank = model.ids, model.rank
    symbols, n = list(chunk), len(chunk)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, str]] = []

    def propose(left: int, right: int) -> None:
        if left >= 0 and right < n and (i := ids.get(merged := symbols[left] + symbols[right])) is not None:
            heapq.heappush(agenda, (rank[i], left, right, merged))

    for k in range(n - 1):
        propose(k, k + 1)
    dropout = dropout if dropout and dropout.limit else None
    while agenda:
        _, left, right, merged = heapq.heappop(agenda)
        if not symbols[left] or not symbols[right] or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(merged):
            continue  # one of the two has changed since
        if dropout and dropout.skips(base, left, ids[merged]):
            continue
        symbols[left], symbols[right] = merged, ""
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
        propose(before[left], left)
        propose(left, after[left])
    return [s for s in symbols if s]


class Agendas:
    """The agendas of many short chunks at once, one step of each in a round:
    arrays hold the symbols of all chunks that still have candidates."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, i in model.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        pairs = {(a, b): i for piece, i in model.ids.items() for k in range(1, len(piece))
                 if (a := model.ids.get(piece[:k])) is not None and (b := model.ids.get(piece[k:])) is not None}
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.none = len(model.text)
        self.ranks = np.array([model.rank[i] for i in pairs.values()], np.int32)[order]
        self.by_rank = np.array(sorted(model.rank, key=model.rank.get), np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def run(self, chunks: list[str], dropout: Dropout, base: np.ndarray,
            merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has; chunks have
        at most ``KEPT_CHARS`` characters. Each round's merges go to ``merges`` as
        (chunk, place, piece)."""
        sym = self.symbol[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        own = np.repeat(np.arange(len(chunks)), sizes)
        place = np.arange(len(sym)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rank = np.full(len(sym), self.none, np.int32)
        inner = np.flatnonzero(own[1:] == own[:-1])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            if (ended := best == self.none).any():
                done.append((own[ended], sym[ended]))
                on = ~ended
                sym, own, place, rank, best = sym[on], own[on], place[on], rank[on], best[on]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.r_[True, own[at][1:] != own[at][:-1]]]  # the leftmost of equals
            piece = self.by_rank[rank[at]]
            if dropout.limit:
                skip = dropout.skip_all(base[own[at]], place[at], piece)
                rank[at[skip]] = self.none
                at, piece = at[~skip], piece[~skip]
            if merges is not None:
                merges.append((own[at], place[at], piece))
            sym[at] = piece
            on = np.ones(len(sym), bool)
            on[at + 1] = False
            sym, own, place, rank = sym[on], own[on], place[on], rank[on]
            at = at - np.arange(len(at))  # as many symbols have gone before as merges
            rank[at] = self.none
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(sym)]
                left = left[own[left] == own[left + 1]]
                rank[left] = self.rank(sym[left], sym[left + 1])
        own, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(own, kind="stable")
        own, ids = own[order], ids[order]
        sizes = np.bincount(own, minlength=len(chunks))
        odd = np.unique(own[ids < 0])  # they have characters that no piece is
        if len(odd):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for k in odd.tolist():
                parts[k] = ids_of(self.model, chunks[k], dropout, int(base[k]))
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids.astype(np.int32), sizes


def ids_of(model: PieceModel, chunk: str, dropout: Dropout | None = None, base: int = 0) -> np.ndarray:
    out = array("i")
    for s in segment(model, chunk, dropout, base):
        out.extend(model.of_symbol(s))
    return np.frombuffer(out, np.int32) if out else np.empty(0, np.int32)


class Ragged:
    """Runs of numbers, one after the other."""

    def __init__(self, *types):
        self.values = [np.empty(0, t) for t in types]
        self.starts = self.sizes = np.empty(0, np.int64)

    def add(self, sizes: np.ndarray, *values: np.ndarray) -> None:
        self.starts = np.r_[self.starts, len(self.values[0]) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.values = [np.r_[a, b.astype(a.dtype)] for a, b in zip(self.values, values, strict=True)]


class Chunks:
    """What the agendas of chunks do without dropout: their ids, and their
    merges by place and piece."""

    def __init__(self, agendas: Agendas, most: int):
        self.agendas, self.most, self.plain = agendas, most, Dropout(0.0, 0)
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.merges = Ragged(np.int32), Ragged(np.uint8, np.int32)

    def slots_of(self, chunks: list[str]) -> np.ndarray:
        """The slot of each chunk; chunks have at most ``KEPT_CHARS`` characters."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.slots]
        if len(self.slots) + len(new) > self.most:
            self.clear()
            new = list(dict.fromkeys(chunks))
        if new:
            done: list = []
            ids, sizes = self.agendas.run([c.replace(" ", SPACE) for c in new], self.plain, np.zeros(len(new), np.uint64), done)
            own, place, piece = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 3
            order = np.argsort(own, kind="stable")
            self.ids.add(sizes, ids)
            self.merges.add(np.bincount(own, minlength=len(new)), place[order], piece[order])
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
        return np.fromiter(map(self.slots.__getitem__, chunks), np.int64, len(chunks))


_CHUNK = re.compile(f" *[^ \n{SPACE}]+| +|\n|{SPACE}")


class Encoder:
    """Texts to ids by one model, rate and seed."""

    def __init__(self, model: PieceModel, rate: float = 0.1, seed: int = 0):
        self.model, self.dropout = model, Dropout(rate, seed)
        self.agendas = Agendas(model)
        self.chunks = Chunks(self.agendas, KEPT_CHUNKS)
        self.sign = np.array([model.bytes[b] for b in SPACE.encode()], np.int32)

    def encode(self, text: str | None, key: int = 0) -> np.ndarray:
        """Ids as int32; none for a null or empty text. A space sign that the
        text itself has is written as bytes, so that it isn't taken for a space."""
        return self.encode_all([text], [key])[0]

    def encode_all(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
        """The texts of a batch, each with the key of its dropout (``Dropout.key``);
        their chunks are worked out together."""
        parts, bases, held, out, sizes = [], [], 0, [], []
        split = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        for chunks, key in zip(split, keys, strict=True):
            sizes.append([])
            for at in range(0, len(chunks), TOGETHER):
                part = chunks[at:at + TOGETHER]
                parts.append((len(sizes) - 1, part))
                bases.append(self.dropout.bases(key, at, len(part)))
                held += len(part)
                if held >= TOGETHER:
                    out += self._together(parts, bases)
                    parts, bases, held = [], [], 0
        out += self._together(parts, bases)
        for k, ids in out:
            sizes[k].append(ids)
        none = np.empty(0, np.int32)
        return [own[0] if len(own) == 1 else np.concatenate(own) if own else none for own in sizes]

    def _together(self, parts: list[tuple[int, list[str]]], bases: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
        """(text, ids) of each part."""
        if not parts:
            return []
        chunks, base = [c for _, part in parts for c in part], np.concatenate(bases)
        alone = [k for k, c in enumerate(chunks) if len(c) > KEPT_CHARS or c == SPACE]
        apart = {k: self.sign if chunks[k] == SPACE else
                 ids_of(self.model, chunks[k].replace(" ", SPACE), self.dropout, int(base[k])) for k in alone}
        usual = np.ones(len(chunks), bool)
        usual[alone] = False
        usual = np.flatnonzero(usual)
        slots = self.chunks.slots_of([chunks[k] for k in usual.tolist()] if alone else chunks)
        kept, merges = self.chunks.ids, self.chunks.merges
        pool, starts, sizes = [kept.values[0]], np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        starts[usual], sizes[usual] = kept.starts[slots], kept.sizes[slots]
        held = len(pool[0])
        if self.dropout.limit:
            n, first = merges.sizes[slots], merges.starts[slots]
            skip = self.dropout.skip_all(np.repeat(base[usual], n), *(gather(v, first, n) for v in merges.values))
            anew = usual[np.unique(np.repeat(np.arange(len(usual)), n)[skip])]
            if len(anew):
                ids, m = self.agendas.run([chunks[k].replace(" ", SPACE) for k in anew.tolist()], self.dropout, base[anew])
                starts[anew], sizes[anew] = held + np.cumsum(m) - m, m
                pool.append(ids)
                held += len(ids)
        for k, ids in apart.items():
            starts[k], sizes[k] = held, len(ids)
            pool.append(ids)
            held += len(ids)
        ids, ends = gather(np.concatenate(pool), starts, sizes), np.r_[0, np.cumsum(sizes)]
        cuts = ends[np.cumsum([0, *(len(part) for _, part in parts)])].tolist()
        return [(k, ids[a:b]) for (k, _), a, b in zip(parts, cuts, cuts[1:])]


def decode(model: PieceModel, ids: Sequence[int] | np.ndarray) -> str:
    """The text; the space put before it on encoding goes."""
    ids = np.asarray(ids, np.int64)
    data = gather(model.all_text, model.starts[ids], model.sizes[ids]).tobytes()
    return data.removeprefix(b" ").decode("utf-8", "replace")


@cache
def encoder_at(path: str, rate: float, seed: int) -> Encoder:
    return Encoder(model_at(path), rate, seed)


def encode_documents(docs: DataFrame, model: str = MODEL, rate: float = 0.1, seed: int = 0,
                     id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None,
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, copy, n_tokens, ids, and
    whether decoding the ids gave back the text, and the columns ``carry``.

    ``model`` is a path that every executor can read. ``copy_col`` has the
    number of a document's copy (else, or null, 0); copies of a document get
    segmentations of their own. A null text gives no ids, like an empty one, and
    decodes to the empty text; a null id is an id like others; repeated rows
    give equal rows; an empty table gives none; other columns are ignored. One
    pass over the rows, no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("n_tokens", pa.int64()),
                        ("ids", pa.list_(pa.int32())), ("lossless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder_at(model, rate, seed)
        for b in _pieces_of(batches):
            doc_ids, texts, copies = (b.column(k).to_pylist() for k in range(3))
            all_ids = own.encode_all(texts, list(map(own.dropout.key, doc_ids, copies)))
            out = [(i, c, ids, decode(own.model, ids) == (t or "")) for i, t, c, ids in zip(doc_ids, texts, copies, all_ids)]
            packed = pack(out)
            yield pa.RecordBatch.from_arrays([*packed.columns, *b.columns[3:]], names=[*schema.names, *b.schema.names[3:]])

    def pack(held: list) -> pa.RecordBatch:
        doc_ids, vs, ids, same = zip(*held, strict=True)
        sizes = [len(x) for x in ids]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(vs, pa.int32()), pa.array(sizes, pa.int64()),
                                           lists, pa.array(same, pa.bool_())], schema=schema)

    copy = F.coalesce(F.col(copy_col).cast("int"), F.lit(0)) if copy_col else F.lit(0)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      copy.alias("__copy"), *carry)
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return own.mapInArrow(run, f"doc_id bigint, copy int, n_tokens bigint, ids array<int>, lossless boolean{extra}")


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``BATCH_ROWS`` rows and about ``BATCH_CHARS`` bytes of text (column 1)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + BATCH_CHARS, side="left")) + 1
            to = min(max(to, at + 1), at + BATCH_ROWS, b.num_rows)
            yield b.slice(at, to - at)
            at = to


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_at(model)
        for b in batches:
            out = [decode(own, ids.as_py() or ()) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The ids of all documents, at a dropout of 0.1."""
    return encode_documents(documents(spark, sf_dir))
