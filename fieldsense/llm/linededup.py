"""Line dedup by a tree of log templates.

A line's fields that hold digits, addresses or links become ``<*>``. The tree's
first level is the number of tokens, the next ones the leading tokens; in a
leaf, lines that agree in enough of the places after these share a template,
whose other places become ``<*>`` too. A template that recurs across documents stays in the first
of them (by id) and is dropped from the others."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import documents, id_and_text, in_batches

FIELD = b"<*>"
#: Leading tokens that lead to a leaf, share of equal places in a template,
#: and the fewest tokens of a line that can be dropped.
DEPTH, SIMILARITY, MIN_TOKENS = 3, 0.7, 2
#: Templates of a leaf up to which a line is compared with each; from there on
#: an index finds those in reach, the same ones.
LEAF_LINES = 24
#: Where documents with a null id stand: after all others.
_NO_ID = (1 << 63) - 1
_WORDS = 1 << 20  # of 64 bits, in the map of leaves that lie in several documents
_DIGITS, _SPACE = b"0123456789", " \t\n\x0b\x0c\r"


def masked(line: bytes) -> list[bytes]:
    """The line's tokens, variable fields as ``<*>``."""
    tokens = line.split()
    if b"@" in line or b"://" in line:
        tokens = [FIELD if b"@" in t or b"://" in t else t for t in tokens]
    if len(line.translate(None, _DIGITS)) < len(line):
        tokens = [FIELD if len(t.translate(None, _DIGITS)) < len(t) else t for t in tokens]
    return tokens


def leaf_of(tokens: list[bytes], depth: int) -> int:
    """The leaf as a signed hash of the number of tokens and the leading ones."""
    h = xxhash.xxh64_intdigest(b"%d %b" % (len(tokens), b" ".join(tokens[:depth])))
    return h - (h >> 63 << 64)


def _line_hash(line: bytes) -> int:
    """Of a masked line."""
    h = xxhash.xxh64_intdigest(line, 1)
    return h - (h >> 63 << 64)


def lines_of(text: str | None, depth: int, min_tokens: int, leaves: np.ndarray | None = None) -> dict[bytes, int]:
    """The leaves of the masked lines, each line once; with ``leaves``, a bit
    map, only the lines of those."""
    out = {}
    for line in set((text or "").encode().split(b"\n")):
        tokens = masked(line)
        if len(tokens) >= min_tokens:
            leaf = leaf_of(tokens, depth)
            if leaves is None or int(leaves[leaf & _WORDS - 1]) >> (leaf >> 20 & 63) & 1:
                out[b" ".join(tokens)] = leaf
    return out


class Templates:
    """The templates of one leaf, to which its lines are added in their order."""

    def __init__(self, similarity: float, depth: int = DEPTH, scanned: int = LEAF_LINES):
        self.similarity, self.depth, self.scanned = similarity, depth, scanned
        self.known: list[list[bytes]] = []
        self.at: dict[tuple[int, bytes], set[int]] | None = None  # (place, token): templates

    def add(self, tokens: list[bytes]) -> int:
        """The number of the template that the line joins: the one with the
        most equal places after the leading ones (the first of equals) if they
        are a share of ``similarity`` or more of those places, else a new one."""
        places = len(tokens) - self.depth
        need = max(0, math.ceil(self.similarity * places))
        most, best = -1, -1
        tail = tokens[self.depth:]
        for k in self._in_reach(tokens, need):
            same = sum(map(eq, self.known[k][self.depth:], tail))
            if same > most:
                most, best = same, k
        if best < 0 or most < need:
            best = len(self.known)
            self.known.append(tokens)
            if self.at is not None:
                self._index(best)
        elif most < places:
            self._merge(best, tokens)
        return best

    def _in_reach(self, tokens: list[bytes], need: int) -> Iterable[int]:
        """In their order, at least all templates with ``need`` equal places:
        of any ``places - need + 1`` places, such a one equals the line in one."""
        if need == 0 or len(self.known) <= self.scanned:
            return range(len(self.known))
        if self.at is None:
            self.at = {}
            for k in range(len(self.known)):
                self._index(k)
        of = sorted((self.at.get(x, ()) for x in enumerate(tokens[self.depth:])), key=len)
        return sorted(set().union(*of[:len(of) - need + 1]))

    def _index(self, k: int) -> None:
        for x in enumerate(self.known[k][self.depth:]):
            self.at.setdefault(x, set()).add(k)

    def _merge(self, k: int, tokens: list[bytes]) -> None:
        old = self.known[k]
        self.known[k] = [a if a == b else FIELD for a, b in zip(old, tokens)]
        if self.at is not None:
            for x, now in zip(enumerate(old[self.depth:]), self.known[k][self.depth:]):
                if now != x[1]:
                    self.at[x].discard(k)
                    self.at.setdefault((x[0], now), set()).add(k)


def templates(lines: list[list[bytes]], similarity: float, depth: int = DEPTH, scanned: int = LEAF_LINES) -> list[int]:
    """For the lines of a leaf in their order, the number of the template that
    each joins. A place where a line differs from its template becomes
    ``<*>``, which equals nothing else."""
    own = Templates(similarity, depth, scanned)
    return [own.add(tokens) for tokens in lines]


def _shared_leaves(docs: DataFrame, depth: int, min_tokens: int) -> np.ndarray:
    """A bit map, of 8 MB at any size of the input, of the hashes of leaves that
    lie in two or more documents (doc, text); others may be marked, none is missed."""
    schema = pa.schema([("doc", pa.int64()), ("leaf", pa.int64())])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), leaf) for b in batches for i, t in zip(b.column(0), b.column(1))
                for leaf in set(lines_of(t.as_py(), depth, min_tokens).values()))
        return in_batches(rows, schema)

    shared = (docs.select("doc", "text").mapInArrow(leaves, "doc bigint, leaf bigint").groupBy("leaf")
              .agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(leaf, 20) & 63 as int))")
    found = shared.groupBy(F.col("leaf").bitwiseAND(F.lit(_WORDS - 1)).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(_WORDS, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits


def recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS,
                    leaf_lines: int = LEAF_LINES) -> DataFrame:
    """(doc, line): hashes of the masked lines of (doc_id, doc, text) whose
    template occurs in an earlier document. ``doc`` tells documents apart,
    ``doc_id`` is their order, and of equal ones ``doc``."""
    bits = docs.sparkSession.sparkContext.broadcast(_shared_leaves(docs, depth, min_tokens))
    schema = pa.schema([("leaf", pa.int64()), ("line", pa.int64()), ("doc_id", pa.int64()), ("doc", pa.int64()), ("tokens", pa.binary())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        rows = ((leaf, _line_hash(line), i.as_py(), d.as_py(), line) for b in batches for i, d, t in zip(*b.columns)
                for line, leaf in lines_of(t.as_py(), depth, min_tokens, known).items())
        return in_batches(rows, schema, lambda r: len(r[4]))

    lines = cut_lineage(docs.select("doc_id", "doc", "text").mapInArrow(
        candidates, "leaf bigint, line bigint, doc_id bigint, doc bigint, tokens binary"))
    only = F.when(F.min("doc") == F.max("doc"), F.min("doc"))  # null if there are several
    variants = lines.groupBy("leaf", "line", "tokens").agg(F.min("doc_id").alias("first"), only.alias("only"))

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(v.as_py() for v in x) for b in batches for x in zip(*b.columns))
        return in_batches(_recurring(rows, similarity, depth, leaf_lines),
                          pa.schema([("line", pa.int64()), ("first", pa.int64()), ("template", pa.int64())]))

    found = (variants.select("leaf", "line", "first", "only", "tokens")
             .repartition("leaf").sortWithinPartitions("leaf", "first", "tokens")
             .mapInArrow(cluster, "line bigint, first bigint, template bigint"))
    # ids that several documents share; a template that begins at one of them stays in one of its documents
    shared = cut_lineage(docs.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("doc_id"))
    if shared.isEmpty():
        return lines.select("line", "doc_id", "doc").join(found, "line").where("doc_id <> first").select("doc", "line")
    found = cut_lineage(found)
    of = lines.select("line", "doc_id", "doc").join(found, "line")
    unsure = found.join(shared, found["first"] == shared["doc_id"], "left_semi")
    firsts = (lines.select("line", "doc_id", "doc").join(unsure, "line").where("doc_id = first")
              .groupBy("template").agg(F.min("doc").alias("stays")))
    return of.join(firsts, "template", "left").where("doc_id <> first or doc <> stays").select("doc", "line")


def _recurring(rows: Iterator[tuple], similarity: float, depth: int, scanned: int) -> Iterator[tuple[int, int, int]]:
    """From sorted (leaf, line, first, only, tokens): the lines whose template
    lies in several documents, with the least id of these and the template,
    known by the hash of its first line. Of a leaf, its templates and two
    numbers for each line are held, whatever the length of the lines."""
    for _, group in groupby(rows, key=lambda r: r[0]):
        own, of, lines = Templates(similarity, depth, scanned), array("q"), array("q")
        first, only, name = [], [], array("q")
        for _, line, i, doc, tokens in group:
            k = own.add(tokens.split(b" "))
            if k == len(first):
                first.append(i)
                only.append(doc)
                name.append(line)
            elif only[k] != doc:
                only[k] = None
            first[k] = min(first[k], i)
            of.append(k)
            lines.append(line)
        for k, line in zip(of, lines):
            if only[k] is None:
                yield line, first[k], name[k]


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """The columns of ``docs``, the text without the dropped lines, and
    ``__lines``, ``__dropped``: the number of lines that have a token, before,
    and of those dropped.

    A null text stays null and has no lines; a document that loses all its
    lines has the empty text; rows of one id and text are one document, and
    each loses the same lines; rows of one id and different texts are
    documents of their own, in the order of a hash; null ids come last; an
    empty table gives no rows. Lines without a token and those under the least
    number of tokens stay.
    """
    own = F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    lines = id_and_text(docs, id_col, text_col)
    lines = lines.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc"), "text")
    drops = recurring_lines(lines, **tree).groupBy("doc").agg(F.collect_set("line").alias("__drops"))
    rows = docs.withColumn("__id", own).join(drops.withColumnRenamed("doc", "__doc"), F.col("__id") == F.col("__doc"), "left")
    rows = rows.select(*docs.columns, "__drops")
    fields = [*docs.schema.fields]
    ddl = rows.drop("__drops").schema.add("__lines", "long").add("__dropped", "long")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, counts, dropped = b.schema.get_field_index(text_col), [], [], []
            for t, d in zip(b.column(at), b.column(b.num_columns - 1)):
                kept, n, gone = _without(t.as_py(), set(d.as_py() or ()))
                texts.append(kept)
                counts.append(n)
                dropped.append(gone)
            columns = [pa.array(texts, b.schema.field(k).type) if k == at else b.column(k) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                                             names=[*(f.name for f in fields), "__lines", "__dropped"])

    return rows.mapInArrow(clean, ddl)


def _without(text: str | None, drops: set[int]) -> tuple[str | None, int, int]:
    """The text without the lines of ``drops``, its lines with a token, and those dropped."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    gone = [bool(drops) and bool(t := masked(line.encode())) and _line_hash(b" ".join(t)) in drops for line in lines]
    n = sum(bool(line.strip(_SPACE)) for line in lines)
    return "\n".join([line for line, x in zip(lines, gone) if not x]) if any(gone) else text, n, sum(gone)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's text without the lines whose template an earlier document has."""
    out = drop_recurring(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), "text")
