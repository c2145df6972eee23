"""SimHash near-duplicates by anchor-point covering.

Of three blocks of a 64-bit fingerprint, two fingerprints that differ in at
most four bits have one with at most one difference. Anchors of a block are
the words of the binary Golay code: every 23-bit word has exactly one anchor
at distance three or less, its home. A fingerprint is sent to every anchor at
distance four or less (covering radius and the block's threshold), so it meets
each fingerprint that differs in one bit of the block at that one's home, where
whole fingerprints are compared. Anchors can also be made of two blocks, which
differ in at most two bits together; they are many more and their groups smaller,
for very many fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import documents, id_and_text, texts

SEED = 42
#: First bit and length of the blocks; each is filled up to 23 bits with zeros.
BLOCKS = ((0, 22), (22, 21), (43, 21))
_N, _RADIUS = 23, 3
#: Fingerprints up to which comparing at anchors of one block costs less than sending more rows.
ONE_BLOCK = 50_000_000
#: Generator polynomial of the Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
_POLYNOMIAL = 0b110001110101


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of the text's word shingles as an unsigned number; 0 for a
    text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(words))
    starts, ends, n = (ends - sizes)[: len(words) - k + 1], ends[k - 1:], len(words) - k + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text's shingles in parts
        part = zip(starts[at:at + (1 << 16)].tolist(), ends[at:at + (1 << 16)].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), fp the fingerprint's bits as a signed long."""
    return _with_fingerprint(id_and_text(docs, id_col, text_col), shingle)


def _with_fingerprint(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` with fp in place of the text; their other columns are bigints."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (fingerprint(t, shingle) for t in texts(b))
            fps = pa.array([fp - (fp >> 63 << 64) for fp in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), fps], names=[*names, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "fp"]))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    r = words.astype(np.int64)
    for bit in range(_N - 1, 10, -1):
        r = np.where(r >> bit & 1, r ^ (_POLYNOMIAL << (bit - 11)), r)
    return r


@cache
def _errors(excess: int) -> np.ndarray:
    """By syndrome: the errors that lead from a word to the anchors whose
    distance is at most the radius (``excess`` 0: one, which leads home) or
    the radius and ``excess``; rows are filled up with -1."""
    weights = range(_RADIUS + 1) if excess == 0 else (_RADIUS + excess,)
    errors = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(_N), w)], np.int64)
    s = _syndromes(errors)
    order = np.argsort(s, kind="stable")
    place = np.arange(len(s)) - np.searchsorted(s[order], s[order])
    out = np.full((2048, place.max() + 1), -1, np.int64)
    out[s[order], place] = errors[order]
    return out


def anchors(fps: np.ndarray, bits: int = 4, blocks: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into ``fps``, anchor, whether it is the home). An anchor is
    a code word in each of ``blocks`` of the three blocks; of some choice of
    them, two fingerprints in reach differ in ``bits * blocks // 3`` bits at
    most, which the excesses over the radius share."""
    reach, near = bits * blocks // len(BLOCKS), []
    for first, length in BLOCKS:
        word = (fps.view(np.uint64) >> np.uint64(first) & np.uint64((1 << length) - 1)).astype(np.int64)
        s = _syndromes(word)
        # a code word is known by its upper twelve bits
        near.append([np.where((e := _errors(x)[s]) >= 0, (word[:, None] ^ e) >> 11, -1) for x in range(reach + 1)])
    at, to, own = [], [], []
    for k, chosen in enumerate(combinations(range(len(BLOCKS)), blocks)):
        for share in product(range(reach + 1), repeat=blocks):
            if sum(share) > reach:
                continue
            anchor = np.full((len(fps), 1), k, np.int64)
            for block, x in zip(chosen, share):
                part = near[block][x]
                anchor = np.where((anchor[:, :, None] >= 0) & (part[:, None, :] >= 0),
                                  anchor[:, :, None] << 12 | part[:, None, :], -1).reshape(len(fps), -1)
            i, j = np.nonzero(anchor >= 0)
            at.append(i)
            to.append(anchor[i, j])
            own.append(np.full(len(i), not any(share)))
    return np.concatenate(at), np.concatenate(to), np.concatenate(own)


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; the smallest index is a set's root."""
    while True:
        ra, rb = _roots(parent, a), _roots(parent, b)
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while not np.array_equal(up := parent[r], r):
        r = up
    return r


def links_at_anchor(fps: np.ndarray, asks: np.ndarray, bits: int, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Compares the fingerprints that ask with all of ``fps``, ``cells`` at a
    time, and returns for each member of a linked set but its smallest the
    member and that smallest: as many links as members, however dense the set."""
    fps, where = np.unique(fps, return_inverse=True)
    asking = np.unique(where[asks])
    parent = np.arange(len(fps))
    rows = max(1, cells // max(1, len(fps)))
    for at in range(0, len(asking), rows):
        q = asking[at:at + rows]
        i, j = np.nonzero(np.bitwise_count(fps[q][:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= bits)
        other = q[i] != j
        _join(parent, q[i][other], j[other])
    root = _roots(parent, np.arange(len(fps)))
    linked = root != np.arange(len(fps))
    return fps[linked], fps[root[linked]]


def anchor_links(distinct: DataFrame, bits: int = 4, group: int = 20_000, blocks: int = 1) -> DataFrame:
    """(a, b) with a > b: links that connect exactly the fingerprints
    (``distinct``, column fp, each once) which differ in ``bits`` or fewer.

    A group of an anchor is compared in one task as long as it has ``group``
    rows; a larger one is laid out in cells, each of a block of asking and a
    block of asked rows, that go to tasks of their own. With ``blocks`` 1
    there are 3 * 4096 anchors and about 16 rows for a fingerprint, with 2
    there are 3 * 4096 ** 2 and about 180, and the same links."""
    if not 0 <= bits <= 5 or blocks not in (1, 2):
        raise ValueError("anchors of one or two blocks cover up to five differing bits")
    schema = pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                fps = b.column(0)[k:k + 2000].to_numpy()
                at, to, own = anchors(fps, bits, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(fps[at]), pa.array(own)], schema=schema)

    sent = distinct.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint, home boolean")
    sizes = sent.groupBy("anchor").count()
    large = sizes.where(F.col("count") > group).select(
        F.col("anchor"), F.ceil(F.col("count") / group).cast("int").alias("cuts"))
    if blocks == 1:
        large = F.broadcast(large)  # 12288 rows at most
    cut = sent.join(large, "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    others = F.sequence(F.lit(0), F.col("cuts") - 1)
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("asks")))
    many = F.concat(F.transform(others, lambda x: F.struct(x.alias("i"), block.alias("j"), F.lit(False).alias("asks"))),
                    F.transform(F.filter(others, lambda x: F.col("home")),
                                lambda x: F.struct(block.alias("i"), x.alias("j"), F.lit(True).alias("asks"))))
    cells = cut.select("anchor", "fp", F.explode(F.when(F.col("cuts") == 1, one).otherwise(many)).alias("cell")) \
               .select("anchor", "cell.i", "cell.j", "fp", "cell.asks")

    def compare(table: pa.Table) -> pa.Table:
        a, b = links_at_anchor(table["fp"].to_numpy(), table["asks"].to_numpy(), bits)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("anchor", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the smallest of its
    component, root. Stars are drawn together in turn: each node's larger
    neighbours are tied to the smallest of its neighbourhood, then each node's
    smaller ones, until nothing changes. Minima are pre-aggregated and joined
    back, so a node with very many neighbours is split like any skewed join."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a <> b").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))))
        edges = cut_lineage(small.distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, group: int = 20_000, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, and component_id, the
    smallest doc_id that links of ``bits`` or fewer differing bits reach.

    Equal fingerprints are one from the start, so copies cost nothing beyond
    their own row. A null text counts as empty, and texts without words are all
    linked; a null id takes part, but is no component's id unless the
    component has no other; repeated rows give repeated rows; an empty table
    gives none; other columns are ignored.
    """
    own = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    named = _rooted(own, bits, group)
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = named.join(ids, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def _rooted(own: DataFrame, bits: int, group: int) -> DataFrame:
    """(fp, first, root) for each fingerprint of (doc_id, fp): its smallest
    doc_id, and the smallest fingerprint of its component."""
    distinct = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    blocks = 1 if distinct.count() <= ONE_BLOCK else 2  # the links are the same
    root = components(anchor_links(distinct, bits, group, blocks))
    return distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text",
             group: int = 20_000) -> DataFrame:
    """``docs`` with one row of each component, whatever its ids: the one with
    the smallest id, null ids last, of one id the text with the smallest hash.

    A row is known by its id and 128 bits of hash of its text, so rows of one
    id, or without any, are told apart unless their texts are equal, and then
    they lie in one component."""
    text = F.col(text_col).cast("string")
    key = ["__none", "__id", "__h", "__g"]
    keys = [F.col(id_col).isNull().cast("bigint"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)),
            F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    keys = [k.alias(name) for k, name in zip(keys, key)]
    own = _with_fingerprint(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *keys, text.alias("text")), shingle)
    own = cut_lineage(own)
    # of each fingerprint first, so that no task joins all rows of one text
    kept = own.groupBy("fp").agg(F.min(F.struct(*key)).alias("k")).join(_rooted(own, bits, group).select("fp", "root"), "fp")
    kept = kept.groupBy("root").agg(F.min("k").alias("k")).select("k.*")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *keys).join(kept, key, "left_semi")
    return rows.dropDuplicates(key).select("__row.*")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
