"""Histogram sort: documents go to shards of near equal bytes.

The sort key's upper bits are a hash of the text and its lower bits a hash of
the id, so equal texts lie side by side, and yet a splitter can fall inside a
group of copies that is larger than a shard. Rows that are equal in text and id
(or have none) are told apart by a tie-break, written down with the key, which
only a splitter inside such rows looks at. Splitters are found by counting
the exact bytes below candidate keys over all partitions and refining the
candidates where the tolerance isn't met; then the rows move once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import documents

#: Bits of the key that come from the id.
GROUP_BITS = 24
#: Bits of the tie-break below the key.
TIE_BITS = 63


@dataclass(frozen=True)
class Splitters:
    """``keys``: the first key of every range but the first, above its
    ``tie_bits`` bits of tie-break; ``bytes_below`` and ``rows_below``: exact
    totals of the rows before it."""

    keys: list[int]
    bytes_below: list[int]
    rows_below: list[int]
    rounds: int
    tie_bits: int = 0

    @property
    def parts_equal_rows(self) -> bool:
        return any(k & ((1 << self.tie_bits) - 1) for k in self.keys)


def sort_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    low = (1 << GROUP_BITS) - 1
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return text.bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(low)))


def tie_break() -> Column:
    """Another number for each row, the same only once it is written."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)


def byte_size(text_col: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 8).cast("bigint")


def finder(splitters: Sequence[int], tie_bits: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Of sorted splitters, how many lie at or before each (key, tie)."""
    last = (1 << 63 + tie_bits) - 1
    edges = [min(k, last) for k in splitters]
    keys = np.array([k >> tie_bits for k in edges], np.int64)
    ties = np.array([k & ((1 << tie_bits) - 1) for k in edges], np.int64)
    parted = np.unique(keys[ties > 0])  # keys whose rows a splitter parts

    def find(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, key, "right")
        for k in parted:
            first, end = np.searchsorted(keys, [k, k], "left")[0], np.searchsorted(keys, k, "right")
            own = key == k
            at[own] = first + np.searchsorted(ties[first:end], tie[own], "right")
        return at

    return find


def histogram(keyed: DataFrame, probes: Sequence[int], tie_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows between neighbouring probes, from (key, size) and, with
    ``tie_bits``, tie: each task sums its own rows, so at most a row for each probe
    leaves a task."""
    find = finder(probes, tie_bits)
    n = len(probes) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            at = find(b.column(0).to_numpy(), b.column(b.num_columns - 1).to_numpy())
            np.add.at(size, at, b.column(1).to_numpy())
            rows += np.bincount(at, minlength=n)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(size[used]), pa.array(rows[used])],
                                         names=["at", "size", "rows"])

    out = (keyed.select("key", "size", *(["tie"] if tie_bits else [])).mapInArrow(count, "at bigint, size bigint, rows bigint")
           .groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect())
    size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in out:  # one row for each probe at most
        size[r["at"]], rows[r["at"]] = r["size"], r["rows"]
    return size, rows


def find_splitters(keyed: DataFrame, ranges: int, tolerance: float, whole: float, probes: int = 8,
                   tie_bits: int = 0) -> Splitters:
    """Splitters of ``ranges`` ranges of (key, size), with ``tie_bits`` also tie, whose bytes below are
    within ``tolerance`` (a share of all bytes) of even, or as near as one
    key allows; ``whole`` is the tolerance where a closer splitter would part
    a group of equal texts. Each round puts ``probes`` candidates into the bracket of each
    open splitter, more when few are open: at borders between groups of equal texts as long as the
    bracket holds any, else inside the group, at borders between ids, and only
    among rows of one key by their tie-break."""
    low, high, group = -(1 << 63 + tie_bits), 1 << 63 + tie_bits, GROUP_BITS + tie_bits
    known: dict[int, tuple[int, int]] = {low: (0, 0)}
    todo = sorted({low + (i << 64 + tie_bits) // (ranges * probes) >> group << group for i in range(1, ranges * probes)})
    rounds = 0
    while True:
        rounds += 1
        keys = sorted({*known, *todo} - {low, high})
        size, rows = histogram(keyed, keys, tie_bits)
        known = {low: (0, 0)} | {k: (int(s), int(r)) for k, s, r in zip([*keys, high], np.cumsum(size), np.cumsum(rows))}
        order, below = sorted(known), [known[k][0] for k in sorted(known)]
        total, todo, chosen, open_ = below[-1], set(), [], []
        for j in range(1, ranges):
            want = total * j / ranges
            i = min(max(bisect_left(below, want), 1), len(order) - 1)
            lo, hi = order[i - 1], order[i]
            best = min((lo, hi), key=lambda k: (abs(known[k][0] - want), k))
            chosen.append(best)
            step = next((bits for bits in (group, tie_bits) if hi - lo > 1 << bits), 0)
            enough = tolerance if step == group else whole
            if abs(known[best][0] - want) > enough * total and hi - lo > 1 and known[hi][1] - known[lo][1] > 1:
                open_.append((lo, hi, step))
        each = max(probes, ranges * probes // max(1, len(open_)))
        for lo, hi, step in open_:
            todo |= {lo + (hi - lo) * p // (each + 1) >> step << step for p in range(1, each + 1)} - {lo, hi}
        if not todo:
            return Splitters(chosen, [known[k][0] for k in chosen], [known[k][1] for k in chosen], rounds, tie_bits)


def range_of(found: Splitters) -> Column:
    """The number of splitters at or before the row's key and tie."""

    @F.pandas_udf("int")
    def at(key, tie):
        import pandas as pd

        return pd.Series(find(key.to_numpy(np.int64), tie.to_numpy(np.int64)).astype(np.int32))

    find = finder(found.keys, found.tie_bits)
    return at(F.col("key"), F.col("tie"))


def shard_by_bytes(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 8, tolerance: float = 0.005,
                   whole: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law
    ``bytes``, shard, slot, grown_shard (null) and the sort ``key``.

    A shard's bytes miss the even share by ``tolerance`` of it at either
    end (``whole``, where that keeps a group of equal texts in one shard), or by
    one document where documents are larger.
    Slots follow the key; they are numbered in ``ranges_per_shard`` ranges of
    a shard at once, whose first slots the histogram knows.

    A null text has 8 bytes and the checksum of the empty one; a null id is an
    id like others; repeated rows share a key and are parted like copies with
    different ids, where they are too many for a range; an empty table gives no rows; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    keyed = cut_lineage(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), byte_size(text_col).alias("size"),
                                    F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
                                    sort_key(id_col, text_col).alias("key"), tie_break().alias("tie")))
    found = find_splitters(keyed, shards * ranges_per_shard, tolerance / shards, whole / shards, tie_bits=TIE_BITS)
    starts = [0, *found.rows_below]
    firsts = [n - starts[i // ranges_per_shard * ranges_per_shard] for i, n in enumerate(starts)]
    in_range = Window.partitionBy("range").orderBy("key", "doc_id", "tie")
    return (keyed.withColumn("range", range_of(found))
            .withColumn("slot", F.row_number().over(in_range) - 1)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                    F.floor(F.col("range") / ranges_per_shard).cast("int").alias("shard"),
                    (F.element_at(F.array(*map(F.lit, firsts)), F.col("range") + 1) + F.col("slot")).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "key"))


def move_to_shards(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 8, tolerance: float = 0.005,
                   whole: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard``, after one exchange of whole rows: each range of
    a shard in a partition, sorted by key. Where a splitter parts rows that are equal
    in id and text, the rows are written to the checkpoint folder first."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), sort_key(id_col, text_col).alias("key"),
                        byte_size(text_col).alias("size"), tie_break().alias("tie"))

    def find(frame: DataFrame) -> Splitters:
        return find_splitters(frame, shards * ranges_per_shard, tolerance / shards, whole / shards, tie_bits=TIE_BITS)

    found = find(cut_lineage(keyed.select("key", "size", "tie")))
    if found.parts_equal_rows:  # a task that is run again must not give a row another tie
        keyed = cut_lineage(keyed)
        found = find(keyed)
    return (keyed.withColumn("range", range_of(found)).repartition(shards * ranges_per_shard, "range")
            .sortWithinPartitions("range", "key", "tie")
            .select("row.*", F.floor(F.col("range") / ranges_per_shard).cast("int").alias("shard")))


def op3_shard(spark, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of near equal bytes."""
    return shard_by_bytes(documents(spark, sf_dir)).drop("key")
