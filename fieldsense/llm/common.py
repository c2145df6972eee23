"""What the text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and text characters after which a Python operator hands a batch on.
BATCH_ROWS, BATCH_CHARS = 2000, 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, under fixed names, so that
    other columns of the input can never clash with its own."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """The column's values one by one (a batch can hold very long texts)."""
    for value in batch.column(column):
        yield value.as_py()


def in_batches(rows: Iterable[tuple], schema: pa.Schema, weight=None) -> Iterator[pa.RecordBatch]:
    """Record batches of ``rows``, each of at most ``BATCH_ROWS`` rows and,
    where ``weight`` measures a row, about ``BATCH_CHARS`` characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += weight(row) if weight else 0
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield _batch(held, schema)
            held, chars = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8; splitting bytes knows exactly the white space of
    ``WORD`` and no other."""
    return (text or "").encode().split()


def row_groups(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, chars: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Lists of (doc_id, text), each of at most ``rows`` rows and about ``chars`` characters."""
    held, size = [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1)):
            held.append((i.as_py(), t.as_py()))
            size += len(held[-1][1] or "")
            if len(held) >= rows or size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of the 64-bit ``keys`` that it has), for the shards that have any."""
    shard = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]) if len(order) else []
    for at in np.split(order, cuts[1:]) if len(order) else []:
        yield int(shard[at[0]]), at
