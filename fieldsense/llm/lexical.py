"""Ranked lexical search with exact top-k over geometrically blocked postings.

A task takes its documents in shards. Of each term's posting list in a shard
it clusters the documents by similarity into blocks, and keeps for each block a
summary: the largest contribution of any of its documents, coordinate by
coordinate. The sum of a query's coordinates of a summary bounds what any
document of the block can score, so a block is skipped only if that lies under
the query's k-th best score so far. Scores are whole numbers, and the k best
of all tasks are those of the whole table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, id_and_text, row_groups

#: Bytes of a shard's matrix of contributions, which sets how many documents a shard has, and the bounds of that number.
SHARD_BYTES, SHARD_DOCS = 32_000_000, (64, 4096)
#: Documents of a block on average, and directions of the sketch that tells which are similar.
BLOCK, SKETCH = 16, 16
#: Queries that one pass over the documents answers.
QUERIES = 500
#: Parts in which the tasks' hits of a query are merged before the whole.
MERGE = 64

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond
    ASCII, with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass
class Statistics:
    """N documents with a term, L terms in all, and the weight of each query term."""

    documents: int
    length: int
    weights: np.ndarray

    def contributions(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.documents) // max(self.length, 1)
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _counted(vocab: dict[bytes, int], rows: list[tuple]) -> Iterator[tuple]:
    """(doc_id, terms in all, query terms, their counts) of each text with a term."""
    for doc_id, text in rows:
        found = terms_of(text)
        if found:
            ids = np.fromiter(map(vocab.get, found, repeat(-1)), np.int64, len(found))
            term, tf = np.unique(ids[ids >= 0], return_counts=True)
            yield doc_id, len(found), term, tf


def statistics(docs: DataFrame, vocab: dict[bytes, int]) -> Statistics:
    """One pass over all texts; a task hands on at most a row for each query term."""
    size, spread = len(vocab), docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for rows in row_groups(batches):
            for _, n, term, _ in _counted(spread.value, rows):
                total[term] += 1
                total[size] += 1
                total[size + 1] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["k", "total"])

    total = np.zeros(size + 2, np.int64)
    for r in docs.mapInArrow(count, "k bigint, total bigint").groupBy("k").agg(F.sum("total").alias("total")).collect():
        total[r["k"]] = r["total"]
    n = int(total[size])
    return Statistics(n, int(total[size + 1]), np.array([weight(n, int(df)) for df in total[:size]], np.int64))


class Best:
    """A query's k best documents so far, by falling score, then by id, null last."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    @property
    def least(self) -> int:
        """What a document has to score, at least, to be among them."""
        return self.found[-1][0] if len(self.found) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        new = [(int(s), i) for s, i in zip(scores, ids) if s >= self.least]
        if new:
            self.found = sorted(self.found + new, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:self.k]


class Shard:
    """The blocked posting lists of some documents.

    ``asked`` has, for each term, the sorted terms that a query asks together
    with it: the coordinates that its blocks' summaries need."""

    def __init__(self, rows: Sequence[tuple], stats: Statistics, asked: Sequence[np.ndarray], block: int = BLOCK):
        self.ids = [r[0] for r in rows]
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        term = np.concatenate([np.empty(0, np.int64), *(r[2] for r in rows)])
        tf = np.concatenate([np.empty(0, np.int64), *(r[3] for r in rows)])
        n = np.array([r[1] for r in rows], np.int64)
        # whole numbers below 2 ** 53, which doubles hold exactly
        self.matrix = np.zeros((len(rows), len(asked)))
        self.matrix[doc, term] = stats.contributions(term, tf, n[doc])
        sketch = self._sketch()
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(asked) + 1))
        self.lists = {}
        for t in np.unique(term):
            if stats.weights[t] > 0:
                self.lists[int(t)] = self._blocks(doc[order[starts[t]:starts[t + 1]]], sketch, asked[t], block)

    def _sketch(self) -> np.ndarray:
        """The documents' vectors, of length one, in a few fixed random directions."""
        directions = np.random.default_rng(5).standard_normal((self.matrix.shape[1], SKETCH))
        out = self.matrix @ directions
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    def _blocks(self, docs: np.ndarray, sketch: np.ndarray, coordinates: np.ndarray, block: int):
        """A posting list's documents, block by block, the blocks' starts and
        their summaries. Each document joins the most similar of evenly spaced ones."""
        n = -(-len(docs) // block)
        if n > 1:
            heads = docs[np.arange(n) * len(docs) // n]
            nearest = (sketch[docs] @ sketch[heads].T).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            docs, nearest = docs[order], nearest[order]
            starts = np.flatnonzero(np.r_[True, nearest[1:] != nearest[:-1]])
        else:
            starts = np.zeros(1, np.int64)
        return docs, starts, np.maximum.reduceat(self.matrix[np.ix_(docs, coordinates)], starts, axis=0)

    def search(self, terms: np.ndarray, asked: Sequence[np.ndarray], best: Best) -> tuple[int, int]:
        """Puts the documents among ``best`` that belong there; returns how
        many blocks it saw and how many it skipped. ``terms`` come heaviest first."""
        seen, blocks, skipped = np.zeros(len(self.ids), bool), 0, 0
        for t in terms:
            if int(t) not in self.lists:
                continue
            docs, starts, summaries = self.lists[int(t)]
            bounds = summaries[:, np.searchsorted(asked[t], terms)].sum(axis=1)
            fits = bounds >= best.least
            blocks, skipped = blocks + len(fits), skipped + int((~fits).sum())
            if not fits.any():
                continue
            at = docs[np.repeat(fits, np.diff(np.r_[starts, len(docs)]))]
            at = at[~seen[at]]
            seen[at] = True
            scores = self.matrix[np.ix_(at, terms)].sum(axis=1).astype(np.int64)
            good = np.flatnonzero(scores >= best.least)
            best.add(scores[good], [self.ids[i] for i in at[good]])
        return blocks, skipped


def _asked(queries: Sequence[np.ndarray], size: int) -> list[np.ndarray]:
    """For each term the sorted terms of the queries that have it."""
    out = [[] for _ in range(size)]
    for q in queries:
        for t in q:
            out[t].append(q)
    return [np.unique(np.concatenate(x)) if x else np.empty(0, np.int64) for x in out]


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """(query, doc_id, score, part): each task's ``k`` best for each query."""
    vocab = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    stats = statistics(docs, vocab)
    queries = []
    for _, ts in items:
        q = np.array(sorted(vocab[t] for t in ts), np.int64)
        q = q[stats.weights[q] > 0]
        queries.append(q[np.argsort(-stats.weights[q], kind="stable")])
    plan = docs.sparkSession.sparkContext.broadcast((vocab, stats, queries))
    least, most = SHARD_DOCS
    shard_docs = min(max(SHARD_BYTES // (8 * max(len(vocab), 1)), least), most)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, stats, queries = plan.value
        asked, best, held = _asked(queries, len(vocab)), [Best(k) for _ in queries], []

        def flush() -> None:
            shard = Shard(held, stats, asked)
            for q, b in zip(queries, best):
                shard.search(q, asked, b)
            held.clear()

        for rows in row_groups(batches):
            for row in _counted(vocab, rows):
                held.append(row)
                if len(held) >= shard_docs:
                    flush()
        if held:
            flush()
        hits = [(q, i, s) for q, b in enumerate(best) for s, i in b.found]
        q, i, s = zip(*hits) if hits else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())],
                                         names=["query", "doc_id", "score"])

    hits = docs.mapInArrow(search, "query int, doc_id bigint, score bigint")
    return hits.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))


def _first(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", query_col: str = "text", per_pass: int = QUERIES) -> DataFrame:
    """The ``k`` best rows of ``docs`` for each item of ``queries``: item_id, rank
    (from 1), doc_id, score, for scores above zero.

    Every ``per_pass`` queries cost two passes over the documents: one for the
    counts, one for the search. A task hands on ``k`` hits for each query at
    most, which are merged in ``MERGE`` parts and then as a whole.

    A null text has no terms, and neither has an empty one: such documents are
    never found and count for nothing, and such queries find nothing; a null
    doc_id comes last of equal scores; repeated documents are found each for
    itself; queries of one item_id (null is one too) are one query with the
    terms of all; an empty table on either side gives no rows; other columns
    are ignored.
    """
    spark, own = docs.sparkSession, id_and_text(docs, id_col, text_col)
    items = (queries.groupBy(F.col(item_col).alias("item_id")).agg(F.sort_array(F.collect_set(F.col(query_col).cast("string"))).alias("texts"))
             .orderBy("item_id"))
    type_ = queries.schema[item_col].dataType.simpleString()
    out, held = None, []

    def run() -> None:
        nonlocal out
        hits = _search_block(own, held, k)
        best = _first(_first(hits, k, "query", "part"), k, "query")
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(held)], f"query int, item_id {type_}")
        found = best.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)

    for r in items.toLocalIterator():
        held.append((r["item_id"], {t for text in r["texts"] for t in terms_of(text)}))
        if len(held) == per_pass:
            run()
            held = []
    if held:
        run()
    return out if out is not None else spark.createDataFrame([], f"item_id {type_}, rank int, doc_id bigint, score bigint")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH t AS (
  SELECT k, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw
  FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)),
d AS (SELECT k, doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t),
p AS (SELECT k, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
l AS (SELECT k, sum(tf) AS n FROM p GROUP BY k),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM l),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
q AS (SELECT DISTINCT item_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM benchmark)),
c AS (SELECT p.k, p.doc_id, p.term,
             w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * CAST(n AS BIGINT) * nn) // ll))) AS c
      FROM p JOIN w USING (term) JOIN l USING (k), s WHERE p.term IN (SELECT term FROM q)),
r AS (SELECT item_id, k, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY ALL)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
                      doc_id, score FROM r WHERE score > 0) WHERE rank <= 50
"""
