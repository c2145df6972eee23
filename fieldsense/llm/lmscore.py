"""Cross-entropy difference of two n-gram models.

The target model counts the documents labelled good, the background model all
documents. Both are bigram models over one vocabulary, all words of the corpus
and the end of a text, smoothed alike towards their own unigrams; every bigram
is counted, so what the models gather grows with the corpus, and of each context
the probabilities add up to one. A document's score is the mean over its words
and its end of the target's loss less the background's: the lower, the more
like the target.

Counting is spread by key: documents are dealt into chunks, a chunk sends each
of its words and bigrams once, with its own counts, to the shard of the key, and
gets the sums over all chunks back, so that no task holds the whole model and
the most frequent bigram costs a task one entry for each chunk."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shard, documents, id_and_text

#: Pseudo-counts of the unigrams in a bigram's distribution, and of each word in the unigrams.
PRIOR, FLOOR = 20.0, 0.5
#: Text bytes of a chunk on average.
CHUNK_BYTES = 8_000_000
#: Chunks that rows of one doc_id may lie in.
SPREAD = 16
#: Keys of the start and the end of a text. Words and the end have odd keys, bigrams even ones.
START, END = np.uint64(2), np.uint64(5)

_A, _B, _MIX, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29), np.uint64(1)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_key(word: str) -> int:
    """64 bits of hash; the lowest bit is set, which tells words from bigrams."""
    return xxhash.xxh64_intdigest(word.encode()) | 1


class WordKeys(dict):
    """Words to their keys, each worked out once."""

    def __missing__(self, word: str) -> int:
        key = self[word] = word_key(word)
        return key


def bigram_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    h = (before * _A ^ (before >> _MIX)) + words
    h = (h ^ (h >> _MIX)) * _B
    return (h ^ (h >> _MIX)) & ~_ONE


@dataclass
class Totals:
    """The size of the vocabulary, and of both models, target first, the words
    in all and the texts with words. The end of a text counts as a word."""

    vocabulary: int
    words: np.ndarray
    texts: np.ndarray

    def losses(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray, model: int) -> np.ndarray:
        """The losses of words that the model counted ``word`` times, after
        contexts that it counted ``context`` times, ``pair`` times together."""
        unigram = (word + FLOOR) / (self.words[model] + FLOOR * self.vocabulary)
        return -np.log((pair + PRIOR * unigram) / (context + PRIOR))


class Steps:
    """The words of some texts, each text with its end, one after the other:
    ``keys`` are those of their words and bigrams, sorted, each once; ``pair`` and
    ``word`` say where each step's bigram and word are among them, ``first``
    which steps begin a text, ``ends`` where the texts end."""

    def __init__(self, texts: list[str | None]):
        known = WordKeys()
        found = [words_of(t) for t in texts]
        sizes = np.array([len(w) + 1 if w else 0 for w in found], np.int64)  # no words, no steps
        words = np.fromiter((k for w in found if w for k in (*map(known.__getitem__, w), int(END))), np.uint64, int(sizes.sum()))
        before = np.r_[START, words[:-1]] if len(words) else words
        self.first = before == END
        self.first[:1] = True
        before[self.first] = START
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.keys, at = np.unique(np.concatenate([bigram_keys(before, words), words]), return_inverse=True)
        self.pair, self.word = at[:len(words)], at[len(words):]

    def counts(self, target: np.ndarray) -> np.ndarray:
        """(model, key): the counts in the texts of the target, and in all. A
        word's count is also its count as a context."""
        good = np.repeat(target, self.sizes)
        return np.stack([np.bincount(self.pair, g, len(self.keys)) + np.bincount(self.word, g, len(self.keys))
                         for g in (good, np.ones(len(good)))]).astype(np.uint32)

    def losses(self, sums: np.ndarray, totals: Totals) -> np.ndarray:
        """(model, text): the sums of the losses of each text's steps, from the
        counts (model, key) over all chunks."""
        out = []
        for model in (0, 1):
            word = sums[model][self.word]
            context = np.where(self.first, totals.texts[model], np.r_[0.0, word[:-1]] if len(word) else word)
            run = np.r_[0.0, np.cumsum(totals.losses(sums[model][self.pair], context, word, model))]
            out.append(run[self.ends] - run[self.ends - self.sizes])
        return np.stack(out)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of equal weight, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _rows(columns: dict, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(columns.items(), cols)})


_SENT = {"shard": pa.int32(), "chunk": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
_SUMS = {"shard": pa.int32(), "chunk": pa.int32(), "sums": pa.binary(), "vocabulary": pa.int64(), "words0": pa.int64(),
         "words1": pa.int64(), "texts0": pa.int64(), "texts1": pa.int64()}
_SCORES = {"doc_id": pa.int64(), "n_words": pa.int64(), "target_loss": pa.float64(), "background_loss": pa.float64(),
           "difference": pa.float64()}
_TOTALS = list(_SUMS)[3:]


def _targets(table: pa.Table) -> tuple[list, list, np.ndarray]:
    """The ids and texts of a chunk's rows, and which are in the target: rows
    without text come from the target's ids."""
    ids, texts, is_id = table["doc_id"].to_pylist(), table["text"].to_pylist(), table["is_target"].to_pylist()
    good = {i for i, t in zip(ids, is_id) if t}
    rows = [k for k, t in enumerate(is_id) if not t]
    return [ids[k] for k in rows], [texts[k] for k in rows], np.array([ids[k] in good for k in rows], float)


def score_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    chunk_bytes: int = CHUNK_BYTES, spread: int = SPREAD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, target_loss and
    background_loss (nats for a word or the end), difference (target less background).

    ``target`` has the target's doc_ids. Words and bigrams are known by 64 bits
    of hash. Rows lie in a chunk by their id and one of ``spread`` numbers dealt
    to the rows in turn, rows without an id by a number alone; the target's ids
    go to all chunks that can have them, so no join moves the texts.

    A text without words, or null, has losses and difference 0; a null id
    is in no target; repeated rows give equal rows and count as often as they
    are there; an empty target leaves its model to the smoothing; an empty
    table gives no rows; other columns are ignored.
    """
    own = id_and_text(docs, id_col, text_col)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(8, math.ceil(size / chunk_bytes))
    of = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(chunks)).cast("int")
    number = F.monotonically_increasing_id()
    rows = own.withColumn("number", number).select(
        "doc_id", "text", F.lit(False).alias("is_target"),
        F.when(F.col("doc_id").isNull(), of("number")).otherwise(of("doc_id", F.pmod("number", F.lit(spread)))).alias("chunk"))
    ids = (target.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
           .select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))).alias("number"))
           .select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("is_target"), of("doc_id", "number").alias("chunk")))
    # read twice, shuffled once: the plan reuses the exchange
    texts = rows.unionByName(ids).repartition(chunks, "chunk")

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, texts, good = _targets(table)
        s = Steps(texts)
        counts = s.counts(good)
        return _rows(_SENT, [(k, key[0].as_py(), pack(np.diff(s.keys[at], prepend=np.uint64(0))), pack(counts[:, at].ravel()))
                             for k, at in by_shard(s.keys, chunks)])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(b, np.uint64), dtype=np.uint64) for b in table["keys"].to_pylist()]
        counts = np.concatenate([unpack(b, np.uint32).reshape(2, -1) for b in table["counts"].to_pylist()], axis=1)
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.stack([np.bincount(at, c, len(found)) for c in counts]).astype(np.uint64)
        words = (found & _ONE) == 1
        texts = total[:, found == END].sum(axis=1).tolist()
        sums, cuts = total[:, at], np.cumsum([len(k) for k in keys])[:-1]
        out = [(key[0].as_py(), c, pack(part.ravel()), None, None, None, None, None)
               for c, part in zip(table["chunk"].to_pylist(), np.split(sums, cuts, axis=1))]
        # the shard's part of the totals goes under a chunk that isn't there
        out.append((key[0].as_py(), -1, None, int(words.sum()), *total[:, words].sum(axis=1).tolist(), *texts))
        return _rows(_SUMS, out)

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids, texts, _ = _targets(left)
        if ids:
            s = Steps(texts)
            at_total = int(np.flatnonzero(right["shard"].to_numpy() == -1)[0])
            v, w0, w1, t0, t1 = (right[n][at_total].as_py() or 0 for n in _TOTALS)
            sums, answer = np.zeros((2, len(s.keys))), dict(zip(right["shard"].to_pylist(), right["sums"].to_pylist()))
            for k, at in by_shard(s.keys, chunks):
                sums[:, at] = unpack(answer[k], np.uint64).reshape(2, -1)
            loss = s.losses(sums, Totals(v, np.array([w0, w1], float), np.array([t0, t1], float))) / np.maximum(s.sizes, 1)
            out = list(zip(ids, np.maximum(s.sizes - 1, 0).tolist(), *loss.tolist(), (loss[0] - loss[1]).tolist()))
        return _rows(_SCORES, out)

    sent = texts.groupBy("chunk").applyInArrow(count, "shard int, chunk int, keys binary, counts binary")
    sums = sent.groupBy("shard").applyInArrow(
        add, "shard int, chunk int, sums binary, vocabulary bigint, words0 bigint, words1 bigint, texts0 bigint, texts1 bigint")
    totals = (sums.where("chunk = -1").agg(*(F.sum(n).alias(n) for n in _TOTALS))
              .select(F.lit(-1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
                      F.lit(None).cast("binary").alias("sums"), *_TOTALS))
    return (texts.groupBy("chunk").cogroup(sums.where("chunk >= 0").unionByName(totals).groupBy("chunk"))
            .applyInArrow(score, "doc_id bigint, n_words bigint, target_loss double, background_loss double, difference double"))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents scored against those labelled to be of good quality."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return score_documents(documents(spark, sf_dir), good)
