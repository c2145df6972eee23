import zlib

import pytest
from pyspark.sql import functions as F

from fieldsense.llm import sharding as H

from . import cases


def check(rows, texts, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(
        ((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    for s in range(shards):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert all(0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None for r in rows)


def test_edge_cases(spark):
    docs = cases.documents(spark)
    check(H.shard_by_bytes(docs).collect(), [r[:2] for r in cases.texts()], 24)
    assert H.shard_by_bytes(docs.where("false")).count() == 0


def test_query_is_even(spark):
    sf = "/root/testdata/sf0.01"
    rows = H.op3_shard(spark, sf).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, texts, 24)
    size = [sum(r.size for r in rows if r.shard == s) for s in range(24)]
    assert max(size) - min(size) <= max(r.size for r in rows) + 0.02 * sum(size) / 24


def test_a_group_larger_than_a_shard_is_parted(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.lit("copy " * 20)).otherwise(
        F.concat(F.lit("word " * 19), F.col("id"))).alias("text"))
    rows = H.shard_by_bytes(docs, shards=8, ranges_per_shard=2).collect()
    size = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(size) <= 1.03 * min(size)
    groups = {}
    for r in rows:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 1


@pytest.mark.parametrize("probes", [1, 7])
def test_splitters_count_exactly(spark, probes):
    keyed = spark.createDataFrame([(k * 10_007 % 5003 - 2500, 1 + k % 5) for k in range(1500)], "key long, size long")
    rows = keyed.collect()
    found = H.find_splitters(keyed, 10, 0.001, 0.001, probes)
    for k, size, n in zip(found.keys, found.bytes_below, found.rows_below):
        assert size == sum(r["size"] for r in rows if r.key < k) and n == sum(r.key < k for r in rows)
    total = sum(r["size"] for r in rows)
    assert all(abs(b - total * j / 10) <= 6 for j, b in enumerate(found.bytes_below, 1))


def test_moved_rows_keep_their_columns(spark):
    docs = cases.documents(spark)
    out = H.move_to_shards(docs, shards=4)
    assert out.columns == [*docs.columns, "shard"]
    a = cases.as_bag(out.select("doc_id", "shard").collect())
    assert a == cases.as_bag(H.shard_by_bytes(docs, shards=4).select("doc_id", "shard").collect())


def test_equal_rows_without_id_are_parted(spark):
    docs = spark.range(3000).select(F.when(F.col("id") >= 1000, F.col("id")).alias("doc_id"), F.when(
        F.col("id") < 1000, F.lit("copy " * 40)).otherwise(F.concat(F.lit("word " * 19), F.col("id"))).alias("text")).repartition(5)
    texts = [tuple(r) for r in docs.collect()]
    rows = H.shard_by_bytes(docs, shards=8, ranges_per_shard=2).collect()
    check(rows, texts, 8)
    size = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(size) <= 1.04 * min(size)
    assert sum(len({r.shard for r in rows if r.text_crc32 == c}) > 1 for c in {r.text_crc32 for r in rows}) == 1
    moved = H.move_to_shards(docs, shards=8, ranges_per_shard=2)
    assert cases.as_bag(moved.select("doc_id", "text").collect()) == cases.as_bag(texts)
    size = [r.b for r in moved.groupBy("shard").agg(F.sum(F.octet_length("text") + 8).alias("b")).collect()]
    assert len(size) == 8 and max(size) <= 1.04 * min(size)


def test_one_text_only(spark):
    docs = spark.range(500).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    rows = H.shard_by_bytes(docs, shards=5, ranges_per_shard=2).collect()
    check(rows, [(7, "same")] * 500, 5)
    assert all(95 <= sum(r.shard == s for r in rows) <= 105 for s in range(5))
