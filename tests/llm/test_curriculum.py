import duckdb
import pytest
from pyspark.sql import functions as F

from fieldsense.llm import curriculum as C

from . import cases


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    got = C.op10_mix_sources(spark, f"/root/testdata/{sf}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    rel = con.sql(C.OP10_SQL)
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    assert cases.as_bag(got.select(names).collect()) == cases.as_bag(con.execute(
        f"SELECT {', '.join(names)} FROM ({C.OP10_SQL})").fetchall())


def level(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Targets by dealing out the excess until none is above."""
    out, free, left = {}, set(sizes), total
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(spark):
    docs = cases.documents(spark)
    rows = C.curriculum_mix(docs).select("row.source", "row.doc_id", "size", "source_size", "target", "copies", "positions").collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: C.WEIGHTS[k % 3] for k, s in enumerate(order)}
    targets = level(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.copies <= 2 and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
    for s in order:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - targets[s]) <= max(r.size for r in own) / 2 + 1
    assert cases.as_bag(rows) == cases.as_bag(
        C.curriculum_mix(docs.repartition(5)).select("row.source", "row.doc_id", "size", "source_size", "target", "copies", "positions").collect())


def test_positions_follow_the_schedule(spark):
    n = 2000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    mix = C.curriculum_mix(docs, weights=(1, 1), share=1.0, schedules=(((0.0, 0.0), (1.0, 2.0)), ((0.0, 2.0), (0.5, 0.0), (1.0, 0.0))))
    at = mix.select("row.source", F.explode("positions").alias("p")).where("p < 0.5").groupBy("source").count().collect()
    assert {r["source"]: round(r["count"] / (n / 2), 2) for r in at} == {"x": 0.25, "y": 1.0}


def test_no_copy_lies_where_the_rate_is_zero(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 3, "a b").otherwise("").alias("text"), F.lit("x").alias("source"))
    knots = ((0.0, 0.0), (0.25, 0.0), (0.5, 1.0), (0.75, 0.0), (1.0, 0.0))
    at = [p for r in C.curriculum_mix(docs, share=1.0, schedules=(knots,)).collect() for p in r.positions]
    assert len(at) == 300 and min(at) >= 0.25 and max(at) <= 0.75 + 1e-9
    with pytest.raises(ValueError):
        C.curriculum_mix(docs, schedules=(((0.0, 0.0), (1.0, 0.0)),))


def test_training_order(spark):
    docs = cases.documents(spark)
    out = C.in_training_order(C.curriculum_mix(docs))
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in C.curriculum_mix(docs).collect())
    assert C.in_training_order(C.curriculum_mix(docs.where("false"))).count() == 0


def test_rows_without_ids_are_spread_and_reruns_agree(spark):
    docs = spark.range(6000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "concat('w', id, ' a b') AS text", "'x' AS source")
    keyed = C._keyed(docs, "source", "text", "doc_id", 1, ["text"])
    bins = [r["n"] for r in keyed.groupBy(F.substring("place", 1, 1).alias("bin")).agg(F.count("*").alias("n")).collect()]
    assert len(bins) == 16 and max(bins) < 2 * 6000 / 16
    runs = [cases.as_bag(C.curriculum_mix(docs.repartition(p)).select("row.text", "copies", "positions").collect()) for p in (2, 11)]
    assert runs[0] == runs[1]
