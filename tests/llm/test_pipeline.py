import corpus_pipeline as C
import __spark_entry__ as E
from fieldsense.llm import quality, simhash

from . import cases

NAMES = ["op1_line_dedup", "op2_license_scan", "op3_shard", "op4_lm_scoring", "op5_sentencepiece", "op6_winnowing", "op7_toxicity",
         "op8_simhash_near_dedup", "op9_quality_rules", "op10_mix_sources", "op11_suffix_dedup", "op12_lexical_search", "op13_whitening", "pipeline"]


def test_registered():
    assert set(NAMES) <= set(E.queries()) and "op10_mix_sources" in E.oracle_sql()
    assert len(C.STAGES) == 5


def test_stages(spark, tmp_path):
    docs = cases.documents(spark)
    kept = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, kept[-1], "")
        if k < 4:
            assert out.columns == docs.columns + ([C.POSITION, C.COPY] if k == 3 else [])
        out.write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    n = [d.count() for d in kept]
    assert n[1] == sum(quality.judge(r[0], r[1])[-2] for r in cases.texts()) and n[2] == n[1]
    assert n[3] == len({c for _, _, c in simhash.near_duplicates(kept[2]).collect()})
    assert n[5] == n[4] and kept[5].where("not lossless").count() == 0
    for _, stage in C.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0


def test_run(spark):
    rows = C.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.lossless for r in rows)
    # copies of one document are there at different positions, and in different pieces
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    twice = [v for v in by_id.values() if len(v) == 2 and v[0].n_tokens > 100]
    assert twice and all(a.mix_position != b.mix_position and a.ids != b.ids and {a.mix_copy, b.mix_copy} == {0, 1} for a, b in twice)


def test_positions_survive_the_files(spark, tmp_path):
    """Sorted by position, what was written and read again is the training order."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('w', id, ' a b c') AS text", "'en' AS lang",
                                        "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS source", "9L AS n_chars").repartition(7)
    mixed = C.mix_sources(spark, docs, "")
    want = [(r.doc_id, r.mix_copy) for r in mixed.collect()]
    mixed.repartition(9).write.parquet(str(tmp_path / "m"))
    out = C.sentencepiece(spark, spark.read.parquet(str(tmp_path / "m")), "")
    got = out.orderBy(C.POSITION, C.COPY).collect()
    place = {k: j for j, k in enumerate(want)}
    assert len(got) == len(want) and sorted((r.doc_id, r.mix_copy) for r in got) == sorted(want)
    moved = [abs(place[r.doc_id, r.mix_copy] - j) for j, r in enumerate(got)]
    assert max(moved) <= 8  # only copies at one position may change places
    early = [r for r in got if r.mix_position < 0.5]  # x rises from 0.5 to 1.5, y is even
    share = {s: sum(r.doc_id % 2 == k for r in early) / sum(r.doc_id % 2 == k for r in got) for k, s in enumerate("xy")}
    assert abs(share["x"] - 0.375) < 0.02 and abs(share["y"] - 0.5) < 0.02


def test_documents_that_have_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 3, "old", "old")], f"doc_id long, text string, lang string, source string, n_chars long, {C.POSITION} string, {C.COPY} string")
    out = C.mix_sources(spark, docs, "")
    assert out.columns == docs.columns and dict(out.dtypes)[C.COPY] == "int"
