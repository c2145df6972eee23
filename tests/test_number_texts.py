"""The exact text of a JSON number is found once for each number, and stays the text of its value."""

from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from fieldsense.functions import canonical_json, exact_number, marked_json
from fieldsense.operators import state as ST

NUMBERS = ["0", "-0", "0.0", "7", "-7", "100", "1" + "0" * 399, "1" + "0" * 400, "1" + "0" * 401, "5" * 400, "5" * 401, "1.50", "-1e0", "12E-1",
           "1e2", "0.00120", "1e400", "-25e-3", "1e-400", "90e+1"]


def test_a_number_is_taken_apart_once(spark):
    text = F.col("t")
    # written out, each use of a part was another search: 94 for a number
    assert str(exact_number(text)).count("regexp_extract(") == 3
    assert str(marked_json(text)).count("regexp_extract_all(") == 1


def test_exact_numbers_keep_their_value(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS], "t string").select(
        "t", exact_number(F.col("t")).alias("e"), marked_json(F.concat(F.lit("["), "t", F.lit("]"))).alias("m"))
    texts = {}
    with localcontext() as c:
        c.prec = 1000
        for r in df.collect():
            assert Decimal(r.e) == Decimal(r.t) and r.m == f'["~n{r.e}"]', r.t
            assert texts.setdefault(Decimal(r.t).normalize(), r.e) == r.e
    assert {r.t: r.e for r in df.where("t in ('-0', '100', '1.50', '1e2', '12E-1')").collect()} == \
        {"-0": "0", "100": "100", "1.50": "1.5", "1e2": "100", "12E-1": "1.2"}


def test_texts_without_numbers_or_marks_stay(spark):
    docs = {'{"a": "b"}': '{"a": "b"}', '{"~": 1}': '{"~~": "~n1"}', '["~n"]': '["~~n"]', '["\\u007en"]': '["~\\u007en"]', "[": None, "~": None, "x": None}
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    assert {r.d: r.m for r in df.select("d", marked_json(F.col("d")).alias("m")).collect()} == docs
    assert [r.c for r in df.where("d like '[\"%'").select(canonical_json(F.col("d")).alias("c")).collect()] == ['["~n"]', '["~n"]']


def test_observations_keep_one_text_for_equal_data(spark):
    data = ['{"value": 1}', '{"value": 1e0}', '{"value": 9, "value": 1.0}', '{"value": 1},2] tail', '{"value": 1', "{}", None, "[1]", '{"value": 1e99999999999999999999}']
    obs = spark.createDataFrame([("d", i, "cloud", d) for i, d in enumerate(data)], "device_id string, id long, segment string, data string")
    got = {r.id: (r.reason, r.data) for r in ST.tag_observations(obs).collect()}
    assert got == {i: ((None, '{"value":1}') if i < 3 else ("data", d)) for i, d in enumerate(data)}
