import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldsense.functions import bucket_start, canonical_json, drop_flag, round_numeric, set_flag, whole_variant, with_default_key

scalars = st.one_of(st.none(), st.booleans(), st.integers(-10**6, 10**6),
                    st.text(alphabet="abcxyz _-", max_size=5))
values = st.recursive(scalars, lambda c: st.lists(c, max_size=3) | st.dictionaries(
    st.text(alphabet="abkuv", min_size=1, max_size=3), c, max_size=3), max_leaves=6)
objects = st.dictionaries(st.text(alphabet="abcdeuIv", min_size=1, max_size=4), values, min_size=1, max_size=4)


def _canon(obj):
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@settings(max_examples=3, deadline=None)
@given(st.lists(objects, min_size=20, max_size=40))
def test_canonical_json_matches_python(spark, docs):
    rows = [(i, json.dumps(d, indent=1)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "i int, data string")
    got = {r.i: r.c for r in df.select("i", canonical_json(F.col("data")).alias("c")).collect()}
    assert got == {i: _canon(d) for i, d in enumerate(docs)}


@settings(max_examples=3, deadline=None)
@given(st.lists(objects, min_size=20, max_size=40))
def test_default_key_matches_python(spark, docs):
    def expect(d):
        d = dict(d)
        if d.get("userId") is None:
            d["userId"] = 0
        return _canon(d)
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "i int, data string")
    got = {r.i: r.c for r in df.select("i", with_default_key(whole_variant(F.col("data")), "userId", "0").alias("c")).collect()}
    assert got == {i: expect(d) for i, d in enumerate(docs)}


def test_bucket_and_rounding(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 9, 1, 13, 59), 2.675, -2.675)],
                               "ts timestamp_ntz, a double, b double")
    r = df.select(bucket_start(F.col("ts"), 12, True).alias("b12"), bucket_start(F.col("ts"), 1, True).alias("b1"),
                  round_numeric(F.col("a")).alias("ra"), round_numeric(F.col("b")).alias("rb")).collect()[0]
    assert r.b12 == dt.datetime(2016, 9, 1, 12) and r.b1 == dt.datetime(2016, 9, 1, 13)
    assert (r.ra, r.rb) == (2.68, -2.68)


def test_set_flag_replaces_key(spark):
    df = spark.createDataFrame([({"cloud": False, "x": True},), (None,)], "m map<string,boolean>")
    out = [r.m for r in df.select(set_flag(F.col("m"), "cloud", True).alias("m")).collect()]
    assert out == [{"x": True, "cloud": True}, {"cloud": True}]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(-10**6, 10**6), min_size=20, max_size=40))
def test_number_forms_are_one(spark, numbers):
    rows = [(n, f) for n in numbers for f in (f"{n}", f"{n}.0", f"{n}e0", f"{n}0e-1" if n else "0e5")]
    df = spark.createDataFrame([(n, f'{{"v": {f}, "s": "{f},"}}', f) for n, f in rows], "n long, data string, f string")
    for r in df.select("n", "f", canonical_json(F.col("data")).alias("c")).collect():
        assert r.c == f'{{"s":"{r.f},","v":{r.n}}}'


def test_drop_flag(spark):
    df = spark.createDataFrame([({"cloud": True, "x": True},), ({"x": None},), (None,)], "m map<string,boolean>")
    assert [r.m for r in df.select(drop_flag(F.col("m"), "cloud").alias("m")).collect()] == [{"x": True}, {"x": None}, None]


@pytest.mark.parametrize("a, b", [("1e20", "1" + "0" * 20), ("1.0", "1"), ("-0", "0.00"), ("12.5e1", "125"), ("-0.50", "-5E-1"),
                                  ("1e-500", "0.1e-499"), ('{"a":{"x":1,"x":[2]}}', '{"a":{"x":[2.0]}}'), ("1e401", "0.1e402"),
                                  ("0e99999999999999999999", "0")])
def test_equal_json_has_one_text(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(canonical_json(F.col("a")).alias("a"), canonical_json(F.col("b")).alias("b")).first()
    assert row.a == row.b is not None


def test_different_json_has_different_texts(spark):
    long = "1" * 39
    docs = [long + "5", long + "6", '"~n5"', "5", '"\\u007en5"', '"~~n5"', '"~"', '"5"', '"a\\"~n5\\""', "0." + long + "1", "0." + long + "2",
            '{"~a":1}', '{"~~a":1}', "-5", "5e400", "5e-500"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    got = {r.i: r.c for r in df.select("i", canonical_json(F.col("d")).alias("c")).collect()}
    # the third and the fifth are the same string, written differently
    assert got[2] == got[4] == '"~n5"' and len(set(got.values())) == len(docs) - 1
    assert [got[k] for k in (0, 3, 5, 6, 7, 8, 11, 12)] == [docs[k] for k in (0, 3, 5, 6, 7, 8, 11, 12)]
    many = json.dumps({f"k{k}": [k / 7, "~n" + str(k), {"~": "x" * k}] for k in range(300)}, separators=(",", ":"))
    assert json.loads(spark.createDataFrame([(many,)], "d string").select(canonical_json(F.col("d"))).first()[0]) == json.loads(many)
    assert spark.createDataFrame([("1e99999999999999999999",)], "d string").select(canonical_json(F.col("d"))).first()[0] is None
