import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsense.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<double>, label int, n string, whitened string, i string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", "clash", "clash") for i, v in rows], SCHEMA)


def vectors(n=300, d=12, seed=3):
    rnd = random.Random(seed)
    mix = [[rnd.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    out = []
    for k in range(n):
        base = [rnd.gauss(0, 0.1 * (j + 1)) for j in range(d)]
        out.append((k, [sum(a * b for a, b in zip(base, col)) for col in mix]))
    return out


def exact(rows):
    """Integers, sums, covariance and deviations with Python's own numbers."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(col) for col in zip(*x)]
    z = [[n * a - b for a, b in zip(r, s)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in z), n ** 3) for j in range(d)] for i in range(d)]
    return n, s, z, cov, [sum(a * a for a in r) for r in z]


def test_equals_exact_covariance(spark):
    rows = vectors()
    rows += [(900, rows[0][1]), (900, rows[0][1]), (None, rows[1][1])]
    broken = [(901, None), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, []), (906, [1.0])]
    own, dims = W.usable(frame(spark, rows + broken))
    n, s, z, cov, far = exact(rows)
    model = W.fit(own, dims)
    assert (dims, model.n, model.sums) == (12, n, s)
    v = np.array([[float(c) for c in r] for r in cov])
    np.testing.assert_allclose(model.vectors @ np.diag(model.values) @ model.vectors.T, v, rtol=1e-10, atol=1e-9 * v.max())
    got = W.whiten(frame(spark, rows + broken).repartition(5), components=8).collect()
    assert len(got) == 8 * n
    values, vecs = np.linalg.eigh(v)
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert abs(r["explained"] - values[-r["component"]] / v.trace()) < 1e-10
    of = {(r["vec_id"], r["component"]): r for r in got}
    for k in (0, 7, 299):
        assert int(of[k, 1]["deviation"]) == far[k]
        for c in range(1, 9):
            want = (np.array(z[k], float) / n) @ vecs[:, -c] / np.sqrt(values[-c])
            assert abs(abs(of[k, c]["whitened"]) - abs(want)) < 1e-7
    white = np.array([[of[k, c]["whitened"] for c in range(1, 9)] for k in range(300)])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 0.2  # the repeated rows are not in it


def test_polarisation_is_exact_beyond_64_bits():
    u = np.array([[1 << 44, -(1 << 44) + 3], [5, -7]])
    assert W.square_sums(u) == [(1 << 88) + 25, ((1 << 44) - 3) ** 2 + 49]
    big = np.array([[1 << 60, -(1 << 59)]])
    assert W.square_sums(big) == [1 << 120, 1 << 118]
    z = W.centred(np.array([[1 << 50], [0]]), 1 << 40, [3])
    assert [int(v) for v in z[:, 0]] == [(1 << 90) - 3, -3]
    assert W.square_sums_of_rows(np.array([[3, 4], [-1, 1]])) == [25, 2]


def test_without_variance_or_rows(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, None)])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    flat = W.whiten(frame(spark, [(k, [float(k), 2.0, float(-k)]) for k in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12
    with pytest.raises(Exception, match="too large"):
        W.whiten(frame(spark, [(1, [1e30]), (2, [0.0])])).collect()


def test_query(spark):
    out = W.op13_whitening(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    got = out.agg(F.count("*").alias("c"), F.max("component").alias("k"), F.max("n").alias("n"), F.max("identity_error").alias("e")).first()
    assert got["c"] == 8 * got["n"] and got["n"] <= n and got["k"] == 8 and got["e"] < 1e-4
    assert dict(out.dtypes)["deviation"] == "bigint" and out.where("deviation is null").count() == 0
