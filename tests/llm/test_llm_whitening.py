import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import whitening


def slow(rows, components=32):
    """Exact sums with whole numbers, covariance from exact fractions, numpy's eigenvectors."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(v[i] for v in x) for i in range(d)]
    away = np.array([[n * v[i] - sums[i] for i in range(d)] for v in x], object)
    cov = np.array([[float(Fraction(int(c), n ** 3)) for c in row] for row in away.T @ away])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    z = np.array([[float(Fraction(int(a), n)) for a in row] for row in away])
    return n, [int(s) for s in (away * away).sum(axis=1)], z @ (vectors / np.sqrt(values)), values / np.trace(cov)


def test_against_a_slow_restatement(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    n, deviations, white, explained = slow(rows)
    got = whitening.whiten(table).toPandas()
    assert len(got) == n * 32 and set(got["n"]) == {n}
    at = {k: i for i, (k, _) in enumerate(rows)}
    found = np.zeros((n, 32))
    found[got["vec_id"].map(at), got["component"] - 1] = got["whitened"]
    assert all(deviations[at[k]] == d for k, d in zip(got["vec_id"], got["deviation"]))
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found - white * signs).max() < 1e-7
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.abs(share / explained - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


@pytest.mark.parametrize("gap", [1.0, 1e-3, 1e-8, 1e-12, 0.0])
def test_refinement_of_clusters(gap):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    values = np.concatenate((np.arange(20, 8, -1.0), 5 + gap * np.arange(5), [2.0, 2.0], 0.1 + gap * 0.01 * np.arange(5)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.eigen(a)
    assert np.abs(np.sort(found) - np.sort(values)).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-14
    assert np.abs(a @ vectors - vectors * found).max() < 2e-14
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(a @ rough - rough * np.diag(rough.T @ a @ rough)).max() > 1e-8  # what was to be corrected


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 0.0]), (103, [0.0, inf, 0.0]), (104, []), (105, [1.0, 2.0]),
           (106, [1e30, 0.0, 0.0]), (None, [0.5, 0.25, -1.0]), (7, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "Component": F.lit("x")})
    got = whitening.whiten(df).toPandas()
    used = good + odd[-3:]
    n, deviations, white, _ = slow(used)
    assert len(got) == 3 * n and set(got["n"]) == {43}
    assert sorted(got.loc[got["component"] == 1, "deviation"]) == sorted(deviations)
    assert len(got[got["vec_id"].isna()]) == 3 and len(got[got["vec_id"] == 7]) == 9
    assert np.allclose(np.sort(np.abs(got["whitened"])), np.sort(np.abs(white).reshape(-1)), atol=1e-9)


def test_no_variance_and_large_entries(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0
    # the second dimension repeats the first: one component
    rows = [(i, [float(i), float(i)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).toPandas()
    assert set(got["component"]) == {1} and got["explained"][0] == pytest.approx(1.0) and got["identity_error"][0] < 1e-9
    big = [(i, [float(i) * 2**30, 1.0 * (i % 2)]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(big, schema)).toPandas()
    assert got["deviation"].isna().any()
