"""The bidiagonal solver against numpy's, and whitened tables against the definition in exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import queries, whitening

RNG = np.random.default_rng(3)
Q = np.linalg.qr(RNG.normal(size=(90, 32)))[0]
MATRICES = {
    "random": RNG.normal(size=(200, 40)),
    "graded": RNG.normal(size=(200, 40)) * 10.0 ** (-np.arange(40) / 4),
    "equal values": Q,
    "clusters": Q @ np.diag(np.repeat([5, 5 + 1e-12, 3, 1], 8)) @ np.linalg.qr(RNG.normal(size=(32, 32)))[0],
    "rank three": RNG.normal(size=(90, 3)) @ RNG.normal(size=(3, 20)),
    "fewer rows than columns": RNG.normal(size=(4, 20)),
    "one column": RNG.normal(size=(9, 1)),
    "diagonal": np.diag(np.arange(12.0)),
    "close pairs": np.diag(np.abs(np.arange(-10, 11.0)) + 0.1) + np.diag(np.ones(20), 1),
    "zeros": np.zeros((6, 3)),
}


@pytest.mark.parametrize("name", list(MATRICES))
def test_principal(name):
    x = MATRICES[name]
    values, directions = whitening.principal(np.linalg.qr(x, mode="r"), x.shape[1])
    want = np.linalg.svd(x, compute_uv=False) ** 2
    rank = int((want > want[0] * 1e-26).sum()) if want[0] else 0
    assert len(values) == rank and np.all(np.diff(values) <= 0)
    if rank:
        assert np.abs(values - want[:rank]).max() <= 1e-12 * want[0]
        assert np.abs(directions.T @ directions - np.eye(rank)).max() < 1e-10
        assert np.abs(x.T @ (x @ directions) - directions * values).max() <= 1e-11 * want[0]


def test_small_values_are_relatively_exact():
    a, b = np.array([1.0, 1e-8, 1e-4]), np.array([0.5, 1e-9])
    product = Fraction(1)
    for v in whitening.squared_values(a, b):
        product *= Fraction(v)
    want = math.prod(Fraction(x) ** 2 for x in a.tolist())  # the determinant
    assert abs(float(product / want) - 1) < 1e-12


def check(rows, got, components=8):
    """rows: {id: vector}, those that count."""
    x = {i: [math.floor(1024 * float(c)) + 100_000 for c in v] for i, v in rows.items()}
    n, sums = len(x), [sum(c) for c in zip(*x.values())]
    off = {i: [n * c - s for c, s in zip(v, sums)] for i, v in x.items()}
    y = np.array([[float(Fraction(c, n)) for c in off[i]] for i in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    k = min(components, int((e > e[0] * 1e-20).sum()))
    assert set(by) == set(rows) and all(set(c) == set(range(1, k + 1)) for c in by.values())
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-9
    z = np.array([[by[i][c]["whitened"] for c in range(1, k + 1)] for i in x])
    want = y @ v[:, :k] / np.sqrt(e[:k])
    assert np.abs(z - want * np.sign((z * want).sum(0))).max() < 1e-8
    for i in x:
        assert {(r["n"], int(r["deviation"])) for r in by[i].values()} == {(n, sum(c * c for c in off[i]))}
        assert all(abs(by[i][c]["explained"] / (e[c - 1] / e.sum()) - 1) < 1e-10 for c in by[i])


def test_whiten_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = {i: (rng.normal(size=12) * (1 + np.arange(12))).astype(np.float32).tolist() for i in range(300)}
    odd = [(1000, None), (1001, [None, *[1.0] * 11]), (1002, [math.nan, *[1.0] * 11]), (1003, [math.inf, *[1.0] * 11]), (1004, []), (1005, [1.0] * 3), (1006, [-math.inf] * 12)]
    df = spark.createDataFrame([*rows.items(), *odd], "vec_id long, embedding array<float>").repartition(7)
    df = df.withColumn("n", F.lit("x")).withColumn("id", F.lit(1)).withColumn("v", F.lit(None).cast("int"))
    check(rows, whitening.whiten(df).collect())


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (None, [0.5, 7.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1"] * 4 + ["None"] * 4 and {r["n"] for r in got} == {4}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(i, [1.0, 1.0]) for i in range(9)]])
def test_no_variance_gives_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    x = [[whitening.MOST + 100_000, 100_000], [100_000 - whitening.MOST, 101_024], [100_000, 105_120]]
    off = [[3 * c - s for c, s in zip(r, map(sum, zip(*x)))] for r in x]
    assert {(r["vec_id"], int(r["deviation"])) for r in got} == {(i + 1, sum(c * c for c in r)) for i, r in enumerate(off)}


def test_triangles_are_put_together_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(6)
    rows = {i: rng.normal(size=5).astype(np.float32).tolist() for i in range(200)}
    check(rows, whitening.whiten(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>").repartition(20)).collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["vec_id"]: r["embedding"] for r in queries.table(spark, sf, "embeddings").collect()}
    got = queries.all_queries()["op11_embedding_whitening"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(rows, got.collect())
