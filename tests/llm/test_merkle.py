"""The manifest against one that plain Python builds: trees of all heights, null fields, repeated rows, tampered texts."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from turnloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(n, sources=()):
    rng = random.Random(n)
    hosts = ["a", "a", "a", "b", None, "ü", *sources]
    texts = lambda i: rng.choice(["Ab cD " * rng.randrange(5), None, "é x", f"Text {i}"])
    rows = [(rng.choice([i, i, i, None]), texts(i), "en", rng.choice(hosts), i if i % 3 else None) for i in range(n)]
    return rows + rows[:5]


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("n,sources", [(1, ()), (16, ()), (17, ()), (400, [f"s{i}" for i in range(40)])])
def test_verify(spark, n, sources):
    rows = made(n, sources)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("digest", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("_at", F.lit(0))
    got = [tuple(r) for r in merkle.verify(df).collect()]
    assert sorted(got, key=key) == sorted(plain.merkle(rows), key=key)
    if n > 100:
        assert {r[6] for r in got} == {True, False}


def test_identical_rows_share_their_records(spark):
    """A third of all rows is one row: its subtrees are stored once and every copy has its proof."""
    rows = [(7, "Same", "en", "a", 4)] * 600 + [(i, f"t{i}", "en", "a", 2) for i in range(8, 300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert sorted(map(tuple, merkle.verify(df).collect()), key=key) == sorted(plain.merkle(rows), key=key)
    manifest = merkle.build(df)
    assert manifest.records[0].count() < len(rows) // 16
    manifest.drop(spark)


def test_proofs_of_few_requests(spark):
    rows = [(i, f"t{i}", "en", "ab"[i % 2], 2) for i in range(90)]
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA))
    requests = spark.createDataFrame([("sa", 3, "p"), ("sb", 44, "q"), ("sa", 45, "beyond"), ("sz", 0, "unknown")], "tree string, rank long, name string")
    got = {r["name"]: r for r in merkle.prove(manifest, requests).withColumn("root", merkle.folded(F.col("digest"))).collect()}
    assert set(got) == {"p", "q"} and {r["root"] for r in got.values()} == {manifest.root}
    assert got["p"]["digest"] == plain.merkle_leaf(rows[6]) and len(got["p"]["path"]) == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.verify(df).count() == 0 and merkle.build(df).root is None


def test_very_long_text(spark):
    rows = [(5, "É x" * 4_000_000, "en", "a", 1), (6, "", "", "", 0)]
    assert sorted(map(tuple, merkle.verify(spark.createDataFrame(rows, SCHEMA)).collect()), key=key) == sorted(plain.merkle(rows), key=key)
