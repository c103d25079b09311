"""Packing against the tokenizer itself: exact round trip, no gaps, little padding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from turnloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs):
    t = Tokenizer.from_file(PATH)
    return {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for d, x in docs.items()}


def check(docs, rows, size):
    ids = encoded(docs)
    for d, want in ids.items():
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        at = 0
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sequences


@pytest.mark.parametrize("size", [64, 1024])
def test_pack(as_docs, corpus, size):
    docs = corpus | {704: "<|endoftext|>", 705: "a  <|endoftext|> \n<|endoftext|><|endoftext|>b <|endoftext|", 700: "ends with <|endoftext|> inside", 701: "naïve  it's\t\n we'll 12 345!? 漢字  x", 702: "   ", 703: "\r\n'S"}
    sequences = check(docs, packing.pack(as_docs(docs), PATH, size).collect(), size)
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) <= 1.05 * total / size + 2


def test_pack_repeated_rows_null_ids_and_empty_tables(as_docs, corpus):
    df = as_docs({d: corpus[d] for d in (1, 2, 130)}).withColumn("length", F.lit("x"))
    twice = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    rows = packing.pack(twice, PATH, 64).collect()
    one = packing.pack(df, PATH, 64).collect()
    assert len(rows) == 3 * len(one) and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(df.limit(0), PATH, 64).count() == 0


def test_sequences_hold_the_ids(as_docs, corpus):
    docs = {d: corpus[d] for d in range(30)}
    rows = packing.sequences(as_docs(docs), PATH, 128).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(map(len, encoded(docs).values()))
    for r in rows:
        full = r["n_tokens"] & (r["n_tokens"] - 1) == 0
        assert len(r["ids"]) == 4 * (r["n_tokens"] if full else 128)


def test_sequences_of_repeated_and_null_ids(as_docs):
    df = as_docs({1: "a b c", 2: "a b d"})
    df = df.unionByName(df.filter("doc_id = 1")).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = packing.sequences(df, PATH, 64).collect()
    assert sum(r["n_tokens"] for r in rows) == packing.pack(df, PATH, 64).agg(F.sum("length")).first()[0] == sum(len(x) for x in encoded({1: "a b c"}).values()) * 4


def test_ranks_are_dense_in_every_length(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(d, 0, 7 if rng.random() < 0.5 else rng.randrange(1, 5)) for d in range(500)], "doc_id long, start long, length long")
    got = packing.ranked(rows, per_bucket=3).collect()
    for n in {r["length"] for r in got}:
        mine = sorted(r["rank"] for r in got if r["length"] == n)
        assert mine == list(range(len(mine)))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns_use_every_piece_once(histogram):
    found = packing.patterns(dict(histogram), 64)
    used = {}
    for pattern, count in found:
        assert sum(pattern) <= 64
        for n in pattern:
            used[n] = used.get(n, 0) + count
    assert used == histogram


def test_patterns_pad_little():
    rng = random.Random(3)
    histogram = {}
    for _ in range(20_000):
        n = rng.randrange(1, 1025)
        histogram[n] = histogram.get(n, 0) + 1
    found = packing.patterns(histogram, 1024)
    total = sum(n * c for n, c in histogram.items())
    assert sum(c for _, c in found) * 1024 < 1.02 * total
