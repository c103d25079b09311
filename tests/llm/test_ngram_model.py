"""The n-gram model against plain counting: probabilities that add up, parts of any size, odd texts and tables."""

import math
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from turnloom.llm import ngram_model, queries

LEARN = "doc_id % 3 <> 0"


def close(got, want):
    assert set(got) == set(want)
    for d, w in want.items():
        assert got[d][:3] == w[:3], d
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got[d][3:], w[3:])), (d, got[d], w)


def scored(df, learn=LEARN):
    model = ngram_model.fit(df, F.expr(learn))
    rows = ngram_model.score(df, model).collect()
    return {r["doc_id"]: (r["lm"]["n_tokens"], r["lm"]["n_known"], model.tokens, r["lm"]["base_score"], r["lm"]["score"]) for r in rows}


@pytest.mark.parametrize("sizes", [{}, {"WORD_PART": 2000, "PAIR_PART": 300, "HELD": 500, "BLOCK": 1000}])
def test_scores(as_docs, corpus, monkeypatch, sizes):
    """Also where words and pairs lie in many parts, a frequent word's pairs in several."""
    for name, size in sizes.items():
        monkeypatch.setattr(ngram_model, name, size)
    docs = corpus | {200 + k: "the " * 40 + f"w{k} the x{k}" for k in range(60)} | {300: "the " * 700}
    df = as_docs(docs).withColumn("lm", F.lit(1)).withColumn("row", F.lit("r")).withColumn("score", F.lit(None).cast("int"))
    close(scored(df), plain.lm_scores(docs, lambda d: d % 3 != 0))


def test_probabilities_add_up(corpus):
    p, counts = plain.lm_model([corpus[d] for d in range(40)])
    for a in (0, "w1", "never seen"):
        assert math.isclose(sum(p(a, b) for b in counts) + p(a, "unknown word"), 1, rel_tol=1e-9)


def test_better_than_the_base_on_unseen_texts(as_docs, corpus):
    got = scored(as_docs(corpus))
    assert sum(g[4] for d, g in got.items() if d % 3 == 0) > sum(g[3] for d, g in got.items() if d % 3 == 0)


@pytest.mark.parametrize("learn", ["false", "cast(null as boolean)"])
def test_nothing_to_learn_from(as_docs, learn):
    docs = {1: "a b", 2: None}
    close(scored(as_docs(docs), learn), plain.lm_scores(docs, lambda d: False))


def test_empty_texts_only_and_empty_tables(as_docs):
    docs = {1: None, 2: "", 4: " \n"}
    close(scored(as_docs(docs)), plain.lm_scores(docs, lambda d: d % 3 != 0))
    assert scored(as_docs(docs).limit(0)) == {}


def test_repeated_rows_and_null_ids(as_docs):
    df = as_docs({1: "a b c", 2: "a b"})
    df = df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    model = ngram_model.fit(df, F.lit(True))
    rows = ngram_model.score(df, model, ["doc_id", "text"], into="m").collect()
    want = plain.lm_scores({i: t for i, t in enumerate(["a b c", "a b"] * 3)}, lambda d: True)
    assert sorted(r["m"]["score"] for r in rows) == pytest.approx(sorted(w[4] for w in want.values())) and model.tokens == 21


def test_very_long_text(as_docs):
    docs = {1: "x y z " * 1_500_000, 2: "q" * 9_000_000, 3: "x y"}
    got = scored(as_docs(docs))
    assert got[1][:2] == (4_500_001, 4_500_001) and got[2][:3] == (2, 2, 4_500_003) and got[1][4] > got[1][3]


def test_arrays_come_back_from_bytes():
    a, b = np.sort(np.array([5, 5, 1 << 63, 7], np.uint64)), np.array([1, 0, 300, 1 << 40], np.uint64)
    back = ngram_model.unpacked(ngram_model.packed(a, b), 2)
    assert back[0].tolist() == a.tolist() and back[1].tolist() == b.tolist()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    learn = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    rows = queries.all_queries()["op13_lm_scoring"](spark, sf).collect()
    close({r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows}, plain.lm_scores(docs, learn))
    assert all(r["held_out"] != learn(r["doc_id"]) for r in rows)
