"""Toxicity and quality: parts against brute force, held-out accuracy on the given tables, degenerate inputs."""

import itertools
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnloom.llm import flat, quality_model, supervised, toxic_spans

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="tables are not here")


def random_chain(rng, size):
    return rng.normal(0, 1, size + 1), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)


def by_enumeration(f, emission, change, first):
    """Toxic marginals of a short sequence by summing over all paths."""
    weight = {}
    for path in itertools.product((0, 1), repeat=len(f)):
        s = first[path[0]] + sum(emission[f[i]] for i in range(len(f)) if path[i]) + sum(change[a, b] for a, b in zip(path, path[1:]))
        weight[path] = np.exp(s)
    total = sum(weight.values())
    return np.array([sum(w for p, w in weight.items() if p[i]) / total for i in range(len(f))])


def test_marginals_and_tagger_equal_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(20):
        size = 3
        emission, change, first = random_chain(rng, size)
        f = rng.integers(0, size + 1, 9)
        f[rng.integers(0, 9)] = 1
        want = by_enumeration(f, emission, change, first)
        score = np.stack([np.zeros(9), emission[f]], -1)[None]
        state, _ = toxic_spans._marginals(score, change, first, np.ones((1, 9), bool))
        assert np.allclose(state[0, :, 1], want)
        model = toxic_spans.Model(np.arange(size, dtype=np.uint64), emission, change, first, np.zeros(5))
        at = np.flatnonzero(f < size)
        assert np.allclose(toxic_spans.Tagger(model).marked(at, f[at], 9), want[at])


def test_padded_windows_have_the_marginals_of_their_tokens():
    rng = np.random.default_rng(6)
    emission, change, first = random_chain(rng, 2)
    f = np.array([0, 2, 1, 2, 0])
    there = np.array([[False, False, True, True, True, True, True, False]])
    padded = np.concatenate([[2, 2], f, [2]])
    score = np.stack([np.zeros(8), emission[padded]], -1)[None] * there[..., None]
    state, _ = toxic_spans._marginals(score, change, first, there)
    assert np.allclose(state[0, 2:7, 1], by_enumeration(f, emission, change, first))


def quality_of(scored, labels, label, least):
    rows = scored.join(labels, "doc_id").filter("held_out").select("score", label).collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])
    assert ((s >= 0) & (s <= 1)).all()
    order = np.argsort(np.argsort(s))
    n1 = y.sum()
    return ((s >= least) == y).mean(), (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1)), max(y.mean(), 1 - y.mean())


@needs_tables
def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxic_spans.fit(docs, labels)
    scored = toxic_spans.score(docs, model).withColumn("held_out", supervised.held_out())
    accuracy, area, base = quality_of(scored.select("doc_id", "held_out", F.col("toxicity.score").alias("score")), labels, "toxic", 0.5)
    assert accuracy > base + 0.05 and area > 0.85
    spans = scored.filter("size(toxicity.spans) > 0").limit(50).collect()
    for r in spans:
        for x in r["toxicity"]["spans"]:
            word = r["text"][x["first_char"] : x["end_char"]]
            assert word and " " not in word and x["probability"] >= 0.5


@needs_tables
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.fit(docs, labels)
    scored = quality_model.score(docs, model, "score").withColumn("held_out", supervised.held_out())
    accuracy, area, base = quality_of(scored, labels, "quality", 0.3)
    assert accuracy > base + 0.03 and area > 0.85


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(d, None, None) for d in range(40)], [(None, 1, 1), *((d, 1, 1) for d in range(40))]])
def test_labels_of_one_class_or_none(spark, as_docs, corpus, labels):
    docs, known = as_docs({d: corpus[d] for d in (1, 2, 130, 131, 132)}), spark.createDataFrame(labels, LABELS)
    for scored in (
        toxic_spans.score(docs, toxic_spans.fit(docs, known)).select("doc_id", "toxicity.score"),
        quality_model.score(docs, quality_model.fit(docs, known), "score"),
    ):
        got = {r["doc_id"]: r["score"] for r in scored.collect()}
        assert len(got) == 5 and len(set(got.values())) == 1 and all(0 <= s <= 1 for s in got.values())


def test_scores_of_odd_rows(spark, as_docs, corpus):
    """Null ids, nulls, repeated rows and clashing columns are scored row by row; empty tables give no rows."""
    toxic = {d: f"{corpus[d % 50]} vile{d % 3} and vile{(d + 1) % 3} words" for d in range(1000, 1060)}
    clean = {d: corpus[d % 50] + " calm words" for d in range(2000, 2060)}
    docs = as_docs(toxic | clean | {1: None, 2: ""}).withColumn("score", F.lit("x")).withColumn("label", F.lit(3))
    docs = docs.unionByName(docs.filter("doc_id in (1, 1000)").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.filter("doc_id = 1001"))
    labels = spark.createDataFrame([(d, int(d >= 2000), int(d < 2000)) for d in toxic | clean], LABELS)
    scored = toxic_spans.score(docs, toxic_spans.fit(docs, labels))
    got = scored.select("doc_id", "toxicity.score", "toxicity.n_tokens").collect()
    assert len(got) == docs.count()
    right = [(r["score"] >= 0.5) == (r["doc_id"] < 2000) for r in got if r["doc_id"] is not None and r["doc_id"] >= 1000]
    assert np.mean(right) > 0.95
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    rated = quality_model.score(docs, quality_model.fit(docs, labels)).collect()
    assert len(rated) == docs.count() and all(0 <= r["quality_score"] <= 1 for r in rated)
    assert toxic_spans.score(docs.limit(0), toxic_spans.fit(docs.limit(0), labels)).count() == 0
    assert quality_model.score(docs.limit(0), quality_model.fit(docs.limit(0), labels)).count() == 0


def test_held_out_is_fold_zero(spark):
    import zlib

    got = spark.range(300).select(F.col("id").alias("doc_id")).select("doc_id", supervised.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_context_sums_equal_a_loop(as_docs, corpus):
    docs = {d: corpus[d] for d in (1, 2, 3, 130, 131, 143)}
    got = quality_model.context_sums(as_docs(docs))
    dims, signs = quality_model.index_vectors()
    want = np.zeros_like(got)
    import pyarrow as pa

    for text in docs.values():
        place, _ = quality_model.places(pa.array([text], pa.string()), slice(0, 1))
        for i, w in enumerate(place):
            for j in range(max(0, i - quality_model.REACH), min(len(place), i + quality_model.REACH + 1)):
                if j != i:
                    np.add.at(want[w], dims[place[j]], signs[place[j]])
    assert np.array_equal(got, want)


def test_every_word_has_its_own_sums(as_docs):
    """Far more words than places: no two share a sum, and none is clipped."""
    docs = {d: " ".join(f"x{d}y{9000 * d + i}" for i in range(9000)) for d in range(3)} | {3: "on off " * 4000}
    got = {r["key"]: quality_model._unpacked(pa.array([r["sums"]], pa.binary()))[0] for r in quality_model.word_sums(as_docs(docs)).collect()}
    dims, signs = quality_model.index_vectors()
    want = {}
    for text in docs.values():
        key, place, _ = quality_model.keyed(pa.array([text], pa.string()), slice(0, 1))
        for i, k in enumerate(flat.signed(key).tolist()):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(key):
                    np.add.at(want.setdefault(k, np.zeros(quality_model.DIM)), dims[place[j]], signs[place[j]])
    assert len(want) > quality_model.PLACES * quality_model.SHAPES and set(got) == set(want)
    assert all(np.array_equal(got[k], want[k]) for k in want)


def test_sums_beyond_32_bits_are_packed_whole():
    sums = np.array([[0] * 32, [127] * 32, [-128] + [0] * 31, [2**15] * 32, [-(2**31)] * 32, [2**40] * 32])
    assert np.array_equal(quality_model._unpacked(pa.array(quality_model._packed(sums).tolist(), pa.binary())), sums)


def test_long_text_of_different_words_does_not_look_repetitive(as_docs):
    texts = [" ".join(f"a{chr(97 + i % 26)}{'bcdfg'[i % 5]}" + "xyzuvw"[i % 6] * (i // 40) for i in range(6000)), "a a a a", None]
    words = quality_model.word_vectors(as_docs(dict(enumerate(texts))))
    got = quality_model.features(pa.array(texts), words)
    n = len(set(texts[0].split()))
    assert np.isclose(got[0][-2], n / 6000) and got[1][-2] == 0.25 and not got[2].any()


def test_features_equal_a_loop(as_docs, corpus):
    texts = [corpus[d] for d in (1, 2, 60, 100, 130, 132, 143)]
    words = quality_model.word_vectors(as_docs(dict(enumerate(texts))))
    assert 0 < len(words.keys) < len({w for t in texts for w in (t or "").split()})
    got = quality_model.features(pa.array(texts), words)
    for x, text in zip(got, texts):
        key, place, _ = quality_model.keyed(pa.array([text], pa.string()), slice(0, 1))
        if not len(key):
            assert not x.any()
            continue
        v = np.array([words.vectors[np.searchsorted(words.keys, k)] if k in words.keys else words.places[p] for k, p in zip(key, place)], float)
        shapes = [np.mean(place // quality_model.PLACES == i) for i in range(quality_model.SHAPES)]
        assert np.allclose(x, [*v.mean(0), *v.std(0), *shapes, len(set(key.tolist())) / len(key), np.log1p(len(key))], atol=1e-6)


def test_scores_do_not_touch_columns_of_any_name(spark, as_docs, corpus):
    docs = as_docs({d: corpus[d] for d in range(30)})
    for name in ("_h1", "_h2", "_score", "_toxicity", "score", "x", "key"):
        docs = docs.withColumn(name, F.lit(name))
    labels = spark.createDataFrame([(d, d % 2, d % 3 // 2) for d in range(30)], LABELS)
    for scored in (quality_model.score(docs, quality_model.fit(docs, labels), "q"), toxic_spans.score(docs, toxic_spans.fit(docs, labels), "t")):
        assert scored.columns[:-1] == docs.columns and scored.count() == 30
        assert {r["_h1"] + r["_score"] + r["_toxicity"] for r in scored.collect()} == {"_h1_score_toxicity"}


def test_sample_is_bounded_by_rows(spark, as_docs):
    docs = as_docs({d: f"t{d}" for d in range(50)})
    many = docs.unionByName(docs.filter("doc_id = 7").drop("text").crossJoin(spark.range(500).selectExpr("'u' || id as text")).select(docs.columns))
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in range(50)], LABELS)
    for per_class in (1, 3, 100):
        got = supervised.labelled_sample(many, labels, "toxic", per_class).collect()
        assert len(got) == len({r["doc_id"] for r in got}) <= 2 * per_class
