"""The pipeline stage by stage against plain Python, on the smallest tables and on odd rows."""

from pathlib import Path

import plain
import pytest
from pyspark.sql import functions as F
from test_packing import check

import corpus_pipeline
from turnloom.llm import toxic_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables are not here")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def by_hand(kept, items):
    """Stages two to four on {doc_id: text}."""
    lines = {d: r[2] for d, r in plain.line_dedup(kept).items()}
    classes = plain.jaccard_classes(lines)
    firsts = {d: t for d, t in lines.items() if classes[d][1] == d}
    return {d: t for d, t in firsts.items() if not plain.contamination({d: t}, items)[d][3]}


def test_run_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxic_spans.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = texts(toxic_spans.score(docs, model).filter("toxicity.score < 0.5"))
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = by_hand(kept, items)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    check(want, rows, 1024)


def test_stages_keep_the_columns_and_follow_each_other(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    now = texts(docs)
    df = corpus_pipeline.dedup_lines(spark, docs, SF)
    assert df.columns == docs.columns and df.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    lines = {d: r[2] for d, r in plain.line_dedup(now).items()}
    assert texts(df) == lines
    assert df.filter(F.col("n_chars") != F.char_length("text")).count() == docs.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    df = corpus_pipeline.near_duplicates(spark, docs, SF)
    classes = plain.jaccard_classes(now)
    assert df.columns == docs.columns and set(texts(df)) == {d for d in now if classes[d][1] == d}
    df = corpus_pipeline.decontamination(spark, docs, SF)
    assert df.columns == docs.columns and set(texts(df)) == {d for d, r in plain.contamination(now, items).items() if not r[3]}


def test_rows_without_id_and_namesakes_are_linked_on_their_own(spark):
    """A unique text stays though its namesake goes, and of copies without id one stays, or none beside one with an id."""
    copy, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(60))
    rows = [(1, copy), (1, "only here, under the same id"), (2, copy + " more"), (None, copy), (None, other), (None, other), (None, "unique"), (3, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=str)
    want = [(1, copy), (1, "only here, under the same id"), (None, other), (None, "unique"), (3, None), (None, None)]
    assert got == sorted(want, key=str)


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, empty texts, repeated rows, extra columns and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumn("h1", F.lit(1)).withColumn("row", F.lit("r")).withColumn("_doc", F.lit("d"))
    for name in ("_toxicity", "_lines", "_found", "found_0", "FOUND_1", "node", "order", "component"):
        docs = docs.withColumn(name, F.lit(name))
    nulls = docs.limit(2).select(*(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
    empty = docs.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(-5).cast("long"))
    odd = docs.unionByName(nulls).unionByName(empty).unionByName(docs.limit(1))
    for df, least in ((odd, 1), (odd.limit(0), 0)):
        now = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, SF)
            assert out.columns == df.columns
            out, _ = corpus_pipeline.write(out, "odd")
            assert least <= out.count() <= now.count()
            assert (out.filter("text = '' and doc_id = -5").count() == 1) == bool(least)
            now = out
        packed = corpus_pipeline.pack(spark, now, SF)
        assert packed.count() >= now.count()
