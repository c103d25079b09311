"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import decontaminate, jaccard_join, line_dedup, packing, queries, toxic_spans
from turnloom.llm.scratch import write


def unused(docs: DataFrame) -> str:
    """A name that no column of docs has, in any case of letters."""
    taken, n = {c.lower() for c in docs.columns}, 0
    while f"found_{n}" in taken:
        n += 1
    return f"found_{n}"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. The model learns from labels of folds 1 to 4 only."""
    model = toxic_spans.fit(docs, queries.table(spark, sf_dir, "labels"))
    found = unused(docs)
    return toxic_spans.score(docs, model, found).filter(F.col(f"{found}.score") < 0.5).drop(found)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id holds too; n_chars follows the text."""
    lines = unused(docs)
    found = line_dedup.without_repeats(docs, lines)
    text = F.when(F.col("text").isNotNull(), F.col(f"{lines}.text"))
    changed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(f"{lines}.n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType)))
    return changed.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; rows without id come last.

    Ids that are null or stand twice tell no documents apart. Only where there are some is every row numbered and
    linked under its number, and the row that stays is looked up by it.
    """
    ids = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if ids.limit(1).count():
        return near_duplicate_rows(docs)
    classes = jaccard_join.jaccard_classes(docs)
    # Written first, so that its size is known when the join is planned.
    copies, _ = write(classes.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """The same where ids tell no rows apart. Of rows that are alike in all, one stays."""
    rows, _ = write(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("node", F.monotonically_increasing_id()), "numbered")
    classes = jaccard_join.jaccard_classes(rows.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text")))
    linked, _ = write(classes.select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")), "numbered-classes")
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("node"))
    first = rows.select("node", order.alias("order")).join(linked, "node").groupBy("component").agg(F.min_by("node", "order").alias("node"))
    return rows.join(first.select("node"), "node", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    into = unused(docs)
    found = decontaminate.scan(docs, queries.table(spark, sf_dir, "benchmark"), into)
    return found.filter(~decontaminate.is_contaminated(F.col(into))).drop(into)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids with their place in the packed sequences."""
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: A fitted model decides in the first stage, which SQL cannot express; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = write(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
