"""Intermediate tables in the folder that all executors share, and document ids without nulls."""

from __future__ import annotations

import uuid

import turnloom
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.session import shared_dir

#: Stands for a null doc_id inside the operators: it sorts after every real id.
NO_ID = (1 << 63) - 1


#: Bytes of rows that Python workers get at once. Some operators hold several times as much while they work on a batch.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Let batches to Python workers be bounded by their size, whatever the rows: a session setting, safe to repeat.

    Tasks bring the package's functions along, so workers need no installed copy.
    """
    cloudpickle.register_pickle_by_value(turnloom)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table and read it back: cuts the lineage and survives lost executors. Returns it with its folder."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables nobody reads any more."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def identified(docs: DataFrame, **more: Column) -> DataFrame:
    """Columns doc_id, variant, text and `more` only; a null id becomes NO_ID.

    Rows of one id with the same text are one document. Should an id have several texts, `variant` (a hash of the text)
    tells them apart; it is 0 where every id stands once, so that it costs nothing in a shuffle.
    """
    bounded(docs.sparkSession)
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"),
        *(c.alias(name) for name, c in more.items()),
    )
    repeated = own.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return own.select("doc_id", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("variant"), "text", *more)


def id_or_null(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)
