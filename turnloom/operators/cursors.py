"""Cursors and file errors that follow from a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_errors(files: DataFrame, rows: DataFrame, adapter: str, needs_header: bool) -> DataFrame:
    """Files a pass could not use: unreadable ones, and headerless ones where a header is required."""
    facts = rows.groupBy("path").agg(
        F.max(F.col("row_kind") == "error").alias("unreadable"), F.max(F.col("row_kind") == "header").alias("headed")
    )
    judged = files.select("path").join(facts, "path", "left")
    reason = F.when(F.col("unreadable"), "unreadable")
    if needs_header:
        reason = reason.when(~F.coalesce("headed", F.lit(False)), "no session header")
    return judged.select("path", F.lit(adapter).alias("adapter"), reason.alias("reason")).filter("reason IS NOT NULL")


def new_cursors(files: DataFrame, rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Where each file's next pass starts: before its first held prompt or unfinished line, else its
    end. Files in error keep the cursor they had, so they get no row."""
    stops = (
        rows.filter(F.col("row_kind").isin("held", "tail"))
        .groupBy("path")
        .agg(F.min("prompt_offset").alias("stop"))
    )
    return (
        files.select("path", "file_size")
        .join(errors.select("path").distinct(), "path", "left_anti")
        .join(stops, "path", "left")
        .select("path", F.coalesce("stop", "file_size").alias("cursor"))
    )


def merge_cursors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new (path, cursor); the new one wins."""
    return old.select("path", F.col("cursor").alias("_old")).join(
        new.select("path", F.col("cursor").alias("_new")), "path", "full"
    ).select("path", F.coalesce("_new", "_old").alias("cursor"))
