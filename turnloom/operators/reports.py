"""Small reports over a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failure_summary(failures: DataFrame, source: str = "source", place: str = "dir") -> DataFrame:
    """Per source, how many places failed and their sorted names.

    Distinct first, so repeats of one place never travel to the grouped list; the list itself is the
    report.
    """
    return (
        failures.select(source, place)
        .distinct()
        .groupBy(source)
        .agg(
            F.count(F.lit(1)).alias("n_failed"),
            F.array_join(F.array_sort(F.collect_list(place)), ", ").alias("places"),
        )
    )


def failure_message() -> Column:
    """Fixed value: the text of the summary line."""
    return F.concat(F.col("n_failed").cast("string"), F.lit("개 폴더 수집 실패: "), F.col("places"))


def idle_keys(events: DataFrame, key: str, ts: str, now, idle: str) -> DataFrame:
    """Keys whose last event is older than ``idle`` before ``now``."""
    return (
        events.groupBy(key)
        .agg(F.max(ts).alias("last_ts"))
        .filter(F.col("last_ts") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {idle}"))
    )


def lost_prompts(rows: DataFrame) -> DataFrame:
    """Per file, prompts overwritten by the next prompt before any answer."""
    return rows.filter("row_kind = 'lost'").groupBy("path").agg(F.count(F.lit(1)).alias("n_lost"))


def quarantined(parsed: DataFrame) -> DataFrame:
    """Where the lines stand that fit no format. Their text is left out: it was never masked."""
    return parsed.filter(~F.col("valid")).select("path", "byte_offset")
