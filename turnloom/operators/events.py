"""Operators on finished events: de-duplication, batches, spool order and delivery state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.wire import wire_struct
from turnloom.operators import ordered

BATCH_SIZE = 100
IDENTITY = ["employee_id", "source_tool", "content_hash"]


def first_writers(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key. One grouped aggregation: copies collapse on the map side, so a key that
    holds a third of all rows reaches its reducer as one row per task."""
    rest = [c for c in events.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return events.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*events.columns)


def dedup_events(events: DataFrame, stored: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """First writer per (employee, tool, content hash), minus identities already stored."""
    winners = first_writers(events, IDENTITY, order or ["path", "prompt_offset"])
    if stored is None:
        return winners
    return winners.join(stored.select(*IDENTITY), IDENTITY, "left_anti")


def ingest_counts(events: DataFrame, batch: str, order: list[str]) -> DataFrame:
    """Accepted and duplicate rows per batch; both sides are counted, no group is ever listed."""
    received = events.groupBy(batch).agg(F.count(F.lit(1)).alias("received"))
    accepted = first_writers(events.select(batch, *IDENTITY, *[c for c in order if c != batch]), IDENTITY, order)
    counted = accepted.groupBy(batch).agg(F.count(F.lit(1)).alias("accepted"))
    return received.join(counted, batch, "left").select(
        batch,
        F.coalesce("accepted", F.lit(0)).alias("accepted"),
        (F.col("received") - F.coalesce("accepted", F.lit(0))).alias("duplicates"),
    )


def assign_batches(
    spooled: DataFrame, unit: list[str], order: list[str], size: int = BATCH_SIZE
) -> DataFrame:
    """Number the requests inside each spool file: ``batch`` and the place ``seq`` within it.

    A spool file holds a bounded number of rows (the writer caps it), so the window is bounded however
    many events one owner has; batches never cross spool files.
    """
    place = F.row_number().over(Window.partitionBy(*unit).orderBy(*order)) - 1
    return (
        spooled.withColumn("_place", place)
        .withColumn("batch", F.expr(f"_place div {int(size)}"))
        .withColumn("seq", F.expr(f"_place % {int(size)}"))
        .drop("_place")
    )


def build_envelopes(batched: DataFrame, unit: list[str]) -> DataFrame:
    """One request body ``{"events": [...]}`` per batch; at most ``size`` events each."""
    rows = batched.select(*unit, "batch", F.struct("seq", wire_struct().alias("event")).alias("item"))
    ordered = F.transform(F.array_sort(F.collect_list("item")), lambda x: x.event)
    return rows.groupBy(*unit, "batch").agg(
        F.count(F.lit(1)).alias("n_events"), F.to_json(F.struct(ordered.alias("events"))).alias("payload")
    )


def accepted(send: Callable[[str, str, int, str], bool], *request) -> bool:
    """The sender took the request; one that breaks is a request that failed."""
    try:
        return bool(send(*request))
    except Exception:  # noqa: BLE001
        return False


OUTCOMES = "queue_slug string, spool_file string, batch bigint, ok boolean"


def drained(bodies: DataFrame, send: Callable[[str, str, int, str], bool]) -> DataFrame:
    """Send request bodies in order and report (queue_slug, spool_file, batch, ok) of each that was sent.

    A queue is sent file by file and batch by batch; at its first failure (``send`` says no or raises) the rest of it is
    left for the next run. Order within a queue is the point, so one task streams it; different queues run side by side.
    """

    def drain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = None
        for part in batches:
            out: list[tuple] = []
            for queue, file, batch, payload in zip(*(c.to_pylist() for c in part.columns)):
                if queue == failed:
                    continue
                ok = accepted(send, queue, file, batch, payload)
                out.append((queue, file, batch, ok))
                failed = failed if ok else queue
            columns = list(zip(*out)) if out else [[]] * 4
            types = [pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["queue_slug", "spool_file", "batch", "ok"])

    ordered = bodies.repartition("queue_slug").sortWithinPartitions("queue_slug", "spool_file", "batch")
    return ordered.select("queue_slug", "spool_file", F.col("batch").cast("bigint"), "payload").mapInArrow(drain, OUTCOMES)


def pending(spooled: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """Spooled rows whose spool file was not delivered yet."""
    return spooled.join(delivered.select(*keys).distinct(), keys, "left_anti")


def delivered_files(outcomes: DataFrame, queue: str = "queue_slug", file: str = "spool_file") -> DataFrame:
    """Spool files that count as delivered, from (queue, file, batch, ok) outcomes.

    A file is done when all its batches are, and only before the first failing file of its queue: the
    failing one and everything after it are kept for the next run.
    """
    failed = outcomes.filter(~F.col("ok")).groupBy(queue).agg(F.min(file).alias("_first_failed"))
    files = outcomes.select(queue, file).distinct()
    return (
        files.join(failed, queue, "left")
        .filter(F.col("_first_failed").isNull() | (F.col(file) < F.col("_first_failed")))
        .select(queue, file)
    )


def in_scan_order(events: DataFrame, adapters: list[str], out: str = "position") -> DataFrame:
    """events with their place in the final order: adapter (as listed, others behind), path, prompt."""
    listed = F.array_position(F.array(*map(F.lit, adapters)), F.col("source_tool"))
    rank = F.when(listed > 0, listed).otherwise(F.lit(len(adapters) + 1))
    return ordered.row_numbers(events.withColumn("_rank", rank), ["_rank", "path", "prompt_offset"], out).drop("_rank")


def write_in_scan_order(events: DataFrame, adapters: list[str], folder: str, rows_per_file: int = 1_000_000) -> None:
    """Write events as JSON lines, in files whose names sort as the events do. Only for presentation; nothing upstream needs it."""
    placed = in_scan_order(events, adapters)
    n = 1 + placed.count() // rows_per_file
    # Each task writes one range of positions, and tasks number their files.
    placed.repartitionByRange(n, "position").sortWithinPartitions("position").write.mode("overwrite").json(folder)
