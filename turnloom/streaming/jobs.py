"""Streaming jobs.

``collect_stream`` is the default: the stream is a clock, and each micro-batch is one resumable pass, whether files
grew or only came to rest. State between batches is the cursor table; no raw text is kept anywhere.

``settled_stream`` keeps the lines of the open turn of each file in state until the turn settles. It
answers without a second read, at the price of raw text in the state store and of one file being
handled by one task.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from turnloom.plans import block_log
from turnloom.plans.collect import Job, run_once

IDLE_MS = 10 * 60 * 1000

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELEASED = "path string, byte_offset bigint, line string, complete boolean"


def collect_stream(
    spark: SparkSession, job: Job, registry: DataFrame, tokens: DataFrame, now=None, trigger: dict | None = None
) -> StreamingQuery:
    """Run one pass per micro-batch. A replayed batch redoes the pass of the same id, which overwrites
    that pass's own spool folder: nothing doubles, nothing is lost. Give the stream a state folder of
    its own, because its pass ids (batch numbers) do not sort among those of scheduled runs."""

    def one_pass(batch: DataFrame, batch_id: int) -> None:
        at = now or spark.sql("select string(current_timestamp())").first()[0]
        run_once(batch.sparkSession, job, registry, tokens, at, f"s{batch_id:012d}")

    # One row a trigger: files that rest for long enough settle their last turn without growing, so every tick counts.
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return (
        ticks.writeStream.foreachBatch(one_pass)
        .option("checkpointLocation", job.table("stream"))
        .trigger(**(trigger or {"processingTime": "15 minutes"}))
        .start()
    )


class OpenTurns(StatefulProcessor):
    """State of one file: the lines of its open turn as a list, and what is known of the turn. Nothing is kept between turns.

    A timer stands at the file's last change plus the idle time while the turn's last answer is terminal; lines that arrive
    before set it anew. A turn is released by the next prompt or by the timer.
    """

    def __init__(self, idle_ms: int = IDLE_MS) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "byte_offset bigint, line string")
        self.turn = handle.getValueState("turn", "terminal boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("byte_offset")  # what one trigger brought of this file
        opened = self.turn.exists()
        terminal = self.turn.get()[0] if opened else False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        held: list[tuple] = []
        for offset, line, is_prompt, stop in zip(new.byte_offset, new.line, new.is_prompt, new.stop_reason):
            if is_prompt:
                if opened:
                    yield self._released(key, held)
                held, opened, terminal = [], True, False
            elif isinstance(stop, str):
                terminal = stop in block_log.TERMINAL_STOPS
            if opened:
                held.append((int(offset), line))
        if opened:
            if held:
                self.lines.appendList(held)
            self.turn.update((bool(terminal),))
            if terminal:
                # The file rests from its last change on, not from the trigger that read it.
                self.handle.registerTimer(int(new.file_mtime.max().timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.turn.exists():
            yield self._released(key, [])
            self.turn.clear()

    def _released(self, key: tuple, more: list[tuple]) -> pd.DataFrame:
        """The lines held and some more; the list is empty afterwards."""
        rows = [*self.lines.get(), *more]
        self.lines.clear()
        return pd.DataFrame([(key[0], offset, line, True) for offset, line in rows], columns=["path", "byte_offset", "line", "complete"])

    def close(self) -> None:
        pass


def settled_lines(lines: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Stream of the lines of settled block-log turns. ``lines`` has path, file_size, file_mtime, byte_offset and line, as from
    ``growth.stream_grown_lines``.

    Timers are checked at every trigger, so the stream always has another one to run: give it an interval and stop it
    from outside. State lives in RocksDB, which this sets for the session.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    shaped = lines.select(
        "path",
        "file_size",
        "file_mtime",
        F.lit(0).cast("bigint").alias("start_offset"),
        "byte_offset",
        F.col("line"),
        F.col("line").alias("kept_line"),
        F.lit(True).alias("terminated"),
        F.lit(False).alias("file_idle"),
    )
    marks = block_log.prompt_marks(block_log.parse(shaped))
    return (
        marks.select("path", "byte_offset", F.col("kept_line").alias("line"), "is_prompt", "stop_reason", "file_mtime")
        .groupBy("path")
        .transformWithStateInPandas(OpenTurns(idle_ms), RELEASED, "append", "processingTime")
    )


def turns_of_released(released: DataFrame) -> DataFrame:
    """Pass rows of one micro-batch of ``settled_lines``: every released turn is complete."""
    sized = released.selectExpr(
        "path", "byte_offset + octet_length(line) + 1 as file_size", "0L as start_offset", "byte_offset", "line",
        "true as terminated", "true as file_idle",
    )
    return block_log.scan_complete_turns(sized)


def wait_until_settled(query: StreamingQuery, idle_seconds: float, most_seconds: float = 600) -> None:
    """Return when a stream of ``settled_lines`` has read what there is and all its timers had time to fire: triggers without
    new rows, for longer than the idle time."""
    quiet_from, seen, end = None, -1, time.monotonic() + most_seconds
    while time.monotonic() < end:
        if query.exception():
            raise query.exception()
        last = query.lastProgress
        if last and last["batchId"] != seen:
            seen, rows = last["batchId"], last["numInputRows"]
            if rows:
                quiet_from = None
            elif quiet_from is None:
                quiet_from = time.monotonic()
            elif time.monotonic() - quiet_from > idle_seconds + 1:
                return
        time.sleep(0.2)
    raise TimeoutError("the stream did not settle")
