"""One bounded pass: list, resume, assemble, mask, spool, advance cursors, deliver."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import scrub
from turnloom.functions.wire import content_hash, to_wire
from turnloom.operators import cursors as cur
from turnloom.operators import events as ev
from turnloom.operators import registry as reg
from turnloom.plans import block_log, rollout_log
from turnloom.plans.chunks import CHUNK_BYTES, spans_chunks
from turnloom.schemas import EVENT_COLUMNS
from turnloom.sources import files as fl
from turnloom.sources import tables
from turnloom.sources.identities import IdentityStore, identity


class LogFormat(Protocol):
    """What a log format brings: a name, where its files lie and how lines become pass rows.

    A format whose files are rewritten sets ``WHOLE_FILES`` and has ``read_files(files, known, now)`` in place of the two scans; its files
    are opened when their listing changed, and what is new in them is told by identity.
    """

    SOURCE_TOOL: str
    FILE_GLOB: str
    READS_FROM_START: bool
    NEEDS_HEADER: bool

    def scan_whole_files(self, lines: DataFrame, chunk_bytes: int) -> DataFrame: ...

    def scan_chunked_files(self, lines: DataFrame, chunk_bytes: int) -> DataFrame: ...

    def owner_dir(self, path: Column) -> Column: ...


FORMATS: tuple[LogFormat, ...] = (block_log, rollout_log)


@dataclass(frozen=True)
class Job:
    """Where a pass reads and keeps its tables. ``globs`` maps a format's name to file globs.

    With ``identity_buckets`` (about one for each 100 MB of identities, 32 bytes each) a pass spools only events that no
    earlier pass has spooled; without, repeats are left to ``stored_events`` and to the receiver. ``formats`` are the log formats
    to collect: a caller's own module or object stands beside the built-in ones.
    """

    globs: dict[str, list[str]]
    state: str
    client_version: str
    chunk_bytes: int = CHUNK_BYTES
    identity_buckets: int | None = None
    formats: tuple = FORMATS

    @property
    def identities(self) -> IdentityStore:
        return IdentityStore(self.table("identities"), self.identity_buckets or 1)

    def table(self, name: str) -> str:
        return f"{self.state}/{name}"


def assemble(files: DataFrame, fmt: LogFormat, now, chunk_bytes: int) -> DataFrame:
    """Pass rows of ``files`` (with ``start_offset``); small and large files are read apart.

    A file whose cursor stands at its end has nothing new and nothing held: it is not opened.
    """
    lower = "0L" if fmt.READS_FROM_START else "start_offset"
    grown = files.filter("file_size > start_offset").withColumn("large", F.expr(spans_chunks(chunk_bytes, lower)))
    todo = grown.groupBy("large").agg(F.expr(f"sum(file_size - {lower})")).collect()  # at most two rows
    parts = []
    for large, n_bytes in todo or [(False, 0)]:
        tasks = fl.scan_tasks(files.sparkSession, n_bytes)
        part = grown.filter(F.col("large") == large).drop("large")
        lines = fl.read_lines(part, chunk_bytes, fmt.READS_FROM_START, tasks).withColumn("file_idle", fl.is_idle(now))
        scan = fmt.scan_chunked_files if large else fmt.scan_whole_files
        parts.append(scan(lines, chunk_bytes))
    return reduce(DataFrame.unionByName, parts)


def finish(rows: DataFrame, client_version: str) -> DataFrame:
    """Mask both texts and stamp the version. Nothing is stored before this step."""
    return (
        rows.withColumn("prompt_text", scrub(F.col("prompt_text")))
        .withColumn("response_text", scrub(F.col("response_text")))
        .withColumn("client_version", F.lit(client_version))
    )


def collect_format(
    spark: SparkSession, job: Job, fmt: LogFormat, entries: DataFrame, held: DataFrame, now, pass_id: str
) -> None:
    """Read one format's files once and stage masked rows; owners are settled per file, not per event."""
    found = fl.list_files(spark, job.globs.get(fmt.SOURCE_TOOL, []))
    # Machine-wide logs are collected only for an owner that holds a token.
    owned = reg.attribute_files(found, entries, fmt.owner_dir(F.col("path")), held if fmt.NEEDS_HEADER else None)
    cursors = tables.read_cursors(spark, job.table("cursors"), before=pass_id)
    stage = f"{job.table('stage')}/pass_id={pass_id}/format={fmt.SOURCE_TOOL}"
    # One listing serves the whole pass: sizes must not move between reading and cursors.
    wanted = owned.select("path", "file_size", "file_mtime", "queue_slug", "error")
    fl.with_cursors(wanted, cursors).write.mode("overwrite").parquet(f"{stage}/listing")
    listing = spark.read.parquet(f"{stage}/listing")
    pinned = listing.filter("error IS NULL").drop("error")
    if getattr(fmt, "WHOLE_FILES", False):
        seen = tables.read_seen(spark, f"{job.table('seen')}/format={fmt.SOURCE_TOOL}", before=pass_id)
        fl.changed(pinned.select("path", "file_size", "file_mtime"), seen, now).write.mode("overwrite").parquet(f"{stage}/opened")
        read_now = spark.read.parquet(f"{stage}/opened")
        rows = fmt.read_files(read_now, seen, now)
    else:
        read_now = pinned.filter("file_size > start_offset OR file_size = 0")
        rows = assemble(pinned.drop("queue_slug"), fmt, now, job.chunk_bytes)
    finish(rows, job.client_version).write.mode("overwrite").parquet(f"{stage}/rows")
    staged = spark.read.parquet(f"{stage}/rows")
    errors = cur.file_errors(read_now, staged, fmt.SOURCE_TOOL, fmt.NEEDS_HEADER)
    unlisted = listing.filter("error IS NOT NULL").select("path", F.lit(fmt.SOURCE_TOOL).alias("adapter"), F.lit("glob").alias("reason"))
    errors.unionByName(unlisted).write.mode("overwrite").parquet(f"{stage}/errors")


def staged(spark: SparkSession, job: Job, pass_id: str, tool: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{job.table('stage')}/pass_id={pass_id}/format={tool}/{name}")


def run_once(spark: SparkSession, job: Job, registry: DataFrame, tokens: DataFrame, now, pass_id: str) -> None:
    """One pass over all formats. ``pass_id`` must sort by time; repeating one redoes it.

    The order is what keeps events safe: spool first, cursors second. A crash in between reads the
    same lines again, which the content hash absorbs; it never skips any.
    """
    if not job.identity_buckets and any(getattr(fmt, "WHOLE_FILES", False) for fmt in job.formats):
        raise ValueError("formats whose files are read whole need Job.identity_buckets")
    entries, held = reg.unique_entries(registry), reg.held_tokens(tokens)
    clashes = entries.filter("conflict").select(
        F.col("config_dir").alias("path"), F.lit("registry").alias("adapter"), F.lit("several token keys").alias("reason")
    )
    clashes.write.mode("overwrite").parquet(f"{job.table('stage')}/pass_id={pass_id}/format=registry/errors")
    with ThreadPoolExecutor(len(job.formats)) as pool:
        running = [pool.submit(collect_format, spark, job, fmt, entries, held, now, pass_id) for fmt in job.formats]
        for one in running:
            one.result()
    spooled, moved = None, None
    for fmt in job.formats:
        listing, rows, errors = (staged(spark, job, pass_id, fmt.SOURCE_TOOL, n) for n in ("listing", "rows", "errors"))
        files = listing.filter("error IS NULL")
        good = rows.filter("row_kind = 'turn'").join(errors.select("path"), "path", "left_anti")
        owned = good.join(files.select("path", "queue_slug"), "path")
        spooled = owned if spooled is None else spooled.unionByName(owned)
        known = files.select("path", "start_offset")
        # Only cursors that moved are written, so the log grows with activity, not with the fleet.
        cursors = cur.new_cursors(files, rows, errors).join(known, "path").filter("cursor <> start_offset").drop("start_offset")
        moved = cursors if moved is None else moved.unionByName(cursors)
    hashed = to_wire(spooled.withColumn("content_hash", content_hash()))
    if job.identity_buckets:
        remember(spark, job, pass_id)
        hashed = job.identities.fresh(hashed.withColumn("identity", identity()), ["path", "prompt_offset"], pass_id)
    tables.write_spool(
        hashed.select("event_json", "path", "prompt_offset", "content_hash", "queue_slug"), job.table("spool"), pass_id
    )
    if job.identity_buckets:
        job.identities.record(spooled_identities(spark, job, pass_id), pass_id)
    tables.write_cursors(moved, job.table("cursors"), pass_id, now)
    for fmt in job.formats:
        if getattr(fmt, "WHOLE_FILES", False):
            opened, rows, errors = (staged(spark, job, pass_id, fmt.SOURCE_TOOL, n) for n in ("opened", "rows", "errors"))
            sessions = rows.filter("row_kind = 'header'").select("path", "session_id")
            noted = opened.join(errors.select("path"), "path", "left_anti").join(sessions, "path", "left")
            tables.write_seen(noted, f"{job.table('seen')}/format={fmt.SOURCE_TOOL}", pass_id, now)


def spooled_identities(spark: SparkSession, job: Job, pass_id: str) -> DataFrame:
    """Identities of what a pass spooled; only the two columns they are made of are read."""
    spool = tables.read_spool(spark, job.table("spool"), pass_id).filter(F.col("pass_id") == pass_id)
    return spool.select(identity().alias("identity"))


def remember(spark: SparkSession, job: Job, before: str) -> None:
    """Record the identities of earlier passes that ended between their spool and their identities."""
    known = set(job.identities.passes(spark))
    for folder in tables.subfolders(spark, job.table("spool")):
        done = folder.removeprefix("pass_id=")
        if folder.startswith("pass_id=") and done < before and done not in known and tables.complete(spark, f"{job.table('spool')}/{folder}"):
            job.identities.record(spooled_identities(spark, job, done), done)


def errors_of(spark: SparkSession, job: Job, pass_id: str) -> DataFrame:
    """Files, globs and registry entries a pass had to leave out."""
    parts = [staged(spark, job, pass_id, tool, "errors") for tool in (*(f.SOURCE_TOOL for f in job.formats), "registry")]
    return reduce(DataFrame.unionByName, parts)


def deliver(
    spark: SparkSession, job: Job, run_id: str, send: Callable[[str, str, int, str], bool], since: str = ""
) -> str:
    """Hand pending request bodies to ``send(queue, spool_file, batch, body)``, which runs inside tasks.

    Each queue is sent in order up to its first failure. What was sent, and how it went, is written once and everything
    else follows from that table; a run that is repeated under its id sends nothing again. Files before the first
    failing one of their queue are logged as delivered, the rest stays pending. Spooled rows that do not decode go to the
    quarantine table, with their place but without their text. Returns the oldest pass that still has
    pending files: the ``since`` of the next call, and the bound for ``tidy``.
    """
    keys = ["queue_slug", "spool_file"]
    spool = tables.spooled_events(spark, job.table("spool"), since)
    left = ev.pending(spool, tables.read_delivered(spark, job.table("delivered")), keys)
    sent = f"{job.table('outcomes')}/run_id={run_id}"
    if not tables.complete(spark, sent):
        batched = ev.assign_batches(left.filter("source_tool IS NOT NULL"), keys, ["path", "prompt_offset"])
        ev.drained(ev.build_envelopes(batched, keys), send).write.mode("overwrite").parquet(sent)
    outcomes = spark.read.schema(ev.OUTCOMES).parquet(sent)
    unreadable = left.filter("source_tool IS NULL").select(*keys, "path", "prompt_offset")
    unreadable.write.mode("overwrite").parquet(f"{job.table('quarantine')}/run_id={run_id}")
    # A file without a single readable row has nothing to wait for.
    empty = left.groupBy(*keys).agg(F.max(F.col("source_tool").isNotNull()).alias("any")).filter("NOT any").select(*keys)
    done = ev.delivered_files(outcomes).unionByName(empty)
    done.write.mode("overwrite").parquet(f"{job.table('delivered')}/pass_id={run_id}")
    files = tables.read_spool(spark, job.table("spool"), since).select("pass_id", *keys).distinct()
    waiting = ev.pending(files, tables.read_delivered(spark, job.table("delivered")), keys)
    newest = files.agg(F.max("pass_id")).first()[0] or since
    return waiting.agg(F.min("pass_id")).first()[0] or newest


def tidy(spark: SparkSession, job: Job, since: str) -> None:
    """Remove staged and spooled folders of the passes before ``since`` (all delivered), and fold the cursor log."""
    for name in ("stage", "spool"):
        old = [p for p in tables.subfolders(spark, job.table(name)) if p.startswith("pass_id=") and p.removeprefix("pass_id=") < since]
        tables.remove(spark, [f"{job.table(name)}/{p}" for p in old])
    tables.compact_cursors(spark, job.table("cursors"))


def stored_events(spark: SparkSession, job: Job, columns: list[str] | None = None) -> DataFrame:
    """Spooled events without duplicates: the first writer of each content hash and owner."""
    events = tables.spooled_events(spark, job.table("spool"))
    named = events.withColumn("employee_id", F.col("queue_slug"))
    return ev.dedup_events(named, order=["path", "prompt_offset", "pass_id"]).select(*(columns or EVENT_COLUMNS))
