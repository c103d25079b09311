"""Delivery as a stream: spool files as they come, a bounded number a trigger, each request handed over once and in order.

The file source knows which spool files were taken. What could not be sent of them is kept as request bodies beside the outcomes of the
micro-batch that took them (``kept=true``), written once and read again only when their queue opens. The table ``held`` has the place where each
closed queue stands: the one body that is tried first in every micro-batch. So a queue that stays closed costs one request a micro-batch,
however much waits behind it. A micro-batch that is replayed finds the outcomes it wrote and sends nothing again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnloom.functions.wire import from_wire
from turnloom.operators import events as ev
from turnloom.plans.collect import Job
from turnloom.sources import tables

FILES_PER_TRIGGER = 1000
KEYS = ["queue_slug", "spool_file"]
BODIES = "queue_slug string, spool_file string, batch bigint, n_events bigint, payload string"
# ``arrival`` is the micro-batch that took the file; ``payload`` is there unless the body was sent, ``ok`` unless it was not tried.
TRIED = "queue_slug string, spool_file string, batch bigint, n_events bigint, arrival bigint, ok boolean, payload string"
_TRIED_SCHEMA = pa.schema(
    [("queue_slug", pa.string()), ("spool_file", pa.string()), ("batch", pa.int64()), ("n_events", pa.int64()), ("arrival", pa.int64()), ("ok", pa.bool_()), ("payload", pa.string())]
)


def spool_stream(spark: SparkSession, job: Job, files_per_trigger: int = FILES_PER_TRIGGER, archive: str | None = None, clean: bool = False) -> DataFrame:
    """Spooled rows with ``spool_file``, oldest files first. Files that were taken stay, or with ``clean`` go (to the folder ``archive``, if one is named)."""
    reader = spark.readStream.schema(tables.SPOOL).option("maxFilesPerTrigger", files_per_trigger)
    if clean:
        reader = reader.option("cleanSource", "archive" if archive else "delete")
        reader = reader.option("sourceArchiveDir", archive) if archive else reader
    return reader.parquet(job.table("spool")).withColumn("spool_file", F.concat_ws("/", "pass_id", "_metadata.file_name"))


def _folder(table: str, stream: str, batch_id: int) -> str:
    return f"{table}/run_id={stream}-{batch_id:012d}"


def _try(bodies: DataFrame, send: Callable[[str, str, int, str], bool], batch_id: int, place: str) -> None:
    """Send bodies (with ``arrival`` and ``closed``) queue by queue up to its first failure, and write at ``place`` what came of it.

    One row for each that was sent or refused, and for each of this micro-batch that was left; what was kept earlier and is left stays where it lies.
    """

    def drain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed: object = batches  # no queue yet
        for part in batches:
            out: list[tuple] = []
            for queue, file, batch, n, arrival, closed, payload in zip(*(c.to_pylist() for c in part.columns)):
                if closed or queue == failed:
                    if arrival == batch_id:
                        out.append((queue, file, batch, n, arrival, None, payload))
                    continue
                ok = ev.accepted(send, queue, file, batch, payload)
                out.append((queue, file, batch, n, arrival, ok, None if ok else payload))
                failed = failed if ok else queue
            columns = list(zip(*out)) if out else [[]] * len(_TRIED_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TRIED_SCHEMA)], schema=_TRIED_SCHEMA)

    ordered = bodies.repartition("queue_slug").sortWithinPartitions("queue_slug", "arrival", "spool_file", "batch")
    tried = ordered.select(*KEYS, F.col("batch").cast("bigint"), F.col("n_events").cast("bigint"), F.col("arrival").cast("bigint"), "closed", "payload").mapInArrow(drain, TRIED)
    kept = tried.withColumn("taken_in", F.lit(batch_id).cast("bigint")).withColumn("kept", F.col("payload").isNotNull())
    kept.write.mode("overwrite").partitionBy("kept").parquet(place)


def _kept(spark: SparkSession, places: list[str], opened: DataFrame) -> DataFrame:
    """Bodies that micro-batches kept, of queues whose first one was just sent: those behind it."""
    found = [f"{place}/kept=true" for place in places if "kept=true" in tables.subfolders(spark, place)]
    rows = spark.read.schema(f"{TRIED}, taken_in bigint").parquet(*found) if found else spark.createDataFrame([], f"{TRIED}, taken_in bigint")
    at = ["arrival", "spool_file", "batch"]
    heads = opened.select(F.col("queue_slug").alias("_queue"), F.struct(*at).alias("_head"))
    behind = F.col("queue_slug").eqNullSafe(F.col("_queue")) & (F.struct(*at) > F.col("_head"))
    # A body that was refused after it had been kept is there twice; the copy in its own micro-batch counts.
    return rows.filter("arrival = taken_in").join(heads, behind).select(*KEYS, "batch", "n_events", "payload", "arrival")


def hand_over(spark: SparkSession, job: Job, stream: str, batch: DataFrame, batch_id: int, send: Callable[[str, str, int, str], bool]) -> None:
    """One micro-batch: first the body at which each closed queue stands, then of the queues that are open what is kept and the new files, queue by
    queue up to its first failure; the rest of the new files is kept.

    Order of the writes: outcomes, then the places of closed queues and the log of delivered files, both of which follow from outcomes and
    can be written again; the quarantine follows from the files alone.
    """
    sent, held = _folder(job.table("outcomes"), stream, batch_id), job.table("held")
    now = _folder("", stream, batch_id)[1:]
    earlier = [f for f in tables.subfolders(spark, held) if f.startswith(f"run_id={stream}-") and f < now]
    read = lambda place: spark.read.schema(TRIED).parquet(place).select(_TRIED_SCHEMA.names)
    heads = read(f"{held}/{earlier[-1]}") if earlier else None
    since = heads.agg(F.min("arrival")).first()[0] if earlier else None  # where the oldest kept body lies
    rows = from_wire(batch)
    bodies = ev.build_envelopes(ev.assign_batches(rows.filter("source_tool IS NOT NULL"), KEYS, ["path", "prompt_offset"]), KEYS)
    bodies = bodies.select(*(c.split()[0] for c in BODIES.split(", ")), F.lit(batch_id).cast("bigint").alias("arrival"))
    aside = _folder(job.table("quarantine"), stream, batch_id)
    unreadable = rows.filter("source_tool IS NULL AND spool_file <> ''").select(*KEYS, "path", "prompt_offset")
    with ThreadPoolExecutor(2) as pool:
        put = lambda df, place: pool.submit(df.write.mode("overwrite").parquet, place)
        set_aside = put(unreadable, aside)
        again, moved = None, False
        if since is not None:
            if not tables.complete(spark, f"{sent}-first"):
                _try(heads.withColumn("closed", F.lit(False)), send, batch_id, f"{sent}-first")
            again = read(f"{sent}-first")
            moved = not again.filter("ok").isEmpty()
        if not tables.complete(spark, sent):
            bodies = bodies.withColumn("closed", F.lit(False))
            if moved:
                places = [_folder(job.table("outcomes"), stream, i) for i in range(since, batch_id)]
                bodies = bodies.unionByName(_kept(spark, places, again.filter("ok")).withColumn("closed", F.lit(False)))
            if again is not None:
                shut = again.filter("NOT ok").select(F.col("queue_slug").alias("_queue"))
                bodies = bodies.join(shut.withColumn("_shut", F.lit(True)), F.col("queue_slug").eqNullSafe(F.col("_queue")), "left")
                bodies = bodies.withColumn("closed", F.coalesce("_shut", "closed")).drop("_queue", "_shut")
            _try(bodies, send, batch_id, sent)
        tried = read(sent) if again is None else read(sent).unionByName(again)
        standing = put(tried.filter("NOT ok").coalesce(1), f"{held}/{now}")
        set_aside.result()
        empty = spark.read.schema("queue_slug string, spool_file string").parquet(aside).withColumn("ok", F.lit(True))
        taken = tried.select(*KEYS, "ok").unionByName(empty).groupBy(*KEYS).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
        taken.filter("ok").select(*KEYS).write.mode("overwrite").parquet(f"{job.table('delivered')}/pass_id={stream}-{batch_id:012d}")
        standing.result()
    # A replay of this micro-batch still reads the newest of the earlier folders; older ones are done with, and so are bodies before the oldest kept one.
    gone = [f"{held}/{f}" for f in earlier[:-1]]
    if again is not None:
        gone += [f"{_folder(job.table('outcomes'), stream, batch_id - 1)}-first/kept=true"]
    if moved:
        first = read(f"{held}/{now}").agg(F.min("arrival")).first()[0]
        gone += [f"{_folder(job.table('outcomes'), stream, i)}/kept=true" for i in range(since, batch_id if first is None else first)]
    tables.remove(spark, gone)


def deliver_stream(
    spark: SparkSession, job: Job, send: Callable[[str, str, int, str], bool], stream: str = "delivery", trigger: dict | None = None, **source
) -> StreamingQuery:
    """Deliver the spool as a stream named ``stream``; ``source`` goes to ``spool_stream``.

    Every trigger is a micro-batch, new files or not, so that a queue which failed is tried again. Run it instead of
    ``collect.deliver``: both keep their own account of what was sent. A pass that is redone after its files were taken
    writes new files, which are taken too; let the pass leave out what was emitted (``Job.identity_buckets``).
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    spool = spool_stream(spark, job, **source)
    nothing = ticks.select(*(F.lit(None).cast(t).alias(c) for c, t in spool.dtypes)).filter("false")

    def one(batch: DataFrame, batch_id: int) -> None:
        hand_over(batch.sparkSession, job, stream, batch, batch_id, send)

    return (
        spool.unionByName(nothing).writeStream.queryName(stream).foreachBatch(one)
        .option("checkpointLocation", f"{job.table('stream')}/{stream}").trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )
