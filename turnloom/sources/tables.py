"""Job state as tables in the shared folder: registry, cursors, spool, delivery log.

Every write goes to a folder named after its pass, so a retried pass overwrites its own output only
and Spark's commit protocol makes each write all-or-nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.wire import from_wire
from turnloom.schemas import CURSORS, REGISTRY, SEEN

SPOOL_FILE_ROWS = 100_000  # a multiple of the batch size, so only a file's last batch is short

SPOOL = "event_json string, path string, prompt_offset bigint, content_hash string, queue_slug string, pass_id string"
DELIVERED = "queue_slug string, spool_file string, pass_id string"


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the registry file, a JSON array; no file means no entries."""
    try:
        raw = spark.read.schema(REGISTRY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], REGISTRY)
    return raw.select(F.col("configDir").alias("config_dir"), F.col("tokenKey").alias("token_key"))


def write_registry(registry: DataFrame, path: str, version: str) -> None:
    """Store the entries as a new version; readers name the version they want."""
    wire = registry.select(F.col("config_dir").alias("configDir"), F.col("token_key").alias("tokenKey"))
    wire.write.mode("overwrite").json(f"{path}/version={version}")


def read_cursors(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """Latest cursor per file. Passes append; pass ids sort by time, the newest wins.

    ``before`` leaves out a pass and later ones: a pass that is redone must start where it first did,
    or it would find nothing new and overwrite its spool with nothing.
    """
    log = _read(spark, path, CURSORS + ", pass_id string")
    if before is not None:
        log = log.filter(F.col("pass_id") < before)
    latest = F.max_by(F.struct("cursor", "legacy_offset", "updated_at"), "pass_id").alias("c")
    return log.groupBy("path").agg(latest).select("path", "c.*")


def compact_cursors(spark: SparkSession, path: str) -> None:
    """Fold all passes but the newest into one folder that sorts where the last of them stood.

    The folded log is written before the old folders go, so a crash in between leaves both, which agree. The newest
    pass stays as it is, because it may have to be redone from what came before it.
    """
    folders = [p for p in subfolders(spark, path) if p.startswith("pass_id=")]
    old = folders[:-1]
    if len(old) < 2:
        return
    newest = folders[-1].removeprefix("pass_id=")
    read_cursors(spark, path, before=newest).write.mode("overwrite").parquet(f"{path}/{old[-1]}+")
    remove(spark, [f"{path}/{p}" for p in old])


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names below a job's folder, sorted. One for each pass that was not tidied away, so they are few."""
    fs, folder = _store(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()) if fs.exists(folder) else []


def complete(spark: SparkSession, path: str) -> bool:
    """A table's write was committed."""
    fs, marker = _store(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, folder = _store(spark, path)
        fs.delete(folder, True)


def write_cursors(cursors: DataFrame, path: str, pass_id: str, now) -> None:
    """Advance cursors. Call only after the spool of the same pass has been written."""
    cursors.select(
        "path",
        F.col("cursor").cast("string").alias("cursor"),
        F.col("cursor").cast("bigint").alias("legacy_offset"),
        F.lit(now).cast("timestamp").alias("updated_at"),
    ).write.mode("overwrite").parquet(f"{path}/pass_id={pass_id}")


def write_spool(events: DataFrame, path: str, pass_id: str) -> None:
    """Spool finished events, one folder per pass and queue, files of a bounded number of rows.

    Rebalancing by queue keeps small queues in one file each and splits a queue that owns a large part
    of all events over many tasks.
    """
    (
        events.hint("rebalance", "queue_slug")
        .sortWithinPartitions("queue_slug", "path", "prompt_offset")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", SPOOL_FILE_ROWS)
        .partitionBy("queue_slug")
        .parquet(f"{path}/pass_id={pass_id}")
    )


def read_spool(spark: SparkSession, path: str, since: str = "") -> DataFrame:
    """Spooled events with ``spool_file``, whose order is the order of passes and files.

    ``since`` leaves out the folders of older passes without opening them.
    """
    raw = _read(spark, path, SPOOL).filter(F.col("pass_id") >= since)
    if not subfolders(spark, path):
        return raw.withColumn("spool_file", F.lit("").cast("string"))
    return raw.withColumn("spool_file", F.concat_ws("/", "pass_id", "_metadata.file_name"))


def spooled_events(spark: SparkSession, path: str, since: str = "") -> DataFrame:
    """Spooled events decoded; rows whose JSON does not decode have no ``source_tool``."""
    return from_wire(read_spool(spark, path, since))


def read_seen(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """Each file as it was when it was last opened, see ``files.changed``."""
    log = _read(spark, path, SEEN + ", pass_id string")
    if before is not None:
        log = log.filter(F.col("pass_id") < before)
    return log.groupBy("path").agg(F.max_by(F.struct("file_size", "file_mtime", "seen_at", "session_id"), "pass_id").alias("s")).select("path", "s.*")


def write_seen(opened: DataFrame, path: str, pass_id: str, now) -> None:
    """Note opened files (path, file_size, file_mtime, session_id). Call only after the spool of the same pass has been written."""
    stamped = opened.withColumn("seen_at", F.lit(now).cast("timestamp"))
    stamped.select("path", "file_size", "file_mtime", "seen_at", "session_id").write.mode("overwrite").parquet(f"{path}/pass_id={pass_id}")


def read_delivered(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, DELIVERED)
