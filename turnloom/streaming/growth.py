"""Lines of growing files as a stream whose offset is the version of a table.

``take_listing`` is an ordinary job: it walks the globs inside tasks, compares the listing with the one before by a join and
writes what grew as byte ranges, one folder a version. The stream reads these folders with Spark's own file source and
the bytes inside tasks. So no file is held on the driver, neither as a row nor as a dictionary entry, and how many ranges a
trigger takes is the file source's own limit. A line belongs to the version in which its LF arrives, so versions meet exactly, half-written
lines included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnloom.sources import files as fl
from turnloom.sources import tables

LISTING = "path string, file_size bigint, file_mtime timestamp"
RANGES = LISTING + ", start bigint, end bigint"
SCHEMA = LISTING + ", byte_offset bigint, line string, error string"
#: Bytes of one range; a task of the stream takes the ranges of one or more files of this many.
RANGE_BYTES = 64 << 20
_BLOCK = 4 << 20
_ROWS = pa.schema(
    [("path", pa.string()), ("file_size", pa.int64()), ("file_mtime", pa.timestamp("us", tz="UTC")), ("byte_offset", pa.int64()), ("line", pa.string()), ("error", pa.string())]
)


def grown(old: DataFrame, new: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges that a listing has beyond an earlier one. A file that became shorter was replaced and counts from its start."""
    before = old.select("path", F.col("file_size").alias("_size"))
    seen = F.when(F.col("_size") <= F.col("file_size"), F.col("_size")).otherwise(F.lit(0))
    more = new.join(before, "path", "left").withColumn("_from", F.coalesce(seen, F.lit(0))).filter("_from < file_size")
    pieces = more.selectExpr("path", "file_size", "file_mtime", "_from", f"explode(sequence(_from div {range_bytes}, (file_size - 1) div {range_bytes})) as k")
    return pieces.selectExpr("path", "file_size", "file_mtime", f"greatest(_from, k * {range_bytes}) as start", f"least(file_size, (k + 1) * {range_bytes}) as end")


def _newest(spark: SparkSession, table: str) -> int:
    done = [p for p in tables.subfolders(spark, table) if p.startswith("version=") and tables.complete(spark, f"{table}/{p}")]
    return max((int(p.removeprefix("version=")) for p in done), default=0)


def _version(number: int) -> str:
    return f"version={number:012d}"


def take_listing(spark: SparkSession, globs: list[str], state: str, range_bytes: int = RANGE_BYTES) -> int:
    """List the files and write the ranges that are new; returns the version.

    The listing is written first and never changes, and the ranges follow from it and the one before: a run that ended in
    between is made up for before the next listing is taken. Folders that cannot be listed are left for the next time.
    """
    listings, ranges = f"{state}/listings", f"{state}/ranges"
    newest = _newest(spark, listings)
    if newest > _newest(spark, ranges):
        _write_ranges(spark, listings, ranges, newest, range_bytes)
    now = newest + 1
    found = fl.list_files(spark, globs).filter("error IS NULL").select("path", "file_size", "file_mtime")
    found.write.mode("overwrite").parquet(f"{listings}/{_version(now)}")
    _write_ranges(spark, listings, ranges, now, range_bytes)
    tables.remove(spark, [f"{listings}/{p}" for p in tables.subfolders(spark, listings) if p < _version(newest)])
    return now


def _write_ranges(spark: SparkSession, listings: str, ranges: str, version: int, range_bytes: int) -> None:
    new = spark.read.schema(LISTING).parquet(f"{listings}/{_version(version)}")
    old = spark.read.schema(LISTING).parquet(f"{listings}/{_version(version - 1)}") if version > 1 else spark.createDataFrame([], LISTING)
    more = grown(old, new, range_bytes)
    size = more.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    # Files of about a range each: the stream's limit on files is then one on bytes, too.
    more.repartition(1 + size // range_bytes, "path", "start").write.mode("overwrite").parquet(f"{ranges}/{_version(version)}")


def ended_lines(path: str, start: int, end: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Lines whose LF lies in ``[start, end)``, as blocks of (offsets, lines without LF)."""
    with fl._open(path) as src:
        # The first line may have begun before `start`: step back to behind the previous LF.
        pos = start
        while pos > 0:
            back = max(0, pos - _BLOCK)
            src.seek(back)
            cut = src.read(pos - back).rfind(b"\n")
            if cut >= 0:
                pos = back + cut + 1
                break
            pos = back
        src.seek(pos)
        held: list[bytes] = []
        line_at = pos
        while pos < end:
            data = src.read(min(_BLOCK, end - pos))
            if not data:
                return
            *full, rest = data.split(b"\n")
            if full:
                full[0] = b"".join([*held, full[0]])
                offsets = [line_at]
                for piece in full[:-1]:
                    offsets.append(offsets[-1] + len(piece) + 1)
                yield offsets, full
                held, line_at = [], offsets[-1] + len(full[-1]) + 1
            if rest:
                held.append(rest)
            pos += len(data)
            if pos - line_at > fl.MAX_LINE_BYTES:
                raise fl.LineTooLong("line too long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            head = [row["path"], row["file_size"], row["file_mtime"]]

            def emit(offsets, lines, error=None, head=head):
                columns = [*([v] * len(offsets) for v in head), offsets, lines, [error] * len(offsets)]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)

            try:
                for offsets, lines in ended_lines(fl._local_uri(row["path"]), row["start"], row["end"]):
                    yield emit(offsets, [b.decode("utf-8", "replace") for b in lines])
            except OSError as e:
                yield emit([row["start"]], [None], str(e) if isinstance(e, fl.LineTooLong) else f"{type(e).__name__}: {e}")


def stream_grown_lines(spark: SparkSession, state: str, files_per_trigger: int = 256, tasks: int | None = None, clean: bool = False) -> DataFrame:
    """Stream of (path, file_size, file_mtime, byte_offset, line, error). A range that cannot be read is one row with ``error``
    and its start; it is not read again."""
    source = spark.readStream.schema(RANGES).option("maxFilesPerTrigger", files_per_trigger)
    if clean:
        source = source.option("cleanSource", "delete")
    ranges = source.parquet(f"{state}/ranges").select(*(c.split()[0] for c in RANGES.split(", ")))
    # Spread by hand: the file source would put all these tiny rows, and all reading behind them, into one task.
    spread = ranges.repartition(tasks or 2 * spark.sparkContext.defaultParallelism, "path", "start")
    return spread.mapInArrow(_read, SCHEMA)


def watch(spark: SparkSession, globs: list[str], state: str, trigger: dict | None = None) -> StreamingQuery:
    """Take a listing at every tick of a clock, for ``stream_grown_lines`` of the same folder to follow."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    spark.range(0).selectExpr("'' as path", "0L as file_size", "timestamp(null) as file_mtime", "0L as start", "0L as end").write.mode("ignore").parquet(f"{state}/ranges/{_version(0)}")
    return (
        ticks.writeStream.foreachBatch(lambda batch, _: take_listing(batch.sparkSession, globs, state))
        .option("checkpointLocation", f"{state}/clock").trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )
