"""Session files: listing, byte-exact line reading and effective cursors.

``spark.read.text`` gives no byte offsets, always reads a file from its start and fails the job on a
file that vanished. Lines are therefore read from an explicit plan of byte ranges, a DataFrame of
``(path, start, end)`` rows: only new bytes are read, ranges never depend on the cluster size, and a
broken file becomes an error row.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.plans.chunks import CHUNK_BYTES
from turnloom.schemas import RAW_LINES

IDLE = "10 minutes"
SCAN_BYTES_PER_TASK = 128 * 1024 * 1024

# A longer line does not fit one VARIANT value; the file becomes an error and keeps its cursor.
MAX_LINE_BYTES = 120 * 1024 * 1024

WALK = "glob string, path string, file_size bigint, file_mtime timestamp, error string"
_WALK_SCHEMA = pa.schema(
    [("glob", pa.string()), ("path", pa.string()), ("file_size", pa.int64()), ("file_mtime", pa.timestamp("us", tz="UTC")), ("error", pa.string())]
)

_BLOCK = 8 * 1024 * 1024
_BATCH_ROWS = 8192


def _alternatives(glob: str) -> list[str]:
    """A glob without braces for each choice of its ``{a,b}`` parts."""
    m = re.search(r"\{([^{}]*)\}", glob)
    return [x for part in m[1].split(",") for x in _alternatives(glob[: m.start()] + part + glob[m.end() :])] if m else [glob]


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _matching(name: str, last: bool):
    """One step of the walk: the entries of each folder that match one part of the glob."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["error"] is not None:
                    out.append(tuple(row.values()))
                    continue
                base = row["path"].rstrip("/")
                try:
                    fs, inner = pafs.FileSystem.from_uri(_local_uri(base)) if ":/" in base else (pafs.LocalFileSystem(), base)
                    for info in fs.get_file_info(pafs.FileSelector(inner or "/", allow_not_found=True)):
                        wanted = info.type == (pafs.FileType.File if last else pafs.FileType.Directory)
                        if wanted and fnmatch.fnmatchcase(info.base_name, name):
                            size, mtime = (info.size, info.mtime) if last else (None, None)
                            out.append((row["glob"], f"{base}/{info.base_name}", size, mtime, None))
                except OSError as e:
                    if not isinstance(e, NotADirectoryError):
                        out.append((row["glob"], base, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out)) if out else [[]] * len(_WALK_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WALK_SCHEMA)], schema=_WALK_SCHEMA)

    return step


def list_files(spark: SparkSession, globs: list[str] | str) -> DataFrame:
    """Path, size and change time of every file, empty and hidden ones too; contents are not read.

    Each glob is walked on its own, folder by folder, inside tasks: one that matches nothing has no rows, and a
    folder that cannot be listed is a row with ``error`` set, which takes nothing away from the others. A file that
    several globs match is listed once.
    """
    found = spark.createDataFrame([], WALK)
    tasks = spark.sparkContext.defaultParallelism
    for glob in [g for given in ([globs] if isinstance(globs, str) else globs) for g in _alternatives(given)]:
        parts = glob.split("/")
        first = next((i for i, x in enumerate(parts) if re.search(r"[*?\[]", x)), len(parts) - 1)
        base = _qualified(spark, "/".join(parts[:first]) or "/")
        folders = spark.createDataFrame([(glob, base, None, None, None)], WALK)
        for i in range(first, len(parts)):
            # Spread by hand: adaptive execution would see tiny rows, not the listings behind them.
            spread = folders.repartition(tasks, "path") if i > first else folders
            folders = spread.mapInArrow(_matching(parts[i], i == len(parts) - 1), WALK)
        found = found.unionByName(folders)
    files = found.groupBy("path").agg(F.first("file_size").alias("file_size"), F.first("file_mtime").alias("file_mtime"), F.first("error").alias("error"))
    return files.select("path", "file_size", "file_mtime", "error")


def start_offset(cursor: Column, legacy_offset: Column, file_size: Column) -> Column:
    """Where reading resumes; 0 again after rotation.

    An empty cursor falls back to the legacy offset; text that is no number restarts the file.
    """
    number = F.when(cursor.rlike("^[+-]?[0-9]+$"), cursor.try_cast("bigint"))
    seeded = F.when(F.coalesce(cursor, F.lit("")) == "", legacy_offset).otherwise(number)
    offset = F.greatest(F.coalesce(seeded, F.lit(0)), F.lit(0))
    return F.when(offset > file_size, F.lit(0)).otherwise(offset).cast("bigint")


def with_cursors(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files with ``start_offset``. The cursor table may be as large as the listing, so no side is
    broadcast by hint."""
    known = cursors.select("path", "cursor", "legacy_offset")
    return files.join(known, "path", "left").select(
        *files.columns,
        start_offset(F.col("cursor"), F.col("legacy_offset"), F.col("file_size")).alias("start_offset"),
    )


def is_idle(now, mtime: str = "file_mtime", idle: str = IDLE) -> Column:
    """The file has not changed for the idle time before ``now`` (a timestamp or its text)."""
    return F.col(mtime) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {idle}")


def from_cursor(lines: DataFrame) -> DataFrame:
    """Only lines at or behind the cursor, for sources that cannot seek."""
    return lines.filter(F.col("byte_offset") >= F.col("start_offset"))


def byte_ranges(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, from_start: bool = False) -> DataFrame:
    """Cut the bytes to read of every file at multiples of ``chunk_bytes``.

    Reading begins at the cursor, or at byte 0 for formats whose first line must always be seen.
    """
    return (
        files.withColumn("lower", F.lit(0).cast("bigint") if from_start else F.col("start_offset"))
        .filter("file_size > lower")
        .selectExpr("*", f"explode(sequence(lower div {chunk_bytes}, (file_size - 1) div {chunk_bytes})) as chunk")
        .withColumn("start", F.greatest(F.col("lower"), F.col("chunk") * chunk_bytes))
        .withColumn("end", F.least(F.col("file_size"), (F.col("chunk") + 1) * chunk_bytes))
    )


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def _local_uri(path: str) -> str:
    # The listing writes file:/x, the file system library wants file:///x.
    return "file:///" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path


class LineTooLong(OSError):
    """A line beyond ``MAX_LINE_BYTES``, found out before it is held whole."""


def read_range(path: str, lower: int, start: int, end: int, size: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Lines that start in ``[start, end)``, as blocks of (byte offsets, lines with their LF).

    ``lower`` is where the pass begins in this file: a line surely starts there. Elsewhere a line
    starts after the first LF at or behind ``start - 1``. The last line may run past ``end``.
    """
    with _open(_local_uri(path)) as src:
        pos = start if start == lower else start - 1
        src.seek(pos)
        skipping = start != lower
        held: list[bytes] = []  # pieces of a line whose LF has not been seen yet
        line_at = pos
        while True:
            data = src.read(max(0, min(_BLOCK, size - pos)))
            at_end = not data
            ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
            if skipping and data:
                if len(ends) == 0:
                    pos += len(data)
                    if pos >= end:
                        return
                    continue
                cut = int(ends[0])
                data, pos, ends, skipping = data[cut:], pos + cut, ends[1:] - cut, False
                line_at = pos
            if len(ends):
                starts = np.concatenate(([0], ends[:-1]))
                offsets = starts + pos
                offsets[0] = line_at
                lines = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                lines[0] = b"".join([*held, lines[0]])
                mine = int(np.searchsorted(offsets, end))
                if mine:
                    yield offsets[:mine], lines[:mine]
                held, line_at = [], pos + int(ends[-1])
                rest = data[int(ends[-1]) :]
            else:
                rest = data
            pos += len(data)
            if rest:
                held.append(rest)
                if pos - line_at > MAX_LINE_BYTES:
                    raise LineTooLong("line too long")
            if line_at >= end:
                return
            if pos >= size or at_end:
                if held and not skipping:
                    yield np.array([line_at]), [b"".join(held)]
                return


_LINE_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("file_size", pa.int64()),
        ("file_mtime", pa.timestamp("us", tz="UTC")),
        ("start_offset", pa.int64()),
        ("byte_offset", pa.int64()),
        ("raw", pa.binary()),
        ("error", pa.string()),
    ]
)


_READ = RAW_LINES.replace("line string, terminated boolean", "raw binary, error string")


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            head = [row["path"], row["file_size"], row["file_mtime"], row["start_offset"]]

            def emit(offsets, raws, error=None, head=head):
                n = len(offsets)
                columns = [pa.array([v] * n, f.type) for v, f in zip(head, _LINE_SCHEMA)]
                columns += [pa.array(offsets, pa.int64()), pa.array(raws, pa.binary()), pa.array([error] * n, pa.string())]
                return pa.RecordBatch.from_arrays(columns, schema=_LINE_SCHEMA)

            try:
                for offsets, raws in read_range(row["path"], row["lower"], row["start"], row["end"], row["file_size"]):
                    if max(map(len, raws)) > MAX_LINE_BYTES:
                        yield emit([-1], [None], "line too long")
                        break
                    for i in range(0, len(raws), _BATCH_ROWS):
                        yield emit(offsets[i : i + _BATCH_ROWS], raws[i : i + _BATCH_ROWS])
            except LineTooLong as e:
                yield emit([-1], [None], str(e))
            except OSError as e:
                yield emit([-1], [None], f"{type(e).__name__}: {e}")


WHOLE = "path string, file_size bigint, file_mtime timestamp, raw binary, error string"
_WHOLE_SCHEMA = pa.schema([("path", pa.string()), ("file_size", pa.int64()), ("file_mtime", pa.timestamp("us", tz="UTC")), ("raw", pa.binary()), ("error", pa.string())])


def read_whole(files: DataFrame) -> DataFrame:
    """(path, file_size, file_mtime, text, error): the whole content of each file as one row, whatever lines it has.

    A file that cannot be read, or is beyond ``MAX_LINE_BYTES``, is a row with ``error``. The rows of a batch hold one large file at most.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0

            def flush(out):
                columns = list(zip(*out)) if out else [[]] * len(_WHOLE_SCHEMA)
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WHOLE_SCHEMA)], schema=_WHOLE_SCHEMA)

            for path, size, mtime in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw, error = None, None
                try:
                    with _open(_local_uri(path)) as src:
                        raw = src.read(MAX_LINE_BYTES + 1)
                    if len(raw) > MAX_LINE_BYTES:
                        raw, error = None, "file too long"
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((path, size, mtime, raw, error))
                held += len(raw or b"")
                if held > _BLOCK:
                    yield flush(out)
                    out, held = [], 0
            yield flush(out)

    tasks = scan_tasks(files.sparkSession, files.agg(F.sum("file_size")).first()[0] or 0)
    spread = files.select("path", "file_size", "file_mtime").repartition(tasks, "path")
    return spread.mapInArrow(read, WHOLE).selectExpr("path", "file_size", "file_mtime", "cast(raw as string) as text", "error")


def changed(listing: DataFrame, seen: DataFrame, now) -> DataFrame:
    """Files worth opening: those whose size or change time is another than when they were last opened, those never opened, and
    those that have come to rest since, because that settles their last turn. Decided by listings alone."""
    before = seen.select("path", F.col("file_size").alias("_size"), F.col("file_mtime").alias("_mtime"), "seen_at")
    rests = is_idle(now) & ~(F.col("file_mtime") < F.col("seen_at") - F.expr(f"INTERVAL {IDLE}"))
    joined = listing.join(before, "path", "left")
    news = F.col("_size").isNull() | (F.col("_size") != F.col("file_size")) | ~F.col("_mtime").eqNullSafe(F.col("file_mtime")) | rests
    return joined.filter(news).drop("_size", "_mtime", "seen_at")


def scan_tasks(spark: SparkSession, n_bytes: int) -> int:
    """How many tasks should read that many bytes."""
    return max(spark.sparkContext.defaultParallelism, -(-n_bytes // SCAN_BYTES_PER_TASK))


def read_lines(
    files: DataFrame, chunk_bytes: int = CHUNK_BYTES, from_start: bool = False, tasks: int | None = None
) -> DataFrame:
    """Raw lines of ``files`` (path, file_size, file_mtime, start_offset) with byte offsets.

    ``error`` is set, and ``line`` NULL, on the one row standing for a range that could not be read.
    ``tasks`` spreads the ranges; by default it follows the listed bytes.
    """
    ranges = byte_ranges(files, chunk_bytes, from_start)
    if tasks is None:
        tasks = scan_tasks(files.sparkSession, ranges.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0)
    # Explicit count: adaptive execution would merge these tiny rows, and all reading, into one task.
    spread = ranges.repartition(tasks, "path", "chunk").select(
        "path", "file_size", "file_mtime", "start_offset", "lower", "start", "end"
    )
    read = spread.mapInArrow(_lines_of, _READ)
    return read.selectExpr(
        "path",
        "file_size",
        "file_mtime",
        "start_offset",
        "byte_offset",
        "cast(raw as string) as line",
        "coalesce(substring(raw, -1, 1) = X'0A', true) as terminated",
        "error",
    )
