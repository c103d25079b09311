"""Fixed-size chunks of a file: the unit that bounds every ordered scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 64 * 1024 * 1024


def chunk_of(chunk_bytes: int) -> str:
    """Chunk in which a line starts; depends on the byte offset alone, never on the cluster."""
    return f"byte_offset div {int(chunk_bytes)}"


def spans_chunks(chunk_bytes: int, start: str = "start_offset") -> str:
    """The part of the file read in this pass touches more than one chunk."""
    return f"{start} div {int(chunk_bytes)} < greatest(file_size - 1, 0L) div {int(chunk_bytes)}"


def aside(parsed: DataFrame) -> str:
    """What a line is besides content: an unfinished last line, or a range that could not be read."""
    failed = "error is not null" if "error" in parsed.columns else "false"
    return f"case when {failed} then 'error' when not valid and not terminated then 'tail' end"


def exchange_chunks(rows: DataFrame, shared: list[str], rest: list[str]) -> DataFrame:
    """Bring each (path, chunk) together once, for the rows and for the chunk summaries alike.

    ``shared`` columns must be used by both sides; the others travel packed as ``payload``, which both
    sides refer to as a whole. Both then ask for the very same exchange, and Spark runs it, and the
    decoding below it, only once.
    """
    packed = F.array(F.struct(*rest)).alias("payload")
    known = rows.filter("path is not null and byte_offset is not null")
    return known.select("path", "chunk", "byte_offset", *shared, packed).repartition("path", "chunk")


def unpack_rows(exchanged: DataFrame) -> DataFrame:
    return exchanged.select(*[c for c in exchanged.columns if c != "payload"], F.inline("payload"))


def summarize_chunks(exchanged: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per (path, chunk)."""
    sized = exchanged.select("*", F.size("payload").alias("packed")).drop("payload")
    sums = sized.groupBy("path", "chunk").agg(F.max("packed").alias("packed"), *aggregates)
    return sums.filter("packed > 0").drop("packed")
