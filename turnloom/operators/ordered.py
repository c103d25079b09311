"""Ordered scans that survive a hot key.

A plain ``partitionBy(key).orderBy(...)`` window sorts a whole key in one task, and one key may hold
a third of all rows. Every scan here therefore cuts a key into *chunks* (any expression that never
decreases along the order), scans inside ``(key, chunk)``, and carries one small summary row per
chunk across. Only those summaries are ever windowed per key.

Where no such expression bounds a chunk, ``in_chunks`` cuts the rows by their number, whatever their keys, and names a coarser
``block`` for each chunk. Given a block, summaries are first put together inside it and only one row per block is windowed per key:
two levels, each of a bounded fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import checkpointed

_BEFORE = (Window.unboundedPreceding, -1)


def _cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _order_struct(order: list[str], *extra: Column) -> Column:
    return F.struct(*_cols(order), *extra)


CHUNK_ROWS, CHUNKS_A_BLOCK = 100_000, 100
RANGE_ROWS = 500_000  # a range holds at least so many rows, however small the blocks are: each costs a task in every scan, and a sample when rows are dealt


def in_chunks(df: DataFrame, key: list[str], order: list[str], chunk_rows: int = CHUNK_ROWS, chunks: int = CHUNKS_A_BLOCK) -> DataFrame:
    """df with ``chunk`` (at most ``chunk_rows`` rows, all of one block) and ``block``, both growing along key and order.

    Rows are sorted by ranges of (key, order) and cut inside them, so a key that holds a third of them lies in as many blocks as its rows
    need, and a block holds many small keys. How many ranges there are follows from the rows alone, not from the size of a chunk. The sorted rows are cut off from their lineage in the shared folder: a chunk stays what it
    is when a task runs again. Rows equal in key and order are put in some order, once.
    """
    placed = _sorted(df, [*key, *order], max(chunk_rows * chunks, RANGE_ROWS))
    placed = placed.withColumn("chunk", F.expr(f"(block << 33) + _at div {int(chunk_rows)}"))
    return placed.withColumn("block", F.expr(f"(block << 33) + _at div {int(chunk_rows) * int(chunks)}")).drop("_at")


def _sorted(df: DataFrame, order: list[str], range_rows: int) -> DataFrame:
    """df sorted by ranges, with the range's number ``block`` and the place ``_at`` in it, cut off from its lineage."""
    ranges, tie = 1 + df.count() // range_rows, "_tie"
    spread = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(ranges, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    at = spread.withColumn("_id", F.monotonically_increasing_id())
    return checkpointed(at.withColumn("block", F.shiftright("_id", 33)).withColumn("_at", F.expr(f"_id & {(1 << 33) - 1}")).drop("_id"))


def row_numbers(df: DataFrame, order: list[str], out: str = "row_number", block_rows: int = CHUNK_ROWS * CHUNKS_A_BLOCK) -> DataFrame:
    """df with the rows numbered from 1 in one order. Rows are sorted by ranges; only one row per range is windowed."""
    placed = _sorted(df, order, block_rows)
    sizes = placed.groupBy("block").agg(F.count("*").alias("_n"))
    base = sizes.select("block", (F.sum("_n").over(Window.orderBy("block")) - F.col("_n")).alias("_base"))
    return placed.join(base, "block").withColumn(out, F.col("_base") + F.col("_at") + 1).drop("block", "_at", "_base")


def _across(summaries: DataFrame, key: list[str], block: Column | None, levels: tuple, out: str) -> DataFrame:
    """``out`` for each summary row (key, chunk): what comes before it (or behind) along the key.

    ``levels`` has three functions: of a window over summaries, of the summaries of a block as an aggregate, and of
    a window over those; and one that joins what the inner and the outer level found.
    """
    of_chunks, of_block, of_blocks, joined = levels
    if block is None:
        return summaries.withColumn(out, of_chunks(Window.partitionBy(*key).orderBy("_chunk")))
    placed = summaries.withColumn(out, of_chunks(Window.partitionBy(*key, "_block").orderBy("_chunk")))
    blocks = summaries.groupBy(*key, "_block").agg(of_block.alias("_whole"))
    blocks = blocks.withColumn("_outer", of_blocks(Window.partitionBy(*key).orderBy("_block"))).drop("_whole")
    return placed.join(blocks, [*key, "_block"]).withColumn(out, joined(F.col(out), F.col("_outer"))).drop("_outer")


def _named(df: DataFrame, chunk: Column, block: Column | None) -> tuple[DataFrame, list[str]]:
    rows = df.withColumn("_chunk", chunk)
    return (rows, ["_chunk"]) if block is None else (rows.withColumn("_block", block), ["_block", "_chunk"])


def running_total(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, value: Column, out: str, total: str, block: Column | None = None
) -> DataFrame:
    """Exclusive running sum of ``value`` as ``out`` and the key's whole sum as ``total``."""
    rows, place = _named(df, chunk, block)
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy(*key, *place).agg(F.sum("_value").alias("_sum"))
    before = lambda name: lambda w: F.coalesce(F.sum(name).over(w.rowsBetween(*_BEFORE)), F.lit(0))
    levels = (before("_sum"), F.sum("_sum"), before("_whole"), lambda inner, outer: inner + outer)
    carry = _across(sums, key, block, levels, "_base")
    if block is None:
        carry = carry.withColumn(total, F.sum("_sum").over(Window.partitionBy(*key)))
    else:
        carry = carry.join(sums.groupBy(*key).agg(F.sum("_sum").alias(total)), key)
    carry = carry.select(*key, *place, "_base", total)
    inside = Window.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(*_BEFORE)
    return (
        rows.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(carry, [*key, *place])
        .withColumn(out, F.col("_base") + F.col("_local"))
        .drop(*place, "_value", "_base", "_local")
    )


def with_line_positions(df: DataFrame, key: list[str], order: list[str], chunk: Column, line: str) -> DataFrame:
    """Byte offset of every line inside its file, and the file's size, for lines ending in one LF."""
    return running_total(
        df, key, order, chunk, F.octet_length(F.col(line)).cast("bigint") + 1, "byte_offset", "file_size"
    )


def carry_forward(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, value: Column, out: str, block: Column | None = None
) -> DataFrame:
    """Latest non-NULL ``value`` up to and including the current row (the as-of look-back)."""
    rows, place = _named(df, chunk, block)
    rows = rows.withColumn("_value", value)
    ends = (
        rows.filter(F.col("_value").isNotNull())
        .groupBy(*key, *place)
        .agg(F.max_by("_value", _order_struct(order)).alias("_end"))
    )
    chunks = rows.select(*key, *place).distinct().join(ends, [*key, *place], "left")
    last = lambda name: lambda w: F.last(name, ignorenulls=True).over(w.rowsBetween(*_BEFORE))
    of_block = F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("_chunk")))
    levels = (last("_end"), of_block, last("_whole"), lambda inner, outer: F.coalesce(inner, outer))
    carry = _across(chunks, key, block, levels, "_carry").select(*key, *place, "_carry")
    inside = (
        Window.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
        .join(carry, [*key, *place], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop(*place, "_value", "_local", "_carry")
    )


def segment(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, opens: Column, out: str, block: Column | None = None
) -> DataFrame:
    """Number the segments of a key: each row where ``opens`` holds starts the next one, rows before
    the first belong to segment 0."""
    flagged = df.withColumn("_opens", F.coalesce(opens.cast("bigint"), F.lit(0)))
    counted = running_total(flagged, key, order, chunk, F.col("_opens"), "_seen", "_all", block)
    return counted.withColumn(out, F.col("_seen") + F.col("_opens")).drop("_opens", "_seen", "_all")


def next_in_sequence(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, payload: list[str], out: str, block: Column | None = None
) -> DataFrame:
    """The following row of the same key as struct ``out`` (``payload`` fields), NULL on the last."""
    rows, place = _named(df, chunk, block)
    item = F.struct(*_cols(payload))
    heads = rows.groupBy(*key, *place).agg(F.min_by(item, _order_struct(order)).alias("_head"))
    lead = lambda name: lambda w: F.lead(name).over(w)
    levels = (lead("_head"), F.min_by("_head", "_chunk"), lead("_whole"), lambda inner, outer: F.coalesce(inner, outer))
    carry = _across(heads, key, block, levels, "_carry").select(*key, *place, "_carry")
    inside = Window.partitionBy(*key, "_chunk").orderBy(*order)
    return (
        rows.withColumn("_local", F.lead(item).over(inside))
        .join(carry, [*key, *place], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop(*place, "_local", "_carry")
    )
