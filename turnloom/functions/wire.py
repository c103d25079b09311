"""Wire form of an event and its content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import empty_to_null
from turnloom.functions.timestamps import format_wire_ts, parse_wire_ts
from turnloom.schemas import WIRE_DDL, WIRE_FIELDS


def wire_struct() -> Column:
    """The event as a struct in wire order; optional fields are NULL when empty."""
    fields = []
    for name, wire, optional in WIRE_FIELDS:
        value = F.col(name)
        if name == "prompt_ts":
            value = format_wire_ts(value)
        elif optional and name != "token_count":
            value = empty_to_null(value)
        fields.append(value.alias(wire))
    return F.struct(*fields)


def to_wire(events: DataFrame) -> DataFrame:
    """Add ``event_json``: camelCase, empty optional fields left out, naive UTC seconds."""
    return events.withColumn("event_json", F.to_json(wire_struct()))


def from_wire(encoded: DataFrame, column: str = "event_json") -> DataFrame:
    """Decode ``event_json`` back into event columns."""
    parsed = encoded.select("*", F.from_json(column, WIRE_DDL).alias("_wire")).drop(column)
    out = [F.col(c) for c in parsed.columns if c != "_wire"]
    for name, wire, _ in WIRE_FIELDS:
        value = F.col(f"_wire.{wire}")
        out.append((parse_wire_ts(value) if name == "prompt_ts" else value).alias(name))
    return parsed.select(*out)


def content_hash() -> Column:
    """sha256 of tool, session, prompt and second; the model takes no part in it."""
    parts = [
        F.coalesce(F.col("source_tool"), F.lit("")),
        F.coalesce(F.col("session_id"), F.lit("")),
        F.coalesce(F.col("prompt_text"), F.lit("")),
        F.coalesce(format_wire_ts(F.col("prompt_ts")), F.lit("")),
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)
