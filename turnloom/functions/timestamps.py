"""RFC 3339 text to UTC seconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^(\d{4}-\d{2}-\d{2})T(\d{1,2}:\d{2}:\d{2})(?:[.,]\d+)?(?:Z|([+-])(\d{2}):(\d{2}))$"

WIRE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def parse_rfc3339(text: Column) -> Column:
    """UTC timestamp cut to whole seconds; unreadable text becomes the year-1 sentinel."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, _RFC3339, i)

    local = F.try_to_timestamp(
        F.concat_ws(" ", part(1), F.lpad(part(2), 8, "0")), F.lit("yyyy-MM-dd HH:mm:ss")
    )
    hours = F.coalesce(part(4).try_cast("int"), F.lit(0))
    minutes = F.coalesce(part(5).try_cast("int"), F.lit(0))
    shift = (hours * 3600 + minutes * 60) * F.when(part(3) == "-", -1).otherwise(1)
    utc = F.timestamp_seconds(F.unix_seconds(local) - shift)
    good = text.rlike(_RFC3339) & (hours <= 24) & (minutes <= 60)
    return F.coalesce(F.when(good, utc), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def format_wire_ts(ts: Column) -> Column:
    return F.date_format(ts, WIRE_FORMAT)


def parse_wire_ts(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(WIRE_FORMAT))
