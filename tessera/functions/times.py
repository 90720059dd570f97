"""Times of hosts as naive local ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zone(zone: str | None) -> Column:
    return F.lit(zone) if zone else F.current_timezone()


def of_epoch(seconds: Column, zone: str | None = None) -> Column:
    """Unix seconds (with a fraction) as the local time of a zone (the session's, if none is named); null stays null."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), _zone(zone), utc)


def of_text(text: Column, zone: str | None = None) -> Column:
    """An ISO time as local time: one with Z or an offset is moved to the zone, one without is local already; null if it can't be read."""
    bare = F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "").try_cast("timestamp_ntz")
    part = lambda i: F.nullif(F.regexp_extract(text, r"\d([+-])(\d\d):?(\d\d)$", i), F.lit(""))
    offset = F.when(F.endswith(text, F.lit("Z")), 0).otherwise((part(2).cast("int") * 60 + part(3).cast("int")) * F.when(part(1) == "-", -1).otherwise(1))
    utc = bare - F.make_dt_interval(mins=offset)
    return F.when(F.rlike(text, F.lit(r"T?\d\d:\d\d.*(Z|[+-]\d\d:?\d\d)$")), F.convert_timezone(F.lit("UTC"), _zone(zone), utc)).otherwise(text.try_cast("timestamp_ntz"))
