"""Times as numbers. Wall clock, whatever the session's time zone: columns without a zone stay as they are, others are read in the
session's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(time: Column | str) -> Column:
    """Microseconds since 1970."""
    c = F.col(time) if isinstance(time, str) else time
    day = F.unix_date(c.cast("date")).cast("long") * 86_400_000_000
    return day + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def millis(time: Column | str) -> Column:
    return F.floor(micros(time) / 1000).cast("long")


def nearest_millis(time: Column | str) -> Column:
    """Milliseconds to the nearest, halves away from 1970, as epoch_ms() of SQL has them; in whole numbers at any time."""
    us = micros(time)
    return F.call_function("div", F.when(us < 0, us - 500).otherwise(us + 500), F.lit(1000).cast("long"))


def seconds(time: Column | str) -> Column:
    return F.floor(micros(time) / 1_000_000).cast("long")
