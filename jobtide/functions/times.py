"""Timestamps. "Now" is always an argument, so every result can be reproduced."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date, separator, time with any fraction, offset. The offset is not optional.
RFC3339_TEXT = (
    r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:?\d{2})\z"
)


def parse_rfc3339(text: Column) -> Column:
    """UTC instant, cut to microseconds; null if the text is malformed."""
    return F.when(text.rlike(RFC3339_TEXT), F.upper(text).try_cast("timestamp"))


def moment(as_of: Column | datetime) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def or_epoch(ts: Column) -> Column:
    return F.coalesce(ts, F.timestamp_seconds(F.lit(0)))
