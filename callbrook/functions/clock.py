"""Time stamps as numbers, whatever zone the session runs in."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less wall-clock stamp read as UTC."""
    stamp = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(F.from_utc_timestamp(stamp.cast("timestamp"), F.current_timezone()))


def epoch_seconds(c: Column | str) -> Column:
    return epoch_micros(c) / 1e6
