"""Date rendering and conversion. All times are UTC instants (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: date patterns of the rendered texts
DATE = "MMMM d, yyyy"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
STAMP = "yyMMddHHmmssSSS"
LOG = "yyyy-MM-dd HH:mm:ss.SSS"
READER = "yyyy-MM-dd'T'HH:mm:ss.SSS-00:00"


def millis(ts: Column) -> Column:
    """Instants are kept to the millisecond."""
    return F.date_trunc("MILLISECOND", ts)


def since_ms(earlier: Column, later: Column) -> Column:
    return F.unix_millis(later) - F.unix_millis(earlier)
