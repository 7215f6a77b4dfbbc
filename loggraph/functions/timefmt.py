"""Typed event time from the three text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_time(ts, log_year: int) -> Column:
    """Parse ``timestamp`` text into a UTC ``TIMESTAMP``.

    * syslog ``MMM d HH:mm:ss`` carries no year: the caller says which one it is;
    * access-log ``dd/MMM/yyyy:HH:mm:ss Z``;
    * epoch seconds with a fraction (Squid, Zeek).
    Unparseable text gives NULL, never an error."""
    t = _col(ts)
    squeezed = F.regexp_replace(t, r"\s+", " ")
    syslog = F.try_to_timestamp(F.concat(F.lit(f"{log_year} "), squeezed),
                                F.lit("yyyy MMM d HH:mm:ss"))
    ncsa = F.try_to_timestamp(t, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    epoch = F.timestamp_seconds(t.try_cast("decimal(20,6)"))
    return (F.when(t.rlike(r"^[A-Z][a-z]{2}\s"), syslog)
            .when(t.rlike(r"^\d{2}/[A-Z][a-z]{2}/"), ncsa)
            .when(t.rlike(r"^\d+(\.\d+)?$"), epoch))
