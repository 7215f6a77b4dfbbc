"""Address predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Private address prefixes (10/8, 192.168/16, loopback, 172.16/12).
PRIVATE_PREFIXES = ["10.", "192.168.", "127."] + [f"172.{i}." for i in range(16, 32)]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_private(c) -> Column:
    """True for RFC-1918 / loopback text addresses.

    Written as an OR of ``startswith`` so the predicate can be pushed down to a
    Parquet scan (``rlike`` cannot)."""
    c = _col(c)
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in PRIVATE_PREFIXES])


def subnet24(c) -> Column:
    """``a.b.c.d`` -> ``a.b.c.0/24``; anything else keeps its text and gets the suffix."""
    c = _col(c)
    three = F.regexp_extract(c, r"^(\d+\.\d+\.\d+)\.\d+$", 1)
    return F.concat(F.coalesce(F.nullif(three, F.lit("")), c), F.lit(".0/24"))
