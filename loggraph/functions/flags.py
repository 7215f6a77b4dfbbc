"""Edge flag and risk classification expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loggraph.constants import (
    CRITICAL_RISK_THRESHOLD, FLAG_SEVERITY, SCAN_FLAGS, SIGNAL_RISK_THRESHOLD,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag_list(pairs: list[tuple[Column, str]]) -> Column:
    """Ordered list of flag names whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def dominant_flag(flags) -> Column:
    """Most severe flag present in an ``ARRAY<STRING>`` of flags, else NULL."""
    flags = _col(flags)
    expr = None
    for name in FLAG_SEVERITY:
        cond = F.array_contains(flags, name)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def edge_class(is_anomalous, flags) -> Column:
    """``noise`` / ``scan`` / ``attack`` class used by the filter toggles."""
    dom = dominant_flag(flags)
    return (F.when(~_col(is_anomalous), F.lit("noise"))
            .when(dom.isin(SCAN_FLAGS), F.lit("scan"))
            .otherwise(F.lit("attack")))


def risk_band(risk) -> Column:
    """red >= 3.0, amber >= 1.5, else green."""
    r = _col(risk)
    return F.when(r >= 3.0, "red").when(r >= 1.5, "amber").otherwise("green")


def risk_tier(risk, is_noise_super) -> Column:
    """critical >= 5.0, suspicious >= 3.0, else noise; super-nodes are noise."""
    r = _col(risk)
    return (F.when(_col(is_noise_super), F.lit("noise"))
            .when(r >= CRITICAL_RISK_THRESHOLD, F.lit("critical"))
            .when(r >= SIGNAL_RISK_THRESHOLD, F.lit("suspicious"))
            .otherwise(F.lit("noise")))


def edge_prominence(is_anomalous, attempts) -> Column:
    """Log-scaled edge size: min(4, base + 0.75*log10(max(1, n)))."""
    base = F.when(_col(is_anomalous), F.lit(1.2)).otherwise(F.lit(0.3))
    n = F.greatest(F.lit(1).cast("double"), _col(attempts).cast("double"))
    return F.least(F.lit(4.0), base + F.lit(0.75) * F.log10(n))
