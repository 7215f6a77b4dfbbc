"""Column-expression builders. Everything here returns a ``Column`` that stays
inside whole-stage codegen: no Python UDFs."""

from loggraph.functions.net import is_private, subnet24
from loggraph.functions.uri import is_static_asset, uri_prefix
from loggraph.functions.flags import (
    dominant_flag, edge_class, risk_band, risk_tier, edge_prominence,
)
from loggraph.functions.timefmt import event_time

__all__ = [
    "is_private", "subnet24", "is_static_asset", "uri_prefix", "dominant_flag",
    "edge_class", "risk_band", "risk_tier", "edge_prominence", "event_time",
]
