"""URI predicates and normalisation (F1, F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loggraph.constants import STATIC_EXTENSIONS

STATIC_PATTERN = "(?i)\\.(" + "|".join(STATIC_EXTENSIONS) + ")(\\?.*)?$"
UUID_SEGMENT = r"/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
FIRST_TWO_SEGMENTS = r"^((?:/[^/]*){1,2})"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_static_asset(c) -> Column:
    """Case-insensitive static-file extension at the end, optional query string."""
    return _col(c).rlike(STATIC_PATTERN)


def uri_prefix(c) -> Column:
    """Collapse a request URI to its endpoint prefix.

    Query and fragment are cut, UUID and numeric segments become ``*``, runs of
    ``/*`` fold into one, then the first two segments are kept. A URI that does
    not start with ``/`` keeps its original text, query string included."""
    uri = _col(c)
    s = F.regexp_replace(uri, r"\?.*$", "")
    s = F.regexp_replace(s, r"#.*$", "")
    s = F.regexp_replace(s, UUID_SEGMENT, "/*")
    s = F.regexp_replace(s, r"/\d+", "/*")
    s = F.regexp_replace(s, r"(/\*)+", "/*")
    head = F.regexp_extract(s, FIRST_TWO_SEGMENTS, 1)
    return F.coalesce(F.nullif(head, F.lit("")), uri)
