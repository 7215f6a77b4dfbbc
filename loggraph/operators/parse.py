"""Line parsing into the unified event table.

All families are parsed in **one scan** of the line table: every line builds an
array of candidate event structs (one slot per family, NULL when the family's
guard does not match), and ``inline`` emits the non-null ones. A line that two
families accept is emitted twice, as a bag union of separate parsers would.

Unified event columns::

    timestamp, source_ip, protocol, action, target      STRING (compatibility view)
    user, auth_method, dest_host                        STRING (SSH metadata)
    status_code, bytes_sent                             INT    (HTTP metadata)
    family, file                                        STRING
    line_no                                             BIGINT

``metadata`` as JSON text is produced only by :func:`unified_view`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Line patterns. Group numbers are listed next to each pattern.
# ---------------------------------------------------------------------------
SSH_TIME = r"([A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})"
# 1 time, 2 host, 3 auth method, 4 user, 5 source, 6 port
SSH_ACCEPTED = SSH_TIME + r"\s+(\S+)\s+sshd\[\d+\]:\s+Accepted\s+(\S+)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)"
# 1 time, 2 host, 3 auth method, 4 user, 5 source, 6 port
SSH_FAILED = SSH_TIME + r"\s+(\S+)\s+sshd\[\d+\]:\s+Failed\s+(\S+)\s+for\s+(?:invalid user\s+)?(\S+)\s+from\s+(\S+)\s+port\s+(\d+)"
# 1 time, 2 host, 3 user, 4 source
SSH_INVALID = SSH_TIME + r"\s+(\S+)\s+sshd\[\d+\]:\s+Invalid user\s+(\S+)\s+from\s+(\S+)"
# 1 source, 2 time, 3 verb, 4 uri, 5 status, 6 bytes
NCSA = r"(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+\"([A-Z]+)\s+(\S+)\s+HTTP/[0-9.]+\"\s+(\d+)\s+(\d+)"
# 1 time, 2 source, 3 status, 4 bytes, 5 verb, 6 uri
SQUID = r"^\s*(\d+\.\d+)\s+\d+\s+(\S+)\s+\S+/(\d+)\s+(\d+)\s+([A-Z]+)\s+(\S+)"

GUARD_NCSA = "HTTP/"
GUARD_SQUID = "TCP_"

# A Zeek data row begins with an epoch or ISO time; the eighth field of an HTTP row is a
# verb, or absent where the tenth is a path.
ZEEK_ROW = r"^(?:\d{9,}(?:\.\d+)?|\d{4}-\d{2}-\d{2}[T ][0-9:.]+(?:Z|[+-]\d{2}:?\d{2})?)\t"
ZEEK_VERB = r"^[A-Z]{3,}$"
ZEEK_SSH_FIELDS, ZEEK_HTTP_FIELDS = 6, 10

#: Rows of the table of files up to which the routed path broadcasts it.
BROADCAST_FILES = 200_000

EVENT_FIELDS = [
    ("family", T.StringType()), ("timestamp", T.StringType()), ("source_ip", T.StringType()),
    ("protocol", T.StringType()), ("action", T.StringType()), ("target", T.StringType()),
    ("user", T.StringType()), ("auth_method", T.StringType()), ("dest_host", T.StringType()),
    ("status_code", T.IntegerType()), ("bytes_sent", T.IntegerType()),
]
EVENT_COLUMNS = [n for n, _ in EVENT_FIELDS[1:]] + ["family", "file", "line_no"]
UNIFIED_COLUMNS = ["timestamp", "source_ip", "protocol", "action", "target", "metadata"]

SSH_META = T.StructType([T.StructField("user", T.StringType()),
                         T.StructField("auth_method", T.StringType()),
                         T.StructField("dest_host", T.StringType())])
HTTP_META = T.StructType([T.StructField("status_code", T.IntegerType()),
                          T.StructField("bytes_sent", T.IntegerType())])


def _groups(pattern: str) -> Column:
    """All groups of the first match as an array (group i at place i), by one run of the
    pattern; one element where it does not match. A line holds no line feed, so it can
    stand between the groups."""
    n = re.compile(pattern).groups
    around = pattern if pattern.startswith("^") else f"^.*?{pattern}"
    joined = F.regexp_replace("raw_line", f"(?s){around}.*$", "".join(f"\n${i}" for i in range(1, n + 1)))
    return F.split(joined, "\n")


def _grp(pattern: str, i: int) -> Column:
    """Regex group ``i`` of ``raw_line``; NULL when the pattern does not match."""
    return F.nullif(F.regexp_extract("raw_line", pattern, i), F.lit(""))


def _part(name: str, i: int) -> Column:
    """Group ``i`` of a family's match; NULL where its pattern does not match."""
    return F.nullif(F.get(F.col(f"_{name}"), i), F.lit(""))


def _event(family: str, **cols) -> Column:
    """Candidate struct in the fixed field order; absent fields are typed NULLs."""
    out = []
    for name, dtype in EVENT_FIELDS:
        if name == "family":
            out.append(F.lit(family).alias(name))
        else:
            c = cols.get(name)
            out.append((c if c is not None else F.lit(None)).cast(dtype).alias(name))
    return F.struct(*out)


def _ssh(name: str, ts: int, src: int, host: int, user: int, method: int | None) -> Column:
    return _event(name, timestamp=_part(name, ts), source_ip=_part(name, src), protocol=F.lit("SSH"),
                  action=F.lit("SUCCESS" if name == "ssh_accepted" else "FAILURE"), target=_part(name, host),
                  user=_part(name, user), auth_method=F.lit("password") if method is None else _part(name, method), dest_host=_part(name, host))


def _http(name: str, ts: int, src: int, verb: int, uri: int, status: int, size: int) -> Column:
    return _event(name, timestamp=_part(name, ts), source_ip=_part(name, src), protocol=F.lit("HTTP"),
                  action=_part(name, verb), target=_part(name, uri), status_code=_part(name, status).try_cast("int"),
                  bytes_sent=_part(name, size).try_cast("int"))


def _zeek(i: int) -> Column:
    return F.get(F.col("_tabs"), i)


def _zeek_http() -> Column:
    return _event("zeek_http", timestamp=_zeek(0), source_ip=_zeek(2), protocol=F.lit("HTTP"),
                  action=_zeek(7), target=_zeek(9), status_code=_zeek(14).try_cast("int"), bytes_sent=F.lit(100))


def _zeek_ssh() -> Column:
    result = F.when(_zeek(6).contains("success"), F.lit("SUCCESS")).otherwise(F.lit("FAILURE"))
    return _event("zeek_ssh", timestamp=_zeek(0), source_ip=_zeek(2), protocol=F.lit("SSH"),
                  action=result, target=_zeek(4), user=F.lit("root"), auth_method=F.lit("password"))


def _found(name: str) -> Column:
    """Whether the line matched the family's pattern."""
    return F.size(f"_{name}") > 1


def is_zeek_row() -> Column:
    """A tab-separated data row with a time in front and at least the SSH layout's fields,
    that is no access-log line."""
    return F.col("_dated") & (F.size("_tabs") >= ZEEK_SSH_FIELDS) & ~F.coalesce(_found("ncsa"), F.lit(False))


def is_zeek_http_row() -> Column:
    """The layout of the line's file where it is known, else what the row itself shows."""
    verb = _zeek(7)
    shown = (F.size("_tabs") >= ZEEK_HTTP_FIELDS) & F.coalesce(
        verb.rlike(ZEEK_VERB) | ((verb == "-") & _zeek(9).startswith("/")), F.lit(False))
    return F.coalesce(F.col("_file_is_http"), shown)


@dataclass(frozen=True)
class Family:
    """One line family, an extension point of the parser.

    ``guard`` says whether a line of the family's own format is one of its lines;
    ``accepts`` says the same for a line of unknown origin; ``event`` is the candidate
    struct, built with ``_event``. All give a Column over ``raw_line`` and ``_<name>``,
    the match of ``pattern`` on lines that hold ``words`` (see ``_groups``)."""

    name: str
    format_key: str
    guard: Callable[[], Column]
    accepts: Callable[[], Column]
    event: Callable[[], Column]
    pattern: str | None = None
    words: tuple[str, ...] = ()


def _raw() -> Column:
    return F.col("raw_line")


def _is(name: str) -> Column:
    return F.coalesce(_found(name), F.lit(False))


def _syslog(name: str, pattern: str, word: str, *fields: int | None) -> Family:
    return Family(name, "SYSLOG_SSH", lambda: _is(name), lambda: _is(name) & ~is_zeek_row(), lambda: _ssh(name, *fields),
                  pattern, ("sshd[", word))


FAMILY_TABLE: dict[str, Family] = {f.name: f for f in [
    _syslog("ssh_accepted", SSH_ACCEPTED, "Accepted", 1, 5, 2, 4, 3),
    _syslog("ssh_failed", SSH_FAILED, "Failed", 1, 5, 2, 4, 3),
    _syslog("ssh_invalid", SSH_INVALID, "Invalid user", 1, 4, 2, 3, None),
    Family("ncsa", "NCSA_SQUID_HTTP", lambda: _is("ncsa"), lambda: _is("ncsa") & ~_is("squid") & ~is_zeek_row(),
           lambda: _http("ncsa", 2, 1, 3, 4, 5, 6), NCSA, (GUARD_NCSA,)),
    Family("squid", "NCSA_SQUID_HTTP", lambda: _is("squid"), lambda: _is("squid") & ~is_zeek_row(),
           lambda: _http("squid", 1, 2, 5, 6, 3, 4), SQUID, (GUARD_SQUID,)),
    Family("zeek_http", "ZEEK_TSV", lambda: ~_raw().startswith("#"), lambda: is_zeek_row() & is_zeek_http_row(), _zeek_http),
    Family("zeek_ssh", "ZEEK_TSV", lambda: ~_raw().startswith("#"), lambda: is_zeek_row() & ~is_zeek_http_row(), _zeek_ssh),
]}

#: Format key -> a parser of whole files: line table in, event table out (routed path).
TABLE_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_family(family: Family) -> None:
    """Add a line family. With a format key of its own it also needs a score column
    (``detect.register_format``) for the routed path."""
    FAMILY_TABLE[family.name] = family


def register_parser(format_key: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    """Add a parser of all lines of the files of one format: a callable from a line table
    to a table with EVENT_COLUMNS. The routed path gives it its files' lines, whole, so it
    may join, aggregate or look across lines."""
    TABLE_PARSERS[format_key] = parser


def _matched(lines: DataFrame, is_http: Column | None = None) -> DataFrame:
    """Each line with the matches of all families, every pattern run at most once and
    only on lines that hold its words, and its tab-separated fields."""
    raw, held = _raw(), []
    for f in FAMILY_TABLE.values():
        if f.pattern is not None:
            words = reduce(lambda a, b: a & b, [raw.contains(w) for w in f.words] or [F.lit(True)])
            held.append(F.when(words, _groups(f.pattern)).alias(f"_{f.name}"))
    tabs = F.when(raw.contains("\t"), F.split(raw, "\t")).alias("_tabs")
    dated = F.coalesce(raw.contains("\t") & raw.rlike(ZEEK_ROW), F.lit(False)).alias("_dated")
    file_is_http = (F.lit(None).cast("boolean") if is_http is None else is_http).alias("_file_is_http")
    return lines.select("*", tabs, dated, file_is_http, *held)


def _candidates(conditions: dict[str, Column]) -> Column:
    """``array_compact`` of one guarded struct per family."""
    return F.array_compact(F.array(*[F.when(c, FAMILY_TABLE[n].event()) for n, c in conditions.items()]))


def _explode(lines: DataFrame, cands: Column) -> DataFrame:
    ev = (lines
          .select(F.inline(cands), "file", "line_no")
          .where(F.col("source_ip").isNotNull()
                 & ~(F.col("family").startswith("zeek") & (F.col("source_ip") == "-"))))
    return ev.select(*EVENT_COLUMNS)


def _mixed_plan(lines: DataFrame, families: list[str] | None, layouts: DataFrame | None) -> tuple[DataFrame, Column]:
    """Each line is tried against every family by its own content; of its file only the
    Zeek layout counts, where ``layouts`` knows it."""
    is_http = None
    if layouts is not None:
        lines = _with_files(lines, layouts.select("file", "zeek_is_http"))
        is_http = F.col("zeek_is_http")
    return _matched(lines, is_http), _candidates({n: FAMILY_TABLE[n].accepts() for n in families or FAMILY_TABLE})


def _with_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The table of files joined on the file name: broadcast when its counted rows are
    few, else a shuffled join whose large files AQE splits."""
    if files.count() <= BROADCAST_FILES:
        files = F.broadcast(files)
    return lines.join(files, "file", "left")


def _routed_plan(lines: DataFrame, formats: DataFrame) -> tuple[DataFrame, Column]:
    """(line table, candidate-array Column) with one parser per file. A file without a
    format row (no line to judge by) falls back to the SSH parser."""
    joined = _with_files(lines, formats.select("file", "format_key", "zeek_fields", "zeek_verb"))
    key = F.coalesce(F.col("format_key"), F.lit("SYSLOG_SSH"))
    http = (F.coalesce("zeek_fields", F.lit(0)) >= ZEEK_HTTP_FIELDS) & F.coalesce("zeek_verb", F.lit(False))
    layout = {"zeek_http": http, "zeek_ssh": ~http & (F.coalesce("zeek_fields", F.lit(0)) >= ZEEK_SSH_FIELDS)}
    return _matched(joined), _candidates({n: (key == f.format_key) & f.guard() & layout.get(n, F.lit(True))
                                          for n, f in FAMILY_TABLE.items()})


def parse_lines(lines: DataFrame, families: list[str] | None = None, layouts: DataFrame | None = None) -> DataFrame:
    """Mixed-file extraction (P9, P11): every line is tried against every family in one
    scan.

    A tab-separated row with a time in front is Zeek; its layout is that of its file
    (``layouts``, the table of ``detect.zeek_layouts``: header or first data row), and
    where nothing is known of the file the row's own: HTTP with at least ten fields and a
    verb in the eighth, else SSH with at least six. Any other line feeds the SSH families
    it matches, and Squid if it matches, else the access log. ``families`` restricts the
    result to some families."""
    return _explode(*_mixed_plan(lines, families, layouts))


def parse_routed(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """One parser per file, as chosen by format detection (S1 + D4).

    ``formats`` is the table of ``detect.detect_formats``. SYSLOG_SSH files run the
    three SSH families, NCSA_SQUID_HTTP files run Squid and access-log (a line that
    both accept is emitted twice), ZEEK_TSV files run the layout of the file's first
    data row (P6-P8; none under six fields), and files of a format with a parser of its
    own (``register_parser``) run that."""
    events = _explode(*_routed_plan(lines, formats))
    for key, parser in TABLE_PARSERS.items():
        own = formats.where(F.col("format_key") == key).select("file")
        events = events.unionByName(parser(lines.join(own, "file", "left_semi")).select(*EVENT_COLUMNS))
    return events


def line_event_counts(lines: DataFrame, families: list[str] | None = None, formats: DataFrame | None = None,
                      layouts: DataFrame | None = None, by_file: bool = False) -> DataFrame:
    """S3 + S10 + A21 in **one pass**: total lines (blank ones included) and the
    valid SSH / HTTP events they yield, counted from the candidate arrays before
    they are exploded, so the raw text is read once; one row, or one per file."""
    df, cands = _routed_plan(lines, formats) if formats is not None else _mixed_plan(lines, families, layouts)

    def valid(x, proto):
        return (x["source_ip"].isNotNull() & ~(x["family"].startswith("zeek") & (x["source_ip"] == "-"))
                & (x["protocol"] == proto))

    c = df.select("file", cands.alias("c"))
    return (c.groupBy("file") if by_file else c).agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.coalesce(F.sum(F.size(F.filter("c", lambda x: valid(x, "SSH")))), F.lit(0)).cast("bigint")
        .alias("valid_ssh_events"),
        F.coalesce(F.sum(F.size(F.filter("c", lambda x: valid(x, "HTTP")))), F.lit(0)).cast("bigint")
        .alias("valid_http_events"),
    )


def ssh_events(events: DataFrame) -> DataFrame:
    """SSH event view: src_ip, dest_host, auth_result, user, auth_method, timestamp."""
    return (events.where(F.col("protocol") == "SSH")
            .select(F.col("source_ip").alias("src_ip"), F.col("target").alias("dest_host"),
                    F.col("action").alias("auth_result"), "user", "auth_method", "timestamp"))


def http_events(events: DataFrame) -> DataFrame:
    """HTTP event view: src_ip, uri, verb, status_code, bytes_sent, timestamp."""
    return (events.where(F.col("protocol") == "HTTP")
            .select(F.col("source_ip").alias("src_ip"), F.col("target").alias("uri"),
                    F.col("action").alias("verb"), "status_code", "bytes_sent", "timestamp"))


def unified_view(events: DataFrame) -> DataFrame:
    """Six text columns with ``metadata`` as JSON, for exchange with other tools (P10)."""
    ssh_meta = F.to_json(F.struct("user", "auth_method", "dest_host"), {"ignoreNullFields": "false"})
    http_meta = F.to_json(F.struct("status_code", "bytes_sent"), {"ignoreNullFields": "false"})
    meta = F.when(F.col("protocol") == "SSH", ssh_meta).otherwise(http_meta)
    return events.select("timestamp", "source_ip", "protocol", "action", "target", meta.alias("metadata"))


def from_unified_view(unified: DataFrame) -> DataFrame:
    """Decode a six-column table back into typed event columns; missing JSON fields are NULL."""
    ssh = F.from_json("metadata", SSH_META)
    http = F.from_json("metadata", HTTP_META)
    is_ssh = F.col("protocol") == "SSH"
    return unified.select(
        "timestamp", "source_ip", "protocol", "action", "target",
        F.when(is_ssh, ssh["user"]).alias("user"),
        F.when(is_ssh, ssh["auth_method"]).alias("auth_method"),
        F.when(is_ssh, ssh["dest_host"]).alias("dest_host"),
        F.when(~is_ssh, http["status_code"]).alias("status_code"),
        F.when(~is_ssh, http["bytes_sent"]).alias("bytes_sent"),
        F.lit(None).cast("string").alias("family"),
        F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("bigint").alias("line_no"),
    )


def with_event_time(events: DataFrame, log_year: int) -> DataFrame:
    """Add typed ``event_ts``."""
    from loggraph.functions.timefmt import event_time
    return events.withColumn("event_ts", event_time("timestamp", log_year))
