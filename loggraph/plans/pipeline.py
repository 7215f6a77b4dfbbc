"""End-to-end pipelines a user runs: log folder in, graph / overview out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loggraph.operators.graph import Graph, build_graph
from loggraph.operators.parse import parse_lines, parse_routed
from loggraph.sources.lines import read_heads, read_lines


@dataclass
class Analysis:
    lines: DataFrame
    events: DataFrame
    graph: Graph
    meta: DataFrame


def session_meta(lines: DataFrame, routed_formats: DataFrame | None = None) -> DataFrame:
    """A21 + S3 + S10: total lines, SSH and HTTP event counts, one pass over the lines."""
    from loggraph.operators.parse import line_event_counts
    return line_event_counts(lines, formats=routed_formats)


def session_record(lines: DataFrame, session_id: str, routed_formats: DataFrame | None = None) -> DataFrame:
    """The record of a session, one row per log file: session id, file, total lines,
    valid SSH and HTTP events."""
    from loggraph.operators.parse import line_event_counts
    counts = line_event_counts(lines, formats=routed_formats, by_file=True)
    return counts.select(F.lit(session_id).alias("session_id"), F.col("file").alias("log_filename"),
                         F.col("total_lines").alias("total_lines_parsed"), "valid_ssh_events", "valid_http_events")


def analyze_lines(lines: DataFrame, routed_formats: DataFrame | None = None,
                  materialize: bool = True, layouts: DataFrame | None = None) -> Analysis:
    """Parse and build the graph; ``routed_formats`` picks one parser per file, ``layouts``
    (``detect.zeek_layouts``) tells the per-line parser what files hold Zeek HTTP rows."""
    events = parse_lines(lines, layouts=layouts) if routed_formats is None else parse_routed(lines, routed_formats)
    g = build_graph(events, materialize=materialize)
    return Analysis(lines=lines, events=events, graph=g, meta=session_meta(lines, routed_formats))


def ingest(lines: DataFrame, session_root: str, session_id: str,
           routed_formats: DataFrame | None = None, layouts: DataFrame | None = None) -> DataFrame:
    """Parse raw lines once and store them as a session (S8); return the stored
    session as a lazy, partition-pruned scan (S9).

    Raw text is parsed exactly once; graph, overview, drill-down and timeline
    queries then read compact columnar events and push their filters (protocol
    partition, ``startswith`` on addresses) into the scan."""
    from loggraph.sources.store import load_session, store_session
    events = parse_lines(lines, layouts=layouts) if routed_formats is None else parse_routed(lines, routed_formats)
    store_session(events, session_root, session_id)
    return load_session(lines.sparkSession, session_root, session_id)


def analyze_path(spark: SparkSession, path: str, route: bool = False) -> Analysis:
    """Log folder -> graph. ``route=True`` classifies every file first (D1-D5); else every
    line is parsed by its content, and only the heads of the files are read before."""
    lines = read_lines(spark, path)
    if route:
        from loggraph.operators.detect import detect_formats
        return analyze_lines(lines, detect_formats(lines))
    from loggraph.operators.detect import STREAM_SNIFF_BYTES, zeek_layouts
    heads = read_heads(spark, path, STREAM_SNIFF_BYTES)
    return analyze_lines(lines, layouts=zeek_layouts(heads))
