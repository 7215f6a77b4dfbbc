"""Time-based operators.

Timestamps are parsed once into ``event_ts`` (X3). The web-to-SSH correlation (X1) is an
as-of lookup ("latest HTTP event of the same source at or before this SSH event, within
the window") done as a carry-forward scan over range slices, so no source, however hot
and however dense in time, is one partition, and no pairs are emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loggraph.functions.uri import is_static_asset, uri_prefix
from loggraph.operators.expand import cluster_predicate
from loggraph.operators.parse import with_event_time
from loggraph.session import materialize


def web_to_ssh(events: DataFrame, log_year: int, window_s: int = 300) -> DataFrame:
    """SSH events preceded by an HTTP event of the same source within ``window_s``.

    One row per matching SSH event: ``src_ip, dest_host, ssh_time, http_time,
    delta_s`` where ``http_time`` is the latest HTTP event at or before it.

    A carry-forward scan: all rows are range-partitioned by (source, time), so a source of
    any size spreads over as many slices as its rows fill; inside a slice a window carries
    the latest HTTP time on; the last HTTP time that a source leaves to its later slices
    comes from a table of slices (a row per source and slice, of which only sources with
    several slices are kept)."""
    ev = with_event_time(events, log_year).where(F.col("event_ts").isNotNull())
    # only the time of an HTTP event matters: one row per source and time
    http = (ev.where(F.col("protocol") == "HTTP").select(F.col("source_ip").alias("src_ip"), F.col("event_ts").alias("t")).distinct()
            .select("src_ip", "t", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("dest_host"), F.lit(None).cast("bigint").alias("line_no")))
    ssh = ev.where(F.col("protocol") == "SSH").select(
        F.col("source_ip").alias("src_ip"), F.col("event_ts").alias("t"), F.lit(1).alias("kind"), F.col("target").alias("dest_host"), "line_no")
    order = ["src_ip", "t", "kind", "dest_host", "line_no"]
    # written once: the bounds of the slices come from a sample
    rows = materialize(http.unionByName(ssh).repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "web_ssh_slices")
    http_t = F.when(F.col("kind") == 0, F.col("t"))
    ends = rows.groupBy("src_ip", "slice").agg(F.max(http_t).alias("last_http"))
    earlier = Window.partitionBy("src_ip").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most one source a slice goes on from an earlier one
    carried = ends.select("src_ip", "slice", F.max("last_http").over(earlier).alias("carried")).where("carried IS NOT NULL")
    inside = Window.partitionBy("slice", "src_ip").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (rows.withColumn("http_time", F.last(http_t, ignorenulls=True).over(inside)).where("kind = 1")
           .join(F.broadcast(carried), ["src_ip", "slice"], "left")
           .withColumn("http_time", F.coalesce("http_time", "carried")).where("http_time IS NOT NULL"))
    delta = F.unix_seconds(F.col("t")) - F.unix_seconds(F.col("http_time"))
    return (hit.withColumn("delta_s", delta).where(F.col("delta_s") <= window_s)
            .select("src_ip", "dest_host", F.col("t").alias("ssh_time"), "http_time", "delta_s"))


def timeline(events: DataFrame, log_year: int, bucket: str = "1 hour") -> DataFrame:
    """Events and failures per time bucket (bucket_start, event_count, failed_count)."""
    ev = with_event_time(events, log_year).where(F.col("event_ts").isNotNull())
    return (ev.groupBy(F.window("event_ts", bucket).alias("w"))
            .agg(F.count(F.lit(1)).alias("event_count"),
                 F.count_if(F.col("action") == "FAILURE").alias("failed_count"))
            .select(F.col("w.start").alias("bucket_start"), "event_count", "failed_count"))


def timeline_stream(events: DataFrame, log_year: int, bucket: str = "1 hour",
                    watermark: str = "1 hour") -> DataFrame:
    """X2 for a stream: the same buckets with a watermark, so finished buckets are
    emitted once and late rows beyond the watermark are dropped by Spark's rules."""
    ev = with_event_time(events, log_year).withWatermark("event_ts", watermark)
    return (ev.groupBy(F.window("event_ts", bucket).alias("w"))
            .agg(F.count(F.lit(1)).alias("event_count"),
                 F.count_if(F.col("action") == "FAILURE").alias("failed_count"))
            .select(F.col("w.start").alias("bucket_start"), "event_count", "failed_count"))


def off_hours_edges(events: DataFrame, log_year: int, start_hour: int = 22, end_hour: int = 6) -> DataFrame:
    """Per SSH edge, events in the off-hours window and the OFF_HOURS_ACCESS flag.

    No hours are given by the rules being reproduced; ``[start_hour, end_hour)``
    wrapping midnight is our parameter (default 22:00-06:00)."""
    ev = with_event_time(events, log_year).where(F.col("protocol") == "SSH")
    h = F.hour("event_ts")
    off = (h >= start_hour) | (h < end_hour) if start_hour > end_hour else (h >= start_hour) & (h < end_hour)
    agg = ev.groupBy(F.col("source_ip").alias("src_ip"), F.col("target").alias("dest_host")).agg(
        F.count(F.lit(1)).alias("total_attempts"), F.count_if(off).alias("off_hours_events"))
    return agg.withColumn("off_hours_access", F.col("off_hours_events") > 0)


def event_ids(lines: DataFrame) -> DataFrame:
    """Deterministic id per raw line: SHA-256 of file and line text."""
    return lines.select("file", "line_no",
                        F.sha2(F.concat_ws("\u0001", "file", "raw_line"), 256).alias("event_id"))


def node_rows_predicate(node_id: str):
    """The events behind one node: a URL prefix, a super-node, or a host."""
    if node_id.startswith("super:"):
        rows = cluster_predicate(node_id)
        if rows is None:
            raise ValueError(f"{node_id} names no cluster")
        return rows
    if node_id.startswith("url:"):
        key = node_id[len("url:"):]
        # the text before the first wildcard starts every matching target: that part of
        # the filter pushes down into the scan
        return ((F.col("protocol") == "HTTP") & F.col("target").startswith(key.split("*")[0])
                & (uri_prefix("target") == key) & ~is_static_asset("target"))
    key = node_id[len("host:"):] if node_id.startswith("host:") else node_id
    return (F.col("source_ip") == key) | ((F.col("protocol") == "SSH") & (F.col("target") == key))


def node_events(events: DataFrame, node_id: str, page_size: int = 50,
                after: tuple[str, int] | None = None) -> DataFrame:
    """Raw events behind one node, one page at a time.

    Paging uses a seek key ``(file, line_no)`` instead of an offset, so every page is a
    filter plus a bounded top-k. A key holds within one stored session: ``line_no`` is
    given when the text is read. The id of no cluster is an error."""
    ev = events.where(node_rows_predicate(node_id))
    if after is not None:
        f, n = after
        ev = ev.where((F.col("file") > f) | ((F.col("file") == f) & (F.col("line_no") > n)))
    return ev.orderBy("file", "line_no").limit(page_size)
