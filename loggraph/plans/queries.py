"""Registered queries: one per operator of the inventory, each run on the
driver's tables (rendered into log lines) and returning one DataFrame.

Every query reads the whole ``events`` table (and ``pages`` where absolute URLs
are needed); nothing is sampled or capped except where a limit is the operator
itself (top-k drill-down).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loggraph import constants as K
from loggraph.functions.net import is_private, subnet24
from loggraph.functions.uri import is_static_asset, uri_prefix
from loggraph.operators import edges as E
from loggraph.operators import graph as G
from loggraph.operators.detect import detect_formats, zeek_layouts
from loggraph.operators.parse import (
    http_events, parse_lines, parse_routed, ssh_events, unified_view,
)
from loggraph.plans.pipeline import session_meta
from loggraph.session import materialize
from loggraph.sources.render import render_lines, write_log_files

#: The rendered syslog lines carry no year; the given tables are of this one.
LOG_YEAR = 2024

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def report(df: DataFrame) -> DataFrame:
    """Flat, engine-neutral output: arrays as comma-joined text, integers as
    BIGINT, fractions as DOUBLE, timestamps as ``yyyy-MM-dd HH:mm:ss`` text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# shared building blocks
# ---------------------------------------------------------------------------

def lines_of(spark, sf, kind="mixed"):
    return render_lines(spark, sf, kind)


def events_of(spark, sf, kind="mixed", layouts=False):
    lines = lines_of(spark, sf, kind)
    return parse_lines(lines, layouts=zeek_layouts(lines) if layouts else None)


def all_events(spark, sf):
    """Every rendering (syslog, access, Squid, Zeek) through the mixed parser."""
    return events_of(spark, sf, "all")


def graph_of(spark, sf) -> G.Graph:
    return G.build_graph(events_of(spark, sf))


# ---------------------------------------------------------------------------
# sources, detection, parsing
# ---------------------------------------------------------------------------

@query("s10_protocol_counts")
def s10_protocol_counts(spark, sf):
    return report(session_meta(lines_of(spark, sf)))


@query("d_format_scores")
def d_format_scores(spark, sf):
    return report(detect_formats(lines_of(spark, sf, "all"), write=False).drop("zeek_fields", "zeek_verb"))


def _family(spark, sf, fam, kind="mixed", layouts=False):
    ev = events_of(spark, sf, kind, layouts)
    return report(ev.where(F.col("family") == fam))


@query("p1_ssh_accepted")
def p1(spark, sf):
    return _family(spark, sf, "ssh_accepted")


@query("p2_ssh_failed")
def p2(spark, sf):
    return _family(spark, sf, "ssh_failed")


@query("p3_ssh_invalid")
def p3(spark, sf):
    return _family(spark, sf, "ssh_invalid")


@query("p4_ncsa")
def p4(spark, sf):
    return _family(spark, sf, "ncsa")


@query("p5_squid")
def p5(spark, sf):
    return _family(spark, sf, "squid", "all")


@query("p6_zeek_http")
def p6(spark, sf):
    return _family(spark, sf, "zeek_http", "files", layouts=True)


@query("p7_zeek_ssh")
def p7(spark, sf):
    return _family(spark, sf, "zeek_ssh", "files", layouts=True)


@query("p11_mixed_family_counts")
def p11(spark, sf):
    """Every rendered file, odd ones included, through the per-line parser."""
    ev = events_of(spark, sf, "files", layouts=True)
    return report(ev.groupBy("file", "family", "protocol").agg(F.count(F.lit(1)).alias("n")))


@query("p9_unified_events")
def p9(spark, sf):
    ev = events_of(spark, sf)
    return report(unified_view(ev))


def _log_folder(spark, sf):
    """All renderings written as text files and read back."""
    return write_log_files(lines_of(spark, sf, "files"), f"{_scratch(spark, 'logs')}/files")


@query("r1_routed_events")
def r1(spark, sf):
    """Log files -> format per file -> one parser per file."""
    lines = _log_folder(spark, sf)
    return report(parse_routed(lines, detect_formats(lines)).drop("line_no"))


@query("r2_routed_counts")
def r2(spark, sf):
    """Chosen format and events per file; a file without a judged line has no format."""
    lines = _log_folder(spark, sf)
    formats = detect_formats(lines)
    events = parse_routed(lines, formats).groupBy("file").agg(
        F.count_if(F.col("protocol") == "SSH").alias("ssh_events"), F.count_if(F.col("protocol") == "HTTP").alias("http_events"))
    found = formats.select("file", "format_key").join(events, "file", "full")
    return report(found.select("file", "format_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ssh_events", "http_events")]))


# ---------------------------------------------------------------------------
# scalar functions over every distinct value
# ---------------------------------------------------------------------------

@query("f1_static_filter")
def f1(spark, sf):
    uris = all_events(spark, sf).where(F.col("protocol") == "HTTP").select(F.col("target").alias("uri")).distinct()
    return report(uris.withColumn("is_static", is_static_asset("uri")))


@query("f2_uri_collapse")
def f2(spark, sf):
    uris = all_events(spark, sf).where(F.col("protocol") == "HTTP").select(F.col("target").alias("uri")).distinct()
    return report(uris.withColumn("uri_prefix", uri_prefix("uri")))


def _addresses(spark, sf):
    ev = all_events(spark, sf)
    return (ev.select(F.col("source_ip").alias("ip"))
            .union(ev.where(F.col("protocol") == "SSH").select(F.col("target").alias("ip"))).distinct())


@query("f3_private_ip")
def f3(spark, sf):
    return report(_addresses(spark, sf).withColumn("is_private", is_private("ip")))


@query("f4_subnet24")
def f4(spark, sf):
    return report(_addresses(spark, sf).withColumn("subnet", subnet24("ip")))


# ---------------------------------------------------------------------------
# edges
# ---------------------------------------------------------------------------

@query("a1_ssh_edges")
def a1(spark, sf):
    return report(E.ssh_edge_counts(ssh_events(events_of(spark, sf))))


@query("a9_ssh_scored")
def a9(spark, sf):
    return report(E.ssh_edges(ssh_events(events_of(spark, sf))))


@query("a10_http_edges")
def a10(spark, sf):
    return report(E.http_edge_counts(http_events(events_of(spark, sf))))


@query("a14_http_scored")
def a14(spark, sf):
    return report(E.http_edges(http_events(events_of(spark, sf))))


CHUNK_LINES = 1000


def _chunked(ev):
    return ev.withColumn("chunk", F.floor(F.col("line_no") / CHUNK_LINES))


@query("a15_merge_http")
def a15(spark, sf):
    """Per-chunk partial HTTP state merged, then scored: equals the one-shot edges."""
    ev = _chunked(events_of(spark, sf))
    http = ev.where(F.col("protocol") == "HTTP").select(
        F.col("source_ip").alias("src_ip"), F.col("target").alias("uri"), F.col("action").alias("verb"),
        "status_code", "timestamp", "chunk")
    parts = E.http_status_counts(http, extra_keys=["chunk"])
    merged = E.merge_http_counts(parts).drop("status_counts")
    return report(E.score_http_edges(merged))


@query("a16_merge_ssh")
def a16(spark, sf):
    """Per-chunk partial SSH state merged, then scored: equals the one-shot edges."""
    ev = _chunked(events_of(spark, sf))
    ssh = ev.where(F.col("protocol") == "SSH").select(
        F.col("source_ip").alias("src_ip"), F.col("target").alias("dest_host"),
        F.col("action").alias("auth_result"), "user", "timestamp", "chunk")
    parts = E.ssh_user_counts(ssh, extra_keys=["chunk"])
    return report(E.score_ssh_edges(E.merge_ssh_counts(parts)))


# ---------------------------------------------------------------------------
# graph
# ---------------------------------------------------------------------------

@query("g3_attack_chain")
def g3(spark, sf):
    ev = events_of(spark, sf)
    http_e = E.http_edges(http_events(ev))
    rows = G.ssh_edge_rows(E.ssh_edges(ssh_events(ev)), http_e)
    return report(rows.select("id", "source", "target", "weight", "anomaly_flags", "is_anomalous"))


@query("g4_node_risk")
def g4(spark, sf):
    g = graph_of(spark, sf)
    return report(g.node_risk.select("id", "risk", "touch", "layer", "is_signal", "super_id"))


@query("g7_signal_split")
def g7(spark, sf):
    g = graph_of(spark, sf)
    return report(g.node_risk.groupBy("layer", "is_signal").agg(F.count(F.lit(1)).alias("n")))


def _touching(spark, sf, super_id):
    g = graph_of(spark, sf)
    return report(g.edges.where((F.col("source") == super_id) | (F.col("target") == super_id)))


@query("g8_external_collapse")
def g8(spark, sf):
    return _touching(spark, sf, K.SUPER_EXTERNAL_NOISE)


@query("g9_web_collapse")
def g9(spark, sf):
    return _touching(spark, sf, K.SUPER_WEB_SURFACE)


@query("g10_internal_collapse")
def g10(spark, sf):
    return _touching(spark, sf, K.SUPER_INTERNAL_BASELINE)


@query("g11_degrees")
def g11(spark, sf):
    return report(G.degrees(graph_of(spark, sf).edges))


@query("g12_nodes")
def g12(spark, sf):
    return report(graph_of(spark, sf).nodes)


@query("g13_edge_ends")
def g13(spark, sf):
    """Edge ends, and those of them that are no node of the graph."""
    g = graph_of(spark, sf)
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("id"))
    there = g.nodes.select(F.col("id").alias("node"))
    return report(ends.join(there, F.col("id") == F.col("node"), "left").agg(
        F.count(F.lit(1)).alias("ends"), F.count_if(F.col("node").isNull()).alias("dangling")))


@query("g14_edges")
def g14(spark, sf):
    return report(G.merge_parallel_edges(graph_of(spark, sf).edges))


@query("g14_merged_chunks")
def g14_chunks(spark, sf):
    """Scored edges of two halves of the events, merged: edges of both halves meet."""
    ev = events_of(spark, sf)
    halves = [G.build_graph(ev.where(F.pmod("line_no", F.lit(2)) == h)).raw_edges for h in (0, 1)]
    return report(G.merge_parallel_edges(halves[0].unionByName(halves[1])))


@query("g2_edge_users")
def g2_users(spark, sf):
    """The long table of users per SSH edge."""
    return report(graph_of(spark, sf).edge_users)


@query("a17_summary")
def a17(spark, sf):
    return report(graph_of(spark, sf).summary)


# ---------------------------------------------------------------------------
# cluster overview and drill-down
# ---------------------------------------------------------------------------

def overview_of(spark, sf):
    from loggraph.operators.clusters import build_overview
    return build_overview(events_of(spark, sf))


@query("c3_super_edges")
def c3(spark, sf):
    return report(overview_of(spark, sf).super_edges)


@query("c4_super_nodes")
def c4(spark, sf):
    return report(overview_of(spark, sf).super_nodes)


@query("c6_cluster_members")
def c6(spark, sf):
    return report(overview_of(spark, sf).members)


@query("a18_cluster_summary")
def a18(spark, sf):
    return report(overview_of(spark, sf).summary)


SUBNET_EXAMPLE = "super:subnet:10.0.1.0/24"


def _expand(spark, sf, super_id, part="nodes"):
    from loggraph.operators.expand import expand
    x = expand(events_of(spark, sf), super_id)
    return report(getattr(x, part))


@query("e1_expand_external")
def e1(spark, sf):
    return _expand(spark, sf, K.SUPER_EXTERNAL_THREATS)


@query("e2_expand_subnet")
def e2(spark, sf):
    return _expand(spark, sf, SUBNET_EXAMPLE)


@query("e3_expand_web")
def e3(spark, sf):
    return _expand(spark, sf, K.SUPER_WEB_SURFACE)


@query("e4_expand_internal")
def e4(spark, sf):
    return _expand(spark, sf, K.SUPER_INTERNAL_BASELINE)


@query("k1_top75_edges")
def k1(spark, sf):
    return _expand(spark, sf, K.SUPER_INTERNAL_BASELINE, "edges")


SMALL_K = 25


@query("k1_cut_nodes")
def k1_small(spark, sf):
    """A cap that cuts: the 25 first nodes, each with "n of m"."""
    from loggraph.operators.expand import expand
    x = expand(events_of(spark, sf), K.SUPER_INTERNAL_BASELINE, SMALL_K)
    kept = x.nodes.agg(F.count(F.lit(1)))
    return report(x.nodes.withColumns({"kept_nodes": kept.scalar(), "total_nodes": x.total_nodes.scalar()}))


@query("k1_cut_edges")
def k1_small_edges(spark, sf):
    """Edges among the 25 kept nodes: the induced filter removes the others."""
    from loggraph.operators.expand import expand
    return report(expand(events_of(spark, sf), K.SUPER_INTERNAL_BASELINE, SMALL_K).edges)


@query("k2_top60")
def k2(spark, sf):
    from loggraph.operators.expand import top_nodes
    g = graph_of(spark, sf)
    return report(top_nodes(g.nodes, g.edges, K.CLIENT_MAX_NODES)[0])


@query("k2_capped_view")
def k2_capped(spark, sf):
    """The client's view of the external drill-down, with "n of m" beside each node; at a
    cap that cuts."""
    from loggraph.operators.expand import capped_view, expand
    return report(capped_view(expand(events_of(spark, sf), K.SUPER_EXTERNAL_THREATS), CAP_THAT_CUTS).withColumn(
        "capped", F.col("capped").cast("int")))


CAP_THAT_CUTS = 5


# ---------------------------------------------------------------------------
# analyst-side operators
# ---------------------------------------------------------------------------

@query("f9_f11_edge_classes")
def f9_f11(spark, sf):
    from loggraph.operators.analyst import classify_edges
    c = classify_edges(graph_of(spark, sf).edges)
    return report(c.select("id", F.round("prominence", 6).alias("prominence"), "dominant_flag", "edge_class"))


@query("f11_attack_only")
def f11(spark, sf):
    from loggraph.operators.analyst import filter_edges
    c = filter_edges(graph_of(spark, sf).edges, hide_noise=True, hide_scan=True)
    return report(c.select("id", "source", "target", "edge_class"))


@query("f12_f13_node_classes")
def f12_f13(spark, sf):
    from loggraph.operators.analyst import classify_nodes
    return report(classify_nodes(graph_of(spark, sf).nodes).select("id", "risk_band", "risk_tier"))


@query("k3_layer_rank")
def k3(spark, sf):
    from loggraph.operators.analyst import layer_rank
    return report(layer_rank(graph_of(spark, sf).nodes).select("id", "layer", "risk_tier", "rank_in_tier"))


@query("k4_parallel_ordinal")
def k4(spark, sf):
    from loggraph.operators.analyst import parallel_ordinal
    g = graph_of(spark, sf)
    return report(parallel_ordinal(g.raw_edges).select("id", "parallel_index", "parallel_count"))


@query("j6_ego")
def j6(spark, sf):
    """Edges around the highest-risk node (ties: smallest id)."""
    from loggraph.operators.analyst import ego_edges
    g = graph_of(spark, sf)
    top = g.nodes.orderBy(F.desc("risk_score"), F.asc("id")).limit(1).select("id")
    return report(ego_edges(g.edges, F.broadcast(top), g.edge_users))


@query("j7_neighbours")
def j7(spark, sf):
    """Nodes adjacent to the members of the internal-baseline super-node."""
    from loggraph.operators.analyst import neighbours
    g = graph_of(spark, sf)
    members = g.node_risk.where(F.col("super_id") == K.SUPER_INTERNAL_BASELINE).select("id")
    return report(neighbours(g.raw_edges, members))


@query("a20_node_type_counts")
def a20(spark, sf):
    from loggraph.operators.analyst import node_type_counts
    return report(node_type_counts(graph_of(spark, sf).nodes))


# ---------------------------------------------------------------------------
# time, classes, extras
# ---------------------------------------------------------------------------

@query("x1_web_ssh_300s")
def x1(spark, sf):
    from loggraph.operators.timeline import web_to_ssh
    return report(web_to_ssh(events_of(spark, sf), LOG_YEAR))


@query("x2_timeline")
def x2(spark, sf):
    from loggraph.operators.timeline import timeline
    return report(timeline(events_of(spark, sf), LOG_YEAR))


@query("x3_event_time")
def x3(spark, sf):
    from loggraph.operators.parse import with_event_time
    ev = with_event_time(all_events(spark, sf), LOG_YEAR)
    return report(ev.select("timestamp", "protocol", "event_ts").distinct())


@query("x4_off_hours")
def x4(spark, sf):
    from loggraph.operators.timeline import off_hours_edges
    return report(off_hours_edges(events_of(spark, sf), LOG_YEAR))


@query("x4_off_hours_flags")
def x4_flags(spark, sf):
    """Edges whose flags include the off-hours one."""
    from loggraph.operators.timeline import off_hours_edges
    ev = events_of(spark, sf)
    g = G.build_graph(ev, off_hours=off_hours_edges(ev, LOG_YEAR))
    return report(g.raw_edges.where(F.array_contains("anomaly_flags", "OFF_HOURS_ACCESS")).select("id", "anomaly_flags", "weight"))


@query("x5_scanners")
def x5(spark, sf):
    from loggraph.operators.classes import scanners
    return report(scanners(events_of(spark, sf)))


@query("x6_benign_ssh")
def x6(spark, sf):
    from loggraph.operators.classes import benign_ssh_sources
    return report(benign_ssh_sources(events_of(spark, sf)))


@query("x7_url_clusters")
def x7(spark, sf):
    from loggraph.operators.classes import url_clusters
    return report(url_clusters(graph_of(spark, sf).node_risk))


@query("x8_exempt_nodes")
def x8(spark, sf):
    from loggraph.operators.classes import exempt_nodes
    g = graph_of(spark, sf)
    return report(exempt_nodes(g.node_risk, g.raw_edges))


@query("x9_super_aggregates")
def x9(spark, sf):
    from loggraph.operators.classes import super_aggregates
    g = graph_of(spark, sf)
    return report(super_aggregates(g.node_risk, g.raw_edges))


@query("x10_summary_extras")
def x10(spark, sf):
    from loggraph.operators.classes import summary_extras
    g = graph_of(spark, sf)
    return report(summary_extras(g.node_risk, g.nodes))


@query("x12_event_id")
def x12(spark, sf):
    from loggraph.operators.timeline import event_ids
    return report(event_ids(lines_of(spark, sf)))


NODE_EXAMPLE = "host:10.0.9.9"


@query("x13_node_events")
def x13(spark, sf):
    from loggraph.operators.timeline import node_events
    return report(node_events(events_of(spark, sf), NODE_EXAMPLE, page_size=50))


@query("x13_url_events")
def x13_url(spark, sf):
    from loggraph.operators.timeline import node_events
    return report(node_events(events_of(spark, sf), "url:/api/v1", page_size=50))


@query("x13_cluster_events")
def x13_cluster(spark, sf):
    from loggraph.operators.timeline import node_events
    return report(node_events(events_of(spark, sf), K.SUPER_EXTERNAL_THREATS, page_size=50, after=("access.log", 500)))


# ---------------------------------------------------------------------------
# session store and streaming
# ---------------------------------------------------------------------------

def _scratch(spark, name):
    import uuid

    from loggraph.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s9_session_scan")
def s9(spark, sf):
    """Store the parsed session (S8), scan it back pruned by session id (S9), count."""
    from loggraph.sources.store import load_session, protocol_counts, store_session
    root = _scratch(spark, "sessions")
    store_session(events_of(spark, sf), root, "sess_a")
    return report(protocol_counts(load_session(spark, root, "sess_a")))


@query("a21_session_record")
def a21(spark, sf):
    """The session's record, one row per log file."""
    from loggraph.plans.pipeline import session_record
    return report(session_record(lines_of(spark, sf), "sess_a"))


@query("s5_numbered_chunks")
def s5(spark, sf):
    """Every line of the written logs with its real number, its chunk and the totals of
    its file."""
    from loggraph.sources.lines import number_lines
    path = f"{_scratch(spark, 'logs')}/files"
    write_log_files(lines_of(spark, sf), path)
    lines = number_lines(spark, path, chunk_lines=CHUNK_LINES)
    name = F.regexp_extract("file", "/key=([^/]+)/", 1)
    return report(lines.select(name.alias("file"), "line_no", "raw_line", "chunk_index", "total_chunks", "total_lines"))


def _head_formats(spark, sf, head_bytes):
    from loggraph.operators.detect import sample_heads
    from loggraph.sources.lines import read_heads
    path = f"{_scratch(spark, 'logs')}/files"
    write_log_files(lines_of(spark, sf, "files"), path)
    heads = read_heads(spark, path, head_bytes).withColumn("file", F.regexp_extract("file", "/key=([^/]+)/", 1))
    return report(detect_formats(sample_heads(heads), write=False).drop("zeek_fields", "zeek_verb"))


@query("d5_upload_heads")
def d5_upload(spark, sf):
    """Formats from the first 16 KiB of each file."""
    from loggraph.operators.detect import SNIFF_BYTES
    return _head_formats(spark, sf, SNIFF_BYTES)


@query("d5_stream_heads")
def d5_stream(spark, sf):
    """Formats from the first 64 KiB of each file."""
    from loggraph.operators.detect import STREAM_SNIFF_BYTES
    return _head_formats(spark, sf, STREAM_SNIFF_BYTES)


@query("d5_short_heads")
def d5_short(spark, sf):
    """Formats from heads so short that they cut lines and samples."""
    return _head_formats(spark, sf, 700)


@query("s8_ranged_host")
def s8_ranged(spark, sf):
    """Events of one host from a session dealt out by address range."""
    from loggraph.sources.store import load_session, store_session
    root = _scratch(spark, "sessions")
    store_session(events_of(spark, sf), root, "sess_r", ranged=True)
    return report(load_session(spark, root, "sess_r").where(F.col("source_ip") == "10.0.9.9").drop("family", "file"))


@query("s9_restored_session")
def s9_restored(spark, sf):
    """Storing a session again replaces it whole; ids are text; an unknown id is empty."""
    from loggraph.sources.store import load_session, protocol_counts, store_session
    root, ev = _scratch(spark, "sessions"), events_of(spark, sf)
    store_session(ev, root, "7")
    store_session(ev.where("protocol = 'SSH'"), root, "7")
    store_session(ev, root, "007")
    parts = [protocol_counts(load_session(spark, root, i)).withColumn("session", F.lit(i)) for i in ("7", "007", "none")]
    return report(parts[0].unionByName(parts[1]).unionByName(parts[2]))


STREAM_PARTS = 4


def _stream(spark, sf, kind="mixed"):
    """Render the logs into four folders of text files (line_no modulo four, written one
    after another, each by as many tasks as the cluster has slots), then stream them, one
    folder's files a micro-batch."""
    from loggraph.streaming.ingest import StreamIngest
    base, files = _scratch(spark, "stream"), spark.sparkContext.defaultParallelism
    lines = lines_of(spark, sf, kind)
    for part in range(STREAM_PARTS):
        (lines.where(F.pmod("line_no", F.lit(STREAM_PARTS)) == part).select("raw_line").repartition(files)
         .write.text(f"{base}/logs/part={part}"))
    return StreamIngest(spark, f"{base}/state").run(f"{base}/logs", max_files_per_trigger=files)


@query("t2_stream_summary")
def t2(spark, sf):
    """Micro-batch ingest (AvailableNow) then the graph over the merged snapshot."""
    return report(_stream(spark, sf).graph().summary)


@query("t1_stream_all_formats")
def t1(spark, sf):
    """Lines of all formats, mixed in every file, through the stream."""
    ev = _stream(spark, sf, "files").events()
    return report(ev.groupBy("family", "protocol").agg(F.count(F.lit(1)).alias("n")))


@query("t2_stream_overview")
def t2_overview(spark, sf):
    """The stream's session gives the cluster overview."""
    return report(_stream(spark, sf).overview().super_nodes)


@query("t2_stream_expand")
def t2_expand(spark, sf):
    """... and drill-downs."""
    from loggraph.operators.expand import expand
    return report(expand(_stream(spark, sf).events(), K.SUPER_INTERNAL_BASELINE).nodes)


@query("k5_running_totals")
def k5(spark, sf):
    """Global totals after each micro-batch."""
    return report(_stream(spark, sf).running_totals())


K5_BATCHES = 50


@query("k5_totals_of_fifty")
def k5_fifty(spark, sf):
    """Totals after each of fifty batches of events, one job."""
    from loggraph.streaming.totals import totals_by_batch
    ev = events_of(spark, sf).withColumn("b", F.pmod("line_no", F.lit(K5_BATCHES)))
    return report(totals_by_batch(materialize(E.edge_facts(ev, "b"), "batch_facts"), spark.range(K5_BATCHES).select(F.col("id").alias("b"))))


@query("t4_edge_state")
def t4(spark, sf):
    """Edges as keyed streaming state, read from the state store after four triggers."""
    files = spark.sparkContext.defaultParallelism
    return report(_stream(spark, sf).update_edges(files_per_trigger=files).edge_counts())


@query("t4_state_summary")
def t4_summary(spark, sf):
    """The graph of the keyed state; no stored batch is read."""
    return report(_stream(spark, sf).update_edges().state_graph().summary)


@query("t5_chunks")
def t5(spark, sf):
    """Chunk index, lines, estimated total and percent of the listed bytes per micro-batch."""
    return report(_stream(spark, sf).chunks())


@query("x11_bounded_overview")
def x11(spark, sf):
    """Overview capped at 50 super-nodes: /24 subnets, else /16, else one internal node."""
    from loggraph.operators.classes import bounded_overview
    ov, level, _ = bounded_overview(events_of(spark, sf))
    return report(ov.super_nodes.select("id", "child_count", F.lit(level).alias("cluster_level")))


X11_BOUND = 8


@query("x11_prefix_nodes")
def x11_prefix(spark, sf):
    """At most eight super-nodes: the largest /24 stay, the smallest branches merge."""
    from loggraph.operators.classes import prefix_overview
    return report(prefix_overview(events_of(spark, sf), X11_BOUND).super_nodes.select("id", "child_count"))


@query("x11_prefix_edges")
def x11_prefix_edges(spark, sf):
    from loggraph.operators.classes import prefix_overview
    return report(prefix_overview(events_of(spark, sf), X11_BOUND).super_edges)


@query("x11_coarse_edges")
def x11_coarse(spark, sf):
    """Super-edges of the two coarser levels, each forced by its bound."""
    from loggraph.operators.classes import bounded_overview
    from loggraph.operators.clusters import LEVELS
    out = []
    for level, bound in zip(LEVELS[1:], (5, 3)):
        ov, reached, within = bounded_overview(events_of(spark, sf), bound)
        out.append(ov.super_edges.withColumn("level", F.lit(f"{level} {reached == level} {within}")))
    return report(out[0].unionByName(out[1]))


@query("e5_expand_unknown")
def e5(spark, sf):
    """An id that names no cluster adds nothing to one that does."""
    from loggraph.operators.expand import expand
    ev = events_of(spark, sf)
    ids = ["super:no_such_cluster", K.SUPER_EXTERNAL_THREATS]
    both = [expand(ev, i).nodes.withColumn("cluster_id", F.lit(i)) for i in ids]
    return report(both[0].unionByName(both[1]))


@query("s11_expand_payload")
def s11(spark, sf):
    """The drill-down result (at most 75 nodes) as one nested JSON document, read back
    into its node rows."""
    from loggraph.operators.expand import expand
    from loggraph.sources.store import bounded_payload
    x = expand(events_of(spark, sf), K.SUPER_INTERNAL_BASELINE)
    shape = T.StructType([T.StructField("nodes", T.ArrayType(x.nodes.schema))])
    document = bounded_payload(x.nodes, x.edges).select(F.from_json("payload", shape).alias("d"))
    return report(document.select(F.inline("d.nodes")))
