"""Signal/noise graph construction.

The sequential "collapse external, then web, then internal" procedure is
expressed relationally, which makes it order-free and distributable::

    contrib  = every edge end with its risk (1.2 x for an SSH destination)
    node     = contrib group by id -> risk = max, touch = bool_or(anomalous)
    signal   = risk >= 3.0 or touch; noise nodes map to one super id per layer
    e2       = edges left join noise_map on source, left join on target
    pass     = edges with neither end collapsed (kept as they are)
    merged   = collapsed edges, minus self loops and edges into external noise,
               grouped by (new_source, new_target) with summed attempts

Shuffles: one per edge aggregate (upstream), one for the node aggregate, the two
remap joins (AQE turns them into broadcasts when the noise map is small and
splits skewed target partitions otherwise), one for the merged edges and one for
degrees. No driver collection, no cross join, no Python in the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggraph import constants as K
from loggraph.functions.flags import flag_list
from loggraph.functions.net import is_private
from loggraph.operators import edges as E
from loggraph.session import drop_table
from loggraph.session import materialize as write_table

EDGE_COLUMNS = [
    "id", "source", "target", "edge_type", "weight", "total_attempts", "http_verb", "status_code",
    "uri_path", "successful_auths", "failed_auths", "distinct_users", "anomaly_flags", "is_anomalous",
    "first_timestamp", "last_timestamp",
]
NODE_COLUMNS = ["id", "label", "node_type", "in_degree", "out_degree", "risk_score", "layer",
                "is_signal", "is_noise_super"]



def _empty_strs():
    return F.array().cast("array<string>")


@dataclass
class Graph:
    """Result of :func:`build_graph`: presentation nodes and edges plus summary.

    Nothing is cached: what several outputs read is written once under the shared
    checkpoint folder. As a context the graph deletes these tables at its end::

        with build_graph(events) as g:
            g.nodes.write..., g.edges.write...
    """
    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame
    raw_edges: DataFrame      # scored edges before collapse (G1-G3)
    node_risk: DataFrame      # every raw node with risk, touch, layer, signal, super id
    edge_users: DataFrame | None = None   # long table (id, user) of the SSH edges
    tables: list[DataFrame] = field(default_factory=list)   # written for this graph

    def __enter__(self) -> "Graph":
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        """Delete the tables written for the graph; its outputs can't be read afterwards."""
        for df in self.tables:
            drop_table(df)
        self.tables.clear()


# ---------------------------------------------------------------------------
# Edge rows
# ---------------------------------------------------------------------------

def http_edge_rows(http_e: DataFrame) -> DataFrame:
    """G1: scored HTTP edges as presentation edge rows."""
    flags = flag_list([(F.col("is_post"), "WEB_EXPLOIT_POST"), (F.col("has_4xx"), "HTTP_4XX_SCAN")])
    return http_e.select(
        F.concat(F.lit("edge:"), "src_ip", F.lit("->"), "uri_prefix", F.lit(":"), "verb").alias("id"),
        F.concat(F.lit("host:"), "src_ip").alias("source"),
        F.concat(F.lit("url:"), "uri_prefix").alias("target"),
        F.lit("HTTP_REQUEST").alias("edge_type"),
        F.col("risk_score").alias("weight"),
        F.col("total_attempts").cast("bigint").alias("total_attempts"),
        F.col("verb").alias("http_verb"),
        F.col("status_code").cast("int").alias("status_code"),
        F.col("uri_prefix").alias("uri_path"),
        F.lit(0).cast("bigint").alias("successful_auths"),
        F.lit(0).cast("bigint").alias("failed_auths"),
        _empty_strs().alias("distinct_users"),
        flags.alias("anomaly_flags"),
        "is_anomalous", "first_timestamp", "last_timestamp",
    )


def http_source_risk(http_e: DataFrame) -> DataFrame:
    """Per source: highest HTTP edge risk (input of the chain test, J1)."""
    return http_e.groupBy("src_ip").agg(F.max("risk_score").alias("http_src_risk"))


def ssh_edge_rows(ssh_e: DataFrame, http_e: DataFrame | None, off_hours: DataFrame | None = None) -> DataFrame:
    """G2 + G3: scored SSH edges; a source with HTTP risk > 2.0 marks a full chain.

    The chain test reads HTTP-derived source risk only, which makes it
    independent of row order (divergence V1). ``off_hours`` (``timeline.off_hours_edges``)
    adds the OFF_HOURS_ACCESS flag (X4); scores do not depend on it."""
    if "distinct_users" not in ssh_e.columns:
        ssh_e = ssh_e.withColumn("distinct_users", _empty_strs())
    if http_e is not None:
        src = ssh_e.join(http_source_risk(http_e), "src_ip", "left")
        chain = F.coalesce(F.col("http_src_risk"), F.lit(0.0)) > K.CHAIN_SOURCE_RISK
    else:
        src = ssh_e
        chain = F.lit(False)
    late = F.lit(False)
    if off_hours is not None:
        src = src.join(off_hours.select("src_ip", "dest_host", "off_hours_access"), ["src_ip", "dest_host"], "left")
        late = F.coalesce("off_hours_access", F.lit(False))
    weight = F.when(chain, F.round(F.col("risk_score") + K.CHAIN_RISK_BONUS, 2)).otherwise(F.col("risk_score"))
    flags = flag_list([
        (F.col("is_brute_force"), "BRUTE_FORCE_BURST"),
        (F.col("has_priv_user"), "PRIVILEGE_PIVOT"),
        (F.col("has_priv_user"), "SSH_PRIVILEGE_PIVOT"),
        (F.col("is_multi_pivot"), "RARE_PIVOT_PATH"),
        (chain, "FULL_ATTACK_CHAIN"),
        (late, "OFF_HOURS_ACCESS"),
    ])
    return src.select(
        F.concat(F.lit("edge:"), "src_ip", F.lit("->"), "dest_host").alias("id"),
        F.concat(F.lit("host:"), "src_ip").alias("source"),
        F.concat(F.lit("host:"), "dest_host").alias("target"),
        F.lit("SSH_AUTH").alias("edge_type"),
        weight.alias("weight"),
        F.col("total_attempts").cast("bigint").alias("total_attempts"),
        F.lit(None).cast("string").alias("http_verb"),
        F.lit(None).cast("int").alias("status_code"),
        F.lit(None).cast("string").alias("uri_path"),
        F.col("successful_auths").cast("bigint").alias("successful_auths"),
        F.col("failed_auths").cast("bigint").alias("failed_auths"),
        "distinct_users",
        flags.alias("anomaly_flags"),
        "is_anomalous", "first_timestamp", "last_timestamp",
    )


# ---------------------------------------------------------------------------
# Node risk and signal split
# ---------------------------------------------------------------------------

def _layer(node_id):
    label = F.regexp_replace(node_id, "^(host|url):", "")
    return (F.when(node_id.startswith("url:"), F.lit("web"))
            .when(is_private(label), F.lit("internal"))
            .otherwise(F.lit("external")))


def node_risk(edge_rows: DataFrame) -> DataFrame:
    """One row per raw node: risk (max contribution), touch, layer, signal, super id.

    Each edge contributes to both ends; the SSH destination gets 1.2 x risk."""
    dest_factor = F.when(F.col("edge_type") == "SSH_AUTH", F.lit(K.DEST_RISK_FACTOR)).otherwise(F.lit(1.0))
    ends = edge_rows.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("weight").alias("risk"), F.col("is_anomalous").alias("anom")),
        F.struct(F.col("target").alias("id"), (F.col("weight") * dest_factor).alias("risk"),
                 F.col("is_anomalous").alias("anom")),
    )).alias("c")).select("c.*")
    nodes = ends.groupBy("id").agg(F.max("risk").alias("risk"), F.bool_or("anom").alias("touch"))
    layer = _layer(F.col("id"))
    is_signal = (F.col("risk") >= K.SIGNAL_RISK_THRESHOLD) | F.col("touch")
    super_id = (F.when(is_signal, F.lit(None).cast("string"))
                .when(layer == "external", F.lit(K.SUPER_EXTERNAL_NOISE))
                .when(layer == "web", F.lit(K.SUPER_WEB_SURFACE))
                .otherwise(F.lit(K.SUPER_INTERNAL_BASELINE)))
    return nodes.select("id", "risk", "touch", layer.alias("layer"), is_signal.alias("is_signal"),
                        super_id.alias("super_id"))


# ---------------------------------------------------------------------------
# Collapse noise into super-nodes
# ---------------------------------------------------------------------------

def collapse_edges(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """G8-G10 in one pass: remap both ends through the noise map, merge.

    An edge's new ends depend only on its own two nodes, so the result does not
    depend on the order in which the three layers are collapsed."""
    noise = nodes.where(F.col("super_id").isNotNull()).select("id", "super_id")
    s = noise.select(F.col("id").alias("source"), F.col("super_id").alias("s_super"))
    t = noise.select(F.col("id").alias("target"), F.col("super_id").alias("t_super"))
    e2 = edge_rows.join(s, "source", "left").join(t, "target", "left")
    collapsed = F.col("s_super").isNotNull() | F.col("t_super").isNotNull()
    passed = e2.where(~collapsed).select(*EDGE_COLUMNS)

    ns = F.coalesce(F.col("s_super"), F.col("source"))
    nt = F.coalesce(F.col("t_super"), F.col("target"))
    moved = (e2.where(collapsed)
             .select(ns.alias("source"), nt.alias("target"), "total_attempts", "weight")
             .where((F.col("source") != F.col("target")) & (F.col("target") != K.SUPER_EXTERNAL_NOISE)))
    merged = moved.groupBy("source", "target").agg(
        F.sum("total_attempts").cast("bigint").alias("total_attempts"),
        F.max("weight").alias("max_weight"))
    dim_super = F.col("source").isin(K.SUPER_EXTERNAL_NOISE, K.SUPER_INTERNAL_BASELINE) | \
        F.col("target").isin(K.SUPER_EXTERNAL_NOISE, K.SUPER_INTERNAL_BASELINE)
    to_web = F.col("target").startswith("url:") | (F.col("target") == K.SUPER_WEB_SURFACE)
    merged = merged.select(
        F.concat(F.lit("edge:"), "source", F.lit("->"), "target").alias("id"),
        "source", "target",
        F.when(to_web, F.lit("HTTP_REQUEST")).otherwise(F.lit("SSH_AUTH")).alias("edge_type"),
        F.when(dim_super, F.lit(K.SUPER_NOISE_RISK)).otherwise(F.col("max_weight")).alias("weight"),
        "total_attempts",
        F.lit(None).cast("string").alias("http_verb"),
        F.lit(None).cast("int").alias("status_code"),
        F.lit(None).cast("string").alias("uri_path"),
        F.lit(0).cast("bigint").alias("successful_auths"),
        F.lit(0).cast("bigint").alias("failed_auths"),
        _empty_strs().alias("distinct_users"),
        _empty_strs().alias("anomaly_flags"),
        F.lit(False).alias("is_anomalous"),
        F.lit(None).cast("string").alias("first_timestamp"),
        F.lit(None).cast("string").alias("last_timestamp"),
    )
    return passed.unionByName(merged)


#: Fixed order of an edge's flags.
FLAG_ORDER = ["WEB_EXPLOIT_POST", "HTTP_4XX_SCAN", "BRUTE_FORCE_BURST", "PRIVILEGE_PIVOT", "SSH_PRIVILEGE_PIVOT",
              "RARE_PIVOT_PATH", "FULL_ATTACK_CHAIN", "OFF_HOURS_ACCESS"]


def merge_parallel_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id: summed attempts, OR-ed anomaly and flags, max weight.

    Every aggregate is combinable and free of order: flags in their fixed order, the
    smallest of values that parallel edges disagree on. Users stay in the long table
    (``Graph.edge_users``), where merging is a union."""
    same = ["source", "target", "edge_type", "http_verb", "status_code", "uri_path"]
    flags = F.array_compact(F.array(*[
        F.when(F.bool_or(F.array_contains("anomaly_flags", f)), F.lit(f)) for f in FLAG_ORDER]))
    return edges.groupBy("id").agg(
        *[F.min(c).alias(c) for c in same], F.max("weight").alias("weight"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("total_attempts", "successful_auths", "failed_auths")],
        _empty_strs().alias("distinct_users"), flags.alias("anomaly_flags"),
        F.bool_or("is_anomalous").alias("is_anomalous"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
    ).select(*EDGE_COLUMNS)


def attach_users(edges: DataFrame, edge_users: DataFrame) -> DataFrame:
    """The users of a few edges as arrays (a drill-down's kept edges): only their rows
    of the long table are gathered."""
    ids = edges.select("id")
    lists = edge_users.join(ids, "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("user")).alias("users"))
    out = edges.join(lists, "id", "left").withColumn("distinct_users", F.coalesce("users", "distinct_users"))
    return out.select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """in/out degree per node id from one exploded aggregate."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("d")).select("d.*")
    return ends.groupBy("id").agg(F.sum("i").cast("bigint").alias("in_degree"),
                                  F.sum("o").cast("bigint").alias("out_degree"))


def node_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G11 + G12 in one aggregate: signal nodes as they are, one row per non-empty
    noise super-node, with in/out degrees.

    Every raw node contributes to its own id (signal) or its super id (noise),
    every final edge contributes one out-degree to its source and one in-degree
    to its target; a single ``groupBy(id)`` then yields risk, member count and
    degrees, with partial aggregation absorbing the three hot super ids."""
    sig = F.col("is_signal")
    node_part = nodes.select(
        F.coalesce("super_id", "id").alias("id"),
        F.when(sig, F.col("risk")).alias("risk"),
        F.when(sig, F.col("layer")).alias("layer"),
        sig.alias("is_signal"),
        F.when(sig, F.lit(0)).otherwise(F.lit(1)).alias("members"),
        F.lit(0).alias("i"), F.lit(0).alias("o"))
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("d")).select(
        "d.id", F.lit(None).cast("double").alias("risk"), F.lit(None).cast("string").alias("layer"),
        F.lit(None).cast("boolean").alias("is_signal"), F.lit(0).alias("members"), "d.i", "d.o")
    agg = node_part.unionByName(ends).groupBy("id").agg(
        F.max("risk").alias("risk"), F.max("layer").alias("layer"),
        F.coalesce(F.bool_or("is_signal"), F.lit(False)).alias("is_signal"),
        F.sum("members").alias("n"),
        F.sum("i").cast("bigint").alias("in_degree"), F.sum("o").cast("bigint").alias("out_degree"))
    agg = agg.where(F.col("is_signal") | (F.col("n") > 0))
    sid = F.col("id")
    super_label = (F.when(sid == K.SUPER_EXTERNAL_NOISE, F.format_string("Background Traffic (%d IPs)", F.col("n")))
                   .when(sid == K.SUPER_WEB_SURFACE, F.format_string("Web Surface (%d URLs)", F.col("n")))
                   .otherwise(F.format_string("Internal Baseline (%d hosts)", F.col("n"))))
    super_layer = (F.when(sid == K.SUPER_EXTERNAL_NOISE, F.lit("external"))
                   .when(sid == K.SUPER_WEB_SURFACE, F.lit("web")).otherwise(F.lit("internal")))
    is_sig = F.col("is_signal")
    return agg.select(
        "id",
        F.when(is_sig, F.regexp_replace("id", "^(host|url):", "")).otherwise(super_label).alias("label"),
        F.when(~is_sig, F.lit("SUPER_NODE")).when(sid.startswith("url:"), F.lit("URL"))
        .otherwise(F.lit("HOST")).alias("node_type"),
        "in_degree", "out_degree",
        F.when(is_sig, F.round("risk", 2)).otherwise(F.lit(K.SUPER_NOISE_RISK)).alias("risk_score"),
        F.when(is_sig, F.col("layer")).otherwise(super_layer).alias("layer"),
        is_sig.alias("is_signal"), (~is_sig).alias("is_noise_super"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A17 + A19 as one aggregate over the union of node and edge rows (no join)."""
    u = nodes.select(F.lit(1).alias("is_node"), F.lit(0).alias("is_edge"),
                     (F.col("risk_score") >= K.SIGNAL_RISK_THRESHOLD).alias("high"), F.lit(False).alias("anom")) \
        .unionByName(edges.select(F.lit(0).alias("is_node"), F.lit(1).alias("is_edge"), F.lit(False).alias("high"),
                                  F.col("is_anomalous").alias("anom")))
    agg = u.agg(F.sum("is_node").cast("bigint").alias("total_nodes"),
                F.sum("is_edge").cast("bigint").alias("total_edges"),
                F.count_if("anom").alias("anomalous_edges_count"),
                F.count_if("high").alias("high_risk_nodes_count"))
    return agg.select(
        F.coalesce("total_nodes", F.lit(0)).cast("bigint").alias("total_nodes"),
        F.coalesce("total_edges", F.lit(0)).cast("bigint").alias("total_edges"),
        "anomalous_edges_count", "high_risk_nodes_count",
        F.col("anomalous_edges_count").alias("detected_lateral_chains"),
        F.when(F.coalesce("total_edges", F.lit(0)) > 0,
               F.round(F.col("anomalous_edges_count") / F.col("total_edges"), 3))
        .otherwise(F.lit(0.0)).alias("noise_reduction_ratio"))


# ---------------------------------------------------------------------------
# Whole pipeline
# ---------------------------------------------------------------------------

def rows_from_counts(counts: DataFrame, off_hours: DataFrame | None = None) -> DataFrame:
    """G1-G3 from combined edge state: scored HTTP and SSH edge rows."""
    ssh_c, http_c = E.split_counts(counts)
    http_e = E.score_http_edges(http_c)
    ssh_e = E.score_ssh_edges(ssh_c)
    return http_edge_rows(http_e).unionByName(ssh_edge_rows(ssh_e, http_e, off_hours))


def build_graph_from_counts(counts: DataFrame, off_hours: DataFrame | None = None, materialize: bool = False) -> Graph:
    """Graph from combined edge state (batch, merged partials or a stream snapshot)."""
    rows = rows_from_counts(counts, off_hours)
    if materialize:
        rows = write_table(rows, "edge_rows")
    nodes = node_risk(rows)
    edges = collapse_edges(rows, nodes)
    if materialize:
        edges = write_table(edges, "graph_edges")
    nrows = node_rows(nodes, edges)
    return Graph(nodes=nrows, edges=edges, summary=summary(nrows, edges), raw_edges=rows, node_risk=nodes,
                 tables=[rows, edges] if materialize else [])


def edge_users_from_facts(facts: DataFrame) -> DataFrame:
    """Long table (id, user) of the SSH edges: one row per edge and user, however many
    users an edge has."""
    return (facts.where((F.col("protocol") == "SSH") & F.col("user").isNotNull())
            .select(F.concat(F.lit("edge:"), "src_ip", F.lit("->"), "k2").alias("id"), "user"))


def build_graph(events: DataFrame, materialize: bool = True, off_hours: DataFrame | None = None) -> Graph:
    """Unified events -> signal/noise graph.

    By default the per-(edge, user, status) fact table is written once to the shared
    checkpoint folder: the log scan and parse run exactly once, every later step reads
    that table, and a lost executor never forces a re-parse. The scored edges and the
    collapsed ones (at most a row per edge) are written too, as every output reads them.
    ``materialize=False`` keeps one lazy plan. Users stay a long table (``edge_users``);
    scores need only their number. ``off_hours``: see :func:`ssh_edge_rows`."""
    facts = E.edge_facts(events)
    return graph_from_facts(write_table(facts, "edge_facts") if materialize else facts, materialize, off_hours)


def graph_from_facts(facts: DataFrame, materialize: bool = False, off_hours: DataFrame | None = None) -> Graph:
    """Graph of an edge fact table (batch, or the sum of a stream's parts)."""
    g = build_graph_from_counts(E.counts_from_facts(facts), off_hours, materialize)
    g.edge_users = edge_users_from_facts(facts)
    if materialize:
        g.tables.append(facts)
    return g
