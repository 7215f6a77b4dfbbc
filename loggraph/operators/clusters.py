"""Cluster overview: super-nodes and super-edges.

Every event is assigned a source cluster (external threats, or its /24 subnet)
and a target cluster (web URLs, a /24 subnet, or external threats). All overview
numbers come from one **fact table**: per cluster pair and protocol its distinct
sources and its distinct targets, each with an event count. It takes one shuffle over
the events (pre-aggregated map-side, so a cluster pair that holds a third of all events
costs one row per map task and key) and holds no (source, target) pairs; after it
super-nodes, super-edges and the membership table are small aggregates. Members
are kept as a long ``(cluster_id, node_id)`` table, never as one array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggraph import constants as K
from loggraph.functions.net import is_private, subnet24
from loggraph.session import drop_table
from loggraph.session import materialize as write_table


@dataclass
class Overview:
    super_nodes: DataFrame   # id, label, node_type, child_count, cluster_rule, risk_score
    super_edges: DataFrame   # id, source, target, edge_type, weight, total_attempts, ...
    members: DataFrame       # cluster_id, node_id
    summary: DataFrame       # one row (A18)
    facts: DataFrame | None = None   # the table written for it

    def __enter__(self) -> "Overview":
        return self

    def __exit__(self, *_) -> None:
        """Delete the table written for the overview."""
        if self.facts is not None:
            drop_table(self.facts)


def src_cluster(source_ip="source_ip"):
    """External threats unless private, then ``super:subnet:<a.b.c.0/24>``."""
    c = F.col(source_ip)
    return F.when(~is_private(c), F.lit(K.SUPER_EXTERNAL_THREATS)) \
        .otherwise(F.concat(F.lit(K.SUPER_SUBNET_PREFIX), subnet24(c)))


def tgt_cluster(target="target", protocol="protocol"):
    """HTTP -> web URLs; private target -> its subnet; else external threats."""
    t = F.col(target)
    return (F.when(F.col(protocol) == "HTTP", F.lit(K.SUPER_WEB_URLS))
            .when(is_private(t), F.concat(F.lit(K.SUPER_SUBNET_PREFIX), subnet24(t)))
            .otherwise(F.lit(K.SUPER_EXTERNAL_THREATS)))


def cluster_facts(events: DataFrame) -> DataFrame:
    """Per cluster pair and protocol its distinct sources (``kind`` S) and its distinct
    targets (T), each ``value`` with its number of events: two rows an event go into one
    aggregate, so its size is that of sources plus targets, never of their pairs."""
    ends = F.explode(F.array(F.struct(F.lit("S").alias("kind"), F.col("source_ip").alias("value")),
                             F.struct(F.lit("T").alias("kind"), F.col("target").alias("value")))).alias("e")
    ev = events.select("protocol", src_cluster().alias("src_cluster"), tgt_cluster().alias("tgt_cluster"), ends)
    return ev.groupBy("e.kind", "src_cluster", "tgt_cluster", "protocol", "e.value").agg(F.count(F.lit(1)).alias("n"))


def cluster_props(cluster_id, child_count):
    """Label, rule and base risk per cluster id."""
    cid = F.col(cluster_id)
    n = F.col(child_count)
    subnet = F.regexp_replace(cid, "^super:subnet:", "")
    label = (F.when(cid == K.SUPER_EXTERNAL_THREATS, F.format_string("External Threats (%d IPs)", n))
             .when(cid.startswith(K.SUPER_SUBNET_PREFIX), F.format_string("Subnet %s (%d hosts)", subnet, n))
             .when(cid.startswith("super:subnet16:"), F.format_string(
                 "Subnet %s (%d hosts)", F.regexp_replace(cid, "^super:subnet16:", ""), n))
             .when(cid.startswith("super:subnet8:"), F.format_string(
                 "Subnet %s (%d hosts)", F.regexp_replace(cid, "^super:subnet8:", ""), n))
             .when(cid == "super:internal", F.format_string("Internal Hosts (%d)", n))
             .when(cid == K.SUPER_WEB_URLS, F.format_string("Web Endpoints (%d)", n))
             .otherwise(F.format_string("Cluster (%d)", n)))
    rule = (F.when(cid == K.SUPER_EXTERNAL_THREATS, F.lit("external_ip"))
            .when(cid.startswith(K.SUPER_SUBNET_PREFIX), F.lit("internal_subnet_24"))
            .when(cid.startswith("super:subnet16:"), F.lit("internal_subnet_16"))
            .when(cid.startswith("super:subnet8:"), F.lit("internal_subnet_8"))
            .when(cid == "super:internal", F.lit("internal"))
            .when(cid == K.SUPER_WEB_URLS, F.lit("url_collapse"))
            .otherwise(F.lit("unknown")))
    risk = (F.when(cid == K.SUPER_EXTERNAL_THREATS, F.lit(K.EXTERNAL_THREATS_RISK))
            .when(cid.startswith("super:subnet") | (cid == "super:internal"), F.lit(K.SUBNET_RISK))
            .when(cid == K.SUPER_WEB_URLS, F.lit(K.WEB_URLS_RISK))
            .otherwise(F.lit(K.UNKNOWN_CLUSTER_RISK)))
    return label, rule, risk


def super_nodes_and_members(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source clusters, the web cluster, then SSH target clusters not yet present.

    Returns ``(nodes(id, child_count), members(cluster_id, node_id))``."""
    sources, targets = facts.where("kind = 'S'"), facts.where("kind = 'T'")
    src_m = sources.select(F.col("src_cluster").alias("cluster_id"), F.concat(F.lit("host:"), "value").alias("node_id"))
    web_m = targets.where(F.col("protocol") == "HTTP").select(
        F.lit(K.SUPER_WEB_URLS).alias("cluster_id"), F.concat(F.lit("url:"), "value").alias("node_id"))
    tgt_m = targets.where(F.col("protocol") == "SSH").select(
        F.col("tgt_cluster").alias("cluster_id"), F.concat(F.lit("host:"), "value").alias("node_id"))
    src_ids = src_m.select("cluster_id").distinct()
    # Target clusters that are not source clusters keep their target members.
    tgt_m = tgt_m.where(F.col("cluster_id") != K.SUPER_WEB_URLS).join(src_ids, "cluster_id", "left_anti")
    members = src_m.unionByName(web_m).unionByName(tgt_m).distinct()
    nodes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("child_count"))
    return nodes, members


LEVELS = ["subnet24", "subnet16", "internal"]


def at_level(facts: DataFrame, level: str) -> DataFrame:
    """The fact table with its /24 clusters merged to /16 or to one internal cluster."""
    def coarse(c):
        col = F.col(c)
        new = F.concat(F.lit("super:subnet16:"), F.regexp_extract(col, r"^super:subnet:(\d+\.\d+)\.", 1), F.lit(".0.0/16")) \
            if level == "subnet16" else F.lit("super:internal")
        return F.when(col.startswith(K.SUPER_SUBNET_PREFIX), new).otherwise(col).alias(c)

    if level == "subnet24":
        return facts
    return facts.select("kind", coarse("src_cluster"), coarse("tgt_cluster"), "protocol", "value", "n")


def build_overview(events: DataFrame, materialize: bool = True) -> Overview:
    """Super-nodes, super-edges, membership and summary from unified events."""
    facts = cluster_facts(events)
    if materialize:
        facts = write_table(facts, "cluster_facts")
    ov = overview_of_facts(facts)
    ov.facts = facts if materialize else None
    return ov


def overview_of_facts(facts: DataFrame) -> Overview:
    """The overview of a cluster fact table: the same columns and rules at every level."""
    counts, members = super_nodes_and_members(facts)
    label, rule, risk = cluster_props("cluster_id", "child_count")
    snodes = counts.select(
        F.col("cluster_id").alias("id"), label.alias("label"), F.lit("SUPER_NODE").alias("node_type"),
        F.col("child_count").cast("bigint").alias("child_count"), rule.alias("cluster_rule"),
        risk.alias("risk_score"))

    # Super-edges between different clusters.
    # one distinct count each: Spark dedups (pair, value) before it counts
    pair_key = ["src_cluster", "tgt_cluster"]
    different = facts.where(F.col("src_cluster") != F.col("tgt_cluster"))
    n_of = {p: F.sum(F.when(F.col("protocol") == p, F.col("n")).otherwise(0)) for p in ("SSH", "HTTP")}
    pair = different.where("kind = 'S'").groupBy(*pair_key).agg(
        F.sum("n").cast("bigint").alias("total_attempts"), F.count_distinct("value").alias("src_unique_ips"),
        n_of["SSH"].alias("ssh_n"), n_of["HTTP"].alias("http_n"))
    targets = different.where("kind = 'T'").groupBy(*pair_key).agg(F.count_distinct("value").alias("tgt_unique_entities"))
    pair = pair.join(targets, pair_key)
    # Modal protocol, ties to the smaller name (HTTP).
    dominant = F.when(F.col("ssh_n") > F.col("http_n"), F.lit("SSH")).otherwise(F.lit("HTTP"))
    pair = pair.withColumn("dominant_protocol", dominant)
    # Both ends must be known clusters.
    known = snodes.select("id")
    pair = (pair.join(known.withColumnRenamed("id", "src_cluster"), "src_cluster", "left_semi")
            .join(known.withColumnRenamed("id", "tgt_cluster"), "tgt_cluster", "left_semi"))
    total = F.col("total_attempts")
    sedges = pair.select(
        F.concat(F.lit("super_edge:"), "src_cluster", F.lit("->"), "tgt_cluster").alias("id"),
        F.col("src_cluster").alias("source"), F.col("tgt_cluster").alias("target"),
        F.when(F.col("dominant_protocol") == "SSH", F.lit("SSH_AUTH")).otherwise(F.lit("HTTP_REQUEST"))
        .alias("edge_type"),
        F.least(F.lit(K.SUPER_EDGE_WEIGHT_CAP), total / F.lit(K.SUPER_EDGE_WEIGHT_DIVISOR)).alias("weight"),
        "total_attempts",
        F.col("src_unique_ips").cast("bigint").alias("src_unique_ips"),
        F.col("tgt_unique_entities").cast("bigint").alias("tgt_unique_entities"),
        "dominant_protocol",
        ((total > K.SUPER_EDGE_ANOMALY_EVENTS) | (F.col("dominant_protocol") == "SSH")).alias("is_anomalous"),
    )
    return Overview(super_nodes=snodes, super_edges=sedges, members=members,
                    summary=overview_summary(snodes, sedges))


def overview_summary(snodes: DataFrame, sedges: DataFrame) -> DataFrame:
    """Counts with the 5.0 high-risk threshold, as one aggregate over a union."""
    u = (snodes.select(F.lit(1).alias("is_node"), F.lit(0).alias("is_edge"),
                       (F.col("risk_score") >= K.CRITICAL_RISK_THRESHOLD).alias("high"), F.lit(False).alias("anom"))
         .unionByName(sedges.select(F.lit(0).alias("is_node"), F.lit(1).alias("is_edge"),
                                    F.lit(False).alias("high"), F.col("is_anomalous").alias("anom"))))
    return u.agg(
        F.coalesce(F.sum("is_node"), F.lit(0)).cast("bigint").alias("total_nodes"),
        F.coalesce(F.sum("is_edge"), F.lit(0)).cast("bigint").alias("total_edges"),
        F.count_if("anom").alias("anomalous_edges_count"),
        F.count_if("high").alias("high_risk_nodes_count"),
    ).withColumn("detected_lateral_chains", F.col("anomalous_edges_count"))
