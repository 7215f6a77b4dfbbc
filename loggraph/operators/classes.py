"""Entity classes and clustering extras declared for the overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggraph import constants as K
from loggraph.functions.uri import is_static_asset, uri_prefix
from loggraph.session import materialize


def scanners(events: DataFrame, min_paths: int = K.HTTP_SCAN_MIN_DISTINCT_PATHS) -> DataFrame:
    """Sources with >= ``min_paths`` distinct 4xx URI prefixes (static assets excluded)."""
    st = F.col("status_code")
    http = (events.where((F.col("protocol") == "HTTP") & ~is_static_asset("target"))
            .withColumn("uri_prefix", uri_prefix("target")))
    agg = http.groupBy(F.col("source_ip").alias("src_ip")).agg(
        F.count_distinct(F.when((st >= 400) & (st < 500), F.col("uri_prefix"))).alias("distinct_4xx_paths"))
    return agg.withColumn("is_scanner", F.col("distinct_4xx_paths") >= min_paths)


def benign_ssh_sources(events: DataFrame) -> DataFrame:
    """Sources whose SSH is all success, one user, high frequency (A6 per source)."""
    ssh = events.where(F.col("protocol") == "SSH")
    agg = ssh.groupBy(F.col("source_ip").alias("src_ip")).agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(F.col("action") == "FAILURE").alias("failed_auths"),
        F.count_distinct("user").alias("n_users"))
    return agg.withColumn("is_benign", (F.col("total_attempts") >= K.HIGH_FREQ_COLLAPSED_THRESHOLD)
                          & (F.col("failed_auths") == 0) & (F.col("n_users") == 1))


def url_clusters(node_risk: DataFrame, exempt_risk: float = 5.0, min_urls: int = 2) -> DataFrame:
    """URL nodes grouped by first path segment (>= ``min_urls``); risk >= 5 stays individual."""
    urls = node_risk.where(F.col("id").startswith("url:") & (F.col("risk") < exempt_risk))
    seg = F.regexp_extract(F.regexp_replace("id", "^url:", ""), r"^(/[^/]*)", 1)
    agg = urls.withColumn("segment", seg).where(F.col("segment") != "").groupBy("segment").agg(
        F.count(F.lit(1)).alias("child_count"), F.max("risk").alias("aggregated_risk"))
    return (agg.where(F.col("child_count") >= min_urls)
            .select(F.concat(F.lit("super:url:"), "segment").alias("id"), "segment", "child_count",
                    "aggregated_risk"))


def exempt_nodes(node_risk: DataFrame, edge_rows: DataFrame, host_risk: float = 7.0) -> DataFrame:
    """Nodes never clustered: hosts with risk >= 7, chain / SSH-pivot endpoints."""
    flagged = edge_rows.where(F.array_contains("anomaly_flags", "FULL_ATTACK_CHAIN")
                              | F.array_contains("anomaly_flags", "SSH_PRIVILEGE_PIVOT"))
    ends = (flagged.select(F.col("source").alias("id")).union(flagged.select(F.col("target").alias("id")))
            .distinct().withColumn("chain_member", F.lit(True)))
    hosts = node_risk.where(F.col("id").startswith("host:")).select(
        "id", (F.col("risk") >= host_risk).alias("crown_jewel"))
    out = hosts.join(ends, "id", "full_outer")
    return (out.select("id", F.coalesce("crown_jewel", F.lit(False)).alias("crown_jewel"),
                       F.coalesce("chain_member", F.lit(False)).alias("chain_member"))
            .where(F.col("crown_jewel") | F.col("chain_member")))


def super_aggregates(node_risk: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Per noise super-node: members, max member risk, raw edges collapsed into it."""
    noise = node_risk.where(F.col("super_id").isNotNull())
    members = noise.groupBy("super_id").agg(F.count(F.lit(1)).alias("child_count"),
                                            F.max("risk").alias("aggregated_risk"))
    nm = noise.select("id", "super_id")
    e = (edge_rows.select("id", "source", "target")
         .join(nm.select(F.col("id").alias("source"), F.col("super_id").alias("s")), "source", "left")
         .join(nm.select(F.col("id").alias("target"), F.col("super_id").alias("t")), "target", "left"))
    per = (e.select(F.explode(F.array_distinct(F.array_compact(F.array("s", "t")))).alias("super_id"))
           .groupBy("super_id").agg(F.count(F.lit(1)).alias("aggregated_edge_count")))
    return members.join(per, "super_id", "left").select(
        F.col("super_id").alias("id"), "child_count", "aggregated_risk",
        F.coalesce("aggregated_edge_count", F.lit(0)).cast("bigint").alias("aggregated_edge_count"))


def summary_extras(node_risk: DataFrame, nodes: DataFrame) -> DataFrame:
    """Raw node count, super / individual counts, clustering ratio, one aggregate."""
    u = (node_risk.select(F.lit(1).alias("raw"), F.lit(0).alias("fin"), F.lit(False).alias("sup"))
         .unionByName(nodes.select(F.lit(0).alias("raw"), F.lit(1).alias("fin"), F.col("is_noise_super").alias("sup"))))
    agg = u.agg(F.sum("raw").cast("bigint").alias("total_raw_nodes_before_clustering"),
                F.sum("fin").cast("bigint").alias("total_nodes"),
                F.count_if("sup").alias("super_node_count"))
    return agg.select(
        "total_raw_nodes_before_clustering", "total_nodes", "super_node_count",
        (F.col("total_nodes") - F.col("super_node_count")).alias("individual_node_count"),
        F.when(F.col("total_raw_nodes_before_clustering") > 0,
               F.round(1 - F.col("total_nodes") / F.col("total_raw_nodes_before_clustering"), 3))
        .otherwise(F.lit(0.0)).alias("clustering_ratio"))


def bounded_overview(events: DataFrame, max_nodes: int = 50):
    """X11: the finest cluster overview of at most ``max_nodes`` super-nodes.

    /24 subnets coarsen to /16, then to one internal cluster; columns, labels and rules
    are the same at every level, over one written fact table, and only counts reach the
    driver. Returns (overview, level, within the bound)."""
    from loggraph.operators import clusters as C

    facts = materialize(C.cluster_facts(events), "cluster_facts")
    for level in C.LEVELS:
        ov = C.overview_of_facts(C.at_level(facts, level))
        within = ov.super_nodes.count() <= max_nodes
        if within:
            break
    return ov, level, within


def _prefix(cluster_id, octets: int):
    """The id of a /24 cluster's branch higher up in the address-prefix tree."""
    name = {2: "super:subnet16:", 1: "super:subnet8:"}[octets]
    pattern = r"^super:subnet:(" + r"\.".join([r"[^./]+"] * octets) + r")\."
    return F.concat(F.lit(name), F.regexp_extract(cluster_id, pattern, 1), F.lit(".0.0/16" if octets == 2 else ".0.0.0/8"))


def largest_that_fit(top: list[tuple[str, str]], sizes: dict[str, int], parents: int, room: int) -> int:
    """How many of the largest branches stay when the others merge into their parents.

    ``top``: (branch, parent), largest first; ``sizes``: branches of each of these
    parents; ``parents``: how many parents there are in all. The most that fit in
    ``room``; -1 where even all parents do not."""
    best, left, open_parents = -1, dict(sizes), parents
    for kept in range(len(top) + 1):
        if kept:
            parent = top[kept - 1][1]
            left[parent] -= 1
            open_parents -= left[parent] == 0
        if kept + open_parents <= room:
            best = kept
    return best


def prefix_overview(events: DataFrame, max_nodes: int = 50):
    """X11: an overview of at most ``max_nodes`` super-nodes for any input, in which the
    largest /24 subnets stay and only the smallest branches of the address tree merge.

    The smallest /24 clusters merge into their /16, as few as needed. Where that would
    leave less than half of the room to /24, half of it goes to the largest of them, and
    the rest of the addresses to /16, /8 and one internal node by the same rule. Ties go
    by id. The driver
    sees at most ``max_nodes`` branches a level and counts; the fact table is read with
    the merged ids. Needs room for three nodes (web, external, internal)."""
    from loggraph.operators import clusters as C

    if max_nodes < 3:
        raise ValueError("an overview has at least three nodes")
    facts = materialize(C.cluster_facts(events), "cluster_facts")
    counts, _ = C.super_nodes_and_members(facts)
    is_subnet = F.col("cluster_id").startswith(K.SUPER_SUBNET_PREFIX)
    counts = materialize(counts.select("cluster_id", "child_count", is_subnet.alias("subnet")), "cluster_sizes")
    room = max_nodes - counts.where("NOT subnet").count()
    cid = F.col("cluster_id")
    level = counts.where("subnet").select(cid.alias("id"), _prefix(cid, 2).alias("up16"), _prefix(cid, 1).alias("up8"), "child_count")
    kept: list[str] = []
    for branch, parent, beyond in (("id", "up16", "up8"), ("up16", "up8", None), ("up8", None, None)):
        if beyond or parent:
            here = level.groupBy(branch, parent).agg(F.sum("child_count").alias("size"))
        else:
            here = level.groupBy(branch).agg(F.sum("child_count").alias("size")).withColumn("all", F.lit("super:internal"))
            parent = "all"
        n = here.count()
        if n <= room:
            kept += [r[0] for r in here.select(branch).collect()]  # at most ``room`` rows
            break
        top = [(r[0], r[1]) for r in here.orderBy(F.desc("size"), branch).limit(max(room, 0)).select(branch, parent).collect()]
        own = {r[0]: r[1] for r in here.where(F.col(parent).isin([p for _, p in top])).groupBy(parent).agg(F.count(F.lit(1))).collect()}
        stay = largest_that_fit(top, own, here.select(parent).distinct().count(), room)
        last = stay >= room // 2
        stay = stay if last else room // 2
        kept += [b for b, _ in top[:stay]]
        if last:
            kept += [r[0] for r in here.where(~F.col(branch).isin([b for b, _ in top[:stay]])).select(parent).distinct().collect()]
            break
        level = level.where(~F.col(branch).isin([b for b, _ in top[:stay]]))
        room -= stay

    def merged(c: str):
        col = F.col(c)
        up16, up8 = _prefix(col, 2), _prefix(col, 1)
        new = (F.when(col.isin(kept), col).when(up16.isin(kept), up16).when(up8.isin(kept), up8).otherwise(F.lit("super:internal")))
        return F.when(col.startswith(K.SUPER_SUBNET_PREFIX), new).otherwise(col).alias(c)

    ov = C.overview_of_facts(facts.select("kind", merged("src_cluster"), merged("tgt_cluster"), "protocol", "value", "n"))
    ov.facts = facts
    return ov
