"""Graph invariants and order independence on logs rendered from sf0.001."""

import pytest
from pyspark.sql import functions as F

from loggraph import constants as K
from loggraph.operators.graph import build_graph
from loggraph.operators.parse import parse_lines
from loggraph.sources.render import render_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    return build_graph(parse_lines(render_lines(spark, SF)))


def test_no_dangling_edges(graph):
    ids = graph.nodes.select("id")
    e = graph.edges
    assert e.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").count() == 0
    assert e.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").count() == 0


def test_unique_ids(graph):
    assert graph.nodes.count() == graph.nodes.select("id").distinct().count()
    assert graph.edges.count() == graph.edges.select("id").distinct().count()


def test_no_anomalous_edge_on_super_nodes(graph):
    bad = graph.edges.where(F.col("is_anomalous") & (F.col("source").startswith("super:")
                                                     | F.col("target").startswith("super:")))
    assert bad.count() == 0


def test_noise_in_exactly_one_super(graph):
    nr = graph.node_risk
    assert nr.where(~F.col("is_signal") & F.col("super_id").isNull()).count() == 0
    assert nr.where(F.col("is_signal") & F.col("super_id").isNotNull()).count() == 0


def test_attempts_conserved(graph):
    """Pass-through + collapsed + dropped (self loops, into external noise) = all."""
    raw_total = graph.raw_edges.agg(F.sum("total_attempts")).first()[0]
    kept = graph.edges.agg(F.sum("total_attempts")).first()[0]
    noise = graph.node_risk.where(F.col("super_id").isNotNull()).select("id", "super_id")
    e = (graph.raw_edges.join(noise.select(F.col("id").alias("source"), F.col("super_id").alias("s")), "source", "left")
         .join(noise.select(F.col("id").alias("target"), F.col("super_id").alias("t")), "target", "left"))
    ns, nt = F.coalesce("s", "source"), F.coalesce("t", "target")
    collapsed = F.col("s").isNotNull() | F.col("t").isNotNull()
    dropped = e.where(collapsed & ((ns == nt) | (nt == K.SUPER_EXTERNAL_NOISE))).agg(F.sum("total_attempts")).first()[0]
    assert kept + (dropped or 0) == raw_total


def test_order_independent(spark, graph):
    shuffled = parse_lines(render_lines(spark, SF).repartition(7).orderBy(F.rand(3)))
    g2 = build_graph(shuffled)
    a = sorted(tuple(r) for r in graph.nodes.collect())
    b = sorted(tuple(r) for r in g2.nodes.collect())
    assert a == b
    assert sorted(map(tuple, graph.summary.collect())) == sorted(map(tuple, g2.summary.collect()))


def test_expected_counts_sf0001(spark):
    """FIXTURES section 5 expected counts at sf0.001."""
    from loggraph.operators import edges as E
    from loggraph.operators.parse import http_events, ssh_events
    ev = parse_lines(render_lines(spark, SF))
    assert ev.where("protocol = 'SSH'").count() == 602
    assert ev.where("protocol = 'HTTP'").count() == 398
    assert E.ssh_edges(ssh_events(ev), drop_baseline=False).count() == 26
    h = E.http_edges(http_events(ev))
    assert h.count() == 84 and h.where("is_anomalous").count() == 13


def test_layer_rank_matches_window(spark, graph):
    """K3 range-split ranking equals a plain window rank, with several slices."""
    from pyspark.sql import Window

    from loggraph.operators.analyst import classify_nodes, layer_rank
    got = {r.id: r.rank_in_tier for r in layer_rank(graph.nodes, partitions=5).collect()}
    w = Window.partitionBy("layer", "risk_tier").orderBy(F.desc("risk_score"), F.asc("id"))
    want = {r.id: r.rk for r in classify_nodes(graph.nodes).select("id", F.row_number().over(w).alias("rk")).collect()}
    assert got == want


def test_exempt_nodes_are_never_collapsed(spark):
    """Whatever the collapse must leave alone is signal already."""
    from loggraph.operators.classes import exempt_nodes
    from loggraph.operators.graph import build_graph
    from loggraph.operators.parse import parse_lines
    from loggraph.sources.render import render_lines
    g = build_graph(parse_lines(render_lines(spark, "/root/testdata/sf0.001")))
    exempt = exempt_nodes(g.node_risk, g.raw_edges)
    assert exempt.count() > 0
    assert exempt.join(g.node_risk.where("super_id IS NOT NULL"), "id").count() == 0


def test_events_of_an_unknown_cluster_are_an_error(spark):
    import pytest

    from loggraph.operators.parse import parse_lines
    from loggraph.operators.timeline import node_events
    from loggraph.sources.lines import empty_lines
    with pytest.raises(ValueError, match="no cluster"):
        node_events(parse_lines(empty_lines(spark)), "super:none")


def test_queries_leave_nothing_cached(spark):
    import __spark_entry__ as se
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, qs = cached(), se.queries()
    for name in ("g4_node_risk", "g12_nodes", "g11_degrees", "a17_summary", "k1_cut_nodes", "j6_ego", "x10_summary_extras",
                 "c3_super_edges", "f9_f11_edge_classes", "s11_expand_payload"):
        qs[name](spark, SF).collect()
    assert cached() == before and spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_a_graph_and_its_kin_delete_their_tables(spark):
    from loggraph import session
    from loggraph.operators.clusters import build_overview
    from loggraph.operators.expand import expand
    paths = lambda: list(session._TABLES.get(spark.sparkContext.applicationId, []))
    ev = parse_lines(render_lines(spark, SF))
    before = paths()
    with build_graph(ev) as g:
        nodes = g.nodes.count()
        assert len(paths()) == len(before) + 3
    with expand(ev, "super:internal_baseline") as x, build_overview(ev) as ov:
        assert x.nodes.count() > 0 and ov.super_nodes.count() > 0
    assert paths() == before and nodes > 0


def test_a_hot_source_spreads_in_the_web_to_ssh_scan(spark):
    """One source with most rows, many in one second, in even slices."""
    from pyspark.sql import functions as F

    from loggraph import session
    from loggraph.operators.timeline import web_to_ssh
    http = spark.range(3000).select(F.lit("HTTP").alias("protocol"), F.when(F.col("id") % 10 == 0, F.format_string("10.0.0.%d", F.col("id") % 50))
                                    .otherwise("6.6.6.6").alias("source_ip"), (F.col("id") % 700).alias("s"), F.lit("/a").alias("target"), "id")
    ssh = spark.range(6000).select(F.lit("SSH").alias("protocol"), F.when(F.col("id") % 10 == 0, F.format_string("10.0.0.%d", F.col("id") % 50))
                                   .otherwise("6.6.6.6").alias("source_ip"), F.when(F.col("id") % 2 == 0, 650).otherwise(F.col("id") % 1500).alias("s"),
                                   F.format_string("h%d", F.col("id") % 9).alias("target"), "id")
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")), "dd/MMM/yyyy:HH:mm:ss +0000")
    ev = http.unionByName(ssh).select("protocol", "source_ip", "target", at.alias("timestamp"), F.col("id").alias("line_no"))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"   # a few kilobytes would be one slice
    old = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        got = web_to_ssh(ev, 2024).select("src_ip", "dest_host", F.unix_seconds("ssh_time"), F.unix_seconds("http_time"), "delta_s").collect()
    finally:
        spark.conf.set(merging, old)
    times = {}
    for r in http.collect():
        times.setdefault(r.source_ip, set()).add(1_700_000_000 + r.s)
    want = []
    for r in ssh.collect():
        t = 1_700_000_000 + r.s
        before = [x for x in times.get(r.source_ip, ()) if x <= t]
        if before and t - max(before) <= 300:
            want.append((r.source_ip, r.target, t, max(before), t - max(before)))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 3000
    path = [p for p in session._TABLES[spark.sparkContext.applicationId] if "web_ssh_slices" in p][-1]
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("slice").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 3 * sum(sizes) / len(sizes)
