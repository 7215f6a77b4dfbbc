"""Cluster overview golden (FIXTURES 2.2) and drill-down behaviour."""

from loggraph import constants as K
from loggraph.operators.clusters import build_overview
from loggraph.operators.expand import expand, top_nodes
from loggraph.operators.graph import build_graph
from loggraph.operators.parse import parse_lines
from loggraph.sources.lines import lines_from_text
from tests.samples import CHAIN, DUAL, STREAM


def test_stream_sample_overview(spark):
    ov = build_overview(parse_lines(lines_from_text(spark, STREAM)))
    nodes = {r.id: r for r in ov.super_nodes.collect()}
    assert set(nodes) == {"super:subnet:192.168.1.0/24", "super:subnet:10.0.0.0/24", "super:external_threats"}
    assert nodes["super:external_threats"].child_count == 1 and nodes["super:external_threats"].risk_score == 7.0
    assert nodes["super:subnet:10.0.0.0/24"].label == "Subnet 10.0.0.0/24 (1 hosts)"
    edges = {(e.source, e.target): e for e in ov.super_edges.collect()}
    e1 = edges[("super:subnet:192.168.1.0/24", "super:external_threats")]
    e2 = edges[("super:subnet:10.0.0.0/24", "super:external_threats")]
    assert (e1.total_attempts, e1.weight, e1.is_anomalous) == (1, 0.02, True)
    assert (e2.total_attempts, e2.weight, e2.is_anomalous) == (2, 0.04, True)
    s = ov.summary.collect()[0]
    assert (s.total_nodes, s.total_edges, s.anomalous_edges_count, s.high_risk_nodes_count) == (3, 2, 2, 1)
    members = {(m.cluster_id, m.node_id) for m in ov.members.collect()}
    assert ("super:external_threats", "host:web-server-01") in members


def test_expand_unknown_is_empty(spark):
    x = expand(parse_lines(lines_from_text(spark, DUAL)), "super:nope")
    assert x.nodes.count() == 0 and x.edges.count() == 0


def test_expand_web_keeps_http_only(spark):
    x = expand(parse_lines(lines_from_text(spark, DUAL)), K.SUPER_WEB_URLS)
    ids = {r.id for r in x.nodes.collect()}
    assert ids == {"host:198.51.100.42", "url:/api/v1", "url:/admin/config"}


def test_top_k_prefers_anomalous_then_risk(spark):
    g = build_graph(parse_lines(lines_from_text(spark, CHAIN)))
    nodes, edges = top_nodes(g.nodes, g.edges, 3)
    ids = [r.id for r in nodes.collect()]
    assert set(ids) == {"host:10.0.9.88", "host:203.0.113.9", "url:/upload"}
    got = {(e.source, e.target) for e in edges.collect()}
    assert got == {("host:203.0.113.9", "url:/upload"), ("host:203.0.113.9", "host:10.0.9.88")}


def test_web_to_ssh_golden(spark):
    from loggraph.operators.timeline import web_to_ssh
    r = web_to_ssh(parse_lines(lines_from_text(spark, CHAIN)), log_year=2026, window_s=300).collect()
    assert len(r) == 1 and r[0].delta_s == 125 and r[0].src_ip == "203.0.113.9"


def test_bounded_overview_coarsens(spark):
    from loggraph.operators.classes import bounded_overview
    from loggraph.sources.render import render_lines
    ev = parse_lines(render_lines(spark, "/root/testdata/sf0.001"))
    full, level, _ = bounded_overview(ev, max_nodes=50)
    assert level == "subnet24"
    n_full = full.super_nodes.count()
    small, level, within = bounded_overview(ev, max_nodes=n_full - 1)
    assert level in ("subnet16", "internal")
    assert small.super_nodes.count() <= n_full - 1
    # members are never lost by coarsening
    assert small.members.select("node_id").distinct().count() == full.members.select("node_id").distinct().count()


def _events(spark, rows):
    return spark.createDataFrame(rows, "protocol string, source_ip string, target string")


def test_prefix_overview_keeps_the_largest_subnets(spark):
    from loggraph.operators.classes import largest_that_fit, prefix_overview
    rows = []
    for a, b, n in [(0, 1, 9), (0, 2, 7), (0, 3, 1), (1, 1, 8), (1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 1, 2)]:
        rows += [("SSH", f"10.{a}.{b}.{h}", "10.0.1.1") for h in range(n)]
    rows += [("HTTP", "8.8.8.8", "/a"), ("SSH", "192.168.5.1", "10.0.1.1")]
    ev = _events(spark, rows)

    def ids(bound):
        ov = prefix_overview(ev, bound)
        edges = {i for r in ov.super_edges.select("source", "target").collect() for i in r}
        found = {r.id: r.child_count for r in ov.super_nodes.collect()}
        assert len(found) <= bound and edges <= set(found)
        return found

    all_24 = ids(50)
    assert len(all_24) == 11 and sum(n for i, n in all_24.items() if "subnet" in i) == 31
    ten = ids(10)   # one pair of /24 in a /16 merges
    assert ten["super:subnet:10.0.1.0/24"] == 9 and len(ten) == 10
    for bound in (8, 6, 5, 4, 3):
        few = ids(bound)
        assert sum(n for i, n in few.items() if "subnet" in i or i == "super:internal") == 31
        assert bound < 5 or few["super:subnet:10.0.1.0/24"] == 9   # the largest stays as long as there is room
    assert ids(3).keys() == {"super:external_threats", "super:web_urls", "super:internal"}
    assert largest_that_fit([("a", "p"), ("b", "p"), ("c", "q")], {"p": 2, "q": 2}, 3, 4) == 2
    assert largest_that_fit([("a", "p")], {"p": 1}, 9, 4) == -1


def test_cluster_facts_hold_no_pairs(spark):
    """A hundred sources times a hundred targets make two hundred rows."""
    from loggraph.operators.clusters import build_overview, cluster_facts
    rows = [("HTTP", f"10.0.0.{s}", f"/p{t}") for s in range(100) for t in range(100)]
    ev = _events(spark, rows)
    assert cluster_facts(ev).count() == 200
    e = build_overview(ev).super_edges.first()
    assert (e.total_attempts, e.src_unique_ips, e.tgt_unique_entities) == (10_000, 100, 100)
