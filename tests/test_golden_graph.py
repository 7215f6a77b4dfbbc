"""Golden graph results from literal samples."""

from loggraph.operators.graph import build_graph
from loggraph.operators.parse import parse_lines
from loggraph.sources.lines import lines_from_text
from tests.samples import CHAIN, DUAL


def _graph(spark, text):
    ev = parse_lines(lines_from_text(spark, text))
    return ev, build_graph(ev)


def test_dual_parse_counts(spark):
    ev, _ = _graph(spark, DUAL)
    rows = ev.collect()
    assert sum(r.protocol == "SSH" for r in rows) == 4
    assert sum(r.protocol == "HTTP" for r in rows) == 2
    assert "/api/v1/upload" in [r.target for r in rows]


def test_dual_graph(spark):
    _, g = _graph(spark, DUAL)
    nodes = {r.id: r for r in g.nodes.collect()}
    assert set(nodes) == {"host:198.51.100.42", "url:/api/v1", "url:/admin/config", "host:10.0.4.15",
                          "host:database01", "super:external_noise", "super:internal_baseline"}
    assert nodes["host:database01"].risk_score == 4.2
    assert nodes["host:database01"].layer == "external"
    assert nodes["url:/api/v1"].risk_score == 3.5
    assert nodes["url:/admin/config"].risk_score == 2.5
    assert nodes["super:external_noise"].label == "Background Traffic (1 IPs)"
    assert nodes["super:internal_baseline"].label == "Internal Baseline (1 hosts)"
    edges = g.edges.collect()
    assert len(edges) == 3 and all(e.is_anomalous for e in edges)
    ssh = [e for e in edges if e.edge_type == "SSH_AUTH"][0]
    assert ssh.total_attempts == 3 and ssh.successful_auths == 1 and ssh.failed_auths == 2
    assert ssh.anomaly_flags == ["PRIVILEGE_PIVOT", "SSH_PRIVILEGE_PIVOT"] and ssh.weight == 3.5
    s = g.summary.collect()[0]
    assert (s.total_nodes, s.total_edges, s.anomalous_edges_count, s.high_risk_nodes_count) == (7, 3, 3, 4)
    assert s.noise_reduction_ratio == 1.0


def test_chain_graph(spark):
    _, g = _graph(spark, CHAIN)
    nodes = {r.id: r for r in g.nodes.collect()}
    assert set(nodes) == {"host:203.0.113.9", "url:/upload", "host:10.0.9.88", "super:external_noise",
                          "super:web_surface", "super:internal_baseline"}
    assert nodes["host:203.0.113.9"].risk_score == 6.5
    assert nodes["host:10.0.9.88"].risk_score == 7.8
    assert nodes["super:external_noise"].label == "Background Traffic (2 IPs)"
    assert nodes["super:web_surface"].label == "Web Surface (1 URLs)"
    assert nodes["super:internal_baseline"].label == "Internal Baseline (2 hosts)"
    edges = {(e.source, e.target): e for e in g.edges.collect()}
    assert set(edges) == {("host:203.0.113.9", "url:/upload"), ("host:203.0.113.9", "host:10.0.9.88"),
                          ("host:203.0.113.9", "super:web_surface"),
                          ("super:external_noise", "super:web_surface"),
                          ("super:external_noise", "super:internal_baseline")}
    chain = edges[("host:203.0.113.9", "host:10.0.9.88")]
    assert chain.weight == 6.5
    assert chain.anomaly_flags == ["PRIVILEGE_PIVOT", "SSH_PRIVILEGE_PIVOT", "FULL_ATTACK_CHAIN"]
    assert edges[("host:203.0.113.9", "super:web_surface")].weight == 1.0
    assert edges[("super:external_noise", "super:web_surface")].total_attempts == 5
    assert edges[("super:external_noise", "super:web_surface")].weight == 0.5
    assert edges[("super:external_noise", "super:internal_baseline")].edge_type == "SSH_AUTH"
    s = g.summary.collect()[0]
    assert (s.total_nodes, s.total_edges, s.anomalous_edges_count, s.high_risk_nodes_count) == (6, 5, 2, 3)
    assert s.noise_reduction_ratio == 0.4
    deg = {r.id: (r.in_degree, r.out_degree) for r in g.nodes.collect()}
    assert deg["host:203.0.113.9"] == (0, 3)
    assert deg["super:web_surface"] == (2, 0)
