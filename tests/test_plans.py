"""Plan checks: no Cartesian products, nested-loop joins or Python evaluation in the
registered queries' physical plans; the end-to-end path over a real log folder."""

import os
import tempfile

import pytest

import __spark_entry__ as se

SF = "/root/testdata/sf0.001"
BAD = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
       "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]


@pytest.mark.parametrize("name", ["g12_nodes", "g14_edges", "c3_super_edges", "x1_web_ssh_300s",
                                  "e2_expand_subnet", "d_format_scores", "p11_mixed_family_counts",
                                  "x9_super_aggregates", "j7_neighbours", "a1_ssh_edges", "a16_merge_ssh", "p6_zeek_http",
                                  "x11_prefix_edges", "k5_totals_of_fifty", "g13_edge_ends", "a21_session_record"])
def test_plan_has_no_cross_join_or_python(spark, name):
    df = se.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in BAD:
        assert bad not in plan, (name, bad)


def test_analyze_path_routed(spark):
    from loggraph.plans.pipeline import analyze_path
    from tests.samples import CHAIN
    d = tempfile.mkdtemp(prefix="lg-e2e-", dir="/tmp")
    ssh = "\n".join(line for line in CHAIN.splitlines() if "sshd" in line) + "\n"
    web = "\n".join(line for line in CHAIN.splitlines() if "HTTP/" in line) + "\n"
    with open(os.path.join(d, "auth.log"), "w") as fh:
        fh.write(ssh)
    with open(os.path.join(d, "access.log"), "w") as fh:
        fh.write(web)
    routed = analyze_path(spark, d, route=True)
    mixed = analyze_path(spark, d, route=False)
    a = sorted(map(tuple, routed.graph.nodes.collect()))
    b = sorted(map(tuple, mixed.graph.nodes.collect()))
    assert a == b and len(a) == 6
    m = routed.meta.first()
    assert (m.total_lines, m.valid_ssh_events, m.valid_http_events) == (11, 4, 7)


def test_drilldown_predicates_reach_the_scan(spark):
    from loggraph import constants as K
    from loggraph.operators.edges import edge_facts
    from loggraph.operators.expand import cluster_predicate
    from loggraph.plans.pipeline import ingest
    from loggraph.sources.render import render_lines
    root = tempfile.mkdtemp(prefix="lg-push-", dir="/tmp")
    ev = ingest(render_lines(spark, SF), root, "s")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")   # show whole filter lists

    def scan_of(super_id):
        plan = edge_facts(ev.where(cluster_predicate(super_id)))._jdf.queryExecution().executedPlan().toString()
        return plan

    assert "StringStartsWith(source_ip,10.0.1.)" in scan_of("super:subnet:10.0.1.0/24")
    assert "StringStartsWith(source_ip,192.168.)" in scan_of(K.SUPER_INTERNAL_BASELINE)
    web = scan_of(K.SUPER_WEB_SURFACE)
    assert "PartitionFilters" in web and "(protocol" in web and "= HTTP)" in web
