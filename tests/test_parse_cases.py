"""Scalar and parser cases from FIXTURES section 4."""

import pytest
from pyspark.sql import functions as F

from loggraph.functions.net import is_private, subnet24
from loggraph.functions.uri import is_static_asset, uri_prefix
from loggraph.operators.parse import FAMILY_TABLE, parse_lines
from loggraph.sources.lines import lines_from_text

URI_CASES = [
    ("/api/v1/users/42/profile?p=1", "/api/v1"),
    ("/item/550e8400-e29b-41d4-a716-446655440000/7", "/item/*"),
    ("/42/17/x", "/*/x"),
    ("/users/42", "/users/*"),
    ("/", "/"),
    ("/a/?q=/b/c", "/a/"),
    ("/2024abc/z", "/*abc/z"),
    ("/550E8400-E29B-41D4-A716-446655440000", "/*E8400-E29B-41D4-A716-446655440000"),
    ("http://example.com/a/1?x=2", "http://example.com/a/1?x=2"),
    ("*", "*"),
]
STATIC_TRUE = ["/app.JS?v=1", "/logo.png", "/api/data.json", "/feed.rss?x"]
STATIC_FALSE = ["/a.js#x", "/file.tar.bz2"]


def test_uri_prefix(spark):
    df = spark.createDataFrame([(u,) for u, _ in URI_CASES], "uri string")
    got = dict(df.select("uri", uri_prefix("uri").alias("p")).collect())
    assert got == dict(URI_CASES)


def test_static_assets(spark):
    df = spark.createDataFrame([(u,) for u in STATIC_TRUE + STATIC_FALSE], "uri string")
    got = dict(df.select("uri", is_static_asset("uri").alias("s")).collect())
    assert all(got[u] for u in STATIC_TRUE)
    assert not any(got[u] for u in STATIC_FALSE)


def test_private_and_subnet(spark):
    rows = [("10.0.4.15",), ("192.168.1.10",), ("172.16.0.1",), ("172.31.9.9",), ("172.32.0.1",),
            ("127.0.0.1",), ("198.51.100.42",), ("database01",)]
    df = spark.createDataFrame(rows, "ip string")
    got = {r.ip: (r.p, r.s) for r in df.select("ip", is_private("ip").alias("p"), subnet24("ip").alias("s")).collect()}
    assert got["10.0.4.15"] == (True, "10.0.4.0/24")
    assert got["172.31.9.9"][0] and got["172.16.0.1"][0] and got["127.0.0.1"][0]
    assert not got["172.32.0.1"][0] and not got["198.51.100.42"][0]
    assert got["database01"] == (False, "database01.0/24")


def _parse(spark, text, families=None):
    return {r.line_no: r for r in parse_lines(lines_from_text(spark, text), families).collect()}


def test_squid_line(spark):
    line = ("1723150200.123    120 10.0.0.7 TCP_MISS/200 4512 GET http://example.com/a/1?x=2 - "
            "DIRECT/93.184.216.34 text/html")
    ev = _parse(spark, line, list(FAMILY_TABLE))
    r = ev[0]
    assert (r.family, r.timestamp, r.source_ip, r.action, r.status_code, r.bytes_sent) == \
        ("squid", "1723150200.123", "10.0.0.7", "GET", 200, 4512)


def test_ncsa_edge_cases(spark):
    text = ('10.0.0.8 - - [06/Aug/2026:03:20:15 +0000] "GET /x HTTP/1.1" 304 -\n'
            '10.0.0.8 - bob [06/Aug/2026:03:20:15 +0000] "GET /x HTTP/2" 200 99999999999\n')
    ev = _parse(spark, text)
    assert 0 not in ev                       # '-' byte count: no match, dropped
    assert ev[1].bytes_sent is None and ev[1].status_code == 200   # INT overflow -> NULL


def test_ssh_invalid_user(spark):
    ev = _parse(spark, "Aug  5 03:22:10 h1 sshd[1]: Invalid user bob from 10.0.0.9")
    r = ev[0]
    assert (r.action, r.user, r.auth_method, r.source_ip, r.target) == ("FAILURE", "bob", "password", "10.0.0.9", "h1")


def test_failed_invalid_user_prefix_removed(spark):
    ev = _parse(spark, "Aug  6 18:00:02 web-server-01 sshd[1235]: Failed password for invalid user admin "
                       "from 10.0.0.5 port 54322")
    assert ev[0].user == "admin" and ev[0].action == "FAILURE"


def test_zeek_ssh_and_http(spark):
    ssh = "\t".join(["1723150200.1", "C1", "10.0.0.5", "4000", "10.0.0.6", "22", "success"])
    ev = _parse(spark, "#fields\tts\n" + ssh + "\n" + ssh.replace("10.0.0.5", "-"), list(FAMILY_TABLE))
    rows = [r for r in ev.values() if r.family.startswith("zeek")]
    assert len(rows) == 1
    r = rows[0]
    assert (r.family, r.action, r.target, r.user, r.dest_host) == ("zeek_ssh", "SUCCESS", "10.0.0.6", "root", None)
    http = "\t".join(["1723150200.1", "C2", "10.0.0.5", "4001", "10.0.0.7", "80", "1", "GET", "h", "/p", "-",
                      "1.1", "ua", "0", "404"])
    ev = _parse(spark, http, list(FAMILY_TABLE))
    r = [r for r in ev.values() if r.family.startswith("zeek")][0]
    assert (r.family, r.action, r.target, r.status_code, r.bytes_sent) == ("zeek_http", "GET", "/p", 404, 100)


def test_empty_input(spark):
    from loggraph.operators.graph import build_graph
    from loggraph.sources.lines import empty_lines
    ev = parse_lines(empty_lines(spark))
    assert ev.count() == 0
    g = build_graph(ev)
    s = g.summary.collect()[0]
    assert (s.total_nodes, s.total_edges, s.noise_reduction_ratio) == (0, 0, 0.0)


@pytest.mark.parametrize("text,fmt", [
    ("Aug  5 01:15:02 jumpbox sshd[1042]: Accepted publickey for a from 1.2.3.4 port 1 ssh2", "SYSLOG_SSH"),
    ('1.2.3.4 - - [06/Aug/2026:03:20:10 +0000] "GET / HTTP/1.1" 200 1', "NCSA_SQUID_HTTP"),
    ("#fields\tts\tuid\n1\tC\t1.2.3.4\t1\t5.6.7.8\t22\tsuccess", "ZEEK_TSV"),
    ("nothing to see here", "SYSLOG_SSH"),
])
def test_detect(spark, text, fmt):
    from loggraph.operators.detect import detect_formats
    r = detect_formats(lines_from_text(spark, text)).collect()[0]
    assert r.format_key == fmt


def test_routed_parse_uses_one_parser_per_file(spark):
    from loggraph.operators.detect import detect_formats
    from loggraph.operators.parse import parse_routed
    from tests.samples import DUAL
    lines = lines_from_text(spark, DUAL)
    ev = parse_routed(lines, detect_formats(lines)).collect()
    assert {r.protocol for r in ev} == {"SSH"} and len(ev) == 4


def test_line_event_counts_one_pass(spark):
    from loggraph.operators.parse import line_event_counts
    from tests.samples import DUAL
    r = line_event_counts(lines_from_text(spark, DUAL + "\n   \n")).collect()[0]
    assert (r.total_lines, r.valid_ssh_events, r.valid_http_events) == (8, 4, 2)


def test_modal_status_from_facts(spark):
    """Mode over per-status counts: NULL statuses ignored, ties to the smaller code."""
    from loggraph.operators import edges as E
    rows = [("HTTP", "1.2.3.4", "/a", "GET", "GET", None, s, "t") for s in [200, 404, 404, 200, None, None, None]]
    ev = spark.createDataFrame(rows, "protocol string, source_ip string, target string, action string, "
                                     "verb string, user string, status_code int, timestamp string")
    r = E.edge_counts(ev).first()
    assert (r.status_code, r.total_attempts, r.count_4xx) == (200, 7, 2)
    direct = ev.groupBy("source_ip").agg(F.mode("status_code", True).alias("m")).first().m
    assert direct == r.status_code


ACCESS = '1.2.3.4 - - [06/Aug/2026:03:20:10 +0000] "GET {} HTTP/1.1" 200 17'
SQUID_LINE = "1723150200.123    20 10.0.0.9 TCP_MISS/200 900 GET http://a.example/x - DIRECT/1.1.1.1 text/html"


def test_one_line_never_switches_a_parser_off(spark):
    """An access log that mentions TCP_, Squid lines and Zeek rows in one file."""
    zeek = "\t".join(["1723150200.1", "C1", "10.0.0.5", "4000", "10.0.0.6", "22", "success"])
    text = "\n".join([ACCESS.format("/docs/TCP_tuning"), ACCESS.format("/a"), SQUID_LINE, zeek, ACCESS.format("/b")])
    fams = [r.family for r in parse_lines(lines_from_text(spark, text)).orderBy("line_no").collect()]
    assert fams == ["ncsa", "ncsa", "squid", "zeek_ssh", "ncsa"]


def test_blank_headed_file_falls_back_to_the_first_parser(spark):
    from loggraph.operators.detect import detect_formats
    from loggraph.operators.parse import parse_routed
    text = "\n" * 120 + "Aug  5 01:15:02 jumpbox sshd[1042]: Accepted publickey for a from 1.2.3.4 port 1 ssh2"
    lines = lines_from_text(spark, text)
    assert parse_routed(lines, detect_formats(lines)).count() == 1
    assert parse_lines(lines).count() == 1


def test_a_line_of_both_http_parsers(spark):
    from loggraph.operators.detect import detect_formats
    from loggraph.operators.parse import parse_routed
    line = SQUID_LINE.replace(" - DIRECT/1.1.1.1 text/html", ' - - [06/Aug/2026:03:20:10 +0000] "GET /x HTTP/1.1" 200 5')
    lines = lines_from_text(spark, line)
    assert sorted(r.family for r in parse_routed(lines, detect_formats(lines)).collect()) == ["ncsa", "squid"]
    assert [r.family for r in parse_lines(lines).collect()] == ["squid"]


def test_register_a_format(spark):
    """The extension point: a family and its score, without touching the modules."""
    from pyspark.sql import functions as F

    from loggraph.operators import detect, parse
    pattern = r"^TOY (\S+) (\S+)$"
    is_toy = lambda: F.col("raw_line").rlike(pattern)
    parse.register_family(parse.Family("toy", "TOY", is_toy, is_toy, lambda: parse._event(
        "toy", source_ip=parse._grp(pattern, 1), target=parse._grp(pattern, 2), protocol=F.lit("SSH"), action=F.lit("SUCCESS"))))
    detect.register_format("TOY", "toy_score", lambda: F.count_if(is_toy()) / F.count(F.lit(1)))
    try:
        lines = lines_from_text(spark, "TOY 1.2.3.4 host1\nTOY 1.2.3.5 host2")
        found = detect.detect_formats(lines)
        assert found.first().format_key == "TOY"
        assert parse.parse_routed(lines, found).count() == parse.parse_lines(lines).count() == 2
    finally:
        del parse.FAMILY_TABLE["toy"], detect.FORMATS["TOY"]


def test_mixed_parse_plan_has_one_scan_and_no_exchange(spark, tmp_path):
    from loggraph.sources.lines import read_lines
    (tmp_path / "a.log").write_text("x\n")
    plan = parse_lines(read_lines(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan


def _zeek(verb, uri="/x", ts="1723150200.1"):
    return "\t".join([ts, "C1", "10.0.0.5", "4000", "10.2.0.1", "80", "1", verb, "www.example.com", uri, "-", "1.1", "M", "0", "200"])


def _parsed(spark, text, layouts=True):
    from loggraph.operators.detect import zeek_layouts
    lines = lines_from_text(spark, text)
    ev = parse_lines(lines, layouts=zeek_layouts(lines) if layouts else None)
    return [(r.family, r.source_ip, r.action) for r in ev.orderBy("line_no").collect()]


def test_a_zeek_http_row_without_verb_is_no_ssh_failure(spark):
    """The layout comes from the file: its header, else its first data row."""
    rows = [_zeek("GET"), _zeek("-"), _zeek("-", uri="-")]
    want = [("zeek_http", "10.0.0.5", v) for v in ("GET", "-", "-")]
    assert _parsed(spark, "\n".join(rows)) == want
    assert _parsed(spark, "\n".join(rows[:2]), layouts=False) == want[:2]
    header = "#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\ttrans_depth\tmethod\thost\turi"
    assert _parsed(spark, "\n".join([header, *reversed(rows)])) == want[::-1]
    ssh = "\t".join(["1723150200.1", "C1", "10.0.0.5", "4000", "10.0.0.6", "22", "success", "GET", "x", "/y"])
    assert _parsed(spark, "#fields\tts\tauth_success\n" + ssh) == [("zeek_ssh", "10.0.0.5", "SUCCESS")]


def test_a_tab_separated_access_log_is_no_zeek_log(spark):
    line = '10.0.0.7\t-\tfrank\t[06/Aug/2026:03:20:10 +0000]\t"GET /a HTTP/1.1"\t200\t23'
    assert _parsed(spark, line) == _parsed(spark, line, layouts=False) == [("ncsa", "10.0.0.7", "GET")]
    dated = '1723150200\t-\tfrank\t[06/Aug/2026:03:20:10 +0000]\t"GET /a HTTP/1.1"\t200\t23'
    assert _parsed(spark, dated) == [("ncsa", "1723150200", "GET")]
    iso = _zeek("GET", ts="2026-08-06T03:20:10.123Z")
    assert _parsed(spark, iso) == [("zeek_http", "10.0.0.5", "GET")]


def test_default_and_routed_path_agree_on_every_rendered_file(spark):
    from loggraph.operators.detect import detect_formats, zeek_layouts
    from loggraph.operators.parse import parse_routed
    from loggraph.sources.render import render_lines
    lines = render_lines(spark, "/root/testdata/sf0.001", "files").where("file <> 'both.log'")  # two parsers accept those lines
    routed = parse_routed(lines, detect_formats(lines))
    default = parse_lines(lines, layouts=zeek_layouts(lines))
    files = {r.file for r in routed.select("file").distinct().collect()}
    assert {"dash_http.log", "tab_access.log", "zeek_http.log", "tcp_access.log"} <= files
    a, b = (sorted(map(str, ev.collect())) for ev in (routed, default))
    assert a == b and len(a) > 2000


def test_a_first_data_row_behind_a_long_header(spark):
    """Over a hundred comment lines in front: the routed path still finds the layout."""
    from loggraph.operators.detect import detect_formats
    from loggraph.operators.parse import parse_routed
    text = "#fields\tts\n" + "#note\n" * 150 + _zeek("GET")
    lines = lines_from_text(spark, text)
    found = detect_formats(lines)
    assert found.first().zeek_fields == 15
    assert [r.family for r in parse_routed(lines, found).collect()] == ["zeek_http"]


def test_a_parser_of_whole_tables(spark):
    """The other extension point: line table in, event table out, here with a join."""
    from pyspark.sql import functions as F

    from loggraph.operators import detect, parse

    def hosts(lines):
        named = lines.where(F.col("raw_line").startswith("HOST ")).select(F.expr("split(raw_line, ' ')[1]").alias("target"), "file")
        out = lines.where(F.col("raw_line").startswith("SEEN ")).join(named, "file").withColumn("source_ip", F.expr("split(raw_line, ' ')[1]"))
        known = {"protocol": "SSH", "action": "SUCCESS", "family": "pair"}
        return out.select(*[F.lit(known[n]).alias(n) if n in known else F.col(n) if n in out.columns else F.lit(None).cast(t).alias(n)
                            for n, t in [*((n, t) for n, t in parse.EVENT_FIELDS[1:]), ("family", "string"), ("file", "string"), ("line_no", "long")]])

    parse.register_parser("PAIRS", hosts)
    detect.register_format("PAIRS", "pair_score", lambda: F.count_if(F.col("raw_line").rlike("^(HOST|SEEN) ")) / F.count(F.lit(1)))
    try:
        lines = lines_from_text(spark, "HOST h1\nSEEN 1.2.3.4\nSEEN 1.2.3.5")
        ev = parse.parse_routed(lines, detect.detect_formats(lines)).collect()
        assert sorted((r.source_ip, r.target) for r in ev) == [("1.2.3.4", "h1"), ("1.2.3.5", "h1")]
    finally:
        del parse.TABLE_PARSERS["PAIRS"], detect.FORMATS["PAIRS"]
