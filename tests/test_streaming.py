"""Batch result equals streaming result after AvailableNow."""

import tempfile

from loggraph.operators.graph import build_graph
from loggraph.operators.parse import parse_lines
from loggraph.sources.render import render_lines
from loggraph.streaming.ingest import StreamIngest


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="lg-stream-", dir="/tmp")
    lines = render_lines(spark, "/root/testdata/sf0.001")
    lines.select("raw_line").repartition(3, "raw_line").write.text(f"{d}/logs")
    si = StreamIngest(spark, f"{d}/state").run(f"{d}/logs", max_files_per_trigger=1)
    g = si.graph()
    gb = build_graph(parse_lines(lines))
    assert sorted(map(tuple, g.nodes.collect())) == sorted(map(tuple, gb.nodes.collect()))
    assert sorted(map(tuple, g.summary.collect())) == sorted(map(tuple, gb.summary.collect()))
    totals = si.running_totals().orderBy("batch_id").collect()
    assert len(totals) == 3
    assert totals[-1].anomalous_edges_count == gb.summary.first().anomalous_edges_count
    prog = si.progress()
    assert prog[-1]["progress"] == 100.0
    si.compact()
    assert si._batches("facts") == [] and len(si._batches("compacted")) == 1
    assert sorted(map(tuple, si.graph().summary.collect())) == sorted(map(tuple, gb.summary.collect()))
    assert si.events().count() == parse_lines(lines).count()
    assert si.overview().super_nodes.count() > 0


def test_a_squid_folder_streams(spark):
    d = tempfile.mkdtemp(prefix="lg-sq-", dir="/tmp")
    lines = render_lines(spark, "/root/testdata/sf0.001", "squid")
    lines.select("raw_line").coalesce(1).write.text(f"{d}/logs")
    si = StreamIngest(spark, f"{d}/state").run(f"{d}/logs")
    assert si.events().where("family = 'squid'").count() == lines.count()


def test_stream_timeline_equals_batch_without_late_rows(spark):
    """X2 on a stream (watermarked windows, update mode): one file, no late rows."""
    from pyspark.sql import functions as F

    from loggraph.operators.timeline import timeline, timeline_stream
    from loggraph.sources.lines import stream_lines
    d = tempfile.mkdtemp(prefix="lg-tl-", dir="/tmp")
    lines = render_lines(spark, "/root/testdata/sf0.001")
    lines.select("raw_line").coalesce(1).write.text(f"{d}/logs")
    q = (timeline_stream(parse_lines(stream_lines(spark, f"{d}/logs")), 2024)
         .writeStream.outputMode("update").format("memory").queryName("lg_timeline")
         .option("checkpointLocation", f"{d}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.b: (r.e, r.f) for r in spark.table("lg_timeline").groupBy(F.col("bucket_start").alias("b"))
           .agg(F.max("event_count").alias("e"), F.max("failed_count").alias("f")).collect()}
    want = {r.bucket_start: (r.event_count, r.failed_count) for r in timeline(parse_lines(lines), 2024).collect()}
    assert got == want


def _rows(df):
    return sorted(str(r) for r in df.collect())


def test_keyed_edge_state_equals_the_batch_and_survives_replays(spark, tmp_path):
    """T4: the state after every trigger, the changed edges alone, and a batch twice."""
    from pyspark.sql import functions as F

    from loggraph.operators import edges as E
    ev = parse_lines(render_lines(spark, "/root/testdata/sf0.001"))
    si = StreamIngest(spark, str(tmp_path))
    parts = [ev.where(F.pmod("line_no", F.lit(3)) == p) for p in range(3)]
    columns = [c for c in E.counts_from_facts(E.edge_facts(ev)).columns]
    for b, part in enumerate(parts):
        E.edge_facts(part).write.parquet(si._folder("facts", b))
        si.update_edges()
        so_far = ev.where(F.pmod("line_no", F.lit(3)) <= b)
        assert _rows(si.edge_counts().select(*columns)) == _rows(E.counts_from_facts(E.edge_facts(so_far)))
    changed = spark.read.parquet(f"{tmp_path}/edges/t=2")
    touched = parts[2].transform(E.edge_facts).select(*E.EDGE_KEYS).distinct().count()
    assert changed.count() == touched < si.edge_counts().count()
    before = _rows(si.edge_counts())
    E.edge_facts(parts[1]).write.mode("overwrite").parquet(si._folder("facts", 1))  # replayed: new files, same batch
    si.update_edges()
    assert _rows(si.edge_counts()) == before
    g = si.state_graph()
    b = build_graph(ev)
    assert _rows(g.nodes) == _rows(b.nodes) and _rows(g.edge_users) == _rows(b.edge_users)


def test_totals_by_retraction_equal_one_graph_per_batch(spark):
    """K5: edges that become baseline, a late attack chain, nodes that turn signal."""
    from loggraph.operators import edges as E
    from loggraph.streaming.totals import totals_by_batch

    def ssh(b, src, host, user, action, n=1):
        return [("SSH", src, action, host, user, None, "t", b)] * n

    def http(b, src, uri, verb, status, n=1):
        return [("HTTP", src, verb, uri, None, status, "t", b)] * n

    rows = [*ssh(0, "10.0.0.1", "10.0.0.2", "svc", "SUCCESS", 3), *ssh(1, "10.0.0.1", "10.0.0.2", "svc", "SUCCESS", 60),
            *ssh(2, "10.0.0.1", "10.0.0.2", "root", "FAILURE", 2), *ssh(0, "8.8.8.8", "10.0.0.2", "bob", "SUCCESS"),
            *http(3, "8.8.8.8", "/up", "POST", 200), *http(0, "9.9.9.9", "/a", "GET", 200, 2), *http(2, "9.9.9.9", "/a", "GET", 200, 70),
            *http(4, "9.9.9.9", "/a", "GET", 404), *http(1, "7.7.7.7", "/b", "GET", 200), *http(3, "7.7.7.7", "/a", "GET", 200),
            *ssh(4, "10.0.0.9", "10.0.0.8", "x", "FAILURE", 9), *ssh(6, "10.0.0.9", "10.0.0.8", "x", "SUCCESS", 90)]
    ev = spark.createDataFrame(rows, "protocol string, source_ip string, action string, target string, user string, "
                                     "status_code int, timestamp string, b int")
    got = totals_by_batch(E.edge_facts(ev, "b"), spark.range(8).withColumnRenamed("id", "b")).orderBy("batch_id").collect()
    for b, r in enumerate(got):
        want = build_graph(ev.where(f"b <= {b}"), materialize=False).summary.first()
        assert (r.batch_id, r.anomalous_edges_count, r.high_risk_nodes_count, r.total_nodes, r.total_edges) == (
            b, want.anomalous_edges_count, want.high_risk_nodes_count, want.total_nodes, want.total_edges), b
    assert len(got) == 8


def test_progress_of_more_than_a_hundred_batches(spark, tmp_path):
    """T5: progress comes from rows stored with each batch, not from the query's memory."""
    si = StreamIngest(spark, str(tmp_path))
    rows = [(b, 10, 100, 15_000, b) for b in range(150)]
    spark.createDataFrame(rows, "batch_id long, lines long, bytes long, total_bytes long, b int").coalesce(1).write.partitionBy("b").parquet(f"{tmp_path}/progress")
    prog = si.progress()
    assert len(prog) == 150 and [p["processed"] for p in prog] == [10 * (b + 1) for b in range(150)]
    assert prog[0]["progress"] == 0.7 and prog[74]["progress"] == 50.0 and prog[-1]["progress"] == 100.0
    assert [r.total_lines for r in si.chunks().collect()] == [1500] * 150


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    lines = render_lines(spark, "/root/testdata/sf0.001")
    lines.select("raw_line").repartition(2).write.text(f"{tmp_path}/logs")
    si = StreamIngest(spark, f"{tmp_path}/state").run(f"{tmp_path}/logs")
    n = si.events().count()
    si.events().limit(5).write.parquet(si._folder("events", 7))   # no progress row: the batch is not complete
    assert si.events().count() == n == lines.count()
