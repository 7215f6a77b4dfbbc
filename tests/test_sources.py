"""Line sources, unified JSON view and the session store."""

import os
import tempfile

from pyspark.sql import functions as F

from loggraph.operators.graph import build_graph
from loggraph.operators.parse import from_unified_view, parse_lines, unified_view
from loggraph.sources.lines import lines_from_text, read_lines
from loggraph.sources.store import load_session, protocol_counts, store_session
from tests.samples import CHAIN, DUAL


def _folder(files):
    d = tempfile.mkdtemp(prefix="lg-src-", dir="/tmp")
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(data)
    return d


def test_read_lines_utf8_and_suffix_filter(spark):
    bad = b"Aug  5 01:15:02 h sshd[1]: Accepted publickey for r\xff\xfeot from 10.0.0.1 port 1 ssh2\n"
    d = _folder({"auth.log": bad + DUAL.encode(), "notes.json": b"{}\n", "access.txt": b"x\n",
                 "dump.gz": b"\x1f\x8b"})
    lines = read_lines(spark, d)
    files = {os.path.basename(r.file) for r in lines.select("file").distinct().collect()}
    assert files == {"auth.log", "access.txt"}
    first = lines.where(F.col("raw_line").contains("publickey for r")).first().raw_line
    assert "�" in first
    ev = parse_lines(lines)
    assert ev.where("protocol = 'SSH'").count() == 5 and ev.where("protocol = 'HTTP'").count() == 2
    heads = lines.where("is_head").count()
    assert heads == lines.count()          # small files: one split each


def test_heads_of_a_file_in_many_splits(spark):
    """Only the first split's rows are head rows; detection still sees 100 lines."""
    from loggraph.operators.detect import detect_formats, sample_lines
    line = "Aug  5 01:15:02 jumpbox sshd[1042]: Accepted publickey for a from 1.2.3.4 port 1 ssh2\n"
    d = _folder({"a.log": (line * 4000).encode()})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        lines = read_lines(spark, d)
        assert lines.count() == 4000 and 100 < lines.where("is_head").count() < 1000
        assert sample_lines(lines).count() == 100
        assert parse_lines(lines).count() == 4000
        assert detect_formats(lines).first().format_key == "SYSLOG_SSH"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_session_is_replaced_whole_and_its_id_is_text(spark):
    root = tempfile.mkdtemp(prefix="lg-store-", dir="/tmp")
    ev = parse_lines(lines_from_text(spark, CHAIN))
    store_session(ev, root, "7")
    store_session(ev.where("protocol = 'SSH'"), root, "7")
    store_session(ev, root, "007")
    store_session(ev.where("protocol = 'none'"), root, "a/b ?")
    assert load_session(spark, root, "7").where("protocol <> 'SSH'").count() == 0
    assert load_session(spark, root, "007").count() == ev.count()
    assert load_session(spark, root, "a/b ?").count() == load_session(spark, root, "unknown").count() == 0


def test_no_machine_local_folder_off_local_masters():
    from types import SimpleNamespace

    import pytest

    from loggraph.session import ensure_checkpoint_dir
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master=master)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_unified_view_round_trip(spark):
    ev = parse_lines(lines_from_text(spark, CHAIN))
    uv = unified_view(ev)
    assert uv.columns == ["timestamp", "source_ip", "protocol", "action", "target", "metadata"]
    meta = uv.where("protocol = 'SSH'").first().metadata
    assert '"user":"root"' in meta and '"dest_host":"10.0.9.88"' in meta
    back = from_unified_view(uv)
    a = sorted(map(tuple, build_graph(back).nodes.collect()))
    b = sorted(map(tuple, build_graph(ev).nodes.collect()))
    assert a == b


def test_session_store_prunes(spark):
    root = tempfile.mkdtemp(prefix="lg-sess-", dir="/tmp")
    store_session(parse_lines(lines_from_text(spark, DUAL)), root, "s1")
    store_session(parse_lines(lines_from_text(spark, CHAIN)), root, "s2")
    store_session(parse_lines(lines_from_text(spark, DUAL)), root, "s1")   # overwrite only s1
    s1 = load_session(spark, root, "s1")
    r = protocol_counts(s1).first()
    assert (r.valid_ssh_events, r.valid_http_events) == (4, 2)
    assert protocol_counts(load_session(spark, root, "s2")).first().valid_http_events == 7
    plan = s1.where("protocol = 'HTTP'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "protocol" in plan
    assert all("/session=s1/" in f for f in s1.inputFiles())   # the session's own folder, no other


def test_real_line_numbers_over_many_splits(spark, tmp_path):
    """Numbers and chunks from the counts of the splits."""
    from loggraph.sources.lines import number_lines
    texts = {"a.log": [f"line {i} " + "x" * (i % 90) for i in range(5000)], "b.log": ["one"], "c.log": [""] * 3000, "d.log": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = {}
        for r in number_lines(spark, str(tmp_path), chunk_lines=700).collect():
            got.setdefault(os.path.basename(r.file), []).append((r.line_no, r.raw_line, r.chunk_index, r.total_chunks, r.total_lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got.keys() == {"a.log", "b.log", "c.log"}
    for name, rows in got.items():
        n = len(texts[name])
        assert sorted(rows) == [(i, x, i // 700, -(-n // 700), n) for i, x in enumerate(texts[name])]


def test_heads_read_bounded_bytes(spark, tmp_path):
    """Only the first bytes count, lines may be cut, invalid bytes are replaced."""
    from loggraph.operators.detect import detect_formats, sample_heads
    from loggraph.sources.lines import read_heads
    ssh = "Aug  5 01:15:02 jumpbox sshd[1042]: Accepted publickey for a from 1.2.3.4 port 1 ssh2\n"
    web = '1.2.3.4 - - [06/Aug/2026:03:20:10 +0000] "GET /a HTTP/1.1" 200 17\n'
    (tmp_path / "a.log").write_text("\n" * 200 + ssh * 3 + web * 100_000)
    (tmp_path / "b.log").write_bytes(b"\xff\xfe" + web.encode() * 2)
    (tmp_path / "c.log").write_text("")
    heads = read_heads(spark, str(tmp_path), 200 + 3 * len(ssh) + 10)
    rows = {os.path.basename(f): [r.raw_line for r in heads.where(F.col("file") == f).orderBy("line_no").collect()]
            for f in [r.file for r in heads.select("file").distinct().collect()]}
    assert rows["a.log"] == [""] * 200 + [ssh.strip()] * 3 + [web[:10]]
    assert rows["b.log"][0].startswith("\ufffd\ufffd1.2.3.4") and "c.log" not in rows
    formats = {os.path.basename(r.file): (r.format_key, r.n_sample) for r in detect_formats(sample_heads(heads), write=False).collect()}
    assert formats == {"a.log": ("SYSLOG_SSH", 4), "b.log": ("NCSA_SQUID_HTTP", 2)}
    names = {r.file for r in read_lines(spark, str(tmp_path)).select("file").distinct().collect()}
    assert {r.file for r in heads.select("file").distinct().collect()} <= names


def _scanned(df):
    """Rows that the file scan of an executed DataFrame gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_drill_down_leaves_parts_of_a_session_out(spark, tmp_path):
    """S8/S9 with E2 and X13: sorted files, small pages and Bloom filters."""
    from loggraph.operators.parse import EVENT_FIELDS
    rows = spark.range(40_000).select(
        F.lit("ssh_accepted").alias("family"), F.lit("t").alias("timestamp"), F.format_string("10.%d.%d.7", F.col("id") % 7, F.col("id") % 200).alias("source_ip"),
        F.when(F.col("id") % 2 == 0, "SSH").otherwise("HTTP").alias("protocol"), F.lit("SUCCESS").alias("action"),
        F.lit("10.9.9.9").alias("target"), F.lit("u").alias("user"), F.lit("p").alias("auth_method"), F.lit("h").alias("dest_host"),
        F.lit(1).alias("status_code"), F.lit(1).alias("bytes_sent"), F.lit("f").alias("file"), F.col("id").alias("line_no"))
    assert {n for n, _ in EVENT_FIELDS} <= set(rows.columns)
    for ranged in (False, True):
        store_session(rows.repartition(3), str(tmp_path), f"s{ranged}", ranged=ranged)
        session = load_session(spark, str(tmp_path), f"s{ranged}")
        subnet = session.where(F.col("source_ip").startswith("10.3.44."))
        want = rows.where(F.col("source_ip").startswith("10.3.44.")).count()
        assert subnet.count() == want > 0
        assert _scanned(subnet.select("line_no")) < 20_000
        assert _scanned(session.where(F.col("source_ip") == "10.77.1.1").select("line_no")) == 0
        assert session.count() == 40_000
