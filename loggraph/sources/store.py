"""Session store and result sinks.

A session is one folder of Parquet files partitioned by ``protocol``. Storing a
session again replaces its folder as a whole; reading it is a partition-pruned scan
into which predicates such as the drill-down filters are pushed.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loggraph.operators.parse import EVENT_FIELDS

SESSION_SCHEMA = T.StructType([T.StructField(n, t) for n, t in EVENT_FIELDS[1:]] + [
    T.StructField("family", T.StringType()), T.StructField("file", T.StringType()), T.StructField("line_no", T.LongType())])


#: Rows of a page (the smallest part that a scan leaves out), distinct values a Bloom filter expects.
PAGE_ROWS, BLOOM_VALUES = 2_000, 50_000


def session_path(root: str, session_id: str) -> str:
    """The session's own folder; any text is an id, "7" and "007" are two."""
    return f"{root.rstrip('/')}/session={quote(session_id, safe='')}"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def store_session(events: DataFrame, root: str, session_id: str, ranged: bool = False) -> str:
    """Write one session's unified events as Snappy Parquet; returns the root.

    Each file is sorted by source address and carries Bloom filters of addresses and
    targets, so a drill-down by address (E2, X13) reads the pages and row groups that can
    hold it. The sort is inside each task; ``ranged=True`` also deals the rows out by
    range of the address (one shuffle), so that most files are left out as a whole."""
    rows = events.select(*SESSION_SCHEMA.names)
    if ranged:
        rows = rows.repartitionByRange("protocol", "source_ip", "target", "line_no")
    writer = (rows.sortWithinPartitions("protocol", "source_ip").write.mode("overwrite").partitionBy("protocol")
              .option("compression", "snappy").option("parquet.page.row.count.limit", PAGE_ROWS))
    for column in ("source_ip", "target"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", BLOOM_VALUES)
    writer.parquet(session_path(root, session_id))
    return root


def load_session(spark: SparkSession, root: str, session_id: str) -> DataFrame:
    """Lazy, partition-pruned scan of one session; an unknown id is an empty one."""
    path = session_path(root, session_id)
    if not path_exists(spark, path):
        return spark.createDataFrame([], SESSION_SCHEMA)
    return spark.read.schema(SESSION_SCHEMA).parquet(path)


def protocol_counts(events: DataFrame) -> DataFrame:
    """SSH and HTTP event counts in one pass (one row)."""
    return events.agg(F.count_if(F.col("protocol") == "SSH").alias("valid_ssh_events"),
                      F.count_if(F.col("protocol") == "HTTP").alias("valid_http_events"))


def write_graph(nodes: DataFrame, edges: DataFrame, summary: DataFrame, path: str) -> str:
    """The result as JSON-lines tables (nodes/, edges/, summary/), written in parallel."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    summary.write.mode("overwrite").json(f"{path}/summary")
    return path


def bounded_payload(nodes: DataFrame, edges: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """One nested JSON document ``{"nodes": [...], "edges": [...]}``.

    Only for results with a proven size bound (the top-75 drill-down, the
    <= 50-node overview): the document is built in one group."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    doc = n.unionByName(e, allowMissingColumns=True).agg(
        F.first("nodes", ignorenulls=True).alias("nodes"), F.first("edges", ignorenulls=True).alias("edges"))
    return doc.select(F.to_json(F.struct("nodes", "edges")).alias("payload"))
