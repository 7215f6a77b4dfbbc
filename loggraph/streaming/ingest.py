"""Chunked ingest as Structured Streaming.

``readStream.text`` over a log folder -> ``foreachBatch``: the same per-line parser as in
batch, the batch's events (the session) and its additive edge facts, one row per (edge,
user, status), each under the batch id, and last one progress row, which makes the batch
count. A replayed batch rewrites its own folders, so the sink is idempotent, and what a
batch writes follows the batch, not what came before. A second stream keeps the edges as
keyed state over the facts (``edge_state``), so the graph after a trigger reads the state
store and no earlier batch. Bursts that span micro-batches are found and totals are global
(divergence V7). ``Trigger.AvailableNow`` gives the stream an exact end; the graph, the
overview and drill-downs are batch jobs over state and session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loggraph.operators import edges as E
from loggraph.operators import graph as G
from loggraph.operators.clusters import build_overview
from loggraph.operators.parse import parse_lines
from loggraph.sources.lines import LOG_GLOB, file_sizes, stream_lines
from loggraph.sources.store import SESSION_SCHEMA, path_exists
from loggraph.streaming import edge_state
from loggraph.streaming.totals import totals_by_batch

PROGRESS = "batch_id long, lines long, bytes long, total_bytes long"


class StreamIngest:
    """Run a log folder through the stream; ``state_dir`` is a shared folder."""

    def __init__(self, spark: SparkSession, state_dir: str):
        self.spark = spark
        self.state_dir = state_dir.rstrip("/")
        self.query = None
        self.total_bytes = 0

    def _folder(self, kind: str, batch_id: int | None = None) -> str:
        return f"{self.state_dir}/{kind}" + ("" if batch_id is None else f"/b={batch_id}")

    def _delete(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _stored(self, kind: str, schema: str) -> DataFrame:
        """All rows under a kind, with their batch ``b``; one listing by Spark's reader."""
        root = self._folder(kind)
        if not path_exists(self.spark, root):
            return self.spark.createDataFrame([], f"{schema}, b int")
        return self.spark.read.schema(f"{schema}, b int").option("basePath", root).parquet(root)

    def _progress(self) -> DataFrame:
        return self._stored("progress", PROGRESS)

    def _complete(self) -> int:
        """The last complete batch (-1: none); every batch before it is complete too."""
        last = self._progress().agg(F.max("batch_id")).first()[0]
        return -1 if last is None else last

    # -- streaming part -----------------------------------------------------
    def _store(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch sink: the batch's events, its edge facts, its progress."""
        spark, seen, events = batch.sparkSession, Observation(), self._folder("events", batch_id)
        lines = batch.observe(seen, F.count(F.lit(1)).alias("lines"),
                              F.coalesce(F.sum(F.octet_length("raw_line") + 1), F.lit(0)).alias("bytes"))
        parse_lines(lines).select(*SESSION_SCHEMA.names).write.mode("overwrite").parquet(events)
        facts = E.edge_facts(spark.read.schema(SESSION_SCHEMA).parquet(events))
        facts.write.mode("overwrite").parquet(self._folder("facts", batch_id))
        row = (batch_id, seen.get["lines"], seen.get["bytes"], self.total_bytes)
        spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(self._folder("progress", batch_id))

    def start(self, log_dir: str, max_files_per_trigger: int | None = 1, available_now: bool = True):
        self.total_bytes = file_sizes(self.spark, log_dir, LOG_GLOB).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        lines = stream_lines(self.spark, log_dir, max_files_per_trigger)
        w = lines.writeStream.option("checkpointLocation", f"{self.state_dir}/checkpoint").foreachBatch(self._store)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        self.query = w.start()
        return self.query

    def run(self, log_dir: str, max_files_per_trigger: int | None = 1) -> "StreamIngest":
        """Process the whole backlog (AvailableNow) and wait for the exact end."""
        q = self.start(log_dir, max_files_per_trigger, available_now=True)
        q.awaitTermination()
        return self

    # -- T4: edges as keyed state -------------------------------------------
    @property
    def _edge_checkpoint(self) -> str:
        return f"{self.state_dir}/edge-checkpoint"

    def update_edges(self, files_per_trigger: int | None = None) -> "StreamIngest":
        """Bring the keyed edge state up to the stored facts. The edges that a trigger
        changed are written with their new totals under ``edges/t=<trigger>``."""
        root = self._folder("facts")
        if not path_exists(self.spark, root):
            return self
        schema = E.edge_facts(self.spark.createDataFrame([], SESSION_SCHEMA)).schema.add("b", T.IntegerType())
        reader = self.spark.readStream.schema(schema).option("basePath", root)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))

        def write(changed: DataFrame, trigger: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.state_dir}/edges/t={trigger}")

        store, conf = "spark.sql.streaming.stateStore.providerClass", self.spark.conf
        before = conf.get(store)
        conf.set(store, edge_state.ROCKSDB)
        try:
            (edge_state.edge_changes(reader.parquet(root)).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", self._edge_checkpoint).trigger(availableNow=True).start().awaitTermination())
        finally:
            conf.set(store, before)
        return self

    def edge_counts(self) -> DataFrame:
        """Edge state after the last ``update_edges``, read from the state store."""
        return edge_state.edge_totals(self.spark, self._edge_checkpoint)

    def state_graph(self) -> G.Graph:
        """The graph of the keyed state; no batch is read."""
        g = G.build_graph_from_counts(self.edge_counts())
        g.edge_users = edge_state.edge_users(self.spark, self._edge_checkpoint)
        return g

    # -- batch part after the stream (T2) ------------------------------------
    def events(self) -> DataFrame:
        """The stream's session: all parsed events of complete batches."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SESSION_SCHEMA.fields)
        return self._stored("events", schema).where(F.col("b") <= self._complete()).select(*SESSION_SCHEMA.names)

    def batch_facts(self) -> DataFrame:
        """Edge facts of all complete batches with their batch ``b``; compacted ones
        carry the last batch they stand for."""
        empty = E.edge_facts(self.spark.createDataFrame([], SESSION_SCHEMA)).schema
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.fields)
        base = self._compacted()
        new = self._stored("facts", schema).where((F.col("b") <= self._complete()) & (F.col("b") > base))
        return new if base < 0 else new.unionByName(self._stored("compacted", schema).where(F.col("b") == base))

    def _batches(self, kind: str) -> list[int]:
        """Complete batches of a kind, by one listing through the Hadoop file system API."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder(kind)}/b=*/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)

    def _compacted(self) -> int:
        return max(self._batches("compacted"), default=-1)

    def facts(self, until: int | None = None) -> DataFrame:
        """Edge facts summed over the batches up to ``until``."""
        rows = self.batch_facts()
        return E.merge_facts(rows if until is None else rows.where(F.col("b") <= until))

    def compact(self) -> None:
        """Fold all facts so far into one table and delete what it replaces, after the
        keyed state has taken them in. Running totals start at the compacted batch
        afterwards."""
        done, old = self._complete(), self._compacted()
        if done <= old:
            return
        self.update_edges()
        self.facts().write.mode("overwrite").parquet(self._folder("compacted", done))
        for b in self._batches("facts"):
            if b <= done:
                self._delete(self._folder("facts", b))
        if old >= 0:
            self._delete(self._folder("compacted", old))

    def graph(self, until: int | None = None) -> G.Graph:
        return G.graph_from_facts(self.facts(until))

    def overview(self):
        """The cluster overview over the stream's session."""
        return build_overview(self.events())

    def running_totals(self) -> DataFrame:
        """K5: global totals after each micro-batch (anomalous edges, high-risk nodes,
        chains, nodes, edges), from one job over the facts."""
        if self._complete() < 0:
            raise ValueError("no batch has been stored yet")
        batches = self._progress().where(F.col("batch_id") >= self._compacted()).select(F.col("batch_id").alias("b"))
        return totals_by_batch(self.batch_facts(), batches)

    def chunks(self) -> DataFrame:
        """One row per stored micro-batch: chunk index, lines, lines so far,
        the total number of lines (estimated from the listed bytes and the mean line so
        far, exact once all is read) and the percent of the listed bytes that is done."""
        from pyspark.sql import Window
        up_to = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per batch
        rows = self._progress().where("lines > 0")
        done = F.sum("bytes").over(up_to)
        total = F.greatest("total_bytes", done)
        processed = F.sum("lines").over(up_to)
        return rows.select(
            F.col("batch_id").alias("chunk_index"), "lines", processed.alias("processed_lines"),
            F.when(done >= F.col("total_bytes"), processed).otherwise(F.ceil(total * processed / done)).cast("long").alias("total_lines"),
            F.round(F.least(done / total, F.lit(1.0)) * 100, 1).alias("progress"))

    def progress(self) -> list[dict]:
        """T5 / F15 as a list: rows per micro-batch and percent of the listed bytes."""
        return [{"batch_id": r.chunk_index, "rows": r.lines, "processed": r.processed_lines, "progress": r.progress}
                for r in self.chunks().orderBy("chunk_index").collect()]
