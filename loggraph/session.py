"""SparkSession settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on: UTC session time (timestamps in
# the logs are UTC or year-less), adaptive execution for runtime broadcast and
# skew handling, and ANSI-safe casts via try_cast in the expressions themselves.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture for DataFrame error messages costs extra JVM round trips
    # on every Column call while plans are built; off for production jobs.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

#: Spark's bound on the bytes of a batch of rows on its way to a Python worker (64 MB
#: unless set), and the one of jobs that send whole texts there.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

#: Paths of the tables that ``materialize`` wrote, by application.
_TABLES: dict[str, list[str]] = {}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "loggraph", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster the master and the checkpoint folder come from the cluster's
    own configuration; both are only filled in here when they are unset."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and it is used as given. A session on a
    ``local`` master without the setting (tests) gets a scratch folder; any other
    master without it is an error, because a machine-local folder would leave each
    executor's part of a table where the others cannot read it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="loggraph-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers, unless the session sets a bound of its
    own. Each running task holds a batch in native memory of the JVM, outside its heap, and
    in its worker; large ones leave both processes large after the stage."""
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def materialize(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` but keeps column pruning and filter
    pushdown for the readers, and the written table survives lost executors.
    ``options`` go to the writer. The table stays until ``drop_table`` or ``drop_tables``
    is called."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def drop_table(table: DataFrame) -> int:
    """Delete the table that ``materialize`` returned, when nothing built on it is
    needed any more; other DataFrames are left alone. Returns how many were deleted."""
    spark = table.sparkSession
    known = _TABLES.get(spark.sparkContext.applicationId, [])
    mine = [p for p in known if getattr(table, "_written_at", None) == p]
    _delete(spark, mine)
    known[:] = [p for p in known if p not in mine]
    return len(mine)


def drop_tables(spark: SparkSession) -> int:
    """Delete every table that ``materialize`` wrote in this application; returns how
    many. To be called when no result built on them is needed any more."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)
