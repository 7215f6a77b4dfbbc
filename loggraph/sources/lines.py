"""Raw log line sources.

Every source yields the same line table::

    raw_line STRING, file STRING, line_no BIGINT, is_head BOOLEAN

``line_no`` orders lines inside the head of each file and ``is_head`` marks the
rows that belong to the file's first split. Format sniffing (first 100 lines)
and the per-file Zeek layout only look at head rows, so no whole-file ordering
is ever needed and no task has to see a whole file. Where real line numbers are
wanted, ``number_lines`` gives them from the line counts of the splits; where only the
heads are wanted, ``read_heads`` reads a bounded number of bytes of each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loggraph.session import materialize

LINE_SCHEMA = T.StructType([
    T.StructField("raw_line", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("is_head", T.BooleanType()),
])

# Fixed value: accepted upload suffixes.
LOG_GLOB = "*.{log,txt,csv}"
#: Lines of a chunk (within the 1,000 to 25,000 of an upload's chunks).
CHUNK_LINES = 10_000
#: Rows of the table of splits up to which it is broadcast.
BROADCAST_SPLITS = 200_000


def _valid_utf8(c):
    # Invalid byte sequences become U+FFFD, as a decoding with replacement would.
    return F.make_valid_utf8(c) if hasattr(F, "make_valid_utf8") else F.expr(f"make_valid_utf8({c})")


def _text(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path)


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = LOG_GLOB) -> DataFrame:
    """Read log files as lines (S1, S2, S6), all of them.

    ``path`` may be a file, a folder (read recursively) or a list of them. ``line_no`` only
    orders the lines of one split; see ``number_lines``.
    """
    return _text(spark, path, glob).select(
        _valid_utf8("value").alias("raw_line"),
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("line_no"),
        (F.col("_metadata.file_block_start") == 0).alias("is_head"),
    )


def split_counts(spark: SparkSession, path: str | list[str], glob: str | None = LOG_GLOB) -> DataFrame:
    """One row per split that holds lines: file, start (its first byte), first_id, lines,
    lines_before (in the same file), total_lines (of the file); written once.

    The lines of a split stand in order in one task, so their ids follow each other. The
    windows hold one row per split."""
    ids = _text(spark, path, glob).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                          F.monotonically_increasing_id().alias("id"))
    per = ids.groupBy("file", "start").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("lines"))
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(per.select("*", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"),
                                  F.sum("lines").over(of_file).alias("total_lines")), "split_counts")


def number_lines(spark: SparkSession, path: str | list[str], glob: str | None = LOG_GLOB, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``read_lines`` with real line numbers (from 0, in each file), and for each line its
    chunk (S3, S5): ``chunk_index``, ``total_chunks`` and ``total_lines`` of its file.

    A first pass counts the lines of each split, prefix sums over a file's splits give the
    number of each split's first line, and the second pass adds the place in the split.
    Files are not sorted and no task sees a whole file. Both passes must split the files
    alike, as one session with unchanged settings does; if they do not, it is an error."""
    counts = split_counts(spark, path, glob)
    if counts.count() <= BROADCAST_SPLITS:
        counts = F.broadcast(counts)
    lines = _text(spark, path, glob).select(
        _valid_utf8("value").alias("raw_line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    place = F.col("id") - F.col("first_id")
    known = F.when((place >= 0) & (place < F.col("lines")), F.col("lines_before") + place)
    line_no = F.coalesce(known, F.raise_error(F.lit("the files are split in another way than when their lines were counted")).cast("bigint"))
    return lines.join(counts, ["file", "start"], "left").select(
        "raw_line", "file", line_no.alias("line_no"), (F.col("start") == 0).alias("is_head"),
        F.floor(line_no / chunk_lines).alias("chunk_index"),
        F.greatest(F.lit(1), F.ceil(F.col("total_lines") / chunk_lines)).alias("total_chunks"), "total_lines")


def read_heads(spark: SparkSession, path: str | list[str], head_bytes: int, glob: str | None = LOG_GLOB) -> DataFrame:
    """The lines of the first ``head_bytes`` bytes of every file (D5), as a line table.

    The files are listed without their content and spread over the tasks; of each file only
    its head is read, so the cost follows the number of files, not their size. The last
    line may be cut, invalid bytes become U+FFFD. Paths are opened in the tasks by
    ``pyarrow.fs`` (local, HDFS, S3, GCS)."""
    files = file_sizes(spark, path, glob).where("length > 0").select("path").repartition("path")

    def read(batches):
        import re

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for uri in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(name) as f:
                    head = f.read(head_bytes)
                lines = re.split("\r\n|\r|\n", head.decode("utf-8", "replace"))
                if lines[-1] == "":
                    lines.pop()
                yield pa.RecordBatch.from_pydict({"raw_line": lines, "file": [uri] * len(lines), "line_no": range(len(lines)),
                                                  "is_head": [True] * len(lines)})

    return files.mapInArrow(read, LINE_SCHEMA)


def file_sizes(spark: SparkSession, path: str | list[str], glob: str | None = LOG_GLOB) -> DataFrame:
    """The files of a folder (``path``, ``length``); their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def lines_from_text(spark: SparkSession, text: str, file: str = "upload.log") -> DataFrame:
    """Line table from an in-memory upload (tests and small interactive use).

    Lines are split the way Spark's text source splits them (LF, CR, CRLF)."""
    import re

    parts = re.split(r"\r\n|\r|\n", text)
    if parts and parts[-1] == "":
        parts = parts[:-1]
    rows = [(p, file, i, True) for i, p in enumerate(parts)]
    return spark.createDataFrame(rows, LINE_SCHEMA)


def empty_lines(spark: SparkSession) -> DataFrame:
    """Zero-row line table with the fixed schema."""
    return spark.createDataFrame([], LINE_SCHEMA)


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                 glob: str | None = LOG_GLOB) -> DataFrame:
    """Streaming line source over a log folder.

    Each micro-batch takes up to ``max_files_per_trigger`` new files; run it with
    ``Trigger.AvailableNow`` for a bounded backlog with an exact end."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.load(path)
    # Streams carry no row ordinal (monotonically_increasing_id is batch-only);
    # the streaming parser needs none, since per-file head rules are batch-only.
    return raw.select(
        _valid_utf8("value").alias("raw_line"),
        F.col("_metadata.file_path").alias("file"),
        F.lit(None).cast("bigint").alias("line_no"),
        (F.col("_metadata.file_block_start") == 0).alias("is_head"),
    )
