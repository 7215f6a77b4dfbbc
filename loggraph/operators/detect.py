"""Per-file format detection.

One job classifies every file of a log folder: the first 100 lines of each file
(head rows only; blank lines dropped after the cut) are scored by three
detectors, and the best score wins, ties going to SSH, then HTTP, then Zeek. The
window ``row_number() <= 100`` per file is planned as a group limit, so at most
100 rows per file and map task are shuffled. The result has one row per file and
is joined back to the lines for routing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loggraph import constants as K
from loggraph.operators.parse import ZEEK_HTTP_FIELDS, ZEEK_ROW, ZEEK_SSH_FIELDS
from loggraph.session import materialize

# Detector patterns.
SSH_KEYWORDS = r"sshd\[\d+\]|pam_unix|Accepted|Failed|Invalid user"
HTTP_MARKERS = r"HTTP/1\.[01]|HTTP/2|TCP_(MISS|HIT|DENIED|REFRESH_HIT)"
HTTP_REQUEST = r"GET\s+\S+|POST\s+\S+"
ZEEK_HEADER_SCORE = 0.9
ZEEK_TAB_CAP = 0.8
ZEEK_MIN_FIELDS = 6
#: Bytes of a head: of an upload sniffed by itself, of a file that is streamed.
SNIFF_BYTES, STREAM_SNIFF_BYTES = 16 << 10, 64 << 10


def sample_lines(lines: DataFrame, n: int = K.SNIFF_SAMPLE_LINES) -> DataFrame:
    """First ``n`` head lines of each file, then blank lines removed; beside them
    ``first_data``, the shape of the first of these lines that is no comment."""
    w = Window.partitionBy("file").orderBy("line_no")
    head = lines.where("is_head").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    # n rows a file at most, already in one place
    first = F.min(F.when(~F.col("raw_line").startswith("#"), _shape())).over(Window.partitionBy("file"))
    return head.withColumn("first_data", first).where(F.col("raw_line").rlike(r"\S"))


def sample_heads(heads: DataFrame) -> DataFrame:
    """D5, the variants by bytes: of each file's head (``sources.lines.read_heads``) the
    lines that are not blank; ``detect_formats`` takes the first hundred of them."""
    return heads.where(F.col("raw_line").rlike(r"\S"))


def _shape() -> Column:
    """Place, field count and whether some field holds a verb."""
    raw = F.col("raw_line")
    verb = raw.contains("GET") | raw.contains("HEAD") | raw.contains("POST")
    return F.struct("line_no", F.size(F.split(raw, "\t")).alias("fields"), verb.alias("verb"))


def _n() -> Column:
    return F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")


def _share(hit: Column) -> Column:
    return F.least(F.lit(1.0), F.count_if(hit) / _n())


def _ssh_score() -> Column:
    return _share(F.col("raw_line").rlike(SSH_KEYWORDS))


def _http_score() -> Column:
    return _share(F.col("raw_line").rlike(HTTP_MARKERS) | F.col("raw_line").rlike(HTTP_REQUEST))


def _zeek_score() -> Column:
    raw = F.col("raw_line")
    header = F.bool_or(raw.startswith("#fields") | raw.startswith("#types"))
    rows = F.count_if(raw.contains("\t") & (F.size(F.split(raw, "\t")) >= ZEEK_MIN_FIELDS))
    return F.least(F.lit(1.0), F.when(header, F.lit(ZEEK_HEADER_SCORE)).otherwise(F.lit(0.0))
                   + F.when(rows > 0, F.least(F.lit(ZEEK_TAB_CAP), rows / _n())).otherwise(F.lit(0.0)))


#: Format key -> (score column name, score over a file's sample lines). The order decides ties.
FORMATS: dict[str, tuple[str, Callable[[], Column]]] = {
    K.FORMAT_SSH: ("ssh_score", _ssh_score),
    K.FORMAT_HTTP: ("http_score", _http_score),
    K.FORMAT_ZEEK: ("zeek_score", _zeek_score),
}


def register_format(format_key: str, score_name: str, score: Callable[[], Column]) -> None:
    """Add a format with its score: an aggregate over ``raw_line`` of a file's sample."""
    FORMATS[format_key] = (score_name, score)


def format_scores(lines: DataFrame) -> DataFrame:
    """D1-D3 per file: ``file, n_sample``, one score per format, and the shape of the
    first data row, from one pass over the samples."""
    return sample_lines(lines).groupBy("file").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_sample"), *[score().alias(name) for name, score in FORMATS.values()],
        F.any_value("first_data.fields").alias("zeek_fields"), F.any_value("first_data.verb").alias("zeek_verb"))


def choose_format(scores: DataFrame) -> DataFrame:
    """Best detector per file; on ties the first registered; none: SSH."""
    best = F.greatest(*[F.col(name) for name, _ in FORMATS.values()])
    key = F.when(best <= 0, F.lit(K.FORMAT_SSH))
    for format_key, (name, _) in FORMATS.items():
        key = key.when(F.col(name) == best, F.lit(format_key))
    return scores.withColumn("format_key", key).withColumn(
        "score", F.when(best <= 0, F.lit(0.0)).otherwise(best))


def zeek_layout(lines: DataFrame) -> DataFrame:
    """Per file the field count of its first data row and whether that row holds a
    verb; a combinable minimum, so no file is sorted."""
    return (lines.where(F.col("is_head") & ~F.col("raw_line").startswith("#")).groupBy("file").agg(F.min(_shape()).alias("first"))
            .select("file", F.col("first.fields").alias("zeek_fields"), F.col("first.verb").alias("zeek_verb")))


def zeek_layouts(lines: DataFrame) -> DataFrame:
    """P6/P7 for files of any mixture: per file that shows it, whether its Zeek rows are
    HTTP rows (``file, zeek_is_http``). The first ``#fields`` header says it by its field
    names; without one the first data row does, as in the routed path. Only head rows
    that hold a tab count, one combinable minimum a file. Written once (one row per file)."""
    raw = F.col("raw_line")
    header = raw.startswith("#fields\t")
    names = F.split(raw, "\t")
    from_header = F.array_contains(names, "method") & F.array_contains(names, "uri")
    from_row = (F.size(names) >= ZEEK_HTTP_FIELDS) & (raw.contains("GET") | raw.contains("HEAD") | raw.contains("POST"))
    shown = lines.where(F.col("is_head") & raw.contains("\t") & (header | (raw.rlike(ZEEK_ROW) & (F.size(names) >= ZEEK_SSH_FIELDS))))
    first = F.min(F.struct((~header).alias("row"), "line_no", F.when(header, from_header).otherwise(from_row).alias("http")))
    found = shown.groupBy("file").agg(first.alias("first"))
    return materialize(found.select("file", F.col("first.http").alias("zeek_is_http")), "zeek_layouts")


def detect_formats(lines: DataFrame, write: bool = True) -> DataFrame:
    """One row per file: ``file, n_sample``, the scores, ``format_key, score``, and the
    shape of the first data row ``zeek_fields, zeek_verb``.

    Written once for the routed parser, which then reads this small table and not the
    heads again; there the files whose whole sample is comments get their first data row
    from the rest of their head. ``write=False`` gives the lazy scores alone."""
    found = choose_format(format_scores(lines))
    if not write:
        return found
    found = materialize(found, "file_formats")
    unseen = found.where(F.col("zeek_fields").isNull()).select("file")
    if unseen.isEmpty():
        return found
    late = zeek_layout(lines.join(unseen, "file", "left_semi")).withColumnsRenamed({"zeek_fields": "f", "zeek_verb": "v"})
    found = found.join(late, "file", "left").select(
        *[c for c in found.columns if not c.startswith("zeek_")],
        F.coalesce("zeek_fields", "f").alias("zeek_fields"), F.coalesce("zeek_verb", "v").alias("zeek_verb"))
    return materialize(found, "file_formats")
