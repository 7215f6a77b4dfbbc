"""Render the driver's tables into raw log lines.

The test tables hold no log files, so the ``events`` table (and ``pages`` for
absolute URLs) is turned into syslog SSH, access-log, Squid and Zeek lines. The
same SQL text runs in Spark and in DuckDB, so the engine and the SQL oracle read
identical lines. Every event row becomes a line: the work grows with the tables.

Output columns: ``raw_line, file, line_no, is_head`` (the line-table schema).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dialect-specific snippets: whole epoch seconds of the naive UTC ``ts`` column.
_EPOCH = {
    "spark": "unix_seconds(cast(ts as timestamp))",
    "duckdb": "cast(floor(epoch(ts)) as bigint)",
}

# Shared field derivations (one row per event).
_BASE = """
b as (
select event_id, user_id, ts, {epoch} as epoch_s,
 substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast((month(ts)-1)*3+1 as int), 3) as mon,
 lpad(cast(day(ts) as string),2,' ') as dd, lpad(cast(day(ts) as string),2,'0') as dd0,
 lpad(cast(hour(ts) as string),2,'0') || ':' || lpad(cast(minute(ts) as string),2,'0') || ':' || lpad(cast(second(ts) as string),2,'0') as hms,
 case when user_id % 10 = 1 then '10.0.9.9'
      when user_id % 3 = 0 then '198.51.' || cast(user_id % 7 as string) || '.' || cast(user_id % 200 as string)
      else '10.0.' || cast(user_id % 5 as string) || '.' || cast(user_id % 200 as string) end as ip,
 case when user_id % 10 = 1 then 'backup01'
      when event_id % 17 = 0 then 'jumpbox'
      else '10.1.' || cast(user_id % 4 as string) || '.' || cast(user_id % 25 as string) end as host,
 case when user_id % 10 = 1 then 'backup'
      when user_id % 5 = 0 and event_id % 3 = 0 then 'root'
      when user_id % 5 = 0 then 'guest' || cast(event_id % 3 as string)
      else 'svc' || cast(user_id % 40 as string) end as usr,
 case when user_id % 10 = 1 then 'A'
      when user_id % 5 = 0 and event_type = 'error' then 'F'
      when user_id % 5 = 0 and event_type = 'signup' then 'I'
      else 'A' end as kind,
 case when user_id % 5 = 0 and event_id % 4 = 0 then 'POST'
      when user_id % 5 = 0 and event_id % 9 = 0 then 'DELETE' else 'GET' end as verb,
 case when user_id % 5 = 0 and event_id % 6 = 1 then 404
      when user_id % 5 = 0 and event_id % 11 = 1 then 503 else 200 end as st,
 case event_id % 8
      when 0 then '/api/v1/users/' || cast(event_id as string) || '/profile?page=' || cast(user_id as string)
      when 1 then '/static/app.js?v=3'
      when 2 then '/item/550e8400-e29b-41d4-a716-4466554' || lpad(cast(user_id % 1000 as string),5,'0') || '/7'
      when 3 then '/admin/config#top'
      when 4 then '/42/17/x'
      when 5 then case when user_id % 5 = 0 then '/' else '/docs/page' || cast(user_id % 20 as string) end
      when 6 then '/shop/cart/' || cast(event_id % 13 as string)
      else '/img/logo.PNG' end as uri,
 event_type
from {events})"""

# Syslog sshd lines (auth.log) and combined access-log lines (access.log).
_MIXED = """
select mon || ' ' || dd || ' ' || hms || ' ' || host || ' sshd[' || cast(1000 + event_id % 9000 as string) || ']: '
  || case kind when 'A' then 'Accepted publickey for ' || usr when 'F' then 'Failed password for ' || case when usr = 'root' then usr else 'invalid user ' || usr end else 'Invalid user ' || usr end
  || ' from ' || ip || case when kind = 'I' then '' else ' port ' || cast(20000 + event_id % 40000 as string) || ' ssh2' end as raw_line,
  'auth.log' as file, event_id as line_no, true as is_head
from b where event_type in ('error','signup','purchase')
union all
select ip || ' - - [' || dd0 || '/' || mon || '/2024:' || hms || ' +0000] "' || verb || ' ' || uri || ' HTTP/1.1" ' || cast(st as string) || ' ' || cast(100 + event_id % 5000 as string) as raw_line,
  'access.log' as file, event_id as line_no, true as is_head
from b where event_type in ('click','view')"""

# Squid native access-log lines, one per event, absolute URLs from ``pages``.
_SQUID = """
select cast(epoch_s as string) || '.' || lpad(cast(event_id % 1000 as string),3,'0') || ' '
  || lpad(cast(10 + event_id % 990 as string),6,' ') || ' ' || ip || ' '
  || case when st >= 400 then 'TCP_DENIED' when event_id % 3 = 0 then 'TCP_HIT' else 'TCP_MISS' end
  || '/' || cast(st as string) || ' ' || cast(100 + event_id % 5000 as string) || ' ' || verb || ' ' || p.url
  || ' - DIRECT/93.184.216.' || cast(user_id % 250 as string) || ' text/html' as raw_line,
  'squid.log' as file, event_id as line_no, true as is_head
from (select *, event_id % (select count(*) from {pages}) as page_key from b) bb
join {pages} p on p.page_id = bb.page_key"""

# Zeek ssh.log and http.log (tab separated, with a #fields header each).
_ZEEK = """
select '#fields' || chr(9) || 'ts' || chr(9) || 'uid' || chr(9) || 'id.orig_h' || chr(9) || 'id.orig_p'
  || chr(9) || 'id.resp_h' || chr(9) || 'id.resp_p' || chr(9) || 'auth_success' as raw_line,
  'zeek_ssh.log' as file, cast(-1 as bigint) as line_no, true as is_head
union all
select cast(epoch_s as string) || '.' || lpad(cast(event_id % 1000 as string),3,'0') || chr(9) || 'C' || cast(event_id as string)
  || chr(9) || ip || chr(9) || cast(20000 + event_id % 40000 as string) || chr(9) || host || chr(9) || '22' || chr(9)
  || case kind when 'A' then 'success' else 'failure' end as raw_line,
  'zeek_ssh.log' as file, event_id as line_no, true as is_head
from b where event_type in ('error','signup','purchase')
union all
select '#fields' || chr(9) || 'ts' || chr(9) || 'uid' || chr(9) || 'id.orig_h' || chr(9) || 'id.orig_p' || chr(9) || 'id.resp_h'
  || chr(9) || 'id.resp_p' || chr(9) || 'trans_depth' || chr(9) || 'method' || chr(9) || 'host' || chr(9) || 'uri'
  || chr(9) || 'referrer' || chr(9) || 'version' || chr(9) || 'user_agent' || chr(9) || 'request_body_len'
  || chr(9) || 'status_code' as raw_line,
  'zeek_http.log' as file, cast(-1 as bigint) as line_no, true as is_head
union all
select cast(epoch_s as string) || '.' || lpad(cast(event_id % 1000 as string),3,'0') || chr(9) || 'C' || cast(event_id as string)
  || chr(9) || ip || chr(9) || cast(20000 + event_id % 40000 as string) || chr(9) || '10.2.0.' || cast(user_id % 50 as string)
  || chr(9) || '80' || chr(9) || '1' || chr(9) || verb || chr(9) || 'www.example.com' || chr(9) || uri || chr(9) || '-'
  || chr(9) || '1.1' || chr(9) || 'Mozilla/5.0' || chr(9) || '0'
  || case when event_id % 50 = 7 then '' else chr(9) || cast(st as string) end as raw_line,
  'zeek_http.log' as file, event_id as line_no, true as is_head
from b where event_type in ('click','view')"""

# Files that a per-file or per-line shortcut gets wrong: access lines that mention TCP_, a
# log with a blank head, tab-separated rows too short for Zeek, lines that both HTTP parsers
# accept, a tab-separated access log, and Zeek HTTP rows without a verb.
_ODD = """
select ip || ' - - [' || dd0 || '/' || mon || '/2024:' || hms || ' +0000] "GET /docs/TCP_tuning/' || cast(event_id % 9 as string)
  || ' HTTP/1.1" 200 ' || cast(100 + event_id % 5000 as string) as raw_line,
  'tcp_access.log' as file, event_id as line_no, true as is_head
from b where event_id % 7 = 1
union all
select '' as raw_line, 'blank_head.log' as file, event_id - 1000000 as line_no, true as is_head
from b where event_id < 600
union all
select mon || ' ' || dd || ' ' || hms || ' ' || host || ' sshd[' || cast(1000 + event_id % 9000 as string)
  || ']: Accepted password for ' || usr || ' from ' || ip || ' port 22 ssh2' as raw_line,
  'blank_head.log' as file, event_id as line_no, true as is_head
from b where event_id % 11 = 3
union all
select cast(epoch_s as string) || '.0' || chr(9) || 'C' || cast(event_id as string) || chr(9) || ip || chr(9) || '22' as raw_line,
  'short_tsv.log' as file, event_id as line_no, true as is_head
from b where event_id % 13 = 5
union all
select cast(epoch_s as string) || '.000     20 ' || ip || ' TCP_MISS/' || cast(st as string) || ' 100 GET http://a.example' || uri
  || ' - - [' || dd0 || '/' || mon || '/2024:' || hms || ' +0000] "GET ' || uri || ' HTTP/1.1" 200 55' as raw_line,
  'both.log' as file, event_id as line_no, true as is_head
from b where event_id % 17 = 2
union all
select ip || chr(9) || '-' || chr(9) || usr || chr(9) || '[' || dd0 || '/' || mon || '/2024:' || hms || ' +0000]' || chr(9)
  || '"' || verb || ' ' || uri || ' HTTP/1.1"' || chr(9) || cast(st as string) || chr(9) || cast(100 + event_id % 5000 as string) as raw_line,
  'tab_access.log' as file, event_id as line_no, true as is_head
from b where event_id % 19 = 4
union all
select cast(epoch_s as string) || '.5' || chr(9) || 'C' || cast(event_id as string) || chr(9) || ip || chr(9) || '4000' || chr(9)
  || '10.2.0.' || cast(user_id % 50 as string) || chr(9) || '80' || chr(9) || '1' || chr(9)
  || case when event_id >= 200 and event_id % 3 = 0 then '-' else 'GET' end || chr(9) || 'www.example.com' || chr(9) || uri
  || chr(9) || '-' || chr(9) || '1.1' || chr(9) || 'Mozilla/5.0' || chr(9) || '0' || chr(9) || cast(st as string) as raw_line,
  'dash_http.log' as file, event_id as line_no, true as is_head
from b where event_id % 29 = 7"""

KINDS = {"mixed": [_MIXED], "squid": [_SQUID], "zeek": [_ZEEK], "all": [_MIXED, _SQUID, _ZEEK],
         "files": [_MIXED, _SQUID, _ZEEK, _ODD]}


def render_sql(kind: str = "mixed", dialect: str = "duckdb") -> str:
    """SQL text producing the line table for one rendering ``kind``.

    For DuckDB the tables are referenced by name; for Spark the ``{events}`` /
    ``{pages}`` placeholders are bound to DataFrames by ``spark.sql``."""
    parts = KINDS[kind]
    body = "\nunion all\n".join(f"select * from ({p})" for p in parts)
    sql = "with " + _BASE.replace("{epoch}", _EPOCH[dialect]) + "\n" + body
    if dialect == "duckdb":
        sql = sql.replace("{events}", "events").replace("{pages}", "pages")
    return sql


def write_log_files(lines: DataFrame, path: str, parts: int = 4) -> DataFrame:
    """Write a line table as text files, ``parts`` per rendered file (a line goes to part
    ``line_no % parts``, in line order), and read them back as a user's log folder;
    ``file`` is the rendered file's name and part."""
    from loggraph.sources.lines import read_lines

    key = F.concat_ws("-", "file", F.pmod("line_no", F.lit(parts)))
    (lines.withColumn("key", key).repartition("key").sortWithinPartitions("key", "line_no")
     .select("raw_line", "key").write.partitionBy("key").text(path))
    return read_lines(lines.sparkSession, path).withColumn("file", F.regexp_extract("file", "/key=([^/]+)/", 1))


def render_lines(spark: SparkSession, sf_dir: str, kind: str = "mixed") -> DataFrame:
    """Line table rendered from ``{sf_dir}/events.parquet`` (and ``pages``)."""
    # The given table is one row group, one split: its narrow rows are spread so that
    # rendering and parsing use every core.
    events = spark.read.parquet(f"{sf_dir}/events.parquet").repartition("event_id")
    kwargs = {"events": events}
    if kind in ("squid", "all", "files"):
        kwargs["pages"] = spark.read.parquet(f"{sf_dir}/pages.parquet")
    df = spark.sql(render_sql(kind, "spark"), **kwargs)
    return df.selectExpr("raw_line", "file", "cast(line_no as bigint) as line_no", "is_head")
