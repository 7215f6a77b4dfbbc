"""DuckDB SQL restatement of every registered query (the correctness oracle).

The SQL restates the rules apart from the Spark code path; it shares with it the
rendering SQL, the URI and address patterns and the thresholds. A chain of CTEs renders the log lines from ``events`` / ``pages``, parses them
with regular expressions, aggregates and scores edges, builds the signal/noise
graph and the cluster overview. Each query is the shared CTE prefix plus one
final SELECT. Arrays are reported as comma-joined text, integers as BIGINT and
fractions as DOUBLE, exactly as :func:`loggraph.plans.queries.report` does on
the Spark side.
"""

from __future__ import annotations

from loggraph import constants as K
from loggraph.functions.net import PRIVATE_PREFIXES
from loggraph.functions.uri import FIRST_TWO_SEGMENTS, STATIC_PATTERN, UUID_SEGMENT
from loggraph.sources.render import render_sql


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def private(x: str) -> str:
    return "(" + " or ".join(f"starts_with({x}, {q(p)})" for p in PRIVATE_PREFIXES) + ")"


def subnet24(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, '^(\\d+\\.\\d+\\.\\d+)\\.\\d+$', 1), ''), {x}) || '.0/24'"


def grp(pattern: str, i: int) -> str:
    return f"nullif(regexp_extract(raw_line, {q(pattern)}, {i}), '')"


def uri_prefix_sql(u: str) -> str:
    s = f"regexp_replace({u}, '\\?.*$', '')"
    s = f"regexp_replace({s}, '#.*$', '')"
    s = f"regexp_replace({s}, {q(UUID_SEGMENT)}, '/*', 'g')"
    s = f"regexp_replace({s}, '/\\d+', '/*', 'g')"
    s = f"regexp_replace({s}, '(/\\*)+', '/*', 'g')"
    return f"coalesce(nullif(regexp_extract({s}, {q(FIRST_TWO_SEGMENTS)}, 1), ''), {u})"


def is_static_sql(u: str) -> str:
    return f"regexp_matches({u}, {q(STATIC_PATTERN)})"


_NULLS_SSH = "cast(null as integer) as status_code, cast(null as integer) as bytes_sent"
_NULLS_HTTP = "cast(null as varchar) as \"user\", cast(null as varchar) as auth_method, cast(null as varchar) as dest_host"


def _ssh_family(name, pattern, guard, ts, src, host, user, method):
    return f"""select {q(name)} as family, {grp(pattern, ts)} as timestamp, {grp(pattern, src)} as source_ip,
  'SSH' as protocol, {q('SUCCESS' if name == 'ssh_accepted' else 'FAILURE')} as action, {grp(pattern, host)} as target,
  {grp(pattern, user)} as "user", {method} as auth_method, {grp(pattern, host)} as dest_host, {_NULLS_SSH},
  file, line_no from lines where regexp_matches(raw_line, {q(guard)}){{cond_{name}}}"""


def _http_family(name, pattern, guard_sql, ts, src, verb, uri, st, by):
    return f"""select {q(name)} as family, {grp(pattern, ts)} as timestamp, {grp(pattern, src)} as source_ip,
  'HTTP' as protocol, {grp(pattern, verb)} as action, {grp(pattern, uri)} as target, {_NULLS_HTTP},
  try_cast({grp(pattern, st)} as integer) as status_code, try_cast({grp(pattern, by)} as integer) as bytes_sent,
  file, line_no from lines where {guard_sql}{{cond_{name}}}"""


# The line patterns and rules once more, written from the format descriptions (in
# DuckDB's dialect), not taken from the parser.
_STAMP = "([A-Z][a-z]{2}\\s+\\d+\\s+\\d{2}:\\d{2}:\\d{2})"
_SSHD = _STAMP + "\\s+(\\S+)\\s+sshd\\[\\d+\\]:\\s+"
SSH_ACCEPTED = _SSHD + "Accepted\\s+(\\S+)\\s+for\\s+(\\S+)\\s+from\\s+(\\S+)\\s+port\\s+(\\d+)"
SSH_FAILED = _SSHD + "Failed\\s+(\\S+)\\s+for\\s+(?:invalid user\\s+)?(\\S+)\\s+from\\s+(\\S+)\\s+port\\s+(\\d+)"
SSH_INVALID = _SSHD + "Invalid user\\s+(\\S+)\\s+from\\s+(\\S+)"
NCSA = "(\\S+)\\s+\\S+\\s+\\S+\\s+\\[([^\\]]+)\\]\\s+\"([A-Z]+)\\s+(\\S+)\\s+HTTP/[0-9.]+\"\\s+(\\d+)\\s+(\\d+)"
SQUID = "^\\s*(\\d+\\.\\d+)\\s+\\d+\\s+(\\S+)\\s+\\S+/(\\d+)\\s+(\\d+)\\s+([A-Z]+)\\s+(\\S+)"
GUARD_ACCEPTED, GUARD_FAILED, GUARD_INVALID = [
    "sshd\\[\\d+\\]:\\s+" + w for w in ("Accepted", "Failed", "Invalid user")]
GUARD_NCSA = "\"[A-Z]+\\s+\\S+\\s+HTTP/"
FAMILY_NAMES = ["ssh_accepted", "ssh_failed", "ssh_invalid", "ncsa", "squid", "zeek_http", "zeek_ssh"]


def _family_sql() -> dict[str, str]:
    f = "string_split(raw_line, chr(9))"
    return {
        "ssh_accepted": _ssh_family("ssh_accepted", SSH_ACCEPTED, GUARD_ACCEPTED, 1, 5, 2, 4, grp(SSH_ACCEPTED, 3)),
        "ssh_failed": _ssh_family("ssh_failed", SSH_FAILED, GUARD_FAILED, 1, 5, 2, 4, grp(SSH_FAILED, 3)),
        "ssh_invalid": _ssh_family("ssh_invalid", SSH_INVALID, GUARD_INVALID, 1, 4, 2, 3, "'password'"),
        "squid": _http_family("squid", SQUID, "contains(raw_line, 'TCP_')", 1, 2, 5, 6, 3, 4),
        "ncsa": _http_family("ncsa", NCSA, f"regexp_matches(raw_line, {q(GUARD_NCSA)})", 2, 1, 3, 4, 5, 6),
        "zeek_http": f"""select 'zeek_http' as family, {f}[1] as timestamp, {f}[3] as source_ip, 'HTTP' as protocol,
  {f}[8] as action, {f}[10] as target, {_NULLS_HTTP}, try_cast({f}[15] as integer) as status_code,
  100 as bytes_sent, file, line_no from lines where not starts_with(raw_line, '#'){{cond_zeek_http}}""",
        "zeek_ssh": f"""select 'zeek_ssh' as family, {f}[1] as timestamp, {f}[3] as source_ip, 'SSH' as protocol,
  case when contains({f}[7], 'success') then 'SUCCESS' else 'FAILURE' end as action, {f}[5] as target,
  'root' as "user", 'password' as auth_method, cast(null as varchar) as dest_host, {_NULLS_SSH},
  file, line_no from lines where not starts_with(raw_line, '#'){{cond_zeek_ssh}}""",
    }


_FIELDS = "string_split(raw_line, chr(9))"
_DATED = ("regexp_matches(raw_line, '^([0-9]{9,}([.][0-9]+)?|[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})?)' "
          "|| chr(9))")
_ACCESS = f"regexp_matches(raw_line, {q(NCSA)})"
_ZEEK = f"({_DATED} and len({_FIELDS}) >= 6 and not {_ACCESS})"
_ZEEK_HTTP = (f"coalesce(zeek_is_http, len({_FIELDS}) >= 10 and coalesce(regexp_matches({_FIELDS}[8], '^[A-Z]{{3,}}$') "
              f"or ({_FIELDS}[8] = '-' and starts_with({_FIELDS}[10], '/')), false))")
#: Per file the layout of its Zeek rows: by its header, else by its first data row.
_LAYOUTS = f"""
shown as (select file, not starts_with(raw_line, '#fields') as no_header, line_no,
   case when starts_with(raw_line, '#fields') then list_contains({_FIELDS}, 'method') and list_contains({_FIELDS}, 'uri')
        else len({_FIELDS}) >= 10 and regexp_matches(raw_line, 'GET|HEAD|POST') end as http
 from rendered where starts_with(raw_line, '#fields' || chr(9)) or ({_DATED} and len({_FIELDS}) >= 6)),
layouts as (select distinct on (file) file, http as zeek_is_http from shown order by file, no_header, line_no),
lines as (select r.*, zeek_is_http from rendered r left join layouts using (file)),"""
_SQUID = f"(contains(raw_line, 'TCP_') and regexp_matches(raw_line, {q(SQUID)}))"
#: What each line is taken for when only its Zeek layout is known of its file.
LINE_RULES = {
    "ssh_accepted": f" and not {_ZEEK}", "ssh_failed": f" and not {_ZEEK}", "ssh_invalid": f" and not {_ZEEK}",
    "squid": f" and {_SQUID} and not {_ZEEK}", "ncsa": f" and not {_SQUID} and not {_ZEEK}",
    "zeek_http": f" and {_ZEEK} and {_ZEEK_HTTP}", "zeek_ssh": f" and {_ZEEK} and not {_ZEEK_HTTP}",
}
_LAYOUT = "coalesce(zf, 0) >= 10 and coalesce(zv, false)"
#: One parser per file, by the file's format (and, for Zeek, its first data row).
FILE_RULES = {
    **{n: " and fk = 'SYSLOG_SSH'" for n in FAMILY_NAMES[:3]}, **{n: " and fk = 'NCSA_SQUID_HTTP'" for n in ("ncsa", "squid")},
    "zeek_http": f" and fk = 'ZEEK_TSV' and {_LAYOUT}", "zeek_ssh": f" and fk = 'ZEEK_TSV' and not ({_LAYOUT}) and coalesce(zf, 0) >= 6",
}


def _events(fams: list[str], rules: dict[str, str], where: str | None = None) -> str:
    fsql = _family_sql()
    ev0 = "\nunion all\n".join(fsql[f].replace("{cond_" + f + "}", rules[f]) for f in fams)
    return f"""
ev0 as ({ev0}),
ev as (select * from ev0 where source_ip is not null and not (starts_with(family, 'zeek') and source_ip = '-')
   and ({where or 'true'}))"""


def events_cte(kind: str = "mixed", families: list[str] | None = None, where: str | None = None) -> str:
    """CTEs ``lines`` and ``ev`` (parsed, non-null source) for one rendering. The mixed
    rendering holds no tab and no Squid line, so four families say all about it."""
    if families is None:
        return f"lines as ({render_sql(kind, 'duckdb')})," + _events(FAMILY_NAMES[:4], dict.fromkeys(FAMILY_NAMES, ""), where)
    return f"rendered as ({render_sql(kind, 'duckdb')})," + _LAYOUTS + _events(families, LINE_RULES, where)


PRIV_LIST = "[" + ", ".join(q(u) for u in K.PRIVILEGED_USERS) + "]"
WRITE_LIST = "(" + ", ".join(q(v) for v in K.WRITE_VERBS) + ")"
EXT, WEB, INT = q(K.SUPER_EXTERNAL_NOISE), q(K.SUPER_WEB_SURFACE), q(K.SUPER_INTERNAL_BASELINE)

EDGE_COLS = ("id, source, target, edge_type, weight, total_attempts, http_verb, status_code, uri_path, "
             "successful_auths, failed_auths, distinct_users, anomaly_flags, is_anomalous, first_timestamp, last_timestamp")

# Edges, scoring and graph on top of ``ev``.
GRAPH = f"""
sshv as (select source_ip as src_ip, target as dest_host, action as auth_result, "user", auth_method, timestamp
   from ev where protocol = 'SSH'),
httpv as (select source_ip as src_ip, target as uri, action as verb, status_code, bytes_sent, timestamp
   from ev where protocol = 'HTTP'),
ssh_cnt as (select src_ip, dest_host, count(*) as total_attempts,
   count(*) filter (where auth_result = 'SUCCESS') as successful_auths,
   count(*) filter (where auth_result = 'FAILURE') as failed_auths,
   list_sort(list_distinct(list("user"))) as users_list,
   min(timestamp) as first_timestamp, max(timestamp) as last_timestamp
   from sshv group by src_ip, dest_host),
ssh_f as (select *, failed_auths / cast(total_attempts as double) as fail_ratio,
   cast(len(users_list) as bigint) as n_users from ssh_cnt),
ssh_g as (select *, (total_attempts > {K.BRUTE_FORCE_MIN_ATTEMPTS} and fail_ratio >= {K.BRUTE_FORCE_FAIL_RATIO}) as is_brute_force,
   coalesce(list_has_any(users_list, {PRIV_LIST}), false) as has_priv_user,
   n_users >= {K.MULTI_USER_PIVOT_THRESHOLD} as is_multi_pivot,
   (total_attempts >= {K.HIGH_FREQ_COLLAPSED_THRESHOLD} and failed_auths = 0 and n_users = 1) as is_collapsed from ssh_f),
ssh_r as (select *, cast(round(1.0 + cast(is_brute_force as int) * 3.5 + cast(has_priv_user as int) * 2.5
   + cast(is_multi_pivot as int) * 2.0 - cast(is_collapsed as int) * 2.0, 2) as double) as risk_score,
   ((is_brute_force or has_priv_user or is_multi_pivot) and not (is_collapsed and not has_priv_user)) as is_anomalous
   from ssh_g),
ssh_sc as (select * from ssh_r where not (is_collapsed and not is_anomalous)),
http_prep as (select *, {uri_prefix_sql('uri')} as uri_prefix from httpv where not {is_static_sql('uri')}),
http_mode as (select src_ip, uri_prefix, verb, status_code from (
   select src_ip, uri_prefix, verb, status_code,
     row_number() over (partition by src_ip, uri_prefix, verb order by count(*) desc, status_code asc) as rn
   from http_prep where status_code is not null group by src_ip, uri_prefix, verb, status_code) where rn = 1),
http_agg as (select src_ip, uri_prefix, verb, count(*) as total_attempts,
   count(*) filter (where status_code >= 400 and status_code < 500) as count_4xx,
   count(*) filter (where status_code >= 500) as count_5xx,
   min(timestamp) as first_timestamp, max(timestamp) as last_timestamp
   from http_prep group by src_ip, uri_prefix, verb),
http_cnt as (select a.src_ip, a.uri_prefix, a.verb, a.total_attempts, m.status_code, a.count_4xx, a.count_5xx,
   a.first_timestamp, a.last_timestamp
   from http_agg a left join http_mode m on m.src_ip = a.src_ip and m.uri_prefix = a.uri_prefix and m.verb = a.verb),
http_f as (select *, count_4xx > 0 as has_4xx, count_5xx > 0 as has_5xx, verb = 'POST' as is_post,
   verb in {WRITE_LIST} as is_write from http_cnt
   where not (verb = 'GET' and count_4xx = 0 and count_5xx = 0 and total_attempts >= {K.HTTP_COLLAPSE_REPEATED_MIN})),
http_sc as (select *, cast(round(1.0 + cast(is_post as int) * 2.5 + cast(is_write as int) * 1.5
   + cast(has_4xx as int) * 1.5 + cast(has_5xx as int) * 2.0, 2) as double) as risk_score,
   (is_post or is_write or has_4xx or has_5xx) as is_anomalous from http_f),
http_rows as (select 'edge:' || src_ip || '->' || uri_prefix || ':' || verb as id, 'host:' || src_ip as source,
   'url:' || uri_prefix as target, 'HTTP_REQUEST' as edge_type, risk_score as weight, total_attempts,
   verb as http_verb, status_code, uri_prefix as uri_path, cast(0 as bigint) as successful_auths,
   cast(0 as bigint) as failed_auths, '' as distinct_users,
   concat_ws(',', case when is_post then 'WEB_EXPLOIT_POST' end, case when has_4xx then 'HTTP_4XX_SCAN' end) as anomaly_flags,
   is_anomalous, first_timestamp, last_timestamp from http_sc),
src_risk as (select src_ip, max(risk_score) as http_src_risk from http_sc group by src_ip),
ssh_c as (select s.*, coalesce(r.http_src_risk, 0.0) > {K.CHAIN_SOURCE_RISK} as is_chain
   from ssh_sc s left join src_risk r on r.src_ip = s.src_ip),
ssh_rows as (select 'edge:' || src_ip || '->' || dest_host as id, 'host:' || src_ip as source,
   'host:' || dest_host as target, 'SSH_AUTH' as edge_type,
   case when is_chain then cast(round(risk_score + 3.0, 2) as double) else risk_score end as weight,
   total_attempts, cast(null as varchar) as http_verb, cast(null as integer) as status_code,
   cast(null as varchar) as uri_path, successful_auths, failed_auths, array_to_string(users_list, ',') as distinct_users,
   concat_ws(',', case when is_brute_force then 'BRUTE_FORCE_BURST' end, case when has_priv_user then 'PRIVILEGE_PIVOT' end,
     case when has_priv_user then 'SSH_PRIVILEGE_PIVOT' end, case when is_multi_pivot then 'RARE_PIVOT_PATH' end,
     case when is_chain then 'FULL_ATTACK_CHAIN' end) as anomaly_flags,
   is_anomalous, first_timestamp, last_timestamp from ssh_c),
erows as (select * from http_rows union all select * from ssh_rows),
contrib as (select source as id, weight as risk, is_anomalous as anom from erows
   union all select target, case when edge_type = 'SSH_AUTH' then weight * {K.DEST_RISK_FACTOR} else weight end, is_anomalous from erows),
nagg as (select id, max(risk) as risk, bool_or(anom) as touch from contrib group by id),
nlay as (select *, case when starts_with(id, 'url:') then 'web'
   when {private("regexp_replace(id, '^(host|url):', '')")} then 'internal' else 'external' end as layer,
   (risk >= {K.SIGNAL_RISK_THRESHOLD} or touch) as is_signal from nagg),
nmap as (select *, case when is_signal then null when layer = 'external' then {EXT}
   when layer = 'web' then {WEB} else {INT} end as super_id from nlay),
noise as (select id, super_id from nmap where super_id is not null),
e2 as (select e.*, s.super_id as s_super, t.super_id as t_super from erows e
   left join noise s on s.id = e.source left join noise t on t.id = e.target),
passed as (select {EDGE_COLS} from e2 where s_super is null and t_super is null),
moved as (select coalesce(s_super, source) as ns, coalesce(t_super, target) as nt, total_attempts, weight
   from e2 where s_super is not null or t_super is not null),
merged as (select 'edge:' || ns || '->' || nt as id, ns as source, nt as target,
   case when starts_with(nt, 'url:') or nt = {WEB} then 'HTTP_REQUEST' else 'SSH_AUTH' end as edge_type,
   case when ns in ({EXT}, {INT}) or nt in ({EXT}, {INT}) then {K.SUPER_NOISE_RISK} else max(weight) end as weight,
   cast(sum(total_attempts) as bigint) as total_attempts, cast(null as varchar) as http_verb,
   cast(null as integer) as status_code, cast(null as varchar) as uri_path, cast(0 as bigint) as successful_auths,
   cast(0 as bigint) as failed_auths, '' as distinct_users, '' as anomaly_flags, false as is_anomalous,
   cast(null as varchar) as first_timestamp, cast(null as varchar) as last_timestamp
   from moved where ns <> nt and nt <> {EXT} group by ns, nt),
fedges as (select * from passed union all select * from merged),
deg as (select id, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree from (
   select source as id, 1 as o, 0 as i from fedges union all select target as id, 0 as o, 1 as i from fedges)
   group by id),
sig as (select id, regexp_replace(id, '^(host|url):', '') as label,
   case when starts_with(id, 'url:') then 'URL' else 'HOST' end as node_type,
   cast(round(risk, 2) as double) as risk_score, layer, true as is_signal, false as is_noise_super from nmap where is_signal),
sup as (select super_id as id,
   case super_id when {EXT} then 'Background Traffic (' || count(*) || ' IPs)'
     when {WEB} then 'Web Surface (' || count(*) || ' URLs)' else 'Internal Baseline (' || count(*) || ' hosts)' end as label,
   'SUPER_NODE' as node_type, cast({K.SUPER_NOISE_RISK} as double) as risk_score,
   case super_id when {EXT} then 'external' when {WEB} then 'web' else 'internal' end as layer,
   false as is_signal, true as is_noise_super from nmap where not is_signal group by super_id),
nrows as (select n.id, n.label, n.node_type, coalesce(d.in_degree, 0) as in_degree,
   coalesce(d.out_degree, 0) as out_degree, n.risk_score, n.layer, n.is_signal, n.is_noise_super
   from (select * from sig union all select * from sup) n left join deg d on d.id = n.id),
gsummary as (select cast((select count(*) from nrows) as bigint) as total_nodes,
   cast((select count(*) from fedges) as bigint) as total_edges,
   cast((select count(*) from fedges where is_anomalous) as bigint) as anomalous_edges_count,
   cast((select count(*) from nrows where risk_score >= {K.SIGNAL_RISK_THRESHOLD}) as bigint) as high_risk_nodes_count)"""


def with_graph(kind: str = "mixed", families: list[str] | None = None, extra: str = "",
               where: str | None = None) -> str:
    ctes = events_cte(kind, families, where) + "," + GRAPH
    if extra:
        ctes += "," + extra
    return "with " + ctes + "\n"


EDGE_OUT = ("id, source, target, edge_type, cast(weight as double) as weight, cast(total_attempts as bigint) as total_attempts, "
            "http_verb, cast(status_code as bigint) as status_code, uri_path, cast(successful_auths as bigint) as successful_auths, "
            "cast(failed_auths as bigint) as failed_auths, distinct_users, anomaly_flags, is_anomalous, first_timestamp, last_timestamp")
# Graph edges carry no user arrays: users are a long table (g2_edge_users).
EDGE_PLAIN = EDGE_OUT.replace("distinct_users", "'' as distinct_users")
NODE_OUT = ("id, label, node_type, cast(in_degree as bigint) as in_degree, cast(out_degree as bigint) as out_degree, "
            "cast(risk_score as double) as risk_score, layer, is_signal, is_noise_super")


EV_OUT = ("family, timestamp, source_ip, protocol, action, target, \"user\", auth_method, dest_host, "
          "cast(status_code as bigint) as status_code, cast(bytes_sent as bigint) as bytes_sent, file, "
          "cast(line_no as bigint) as line_no")
SSH_CNT_OUT = ("src_ip, dest_host, cast(total_attempts as bigint) as total_attempts, "
               "cast(successful_auths as bigint) as successful_auths, cast(failed_auths as bigint) as failed_auths, "
               "array_to_string(users_list, ',') as distinct_users, first_timestamp, last_timestamp")
SSH_SC_OUT = SSH_CNT_OUT + (", fail_ratio, n_users, is_brute_force, has_priv_user, is_multi_pivot, is_collapsed, "
                            "risk_score, is_anomalous")
HTTP_CNT_OUT = ("src_ip, uri_prefix, verb, cast(total_attempts as bigint) as total_attempts, "
                "cast(status_code as bigint) as status_code, cast(count_4xx as bigint) as count_4xx, "
                "cast(count_5xx as bigint) as count_5xx, first_timestamp, last_timestamp")
HTTP_SC_OUT = HTTP_CNT_OUT + ", has_4xx, has_5xx, is_post, is_write, risk_score, is_anomalous"

ALL_FAMILIES = FAMILY_NAMES

DETECT = f"""
samp as (select * from (select *, row_number() over (partition by file order by line_no) as rn
   from lines where is_head) where rn <= {K.SNIFF_SAMPLE_LINES} and regexp_matches(raw_line, '\\S')),
sc as (select file, count(*) as n_sample,
   count(*) filter (where regexp_matches(raw_line, 'sshd\\[\\d+\\]|pam_unix|Accepted|Failed|Invalid user')) as ssh_hits,
   count(*) filter (where regexp_matches(raw_line, 'HTTP/1\\.[01]|HTTP/2|TCP_(MISS|HIT|DENIED|REFRESH_HIT)')
                       or regexp_matches(raw_line, 'GET\\s+\\S+|POST\\s+\\S+')) as http_hits,
   bool_or(starts_with(raw_line, '#fields') or starts_with(raw_line, '#types')) as zeek_header,
   count(*) filter (where contains(raw_line, chr(9)) and len(string_split(raw_line, chr(9))) >= 6) as tab_rows
   from samp group by file),
sc2 as (select file, cast(n_sample as bigint) as n_sample,
   least(1.0, ssh_hits / cast(greatest(n_sample, 1) as double)) as ssh_score,
   least(1.0, http_hits / cast(greatest(n_sample, 1) as double)) as http_score,
   least(1.0, case when zeek_header then 0.9 else 0.0 end
     + case when tab_rows > 0 then least(0.8, tab_rows / cast(greatest(n_sample, 1) as double)) else 0.0 end) as zeek_score
   from sc),
detected as (select *, case when greatest(ssh_score, http_score, zeek_score) <= 0 then 'SYSLOG_SSH'
   when ssh_score = greatest(ssh_score, http_score, zeek_score) then 'SYSLOG_SSH'
   when http_score = greatest(ssh_score, http_score, zeek_score) then 'NCSA_SQUID_HTTP' else 'ZEEK_TSV' end as format_key,
   case when greatest(ssh_score, http_score, zeek_score) <= 0 then 0.0 else greatest(ssh_score, http_score, zeek_score) end as score
   from sc2)"""

ADDR = """addr as (select distinct ip from (select source_ip as ip from ev union all
   select target as ip from ev where protocol = 'SSH'))"""

CHUNK_LINES = 1000


def _mixed(final: str, extra: str = "") -> str:
    return with_graph("mixed", None, extra) + final


def _all(final: str, extra: str = "") -> str:
    return with_graph("all", ALL_FAMILIES, extra) + final


ORACLE: dict[str, str] = {
    "s10_protocol_counts": _mixed("""select cast((select count(*) from lines) as bigint) as total_lines,
   cast((select count(*) from ev where protocol = 'SSH') as bigint) as valid_ssh_events,
   cast((select count(*) from ev where protocol = 'HTTP') as bigint) as valid_http_events"""),
    "d_format_scores": "with lines as (" + render_sql("all", "duckdb") + ")," + DETECT
    + "\nselect file, n_sample, ssh_score, http_score, zeek_score, format_key, score from detected",
    "p1_ssh_accepted": _mixed(f"select {EV_OUT} from ev where family = 'ssh_accepted'"),
    "p2_ssh_failed": _mixed(f"select {EV_OUT} from ev where family = 'ssh_failed'"),
    "p3_ssh_invalid": _mixed(f"select {EV_OUT} from ev where family = 'ssh_invalid'"),
    "p4_ncsa": _mixed(f"select {EV_OUT} from ev where family = 'ncsa'"),
    "p5_squid": _all(f"select {EV_OUT} from ev where family = 'squid'"),
    "p6_zeek_http": with_graph("files", ALL_FAMILIES) + f"select {EV_OUT} from ev where family = 'zeek_http'",
    "p7_zeek_ssh": with_graph("files", ALL_FAMILIES) + f"select {EV_OUT} from ev where family = 'zeek_ssh'",
    "p11_mixed_family_counts": with_graph("files", ALL_FAMILIES) + ("select file, family, protocol, count(*) as n from ev group by file, family, protocol"),
    "p9_unified_events": _mixed("""select timestamp, source_ip, protocol, action, target,
   case when protocol = 'SSH' then to_json({'user': "user", 'auth_method': auth_method, 'dest_host': dest_host})::varchar
        else to_json({'status_code': status_code, 'bytes_sent': bytes_sent})::varchar end as metadata from ev"""),
    "f1_static_filter": _all(f"""select uri, {is_static_sql('uri')} as is_static
   from (select distinct target as uri from ev where protocol = 'HTTP')"""),
    "f2_uri_collapse": _all(f"""select uri, {uri_prefix_sql('uri')} as uri_prefix
   from (select distinct target as uri from ev where protocol = 'HTTP')"""),
    "f3_private_ip": _all(f"select ip, {private('ip')} as is_private from addr", ADDR),
    "f4_subnet24": _all(f"select ip, {subnet24('ip')} as subnet from addr", ADDR),
    "a1_ssh_edges": _mixed(f"select {SSH_CNT_OUT}, n_users, has_priv_user from ssh_g"),
    "a9_ssh_scored": _mixed(f"select {SSH_SC_OUT} from ssh_sc"),
    "a10_http_edges": _mixed(f"select {HTTP_CNT_OUT} from http_cnt"),
    "a14_http_scored": _mixed(f"select {HTTP_SC_OUT} from http_sc"),
    "a15_merge_http": _mixed(f"select {HTTP_SC_OUT} from http_sc"),
    "a16_merge_ssh": _mixed(f"select {SSH_SC_OUT} from ssh_sc"),
    "g3_attack_chain": _mixed("select id, source, target, weight, anomaly_flags, is_anomalous from ssh_rows"),
    "g13_edge_ends": _mixed("""select count(*) as ends, count(*) filter (where id not in (select id from nrows)) as dangling
   from (select source as id from fedges union all select target from fedges)"""),
    "g4_node_risk": _mixed("select id, risk, touch, layer, is_signal, super_id from nmap"),
    "g7_signal_split": _mixed("select layer, is_signal, count(*) as n from nmap group by layer, is_signal"),
    "g8_external_collapse": _mixed(f"select {EDGE_PLAIN} from fedges where source = {EXT} or target = {EXT}"),
    "g9_web_collapse": _mixed(f"select {EDGE_PLAIN} from fedges where source = {WEB} or target = {WEB}"),
    "g10_internal_collapse": _mixed(f"select {EDGE_PLAIN} from fedges where source = {INT} or target = {INT}"),
    "g11_degrees": _mixed("select id, in_degree, out_degree from deg"),
    "g2_edge_users": _mixed("""select distinct 'edge:' || source_ip || '->' || target as id, "user" from ev
   where protocol = 'SSH' and "user" is not null"""),
    "g14_merged_chunks": """select id, min(source) as source, min(target) as target, min(edge_type) as edge_type, max(weight) as weight,
   cast(sum(total_attempts) as bigint) as total_attempts, min(http_verb) as http_verb, min(status_code) as status_code,
   min(uri_path) as uri_path, cast(sum(successful_auths) as bigint) as successful_auths, cast(sum(failed_auths) as bigint) as failed_auths,
   '' as distinct_users, concat_ws(',', """ + ", ".join(
        f"case when bool_or(list_contains(string_split(anomaly_flags, ','), '{f}')) then '{f}' end" for f in (
            "WEB_EXPLOIT_POST", "HTTP_4XX_SCAN", "BRUTE_FORCE_BURST", "PRIVILEGE_PIVOT", "SSH_PRIVILEGE_PIVOT",
            "RARE_PIVOT_PATH", "FULL_ATTACK_CHAIN")) + """) as anomaly_flags,
   bool_or(is_anomalous) as is_anomalous, min(first_timestamp) as first_timestamp, max(last_timestamp) as last_timestamp
   from (""" + " union all ".join(
        f"(select * from ({with_graph('mixed', None, where=f'line_no % 2 = {h}')} select {EDGE_OUT} from erows))" for h in (0, 1))
    + ") group by id",
    "g12_nodes": _mixed(f"select {NODE_OUT} from nrows"),
    "g14_edges": _mixed(f"select {EDGE_PLAIN} from fedges"),
    "a17_summary": _mixed("""select total_nodes, total_edges, anomalous_edges_count, high_risk_nodes_count,
   anomalous_edges_count as detected_lateral_chains,
   case when total_edges > 0 then round(anomalous_edges_count / total_edges, 3) else 0.0 end as noise_reduction_ratio
   from gsummary"""),
}


# ---------------------------------------------------------------------------
# cluster overview
# ---------------------------------------------------------------------------

OVERVIEW = f"""
cf as (select case when not {private('source_ip')} then 'super:external_threats'
     else 'super:subnet:' || {subnet24('source_ip')} end as src_cluster,
   case when protocol = 'HTTP' then 'super:web_urls'
     when {private('target')} then 'super:subnet:' || {subnet24('target')} else 'super:external_threats' end as tgt_cluster,
   protocol, source_ip, target from ev),
src_m as (select distinct src_cluster as cluster_id, 'host:' || source_ip as node_id from cf),
web_m as (select distinct 'super:web_urls' as cluster_id, 'url:' || target as node_id from cf where protocol = 'HTTP'),
tgt_m as (select distinct tgt_cluster as cluster_id, 'host:' || target as node_id from cf
   where protocol = 'SSH' and tgt_cluster <> 'super:web_urls'
     and tgt_cluster not in (select cluster_id from src_m)),
cmembers as (select * from src_m union select * from web_m union select * from tgt_m),
ccount as (select cluster_id, count(*) as child_count from cmembers group by cluster_id),
snodes as (select cluster_id as id,
   case when cluster_id = 'super:external_threats' then 'External Threats (' || child_count || ' IPs)'
        when starts_with(cluster_id, 'super:subnet:') then 'Subnet ' || replace(cluster_id, 'super:subnet:', '') || ' (' || child_count || ' hosts)'
        when cluster_id = 'super:web_urls' then 'Web Endpoints (' || child_count || ')'
        else 'Cluster (' || child_count || ')' end as label,
   'SUPER_NODE' as node_type, cast(child_count as bigint) as child_count,
   case when cluster_id = 'super:external_threats' then 'external_ip' when starts_with(cluster_id, 'super:subnet:') then 'internal_subnet_24'
        when cluster_id = 'super:web_urls' then 'url_collapse' else 'unknown' end as cluster_rule,
   cast(case when cluster_id = 'super:external_threats' then 7.0 when starts_with(cluster_id, 'super:subnet:') then 2.0
        when cluster_id = 'super:web_urls' then 3.0 else 1.0 end as double) as risk_score
   from ccount),
pairs as (select src_cluster, tgt_cluster, count(*) as total_attempts, count(distinct source_ip) as src_unique_ips,
   count(distinct target) as tgt_unique_entities, count(*) filter (where protocol = 'SSH') as ssh_n,
   count(*) filter (where protocol = 'HTTP') as http_n
   from cf group by src_cluster, tgt_cluster having src_cluster <> tgt_cluster),
sedges as (select 'super_edge:' || src_cluster || '->' || tgt_cluster as id, src_cluster as source, tgt_cluster as target,
   case when ssh_n > http_n then 'SSH_AUTH' else 'HTTP_REQUEST' end as edge_type,
   cast(least(10.0, cast(total_attempts as double) / 50.0) as double) as weight, cast(total_attempts as bigint) as total_attempts,
   cast(src_unique_ips as bigint) as src_unique_ips, cast(tgt_unique_entities as bigint) as tgt_unique_entities,
   case when ssh_n > http_n then 'SSH' else 'HTTP' end as dominant_protocol,
   (total_attempts > 10 or ssh_n > http_n) as is_anomalous
   from pairs where src_cluster in (select id from snodes) and tgt_cluster in (select id from snodes))"""

TOPK = """
touchids as (select source as id from fedges where is_anomalous union select target as id from fedges where is_anomalous),
ranked as (select n.*, (t.id is not null) as touch from nrows n left join touchids t on t.id = n.id),
kept as (select * from ranked order by touch desc, risk_score desc, id asc limit {k}),
kept_edges as (select * from fedges where source in (select id from kept) and target in (select id from kept))"""


def expand_where(super_id: str) -> str:
    if super_id in (K.SUPER_EXTERNAL_THREATS, K.SUPER_EXTERNAL_NOISE):
        return f"not {private('source_ip')}"
    if super_id.startswith(K.SUPER_SUBNET_PREFIX):
        prefix = super_id.replace(K.SUPER_SUBNET_PREFIX, "").replace(".0/24", ".")
        return f"(starts_with(source_ip, {q(prefix)}) or coalesce(starts_with(target, {q(prefix)}), false))"
    if super_id in (K.SUPER_WEB_URLS, K.SUPER_WEB_SURFACE):
        return "protocol = 'HTTP'"
    if super_id == K.SUPER_INTERNAL_BASELINE:
        return private("source_ip")
    return "false"


def _expand_sql(super_id: str, final: str, k: int = K.EXPAND_MAX_NODES) -> str:
    return with_graph("mixed", None, TOPK.format(k=k), where=expand_where(super_id)) + final


# ---------------------------------------------------------------------------
# time
# ---------------------------------------------------------------------------

def event_ts_sql(c: str = "timestamp", log_year: int = 2024) -> str:
    return f"""(case when regexp_matches({c}, '^[A-Z][a-z]{{2}}\\s')
     then try_strptime('{log_year} ' || regexp_replace({c}, '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S')
   when regexp_matches({c}, '^\\d{{2}}/[A-Z][a-z]{{2}}/')
     then try_strptime({c}, '%d/%b/%Y:%H:%M:%S %z') at time zone 'UTC'
   when regexp_matches({c}, '^\\d+(\\.\\d+)?$') then to_timestamp(cast({c} as double)) at time zone 'UTC' end)"""


FMT = "'%Y-%m-%d %H:%M:%S'"
TSV = f"tsv as (select *, {event_ts_sql()} as t from ev)"

FLAGS = "string_split(anomaly_flags, ',')"


def dominant_sql() -> str:
    parts = " ".join(f"when list_contains({FLAGS}, {q(f)}) then {q(f)}" for f in K.FLAG_SEVERITY)
    return f"(case {parts} end)"


SCAN_IN = "(" + ", ".join(q(f) for f in K.SCAN_FLAGS) + ")"
TIER = ("case when is_noise_super then 'noise' when risk_score >= 5.0 then 'critical' "
        "when risk_score >= 3.0 then 'suspicious' else 'noise' end")

ORACLE.update({
    "c3_super_edges": _mixed("select * from sedges", OVERVIEW),
    "c4_super_nodes": _mixed("select * from snodes", OVERVIEW),
    "c6_cluster_members": _mixed("select cluster_id, node_id from cmembers", OVERVIEW),
    "a18_cluster_summary": _mixed("""select cast((select count(*) from snodes) as bigint) as total_nodes,
   cast((select count(*) from sedges) as bigint) as total_edges,
   cast((select count(*) from sedges where is_anomalous) as bigint) as anomalous_edges_count,
   cast((select count(*) from snodes where risk_score >= 5.0) as bigint) as high_risk_nodes_count,
   cast((select count(*) from sedges where is_anomalous) as bigint) as detected_lateral_chains""", OVERVIEW),
    "e1_expand_external": _expand_sql(K.SUPER_EXTERNAL_THREATS, f"select {NODE_OUT} from kept"),
    "e2_expand_subnet": _expand_sql("super:subnet:10.0.1.0/24", f"select {NODE_OUT} from kept"),
    "e3_expand_web": _expand_sql(K.SUPER_WEB_SURFACE, f"select {NODE_OUT} from kept"),
    "e4_expand_internal": _expand_sql(K.SUPER_INTERNAL_BASELINE, f"select {NODE_OUT} from kept"),
    "k1_top75_edges": _expand_sql(K.SUPER_INTERNAL_BASELINE, f"select {EDGE_OUT} from kept_edges"),
    "k1_cut_nodes": _expand_sql(K.SUPER_INTERNAL_BASELINE, f"""select {NODE_OUT},
   cast((select count(*) from kept) as bigint) as kept_nodes, cast((select count(*) from nrows) as bigint) as total_nodes from kept""", 25),
    "k1_cut_edges": _expand_sql(K.SUPER_INTERNAL_BASELINE, f"select {EDGE_OUT} from kept_edges", 25),
    "k2_top60": _mixed(f"select {NODE_OUT} from kept", TOPK.format(k=K.CLIENT_MAX_NODES)),
    "f9_f11_edge_classes": _mixed(f"""select id,
   round(least(4.0, (case when is_anomalous then 1.2 else 0.3 end)
     + 0.75 * log10(greatest(1.0, cast(total_attempts as double)))), 6) as prominence,
   {dominant_sql()} as dominant_flag,
   case when not is_anomalous then 'noise' when {dominant_sql()} in {SCAN_IN} then 'scan' else 'attack' end as edge_class
   from fedges"""),
    "f11_attack_only": _mixed(f"""select id, source, target, 'attack' as edge_class from fedges
   where is_anomalous and not coalesce({dominant_sql()} in {SCAN_IN}, false)"""),
    "f12_f13_node_classes": _mixed(f"""select id,
   case when risk_score >= 3.0 then 'red' when risk_score >= 1.5 then 'amber' else 'green' end as risk_band,
   {TIER} as risk_tier from nrows"""),
    "k3_layer_rank": _mixed(f"""select id, layer, {TIER} as risk_tier,
   cast(row_number() over (partition by layer, {TIER} order by risk_score desc, id asc) as bigint) as rank_in_tier
   from nrows"""),
    "k4_parallel_ordinal": _mixed("""select id,
   cast(row_number() over (partition by source, target order by id) - 1 as bigint) as parallel_index,
   cast(count(*) over (partition by source, target) as bigint) as parallel_count from erows"""),
    "j6_ego": _mixed(f"""select {EDGE_OUT} from fedges
   where source = (select id from nrows order by risk_score desc, id asc limit 1)
      or target = (select id from nrows order by risk_score desc, id asc limit 1)"""),
    "j7_neighbours": _mixed(f"""select distinct other as id from (
   select source as node, target as other from erows union all select target as node, source as other from erows)
   where node in (select id from nmap where super_id = {INT})
     and other not in (select id from nmap where super_id = {INT})"""),
    "a20_node_type_counts": _mixed("select node_type, count(*) as n from nrows group by node_type"),
    "x1_web_ssh_300s": _mixed(f"""select s.src_ip, s.dest_host, strftime(s.t, {FMT}) as ssh_time,
   strftime(h.http_time, {FMT}) as http_time, cast(epoch(s.t) - epoch(h.http_time) as bigint) as delta_s
   from (select source_ip as src_ip, target as dest_host, t from tsv where protocol = 'SSH' and t is not null) s
   asof join (select source_ip as src_ip, t as http_time from tsv where protocol = 'HTTP' and t is not null) h
     on s.src_ip = h.src_ip and h.http_time <= s.t
   where epoch(s.t) - epoch(h.http_time) <= 300""", TSV),
    "x2_timeline": _mixed(f"""select strftime(date_trunc('hour', t), {FMT}) as bucket_start, count(*) as event_count,
   count(*) filter (where action = 'FAILURE') as failed_count from tsv where t is not null
   group by date_trunc('hour', t)""", TSV),
    "x3_event_time": _all(f"""select distinct timestamp, protocol, strftime(t, {FMT}) as event_ts from tsv""", TSV),
    "x4_off_hours": _mixed("""select source_ip as src_ip, target as dest_host, count(*) as total_attempts,
   count(*) filter (where hour(t) >= 22 or hour(t) < 6) as off_hours_events,
   count(*) filter (where hour(t) >= 22 or hour(t) < 6) > 0 as off_hours_access
   from tsv where protocol = 'SSH' group by source_ip, target""", TSV),
    "x5_scanners": _mixed(f"""select src_ip, count(distinct case when status_code >= 400 and status_code < 500 then uri_prefix end)
     as distinct_4xx_paths,
   count(distinct case when status_code >= 400 and status_code < 500 then uri_prefix end) >= {K.HTTP_SCAN_MIN_DISTINCT_PATHS} as is_scanner
   from http_prep group by src_ip"""),
    "x6_benign_ssh": _mixed("""select src_ip, count(*) as total_attempts, count(*) filter (where auth_result = 'FAILURE') as failed_auths,
   count(distinct "user") as n_users,
   (count(*) >= 100 and count(*) filter (where auth_result = 'FAILURE') = 0 and count(distinct "user") = 1) as is_benign
   from sshv group by src_ip"""),
    "x7_url_clusters": _mixed("""select 'super:url:' || segment as id, segment, count(*) as child_count, max(risk) as aggregated_risk
   from (select *, regexp_extract(replace(id, 'url:', ''), '^(/[^/]*)', 1) as segment from nmap
         where starts_with(id, 'url:') and risk < 5.0) where segment <> ''
   group by segment having count(*) >= 2"""),
    "x8_exempt_nodes": _mixed("""select coalesce(h.id, c.id) as id, coalesce(h.crown_jewel, false) as crown_jewel,
   coalesce(c.chain_member, false) as chain_member
   from (select id, risk >= 7.0 as crown_jewel from nmap where starts_with(id, 'host:')) h
   full outer join (select distinct id, true as chain_member from (
       select source as id from erows where list_contains(string_split(anomaly_flags, ','), 'FULL_ATTACK_CHAIN')
         or list_contains(string_split(anomaly_flags, ','), 'SSH_PRIVILEGE_PIVOT')
       union all select target as id from erows where list_contains(string_split(anomaly_flags, ','), 'FULL_ATTACK_CHAIN')
         or list_contains(string_split(anomaly_flags, ','), 'SSH_PRIVILEGE_PIVOT'))) c on c.id = h.id
   where coalesce(h.crown_jewel, false) or coalesce(c.chain_member, false)"""),
    "x9_super_aggregates": _mixed("""select m.super_id as id, m.child_count, m.aggregated_risk,
   cast(coalesce(p.aggregated_edge_count, 0) as bigint) as aggregated_edge_count
   from (select super_id, count(*) as child_count, max(risk) as aggregated_risk from nmap
         where super_id is not null group by super_id) m
   left join (select sid as super_id, count(*) as aggregated_edge_count from (
       select distinct e.id, x.sid from e2 e, (select unnest([e.s_super, e.t_super]) as sid) x where x.sid is not null)
       group by sid) p on p.super_id = m.super_id"""),
    "x10_summary_extras": _mixed("""select cast((select count(*) from nmap) as bigint) as total_raw_nodes_before_clustering,
   cast((select count(*) from nrows) as bigint) as total_nodes,
   cast((select count(*) from nrows where is_noise_super) as bigint) as super_node_count,
   cast((select count(*) from nrows where not is_noise_super) as bigint) as individual_node_count,
   case when (select count(*) from nmap) > 0 then round(1 - (select count(*) from nrows) / (select count(*) from nmap), 3)
     else 0.0 end as clustering_ratio"""),
    "x12_event_id": "with lines as (" + render_sql("mixed", "duckdb") + """)
select file, line_no, sha256(file || chr(1) || raw_line) as event_id from lines""",
    "x4_off_hours_flags": _mixed("""select r.id, concat_ws(',', nullif(r.anomaly_flags, ''), 'OFF_HOURS_ACCESS') as anomaly_flags, r.weight
   from ssh_rows r where r.id in (select 'edge:' || source_ip || '->' || target from tsv
     where protocol = 'SSH' and (hour(t) >= 22 or hour(t) < 6))""", TSV),
    "x13_url_events": _mixed(f"""select {EV_OUT} from ev where protocol = 'HTTP' and not {is_static_sql('target')}
   and {uri_prefix_sql('target')} = '/api/v1' order by file, line_no limit 50"""),
    "x13_cluster_events": _mixed(f"""select {EV_OUT} from ev where not {private('source_ip')}
   and (file > 'access.log' or (file = 'access.log' and line_no > 500)) order by file, line_no limit 50"""),
    "x13_node_events": _mixed(f"""select {EV_OUT} from ev where source_ip = '10.0.9.9' or (protocol = 'SSH' and target = '10.0.9.9')
   order by file, line_no limit 50"""),
})

def _totals(batches: int) -> str:
    """The graph's totals over the events of the first batches, one graph per batch."""
    return "\nunion all\n".join(
        "select * from (" + with_graph("mixed", None, where=f"line_no % {batches} <= {b}") + f"""select cast({b} as bigint) as batch_id,
   anomalous_edges_count, high_risk_nodes_count, anomalous_edges_count as detected_lateral_chains, total_nodes, total_edges
   from gsummary)""" for b in range(batches))


ORACLE.update({
    "s9_session_scan": _mixed("""select cast(count(*) filter (where protocol = 'SSH') as bigint) as valid_ssh_events,
   cast(count(*) filter (where protocol = 'HTTP') as bigint) as valid_http_events from ev"""),
    "s9_restored_session": _mixed("""select cast(n_ssh as bigint) as valid_ssh_events, cast(n_http as bigint) as valid_http_events, session
   from (select count(*) filter (where protocol = 'SSH') as a, count(*) filter (where protocol = 'HTTP') as b from ev) c,
   lateral (values ('7', a, 0), ('007', a, b), ('none', 0, 0)) as t(session, n_ssh, n_http)"""),
    "t1_stream_all_formats": with_graph("files", ALL_FAMILIES)
    + "select family, protocol, count(*) as n from ev group by family, protocol",
    "t2_stream_overview": ORACLE["c4_super_nodes"],
    "t2_stream_expand": ORACLE["e4_expand_internal"],
    "k5_running_totals": _totals(4),
    "k5_totals_of_fifty": _totals(50),
    "t4_state_summary": ORACLE["a17_summary"],
    "t4_edge_state": _mixed("""select 'SSH' as protocol, src_ip, dest_host as k2, '' as k3, total_attempts, successful_auths, failed_auths,
   n_users, has_priv_user, cast(null as bigint) as status_code, cast(0 as bigint) as count_4xx, cast(0 as bigint) as count_5xx,
   first_timestamp, last_timestamp from ssh_g
   union all select 'HTTP', src_ip, uri_prefix, verb, total_attempts, 0, 0, 0, false, status_code, count_4xx, count_5xx,
   first_timestamp, last_timestamp from http_cnt"""),
    "t5_chunks": _mixed("""select cast(b as bigint) as chunk_index, lines, cast(so_far as bigint) as processed_lines,
   cast(case when done >= total then so_far else ceil(total * so_far / done) end as bigint) as total_lines,
   round(cast(done as double) / total * 100, 1) as progress
   from (select *, sum(lines) over (order by b) as so_far, sum(bytes) over (order by b) as done, sum(bytes) over () as total
     from (select line_no % 4 as b, count(*) as lines, sum(strlen(raw_line) + 1) as bytes from lines group by 1))"""),
    "t2_stream_summary": ORACLE["a17_summary"],
})

BOUNDED = OVERVIEW + """,
m16 as (select distinct case when starts_with(cluster_id, 'super:subnet:')
     then 'super:subnet16:' || regexp_extract(cluster_id, '^super:subnet:(\\d+\\.\\d+)\\.', 1) || '.0.0/16'
     else cluster_id end as cluster_id, node_id from cmembers),
mint as (select distinct case when starts_with(cluster_id, 'super:subnet:') then 'super:internal'
     else cluster_id end as cluster_id, node_id from cmembers),
levels as (select 'subnet24' as cluster_level, id, child_count from snodes
   union all select 'subnet16', cluster_id, count(*) from m16 group by cluster_id
   union all select 'internal', cluster_id, count(*) from mint group by cluster_id),
chosen as (select case when (select count(*) from snodes) <= 50 then 'subnet24'
   when (select count(distinct cluster_id) from m16) <= 50 then 'subnet16' else 'internal' end as cluster_level)"""



def _coarse(level: str, cluster: str) -> str:
    """The overview CTEs with the /24 clusters replaced, as super-edges of one level."""
    low = lambda c: f"case when starts_with({c}, 'super:subnet:') then {cluster.format(c=c)} else {c} end as {c}"
    text = OVERVIEW.replace("cf as (", "cf24 as (", 1).replace(
        "src_m as (", f"cf as (select {low('src_cluster')}, {low('tgt_cluster')}, protocol, source_ip, target from cf24),\nsrc_m as (", 1)
    return f"select * from ({_mixed(f'select *, {q(level)} as level from sedges', text)})"


ORACLE.update({
    "x11_coarse_edges": _coarse("subnet16 True True", "'super:subnet16:' || regexp_extract({c}, '^super:subnet:(\\d+\\.\\d+)\\.', 1) || '.0.0/16'")
    + " union all " + _coarse("internal True True", "'super:internal'"),
    "x11_bounded_overview": _mixed("""select id, cast(child_count as bigint) as child_count, cluster_level from levels
   where cluster_level = (select cluster_level from chosen)""", BOUNDED),
    "s11_expand_payload": ORACLE["e4_expand_internal"],
    "e5_expand_unknown": _expand_sql(K.SUPER_EXTERNAL_THREATS, f"select {NODE_OUT}, {q(K.SUPER_EXTERNAL_THREATS)} as cluster_id from kept"),
})

ROUTED = (f"with rendered as ({render_sql('files', 'duckdb')})," + """
lines as (select raw_line, file || '-' || cast(((line_no % 4) + 4) % 4 as varchar) as file, line_no, is_head from rendered),"""
          + DETECT + """,
first_data as (select file, len(string_split(raw_line, chr(9))) as zf,
   contains(raw_line, 'GET') or contains(raw_line, 'HEAD') or contains(raw_line, 'POST') as zv
   from (select *, row_number() over (partition by file order by line_no) as rn from lines where not starts_with(raw_line, '#'))
   where rn = 1),
lr as (select l.*, coalesce(d.format_key, 'SYSLOG_SSH') as fk, z.zf, z.zv from lines l
   left join detected d on d.file = l.file left join first_data z on z.file = l.file),"""
          + _events(ALL_FAMILIES, FILE_RULES).replace("from lines where", "from lr where") + "\n")

ORACLE.update({
    "r1_routed_events": ROUTED + f"select {EV_OUT.rsplit(',', 1)[0]} from ev",
    "r2_routed_counts": ROUTED + """select coalesce(d.file, e.file) as file, d.format_key,
   cast(count(*) filter (where protocol = 'SSH') as bigint) as ssh_events,
   cast(count(*) filter (where protocol = 'HTTP') as bigint) as http_events
   from detected d full join ev e on e.file = d.file group by 1, 2""",
})


def _prefixes(bound: int, final: str) -> str:
    """The overview CTEs with the smallest /24 clusters merged into their /16, as few as the bound needs."""
    low = lambda c: (f"case when starts_with({c}, 'super:subnet:') and {c} not in (select c from sub, cut where rk <= r) "  # noqa: E731
                     f"then (select up from sub where sub.c = {c}) else {c} end as {c}")
    text = OVERVIEW.replace("cf as (", "cf24 as (", 1).replace("src_m as (", f"""s24 as (select distinct src_cluster as c, source_ip as m from cf24),
n24 as (select c, count(*) as n from (select * from s24 union all select distinct tgt_cluster, target from cf24
   where protocol = 'SSH' and tgt_cluster not in (select c from s24)) group by c),
sub as (select c, 'super:subnet16:' || regexp_extract(c, '^super:subnet:([^./]+\\.[^./]+)\\.', 1) || '.0.0/16' as up,
   row_number() over (order by n desc, c) as rk from n24 where starts_with(c, 'super:subnet:')),
cut as (select max(r) as r from (select r, r + (select count(distinct up) from sub where rk > r) as nodes from range(0, {bound + 1}) t(r))
   where nodes <= {bound} - (select count(*) from n24 where not starts_with(c, 'super:subnet:'))
     - (select cast(count(*) > 0 as integer) from cf24 where protocol = 'HTTP') and r <= (select count(*) from sub)),
cf as (select {low('src_cluster')}, {low('tgt_cluster')}, protocol, source_ip, target from cf24),
src_m as (""", 1)
    return _mixed(final, text)


def _heads(head_bytes: int) -> str:
    """Format scores from the first bytes of each written file (ASCII lines and a line feed each)."""
    return (f"with rendered as ({render_sql('files', 'duckdb')})," + f"""
written as (select raw_line, file || '-' || cast(((line_no % 4) + 4) % 4 as varchar) as file, line_no, true as is_head from rendered),
placed as (select *, sum(strlen(raw_line) + 1) over (partition by file order by line_no) - strlen(raw_line) - 1 as starts from written),
lines as (select left(raw_line, cast({head_bytes} - starts as bigint)) as raw_line, file, line_no, is_head from placed
   where starts < {head_bytes} and regexp_matches(left(raw_line, cast({head_bytes} - starts as bigint)), '\\S')),""" + DETECT
            + " select file, n_sample, ssh_score, http_score, zeek_score, format_key, score from detected")


ORACLE.update({
    "x11_prefix_nodes": _prefixes(8, "select id, child_count from snodes"),
    "x11_prefix_edges": _prefixes(8, "select * from sedges"),
    "d5_upload_heads": _heads(16 << 10), "d5_stream_heads": _heads(64 << 10), "d5_short_heads": _heads(700),
    "k2_capped_view": _expand_sql(K.SUPER_EXTERNAL_THREATS, f"""select {NODE_OUT}, cast((select count(*) from kept) as bigint) as shown_nodes,
   cast((select count(*) from nrows) as bigint) as total_nodes,
   cast((select count(*) from kept) < (select count(*) from nrows) as bigint) as capped from kept""", 5),
    "a21_session_record": _mixed("""select 'sess_a' as session_id, l.file as log_filename, l.n as total_lines_parsed,
   coalesce(e.ssh, 0) as valid_ssh_events, coalesce(e.http, 0) as valid_http_events
   from (select file, count(*) as n from lines group by file) l left join (select file, count(*) filter (where protocol = 'SSH') as ssh,
     count(*) filter (where protocol = 'HTTP') as http from ev group by file) e on e.file = l.file"""),
    "s5_numbered_chunks": f"with rendered as ({render_sql('mixed', 'duckdb')})," + f"""
lines as (select raw_line, file || '-' || cast(line_no % 4 as varchar) as file, line_no as n from rendered),
numbered as (select raw_line, file, row_number() over (partition by file order by n) - 1 as line_no, count(*) over (partition by file) as total
   from lines)
select file, cast(line_no as bigint) as line_no, raw_line, cast(line_no // {CHUNK_LINES} as bigint) as chunk_index,
   cast(ceil(total / {CHUNK_LINES}) as bigint) as total_chunks, cast(total as bigint) as total_lines from numbered""",
    "s8_ranged_host": _mixed("""select timestamp, source_ip, protocol, action, target, "user", auth_method, dest_host,
   cast(status_code as bigint) as status_code, cast(bytes_sent as bigint) as bytes_sent, line_no from ev where source_ip = '10.0.9.9'"""),
})
