"""Registered queries of the event-log operators, and the same results as SQL for DuckDB."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import accounts as A
from ..functions import text as T
from ..operators import correlate as C
from ..operators import detectors as D
from ..operators import filters as L
from ..operators import findings as N
from ..operators import intel as I
from ..operators import merge as M
from ..operators import normalize as R
from ..operators import sigma as G
from ..operators import stats as S
from ..operators import timeline as TL
from ..operators.signature_catalog import CATALOGS, Signature
from ..sources import sinks as X
from ..schema import once
from ..storage import stored
from .adapter import LOG_EVENTS_SQL, log_events
from .analyze import finding_events, run_detectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BS = "\\"
HOUR = 3600 * 1_000_000
DAY = 24 * HOUR
SETTINGS = D.Settings(burst_threshold=4, spray_threshold=5, burst_window_us=3 * DAY, new_user_window_us=2 * HOUR)

PREFIX = (
    "WITH RECURSIVE log_events AS (" + LOG_EVENTS_SQL.replace("{events}", "events") + "), e AS (SELECT *, epoch_us(time_created_utc) AS us, "
    "lower(domain) || '\\' || lower(coalesce(target_user_name, user_name, '')) AS account, lower(trim(coalesce(source_ip, ''))) AS ip FROM log_events) "
)


def query(name: str, sql: str | None = None, bare: bool = False):
    """Registers a query of (spark, sf_dir), or with ``bare`` False one of (events)."""

    def add(f):
        QUERIES[name] = f if bare else lambda spark, sf_dir: f(log_events(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql if bare else PREFIX + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(f: DataFrame) -> DataFrame:
    return f.select("rule_id", "title", "severity", "event_row_id")


def grouped(f: DataFrame) -> DataFrame:
    return f.select("rule_id", "title", "severity", "event_row_id", "n_related", "group_key")


# Scalar functions and normalisation, over all rows of a driver table.

MIX = "CASE event_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN ' - ' WHEN 2 THEN '?' WHEN 3 THEN 'NULL' WHEN 4 THEN concat(' ', event_type, ' ') END"


def scalar(name: str, inputs: str, column: Callable[[], object], sql: str) -> None:
    """A function over text made from ``events``: Spark applies ``column`` to x, DuckDB ``sql``."""
    made = f"SELECT event_id, {inputs} AS x FROM {{events}}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = spark.sql(made.replace(BS, BS + BS), events=table(spark, sf_dir, "events"))
        return d.select("event_id", column().alias("y"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT event_id, {sql} AS y FROM ({made.replace('{events}', 'events')}) t"


scalar("fn1_clean_text", MIX, lambda: T.clean_text(F.col("x")), "CASE WHEN trim(x) NOT IN ('', '-', '?', 'null', 'NULL') THEN trim(x) END")
scalar("fn2_file_name", "CASE event_id % 3 WHEN 0 THEN concat('C:/a/', event_type) WHEN 1 THEN concat(event_type, '/') ELSE event_type END", lambda: T.file_name(F.col("x")), "nullif(split_part(x, '/', len(string_split(x, '/'))), '')")
scalar("fn3_sha256_hex", MIX, lambda: T.sha256_hex(F.col("x")), "CASE WHEN trim(coalesce(x, '')) = '' THEN '' ELSE upper(sha256(x)) END")
scalar("fn4_parse_utc", "CASE event_id % 4 WHEN 0 THEN '2024-03-01 10:11:12' WHEN 1 THEN '2024-03-01T10:11:12Z' WHEN 2 THEN '\"2024-03-01\"' ELSE event_type END", lambda: F.unix_seconds(T.parse_utc(F.col("x"))) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp")),
       "CAST(CASE event_id % 4 WHEN 0 THEN 5220672 WHEN 1 THEN 5220672 WHEN 2 THEN 5184000 END AS BIGINT)")
scalar("fn5_parse_event_ids", "concat('4624, x, ', CAST(event_id AS STRING), ',,')", lambda: F.array_join(T.parse_event_ids(F.col("x")).cast("array<string>"), ","), "concat('4624,', CAST(event_id AS VARCHAR))")
scalar("fn6_technique_id", "concat('attack.t', CAST(event_id AS STRING))", lambda: F.concat_ws("/", T.normalize_technique_id(F.col("x")), T.normalize_tactic(F.concat(F.lit("Attack.Lateral_Movement "), F.col("x")))), "concat('T', CAST(event_id AS VARCHAR), '/lateral-movement-attack.t', CAST(event_id AS VARCHAR))")
scalar("fn7_parse_hashes", "concat('MD5=', CAST(event_id AS STRING), ', sha256 = ab', CAST(user_id AS STRING), ',SHA256=cd,x')", lambda: F.concat_ws("/", F.element_at(T.parse_hashes(F.col("x")), "MD5"), F.element_at(T.parse_hashes(F.col("x")), "SHA256"), T.hash_value(F.col("x"), "SHA256")), "concat(CAST(event_id AS VARCHAR), '/cd/ab', CAST(user_id AS VARCHAR))".replace("user_id", "regexp_extract(x, 'ab([0-9]+)', 1)"))
scalar("fn8_sam_account_name", "concat(CASE WHEN event_id % 2 = 0 THEN concat('LAB', chr(92)) ELSE '' END, event_type, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END)", lambda: T.sam_account_name(F.col("x")), "trim(replace(x, 'LAB' || chr(92), ''))")
scalar("fn9_export_cell", "concat(' a', chr(9), event_type, chr(10), 'b ')", lambda: T.export_cell(F.col("x")), "trim(replace(replace(x, chr(9), ' '), chr(10), ' '))")
scalar("fn10_ids_json", "CASE WHEN event_id % 2 = 0 THEN concat('[1,', CAST(event_id AS STRING), ']') ELSE '[1,' END", lambda: T.ids_to_json(T.ids_from_json(F.col("x"))), "CASE WHEN event_id % 2 = 0 THEN x ELSE '[]' END")
scalar("nrm2_level_name", "CASE WHEN event_id % 9 = 8 THEN '' WHEN event_id % 9 = 7 THEN 'Custom' ELSE CAST(event_id % 9 AS STRING) END", lambda: R.level_name(F.col("x")), "CASE x WHEN '0' THEN 'LogAlways' WHEN '1' THEN 'Critical' WHEN '2' THEN 'Error' WHEN '3' THEN 'Warning' WHEN '4' THEN 'Information' WHEN '5' THEN 'Verbose' WHEN '' THEN 'Unknown' ELSE x END")
scalar("nrm3_parse_int", "CASE event_id % 4 WHEN 0 THEN concat('0x', lower(hex(event_id))) WHEN 1 THEN concat(' ', CAST(event_id AS STRING)) WHEN 2 THEN event_type ELSE '' END", lambda: T.parse_int(F.col("x")), "CASE WHEN event_id % 4 < 2 THEN CAST(event_id AS INTEGER) END")
scalar("nrm6_split_domain_user", "CASE WHEN event_id % 2 = 0 THEN concat('LAB', chr(92), event_type, chr(92), 'z') ELSE event_type END", lambda: F.concat_ws("|", T.split_domain_user(F.col("x"))["domain"], T.split_domain_user(F.col("x"))["user"]), "CASE WHEN event_id % 2 = 0 THEN concat('LAB|', substr(x, 5)) ELSE x END")
scalar("nrm10_record_id", "concat('<Event><EventRecordID a=\"1\">', CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END, '</EventRecordID></Event>')", lambda: R.record_id_from_xml(F.col("x")), "CASE WHEN event_id % 3 <> 0 THEN event_id END")
scalar("nrm13_log_name", "CASE event_id % 4 WHEN 0 THEN 'Sysmon' WHEN 1 THEN ' безопасность ' WHEN 2 THEN 'System' ELSE event_type END", lambda: R.resolve_log_name(F.col("x")), "CASE event_id % 4 WHEN 0 THEN 'Microsoft-Windows-Sysmon/Operational' WHEN 1 THEN 'Security' WHEN 2 THEN 'System' ELSE x END")
scalar("det5_privileged_group", "CASE event_id % 5 WHEN 0 THEN 'Domain Admins' WHEN 1 THEN 'LAB Операторы архива' WHEN 2 THEN event_type WHEN 3 THEN '' END", lambda: A.is_privileged_group(F.col("x"), F.when(F.col("event_id") % 7 == 0, "S-1-5-21-1-512").otherwise("S-1-5-21-1-513")), "(event_id % 5 < 2) OR (event_id % 7 = 0)")
scalar("det6_suspicious_paths", "concat('C:', chr(92), CASE event_id % 3 WHEN 0 THEN 'temp' WHEN 1 THEN 'Users' ELSE 'x' END, chr(92), CASE event_id % 2 WHEN 0 THEN 'Загрузки' ELSE event_type END, chr(92), 'a.exe')", lambda: F.array_join(A.suspicious_paths(F.col("x")), "|"),
       "concat_ws('|', CASE WHEN event_id % 3 = 0 THEN concat(chr(92), 'Temp', chr(92)) END, CASE WHEN event_id % 2 = 0 THEN concat(chr(92), 'Загрузки', chr(92)) END)")
scalar("det4_machine_account", "CASE event_id % 5 WHEN 0 THEN 'HOST$' WHEN 1 THEN 'система' WHEN 2 THEN concat('LAB', chr(92), 'DWM-3') WHEN 3 THEN event_type END", lambda: A.is_service_name(F.col("x")), "event_id % 5 < 3")


@query("nrm7_script_hash", "SELECT row_id, upper(sha256(script_block)) AS h FROM e WHERE script_block IS NOT NULL")
def _(ev):
    return ev.where("script_block is not null").select("row_id", T.sha256_hex(F.col("script_block")).alias("h"))


KEY_SQL = "concat_ws('|', lower(computer_name), lower(log_name), lower(provider_name), CAST(event_id AS VARCHAR), 'record:' || CAST(event_record_id AS VARCHAR))"


@query("nrm9_event_key", f"SELECT row_id, {KEY_SQL} AS event_key FROM e")
def _(ev):
    return ev.select("row_id", R.event_key().alias("event_key"))


SCORE_SQL = " + ".join(
    f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END"
    for c in ("computer_name", "log_name", "provider_name", "user_name", "domain", "process_name", "parent_process_name", "command_line", "source_ip", "destination_ip", "target_user_name", "script_block", "query_name", "task_name", "service_name", "process_path",
              "event_record_id", "process_id", "logon_type", "p_targetusername", "p_membername", "p_status", "p_ticketencryptiontype", "p_servicename")
)


@query("nrm11_completeness", f"SELECT row_id, CAST({SCORE_SQL} AS INTEGER) AS score FROM e")
def _(ev):
    return ev.select("row_id", R.completeness_score().cast("int").alias("score"))


DESCRIBE_SQL = """provider_name || ' / ' || CAST(event_id AS VARCHAR) || CASE event_id WHEN 4624 THEN ' successful logon type ' || CAST(logon_type AS VARCHAR) WHEN 4625 THEN ' failed logon' WHEN 4648 THEN ' explicit credentials logon'
 WHEN 4672 THEN ' special privileges assigned' WHEN 4688 THEN ' process created' WHEN 1 THEN ' process created' WHEN 4698 THEN ' scheduled task created' WHEN 4720 THEN ' user account created' WHEN 4728 THEN ' group membership change'
 WHEN 4732 THEN ' group membership change' WHEN 1102 THEN ' security log cleared' WHEN 4104 THEN ' PowerShell script block' WHEN 3 THEN ' network connection' WHEN 22 THEN ' DNS query' ELSE ' event' END
 || ' user=' || user_name || coalesce(' proc=' || process_name, '') || coalesce(' ip=' || source_ip, '')"""


@query("nrm12_describe", f"SELECT row_id, {DESCRIBE_SQL} AS description FROM e")
def _(ev):
    return R.describe(ev).select("row_id", "description")


@query("src2_day_partition", "SELECT row_id, strftime(time_created_utc, '%Y-%m-%d') AS event_date FROM e WHERE time_created_utc >= TIMESTAMP '2024-01-05' AND time_created_utc < TIMESTAMP '2024-01-08'")
def _(ev):
    f = L.EventFilter(start=dt.datetime(2024, 1, 5), end=dt.datetime(2024, 1, 7, 23, 59, 59, 999999))
    return L.filter_events(R.with_identity(ev), f).select("row_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


# Merging. Rows meet on a coarse key, so that there is something to merge.

@query("mrg1_upsert", """, k AS (SELECT concat(computer_name, '|', CAST(event_id AS VARCHAR)) AS key, row_id, process_name, command_line, CAST(row_id * 7919 % 101 AS INTEGER) AS score FROM e),
 m AS (SELECT *, max(score) OVER (PARTITION BY key ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM k), s AS (SELECT * FROM m WHERE best IS NULL OR score > best)
 SELECT key AS event_key, max(score) AS completeness_score, arg_max(process_name, score) FILTER (WHERE process_name IS NOT NULL) AS process_name, arg_max(command_line, score) FILTER (WHERE command_line IS NOT NULL) AS command_line FROM s GROUP BY key""")
def _(ev):
    d = ev.select(F.concat_ws("|", "computer_name", F.col("event_id").cast("string")).alias("event_key"), "row_id", "process_name", "command_line", (F.col("row_id") * 7919 % 101).cast("int").alias("completeness_score"))
    return M.upsert_events(None, d, "row_id").select("event_key", "completeness_score", "process_name", "command_line")


@query("mrg2_best_per_key", """, k AS (SELECT concat(computer_name, '|', CAST(event_id AS VARCHAR)) AS event_key, row_id, CAST(row_id * 7919 % 11 AS INTEGER) AS completeness_score FROM e)
 SELECT event_key, row_id, completeness_score FROM k QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY completeness_score DESC, row_id DESC) = 1""")
def _(ev):
    return M.best_per_key(ev.select(F.concat_ws("|", "computer_name", F.col("event_id").cast("string")).alias("event_key"), "row_id", (F.col("row_id") * 7919 % 11).cast("int").alias("completeness_score")))


@query("mrg3_indicators", """WITH a AS (SELECT DISTINCT 'ip' AS type, concat('10.0.0.', CAST(user_id % 40 AS VARCHAR)) AS value FROM events), b AS (SELECT DISTINCT 'ip' AS type, concat('10.0.0.', CAST(user_id % 20 AS VARCHAR)) AS value FROM events)
 SELECT a.type, a.value, CASE WHEN b.value IS NULL THEN 'first' ELSE 'second' END AS source FROM a LEFT JOIN b USING (value)""", bare=True)
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    batch = lambda kind, mod, source: ev.select(F.lit(kind).alias("type"), F.concat(F.lit(" 10.0.0."), (F.col("user_id") % mod).cast("string")).alias("value"), F.lit(None).cast("string").alias("comment"), F.lit(source).alias("source"))
    return M.upsert_indicators([batch(" IP ", 40, "first"), batch("ip", 20, "second")]).select("type", "value", "source")


# Filters and search.

@query("flt1_fields", "SELECT row_id FROM e WHERE event_id IN (4624, 4625, 4688) AND (contains(lower(coalesce(user_name, '')), 'user1') OR contains(lower(coalesce(target_user_name, '')), 'user1')) AND contains(lower(computer_name), 'host-')")
def _(ev):
    return L.filter_events(ev, L.EventFilter(event_ids=(4624, 4625, 4688), user="USER1", host="host-")).select("row_id")


@query("flt2_keyword", "SELECT row_id FROM e WHERE contains(lower(concat_ws('|', command_line, script_block, process_name, user_name, target_user_name, query_name, task_name, service_name, p_membername)), 'svc-n') OR contains(lower(concat_ws('|', command_line, script_block, process_name)), 'comsvcs')")
def _(ev):
    return L.filter_events(ev, L.EventFilter(keyword="SVC-N")).select("row_id").unionByName(L.filter_events(ev, L.EventFilter(keyword="comsvcs")).select("row_id")).distinct()


@query("flt3_time_ranges", "SELECT row_id FROM e WHERE time_created_utc BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-03 23:59:59.999999' OR time_created_utc BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:59:59.999999'")
def _(ev):
    return L.filter_events(ev, L.build_filter(dates="2024-01-03, 2024-01-10..2024-01-12")).select("row_id")


@query("flt4_search", "SELECT row_id FROM e WHERE event_id = 4625 ORDER BY time_created_utc, row_id LIMIT 1000 OFFSET 5")
def _(ev):
    return L.search(ev, L.EventFilter(event_ids=(4625,)), offset=5).select("row_id")


@query("flt5_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM e WHERE contains(lower(coalesce(process_name, '') || '|' || coalesce(parent_process_name, '') || '|' || coalesce(process_path, '') || '|' || coalesce(command_line, '')), 'certutil')")
def _(ev):
    return L.count_events(ev, L.EventFilter(process="certutil"))


@query("flt5_scoped_fetch", "SELECT row_id FROM e WHERE event_id IN (1102, 104) AND contains(lower(user_name || '|' || coalesce(target_user_name, '') || '|' || domain), 'admin1')")
def _(ev):
    return L.fetch_by_event_ids(ev, L.EventFilter(event_ids=(1,), user="admin1"), (1102, 104)).select("row_id")


@query("flt6_by_row_ids", "SELECT row_id, event_id FROM e WHERE row_id % 7 = 3")
def _(ev):
    return L.fetch_by_row_ids(ev, ev.where("row_id % 7 = 3").select("row_id")).select("row_id", "event_id")


@query("flt7_merge_ranges", f""", r AS (SELECT computer_name, us AS s, us + {HOUR} AS t FROM e WHERE event_id = 4624), w AS (SELECT *, max(t) OVER (PARTITION BY computer_name ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY computer_name ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM w)
 SELECT computer_name, CAST(max(t) - min(s) AS BIGINT) AS span_us, CAST(count(*) AS BIGINT) AS n_ranges FROM i GROUP BY computer_name, k""")
def _(ev):
    d = ev.where("event_id = 4624").select("computer_name", F.unix_micros("time_created_utc").alias("start_us"), (F.unix_micros("time_created_utc") + HOUR).alias("end_us"))
    return L.merge_ranges(d, ["computer_name"]).select("computer_name", (F.col("end_us") - F.col("start_us")).alias("span_us"), "n_ranges")


@query("flt9_artefacts", "SELECT row_id AS event_row_id FROM e WHERE event_id IN (4697, 7045) AND contains(lower(computer_name), 'host-3')")
def _(ev):
    return L.filter_artefacts(D.service_installs(ev), "findings", L.EventFilter(host="HOST-3", keyword="image")).select("event_row_id")


@query("set2_range_union", "SELECT row_id FROM e WHERE time_created_utc BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04 23:59:59.999999'")
def _(ev):
    r = L.TimeRange
    two = (r(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3, 12)), r(dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4, 23, 59, 59, 999999)))
    return L.filter_events(ev, L.EventFilter(ranges=two)).select("row_id")


# Aggregates.

def top_sql(section: str, key: str, k: int | None, where: str = "TRUE") -> str:
    limit = f" ORDER BY value DESC, key LIMIT {k}" if k else ""
    return f"SELECT * FROM (SELECT '{section}' AS section, key, CAST(count(*) AS BIGINT) AS value FROM (SELECT {key} AS key FROM e WHERE {where}) GROUP BY key{limit})"


@query("agg1_statistics", " UNION ALL ".join([
    top_sql("EventIdCounts", "CAST(event_id AS VARCHAR)", 30), top_sql("UserCounts", "coalesce(user_name, target_user_name, '(unknown)')", 20), top_sql("ProcessCounts", "process_name", 20, "process_name IS NOT NULL"),
    top_sql("SourceIpCounts", "source_ip", 20, "source_ip IS NOT NULL"), top_sql("EventsByHour", "lpad(CAST(hour(time_created_utc) AS VARCHAR), 2, '0') || ':00'", None), top_sql("Summary", "'TotalEvents'", None),
]))
def _(ev):
    return S.statistics(ev)


FAILED_SQL = "SELECT account, ip, count(*) AS n, arg_max(row_id, (us, row_id)) AS last_row, 'Failed logons for ' || arg_min(target_user_name, (us, row_id)) AS title FROM e WHERE event_id = 4625 GROUP BY account, ip HAVING count(*) >= 3"


@query("agg2_severity_summary", f""", f AS ({FAILED_SQL}), x AS (SELECT f.*, e.target_user_name AS who, e.source_ip AS addr FROM f JOIN e ON e.row_id = f.last_row)
 SELECT 'Severity' AS section, s AS key, CAST(CASE WHEN s = 'Low' THEN (SELECT count(*) FROM x) ELSE 0 END AS BIGINT) AS value FROM (SELECT unnest(['Info', 'Low', 'Medium', 'High', 'Critical']) AS s)
 UNION ALL SELECT 'Summary', 'Findings', CAST(count(*) AS BIGINT) FROM x
 UNION ALL (SELECT 'TopUsers', lower(who), CAST(count(*) AS BIGINT) FROM x GROUP BY lower(who) ORDER BY count(*) DESC, lower(who) LIMIT 5)
 UNION ALL (SELECT 'TopIps', lower(addr), CAST(count(*) AS BIGINT) FROM x GROUP BY lower(addr) ORDER BY count(*) DESC, lower(addr) LIMIT 5)
 UNION ALL SELECT 'Summary', k, 0 FROM (SELECT unnest(['Chains', 'IocMatches', 'CveMatches']) AS k)""")
def _(ev):
    f = D.failed_logons(ev)
    none = f.limit(0)
    return S.severity_summary(f, none, none, none)


@query("agg3_table_summary", "SELECT 'events' AS name, CAST(count(*) AS BIGINT) AS n, strftime(min(time_created_utc), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(time_created_utc), '%Y-%m-%d %H:%M:%S') AS last_time FROM e UNION ALL SELECT 'findings', CAST(count(*) AS BIGINT), NULL, NULL FROM e WHERE event_id = 7045")
def _(ev):
    return S.table_summary({"events": ev, "findings": D.service_installs(ev)})


@query("agg4_counts", "SELECT event_type AS key, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type", bare=True)
def _(spark, sf_dir):
    return S.counts_by(table(spark, sf_dir, "events"), "event_type")


@query("agg5_ordered_findings", "SELECT row_id AS event_row_id, CASE event_id WHEN 1102 THEN 'Critical' ELSE 'High' END AS severity FROM e WHERE event_id IN (104, 1102) ORDER BY event_id DESC, time_created_utc, row_id LIMIT 50")
def _(ev):
    return S.ordered_findings(D.log_clearing(ev)).select("event_row_id", "severity")


# Classification and severity.

CATEGORY_SQL = "CASE WHEN event_id IN (1, 4688) THEN 'process_creation' WHEN event_id = 3 THEN 'network_connection' WHEN event_id = 22 THEN 'dns_query' WHEN event_id = 4104 THEN 'ps_script' WHEN event_id IN (4624, 4625, 4648, 4771, 4776) THEN 'authentication' WHEN event_id IN (4720, 4728, 4732) THEN 'account_management' WHEN event_id = 4672 THEN 'privilege_escalation' WHEN event_id IN (104, 1102) THEN 'log_clearing' WHEN event_id = 4698 THEN 'task_scheduler' WHEN event_id = 7045 THEN 'service_installation' END"


@query("det1_classify", f"SELECT row_id, {CATEGORY_SQL} AS category FROM e")
def _(ev):
    return ev.select("row_id", N.classify_event().alias("category"))


@query("det2_validated_severity", "SELECT row_id, CASE WHEN row_id % 5 <= 2 THEN row_id % 5 WHEN event_id IN (4624, 4625, 4648, 4771, 4776) THEN 2 WHEN event_id IN (1, 3, 22, 4104, 1102) THEN row_id % 5 ELSE 3 END::INTEGER AS severity_rank FROM e")
def _(ev):
    return ev.select("row_id", N.validated_severity((F.col("row_id") % 5).cast("int"), "Custom").cast("int").alias("severity_rank"))


@query("det3_keys", "SELECT row_id, account, ip FROM e")
def _(ev):
    return ev.select("row_id", A.account_key().alias("account"), A.ip_key().alias("ip"))


@query("det0_findings", "SELECT 'ServiceInstallation' AS rule_name, row_id AS event_row_id, CAST(row_id AS VARCHAR) AS ids, 2 AS severity_rank, 'service_installation' AS event_type, TRUE AS severity_matches_event FROM e WHERE event_id = 7045")
def _(ev):
    f = D.service_installs(ev)
    return f.select("rule_name", "event_row_id", F.array_join(F.col("related_event_row_ids").cast("array<string>"), ",").alias("ids"), "severity_rank", "event_type", "severity_matches_event")


# Detectors.

@query("d1_failed_logon", f", f AS ({FAILED_SQL}) SELECT 'FailedLogon' AS rule_id, title, 'Low' AS severity, last_row AS event_row_id, CAST(n AS BIGINT) AS n_related, account || '|' || ip AS group_key FROM f")
def _(ev):
    return grouped(D.failed_logons(ev))


@query("d2_successful_logon", """ SELECT 'SuccessfulLogon' AS rule_id, 'Successful ' || CASE logon_type WHEN 3 THEN 'Network' WHEN 8 THEN 'NetworkCleartext' WHEN 9 THEN 'NewCredentials' WHEN 10 THEN 'RemoteInteractive (RDP)' ELSE 'CachedRemoteInteractive' END || ' logon: ' || arg_min(target_user_name, (us, row_id)) AS title,
 CASE WHEN logon_type IN (8, 10) THEN 'Low' ELSE 'Info' END AS severity, arg_max(row_id, (us, row_id)) AS event_row_id, CAST(count(*) AS BIGINT) AS n_related, account || '|' || CAST(logon_type AS VARCHAR) || '|' || ip AS group_key FROM e WHERE event_id = 4624 AND logon_type IN (3, 8, 9, 10, 11) GROUP BY account, logon_type, ip
 UNION ALL SELECT 'SuccessfulLogon', 'Logon with explicit credentials', 'Low', row_id, 1, NULL FROM e WHERE event_id = 4648""")
def _(ev):
    return grouped(D.successful_logons(ev))


def greedy_sql(failures: str, keys: str, window: int, fit: str, more: str = "") -> str:
    """Greedy clusters as SQL: candidates, the next candidate after each one's end, and a walk."""
    return f""", f AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY us, row_id) AS rn FROM ({failures})),
 w AS (SELECT *, max(rn) OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN CURRENT ROW AND {window} FOLLOWING) AS en{more} FROM f),
 c AS (SELECT {keys}, rn, en FROM w WHERE {fit}),
 nx AS (SELECT a.*, (SELECT min(b.rn) FROM c b WHERE {' AND '.join(f'b.{k.strip()} = a.{k.strip()}' for k in keys.split(','))} AND b.rn > a.en) AS nxt FROM c a),
 g AS (SELECT n.* FROM nx n JOIN (SELECT {keys}, min(rn) AS rn FROM c GROUP BY {keys}) m USING ({keys}, rn) UNION ALL SELECT n.* FROM g JOIN nx n ON {' AND '.join(f'n.{k.strip()} = g.{k.strip()}' for k in keys.split(','))} AND n.rn = g.nxt),
 h AS (SELECT {keys}, g.rn AS start_rn, count(*) AS n, max(f.us) AS last_us, arg_max(f.row_id, f.rn) AS last_row, count(DISTINCT f.account) AS accounts FROM g JOIN (SELECT *, {', '.join(k.strip() + ' AS k_' + k.strip() for k in keys.split(','))} FROM f) f USING ({keys}) WHERE f.rn BETWEEN g.rn AND g.en GROUP BY {keys}, g.rn)
"""


FAILURE_SQL = "SELECT * FROM e WHERE event_id IN (4625, 4771) OR (event_id = 4776 AND coalesce(p_status, '0x0') <> '0x0')"


@query("d3_brute_force", greedy_sql(FAILURE_SQL, "account, ip", 3 * DAY, "en - rn + 1 >= 4") + f""", won AS (SELECT h.account, h.ip, h.start_rn, arg_min(s.row_id, (s.us, s.row_id)) AS s_row FROM h JOIN e s ON s.event_id = 4624 AND s.account = h.account AND s.ip = h.ip AND s.us BETWEEN h.last_us AND h.last_us + {3 * DAY} GROUP BY h.account, h.ip, h.start_rn)
 SELECT 'BruteForce' AS rule_id, CASE WHEN s_row IS NULL THEN 'Possible brute force authentication' ELSE 'Possible successful brute force authentication' END AS title, CASE WHEN s_row IS NULL THEN 'Medium' ELSE 'High' END AS severity, coalesce(s_row, last_row) AS event_row_id,
 CAST(n + CASE WHEN s_row IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_related, h.account || '|' || h.ip AS group_key FROM h LEFT JOIN won USING (account, ip, start_rn)""")
def _(ev):
    return grouped(D.brute_force(ev, SETTINGS))


@query("d3c_password_spray", greedy_sql(f"SELECT * FROM ({FAILURE_SQL}) WHERE ip NOT IN ('', '-')", "ip", DAY, "seen >= 5", f", len(list_distinct(list(account) OVER (PARTITION BY ip ORDER BY us RANGE BETWEEN CURRENT ROW AND {DAY} FOLLOWING))) AS seen")
       + " SELECT 'BruteForce' AS rule_id, 'Possible password spraying' AS title, 'High' AS severity, last_row AS event_row_id, CAST(n AS BIGINT) AS n_related, ip AS group_key FROM h")
def _(ev):
    return grouped(D.password_spray(ev, D.Settings(spray_threshold=5, burst_window_us=DAY)))


@query("d4_new_user", f""", a AS (SELECT us, row_id, lower(p_membername) AS member, target_user_name FROM e WHERE event_id IN (4728, 4732) AND p_targetusername = 'Administrators'),
 m AS (SELECT c.row_id, count(a.row_id) AS hits FROM e c LEFT JOIN a ON contains(a.member, lower(c.target_user_name)) AND a.us BETWEEN c.us AND c.us + {2 * HOUR} WHERE c.event_id = 4720 GROUP BY c.row_id)
 SELECT 'NewUser' AS rule_id, CASE WHEN hits > 0 THEN 'New user created and added to a privileged group' ELSE 'New user account created' END AS title, CASE WHEN hits > 0 THEN 'High' ELSE 'Medium' END AS severity, row_id AS event_row_id, CAST(hits + 1 AS BIGINT) AS n_related, NULL AS group_key FROM m""")
def _(ev):
    return grouped(D.new_users(ev, SETTINGS))


@query("d5_privilege_change", " SELECT 'PrivilegeChange' AS rule_id, CASE WHEN event_id = 4672 THEN 'Special privileges assigned to new logon' ELSE 'User added to a privileged group' END AS title, CASE WHEN event_id = 4672 THEN 'Low' ELSE 'High' END AS severity, row_id AS event_row_id FROM e WHERE event_id = 4672 OR (event_id IN (4728, 4732) AND p_targetusername = 'Administrators')")
def _(ev):
    return shown(D.privilege_changes(ev))


@query("d6_process_creation", """, r AS (SELECT row_id, CASE WHEN contains(lower(process_path), '\\temp\\') THEN 1 ELSE 0 END + CASE WHEN parent_process_name = 'winword.exe' AND process_name IN ('powershell.exe', 'cmd.exe') THEN 1 ELSE 0 END AS n FROM e WHERE event_id IN (1, 4688))
 SELECT 'SuspiciousProcessCreation' AS rule_id, 'Suspicious process creation' AS title, CASE WHEN n > 1 THEN 'High' ELSE 'Medium' END AS severity, row_id AS event_row_id FROM r WHERE n > 0""")
def _(ev):
    return shown(D.process_creation(ev))


@query("d7_powershell", """, b AS (SELECT row_id, lower(concat_ws(chr(10), command_line, script_block)) AS t, concat_ws(chr(10), command_line, script_block) AS o FROM e WHERE event_id IN (1, 4688, 4104)),
 r AS (SELECT row_id, CASE WHEN regexp_matches(t, '(-enc|-encodedcommand|-ec)(\\s+|:)\\s*[''"]?[a-z0-9+/]{20,}=?=?') THEN 1 ELSE 0 END + CASE WHEN contains(t, ' -nop ') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'certutil') THEN 1 ELSE 0 END AS n FROM b)
 SELECT 'SuspiciousPowerShell' AS rule_id, 'Suspicious PowerShell activity' AS title, CASE WHEN n > 1 THEN 'High' ELSE 'Medium' END AS severity, row_id AS event_row_id FROM r WHERE n > 0""")
def _(ev):
    return shown(D.suspicious_powershell(ev))


@query("d9_scheduled_task", " SELECT 'SuspiciousScheduledTask' AS rule_id, 'Scheduled task created' AS title, CASE WHEN contains(lower(command_line), '\\temp\\') THEN 'High' ELSE 'Medium' END AS severity, row_id AS event_row_id FROM e WHERE event_id = 4698")
def _(ev):
    return shown(D.scheduled_tasks(ev))


@query("d10_service_install", " SELECT 'ServiceInstallation' AS rule_id, 'Windows service installed' AS title, 'Medium' AS severity, row_id AS event_row_id FROM e WHERE event_id = 7045")
def _(ev):
    return shown(D.service_installs(ev))


@query("d11_rdp", " SELECT 'RdpActivity' AS rule_id, 'RDP logon: ' || arg_min(target_user_name, (us, row_id)) AS title, 'Low' AS severity, arg_max(row_id, (us, row_id)) AS event_row_id, CAST(count(*) AS BIGINT) AS n_related, account || '|' || ip AS group_key FROM e WHERE event_id = 4624 AND logon_type = 10 GROUP BY account, ip")
def _(ev):
    return grouped(D.rdp_activity(ev))


@query("d12_log_clearing", " SELECT 'LogClearing' AS rule_id, CASE WHEN event_id = 1102 THEN 'Security event log was cleared' ELSE 'Windows event channel was cleared' END AS title, CASE WHEN event_id = 1102 THEN 'Critical' ELSE 'High' END AS severity, row_id AS event_row_id FROM e WHERE event_id IN (104, 1102)")
def _(ev):
    return shown(D.log_clearing(ev))


def remapped(ev: DataFrame, source: int, target: int, **columns) -> DataFrame:
    """Events of one id turned into another that the driver's tables lack."""
    return ev.withColumn("event_id", F.when(F.col("event_id") == source, target).otherwise(F.col("event_id"))).withColumns(columns)


@query("d13_directory_attack", """ SELECT 'KerberosAndDirectoryAttack' AS rule_id, CASE event_id WHEN 4698 THEN 'Directory replication rights used (possible DCSync)' WHEN 4769 THEN 'AS-REP roasting indicator' ELSE 'User account locked out' END AS title,
 CASE event_id WHEN 4698 THEN 'Critical' WHEN 4769 THEN 'High' ELSE 'Medium' END AS severity, row_id AS event_row_id FROM e WHERE event_id = 4648 OR (event_id = 4698 AND row_id % 2 = 0) OR (event_id = 4769 AND row_id % 3 = 0)""")
def _(ev):
    d = remapped(remapped(remapped(ev, 4648, 4740), 4698, 4662), 4769, 4768)
    d = d.withColumn("raw_xml", F.when((F.col("event_id") == 4662) & (F.col("row_id") % 2 == 0), F.lit("<P>{1131F6AD-9c07-11d1-f79f-00c04fc2dcd2}</P>")))
    more = F.create_map(F.lit("preauthtype"), F.when(F.col("row_id") % 3 == 0, "0").otherwise("2"))
    return shown(D.directory_attacks(d.withColumn("properties", F.map_concat(F.coalesce("properties", F.create_map().cast("map<string,string>")), more))))


def largest_sql(rows: str, window: int, fit: str, title: str) -> str:
    return f""", f AS (SELECT *, lower(coalesce(target_user_name, '')) AS who, row_number() OVER (PARTITION BY target_user_name, ip ORDER BY us, row_id) AS rn FROM ({rows})), w AS (SELECT *, max(rn) OVER (PARTITION BY who, ip ORDER BY us RANGE BETWEEN CURRENT ROW AND {window} FOLLOWING) AS en FROM f),
 b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY who, ip ORDER BY en - rn DESC, us, row_id) = 1), h AS (SELECT b.who, b.ip, count(*) AS n, count(DISTINCT f.p_servicename) AS services, arg_max(f.row_id, f.rn) AS last_row FROM b JOIN f ON f.who = b.who AND f.ip = b.ip AND f.rn BETWEEN b.rn AND b.en GROUP BY b.who, b.ip)
 SELECT 'KerberosAndDirectoryAttack' AS rule_id, '{title}' AS title, 'High' AS severity, last_row AS event_row_id, CAST(n AS BIGINT) AS n_related, who || '|' || ip AS group_key FROM h WHERE {fit}"""


@query("d13c_preauth_burst", largest_sql("SELECT * FROM e WHERE event_id = 4771", 20 * DAY, "n >= 3", "Kerberos pre-authentication failure burst"))
def _(ev):
    return grouped(D.kerberos_bursts(ev, D.Settings(burst_threshold=3, burst_window_us=20 * DAY)).where("title like 'Kerberos pre%'"))


@query("d13d_kerberoast", largest_sql("SELECT * FROM e WHERE event_id = 4769", 25 * DAY, "n >= 5 AND services >= 3", "Kerberoasting ticket-request burst"))
def _(ev):
    return grouped(D.kerberos_bursts(ev, D.Settings(burst_window_us=25 * DAY)).where("title like 'Kerberoasting%'"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BLOB_SQL = "lower(concat_ws(chr(10), process_name, process_path, parent_process_name, command_line, script_block, service_name, task_name, query_name, CASE WHEN p_targetusername IS NOT NULL THEN 'targetusername' END, p_targetusername, CASE WHEN p_membername IS NOT NULL THEN 'membername' END, p_membername, CASE WHEN p_status IS NOT NULL THEN 'status' END, p_status, CASE WHEN p_ticketencryptiontype IS NOT NULL THEN 'ticketencryptiontype' END, p_ticketencryptiontype, CASE WHEN p_servicename IS NOT NULL THEN 'servicename' END, p_servicename))"


def signature_sql(signatures: tuple[Signature, ...]) -> str:
    parts = []
    for s in signatures:
        ids = [i for i in s.event_ids]
        fits = [f"event_id IN ({', '.join(map(str, ids))})"]
        if s.provider:
            fits.append(f"contains(lower(provider_name), {quoted(s.provider.lower())})")
        if s.processes:
            fits.append("(" + " OR ".join(f"coalesce(lower({c}) = {quoted(p)} OR ends_with(lower({c}), {quoted(BS + p)}), FALSE)" for p in s.processes for c in ("process_name", "process_path")) + ")")
        if s.any:
            fits.append("(" + " OR ".join(f"contains(blob, {quoted(t.lower())})" for t in s.any) + ")")
        fits += [f"contains(blob, {quoted(t.lower())})" for t in s.all] + [f"NOT contains(blob, {quoted(t.lower())})" for t in s.exclude]
        parts.append(f"SELECT {quoted(s.id)} AS rule_id, {quoted(s.title)} AS title, {quoted(s.severity)} AS severity, row_id AS event_row_id FROM b WHERE {' AND '.join(fits)}")
    return f", b AS (SELECT *, {BLOB_SQL} AS blob FROM e) " + " UNION ALL ".join(parts)


for _no, (_name, _signatures) in enumerate(CATALOGS.items(), 15):
    _no = 21 if _name == "CredentialAccess" else _no
    query(f"d{_no}_{_name.lower()}", signature_sql(_signatures))(lambda ev, n=_name, s=_signatures: shown(D.signature_findings(ev, {n: s})))

OWN = (Signature("X-1", "Notepad or agent", "Low", (1, 4688), processes=("notepad.exe", "agent.exe"), exclude=("readme",)), Signature("X-2", "Any event with svc1", "Medium", (), any=("svc1",)), Signature("X-3", "Windows events", "Info", (7045,), provider="service control", all=("SVC-", "system32")))


def own_sql() -> str:
    return signature_sql(OWN).replace("event_id IN ()", "TRUE")


@query("d14_own_signatures", own_sql())
def _(ev):
    return shown(D.signature_findings(ev, {"Custom": OWN}))


@query("d20_dns_tunnelling", " SELECT 'MalwareBehavior' AS rule_id, 'Possible DNS tunneling or encoded exfiltration' AS title, 'Medium' AS severity, row_id AS event_row_id FROM e WHERE event_id = 22 AND query_name LIKE 'mfrgg%'")
def _(ev):
    return shown(D.dns_tunnelling(ev))


@query("d22_all_detectors")
def _(ev):
    return run_detectors(stored(ev, "events"), SETTINGS, ordered=False, whole=True).select("rule_name", "rule_id", "title", "severity", "event_row_id", "n_related")


@query("w10_finding_events", f", f AS ({FAILED_SQL}) SELECT account || '|' || ip AS group_key, row_id FROM e JOIN f USING (account, ip) WHERE event_id = 4625")
def _(ev):
    return finding_events(ev, D.failed_logons(ev)).select("group_key", "row_id")


# Rules.

RULES_YAML = r"""
title: Whoami
id: r1
logsource: {product: windows, category: process_creation}
detection:
  selection:
    Image|endswith: '\whoami.exe'
  filter:
    CommandLine|contains: '/never'
  condition: selection and not filter
level: low
tags: [attack.discovery, attack.t1033]
---
title: Two of many
id: r2
logsource: {product: windows, category: process_creation}
detection:
  sel_a: {CommandLine|contains: delete}
  sel_b: {Image|startswith: 'C:\Windows'}
  sel_c: {ParentImage: WINWORD.EXE}
  condition: 2 of sel_*
level: high
tags: [attack.impact, attack.t1490, attack.t1490.001]
---
title: Words
id: r3
logsource: {product: windows, service: system}
detection:
  words: [svc-cmd, svc-net]
  condition: words
level: informational
---
title: Pattern
id: r4
logsource: {product: windows, service: sysmon}
detection:
  q: {QueryName: 'mfrgg*7*.test', EventID: 22}
  r: {QueryName|re: '^www\.example'}
  condition: all of q or (r and not q)
level: critical
---
title: Left out
id: r5
status: experimental
logsource: {product: windows}
detection: {a: {EventID: 1}, condition: a}
"""


def rules() -> list[G.Rule]:
    from ..sources.readers import parse_rules

    return G.select_rules(parse_rules(RULES_YAML, "rules.yml"))


RULES_SQL = [
    "event_id IN (1, 4688) AND ends_with(lower(process_path), '\\whoami.exe') AND NOT contains(lower(command_line), '/never')",
    "event_id IN (1, 4688) AND (CASE WHEN contains(lower(command_line), 'delete') THEN 1 ELSE 0 END + CASE WHEN starts_with(lower(process_path), 'c:\\windows') THEN 1 ELSE 0 END + CASE WHEN lower(parent_process_name) = 'winword.exe' THEN 1 ELSE 0 END) >= 2",
    "contains(lower(log_name || '|' || provider_name), 'system') AND (contains(lower(concat_ws('|', service_name, command_line, process_path)), 'svc-cmd') OR contains(lower(concat_ws('|', service_name, command_line, process_path)), 'svc-net'))",
    "contains(lower(provider_name), 'sysmon') AND ((event_id = 22 AND regexp_full_match(lower(query_name), 'mfrgg.*7.*\\.test')) OR (starts_with(query_name, 'www.example') AND NOT (event_id = 22 AND regexp_full_match(lower(query_name), 'mfrgg.*7.*\\.test'))))",
]


@query("sig_rules", " " + " UNION ALL ".join(f"SELECT 'r{i + 1}' AS rule_id, row_id FROM e WHERE {s}" for i, s in enumerate(RULES_SQL)))
def _(ev):
    named = F.element_at(F.array(*(F.lit(r.id) for r in rules())), F.col("rule_no") + 1)
    return G.match_rules(ev, rules()).select(named.alias("rule_id"), "row_id")


@query("sig9_rule_findings", " " + " UNION ALL ".join(f"SELECT 'r{i + 1}' AS rule_id, '[Sigma] {t}' AS title, '{v}' AS severity, row_id AS event_row_id, {ta} AS mitre_tactic, {te} AS mitre_technique FROM e WHERE {s}" for i, (s, t, v, ta, te) in enumerate(zip(
    RULES_SQL, ("Whoami", "Two of many", "Words", "Pattern"), ("Low", "High", "Info", "Critical"), ("'attack.discovery'", "'attack.impact'", "NULL", "NULL"), ("'attack.t1033'", "'attack.t1490'", "NULL", "NULL")))))
def _(ev):
    return G.sigma_findings(ev, rules()).select("rule_id", "title", "severity", "event_row_id", "mitre_tactic", "mitre_technique")


@query("sig8_match_detail", " SELECT row_id, 'selection' AS selections, 'Image' AS fields, process_path AS vals FROM e WHERE " + RULES_SQL[0])
def _(ev):
    r = rules()[0]
    d = ev.where(G.rule_predicate(r)).withColumn("d", G.match_detail(r))
    return d.select("row_id", F.array_join("d.selections", ",").alias("selections"), F.array_join("d.fields", ",").alias("fields"), F.array_join("d.values", ",").alias("vals"))


# Chains.

def first_sql(name: str, anchor: str, other: str, on: str, keep: str = "") -> str:
    return f", {name} AS (SELECT a.row_id AS a_row, arg_min(o.row_id, (o.us, o.row_id)) AS o_row, min(o.us) AS o_us{keep} FROM ({anchor}) a JOIN ({other}) o ON {on} GROUP BY a.row_id)"


def chain(df: DataFrame) -> DataFrame:
    return df.select("scenario", "severity", "user_name", "computer_name", F.array_join(F.col("related_event_row_ids").cast("array<string>"), ",").alias("ids"))


PROCESS_SQL = "SELECT * FROM e WHERE event_id IN (1, 4688)"


@query("cor1_compromised_account", f""", f AS (SELECT *, lower(target_user_name) || '|' || source_ip AS key FROM e WHERE event_id = 4625), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, row_id) AS rn FROM f),
 w AS (SELECT *, max(rn) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN CURRENT ROW AND {10 * DAY} FOLLOWING) AS en FROM n), s AS (SELECT w.*, l.us AS last_us FROM w JOIN n l ON l.key = w.key AND l.rn = w.en WHERE w.en - w.rn + 1 >= 5),
 x AS (SELECT s.row_id, s.key, s.us, s.rn, arg_min(o.row_id, (o.us, o.row_id)) AS s_row, min(o.us) AS s_us, arg_min(o.target_user_name, (o.us, o.row_id)) AS who, arg_min(o.computer_name, (o.us, o.row_id)) AS host FROM s JOIN e o ON o.event_id = 4624 AND lower(o.target_user_name) || '|' || o.source_ip = s.key AND o.us BETWEEN s.last_us AND s.last_us + {10 * DAY} GROUP BY s.row_id, s.key, s.us, s.rn),
 y AS (SELECT x.*, (SELECT p.row_id FROM e p WHERE p.event_id = 4672 AND lower(p.user_name) = lower(x.who) AND p.us BETWEEN x.s_us AND x.s_us + {10 * DAY} ORDER BY p.us, p.row_id LIMIT 1) AS p_row FROM x)
 SELECT 'FailedLogonsThenPrivilegedSuccess' AS scenario, 'Critical' AS severity, who AS user_name, host AS computer_name, concat_ws(',', row_id, s_row, p_row) AS ids FROM y WHERE p_row IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY us, rn) = 1""")
def _(ev):
    return chain(C.compromised_account(ev, 10 * DAY))


@query("cor2_suspicious_account", first_sql("g", "SELECT * FROM e WHERE event_id = 4720", "SELECT * FROM e WHERE event_id IN (4728, 4732)", f"o.us BETWEEN a.us AND a.us + {12 * HOUR} AND (contains(lower(o.target_user_name), lower(a.target_user_name)) OR contains(lower(o.p_membername), lower(a.target_user_name)))")
       + f""", l AS (SELECT g.a_row, g.o_row, min((x.us, x.row_id)) AS hit FROM g JOIN e c ON c.row_id = g.a_row JOIN e x ON x.event_id = 4624 AND replace(x.target_user_name, 'user', 'new') = c.target_user_name AND x.us BETWEEN g.o_us AND g.o_us + {12 * HOUR} GROUP BY g.a_row, g.o_row)
 SELECT 'AccountCreatedThenPrivilegedThenLogon' AS scenario, 'High' AS severity, c.target_user_name AS user_name, c.computer_name, concat_ws(',', l.a_row, l.o_row, l.hit[2]) AS ids FROM l JOIN e c ON c.row_id = l.a_row""")
def _(ev):
    return chain(C.suspicious_account(ev.withColumn("target_user_name", F.when(F.col("event_id") == 4624, F.replace("target_user_name", F.lit("user"), F.lit("new"))).otherwise(F.col("target_user_name"))), 12 * HOUR))


def same_image(text: str) -> str:
    return f"(contains(lower({text}), lower(o.process_path)) OR contains(lower({text}), lower(o.process_name)))"


@query("cor3_task_persistence", first_sql("h", "SELECT * FROM e WHERE event_id = 4698", PROCESS_SQL, f"o.us BETWEEN a.us AND a.us + {HOUR // 6} AND ({same_image('a.command_line')} OR contains(lower(o.command_line), lower(a.task_name)))")
       + " SELECT 'ScheduledTaskThenProcess' AS scenario, 'High' AS severity, t.user_name, t.computer_name, concat_ws(',', a_row, o_row) AS ids FROM h JOIN e t ON t.row_id = a_row")
def _(ev):
    return chain(C.task_persistence(ev))


@query("cor4_script_to_network", first_sql("h", "SELECT * FROM e WHERE event_id = 4104", "SELECT * FROM e WHERE event_id = 1 AND contains(lower(process_name), 'powershell')", f"o.computer_name = a.computer_name AND o.us BETWEEN a.us - 60000000 AND a.us + {3 * DAY}")
       + f""", c AS (SELECT h.a_row, h.o_row, min((n.us, n.row_id)) AS hit FROM h JOIN e p ON p.row_id = h.o_row JOIN e n ON n.event_id = 3 AND n.us BETWEEN p.us AND p.us + {3 * DAY} AND n.computer_name = p.computer_name AND (n.process_id = p.process_id OR n.process_name = p.process_name) GROUP BY h.a_row, h.o_row)
 SELECT 'PowerShellThenProcessThenNetwork' AS scenario, 'High' AS severity, p.user_name, p.computer_name, concat_ws(',', a_row, o_row, hit[2]) AS ids FROM c JOIN e p ON p.row_id = c.o_row""")
def _(ev):
    return chain(C.script_to_network(ev, 3 * DAY))


@query("cor5_remote_logon", first_sql("h", "SELECT * FROM e WHERE event_id = 4624 AND logon_type IN (3, 8, 9, 10)", PROCESS_SQL + " AND process_name IN ('powershell.exe', 'rundll32.exe', 'cmd.exe')", f"o.computer_name = a.computer_name AND o.us BETWEEN a.us AND a.us + {12 * HOUR} AND lower(coalesce(o.target_user_name, o.user_name)) = lower(a.target_user_name)")
       + " SELECT 'RemoteLogonThenSuspiciousProcess' AS scenario, 'High' AS severity, l.target_user_name AS user_name, l.computer_name, concat_ws(',', a_row, o_row) AS ids FROM h JOIN e l ON l.row_id = a_row")
def _(ev):
    return chain(C.remote_logon_to_process(ev, 12 * HOUR))


@query("cor6_service_process", first_sql("h", "SELECT * FROM e WHERE event_id = 7045", PROCESS_SQL, f"o.computer_name = a.computer_name AND o.us BETWEEN a.us AND a.us + {2 * HOUR} AND {same_image('a.process_path')}")
       + " SELECT 'ServiceInstalledThenProcess' AS scenario, 'High' AS severity, s.user_name, s.computer_name, concat_ws(',', a_row, o_row) AS ids FROM h JOIN e s ON s.row_id = a_row")
def _(ev):
    return chain(C.service_to_process(ev, 2 * HOUR))


@query("cor7_all_chains")
def _(ev):
    return chain(C.all_chains(stored(ev, "events"), 2 * HOUR))


# Indicators, vulnerabilities, techniques. Lists come from the driver's tables.

def indicator_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, files, users, names and hashes that some events have, derived from ``events``."""
    ev = table(spark, sf_dir, "events")
    k = (F.col("user_id") % 12).cast("string")
    rows = [("ipv4", F.concat(F.lit("10.0.0."), k)), ("File", F.when(F.col("user_id") % 2 == 0, "WEVTUTIL.exe").otherwise("comsvcs")), ("user", F.concat(F.lit("user1"), k)), ("domain", F.lit("example.TEST")), ("url", F.lit("http://bad.example.test/a.exe")), ("md5", F.lit("d41d8cd98f00b204e9800998ecf8427e")), ("ipaddress", F.lit("10.0.0.1"))]
    parts = F.array(*(F.struct(F.lit(t).alias("type"), v.alias("value")) for t, v in rows))
    return ev.select(F.explode(parts).alias("x")).select("x.type", "x.value").distinct()


INDICATORS_SQL = "ind AS (SELECT DISTINCT type, value FROM (SELECT 'ip' AS type, concat('10.0.0.', CAST(user_id % 12 AS VARCHAR)) AS value FROM events UNION ALL SELECT 'filename', CASE WHEN user_id % 2 = 0 THEN 'WEVTUTIL.exe' ELSE 'comsvcs' END FROM events UNION ALL SELECT 'user', concat('user1', CAST(user_id % 12 AS VARCHAR)) FROM events UNION ALL SELECT 'domain', 'example.TEST' FROM events UNION ALL SELECT 'url', 'http://bad.example.test/a.exe' FROM events UNION ALL SELECT 'hash', 'd41d8cd98f00b204e9800998ecf8427e' FROM events))"


@query("ioc1_usable", f"WITH {INDICATORS_SQL} SELECT type, value FROM ind", bare=True)
def _(spark, sf_dir):
    return I.usable_indicators(indicator_list(spark, sf_dir))


@query("ioc3_matches", PREFIX + f""", {INDICATORS_SQL}, m AS (SELECT i.type AS ioc_type, i.value AS ioc_value, e.row_id AS event_row_id, CASE i.type
 WHEN 'ip' THEN CASE WHEN source_ip = value THEN 'SourceIpAddress' WHEN destination_ip = value THEN 'DestinationIpAddress' END
 WHEN 'domain' THEN CASE WHEN contains(query_name, lower(value)) THEN 'QueryName' WHEN contains(lower(command_line), lower(value)) THEN 'CommandLine' WHEN contains(lower(script_block), lower(value)) THEN 'ScriptBlock' END
 WHEN 'filename' THEN CASE WHEN contains(process_name, lower(value)) THEN 'ProcessName' WHEN contains(parent_process_name, lower(value)) THEN 'ParentProcessName' WHEN contains(lower(process_path), lower(value)) THEN 'ProcessPath' WHEN contains(lower(command_line), lower(value)) THEN 'CommandLine' WHEN contains(lower(script_block), lower(value)) THEN 'ScriptBlock' END
 WHEN 'url' THEN CASE WHEN contains(command_line, value) OR contains(script_block, value) THEN 'CommandLine/ScriptBlock' END
 WHEN 'user' THEN CASE WHEN contains(user_name, value) OR contains(lower(target_user_name), value) THEN 'User' END END AS matched_field FROM e, ind i)
 SELECT * FROM m WHERE matched_field IS NOT NULL""", bare=True)
def _(spark, sf_dir):
    return I.match_indicators(log_events(spark, sf_dir), indicator_list(spark, sf_dir)).select("ioc_type", "ioc_value", "event_row_id", "matched_field")


@query("ioc4_built_in", " SELECT 'psexec.exe' AS ioc_value, row_id AS event_row_id FROM e WHERE process_name = 'powershell.exe'")
def _(ev):
    d = ev.withColumn("process_name", F.when(F.col("process_name") == "powershell.exe", "PsExec.exe").otherwise(F.col("process_name"))).withColumns({"process_path": F.lit(None).cast("string"), "command_line": F.lit(None).cast("string"), "script_block": F.lit(None).cast("string")})
    return I.match_indicators(d, I.built_in_indicators(d.sparkSession)).select("ioc_value", "event_row_id")


@query("ioc2_feed", """WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) SELECT DISTINCT 'domain' AS type, host AS value FROM u WHERE contains(host, '.') UNION ALL SELECT 'ip', concat('10.9.', CAST(page_id % 7 AS VARCHAR), '.1') FROM u GROUP BY ALL""", bare=True)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = pages.select(F.lit("Host").alias("type"), F.concat(F.lit(" "), F.regexp_replace("url", "^http", "hxxp"), F.lit(",")).alias("value"))
    net = pages.select(F.lit("ipv4").alias("type"), F.concat(F.lit("10.9."), (F.col("page_id") % 7).cast("string"), F.lit(".1/24")).alias("value"))
    bad = pages.select(F.lit("hash").alias("type"), F.lit("xyz").alias("value"))
    rows = host.unionByName(net).unionByName(bad).withColumns({"source": F.lit("feed"), "comment": F.lit("feed")})
    return I.normalize_feed(rows).select("type", F.lower("value").alias("value"))


@query("cve1_matches", " SELECT 'CVE-2024-1234' AS cve_id, row_id AS event_row_id, CASE WHEN command_line IS NOT NULL THEN 'CommandLine' ELSE 'ScriptBlock' END AS matched_field FROM e WHERE contains(concat_ws('|', command_line, script_block), 'cve-2024-1234')")
def _(ev):
    known = ev.select(F.lit("cve-2024-1234").alias("cve_id"), *(F.lit("x").alias(c) for c in ("vulnerability_name", "short_description", "vendor_project", "product", "known_ransomware_use"))).limit(1)
    return I.match_cves(ev, known).select("cve_id", "event_row_id", "matched_field")


def attack_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Techniques from customers and tactics from nations: only their shape matters."""
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("short_name"), F.concat(F.lit("Tactic "), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("technique_id"), F.concat(F.lit("Name "), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_nationkey").alias("k"))
    return c.join(n.select("k", "short_name"), "k").select("technique_id", "name", "url", F.array("short_name").alias("tactic_short_names")), n.select("short_name", "name")


@query("jn2_enrich_attack", PREFIX + """, f AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'attack.t' || CAST(row_id % 50 AS VARCHAR) WHEN row_id % 3 = 1 THEN 'attack.t' || CAST(row_id % 50 AS VARCHAR) || '.001' END AS tag, row_id % 50 AS k FROM e WHERE event_id = 7045)
 SELECT row_id AS event_row_id, CASE WHEN tag IS NOT NULL AND c_custkey IS NOT NULL THEN 'Name ' || CAST(k AS VARCHAR) END AS mitre_technique_name, CASE WHEN row_id % 3 = 0 AND c_custkey IS NOT NULL THEN 'Tactic ' || CAST(c_nationkey AS VARCHAR) END AS mitre_tactic_name,
 CASE WHEN row_id % 5 = 0 THEN 'own' WHEN tag IS NOT NULL AND c_custkey IS NOT NULL THEN 'u' || CAST(k AS VARCHAR) END AS mitre_url FROM f LEFT JOIN customer ON c_custkey = k""", bare=True)
def _(spark, sf_dir):
    d = D.service_installs(log_events(spark, sf_dir))
    k = (F.col("event_row_id") % 50).cast("string")
    tag = F.when(F.col("event_row_id") % 3 == 0, F.concat(F.lit("attack.t"), k)).when(F.col("event_row_id") % 3 == 1, F.concat(F.lit("attack.t"), k, F.lit(".001")))
    d = d.withColumns({"mitre_technique": tag, "mitre_tactic": F.lit(None).cast("string"), "mitre_url": F.when(F.col("event_row_id") % 5 == 0, "own")})
    return I.enrich_attack(d, *attack_tables(spark, sf_dir)).select("event_row_id", "mitre_technique_name", "mitre_tactic_name", "mitre_url")


@query("jn3_lookup", "SELECT 'T' || CAST(c_custkey AS VARCHAR) AS technique_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(n_name) = 'france' UNION ALL SELECT 'T7' FROM customer WHERE c_custkey = 7", bare=True)
def _(spark, sf_dir):
    t, _tactics = attack_tables(spark, sf_dir)
    return I.find_techniques(t, tactic="attack.France").unionByName(I.find_techniques(t, technique="attack.t7")).select("technique_id")


@query("jn4_hydrate", " SELECT row_id AS event_row_id, computer_name, coalesce(target_user_name, user_name) AS user_name, log_name AS channel, process_path AS image, CASE event_id WHEN 7045 THEN 'service_installation' END AS event_type FROM e WHERE event_id = 7045")
def _(ev):
    f = D.service_installs(ev).withColumns({"computer_name": F.lit(" "), "user_name": F.lit(None).cast("string"), "event_type": F.lit(None).cast("string")})
    return N.hydrate(f, ev).select("event_row_id", "computer_name", "user_name", F.col("context.channel").alias("channel"), F.col("context.image").alias("image"), "event_type")


@query("jn5_context", " SELECT row_id, coalesce(target_user_name, user_name) AS user_name, coalesce(process_path, process_name) AS image, 'ab' || CAST(row_id AS VARCHAR) AS sha256, coalesce(process_path, '') AS file_path FROM e WHERE event_id IN (1, 4688)")
def _(ev):
    d = ev.where("event_id in (1, 4688)").withColumn("hashes", F.concat(F.lit("MD5=x, SHA256=ab"), F.col("row_id").cast("string"))).select("row_id", N.finding_context().alias("c"))
    return d.select("row_id", F.col("c.user").alias("user_name"), "c.image", "c.sha256", "c.file_path")


@query("jn1_timeline", f" SELECT row_id AS event_row_id, {DESCRIBE_SQL} AS description, CASE WHEN event_id = 1102 THEN 'Critical' WHEN event_id = 104 THEN 'High' WHEN event_id = 7045 THEN 'Medium' ELSE 'Info' END AS severity FROM e")
def _(ev):
    return TL.timeline(ev, D.log_clearing(ev).unionByName(D.service_installs(ev))).select("event_row_id", "description", "severity")


@query("set1_related_ids", " SELECT DISTINCT row_id FROM e WHERE event_id IN (7045, 104, 1102, 22)")
def _(ev):
    none = ev.limit(0).select(F.array("row_id").alias("related_event_row_ids"))
    single = ev.where("event_id = 22").select(F.col("row_id").alias("event_row_id"))
    return TL.related_row_ids(D.log_clearing(ev).unionByName(D.service_installs(ev)), none, single, single, single)


#: Events that the detectors of groups look at.
GROUP_EVENT_IDS = (4624, 4625, 4648, 4720, 4728, 4732, 4756, 4769, 4771, 4776)


def grouped_findings(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of groups and the events of each."""
    ev = stored(ev.where(once(F.col("event_id")).isin(*GROUP_EVENT_IDS)), "events")
    # One plan a detector: planning all at once takes much of the driver's memory.
    parts = [stored(f(ev, SETTINGS), "group-findings") for f in (D.failed_logons, D.successful_logons, D.rdp_activity, D.brute_force, D.password_spray, D.kerberos_bursts, D.new_users)]
    found = reduce(DataFrame.unionByName, parts)
    return found, finding_events(ev, found, SETTINGS)


@query("w11_group_events")
def _(ev):
    return grouped_findings(ev)[1]


@query("jn1b_group_timeline")
def _(ev):
    found, members = grouped_findings(ev)
    return TL.timeline(ev, found, members=members).select("event_row_id", "severity")


@query("cor1b_compromised_account_events")
def _(ev):
    return C.compromised_account_events(ev, 10 * DAY)


@query("set1b_group_related_ids")
def _(ev):
    found, members = grouped_findings(ev)
    single = ev.limit(0).select(F.col("row_id").alias("event_row_id"))
    every = members.select("row_id").unionByName(C.compromised_account_events(ev, 10 * DAY).select("row_id"))
    return TL.related_row_ids(found, C.compromised_account(ev, 10 * DAY), single, single, single, every)


# Exports.

@query("snk1_export_findings", " SELECT 'Medium' AS Severity, row_id AS EventRow, strftime(time_created_utc, '%Y-%m-%d %H:%M:%S') AS TimeUtc, computer_name AS Host, user_name AS User, log_name AS Channel, process_path AS Image, CAST(row_id AS VARCHAR) AS RelatedEventRowIds, 'yes' AS SeverityMatchesEvent FROM e WHERE event_id = 7045")
def _(ev):
    d = X.export_findings(N.hydrate(D.service_installs(ev), ev))
    return d.select("Severity", F.col("RelatedEventRowIds").cast("bigint").alias("EventRow"), "TimeUtc", "Host", "User", "Channel", "Image", "RelatedEventRowIds", "SeverityMatchesEvent")


@query("snk2_export_timeline", f" SELECT strftime(time_created_utc, '%Y-%m-%d %H:%M:%S') AS TimestampUtc, row_id AS EventRowId, computer_name AS Host, event_id AS EventId, coalesce(process_name, '') AS Process, coalesce(source_ip, '') AS Ip, 'Info' AS Severity FROM e")
def _(ev):
    t = TL.timeline(ev, D.log_clearing(ev).limit(0))
    return X.export_timeline(t).select("TimestampUtc", "EventRowId", "Host", "EventId", "Process", "Ip", "Severity")


@query("snk3_export_events", " SELECT row_id AS EventRowId, strftime(time_created_utc, '%Y-%m-%d %H:%M:%S') AS TimeCreatedUtc, coalesce(command_line, '') AS CommandLine, logon_type AS LogonType, CASE WHEN p_status IS NOT NULL THEN '{\"status\":\"' || p_status || '\"}' ELSE '' END AS PropertiesJson FROM e WHERE p_membername IS NULL AND p_servicename IS NULL")
def _(ev):
    d = ev.where(F.try_element_at("properties", F.lit("membername")).isNull() & F.try_element_at("properties", F.lit("servicename")).isNull())
    return X.export_events(d).select("EventRowId", "TimeCreatedUtc", "CommandLine", "LogonType", "PropertiesJson")


@query("snk4_export_statistics", " SELECT section, key, CAST(value AS VARCHAR) AS value FROM (" + top_sql("Summary", "'TotalEvents'", None) + " UNION ALL " + top_sql("EventIdCounts", "CAST(event_id AS VARCHAR)", 30) + ") UNION ALL SELECT 'Filter', k, CASE k WHEN 'User' THEN 'bob' ELSE '' END FROM (SELECT unnest(['User', 'IpAddress', 'ProcessName', 'Keyword', 'ComputerName', 'LogName', 'FromUtc', 'ToUtc', 'EventIds']) AS k)")
def _(ev):
    return X.export_statistics(S.statistics(ev).where("section in ('Summary', 'EventIdCounts')"), L.EventFilter(user="bob"))


# The same exports over the whole job; tests hold them against brute force.

@query("snk3b_export_all_events")
def _(ev):
    return X.export_events(ev).select("EventRowId", "TimeCreatedUtc", "CommandLine", "LogonType", "PropertiesJson")


@query("snk4b_export_all_statistics")
def _(ev):
    ev = stored(ev, "events")  # every detector reads it
    return X.export_statistics(S.statistics(ev, run_detectors(ev, SETTINGS, ordered=False, whole=True)), L.EventFilter(user="bob"))
