"""Registered queries of exports of matches and chains, look-ups, older scores and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate as C
from ..operators import intel as I
from ..operators import merge as M
from ..sources import sinks as X
from ..storage import new_path
from ..streaming import jobs as J
from .adapter import log_events
from .ingest_queries import arrived
from .queries import DAY, HOUR, ORACLES, PREFIX, indicator_list, query, table

SHOWN_TIME = "strftime(e.time_created_utc, '%Y-%m-%d %H:%M:%S')"


@query("snk2b_export_indicators", PREFIX + f"""SELECT i.ioc_type AS IocType, i.ioc_value AS IocValue, e.event_id AS EventId, e.row_id AS EventRowId, e.computer_name AS Host, coalesce(e.process_name, '') AS RelatedProcess,
 coalesce(e.user_name, e.target_user_name, '') AS RelatedUser, i.matched_field AS MatchedField, {SHOWN_TIME} AS TimestampUtc FROM ({ORACLES["ioc3_matches"]}) i JOIN e ON e.row_id = i.event_row_id""", bare=True)
def _(spark, sf_dir):
    return X.export_iocs(I.match_indicators(log_events(spark, sf_dir), indicator_list(spark, sf_dir)))


def catalogue(spark, sf_dir):
    """A CVE for each customer; events name one of them."""
    c = table(spark, sf_dir, "customer").select(F.format_string("CVE-2024-%04d", "c_custkey").alias("cve_id"), F.col("c_name").alias("vulnerability_name"), F.col("c_mktsegment").alias("vendor_project"))
    return c.withColumns({"short_description": F.concat(F.lit("a\tb "), "cve_id"), "product": F.lit(None).cast("string"), "known_ransomware_use": F.lit("Known")})


CATALOGUE_SQL = "cves AS (SELECT printf('CVE-2024-%04d', c_custkey) AS cve_id, c_name, c_mktsegment FROM customer)"


@query("snk2c_export_cves", PREFIX + f""", {CATALOGUE_SQL}, m AS (SELECT e.*, regexp_extract(lower(concat_ws('|', command_line, script_block)), 'cve-[0-9]+-[0-9]+') AS named FROM e)
 SELECT cve_id AS CveId, c_name AS VulnerabilityName, 'a b ' || cve_id AS ShortDescription, c_mktsegment AS VendorProject, '' AS Product, 'Known' AS KnownRansomwareUse, e.event_id AS EventId, e.row_id AS EventRowId, computer_name AS Host,
 coalesce(process_name, process_path, '') AS RelatedProcess, coalesce(target_user_name, user_name, '') AS RelatedUser, CASE WHEN contains(lower(command_line), named) THEN 'CommandLine' ELSE 'ScriptBlock' END AS MatchedField, {SHOWN_TIME} AS TimestampUtc
 FROM m e JOIN cves ON lower(cve_id) = named WHERE named <> ''""", bare=True)
def _(spark, sf_dir):
    return X.export_cves(I.match_cves(log_events(spark, sf_dir), catalogue(spark, sf_dir)))


@query("snk2d_export_chains", PREFIX + f"""SELECT c.severity AS Severity, c.scenario AS Scenario, coalesce(c.user_name, '') AS User, c.computer_name AS ComputerName, replace(c.ids, ',', ', ') AS RelatedEventRowIds,
 strftime(max(e.time_created_utc), '%Y-%m-%d %H:%M:%S') AS TimeUtc FROM ({ORACLES["cor5_remote_logon"]}) c JOIN e ON list_contains(string_split(c.ids, ','), CAST(e.row_id AS VARCHAR)) GROUP BY ALL""", bare=True)
def _(spark, sf_dir):
    rows = X.export_correlations(C.remote_logon_to_process(log_events(spark, sf_dir), 12 * HOUR))
    return rows.select("Severity", "Scenario", "User", "ComputerName", "RelatedEventRowIds", "TimeUtc")


@query("jn3b_find_cve", f"WITH {CATALOGUE_SQL} SELECT cve_id, c_name AS vulnerability_name FROM cves WHERE cve_id IN ('CVE-2024-0007', 'CVE-2024-0042')", bare=True)
def _(spark, sf_dir):
    known = catalogue(spark, sf_dir)
    return I.find_cve(known, " cve-2024-0007 ").unionByName(I.find_cve(known, "CVE-2024-0042")).select("cve_id", "vulnerability_name")


@query("mrg2b_legacy_score", """ SELECT row_id, 3 + least(20, length(coalesce(repeat(command_line, 1 + row_id % 90), '')) // 128) AS score FROM e""")
def _(ev):
    """Rows that kept their bag as text, of very different lengths."""
    old = ev.withColumn("properties_json", F.expr("repeat(command_line, int(1 + row_id % 90))")).withColumn("completeness_score", F.lit(3))
    return old.select("row_id", M.legacy_score().cast("long").alias("score"))


@query("str3b_sessions", f""", f AS (SELECT account, ip, us, CASE WHEN us - lag(us) OVER (PARTITION BY account, ip ORDER BY us) < {DAY} THEN 0 ELSE 1 END AS fresh FROM e WHERE event_id = 4625),
 g AS (SELECT account, ip, us, sum(fresh) OVER (PARTITION BY account, ip ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM f)
 SELECT account, ip, CAST(min(us) AS BIGINT) AS start_us, CAST(max(us) + {DAY} AS BIGINT) AS end_us, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY account, ip, session HAVING count(*) >= 3""")
def _(ev):
    """Failures without a quiet day between them; an event far ahead closes the last ones."""
    spark, target, source = ev.sparkSession, new_path(ev.sparkSession, "sessions"), arrived(ev)
    closing = spark.read.parquet(source).limit(1).withColumns({"event_id": F.lit(4625), "target_user_name": F.lit("closing"), "time_created_utc": F.to_timestamp(F.lit("2999-01-01"))})
    found = J.failed_logon_sessions(J.stream_events(spark, source), 3, "1 day", "30 days")
    for _ in range(2):
        found.writeStream.format("parquet").option("checkpointLocation", f"{target}_at").trigger(availableNow=True).start(target).awaitTermination()
        closing.write.mode("append").parquet(source)
    return spark.read.schema(found.schema).parquet(target).select("account", "ip", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


# Every failure of the window that a chain begins with, the logon and the privileges: the chain's own tables, and another end.
_steps, _end, _ = ORACLES["cor1_compromised_account"].rpartition(" SELECT 'FailedLogonsThenPrivilegedSuccess'")
assert _end, "the chain's SQL has another end"
ORACLES["cor1b_compromised_account_events"] = _steps + """, z AS (SELECT y.*, w.en FROM y JOIN w ON w.row_id = y.row_id WHERE p_row IS NOT NULL QUALIFY row_number() OVER (PARTITION BY y.key ORDER BY y.us, y.rn) = 1)
 SELECT 'FailedLogonsThenPrivilegedSuccess' AS scenario, key, row_id FROM (SELECT z.key, n.row_id FROM z JOIN n ON n.key = z.key AND n.rn BETWEEN z.rn AND z.en UNION ALL SELECT key, unnest([s_row, p_row]) FROM z)"""
