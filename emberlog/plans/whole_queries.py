"""Queries over all detectors, chains and grouped findings together, with their SQL put together from its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import stats as S
from ..operators import timeline as TL
from ..operators.findings import hydrate
from ..operators.sigma import sigma_findings
from ..operators.signature_catalog import CATALOGS, Signature
from ..sources import sinks as X
from ..storage import stored
from .analyze import finding_events
from .queries import DAY, FAILURE_SQL, HOUR, ORACLES, PREFIX, RULES_SQL, SETTINGS, greedy_sql, largest_sql, query, rules, shown, signature_sql, top_sql

# All detectors.

SHOWN = ("d5_privilege_change", "d6_process_creation", "d7_powershell", "d9_scheduled_task", "d10_service_install", "d12_log_clearing", "d20_dns_tunnelling")
GROUPED = ("d1_failed_logon", "d2_successful_logon", "d3_brute_force", "d4_new_user", "d11_rdp")


def part(sql: str, n_related: str, rule_name: str = "rule_id") -> str:
    return f"SELECT {rule_name} AS rule_name, rule_id, title, severity, event_row_id, CAST({n_related} AS BIGINT) AS n_related FROM ({sql})"


ALL_DETECTORS = " UNION ALL ".join([
    *(part(ORACLES[n], "1") for n in SHOWN), *(part(ORACLES[n], "n_related") for n in GROUPED),
    part(ORACLES["d3c_password_spray"].replace(str(DAY), str(SETTINGS.burst_window_us)), "n_related"),
    part(PREFIX + largest_sql("SELECT * FROM e WHERE event_id = 4771", SETTINGS.burst_window_us, "n >= 4", D.PRE_AUTH_BURST), "n_related"),
    part(PREFIX + largest_sql("SELECT * FROM e WHERE event_id = 4769", SETTINGS.burst_window_us, "n >= 5 AND services >= 3", D.ROASTING_BURST), "n_related"),
    *(part(PREFIX + signature_sql(signatures), "1", f"'{name}'") for name, signatures in CATALOGS.items()),
])
ORACLES["d22_all_detectors"] = ALL_DETECTORS

# Signatures of a user's own rule, which no content or behaviour backs: the event's ceiling holds.
OWN = (
    Signature("Y-1", "Critical logon", "Critical", (4624, 4625), any=("user1",)), Signature("Y-2", "Critical clearing", "Critical", (1102,), provider="eventlog"),
    Signature("Y-3", "High service", "High", (7045,), all=("svc-",)), Signature("Y-4", "Critical task", "Critical", (4698,), any=("labtask",)), Signature("Y-5", "Critical process", "Critical", (1,), any=("whoami",)),
)


@query("d14b_validated_signatures", signature_sql(OWN).replace("'Critical logon' AS title, 'Critical'", "'Critical logon' AS title, 'Medium'").replace("'Critical task' AS title, 'Critical'", "'Critical task' AS title, 'High'"))
def _(ev):
    return shown(D.signature_findings(ev, {"Custom": OWN}))


# All chains.

def at_window(name: str, own: int) -> str:
    return f"SELECT * FROM ({ORACLES[name].replace(str(own), str(2 * HOUR)).replace(chr(39).join(['replace(x.target_user_name, ', 'user', ', ', 'new', ')']), 'x.target_user_name')})"


ORACLES["cor7_all_chains"] = " UNION ALL ".join(at_window(n, w) for n, w in (
    ("cor1_compromised_account", 10 * DAY), ("cor2_suspicious_account", 12 * HOUR), ("cor3_task_persistence", HOUR // 6), ("cor4_script_to_network", 3 * DAY), ("cor5_remote_logon", 12 * HOUR), ("cor6_service_process", 2 * HOUR)))


# Grouped findings: every event of a group counts.

MEMBERS_SQL = greedy_sql(FAILURE_SQL, "account, ip", 3 * DAY, "en - rn + 1 >= 4") + f""", won AS (SELECT h.account, h.ip, h.start_rn, arg_min(s.row_id, (s.us, s.row_id)) AS s_row FROM h JOIN e s ON s.event_id = 4624 AND s.account = h.account AND s.ip = h.ip AND s.us BETWEEN h.last_us AND h.last_us + {3 * DAY} GROUP BY h.account, h.ip, h.start_rn),
 bursts AS (SELECT g.account, g.ip, g.rn AS start_rn, g.en, CASE WHEN s_row IS NULL THEN 2 ELSE 3 END AS rank, s_row FROM g LEFT JOIN won ON won.account = g.account AND won.ip = g.ip AND won.start_rn = g.rn),
 many AS (SELECT account, ip FROM e WHERE event_id = 4625 GROUP BY account, ip HAVING count(*) >= 3),
 told AS (SELECT f.row_id, b.rank FROM bursts b JOIN f ON f.account = b.account AND f.ip = b.ip AND f.rn BETWEEN b.start_rn AND b.en UNION ALL SELECT s_row, rank FROM bursts WHERE s_row IS NOT NULL
  UNION ALL SELECT e.row_id, 1 FROM e JOIN many m ON m.account = e.account AND m.ip = e.ip WHERE e.event_id = 4625 UNION ALL SELECT row_id, CASE event_id WHEN 1102 THEN 4 ELSE 3 END FROM e WHERE event_id IN (104, 1102)),
 highest AS (SELECT row_id, max(rank) AS rank FROM told GROUP BY row_id)"""


def grouped_and_single(ev):
    """Failed logons, bursts and log clearing, and all events of their groups."""
    ev = stored(ev, "events")
    found = stored(D.failed_logons(ev).unionByName(D.brute_force(ev, SETTINGS)).unionByName(D.log_clearing(ev)), "grouped-and-single")
    return found, finding_events(ev, found, SETTINGS)


@query("jn1c_timeline_of_groups", MEMBERS_SQL + " SELECT e.row_id AS event_row_id, CASE coalesce(rank, 0) WHEN 0 THEN 'Info' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END AS severity FROM e LEFT JOIN highest USING (row_id)")
def _(ev):
    found, members = grouped_and_single(ev)
    return TL.timeline(ev, found, members=members).select("event_row_id", "severity")


@query("set1c_related_ids_of_groups", MEMBERS_SQL + " SELECT row_id FROM highest")
def _(ev):
    found, members = grouped_and_single(ev)
    none = ev.limit(0).select(F.array("row_id").alias("related_event_row_ids"))
    single = ev.limit(0).select(F.col("row_id").alias("event_row_id"))
    return TL.related_row_ids(found, none, single, single, single, members.select("row_id"))


# Exports of whole tables.

BAG_SQL = "nullif(concat_ws(',', " + ", ".join(f"'\"{p}\":\"' || replace(p_{p}, '\\', '\\\\') || '\"'" for p in ("targetusername", "membername", "status", "ticketencryptiontype", "servicename")) + "), '')"
ORACLES["snk3b_export_all_events"] = PREFIX + f" SELECT row_id AS EventRowId, strftime(time_created_utc, '%Y-%m-%d %H:%M:%S') AS TimeCreatedUtc, coalesce(command_line, '') AS CommandLine, logon_type AS LogonType, coalesce('{{' || {BAG_SQL} || '}}', '') AS PropertiesJson FROM e"


@query("snk4c_export_sections", " SELECT section, key, CAST(value AS VARCHAR) AS value FROM (" + " UNION ALL ".join([
    top_sql("EventIdCounts", "CAST(event_id AS VARCHAR)", 30), top_sql("UserCounts", "coalesce(user_name, target_user_name, '(unknown)')", 20), top_sql("ProcessCounts", "process_name", 20, "process_name IS NOT NULL"),
    top_sql("SourceIpCounts", "source_ip", 20, "source_ip IS NOT NULL"), top_sql("EventsByHour", "lpad(CAST(hour(time_created_utc) AS VARCHAR), 2, '0') || ':00'", None), top_sql("Summary", "'TotalEvents'", None),
]) + ")")
def _(ev):
    return X.export_statistics(S.statistics(ev))


# Rules with all that matched, and what of it is exported.

RULE_MATCH_SQL = (
    " SELECT 'r1' AS rule_id, row_id AS event_row_id, 'selection and not filter' AS condition, 'selection' AS selections, 'Image' AS fields, process_path AS vals FROM e WHERE " + RULES_SQL[0]
    + " UNION ALL SELECT 'r3', row_id, 'words', 'words', '', '' FROM e WHERE " + RULES_SQL[2]
)


@query("sig9b_rule_matches", RULE_MATCH_SQL)
def _(ev):
    f = sigma_findings(ev, rules()).where("rule_id in ('r1', 'r3')")
    return f.select("rule_id", "event_row_id", "condition", F.col("matched_selection").alias("selections"), F.array_join("matched_fields", ",").alias("fields"), F.array_join("matched_values", ",").alias("vals"))


@query("snk1b_export_rule_findings", f" SELECT rule_id AS RuleId, CAST(event_row_id AS VARCHAR) AS RelatedEventRowIds, condition AS Condition, selections AS MatchedSelection, fields AS MatchedFields, vals AS MatchedValues, rule_id AS SigmaId, CASE rule_id WHEN 'r1' THEN 'attack.discovery' ELSE '' END AS MitreTactic FROM ({RULE_MATCH_SQL})")
def _(ev):
    f = sigma_findings(ev, rules()).where("rule_id in ('r1', 'r3')")
    return X.export_findings(hydrate(f, ev)).select("RuleId", "RelatedEventRowIds", "Condition", "MatchedSelection", "MatchedFields", "MatchedValues", "SigmaId", "MitreTactic")
