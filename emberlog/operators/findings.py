"""The common finding row: classification of events and validation of severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, hash_value
from ..schema import RANK, first_prop, is_sysmon, micros, prop, severity_name

# Event ids of each category, in order of choice.
CATEGORY_EVENT_IDS = {
    "process_creation": (1, 4688), "process_termination": (5, 4689), "network_connection": (3,), "dns_query": (22,), "registry_event": (12, 13, 14),
    "registry_add": (12,), "registry_delete": (12,), "registry_set": (13,), "registry_rename": (14,), "file_event": (11,), "file_change": (2,),
    "file_delete": (23, 26), "image_load": (7,), "driver_load": (6,), "create_remote_thread": (8,), "pipe_created": (17, 18), "ps_script": (4104, 4103),
    "ps_module": (4103,), "ps_classic_start": (400, 600), "service_start": (7036,), "firewall_as": (2004, 2005, 2006, 2009),
    "authentication": (4624, 4625, 4648, 4771, 4776), "account_management": (4720, 4722, 4723, 4724, 4725, 4726, 4728, 4732, 4756),
    "privilege_escalation": (4672, 4673, 4674), "log_clearing": (104, 1102), "task_scheduler": (4698, 4699, 4700, 4701, 4702),
    "service_installation": (4697, 7045), "wmi_event": (5857, 5858, 5859, 5860, 5861), "raw_access_thread": (9,), "clipboard_capture": (24,), "file_access": (25,),
}
SYSMON_EVENT_IDS = (1, 2, 3, 5, 6, 7, 8, 9, 11, 12, 13, 14, 17, 18, 22, 23, 24, 25, 26)
CONTENT_DRIVEN = (
    "CredentialAccess", "DefenseEvasion", "PersistenceAndLolbin", "MalwareBehavior", "LateralMovementAndDiscovery", "SecurityPolicyChange",
    "SigmaRules", "SuspiciousPowerShell", "SuspiciousProcessCreation", "SuspiciousScheduledTask",
)
BEHAVIORAL = ("BruteForce", "KerberosAndDirectoryAttack", "LogClearing", "PrivilegeChange", "NewUser")
#: Highest severity that the event alone supports; others reach High.
CEILINGS = {"Critical": (1102, 5001, 4662), "Medium": (4625, 4771, 4776, 4624, 4648)}


def provider_has(text: str) -> Column:
    return F.coalesce(F.lower("provider_name").contains(text.lower()), F.lit(False))


def sql_text(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _provider_sql(text: str) -> str:
    return f"coalesce(contains(lower(provider_name), {sql_text(text.lower())}), false)"


def _ids_sql(ids: tuple[int, ...]) -> str:
    return f"event_id IN ({', '.join(map(str, ids))})"


def category_sql(ids: tuple[int, ...]) -> str:
    return (
        f"({_ids_sql(ids)} AND (NOT {_ids_sql(SYSMON_EVENT_IDS)} OR {_provider_sql('sysmon')}) AND (event_id <> 104 OR {_provider_sql('eventlog')}) "
        f"AND (event_id NOT IN (4103, 4104) OR {_provider_sql('powershell')}))"
    )


def satisfies_category(ids: tuple[int, ...]) -> Column:
    return F.expr(category_sql(ids))


# Long case chains are one SQL text each: building them call by call costs more than running them.
CLASSIFY_SQL = "CASE " + " ".join(f"WHEN {category_sql(ids)} THEN '{name}'" for name, ids in CATEGORY_EVENT_IDS.items()) + " END"


def classify_event() -> Column:
    """The first category whose ids and provider fit, else null."""
    return F.expr(CLASSIFY_SQL)


def category_matches(category: str | None) -> Column:
    """Unknown and blank categories fit every event."""
    ids = CATEGORY_EVENT_IDS.get((category or "").lower())
    return satisfies_category(ids) if ids else F.lit(True)


def declared_ids_sql(ids: tuple[int, ...]) -> str:
    if not ids:
        return "true"
    return f"({_ids_sql(ids)} AND (event_id <> 1 OR {_provider_sql('sysmon')}) AND (event_id <> 104 OR {_provider_sql('eventlog')}) AND (event_id NOT IN (4103, 4104) OR {_provider_sql('powershell')}))"


def severity_ceiling() -> Column:
    eid = F.col("event_id")
    out = F.when((eid == 1) & ~is_sysmon(), RANK["Info"]).when((eid == 104) & provider_has("eventlog"), RANK["High"])
    out = out.when((eid.isin(4103, 4104) & provider_has("powershell")) | is_sysmon(), RANK["Critical"])
    for name, ids in CEILINGS.items():
        out = out.when(eid.isin(*ids), RANK[name])
    return out.otherwise(RANK["High"])


def validated_severity(requested: Column, rule: str | Column, category_fits: Column | None = None) -> Column:
    """The severity that stands: up to Medium as asked; Medium if the category or event is too weak;
    as asked for rules that judge content or behaviour; else at most the event's ceiling."""
    weak = (F.col("event_id") == 1) & ~is_sysmon()
    if category_fits is not None:
        weak = weak | ~category_fits
    strong = (F.lit(rule) if isinstance(rule, str) else rule).isin(*CONTENT_DRIVEN, *BEHAVIORAL)
    return F.when(requested <= RANK["Medium"], requested).when(weak, F.lit(RANK["Medium"])).when(strong, requested).otherwise(F.least(requested, severity_ceiling()))


#: What a grouped detector carries along of its primary event.
PRIMARY = (
    "row_id", "event_id", "provider_name", "log_name", "computer_name", "user_name", "domain", "target_user_name", "target_domain_name", "process_name",
    "process_path", "source_ip", "time_created_utc",
)


def make_finding(
    df: DataFrame, rule: str, title: Column | str, severity: Column | int, description: Column | str = "", details: Column | str = "",
    rule_id: Column | str | None = None, related: Column | None = None, count: Column | None = None, group_key: Column | None = None,
    first_us: Column | None = None, last_us: Column | None = None, category_fits: Column | None = None, named: Column | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Finding rows from rows that have the primary event's columns.

    ``related`` holds at most a few ids; all events of a group are found by ``group_key`` and the
    times (see ``plans.analyze.finding_events``). The primary id comes first if it is absent.
    ``named`` gives the rule's name by row, and severities are validated by it; ``extra`` adds columns.
    """
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    asked = F.lit(severity) if isinstance(severity, int) else severity
    stands = validated_severity(asked, named if named is not None else rule, category_fits)
    ids = related if related is not None else F.array("row_id")
    ids = F.when(F.array_contains(ids, F.col("row_id")), ids).otherwise(F.concat(F.array("row_id"), ids))
    ids = F.filter(F.array_distinct(ids), lambda i: i > 0)
    return df.select(
        (named if named is not None else F.lit(rule)).alias("rule_name"),
        F.coalesce(lit(rule_id) if rule_id is not None else F.lit(rule), F.lit(rule)).alias("rule_id"),
        lit(title).alias("title"), lit(description).alias("description"),
        stands.cast("int").alias("severity_rank"), severity_name(stands).alias("severity"),
        F.when(stands < asked, asked).cast("int").alias("requested_severity_rank"),
        (stands == asked).alias("severity_matches_event"), classify_event().alias("event_type"),
        F.col("time_created_utc").alias("time_utc"), "computer_name", F.coalesce("target_user_name", "user_name").alias("user_name"),
        "source_ip", F.coalesce("process_name", "process_path").alias("process_name"), "event_id", F.col("row_id").alias("event_row_id"),
        lit(details).alias("details"), ids.alias("related_event_row_ids"),
        (count if count is not None else F.lit(1)).cast("bigint").alias("n_related"),
        (group_key if group_key is not None else F.lit(None)).cast("string").alias("group_key"),
        (first_us if first_us is not None else micros()).alias("first_us"), (last_us if last_us is not None else micros()).alias("last_us"),
        *(c.alias(n) for n, c in (extra or {}).items()),
    )


def finding_context() -> Column:
    """The context of a finding, from the columns of its event."""
    full = lambda *cs: F.coalesce(*(F.when(~blank(c), c) for c in cs))
    raw = F.to_json(F.struct(
        F.col("row_id").alias("id"), F.col("computer_name").alias("computerName"), F.col("log_name").alias("logName"), F.col("provider_name").alias("providerName"),
        F.col("event_id").alias("eventId"), F.col("event_record_id").alias("eventRecordId"), F.date_format("time_created_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'").alias("timeCreatedUtc"),
        F.col("user_name").alias("user"), "domain", F.col("target_user_name").alias("targetUserName"), F.col("process_name").alias("processName"),
        F.col("process_path").alias("processPath"), F.col("process_id").alias("processId"), F.col("command_line").alias("commandLine"), F.col("source_ip").alias("sourceIpAddress"),
        F.col("destination_ip").alias("destinationIpAddress"), F.col("logon_type").alias("logonType"), "properties",
    ))
    fields = {
        "timestamp_utc": F.col("time_created_utc"), "event_id": F.when(F.col("event_id") > 0, F.col("event_id")), "event_record_id": F.col("event_record_id"),
        "provider": F.col("provider_name"), "channel": F.col("log_name"), "host": F.col("computer_name"), "domain": F.coalesce("target_domain_name", "domain"),
        "user": F.coalesce("target_user_name", "user_name"), "user_sid": full(prop("TargetUserSid"), prop("SubjectUserSid"), prop("SecurityUserId")),
        "logon_id": full(prop("TargetLogonId"), prop("SubjectLogonId")), "process_id": F.col("process_id"), "parent_process_id": F.col("parent_process_id"),
        "process_name": F.col("process_name"), "image": F.coalesce("process_path", "process_name"), "command_line": F.col("command_line"),
        "parent_image": full(prop("ParentImage"), F.col("parent_process_name")), "parent_command_line": F.col("parent_command_line"),
        "working_directory": prop("CurrentDirectory"), "integrity_level": prop("IntegrityLevel"), "elevation_type": full(prop("ElevatedToken"), prop("ElevationType")),
        "file_path": full(prop("TargetFilename"), F.col("process_path"), prop("ObjectName"), prop("Image")), "original_file_name": prop("OriginalFileName"),
        "signer": full(prop("Signature"), prop("Signer")), "sha256": hash_value(F.col("hashes"), "SHA256"), "md5": hash_value(F.col("hashes"), "MD5"),
        "source_ip": F.col("source_ip"), "source_port": F.col("source_port"), "destination_ip": F.col("destination_ip"), "destination_port": F.col("destination_port"),
        "raw_xml": F.col("raw_xml"), "raw_event": raw, "event_type": classify_event(),
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def hydrate(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Adds the context of each finding's event; blank columns of the finding are filled from it.

    Only events that findings refer to are shuffled, and their context is made after the join.
    """
    first = F.coalesce(F.when(F.col("event_row_id") > 0, F.col("event_row_id")), F.get("related_event_row_ids", F.lit(0)))
    ids = findings.select(first.alias("_row")).where("_row is not null").distinct()
    side = events.join(ids, F.col("row_id") == F.col("_row"), "left_semi").select(F.col("row_id").alias("_row"), finding_context().alias("context"))
    d = findings.join(side, first == F.col("_row"), "left").drop("_row")
    fill = lambda c, f: F.when(~blank(F.col(c)), F.col(c)).otherwise(F.col(f"context.{f}"))
    filled = {"computer_name": fill("computer_name", "host"), "user_name": fill("user_name", "user"), "source_ip": fill("source_ip", "source_ip"), "process_name": fill("process_name", "process_name")}
    return d.withColumns(filled | {"time_utc": F.coalesce("time_utc", "context.timestamp_utc"), "event_type": F.coalesce("event_type", "context.event_type")})
