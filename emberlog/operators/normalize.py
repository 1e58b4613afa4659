"""Normalisation of raw records to event rows: one walk and one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.event_xml import DDL, parse_batches
from ..functions.text import WHITE, clean_text, file_name, parse_int, parse_utc, sha256_hex, split_domain_user
from ..schema import EVENT_SCHEMA, is_sysmon, once

# Level codes.
LEVELS = {"0": "LogAlways", "1": "Critical", "2": "Error", "3": "Warning", "4": "Information", "5": "Verbose"}


def level_name(code: Column) -> Column:
    t = F.trim(code)
    out = F.when(F.coalesce(t, F.lit("")) == "", F.lit("Unknown"))
    for k, v in LEVELS.items():
        out = out.when(t == k, v)
    return out.otherwise(code)


def _as_map(pairs: Column) -> Column:
    """A map from structs (k, v); of equal keys the last wins, whatever the session's policy."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def _missing_from(main: Column, extra: Column) -> Column:
    """``main`` with those entries of ``extra`` whose keys it lacks."""
    return F.map_concat(main, F.map_filter(extra, lambda k, v: ~F.map_contains_key(main, k)))


def parse_event_xml(raw: DataFrame, column: str = "raw_xml") -> DataFrame:
    """Event rows from XML texts; broken documents give no row.

    Elements and their nesting are open, which no fixed row type holds, so a tree walk of each text
    (``functions.event_xml``) runs over Arrow batches; what fields mean is column code.
    """
    d = raw.select(F.col(column).cast("string")).mapInArrow(parse_batches, DDL)
    extra = lambda name, c: F.when(c.isNotNull() & (c != ""), F.create_map(F.lit(name), c)).otherwise(F.create_map().cast("map<string,string>"))
    own = F.map_concat(extra("securityuserid", clean_text(F.col("user_id"))), extra("eventidqualifiers", F.col("qualifiers")))
    return d.select(
        "raw_xml", _missing_from(own, F.col("main")).alias("properties"), clean_text(F.col("channel")).alias("log_name"), clean_text(F.col("provider")).alias("provider_name"),
        F.coalesce(parse_int(F.col("event_id")), F.lit(0)).alias("event_id"), F.trim("record_id").try_cast("bigint").alias("event_record_id"),
        F.coalesce(parse_utc(F.col("time")), F.to_timestamp(F.lit("0001-01-01"))).alias("time_created_utc"), level_name(F.col("level")).alias("level"), clean_text(F.col("computer")).alias("computer_name"),
    )


class _Wanted:
    """The first of some properties that says something; ``aliases`` adds names to try after each.

    Properties are cleaned once: each is a place in one array, and asking for it again costs nothing.
    """

    def __init__(self, aliases: Mapping[str, Sequence[str]] | None):
        self.aliases, self.places = aliases or {}, {}

    def __call__(self, *names: str) -> Column:
        every = [n.lower() for name in names for n in (name, *self.aliases.get(name, ()))]
        return F.coalesce(*(F.get("_wanted", F.lit(self.places.setdefault(n, len(self.places)))) for n in every), F.lit(None).cast("string"))

    def column(self) -> Column:
        names = F.array(*(F.lit(n) for n in self.places))
        return once(F.transform(names, lambda n: clean_text(F.try_element_at("properties", n))))


def context_info(text: Column) -> Column:
    """A map from lines ``key = value``; keys are lower-cased, the last of equal ones wins."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.instr(x, "=") > 1)
    t = lambda c: F.btrim(c, F.lit(WHITE))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(t(F.substring_index(x, "=", 1))).alias("k"), t(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    return _as_map(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "")))


def map_fields(events: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Fills the typed columns from the property map, by provider family and event id."""
    p = _Wanted(aliases)
    eid = F.col("event_id")
    sysmon = is_sysmon()
    shell = ~sysmon & F.coalesce(F.lower("provider_name").contains("powershell"), F.lit(False))
    security = ~sysmon & ~shell
    info = F.coalesce(context_info(F.try_element_at("properties", F.lit("contextinfo"))), F.create_map().cast("map<string,string>"))
    d = events.withColumn("_info", F.when(shell, info)).withColumn("_sysmon", sysmon).withColumn("_shell", shell).withColumn("_security", security)
    sysmon, shell, security = F.col("_sysmon"), F.col("_shell"), F.col("_security")
    d = d.withColumn("properties", F.when(shell, _missing_from(F.col("properties"), F.col("_info"))).otherwise(F.col("properties")))
    at = lambda k: F.try_element_at("_info", F.lit(k))
    host_app = F.coalesce(at("host application"), at("хост-приложение"), at("приложение узла"))
    shell_user = split_domain_user(F.coalesce(at("user"), at("пользователь")))
    sysmon_user = split_domain_user(p("User"))
    logon, account = eid.isin(4624, 4625, 4634, 4647, 4648, 4776), eid.isin(4720, 4722, 4723, 4724, 4725, 4726, 4728, 4732, 4756)
    service, task = eid.isin(4697, 7045), eid.isin(4698, 4699, 4702)

    target = F.when(security & account, p("TargetUserName", "MemberName", "TargetSid")).when(security & (eid == 4688), p("TargetUserName")).otherwise(p("TargetUserName", "TargetUser", "NewAccountName"))
    target_domain = F.when(security & account, p("TargetDomainName")).otherwise(p("TargetDomainName", "TargetDomain", "TargetAccountDomain"))
    user = (
        F.when(sysmon, sysmon_user["user"])
        .when(shell, F.coalesce(shell_user["user"], p("UserId", "User")))
        .when(logon, p("TargetUserName", "SubjectUserName"))
        .when(eid.isin(4672, 4688, 4689) | task | account, p("SubjectUserName"))
        .when(service, p("SubjectUserName", "AccountName"))
        .when(eid == 1102, p("SubjectUserName", "User"))
    )
    domain = (
        F.when(sysmon, sysmon_user["domain"]).when(shell, shell_user["domain"])
        .when(logon, p("TargetDomainName", "SubjectDomainName")).when(eid.isin(4672, 4688, 1102) | account, p("SubjectDomainName"))
    )
    own_path = (
        F.when(sysmon, F.coalesce(F.when(eid == 11, p("TargetFilename")), p("Image")))
        .when(shell, host_app)
        .when(logon | (eid == 4689), p("ProcessName")).when(eid == 4688, p("NewProcessName")).when(service, p("ServiceFileName", "ImagePath"))
    )
    image = F.when(sysmon, p("Image")).otherwise(own_path)
    own_name = F.coalesce(file_name(image), image, F.when(shell, F.lit("powershell.exe")))
    general = p("NewProcessName", "ProcessName", "Image", "Application")
    parent_own = F.when(sysmon, p("ParentImage")).when(security & (eid == 4688), p("ParentProcessName"))
    parent = F.coalesce(parent_own, p("ParentProcessName", "ParentImage"))
    command = (
        F.when(sysmon, F.coalesce(F.when(eid == 13, p("TargetObject")), p("CommandLine")))
        .when(shell, F.coalesce(p("CommandLine"), host_app))
        .when(service, p("ServiceFileName", "ImagePath")).when(task, p("TaskContent", "TaskContentNew")).otherwise(p("CommandLine"))
    )
    own_pid = F.when(sysmon, p("ProcessId", "ProcessID")).when(security & logon, p("ProcessId"))
    pid = F.when(eid == 4688, parse_int(p("NewProcessId"))).otherwise(F.coalesce(parse_int(own_pid), parse_int(p("NewProcessId", "ProcessId", "ProcessID"))))
    parent_pid = F.when(eid == 4688, parse_int(p("ProcessId"))).otherwise(parse_int(p("ParentProcessId", "ParentProcessID")))
    script = p("ScriptBlockText", "Payload", "ScriptBlock")
    three = sysmon & (eid == 3)
    source = F.when(three, p("SourceIp", "SourceAddress")).otherwise(p("IpAddress", "SourceIp", "SourceAddress", "ClientAddress"))
    destination = F.when(three, p("DestinationIp", "DestinationAddress")).otherwise(p("DestAddress", "DestinationIp", "DestinationAddress"))
    made = {
        "target_user_name": target, "target_domain_name": target_domain, "workstation_name": p("WorkstationName", "Workstation", "ComputerName"),
        "source_ip": source, "destination_ip": destination, "command_line": command, "parent_command_line": p("ParentCommandLine"),
        "hashes": p("Hashes", "Hash"), "process_guid": p("ProcessGuid", "ProcessGUID"), "parent_process_guid": p("ParentProcessGuid", "ParentProcessGUID"),
        "query_name": F.when(sysmon & (eid == 22), p("QueryName")).otherwise(p("QueryName", "Query")),
        "task_name": F.when(security & task, p("TaskName")).otherwise(p("TaskName", "TaskContentName")),
        "service_name": F.when(security & service, p("ServiceName")).otherwise(p("ServiceName", "ServiceNameName")),
        "logon_type": parse_int(p("LogonType")),
        "source_port": F.when(three, parse_int(p("SourcePort"))).otherwise(parse_int(p("SourcePort", "IpPort"))),
        "destination_port": F.when(three, parse_int(p("DestinationPort"))).otherwise(parse_int(p("DestinationPort", "DestPort"))),
        "user_name": F.coalesce(user, target, p("SubjectUserName", "User", "AccountName")),
        "domain": F.coalesce(domain, target_domain, p("SubjectDomainName", "Domain", "AccountDomain")),
        "process_path": F.when(own_name.isNull(), general).otherwise(own_path),
        "process_name": F.coalesce(own_name, file_name(general), general),
        "parent_process_name": F.coalesce(file_name(parent), parent),
        "process_id": pid, "parent_process_id": parent_pid,
        "script_block": script, "script_block_hash": F.when(F.coalesce(script, F.lit("")) != "", sha256_hex(script)),
    }
    types = {f.name: f.dataType for f in EVENT_SCHEMA}
    made = {k: v.cast(types[k]).alias(k) for k, v in made.items()}
    kept = [c for c in d.columns if c not in made and not c.startswith("_")]
    return d.withColumn("_wanted", p.column()).select(*kept, *made.values())


def record_id_from_xml(raw_xml: Column) -> Column:
    return F.regexp_extract(raw_xml, r"(?i)<EventRecordID(?:\s[^>]*)?>(\d+)</EventRecordID>", 1).try_cast("bigint")


def event_key() -> Column:
    """Identity of an event: host, channel, provider, id, and record id or else time."""
    n = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    iso = F.date_format("time_created_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")
    identity = F.when(F.col("event_record_id").isNotNull(), F.concat(F.lit("record:"), F.col("event_record_id").cast("string"))).otherwise(F.concat(F.lit("time:"), iso))
    return F.concat_ws("|", n("computer_name"), n("log_name"), n("provider_name"), F.col("event_id").cast("string"), identity)


SCORED_TEXTS = (
    "computer_name", "log_name", "provider_name", "level", "user_name", "domain", "process_name", "parent_process_name", "command_line", "source_ip",
    "destination_ip", "workstation_name", "target_user_name", "target_domain_name", "script_block", "script_block_hash", "hashes", "process_guid",
    "parent_process_guid", "parent_command_line", "query_name", "task_name", "service_name", "process_path",
)
SCORED_NUMBERS = ("event_record_id", "process_id", "parent_process_id", "source_port", "destination_port", "logon_type")


def completeness_score(size_of_bag: Column | None = None) -> Column:
    texts = [F.when(F.trim(c) != "", 1).otherwise(0) for c in SCORED_TEXTS]
    numbers = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in SCORED_NUMBERS]
    bag = size_of_bag if size_of_bag is not None else F.coalesce(F.size(F.map_keys("properties")), F.lit(0))
    return sum([*texts, *numbers], F.lit(0)) + F.least(F.lit(20), bag) + F.least(F.lit(20), F.floor(F.coalesce(F.length("raw_xml"), F.lit(0)) / 256).cast("int"))


def with_identity(events: DataFrame) -> DataFrame:
    return events.withColumns({"event_key": event_key(), "completeness_score": completeness_score().cast("int"), "event_date": F.to_date("time_created_utc")})


# Phrases by event id; those of 1, 3, 5 and 22 need the Sysmon provider.
PHRASES = {
    4624: " successful logon", 4625: " failed logon", 4634: " logoff", 4647: " logoff", 4648: " explicit credentials logon", 4672: " special privileges assigned",
    4688: " process created", 4689: " process terminated", 4697: " service installed", 4698: " scheduled task created", 4702: " scheduled task updated",
    4699: " scheduled task deleted", 4720: " user account created", 4728: " group membership change", 4732: " group membership change",
    1102: " security log cleared", 4103: " PowerShell module logging", 4104: " PowerShell script block",
}
SYSMON_PHRASES = {1: " process created", 5: " process terminated", 3: " network connection", 22: " DNS query"}


def describe(events: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Adds ``description``; ``titles`` (channel, event_id, title) take the place of the built-in phrase."""
    phrase = F.lit(" event")
    for eid, text in PHRASES.items():
        phrase = F.when(F.col("event_id") == eid, F.concat(F.lit(text), F.coalesce(F.concat(F.lit(" type "), F.col("logon_type").cast("string")), F.lit(""))) if eid == 4624 else F.lit(text)).otherwise(phrase)
    for eid, text in SYSMON_PHRASES.items():
        phrase = F.when((F.col("event_id") == eid) & is_sysmon(), F.lit(text)).otherwise(phrase)
    suffix = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f" {name}="), F.col(c))).otherwise(F.lit(""))
    head = F.concat(F.coalesce("provider_name", "log_name", F.lit("Event")), F.lit(" / "), F.col("event_id").cast("string"))
    built_in = F.concat(head, phrase, suffix("user", "user_name"), suffix("proc", "process_name"), suffix("ip", "source_ip"))
    if titles is None:
        return events.withColumn("description", built_in)
    t = titles.select(F.lower(F.trim("channel")).alias("_channel"), F.col("event_id").alias("_eid"), F.col("title").alias("_title")).dropDuplicates(["_channel", "_eid"])
    joined = events.join(t, (F.lower("log_name") == F.col("_channel")) & (F.col("event_id") == F.col("_eid")), "left")
    return joined.withColumn("description", F.coalesce(F.concat(head, F.lit(" "), F.col("_title")), built_in)).drop("_channel", "_eid", "_title")


# Channel names by alias.
LOG_ALIASES = {
    "security": "Security", "безопасность": "Security", "system": "System", "система": "System", "application": "Application", "приложение": "Application",
    "powershell": "Microsoft-Windows-PowerShell/Operational", "sysmon": "Microsoft-Windows-Sysmon/Operational",
}


def resolve_log_name(c: Column, aliases: Mapping[str, str] = LOG_ALIASES) -> Column:
    out = F.trim(c)
    for k, v in aliases.items():
        out = F.when(F.lower(F.trim(c)) == k, F.lit(v)).otherwise(out)
    return out


def normalize_xml(raw: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None, column: str = "raw_xml") -> DataFrame:
    """Raw XML to keyed and scored event rows."""
    from ..schema import as_events

    return with_identity(as_events(map_fields(parse_event_xml(raw, column), aliases)))
