"""Export rows and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import export_bool, export_cell, export_list, export_time
from ..schema import severity_name


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _ids(c: str) -> Column:
    return export_list(F.transform(F.col(c), lambda i: i.cast("string")), ", ")


def export_findings(findings: DataFrame) -> DataFrame:
    """The 59 columns of exported findings; ``findings`` are hydrated (they have ``context``)."""
    x = lambda f: F.col(f"context.{f}")
    o = lambda name, kind="string": _optional(findings, name, kind)
    cell = export_cell
    rows = {
        "Severity": cell(F.col("severity")), "FindingId": o("finding_id", "bigint"), "RuleName": cell(F.col("rule_name")), "RuleId": cell(F.col("rule_id")), "RuleTitle": cell(F.col("title")), "Title": cell(F.col("title")),
        "Category": cell(F.col("rule_name")), "EventType": cell(F.col("event_type")), "CategoryMatchesEvent": export_bool(F.lit(True)), "SeverityMatchesEvent": export_bool(F.col("severity_matches_event")),
        "RequestedSeverity": cell(severity_name(F.col("requested_severity_rank"))), "TimeUtc": export_time(F.coalesce(x("timestamp_utc"), "time_utc")), "CreatedUtc": export_time(o("created_utc", "timestamp")),
        "Host": cell(F.coalesce(x("host"), "computer_name")), "Domain": cell(x("domain")), "User": cell(F.coalesce(x("user"), "user_name")), "UserSid": cell(x("user_sid")), "LogonId": cell(x("logon_id")),
        "EventId": F.coalesce(x("event_id"), "event_id"), "EventRecordId": x("event_record_id"), "Provider": cell(x("provider")), "Channel": cell(x("channel")), "ProcessId": x("process_id"), "ParentProcessId": x("parent_process_id"),
        "ProcessName": cell(F.coalesce(x("process_name"), "process_name")), "Image": cell(x("image")), "CommandLine": cell(x("command_line")), "ParentImage": cell(x("parent_image")), "ParentCommandLine": cell(x("parent_command_line")),
        "WorkingDirectory": cell(x("working_directory")), "IntegrityLevel": cell(x("integrity_level")), "ElevationType": cell(x("elevation_type")), "SourceIp": cell(F.coalesce(x("source_ip"), "source_ip")), "SourcePort": x("source_port"),
        "DestinationIp": cell(x("destination_ip")), "DestinationPort": x("destination_port"), "FilePath": cell(x("file_path")), "Sha256": cell(x("sha256")), "Md5": cell(x("md5")), "Signer": cell(x("signer")),
        "OriginalFileName": cell(x("original_file_name")), "SigmaId": cell(o("sigma_id")), "SigmaStatus": cell(o("sigma_status")), "MitreTactic": cell(o("mitre_tactic")), "MitreTechnique": cell(o("mitre_technique")),
        "MitreTechniqueName": cell(o("mitre_technique_name")), "MitreTacticName": cell(o("mitre_tactic_name")), "MitreUrl": cell(o("mitre_url")), "MitreTags": export_list(o("mitre_tags", "array<string>")),
        "MatchedSelection": cell(o("matched_selection")), "MatchedFields": export_list(o("matched_fields", "array<string>")), "MatchedValues": export_list(o("matched_values", "array<string>")), "Condition": cell(o("condition")),
        "Reason": cell(o("reason")), "Description": cell(F.col("description")), "Details": cell(F.col("details")), "RelatedEventRowIds": _ids("related_event_row_ids"), "RawEvent": cell(x("raw_event")), "RawXml": cell(x("raw_xml")),
    }
    return findings.select(*(c.alias(n) for n, c in rows.items()))


def export_timeline(t: DataFrame) -> DataFrame:
    return t.select(
        export_time(F.col("time_utc")).alias("TimestampUtc"), F.col("event_row_id").alias("EventRowId"), export_cell(F.col("computer_name")).alias("Host"), F.col("event_id").alias("EventId"), export_cell(F.col("source")).alias("Source"),
        export_cell(F.col("user_name")).alias("User"), export_cell(F.col("process_name")).alias("Process"), export_cell(F.col("ip")).alias("Ip"), export_cell(F.col("description")).alias("Description"), export_cell(F.col("severity")).alias("Severity"),
    )


_MATCH = {"EventId": "event_id", "EventRowId": "event_row_id", "Host": "computer_name", "RelatedProcess": "related_process", "RelatedUser": "related_user", "MatchedField": "matched_field"}


def _matches(df: DataFrame, own: dict[str, str]) -> DataFrame:
    cols = [(n, F.col(c) if c in ("event_id", "event_row_id") else export_cell(F.col(c))) for n, c in (own | _MATCH).items()]
    return df.select(*(c.alias(n) for n, c in cols), export_time(F.col("time_utc")).alias("TimestampUtc"))


def export_iocs(df: DataFrame) -> DataFrame:
    return _matches(df, {"IocType": "ioc_type", "IocValue": "ioc_value"})


def export_cves(df: DataFrame) -> DataFrame:
    return _matches(df, {"CveId": "cve_id", "VulnerabilityName": "vulnerability_name", "ShortDescription": "short_description", "VendorProject": "vendor_project", "Product": "product", "KnownRansomwareUse": "known_ransomware_use"})


def export_correlations(df: DataFrame) -> DataFrame:
    cell = lambda c: export_cell(F.col(c))
    return df.select(
        cell("severity").alias("Severity"), cell("scenario").alias("Scenario"), cell("title").alias("Title"), export_time(F.col("time_utc")).alias("TimeUtc"), cell("user_name").alias("User"), cell("source_ip").alias("SourceIpAddress"),
        cell("computer_name").alias("ComputerName"), cell("details").alias("Details"), _ids("related_event_row_ids").alias("RelatedEventRowIds"),
    )


EVENT_EXPORT = {
    "EventRowId": "row_id", "TimeCreatedUtc": "time_created_utc", "ComputerName": "computer_name", "LogName": "log_name", "ProviderName": "provider_name", "EventId": "event_id", "EventRecordId": "event_record_id", "Level": "level",
    "User": "user_name", "Domain": "domain", "TargetUserName": "target_user_name", "TargetDomainName": "target_domain_name", "ProcessName": "process_name", "ProcessPath": "process_path", "ProcessId": "process_id",
    "ParentProcessName": "parent_process_name", "ParentProcessId": "parent_process_id", "ParentCommandLine": "parent_command_line", "CommandLine": "command_line", "SourceIpAddress": "source_ip", "DestinationIpAddress": "destination_ip",
    "SourcePort": "source_port", "DestinationPort": "destination_port", "WorkstationName": "workstation_name", "LogonType": "logon_type", "ScriptBlock": "script_block", "ScriptBlockHash": "script_block_hash", "Hashes": "hashes",
    "ProcessGuid": "process_guid", "ParentProcessGuid": "parent_process_guid", "QueryName": "query_name", "TaskName": "task_name", "ServiceName": "service_name", "PropertiesJson": "properties", "RawXml": "raw_xml",
}


def export_events(events: DataFrame) -> DataFrame:
    kinds = dict(events.dtypes)

    def shown(c: str) -> Column:
        if c == "properties":
            return F.when(F.coalesce(F.size(F.map_keys(c)), F.lit(0)) > 0, export_cell(F.to_json(c))).otherwise(F.lit(""))
        if kinds[c] == "timestamp":
            return export_time(F.col(c))
        return export_cell(F.col(c)) if kinds[c] == "string" else F.col(c)

    return events.select(*(shown(c).alias(n) for n, c in EVENT_EXPORT.items()))


SECTION_ORDER = ("Summary", "Filter", "FindingsBySeverity", "EventIdCounts", "UserCounts", "ProcessCounts", "SourceIpCounts", "EventsByHour")


def export_statistics(stats: DataFrame, f=None) -> DataFrame:
    """Statistics as text rows in order of section; a filter adds a section of its own."""
    rows = stats.select("section", export_cell(F.col("key")).alias("key"), F.col("value").cast("string").alias("value"))
    if f is not None:
        named = [("User", f.user), ("IpAddress", f.ip), ("ProcessName", f.process), ("Keyword", f.keyword), ("ComputerName", f.host), ("LogName", f.log), ("FromUtc", f.start), ("ToUtc", f.end), ("EventIds", ", ".join(map(str, f.event_ids)))]
        told = [("Filter", k, "" if v is None else f"{v:%Y-%m-%d %H:%M:%S}" if hasattr(v, "year") else str(v)) for k, v in named]
        rows = rows.unionByName(stats.sparkSession.createDataFrame(told, "section string, key string, value string"))
    place = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("section"))
    return rows.orderBy(place, F.when(F.col("section") == "EventsByHour", F.col("key")), F.col("value").try_cast("bigint").desc_nulls_last(), "key")


def write_investigation(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """One folder for each table; JSON leaves null fields out and has camel-case names."""
    for name, df in tables.items():
        if fmt == "json":
            df = df.select(*(F.col(c).alias(c[:1].lower() + c[1:]) for c in df.columns))
        elif fmt == "csv":
            df = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{path}/{name}")
