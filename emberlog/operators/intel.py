"""Indicators, exploited vulnerabilities and attack techniques, matched against events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import WHITE, normalize_tactic, normalize_technique_id
from .containment import containing

# Types that are taken, what they stand for, and the tools that are always looked for.
SUPPORTED_TYPES = ("ip", "ipv4", "ipv6", "domain", "hash", "sha256", "sha1", "md5", "filename", "file", "url", "user")
TYPE_NAMES = {"ipv4": "ip", "ipv6": "ip", "ipaddress": "ip", "sha256": "hash", "sha1": "hash", "md5": "hash", "file": "filename", "name": "filename"}
FEED_TYPE_NAMES = TYPE_NAMES | {"host": "domain", "fqdn": "domain", "hostname": "domain"}
BUILT_IN_FILES = (
    ("mimikatz.exe", "Credential dumping tool name"), ("procdump.exe", "Sysinternals dump utility often abused post-compromise"),
    ("psexec.exe", "Remote execution utility frequently used for lateral movement"), ("psexesvc.exe", "PsExec service binary"), ("lazagne.exe", "Credential recovery tool"),
    ("rubeus.exe", "Kerberos attack toolkit name"), ("sharphound.exe", "AD collection utility"), ("bloodhound.exe", "AD graphing utility"), ("seatbelt.exe", "Host recon utility"),
    ("safetykatz.exe", "Credential dumping variant name"), ("nanodump.exe", "LSASS dump utility name"), ("cobain.exe", "Known infostealer name"),
    ("beacon.exe", "Generic C2 beacon filename (high FP — corroborate)"), ("kportscan.exe", "Port scanner"), ("nbtscan.exe", "Network scanner"), ("adfind.exe", "AD enumeration utility"),
    ("wce.exe", "Windows Credential Editor"), ("pwdump.exe", "Password hash dump utility"), ("fgdump.exe", "Password hash dump utility"), ("gsecdump.exe", "Security dump utility"), ("cain.exe", "Cain & Abel"),
)


def type_name(c: Column, names: dict[str, str] = TYPE_NAMES) -> Column:
    t = F.lower(F.trim(c))
    out = t
    for k, v in names.items():
        out = F.when(t == k, F.lit(v)).otherwise(out)
    return out


def usable_indicators(iocs: DataFrame) -> DataFrame:
    """Supported types (before names are unified) with a value; one row for each (type, value)."""
    ok = (F.coalesce(F.trim("value"), F.lit("")) != "") & F.lower("type").isin(*SUPPORTED_TYPES)
    return iocs.where(F.coalesce(ok, F.lit(False))).select(type_name(F.col("type")).alias("type"), F.trim("value").alias("value")).distinct()


def built_in_indicators(spark) -> DataFrame:
    return spark.createDataFrame([("filename", f, c, "built-in") for f, c in BUILT_IN_FILES], "type string, value string, comment string, source string")


_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def is_address(c: Column) -> Column:
    """IPv4 or IPv6, neither loopback nor unspecified."""
    groups = F.filter(F.split(c, ":"), lambda g: g != "")
    six = c.contains(":") & c.rlike(r"(?i)^[0-9a-f:]+(?:\.[\d.]+)?$") & (F.size(groups) <= 8) & F.forall(groups, lambda g: g.rlike(r"(?i)^[0-9a-f]{1,4}$|^[\d.]+$")) & ~c.rlike(":::") & (c.contains("::") | (F.size(groups) == 8)) & ~c.rlike("::.*::")
    return (c.rlike(_IPV4) & ~c.startswith("127.") & (c != "0.0.0.0")) | (six & ~c.isin("::1", "::"))


def normalize_feed(rows: DataFrame) -> DataFrame:
    """Feed rows cleaned, defanged and checked; the first of each (type, value), whatever its case."""
    v = F.btrim(F.btrim(F.col("value"), F.lit(WHITE)), F.lit(",;\"'"))
    v = F.when(v.startswith("[") & v.contains("]"), F.replace(F.replace(v, F.lit("[.]"), F.lit(".")), F.lit("[://]"), F.lit("://"))).otherwise(v)
    v = F.regexp_replace(F.regexp_replace(v, "(?i)hxxp://", "http://"), "(?i)hxxps://", "https://")
    kind = type_name(F.col("type"), FEED_TYPE_NAMES)
    host = F.try_parse_url(F.btrim(v, F.lit(".")), F.lit("HOST"))
    v = F.when(kind == "domain", F.coalesce(host, F.btrim(v, F.lit(".")))).when((kind == "ip") & v.contains("/"), F.substring_index(v, "/", 1)).otherwise(v)
    d = rows.withColumn("_kind", kind).withColumn("value", v)
    x, n = F.col("value"), F.char_length("value")
    fits = (
        F.when(F.col("_kind") == "ip", is_address(x))
        .when(F.col("_kind") == "domain", x.contains(".") & ~x.contains(" ") & n.between(4, 253) & ~F.lower(x).endswith(".localhost"))
        .when(F.col("_kind") == "hash", x.rlike("^[A-Fa-f0-9]{32}$|^[A-Fa-f0-9]{40}$|^[A-Fa-f0-9]{64}$"))
        .when(F.col("_kind") == "filename", n.between(3, 128) & ~x.contains("\\") & ~x.contains("/"))
        .when(F.col("_kind") == "url", F.try_parse_url(x, F.lit("PROTOCOL")).rlike("(?i)^https?$") & F.try_parse_url(x, F.lit("HOST")).isNotNull())
        .otherwise(F.lit(False))
    )
    d = d.where(F.coalesce(fits, F.lit(False)))
    order = W.partitionBy("_kind", F.lower("value")).orderBy("source", "value")
    return d.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(F.col("_kind").alias("type"), "value", "source", "comment")


#: Fields by type in order: (name, column, by equality).
FIELDS = {
    "ip": (("SourceIpAddress", "source_ip", True), ("DestinationIpAddress", "destination_ip", True), ("RawXml", "raw_xml", False)),
    "domain": (("QueryName", "query_name", False), ("CommandLine", "command_line", False), ("ScriptBlock", "script_block", False), ("RawXml", "raw_xml", False)),
    "hash": (("Hashes", "hashes", False), ("ScriptBlockHash", "script_block_hash", True), ("CommandLine", "command_line", False), ("RawXml", "raw_xml", False)),
    "filename": (("ProcessName", "process_name", False), ("ParentProcessName", "parent_process_name", False), ("ProcessPath", "process_path", False), ("CommandLine", "command_line", False), ("ScriptBlock", "script_block", False)),
    "url": (("CommandLine/ScriptBlock", "command_line", False), ("CommandLine/ScriptBlock", "script_block", False), ("CommandLine/ScriptBlock", "raw_xml", False)),
    "user": (("User", "user_name", False), ("User", "target_user_name", False)),
}


def contains_scan(events: DataFrame, patterns: DataFrame, columns: list[str]) -> DataFrame:
    """(row_id, column, value): which lower-cased patterns each text column holds, by an index of their grams."""
    texts = events.select("row_id", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns))).alias("t"))
    texts = texts.select(F.struct("row_id", "t.column").alias("of"), F.col("t.text").alias("text")).where("text is not null")
    return containing(texts, "of", "text", patterns.select(F.col("value").alias("pattern"))).select("of.*", F.col("pattern").alias("value"))


def match_indicators(events: DataFrame, iocs: DataFrame) -> DataFrame:
    """One row for each event and indicator, with the first field that fits."""
    ind = usable_indicators(iocs).withColumn("low", F.lower("value"))
    found = None
    for kind, fields in FIELDS.items():
        for rank, (name, column, equal) in enumerate(fields):
            if not equal:
                continue
            mine = ind.where(F.col("type") == kind)
            hit = events.where(F.coalesce(F.col(column), F.lit("")) != "").select("row_id", F.lower(column).alias("low")).join(mine, "low")
            hit = hit.select("row_id", "type", "value", F.lit(rank).alias("rank"), F.lit(name).alias("field"))
            found = hit if found is None else found.unionByName(hit)
    scanned = sorted({c for f in FIELDS.values() for _, c, equal in f if not equal})
    pieces = contains_scan(events, ind, scanned)
    ranks = events.sparkSession.createDataFrame([(k, c, r, n) for k, f in FIELDS.items() for r, (n, c, equal) in enumerate(f) if not equal], "type string, column string, rank int, field string")
    held = pieces.withColumnRenamed("value", "low").join(ind, "low").join(F.broadcast(ranks), ["type", "column"]).select("row_id", "type", "value", "rank", "field")
    best = found.unionByName(held).groupBy("row_id", "type", "value").agg(F.min(F.struct("rank", "field")).alias("b"))
    about = events.select("row_id", "event_id", F.col("time_created_utc").alias("time_utc"), "computer_name", F.col("process_name").alias("related_process"), F.coalesce("user_name", "target_user_name").alias("related_user"))
    return best.join(about, "row_id").select(
        F.col("type").alias("ioc_type"), F.col("value").alias("ioc_value"), "event_id", F.col("row_id").alias("event_row_id"), "time_utc", "computer_name", "related_process", "related_user", F.col("b.field").alias("matched_field"),
    )


CVE_FIELDS = (("CommandLine", "command_line"), ("ParentCommandLine", "parent_command_line"), ("ScriptBlock", "script_block"), ("RawXml", "raw_xml"), ("PropertiesJson", None), ("ProcessPath", "process_path"), ("TaskName", "task_name"), ("ServiceName", "service_name"), ("QueryName", "query_name"))


def match_cves(events: DataFrame, cves: DataFrame) -> DataFrame:
    """One row for each event and known CVE that a field names, with the first such field."""
    text = lambda c: F.array_join(F.map_values("properties"), " ") if c is None else F.col(c)
    fields = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(n).alias("field"), text(c).alias("text")) for i, (n, c) in enumerate(CVE_FIELDS)))
    named = F.filter(fields, lambda f: F.coalesce(F.contains(F.lower(f["text"]), F.lit("cve-")), F.lit(False)))
    d = events.select("row_id", F.explode(named).alias("f"))
    ids = F.regexp_extract_all(F.col("f.text"), F.lit(r"(?i)\bCVE-\d{4}-\d{4,}\b"), F.lit(0))
    d = d.select("row_id", "f.rank", "f.field", F.explode(ids).alias("cve_id")).withColumn("cve_id", F.upper("cve_id"))
    first = d.groupBy("row_id", "cve_id").agg(F.min(F.struct("rank", "field")).alias("b"))
    about = events.select("row_id", "event_id", F.col("time_created_utc").alias("time_utc"), "computer_name", F.coalesce("process_name", "process_path").alias("related_process"), F.coalesce("target_user_name", "user_name").alias("related_user"))
    known = cves.withColumn("cve_id", F.upper("cve_id"))
    return first.join(known, "cve_id").join(about, "row_id").select(
        "cve_id", "vulnerability_name", "short_description", "vendor_project", "product", "known_ransomware_use", "event_id", F.col("row_id").alias("event_row_id"), "time_utc", "computer_name", "related_process", "related_user", F.col("b.field").alias("matched_field"),
    )


def enrich_attack(findings: DataFrame, techniques: DataFrame, tactics: DataFrame) -> DataFrame:
    """Adds technique name, tactic names and address to rows with mitre_technique, mitre_tactic and
    mitre_url; a sub-technique that is unknown takes name and address of its parent. Of rows that share
    an id the least by name stays, so that runs agree (``merge.first_per_key`` keeps a given order)."""
    names = tactics.groupBy(normalize_tactic(F.col("short_name")).alias("_short")).agg(F.min("name").alias("_tactic"))
    t = techniques.groupBy(normalize_technique_id(F.col("technique_id")).alias("_tid")).agg(F.min(F.struct("name", "url", "tactic_short_names")).alias("x"))
    t = t.select("_tid", F.col("x.name").alias("_name"), F.col("x.url").alias("_url"), "x.tactic_short_names")
    listed = t.select("_tid", F.posexplode_outer("tactic_short_names").alias("_pos", "_s")).withColumn("_short", normalize_tactic(F.col("_s"))).join(names, "_short", "left")
    listed = listed.groupBy("_tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_tactic"))), lambda x: x["_tactic"]), ", ").alias("_tactics"))
    full = t.drop("tactic_short_names").join(listed, "_tid", "left")
    parent = full.select(F.col("_tid").alias("_pid"), F.col("_name").alias("_pname"), F.col("_url").alias("_purl"))
    d = findings.withColumn("_id", normalize_technique_id(F.col("mitre_technique"))).withColumn("_up", F.when(F.col("_id").contains("."), F.substring_index("_id", ".", 1)))
    d = d.join(full, F.col("_id") == F.col("_tid"), "left").join(parent, F.col("_up") == F.col("_pid"), "left")
    d = d.join(names.select(F.col("_short").alias("_own"), F.col("_tactic").alias("_own_name")), normalize_tactic(F.col("mitre_tactic")) == F.col("_own"), "left")
    full_text = lambda c: F.when(F.trim(c) != "", F.col(c))
    out = d.withColumns({
        "mitre_technique_name": F.coalesce("_name", "_pname"), "mitre_tactic_name": F.coalesce(full_text("_tactics"), "_own_name"),
        "mitre_url": F.coalesce(full_text("mitre_url"), "_url", "_purl"),
    })
    return out.select(*(c for c in out.columns if not c.startswith("_")))


def find_techniques(techniques: DataFrame, technique: str | None = None, tactic: str | None = None) -> DataFrame:
    out = techniques
    if technique:
        out = out.where(normalize_technique_id(F.col("technique_id")) == normalize_technique_id(F.lit(technique)))
    if tactic:
        out = out.where(F.exists("tactic_short_names", lambda x: normalize_tactic(x) == normalize_tactic(F.lit(tactic))))
    return out


def find_cve(cves: DataFrame, cve_id: str) -> DataFrame:
    return cves.where(F.upper(F.trim("cve_id")) == cve_id.strip().upper())
