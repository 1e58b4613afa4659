"""Readers of event exports, indicator feeds, catalogues and rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..operators.filters import EventFilter, filter_events
from ..operators.intel import SUPPORTED_TYPES
from ..operators.normalize import normalize_xml
from ..operators.sigma import LEVELS, FieldMatch, Rule, Selection


def read_event_xml(spark: SparkSession, path: str, f: EventFilter = EventFilter(), whole_files: bool = True) -> DataFrame:
    """Events from exported XML, one document a file (or a line); broken ones give no row."""
    raw = spark.read.text(path, wholetext=whole_files).select(F.col("value").alias("raw_xml"))
    each = F.regexp_extract_all("raw_xml", F.lit(r"(?s)<Event[\s>].*?</Event>"), F.lit(0))
    # A text that is one event from end to end, as most lines are, is not searched by the expression.
    one = (F.startswith("raw_xml", F.lit("<Event ")) | F.startswith("raw_xml", F.lit("<Event>"))) & (F.instr("raw_xml", "</Event>") == F.char_length("raw_xml") - 7)
    found = raw.select("raw_xml", F.when(one, F.array("raw_xml")).otherwise(each).alias("found"))
    raw = found.select(F.explode_outer(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array("raw_xml"))).alias("raw_xml"))
    return filter_events(normalize_xml(raw), f)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day; with ``overwrite`` only the days that occur are replaced.

    Ranges of day and time: a large day is several tasks and files, a file holds few days.
    """
    writer = events.repartitionByRange("event_date", "time_created_utc").sortWithinPartitions("event_date", "time_created_utc").write.mode(mode).partitionBy("event_date")
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(path)


def read_events(spark: SparkSession, path: str, f: EventFilter = EventFilter()) -> DataFrame:
    return filter_events(spark.read.parquet(path), f)


def read_ioc_json(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.json(path, schema="type string, value string, comment string, source string", multiLine=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    ok = (F.trim("type") != "") & (F.trim("value") != "") & F.lower(F.trim("type")).isin(*SUPPORTED_TYPES)
    return d.select(F.lower(F.trim("type")).alias("type"), F.trim("value").alias("value"), "comment", F.coalesce("source", name).alias("source")).where(ok)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.btrim("value", F.lit(WHITE)).alias("line"))


def _feed(d: DataFrame, kind, value, source: str) -> DataFrame:
    return d.select(kind.alias("type"), value.alias("value"), F.lit(source).alias("source"), F.lit(source).alias("comment")).where(F.coalesce(F.trim("value"), F.lit("")) != "")


def read_ioc_text(spark: SparkSession, path: str, kind: str, source: str) -> DataFrame:
    """One indicator a line; rows of a hosts file give their name, as a domain where addresses are listed."""
    d = _lines(spark, path).where((F.col("line") != "") & ~F.substring("line", 1, 1).isin("#", ";", "/"))
    parts = F.filter(F.split("line", " "), lambda p: F.trim(p) != "")
    hosts = (F.startswith("line", F.lit("127.0.0.1")) | F.startswith("line", F.lit("0.0.0.0"))) & (F.size(parts) >= 2)
    text = F.when(hosts, F.trim(F.get(parts, F.lit(1)))).otherwise(F.col("line"))
    value = F.get(F.split(text, r"[ \t,;]"), F.lit(0))
    return _feed(d, F.when(hosts & F.lit(kind == "ip"), F.lit("domain")).otherwise(F.lit(kind)), value, source)


def read_ioc_url_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The first URL of each line, and its host if that has a dot."""
    d = spark.read.text(path).select(F.col("value").alias("line")).where(~F.startswith("line", F.lit("#")) & (F.char_length("line") >= 8))
    d = d.select(F.regexp_extract("line", r'(?i)https?://[^,"]+', 0).alias("url")).where("url <> ''")
    host = F.try_parse_url("url", F.lit("HOST"))
    pairs = F.array_compact(F.array(F.struct(F.lit("url").alias("k"), F.col("url").alias("v")), F.when(host.contains("."), F.struct(F.lit("domain").alias("k"), host.alias("v")))))
    d = d.select(F.explode(pairs).alias("p"))
    return _feed(d, F.col("p.k"), F.col("p.v"), source)


def read_ioc_cidr_ndjson(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The first address of each network; lines that are no JSON are skipped."""
    d = spark.read.text(path).select(F.from_json("value", "cidr string").alias("j"))
    return _feed(d.where("j.cidr is not null"), F.lit("ip"), F.get(F.split("j.cidr", "/"), F.lit(0)), source)


def read_ioc_mixed(spark: SparkSession, path: str, source: str) -> DataFrame:
    d = _lines(spark, path).where((F.col("line") != "") & ~F.substring("line", 1, 1).isin("#", ";"))
    line = F.col("line")
    kind = (
        F.when(line.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ip").when(line.rlike("^[A-Fa-f0-9]{32}$|^[A-Fa-f0-9]{40}$|^[A-Fa-f0-9]{64}$"), "hash")
        .when(line.rlike("(?i)^https?://"), "url").otherwise("domain")
    )
    return _feed(d, kind, line, source)


def read_cve_catalog(spark: SparkSession, path: str) -> DataFrame:
    fields = "cveID string, vendorProject string, product string, vulnerabilityName string, dateAdded string, shortDescription string, requiredAction string, dueDate string, knownRansomwareCampaignUse string, notes string"
    d = spark.read.json(path, schema=f"vulnerabilities array<struct<{fields.replace(' string', ':string')}>>", multiLine=True).select(F.explode("vulnerabilities").alias("v")).select("v.*")
    day = lambda c: F.try_to_date(F.col(c)) if hasattr(F, "try_to_date") else F.col(c).try_cast("date")
    return d.select(
        F.upper(F.trim("cveID")).alias("cve_id"), F.col("vendorProject").alias("vendor_project"), "product", F.col("vulnerabilityName").alias("vulnerability_name"), day("dateAdded").alias("date_added"),
        F.col("shortDescription").alias("short_description"), F.col("requiredAction").alias("required_action"), day("dueDate").alias("due_date"), F.col("knownRansomwareCampaignUse").alias("known_ransomware_use"), "notes",
    ).where(F.coalesce(F.col("cve_id"), F.lit("")) != "")


def read_attack_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(techniques, tactics) of a bundle; revoked and deprecated techniques are left out."""
    schema = (
        "objects array<struct<type:string, name:string, description:string, x_mitre_shortname:string, revoked:boolean, x_mitre_deprecated:boolean, "
        "external_references:array<struct<source_name:string, external_id:string, url:string>>, kill_chain_phases:array<struct<kill_chain_name:string, phase_name:string>>>>"
    )
    d = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("objects").alias("o")).select("o.*")
    reference = F.get(F.filter("external_references", lambda r: F.lower(r["source_name"]) == "mitre-attack"), F.lit(0))
    d = d.withColumn("r", reference).where("r.external_id is not null")
    tactics = d.where("type = 'x-mitre-tactic'").select(F.col("r.external_id").alias("tactic_id"), "name", F.lower("x_mitre_shortname").alias("short_name"), F.col("r.url").alias("url"))
    live = ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    names = F.array_distinct(F.transform(F.coalesce("kill_chain_phases", F.array().cast("array<struct<kill_chain_name:string,phase_name:string>>")), lambda p: F.lower(p["phase_name"])))
    techniques = d.where((F.col("type") == "attack-pattern") & live).select(F.upper("r.external_id").alias("technique_id"), "name", F.col("r.url").alias("url"), names.alias("tactic_short_names"))
    return techniques, tactics


def read_event_titles(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, schema="channel string, event_id string, title string", header=True)
    return d.select(F.trim("channel").alias("channel"), F.trim("event_id").try_cast("int").alias("event_id"), F.trim("title").alias("title")).where("event_id is not null and title <> ''")


def read_field_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, leaf): the last part of the dotted path that an alias stands for."""
    d = spark.read.csv(path, schema="alias string, path string", header=True)
    return d.select(F.trim("alias").alias("alias"), F.regexp_extract(F.trim("path"), r"([^.]*)$", 1).alias("leaf")).where("alias <> '' and leaf <> ''")


# Rules are settings: many small texts that are parsed where the query is made.

_MODIFIERS = {"contains": "contains", "startswith": "startswith", "endswith": "endswith", "re": "re", "regex": "re"}


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _fields(table: dict, strict: bool) -> Selection:
    out = []
    for key, value in table.items():
        parts = [p.strip().lower() for p in str(key).split("|")]
        if not parts[0]:
            continue
        every = not strict and "all" in parts[2:]
        named = "|".join(parts[1:]) if strict else next((p for p in parts[1:] if p != "all"), "")
        values = () if value is None else (value,) if isinstance(value, str) else tuple(t for t in map(_text, value) if t.strip()) if isinstance(value, list) else (_text(value),)
        out.append(FieldMatch(str(key).split("|")[0].strip(), values, _MODIFIERS.get(named, "equals"), every))
    return Selection(fields=tuple(out))


def _selection(value, strict: bool) -> Selection:
    if isinstance(value, str):
        return Selection(keywords=(value,))
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return Selection(keywords=tuple(value))
    if isinstance(value, dict):
        return _fields(value, strict)
    if isinstance(value, list) and not strict and all(isinstance(v, dict) for v in value):
        return Selection(options=tuple(_fields(v, strict) for v in value))
    return Selection()


def _sound(s: Selection) -> bool:
    """Whether the patterns of a selection can be compiled, so that a broken one costs its rule and not the job."""
    try:
        for f in s.fields:
            for v in f.values if f.modifier == "re" else ():
                re.compile(v)
    except re.error:
        return False
    return all(map(_sound, s.options))


def parse_rules(text: str, source: str = "", strict: bool = True) -> list[Rule]:
    """Rules of a YAML text with any number of documents; broken ones are skipped.

    ``strict`` keeps two habits of the format's plain reading: only the first pipe of a field
    counts (so ``contains|all`` compares for equality), and a list of maps never matches.
    Without it both have their full meaning.
    """
    import yaml

    rules = []
    for document in re.split(r"(?m)^\s*---\s*$", text):
        try:
            raw = yaml.safe_load(document)
            detection, title = raw["detection"], str(raw["title"]).strip()
            source_of = {str(k).lower(): v for k, v in (raw.get("logsource") or {}).items()}
            chosen = {str(n): _selection(v, strict) for n, v in detection.items() if str(n).lower() not in ("condition", "timeframe")}
            condition = next((str(v) for n, v in detection.items() if str(n).lower() == "condition"), "")
        except (yaml.YAMLError, KeyError, TypeError, AttributeError):
            continue
        if not title or not chosen or not condition.strip() or not all(map(_sound, chosen.values())):
            continue
        level = str(raw.get("level") or "medium").strip().lower()
        get = lambda k: None if source_of.get(k) is None else str(source_of[k])  # noqa: E731, B023
        rules.append(Rule(
            title=title, condition=condition, selections=chosen, id=raw.get("id"), description=raw.get("description"), status=raw.get("status"), author=raw.get("author"),
            product=get("product"), service=get("service"), category=get("category"), severity=LEVELS.get(level, "Medium"), tags=tuple(map(str, raw.get("tags") or ())), source=source,
        ))
    return rules


def load_rules(spark: SparkSession, paths: Sequence[str], strict: bool = True) -> list[Rule]:
    """Rules of YAML files or folders of them, by Spark's readers. Rules are settings: their texts come
    to the driver, where queries are made from them."""
    texts = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("name"), "value").orderBy("name")
    return [r for t in texts.collect() for r in parse_rules(t.value, t.name.rsplit("/", 1)[-1], strict)]
