"""Detection rules with named selections and a condition, compiled to predicates.

Rules are settings and live on the driver; events are data. A rule becomes one boolean column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE
from ..schema import RANK, once
from .findings import CATEGORY_EVENT_IDS, category_sql, make_finding, sql_text

# Channels of services, and columns of field names.
SERVICE_LOGS = {
    "security": ("Security", "Безопасность"), "system": ("System", "Система"), "application": ("Application", "Приложение"),
    "powershell": ("Microsoft-Windows-PowerShell/Operational",), "sysmon": ("Microsoft-Windows-Sysmon/Operational",),
}
LEVELS = {"informational": "Info", "info": "Info", "low": "Low", "high": "High", "critical": "Critical"}
FIELD_COLUMNS = {
    "eventid": "event_id", "event.system.eventid": "event_id", "channel": "log_name", "provider": "provider_name", "computer": "computer_name", "computername": "computer_name",
    "user": "user_name", "targetusername": "target_user_name", "targetdomainname": "target_domain_name", "domain": "domain", "newprocessname": "process_path",
    "processname": "process_name", "parentimage": "parent_process_name", "parentprocessname": "parent_process_name", "commandline": "command_line",
    "parentcommandline": "parent_command_line", "processid": "process_id", "parentprocessid": "parent_process_id", "processguid": "process_guid",
    "parentprocessguid": "parent_process_guid", "ipaddress": "source_ip", "sourceip": "source_ip", "sourceipaddress": "source_ip", "destinationip": "destination_ip",
    "destinationipaddress": "destination_ip", "destinationport": "destination_port", "sourceport": "source_port", "queryname": "query_name", "scriptblocktext": "script_block",
    "scriptblock": "script_block", "hashes": "hashes", "taskname": "task_name", "servicename": "service_name", "logontype": "logon_type", "workstationname": "workstation_name",
}


@dataclass(frozen=True)
class FieldMatch:
    field: str
    values: tuple[str, ...]
    modifier: str = "equals"
    every: bool = False


@dataclass(frozen=True)
class Selection:
    keywords: tuple[str, ...] = ()
    fields: tuple[FieldMatch, ...] = ()
    options: tuple[Selection, ...] = ()


@dataclass(frozen=True)
class Rule:
    title: str
    condition: str
    selections: Mapping[str, Selection]
    id: str | None = None
    description: str | None = None
    status: str | None = None
    author: str | None = None
    product: str | None = None
    service: str | None = None
    category: str | None = None
    severity: str = "Medium"
    tags: tuple[str, ...] = ()
    source: str = ""

    @property
    def event_ids(self) -> tuple[int, ...]:
        return tuple(sorted(CATEGORY_EVENT_IDS.get((self.category or "").lower(), ())))


def select_rules(rules: Sequence[Rule], experimental: bool = False, deprecated: bool = False, unsupported: bool = False, emerging: bool = False, hunting: bool = False) -> list[Rule]:
    """Leaves out immature statuses, opt-in tags and other products."""
    barred = {s for s, on in (("experimental", experimental), ("deprecated", deprecated), ("unsupported", unsupported)) if not on}
    tags = {t for t, on in (("detection.emerging_threats", emerging), ("detection.threat_hunting", hunting)) if not on}
    return [r for r in rules if (r.status or "").lower() not in barred and not tags & {t.lower() for t in r.tags} and (not (r.product or "").strip() or r.product.lower() == "windows")]


# Predicates are SQL texts: building thousands of them call by call costs more than running them.

def _blank_sql(c: str) -> str:
    return f"coalesce(btrim({c}, {sql_text(WHITE)}) = '', true)"


def logsource_sql(rule: Rule) -> str:
    """Product, known service (by channel or provider) and category; what is unknown fits."""
    if (rule.product or "").strip() and rule.product.lower() != "windows":
        return "false"
    out = []
    service = (rule.service or "").strip().lower()
    if service in SERVICE_LOGS:
        names = [n.lower() for n in SERVICE_LOGS[service]]
        hits = [f"coalesce(contains(lower({c}), {sql_text(n)}), false)" for n in names for c in ("log_name", "provider_name")]
        if service == "sysmon":
            hits.append("coalesce(contains(lower(provider_name), 'sysmon'), false)")
        out.append("(" + " OR ".join(hits) + ")")
    ids = CATEGORY_EVENT_IDS.get((rule.category or "").lower())
    return " AND ".join([*out, category_sql(ids)] if ids else out) or "true"


def field_sql(name: str, aliases: Mapping[str, str] | None = None) -> str:
    """A field by name: an alias's target, the property bag, the typed column; blank ones are skipped.

    A dotted name is also looked for by its last part.
    """
    low, target = name.lower(), (aliases or {}).get(name.lower())
    names = [n for n in (target.lower() if target else None, low, low.rsplit(".", 1)[-1]) if n]
    options = []
    for n in dict.fromkeys(names):
        options.append(f"try_element_at(properties, {sql_text(n)})")
        if n in FIELD_COLUMNS:
            options.append(f"CAST({FIELD_COLUMNS[n]} AS STRING)")
        elif n == "image":
            options.append("coalesce(process_path, process_name)")
        elif n == "subjectusername":
            pass  # a missing property is '' and hides what would follow it
    return "coalesce(" + ", ".join(f"CASE WHEN NOT {_blank_sql(o)} THEN {o} END" for o in options) + ")"


def compare_sql(actual: str, expected: str, modifier: str) -> str:
    """Case-insensitive; a value with ``*`` is an anchored pattern whatever the modifier."""
    if "*" in expected:
        return f"rlike({actual}, {sql_text('(?id)^' + '.*'.join(map(re.escape, expected.split('*'))) + '$')})"
    if modifier == "re":
        return f"rlike({actual}, {sql_text('(?id)' + expected)})"
    value = sql_text(expected.lower())
    return f"{modifier}(lower({actual}), {value})" if modifier in ("contains", "startswith", "endswith") else f"lower({actual}) = {value}"


def keyword_blob_sql() -> str:
    columns = dict.fromkeys([*FIELD_COLUMNS.values(), "raw_xml", "process_path"])
    return "lower(concat_ws('\n', " + ", ".join(f"CAST({c} AS STRING)" for c in columns) + ", array_join(map_values(properties), '\n')))"


class Texts:
    """How a predicate writes a field's value and the text that keywords look into."""

    def __init__(self, aliases: Mapping[str, str] | None = None, named: Mapping[str, str] | None = None, blob: str | None = None):
        self.aliases, self.named, self.blob = aliases, named or {}, blob or keyword_blob_sql()

    def field(self, name: str) -> str:
        return self.named.get(name.lower()) or field_sql(name, self.aliases)


def selection_sql(s: Selection, t: Texts) -> str:
    """A keyword list needs one keyword; a field list needs every field, with any of its values."""
    if s.options:
        return "(" + " OR ".join(selection_sql(o, t) for o in s.options) + ")"
    if s.keywords:
        hits = [f"contains({t.blob}, {sql_text(k.lower())})" for k in s.keywords if k.strip()]
        return f"coalesce({' OR '.join(hits)}, false)" if hits else "false"
    out = []
    for f in s.fields:
        hits = [compare_sql(t.field(f.field), v, f.modifier) for v in f.values]
        out.append(f"coalesce({(' AND ' if f.every else ' OR ').join(hits)}, false)" if hits else "false")
    return "(" + " AND ".join(out) + ")" if out else "false"


_TOKEN = re.compile(r"\(|\)|[^\s()|]+")


def condition_sql(condition: str, selections: Mapping[str, str]) -> str:
    """and, or, not, parentheses, ``N of name*`` and ``all of name*``.

    Unknown names and ``them`` are false; what follows a pipe is not looked at.
    """
    names = {n.lower(): c for n, c in selections.items()}
    words = _TOKEN.findall(condition.split("|")[0])
    at = 0

    def group(pattern: str) -> list[str]:
        if "*" not in pattern:
            return [names[pattern.lower()]] if pattern.lower() in names else []
        fits = re.compile("^" + ".*".join(map(re.escape, pattern.split("*"))) + "$", re.I)
        return [c for n, c in selections.items() if fits.match(n)]

    def joined(word: str, next_one: Callable[[], str]) -> str:
        nonlocal at
        parts = [next_one()]
        while at < len(words) and words[at].lower() == word:
            at += 1
            parts.append(next_one())
        return parts[0] if len(parts) == 1 else "(" + f" {word.upper()} ".join(parts) + ")"

    def either() -> str:
        return joined("or", lambda: joined("and", one))

    def one() -> str:
        nonlocal at
        if at >= len(words):
            return "false"
        word = words[at].lower()
        at += 1
        if word == "not":
            return f"(NOT {one()})"
        if word == "(":
            out = either()
            if at < len(words) and words[at] == ")":
                at += 1
            return out
        if (word == "all" or word.isdigit()) and at + 1 < len(words) and words[at].lower() == "of":
            members = group(words[at + 1])
            at += 2
            if word == "all" and not members:
                return "false"
            hits = " + ".join(f"CAST({m} AS INT)" for m in members) or "0"
            return f"(({hits}) >= {len(members) if word == 'all' else int(word)})"
        return names.get(word, "true" if word == "true" else "false")

    return either() if words else "false"


def rule_sql(rule: Rule, t: Texts) -> str:
    return f"({logsource_sql(rule)} AND {condition_sql(rule.condition, {n: selection_sql(s, t) for n, s in rule.selections.items()})})"


def rule_predicate(rule: Rule, aliases: Mapping[str, str] | None = None) -> Column:
    return F.expr(rule_sql(rule, Texts(aliases)))


def attack_tags(tags: Sequence[str]) -> tuple[str | None, str | None, list[str]]:
    """(First tactic, first technique, all attack tags)."""
    own = list({t.lower(): t for t in reversed([t for t in tags if t.lower().startswith("attack.")])}.values())[::-1]
    is_technique = re.compile(r"^attack\.t\d+", re.I)
    return next((t for t in own if not is_technique.match(t)), None), next((t for t in own if is_technique.match(t)), None), own


def _fields_of(s: Selection) -> set[str]:
    return {f.field.lower() for f in s.fields}.union(*map(_fields_of, s.options))


def match_rules(events: DataFrame, rules: Sequence[Rule], aliases: Mapping[str, str] | None = None, batch: int = 100, detailed: bool = False) -> DataFrame:
    """Events with the rules that they match: the event's columns, ``rule_no`` and, if ``detailed``,
    ``fits`` (whether the category does) and ``detail`` (see ``match_detail``).

    Rules are grouped by their event ids, so each group first cuts the events down; a group is cut
    into batches, so that no expression grows too large. A batch is one scan, whatever its rules: each
    field that they ask for is worked out once, details for what matches alone. Nothing is shuffled.
    """
    groups: dict[tuple[int, ...], list[int]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(r.event_ids, []).append(i)

    def hit(i: int, t: Texts) -> str:
        r, told = rules[i], f"'rule_no', {i}"
        if detailed:
            ids = CATEGORY_EVENT_IDS.get((r.category or r.service or "").lower())
            told += f", 'fits', coalesce({category_sql(ids) if ids else 'true'}, false), 'detail', {detail_sql(r, t)}"
        return f"CASE WHEN {rule_sql(r, t)} THEN named_struct({told}) END"

    out = None
    for ids, members in sorted(groups.items()):
        some = events.where(F.col("event_id").isin(*ids)) if ids else events
        for k in range(0, len(members), batch):
            part = members[k : k + batch]
            selections = [s for i in part for s in rules[i].selections.values()]
            named = {n: f"_f{j}" for j, n in enumerate(sorted(set().union(*map(_fields_of, selections))))}
            made = {c: once(F.expr(field_sql(n, aliases))) for n, c in named.items()}
            if any(s.keywords or s.options for s in selections):
                made["_blob"] = once(F.expr(keyword_blob_sql()))
            t = Texts(aliases, named, "_blob")
            hits = F.expr("array_compact(array(" + ", ".join(hit(i, t) for i in part) + "))")
            d = some.withColumns(made).withColumn("_hits", once(hits)).withColumn("_hit", F.explode("_hits"))
            d = d.select("*", "_hit.*").drop("_hits", "_hit", *made)
            out = d if out is None else out.unionByName(d)
    return out if out is not None else events.withColumn("rule_no", F.lit(0)).limit(0)


DESCRIBE = {"contains": "contains", "startswith": "startswith", "endswith": "endswith", "re": "matches", "equals": "equals"}


def detail_sql(rule: Rule, t: Texts) -> str:
    names, fields, values, parts = [], [], [], []
    for name, s in rule.selections.items():
        hit = selection_sql(s, t)
        names.append(f"CASE WHEN {hit} THEN {sql_text(name)} END")
        for f in s.fields:
            actual = t.field(f.field)
            expected = "coalesce(" + "".join(f"CASE WHEN {compare_sql(actual, v, f.modifier)} THEN {sql_text(v)} END, " for v in f.values) + "CAST(NULL AS STRING))"
            ok = f"{hit} AND {expected} IS NOT NULL"
            fields.append(f"CASE WHEN {ok} THEN {sql_text(f.field)} END")
            values.append(f"CASE WHEN {ok} THEN {actual} END")
            head = sql_text(f'{f.field} {DESCRIBE[f.modifier]} "')
            parts.append(f"CASE WHEN {ok} THEN concat({head}, {expected}, '\" (actual=\"', {actual}, '\")') END")
    pack = lambda xs: "array_compact(array(" + ", ".join(xs) + "))" if xs else "CAST(array() AS ARRAY<STRING>)"
    chosen, condition = pack(names), sql_text(f'condition="{rule.condition}"')
    head = f"concat({condition}, CASE WHEN size({chosen}) > 0 THEN concat('; matchedSelection=', array_join({chosen}, ',')) ELSE '' END)"
    return f"named_struct('selections', {chosen}, 'fields', {pack(fields)}, 'values', {pack(values)}, 'reason', concat_ws('; ', {head}, {pack(parts)}))"


def match_detail(rule: Rule, aliases: Mapping[str, str] | None = None) -> Column:
    """struct(selections, fields, values, reason) of an event that matches the rule."""
    return F.expr(detail_sql(rule, Texts(aliases)))


def sigma_findings(events: DataFrame, rules: Sequence[Rule], aliases: Mapping[str, str] | None = None, batch: int = 25) -> DataFrame:
    """Findings with the rule's severity, tags and what matched.

    Events are scanned once for each batch of rules; what is the same for all matches of a rule comes
    from a table of the rules, which is broadcast (rules are settings that the driver holds).
    """
    if not rules:
        return make_finding(events.limit(0), "SigmaRules", "", 0)
    d = match_rules(events, rules, aliases, batch, detailed=True)
    kinds = {"r_no": "int", "r_id": "string", "r_title": "string", "r_rank": "int", "r_text": "string", "r_head": "string", "r_status": "string", "r_condition": "string", "r_tactic": "string", "r_technique": "string", "r_tags": "array<string>"}
    told = []
    for i, r in enumerate(rules):
        tactic, technique, tags = attack_tags(r.tags)
        text = r.description if (r.description or "").strip() else f"Sigma rule matched ({r.id or r.source})."
        head = f"sigmaId={r.id or ''}; status={r.status or ''}; tags={', '.join(r.tags[:8])}; reason="
        told.append((i, r.id or r.source, f"[Sigma] {r.title}", RANK[r.severity], text, head, r.status, r.condition, tactic, technique, tags))
    table = events.sparkSession.createDataFrame(told, ", ".join(f"{n} {t}" for n, t in kinds.items()))
    d = d.join(F.broadcast(table), F.col("rule_no") == F.col("r_no"))
    c = F.col
    return make_finding(
        d, "SigmaRules", c("r_title"), c("r_rank"), c("r_text"), F.concat("r_head", "detail.reason"), rule_id=c("r_id"), category_fits=c("fits"),
        extra={
            "mitre_tactic": c("r_tactic"), "mitre_technique": c("r_technique"), "mitre_tags": c("r_tags"), "mitre_url": F.lit(None).cast("string"), "sigma_id": c("r_id"), "sigma_status": c("r_status"),
            "matched_selection": F.array_join("detail.selections", ","), "matched_fields": c("detail.fields"), "matched_values": c("detail.values"), "condition": c("r_condition"), "reason": c("detail.reason"),
        },
    )


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i, r.id, r.title, RANK[r.severity], r.severity, *attack_tags(r.tags)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, title string, severity_rank int, severity string, mitre_tactic string, mitre_technique string, mitre_tags array<string>")
