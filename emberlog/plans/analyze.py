"""The whole analysis of an event table: detectors, enrichment, chains, indicators and a summary."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.accounts import account_key, ip_key, is_machine_account
from ..operators.correlate import all_chains, compromised_account_events
from ..operators.detectors import (
    DETECTORS, KERBEROS, LOGON_TYPES, MINUTE, PRE_AUTH_BURST, ROASTING_BURST, SPRAYING, Settings, has_user, is_failure, is_kerberoast, new_user_additions, ticket_account,
    ticket_source,
)
from ..operators.findings import hydrate, make_finding
from ..operators.intel import enrich_attack, match_cves, match_indicators
from ..operators.sigma import Rule, sigma_findings
from ..operators.stats import severity_summary
from ..operators.timeline import related_row_ids, timeline
from ..schema import micros
from ..storage import stored

log = logging.getLogger(__name__)

Detector = Callable[[DataFrame, Settings], DataFrame]


def run_detectors(
    events: DataFrame, settings: Settings = Settings(), detectors: dict[str, Detector] | None = None, rules: Sequence[Rule] = (), ordered: bool = True, isolated: bool = True, whole: bool = False,
) -> DataFrame:
    """All findings, the most severe first (if ``ordered``).

    ``isolated`` runs each detector as a job of its own and writes its findings, so one that fails,
    when it is planned or when it runs, is logged and left out. Otherwise all are one plan. Findings
    do not show what was left out: with ``whole`` the first failure is raised under the detector's name.
    """
    todo = dict(detectors or DETECTORS)
    if rules:
        todo["rules"] = lambda ev, _: sigma_findings(ev, rules)
    parts = []
    for name, detector in todo.items():
        try:
            found = detector(events, settings)
            parts.append(stored(found, f"findings-{name}") if isolated else found)
        except Exception as e:
            if whole:
                raise RuntimeError(f"detector {name} failed") from e
            log.exception("detector %s failed", name)
    if not parts:
        return make_finding(events.limit(0), "None", "", 0)
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return found if not ordered else found.orderBy(F.col("severity_rank").desc(), "time_utc", "event_row_id", "rule_id", "title")


def finding_events(events: DataFrame, findings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(rule_name, title, group_key, first_us, severity_rank, row_id): every event of the grouped findings.

    Rows of findings keep a few ids; this side table has all of them, by a join on the group's key
    and times, so no list grows with the group. Bursts of a key are joined by time bucket too, so an
    event meets its own bursts alone. A new account's group is named by the id of its creation.
    """
    account = F.concat_ws("|", account_key(), ip_key())
    logon_type = F.col("logon_type").cast("string")
    ticket = F.concat_ws("|", F.lower(ticket_account()), F.lower(ticket_source()))
    failure, person = is_failure() & has_user(), ~is_machine_account()
    rule, title = F.col("rule_name"), F.col("title")
    whole = {
        "FailedLogon": (rule == "FailedLogon", (F.col("event_id") == 4625) & has_user(), account),
        "RdpActivity": (rule == "RdpActivity", (F.col("event_id") == 4624) & (F.col("logon_type") == 10) & person, account),
        "SuccessfulLogon": (rule == "SuccessfulLogon", (F.col("event_id") == 4624) & F.col("logon_type").isin(*LOGON_TYPES) & person, F.concat_ws("|", account_key(), logon_type, ip_key())),
    }
    bursts = {
        "spray": ((rule == "BruteForce") & (title == SPRAYING), failure, ip_key()),
        "burst": ((rule == "BruteForce") & (title != SPRAYING), failure, account),
        "pre_auth": ((rule == KERBEROS) & (title == PRE_AUTH_BURST), F.col("event_id") == 4771, ticket),
        "roasting": ((rule == KERBEROS) & (title == ROASTING_BURST), is_kerberoast(), ticket),
    }
    kinds = whole | bursts
    bucket = lambda us: F.floor(us / settings.burst_window_us).cast("bigint")
    mine = F.array_compact(F.array(*(F.when(fits, F.struct(F.lit(kind).alias("kind"), key.alias("k"))) for kind, (_, fits, key) in kinds.items())))
    members = events.select(micros().alias("us"), "row_id", F.explode(mine).alias("m")).select("us", "row_id", "m.*")
    members = members.withColumn("bucket", F.when(F.col("kind").isin(*bursts), bucket(F.col("us"))).otherwise(0))
    kind = F.coalesce(*(F.when(of, F.lit(name)) for name, (of, _, _) in kinds.items()))
    out = ("rule_name", "title", "group_key", "first_us", "severity_rank", "row_id")
    groups = findings.where("group_key is not null").select(kind.alias("kind"), F.col("group_key").alias("k"), "group_key", "rule_name", "title", "severity_rank", "first_us", "last_us")
    spans = F.when(F.col("kind").isin(*bursts), F.sequence(bucket(F.col("first_us")), bucket(F.col("last_us")))).otherwise(F.array(F.lit(0).cast("bigint")))
    grouped = members.join(groups.withColumn("bucket", F.explode(spans)), ["kind", "k", "bucket"]).where(F.col("us").between(F.col("first_us"), F.col("last_us"))).select(*out)
    created = findings.where(rule == "NewUser").select("rule_name", "title", F.col("event_row_id").cast("string").alias("group_key"), "first_us", "severity_rank", F.col("event_row_id").alias("row_id"))
    added = new_user_additions(events, settings, of=created).drop("row_id").withColumnRenamed("g_row", "row_id")
    return grouped.unionByName(added.select(*out))


def analyze(
    events: DataFrame, iocs: DataFrame, cves: DataFrame, techniques: DataFrame | None = None, tactics: DataFrame | None = None, rules: Sequence[Rule] = (),
    settings: Settings = Settings(), window_us: int = 10 * MINUTE, whole: bool = True,
) -> dict[str, DataFrame]:
    """All tables of an investigation. Findings are written once, as several parts read them; the caller may
    persist ``events``, which every part reads. A detector that fails is raised; unless ``whole``, it is logged
    and left out."""
    findings = hydrate(run_detectors(events, settings, rules=rules, whole=whole), events)
    if techniques is not None and tactics is not None and "mitre_technique" in findings.columns:
        findings = enrich_attack(findings, techniques, tactics)
    chains, ioc, cve = all_chains(events, window_us), match_indicators(events, iocs), match_cves(events, cves)
    findings = stored(findings, "findings")
    members = finding_events(events, findings, settings)
    every = members.select("row_id").unionByName(compromised_account_events(events, window_us).select("row_id"))
    return {
        "findings": findings, "finding_events": members, "correlations": chains, "ioc_matches": ioc, "cve_matches": cve,
        "timeline": timeline(events, findings, members=members), "related": related_row_ids(findings, chains, ioc, cve, findings, every), "summary": severity_summary(findings, chains, ioc, cve),
    }
