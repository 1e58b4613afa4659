"""Timelines, and the events that results refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import severity_name
from .filters import EventFilter, fetch_by_row_ids, filter_events
from .normalize import describe


def row_severities(findings: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(row_id, severity_rank): the highest severity of any finding that refers to an event.

    Findings of groups list a few events; ``members`` (row_id, severity_rank) has all of them.
    """
    told = findings.select(F.explode("related_event_row_ids").alias("row_id"), "severity_rank")
    if members is not None:
        told = told.unionByName(members.select("row_id", "severity_rank"))
    return told.groupBy("row_id").agg(F.max("severity_rank").alias("severity_rank"))


def timeline(events: DataFrame, findings: DataFrame, f: EventFilter = EventFilter(), titles: DataFrame | None = None, limit: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """Events in order of time with a description and the severity of findings (Info if none)."""
    d = describe(filter_events(events, f), titles).join(row_severities(findings, members), "row_id", "left")
    rank = F.coalesce("severity_rank", F.lit(0))
    out = d.select(
        F.col("time_created_utc").alias("time_utc"), F.col("row_id").alias("event_row_id"), "computer_name", "event_id", F.coalesce("provider_name", "log_name").alias("source"),
        F.coalesce("user_name", "target_user_name").alias("user_name"), "process_name", F.col("source_ip").alias("ip"), "description", severity_name(rank).alias("severity"), rank.alias("severity_rank"),
    ).orderBy("time_utc", "event_row_id")
    return out if limit is None else out.limit(limit)


def related_row_ids(findings: DataFrame, correlations: DataFrame, ioc_matches: DataFrame, cve_matches: DataFrame, items: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """All event ids that some result refers to, each once; ``members`` (row_id) has those of groups and chains."""
    exploded = lambda df: df.select(F.explode("related_event_row_ids").alias("row_id"))
    single = lambda df: df.select(F.col("event_row_id").alias("row_id"))
    ids = exploded(findings).unionByName(exploded(correlations)).unionByName(single(ioc_matches)).unionByName(single(cve_matches)).unionByName(single(items))
    if members is not None:
        ids = ids.unionByName(members.select("row_id"))
    return ids.where("row_id > 0").distinct()


def related_events(events: DataFrame, ids: DataFrame) -> DataFrame:
    return fetch_by_row_ids(events, ids)
