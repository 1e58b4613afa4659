"""Search filters as predicates, and time ranges."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_ci


@dataclass(frozen=True)
class TimeRange:
    start: dt.datetime
    end: dt.datetime


@dataclass(frozen=True)
class EventFilter:
    event_ids: Sequence[int] = ()
    user: str | None = None
    ip: str | None = None
    process: str | None = None
    host: str | None = None
    log: str | None = None
    keyword: str | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    ranges: Sequence[TimeRange] = ()
    like: bool = False


USER_COLUMNS = ("user_name", "target_user_name", "domain")
IP_COLUMNS = ("source_ip", "destination_ip", "workstation_name")
PROCESS_COLUMNS = ("process_name", "parent_process_name", "process_path", "command_line")
KEYWORD_COLUMNS = ("raw_xml", "command_line", "script_block", "process_name", "user_name", "target_user_name", "query_name", "task_name", "service_name", "hashes")


def any_contains(columns: Sequence[str | Column], needle: str, like: bool = False) -> Column:
    """Whether some column holds the text (or fits it as a LIKE pattern)."""
    out = F.lit(False)
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        hit = F.coalesce(F.ilike(c, F.lit(f"%{needle}%"), F.lit("|")), F.lit(False)) if like else contains_ci(c, needle)
        out = out | hit
    return out


def time_predicate(f: EventFilter, column: str = "time_created_utc") -> Column:
    """Ranges, closed at both ends, take the place of start and end."""
    at = lambda t: F.lit(t).cast("timestamp")
    if f.ranges:
        out = F.lit(False)
        for r in f.ranges:
            out = out | F.col(column).between(at(r.start), at(r.end))
        return out
    out = F.lit(True)
    if f.start is not None:
        out = out & (F.col(column) >= at(f.start))
    if f.end is not None:
        out = out & (F.col(column) <= at(f.end))
    return out


def event_predicate(f: EventFilter) -> Column:
    out = F.lit(True)
    if f.event_ids:
        out = out & F.col("event_id").isin(list(f.event_ids))
    for needle, columns in ((f.user, USER_COLUMNS), (f.ip, IP_COLUMNS), (f.process, PROCESS_COLUMNS), (f.host, ("computer_name",)), (f.log, ("log_name",))):
        if needle and needle.strip():
            out = out & any_contains(columns, needle, f.like)
    if f.keyword and f.keyword.strip():
        out = out & any_contains((*KEYWORD_COLUMNS, F.to_json("properties")), f.keyword, f.like)
    return out & time_predicate(f)


def filter_events(events: DataFrame, f: EventFilter) -> DataFrame:
    """Filtered events; if the table has ``event_date``, whole days outside the times are not read."""
    out = events.where(event_predicate(f))
    if "event_date" in events.columns:
        days = [(r.start, r.end) for r in f.ranges] or [(f.start, f.end)]
        low, high = [a for a, _ in days], [b for _, b in days]
        if None not in low:
            out = out.where(F.col("event_date") >= F.lit(min(low).date()))
        if None not in high:
            out = out.where(F.col("event_date") <= F.lit(max(high).date()))
    return out


def search(events: DataFrame, f: EventFilter, limit: int | None = 1000, offset: int = 0) -> DataFrame:
    out = filter_events(events, f).orderBy("time_created_utc", "row_id")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def count_events(events: DataFrame, f: EventFilter) -> DataFrame:
    return filter_events(events, f).agg(F.count(F.lit(1)).alias("n"))


def fetch_by_event_ids(events: DataFrame, f: EventFilter, event_ids: Sequence[int], limit: int | None = None) -> DataFrame:
    """The detector's ids take the place of the user's; no silent cap."""
    from dataclasses import replace

    return search(events, replace(f, event_ids=tuple(event_ids)), limit)


def fetch_by_row_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select("row_id").distinct(), "row_id", "left_semi")


# Expressions of dates, parsed where the query is made.

_DATE = re.compile(r"^(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}(?::\d{2})?))?$")


def _moment(text: str, end: bool) -> dt.datetime:
    m = _DATE.match(text.strip())
    if not m:
        raise ValueError(f"no date: {text!r}")
    day = dt.datetime.strptime(m[1], "%Y-%m-%d")
    if m[2]:
        parts = [int(x) for x in m[2].split(":")]
        return day.replace(hour=parts[0], minute=parts[1], second=parts[2] if len(parts) > 2 else 0)
    return day + dt.timedelta(days=1) - dt.timedelta(microseconds=1) if end else day


def parse_date_expression(text: str, gap: dt.timedelta = dt.timedelta(minutes=1)) -> list[TimeRange]:
    """``d``, ``d1,d2``, ``a..b`` or ``a/b`` as ranges, merged if they are at most ``gap`` apart."""
    ranges = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, b = (part.split("..", 1) if ".." in part else part.split("/", 1) if "/" in part else (part, part))
        start, end = _moment(a, False), _moment(b, True)
        ranges.append(TimeRange(min(start, end), max(start, end)))
    merged: list[TimeRange] = []
    for r in sorted(ranges, key=lambda r: r.start):
        if merged and r.start - merged[-1].end <= gap:
            merged[-1] = TimeRange(merged[-1].start, max(merged[-1].end, r.end))
        else:
            merged.append(r)
    return merged


def build_filter(hours: int | None = None, dates: str | None = None, ids: str | None = None, now: dt.datetime | None = None, **more) -> EventFilter:
    """A filter from look-back hours, a date expression and a comma list of ids."""
    ranges = tuple(parse_date_expression(dates)) if dates else ()
    start = (now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) - dt.timedelta(hours=hours) if hours and not ranges else more.pop("start", None)
    numbers = tuple(int(t) for t in (x.strip() for x in re.split("[,;]", ids or "")) if re.fullmatch(r"[+-]?\d+", t))
    return EventFilter(event_ids=numbers, ranges=ranges, start=start, **more)


def merge_ranges(ranges: DataFrame, keys: Sequence[str], gap_us: int = 60_000_000) -> DataFrame:
    """Ranges (start_us, end_us) of each key, joined where at most ``gap_us`` apart."""
    w = W.partitionBy(*keys).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(w.rowsBetween(W.unboundedPreceding, -1))
    d = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("start_us") - reach > gap_us), 1).otherwise(0))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("n_ranges")).drop("_island")


# Filters on results.

ARTEFACT_COLUMNS = {
    "findings": {"user": ("user_name",), "ip": ("source_ip",), "process": ("process_name",), "host": ("computer_name",), "keyword": ("title", "description", "details")},
    "correlations": {"user": ("user_name",), "ip": ("source_ip",), "host": ("computer_name",), "keyword": ("title", "scenario", "details")},
    "iocs": {"user": ("related_user",), "ip": ("ioc_value", "matched_field"), "process": ("related_process",), "host": ("computer_name",), "keyword": ("ioc_value", "matched_field", "related_process", "related_user")},
    "cves": {"user": ("related_user",), "process": ("related_process",), "host": ("computer_name",), "keyword": ("cve_id", "vulnerability_name", "short_description", "product", "vendor_project", "matched_field")},
}


def filter_artefacts(df: DataFrame, kind: str, f: EventFilter, time: str = "time_utc") -> DataFrame:
    """Each kind of result looks at its own columns; criteria that a kind lacks do not apply to it."""
    columns = ARTEFACT_COLUMNS[kind]
    keep = time_predicate(f, time)
    for name, needle in (("user", f.user), ("ip", f.ip), ("process", f.process), ("host", f.host), ("keyword", f.keyword)):
        if needle and needle.strip() and name in columns:
            keep = keep & any_contains([c for c in columns[name] if c in df.columns], needle.strip())
    if f.event_ids and kind != "correlations":
        keep = keep & F.coalesce(F.col("event_id").isin(list(f.event_ids)), F.lit(False))
    return df.where(keep)
