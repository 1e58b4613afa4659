"""Statistics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import SEVERITIES

#: Section, how many of its keys are shown (all if None).
SECTIONS = (("EventIdCounts", 30), ("UserCounts", 20), ("ProcessCounts", 20), ("SourceIpCounts", 20), ("EventsByHour", None))


def statistics(events: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(section, key, value): one scan and one shuffle for all breakdowns of events.

    Ties are broken by key. Unknown users count as ``(unknown)``.
    """
    present = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    keys = {
        "EventIdCounts": F.col("event_id").cast("string"), "UserCounts": F.coalesce("user_name", "target_user_name", F.lit("(unknown)")),
        "ProcessCounts": present("process_name"), "SourceIpCounts": present("source_ip"),
        "EventsByHour": F.concat(F.lpad(F.hour("time_created_utc").cast("string"), 2, "0"), F.lit(":00")), "Summary": F.lit("TotalEvents"),
    }
    pairs = F.array(*(F.struct(F.lit(section).alias("section"), key.alias("key")) for section, key in keys.items()))
    counts = events.select(F.explode(pairs).alias("p")).where("p.key is not null").groupBy("p.section", "p.key").agg(F.count(F.lit(1)).alias("value"))
    # A group limit for each section: the rows that reach its one task are its limit a partition.
    limits = {**{name: k for name, k in SECTIONS}, "Summary": None}
    rank = F.row_number().over(W.partitionBy("section").orderBy(F.col("value").desc(), "key"))
    out = counts.where(F.col("section").isin(*(name for name, k in limits.items() if k is None)))
    for k in sorted({k for k in limits.values() if k is not None}):
        part = counts.where(F.col("section").isin(*(name for name, n in limits.items() if n == k)))
        out = out.unionByName(part.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank"))
    if findings is not None:
        by = findings.groupBy(F.lit("FindingsBySeverity").alias("section"), F.col("severity").alias("key")).agg(F.count(F.lit(1)).alias("value"))
        total = findings.agg(F.lit("Summary").alias("section"), F.lit("TotalFindings").alias("key"), F.count(F.lit(1)).alias("value"))
        out = out.unionByName(by).unionByName(total)
    return out


def severity_summary(findings: DataFrame, correlations: DataFrame, ioc_matches: DataFrame, cve_matches: DataFrame, top: int = 5) -> DataFrame:
    """(section, key, value): findings by severity, the most frequent users and addresses (whatever
    their case), and how many chains, indicator and CVE matches there are."""
    rows = lambda section, key, df: df.select(F.lit(section).alias("section"), key.alias("key"), F.col("n").alias("value"))
    n = F.count(F.lit(1)).alias("n")
    order = F.array(*map(F.lit, SEVERITIES))
    counts = findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    out = counts.select(F.lit("Severity").alias("section"), F.explode(F.arrays_zip(order.alias("key"), F.array(*SEVERITIES).alias("value"))).alias("x")).select("section", "x.key", "x.value")
    out = out.unionByName(rows("Summary", F.lit("Findings"), findings.agg(n)))
    for section, column in (("TopUsers", "user_name"), ("TopIps", "source_ip")):
        best = findings.where(F.coalesce(F.trim(column), F.lit("")) != "").groupBy(F.lower(column).alias("k")).agg(n).orderBy(F.col("n").desc(), "k").limit(top)
        out = out.unionByName(rows(section, F.col("k"), best))
    for key, df in (("Chains", correlations), ("IocMatches", ioc_matches), ("CveMatches", cve_matches)):
        out = out.unionByName(rows("Summary", F.lit(key), df.agg(n)))
    return out


def table_summary(tables: dict[str, DataFrame], time_of: str = "events") -> DataFrame:
    """(name, n, first, last): rows of each table and, for events, the span of time."""
    out = None
    for name, df in tables.items():
        t = F.col("time_created_utc") if name == time_of else F.lit(None).cast("timestamp")
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.date_format(F.min(t), "yyyy-MM-dd HH:mm:ss").alias("first_time"), F.date_format(F.max(t), "yyyy-MM-dd HH:mm:ss").alias("last_time"))
        out = row if out is None else out.unionByName(row)
    return out


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def ordered_findings(findings: DataFrame, limit: int | None = 50) -> DataFrame:
    out = findings.orderBy(F.col("severity_rank").desc(), "time_utc", "event_row_id", "title")
    return out if limit is None else out.limit(limit)
