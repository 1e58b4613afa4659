"""Streams of events: incremental collection, stateless detection and windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.accounts import account_key, ip_key
from ..operators.detectors import STATELESS, Settings, has_user
from ..operators.merge import upsert_events
from ..operators.normalize import normalize_xml
from ..schema import EVENT_SCHEMA


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Normalised event files as they arrive."""
    return spark.readStream.schema(EVENT_SCHEMA).parquet(path)


def stream_event_xml(spark: SparkSession, path: str) -> DataFrame:
    return normalize_xml(spark.readStream.format("text").option("wholetext", True).load(path).select(F.col("value").alias("raw_xml")))


class EventTable:
    """A table by day of which readers and later batches see whole batches only.

    A batch writes the days that it touches to a folder of its own, then adds one file to the manifest that
    says where these days are from now on. A day is where its last batch left it. What a job that dies before that
    file leaves is in no manifest and is never read; nothing that the manifest names is written again.
    """

    MANIFEST = "place long, query string, batch long, event_date date, folder string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame | None:
        """All entries, or None where there is no table yet; any other failure to read is raised."""
        try:
            return self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/_manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def days(self, among: list | None = None) -> DataFrame | None:
        """The rows of the table, or of some days; None where there are none."""
        entries = self.manifest()
        if entries is None:
            return None
        if among is not None:
            day = F.col("event_date")
            entries = entries.where(F.when(day.isNull(), F.lit(None in among)).otherwise(day.isin([d for d in among if d is not None])))
        last = entries.groupBy("event_date").agg(F.max_by("folder", "place").alias("folder")).collect()  # a row for each day
        paths = [f"{self.path}/{r.folder}/event_date={r.event_date or '__HIVE_DEFAULT_PARTITION__'}" for r in last]
        return self.spark.read.option("basePath", self.path).parquet(*paths).drop("batch") if paths else None

    def has(self, query: str, batch: int) -> bool:
        entries = self.manifest()
        return entries is not None and bool(entries.where((F.col("query") == query) & (F.col("batch") == batch)).limit(1).count())

    def write(self, rows: DataFrame) -> str:
        """Writes the days of ``rows``; they are not part of the table before ``commit``."""
        folder = f"batch={uuid.uuid4().hex}"
        rows.write.partitionBy("event_date").parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, days: list, query: str, batch: int, folder: str) -> None:
        """Adds the batch's one file to the manifest, which a rename makes visible whole. One job at a time writes a table."""
        entries = self.manifest()
        place = 0 if entries is None else 1 + entries.agg(F.max("place")).first()[0]
        rows = self.spark.createDataFrame([(place, query, batch, d, folder) for d in days], self.MANIFEST)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/_manifest")


def collect_incrementally(keyed: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merges each batch of keyed events into an ``EventTable``; ``collected`` reads it.

    Only the days that a batch touches are read and written anew. A batch that is run again after a failure
    starts from the table as it was before it, or is passed over if it had been committed. Batches are
    told apart by checkpoint and number.
    """

    def merge(batch: DataFrame, number: int) -> None:
        target = EventTable(batch.sparkSession, table)
        days = [r.event_date for r in batch.select("event_date").distinct().collect()]
        if not days or target.has(checkpoint, number):
            return
        incoming = batch.withColumn("_arrival", F.monotonically_increasing_id())
        folder = target.write(upsert_events(target.days(days), incoming, "_arrival"))
        target.commit(days, checkpoint, number, folder)

    return keyed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(spark: SparkSession, table: str) -> DataFrame | None:
    """The events that have been collected."""
    return EventTable(spark, table).days()


def stream_findings(events: DataFrame, settings: Settings = Settings(), detectors: dict[str, Callable] | None = None) -> DataFrame:
    """Stateless detectors on a stream: the same expressions as in batches."""
    out = None
    for detector in (detectors or STATELESS).values():
        part = detector(events, settings)
        out = part if out is None else out.unionByName(part)
    return out


def failed_logon_windows(events: DataFrame, threshold: int = 3, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Failed logons of each account and address in sliding windows: an approximation of bursts that
    needs bounded state, as late data end at the watermark."""
    d = events.where((F.col("event_id") == 4625) & has_user()).withWatermark("time_created_utc", late)
    g = d.groupBy(F.window("time_created_utc", window, slide), account_key().alias("account"), ip_key().alias("ip")).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= threshold).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "account", "ip", "n")


def failed_logon_sessions(events: DataFrame, threshold: int = 3, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    d = events.where((F.col("event_id") == 4625) & has_user()).withWatermark("time_created_utc", late)
    g = d.groupBy(F.session_window("time_created_utc", gap), account_key().alias("account"), ip_key().alias("ip")).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= threshold).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "account", "ip", "n")
