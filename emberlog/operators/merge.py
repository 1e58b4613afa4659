"""Merging of event tables by identity, and upserts of small dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY, SCORE = "event_key", "completeness_score"
#: Taken whole from the richest record.
FROM_RICHEST = ("event_id", "time_created_utc", "event_date", SCORE, "properties")


def upsert_events(existing: DataFrame | None, incoming: DataFrame, arrival: str) -> DataFrame:
    """One row per key. In order of arrival a row counts only if its score beats all before it; then
    each column is the value of the richest counting row that has one. Rows of the existing table
    arrive first. Columns that are taken whole come from the richest row.

    Winners are found on (key, score, arrival) alone; wide columns are merged by partial aggregates.
    """
    new = incoming.withColumn("_order", F.struct(F.lit(1).alias("a"), F.col(arrival).cast("bigint").alias("b")))
    rows = new if existing is None else existing.withColumn("_order", F.struct(F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"))).unionByName(new, allowMissingColumns=True)
    # A row that beats all before it, found on three narrow columns; a poorer copy never shuffles whole.
    before = W.partitionBy(KEY).orderBy("_order").rowsBetween(W.unboundedPreceding, -1)
    narrow = rows.select(KEY, SCORE, "_order").withColumn("_best", F.max(SCORE).over(before)).where(F.col("_best").isNull() | (F.col(SCORE) > F.col("_best")))
    winners = narrow.select(F.col(KEY).alias("_key"), F.col("_order").alias("_won"))
    rows = rows.join(winners, (F.col(KEY) == F.col("_key")) & (F.col("_order") == F.col("_won")), "left_semi")
    merged = [
        (F.max_by(c, SCORE) if c in FROM_RICHEST else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(SCORE)))).alias(c)
        for c in incoming.columns if c not in (KEY, arrival)
    ]
    return rows.groupBy(KEY).agg(*merged)


def best_per_key(events: DataFrame, key: str = KEY, score: str = SCORE, tie: str = "row_id") -> DataFrame:
    """The row of the highest score of each key; of equal ones that of the highest id."""
    w = W.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie).desc())
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def legacy_score(base_score: str = SCORE, properties_json: str = "properties_json"):
    """The score of rows that kept their bag as text: its length by 128, at most 20, for its count."""
    return F.col(base_score) + F.least(F.lit(20), F.floor(F.coalesce(F.length(properties_json), F.lit(0)) / 128).cast("int"))


def upsert_indicators(batches: list[DataFrame]) -> DataFrame:
    """Indicators by (lower-case type, value); the last batch that has one gives source and comment."""
    rows = [b.select(F.lower(F.trim("type")).alias("type"), F.trim("value").alias("value"), "comment", "source", F.lit(i).alias("_batch")) for i, b in enumerate(batches)]
    rows = reduce(DataFrame.unionByName, rows)
    last = F.max_by(F.struct("comment", "source"), F.struct("_batch", F.coalesce("source", F.lit("")), F.coalesce("comment", F.lit("")))).alias("last")
    return rows.groupBy("type", "value").agg(last).select("type", "value", "last.comment", "last.source")


def first_per_key(df: DataFrame, key, order: str) -> DataFrame:
    """The first row of each normalised key."""
    d = df.withColumn("_key", key)
    return d.withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(order))).where("_n = 1").drop("_n", "_key")


def replace_all(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
