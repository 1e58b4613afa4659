"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time. Its integral is the source's cumulative
token demand; inverting that demand at a document's token offset gives the document's training time,
and the demand of all sources up to that time its training position in tokens. Documents are
range-sorted by position.

Defined cases: a null or empty text has size 0, takes 0 words and stands where its offset falls;
a null source is a source of its own, last in order; documents that are equal in id and size are
interchangeable; a text of any length is one document, whose words count whole; an empty table gives
an empty result; columns other than doc_id, source and text are not read (or pass through, in
``mixed_documents``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE_WORD, id_order, small_or_shuffled, stored

WEIGHTS = (5, 2, 1)
#: Multipliers of each weight class over training time 0..1, as knots (time, multiplier):
#: heavy sources lead early, light ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """One row per source: sid, source, docs, source_size, weight, target.

    Weights repeat over the sources in code-point order (null last). A target stops at
    ``most_epochs`` times its source's size; the excess goes to the other sources by weight.
    ``sizes`` has source and size.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    )
    # Sources reach their cap in the order of cap / weight. The water level after the first k are
    # capped is what is left of the total over the weight that is left; the first level that is
    # below the next cap holds.
    cap = most_epochs * F.col("source_size")
    by_cap = W.orderBy("ratio", "sid")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = (
        per.withColumn("ratio", cap / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum(cap).over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left_weight"))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every))
    )
    target = F.least(cap.cast("double"), F.coalesce(F.col("first.level") * F.col("weight"), cap.cast("double")))
    return per.select("sid", "source", "docs", "source_size", "weight", target.alias("target"))


def _share(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Segments (time, length, multiplier, slope, integral before) of a schedule scaled to integral 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t, m), (u, n) in zip(knots, knots[1:]):
        out.append((t, u - t, m / area, (n - m) / area / (u - t), before))
        before += (u - t) * (m + n) / 2 / area
    return out


def position_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's cumulative demand reaches ``share`` (0..1) of all it demands."""
    out = None
    for t, _, m, slope, before in reversed(_share(knots)):
        due = share - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(m * m) + F.lit(2.0 * slope) * due, F.lit(0.0)))
        at = F.lit(t) + F.lit(2.0) * due / (F.lit(m) + root)
        out = at if out is None else F.when(share < F.lit(before_next), at).otherwise(out)
        before_next = before
    return out


def demand_at(time: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The share of all its demand that a schedule has asked for by a time: the inverse of ``position_of``."""
    out = None
    for t, _, m, slope, before in reversed(_share(knots)):
        passed = time - F.lit(t)
        at = F.lit(before) + passed * (F.lit(m) + F.lit(slope / 2) * passed)
        out = at if out is None else F.when(time < F.lit(t_next), at).otherwise(out)
        t_next = t
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    most_epochs: int = 3,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, start, taken, occurrences, time, token, position.

    Each source's documents form one stream, in an order fixed by md5 of the id, that repeats up
    to ``most_epochs`` times; the mix takes the first ``target`` words of it. ``start`` is the
    document's offset in the stream, ``taken`` its words in the mix over all repeats, ``time`` (0 to 1)
    the time of its first occurrence by its source's schedule, ``token`` what all sources together have
    been asked for by then and ``position`` that as a share of the mix (null if it has none).

    Offsets are prefix sums in two levels, over the square root of a source's documents as
    buckets, so that a source with a third of all rows is no single task.
    """
    planned, totals = _planned(docs, weights, most_epochs, broadcast_rows)
    time = _time(F.col("start"), weights, schedules)
    token = _token(F.col("time"), totals, weights, schedules)
    return planned.withColumn("time", time).withColumn("token", token).withColumn("position", F.col("token") / max(sum(totals.values()), 1))


def _planned(docs: DataFrame, weights: Sequence[int], most_epochs: int, broadcast_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(One row per document, what all sources of each weight are asked for)."""
    sizes = stored(docs.select("doc_id", "source", text_size(F.col("text")).alias("size")), "mix-sizes")
    targets = stored(source_targets(sizes, weights, most_epochs), "mix-targets")
    totals = {r.weight: r.due for r in targets.groupBy("weight").agg(F.sum(F.round("target").cast("long")).alias("due")).collect()}  # a row a weight
    small = small_or_shuffled(targets.withColumnRenamed("source", "t_source"), targets.count(), broadcast_rows)
    d = (
        sizes.join(small, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("u", id_order(F.col("doc_id")))
        .withColumn("buckets", F.ceil(F.sqrt(F.col("docs").cast("double"))))
        .withColumn("bucket", F.shiftright(F.shiftright("u", 30) * F.col("buckets"), 30))
    )
    within = W.partitionBy("sid", "bucket").orderBy("u", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        d.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
        .select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    )
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["sid", "bucket"])
    d = d.withColumn("start", F.col("offset") + F.col("inside")).withColumn("due", F.round("target").cast("long"))
    zero = F.lit(0).cast("long")
    taken = sum((F.least(F.col("size"), F.greatest(zero, F.col("due") - F.col("start") - e * F.col("source_size"))) for e in range(most_epochs)), zero)
    seen = sum((F.when(F.col("start") + e * F.col("source_size") < F.col("due"), 1).otherwise(0) for e in range(most_epochs)), F.lit(0))
    d = d.withColumn("taken", taken).withColumn("occurrences", F.when(F.col("size") == 0, F.least(seen, F.lit(1))).otherwise(seen))
    return d.select("doc_id", "size", "source_size", "weight", "target", "due", "start", "taken", "occurrences"), totals


def _time(offset: Column, weights: Sequence[int], schedules: Sequence) -> Column:
    """The training time at which a source's demand reaches an offset in its stream."""
    out = F.lit(None).cast("double")
    share = offset / F.col("due")
    for weight, knots in zip(weights, schedules):
        out = F.when((offset < F.col("due")) & (F.col("weight") == weight), position_of(share, knots)).otherwise(out)
    return out


def _token(time: Column, totals: dict[int, int], weights: Sequence[int], schedules: Sequence) -> Column:
    """The tokens that all sources together are asked for by a time."""
    return sum((F.lit(float(totals.get(w, 0))) * demand_at(time, knots) for w, knots in zip(weights, schedules)), F.lit(0.0))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorts the mix; what it does not take stands last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence = SCHEDULES, most_epochs: int = 3, broadcast_rows: int = 100_000) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, whole, in training order.

    Rows that share an id are told apart by their size; of rows equal in both, one stands for all.
    """
    planned, _ = _planned(docs, weights, most_epochs, broadcast_rows)
    plan = planned.groupBy("doc_id", "size").agg(
        F.max("occurrences").alias("occurrences"), *(F.first(c).alias(c) for c in ("source_size", "weight", "due")), F.min("start").alias("start")
    )
    turns = (
        plan.where("occurrences > 0")
        .select("doc_id", "size", "weight", "due", F.explode(F.sequence(F.lit(0), F.col("occurrences") - 1)).alias("epoch"), "start", "source_size")
        .withColumn("offset", F.col("start") + F.col("epoch") * F.col("source_size"))
        .select("doc_id", "size", _time(F.col("offset"), weights, schedules).alias("_time"))  # positions rise with time
        .withColumnRenamed("doc_id", "_id").withColumnRenamed("size", "_size")
    )
    sized = docs.select(F.struct("*").alias("doc"), "doc_id", text_size(F.col("text")).alias("words"))
    joined = sized.join(turns, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("words") == F.col("_size")))
    return joined.orderBy(F.col("_time").asc_nulls_last(), "doc_id").select("doc.*")


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u
  FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s GROUP BY source
), q AS (
  SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS weight, 3 * source_size / CAST([5, 2, 1][(sid - 1) % 3 + 1] AS DOUBLE) AS ratio FROM p
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(3 * source_size) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM q
), f AS (
  SELECT *, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, sid LIMIT 1) AS held FROM l
), t AS (
  SELECT sid, source, source_size, weight, least(CAST(3 * source_size AS DOUBLE), coalesce(held * weight, 3.0 * source_size)) AS target FROM f
), o AS (
  SELECT s.doc_id, s.size, t.source_size, t.weight, t.target, CAST(round(t.target) AS BIGINT) AS due,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY t.sid ORDER BY s.u, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), h AS (
  SELECT *, CASE WHEN start < due THEN CASE weight WHEN 5 THEN 2.0::DOUBLE * (start / CAST(due AS DOUBLE)) / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE + -2.0::DOUBLE * (start / CAST(due AS DOUBLE)), 0.0::DOUBLE)))
    WHEN 2 THEN start / CAST(due AS DOUBLE)
    ELSE CASE WHEN start / CAST(due AS DOUBLE) < 0.375::DOUBLE THEN 2.0::DOUBLE * (start / CAST(due AS DOUBLE)) / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * (start / CAST(due AS DOUBLE)), 0.0::DOUBLE)))
      ELSE 0.5::DOUBLE + 2.0::DOUBLE * (start / CAST(due AS DOUBLE) - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 2.0::DOUBLE * (start / CAST(due AS DOUBLE) - 0.375::DOUBLE), 0.0::DOUBLE))) END END END AS time
  FROM o
), g AS (
  SELECT CAST(coalesce(sum(CASE WHEN weight = 5 THEN due END), 0) AS DOUBLE) AS early, CAST(coalesce(sum(CASE WHEN weight = 2 THEN due END), 0) AS DOUBLE) AS even,
    CAST(coalesce(sum(CASE WHEN weight = 1 THEN due END), 0) AS DOUBLE) AS late FROM (SELECT weight, CAST(round(target) AS BIGINT) AS due FROM t)
)
SELECT doc_id, size, source_size, target,
  CAST(least(size, greatest(0, due - start)) + least(size, greatest(0, due - start - source_size)) + least(size, greatest(0, due - start - 2 * source_size)) AS BIGINT) AS taken,
  CAST(floor(early * (time * (1.5::DOUBLE - 0.5::DOUBLE * time)) + even * time
    + late * CASE WHEN time < 0.5::DOUBLE THEN time * (0.5::DOUBLE + 0.5::DOUBLE * time) ELSE 0.375::DOUBLE + (time - 0.5::DOUBLE) * (1.0::DOUBLE + 0.5::DOUBLE * (time - 0.5::DOUBLE)) END) AS BIGINT) AS token
FROM h, g
"""
