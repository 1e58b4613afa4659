"""Windows anchored at events, and joins of events to what follows them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import stored


def busy_runs(events: DataFrame, keys: Sequence[str], window_us: int, least: int) -> DataFrame:
    """The events of runs that could hold a window of ``least`` events, with ``run``, ``bucket`` and
    ``offset`` (the events of the run before the bucket) and ``n_bucket`` (those in it).

    Time is cut into buckets of the window's length. No window spans an empty bucket, so runs of busy
    buckets are found, and numbered, on counts of (key, bucket) alone; runs with too few events never
    shuffle further. Events stay grouped by bucket, so one key with most of them, even without a quiet
    moment, is spread over its buckets.
    """
    d = events.withColumn("bucket", F.floor(F.col("us") / window_us).cast("bigint"))
    counts = d.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_key = W.partitionBy(*keys).orderBy("bucket")
    gap = F.when(F.col("bucket") - F.lag("bucket").over(by_key) == 1, 0).otherwise(1)
    runs = counts.withColumn("gap", gap).withColumn("run", F.sum("gap").over(by_key.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy(*keys, "run")
    runs = runs.withColumn("total", F.sum("n").over(whole)).withColumn("offset", F.coalesce(F.sum("n").over(whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return d.join(runs.where(F.col("total") >= least).select(*keys, "bucket", "run", "offset", F.col("n").alias("n_bucket")), [*keys, "bucket"])


def window_ends(events: DataFrame, keys: Sequence[str], window_us: int) -> DataFrame:
    """Adds rn (rank in the run by time) and end_rn (rank of the last event within the window).

    A window holds all that follows in its own bucket and ends in the next, so each bucket is joined by the
    asks of the one before, and no group is larger than that. Each event asks once, at the time its window
    ends, for the events of the next bucket before; asks are sorted among these, and running counts give both
    ranks, so the work grows with the events of a bucket and not with the pairs of its events. Events are
    shuffled twice, so callers keep them narrow and look up what else they need of the few that count.
    """
    item = lambda group, ask, at: F.struct(group.alias("_group"), F.lit(ask).alias("_ask"), at.alias("_at"))
    items = F.array(item(F.col("bucket"), False, F.col("us")), item(F.col("bucket") + 1, True, F.col("us") + window_us))
    d = events.withColumn("_item", F.explode(items)).select("*", "_item.*").drop("_item")
    so_far = W.partitionBy(*keys, "_group").orderBy("_at", "_ask", "row_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumns({"_asks": F.count_if(F.col("_ask")).over(so_far), "_next": F.count_if(~F.col("_ask")).over(so_far)}).where("_ask")
    d = d.withColumns({"rn": (F.col("offset") + F.col("_asks")).cast("int"), "end_rn": (F.col("offset") + F.col("n_bucket") + F.col("_next")).cast("int")})
    return d.drop("n_bucket", "_group", "_ask", "_at", "_asks", "_next")


def distinct_ahead(events: DataFrame, keys: Sequence[str], window_us: int, value: str, name: str) -> DataFrame:
    """Adds ``name``: how many values the window from each event on has (null is none).

    An event adds its value to the windows that start after the value's event before and reach the
    event: an interval of starts, and those of one value are disjoint. So the number of values of a window
    is the number of intervals that its start lies in, a running sum of ends and beginnings. An interval
    meets two buckets at most, as does the event before that matters, so no group is larger than that.
    ``events`` have keys, bucket, us and row_id.
    """
    d = events.select(*keys, "bucket", "us", F.col(value).alias("_value")).where("_value is not null")
    d = d.withColumn("_group", F.explode(F.array("bucket", F.col("bucket") + 1)))
    before = F.lag("us").over(W.partitionBy(*keys, "_value", "_group").orderBy("us"))
    d = d.withColumn("_low", F.greatest(before + 1, F.col("us") - window_us)).where(F.col("_group") == F.col("bucket")).where("_low <= us")
    point = lambda bucket, at, step: F.struct(bucket.alias("bucket"), at.alias("us"), F.lit(step).alias("_step"))
    first = F.floor(F.col("_low") / window_us).cast("bigint")
    points = [point(F.col("bucket"), F.greatest("_low", F.col("bucket") * window_us), 1), point(F.col("bucket"), F.col("us") + 1, -1)]
    early = F.when(first < F.col("bucket"), F.array(point(first, F.col("_low"), 1))).otherwise(F.array().cast("array<struct<bucket:bigint,us:bigint,_step:int>>"))
    steps = d.select(*keys, F.explode(F.concat(F.array(*points), early)).alias("_p")).select(*keys, "_p.*")
    steps = steps.groupBy(*keys, "bucket", "us").agg(F.sum("_step").alias("_step"))
    sides = events.withColumn("_step", F.lit(None).cast("bigint")).unionByName(steps, allowMissingColumns=True)
    so_far = W.partitionBy(*keys, "bucket").orderBy("us", F.col("_step").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return sides.withColumn(name, F.coalesce(F.sum("_step").over(so_far), F.lit(0)).cast("int")).where("_step is null").drop("_step")


def greedy_clusters(candidates: DataFrame, keys: Sequence[str], most: int = 10_000, steps: int = 32) -> DataFrame:
    """Non-overlapping windows in order of time: after one is taken, those that start inside it go.

    ``candidates`` (keys, run, bucket, rn, end_rn) are only the windows that are large enough. They are
    cut where one starts after all before it have ended; ends rise with starts, so that needs the one
    before alone, which is in the bucket or the last one of the bucket before. A part with up to ``most``
    candidates is folded; in a larger one each is linked to the first that starts after its end, and the
    chain from the part's start is marked. No two windows of a chain start in one bucket, so where parts span
    up to ``steps`` buckets the links are followed one by one, which moves only the chains' ends; else in
    rounds that double the length of the links.
    """
    group = [*keys, "run"]
    inside = W.partitionBy(*group, "bucket").orderBy("rn")
    c = candidates.select(*group, "bucket", "rn", "end_rn").withColumn("_before", F.lag("end_rn").over(inside))
    ends = candidates.groupBy(*group, "bucket").agg(F.max("end_rn").alias("_end"), F.min("rn").alias("_first"))
    by_bucket = W.partitionBy(*group).orderBy("bucket")
    ends = ends.withColumn("_last", F.max("_end").over(by_bucket.rowsBetween(W.unboundedPreceding, -1)))
    c = c.join(ends.select(*group, "bucket", "_last"), [*group, "bucket"]).withColumn("_before", F.coalesce("_before", "_last"))
    c = c.withColumn("_starts", (F.col("_before").isNull() | (F.col("rn") > F.col("_before"))).cast("int"))
    base = c.groupBy(*group, "bucket").agg(F.sum("_starts").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(by_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = c.join(base.select(*group, "bucket", "_base"), [*group, "bucket"])
    c = c.withColumn("part", F.col("_base") + F.sum("_starts").over(inside.rowsBetween(W.unboundedPreceding, 0))).select(*group, "part", "bucket", "rn", "end_rn", "_starts")
    c = stored(c, "window-parts")
    sizes = c.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("_size"), (F.max("bucket") - F.min("bucket") + 1).alias("_span"))
    large = sizes.where(F.col("_size") > most).drop("_size")
    span = large.agg(F.max("_span")).first()[0]
    if span is None:
        return _folded(c, group)
    large = large.drop("_span")
    return _folded(c.join(large, [*group, "part"], "left_anti"), group).unionByName(_linked(c.join(large, [*group, "part"]), group, span <= steps))


def _folded(c: DataFrame, group: list[str]) -> DataFrame:
    starts = F.array_sort(F.collect_list(F.struct("rn", "end_rn", "bucket")))
    none = F.struct(F.lit(0).cast("int").alias("next"), F.array().cast("array<struct<rn:int,end_rn:int,bucket:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct((x["end_rn"] + 1).cast("int").alias("next"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(x["rn"] >= acc["next"], taken).otherwise(acc)

    folded = c.groupBy(*group, "part").agg(starts.alias("s")).select(*group, F.explode(F.aggregate("s", none, step, lambda a: a["out"])).alias("c"))
    return folded.select(*group, F.col("c.rn").alias("rn"), F.col("c.end_rn").alias("end_rn"), F.col("c.bucket").alias("bucket"))


def _linked(c: DataFrame, group: list[str], stepwise: bool) -> DataFrame:
    """The chain of each part from its first window on."""
    # The first start after an end: among the bucket's and the next one's own, else the first of a later bucket.
    own = c.select(*group, "bucket", "rn", "end_rn", F.lit(True).alias("_own"))
    near = c.select(*group, F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"), F.col("rn").alias("_at"), F.lit(None).cast("int").alias("_id"))
    asks = own.select(*group, "bucket", F.col("end_rn").alias("_at"), F.col("rn").alias("_id"))
    # Latest first, so that all that follows in time precedes in the frame, which grows and is never summed up anew.
    after = W.partitionBy(*group, "bucket").orderBy(F.col("_at").desc(), F.col("_id").isNull()).rowsBetween(W.unboundedPreceding, -1)
    found = near.unionByName(asks).withColumn("_next", F.min(F.when(F.col("_id").isNull(), F.col("_at"))).over(after)).where("_id is not null")
    firsts = c.groupBy(*group, "bucket").agg(F.min("rn").alias("_first"))
    beyond = firsts.select(*group, "bucket", F.min("_first").over(W.partitionBy(*group).orderBy(F.col("bucket").desc()).rangeBetween(W.unboundedPreceding, -2)).alias("_far"))
    link = found.join(beyond, [*group, "bucket"]).select(*group, F.col("_id").alias("rn"), F.coalesce("_next", "_far").alias("next"))
    link = stored(link.where("next is not null"), "window-links")
    marked = stored(c.where("_starts = 1").select(*group, "rn"), "window-marks")
    if stepwise:
        starts = ends = marked
        while not ends.isEmpty():
            ends = ends.join(link, [*group, "rn"]).select(*group, F.col("next").alias("rn"))
            ends = stored(ends.join(starts, [*group, "rn"], "left_anti"), "window-marks")  # of a later part: it has its own chain
            marked = marked.unionByName(ends)
        return c.join(marked, [*group, "rn"], "left_semi").select(*group, "rn", "end_rn", "bucket")
    n = marked.count()
    while True:
        reached = marked.join(link, [*group, "rn"]).select(*group, F.col("next").alias("rn"))
        marked = stored(marked.unionByName(reached).distinct(), "window-marks")
        now = marked.count()
        if now == n:
            break
        n = now
        onward = link.select(*group, F.col("rn").alias("next"), F.col("next").alias("_onward"))
        link = stored(link.join(onward, [*group, "next"], "left").select(*group, "rn", F.coalesce("_onward", "next").alias("next")), "window-links")
    return c.join(marked, [*group, "rn"], "left_semi").select(*group, "rn", "end_rn", "bucket")


def cluster_rows(events: DataFrame, clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The events of each cluster, with its first rank as ``start_rn``. A cluster begins in its
    ``bucket`` and ends there or in the next, so events meet the clusters of their buckets alone."""
    c = clusters.select(*keys, "run", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), F.col("rn").alias("start_rn"), "end_rn")
    return events.drop("end_rn").join(c, [*keys, "run", "bucket"]).where(F.col("rn").between(F.col("start_rn"), F.col("end_rn")))


#: Parts of the others of a bucket that are searched apart where a key may be missing.
ANY_PARTS = 32


def first_after(
    anchors: DataFrame, others: DataFrame, anchor_id: str, on: Sequence[tuple[str, str]], low: Column, high: Column, time: str, tie: str,
    bucket_us: int, keep: Sequence[str] = (), loose: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """For each anchor the first of the others in [low, high], by time and then ``tie``, as ``hit``.

    Pairs are never joined. An anchor asks, in each time bucket that its interval meets, for what comes
    next; asks and others are sorted together by keys and bucket, latest first, and the last other seen is
    the answer. The work grows with anchors plus others, however many there are of one key in one bucket.

    Values of ``on`` must be equal (null equals nothing). Those of ``loose`` must be equal where both
    are there; a missing one fits all. So others stand under their own value and under any, and
    anchors ask for their own value and for others without; those without a value ask for any. What stands
    under any is kept only for buckets that are asked so, and there in parts that are searched apart.
    """
    any_value = F.lit("*")
    own = lambda c: F.concat(F.lit("="), F.col(c).cast("string"))
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    keys, tags = [f"_k{i}" for i in range(len(on))], [f"_t{i}" for i in range(len(loose))]
    wide = F.lit(False)
    for t in tags:
        wide = wide | (F.col(t) == any_value)
    group = [*keys, *tags, "_part", "_bucket"]
    hit = F.struct(F.col(time).alias("us"), F.col(tie).alias("id"), *(F.col(k) for k in keep))

    buckets = F.sequence(F.floor(F.col("_low") / bucket_us).cast("bigint"), F.floor(F.col("_high") / bucket_us).cast("bigint"))
    a = anchors.select(F.col(anchor_id), *(F.col(x).alias(k) for k, (x, _) in zip(keys, on)), *(x for x, _ in loose), low.alias("_low"), high.alias("_high")).where("_low <= _high")
    for t, (x, _) in zip(tags, loose):
        a = a.withColumn(t, F.explode(F.when(there(x), F.array(own(x), F.lit(""))).otherwise(F.array(any_value))))
    a = a.withColumn("_part", F.explode(F.when(wide, F.sequence(F.lit(0), F.lit(ANY_PARTS - 1))).otherwise(F.array(F.lit(0))))).withColumn("_bucket", F.explode(buckets))
    o = others.select(*(F.col(y).alias(k) for k, (_, y) in zip(keys, on)), *(y for _, y in loose), F.col(time).alias("_at"), F.col(tie).alias("_tie"), hit.alias("hit"))
    o = o.where("_at is not null").withColumn("_bucket", F.floor(F.col("_at") / bucket_us).cast("bigint"))
    for t, (_, y) in zip(tags, loose):
        o = o.withColumn(t, F.explode(F.array(F.when(there(y), own(y)).otherwise(F.lit("")), any_value)))
    if loose:
        asked = a.where(wide).select("_bucket").distinct()
        o = o.where(~wide).unionByName(o.where(wide).join(asked, "_bucket", "left_semi"))
    o = o.withColumn("_part", F.when(wide, F.pmod(F.xxhash64("_tie"), F.lit(ANY_PARTS)).cast("int")).otherwise(0))
    asks = a.select(*group, F.greatest("_low", F.col("_bucket") * bucket_us).alias("_at"), F.struct(F.col(anchor_id).alias("id"), F.col("_high").alias("high")).alias("_ask"))
    both = o.select(*group, "_at", "_tie", "hit").unionByName(asks, allowMissingColumns=True)
    for k in keys:
        both = both.where(F.col(k).isNotNull())
    latest = W.partitionBy(*group).orderBy(F.col("_at").desc(), F.col("_ask").isNotNull(), F.col("_tie").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("hit", F.last("hit", ignorenulls=True).over(latest)).where(F.col("_ask").isNotNull() & (F.col("hit.us") <= F.col("_ask.high")))
    return found.groupBy(F.col("_ask.id").alias(anchor_id)).agg(F.min("hit").alias("hit"))
