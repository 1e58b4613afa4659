"""Time windows of busy keys against brute force."""

import random
import time

from pyspark.sql import functions as F

from emberlog.operators.windows import busy_runs, cluster_rows, distinct_ahead, greedy_clusters, window_ends

WINDOW, LEAST = 1000, 4


def brute(events):
    """Per key: the greedy windows as (first us, last us, events)."""
    out = []
    for key in {e[0] for e in events}:
        mine = sorted((us, row) for k, us, row in events if k == key)
        at = 0
        while at < len(mine):
            end = max(i for i in range(at, len(mine)) if mine[i][0] <= mine[at][0] + WINDOW)
            if end - at + 1 >= LEAST:
                out.append((key, mine[at][0], mine[end][0], end - at + 1))
                at = end + 1
            else:
                at += 1
    return sorted(out)


def rows():
    rnd = random.Random(5)
    events = [("hot", rnd.randrange(0, 60_000), i) for i in range(600)]  # never quiet
    events += [("hot", 30_000, 1000 + i) for i in range(20)]  # ties
    events += [(f"k{i % 7}", rnd.randrange(0, 40_000), 2000 + i) for i in range(300)]
    return events


def found(spark, **how):
    d = spark.createDataFrame(rows(), "key string, us long, row_id long")
    d = window_ends(busy_runs(d, ["key"], WINDOW, LEAST), ["key"], WINDOW)
    c = greedy_clusters(d.where(F.col("end_rn") - F.col("rn") + 1 >= LEAST), ["key"], **how)
    g = cluster_rows(d, c, ["key"]).groupBy("key", "run", "start_rn").agg(F.min("us"), F.max("us"), F.count(F.lit(1)))
    return sorted(tuple(r)[:1] + tuple(r)[3:] for r in g.collect())


def test_greedy_windows_equal_brute_force(spark):
    want = brute(rows())
    assert found(spark) == want
    assert found(spark, most=5) == want  # chains marked by doubling


def test_chains_followed_or_doubled_equal_brute_force(spark):
    want = brute(rows())
    assert found(spark, most=5, steps=0) == want
    assert found(spark, most=5, steps=1000) == want


def test_no_group_is_larger_than_two_buckets(spark):
    d = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") * 50).alias("us"), F.col("id").alias("row_id"))
    d = window_ends(busy_runs(d, ["key"], WINDOW, LEAST), ["key"], WINDOW)
    sizes = d.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert sizes == 20 and d.where("end_rn - rn <> 20 and us < 999000").count() == 0


def test_windows_of_nothing(spark):
    d = spark.createDataFrame([], "key string, us long, row_id long")
    d = window_ends(busy_runs(d, ["key"], WINDOW, LEAST), ["key"], WINDOW)
    assert d.count() == 0 and greedy_clusters(d, ["key"]).count() == 0


def test_distinct_values_ahead_equal_brute_force(spark):
    rnd = random.Random(6)
    events = [(k, us, row, rnd.choice([None, "a", "b", "c", f"v{row % 11}"])) for k, us, row in rows()]
    d = spark.createDataFrame(events, "key string, us long, row_id long, name string").withColumn("bucket", F.floor(F.col("us") / WINDOW))
    got = {r.row_id: r.seen for r in distinct_ahead(d, ["key"], WINDOW, "name", "seen").collect()}
    assert got == {row: len({n for k, t, _, n in events if k == key and us <= t <= us + WINDOW and n is not None}) for key, us, row, _ in events}


def test_one_address_with_all_failures_in_one_bucket_takes_seconds(spark):
    """A spray of 100 000 failures for 50 000 accounts within a window: linear, where pairs would be 10^10."""
    d = spark.range(100_000).select(F.lit("hot").alias("key"), (F.col("id") % 900).alias("us"), F.col("id").alias("row_id"), (F.col("id") % 50_000).cast("string").alias("name"))
    began = time.monotonic()
    d = window_ends(busy_runs(d, ["key"], WINDOW, LEAST), ["key"], WINDOW)
    d = distinct_ahead(d, ["key"], WINDOW, "name", "seen")
    c = greedy_clusters(d.where(F.col("seen") >= LEAST), ["key"])
    assert [tuple(r) for r in c.select("rn", "end_rn").collect()] == [(1, 100_000)]
    assert time.monotonic() - began < 60
