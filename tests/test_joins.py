"""What comes first after an event, and which texts contain which names, against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from emberlog.operators import containment
from emberlog.operators.containment import containing
from emberlog.operators.windows import first_after

BUCKET = 100


def sides(seed=1, n=300):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, "", "x", "y", "*", "="])
    anchors = [(i, rnd.choice([None, "k", "l"]), value(), value(), rnd.randrange(0, 3000), rnd.choice([-5, 0, 30, 250])) for i in range(n)]
    others = [(1000 + i, rnd.choice([None, "k", "l"]), value(), value(), rnd.choice([None, rnd.randrange(0, 3300), 500])) for i in range(n)]
    return anchors, others


def brute(anchors, others, keyed, loose):
    out = {}
    for i, k, h, u, low, more in anchors:
        fits = lambda a, b: not a or not b or a == b
        hits = [
            (t, j, h2) for j, k2, h2, u2, t in others
            if t is not None and low <= t <= low + more and (not keyed or (k is not None and k == k2)) and (loose < 1 or fits(h, h2)) and (loose < 2 or fits(u, u2))
        ]
        if hits:
            out[i] = min(hits, key=lambda x: x[:2])
    return out


@pytest.mark.parametrize("keyed, loose", [(True, 0), (False, 0), (True, 1), (False, 1), (False, 2)])
def test_first_after_equals_brute_force(spark, keyed, loose):
    anchors, others = sides(loose)
    a = spark.createDataFrame(anchors, "a_id long, a_key string, a_host string, a_user string, a_us long, more long")
    o = spark.createDataFrame(others, "o_id long, o_key string, o_host string, o_user string, o_us long")
    pairs = [("a_host", "o_host"), ("a_user", "o_user")][:loose]
    got = first_after(a, o, "a_id", [("a_key", "o_key")] if keyed else [], F.col("a_us"), F.col("a_us") + F.col("more"), "o_us", "o_id", BUCKET, ["o_host"], pairs)
    assert {r.a_id: tuple(r.hit) for r in got.collect()} == brute(anchors, others, keyed, loose)


def test_one_host_with_many_anchors_and_successors_takes_seconds(spark):
    """100 000 of each in one bucket: 10^10 pairs, were they joined."""
    a = spark.range(100_000).select(F.col("id").alias("a_id"), F.lit("h").alias("a_host"), (F.col("id") % 50).alias("a_us"))
    o = spark.range(100_000).select(F.col("id").alias("o_id"), F.lit("h").alias("o_host"), (50 + F.col("id") % 40).alias("o_us"))
    began = time.monotonic()
    got = first_after(a, o, "a_id", [], F.col("a_us"), F.col("a_us") + BUCKET, "o_us", "o_id", BUCKET, loose=[("a_host", "o_host")])
    assert [tuple(r) for r in got.groupBy("hit.us", "hit.id").count().collect()] == [(50, 0, 100_000)]
    assert time.monotonic() - began < 60


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abC\\:.é ") for _ in range(n))
    texts = [(i, word(rnd.randrange(0, 60))) for i in range(200)] + [(500, None), (501, ""), (502, "x" * 20_000 + "C:\\Windows\\System32\\cmd.EXE /c dir"), (503, "cmd.exe")]
    patterns = [word(n) for n in range(1, 20) for _ in range(6)] + [None, "", "cmd.exe", "c:\\windows\\system32\\CMD.exe", "É", "dir", texts[3][1], texts[4][1]]
    return texts, patterns


@pytest.mark.parametrize("most", [0, 200_000])
def test_containment_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(containment, "BROADCAST_ROWS", most)
    texts, patterns = corpus(3)
    t = spark.createDataFrame(texts, "id long, text string")
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    got = sorted(tuple(r) for r in containing(t, "id", "text", p).collect())
    assert got == sorted({(i, x.lower()) for i, text in texts for x in patterns if text and x and x.lower() in text.lower()})
    assert containing(t, "id", "text", p.limit(0)).count() == 0 and containing(t.limit(0), "id", "text", p).count() == 0


def test_patterns_stand_under_their_rarest_stretch(spark):
    """Folders that all share are not what is looked up."""
    p = spark.createDataFrame([(f"c:\\windows\\{n}",) for n in ("alphabeta.exe", "gammadelta.exe", "omegasigma.exe")], "pattern string")
    grams = containment.pattern_grams(p)
    assert grams.groupBy("pattern").count().agg(F.min("count")).first()[0] == 8
    assert not [r.gram for r in grams.collect() if r.gram in "c:\\windows\\"]
