"""Top-k search and mixing against brute force, and their edge cases."""

import math
import re

import pytest

from emberlog.llm import mixing, topk

VECTORS = "vec_id long, embedding array<float>, label int, norm string"


def brute_top(rows, k):
    good = {i: [math.floor(64 * float(x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in good if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def run_top(spark, rows, k=20, **how):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS)
    vectors = topk.quantised_vectors(df)
    found = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k, **how)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seeds,bucket_rows", [(8, 16), (64, 4096)])
def test_top_k_equals_brute_force(spark, seeds, bucket_rows):
    import random

    rnd = random.Random(3)
    base = [rnd.gauss(0, 1) for _ in range(8)]
    rows = []
    for i in range(300):
        near = i % 3 == 0  # a cluster, so that thresholds are high and coordinates prune
        v = [(b if near else 0) + rnd.gauss(0, 0.05 if near else 1) for b in base]
        length = 2.0 ** rnd.uniform(-4, 2)
        rows.append((i, [float(__import__("numpy").float32(x * length)) for x in v]))
    rows += [(300 + j, rows[0][1]) for j in range(30)]  # ties
    assert run_top(spark, rows, 20, seeds=seeds, bucket_rows=bucket_rows, query_rows=8) == brute_top(rows, 20)


def test_top_k_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [-1.0, 2.0]), (6, [0.5, 0.5]), (40, [])]
    got = run_top(spark, rows, 20)
    assert {r[2] for r in got} == {0, 20, 5, 6, 40}
    assert got == brute_top([(i, (v + [0.0, 0.0])[:2] if v is not None else v) for i, v in rows], 20)
    assert run_top(spark, [], 20) == []
    big = run_top(spark, [(0, [1e18, 1.0]), (1, [1e18, 3.0])], 1)
    assert big == [(0, 1, 1, 2**63 - 1)]


def test_top_k_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 1.0]), (1, [3.0, 0.5]), (2, [2.0, 0.0])]
    got = run_top(spark, rows, 20)
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w)), c) for j, (c, w) in enumerate(rows) if j != i)
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    assert got == sorted(want)


def test_top_k_searches_only_blocks_that_can_win(spark, monkeypatch):
    # Queries whose bound asks for long vectors never meet the blocks of short ones.
    rows = [(i, [100.0 + i, 1.0]) for i in range(40)] + [(1000 + i, [0.01, 0.02]) for i in range(1, 400) if i % 20]
    assert run_top(spark, rows, 5, seeds=16, bucket_rows=8, query_rows=4) == brute_top(rows, 5)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def brute_targets(sizes, most=3, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, list(names)
    while open_:
        left = total - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            open_.remove(s)
    return target


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", s, 0, "x") for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 10 + [None] * 5)]
    rows += [(1000, None, "en", "a", 0, "x"), (1001, "", None, "d", 0, "x"), (0, rows[0][1], "en", "a", 0, "x")]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(sizes)
    by_size = {}
    for r in got:
        by_size.setdefault(r.source_size, [r.target, 0])
        by_size[r.source_size][1] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    for s, t in want.items():
        assert by_size[sizes[s]][0] == pytest.approx(t)
        assert abs(by_size[sizes[s]][1] - t) <= 1
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    assert sorted((r.doc_id, r["size"], r.taken, r.position or -1) for r in got) == sorted((r.doc_id, r["size"], r.taken, r.position or -1) for r in again)


def test_positions_invert_the_schedule():
    for knots in mixing.SCHEDULES:
        parts = mixing._share(knots)
        t, length, m, slope, before = parts[-1]
        assert before + length * (m + slope * length / 2) == pytest.approx(1)


def test_time_inverts_the_integral_of_the_schedule(spark):
    from pyspark.sql import functions as F

    shares = spark.range(0, 101).select((F.col("id") / 100).alias("share"))
    for knots in mixing.SCHEDULES:
        timed = shares.select("share", mixing.position_of(F.col("share"), knots).alias("time"))
        for r in timed.select("share", "time", mixing.demand_at(F.col("time"), knots).alias("back")).collect():
            steps = [(r.time * (i + 0.5) / 2000) for i in range(2000)]
            weight = lambda t: next(a[1] + (t - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(knots, knots[1:]) if t <= b[0])  # noqa: E731, B023
            area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
            assert sum(map(weight, steps)) * r.time / 2000 / area == pytest.approx(r.share, abs=1e-5)
            assert r.back == pytest.approx(r.share, abs=1e-12)


def test_tokens_count_the_demand_of_all_sources(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "abcde"[i % 5], 0, "x") for i in range(400)]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect() if r.token is not None]
    due = {w: sum({r.source_size: r.due for r in got if r.weight == w}.values()) for w in (5, 2, 1)}
    schedules = dict(zip((5, 2, 1), mixing.SCHEDULES))
    def asked(w, t):
        knots, n = schedules[w], 400
        weight = lambda x: next(a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(knots, knots[1:]) if x <= b[0])
        return due[w] * sum(weight(t * (i + 0.5) / n) for i in range(n)) * t / n
    for r in got[::7]:
        assert r.token == pytest.approx(sum(asked(w, r.time) for w in due), rel=1e-4, abs=1e-6)
        assert r.position == pytest.approx(r.token / sum(due.values()))


def test_mix_of_odd_rows(spark):
    rows = [(1, "word " * 300_000, "en", "a", 0, "x"), (2, None, None, None, None, None), (None, "a b", "en", "a", 0, "x"), (None, "a b", "en", "a", 0, "x")]
    docs = spark.createDataFrame(rows, DOCS)  # with a column named size
    got = sorted((str(r.doc_id), r["size"]) for r in mixing.mix(docs).collect())
    assert got == [("1", 300_000), ("2", 0), ("None", 2), ("None", 2)]
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_positions_follow_the_curriculum(spark):
    rows = [(i, "one two three", "en", s, 0, "x") for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 200)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).where("position is not null").collect()
    mean = lambda w: sum(r.position for r in got if r.weight == w) / sum(1 for r in got if r.weight == w)
    first = lambda w: sum(1 for r in got if r.weight == w and r.position < 0.2) / sum(1 for r in got if r.weight == w)
    assert first(5) > first(2) > first(1)
    assert all(0 <= r.position <= 1 for r in got) and mean(5) > 0


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, "one two", "en", "a", 7, "x") for i in range(30)] + [(100 + i, "x y z", "de", "b", 5, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = {r.doc_id: r.occurrences for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {k: v for k, v in plan.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
