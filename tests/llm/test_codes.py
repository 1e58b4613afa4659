"""Vector codes against a plain codebook fit."""

import hashlib
import math
import random

import numpy as np
import pytest

from emberlog.llm import codes
from emberlog.llm.common import stored

ROWS = "vec_id long, embedding array<float>, label int, code string, row long"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    size = width // parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    code, error, final = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        x = [v[p * size : (p + 1) * size] for _, v, _ in kept]
        book = [list(v) for v in x[:entries]]
        for step in range(rounds + 1):
            at = [min(((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book)), default=(0, 0)) for v in x]
            if step == rounds:
                break
            for k in range(len(book)):
                mine = [v for v, (_, g) in zip(x, at) if g == k]
                if mine:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        for n, (d, k) in enumerate(at):
            code[n] += f"{k:02x}"
            error[n] += d
        final += [c for e in book for c in e]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for (i, _, label), c, e in zip(kept, code, error)), key=repr)


def table(spark, rows):
    return stored(codes.quantised(spark.createDataFrame(rows, ROWS)), "vectors")


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(n, width, clusters=None, seed=1):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, width)) if clusters is None else rnd.normal(size=(clusters, width))[rnd.integers(0, clusters, n)] + rnd.normal(size=(n, width)) * 0.01
    return [[float(np.float32(x)) for x in row] for row in v]


@pytest.mark.parametrize("entries, block", [(16, 8), (256, 64), (5, 1)])
def test_codes_equal_brute_force(spark, entries, block):
    rnd = random.Random(2)
    rows = [(i, v, rnd.choice([None, 1, 2]), "x", 0) for i, v in enumerate(vectors(120, 8))]
    rows += [(200 + i, rows[3][1], None, None, None) for i in range(90)]  # one vector in many rows
    rows += [(5, rows[9][1], 2, None, None), (5, rows[5][1], 1, None, None), (None, rows[7][1], 1, None, None), (-3, [0.0] * 8, 7, None, None)]
    rows += [(300, None, 1, None, None), (301, [1.0] * 7 + [None], 1, None, None), (302, [float("nan")] * 8, 1, None, None), (303, [float("inf")] * 8, 1, None, None), (304, rows[0][1][:5], 1, None, None)]
    assert got(codes.encode(table(spark, rows), entries=entries, block=block)) == brute(rows, entries=entries)


def test_widths_that_parts_do_not_divide_and_large_components(spark):
    rows = [(i, [x * 3e5 for x in v], i % 2, None, None) for i, v in enumerate(vectors(40, 6))]
    assert got(codes.encode(table(spark, rows), entries=6, block=4)) == brute(rows, entries=6)
    rows = [(i, [x * 1e6 for x in v], i % 2, None, None) for i, v in enumerate(vectors(30, 4))]  # sums beyond 2^53
    assert got(codes.encode(table(spark, rows), entries=4, block=4)) == brute(rows, entries=4)
    huge = got(codes.encode(table(spark, [(1, [3e38] * 4, 1, None, None), (2, [-3e38] * 4, 1, None, None)]), entries=1))
    assert [r[2] for r in huge] == [codes.LONG] * 2  # distances beyond a long saturate


def test_empty_tables_and_empty_vectors(spark):
    assert got(codes.encode(table(spark, []))) == []
    assert [r[1:3] for r in got(codes.encode(table(spark, [(1, [], None, None, None), (2, [], 3, None, None)])))] == [("00000000", 0)] * 2


def test_short_lists_hold_every_nearest_entry_and_clusters_cut_them():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        book, x = rnd.integers(-9, 9, (12, 3)), rnd.integers(-9, 9, (5, 3)) // rnd.integers(1, 6)
        short = codes.shortlist(x.min(axis=0), x.max(axis=0), book)
        d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert set(d.argmin(axis=1)) <= set(short.tolist())
        at, error = codes.nearest(x, book[short])
        assert (short[at] == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_clusters_are_coded_by_sums_of_blocks(spark):
    rows = [(i, v, 0, None, None) for i, v in enumerate(vectors(2000, 8, clusters=6))]
    vectors_ = table(spark, rows)
    first = np.array([r.v for r in vectors_.orderBy("vec_id").limit(16).collect()])
    blocks = codes.flat_blocks(vectors_, 8, 4, block=32)
    _, work = codes.learn(blocks, [first[:, p * 2 : p * 2 + 2].copy() for p in range(4)], 2)
    assert all(w < 0.5 * 2000 * 4 * 16 for w in work)


def test_curve_steps_to_neighbours():
    side = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = codes.hilbert_keys(side, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = side[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
