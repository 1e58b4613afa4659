"""Near-duplicates, components and the pipeline against brute force."""

import importlib
import random

import numpy as np
import pytest
import xxhash

from emberlog.llm import components, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, budget=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_equal_brute_force():
    for t in (None, "", "One", "one TWO", "a b c", "É b\x0bc d", "x y z " * 3000):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("most", [4, 2048])
def test_near_duplicates_equal_brute_force(spark, most):
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(400)]
    rows = [(i, " ".join(base[:-1] + [f"v{i}"]), "en", "s", 0, "x") for i in range(40)]  # one large group of near copies
    rows += [(100 + i, " ".join(f"u{rnd.randint(0, 99)}" for _ in range(30)), "en", "s", 0, "x") for i in range(40)]
    rows += [(200 + i, rows[45][1], "en", "s", 0, "x") for i in range(30)]
    rows += [(300, None, None, None, None, None), (301, "", "en", "s", 0, "x"), (None, rows[50][1], "en", "s", 0, "x"), (None, "lonely words here", "en", "s", 0, "x"), (5, rows[60][1], "en", "s", 0, "x"), (200, rows[45][1], "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(zip([str(r[0]) for r in rows], prints, map(str, brute_components([r[0] for r in rows], prints))))
    got = simhash.near_duplicates(docs, most=most).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == want
    kept = simhash.one_of_each(docs, most=most)
    assert kept.columns == docs.columns
    kept = kept.collect()
    groups = {}
    for r, c in zip(rows, brute_components(list(range(len(rows))), prints)):
        groups.setdefault(c, []).append((r[0], r[1]))
    assert len(kept) == len(groups)
    for r in kept:
        members = next(g for g in groups.values() if (r.doc_id, r.text) in g)
        assert r.doc_id == min((m[0] for m in members if m[0] is not None), default=None)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_trie_pairs_equal_brute_force():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = np.concatenate([centre[rng.integers(0, 6, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)), rng.integers(0, 2**63, 200, dtype=np.uint64)])
    values = np.unique(values)
    cells = np.sort(rng.integers(0, 3, len(values)))
    order = np.lexsort((values, cells))
    values, cells = values[order], cells[order]
    i, j = simhash.trie_pairs(values, cells, 3)
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if cells[a] == cells[b] and int(values[a] ^ values[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_cells_cover_all_bits():
    masks = simhash._masks(0, 4)
    assert np.bitwise_or.reduce(np.array(masks, dtype=np.uint64)) == np.uint64(2**64 - 1) and sum(m.bit_count() for m in masks) == 64
    deeper = simhash._masks(masks[1], 4)
    assert all(m & masks[1] == masks[1] for m in deeper) and sum((m ^ masks[1]).bit_count() for m in deeper) == 48


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(-5, -9), (-9, -7), (3, 3), (2, 1)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {1000 + i: 1000 for i in range(60)} | {-5: -9, -9: -9, -7: -9}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    from emberlog.llm import decontamination, mixing, quality, sharding
    from emberlog.llm.common import read, stored

    docs = read(spark, sf_dir, "documents")
    for name, stage in pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), "test-stage")
        before, after = docs.collect(), out.collect()
        if name == "quality":
            told = {r.doc_id: r.quality for r in read(spark, sf_dir, "labels").collect()}
            kept = {r.doc_id for r in after}
            assert sum((r.doc_id in kept) != told[r.doc_id] for r in before if r.doc_id in told) <= 0.03 * len(told)
        elif name == "near_duplicates":
            from .test_similar import brute_links, groups

            roots = groups(len(before), brute_links([r.text for r in before]))
            least = {}
            for r, root in zip(before, roots):
                least[root] = min(least.get(root, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(least.values())
        elif name == "decontamination":
            from .test_text_scans import brute_leaks

            leaks = brute_leaks([r.text for r in before], [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()])
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, x in zip(before, leaks) if not x[4])
        elif name == "mixing":
            taken = {r.doc_id: r.occurrences for r in mixing.mix(docs).collect()}
            assert len(after) == sum(taken.values()) and {r.doc_id for r in after} == {k for k, v in taken.items() if v}
        else:
            assert len(after) == len(before) and {r.shard for r in after} <= set(range(40))
        assert out.columns[: len(docs.columns)] == docs.columns
        docs = out
    assert pipeline.run(spark, sf_dir).count() == docs.count()


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeats, clashing names, and no rows at all."""
    pipeline = importlib.import_module("corpus_pipeline")
    from emberlog.llm import decontamination, mixing, sharding, similar

    rows = [(i, f"some words of text number {i} that differ from all others {i * 7}", "en", "s", 0, i, "x") for i in range(30)]
    rows += [(None, None, None, None, None, None, None), (None, "", "en", "s", 0, 1, "x"), (40, "long " * 100_000, "en", None, 0, 2, "y"), (41, rows[3][1], "en", "s", 0, 3, "x"), (3, rows[3][1], "en", "s", 0, 3, "x"), (3, rows[3][1], "en", "s", 0, 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, position string")
    bench = spark.createDataFrame([(1, "some words of text number 5 that differ from all others 35", "x"), (None, None, None)], "item_id long, text string, shard string")
    stages = [lambda d: similar.distinct_documents(d), lambda d: decontamination.clean_documents(d, bench), mixing.mixed_documents, sharding.sharded_documents]
    for d in (docs, docs.limit(0)):
        for stage in stages:
            out = stage(d)
            assert set(out.columns) == set(docs.columns)
            d = out
        got = d.collect()
        if got:
            ids = {r.doc_id for r in got}
            assert 41 not in ids and 5 not in ids and 3 in ids and 40 in ids
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
