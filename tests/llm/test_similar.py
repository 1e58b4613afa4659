"""Near-duplicates by similarity against brute force over all pairs."""

import random
import re

import pytest

from emberlog.llm import similar
from emberlog.llm.common import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long, unit string"


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def brute_links(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for g in s or {()}:
            where.setdefault(g, []).append(i)
    seen = {(a, b) for rows in where.values() for n, a in enumerate(rows) for b in rows[n + 1 :]}
    return {(a, b) for a, b in seen if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"z{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("most", [16, 1024])
def test_groups_equal_brute_force(spark, most):
    rnd = random.Random(8)
    texts = []
    for i in range(40):
        base = [f"w{rnd.randrange(900)}" for _ in range(rnd.randrange(40, 300))]
        texts += [" ".join(base), edited(rnd, base, 1), edited(rnd, base, 1 + i % 4), " ".join(base).upper()]
    base = [f"c{rnd.randrange(900)}" for _ in range(250)]  # one large group of near copies
    texts += [edited(rnd, base, 3) for _ in range(150)]
    texts += [None, "", "   ", "one two", "one two", "One  TWO", "word " * 30_000, "a b c d e"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)], DOCS)
    prints = similar.units(docs, 5)
    links = similar.candidates(prints.groupBy("unit").agg({"hi": "min", "lo": "min"}).toDF("unit", "hi", "lo"), most=most)
    assert links.where("a >= b").count() == 0
    want, root = brute_links(texts), groups(len(texts), brute_links(texts))
    if most == 1024:
        rows = similar.near_copies(docs).collect()
        got = [0] * len(texts)
        for r in rows:
            got[r.doc_id] = r.first.doc_id
        # Every group holds links that brute force has, and hardly any link is lost.
        assert all(root[i] == root[got[i]] for i in range(len(texts)))
        assert sum(got[a] == got[b] for a, b in want) >= 0.99 * len(want)
    else:
        pairs = {(r.a, r.b) for r in similar.confirmed(links, docs, prints, 5, 0.8).collect()}
        unit = {r.doc_id: r.unit for r in prints.collect()}
        at = {}
        for i in range(len(texts)):
            at.setdefault(unit[i], i)
        found = groups(len(texts), {(at[a], at[b]) for a, b in pairs} | {(at[unit[i]], i) for i in range(len(texts))})
        assert all(root[at[a]] == root[at[b]] for a, b in pairs)
        assert sum(found[a] == found[b] for a, b in want) >= 0.97 * len(want)


def test_documents_that_stay(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(7, long, "en", "s", 0, "x"), (3, long + " more", "en", "s", 0, "x"), (None, long, "en", "s", 0, "x"), (9, "other text of six words here", None, None, None, None), (9, "other text of six words here", None, None, None, None), (None, None, None, None, None, None), (4, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = similar.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, long + " more"), (4, ""), (9, "other text of six words here")]
    assert similar.distinct_documents(docs.limit(0)).count() == 0


def test_recall_on_driver_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    want = brute_links([texts[i] for i in ids])
    got = {r.doc_id: r.first.doc_id for r in similar.near_copies(docs).collect()}
    root = groups(len(ids), want)
    at = {i: n for n, i in enumerate(ids)}
    assert all(root[at[i]] == root[at[f]] for i, f in got.items())
    assert sum(got[ids[a]] == got[ids[b]] for a, b in want) >= 0.9 * len(want)


def test_no_link_depends_on_fingerprints(spark):
    rnd = random.Random(5)
    texts = []
    for i in range(30):  # one pair each at the threshold or just above, and one just below
        base = [f"p{i}w{k}" for k in range(60 + 7 * i)]
        cut = (len(base) - 4) // 9
        texts += [" ".join(base), " ".join(base[:-cut] + [f"q{rnd.randrange(10**9)}" for _ in range(cut)]), " ".join(base[: -cut - 3] + [f"r{rnd.randrange(10**9)}" for _ in range(cut + 3)])]
    line = [f"c{k}" for k in range(40)]  # a line that many have
    texts += [" ".join(line + [f"m{i}x{k}" for k in range(12)]) for i in range(60)] + [" ".join(line + ["end"]), " ".join(["start", *line])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)], DOCS)
    root = groups(len(texts), brute_links(texts))
    assert len(set(root)) < len(texts) - 30
    for recall in (0.01, 0.95):
        got = {r.doc_id: r.first.doc_id for r in similar.near_copies(docs, recall=recall).collect()}
        assert all((root[a] == root[b]) == (got[a] == got[b]) for a in range(len(texts)) for b in range(a))


@pytest.mark.parametrize("most", [8, 4096])
def test_missed_candidates_hold_every_link(spark, most):
    rnd = random.Random(9)
    base = [f"c{rnd.randrange(900)}" for _ in range(120)]
    texts = sorted({edited(rnd, base, 2 + i % 5) for i in range(80)} | {edited(rnd, [f"d{k}" for k in range(90)], 1 + i % 3) for i in range(30)})
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)], DOCS)
    for often in (similar.often_seen(docs, 5, part=1), similar.often_seen(docs, 5, part=1, least=10**9)):
        prints = similar.units(docs, 5, 0.8, often)
        unit = {r.doc_id: r.unit for r in prints.collect()}
        alone = prints.selectExpr("unit", "unit AS root", "n", "first_ones")
        found = {(r.a, r.b) for r in similar.missed_candidates(alone, 0.8, most).collect()}
        want = {(min(unit[a], unit[b]), max(unit[a], unit[b])) for a, b in brute_links(texts)}
        assert want and want <= found
        likely = {(r.a, r.b) for r in similar.not_apart(similar.missed_candidates(alone, 0.8, most), prints.select("unit", "n", "counts")).collect()}
        assert want <= likely <= found
        # Of units that have a group already only pairs across groups are asked for.
        parts = alone.selectExpr("unit", "CAST(pmod(unit, 2) AS long) AS root", "n", "first_ones")
        crossing = {(r.a, r.b) for r in similar.missed_candidates(parts, 0.8, most).collect()}
        assert crossing == {(a, b) for a, b in found if a % 2 != b % 2}
