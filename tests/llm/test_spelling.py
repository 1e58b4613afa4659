"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import spelling

DOCS = "doc_id long, text string, word string, n long, cell string"


def brute_counts(rows, mod=97):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if mod and h % mod == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    form, out = {}, []
    near = {w: [o for o in counts if o != w and one_edit(w, o)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def corpus(seed=1):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(stems) for _ in range(80)) + " İstanbul ÀÉÎÕÜ ÀÉÎÕü WORD5 Abcdef×÷") for i in range(90)]
    rows += [(None, None), (None, "nullid nullid nullid"), (7, ""), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(200 + i, "z" * (4000 + i % 2) + " " + "z" * 4000) for i in range(6)]  # long words, one edit apart
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("block", [2, 5, 2048])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0, "y") for i, t in rows], DOCS)
    words = spelling.word_counts(docs, typo_mod=97)
    want = brute_counts(rows)
    assert {r.word: r.n for r in words.collect()} == want
    assert got(spelling.variants(words)) == brute_variants(want)


@pytest.mark.parametrize("segments", [1, 2, 5])
def test_segments_do_not_change_the_result(spark, segments):
    words = {w: n for w, n in zip(["aaaaa", "aaaaaa", "aaaab", "baaaa", "ababab", "bababa", "abababa", "aabbb", "日本語日本", "日本語日木"], range(1, 30))}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    near = {r.word: (r.n_near, r.best) for r in spelling.near_words(df, segments).collect()}
    for w in words:
        others = sorted((o for o in words if o != w and one_edit(w, o)), key=lambda o: (-words[o], o))
        assert near.get(w, (0, None)) == (len(others), others[0] if others else None)


def test_ties_go_to_the_smallest_word_and_chains_to_their_end(spark):
    words = {"abcde": 4, "abcdf": 8, "abcdg": 8, "abcxg": 16, "abyxg": 32, "azyxg": 64, "bzyxg": 128, "lonely": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(df)) == brute_variants(words)


def test_long_texts_are_read_in_slices(monkeypatch):
    text = " ".join(random.Random(3).choice(["alpha", "Betas", "gammadelta", "xy", "ä" * 40]) for _ in range(500))
    whole = spelling.runs(text, 5)
    monkeypatch.setattr(spelling, "SLICE", 7)
    assert spelling.runs(text, 5) == whole == Counter(r for r in re.findall("[A-Za-zÀ-ÿ]+", text) if len(r) >= 5)


def test_tiles_are_padded_little():
    sides = [spelling._side(n) for n in range(2, 200)]
    assert all(s >= n and s <= 1.5 * n for n, s in zip(range(2, 200), sides) if n > 2)
    assert spelling._points(["ab", "c"], 3, True).tolist() == [[0, 97, 98], [0, 0, 99]]
    assert spelling._points(["日", ""], 1, False).dtype == np.uint32


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert got(spelling.variants(spelling.word_counts(empty, typo_mod=97))) == []
    few = spark.createDataFrame([(1, "some words seen once", None, None, None)], DOCS)
    assert got(spelling.variants(spelling.word_counts(few))) == []
