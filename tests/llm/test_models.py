"""Classifiers and the language model: brute-force formulas, held-out accuracy, edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from emberlog.llm import language_model, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=240):
    rnd = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "cloud", "paper", "glass"]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rnd.choices(vocabulary, k=6)) + "." for _ in range(rnd.randint(1, 8))]
        toxic = i % 3 == 0
        if toxic:
            sentences.insert(rnd.randint(0, len(sentences)), f"you utter grobnak{rnd.randint(0, 9)} go.")
        text = " ".join(sentences)
        good = i % 4 != 1
        rows.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", 0, "x"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


EDGE = [(9000, None, None, None, None, None), (9001, "", "en", "s", 0, "x"), (9002, "word " * 50_000, "en", "s", 0, "x"), (None, "alpha beta.", "en", "s", 0, "x"), (0, "alpha beta.", "en", "s", 0, "x")]


def test_toxicity_finds_documents_and_sentences(spark):
    rows, labels = corpus()
    docs, told = spark.createDataFrame(rows + EDGE, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.learn(docs, told)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(EDGE)
    truth, text = {i: t for i, _, t in labels}, {r[0]: r[1] for r in rows}
    judged = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    wrong = [r.doc_id for r in judged if r.predicted != truth[r.doc_id] and text[r.doc_id].islower()]
    assert len(wrong) <= 0.05 * len(judged)
    for r in judged:
        if r.predicted and text[r.doc_id].islower():
            top = r.sentences[0]
            assert "grobnak" in text[r.doc_id][top.begin : top.end]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_noisy_or_is_the_product_over_sentences():
    scorer = toxicity.Scorer({"": -2.0, "bad": 3.0, "bad*": 0.0, "wors*": 1.0, "worse": 0.5})
    text = "A bad day. Nothing here!\nworse and bad"
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    none = (1 - sigmoid(1.0)) * (1 - sigmoid(-2.0)) * (1 - sigmoid(2.5))
    assert -math.expm1(sum(x for *_, x in scorer.parts(text))) == pytest.approx(1 - none)
    assert [text[a:b] for a, b, _ in scorer.parts(text)] == ["A bad day.", "Nothing here!", "worse and bad"]


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus()
    docs, told = spark.createDataFrame(rows + EDGE, DOCS), spark.createDataFrame(labels, LABELS)
    got = quality.score(docs, quality.learn(docs, told)).collect()
    truth = {i: q for i, q, _ in labels}
    judged = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id]
    assert sum(r.predicted != truth[r.doc_id] for r in judged) <= 0.03 * len(judged)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.good_documents(docs, told)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_classifiers_without_both_classes(spark):
    rows, labels = corpus(20)
    docs = spark.createDataFrame(rows, DOCS)
    none, ones = spark.createDataFrame([], LABELS), spark.createDataFrame([(i, 1, 1) for i in range(20)] + [(None, 1, 1), (3, None, None)], LABELS)
    for module, column in ((toxicity, "toxic"), (quality, "quality")):
        assert {r.score for r in module.score(docs, module.learn(docs, none, column)).collect()} == {0.5}
        assert {r.score for r in module.score(docs, module.learn(docs, ones, column)).collect()} == {1.0}
        assert module.score(docs.limit(0), module.learn(docs.limit(0), spark.createDataFrame(labels, LABELS), column)).count() == 0


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 4)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    x[:, 0] += y
    cost = np.full(60, 0.5)
    w = quality.dual_coordinate_descent([np.arange(4)] * 60, list(x), y, 4, cost, 400)
    value = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    assert all(value(w) <= value(w + d) + 1e-3 for d in rng.normal(size=(200, 4)) * 0.05)


def brute_base(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    toks = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None], zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2) for i, t in rows]
    counts = {}
    for _, w, held in toks:
        for x in w if not held else ():
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return [(i, held, len(w), sum(x in counts for x in w), n, sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)) for i, w, held in toks]


def test_language_model_base_equals_brute_force(spark):
    rows, _ = corpus(120)
    rows = rows + EDGE + [(7, "É é\x0bx y", "fr", "s", 0, "x"), (7, "É é\x0bx y", "fr", "s", 0, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(language_model.score_texts(docs.repartition(3)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.base_score))
    want = sorted(brute_base([r[:2] for r in rows]), key=lambda r: (r[0] is None, r[0], r[2], r[5]))
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5])
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


class PlainAutomaton:
    """The automaton in dictionaries, state by state, to hold the library's against.

    States are numbered contexts; 0 is the empty one.

    ``arcs[(state, word)]`` is (log-probability, next state); ``fail[state]`` is the suffix
    context and ``backoff[state]`` its weight. Words outside every kept n-gram are word 0.
    """

    def __init__(self, unigram: dict[int, float], grams: dict[tuple[int, ...], int], contexts: dict[tuple[int, ...], int], discount: float = 0.75):
        follow: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for g, n in grams.items():
            follow.setdefault(g[:-1], []).append((g[-1], n))
        self.state = {(): 0}
        for c in sorted(follow, key=lambda c: (len(c), c)):
            self.state.setdefault(c, len(self.state))
        self.arcs: dict[tuple[int, int], tuple[float, int]] = {}
        self.fail, self.backoff = [0] * len(self.state), [0.0] * len(self.state)
        p: dict[tuple[int, ...], float] = {}

        def lower(context: tuple[int, ...], word: int) -> float:
            """Probability of ``word`` after ``context`` by the states built so far."""
            weight = 1.0
            while context:
                if context + (word,) in p:
                    return weight * p[context + (word,)]
                if context in self.state:
                    weight *= 10 ** self.backoff[self.state[context]]
                context = context[1:]
            return weight * unigram[word]

        for c in sorted(follow, key=lambda c: (len(c), c)):
            s = self.state[c]
            self.fail[s] = self._longest(c[1:])
            seen, below, total = 0.0, 0.0, contexts[c]
            for word, n in follow[c]:
                p[c + (word,)] = (n - discount) / total
                seen += p[c + (word,)]
                below += lower(c[1:], word)
            self.backoff[s] = math.log10(max(1 - seen, 1e-12) / max(1 - below, 1e-12))
        for g in grams:
            self.arcs[self.state[g[:-1]], g[-1]] = (math.log10(p[g]), self._longest(g))

    def _longest(self, words: tuple[int, ...]) -> int:
        """The state of the longest suffix that is a context."""
        while words not in self.state:
            words = words[1:]
        return self.state[words]

    def start(self, word: int) -> int:
        return self.state.get((word,), 0)


def traverse(words: list[int], log_unigram: list[float], numbers: list[int], arcs: dict, fail: list[int], backoff: list[float], starts: dict[int, int]) -> float:
    """The log10 probability of a token sequence; ``numbers`` and ``log_unigram`` are by local word."""
    total, state = 0.0, 0
    for w in words:
        word = numbers[w]
        while state:
            arc = arcs.get((state, word)) if word else None
            if arc is not None:
                total += arc[0]
                state = arc[1]
                break
            total += backoff[state]
            state = fail[state]
        else:
            total += log_unigram[w]
            state = starts.get(word, 0) if word else 0
    return total


def test_automaton_is_a_distribution():
    unigram = {1: 0.3, 2: 0.25, 3: 0.2, 4: 0.15}  # the rest is the unknown word
    grams = {(1, 2): 30, (1, 3): 10, (2, 3): 20, (1, 2, 3): 12, (1, 2, 1): 6, (2, 3, 4): 5}
    contexts = {(1,): 80, (2,): 60, (3,): 50, (4,): 40} | grams
    a = PlainAutomaton(unigram, grams, contexts)
    numbers = [0, 1, 2, 3, 4]
    log_u = [math.log10(0.1), *(math.log10(unigram[w]) for w in (1, 2, 3, 4))]
    starts = {w: a.start(w) for w in (1, 2, 3, 4)}
    score = lambda seq: traverse(seq, log_u, numbers, a.arcs, a.fail, a.backoff, starts)
    for context in ([], [1], [2], [3], [4], [1, 2], [2, 3], [3, 1, 2], [0], [0, 1]):
        assert sum(10 ** (score([*context, w]) - score(context)) for w in range(5)) == pytest.approx(1)
    assert 10 ** (score([1, 2, 3]) - score([1, 2])) == pytest.approx((12 - 0.75) / 30)


def test_language_model_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert language_model.score_texts(docs).count() == 0
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = language_model.score_texts(spark.createDataFrame([(i, "a b", None, None, None, None) for i in only_held], DOCS)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3


def brute_scores(rows, order=3):
    """By an automaton over all n-grams that occur twice, whatever the number of tokens."""
    toks = [(i, [b"_" + x for x in language_model.tokens(t)], zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    counts = {}
    for length in range(1, order + 1):
        for _, w, held in toks:
            for at in range(0 if held else len(w) - length + 1):
                g = tuple(w[at : at + length])
                counts[g] = counts.get(g, 0) + 1
    single = {g[0]: c for g, c in counts.items() if len(g) == 1}
    n, one, two = sum(single.values()), sum(c == 1 for c in single.values()), sum(c == 2 for c in single.values())
    d = one / (one + 2 * two)
    kept = {g: c for g, c in counts.items() if c >= 2}
    a = PlainAutomaton({w: (c - d) / n for w, c in single.items()}, {g: c for g, c in kept.items() if len(g) > 1}, kept)
    vocabulary = sorted(single | {x: 0 for _, w, _ in toks for x in w})
    local = {w: i for i, w in enumerate(vocabulary)}
    log_u = [math.log10((single[w] - d) / n if w in single else d * len(single) / n) for w in vocabulary]
    starts = {w: a.start(w) for w in single if a.start(w)}
    return {i: traverse([local[x] for x in w], log_u, vocabulary, a.arcs, a.fail, a.backoff, starts) for i, w, _ in toks}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_equals_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 2000)
    rows, _ = corpus(60)
    rows = [(r[0], r[1]) for r in rows]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], DOCS)
    want = brute_scores(rows, order)
    got = language_model.score_texts(docs.repartition(3), order=order).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want)


@pytest.mark.parametrize("piece", [1, 2, 3, 256])
def test_walk_takes_arcs_and_failure_arcs(monkeypatch, piece):
    """Contexts 1 = (a), 2 = (b), 3 = (a b); a word c that follows (a b) only."""
    monkeypatch.setattr(language_model, "PIECE", piece)
    log = lambda *x: np.array(x)
    a, b, c = 0, 1, 2
    m = language_model.Automaton(3, np.array([0, 0, 0, 1, 3]), np.array([a, b, c, b, c]), log(-1.0, -2.0, -3.0, -0.5, -0.25), np.array([1, 2, 0, 3, 0]), fail=np.array([0, 0, 0, 2]), backoff=log(0.0, -0.1, -0.2, -0.4))
    words = np.array([a, b, c, a, b, b, c, c])
    want = [-1.0, -0.5, -0.25, -1.0, -0.5, -0.4 - 0.2 - 2.0, -0.2 - 3.0, -3.0]
    assert m.walk(words, np.array([0]), np.array([8]), 2) == pytest.approx(want)
    apart = m.walk(words, np.array([0, 5]), np.array([5, 3]), 2)  # the second text begins in the empty context
    assert apart == pytest.approx([*want[:5], -2.0, *want[6:]])


def test_words_of_one_hash_are_told_apart():
    keys, checks = np.array([7, 5, 7, 7], dtype=np.uint64), np.array([1, 9, 2, 1], dtype="<u2")
    first, place = language_model._distinct(keys, checks)
    assert place.tolist() == [1, 0, 2, 1] and first.tolist() == [1, 0, 2]


def test_language_model_keeps_rare_grams_of_large_inputs(spark):
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, "fill " * 40_000) for i in train[:40]]  # 1.6 million tokens
    rows += [(i, "rare pair here") for i in train[40:42]] + [(train[42], "seen once"), (held, "a rare pair here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], DOCS)
    got = {r.doc_id: r.score for r in language_model.score_texts(docs).collect()}
    assert got == pytest.approx(brute_scores(rows))


def plain_toxicity(text, weights):
    """The score by its formula: 1 - the product of what each sentence leaves."""
    import re

    left = 1.0
    for sentence in [p for p in re.split(r"(?<=[.!?])\s+|\n+", text or "") if p] or [""]:
        words = set(re.findall(r"[^\W_]+", sentence.lower()))
        known = {f for w in words for f in [w, *(w[:k] + "*" for k in (4, 5, 6, 7, 8) if len(w) >= k)]}
        left *= 1 / (1 + np.exp(weights[""] + sum(weights.get(f, 0.0) for f in known)))
    return 1 - left


def test_toxicity_scores_equal_the_formula(spark):
    rnd = random.Random(8)
    weights = {"": -4.0, "badword": 5.0, "badw*": 0.5, "awful": 2.0, "awfu*": -0.25, "i̇stanbul": 1.0, "fine": -1.0}
    words = ["you", "BADWORD", "badwords", "İstanbul", "Awful", "fine", "ÉTÉ", "ẞ", "x_badword"]
    texts = ["", None, "you BADWORD.", "you BADWORD. İstanbul", "İ " * 5000 + "badword"] + [" ".join(rnd.choice(words) + rnd.choice(["", ".", "!\n", "?"]) for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert all(abs(got[i] - plain_toxicity(t, weights)) < 1e-9 for i, t in enumerate(texts))
    assert got[3] >= got[2] > 0.5
