"""Quality by Naive Bayes support vectors.

Indicators of n-grams, scaled by the log-count ratio of the classes, go into a linear hinge-loss
model that dual coordinate descent fits; a sigmoid turns margins into probabilities. The n-grams
are words, and one and two consecutive word shapes (case, what a word ends in, whether it repeats
the word before) at each power of two of their share of the text.

Defined cases: a null text is an empty one and has no n-gram (its score is the sigmoid of the
bias); rows that repeat score alike; without labels of both classes every score is the share of
label 1 (0.5 without labels); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, prior, training_sample

_TAIL = re.compile(r"[^\w\s]+$")


def shape(word: str) -> str:
    tail = _TAIL.search(word)
    core = word[: tail.start()] if tail else word
    mark = tail[0][:2] if tail else ""
    if not core:
        return "p" + word[:2]
    kind = "d" if core.isdigit() else "U" if len(core) > 1 and core.isupper() else "l" if core.islower() else "T" if core[:1].isupper() and (core[1:].islower() or len(core) == 1) else "m"
    return kind + ("" if mark in (".", ",") else mark)


class Grams:
    """The distinct n-grams of a text. Shapes of words are kept, up to a bound."""

    def __init__(self):
        self.shapes: dict[str, str] = {}

    def of(self, text: str | None) -> list[str]:
        words = (text or "").split()
        if not words:
            return []
        if len(self.shapes) > 300_000:
            self.shapes.clear()
        known = self.shapes
        shapes = []
        for w in words:
            s = known.get(w)
            if s is None:
                s = known[w] = shape(w)
            shapes.append(s)
        n = len(words)
        counts = Counter(shapes)
        for (a, b), c in Counter(zip(shapes, shapes[1:])).items():
            counts[a + "_" + b] = c
        distinct = set(words)
        counts["=repeats"] = sum(a == b for a, b in zip(words, words[1:]))
        counts["=again"] = n - len(distinct)
        lines = text.split("\n")
        counts["=lines"] = round(n * (1 - len(set(lines)) / len(lines)))
        grams = [f"{s}@{b}" for s, c in counts.items() if c for b in range(min(int(math.log2(n / c)), 7), 8)]
        grams += [f"n@{b}" for b in range(min(n.bit_length(), 12), 13)]
        grams += ["w:" + w for w in {w.lower() for w in distinct}]
        return grams


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, cost: np.ndarray, rounds: int = 15) -> np.ndarray:
    """min |w|^2 / 2 + sum cost_i * max(0, 1 - y_i w.x_i): one dual variable a step, in its box."""
    w, alpha = np.zeros(width), np.zeros(len(y))
    square = np.array([v @ v for v in values])
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            if not square[i]:
                continue
            gradient = y[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[rows[i]] += step * y[i] * values[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability, by Newton steps with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        g = np.array([r @ margin, r.sum()])
        hess = np.array([[h @ margin**2, h @ margin], [h @ margin, h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(texts: list[str | None], labels: np.ndarray, rate: float, most_grams: int = 60_000, cost: float = 4.0) -> dict[str, float]:
    """Weights by n-gram; the bias, slope and offset under "", "slope" and "offset"."""
    maker = Grams()
    bags = [maker.of(t) for t in texts]
    seen = {0: Counter(), 1: Counter()}
    for bag, label in zip(bags, labels):
        seen[int(label)].update(bag)
    n1, n0 = max(int(labels.sum()), 1), max(int(len(labels) - labels.sum()), 1)
    ratio = {}
    for g in seen[0].keys() | seen[1].keys():
        if seen[0][g] + seen[1][g] >= 5:
            ratio[g] = math.log((seen[1][g] + 1) / (n1 + 2)) - math.log((seen[0][g] + 1) / (n0 + 2))
    names = sorted(ratio, key=lambda g: (-abs(ratio[g]) * math.sqrt(seen[0][g] + seen[1][g]), g))[:most_grams]
    index, r = {g: i for i, g in enumerate(names)}, np.array([ratio[g] for g in names] + [1.0])
    rows, values = [], []
    for bag in bags:
        at = np.array([index[g] for g in bag if g in index] + [len(names)], dtype=np.int64)
        x = r[at]
        rows.append(at)
        values.append(x / math.sqrt(x @ x))
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.where(y > 0, rate / (n1 / (n1 + n0)), (1 - rate) / (n0 / (n1 + n0)))
    each = cost * np.where(y > 0, 0.5 * len(y) / n1, 0.5 * len(y) / n0)
    margins = np.zeros(len(y))
    for part in range(3):  # margins of rows that the weights were not fitted on
        out = np.arange(len(y)) % 3 == part
        if not out.any() or out.all() or len(set(y[~out])) < 2:
            continue
        inside = np.flatnonzero(~out)
        w = dual_coordinate_descent([rows[i] for i in inside], [values[i] for i in inside], y[inside], len(r), each[inside])
        for i in np.flatnonzero(out):
            margins[i] = w[rows[i]] @ values[i]
    slope, offset = _sigmoid_fit(margins, (y > 0).astype(float), share)
    w = dual_coordinate_descent(rows, values, y, len(r), each)
    out = {g: float(x) for g, x in zip(names, w * 1.0)}
    return out | {"": float(w[-1]), "slope": slope, "offset": offset} | {"r:" + g: float(x) for g, x in zip(names, r)}


class Scorer:
    def __init__(self, model: dict[str, float]):
        self.grams, self.bias, self.slope, self.offset = Grams(), model[""], model["slope"], model["offset"]
        # What a gram adds to the sum and to the squared length.
        self.parts = {g[2:]: (model[g[2:]] * x, x * x) for g, x in model.items() if g.startswith("r:")}

    def score(self, text: str | None) -> float:
        total, square = self.bias, 1.0
        parts = self.parts
        for g in self.grams.of(text):
            if g in parts:
                a, b = parts[g]
                total += a
                square += b
        z = self.slope * total / math.sqrt(square) + self.offset
        return 1 / (1 + math.exp(-max(min(z, 500), -500)))


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = 4000) -> dict[str, float] | float:
    """The model, fitted in one task on at most 2 * ``per_class`` labelled documents; the share of
    label 1 if there is one class only."""
    sample, sizes = training_sample(docs, labels, target, per_class)
    rate = prior(sizes)
    if rate in (0.0, 1.0) or not sum(sizes.values()) or sample.select("label").distinct().count() < 2:
        return rate

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            pdf = pd.concat(held).sort_values("doc_id")
            model = fit(pdf["text"].tolist(), pdf["label"].to_numpy(), rate)
            yield pd.DataFrame({"name": list(model), "value": list(model.values())})

    return {r.name: r.value for r in sample.repartition(1).mapInPandas(run, "name string, value double").collect()}


def score_column(spark, model: dict[str, float] | float):
    if isinstance(model, float):
        return F.lit(model)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for series in texts:
            yield pd.Series([scorer.score(t) for t in series], dtype="float64")

    return judge("text")


def score(docs: DataFrame, model: dict[str, float] | float, least: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    d = docs.select("doc_id", held_out().alias("held_out"), score_column(docs.sparkSession, model).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= least).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject."""
    model = learn(docs, labels)
    kept = docs.select(F.struct("*").alias("doc"), "text").where(score_column(docs.sparkSession, model) >= least)
    return kept.select("doc.*")
