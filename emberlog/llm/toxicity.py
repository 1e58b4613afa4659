"""Toxicity by multiple-instance learning: a document is toxic if some sentence is.

Each sentence has the probability sigmoid(bias + weights of its distinct words and word beginnings);
the document's is the noisy-or of them. Only document labels are given, so the weights are fitted
on the likelihood of documents; the sentences that carry the probability are then located.

Defined cases: a null or empty text has one empty sentence; rows that repeat score alike; without
labels of both classes every score is the share of label 1 (0.5 without labels); a text of any length is
read whole, sentence by sentence, each lower-cased on its own; features that set the classes apart equally
well are taken in the order of their names; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, prior, training_sample

SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6, 7, 8)


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Begin and end of each sentence."""
    out, at = [], 0
    text = text or ""
    for m in SENTENCE_END.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text) or not out:
        out.append((at, len(text)))
    return out


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def fit(texts: list[str | None], labels: np.ndarray, rate: float, most_features: int = 30_000, rounds: int = 200) -> dict[str, float]:
    """Weights by feature, the bias under the empty string. ``rate``: the share of label 1 to fit for."""
    bags = [[frozenset(WORD.findall((t or "")[a:b].lower())) for a, b in sentences(t)] for t in texts]
    seen = {0: Counter(), 1: Counter()}
    for bag, y in zip(bags, labels):
        seen[int(y)].update({f for s in bag for w in s for f in features(w)})
    n1, n0 = max(int(labels.sum()), 1), max(int(len(labels) - labels.sum()), 1)
    # Features that set the classes apart, by the signed root of their log-likelihood ratio.
    scored = []
    for f in seen[1].keys() | seen[0].keys():
        a, b = seen[1][f], seen[0][f]
        if a + b >= 3:
            p = (a + b) / (n1 + n0)
            g = sum(x * np.log(x / n / p) for x, n in ((a, n1), (b, n0)) if x)
            if g > 3.0:
                scored.append((-g, f))
    names = [f for _, f in sorted(scored)[:most_features]]
    index = {f: i for i, f in enumerate(names)}
    rows, cols, doc_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            for i in {index[f] for w in s for f in features(w) if f in index}:
                rows.append(len(doc_of))
                cols.append(i)
            doc_of.append(d)
    rows, cols, doc_of = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), np.array(doc_of, dtype=np.int64)
    y = labels.astype(float)
    weight = np.where(y == 1, rate / (n1 / (n1 + n0)), (1 - rate) / (n0 / (n1 + n0)))  # undo the draw by class
    w, bias = np.zeros(len(names)), -6.0
    grad_w2, grad_b2 = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(rows, weights=w[cols], minlength=len(doc_of))
        log_not = -np.logaddexp(0, z)  # log(1 - p)
        none = np.bincount(doc_of, weights=log_not, minlength=len(y))
        p_doc = np.clip(-np.expm1(none), 1e-12, 1)
        # d loss / d z: p_i for label 0, -p_i * (1 - P) / P for label 1.
        pull = np.where(y == 1, -np.exp(none) / p_doc, 1.0) * weight
        g = pull[doc_of] / (1 + np.exp(-z))
        gw = np.bincount(cols, weights=g[rows], minlength=len(names)) + 0.05 * w
        gb = g.sum()
        grad_w2 += gw * gw
        grad_b2 += gb * gb
        w -= 0.5 * gw / np.sqrt(grad_w2)
        bias -= 0.3 * gb / np.sqrt(grad_b2)
    return {"": float(bias)} | {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}


class Scorer:
    """Noisy-or over the sentences of a text; word weights are looked up once for each word."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.bias, self.words = weights, weights.get("", 0.0), {}

    def _weight(self, word: str) -> float:
        if len(self.words) > 300_000:
            self.words.clear()
        x = sum(self.weights.get(f, 0.0) for f in features(word))
        self.words[word] = x
        return x

    def sentence(self, text: str) -> float:
        """log(1 - p). A beginning that several words share counts once, as in the fit."""
        words = set(WORD.findall(text))
        known = self.words
        hot = [w for w in words if (known[w] if w in known else self._weight(w))]
        if not hot:
            return self.clean
        z = self.bias + sum(self.weights.get(f, 0.0) for f in {f for w in hot for f in features(w)})
        return -float(np.logaddexp(0, z))

    @property
    def clean(self) -> float:
        return -float(np.logaddexp(0, self.bias))

    def parts(self, text: str | None) -> list[tuple[int, int, float]]:
        text = text or ""
        return [(a, b, self.sentence(text[a:b].lower())) for a, b in sentences(text)]  # as in the fit; lower case may be longer


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = 3000) -> dict[str, float] | float:
    """The weights, fitted in one task on at most 2 * ``per_class`` labelled documents; the share of
    label 1 if there is one class only."""
    sample, sizes = training_sample(docs, labels, target, per_class)
    rate = prior(sizes)
    if rate in (0.0, 1.0) or not sum(sizes.values()) or sample.select("label").distinct().count() < 2:
        return rate

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            pdf = pd.concat(held).sort_values("doc_id")
            weights = fit(pdf["text"].tolist(), pdf["label"].to_numpy(), rate)
            yield pd.DataFrame({"feature": list(weights), "weight": list(weights.values())})

    return {r.feature: r.weight for r in sample.repartition(1).mapInPandas(run, "feature string, weight double").collect()}


def score(docs: DataFrame, model: dict[str, float] | float, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the sentences at fault as
    structs (begin, end, p) in code points, most likely first."""
    kind = "struct<score:double,at:array<struct<begin:int,end:int,p:double>>>"
    if isinstance(model, float):
        told = F.struct(F.lit(model).alias("score"), F.array().cast("array<struct<begin:int,end:int,p:double>>").alias("at"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf(kind)
        def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(shared.value)
            clean = scorer.clean
            for series in texts:
                scores, spans = [], []
                for text in series:
                    parts = scorer.parts(text)
                    scores.append(-np.expm1(sum(x for _, _, x in parts)))
                    found = [(a, b, float(-np.expm1(x))) for a, b, x in parts if x < clean and -np.expm1(x) >= least]
                    spans.append([{"begin": a, "end": b, "p": p} for a, b, p in sorted(found, key=lambda s: (-s[2], s[0]))])
                yield pd.DataFrame({"score": scores, "at": spans})

        told = judge("text")
    d = docs.select("doc_id", held_out().alias("held_out"), told.alias("told"))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("told.score")))
    return d.select("doc_id", "held_out", s.alias("score"), (s >= least).cast("int").alias("predicted"), F.col("told.at").alias("sentences"))
