"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the n-grams of ``SIZES`` code points present in the lower-cased text
(runs of white space folded), hashed to ``BITS`` bits (an n-gram that shares its
number with another counts as that one). Their log-count ratios
come from a bounded sample (``PER_CLASS`` rows of each label, texts up to
``MAX_CHARS``); the ``FEATURES`` with the most significant ratios enter a
logistic regression on presence * ratio. A score is the logistic of the sum over
the whole text, whatever its length (a very long one is scored alone); null and
empty texts get the score of no features. Without rows of both labels, every score
is the share of label 1, a half without any. Equal texts have equal scores; rows
that repeat, or share an id, or have none, are scored one by one. Features of equal
significance are taken in order of their numbers; labels that contradict each other
count as toxic. An empty table gives an empty result. Other columns are neither
read nor changed, whatever their names.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slim
from .labelled import sample, scored

SIZES = (4, 5, 6)
BITS = 19
PER_CLASS, MAX_CHARS = 3000, 20_000
FEATURES = 2000
THRESHOLD = 0.3
_FOLD = re.compile(r"\s+")


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of a text, repeats included."""
    codes = np.frombuffer(f" {_FOLD.sub(' ', text.lower())} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, h = [], codes
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        h = h[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
        if n in SIZES:
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def train(texts: list[str], y: np.ndarray, odds: float) -> tuple[np.ndarray, float]:
    """(weight by hashed n-gram, bias)."""
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return weights, odds
    counts = np.zeros((2, 1 << BITS))
    for t, label in zip(texts, y, strict=True):
        counts[int(label), np.unique(grams(t))] += 1
    n0, n1 = float((y == 0).sum()), float(y.sum())
    p0, p1 = (counts[0] + 0.5) / (n0 + 1), (counts[1] + 0.5) / (n1 + 1)
    ratio = np.log(p1 / p0)
    z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    z[(counts.sum(0) < 3)] = 0
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:FEATURES])
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)), dtype=np.float32)
    for i, t in enumerate(texts):  # found anew, as all texts' n-grams at once would be hundreds of MB
        at = place[grams(t)]
        x[i, at[at >= 0]] = 1
    x *= ratio[chosen].astype(np.float32)
    w, b = np.zeros(len(chosen)), 0.0
    m_w, m_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(300):  # AdaGrad on the whole sample
        e = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30))) - y
        g_w, g_b = (x.T @ e.astype(np.float32)) / len(y) + 2e-3 * w, e.mean()
        m_w += g_w**2
        m_b += g_b**2
        w -= 0.1 * g_w / np.sqrt(m_w)
        b -= 0.1 * g_b / np.sqrt(m_b)
    weights[chosen] = w * ratio[chosen]
    return weights, float(b + odds - np.log(n1 / n0))


def score_texts(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    seen = np.zeros(len(weights), dtype=np.float32)
    out = np.empty(len(texts))
    live = weights != 0
    for i, t in enumerate(texts):
        g = grams(t)
        g = g[live[g]]
        seen[g] = weights[g]
        out[i] = seen[np.unique(g)].sum() if len(g) else 0.0
        seen[g] = 0
    return 1 / (1 + np.exp(-np.clip(out + bias, -30, 30)))


def classify(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    texts, y, odds = sample(train_docs, labels, "toxic", PER_CLASS, MAX_CHARS)
    weights, bias = train(texts, y, odds)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 2 MB
    return scored(docs, functools.partial(_scores, model), THRESHOLD)


def _scores(model, texts: list[str]) -> np.ndarray:
    return score_texts(texts, *model.value)


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = classify(slim(docs), docs, labels)
    return rows.select("_row.doc_id", "score", "predicted").select("doc_id", held_out(4).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic; same columns."""
    return classify(docs, train_docs, labels).where(F.col("predicted") == 0).select("_row.*")
