"""Quality classifier: a small convolutional network over the bytes of whole texts, in numpy.

Bytes are embedded, ``FILTERS`` learned filters of ``WIDTH`` bytes run over them
in steps of ``STEP``, and each chunk of ``2 * HALF`` bytes, overlapping the next
by half, is max-pooled per filter and given a logit. The mean of a document's
chunk logits, scaled and shifted, is the log odds of label 1. Trained on a
bounded sample (``PER_CLASS`` rows of each label, texts up to ``MAX_CHARS``).

A null or empty text is one chunk of padding; a very long one is scored alone, by
blocks, with the same result. Without rows of both labels every score is the share
of label 1, a half without any. Equal texts have equal scores, alone or in any
batch; rows that repeat, or share an id, or have none, are scored one by one. A tie
of responses goes to the first window, contradicting labels to label 1. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from .common import held_out, slim
from .labelled import sample, scored

WIDTH, STEP, DIM, FILTERS, HALF = 8, 4, 8, 16, 256
PER_CLASS, MAX_CHARS = 1500, 20_000
EPOCHS, CHUNKS = 12, 6
THRESHOLD = 0.7
BLOCK = 1 << 20
SLOTS = HALF // STEP


def halves(text: str) -> np.ndarray:
    """The text's bytes as rows of HALF and the WIDTH bytes that follow, padded by at least WIDTH zeros and to two rows."""
    raw = text.encode("utf-8", "surrogatepass")
    rows = max(2, -(-(len(raw) + WIDTH) // HALF))
    out = np.zeros(rows * HALF + WIDTH, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(out, (rows, HALF + WIDTH), (HALF, 1))


def windows(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Embedded windows of WIDTH bytes, one each STEP bytes of each row but its last WIDTH, which only end windows."""
    x = table[rows]
    n = (rows.shape[1] - WIDTH) // STEP
    view = np.lib.stride_tricks.as_strided(x, (len(rows), n, WIDTH * DIM), (x.strides[0], STEP * x.strides[1], x.strides[2]))
    return view.reshape(len(rows) * n, WIDTH * DIM)


def pooled(rows: np.ndarray, table: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each row (rows of one or more documents, as ``halves`` gives them)."""
    out = [(windows(rows[i : i + BLOCK // HALF], table) @ filters).reshape(-1, SLOTS, FILTERS).max(1) for i in range(0, len(rows), BLOCK // HALF)]
    return np.concatenate(out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], y: np.ndarray, odds: float, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    p = {
        "table": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "filters": rng.normal(0, 0.2, (WIDTH * DIM, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, dtype=np.float32),
        "top": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "shift": np.zeros(1, dtype=np.float32),
    }
    model = p | {"a": 1.0, "b": odds, "constant": not 0 < y.sum() < len(y)}
    if model["constant"]:
        return model
    parts = [halves(t) for t in texts]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        picks = [(i, j) for i, x in enumerate(parts) for j in rng.integers(0, len(x) - 1, min(CHUNKS, len(x) - 1))]
        rng.shuffle(picks)
        for at in range(0, len(picks), 128):
            batch = picks[at : at + 128]
            rows = np.stack([np.concatenate([parts[i][j, :HALF], parts[i][j + 1]]) for i, j in batch])
            label, w = y[[i for i, _ in batch]], weight[[i for i, _ in batch]]
            x = windows(rows, p["table"]).reshape(len(batch), 2 * SLOTS, -1)
            conv = x @ p["filters"]
            best = conv.argmax(1)
            hidden = np.maximum(np.take_along_axis(conv, best[:, None, :], 1)[:, 0] + p["bias"], 0)
            error = ((_sigmoid(hidden @ p["top"] + p["shift"]) - label) * w / len(batch)).astype(np.float32)
            back = (error[:, None] * p["top"]) * (hidden > 0)
            won = x[np.arange(len(batch))[:, None], best]
            grads = {"top": hidden.T @ error, "shift": error.sum(keepdims=True), "bias": back.sum(0), "filters": np.einsum("bf,bfd->df", back, won), "table": np.zeros_like(p["table"])}
            places = best[:, :, None] * STEP + np.arange(WIDTH)
            which = rows[np.arange(len(batch))[:, None, None], places]
            np.add.at(grads["table"], which, back[:, :, None, None] * p["filters"].T.reshape(1, FILTERS, WIDTH, DIM))
            step += 1
            for k, g in grads.items():  # Adam
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= (0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    logits = np.array([document_logits([t], p)[0] for t in texts])
    a, b = 1.0, 0.0
    for _ in range(500):  # scale and shift of document logits, classes in balance
        e = (_sigmoid(a * logits + b) - y) * weight
        a, b = a - 0.1 * ((e * logits).mean() + 0.02 * (a - 1)), b - 0.1 * e.mean()
    # Shrunk prior: the sample is small beside the corpus, its odds need not be.
    return model | p | {"a": float(a), "b": float(b + odds)}


def document_logits(texts: list[str], p: dict) -> np.ndarray:
    parts = [halves(t) for t in texts]
    most = pooled(np.concatenate(parts), p["table"], p["filters"])
    sizes = np.array([len(x) for x in parts])
    ends = np.cumsum(sizes)
    pair = np.maximum(most[:-1], most[1:])
    logit = np.maximum(pair + p["bias"], 0) @ p["top"] + p["shift"][0]
    inside = np.ones(len(logit), dtype=bool)
    inside[ends[:-1] - 1] = False  # pairs across documents
    sums = np.add.reduceat(np.where(inside, logit, 0), ends - sizes)
    return sums / (sizes - 1)


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    if model["constant"]:
        return np.full(len(texts), _sigmoid(np.array(model["b"])))
    out, i = np.empty(len(texts)), 0
    while i < len(texts):  # some MB at a time
        j, size = i, 0
        while j < len(texts) and (j == i or size < BLOCK):
            size += len(texts[j])
            j += 1
        out[i:j] = document_logits(texts[i:j], model)
        i = j
    return _sigmoid(model["a"] * out + model["b"])


def _scores(model, texts: list[str]) -> np.ndarray:
    return score_texts(texts, model.value)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(*sample(docs, labels, "quality", PER_CLASS, MAX_CHARS))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some kB
    rows = scored(slim(docs), functools.partial(_scores, shared), THRESHOLD)
    return rows.select("_row.doc_id", "score", "predicted").select("doc_id", held_out(4).alias("held_out"), "score", "predicted")
