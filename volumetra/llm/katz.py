"""LM scoring: a Katz model of order ``ORDER`` with Good-Turing discounts and exactly normalised backoff weights.

Tokens are words (A-Z lower-cased) and one end for each text. Counts come from
the learning fold. Good-Turing's r* = (r+1) n(r+1) / n(r) uses counts of counts
smoothed by a line in log-log space (linear Good-Turing), so every count has a
discount d(r) = (1 + 1/r)^(b+1) below 1. Evaluation is recursive: an n-gram that
occurs ``LEAST[n]`` times or more has d c / c(history); any other has
alpha(history) times what the history without its first word gives, with
alpha(h) = (1 - sum of the discounted followers) / (1 - sum of what the shorter
history gives them), which is 1 after a history without followers. As is usual,
trigrams count as seen from two occurrences on; what single ones would have is
left to the bigrams. Unigrams have d c / N; the rest of the mass is one unknown
token's. A text begins after start marks.

One scan makes chunks of whole documents, their tokens numbered within the
chunk, and writes them down. A chunk asks each partition of the n-gram tables,
by the high bits of hashed keys, for what it holds of its distinct n-grams, and
gets their counts. For every n-gram one of the chunks that learned from it is its
owner, and adds it to the sums of the backoff weights; so the sums hold each
n-gram once. Chunks then ask for the weights that their backed-off tokens need.
Only filled (chunk, partition) cells make rows, so there are never more of them
than distinct n-grams in the chunks, whatever the number of partitions; a
frequent n-gram costs its partition one entry a chunk.

Unigrams are identified by 64-bit hashes; longer ones by their partition and
``KEY_BITS`` more bits: two of the n that a partition is asked for share a key with
a probability of n^2 / 2^41 (some hundred thousand, at any size of the corpus).

Null and empty texts have one token, the end; very long ones are chunks of their
own. An empty table gives an empty result. Rows are scored one by one: repeated
rows and ids, and null ids, stay as they are. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, saved, scratch, slim, small_batches
from .words import WordHasher, pair

START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000002)
ORDER = 3
#: The count from which an n-gram is seen, by n.
LEAST = {1: 1, 2: 1, 3: 2}
CHUNK_CHARS = 4_000_000
BUCKET_CHARS = 4_000_000
KEY_BITS = 40
#: Counts of counts up to this one enter the line.
MOST_RANK = 40


def shrink(a: np.ndarray) -> bytes:
    """An array as compressed byte planes; sorted unsigned 64-bit keys should be passed as differences."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def grow(raw: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(dtype)


def keys_out(keys: np.ndarray) -> bytes:
    return shrink(np.diff(keys, prepend=np.uint64(0)))


def keys_in(raw: bytes) -> np.ndarray:
    return np.cumsum(grow(raw, "u8"), dtype=np.uint64)


def floats_out(a: np.ndarray) -> bytes:
    """Numbers rounded to 36 bits after the leading one, an error of 7e-12 at most, as their distinct values and each one's place among these: many are made of the same few counts."""
    bits = (a.view(np.uint64) + np.uint64(1 << 15)) & ~np.uint64((1 << 16) - 1)
    values, at = np.unique(bits, return_inverse=True)
    head = keys_out(values)
    return len(head).to_bytes(4, "little") + head + shrink(at.astype(np.uint32))


def floats_in(raw: bytes) -> np.ndarray:
    end = 4 + int.from_bytes(raw[:4], "little")
    return keys_in(raw[4:end]).view(np.float64)[grow(raw[end:], "u4")]


def joined(arrays: list[np.ndarray], dtype: str) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, dtype)


def slices(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """The stretches of sorted keys that go to each of 2**bits partitions, filled ones only."""
    at = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)
    ends = [0, *at.tolist(), len(keys)]
    return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]


def within(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """What identifies keys of n-grams inside their partition; the order stays."""
    return keys if n == 1 else (keys << np.uint64(bits)) >> np.uint64(64 - KEY_BITS)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place where each occurs, and each place's number among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(keys), dtype=np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ranked[new], order[new], at


def _starts(order: int) -> list[np.uint64]:
    """Keys of the histories of start marks alone: of 1, 2, ... of them."""
    out = [START]
    while len(out) < order:
        out.append(pair(np.array([out[-1]]), np.array([START]))[0])
    return out


class Chunk:
    """Tokens of some documents, with their distinct n-grams of each order."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, train: np.ndarray, order: int):
        self.sizes, self.order = sizes, order
        self.learned = np.repeat(train, sizes)
        first = np.zeros(len(tokens), dtype=bool)
        first[np.cumsum(sizes)[:-1]] = True
        first[:1] = True
        self.keys, self.at, self.counts = {1: words}, {1: tokens}, {}
        #: Of each n-gram over 1: its history's number among the shorter ones (-1: start marks alone), and that of its last n - 1 words.
        self.history, self.lower, self.starts = {}, {}, _starts(order)
        said = words[tokens]
        for n in range(2, order + 1):
            shorter = self.keys[n - 1][self.at[n - 1]]
            history = np.concatenate([shorter[:1], shorter[:-1]])
            history[first] = self.starts[n - 2]
            self.keys[n], place, self.at[n] = distinct(pair(history, said))
            self.history[n] = np.where(first[place], -1, self.at[n - 1][np.maximum(place - 1, 0)])
            self.lower[n] = self.at[n - 1][place]
        for n in self.keys:
            self.counts[n] = np.bincount(self.at[n], weights=self.learned, minlength=len(self.keys[n])).astype(np.uint32)


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list, list[str], np.ndarray]]:
    """(chunk, ids, texts, learned) from the batches of one partition."""
    name, ids, texts, train, size, n = TaskContext.get().partitionId(), [], [], [], 0, 0
    for batch in batches:
        for key, text, learned in zip(batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), batch["text"], batch["learned"], strict=True):
            if size and size + len(text or "") > CHUNK_CHARS:
                yield f"{name}-{n}", ids, texts, np.array(train, dtype=bool)
                ids, texts, train, size, n = [], [], [], 0, n + 1
            ids.append(key)
            texts.append(text or "")
            train.append(bool(learned))
            size += len(text or "") + 8
    if ids:
        yield f"{name}-{n}", ids, texts, np.array(train, dtype=bool)


STATE = "chunk string, ids binary, learned binary, sizes binary, words binary, tokens binary"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = WordHasher()
    for name, ids, texts, train in chunks(batches):
        parts = []
        for i, t in enumerate(texts):
            parts.append(np.append(hasher(t), END))
            texts[i] = ""
        words, _, tokens = distinct(np.concatenate(parts))
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        written = ",".join("" if i is None else str(i) for i in ids).encode()
        yield pd.DataFrame([(name, written, train.tobytes(), sizes.tobytes(), keys_out(words), shrink(tokens))], columns=["chunk", "ids", "learned", "sizes", "words", "tokens"])


def _chunk(s, order: int) -> Chunk:
    return Chunk(keys_in(s["words"]), grow(s["tokens"], "i4"), np.frombuffer(s["sizes"], dtype=np.int64), np.frombuffer(s["learned"], dtype=bool), order)


ASKED = "chunk string, n int, bucket int, keys binary, counts binary"


def _ask(bits: int, order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, s in batch.iterrows():
                c = _chunk(s, order)
                for n, keys in c.keys.items():
                    rows = [(s["chunk"], n, b, keys_out(within(keys[p], bits, n)), shrink(c.counts[n][p])) for b, p in slices(keys, bits)]
                    yield pd.DataFrame(rows, columns=["chunk", "n", "bucket", "keys", "counts"])

    return run


def _answer(order: int):
    """For what each chunk asked of one partition: twice the whole count, and 1 more where the chunk is the n-gram's owner. Counts of counts in a row without chunk.

    Of n-grams of the highest order, no histories of others, a count too low to be seen is told as 0.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        keys = [keys_in(k) for k in rows["keys"]]
        found, _, at = distinct(np.concatenate(keys))
        own = np.concatenate([grow(c, "u4") for c in rows["counts"]])
        counts = np.bincount(at, weights=own, minlength=len(found)).astype(np.int64)
        told = 2 * counts[at]
        learned = np.flatnonzero(own)[::-1]
        owner = np.full(len(found), -1)
        owner[at[learned]] = learned  # the first chunk's entry stays
        told[owner[owner >= 0]] += 1
        n = int(rows["n"].iloc[0])
        if n == order:
            told[counts[at] < LEAST[n]] = 0
        ends = np.cumsum([len(k) for k in keys])
        out = rows[["chunk", "n", "bucket"]].copy()
        out["counts"] = [shrink(told[e - len(k) : e].astype("u8")) for k, e in zip(keys, ends, strict=True)]
        seen = counts[counts > 0]
        stats = np.concatenate([[len(seen), seen.sum()], np.bincount(np.minimum(seen, MOST_RANK + 1), minlength=MOST_RANK + 2)[1:-1]]).astype(np.int64)
        value, times = np.unique(seen, return_counts=True) if n == 1 else (seen[:0], seen[:0])
        values = [{"count": int(v), "times": int(t)} for v, t in zip(value, times, strict=True)]
        row = pd.DataFrame([{"chunk": None, "n": n, "bucket": rows["bucket"].iloc[0], "counts": None, "stats": stats.tolist(), "values": values}])
        return pd.concat([out.assign(stats=None, values=None), row], ignore_index=True)

    return run


def slope(counts_of_counts: list[int]) -> float:
    """b of log n(r) = a + b log r, over the counts of counts that are not 0, each spread over the gap around it."""
    r = np.flatnonzero(counts_of_counts) + 1
    if len(r) < 2:
        return -2.0
    n = np.array(counts_of_counts, dtype=float)[r - 1]
    before, after = np.concatenate([[0], r[:-1]]), np.concatenate([r[1:], [2 * r[-1] - r[-2]]])
    b = np.polyfit(np.log(r), np.log(n / (0.5 * (after - before))), 1)[0]
    return float(min(b, -1.05))


class Model:
    def __init__(self, stats: dict[int, list[int]], documents: int, by_count: DataFrame, order: int):
        none = [0] * (MOST_RANK + 2)
        self.vocabulary, self.tokens = stats.get(1, none)[:2]
        self.documents, self.order = documents, order
        self.b = {n: slope(stats.get(n, none)[2:]) for n in range(1, order + 1)}
        # What the discounted unigrams leave is the unknown token's.
        kept = by_count.agg(F.sum(F.col("times") * F.col("count") * F.pow(1 + 1 / F.col("count"), F.lit(self.b[1] + 1)))).first()[0]
        self.unknown = 1 - (kept or 0.0) / max(self.tokens, 1)

    def discounted(self, c: np.ndarray, n: int) -> np.ndarray:
        c = c.astype(np.float64)
        return np.where(c > 0, c * (1 + 1 / np.maximum(c, 1)) ** (self.b[n] + 1), 0.0)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounted(c, 1) / max(self.tokens, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c.astype(np.float64) + 1) / (self.tokens + self.vocabulary + 1))


def _score(model: Model, bits: int):
    """A chunk with the answers to it: what is known of its documents, its n-grams' part of the backoff sums, and the weights it wants."""

    def run(state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c = _chunk(state.iloc[0], model.order)
        answers = answers.sort_values(["n", "bucket"])
        told = {n: joined([grow(x, "u8") for x in answers.loc[answers["n"] == n, "counts"]], "u8") for n in c.keys}
        counts = {n: (x >> np.uint64(1)).astype(np.int64) for n, x in told.items()}
        doc = np.repeat(np.arange(len(c.sizes)), c.sizes)
        sums = lambda v: np.bincount(doc, weights=v, minlength=len(c.sizes))
        # value: what an n-gram has itself, or else, its history's weight aside, from its last n - 1 words.
        value, rows, weigh, wants, offset = {1: model.unigram(counts[1])}, [], {}, [], 0
        for n in range(2, model.order + 1):
            h = c.history[n]
            c_history = np.where(h < 0, model.documents, counts[n - 1][h])
            seen = counts[n] >= LEAST[n]
            own = model.discounted(counts[n], n) / np.maximum(c_history, 1)
            shorter = value[n - 1][c.lower[n]]
            value[n] = np.where(seen, own, shorter)
            # Places of histories: those of the shorter n-grams, then the start marks.
            place = np.where(h < 0, len(c.keys[n - 1]), h)
            keys = np.append(c.keys[n - 1], c.starts[n - 2])
            order = np.argsort(keys, kind="stable")
            adds = seen & ((told[n] & np.uint64(1)) > 0)
            total = [np.bincount(place[adds], weights=v[adds], minlength=len(keys)) for v in (own, shorter)]
            has = order[np.bincount(place[adds], minlength=len(keys))[order] > 0]
            for b, p in slices(keys[has], bits):
                rows.append({"kind": "sums", "n": n, "bucket": b, "keys": keys_out(within(keys[has[p]], bits, n)), "a": floats_out(total[0][has[p]]), "b": floats_out(total[1][has[p]])})
            waits = ~seen & (c_history >= LEAST[n])  # a history as rare as that has no followers
            token_waits = waits[c.at[n]]
            asked = np.zeros(len(keys), dtype=bool)
            asked[place[waits]] = True
            wanted = order[asked[order]]
            rank = np.zeros(len(keys), dtype=np.int64)
            rank[wanted] = np.arange(len(wanted)) + offset
            weigh[n] = (token_waits, rank[place[c.at[n]]])
            for b, p in slices(keys[wanted], bits):
                rows.append({"kind": "wanted", "n": n, "bucket": b, "keys": keys_out(within(keys[wanted[p]], bits, n))})
            offset += len(wanted)
        # A token takes the weights of all orders at which it backs off, down to the one that has it.
        backs = np.ones(len(doc), dtype=bool)
        for n in range(model.order, 1, -1):
            token_waits, rank = weigh[n]
            wants.append((doc * np.int64(max(offset, 1)) + rank)[backs & token_waits])
            backs &= ~(counts[n] >= LEAST[n])[c.at[n]]
        code, _, at = distinct(np.concatenate(wants)) if wants else (np.empty(0, np.int64), None, np.empty(0, np.int64))
        documents = {
            "n_tokens": c.sizes.astype(np.int64),
            "n_known": sums(counts[1][c.at[1]] > 0).astype(np.int64),
            "base": sums(model.base(counts[1])[c.at[1]]),
            "score": sums(np.log10(value[model.order])[c.at[model.order]]),
        }
        times = np.bincount(at, minlength=len(code)).astype("<u4")
        rows.append({"kind": "documents", "n": 0, "bucket": -1, "keys": state.iloc[0]["ids"], "a": b"".join(v.tobytes() for v in documents.values()), "b": keys_out(code.astype(np.uint64)), "c": shrink(times)})
        return pd.DataFrame(rows, columns=["kind", "n", "bucket", "keys", "a", "b", "c"]).assign(chunk=state.iloc[0]["chunk"])

    return run


SCORED = "kind string, chunk string, n int, bucket int, keys binary, a binary, b binary, c binary"


def _weights(rows: pd.DataFrame) -> pd.DataFrame:
    """log10 of the backoff weights that chunks want of one partition; 0 after histories without followers."""
    added, wanted = rows[rows["kind"] == "sums"], rows[rows["kind"] == "wanted"]
    keys, _, at = distinct(joined([keys_in(k) for k in added["keys"]], "u8"))
    total = [np.bincount(at, weights=joined([floats_in(x) for x in added[c]], "f8"), minlength=len(keys)) for c in ("a", "b")]
    alpha = np.append(np.log10(np.maximum(1 - total[0], 1e-300) / np.maximum(1 - total[1], 1e-300)), 0.0)

    def of(asked: np.ndarray) -> np.ndarray:
        place = np.searchsorted(keys, asked)
        known = place < len(keys)
        known[known] = keys[place[known]] == asked[known]
        return alpha[np.where(known, place, len(keys))]

    out = wanted[["chunk", "n", "bucket"]].copy()
    out["weights"] = [floats_out(of(keys_in(k))) for k in wanted["keys"]]
    return out


def _finish(tokens: int):
    def run(state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        s = state.iloc[0]
        ids = [None if i == "" else int(i) for i in s["keys"].decode().split(",")]
        n = len(ids)
        numbers = np.frombuffer(s["a"], dtype=np.int64)
        floats = numbers.view(np.float64)
        weights = joined([floats_in(x) for x in answers.sort_values(["n", "bucket"])["weights"]], "f8")
        code, times = keys_in(s["b"]).astype(np.int64), grow(s["c"], "u4")  # a document's number and a weight's in one
        doc, at = code // max(len(weights), 1), code % max(len(weights), 1)
        score = floats[3 * n :] + np.bincount(doc, weights=weights[at] * times, minlength=n)
        return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n_tokens": numbers[:n], "n_known": numbers[n : 2 * n], "train_tokens": tokens, "base_score": floats[2 * n : 3 * n], "score": score})

    return run


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, learned, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score). ``learned``: whether a row is learned from."""
    with scratch():
        with scratch():
            model, parts = _parts(docs, learned, order)
        weights = parts.where("kind <> 'documents'").groupBy("n", "bucket").applyInPandas(_weights, "chunk string, n int, bucket int, weights binary")
        final = parts.where("kind = 'documents'").groupBy("chunk").cogroup(weights.groupBy("chunk"))
        return saved(final.applyInPandas(_finish(int(model.tokens)), RESULT), keep=True)


def _parts(docs: DataFrame, learned, order: int) -> tuple[Model, DataFrame]:
    """The model, and what ``_score`` gives for each chunk."""
    small_batches(docs.sparkSession)
    rows = slim(docs).withColumn("learned", learned)
    size = rows.agg(F.sum(F.char_length("text")).alias("n"), F.sum(F.col("learned").cast("long")).alias("d")).first()
    bits = max(0, math.ceil(math.log2(max(1, (size["n"] or 0) / BUCKET_CHARS))))
    state = saved(rows.mapInPandas(_read, STATE))
    # A task has few cells' worth of partitions, or few chunks, at any size.
    asked = state.mapInPandas(_ask(bits, order), ASKED).repartition(max(1, (order << bits) // 4), "n", "bucket")
    answers = saved(asked.groupBy("n", "bucket").applyInPandas(_answer(order), "chunk string, n int, bucket int, counts binary, stats array<long>, values array<struct<count:long,times:long>>"))
    stats: dict[int, list[int]] = {}
    told = answers.where("chunk is null").select("n", F.posexplode("stats").alias("i", "x")).groupBy("n", "i").agg(F.sum("x").alias("x"))
    for r in told.orderBy("n", "i").collect():
        stats.setdefault(r["n"], []).append(r["x"])
    by_count = answers.where("chunk is null and n = 1").select(F.explode("values").alias("v")).groupBy("v.count").agg(F.sum("v.times").alias("times"))
    model = Model(stats, size["d"] or 0, by_count, order)
    own = answers.where("chunk is not null").select("chunk", "n", "bucket", "counts")
    tasks = 2 * math.ceil((size["n"] or 1) / CHUNK_CHARS)
    state, own = state.repartition(tasks, "chunk"), own.repartition(tasks, "chunk")
    return model, saved(state.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInPandas(_score(model, bits), SCORED), keep=True)


def op10(docs: DataFrame) -> DataFrame:
    out = scores(docs, ~held_out(7))
    return out.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
