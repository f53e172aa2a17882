"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most ``CAPACITY`` tokens (only longer documents are
cut; their first piece may be shorter). The histogram of lengths, at most
``CAPACITY`` numbers, goes to the driver. A configuration is a multiset of lengths
that fits. Multiplicative weights work on the covering program: each round prices
lengths by their weights, a knapsack dynamic program finds the most valuable
configurations, and the weights of the lengths they cover shrink. Each round's
configurations are used whole numbers of times, and a last rest is placed best fit;
best fit alone is taken where it needs fewer sequences. The dual value of the prices
bounds how many any packing needs. Pieces are ranked within their length by counts of
hash buckets (one length may hold most rows) and looked up in the plan, a table of
bounded size.

Null and empty texts are one piece, of the end token alone. A very long text is
encoded whole and cut into pieces. Rows that repeat, or share an id, or have none,
are packed one by one; equal pieces take their places in any order. An empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slim, small_batches
from .sharding import with_slots

CAPACITY = 1024
END_ID = 2
#: Rates of the weights; rounds at most; the shares of pieces left at which a program is rounded; what a round places at most; worth given up against the best.
RATES, ROUNDS = (0.001, 0.05), 400
LEFT = (0.6, 0.3, 0.1, 0.02)
SHARE, SLACK = 0.25, 0.002


class Ids:
    """Ids of texts by a byte-level file of the tokenizers library.

    The file's ids are its merge ranks, so another implementation of the same
    merges gives the same ids (a test compares them). Special tokens in a text get
    their own ids, as that library gives.
    """

    def __init__(self, path: str, pattern: str | None = None):
        import json

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in spec.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        bytes_of = _byte_letters()
        ranks = {bytes(bytes_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(x in text for x in self.special):
            return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.split.split(text) if p)
        return self._plain(text)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level file: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and the ids if asked for."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = ids_of(path)
        for batch in batches:
            rows = []
            keys = batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for key, text in zip(keys, batch["text"], strict=True):
                raw = encode(text or "") + end
                n, start = len(raw) // 4, 0
                size = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    own = raw[4 * start : 4 * (start + size)]
                    row = (key, piece, start, size, zlib.crc32(own))
                    rows.append((*row, own) if with_ids else row)
                    start, size = start + size, capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    small_batches(docs.sparkSession)
    return slim(docs).mapInPandas(run, schema)


def priced(value: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by capacity over the lengths that have pieces: the best worth within each capacity, and a length taken for it (0: none)."""
    live = np.flatnonzero(counts > 0)
    worth, ends = value[live], np.searchsorted(live, np.arange(capacity + 1), "right")
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(int(live[0]), capacity + 1):
        gain = best[c - live[: ends[c]]] + worth[: ends[c]]
        k = int(gain.argmax())
        if gain[k] >= best[c - 1]:
            best[c], taken[c] = gain[k], live[k]
        else:
            best[c] = best[c - 1]
    return best, taken


def filled_up(length: int, taken: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most valuable configuration that holds ``length``: its lengths and how often each."""
    found, c = [length], capacity - length
    while c > 0:
        if taken[c]:
            found.append(int(taken[c]))
            c -= taken[c]
        else:
            c -= 1
    return np.unique(found, return_counts=True)


class Program:
    """The covering program over configurations, solved and rounded together by multiplicative weights at one rate.

    A length's weight begins at size * count and falls by the factor exp(-rate * share)
    as its pieces are covered; its price is weight / count, the dual variable of its row.
    Each round's knapsack prices all configurations; the best one around each length, if
    its worth is within SLACK of the best of all, is used a whole number of times,
    for at most SHARE of the pieces that any of its lengths has left.
    """

    def __init__(self, counts: np.ndarray, capacity: int, rate: float):
        self.counts, self.capacity, self.rate = np.array(counts, dtype=np.int64), capacity, rate
        self.rest, self.used = self.counts.copy(), {}
        #: No packing has fewer sequences: prices, scaled so that no configuration is worth more than 1, summed over all pieces.
        self.bound = 0.0

    def step(self) -> bool:
        """One round; whether it placed anything."""
        live = np.flatnonzero(self.rest > 0)
        if not len(live):
            return False
        known = np.flatnonzero(self.counts > 0)
        value = np.zeros(self.capacity + 1)
        covered = 1 - self.rest[known] / self.counts[known]
        value[known] = known * np.exp(-self.rate * (covered - covered.min()))
        best, taken = priced(value, self.rest, self.capacity)
        if not self.used:  # all lengths are live: the prices are feasible for the whole program
            self.bound = float((self.counts * value).sum() / best[self.capacity])
        good = (value[live] + best[self.capacity - live]) / best[self.capacity]
        share = self.rest[live] / self.counts[live]
        budget = np.maximum(1, np.floor(SHARE * self.rest)).astype(np.int64)
        before = self.rest.sum()
        for i in np.lexsort((-live, -share, -good)):
            if good[i] < good.max() - SLACK:
                break
            if budget[live[i]] < 1:
                continue
            lengths, times = filled_up(int(live[i]), taken, self.capacity)
            n = int((np.minimum(budget[lengths], self.rest[lengths]) // times).min())
            if n < 1 and (self.rest[lengths] >= times).all() and (budget[lengths] > 0).all():
                n = 1
            if n > 0:
                self.rest[lengths] -= n * times
                budget[lengths] -= n * times
                key = (tuple(lengths.tolist()), tuple(times.tolist()))
                self.used[key] = self.used.get(key, 0) + n
        return self.rest.sum() < before

    def whole(self) -> list[tuple[np.ndarray, int]]:
        """Its configurations and how often, the pieces that are left placed best fit."""
        out = []
        for (lengths, times), n in self.used.items():
            config = np.zeros(self.capacity + 1, dtype=np.int64)
            config[list(lengths)] = times
            out.append((config, n))
        return out + best_fit(self.rest, self.capacity)


def area_bound(counts: np.ndarray, capacity: int) -> int:
    """The dual value of prices in proportion to size, and of price 1 for what fills over half a sequence."""
    sizes = np.arange(len(counts))
    return int(max(-(-int((counts * sizes).sum()) // capacity), counts[sizes > capacity / 2].sum()))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[np.ndarray, int]], int]:
    """Whole configurations (how often each length) with how many sequences have each, every piece in one; and a lower bound of sequences.

    Programs of several rates are rounded when several shares of the pieces are
    left; the fewest sequences win, best fit alone included.
    """
    counts = np.array(counts, dtype=np.int64)
    size = lambda found: sum(n for _, n in found)
    bound, chosen = area_bound(counts, capacity), best_fit(counts, capacity)
    if size(chosen) <= bound:
        return chosen, bound
    for rate in RATES:
        program, left = Program(counts, capacity, rate), list(LEFT)
        for _ in range(ROUNDS):
            moved = program.step()
            while left and (program.rest.sum() <= left[0] * counts.sum() or not moved):
                left.pop(0)
                found = program.whole()
                if size(found) < size(chosen):
                    chosen = found
            if not left or not moved:
                break
        bound = max(bound, math.ceil(program.bound - 1e-6))
        if size(chosen) <= bound:
            break
    return chosen, bound


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The last rest: longest first, each into the fullest sequence that has room; alike sequences are one entry."""
    rest, out = counts.copy(), []
    while rest.any():
        config, room = np.zeros(capacity + 1, dtype=np.int64), capacity
        while True:
            fit = np.flatnonzero(rest[: room + 1] - config[: room + 1] > 0)
            if not len(fit):
                break
            length = int(fit[-1])
            n = min(int(rest[length] - config[length]), room // length)
            config[length] += n
            room -= n * length
        inside = config > 0
        times = max(1, int((rest[inside] // config[inside]).min()))
        out.append((config, times))
        rest -= times * config
    return out


def lookup(configs: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, sequence, pieces a sequence, offset) in order of rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for config, times in configs:
        offset = 0
        for length in np.flatnonzero(config)[::-1]:
            length, n = int(length), int(config[length])
            rows.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length (1 to capacity)."""
    rows = saved(rows)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    place = rows.sparkSession.sparkContext.broadcast(lookup(plan(counts, capacity)[0]))

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.empty((len(lengths), 2), dtype=np.int64)
        for x in np.unique(lengths):
            at = np.flatnonzero(lengths == x)
            t = place.value[int(x)]
            r = t[np.searchsorted(t[:, 0], ranks[at], "right") - 1]
            k = ranks[at] - r[:, 0]
            out[at, 0], out[at, 1] = r[:, 1] + k // r[:, 2], r[:, 3] + k % r[:, 2] * x
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    ranked = with_slots(rows, "length", ["doc_id", "piece", "ids_crc32"])
    return ranked.withColumn("_at", where("length", "slot")).select(*rows.columns, "_at.sequence_id", "_at.offset")


def op6(docs: DataFrame, path: str) -> DataFrame:
    return packed(pieces(docs, path))
