"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the tokenizer's pattern. Pieces not seen lately are
encoded together: their bytes stand in padded numpy matrices, bucketed by
length, and in every round each row merges its leftmost pair of minimum rank,
found by a hashed pair lookup; the row is compacted, and rows without a ranked
pair are finished. Encodings of pieces are kept in a bounded cache.

Null and empty texts have no ids. A very long text is encoded whole; a piece of
over ``LONG`` bytes, as a run of letters without a space can be, stands in no matrix
but merges all occurrences of its minimum-rank pair in a round, from the left: a
merge makes only pairs of higher rank, so this is what single merges give, in fewer
rounds. Rows that repeat, or share an id, or have none, are encoded one by one with
equal results. Of equal ranks in a row the leftmost goes first. An empty table gives
an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim, small_batches

#: \s of the tokenizer is Unicode White_Space (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE = 400_000
LONG = 256
NONE = np.int32(np.iinfo(np.int32).max)


def compiled(pattern: str):
    """The pattern with White_Space spelled out, as the regex library's \\s holds more."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressed table from a pair of ids to the id of their merge."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        values = np.array(merged, dtype=np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        self.probes = 0
        slots, left_over = self._slot(keys), np.arange(len(keys))
        while len(left_over):
            self.probes += 1
            at = slots[left_over]
            _, first = np.unique(at, return_index=True)
            free = first[self.values[at[first]] == NONE]
            self.keys[at[free]], self.values[at[free]] = keys[left_over[free]], values[left_over[free]]
            left_over = np.delete(left_over, free)
            slots[left_over] = (slots[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NONE where there is no merge; ids below 0 are padding."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.values[slots] != NONE))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            at = slots[open_]
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] != NONE)]
        return np.where((left < 0) | (right < 0), NONE, found)


NO_IDS = np.empty(0, np.int32)
#: In place of an encoding: the text with this word is encoded whole.
ODD = (b"", " ")


def words(text: str) -> list[str]:
    """The text cut before each space. The pattern begins a match there, if the characters beside it are no white space."""
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]]


def apart(word: str) -> bool:
    """Whether the word has other white space beside one of its spaces."""
    return word[-1:].isspace() or word[:1] == " " and word[1:2].isspace()


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = compiled(pattern)
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.decimals = [str(i) for i in range(size)]
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.cache: dict[str, tuple[bytes, str]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces that the pattern has cut."""
        out: list[np.ndarray] = [NO_IDS] * len(pieces)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        buckets = np.where(lengths > LONG, -1, np.ceil(np.log2(np.maximum(lengths, 1)) * 2).astype(np.int64))
        for bucket in np.unique(buckets):
            rows = np.flatnonzero(buckets == bucket)
            if bucket < 0:
                for r in rows:
                    out[r] = self._long(pieces[r])
                continue
            width = int(lengths[rows].max())
            per = max(1, (1 << 21) // max(width, 1))
            for at in range(0, len(rows), per):
                part = rows[at : at + per]
                for r, ids in zip(part, self._matrix([pieces[r] for r in part], lengths[part], width), strict=True):
                    out[r] = ids
        return out

    def _matrix(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[np.ndarray]:
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        done, rows = ids.copy(), np.arange(len(pieces))
        sizes = lengths.copy()
        # Ranks of all pairs; a merge changes the two beside it.
        ranks = np.full(ids.shape, NONE, dtype=np.int32)
        if width > 1:
            ranks[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best != NONE
            if not live.all():
                done[rows[~live], : ids.shape[1]] = ids[~live]
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            line, wide = np.arange(len(rows)), ids.shape[1]
            ids[line, at] = best
            stay = np.ones(ids.shape, dtype=bool)
            stay[line, at + 1] = False
            ids, ranks = ids[stay].reshape(-1, wide - 1), ranks[stay].reshape(-1, wide - 1)
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, wide - 2)
            ranks[line, at] = np.where(at < wide - 2, self.pairs(best, ids[line, after]), NONE)
            ranks[line, before] = np.where(at > 0, self.pairs(ids[line, before], best), ranks[line, before])
            sizes[rows] -= 1
            longest = max(1, int(sizes[rows].max()))
            ids, ranks = ids[:, :longest], ranks[:, :longest]
        return [row[:n] for row, n in zip(done, sizes, strict=True)]

    def _long(self, piece: bytes) -> np.ndarray:
        """A row of its own: every round merges all occurrences, from the left, of its minimum-rank pair.

        Merges of a pair rank after it, so this is what leftmost rounds give, in fewer of them.
        """
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        while len(ids) > 1:
            ranks = self.pairs(ids[:-1], ids[1:])
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            run = np.cumsum(np.concatenate([[0], np.diff(at) != 1]))  # overlapping ones, as in aaa: each second of a run
            first = np.zeros(run[-1] + 1, dtype=np.int64)
            first[run[::-1]] = at[::-1]
            at = at[(at - first[run]) % 2 == 0]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def _learn(self, words: list[str]) -> None:
        """Encode words, each a stretch of text that the pattern cuts alike wherever it stands."""
        findall, decimal = self.pattern.findall, self.decimals.__getitem__
        cut = [findall(w) for w in words]
        pieces = list({p for c in cut for p in c})
        ids = dict(zip(pieces, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces]), strict=True))
        for w, c in zip(words, cut, strict=True):
            own = ids[c[0]] if len(c) == 1 else np.concatenate([ids[p] for p in c]) if c else NO_IDS
            self.cache[w] = (own.tobytes(), " ".join(map(decimal, own.tolist())))

    def _whole(self, text: str) -> tuple[bytes, str]:
        cut = self.pattern.findall(text)
        new = list(set(cut))
        ids = dict(zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        own = np.concatenate([ids[p] for p in cut]) if cut else NO_IDS
        return own.tobytes(), " ".join(map(self.decimals.__getitem__, own.tolist()))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text: its ids as little-endian 32-bit numbers, and in decimal joined by a space."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cut = [words(t) for t in texts]
        new = {w for c in cut for w in c} - self.cache.keys()
        odd = {w for w in new if apart(w)}
        self.cache.update(dict.fromkeys(odd, ODD))
        self._learn(list(new - odd))
        get, out = self.cache.__getitem__, []
        for t, c in zip(texts, cut, strict=True):
            found = list(map(get, c))
            if ODD in found:
                found = [self._whole(t)]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[at].tobytes()


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for. ``path`` is read by each worker."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            rows = []
            for at in range(0, len(texts), 2000):
                for ids, decimals in bpe.encode(texts[at : at + 2000]):
                    found = np.frombuffer(ids, dtype="<u4").astype(np.int64)
                    row = (len(found), hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(bpe.decode(found)).hexdigest())
                    rows.append((*row, found.astype(np.int32)) if with_ids else row)
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    small_batches(docs.sparkSession)
    return slim(docs).mapInPandas(run, schema)


def op4(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return encoded(docs, path, pattern).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
