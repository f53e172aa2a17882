"""MinHash near-duplicates with odd sketches.

A document's set is its distinct 2-word shingles. Documents of equal sets form a
class, stood for by its smallest doc_id. ``SAMPLES`` MinHash values in ``BANDS``
bands propose candidates. The ``LOWEST`` smallest hashes (bottom-k MinHash
samples; smaller sets give all) are folded into a parity bitmap of ``BITS`` bits,
the odd sketch: the population count of two bitmaps' XOR never exceeds, and nearly
equals, the number of samples in one set only. Pairs beyond what similarity 0.8
and their sizes let expect, by six deviations, are dropped; the others are
confirmed on their full sets. With 32 bands of 4, a pair at the bound shares no
band with a probability of 5e-8, and its sketch drops it with less than 1e-7
(never, for sets of up to ``LOWEST``).

No group is expanded into pairs. First each band's members are held against its
smallest one (a star). Components of confirmed links follow. Where a band still
holds several components, its members outside the smallest one's component are
held against all of its members, in blocks of ``BLOCK`` by bitmaps: first a
spanning forest of what passes in a block is confirmed, then, for bands that still
hold several components, all that passes. So every pair that shares a band is in
one component or has been compared.

Texts without words, and null ones, have an empty set and no links; a very long one
is held by one task at a time. Rows that share a doc_id are one node; a row with a
null doc_id has a null component and is kept. One row results for each input row,
repeated ones included; equal sets have equal components; a component's name is its
smallest doc_id, so that no tie is left. An empty table gives an empty result.
Columns other than doc_id and text are not read.

What scales and what does not: keys that hold over a thousandth of a table's rows
(bands, leaders, hubs, digests) meet broadcast rows, fewer than a thousand of them,
instead of being shuffled to one task, and partners of one text are dealt to groups.
A band whose many members are mostly unlike each other is compared within itself by
bitmaps, in blocks spread over tasks: work that grows with the square of such a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, saved, scratch, slim, spread_join
from .words import WordHasher, mix, pair

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
LOWEST, BITS = 512, 2048
LINK = 80
BLOCK = 1024
#: Partners compared with one copy of a text, about.
GROUP = 64
#: Ids are broadcast up to this many (8 bytes each); beyond it they are joined.
BROADCAST_IDS = 4_000_000


def shingles(words: np.ndarray, size: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` words; a shorter text is one shingle, no words none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = words[:n]
    for k in range(1, min(size, len(words))):
        out = pair(out, words[k : k + n])
    if len(words) < size:
        out = mix(out + np.uint64(len(words)))
    return np.unique(out)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


_A, _B = _coefficients()


def minhash(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        for i in range(0, SAMPLES, 16):
            h = _A[i : i + 16, None] * part + _B[i : i + 16, None]
            np.minimum(out[i : i + 16], (h ^ (h >> np.uint32(16))).min(1), out=out[i : i + 16])
    return out


def odd_sketch(found: np.ndarray) -> bytes:
    """Parity bitmap of the LOWEST smallest of sorted distinct hashes."""
    at = (found[:LOWEST] & np.uint64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def most_bits(a, b, link: int, least, root):
    """The largest population count of a pair of sets of sizes a and b with 100 * similarity >= link.

    Of a set of n, the samples are those below the share min(1, LOWEST / n) of the
    hash range. Below the lesser share t both sets are seen, beyond it one of them.
    Works on arrays and on columns, by ``least`` and ``root``.
    """
    common = (a + b) * (link / (100.0 + link))
    k_a, k_b = least(a, LOWEST), least(b, LOWEST)
    t = least(k_a / a, k_b / b)
    differ = (a + b - 2 * common) * t + (k_a - a * t) + (k_b - b * t)
    return differ + 6 * root((differ + 4) * (1 - t)) + 1e-6


def bands(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        out = pair(out, parts[:, k])
    return out.view(np.int64)


def estimate(differing_bits, a, b):
    """Similarity estimated from the population count of two whole sets' sketches' XOR."""
    differ = -BITS / 2 * np.log(np.maximum(1 - 2 * differing_bits / BITS, 1e-9))
    return (a + b - differ) / (a + b + differ)


def sketches(docs: DataFrame, size: int = 2) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch); an empty set has neither digest, bands nor sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(hasher(text.as_py() or ""), size)
                if len(found):
                    samples = minhash(found)
                    rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), bands(samples), odd_sketch(found)))
                else:
                    rows.append((0, None, None, None))
            types = {"n_shingles": pa.int64(), "digest": pa.binary(), "bands": pa.list_(pa.int64()), "sketch": pa.binary()}
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *found], ["doc_id", *types])

    return slim(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, link: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets are alike enough.

    Texts travel alone, one a row. The partners of one ``a`` are dealt to groups of
    about GROUP; each gets one copy of that text, which comes first, and the
    partners' texts stream past it.
    """
    pairs = saved(pairs)
    sizes = saved(pairs.groupBy("a").agg(F.count("*").alias("m")).withColumn("parts", F.ceil(F.col("m") / GROUP).cast("int")))
    large = sizes.where("parts > 1").select("a", "parts")
    dealt = pairs.withColumn("part", F.lit(0))
    if not large.isEmpty():
        dealt = spread_join(pairs, large, "a", "left", hot_keys(sizes, "a", "m"))
        dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0)))
    first = sizes.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    wanted = saved(first.unionByName(dealt.select(F.col("b").alias("doc_id"), "a", "part", "b")))
    ids = saved(wanted.select("doc_id").distinct())
    texts = slim(docs).join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, "doc_id", "left_semi")
    rows = texts.join(wanted, "doc_id").select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, group, firsts = WordHasher(), None, []
        for batch in batches:
            keep = []
            for a, part, b, text in zip(batch["a"].to_pylist(), batch["part"].to_pylist(), batch["b"].to_pylist(), batch["text"], strict=True):
                if group != (a, part):
                    group, firsts = (a, part), []
                own = shingles(hasher(text.as_py() or ""), size)  # one text at a time leaves the batch
                if b is None:
                    firsts.append(own)
                keep.append(b is not None and any(_alike(x, own, link) for x in firsts))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _alike(x: np.ndarray, y: np.ndarray, link: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= link * (len(x) + len(y) - common)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ids in links (a, b): the smallest id reachable. Labels pass along links and jump to their own labels."""
    both = saved(links.select("a", F.col("b").alias("id")).union(links.select("b", "a")).distinct())
    hubs = hot_keys(both, "id")
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("id")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        heard = spread_join(both, labels, "id", hot=hubs).groupBy("a").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, labels["id"] == heard["a"]).select("id", F.col("component").alias("old"), F.least("component", "heard").alias("new"))
        nearer = saved(nearer)
        jump = nearer.select(F.col("id").alias("new"), F.col("new").alias("next"))
        after = saved(spread_join(nearer, jump, "new", "left").select("id", "old", F.least("new", F.coalesce("next", "new")).alias("component")))
        labels = after.select("id", "component")
        if after.where("old <> component").isEmpty():
            return labels


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _across(link: int, whole: bool):
    """Pairs of different components, by size and sketch, within each run of rows of one block; ``whole``: all of them, else a forest."""

    def pairs(g: pd.DataFrame) -> Iterator[list[tuple[int, int]]]:
        row, col = g[g["as_row"]], g[~g["as_row"]]
        if not len(row) or not len(col):
            return
        bits = [np.frombuffer(b"".join(x["sketch"]), dtype=np.uint64).reshape(len(x), -1) for x in (row, col)]
        size, part, key = ((row[c].to_numpy(), col[c].to_numpy()) for c in ("n", "component", "rep"))
        for at in range(0, len(row), 64):
            end = at + 64
            ok = (part[0][at:end, None] != part[1]) & (100 * np.minimum(size[0][at:end, None], size[1]) >= link * np.maximum(size[0][at:end, None], size[1]))
            i, j = np.nonzero(ok)
            most = most_bits(size[0][at + i].astype(float), size[1][j].astype(float), link, np.minimum, np.sqrt)
            near = np.bitwise_count(bits[0][at + i] ^ bits[1][j]).sum(1) <= most
            x, y = key[0][at + i[near]], key[1][j[near]]
            yield list(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))

    def block(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """All pairs go out as they come (64 rows against a block); of a forest, at most a block's rows are held."""
        forest: list[tuple[int, int]] = []
        for found in pairs(g):
            if whole:
                yield pd.DataFrame(list(dict.fromkeys(found)), columns=["a", "b"], dtype="int64")
            else:
                forest = _forest(forest + found)
        yield pd.DataFrame(forest, columns=["a", "b"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        keys = ["key", "i", "j"]
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cut = np.flatnonzero((batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(1)) + 1
            edges = [0, *cut.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    yield from block(batch.iloc[a:b])
            rest = batch.iloc[edges[-1] :]
        if rest is not None and len(rest):
            yield from block(rest)

    return run


def _between(members: DataFrame, reps: DataFrame, found: DataFrame, hot: tuple[list, list], link: int, whole: bool) -> DataFrame:
    """Candidates (a, b) of bands that hold several components. ``hot``: the hot bands and the leaders of the most members."""
    state = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    leads = found.select(F.col("id").alias("leader"), F.col("component").alias("main"))
    state = saved(spread_join(state, leads, "leader", "left", hot[1]).withColumn("main", F.coalesce("main", "leader")).where("m > 2"))
    outside = saved(state.where("component <> main").groupBy("key").agg(F.count("*").alias("u")))
    open_ = spread_join(state, outside, "key", hot=hot[0]).join(reps.select("rep", "n", "sketch"), "rep")
    nb = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = ["rep", "n", "component", "sketch"]
    block = F.pmod(F.xxhash64("rep"), nb("m")).cast("int")
    as_col = open_.where("rep <> leader").select("key", F.explode(F.sequence(F.lit(0), nb("u") - 1)).alias("i"), block.alias("j"), F.lit(False).alias("as_row"), *own)
    as_row = open_.where("component <> main").select("key", F.pmod(F.xxhash64("rep"), nb("u")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), nb("m") - 1)).alias("j"), F.lit(True).alias("as_row"), *own)
    blocks = as_row.unionByName(as_col).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return blocks.mapInPandas(_across(link, whole), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 2, link: int = LINK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row."""
    with scratch():
        return saved(_near_duplicates(docs, size, link), keep=True)


def _near_duplicates(docs: DataFrame, size: int, link: int) -> DataFrame:
    rows = saved(sketches(docs, size))
    # One row per class, merged before the shuffle: equal sets have equal sizes, bands and sketches.
    reps = rows.where("digest is not null and doc_id is not null").groupBy("digest")
    reps = saved(reps.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    members = reps.select(F.explode("bands").alias("key"), "rep")
    stars = members.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("_last"), F.count("*").alias("m")).where("leader <> _last").drop("_last")
    stars = saved(stars)
    bands_ = hot_keys(stars, "key", "m")
    members = saved(spread_join(members, stars, "key", hot=bands_))

    def side(name: str) -> DataFrame:
        return reps.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    star = saved(members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    star = spread_join(star, side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {link} * greatest(n_a, n_b)")
    # Four bytes of the bitmaps at a time.
    word = lambda c, k: F.conv(F.hex(F.substring(c, F.lit(k) if isinstance(k, int) else k, F.lit(4))), 16, 10).cast("long")
    differing = F.aggregate(F.sequence(F.lit(1), F.lit(BITS // 8), F.lit(4)), F.lit(0), lambda n, k: n + F.bit_count(word(F.col("sketch_a"), k).bitwiseXOR(word(F.col("sketch_b"), k))))
    column = lambda x: x if not isinstance(x, int) else F.lit(float(x))
    most = most_bits(F.col("n_a").cast("double"), F.col("n_b").cast("double"), link, lambda x, y: F.least(x, column(y)), lambda x: F.sqrt(F.greatest(F.lit(0.0), x)))
    star = star.where(differing <= most).select("a", "b").distinct()
    links = saved(confirmed(star, docs, size, link))
    found = components(links)
    leaders = hot_keys(members, "leader")
    for whole in (False, True):
        more = saved(confirmed(_between(members, reps, found, (bands_, leaders), link, whole), docs, size, link))
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)
    classes = saved(reps.select("digest", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")))
    out = spread_join(rows.select("doc_id", "n_shingles", "digest"), classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """The documents that are kept, one of each component; same columns. Of rows that share a doc_id one stays; null ids all stay."""
    with scratch():
        found = saved(_near_duplicates(docs, size, LINK).where("doc_id is not null"))
        gone = saved(found.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), keep=True)
        repeated = saved(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), keep=True)
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, docs["doc_id"] == gone["_id"], "left_anti")
    if repeated.isEmpty():
        return out
    same = out["doc_id"] == repeated["_id"]
    return out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates(["doc_id"]))
