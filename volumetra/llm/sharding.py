"""Sharding by a hierarchical weighted hash tree.

The shards form racks of ``RACK`` and regions of ``REGION`` racks, in order of
their numbers. A document descends from the root: at each level every child
draws -ln(u) / weight from a hash of (doc_id, child), and the smallest draw
wins, so a child gets rows in proportion to the shards below it. A changed
weight moves rows only into or out of the subtree whose weight changes. From 24
shards to 25, the new shard is a region of its own: rows move into it alone
(the ``key`` law). Growth inside a rack also reshuffles rows among the shards of
the regions that gain; a weight of whole regions keeps the law.

Slots are ranks within a shard, made from counts of small hash buckets, so no
task sees a whole shard. Null texts have no bytes; of a very long one only its size
and checksum leave the scan. Rows of equal doc_id go to one shard; a null doc_id
hashes as the text ``null``. Rows that repeat get a slot each; ties of draws go to
the smaller number. An empty table gives an empty result. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved, shuffle_partitions, slim

RACK, REGION = 4, 3
SHARDS = 24
BUCKET = 256


def _draw(key: Column, level: str, child: Column, weight: Column) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(level), key, child), 12).cast("double") + 0.5) / float(2**52)
    return -F.ln(u) / weight


def _choose(key: Column, level: str, first: Column, last: Column, weight) -> Column:
    """The child of first..last with the smallest draw; ties go to the smaller number."""
    draws = F.transform(F.sequence(first, last), lambda c: F.struct(_draw(key, level, c, weight(c)).alias("draw"), c.alias("child")))
    return F.array_min(draws)["child"]


def shard_of(key: Column, shards: int = SHARDS, weights: list[float] | None = None) -> Column:
    """The shard that a document's key descends to; ``weights``, above 0, by shard (1 each)."""
    own = [1.0] * shards if weights is None else [float(w) for w in weights]
    if len(own) != shards or min(own) <= 0:
        raise ValueError("weights must be one a shard, above 0")
    per_region = RACK * REGION
    sums = lambda per: F.lit([sum(own[i : i + per]) for i in range(0, shards, per)])
    region_weights, rack_weights, shard_weights = sums(per_region), sums(RACK), sums(1)
    regions, racks = -(-shards // per_region), -(-shards // RACK)
    region = _choose(key, "region", F.lit(0), F.lit(regions - 1), lambda c: region_weights[c])
    rack = let(region, lambda r: _choose(key, "rack", r * REGION, F.least(r * REGION + REGION - 1, F.lit(racks - 1)), lambda c: rack_weights[c]))
    return let(rack, lambda r: _choose(key, "shard", r * RACK, F.least(r * RACK + RACK - 1, F.lit(shards - 1)), lambda c: shard_weights[c]))


def with_slots(rows: DataFrame, group: str, tie: list[str]) -> DataFrame:
    """Adds ``slot``: numbers 0, 1, ... without gaps within each group.

    Rows are ranked within (group, hash bucket); the buckets' counts, summed
    over the buckets before, give the bases. A group has a bucket for each BUCKET of
    its rows, eight for each shuffle partition at most, so that one of any size is
    spread over all tasks; rows that repeat whole are of one bucket. ``rows`` is a
    saved table with a bounded number of groups, whose sizes are broadcast.
    """
    most = 8 * shuffle_partitions(rows.sparkSession)
    sizes = rows.groupBy(group).agg(F.least(F.lit(most), F.ceil(F.count("*") / BUCKET)).alias("_parts"))
    rows = rows.join(F.broadcast(sizes), group).withColumn("_part", F.pmod(F.xxhash64(*tie), F.col("_parts")).cast("int")).drop("_parts")
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*tie))
    ranked = rows.withColumn("_rank", rank - 1)
    return ranked.join(bases, [group, "_part"]).withColumn("slot", (F.col("_base") + F.col("_rank")).cast("long")).drop("_part", "_base", "_rank")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = slim(docs).select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), key.alias("_key"))
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), shard_of(F.col("_key"), shards).cast("int").alias("shard"), shard_of(F.col("_key"), shards + 1).cast("int").alias("grown_shard"))
    rows = with_slots(saved(rows), "shard", ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8(docs: DataFrame) -> DataFrame:
    return assign(docs)
