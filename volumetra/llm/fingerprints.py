"""Document fingerprints: a canonical exact digest.

A text is brought to one form (compatibility normalisation, full case folding,
normalisation again, runs of white space folded to one space, trimmed). Two
differently seeded 64-bit xxhashes of that form give a 128-bit bucket. Documents
of a bucket are then compared byte by byte; where a bucket holds different
forms, a rank among them is appended, so the fingerprints of documents are equal
exactly when their canonical forms are.

Null texts count as empty. Rows with a null doc_id keep it; their buckets are not
compared byte by byte. Repeated rows get the same fingerprint; documents of equal
doc_id follow each other in the order of their texts. A very long text is one row,
normalised whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, saved, scratch, shuffle_partitions, slim, spread_join, whole_text

#: Unicode White_Space characters (fixed values).
UNICODE_SPACES = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Ids of documents with a shared bucket are broadcast up to this many (8 bytes each); beyond it they are joined.
BROADCAST_IDS = 4_000_000


def _java(class_name: str, method: str, value: Column, flag: bool) -> Column:
    return F.call_function("reflect", F.lit(class_name), F.lit(method), value, F.lit(flag))


def canonical(text: Column) -> Column:
    """The canonical form, made by the Unicode library that Spark carries."""
    once = _java("com.ibm.icu.text.Normalizer", "compose", F.coalesce(text, F.lit("")), True)
    folded = _java("com.ibm.icu.lang.UCharacter", "foldCase", once, True)
    return F.trim(F.regexp_replace(_java("com.ibm.icu.text.Normalizer", "compose", folded, True), UNICODE_SPACES, " "))


def bucket(form: Column, bits: int = 128) -> Column:
    """Hex of two xxhashes of the canonical form. Fewer bits serve tests of the byte comparison."""
    wide = F.concat(F.lpad(F.lower(F.hex(F.xxhash64(form))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit("second"), form))), 16, "0"))
    return wide if bits >= 128 else F.substring(wide, 1, max(1, bits // 4))


def likeness(a: Column, b: Column) -> Column:
    """An exact digest knows equal and different only."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def ranked(forms: DataFrame) -> DataFrame:
    """Of (fingerprint, form) rows, those whose bucket holds different forms, once each, with their rank from 1. Equal forms are merged before the shuffle."""
    mixed = saved(forms.groupBy("fingerprint").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("fingerprint"))
    different = forms.join(mixed, "fingerprint", "left_semi").distinct()
    return different.withColumn("rank", F.row_number().over(Window.partitionBy("fingerprint").orderBy("form")))


def shared_buckets(docs: DataFrame, digests: DataFrame, bits: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Canonical forms ranked within buckets that hold different ones: (fingerprint, form, rank from 1).

    ``digests``, a saved table, has (doc_id, fingerprint) of all documents. Only
    documents whose bucket holds several are read again.
    """
    multiple = saved(digests.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"))
    ids = spread_join(digests, multiple, "fingerprint", hot=hot_keys(multiple, "fingerprint", "n"))
    ids = saved(ids.select("doc_id").distinct())
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    forms = slim(docs).join(ids, "doc_id", "left_semi").select(canonical(F.col("text")).alias("form"))
    return ranked(forms.select(bucket(F.col("form"), bits).alias("fingerprint"), "form"))


def fingerprints(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(doc_id, fingerprint, group_id): one row per document; group_id is the smallest doc_id with that fingerprint."""
    forms = slim(docs).select("doc_id", canonical(F.col("text")).alias("form"))
    digests = saved(forms.select("doc_id", bucket(F.col("form"), bits).alias("fingerprint")))
    ranks = saved(shared_buckets(docs, digests, bits))
    if ranks.isEmpty():
        out = digests
    else:
        rows = forms.withColumn("fingerprint", bucket(F.col("form"), bits))
        out = rows.join(ranks, ["fingerprint", "form"], "left").select("doc_id", _ranked().alias("fingerprint"))
    smallest = out.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"))
    return spread_join(out, smallest, "fingerprint", hot=hot_keys(digests, "fingerprint")).select("doc_id", "fingerprint", "group_id")


def _ranked() -> Column:
    return F.when(F.coalesce(F.col("rank"), F.lit(1)) > 1, F.concat_ws("-", "fingerprint", F.col("rank").cast("string"))).otherwise(F.col("fingerprint"))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: the value in the row that follows by descending doc_id; the first follows the last.

    Rows are dealt to buckets between exact doc_id quantiles. Each bound is a
    doc_id of the table, so the row that follows a bucket's last one is known
    and is copied there: one shuffle, no window over all rows. Rows of equal
    doc_id follow each other in the order of the other columns; null ids come last.
    """
    parts = 4 * shuffle_partitions(rows.sparkSession)
    bounds = rows.agg(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts)], 100 * parts).alias("b")).first()["b"]
    bounds = sorted({*bounds}) if bounds else [0]
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    # Two levels: the last bound of each block, then the bounds of one block.
    coarse = F.lit([b[-1] for b in blocks[:-1]]) if len(blocks) > 1 else F.array().cast("array<bigint>")
    block = F.size(F.filter(coarse, lambda b: b < F.col("doc_id")))
    inner = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks]), F.col("_block") + 1)
    last = len(bounds)
    dealt = rows.withColumn("_block", block).withColumn("_low", inner).withColumn("_at", F.least(F.col("_block") * step + F.size(F.filter("_low", lambda b: b < F.col("doc_id"))), F.lit(last - 1)))
    here = F.struct(F.col("_at").alias("at"), F.lit(0).alias("copy"))
    there = F.struct(((F.col("_at") + 1) % last).alias("at"), F.lit(1).alias("copy"))
    bound = F.element_at("_low", F.col("_at") - F.col("_block") * step + 1)
    dealt = dealt.select(*rows.columns, F.explode(F.when(F.col("doc_id") == bound, F.array(here, there)).otherwise(F.array(here))).alias("_to"))
    w = Window.partitionBy("_to.at").orderBy("_to.copy", F.desc("doc_id"), *[c for c in rows.columns if c != "doc_id"])
    out = dealt.select(*rows.columns, "_to", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where("_to.copy = 0").drop("_to")


def edited_forms(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Per document its text, its edited text, their canonical forms and that of the next one, and the two buckets.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document by descending doc_id.
    """
    rows = slim(docs).select("doc_id", whole_text().alias("text"))
    if rows.where("doc_id is not null").isEmpty():  # no order: every text is followed by itself
        rows = rows.select("*", F.col("text").alias("next_text"))
    else:
        rows = with_next(rows, ["text"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("*", canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"), canonical(F.col("next_text")).alias("next_form"))
    return rows.select("*", bucket(F.col("form"), bits).alias("fingerprint"), bucket(F.col("edited_form"), bits).alias("edited_fingerprint"))


def edited(forms: DataFrame) -> DataFrame:
    """Of ``edited_forms``: per document its digest, its edited text's digest and their likenesses."""
    return forms.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        # The forms themselves are compared, not only their digests.
        likeness(F.col("form"), F.col("edited_form")).alias("near_edited"),
        likeness(F.col("form"), F.col("next_form")).alias("near_next"),
    )


def op1(docs: DataFrame, bits: int = 128) -> DataFrame:
    with scratch():
        rows = saved(edited(edited_forms(docs, bits)), keep=True)
        if shared_buckets(docs, rows.select("doc_id", "fingerprint"), bits).isEmpty():
            return rows
        # Different texts share a bucket: their forms and the edited texts' are ranked together.
        forms = edited_forms(docs, bits)
        both = forms.select(F.explode(F.array(F.struct("fingerprint", "form"), F.struct(F.col("edited_fingerprint").alias("fingerprint"), F.col("edited_form").alias("form")))).alias("f")).select("f.*")
        ranks = saved(ranked(both))
        for name, form in (("fingerprint", "form"), ("edited_fingerprint", "edited_form")):
            own = ranks.select(F.col("fingerprint").alias(name), F.col("form").alias(form), "rank")
            forms = forms.join(own, [name, form], "left").withColumn(name, F.when(F.coalesce("rank", F.lit(1)) > 1, F.concat_ws("-", name, F.col("rank").cast("string"))).otherwise(F.col(name))).drop("rank")
        return saved(edited(forms), keep=True)
