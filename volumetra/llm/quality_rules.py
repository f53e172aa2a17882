"""Quality rules, by DataFrame functions alone: counts over the words of whole texts, then line-first cleaning.

A document fails the base rules with fewer than 10 words, or when over 20 % of
its words lie in 5-word windows that occur twice or more in it. The method then
judges each line by its punctuation, navigation marks and boilerplate phrases,
removes the lines that fail, and rejects the document if less than
``LEAST_KEPT`` of the characters of its lines are left.

Null and empty texts have no words and fail. A very long text, or line, is judged
whole. Rows that repeat, or share an id, or have none, are judged one by one with
equal results. An empty table gives an empty result. Other columns are neither read
nor changed, whatever their names (``clean`` keeps n_chars true where there is one).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, slim, whole_text, word_array

GRAM = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
LEAST_KEPT = 0.5
#: A line ends as a sentence does, closing quotes and brackets aside (fixed values).
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*\s*$"""
NAVIGATION = r"(?i)\b(click here|read more|sign in|sign up|log ?in|next page|previous page|back to top|skip to content|main menu|add to cart|share this|follow us|site map)\b"
BOILERPLATE = r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|use cookies|enable javascript|lorem ipsum|subscribe to our newsletter|powered by)\b|\bcopyright \(c\)"
#: In lower case, one of these is in every text with a boilerplate phrase.
PHRASES = ["rights reserved", "terms of", "policy", "use cookies", "javascript", "lorem ipsum", "newsletter", "copyright (c)", "powered by"]


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of 5 that occur at least twice in the array, first occurrences included.

    Equal windows have equal hashes, so a text without equal hashes has none.
    Elsewhere the windows themselves are sorted and compared.
    """

    def hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h["h"]) - GRAM), lambda i: F.xxhash64(*[h["h"][i + k] for k in range(GRAM)]))

    def exact(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(v["w"]) - GRAM)
        grams = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(v["w"], i + 1, GRAM)).alias("gram"), i.alias("at"))))

        def twice(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s["g"], i)["gram"] == F.get(s["g"], j)["gram"], F.lit(False))
            found = F.filter(F.sequence(F.lit(0), F.size(s["g"]) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            starts = F.sort_array(F.transform(found, lambda i: s["g"][i]["at"]))
            zero = F.struct(F.lit(-GRAM).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(starts, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(GRAM), p - a["last"])).alias("n")), lambda a: a["n"])

        return let(F.struct(grams.alias("g")), twice)

    def count(v: Column) -> Column:
        h = F.struct(F.transform(v["w"], lambda w: F.xxhash64(w)).alias("h"))
        any_equal = let(let(h, hashes), lambda x: F.size(F.array_distinct(x)) < F.size(x))
        return F.when(any_equal, exact(v)).otherwise(F.lit(0))

    return F.when(F.size(words) < GRAM, F.lit(0)).otherwise(let(F.struct(words.alias("w")), count))


def _symbols(text: Column) -> Column:
    return F.when(text.rlike("[#*$%&|<>]"), F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]", ""))).otherwise(F.lit(0))


def _times(text: Column, part: str) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())


def line_passes(line: Column, doc: Column) -> Column:
    """The rules for one line that has a word. ``doc`` tells whether the text has any symbols, !!, bars or phrases at all."""

    def judged(v: Column) -> Column:
        text, n = v["line"], v["n"]
        few_symbols = ~doc["symbols"] | (_symbols(text) <= F.greatest(F.lit(3), n * 0.3))
        few_shouts = ~doc["shouts"] | (_times(text, "!!") <= F.greatest(F.lit(2), n * 0.2))
        bars = _times(text, "|") + _times(text, "»") + _times(text, "›") + _times(text, "•")
        few_bars = ~doc["bars"] | (bars < F.greatest(F.lit(3), n * 0.2))
        ends = F.substring(F.rtrim(text), -8, 8).rlike(SENTENCE_END)
        navigation = (n <= 12) & text.rlike(NAVIGATION)
        return ends & few_symbols & few_shouts & few_bars & ~navigation & ~(doc["phrases"] & text.rlike(BOILERPLATE))

    return let(F.struct(line.alias("line"), (_times(line, " ") + 1).alias("n")), judged)


def judge(docs: DataFrame) -> DataFrame:
    """(_row, cleaned, the counts, base_failed, kept) for every input row."""
    text = F.col("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    low = F.lower(text)
    phrases = let(F.struct(low.alias("t")), lambda v: functools.reduce(lambda a, b: a | b, [F.contains(v["t"], F.lit(p)) for p in PHRASES]))
    doc = F.struct(text.rlike("[#*$%&|<>]").alias("symbols"), F.contains(text, F.lit("!!")).alias("shouts"), text.rlike("[|»›•]").alias("bars"), phrases.alias("phrases"))
    good = let(F.struct(F.col("lines").alias("lines"), doc.alias("doc")), lambda v: F.filter(v["lines"], lambda x: line_passes(x, v["doc"])))
    rows = rows.withColumn("good", good).withColumn("words", word_array(text))
    measure = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.char_length(x))
    rows = rows.select(
        "_row",
        F.array_join("good", "\n").alias("cleaned"),
        F.size("words").cast("long").alias("n_words"),
        measure(F.col("words")).cast("long").alias("word_chars"),
        _symbols(text).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        (measure(F.col("good")) >= LEAST_KEPT * measure(F.col("lines"))).alias("_enough"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("_enough"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines that failed; same columns, n_chars as the text now is."""
    rows = judge(docs).where("kept")
    new = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("long")}
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op7(docs: DataFrame) -> DataFrame:
    return judge(slim(docs)).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
