"""Secret scans, by DataFrame functions alone.

Base kinds: ``assign`` (a keyword with a value of 6+ characters), ``access``
(an access key id of 20+ characters), ``hex`` (24+ hex digits), each the leftmost
non-overlapping matches over the whole text. The entropy pass adds ``entropy``
spans: over candidate strings of 20+ characters that hold a digit or letters of
both cases, the Shannon entropy of a sliding window of 20 characters, one
character going and one coming at a time, against a threshold for the
candidate's character class. Candidates on the allow-list, and those that base
spans cover from end to end, add nothing. What base spans leave of a candidate is
a candidate too, so that the allow-list does not pass it with its neighbour.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Time
grows in proportion to a text, whatever runs and matches it holds. Spans are sorted
by start, then kind as listed, then end. Rows that repeat, or share an id, or have
none, are scanned one by one. An empty table gives an empty result. Other columns
are neither read nor changed, whatever their names (``redact`` keeps n_chars true
where there is one).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, slim

#: Patterns of the base kinds, in the order of listing (fixed values), and cheap tests of a text before them.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]
#: Runs of key characters with a digit or both cases, from the start of a run.
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9]|[A-Z+/=_-]*+[a-z][a-z+/=_-]*+[A-Z]|[a-z+/=_-]*+[A-Z][A-Z+/=_-]*+[a-z])[A-Za-z0-9+/=_-]{20,}+"
WINDOW = 20
#: Bits a character that a window must reach, by class: hex digits, other key characters, those without a digit.
#: Of random keys of 20 letters 70 % reach the last one, of 40 letters 99 %; of names in Python code 15 %.
HEX_BITS, KEY_BITS, LETTER_BITS = 2.9, 3.7, 3.9
#: Placeholders, running alphabets, checksums of lock files, UUIDs.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|your[-_]?(key|token)|x{6,}|0{8,}|01234567|12345678|abcdefgh|qwerty|^sha(1|256|384|512)-|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Array of (start, kind, end) of the pattern's matches that ``keep(match, group 2)`` accepts.

    The pieces between the matches give the offsets.
    """
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern is ASSIGN else F.array().cast("array<string>")
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), second.alias("second"))

    def walk(v: Column) -> Column:
        def step(pos: Column, i: Column) -> tuple[Column, Column]:
            start = pos + F.char_length(v["gaps"][i])
            end = start + F.char_length(v["hits"][i])
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            return end, F.when(keep(v["hits"][i], F.get(v["second"], i)), F.array(span)).otherwise(F.array().cast(SPANS))

        return walked(F.size(v["hits"]), F.lit(0), step, SPANS)

    return F.when(text.rlike(pattern), let(found, walk)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,kind:int,end:int>>"
STEP = 256


def walked(n: Column, start: Column, step, kind: str) -> Column:
    """All that ``step(state, i)`` = (next state, array) emits for i = 0 to n - 1, as one array.

    It goes by blocks of STEP, so that no long array is copied for each element.
    """

    def one(acc: Column, i: Column) -> Column:
        state, items = step(acc["state"], i)
        return F.struct(state.alias("state"), F.concat(acc["out"], items).alias("out"))

    def block(acc: Column, first: Column) -> Column:
        own = F.aggregate(F.sequence(first, F.least(first + (STEP - 1), n - 1)), F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out")), one)
        return let(own, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    empty = F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(STEP)), empty, block, lambda acc: F.flatten(acc["out"]))).otherwise(F.array().cast(kind))


def united(spans: Column, touching: bool) -> Column:
    """Spans sorted by start, joined where they overlap (or touch): disjoint and sorted."""

    def over(v: Column) -> Column:
        def step(at: Column, i: Column) -> tuple[Column, Column]:
            s = F.get(v["s"], i)  # null after the last one
            joins = F.coalesce(s["start"] <= at["end"] if touching else s["start"] < at["end"], F.lit(False)) & (at["end"] > 0)
            after = F.struct(F.when(joins, at["start"]).otherwise(s["start"]).alias("start"), F.when(joins, F.greatest(at["end"], s["end"])).otherwise(s["end"]).alias("end"))
            done = F.struct(at["start"].alias("start"), F.lit(0).alias("kind"), at["end"].alias("end"))
            return after, F.when(joins | (at["end"] == 0), F.array().cast(SPANS)).otherwise(F.array(done))

        zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
        return walked(F.size(v["s"]) + 1, zero, step, SPANS)

    return F.when(F.size(spans) > 0, let(F.struct(spans.alias("s")), over)).otherwise(F.array().cast(SPANS))


def last_before(spans: Column, x: Column) -> Column:
    """The index of the last of sorted spans that starts before x, by halving; -1 if none does."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        before = F.get(spans, mid)["start"] < x
        return F.struct(F.when((acc["lo"] < acc["hi"]) & before, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when((acc["lo"] < acc["hi"]) & ~before, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.char_length(F.bin(F.size(spans).cast("long")))), start, step, lambda acc: acc["lo"] - 1)


def filled(text: Column, spans: Column, fill) -> Column:
    """The text with ``fill(length)`` in place of each of its disjoint sorted spans. Texts are cut into chunks once, so that no piece is sought from their start."""
    n = F.char_length(text)
    size = F.greatest(F.lit(4096), (8 * F.sqrt(n)).cast("int"))
    chunks = lambda c: F.transform(F.sequence(F.lit(0), F.floor(n / c).cast("int")), lambda k: F.substring(text, k * c + 1, c))

    def over(v: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / v["size"]).cast("int")
            some = F.array_join(F.slice(v["chunks"], first + 1, F.floor(b / v["size"]).cast("int") - first + 1), "")
            return F.substring(some, a - first * v["size"] + 1, b - a)

        def step(pos: Column, i: Column) -> tuple[Column, Column]:
            s = F.get(v["s"], i)  # null after the last one
            return F.coalesce(s["end"], pos), F.array(piece(pos, F.coalesce(s["start"], v["n"])), F.coalesce(fill(s["end"] - s["start"]), F.lit("")))

        return F.array_join(walked(F.size(v["s"]) + 1, F.lit(0), step, "array<string>"), "")

    parts = let(size, lambda c: F.struct(c.alias("size"), chunks(c).alias("chunks"), n.alias("n"), spans.alias("s")))
    return F.when(F.size(spans) > 0, let(parts, over)).otherwise(text)


#: The characters of candidates, numbered in this order; a window's counts stand in six numbers, twelve characters in each, five bits a count.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
PER, WIDTH = 12, 5
#: c log2 c by c.
TERMS = [0.0, *[c * math.log2(c) for c in range(1, WINDOW + 2)]]


def window_entropy(s: Column) -> Column:
    """The largest Shannon entropy of a window, in bits a character, of a string of candidates' characters.

    H = log2(W) - sum(c log2 c) / W. The counts of the window's characters are
    carried along: each step takes one from the character that leaves, adds one to
    that which enters, and changes the sum by their terms. A shorter string is one window.
    """
    places = [LETTERS.find(chr(i)) for i in range(128)]
    number = F.lit([max(0, k) // PER for k in places])  # by ASCII code: which of the numbers,
    shift = F.lit([max(0, k) % PER * WIDTH for k in places])  # and where in it
    terms = F.lit(TERMS)
    have = lambda counts, c: F.call_function("shiftright", counts[number[c]], shift[c]).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
    one = F.lit([1 << (k % PER * WIDTH) if k >= 0 else 0 for k in places])

    def moved(counts: Column, c: Column, by: int) -> Column:
        return F.transform(counts, lambda x, k: F.when(k == number[c], x + by * one[c]).otherwise(x))

    def enter(acc: Column, c: Column) -> Column:
        n = have(acc["counts"], c)
        return F.struct((acc["sum"] + terms[n + 1] - terms[n]).alias("sum"), moved(acc["counts"], c, 1).alias("counts"))

    def over(v: Column) -> Column:
        empty = F.struct(F.lit(0.0).alias("sum"), F.lit([0] * -(-len(LETTERS) // PER)).cast("array<bigint>").alias("counts"))
        first = F.aggregate(F.slice(v["c"], 1, WINDOW), empty, enter)

        def step(acc: Column, i: Column) -> Column:
            def slid(x: Column) -> Column:
                n = have(acc["counts"], x["gone"])
                left = let(F.struct(moved(acc["counts"], x["gone"], -1).alias("counts"), (acc["sum"] + terms[n - 1] - terms[n]).alias("sum")), lambda y: enter(y, x["come"]))
                return let(left, lambda y: F.struct(y["sum"].alias("sum"), y["counts"].alias("counts"), F.least(acc["low"], y["sum"]).alias("low")))

            return let(F.struct(v["c"][i - WINDOW].alias("gone"), v["c"][i].alias("come")), slid)

        steps = F.when(F.size(v["c"]) > WINDOW, F.sequence(F.lit(WINDOW), F.size(v["c"]) - 1)).otherwise(F.array().cast("array<int>"))
        start = let(first, lambda x: F.struct(x["sum"].alias("sum"), x["counts"].alias("counts"), x["sum"].alias("low")))
        return F.aggregate(steps, start, step, lambda acc: acc["low"])

    codes = F.transform(F.split(F.substring(s, F.lit(1), F.char_length(s)), ""), lambda c: F.least(F.ascii(c), F.lit(127)))
    lowest = let(F.struct(F.filter(codes, lambda c: c > 0).alias("c")), over)
    return F.log2(F.least(F.lit(WINDOW), F.greatest(F.lit(1), F.char_length(s))).cast("double")) - lowest / F.least(F.lit(WINDOW), F.greatest(F.lit(1), F.char_length(s)))


def _random_looking(s: Column, _: Column) -> Column:
    is_hex = s.rlike("^[0-9a-fA-F]+$")
    least = F.when(is_hex, HEX_BITS).when(s.rlike("[0-9]"), KEY_BITS).otherwise(LETTER_BITS)
    return s.rlike("[A-Za-z]") & ~s.rlike(ALLOWED) & (window_entropy(s) >= least)


def scan(docs: DataFrame) -> DataFrame:
    """(_row, text, base, entropy, spans): every input row with its spans, sorted by start, kind, end."""
    text = F.col("text")
    every = lambda hit, group: F.lit(True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        _spans(text, ASSIGN, 0, lambda hit, group: F.char_length(group) >= 6).alias("assign"),
        _spans(text, ACCESS, 1, every).alias("access"),
        _spans(text, HEX, 2, every).alias("hex"),
        _spans(text, CANDIDATE, 3, _random_looking).alias("entropy"),
    )
    rows = rows.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    rows = rows.withColumn("_base", united(F.col("base"), True))
    covering = lambda e: F.get(F.col("_base"), last_before(F.col("_base"), e["start"] + 1))["end"]
    rows = rows.withColumn("entropy", F.filter("entropy", lambda e: F.coalesce(covering(e) < e["end"], F.lit(True))))
    blank = filled(text, F.col("_base"), lambda n: F.repeat(F.lit(" "), n))
    left = F.when(F.size("base") > 0, let(blank, lambda t: _spans(t, CANDIDATE, 3, _random_looking))).otherwise(F.array().cast(SPANS))
    reaching = lambda e: F.get(F.col("entropy"), last_before(F.col("entropy"), e["end"]))["end"]
    apart = F.filter(left, lambda e: F.coalesce(reaching(e) <= e["start"], F.lit(True)))
    rows = rows.withColumn("spans", F.sort_array(F.concat("base", "entropy", apart)))
    return rows.drop("_base")


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.lit(KINDS), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with each secret's span, overlaps joined, replaced by ``mask``; same columns."""

    found = scan(docs)
    masked = let(united(F.col("spans"), False), lambda v: filled(F.col("text"), v, lambda n: F.when(n.isNotNull(), F.lit(mask))))
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("_row.text"))
    out = found.withColumn("_new", text)
    return out.select(*[F.col("_new").alias(c) if c == "text" else F.when(F.size("spans") > 0, F.char_length("_new").cast("long")).otherwise(F.col("_row.n_chars")).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    rows = scan(slim(docs))
    return rows.select(
        "_row.doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
