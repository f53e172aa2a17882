"""Slow, plain versions of what the operators compute, on small tables; and tables of odd shapes."""

import glob
import math
import re
import string
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from volumetra.llm import common, fingerprints, near_dedup, packing, quality_classifier, secrets, sharding, toxicity
from volumetra.llm.common import table

from .test_operators import OPERATORS, components, shingle_sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


# -- op1


def folded(text):
    once = unicodedata.normalize("NFKC", text).casefold()
    return re.sub("[\x09-\x0d\x20\x85\xa0  -     　]+", " ", unicodedata.normalize("NFKC", once)).strip(" ")


@pytest.mark.parametrize("bits", (128, 8))
def test_fingerprints_of_texts_and_edited_texts(docs, rows, bits):
    """Fingerprints are equal exactly where canonical forms are, across both columns; with 8 bits most buckets are shared."""
    order = sorted(rows, key=lambda r: -r[0])
    forms, likely = {}, {}
    for i, (key, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        forms[key] = (folded(text), folded(text[: len(text) - half] + after[:half]))
        likely[key] = (float(forms[key][0] == forms[key][1]), float(forms[key][0] == folded(after)))
    got = {r["doc_id"]: r for r in fingerprints.op1(docs, bits).collect()}
    pairs = {(form, print_) for key, own in forms.items() for form, print_ in zip(own, (got[key]["fingerprint"], got[key]["edited_fingerprint"]), strict=True)}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    assert {key: (r["near_edited"], r["near_next"]) for key, r in got.items()} == likely


# -- op2


def test_near_duplicates_by_every_branch(spark, docs, rows, monkeypatch):
    """Small groups, hot keys of few rows, and ids that are joined instead of broadcast give the same components."""
    copies = [(100_000 + i, "a passage that many documents share word for word " * 3 + f"number {i % 7}") for i in range(40)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string")).cache()
    expected = components(shingle_sets(rows + copies))
    monkeypatch.setattr(near_dedup, "GROUP", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    plain = near_dedup.confirmed
    for most in (near_dedup.BROADCAST_IDS, 0):
        monkeypatch.setattr(near_dedup, "confirmed", lambda *a, most=most: plain(*a, broadcast_ids=most))
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.op2(both).collect()} == expected


def test_hot_keys_and_spread_joins(spark):
    left = common.saved(spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 1010, None).otherwise(F.col("id")).alias("k"), "id"))
    right = spark.range(0, 3000, 2).select((F.col("id") + 1).alias("k"), F.col("id").alias("x"))
    assert common.hot_keys(left, "k") == [7]
    for how in ("inner", "left"):
        a = common.spread_join(left, right, "k", how).select("k", "id", "x").collect()
        assert Counter(map(tuple, a)) == Counter(map(tuple, left.join(right, "k", how).select("k", "id", "x").collect()))


def test_only_kept_tables_stay(spark, docs):
    found = lambda: set(glob.glob(f"{common.shared_dir(spark).removeprefix('file:')}/table-*"))
    before = found()
    near_dedup.op2(docs).count()
    assert len(found() - before) == 1


# -- op3 and op9


def test_quality_scores_by_loops(rows):
    q = quality_classifier
    rng = np.random.default_rng(1)
    p = {"table": rng.normal(0, 1, (256, q.DIM)), "filters": rng.normal(0, 1, (q.WIDTH * q.DIM, q.FILTERS)), "bias": rng.normal(0, 1, q.FILTERS), "top": rng.normal(0, 1, q.FILTERS), "shift": rng.normal(0, 1, 1)}
    texts = ["", "é", "x" * 255, "x" * 256, "abc" * 171, *[t[:3000] for _, t in rows[:6]]]
    for text in texts:
        raw = text.encode()
        count = max(2, math.ceil((len(raw) + q.WIDTH) / q.HALF))
        padded = raw + bytes(count * q.HALF + q.WIDTH - len(raw))
        logits = []
        for chunk in range(count - 1):
            pooled = [-math.inf] * q.FILTERS
            for at in range(chunk * q.HALF, (chunk + 2) * q.HALF, q.STEP):
                window = [x for b in padded[at : at + q.WIDTH] for x in p["table"][b]]
                for f in range(q.FILTERS):
                    pooled[f] = max(pooled[f], sum(w * k for w, k in zip(window, p["filters"][:, f], strict=True)))
            logits.append(sum(max(m + b, 0) * t for m, b, t in zip(pooled, p["bias"], p["top"], strict=True)) + p["shift"][0])
        model = p | {"a": 0.7, "b": -0.2, "constant": False}
        expected = 1 / (1 + math.exp(-(0.7 * sum(logits) / len(logits) - 0.2)))
        assert math.isclose(q.score_texts([text], model)[0], expected, rel_tol=1e-6, abs_tol=1e-9)


def test_quality_gradients(monkeypatch):
    """One step of training lowers the loss on what it is trained on, and the network tells two plain kinds of text apart."""
    texts = ["lorem ipsum dolor sit amet " * 12] * 12 + ["0xff 0xfe {{}} ;; ## " * 14] * 12
    y = np.array([1.0] * 12 + [0.0] * 12)
    model = quality_classifier.train(texts, y, 0.0)
    scores = quality_classifier.score_texts(["lorem amet dolor sit " * 15, "{{}} ## 0xfe ;; 0xff " * 15], model)
    assert scores[0] > 0.9 and scores[1] < 0.1


def slow_grams(text):
    """Hashed n-grams by Python numbers."""
    codes = [ord(c) for c in f" {re.sub(chr(92) + 's+', ' ', text.lower())} "]
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(codes) - n + 1):
            h = codes[i]
            for c in codes[i + 1 : i + n]:
                h = (h * 0x9E3779B1 + c) % 2**32
            out.add((((h ^ (h >> 15)) * 0x85EBCA6B) % 2**32) >> (32 - toxicity.BITS))
    return out


def test_toxicity_by_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 60)
    bad = ["you are a vile fool", "vile fool go away", "what a vile thing", "foolish vile people are"]
    good = ["the garden is lovely today", "what a lovely day", "people are kind", "a kind day in the garden", "today is the day"]
    texts, y = bad + good, [1] * 4 + [0] * 5
    sets = [slow_grams(t) for t in texts]
    assert all(s == set(toxicity.grams(t).tolist()) for s, t in zip(sets, texts, strict=True))
    stats = {}
    for g in set.union(*sets):
        c = [sum(g in s and v == k for s, v in zip(sets, y, strict=True)) for k in (0, 1)]
        p0, p1 = (c[0] + 0.5) / (5 + 1), (c[1] + 0.5) / (4 + 1)
        stats[g] = (math.log(p1 / p0), 0.0 if sum(c) < 3 else (p1 - p0) / math.sqrt(p1 * (1 - p1) / 4 + p0 * (1 - p0) / 5))
    weights, bias = toxicity.train(texts, np.array(y, dtype=float), 0.3)
    used = np.flatnonzero(weights)
    assert {g for g in stats if abs(stats[g][1]) > 0} >= set(used.tolist()) and len(used) > 5
    # The regression again, over lists.
    chosen = sorted(sorted(range(1 << toxicity.BITS), key=lambda g: (-abs(stats.get(g, (0, 0))[1]), g))[:60])
    x = [[stats[g][0] if g in s else 0.0 for g in chosen if g in stats] for s in sets]
    names = [g for g in chosen if g in stats]
    w, b, m_w, m_b = [0.0] * len(names), 0.0, [1e-8] * len(names), 1e-8
    for _ in range(300):
        e = [1 / (1 + math.exp(-(sum(a * c for a, c in zip(r, w, strict=True)) + b))) - v for r, v in zip(x, y, strict=True)]
        g_w = [sum(e[i] * x[i][k] for i in range(9)) / 9 + 2e-3 * w[k] for k in range(len(names))]
        g_b = sum(e) / 9
        for k in range(len(names)):
            m_w[k] += g_w[k] ** 2
            w[k] -= 0.1 * g_w[k] / math.sqrt(m_w[k])
        m_b += g_b**2
        b -= 0.1 * g_b / math.sqrt(m_b)
    expected = {g: w[k] * stats[g][0] for k, g in enumerate(names)}
    assert all(math.isclose(weights[g], v, rel_tol=0.02, abs_tol=0.01) for g, v in expected.items())
    assert math.isclose(bias, b + 0.3 - math.log(4 / 5), rel_tol=0.02, abs_tol=0.01)
    for text in ["", "a vile garden", "LOVELY   vile\nfool", "lovely day"]:
        z = bias + sum(float(weights[g]) for g in slow_grams(text))
        assert math.isclose(toxicity.score_texts([text], weights, bias)[0], 1 / (1 + math.exp(-z)), rel_tol=1e-5)


# -- op5

RUN = re.compile("[A-Za-z0-9+/=_-]+")


def entropy_spans(text, base):
    """Candidates of the whole text that base spans do not cover, and of the text with its base spans blanked, if apart from those."""

    def found(t):
        out = []
        for m in RUN.finditer(t):
            s = m[0]
            cased = re.search("[a-z]", s) and re.search("[A-Z]", s)
            if len(s) < secrets.WINDOW or not (re.search("[0-9]", s) or cased) or not re.search("[A-Za-z]", s) or re.search(secrets.ALLOWED, s):
                continue
            windows = [s[i : i + secrets.WINDOW] for i in range(len(s) - secrets.WINDOW + 1)]
            most = max(-sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in Counter(w).values()) for w in windows)
            least = secrets.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", s) else secrets.KEY_BITS if re.search("[0-9]", s) else secrets.LETTER_BITS
            if most >= least - 1e-12:
                out.append((m.start(), 3, m.end()))
        return out

    inside = {i for a, _, b in base for i in range(a, b)}
    own = [e for e in found(text) if not set(range(e[0], e[2])) <= inside]
    blank = "".join(" " if i in inside else c for i, c in enumerate(text))
    return own + [e for e in (found(blank) if base else []) if not any(o[0] < e[2] and e[0] < o[2] for o in own)]


def test_all_spans_by_loops(spark, docs, rows):
    from .test_operators import base_spans

    rng = np.random.default_rng(4)
    letters = list(string.ascii_letters + string.digits + "+/=_-  \n:'\"") + ["é", "token=", "AKIA", "deadbeef"]
    made = [(50_000 + i, "".join(rng.choice(letters, 400))) for i in range(150)]
    made += [(60_000, "".join(rng.choice(list("0123456789abcdef "), 3000, p=[0.06] * 16 + [0.04]))), (60_001, "password=" + "A1b2C3d4E5f6G7h8I9j0" * 3 + "/" + "".join(rng.choice(list(string.ascii_letters), 60)))]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in secrets.op5(both).collect()}
    added = 0
    for key, text in rows + made:
        base = base_spans(text)
        more = entropy_spans(text, base)
        added += len(more)
        assert got[key]["spans"] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more)), key
    assert added > 50


def test_masking_by_loops(spark):
    rng = np.random.default_rng(6)
    letters = list("abc 0189+/=\n") + ["token=Zx9Kq2", "😀", "deadbeefdeadbeefdeadbeef"]
    docs = spark.createDataFrame([(i, "".join(rng.choice(letters, 9000 if i == 0 else 60))) for i in range(60)], "doc_id long, text string").cache()
    spans = {r["doc_id"]: r["spans"] for r in secrets.op5(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    for key, text in map(tuple, docs.collect()):
        out, at = [], 0
        merged = []
        for s in sorted(tuple(map(int, x.split(":")[1:])) for x in spans[key].split(",") if x):
            if merged and s[0] < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
            else:
                merged.append(s)
        for a, b in merged:
            out += [text[at:a], "[SECRET]"]
            at = b
        assert masked[key] == "".join([*out, text[at:]])


# -- op8


def test_weights_of_shards(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    even, heavy = [1.0] * 24, [1.0] * 24
    heavy[5] = 4.0
    both = keys.select(sharding.shard_of(F.col("key"), 24, even).alias("a"), sharding.shard_of(F.col("key"), 24, heavy).alias("b"), sharding.shard_of(F.col("key")).alias("c")).collect()
    assert all(r["a"] == r["c"] for r in both)
    region = sharding.RACK * sharding.REGION
    # What moves, moves into or inside the region and the rack whose weights grew.
    assert all(r["b"] // region == 0 for r in both if r["a"] != r["b"])
    assert all(r["b"] // sharding.RACK == 1 for r in both if r["a"] != r["b"] and r["a"] // region == 0)
    counts = Counter(r["b"] for r in both)
    assert 0.9 < counts[5] / (20_000 * 4 / 27) < 1.1
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("key"), 24, [0.0] * 24)


# -- all of them


@pytest.mark.parametrize("name", OPERATORS)
def test_one_long_run(spark, name):
    """A document that is one run of 200,000 characters, as a data URI is."""
    rng = np.random.default_rng(9)
    run = "".join(rng.choice(list(string.ascii_letters + string.digits + "+/"), 200_000))
    docs = spark.createDataFrame([(1, run), (2, "short"), (3, "data:image/png;base64," + run)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    found = OPERATORS[name](docs, labels).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3}
    if name == "op5":
        assert {r["doc_id"]: r["spans"] for r in found} == {1: "entropy:0:200000", 2: "", 3: "entropy:22:200022"}


def test_stages_on_odd_rows_and_clashing_columns(spark):
    """Each stage of the pipeline on nulls, empty texts, repeated rows, clashing columns, and on none at all."""
    import corpus_pipeline

    good = "The harbour was quiet in the early morning. Small boats came in one after another.\nPeople walked along the pier and talked about the weather. Nobody was in a hurry."
    made = [(1, good), (2, None), (3, ""), (4, good), (4, good), (None, good + " Another end."), (5, good + " token = abcdef123456 was left here by mistake.")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", 1, True, 0.5, 3) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long, spans string, base int, kept boolean, score double, sequence_id int").cache()
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if name != "packing":
                assert out.columns == docs.columns, name
            got = out.collect()
            if frame is not docs:
                assert got == [], name
            elif name == "toxicity":
                assert len(got) == len(made)
            elif name == "quality_rules":
                assert sorted(str(r["doc_id"]) for r in got) == ["1", "4", "4", "5", "None"]
            elif name == "near_dedup":
                assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "5", "None"]  # 5 shares 25 of 34 shingles with 1
            elif name == "secret_scan":
                assert [r["text"] for r in got if r["doc_id"] == 5] == [good + " [SECRET] was left here by mistake."]
            else:
                assert sum(r["length"] for r in got if r["doc_id"] in (2, 3)) == 2 and len(got) == len(made)


def test_ids_and_packing_on_special_tokens(spark):
    """The tokenizers library is the measure for texts with special tokens, odd spaces and long runs."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["", " ", "a  b\n\n c\t", "x" * 5000, "<|endoftext|> a <|endoftext|>", "é ü　z", "1234567 89"]
    for text in texts:
        assert np.frombuffer(packing.ids_of(path)(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
