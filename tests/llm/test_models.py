"""Operators 3, 4 and 5: exact parts against plain code, the rest on held-out rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import lm_scoring, quality, toxicity

from .conftest import SCHEMA, rows, text


def test_base_scores(docs):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in rows() if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = [(i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t, *_ in rows()]
    found = [(*r[:5], round(r["base_score"], 4)) for r in lm_scoring.scored(docs).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("n_head", [20, 60, 1000])
def test_probabilities_sum_to_one(spark, n_head):
    """After the start of a text: every known word, an unknown one and the end, whether found in the head or by joins."""
    train = [(k, text(k, 50)) for k in range(40)]
    known = sorted({w for _, t in train for w in t.split()})
    probes = [(1000 + k, w) for k, w in enumerate([*known, "unknown"])]
    docs = spark.createDataFrame([*train, *probes, (5000, "")], "doc_id long, text string")
    # With no word as a context, the end after a word has the probability it has at the start.
    scores = {r["doc_id"]: r["score"] for r in lm_scoring.scored(docs, is_held=F.col("doc_id") >= 1000, n_contexts=0, n_head=n_head).collect()}
    end = scores[5000]
    assert abs(10**end + sum(10 ** (scores[i] - end) for i, _ in probes) - 1) < 1e-4


def test_seating_matches_the_exact_law():
    """Mean tables of many equal pairs against the law summed up by hand."""
    d, c, rest, base = 0.6, 6, 10, 0.05
    seating = lm_scoring.Seating(d, 1)
    n = 20_000
    drawn = seating.sweep(np.full(n, c), np.ones(n, dtype=np.int64), np.full(n, rest), np.full(n, base))
    stirling = np.exp(seating.stirling[c])
    w = np.array([stirling[t - 1] * base**t * math.prod(lm_scoring.STRENGTH + d * (rest + j) for j in range(t)) for t in range(1, c + 1)])
    assert abs(drawn.mean() - (w / w.sum() @ np.arange(1, c + 1))) < 0.02


def test_language_model_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = lm_scoring.scored(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]


def by_hand(train, probes):
    """Scores of texts where no pair is twice in the training texts, so each has one table."""
    tokens = lambda t: [None, *t.split(), "\n"]
    pairs = [p for t in train for p in itertools.pairwise(tokens(t))]
    assert len(set(pairs)) == len(pairs)
    customers, tables = Counter(u for u, _ in pairs), Counter(w for _, w in pairs)
    d, d0 = 0.95, lm_scoring.discount_of(*(sum(n == k for n in tables.values()) for k in (1, 2)))
    below = lm_scoring.ROOT_STRENGTH + len(pairs)
    s = lm_scoring.STRENGTH

    def p(u, w):
        root = (tables[w] - d0) / below if w in tables else (lm_scoring.ROOT_STRENGTH + d0 * len(tables)) / below
        return (((u, w) in set(pairs)) * (1 - d) + (s + d * customers[u]) * root) / (s + customers[u])

    return [sum(math.log10(p(u, w)) for u, w in itertools.pairwise(tokens(t))) for t in probes]


@pytest.mark.parametrize("chars", [40, 12_000_000])
def test_every_word_is_a_context(spark, monkeypatch, chars):
    """401 words in pairs that are met once, far more than 63 contexts, whatever the number of buckets."""
    monkeypatch.setattr(lm_scoring, "BUCKET_CHARS", chars)
    train = [f"a{k} b{k} c{k} shared d{k}" for k in range(100)]
    probes = ["b5 c5", "c5 b5", "new york", "", train[70], " ".join(reversed(train[70].split()))]
    docs = spark.createDataFrame([*enumerate(train), *enumerate(probes, 1000)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in lm_scoring.scored(docs, is_held=F.col("doc_id") >= 1000).collect()}
    wanted = by_hand(train, [*train, *probes])
    assert np.allclose([found[k] for k in sorted(found)], wanted, atol=1e-9)
    assert found[1004] > found[1005] + 1


def test_probabilities_sum_to_one_over_buckets(spark, monkeypatch):
    """Pairs of the start met often, so tables are drawn, dealt into some 25 buckets."""
    monkeypatch.setattr(lm_scoring, "BUCKET_CHARS", 500)
    test_probabilities_sum_to_one(spark, 60)


def test_language_model_on_nothing(empty):
    assert lm_scoring.scored(empty).count() == 0


def plain_segments(scores):
    """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    a, b = best[2:]
    return [*plain_segments(scores[:a]), (a, b), *((x + b, y + b) for x, y in plain_segments(scores[b:]))]


def test_maximal_segments():
    r = random.Random(2)
    for _ in range(300):
        scores = [r.choice([-5, -3, -1, 1, 2, 4]) + r.random() / 100 for _ in range(r.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(scores))] == plain_segments(scores)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    found = toxicity.scored(docs, toxicity.fitted(docs, labels)).join(labels, "doc_id").where(toxicity.held_out())
    r = found.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r["right"] > 0.9 and 0 <= r["low"] <= r["high"] <= 1


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert toxicity.scored(docs, model).count() == len(rows())
    assert toxicity.kept(docs, model).columns == docs.columns
    none = toxicity.fitted(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(empty, model).count() == 0


def plain_measures(t):
    w = (t or "").encode().split()
    twice = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if twice[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, same = set(), 0
    for x in (t or "").split("\n"):
        if x.encode().split():
            same += x in seen
            seen.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), same, len(covered)


@pytest.mark.parametrize("t", [None, "", "a", "a b c a b c", "x\nx\n\n \nx y", "## é漢 | a b", "a a a a", "a b a b a b"])
def test_measures(t):
    assert quality.measures(t or "")[:5] == plain_measures(t)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    found = quality.judged(docs, labels).collect()
    assert len(found) == len(rows())
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in found)
    assert quality.judged(empty, labels).count() == 0


def test_binomial_tail():
    assert abs(quality.binomial_tail(2, 10, 0.3) - sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3))) < 1e-12


def test_only_certified_rules_are_used():
    """Three of 1000 good texts rejected by the first rule, 200 by both: the second can't be certified."""
    tests = {"en": {True: [3, 200], False: [500, 900]}}
    assert quality.certified(tests, {"en": {True: 1000, False: 1000}}, 0.03, 0.05) == {"en": 1}
    assert quality.certified({"en": {True: [0], False: [9]}}, {"en": {True: 20, False: 9}}, 0.03, 0.05) == {}


def test_repeated_rows_are_one_trial(spark):
    """Few good documents prove nothing, however often their rows are repeated; and rows don't move the cutoffs of others."""
    def kept(good, copies):
        rows_ = [(k, text(k, 100), "en") for k in range(good)] * copies + [(k, " ".join(f"{w}###" for w in text(k, 100).split()), "en") for k in range(900, 1200)]
        docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
        labels = spark.createDataFrame([(k, int(k < 900)) for k in [*range(good), *range(900, 1200)]], "doc_id long, quality int")
        return {r["doc_id"] for r in quality.judged(docs, labels).where("kept").collect()}

    assert kept(20, 1) == kept(20, 50) == {*range(20), *range(900, 1200)}
    assert kept(900, 1) == kept(900, 3) == set(range(900))


def test_rules_cut_bad_texts(spark):
    good = [(k, text(k, 100), "en") for k in range(900)]
    bad = [(k, " ".join(f"{w}###" for w in text(k, 100).split()), "en") for k in range(900, 1200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < 900)) for k in range(1200)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.judged(docs, labels).where("kept").collect()}
    assert kept == set(range(900))


def test_schema_names():
    assert SCHEMA.startswith("doc_id")


def test_cutoffs_by_stratum(spark):
    """Two strata with marks of their own; 40 good labels can't certify 0.03, so the third keeps everything."""
    clean = lambda k, lang: (k, text(k, 100), lang)
    noisy = lambda k, lang: (k, " ".join(f"{w}###" for w in text(k, 100).split()), lang)
    rows_ = [clean(k, "en") for k in range(900)] + [noisy(k, "en") for k in range(900, 1200)] + [clean(k, None) for k in range(2000, 2900)] + [noisy(k, None) for k in range(2900, 3200)] + [clean(k, "xx") for k in range(4000, 4040)] + [noisy(k, "xx") for k in range(4040, 4080)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int("###" not in t)) for k, t, _ in rows_], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.judged(docs, labels).where("kept").collect()}
    assert kept == {k for k, t, lang in rows_ if "###" not in t or lang == "xx"}


def test_many_segments(spark):
    """A hundred toxic passages in one text: calibration and scoring see them all."""
    bad, labels = [], []
    for k in range(600):
        passage = " ".join(["vile", "scum"] * 3)
        body = " ".join(text(k * 7 + j, 90) + (" " + passage if k % 2 else "") for j in range(100 if k < 20 else 2))
        bad.append((k, body))
        labels.append((k, k % 2))
    docs = spark.createDataFrame(bad, "doc_id long, text string")
    model = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    assert all((found[k]["score"] >= 0.5) == bool(k % 2) for k in range(600))
    assert len(found[1]["passages"]) == 100


def test_word_counts_are_summed_over_flushes(spark, monkeypatch):
    """Whatever a task forgets on its way, the counts are those of plain code."""
    monkeypatch.setattr(lm_scoring, "COUNTED", 5)
    texts = [text(k, 30) for k in range(20)] + ["A a\ta", ""]
    docs = spark.createDataFrame([(t, True) for t in texts], "text string, train boolean")
    wanted = Counter(lm_scoring.Reader().number(w) for t in texts for w in [*t.encode().lower().split(), b"\n"])
    assert {r["key"]: r["n"] for r in lm_scoring.word_counts(docs).collect()} == wanted
