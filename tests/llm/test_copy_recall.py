"""Near copies of the pipeline against the similarity alone, by the kind of change."""

import random

import pytest

from tallyline.llm import simhash

from .conftest import SCHEMA
from .test_near_duplicates import group

WORDS = [f"w{k}" for k in range(20_000)]
OFTEN = [1 / (k + 1) for k in range(20_000)]


def similarity(a: str, b: str) -> float:
    x, y = set(simhash.shingles(a, 5)), set(simhash.shingles(b, 5))
    return len(x & y) / len(x | y)


def changed(r: random.Random, kind: str, d: list[str]) -> list[str]:
    """d with words changed here and there, a passage replaced, or words added at the end."""
    n, e = len(d), list(d)
    if kind == "scattered":
        for i in r.sample(range(n), max(1, round(n * 0.0225))):
            e[i] = r.choice(WORDS)
    elif kind == "passage":
        k = max(1, round(n * 0.107) - 4)
        i = r.randrange(n - k)
        e[i : i + k] = r.choices(WORDS, OFTEN, k=k)
    else:
        e += r.choices(WORDS, OFTEN, k=round(n * 0.22))
    return e


def found(spark, texts: list[str]) -> list[int]:
    docs = spark.createDataFrame([(k, t, None, None, None, None, None) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    return [r["component_id"] for r in sorted(simhash.near_copies(docs).collect(), key=lambda x: x["doc_id"])]


def test_recall_at_the_threshold(spark):
    r, texts, pairs = random.Random(1), [], {}
    for kind in ("scattered", "passage", "appended"):
        while len(pairs.setdefault(kind, [])) < 80:
            d = r.choices(WORDS, OFTEN, k=r.choice((60, 150, 400)))
            a, b = " ".join(d), " ".join(changed(r, kind, d))
            if 0.8 <= similarity(a, b) < 0.84:
                pairs[kind].append(len(texts))
                texts += [a, b]
    of = found(spark, texts)
    for kind, starts in pairs.items():
        assert sum(of[k + 1] == k for k in starts) >= 0.95 * len(starts), kind
    assert all(of[k] == k and of[k + 1] in (k, k + 1) for starts in pairs.values() for k in starts)


@pytest.mark.parametrize("shared", [60, 110])
def test_crowd_that_shares_a_passage(spark, shared):
    """Unlike texts with one passage in common meet under crowded keys; copies among them are found, nothing else is."""
    r = random.Random(shared)
    passage = r.choices(WORDS, k=shared)
    texts = [r.choices(WORDS, k=40) + passage for _ in range(60)]
    texts += [t[:-1] + ["other"] for t in texts[:12]] + [["other"] + t for t in texts[6:20]]
    texts = [" ".join(t) for t in texts]
    assert found(spark, texts) == group(len(texts), lambda a, b: similarity(texts[a], texts[b]) >= 0.8)
