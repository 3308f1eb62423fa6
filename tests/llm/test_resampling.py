"""Operator 12 against features that are put together, counted and ranked plainly."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyline.llm import resampling as R

from .conftest import text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(body):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))


def features(body):
    w = words(body)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def crc(x):
    return zlib.crc32(x.encode()) % 10000


def plain(docs, target, percent=5, least=20, seed=42):
    s, t = Counter(), Counter()
    for _, body in docs:
        s.update(map(crc, features(body)))
    for body in target:
        t.update(map(crc, features(body)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for ident, body in docs:
        f = features(body)
        h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc(x)] for x in f)
        rows.append([ident, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(body))])
    best = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    for k, r in enumerate(best[: len(best) * percent // 100], 1):
        r[4] = k
    return sorted(map(repr, ([*r[:5]] for r in rows)))


def found(spark, docs, target, **options):
    df = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in docs], "doc_id long, text string, ident string, part long, place long").repartition(3)
    goal = spark.createDataFrame([(x, 5) for x in target], "text string, weight int")
    out = R.resampled(df, goal, **options).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(repr([*r]) for r in out.collect())


def test_same_as_plain(spark):
    docs = [(k, text(k % 50, 10 + k)) for k in range(120)] + [(200, None), (201, ""), (202, "Ab9 É漢x ab9-c"), (None, text(3, 60)), (5, text(5, 15)), (203, text(9, 5000))]
    target = [text(1000 + k, 40) for k in range(10)] + [text(3, 60), None, ""]
    for percent in (5, 40, 100):
        assert found(spark, docs, target, percent=percent) == plain(docs, target, percent)


def test_repeated_ids_and_ties(spark):
    docs = [(k // 2, text(1, 30)) for k in range(40)]
    assert found(spark, docs, [text(1, 30)], percent=30) == plain(docs, [text(1, 30)], 30)


def test_empty_tables(spark, docs, empty):
    assert R.resampled(empty, docs).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(spark, rows, [], percent=50) == plain(rows, [], 50)
    kept = R.drawn_texts(docs, docs, 50)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


@pytest.mark.parametrize("piece", [7, 40, 1 << 20])
def test_states_cross_pieces(monkeypatch, piece):
    from tallyline.llm import byte_words

    monkeypatch.setattr(byte_words, "PIECE_BYTES", piece)
    body = " ".join([text(4, 60), "é" * 50, "a b c"])
    got = np.concatenate([x for _, x in R.buckets(body.encode())])
    assert sorted(got.tolist()) == sorted(map(crc, features(body)))
    assert sum(n for n, _ in R.buckets(body.encode())) == len(words(body))
