"""Operator 11 against a plain count of every term in every group."""

import re
from collections import Counter, defaultdict

import pytest

from tallyline.llm import divergence as D
from tallyline.llm.byte_words import LETTERS, word_pieces, word_table

from .conftest import text

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def plain(rows, least, most):
    """rows: (lang, source, text)."""
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, body in ((a or "", b or "", c or "") for a, b, c in rows):
        found = TERM.findall(lower(body))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        sources[lang].add(source)
    out = set()
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (n + 5 * len(kept)) for t in kept}

        q = shares(sum((counts[lang, s] for s in own), Counter()))
        p = {s: shares(counts[lang, s]) for s in own}
        for s in own:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(far, 1)}
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(more[:most], 1)}
    return out


def made(rows, spark):
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "lang string, source string, text string, term string, n long").repartition(3)
    return df


@pytest.mark.parametrize("least", [1, 3])
def test_same_as_plain(spark, least):
    rows = [("en", f"s{k % 4}", text(k, 40 + k)) for k in range(24)] + [("de", "s0", "Éa ÉA éa Z9z zz"), ("de", "s1", None), ("de", None, ""), (None, "s1", "zz zz"), ("fr", "only", "a b a"), ("en", "empty", " 1 2 ")]
    rows += rows[:5]
    found = [tuple(r) for r in D.audited(made(rows, spark), least=least, most=7).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain(rows, least, 7)


def test_ties_and_small_sources(spark):
    """Sources of very unlike sizes: shares of absent terms of the small one lie above shares of the large one's rare terms."""
    rows = [("en", "big", "a " * 500 + "b c d"), ("en", "small", "b"), ("en", "none", None), ("en", "like", "b"), ("en", "big", "e f g " * 3)]
    found = [tuple(r) for r in D.audited(made(rows, spark), least=1, most=50).collect()]
    assert set(found) == plain(rows, 1, 50)


def test_many_sources_in_one_scan(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 3)
    rows = [("en", f"s{k % 9}", text(k, 30)) for k in range(30)]
    found = D.audited(made(rows, spark).coalesce(1), least=2, most=5)
    assert {tuple(r) for r in found.collect()} == plain(rows, 2, 5)


def test_shared_rows_and_empty(spark, docs, empty):
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert {tuple(r) for r in D.audited(docs, least=2).collect()} == plain(rows, 2, 50)
    assert D.audited(empty).collect() == []


def test_pieces(monkeypatch):
    from tallyline.llm import byte_words

    body = " ".join([text(7, 500), "x" * 300, "É漢" * 80, text(8, 50)]).encode()
    whole = next(word_pieces(body, word_table(LETTERS)))
    monkeypatch.setattr(byte_words, "PIECE_BYTES", 100)
    pieces = list(word_pieces(body, word_table(LETTERS)))
    assert len(pieces) > 5 and sum(pieces, []) == whole
