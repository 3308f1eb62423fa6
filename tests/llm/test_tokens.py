"""Operators 1 and 2 against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyline.llm import packing, token_counts, tokenizing

from .conftest import rows


@pytest.fixture(scope="module")
def library(vocabulary):
    return tokenizing.tokenizer(vocabulary)


def test_pieces_equal_whole_texts(library, vocabulary):
    """Any mix of letters, marks, white space and special strings, in batches."""
    encoder = tokenizing.PieceEncoder(vocabulary, tokenizing.ids_bytes, b"".join)
    r = random.Random(5)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'", "ll", "1", "²", "¼", "<|endoftext|>", "<|", "ª", "\xa0", "\x85", "\x1c", "漢", "ß", ".", "$$", "😀", "Ω", "٣", "\x00", "ǆ", "ʰ", "Ġ"]
    for _ in range(300):
        texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(10)]
        for text, found in zip(texts, encoder.values(texts), strict=True):
            assert b"".join(found) == tokenizing.ids_bytes(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_counts(docs, library, vocabulary):
    found = token_counts.token_lengths(docs, vocabulary).collect()
    wanted = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows()]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_counts_of_nothing(empty, vocabulary):
    assert token_counts.token_lengths(empty, vocabulary).collect() == []


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_holds_every_id_once(docs, library, vocabulary, capacity):
    found = packing.packed(docs, vocabulary, capacity=capacity).collect()
    ids = defaultdict(list)
    for i, t, *_ in rows():
        ids[i].append(library.encode(t or "", add_special_tokens=False).ids + [0])
    pieces = defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == ids.keys()
    for i, own in ids.items():
        for whole in own:
            same = [r for r in pieces[i] if r["doc_tokens"] == len(whole)]
            cover = np.zeros(len(whole), dtype=int)
            for r in same:
                cover[r["start"] : r["start"] + r["length"]] += 1
                assert zlib.crc32(np.array(whole[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            assert (cover == sum(len(x) == len(whole) for x in own)).all()
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_nothing(empty, vocabulary):
    assert packing.packed(empty, vocabulary).collect() == []


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_plans_are_whole_and_tight(n):
    r = random.Random(n)
    tails = defaultdict(int)
    for _ in range(n):
        tails[r.randint(1, 1023)] += 1
    total = sum(k * v for k, v in tails.items())
    level, plan = packing.plan_tails(dict(tails), total, 1024, 0.002)
    placed = defaultdict(int)
    for pattern, times in plan:
        assert sum(x * c for x, c in pattern.items()) <= 1024
        for x, c in pattern.items():
            placed[x] += c * times
    wanted = defaultdict(int)
    for tail, c in tails.items():
        for x in packing.tail_cuts(tail, level, 1024):
            wanted[x] += c
    assert placed == wanted
    assert packing.padding(plan, 1024) <= 0.002 * total + 1024


def test_linear_program_reaches_its_bound():
    """Lengths of which two fit but waste a fifth: mixing them is found by pricing."""
    need = {600: 100, 420: 100, 300: 100, 120: 200}
    plan = packing.relaxed(need, 1024)
    used = {x: sum(p.get(x, 0) * t for p, t in plan) for x in need}
    assert all(abs(used[x] - need[x]) < 1e-6 for x in need)
    assert sum(t for _, t in plan) <= 1.02 * max(100, sum(k * v for k, v in need.items()) / 1024)


def padded(need, monkeypatch, rounds):
    monkeypatch.setattr(packing, "ROUNDS", rounds)
    found = packing.relaxed(need, 1024)
    for x, n in need.items():
        assert abs(sum(p.get(x, 0) * t for p, t in found) - n) < 1e-6 * n
    return sum(t for _, t in found) * 1024 / sum(x * n for x, n in need.items())


def test_generated_columns_lower_the_value(monkeypatch):
    """Lengths as skewed as those of documents: columns must bring the start, most of whose patterns tie, close to the bound."""
    r = random.Random(11)
    need = defaultdict(int)
    for _ in range(260):
        need[min(1023, int(r.lognormvariate(5.9, 0.7)) + 1)] += 400
    start, end = padded(need, monkeypatch, 0), padded(need, monkeypatch, 50_000)
    assert end < start - 0.005
    assert end < 1 + (start - 1) / 2


def test_equal_rows_are_whole(spark, vocabulary):
    """Rows that can't be told apart, nulls among them, are spread over the buckets and packed each for itself."""
    docs = spark.createDataFrame([(None, None)] * 500 + [(7, "same words " * 900)] * 40, "doc_id long, text string").repartition(4)
    found = packing.packed(docs, vocabulary, capacity=64).collect()
    assert sum(r["doc_id"] is None for r in found) == 500
    size = {r["doc_tokens"] for r in found if r["doc_id"] == 7}
    assert len(size) == 1
    assert sum(r["length"] for r in found if r["doc_id"] == 7) == 40 * size.pop()
    taken = defaultdict(list)
    for r in found:
        taken[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_memory_is_emptied(library, vocabulary, monkeypatch):
    """A full memory, by pieces or by characters, changes no result, and one encoder serves later calls."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdefgh", k=r.randint(1, 12))) for _ in range(200)) for _ in range(30)]
    wanted = [library.encode(x, add_special_tokens=False).ids for x in texts]
    for name in ("REMEMBERED", "REMEMBERED_CHARS"):
        monkeypatch.setattr(tokenizing, name, 1000)
        encoder = tokenizing.remembering(vocabulary, tokenizing.ids_bytes, b"".join)
        assert encoder is tokenizing.remembering(vocabulary, tokenizing.ids_bytes, b"".join)
        for _ in range(2):
            for at in range(0, len(texts), 3):
                found = encoder.values(texts[at : at + 3])
                assert [b"".join(x) for x in found] == [tokenizing.ids_bytes(x) for x in wanted[at : at + 3]]
        assert encoder.chars <= 1000 + sum(len(x) for x in texts[-3:]) * 4 if name.endswith("CHARS") else len(encoder.inner) <= 1000 + 700
        monkeypatch.undo()


def test_runs_are_those_of_each_part(vocabulary):
    """Words, and the same words with signs: each is encoded once, and every kind of value is that of the part's ids."""
    import numpy as np

    library = tokenizing.tokenizer(vocabulary)
    parts = [" word", " untokenizable", " a", " Zz", ' "quoted']
    wanted = [x.ids for x in library.encode_batch(parts, add_special_tokens=False)]
    ids = np.array([i for x in wanted for i in x], dtype="<u4")
    starts = np.cumsum([0, *map(len, wanted[:-1])])
    for kept in (len, tokenizing.ids_bytes, tuple):
        assert list(tokenizing.runs(kept, ids, starts)) == [kept(x) for x in wanted]
    encoder = tokenizing.PieceEncoder(vocabulary, tuple, lambda x: sum(x, ()))
    text = "one two, two three. three's (four four) über 漢 a<|endoftext|> b1 1b"
    for _ in range(2):
        assert [sum(x, ()) for x in encoder.values([text, text + " five"])] == [tuple(library.encode(x, add_special_tokens=False).ids) for x in (text, text + " five")]
    assert encoder.parts[" two"] is encoder.inner["two"]
