"""Operator 13 against hashes, windows and neighbours taken one by one."""

import hashlib

import numpy as np
import pytest

from tallyline.llm import winnowing as N

from .conftest import text

MASK = (1 << 64) - 1


def one_hash(points):
    inverse, h = pow(N.BASE, -1, 1 << 64), 0
    for j, c in enumerate(points):
        h = (h + (c + 1) * pow(inverse, j, 1 << 64)) & MASK
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 32)) * 0x94D049BB133111EB) & MASK
    return h >> 32


def plain(body, k=N.K, w=N.WINDOW):
    at = [i for i, c in enumerate(body) if not c.isspace()]
    points = [ord(body[i].lower() if "A" <= body[i] <= "Z" else body[i]) for i in at]
    k = min(k, len(points))
    hashes = [one_hash(points[i : i + k]) for i in range(len(points) - k + 1)] if points else []
    out = []
    for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
        some = hashes[i : i + w]
        j = i + max(j for j, h in enumerate(some) if h == min(some))
        if not out or out[-1][1] != at[j]:
            out.append((hashes[j], at[j]))
    return out


BODIES = ["", " \n\t ", "a", "short Text", text(1, 12), text(2, 90), "abc " * 200, "Éa漢 字 " * 40 + text(3, 30), "z" * 300, "A" * (N.K + N.WINDOW - 1), "B" * N.K]


@pytest.mark.parametrize("body", BODIES)
def test_same_as_plain(body):
    hashes, places = N.winnowed(body)
    assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == plain(body)


@pytest.mark.parametrize("piece", [60, 61, 200])
def test_pieces(monkeypatch, piece):
    monkeypatch.setattr(N, "PIECE", piece)
    for body in (*BODIES, text(4, 400), " " * 500 + text(5, 100) + "\n" * 500 + text(6, 50)):
        hashes, places = N.winnowed(body)
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == plain(body)


def test_every_long_common_run_is_found():
    """A run of K + WINDOW - 1 code points that count gives a hash in common, at its place."""
    r = np.random.default_rng(1)
    for seed in range(30):
        common = "".join(map(chr, r.integers(97, 123, N.K + N.WINDOW - 1)))
        one, two = text(seed, 50) + common + text(seed + 100, 20), text(seed + 200, 9) + common
        (h1, p1), (h2, p2) = N.winnowed(one), N.winnowed(two)
        a, b = one.index(common), two.index(common)
        assert {(int(h), int(p) - a) for h, p in zip(h1, p1, strict=True)} & {(int(h), int(p) - b) for h, p in zip(h2, p2, strict=True)}


def expected(rows):
    """rows: (id, text) in their order."""
    out = []
    for k, (ident, body) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        body = body or ""
        half = len(body) // 2
        other = body[: len(body) - half] + following[:half]
        print_of = lambda x: "".join(f"{h:08x}" for h, _ in plain(x))
        sets = [{h for h, _ in plain(x)} for x in (body, other, following)]
        like = lambda a, b: len(a & b) / len(a | b) if a and b else float(not a and not b)
        out.append((ident, len(body), hashlib.sha256(other.encode()).hexdigest(), print_of(body), print_of(other), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return sorted(map(repr, out))


@pytest.mark.parametrize("range_rows", [1, 3, 2000])
def test_neighbours(spark, monkeypatch, range_rows):
    monkeypatch.setattr(N, "RANGE_ROWS", range_rows)
    rows = [(k * 3 - 20, BODIES[k % len(BODIES)] + text(k, k)) for k in range(40)] + [(500, text(8, 700)), (501, None), (None, "no id at all")]
    df = spark.createDataFrame([(a, b, 1, "x", True) for a, b in rows], "doc_id long, text string, range int, h string, known boolean").repartition(4)
    found = N.compared(df)
    assert sorted(map(repr, map(tuple, found.collect()))) == expected(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))))


def test_repeated_rows_one_row_and_empty(spark, monkeypatch, docs, empty):
    monkeypatch.setattr(N, "RANGE_ROWS", 1)
    same = spark.createDataFrame([(1, text(1, 60))] * 5 + [(None, None)] * 3, "doc_id long, text string").repartition(3)
    found = N.compared(same).collect()
    assert len(found) == 8 and sorted(r["near_next"] for r in found) == [0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    one = N.compared(same.limit(1)).first()
    assert one["near_next"] == 1.0
    assert N.compared(empty).count() == 0 and N.fingerprints(empty).count() == 0
    assert N.compared(docs).count() == docs.count() == N.fingerprints(docs).count()


def test_texts_as_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "one two three"), ("é", "q"), (None, "n")], "name string, body string")
    found = {r["name"]: r["edited_sha256"] for r in N.compared(df, "name", "body").collect()}
    assert found["a"] == hashlib.sha256(b"one twon").hexdigest() and found["é"] == hashlib.sha256(b"q").hexdigest() and found["b"] == hashlib.sha256(b"x o").hexdigest()
