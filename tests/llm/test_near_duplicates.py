"""Operators 7, 9 and 10 against plain comparisons of everything with everything."""

import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import decontam, line_dedup, simhash
from tallyline.llm.components import components

from .conftest import SCHEMA, rows, text


def group(n, linked):
    """Least member of each one's group, for nodes 0 to n - 1."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(x) for x in range(n)]


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(parts))


def test_simhash(docs):
    own = [(i, plain_fingerprint(t)) for i, t, *_ in rows()]
    roots = group(len(own), lambda a, b: (own[a][1] ^ own[b][1]).bit_count() <= 3)
    least = defaultdict(list)
    for k, r in enumerate(roots):
        if own[k][0] is not None:
            least[r].append(own[k][0])
    wanted = [(i, bits - (1 << 64) if bits >> 63 else bits, min(least[r], default=None)) for (i, bits), r in zip(own, roots, strict=True)]
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_spark_has_the_same_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_random_fingerprints(spark):
    """Balls of fingerprints around centres, with chains between them."""
    r = np.random.default_rng(3)
    centres = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    some = []
    for c in centres:
        for _ in range(25):
            flips = r.choice(64, r.integers(0, 6), replace=False)
            some.append(int(c) ^ sum(1 << int(b) for b in flips))
    some = sorted(set(some))
    roots = group(len(some), lambda a, b: (some[a] ^ some[b]).bit_count() <= 3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in some], "bits long").repartition(5)
    found = {r["node"]: r["component"] for r in components(simhash.links(df)).collect()}
    blocks = defaultdict(set)
    for x, k in zip(some, roots, strict=True):
        blocks[k].add(signed(x))
    for members in blocks.values():
        assert {found.get(x, x) for x in members} == {min(members)}


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in components(edges).collect()} == {(k, 0) for k in range(201)}
    assert components(edges.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark):
    """Equal lines, lines that differ in a word or a letter, and long lines, by edit similarity alone."""
    line, long = text(7, 60), text(8, 400)
    made = [line, line.upper() + "  ", line.replace(line.split()[3], "xyzzy", 1), line + "s", long, long + " end", text(9, 30), "a a b", "a b", "", "  ", "--|--", text(11, 128), "b, a."]
    docs = spark.createDataFrame([(k, "\n".join(made[(k + j) % len(made)] for j in range(3))) for k in range(20)] + [(98, None), (99, "")], "doc_id long, text string")
    normal = lambda x: re.sub(r"[^a-z0-9é]+", " ", x.lower()).strip()
    where = defaultdict(list)
    for r in docs.collect():
        for p, x in enumerate((r["text"] or "").split("\n")):
            if normal(x):
                where[normal(x)].append((r["doc_id"], p))
    lines = list(where)
    alike = lambda a, b: distance(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b]))
    roots = group(len(lines), alike)
    first = {r: min(o for k, x in enumerate(lines) if roots[k] == r for o in where[x]) for r in set(roots)}
    gone = {o for k, x in enumerate(lines) for o in where[x] if o != first[roots[k]]}
    wanted = {r["doc_id"]: None if r["text"] is None else "\n".join(x for p, x in enumerate(r["text"].split("\n")) if (r["doc_id"], p) not in gone) for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()} == wanted
    assert len(set(roots)) < len(lines)


def test_lines_keep_rows_and_columns(docs, empty):
    out = line_dedup.deduplicated(docs, count_col="n_removed")
    assert out.columns == [*docs.columns, "n_removed"]
    assert out.count() == len(rows())
    assert line_dedup.deduplicated(empty).count() == 0


def test_lines_keep_clashing_columns(spark):
    line = text(50, 20)
    docs = spark.createDataFrame([(1, line, 7, 8, 9), (2, line + "\n" + text(51, 20), 1, 2, 3)], "doc_id long, text string, ld_key long, LD_DOC long, ld_gone long")
    found = {tuple(r) for r in line_dedup.deduplicated(docs).collect()}
    assert found == {(1, line, 7, 8, 9), (2, text(51, 20), 1, 2, 3)}


def test_passages_in_unlike_lines_stay(spark):
    """A passage of 60 words at different places of lines that are otherwise unlike."""
    passage = text(60, 60)
    lines = [text(600 + k, 3 + 11 * k) + " " + passage + " " + text(700 + k, 80 - 9 * k) for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.deduplicated(docs, count_col="gone").where("gone > 0").count() == 0


def jaccard(x, y):
    parts = lambda t: set(simhash.shingles(t, 5))
    a, b = parts(x), parts(y)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies(docs, spark, empty):
    """Against the Jaccard similarity of all pairs; copies with one to nine of 300 words changed, on both sides of 0.8."""
    import random

    r, made = random.Random(4), [(k, t) for k, t, *_ in rows()]
    for k in range(12):
        words = text(900 + k, 300).split()
        made.append((100 + 2 * k, " ".join(words)))
        for p in r.sample(range(300), 1 + 3 * (k % 4)):
            words[p] = "other"
        made.append((101 + 2 * k, " ".join(words)))
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    roots = group(len(made), lambda a, b: jaccard(made[a][1] or "", made[b][1] or "") >= 0.8)
    least = defaultdict(list)
    for k, root in enumerate(roots):
        if made[k][0] is not None:
            least[root].append(made[k][0])
    wanted = sorted(((made[k][0], min(least[root], default=None)) for k, root in enumerate(roots)), key=repr)
    found = sorted(((x["doc_id"], x["component_id"]) for x in simhash.near_copies(frame).collect()), key=repr)
    assert len(found) == len(wanted)
    links = [(f, w) for f, w in zip(found, wanted, strict=True) if f != w]
    assert len(links) <= 2 and all(f[1] == f[0] for f, _ in links)  # none too many; candidates are found by probability
    assert simhash.near_copies(empty).count() == 0


def test_benchmark_passages(spark, docs, empty):
    """Whole, changed and cut passages, short items, equal items, null and empty ones."""
    item = text(21, 40)
    words = item.split()
    changed = " ".join(words[:20] + ["other"] + words[21:])
    half = " ".join(words[:12])
    items = [(1, item), (2, item), (3, "tiny item here"), (4, None), (5, ""), (6, text(22, 200))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    made = [(0, text(23, 50) + " " + item + ". " + text(24, 50)), (1, changed), (2, half), (3, "a Tiny, item here too"), (4, None), (5, item), (6, text(25, 500)), (7, (item + " ") * 3), (8, text(22, 200).upper())]
    found = decontam.leaks(spark.createDataFrame(made, "doc_id long, text string"), bench).collect()
    plain = lambda t: [w.strip(decontam.EDGES) or w for w in t.encode().lower().split()]
    wanted = set()
    for d, t in made:
        for i, b in items:
            own, held = plain(t or ""), plain(b or "")
            if not held:
                continue
            parts = decontam.weights(held)
            windows = [own[k : k + len(held)] for k in range(max(1, len(own) - len(held) + 1))]
            if max(decontam.similarity(parts, decontam.weights(w)) for w in windows) >= decontam.LEAST:
                wanted.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted >= {(0, 1), (0, 2), (1, 1), (3, 3), (5, 1), (7, 2), (8, 6)}
    assert decontam.leaks(empty, bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0


def test_index_returns_all_within_the_radius():
    index = decontam.Index([text(k, 30).encode().split() for k in range(30)])
    r = np.random.default_rng(1)
    for k, print_ in enumerate(index.prints.tolist()):
        for n in (0, 7, decontam.RADIUS):
            bits = print_ ^ sum(1 << int(b) for b in r.choice(64, n, replace=False))
            wanted = {j: (x ^ bits).bit_count() for j, x in enumerate(index.prints.tolist()) if (x ^ bits).bit_count() <= decontam.RADIUS}
            assert index.within(bits) == wanted and k in wanted


def test_schema_is_used():
    assert SCHEMA.count(",") == len(rows()[0]) - 1
