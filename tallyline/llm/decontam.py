"""Operator 9, benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Benchmark items are the query set. They are taken in blocks of at most `BLOCK_BYTES` of text; each block is an index
that is broadcast, and one pass without a shuffle over the documents answers it.

- A window has as many words as the item. Only windows that hold one of the item's shingles can be similar to it, so
  a window is made where a shingle of the document is one of the item's, at the place that lines the two up.
- A window's SimHash is looked up in blocks of bits: `RADIUS` + 1 blocks, one of which must be equal if two
  fingerprints differ in RADIUS bits at most, so the index returns every item within the radius.
- Of those, the exact weighted similarity decides: the weight of the item's shingles that the window holds, repeats
  included, over the weight of all of them; a shingle weighs its characters. At least `LEAST` is a match.

Shingles have five words (an item of fewer words is one shingle), lower case in A-Z, without marks at word ends. Null
and empty texts match nothing, nor do items without words. Equal items are searched once and reported each. Repeated
documents give rows each. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .rows import row_key, without
from .tokenizing import balanced

WIDTH, LEAST, RADIUS, BITS = 5, 0.8, 20, 64
BLOCK_BYTES = 8 << 20
REMEMBERED = 400_000
EDGES = b".,;:!?\"'()[]{}<>|"
#: Slots of the table that rules out most shingles at once.
SLOTS = 1 << 20
#: Odd multipliers of the word hashes in a shingle's hash.
ODD = np.array([int.from_bytes(xxhash.xxh64_digest(b"%d" % k), "little") | 1 for k in range(WIDTH)], dtype=np.uint64)


def normal_words(text: str) -> list[bytes]:
    return [w.strip(EDGES) or w for w in text.encode().lower().split()]


def weights(words: list[bytes]) -> Counter:
    """Weight of each shingle, repeats included."""
    out: Counter = Counter()
    k = min(WIDTH, len(words))
    for i in range(len(words) - k + 1 if k else 0):
        part = tuple(words[i : i + k])
        out[part] += sum(map(len, part))
    return out


def signature(parts: Counter) -> int:
    """SimHash of weighted shingles."""
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(x)) for x in parts], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    w = np.array(list(parts.values()), dtype=np.float64)
    return int.from_bytes(np.packbits(2 * (w @ bits) > w.sum(), bitorder="little").tobytes(), "little")


def similarity(item: Counter, window: Counter) -> float:
    return sum(min(w, window[x]) for x, w in item.items()) / sum(item.values())


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words, from their hashes."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out += words[k : k + n] * ODD[k]
    return out ^ (out >> np.uint64(29))


class Index:
    """Items by shingle, and by each block of their fingerprint's bits."""

    def __init__(self, items: list[list[bytes]]):
        self.sizes = [len(x) for x in items]
        self.parts = [weights(x) for x in items]
        self.prints = np.array([signature(x) for x in self.parts], dtype=np.uint64)
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, words in enumerate(items):
            width = min(WIDTH, len(words))
            hashes = np.array([word_hash(w) for w in words], dtype=np.uint64)
            for j, h in enumerate(shingle_hashes(hashes, width).tolist()):
                self.places[width][h].append((k, j))
        self.places = {w: dict(x) for w, x in self.places.items()}
        self.slots = {}
        for width, x in self.places.items():
            table = np.zeros(SLOTS, dtype=bool)
            table[np.fromiter(x, np.uint64, len(x)) & np.uint64(SLOTS - 1)] = True
            self.slots[width] = table
        edges = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        self.tables: list[dict[int, np.ndarray]] = []
        for shift, mask in self.blocks:
            values = (self.prints >> np.uint64(shift)) & np.uint64(mask)
            self.tables.append({int(v): np.flatnonzero(values == v) for v in np.unique(values)})

    def within(self, bits: int) -> dict[int, int]:
        """Items whose fingerprint differs from bits in RADIUS bits at most, with the number of bits."""
        near = [t[v] for (shift, mask), t in zip(self.blocks, self.tables, strict=True) if (v := (bits >> shift) & mask) in t]
        if not near:
            return {}
        found = np.unique(np.concatenate(near))
        apart = np.bitwise_count(self.prints[found] ^ np.uint64(bits))
        return {int(k): int(d) for k, d in zip(found, apart, strict=True) if d <= RADIUS}

    def search(self, text: str, known: dict[bytes, int]) -> dict[int, tuple[float, int, int]]:
        """Best window by item: similarity, minus the first word, bits apart."""
        raw = text.encode().lower().split()
        for w in set(raw).difference(known):
            known[w] = word_hash(w.strip(EDGES) or w)
        hashes = np.fromiter(map(known.__getitem__, raw), np.uint64, len(raw))
        starts: dict[tuple[int, int], set[int]] = defaultdict(set)
        for width, places in self.places.items():
            own = shingle_hashes(hashes, width)
            for p in np.flatnonzero(self.slots[width][own & np.uint64(SLOTS - 1)]).tolist():
                for item, j in places.get(int(own[p]), ()):
                    size = self.sizes[item]
                    starts[max(0, min(p - j, len(raw) - size)), size].add(item)
        best: dict[int, tuple[float, int, int]] = {}
        for (start, size), items in starts.items():
            words = [w.strip(EDGES) or w for w in raw[start : start + size]]
            window = weights(words)
            near = self.within(signature(window))
            for item in items & near.keys():
                s = similarity(self.parts[item], window)
                if s >= LEAST:
                    best[item] = max(best.get(item, (0.0, 0, 0)), (s, -start, near[item]))
        return best


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[dict[tuple[bytes, ...], list]]:
    """Item ids by words, in blocks of bounded size."""
    block: dict[tuple[bytes, ...], list] = {}
    size = 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull()).toLocalIterator():
        if words := tuple(normal_words(row["t"])):
            block.setdefault(words, []).append(row["i"])
            size += len(row["t"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = {}, 0
    yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, start: first word of the best window, n_words, similarity, bits_apart) for each pair that matches."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("dc_text"))
    kinds = (rows.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, start long, n_words long, similarity double, bits_apart int"
    context, item_type = docs.sparkSession.sparkContext, to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for block in blocks_of(benchmark, item_col, item_text):
        sent = context.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = list(sent.value.items())
            index, known = Index([list(x) for x, _ in items]), {}
            for whole in batches:
                for batch in balanced(whole, 1):
                    if len(known) > REMEMBERED:
                        known.clear()
                    found = []
                    for i, text in zip(range(batch.num_rows), pc.fill_null(batch.column(1), "").to_pylist(), strict=True):
                        for k, (s, start, apart) in index.search(text, known).items():
                            found += [(i, item, -start, index.sizes[k], s, apart) for item in items[k][1]]
                    if found:
                        at, item, *rest = zip(*found, strict=True)
                        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
                        yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(item, item_type), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], names=[id_col, item_col, "start", "n_words", "similarity", "bits_apart"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item. Rows are told apart by id and text."""
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return without(docs, leaks(rows, benchmark, "key", "text", item_col, item_text), id_col, text_col)
