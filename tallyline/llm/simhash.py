"""Operator 10, SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most 3 bits are linked. Cut in two segments of 32 bits, two such
fingerprints have a segment in which they differ in one bit at most, so they agree in one of the 32 variants
of it that leave one bit out. Each distinct fingerprint is indexed under its 2 x 32 variants; equal variants
meet in an equality shuffle and are verified by Hamming distance.

Equal fingerprints are one node, so groups of exact copies cost nothing. Fingerprints that share a variant
are searched breadth first in the task that has them, which returns a spanning forest of their links rather
than all pairs: the rows grow with the group, not with its square, and no link between components is lost.
The forests are joined up by `components`.

`near_copies` is for copies by similarity, where the exact Jaccard similarity of word shingles decides (five words and
0.8). Bits of a SimHash don't find these: at 0.8 a segment of 32 bits differs in more than one. So its signatures are least
hashes of the shingles, one for each of `SEGMENTS` x `VALUES` hash functions; in a segment of `VALUES` of them one may differ,
and the variants that leave one value out meet in an equality join. A value is equal with a probability of the similarity,
whatever was changed: a pair at 0.8 meets with 0.995, at 0.9 with 0.9999. What meets under a crowded key is refined by
rare shingles (`components.refined`), which misses no pair of the similarity.

Null text counts as empty, and the empty text's fingerprint is zero, linked like any other. Null ids get a
component but never name one (a component of null ids alone is null). Repeated rows give a row each. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, grouped, met
from .rows import row_key, without
from .storage import released, written
from .tokenizing import balanced

SEED = 42
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15
BITS, SEGMENT = 64, 32
#: Segments of the signatures of near_copies, least hashes in each, and what decides there.
SEGMENTS, VALUES, WIDTH, LEAST = 4, 5, 5, 0.8
#: A hash function of hashes is a multiplication by one of these odd numbers.
ODD = np.array([xxhash.xxh64_intdigest(b"least %d" % k) | 1 for k in range(SEGMENTS * VALUES)], dtype=np.uint64)


def shingles(text: str, width: int) -> list[bytes]:
    """Word shingles of the text in which A-Z are lower case; a shorter text is one shingle, no words none."""
    words = text.encode().lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint(parts: list[bytes]) -> int:
    """Bit i is set if it is set in over half the hashes of parts."""
    one, votes = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(parts), COUNTED):
        hashes = np.array([one(x, SEED) for x in parts[at : at + COUNTED]], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(parts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, bits): the fingerprint of each row as a signed long."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("sh_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in balanced(whole, 1):
                texts = pc.fill_null(batch.column(1), "").to_pylist()
                bits = np.array([fingerprint(shingles(x, width)) for x in texts], dtype=np.uint64).view(np.int64)
                yield pa.record_batch([batch.column(0), pa.array(bits)], names=[id_col, "bits"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(sign, f"`{id_col}` {kind}, bits long")


def _wildcards(bits: Column, first: int) -> list[Column]:
    """For each bit of a long the segment number, the bit left out and its segment without it, in one long."""
    keys = []
    for segment in range(BITS // SEGMENT):
        part = F.shiftrightunsigned(bits, SEGMENT * segment).bitwiseAND((1 << SEGMENT) - 1)
        for k in range(SEGMENT):
            keys.append(part.bitwiseAND(((1 << SEGMENT) - 1) ^ (1 << k)) + F.lit((first + segment * SEGMENT + k) << SEGMENT))
    return keys


def variants(distinct: DataFrame) -> DataFrame:
    """(key, bits): each fingerprint under its variants."""
    return distinct.select(F.explode(F.array(*_wildcards(F.col("bits"), 0))).alias("key"), "bits")


def forest(group: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the fingerprints in group that are at most radius apart."""
    out, rest = [], group
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            node = front.pop()
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), node), found))
                front.extend(found)
                rest = rest[~near]
    return out


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all links."""
    if radius > 3:
        raise ValueError("two segments with one deletion cover a radius of 3")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by key; a key that runs on into the next batch is held back."""
        key, held = None, []
        names = ["a", "b"]

        def made(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate([x[k] for x in found]).view(np.int64)) for k in (0, 1)], names=names)

        for batch in batches:
            keys, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            found = []
            if keys[0] == key:
                held.append(bits[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if len(held) > 1 or held and len(held[0]) > 1:
                    found += forest(np.concatenate(held), radius)
                for k in np.flatnonzero(ends - starts > 1):
                    if k < len(starts) - 1:
                        found += forest(bits[starts[k] : ends[k]], radius)
                key, held = keys[starts[-1]], [bits[starts[-1] : ends[-1]]]
            if found:
                yield made(found)
        if held and (found := forest(np.concatenate(held), radius)):
            yield made(found)

    keyed = variants(distinct).repartition("key").sortWithinPartitions("key")
    return keyed.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, bits, component_id): the least id of the documents that links reach, itself included."""
    prints = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = written(prints.groupBy("bits").agg(F.min(id_col).alias("least")), "classes")
    found = components(links(classes.select("bits"), radius))
    of = classes.join(found, classes["bits"] == found["node"], "left").select("bits", "least", F.coalesce("component", "bits").alias("root"))
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(of.join(roots, "root").select("bits", "component_id"), "components")
    released(classes)
    return prints.join(named, "bits").select(id_col, "bits", "component_id")


def signature_keys(hashes: np.ndarray) -> list[int]:
    """A negative long for each segment of the least hashes and each value that is left out of it; none without hashes."""
    if not len(hashes):
        return []
    least = np.array([(hashes * m).min() for m in ODD], dtype="<u8").reshape(SEGMENTS, VALUES)
    parts = [(b"%d %d " % (k, j), np.delete(x, j)) for k, x in enumerate(least) for j in range(VALUES)]
    return [-1 - (xxhash.xxh64_intdigest(name + x.tobytes()) >> 1) for name, x in parts]


def _prepared(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id_col, key: of the row, a, b: hashes of the text's words, keys: of its signature, parts: its distinct shingles' hashes, sorted) for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("key"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in balanced(whole, 1):
                out = []
                for text in pc.fill_null(batch.column(1), "").to_pylist():
                    own = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, width)), "<u8"))
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(text.encode().lower().split())), "<i8")
                    out.append((int(a), int(b), signature_keys(own), own.tobytes()))
                cols = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["id", "key", "a", "b", "keys", "parts"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(prepare, f"id {kind}, key struct<k1:long,k2:long>, a long, b long, keys array<long>, parts binary")


#: Jaccard distances are whole numbers of this part, rounded up.
PART = 1_000_000


def _distances(pairs: DataFrame) -> DataFrame:
    """pairs(u, v, limit, s, t: sorted distinct hashes) as (u, v, d, least): the Jaccard distance in parts, null if it is over limit."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                every = len(x) + len(y) - both
                found.append(-(-PART * (every - both) // every) if every else 0)
            d, limit = np.array(found, dtype=np.int64), batch.column(2).to_numpy()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(d, mask=d > limit), pa.array(d)], names=["u", "v", "d", "least"])

    return pairs.select("u", "v", F.col("limit").cast("long").alias("limit"), "s", "t").mapInArrow(compare, "u long, v long, d long, least long")


def _exploded(parts: DataFrame) -> DataFrame:
    """(node, space, f): a row for each hash of parts."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(s, "<i8")
                yield pa.record_batch([pa.array(np.full(len(own), node)), pa.array(np.zeros(len(own), dtype=np.int32)), pa.array(own)], names=["node", "space", "f"])

    return parts.select("node", "parts").mapInArrow(explode, "node long, space int, f long")


def near_copies(docs: DataFrame, least: float = LEAST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, key: of the row, component_id) for each row: the least id of the documents that near copies reach.

    Texts of equal words are one node, texts without words one as well. Null ids never name a component unless all its
    ids are null. Repeated rows give a row each; an empty table gives an empty result.
    """
    rows = written(_prepared(docs, width, id_col, text_col), "prepared")
    nodes = rows.groupBy("a", "b").agg(F.min("id").alias("least"), F.first("keys").alias("keys"), F.first("parts").alias("parts"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    parts = nodes.select("node", "parts")

    def compared(pairs: DataFrame) -> DataFrame:
        return _distances(pairs.join(parts.toDF("u", "s"), "u").join(parts.toDF("v", "t"), "v"))

    def of_nodes(some: DataFrame) -> DataFrame:
        return _exploded(parts.join(some, "node", "left_semi"))

    keyed = met(nodes.select(F.explode("keys").alias("key"), "node"))
    limit = F.lit(round((1 - least) * PART)).cast("long")
    found = grouped(keyed, nodes.select("node", F.lit(0).cast("long").alias("size")), compared, lambda _: limit, of_nodes, least)
    of = nodes.join(found, "node", "left").select("a", "b", "least", F.coalesce("component", "node").alias("root"))
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("a", "b", "component_id")
    out = written(rows.select("id", "key", "a", "b").join(named, ["a", "b"]).select(F.col("id").alias(id_col), "key", "component_id"), "copies")
    released(rows, nodes, keyed)
    return out


def without_copies(docs: DataFrame, least: float = LEAST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less those that have a near copy of smaller id.

    Rows are told apart by id and text, so unlike texts of one id don't go together; repeated rows stay or go together.
    """
    found = near_copies(docs, least, width, id_col, text_col).select(F.col(id_col).alias("id"), "key", "component_id")
    # Of unlike texts of the least id the one with the smaller key stays.
    own = F.struct(F.col("id").isNull().alias("no"), "id", "key")
    first = found.groupBy("component_id").agg(F.min(own).alias("first")).select(F.col("component_id").alias("of"), "first.key")
    stays = first.select(F.col("of"), F.col("key").alias("first"))
    gone = found.join(stays, F.col("component_id").eqNullSafe(F.col("of"))).where("key <> first")
    return without(docs, gone, id_col, text_col)
