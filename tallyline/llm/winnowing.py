"""Operator 13, document fingerprints by winnowing.

1. A text is normalised: white space goes, A-Z become a-z; every code point keeps its place in the whole text.
2. Every run of `K` code points has a rolling hash: the difference of two running sums of a polynomial modulo 2^64,
   mixed and cut to 32 bits.
3. Of every `WINDOW` neighbouring hashes the least is selected, the rightmost of equal ones. So any run of
   K + WINDOW - 1 code points that two texts share gives both a common selected hash, and nothing shorter than K does.
   The selected hashes stay with their places, in order.
4. Likeness of two fingerprints: Jaccard similarity of their sets of hashes.

`compared` also fingerprints an edited text of each document (its second half replaced by the beginning of the next
document, ids descending) and compares both, and the next document, with it. Rows are dealt into ranges of ids whose
limits are a row a range (`RANGES` at most); each range also gets the first row of the one after it, so a single pass
over sorted rows sees every neighbour and texts are shuffled once.

Texts shorter than K have one hash, of all they have; null, empty and blank texts have none. Two fingerprints without hashes
are alike (1), one without and one with aren't (0). Very long texts are hashed in pieces of PIECE code points with what
they need of the piece before. Null ids come last; ties of ids are ordered by a hash of the text, then by the text, so
repeated rows are each other's neighbours. One row is its own next; an empty table gives an empty result. Other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import unused
from .storage import released, written
from .tokenizing import balanced

K = 24
WINDOW = 32
#: Code points that are hashed at once.
PIECE = 1 << 18
#: Ranges of ids at most, and rows that one is made for.
RANGES = 50_000
RANGE_ROWS = 2_000
BASE = 0x9E3779B97F4A7C15 | 1
# The code points that count as white space.
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = _powers(BASE, PIECE + 2 * (K + WINDOW)), _powers(pow(BASE, -1, 1 << 64), PIECE + 2 * (K + WINDOW))


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points that count, and their places in text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    spaces = (points <= 32) & ((points == 32) | ((points >= 9) & (points <= 13)) | ((points >= 28) & (points <= 31)))
    if points.max(initial=0) >= 133:
        spaces |= np.isin(points, SPACES)
    at = np.flatnonzero(~spaces)
    points = points[at]
    return np.where((points >= 65) & (points <= 90), points + 32, points), at


def _mixed(h: np.ndarray) -> np.ndarray:
    """32 bits of each hash, after mixing, for the low bits of a polynomial are weak."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(32)


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k points (at most PIECE + K + WINDOW of them): differences of running sums, one step a run."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * DOWN[: len(points)], out=sums[1:])
    return _mixed((sums[k:] - sums[:n]) * UP[:n])


def _window_least(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from the least of the ends and beginnings of blocks of w."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    begins = np.minimum.accumulate(padded, axis=1).ravel()
    ends = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(ends[: n - w + 1], begins[w - 1 : n])


def winnowed(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places in text) of the selected runs, in order."""
    hashes, places = [], []
    kept_points, kept_at = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    last = -1
    for start in range(0, max(len(text), 1), PIECE):
        points, at = normalised(text[start : start + PIECE])
        points, at = np.concatenate([kept_points, points]), np.concatenate([kept_at, at + start])
        if start + PIECE < len(text) and len(points) < k + window - 1:
            kept_points, kept_at = points, at
            continue
        h = rolling(points, k)
        if not len(h) and len(points) and last < 0 and start + PIECE >= len(text):
            h = rolling(points, len(points))
        # The place counts down in the low bits, so the least key is the least hash and of equal ones the rightmost.
        keys = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
        if len(keys) and (len(keys) >= window or last < 0):
            least = _window_least(keys, min(window, len(keys)))
            first = np.ones(len(least), bool)
            first[1:] = least[1:] != least[:-1]
            least = least[first]
            found = at[(np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)]
            new = found > last
            hashes.append((least >> np.uint64(32))[new])
            places.append(found[new])
            last = int(found[-1])
        # The next piece's first window begins one run after this one's last.
        more = max(0, len(points) - (k + window - 2))
        kept_points, kept_at = points[more:], at[more:]
    return (np.concatenate(hashes).astype(np.uint32), np.concatenate(places)) if hashes else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones. Both sorted and distinct."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(hashes: np.ndarray) -> str:
    """Selected hashes in order, eight hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many code points of the beginning of following, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, hashes: array of long, places: array of long) of every row, without a shuffle."""
    names = [id_col, unused([id_col], "hashes"), unused([id_col], "places")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in balanced(whole, 1):
                found = [winnowed(x) for x in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), *(pa.array([x[k].astype(np.int64) for x in found], pa.list_(pa.int64())) for k in (0, 1))], names=names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {names[1]} array<long>, {names[2]} array<long>")


def _key(known: bool, ident: object, h: int) -> tuple:
    """Null ids are the lowest, so that they come last when ids descend."""
    return (True, ident, h) if known else (False, h)


def _ranges(keys: DataFrame) -> list[tuple[tuple, tuple]]:
    """Lowest and highest key of each range of rows in ascending order; keys is a written table (known, id, h)."""
    n = max(1, min(RANGES, keys.count() // RANGE_ROWS))
    parts = keys.repartitionByRange(n, "known", "id", "h").withColumn("part", F.spark_partition_id())
    own = F.struct("known", "id", "h")
    found = parts.groupBy("part").agg(F.min(own).alias("low"), F.max(own).alias("high")).collect()
    return sorted((_key(*r["low"]), _key(*r["high"])) for r in found)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, extra, known, id, h, text), sorted; each one that isn't extra with the row after it in its range."""
    own = None  # range, id, text, hashes, distinct hashes of the row that waits for the next
    for whole in batches:
        for batch in balanced(whole, 5):
            ids, rows = [], []
            for part, extra, ident, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 5)), strict=True):
                if extra and own is None:
                    continue
                hashes = winnowed(text)[0]
                distinct = np.unique(hashes)
                if own is not None and own[0] == part:
                    other = edited(own[2], text)
                    changed = winnowed(other)[0]
                    ids.append(own[1])
                    rows.append((len(own[2]), hashlib.sha256(other.encode()).hexdigest(), fingerprint(own[3]), fingerprint(changed), likeness(own[4], np.unique(changed)), likeness(own[4], distinct)))
                own = None if extra else (part, ident, text, hashes, distinct)
            if rows:
                values = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(ids, batch.column(3).type), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=["id", *RESULT])


RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row; ids descend to the next."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    keys = written(rows.select("known", "id", "h"), "keys")
    ranges = _ranges(keys)
    released(keys)
    sent, n = docs.sparkSession.sparkContext.broadcast(([low for low, _ in ranges], [high for _, high in ranges])), len(ranges)

    @F.pandas_udf("long")
    def place(known: pd.Series, ident: pd.Series, h: pd.Series) -> pd.Series:
        """Twice the number of a row's range, and one more for the highest of a range."""
        lows, highs = sent.value
        found = [_key(*x) for x in zip(known, ident, h, strict=True)]
        at = [max(0, bisect_right(lows, x) - 1) for x in found]
        return pd.Series([2 * i + (x == highs[i]) for i, x in zip(at, found, strict=True)], dtype="int64")

    # The highest row of a range is the next one of the lowest row of the range above; that of the highest range closes the circle.
    at = F.expr("p div 2")
    also = F.when(F.col("p") % 2 == 1, F.array(F.struct(((at + 1) % max(n, 1)).alias("range"), F.lit(True).alias("extra"))))
    places = F.concat(F.array(F.struct(at.alias("range"), F.lit(False).alias("extra"))), F.coalesce(also, F.array().cast("array<struct<range:bigint,extra:boolean>>")))
    placed = rows.withColumn("p", place("known", "id", "h")).select(F.inline(places), "known", "id", "h", "text")
    dealt = placed.repartition("range").sortWithinPartitions("range", "extra", *(F.desc(c) for c in ("known", "id", "h", "text")))
    kind = rows.schema["id"].dataType.simpleString()
    out = dealt.mapInArrow(_compare, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
