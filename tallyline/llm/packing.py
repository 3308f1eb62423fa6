"""Operator 2, packing: cutting-stock column generation over the histogram of piece lengths.

1. Documents are encoded (see `tokenizing`). Runs of `capacity` ids fill a sequence each; what is left, the
   tail, is packed with other tails. The workers return lengths and checksums only.
2. The histogram of tail lengths, at most capacity - 1 numbers, goes to the driver. A linear program over
   patterns (how many pieces of each length share a sequence) is solved by column generation: the dual
   prices of the lengths are the values of an unbounded knapsack, whose dynamic program finds the pattern
   that gains most. It starts from patterns that exhaust one length each and ends when no pattern gains, or when its
   value is a lower bound (the tokens, or what the prices prove) rounded up, or within `GAP` of one.
3. Patterns are used as often as the rounded-down solution says; what remains, some sequences for each length
   at most, is placed by best fit or pattern by pattern, whichever pads less.
4. If padding stays above `target`, tails are first cut at the largest power of two they hold, then at the
   next one, and so on; at the last level every piece is a power of two. The checksums of the pieces of every
   level are taken while the ids are at hand, so no text is encoded twice.
5. Pieces are ranked within their length by buckets of row numbers (a length, or a text, that a third of all documents
   share is ranked in many tasks) and looked up in the table of patterns, which is bounded by the capacity and is
   broadcast.

Null text counts as empty: its document is the end id alone. Repeated rows are packed each for itself, null
ids are carried, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import unused
from .storage import written
from .tokenizing import balanced, ids_bytes, remembering

#: Column generation ends at this share between the program's value and its lower bound.
GAP = 0.0005
#: Guard against a program that rounding errors keep from ending; 584 lengths took 9,000 columns to the optimum, 25 seconds.
ROUNDS = 50_000
#: Columns after which the inverse of the basis is computed anew.
REFRESHED = 100
#: Rows of a length that one ranking task should get.
RANKED_ROWS = 200_000


def tail_cuts(tail: int, level: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a tail at a level: powers of two from capacity / 2 down to capacity / 2**level, then the rest."""
    out = []
    for k in range(1, level + 1):
        if tail >= (p := capacity >> k) and p:
            out.append(p)
            tail -= p
    return out + [tail] * (tail > 0)


def encoded(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(id_col, doc_tokens, full: checksums of the full runs, bits and rests: of the tail's pieces and of what follows the first k of them)."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("pk_text"))
    end, step = ids_bytes([end_id]), 4 * capacity

    def sums(data: bytes) -> tuple[int, list[int], list[int], list[int]]:
        n = len(data) // 4
        whole = n // capacity
        full = [zlib.crc32(data[i * step : (i + 1) * step]) for i in range(whole)]
        bits, rests, rest = [], [], data[whole * step :]
        for p in tail_cuts(n % capacity, capacity.bit_length(), capacity):
            rests.append(zlib.crc32(rest))
            bits.append(zlib.crc32(rest[: 4 * p]))
            rest = rest[4 * p :]
        return n, full, bits, rests

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembering(vocabulary, ids_bytes, b"".join)
        for outer in batches:
            for batch in balanced(outer, 1):
                texts = pc.fill_null(batch.column(1), "").to_pylist()
                found = [sums(b"".join(x) + end) for x in encoder.values(texts)]
                cols = [batch.column(0), pa.array([x[0] for x in found], pa.int64())]
                cols += [pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in (1, 2, 3)]
                yield pa.record_batch(cols, names=[id_col, "doc_tokens", "full", "bits", "rests"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(encode, f"`{id_col}` {kind}, doc_tokens long, full array<long>, bits array<long>, rests array<long>")


class Knapsack:
    """Best pattern for dual prices: unbounded knapsack over the lengths, by dynamic programming."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity

    def best(self, prices: np.ndarray) -> tuple[float, dict[int, int]]:
        at = np.full(self.capacity + 1, -np.inf)
        at[self.lengths] = prices
        value, last = np.zeros(self.capacity + 1), np.zeros(self.capacity + 1, dtype=np.int64)
        for c in range(1, self.capacity + 1):
            gains = value[c - 1 :: -1][:c] + at[1 : c + 1]
            k = int(gains.argmax())
            if gains[k] > value[c - 1]:
                value[c], last[c] = gains[k], k + 1
            else:
                value[c] = value[c - 1]
        pattern: dict[int, int] = {}
        c = self.capacity
        while c > 0:
            if last[c]:
                pattern[int(last[c])] = pattern.get(int(last[c]), 0) + 1
                c -= int(last[c])
            else:
                c -= 1
        return float(value[self.capacity]), pattern


def filled(need: dict[int, float], first: int, capacity: int) -> dict[int, int]:
    """A pattern with a piece of length first: what is left is met by one length or two if it can be, else by the longest that fits."""
    pattern, room = {first: 1}, capacity - first

    def free(x: int) -> bool:
        return need.get(x, 0) - pattern.get(x, 0) >= 1

    def take(x: int) -> int:
        pattern[x] = pattern.get(x, 0) + 1
        return x

    while room > 0:
        if free(room):
            room -= take(room)
            continue
        pair = next((x for x in range(room - 1, room // 2, -1) if free(x) and free(room - x)), None)
        x = pair or next((x for x in range(room, 0, -1) if free(x)), None)
        if x is None:
            break
        room -= take(x)
    return pattern


def started(need: dict[int, int], capacity: int) -> list[tuple[dict[int, int], float]]:
    """A pattern for each length, each used until it exhausts that length: a triangular basis close to the best solution."""
    left: dict[int, float] = {x: float(n) for x, n in need.items()}
    out = []
    while left:
        whole = {x: max(1.0, n) for x, n in left.items()}
        pattern = filled(whole, max(left), capacity)
        gone = min(pattern, key=lambda x: left[x] / pattern[x])
        times = left[gone] / pattern[gone]
        for x, n in pattern.items():
            left[x] = max(0.0, left[x] - n * times)
        del left[gone]
        out.append((pattern, times))
    return out


def relaxed(need: dict[int, int], capacity: int) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used, possibly in part: the linear program by revised simplex and column generation.

    Many solutions have patterns that are used zero times, and a pivot on one of those changes nothing. So ties of the ratio
    test are broken by a second right-hand side, an infinitely small random surplus of the starting patterns, which
    every pivot lowers: the program moves on and ends at its optimum, and the first right-hand side stays exact.
    """
    lengths = np.array(sorted(need))
    place, m = {int(x): i for i, x in enumerate(lengths)}, len(lengths)
    demand = np.array([need[int(x)] for x in lengths], dtype=float)

    def columns(patterns: list[dict[int, int]]) -> np.ndarray:
        out = np.zeros((m, len(patterns)))
        for k, p in enumerate(patterns):
            out[[place[x] for x in p], k] = list(p.values())
        return out

    patterns = [p for p, _ in started(need, capacity)]
    basis = columns(patterns)
    surplus = basis @ np.random.default_rng(m).uniform(0.5, 1, m)
    sack, bound = Knapsack(lengths, capacity), float(lengths @ demand) / capacity

    def solved() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inverse = np.linalg.inv(columns(patterns))
        return inverse, np.maximum(inverse @ demand, 0), inverse @ surplus

    inverse, use, second = solved()
    for k in range(1, ROUNDS + 1):
        if k % REFRESHED == 0:  # Rounding errors of the updates don't add up.
            inverse, use, second = solved()
        prices = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = sack.best(prices)
        bound = max(bound, float(prices @ demand) / max(value, 1.0))
        if value <= 1 + 1e-6 or use.sum() <= max(np.ceil(bound - 1e-6), (1 + GAP) * bound):
            break
        enter = inverse @ columns([pattern])[:, 0]
        safe = np.where(enter > 1e-7, enter, np.inf)
        ratio = np.where(enter > 1e-7, use / safe, np.inf)
        if not np.isfinite(ratio.min()):
            break
        tied = ratio <= ratio.min() + 1e-9 * max(1.0, ratio.min())
        r = int(np.where(tied, second / safe, np.inf).argmin())
        row, theta, theta2 = inverse[r] / enter[r], use[r] / enter[r], second[r] / enter[r]
        inverse -= np.outer(enter, row)
        inverse[r] = row
        use, second = np.maximum(use - theta * enter, 0), second - theta2 * enter
        use[r], second[r] = theta, theta2
        patterns[r] = pattern
    return list(zip(patterns, use.tolist(), strict=True))


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences for what rounding left over: longest first, each into the fullest sequence that still has room."""
    rooms: dict[int, list[dict[int, int]]] = {}
    for x in sorted(left, reverse=True):
        for _ in range(left[x]):
            room = min((r for r in rooms if r >= x and rooms[r]), default=None)
            if room is None:
                room, bag = capacity, {}
            else:
                bag = rooms[room].pop()
            bag[x] = bag.get(x, 0) + 1
            rooms.setdefault(room - x, []).append(bag)
    return [(bag, 1) for room in sorted(rooms) for bag in rooms[room]]


def by_patterns(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences for what rounding left over: longest first, each sequence filled up at once."""
    left, out = dict(left), []
    while left:
        pattern = filled(left, max(left), capacity)
        times = min(left[x] // n for x, n in pattern.items())
        out.append((pattern, times))
        left = {x: n - times * pattern.get(x, 0) for x, n in left.items() if n > times * pattern.get(x, 0)}
    return out


def planned(need: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of patterns that hold every piece once."""
    out, left = [], dict(need)
    for pattern, use in relaxed(need, capacity) if need else []:
        times = min([int(use + 1e-6), *(left[x] // n for x, n in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for x, n in pattern.items():
                left[x] -= n * times
    left = {x: n for x, n in left.items() if n}
    return out + min(by_patterns(left, capacity), best_fit(left, capacity), key=lambda x: padding(x, capacity))


def padding(plan: list[tuple[dict[int, int], int]], capacity: int) -> int:
    """Padded places: up to capacity, none in a sequence whose length is a power of two."""
    sizes = [(sum(x * n for x, n in p.items()), t) for p, t in plan]
    return sum(0 if s & (s - 1) == 0 else (capacity - s) * t for s, t in sizes)


def plan_tails(tails: dict[int, int], total: int, capacity: int, target: float) -> tuple[int, list[tuple[dict[int, int], int]]]:
    """The first level of cuts, and its plan, whose padding is at most target of all tokens and one sequence more."""
    for level in range(capacity.bit_length()):
        need: dict[int, int] = {}
        for tail, n in tails.items():
            for x in tail_cuts(tail, level, capacity):
                need[x] = need.get(x, 0) + n
        plan = planned(need, capacity)
        if padding(plan, capacity) <= target * total + capacity:
            break
    return level, plan


def packed(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, target: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of docs: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    rows = encoded(docs, vocabulary, end_id, capacity, id_col, text_col)
    row = unused(rows.columns, "row")
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "encoded")
    # At most `capacity` rows, whatever the input.
    counts = rows.groupBy((F.col("doc_tokens") % capacity).alias("tail")).agg(F.count("*").alias("n"), F.sum("doc_tokens").alias("tokens")).collect()
    total, n_rows = sum(x["tokens"] for x in counts), sum(x["n"] for x in counts)
    level, plan = plan_tails({x["tail"]: x["n"] for x in counts if x["tail"]}, total, capacity, target)

    runs, seen, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for x, n in sorted(pattern.items(), reverse=True):
            first = seen.get(x, 0)
            runs.append((x, first, first + n * times, n, sequence, offset))
            seen[x] = first + n * times
            offset += n * x
        sequence += times
    table = spark.createDataFrame(runs, "run_length long, first long, stop long, each long, sequence long, base long")

    # The tail's pieces: powers of two that this level cuts off, then the rest.
    tail, whole = F.col("doc_tokens") % capacity, F.col("doc_tokens") - F.col("doc_tokens") % capacity
    powers = [capacity >> k for k in range(1, level + 1)]
    cut_off = F.array(*[F.when(tail.bitwiseAND(p) != 0, F.lit(p)) for p in powers]) if powers else F.array().cast("array<int>")
    parts = F.array_compact(cut_off).cast("array<long>")
    n_bits = F.size(parts)
    done = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    pieces = F.concat(
        F.transform(parts, lambda x, i: F.struct((whole + F.aggregate(F.slice(parts, 1, i), F.lit(0).cast("long"), lambda a, y: a + y)).alias("start"), x.alias("length"), F.get("bits", i).alias("crc"))),
        F.when(tail > done, F.array(F.struct((whole + done).alias("start"), (tail - done).alias("length"), F.get("rests", n_bits).alias("crc")))).otherwise(F.array().cast("array<struct<start:long,length:long,crc:long>>")),
    )
    salt = max(8, -(-n_rows // RANKED_ROWS))
    dealt = rows.withColumn("bucket", F.pmod(row, F.lit(salt)).cast("int"))
    tails = dealt.select(F.col(id_col).alias("id"), F.col(row).alias("row"), "doc_tokens", "bucket", F.explode(pieces).alias("p")).select("id", "row", "doc_tokens", "bucket", "p.start", "p.length", "p.crc")
    by_bucket = tails.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = tails.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("row", "start")) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select("id", "doc_tokens", "start", "length", "crc", (F.col("rank") + F.col("before")).alias("rank"))
    inside = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    nth = F.col("rank") - F.col("first")
    names = [F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens"]
    placed = ranked.join(F.broadcast(table), inside).select(*names, (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("base") + nth % F.col("each") * F.col("length")).alias("offset"))

    # Full runs: a sequence each, numbered after the others by bucket and by document within it.
    runs_of = F.size("full").cast("long")
    full = dealt.where(F.size("full") > 0)
    sums = full.groupBy("bucket").agg(F.sum(runs_of).alias("n"))
    base = sums.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = full.withColumn("upto", F.sum(runs_of).over(W.partitionBy("bucket").orderBy(row).rowsBetween(W.unboundedPreceding, -1))).join(F.broadcast(base), "bucket")
    numbered = numbered.select(F.col(id_col).alias("id"), "doc_tokens", (F.lit(sequence) + F.col("before") + F.coalesce("upto", F.lit(0))).alias("first"), F.posexplode("full").alias("k", "crc"))
    whole_rows = numbered.select(F.col("id").alias(id_col), (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole_rows)
