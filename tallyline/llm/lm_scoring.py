"""Operator 3, language-model scores: a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

Tokens are words and one end per text. A token's context is the token before it, or the start of the text. Every context
of the training texts is a restaurant, and all share the root restaurant as their parent.
With c customers and t tables, by dish and in all, discounts d and strengths s:

    P(w | u)    = (c_uw - d t_uw + (s + d t_u) P(w)) / (s + c_u)
    P(w)        = (r_w - d0) / (s0 + r)                 r_w: tables of w in all contexts
    P(unknown)  = (s0 + d0 V) / (s0 + r)                V: distinct training tokens

The root draws new dishes from a continuum, so all words never seen share what is left, and the probabilities of the
V known tokens and of the unknown sum to one. A context never seen in training gives P(w).

Sampling: given the others, the number of tables of c customers of a dish has a known distribution (generalised
Stirling numbers), from which it is drawn up to `EXACT` customers, above by Metropolis steps; one customer has one table.
Scores are the predictive probabilities at the mean table counts of the sweeps after the first ones, which sum to one;
they stand for the mean of the sweeps' probabilities, from which they differ by the covariance of a restaurant's tables with the root's.

How the work is dealt: texts are read once, into chunks of (context, word, document, count), which are dealt into buckets
by context. Contexts that are frequent in a sample of rows are dealt by pair, so no bucket has all of one; the sample decides
nothing else. A bucket so has all occurrences of its pairs, and the totals of its other contexts. What it lacks are the totals of
words and of frequent contexts: each bucket sends one row for each of its words, which are summed by word and sent
back. Sweeps are made within a bucket, with the tables of other buckets held; then the sums that they changed are
exchanged once more, and pairs are scored. Words are known by 64-bit hashes there. Buckets are worked on in `PARTS`, so
their shuffles aren't on disk at once.

Null text counts as empty and scores its end. Null ids train. Repeated rows train each and get a row each. An empty
table gives an empty result; without any training text each token is unknown with probability one. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import released, shuffles_dropped, written
from .tokenizing import balanced

#: Contexts that are dealt by pair, at most; rows of the sample that names them.
HEAD, SAMPLED = 1024, 1000
#: Characters of texts whose tokens share a bucket, characters of a chunk, parts that buckets are worked on in.
BUCKET_CHARS, CHUNK_CHARS, PARTS = 8_000_000, 4_000_000, 8
SWEEPS, BURN_IN, EXACT, STEPS, SEED = 8, 3, 32, 6, 7
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
COUNTED = 500_000
END = b"\n"  # no word has it
START = -1  # no word's hash


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def split(text: str) -> list[bytes]:
    """The tokens of a text: its words, then the end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


class Reader:
    """Tokens as numbers: 63 bits of their hash."""

    def number(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word) & ((1 << 63) - 1)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts one after the other, as places among their hashes; how many each text has; the hashes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at the ends leaves empty ones
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[real]
    words = words.filter(pa.array(real)).dictionary_encode()
    number = Reader().number
    hashes = np.array([number(x) for x in [*words.dictionary.cast(pa.binary()).to_pylist(), END]], dtype=np.int64)
    size = np.bincount(text, minlength=len(texts)) + 1
    out = np.full(len(text) + len(texts), len(hashes) - 1)
    out[np.arange(len(text)) + text] = words.indices.to_numpy()
    return out, size, hashes


def contexts(tokens: np.ndarray, only: np.ndarray) -> np.ndarray:
    """For each token the last one of `only` before it, or the start."""
    at = np.maximum.accumulate(np.where(np.isin(tokens, only), np.arange(1, len(tokens) + 1), 0))
    last = np.concatenate([[0], at[:-1]])
    return np.where(last > 0, tokens[last - 1], START)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of two arrays of 64-bit numbers."""
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C159E3779B9))
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def log_stirling(discount: float) -> list[np.ndarray]:
    """Logs of the generalised Stirling numbers S(c, t), t = 1 to c, for c up to EXACT."""
    rows = [np.array([]), np.array([0.0])]
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        stay = np.append(rows[c] + np.log(c - discount * t), -np.inf)
        rows.append(np.logaddexp(stay, np.insert(rows[c], 0, -np.inf)))
    return rows


class Seating:
    """Gibbs sweeps over pairs of a restaurant and a dish, given tables of the restaurants and of the root."""

    def __init__(self, discount: float, seed: int):
        self.d, self.stirling, self.random = discount, log_stirling(discount), np.random.default_rng(seed)

    def sweep(self, c: np.ndarray, t: np.ndarray, rest: np.ndarray, base: np.ndarray) -> np.ndarray:
        """New table counts of pairs with c customers; rest: other tables of the restaurant; base: the parent's probability."""
        out = t.copy()
        for size in range(2, EXACT + 1):
            at = np.flatnonzero(c == size)
            for some in np.array_split(at, len(at) // 50_000 + 1) if len(at) else ():
                k = np.arange(1, size + 1)
                grow = np.cumsum(np.log(STRENGTH + self.d * (rest[some, None] + k - 1)), axis=1)
                logs = self.stirling[size] + grow + k * np.log(base[some, None])
                p = np.exp(logs - logs.max(axis=1, keepdims=True))
                p = np.cumsum(p, axis=1)
                out[some] = 1 + (p < self.random.random(len(some))[:, None] * p[:, -1:]).sum(axis=1)
        at = np.flatnonzero(c > EXACT)
        for _ in range(STEPS if len(at) else 0):
            step = np.where(self.random.random(len(at)) < 0.5, 1, -1)
            low = np.minimum(out[at], out[at] + step)  # the ratio of low + 1 to low tables
            ratio = np.log(base[at]) + np.log(STRENGTH + self.d * (rest[at] + low)) - np.log(self.d) - np.log(np.maximum(low, 1))
            new = out[at] + step
            take = (np.log(self.random.random(len(at))) < step * ratio) & (new >= 1) & (new <= c[at])
            out[at] = np.where(take, new, out[at])
        return out


def discount_of(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, n) over the training rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(), Counter()

        def made() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(map(reader.number, seen)), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split(text))
                if len(seen) > COUNTED:
                    yield made()
                    seen.clear()
        yield made()

    return rows.where("train").select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def frequent(rows: DataFrame, n_rows: int, n_head: int, n_buckets: int) -> np.ndarray:
    """Contexts that take a good part of a bucket in a sample of rows, the start always; sorted hashes."""
    some = rows.withColumn("train", F.lit(True))
    found = word_counts(some.sample(min(1.0, SAMPLED / n_rows), SEED) if n_rows > SAMPLED else some)
    least = F.col("n") * (8 * n_buckets) > F.col("total")
    top = found.crossJoin(found.agg(F.sum("n").alias("total"))).where(least).orderBy(F.desc("n"), "key").limit(n_head).collect()
    return np.array(sorted([START, *(r["key"] for r in top)]), dtype=np.int64)


def gathered(rows: DataFrame, hot: np.ndarray, only: np.ndarray | None, n_buckets: int) -> DataFrame:
    """Chunks: for each bucket (context u, word w, doc: place in the chunk, n), as little-endian arrays; and a row of bucket -1 with the documents."""
    kind = rows.schema["own"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in balanced(whole, 1, CHUNK_CHARS):
                w, size, words = tokens_of(batch.column(1))
                doc, train = np.repeat(np.arange(len(size)), size), batch.column(2).to_numpy(zero_copy_only=False)
                if only is None:
                    u = np.append(START, w[:-1])
                    u[np.cumsum(size)[:-1]] = START
                else:
                    kept = np.flatnonzero(np.isin(words, only))
                    u = np.concatenate([contexts(x, kept) for x in np.split(w, np.cumsum(size)[:-1])])
                u[u == START] = len(words)
                words = np.append(words, START)
                # Equal triples as one, in the order of their bits.
                if len(words) < 1 << 21 and len(size) < 1 << 22:
                    key, n = np.unique((u.astype(np.uint64) << np.uint64(43)) | (w.astype(np.uint64) << np.uint64(22)) | doc.astype(np.uint64), return_counts=True)
                    u, w, doc = (key >> np.uint64(43)).astype(np.int64), ((key >> np.uint64(22)) & np.uint64((1 << 21) - 1)).astype(np.int64), (key & np.uint64((1 << 22) - 1)).astype(np.int64)
                else:
                    order = np.lexsort((doc, w, u))
                    u, w, doc = u[order], w[order], doc[order]
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(u) != 0) | (np.diff(w) != 0) | (np.diff(doc) != 0)]))
                    u, w, doc, n = u[first], w[first], doc[first], np.diff(np.append(first, len(u)))
                by_pair = np.isin(words, hot)[u]
                u, w = words[u], words[w]
                bucket = (mixed(u, np.where(by_pair, w, START)) % np.uint64(n_buckets)).astype(np.int32) * 2 + train[doc]
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                first = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
                ends = [*first[1:].tolist(), len(bucket)]
                dealt = [x[order] for x in (u, w, doc.astype(np.uint16 if len(size) <= 1 << 16 else np.uint32), n.astype(np.int32))]
                cols = [[x[i:j].tobytes() for i, j in zip(first.tolist(), ends, strict=True)] for x in dealt]
                key = np.append(bucket[first] // 2, -1)
                nothing = pa.nulls(len(first), pa.list_(batch.column(0).type))
                own = pa.concat_arrays([nothing, pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), batch.column(0))])
                values = [pa.array(np.where(key < 0, -1, key % PARTS), pa.int32()), pa.array(np.full(len(key), chunk)), pa.array(key, pa.int32()), pa.array(np.append(bucket[first] % 2 == 1, False))]
                values += [pa.array([*x, y], pa.binary()) for x, y in zip(cols, [size.tobytes(), train.astype(np.int64).tobytes(), None, None], strict=True)]
                yield pa.record_batch([*values[1:], own, values[0]], names=["chunk", "bucket", "train", "u", "w", "doc", "n", "own", "part"])
                chunk += 1

    return rows.select("own", "text", "train").mapInArrow(read, f"chunk long, bucket int, train boolean, u binary, w binary, doc binary, n binary, own array<{kind.simpleString()}>, part int")


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _pairs(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of occurrences by pair, and where in it the pairs begin."""
    key = mixed(u, w)
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


#: What buckets tell, as little-endian arrays: 0, words x with their customers c and tables r, and cu and tu as frequent contexts; 1, words
#: that are frequent contexts or have pairs of several customers, in the same way; 2, such pairs x, y with c customers, r tables and the
#: tables tu of x if that isn't frequent; 3, changes of r and tu of words x. Words are dealt into groups, for their sums.
ROWS = "bucket int, part int, kind int, x binary, y binary, c binary, r binary, cu binary, tu binary"
TYPES = {"x": np.int64, "y": np.int64, "c": np.int64, "r": np.float64, "cu": np.int64, "tu": np.float64}


def _made(rows: list[tuple[int, int, int, dict[str, np.ndarray]]]) -> pa.Table:
    """`ROWS` of these (bucket, part or group, kind, columns)."""
    columns = [pa.array([x[k] for x in rows], pa.int32()) for k in range(3)]
    columns += [pa.array([np.asarray(x[3].get(k, ()), dtype=t).tobytes() for x in rows], pa.binary()) for k, t in TYPES.items()]
    return pa.table(columns, names=[x.split()[0] for x in ROWS.split(", ")])


def _dealt(bucket: int, kinds: np.ndarray, n_groups: int, columns: dict[str, np.ndarray]) -> list[tuple]:
    """Rows of the words of a bucket by their kind and group."""
    key = (mixed(columns["x"], np.zeros(1, dtype=np.int64)) % np.uint64(n_groups)).astype(np.int64) * 4 + kinds
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
    columns = {k: v[order] for k, v in columns.items()}
    return [(bucket, int(key[i] // 4), int(key[i] % 4), {k: v[i:j] for k, v in columns.items()}) for i, j in zip(first, [*first[1:], len(key)], strict=bool(first))]


def counted(found: DataFrame, hot: np.ndarray, n_buckets: int) -> DataFrame:
    """`ROWS` of all words of a bucket, held-out ones too, and of the pairs of several customers, with one table a pair and the number of those of two as cu."""
    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        u, w, n = (_joined(table.column(k), t) for k, t in (("u", np.int64), ("w", np.int64), ("n", np.int32)))
        n = n * np.repeat(table.column("train").to_numpy(), [len(x) // 4 for x in table.column("n").to_pylist()])
        order, first = _pairs(u, w)
        c = np.add.reduceat(n[order], first, dtype=np.int64)
        u, w = u[order[first]], w[order[first]]
        some, many = c > 0, c > 1
        us, at_u = np.unique(u, return_inverse=True)
        tables, shared = np.bincount(at_u, some), np.isin(us, hot)
        words, at = np.unique(np.concatenate([w, us[shared]]), return_inverse=True)
        at, at_head = at[: len(w)], at[len(w) :]
        size = len(words)
        cu, tu, wanted = np.zeros(size), np.zeros(size), np.bincount(at, many, size) > 0
        cu[at_head], tu[at_head], wanted[at_head] = np.bincount(at_u, c)[shared], tables[shared], True
        out = _dealt(bucket, wanted * 1, n_buckets, {"x": words, "c": np.bincount(at, c, size), "r": np.bincount(at, some, size), "cu": cu, "tu": tu})
        local = np.where(shared, 0, tables)[at_u][many]
        return _made([*out, (bucket, bucket % PARTS, 2, {"x": u[many], "y": w[many], "c": c[many], "r": np.ones(len(local)), "cu": [(c == 2).sum()], "tu": local})])

    return found.select("bucket", "train", "u", "w", "n").groupBy("bucket").applyInArrow(count, ROWS)


def summed(rows: DataFrame) -> DataFrame:
    """Rows of words with the sums over all buckets, for each bucket that told of them; and for each group a row of bucket -1: numbers of words
    with customers, of customers, of words of one table and of two (c), and of tables (r)."""
    def add(table: pa.Table) -> pa.Table:
        kinds, buckets = table.column("kind").to_numpy(), table.column("bucket").to_numpy()
        sizes = np.array([len(x) // 8 for x in table.column("x").to_pylist()])
        words, at = np.unique(_joined(table.column("x"), np.int64), return_inverse=True)
        sums = {k: np.bincount(at, _joined(table.column(k), TYPES[k]), len(words)) for k in ("c", "r", "cu", "tu")}
        wanted = np.bincount(at, np.repeat(kinds == 1, sizes), len(words)) > 0
        order = np.argsort(np.repeat(buckets, sizes), kind="stable")
        mine, at = np.repeat(buckets, sizes)[order], at[order]
        out, changes = [], kinds[0] == 3
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, dtype=np.int64)
        for i, j in zip(first, np.append(first[1:], len(mine)), strict=bool(len(first))):
            for kind in (3,) if changes else (0, 1):
                some = at[i:j] if changes else at[i:j][wanted[at[i:j]] == kind]
                out.append((int(mine[i]), int(mine[i]) % PARTS, kind, {"x": words[some]} | {k: v[some] for k, v in sums.items()}))
        known = sums["c"] > 0
        return _made([*out, (-1, -1, kinds[0], {"c": [known.sum(), sums["c"].sum(), *((sums["r"] == k).sum() for k in (1, 2))], "r": [sums["r"].sum()]})])

    return rows.withColumnRenamed("part", "g").groupBy("g").applyInArrow(add, ROWS)


def _looked(xs: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x among the sorted xs, and whether they are there."""
    if not len(xs):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(xs, x), len(xs) - 1)
    return at, xs[at] == x


def _of_kind(table: pa.Table, *kinds: int) -> dict[str, np.ndarray]:
    """Columns of the rows of these kinds, in the order of x, then y."""
    table = table.filter(pc.is_in(table.column("kind"), pa.array(kinds, pa.int32())))
    out = {k: _joined(table.column(k), t) for k, t in TYPES.items()}
    order = np.lexsort((out["y"], out["x"])) if len(out["y"]) else np.argsort(out["x"])
    return {k: v[order] if len(v) == len(order) else v for k, v in out.items()}


def _told(table: DataFrame) -> tuple[np.ndarray, float]:
    """The sums over all groups of what `summed` tells."""
    rows = table.where("bucket = -1").select("c", "r").collect()
    return sum((np.frombuffer(x["c"], dtype=np.int64) for x in rows), np.zeros(4, dtype=np.int64)), sum(np.frombuffer(x["r"])[0] for x in rows)


def seated(rows: DataFrame, hot: np.ndarray, n_buckets: int, d: float, d0: float, root_total: float) -> DataFrame:
    """Sweeps over the pairs of several customers. Rows of kind 2 with their mean tables; of kind 3 for all words that came, with what was added to r and tu."""
    def sweep(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words, pairs = _of_kind(table, 1), _of_kind(table, 2)
        at, _ = _looked(words["x"], pairs["y"])
        us, at_u = np.unique(pairs["x"], return_inverse=True)
        place, _ = _looked(words["x"], us)
        shared = np.isin(us, hot)
        tables = np.zeros(len(us))
        tables[at_u] = pairs["tu"]
        tables = np.where(shared, words["tu"][place] if len(us) else 0, tables)
        seating, t, mean = Seating(d, SEED + bucket), np.ones(len(at), dtype=np.int64), np.zeros(len(at))
        for k in range(SWEEPS if len(at) else 0):
            root = words["r"] + np.bincount(at, t - 1, len(words["x"]))
            rest = tables[at_u] + np.bincount(at_u, t - 1, len(us))[at_u] - t
            base = np.maximum(root[at] - t - d0, 1 - d0) / (ROOT_STRENGTH + root_total)
            t = seating.sweep(pairs["c"], t, np.maximum(rest, 0), base)
            if k >= BURN_IN:
                mean += t / (SWEEPS - BURN_IN)
        more = np.bincount(at, mean - 1, len(words["x"])) if len(at) else np.zeros(len(words["x"]))
        more_u = np.zeros(len(words["x"]))
        more_u[place[shared]] = np.bincount(at_u, mean - 1, len(us))[shared]
        changes = _dealt(bucket, np.full(len(more), 3), n_buckets, {"x": words["x"], "c": np.zeros(len(more)), "r": more, "cu": np.zeros(len(more)), "tu": more_u})
        return _made([*changes, (bucket, bucket % PARTS, 2, {"x": pairs["x"], "y": pairs["y"], "c": pairs["c"], "r": mean})])

    return rows.groupBy("bucket").applyInArrow(sweep, ROWS)


def merged(table: pa.Table) -> pa.Table:
    """The sums of a chunk's documents over its rows, as one row."""
    table = table.sort_by([("bucket", "ascending")])
    docs, at = np.unique(_joined(table.column("doc"), np.int32), return_inverse=True)
    sums = [np.bincount(at, _joined(table.column(k), np.float64), len(docs)).tobytes() for k in ("known", "base", "score")]
    return pa.table([table.column("chunk")[:1], table.column("bucket")[:1], *(pa.array([x], pa.binary()) for x in (docs.tobytes(), *sums))], names=table.column_names)


def judged(found: DataFrame, rows: DataFrame, hot: np.ndarray, d: float, d0: float, root_total: float, distinct: int) -> DataFrame:
    """(chunk, bucket, doc, known, base, score: little-endian arrays): sums over the occurrences in these buckets, a row for each chunk."""
    below = ROOT_STRENGTH + root_total
    unknown = (ROOT_STRENGTH + d0 * distinct) / below

    def judge(table: pa.Table, more: pa.Table) -> pa.Table:
        u, w, n = (_joined(table.column(k), t) for k, t in (("u", np.int64), ("w", np.int64), ("n", np.int32)))
        sizes = [len(x) // 4 for x in table.column("n").to_pylist()]
        docs = [np.frombuffer(x, np.uint16 if len(x) == 2 * size else np.uint32) for x, size in zip(table.column("doc").to_pylist(), sizes, strict=True)]
        out = []
        if len(u):
            row = np.repeat(np.arange(len(sizes)), sizes)
            train = table.column("train").to_numpy()[row]
            order, first = _pairs(u, w)
            pair = np.empty(len(u), dtype=np.int64)
            pair[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
            c = np.add.reduceat((n * train)[order], first, dtype=np.int64)
            pu, pw = u[order[first]], w[order[first]]
            words, seats, added = _of_kind(more, 0, 1), _of_kind(more, 2), _of_kind(more, 3)
            # Tables of the pairs; pairs stand in the order of their hash.
            t = np.minimum(c, 1).astype(np.float64)
            key = mixed(pu, pw)
            at, _ = _looked(key, mixed(seats["x"], seats["y"]))
            t[at] = seats["r"]
            place, there = _looked(added["x"], words["x"])
            if len(added["x"]):
                words["r"] = words["r"] + np.where(there, added["r"][place], 0)
                words["tu"] = words["tu"] + np.where(there, added["tu"][place], 0)
            us, at_u = np.unique(pu, return_inverse=True)
            customers, tables = np.bincount(at_u, c).astype(np.float64), np.bincount(at_u, t)
            place, there = _looked(words["x"], us)
            shared = np.isin(us, hot)
            if len(words["x"]):
                customers = np.where(shared, np.where(there, words["cu"][place], 0), customers)
                tables = np.where(shared, np.where(there, words["tu"][place], 0), tables)
            place, there = _looked(words["x"], pw)
            r = np.where(there, words["r"][place], 0) if len(words["x"]) else np.zeros(len(pw))
            count = np.where(there, words["c"][place], 0) if len(words["x"]) else np.zeros(len(pw))
            p_root = np.where(count > 0, (r - d0) / below, unknown)
            p = (c - d * t + (STRENGTH + d * tables[at_u]) * p_root) / (STRENGTH + customers[at_u])
            values = [(count > 0)[pair] * n, np.log10(1.0 + count)[pair] * n, np.log10(p)[pair] * n]
            at = 0
            for doc, size in zip(docs, sizes, strict=True):
                some, place = np.unique(doc, return_inverse=True)
                out.append([some.astype(np.int32).tobytes(), *(np.bincount(place, v[at : at + size]).tobytes() for v in values)])
                at += size
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([table.column("chunk"), table.column("bucket"), *(pa.array(x, pa.binary()) for x in cols)], names=["chunk", "bucket", "doc", "known", "base", "score"])

    left = found.select("chunk", "bucket", "train", "u", "w", "doc", "n").groupBy("bucket")
    schema = "chunk long, bucket int, doc binary, known binary, base binary, score binary"
    return left.cogroup(rows.groupBy("bucket")).applyInArrow(judge, schema).groupBy("chunk").applyInArrow(merged, schema)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_held: Column | None = None, n_contexts: int | None = None, n_head: int = HEAD) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    With n_contexts only that many of the most frequent words (none: 0) and the start are contexts, of the tokens up to the next one.
    """
    is_held = held_out(id_col) if is_held is None else is_held
    rows = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (~is_held).alias("train"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n_buckets = 1 + (size["chars"] or 0) // BUCKET_CHARS
    hot, only = frequent(rows, size["n"], n_head, n_buckets), None
    if n_contexts is not None:
        end = Reader().number(END)
        top = word_counts(rows).where(F.col("key") != end).orderBy(F.desc("n"), "key").limit(n_contexts).collect()
        only = np.array(sorted(r["key"] for r in top), dtype=np.int64)
    found = written(gathered(rows, hot, only, n_buckets), "occurrences", parts="part")

    parts = []
    for part in range(PARTS):
        parts.append(written(counted(found.where(F.col("part") == part), hot, n_buckets), "counted"))
        shuffles_dropped(found)
    ones = reduce(DataFrame.union, parts)
    totals = written(summed(ones.where("kind < 2")), "totals")
    (distinct, tokens, one, two), tables = _told(totals)
    several = [(x["n"], np.frombuffer(x["two"], dtype=np.int64)[0]) for x in ones.where("kind = 2").select((F.octet_length("x") / 8).alias("n"), F.col("cu").alias("two")).collect()]
    d, d0 = discount_of(int(tables - sum(n for n, _ in several)), int(sum(n for _, n in several))), discount_of(int(one), int(two))
    seats = written(seated(totals.where("kind = 1 and bucket >= 0").union(ones.where("kind = 2")), hot, n_buckets, d, d0, float(tables)), "seats")
    released(*parts)
    shuffles_dropped(seats)
    added = written(summed(seats.where("kind = 3")), "added")
    shuffles_dropped(added)
    r_all = float(tables + _told(added)[1])
    known = totals.where("bucket >= 0").union(seats.where("kind = 2")).union(added.where("bucket >= 0"))
    sums = []
    for part in range(PARTS):
        sums.append(written(judged(found.where(F.col("part") == part), known.where(F.col("part") == part), hot, d, d0, r_all, int(distinct)), "sums"))
        shuffles_dropped(found)
    released(totals, seats, added)

    tokens, norm = int(tokens), math.log10(int(tokens) + int(distinct) + 1)
    kind = rows.schema["own"].dataType.simpleString()

    def add(own: pa.Table, table: pa.Table) -> pa.Table:
        n, train = _joined(own.column("u"), np.int64), _joined(own.column("w"), np.int64)
        values = np.zeros((3, len(n)))
        table = table.sort_by([("bucket", "ascending")])
        for data, *cols in zip(*(table.column(k).to_pylist() for k in ("doc", "known", "base", "score")), strict=True):
            at = np.frombuffer(data, dtype=np.int32)
            for value, col in zip(values, cols, strict=True):
                value[at] += np.frombuffer(col, dtype=np.float64)
        ids = own.column("own").combine_chunks().flatten()
        return pa.table([ids, pa.array(train == 0), pa.array(n), pa.array(np.round(values[0]).astype(np.int64)), pa.array(np.full(len(n), tokens)), pa.array(values[1] - n * norm), pa.array(values[2])], names=["own", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = found.where("part = -1").select("chunk", "u", "w", "own").groupBy("chunk")
    out = own.cogroup(reduce(DataFrame.union, sums).groupBy("chunk")).applyInArrow(add, f"own {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("own", id_col)


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, n_tokens, perplexity) over the rows of `scored`: ten to the power of minus the mean score of a token."""
    sums = scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("score"))
    return sums.select("held_out", "n_tokens", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
