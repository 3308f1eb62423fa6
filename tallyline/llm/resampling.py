"""Operator 12, importance resampling towards a target distribution by hashed runs of words.

A feature is a run of one to `ORDER` words joined by one space; its bucket is the CRC-32 of its bytes modulo `BUCKETS`. A
text is scanned once: the CRC states of the runs that started at the last words are kept, and the next word extends each
of them by a space and itself, so no run is ever put together. The scan emits buckets.

1. All texts and all target texts are scanned into counts of the buckets, BUCKETS numbers a task, and these are added up.
   The gains of the buckets, BUCKETS numbers whatever the input, go to all tasks.
2. Texts are scanned again; a text's weight is the sum of the gains of its features, its score adds Gumbel noise that
   depends on the seed and the id only. Nothing is kept of the text but these numbers.
3. Texts of `least` words or more are sorted by score over all partitions; with the sizes of the partitions before it
   each has its rank, without a window over all rows. The best `percent` per cent are drawn (the Gumbel top-k trick).

Null and empty texts have no features, weight 0 and are never drawn. Null ids count as '' for the noise and come last in ties;
further ties are ordered by number of features and weight, so only rows alike in all columns could change places.
Repeated rows are rows of their own. An empty table gives an empty result; an empty target makes all gains follow from the
documents alone. Very long texts are scanned in pieces, across which the states are kept. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_words import DIGITS, LETTERS, word_pieces, word_table
from .rows import unused
from .storage import released, written
from .tokenizing import balanced

BUCKETS = 10_000
ORDER = 3
TABLE = word_table(LETTERS + DIGITS)


def buckets(text: bytes, order: int = ORDER, size: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end at them) for each piece of a text.

    states[k] has the CRC of the run of k + 1 words that ends at each word; those of the last word are carried on.
    """
    ring: list[int] = []
    for words in word_pieces(text, TABLE):
        if not words:
            continue
        spaced = [b" " + w for w in words]
        states = [list(map(crc32, words))]
        for k in range(1, order):
            # The runs that ended at the word before, longer by a space and this word.
            shorter = ring[k - 1 : k] + states[-1][:-1]
            states.append(list(map(crc32, islice(spaced, len(spaced) - len(shorter), None), shorter)))
        ring = [x[-1] for x in states if x]
        found = np.fromiter((c for some in states for c in some), np.int64, sum(map(len, states)))
        yield len(words), found % size


def _counted(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for whole in batches:
            for batch in balanced(whole, 0):
                for text in batch.column(0).to_pylist():
                    for _, found in buckets(text, size=size):
                        sums += np.bincount(found, minlength=size)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    return count


def _bytes(df: DataFrame, text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")


def bucket_counts(texts: DataFrame, text_col: str = "text", size: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""
    found = texts.select(_bytes(texts, text_col)).mapInArrow(_counted(size), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for r in found.collect():  # `size` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    size = len(source)
    s_all, t_all = float(source.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(ident: str, seed: int) -> int:
    """1000 times a Gumbel draw from the seed and the id, floored."""
    h = int(hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight, score) of every row."""
    names = [id_col, *(unused([id_col], x) for x in ("n_words", "n_features", "weight", "score"))]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in balanced(whole, 2):
                rows = []
                for ident, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    n = features = weight = 0
                    for words, found in buckets(text, size=len(gain)):
                        n, features, weight = n + words, features + len(found), weight + int(gain[found].sum())
                    rows.append((n, features, weight, weight + noise(ident, seed)))
                columns = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.record_batch([batch.column(0), *(pa.array(columns[:, k]) for k in range(4))], names=names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("ident"), _bytes(docs, text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(weigh, f"`{id_col}` {kind}, " + ", ".join(f"{x} long" for x in names[1:]))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with their rank (from 1) in this order over all partitions: a range sort, and the sizes of the partitions before."""
    place = unused(rows.columns, "place")
    # In a sorted partition this id is the partition's number, shifted by 33 bits, and the row's place.
    table = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(place, 33)
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "part long, offset long")
    own = unused([*rows.columns, place], "part")
    joined = table.withColumn(own, part).join(F.broadcast(offsets.withColumnRenamed("part", own)), own)
    return joined.withColumn("rank", F.col("offset") + F.col(place).bitwiseAND((1 << 33) - 1) + 1).drop(own, "offset", place)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every row; rank is null for rows that aren't drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    table = written(weighed(docs, gain, seed, id_col, text_col), "weighed")
    enough = F.col("n_words") >= least
    drawn = table.where(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.desc("n_features"), F.desc("weight")]
    best = ranked(table.where(enough), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.unionByName(table.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def drawn_texts(docs: DataFrame, target: DataFrame, percent: int = 5, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of docs, with all their columns, whose id was drawn."""
    own = unused(docs.columns, "drawn_id")
    ids = resampled(docs, target, percent, id_col=id_col, **options).where(F.col("rank").isNotNull()).select(F.col(id_col).alias(own)).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
