"""Operator 1, token counts: batch encoding in Arrow functions that return lengths only.

Each Arrow batch is dealt into runs of about equal bytes, long texts are cut at boundaries that no token
crosses (see `tokenizing`), and only the sums of the piece lengths leave the worker. There is no shuffle.

Null text counts as empty (0 bytes, 0 tokens); empty tables give empty results; ids are carried as they
are, so null or repeated ids give a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenizing import balanced, remembering


def token_lengths(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) for each row of docs, by the tokenizers file `vocabulary`."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("tl_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembering(vocabulary, len, sum)
        for whole in batches:
            for batch in balanced(whole, 1):
                texts = pc.fill_null(batch.column(1), "")
                n = pa.array([sum(x) for x in encoder.values(texts.to_pylist())], pa.int64())
                yield pa.record_batch([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n], names=[id_col, "n_bytes", "n_tokens"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def over(limit: int) -> Column:
    return (F.col("n_tokens") > limit).alias("over_limit")
