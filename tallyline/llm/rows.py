"""Rows told apart by id and text, for unlike texts may share an id; repeated rows are one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(names: list[str], like: str) -> str:
    """A column name that is none of names."""
    taken = {x.lower() for x in names}
    while like.lower() in taken:
        like += "_"
    return like


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of hash of id and text."""
    text = F.col(text_col).cast("string")
    return F.struct(F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(1), F.col(id_col), text).alias("k2"))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, with all their columns, whose key isn't in the column `key` of gone."""
    own, other = (unused(docs.columns, x) for x in ("row_key", "row_gone"))
    rows = docs.withColumn(own, row_key(id_col, text_col))
    return rows.join(gone.select(F.col("key").alias(other)).distinct(), F.col(own) == F.col(other), "left_anti").drop(own)
