"""Exact quantiles by key of which no task holds all values of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets for each factor of e; a key has a few thousand of them, however many rows.
FINE = 64


def _bucket(value: Column) -> Column:
    return F.floor(F.log(value) * FINE).cast("int")


def quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, n, a column for each of points) of positive values, interpolated between neighbours.

    1. Values are counted in logarithmic buckets, before the shuffle as well; the buckets of a key are a short list,
       which tells in which bucket a rank lies and how far into it.
    2. Only the values of those buckets are counted one by one, equal ones together, and the rank is looked up among them.
    So neither a key with most of the rows nor a value with most of a key's rows gathers in a task. Values that
    aren't positive, and nulls, don't count; keys without any have no row.
    """
    some = rows.where(F.col(value) > 0).select(*keys, F.col(value).cast("double").alias("v")).withColumn("bucket", _bucket(F.col("v")))
    counts = some.groupBy(*keys, "bucket").agg(F.count("*").alias("m"))
    w = W.partitionBy(*keys).orderBy("bucket")
    below = counts.withColumns({"upto": F.sum("m").over(w), "n": F.sum("m").over(W.partitionBy(*keys))})
    # For each point the two ranks, from 0, that its value lies between.
    ranks = F.array(*(F.struct(F.lit(name).alias("point"), F.lit(upper).alias("upper"), (F.floor if not upper else F.ceil)((F.col("n") - 1) * q).cast("long").alias("rank")) for name, q in points.items() for upper in (False, True)))
    wanted = below.select("*", F.inline(ranks)).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m")))
    wanted = wanted.select(*keys, "n", "bucket", "point", "upper", (F.col("rank") - F.col("upto") + F.col("m")).alias("into"))
    values = some.join(wanted.select(*keys, "bucket").distinct(), [*keys, "bucket"]).groupBy(*keys, "bucket", "v").agg(F.count("*").alias("m"))
    values = values.withColumn("upto", F.sum("m").over(W.partitionBy(*keys, "bucket").orderBy("v")))
    found = wanted.join(values, [*keys, "bucket"]).where((F.col("into") < F.col("upto")) & (F.col("into") >= F.col("upto") - F.col("m")))
    part = lambda name, upper: F.max(F.when((F.col("point") == name) & (F.col("upper") == upper), F.col("v")))
    n = F.first("n")

    def between(name: str, q: float) -> Column:
        h = (n - 1) * q
        return part(name, False) + (part(name, True) - part(name, False)) * (h - F.floor(h))

    return found.groupBy(*keys).agg(n.alias("n"), *(between(name, q).alias(name) for name, q in points.items()))
