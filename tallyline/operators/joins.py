"""Joins on an interval of days, and on a band of amounts, by buckets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    """Amounts of the right side from low to high times those of the left side; all positive."""

    left: str
    right: str
    low: float
    high: float

    def holds(self) -> Column:
        return F.col(self.right).between(F.col(self.left) * self.low, F.col(self.left) * self.high)

    def bucket(self, amount: Column) -> Column:
        """Logarithmic buckets as wide as the band, so that a band lies in two of them, or three at its edges."""
        return F.floor(F.log(amount) / math.log(self.high / self.low))


#: Parts that rows are dealt into before they become more or wider. The number is given, for what comes of a part isn't in
#: proportion to the bytes by which Spark would put parts together.
PARTS = 192


def days_join(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, max_days: int, also: Column | None = None, band: Band | None = None) -> DataFrame:
    """Pairs of equal keys whose right date is 0 to max_days after the left one, and whose amounts are in the band.

    Dates are dealt into buckets of max_days + 1 days, so a right row has one bucket and a left row two. That makes an
    equality join of what would be a nested loop. With a band, amounts are dealt into buckets as well, so a busy
    day of a busy statement doesn't meet itself whole; `also` is checked within the join.
    """
    width = max_days + 1
    bucket = lambda date: F.floor(F.unix_date(F.col(date)) / width)
    l = left.withColumn("day_bucket", F.explode(F.array(bucket(left_date), bucket(left_date) + 1)))
    r = right.withColumn("right_bucket", bucket(right_date))
    on = (F.col("day_bucket") == F.col("right_bucket")) & F.col(right_date).between(F.col(left_date), F.date_add(F.col(left_date), max_days))
    if band is not None:
        at = F.col(band.left)
        l = l.where(at > 0).withColumn("amount_bucket", F.explode(F.sequence(band.bucket(at * band.low), band.bucket(at * band.high))))
        r = r.where(F.col(band.right) > 0).withColumn("right_amount_bucket", band.bucket(F.col(band.right)))
        on = on & (F.col("amount_bucket") == F.col("right_amount_bucket")) & band.holds()
    for k in keys:
        r = r.withColumnRenamed(k, f"right_{k}")
        on = on & (F.col(k) == F.col(f"right_{k}"))
    if also is not None:
        on = on & also
    amounts = (["amount_bucket"], ["right_amount_bucket"]) if band is not None else ([], [])
    l = l.repartition(PARTS, "day_bucket", *amounts[0], *keys)
    r = r.repartition(PARTS, "right_bucket", *amounts[1], *(f"right_{k}" for k in keys))
    return l.join(r, on).drop("day_bucket", "right_bucket", "amount_bucket", "right_amount_bucket", *(f"right_{k}" for k in keys))
