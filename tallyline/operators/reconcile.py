"""Reconciliation of rows with printed balances, and repairs that the balances prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("NO REPORTED BALANCE", "OPENING / REFERENCE", "INCOMPLETE — DEBIT/CREDIT UNKNOWN", "MATCH", "MISMATCH")


def in_order() -> W:
    return W.partitionBy("statement_id").orderBy("source_seq")


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def evidence_order(ledger: DataFrame) -> DataFrame:
    """Rows with their place by date, then source order; undated rows last."""
    place = W.partitionBy("statement_id").orderBy(F.col("date").asc_nulls_last(), F.col("source_seq").asc_nulls_last())
    return ledger.withColumn("place", F.row_number().over(place))


def balance_check(ledger: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Status, expected balance and difference of each row; gap_explained: a mismatch after which the next rows agree again.

    The balance before a row is the last printed one. A mismatch is explained if the next two rows (or the only one
    left) follow from its own balance.
    """
    w = in_order()
    rows = ledger.withColumns(
        {
            "before": F.last("balance", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),
            "left": F.count("*").over(w.rowsBetween(1, W.unboundedFollowing)),
            **{f"b{k}": F.lead("balance", k).over(w) for k in (1, 2)},
            **{f"m{k}": F.lead(zero("credit") - zero("debit"), k).over(w) for k in (1, 2)},
        }
    )
    expected = F.col("before") + zero("credit") - zero("debit")
    status = (
        F.when(F.col("balance").isNull(), STATUSES[0]).when(F.col("before").isNull(), STATUSES[1])
        .when(F.col("debit").isNull() & F.col("credit").isNull(), STATUSES[2])
        .when(F.abs(F.col("balance") - expected) <= tolerance, STATUSES[3]).otherwise(STATUSES[4])
    )
    known = F.col("status").isin("MATCH", "MISMATCH")
    follows = lambda a, b, m: F.coalesce(F.abs(F.col(b) - (F.col(a) + F.col(m))) <= tolerance, F.lit(False))
    first, second = follows("balance", "b1", "m1"), follows("b1", "b2", "m2")
    gap = (F.col("status") == "MISMATCH") & F.when(F.col("left") >= 2, first & second).otherwise((F.col("left") == 1) & first)
    rows = rows.withColumn("status", status)
    rows = rows.withColumns(
        {
            "expected": F.when(F.col("status") == STATUSES[1], F.col("balance")).when(known, expected),
            "difference": F.when(F.col("status") == STATUSES[1], F.lit(0.0)).when(known, F.col("balance") - expected),
            "gap_explained": gap,
        }
    )
    return rows.drop("before", "left", "b1", "b2", "m1", "m2")


def _flipped(rows: DataFrame, before: Column, tolerance: float) -> DataFrame:
    """Swaps the sides of rows with one amount that only fits on the other side."""
    change = F.col("balance") - before
    one = F.col("debit").isNull() != F.col("credit").isNull()
    amount = F.coalesce("debit", "credit")
    own = F.abs(zero("credit") - zero("debit") - change) <= tolerance
    other = F.abs(zero("debit") - zero("credit") - change) <= tolerance
    flip = F.coalesce(one & (amount > tolerance) & other & ~own, F.lit(False))
    return rows.withColumns({"debit": F.when(flip, F.col("credit")).otherwise(F.col("debit")), "credit": F.when(flip, F.col("debit")).otherwise(F.col("credit")), "flipped": flip})


def repair_side(ledger: DataFrame, tolerance: float = 0.01, opening: DataFrame | None = None, fill: bool = False) -> DataFrame:
    """Sides that the last printed balance proves; with opening (statement_id, opening) also for the first rows.

    fill: where both sides are missing, the change from the last printed balance (or the opening) to the row's own is its
    amount; off by default, for such an amount is printed nowhere. Rows tell by `flipped` and `filled` what happened.
    """
    rows = ledger.withColumn("before", F.last("balance", ignorenulls=True).over(in_order().rowsBetween(W.unboundedPreceding, -1)))
    if opening is not None:
        rows = rows.join(opening, "statement_id", "left").withColumn("before", F.coalesce("before", "opening")).drop("opening")
    rows = _flipped(rows, F.col("before"), tolerance)
    change = F.round(F.col("balance") - F.col("before"), 2)
    none = F.col("debit").isNull() & F.col("credit").isNull()
    filled = F.coalesce(none & (F.abs(change) > tolerance), F.lit(False)) if fill else F.lit(False)
    rows = rows.withColumns({"filled": filled, "change": change})
    side = lambda c, sign: F.when(F.col("filled") & (F.col("change") * sign > 0), F.abs("change")).otherwise(F.col(c))
    return rows.withColumns({"debit": side("debit", -1), "credit": side("credit", 1)}).drop("before", "change")


def repair_movement(ledger: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Sides, and amounts found once in the source text, that the balance of the row just before proves."""
    rows = ledger.withColumn("before", F.lag("balance").over(in_order()))
    rows = _flipped(rows, F.col("before"), tolerance)
    change = F.col("balance") - F.col("before")
    tokens = F.transform(F.regexp_extract_all(F.coalesce("source_text", F.lit("")), F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    hits = F.size(F.filter(tokens, lambda x: F.abs(x - F.abs(change)) <= tolerance))
    found = F.coalesce(F.col("debit").isNull() & F.col("credit").isNull() & (hits == 1) & (F.abs(change) > tolerance), F.lit(False))
    amount = F.round(F.abs(change), 2)
    return rows.withColumns({"debit": F.when(found & (change < 0), amount).otherwise(F.col("debit")), "credit": F.when(found & (change > 0), amount).otherwise(F.col("credit")), "filled": found}).drop("before")


def runs_back() -> Column:
    """Whether a row's date lies before that of the row before; false without dates."""
    return F.coalesce(F.datediff("date", F.lag("date").over(in_order())) < 0, F.lit(False))


def date_reversals(ledger: DataFrame) -> DataFrame:
    """Per statement how often a date lies before that of the row before."""
    return ledger.withColumn("back", runs_back()).groupBy("statement_id").agg(F.count_if("back").alias("reversals"))
