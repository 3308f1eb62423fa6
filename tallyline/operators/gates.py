"""Verdicts on whole statements: integrity, anchors, acceptance. They are rows, never exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import cents
from .reconcile import balance_check, runs_back, zero


def _odd(name: str) -> Column:
    return F.coalesce(F.isnan(name) | (F.abs(name) == float("inf")), F.lit(False))


def integrity_counts() -> list[Column]:
    """Aggregates of the rows of `balance_check` (with `back`: the date lies before that of the row above) that `broken_rule` looks at.

    A row is dual-sided if both sides are present, whatever their amounts; infinite amounts and NaN are not finite.
    """
    has, both = F.col("debit").isNotNull() | F.col("credit").isNotNull(), F.col("debit").isNotNull() & F.col("credit").isNotNull()
    found = {
        "undated": F.col("date").isNull(), "dual_sided": both, "non_finite": _odd("debit") | _odd("credit") | _odd("balance"), "negative": (zero("debit") < 0) | (zero("credit") < 0),
        "moved": has, "unmatched": F.col("status") == "MISMATCH", "reversed": F.col("back"),
    }
    return [F.count_if(c).alias(name) for name, c in found.items()]


def broken_rule() -> Column:
    """The first rule that a statement of n_rows with these counts breaks; empty for none."""
    limit = F.greatest(F.lit(2), F.floor(F.col("n_rows") * 0.02))
    return (
        F.when(F.col("undated") > 0, "undated rows").when(F.col("dual_sided") > 0, "both sides in a row").when(F.col("non_finite") > 0, "amounts that are not finite").when(F.col("negative") > 0, "negative amounts")
        .when(F.col("moved") < 0.9 * F.col("n_rows"), "movements missing").when(F.col("reversed") > limit, "dates run backwards").when(F.col("unmatched") > 0, "balances do not follow").otherwise("")
    )


def integrity(ledger: DataFrame) -> DataFrame:
    """Counts of violations of each statement, the first rule that it breaks (reason, empty for none) and whether it passes."""
    rows = balance_check(ledger).withColumn("back", runs_back())
    out = rows.groupBy("statement_id").agg(F.count("*").alias("n_rows"), *integrity_counts()).withColumn("reason", broken_rule())
    return out.withColumnsRenamed({"unmatched": "mismatches", "reversed": "reversals"}).withColumn("passed", F.col("reason") == "")


def anchor(first: Column, opening: Column, tolerance: float = 0.01) -> dict[str, Column]:
    """What a first row (struct of debit, credit, balance) says of a printed opening balance: the balance expected of it, the
    difference, what to make of it, and how far that may be relied on: 1 if it is verified or there is nothing to verify, else 0."""
    move = F.coalesce(first["credit"], F.lit(0.0)) - F.coalesce(first["debit"], F.lit(0.0))
    known = first["balance"].isNotNull() & (first["debit"].isNotNull() | first["credit"].isNotNull())
    difference = F.round(first["balance"] - (opening + move), 2)
    status = F.when(opening.isNull(), "NOT_PRESENT").when(~known, "AMBIGUOUS").when(F.abs(difference) <= tolerance, "VERIFIED").otherwise("CONFLICTING")
    return {"expected": F.when(known, F.round(opening + move, 2)), "difference": F.when(known, difference), "status": status, "confidence": F.when(status.isin("VERIFIED", "NOT_PRESENT"), 1.0).otherwise(0.0)}


def opening_anchor(ledger: DataFrame, opening: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether the first row follows from a printed opening balance (statement_id, opening, source): see `anchor`."""
    first = ledger.groupBy("statement_id").agg(F.min_by(F.struct("debit", "credit", "balance"), "source_seq").alias("f"))
    out = first.join(opening, "statement_id", "left").withColumns(anchor(F.col("f"), F.col("opening"), tolerance))
    return out.select("statement_id", "opening", "source", "expected", "difference", "status", "confidence")


def anchor_policy(anchors: DataFrame, rates: DataFrame) -> DataFrame:
    """Accepts or rejects statements by their anchor and their recovery rates (movement_rate, balance_rate, mismatches)."""
    strong = (F.col("movement_rate") >= 0.95) & (F.col("balance_rate") >= 0.95)
    by_source = F.when(F.col("source").isin("explicit_opening", "brought_forward"), F.lit(False)).otherwise(strong & (F.col("mismatches") == 0))
    accept = F.when(F.col("status").isin("NOT_PRESENT", "VERIFIED"), F.lit(True)).when(F.col("status") == "AMBIGUOUS", strong).otherwise(by_source)
    return anchors.join(rates, "statement_id").withColumn("accepted", accept)


def own_totals() -> list[Column]:
    """Aggregates of a ledger that its printed summary is compared with: debits, credits, last_balance."""
    total = lambda c: F.coalesce(F.sum(cents(c)), F.lit(0)).cast("double")
    return [total("debit").alias("debits"), total("credit").alias("credits"), F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("source_seq"))).alias("last_balance")]


def agrees(tolerance: float = 0.01) -> Column:
    """Whether own totals are those of a printed summary (withdrawal, deposit, closing)."""
    pairs = (("debits", "withdrawal"), ("credits", "deposit"), ("last_balance", "closing"))
    return F.coalesce(reduce(lambda a, b: a & b, (F.abs(F.col(x) - F.col(y)) <= tolerance for x, y in pairs)), F.lit(False))


def summary_anchor(ledger: DataFrame, summary: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether sums and the last balance agree with a printed summary (statement_id, withdrawal, deposit, closing)."""
    return ledger.groupBy("statement_id").agg(*own_totals()).join(summary, "statement_id").withColumn("matched", agrees(tolerance))


def recovery_rates(ledger: DataFrame) -> DataFrame:
    moved = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    rate = lambda x: F.round(F.avg(x.cast("int")), 6)
    return balance_check(ledger).groupBy("statement_id").agg(F.count("*").alias("n_rows"), rate(moved).alias("movement_rate"), rate(F.col("balance").isNotNull()).alias("balance_rate"), F.count_if(F.col("status") == "MISMATCH").alias("mismatches"), F.count_if("gap_explained").alias("gaps"))


def quality_status(ledger: DataFrame) -> DataFrame:
    good = (F.col("movement_rate") >= 0.6) & (F.col("mismatches") == 0)
    return recovery_rates(ledger).withColumn("quality", F.when(good & (F.col("gaps") > 0), "PASS WITH SOURCE GAPS").when(good, "PASS").otherwise("REVIEW REQUIRED"))


# Shares of pages with text below which a statement is scanned, and is shown as scanned.
SCANNED_BELOW, SHOWN_SCANNED_BELOW = 0.5, 0.7


def text_modes(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ratio, source_type, mode): the share of pages with text of each document, what it is read as and what it is shown as."""
    ratio = F.round(F.avg((F.trim(F.coalesce(F.col(text), F.lit(""))) != "").cast("int")), 6)
    out = pages.groupBy(key).agg(ratio.alias("ratio"))
    kind = F.when(F.col("ratio") < SCANNED_BELOW, "PDF — Scanned/OCR").otherwise("PDF — Digital native")
    return out.withColumns({"source_type": kind, "mode": F.when(F.col("ratio") < SHOWN_SCANNED_BELOW, "Scanned").otherwise("Digital")})
