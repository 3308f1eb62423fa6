"""Tables for reports: what a workbook or a page would show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reconcile import zero


def transactions(ledger: DataFrame) -> DataFrame:
    """Rows as text: blanks as dashes, the side without an amount as zero."""
    money = lambda x: F.when(x.isNotNull(), F.format_string("%.2f", x))
    dash = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    other = lambda a, b: F.when(F.col(a).isNotNull(), money(F.col(a))).when(F.col(b).isNotNull(), "0.00").otherwise("-")
    return ledger.select("statement_id", "source_seq", F.coalesce(F.date_format("date", "dd-MM-yyyy"), F.lit("-")).alias("date"), dash("narration").alias("narration"), dash("reference").alias("reference"), other("debit", "credit").alias("debit"), other("credit", "debit").alias("credit"), F.coalesce(money(F.col("balance")), F.lit("-")).alias("balance"))


def extraction_confidence(ledger: DataFrame) -> DataFrame:
    """Points for what a row has: date, movement, balance, a telling narration, a page."""
    size = F.length(F.trim(F.coalesce("narration", F.lit(""))))
    points = F.when(F.col("date").isNotNull(), 25).otherwise(0) + F.when((zero("debit") > 0) | (zero("credit") > 0), 25).otherwise(0) + F.when(zero("balance") > 0, 20).otherwise(0)
    points = points + F.when(size > 50, 15).when(size > 20, 10).when(size > 0, 5).otherwise(0)
    if "source_page" in ledger.columns:
        points = points + F.when(F.col("source_page").isNotNull(), 15).otherwise(0)
    return ledger.withColumn("confidence", points)


def _in_period(ledger: DataFrame, periods: DataFrame) -> DataFrame:
    rows = ledger.join(periods, "statement_id", "left")
    inside = F.col("first_day").isNull() | F.col("last_day").isNull() | F.col("date").isNull() | F.col("date").between(F.col("first_day"), F.col("last_day"))
    return rows.withColumn("inside", inside).drop("first_day", "last_day")


def period_guard(ledger: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows within the statement's printed period (statement_id, first_day, last_day); all rows where none is printed."""
    return _in_period(ledger, periods).where("inside").drop("inside")


def period_removed(ledger: DataFrame, periods: DataFrame) -> DataFrame:
    """(statement_id, removed) rows of each statement that its printed period leaves out."""
    return _in_period(ledger, periods).groupBy("statement_id").agg(F.count_if(~F.col("inside")).alias("removed"))


def kpis(enriched: DataFrame) -> DataFrame:
    """Counts and sums of a statement, and the share of flagged rows in whole per cent."""
    flagged = F.count_if(F.col("priority") != "NORMAL")
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")), F.lit(0)).cast("double")
    return enriched.groupBy("statement_id").agg(F.count("*").alias("n_rows"), total("credit").alias("credits"), total("debit").alias("debits"), flagged.alias("flagged"), F.floor(100 * flagged / F.count("*")).alias("flagged_percent"))


# The executive figures, in order.
SUMMARY = ("Source", "Period", "Transactions", "Total Credits", "Total Debits", "Net Flow", "Review", "Critical", "Balance Mismatches", "Balance Evidence Gaps")


def summary(enriched: DataFrame, rates: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(statement_id, place, metric, value, value_text): the ten executive figures of each statement, from its enriched rows and
    its recovery rates; sources: (statement_id, source_type, location), where they came from, else dashes."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")), F.lit(0)).cast("decimal(28,2)")
    base = enriched.groupBy("statement_id").agg(F.count("*").alias("all"), total("credit").alias("c"), total("debit").alias("d"), F.count_if(F.col("priority") == "REVIEW").alias("review"), F.count_if(F.col("priority") == "CRITICAL").alias("critical"))
    out = base.join(rates.select("statement_id", "mismatches", "gaps"), "statement_id")
    if sources is not None:
        out = out.join(sources.select("statement_id", "source_type", "location"), "statement_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit("-")) if sources is not None else F.lit("-")
    none, number = F.lit(None), lambda x: x.cast("double")
    values = [none.cast("double")] * 2 + [number(x) for x in (F.col("all"), F.col("c"), F.col("d"), F.col("c") - F.col("d"), F.col("review"), F.col("critical"), F.col("mismatches"), F.col("gaps"))]
    texts = [text("source_type"), text("location")] + [none.cast("string")] * 8
    cells = F.array(*(F.struct(F.lit(k + 1).alias("place"), F.lit(name).alias("metric"), values[k].alias("value"), texts[k].alias("value_text")) for k, name in enumerate(SUMMARY)))
    return out.select("statement_id", F.inline(cells))


def report_profile(profile: DataFrame, by: str, most: int = 20) -> DataFrame:
    """The rows of a profile with the most transactions, for a report; ties by name."""
    return profile.orderBy(F.desc("n_rows"), F.asc_nulls_first(by)).limit(most)


def first_rows(rows: DataFrame, most: int, *order: str, keys: tuple[str, ...] = ("statement_id",)) -> DataFrame:
    """The first `most` rows of each statement in this order, with their place; what a page or a report shows."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def report_fund_flow(pairs: DataFrame, most: int = 40) -> DataFrame:
    """The first onward movements of each statement for a report, in source order."""
    return first_rows(pairs, most, "in_date", "in_seq", "out_seq", "debit")


def assistant_context(master: DataFrame, flags: DataFrame, pairs: DataFrame, quality: DataFrame, flagged: int = 60, moved: int = 40) -> DataFrame:
    """(statement_id, part, place, entry): what an assistant would be told of each statement, as JSON entries: all main
    figures, the first flagged rows and onward movements, all counters of quality. Nothing is sent anywhere."""
    parts = {"summary": master, "top_review_rows": first_rows(flags, flagged, "source_seq"), "fund_flow": report_fund_flow(pairs, moved), "data_quality": quality}
    out = [rows.select("statement_id", F.lit(name).alias("part"), "place", F.to_json(F.struct(*(c for c in rows.columns if c not in ("statement_id", "place")))).alias("entry")) for name, rows in parts.items()]
    return reduce(DataFrame.unionByName, out)


def quick_summary(enriched: DataFrame, rates: DataFrame) -> DataFrame:
    """The counters that stand in for an assistant's answer: rows, priorities, rapid movements and mismatches of each statement."""
    counts = enriched.groupBy("statement_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("priority") == "REVIEW").alias("review"), F.count_if(F.col("priority") == "CRITICAL").alias("critical"), F.count_if("rapid").alias("rapid"))
    return counts.join(rates.select("statement_id", "mismatches"), "statement_id")


def provenance(ledger: DataFrame) -> DataFrame:
    """Rows by where they came from; nulls are a group."""
    places = [c for c in ("source_sheet", "source_page") if c in ledger.columns]
    return ledger.groupBy("statement_id", *places).agg(F.count("*").alias("n_rows"))


def projected(ledger: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """The required columns first, then the others, without a second date; an error names what is missing."""
    if missing := [c for c in required if c not in ledger.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return ledger.select(*required, *(c for c in ledger.columns if c not in required and c != "value_date"))
