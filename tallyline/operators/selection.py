"""The choice of one extraction of each statement among several: every gate in order, then the best that is left.

Candidates are (statement_id, method, ledger columns). All of them are repaired and judged together, a candidate being a
statement of its own until the end, so the number of methods changes the number of rows and not the number of passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import candidates as C
from . import gates
from .joins import PARTS
from .reconcile import balance_check, evidence_order, repair_movement, repair_side, runs_back

#: The name of rows put together from several candidates.
CONSENSUS = "consensus"
#: Shares of rows with a balance that a text which speaks of balances lets expect, scanned and digital, and what is scanned.
SCANNED_SHARE, DIGITAL_SHARE, SCANNED_BELOW = 0.40, 0.90, 0.5


def proven(least: float = 0.95) -> Column:
    """Whether a candidate's own chain of balances proves it: ten rows or more, nearly all with movement and balance, no mismatch."""
    return (F.col("n_rows") >= 10) & (F.col("movement_rate") >= least) & (F.col("balance_rate") >= least) & (F.col("mismatches") == 0)


def _single(candidates: DataFrame) -> DataFrame:
    """Candidates as statements of their own: own is the statement, statement_id the candidate."""
    rows = candidates.withColumns({"own": F.col("statement_id"), "statement_id": F.concat_ws("\u0001", "statement_id", "method")})
    rows = rows if "source_text" in rows.columns else rows.withColumn("source_text", F.lit(None).cast("string"))
    return rows.repartition(PARTS, "statement_id")  # many windows widen the rows, so parts are of rows and not of the bytes before


def repaired(rows: DataFrame) -> DataFrame:
    """Rows in evidence order, with the sides and amounts that balances prove."""
    rows = evidence_order(rows).drop("source_seq").withColumnRenamed("place", "source_seq")
    return repair_side(repair_movement(rows).drop("flipped", "filled")).drop("flipped", "filled")


def judged(candidates: DataFrame, opening: DataFrame | None = None, summary: DataFrame | None = None, lenient: tuple[str, ...] = ()) -> DataFrame:
    """(statement_id, method, counts, score, opening_status, proven, requires_review, reason): every candidate, and the first gate
    that it fails; empty if none.

    Gates in order: acceptable figures; integrity after repairs; agreement with a printed summary (statement_id,
    withdrawal, deposit, closing); agreement with a printed opening (statement_id, opening, source), unless the
    candidate's own chain proves it, which then needs a review. A candidate of a lenient method, one whose
    columns are known, may have a single mismatch, and passes for review then whatever the summary and the opening say.
    All figures, before and after repairs, are windows of a candidate's rows and come from one grouping.
    """
    w = W.partitionBy("statement_id").orderBy("source_seq")
    before = F.last("date", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    alike = W.partitionBy("statement_id", F.coalesce("narration", F.lit("")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("date", "debit", "credit", "balance")))
    rows = balance_check(_single(candidates)).withColumns({"read_wrong": F.col("status") == "MISMATCH", "read_back": F.coalesce(F.datediff("date", before) < 0, F.lit(False)), "read_moved": F.col("debit").isNotNull() | F.col("credit").isNotNull(), "copies": F.count("*").over(alike)})
    rows = balance_check(repaired(rows.drop("status", "expected", "difference", "gap_explained"))).withColumn("back", runs_back())
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    out = rows.groupBy("own", "method").agg(
        F.count("*").alias("n_rows"), rate(F.col("read_moved")).alias("movement_rate"), rate(F.col("balance").isNotNull()).alias("balance_rate"), F.count_if("read_wrong").alias("mismatches"), F.count_if("read_back").alias("reversals"), F.count_if(F.col("copies") > 1).alias("duplicates"),
        *gates.integrity_counts(), *gates.own_totals(), F.min_by(F.struct("debit", "credit", "balance"), "source_seq").alias("first_row"),
    )
    out = out.withColumnRenamed("own", "statement_id").withColumn("score", C.score())
    out = C.acceptance(out)
    for table, columns in ((opening, {"opening": "double"}), (summary, {"withdrawal": "double", "deposit": "double", "closing": "double"})):
        out = out.join(table.select("statement_id", *columns), "statement_id", "left") if table is not None else out.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})
    spared = F.col("method").isin(*lenient) & (F.col("unmatched") == 1) if lenient else F.lit(False)
    out = out.withColumns({"opening_status": gates.anchor(F.col("first_row"), F.col("opening"))["status"], "proven": proven(), "spared": spared, "broken": gates.broken_rule(), "agrees": F.col("closing").isNull() | gates.agrees()})
    # An opening that can't be compared, for the first row lacks a balance or an amount, counts as a conflict.
    conflict = F.col("opening_status").isin("CONFLICTING", "AMBIGUOUS")
    reason = (
        F.when(F.col("reason") != "", F.col("reason")).when(~F.col("spared") & (F.col("broken") != ""), F.col("broken"))
        .when(~F.col("spared") & ~F.col("agrees"), "summary differs").when(~F.col("spared") & conflict & ~F.col("proven"), "opening differs").otherwise("")
    )
    out = out.withColumn("reason", reason).withColumn("requires_review", (F.col("reason") == "") & (conflict | F.col("spared")))
    return out.select("statement_id", "method", "n_rows", "movement_rate", "balance_rate", "mismatches", "reversals", "duplicates", "score", "opening_status", "proven", "requires_review", "reason")


def covered(texts: DataFrame) -> Column:
    """texts(speaks: the text speaks of balances, text_ratio): whether enough rows have a balance for such a text."""
    least = F.when(F.col("text_ratio") < SCANNED_BELOW, SCANNED_SHARE).otherwise(DIGITAL_SHARE)
    return ~F.coalesce("speaks", F.lit(False)) | (F.col("balance_rate") >= least)


def speaks_of_balances(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\bbalance\b"), F.lit(False))


def selected(candidates: DataFrame, methods: tuple[str, ...], opening: DataFrame | None = None, summary: DataFrame | None = None, texts: DataFrame | None = None, lenient: tuple[str, ...] = ()) -> DataFrame:
    """A row for each candidate that was judged, with `chosen` for the one taken of each statement and the reason against each other.

    The valid candidate of the highest score is taken, the earlier one in `methods` among equals. Statements without a valid one
    get a consensus: all rows of the first four methods once, judged like a candidate. texts: (statement_id, speaks, text_ratio);
    where they speak of balances and too few rows have one, the one taken is rejected in the end. No statement is dropped:
    one without any choice has rows with reasons only.
    """
    first = judged(candidates, opening, summary, lenient)
    order = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    best = W.partitionBy("statement_id").orderBy(F.desc(F.col("reason") == ""), F.desc("score"), order, "method")
    first = first.withColumn("chosen", (F.row_number().over(best) == 1) & (F.col("reason") == ""))
    none = first.withColumn("any", F.max("chosen").over(W.partitionBy("statement_id"))).where(~F.col("any")).select("statement_id", "method", "score")
    second = judged(consensus(candidates, none.where(F.col("method").isin(*methods[:4]))), opening, summary).withColumn("chosen", F.col("reason") == "")
    out = first.unionByName(second)
    if texts is not None:
        out = out.join(texts.select("statement_id", "speaks", "text_ratio"), "statement_id", "left")
        rare = F.col("chosen") & ~covered(texts)
        out = out.withColumns({"reason": F.when(rare, "balances too rare for the text").otherwise(F.col("reason")), "chosen": F.col("chosen") & ~rare}).drop("speaks", "text_ratio")
    return out


def consensus(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """All rows of the candidates in scores (statement_id, method, score) once, of equal ones that of the best, as a candidate of its own; numbered by date."""
    rows = C.merged(candidates, scores).drop("score")
    columns = [c for c in rows.columns if c not in ("method", "source_seq")]
    by = W.partitionBy("statement_id").orderBy(F.col("date").asc_nulls_last(), "source_seq", "method")
    return rows.withColumn("nth", F.row_number().over(by)).select(*columns, F.col("nth").cast("long").alias("source_seq"), F.lit(CONSENSUS).alias("method"))


def selected_rows(candidates: DataFrame, verdicts: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """The repaired rows of the candidates that were chosen, with their method, whether they need a review, and the row that a
    single mismatch leaves to be looked at."""
    chosen = verdicts.where("chosen").select("statement_id", "method", "requires_review")
    some = candidates.join(chosen.where(F.col("method") != CONSENSUS), ["statement_id", "method"])
    open_ = chosen.where(F.col("method") == CONSENSUS).select("statement_id", "requires_review")
    scores = verdicts.where(F.col("method").isin(*methods[:4])).join(open_, "statement_id", "left_semi").select("statement_id", "method", "score")
    rows = some.unionByName(consensus(candidates, scores).join(open_, "statement_id"), allowMissingColumns=True)
    checked = balance_check(repaired(_single(rows))).withColumn("look_at", F.col("status") == "MISMATCH")
    return checked.drop("statement_id").withColumnRenamed("own", "statement_id")
