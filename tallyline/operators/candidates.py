"""Choosing between competing extractions of one statement: (statement_id, method, ledger columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .findings import cents
from .reconcile import balance_check, repair_side


def row_key() -> list[Column]:
    """Date and amounts to the cent as text, blanks for nulls."""
    return [F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("k_date"), *(F.coalesce(cents(c).cast("string"), F.lit("")).alias(f"k_{c}") for c in ("debit", "credit", "balance"))]


KEYS = ["statement_id", "k_date", "k_debit", "k_credit", "k_balance"]


def keep_first(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, in source order."""
    w = W.partitionBy(*keys).orderBy("source_seq")
    return ledger.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def score() -> Column:
    """Quality of a candidate by its figures."""
    points = 0.25 * F.least("n_rows", F.lit(10000)) + 100 * F.col("movement_rate") + 70 * F.col("balance_rate") - 35 * F.col("mismatches") - 2 * F.col("duplicates") - 10 * F.col("reversals")
    return F.round(points, 4)


def stats(candidates: DataFrame) -> DataFrame:
    """Rows, rates, mismatches, repeated rows and date reversals of each candidate, and its score."""
    each = candidates.withColumn("own", F.col("statement_id")).withColumn("statement_id", F.concat_ws("\u0001", "statement_id", "method"))
    w = W.partitionBy("statement_id").orderBy("source_seq")
    rows = balance_check(each).withColumn("back", F.coalesce(F.datediff("date", F.last("date", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))) < 0, F.lit(False)))
    keyed = rows.select("statement_id", F.coalesce("narration", F.lit("")).alias("k_text"), *row_key())
    repeated = keyed.groupBy(*KEYS, "k_text").agg(F.count("*").alias("n")).where("n > 1").groupBy("statement_id").agg(F.sum("n").alias("duplicates"))
    moved = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    out = rows.groupBy("statement_id", "own", "method").agg(F.count("*").alias("n_rows"), F.round(F.avg(moved.cast("int")), 6).alias("movement_rate"), F.round(F.avg(F.col("balance").isNotNull().cast("int")), 6).alias("balance_rate"), F.count_if(F.col("status") == "MISMATCH").alias("mismatches"), F.count_if("back").alias("reversals"))
    out = out.join(repeated, "statement_id", "left").withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))
    return out.drop("statement_id").withColumnRenamed("own", "statement_id").withColumn("score", score())


def acceptance(found: DataFrame) -> DataFrame:
    """The first reason against each candidate, or none."""
    reason = (
        F.when(F.col("n_rows") < 10, "too few rows").when(F.col("movement_rate") < 0.95, "movements missing").when(F.col("balance_rate") < 0.40, "balances missing")
        .when(F.col("mismatches") > F.greatest(F.lit(5), F.floor(F.col("n_rows") * 0.25)), "too many mismatches").otherwise("")
    )
    return found.withColumn("reason", reason).withColumn("accepted", reason == "")


def ranked(found: DataFrame) -> DataFrame:
    """Candidates of a statement from best to worst: proven first, then fewest mismatches, rates, rows."""
    w = W.partitionBy("statement_id").orderBy(F.desc(F.col("mismatches") == 0), "mismatches", F.desc("movement_rate"), F.desc("balance_rate"), F.desc("n_rows"), "method")
    return found.withColumn("place", F.row_number().over(w))


def merged(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """All rows of all candidates once; of equal rows that of the best candidate."""
    rows = candidates.join(scores.select("statement_id", "method", "score"), ["statement_id", "method"]).select("*", *row_key())
    w = W.partitionBy(*KEYS).orderBy(F.desc("score"), "method", "source_seq")
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", *KEYS[1:])


def consensus(base: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of base that other has too; base's own rows stay as well if base has no mismatch, or if none are shared."""
    keyed, there = base.select("*", *row_key()), other.select("statement_id", *row_key()).distinct()
    marked = keyed.join(there.withColumn("shared", F.lit(True)), KEYS, "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    proof = balance_check(base).groupBy("statement_id").agg(F.count_if(F.col("status") == "MISMATCH").alias("wrong"))
    any_shared = marked.groupBy("statement_id").agg(F.max("shared").alias("any_shared"))
    out = marked.join(proof, "statement_id").join(any_shared, "statement_id")
    return out.where(F.col("shared") | (F.col("wrong") == 0) | ~F.col("any_shared")).drop("shared", "wrong", "any_shared", *KEYS[1:])


def normalized(rows: DataFrame) -> DataFrame:
    """Candidate rows with all ledger columns, amounts and dates in their types, undated rows left out.

    Where a statement has a row with both sides, its sides are put right as far as balances prove them.
    """
    kinds = {"debit": "double", "credit": "double", "balance": "double", "source_page": "int", "source_row": "long", "narration": "string", "reference": "string"}
    out = rows.withColumns({c: (F.col(c).try_cast(kind) if c in rows.columns else F.lit(None).cast(kind)) for c, kind in kinds.items()})
    out = out.withColumn("date", F.col("date").try_cast("date")).where(F.col("date").isNotNull())
    dual = F.max(F.col("debit").isNotNull() & F.col("credit").isNotNull()).over(W.partitionBy("statement_id"))
    out = repair_side(out.withColumn("any_dual", dual))
    back = F.col("flipped") & ~F.col("any_dual")
    side = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    return out.withColumns({"debit": side("debit", "credit"), "credit": side("credit", "debit")}).drop("any_dual", "flipped", "filled")


def deduplicated(rows: DataFrame) -> DataFrame:
    """The first of equal rows of each candidate: by page and row of the source where all of a candidate's rows have one, for two
    rows may well be alike; else by date, narration and amounts."""
    keys = [c for c in ("statement_id", "method") if c in rows.columns]
    placed = F.min(F.col("source_row").isNotNull()).over(W.partitionBy(*keys)) if "source_row" in rows.columns else F.lit(False)
    page = F.col("source_page") if "source_page" in rows.columns else F.lit(None).cast("int")
    identity = F.when(F.col("placed"), F.to_json(F.struct(page.alias("p"), (F.col("source_row") if "source_row" in rows.columns else F.lit(None).cast("long")).alias("r"))))
    values = F.to_json(F.struct("date", "narration", "debit", "credit", "balance"))
    out = rows.withColumn("placed", placed).withColumn("same", F.when(F.col("placed"), F.concat(F.lit("row "), identity)).otherwise(values))
    return keep_first(out, [*keys, "same"]).drop("placed", "same")


def review_marks(ledger: DataFrame) -> DataFrame:
    """Rows of a statement with a single mismatch, that row marked for review with its difference."""
    checked = balance_check(ledger)
    one = checked.where("status = 'MISMATCH'").groupBy("statement_id").agg(F.count("*").alias("wrong")).where("wrong = 1")
    mark = (F.col("status") == "MISMATCH") & F.col("wrong").isNotNull()
    return checked.join(one, "statement_id", "left").withColumn("review", F.coalesce(mark, F.lit(False))).drop("wrong")


def upserted(history: DataFrame, key: str, time: str, most: int = 25) -> DataFrame:
    """The latest entry of each key, and of those the latest `most`."""
    last = history.groupBy(key).agg(F.max_by(F.struct(*history.columns), time).alias("e")).select("e.*")
    return last.orderBy(F.desc(time), key).limit(most)
