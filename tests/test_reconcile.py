"""Reconciliation, repairs, anchors and the solver on small ledgers and on random ones."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import gates, reconcile, solver
from tallyline.operators.joins import days_join

SCHEMA = "statement_id string, source_seq long, date date, narration string, debit double, credit double, balance double"


def ledger(spark, rows, statement="s"):
    day = datetime.date(2024, 1, 1)
    return spark.createDataFrame([(statement, k, day + datetime.timedelta(k), f"row {k}", d, c, b) for k, (d, c, b) in enumerate(rows)], SCHEMA)


def statuses(df):
    return [(r["status"], r["gap_explained"]) for r in df.orderBy("source_seq").collect()]


def test_statuses(spark):
    rows = [(None, None, 100.0), (None, 50.0, 150.0), (20.0, None, None), (None, None, 140.0), (30.0, None, 500.0), (None, 5.0, 505.0), (5.0, None, 500.0)]
    assert statuses(reconcile.balance_check(ledger(spark, rows))) == [("OPENING / REFERENCE", False), ("MATCH", False), ("NO REPORTED BALANCE", False), (reconcile.STATUSES[2], False), ("MISMATCH", True), ("MATCH", False), ("MATCH", False)]


def random_rows(n, seed):
    r, balance, rows = random.Random(seed), 1000.0, []
    for _ in range(n):
        amount, credit = r.randint(1, 90000) / 100, r.random() < 0.5
        balance = round(balance + (amount if credit else -amount), 2)
        rows.append((None, amount, balance) if credit else (amount, None, balance))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_flipped_sides_are_found(spark, seed):
    rows = random_rows(60, seed)
    turned = set(random.Random(seed + 9).sample(range(1, 60), 12))
    wrong = [(c, d, b) if k in turned else (d, c, b) for k, (d, c, b) in enumerate(rows)]
    clean = ledger(spark, rows)
    assert reconcile.balance_check(clean).where("status = 'MISMATCH'").count() == 0
    back = [tuple(r) for r in reconcile.repair_side(ledger(spark, wrong)).orderBy("source_seq").select("debit", "credit").collect()]
    assert back == [(d, c) for d, c, _ in rows]
    opening = spark.createDataFrame([("s", 1000.0)], "statement_id string, opening double")
    solved = [tuple(r) for r in solver.solve_printed(ledger(spark, wrong), opening).orderBy("source_seq").select("debit", "credit").collect()]
    assert solved == back
    searched = solver.solve_missing(ledger(spark, wrong).join(opening, "statement_id"))
    assert {r["source_seq"] for r in searched.where("swapped").collect()} == turned


def test_solver_fixture(spark):
    rows = [(100.0, None, 900.0), (None, 200.0, 700.0), (None, 500.0, 1200.0)]
    opening = spark.createDataFrame([("s", 1000.0)], "statement_id string, opening double")
    out = solver.solve_printed(ledger(spark, rows), opening).orderBy("source_seq").collect()
    assert [(r["debit"], r["credit"], r["swapped"]) for r in out] == [(100.0, None, False), (200.0, None, True), (None, 500.0, False)]
    assert {r["order"] for r in out} == {"source"}


@pytest.mark.parametrize("opening, rows, status", [(1000.0, [(None, 500.0, 1500.0), (100.0, None, 1400.0)], "VERIFIED"), (None, [(None, 500.0, 1500.0)], "NOT_PRESENT"), (1000.0, [(None, 500.0, 2000.0)], "CONFLICTING"), (1000.0, [(None, 500.0, None)], "AMBIGUOUS")])
def test_anchor(spark, opening, rows, status):
    known = spark.createDataFrame([("s", opening, "explicit_opening")], "statement_id string, opening double, source string")
    assert gates.opening_anchor(ledger(spark, rows), known).first()["status"] == status


def test_days_join_is_the_theta_join(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7 % 40).cast("int"))
    left = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"), day.alias("d1"))
    right = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"), F.date_add(day, 1).alias("d2"))
    plain = left.join(right.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & F.col("d2").between(F.col("d1"), F.date_add(F.col("d1"), 3))).select("a", "b")
    fast = days_join(left, right, ["k"], "d1", "d2", 3).select("a", "b")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, plain.collect()))


def test_empty(spark):
    assert reconcile.balance_check(ledger(spark, [])).count() == 0
    assert gates.integrity(ledger(spark, [])).count() == 0
