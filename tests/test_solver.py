"""The solver against every choice of sides in every order of rows."""

import itertools
import random

from pyspark.sql import functions as F

from tallyline.operators import selection, solver
from tallyline.operators.joins import PARTS

SCHEMA = "statement_id string, source_seq long, date date, debit double, credit double, balance double, opening double, closing double"


def total(rows, opening, closing, swaps):
    """Score of one choice of sides for (debit, credit, balance) in order."""
    score, before = 0.0, opening
    for (debit, credit, balance), swap in zip(rows, swaps, strict=True):
        move = ((credit or 0) - (debit or 0)) * (-1 if swap else 1)
        score -= 4 if swap else 0
        if balance is None:
            score, before = score + 1, None if before is None else before + move
            continue
        off = None if before is None or (debit is None and credit is None) else abs(balance - before - move)
        score += -1 if off is None else 45 if off <= 0.01 else -min(80, 5 + off / 1000)
        before = balance
    known = [r for r in rows if r[2] is not None]
    if closing is not None and known:
        score += 80 if rows[-1][2] is not None and abs(rows[-1][2] - closing) <= 0.01 else -60
    return score


def statements():
    import datetime

    r, out = random.Random(2), []
    for k in range(40):
        n, balance = r.randint(1, 6), 1000.0
        opening, rows = (balance if k % 3 else None), []
        for seq in range(n):
            amount, debit = float(r.randint(1, 90) * 10), r.random() < 0.5
            balance += -amount if debit else amount
            wrong = r.random() < 0.3
            sides = (amount, None) if debit != wrong else (None, amount)
            if r.random() < 0.1:
                sides = (None, None)
            rows.append([seq, datetime.date(2024, 1, 1 + (n - seq if k % 5 == 0 else seq)), *sides, None if k % 2 and r.random() < 0.4 else balance])
        if k % 7 == 0:
            rows = [[n - 1 - x[0], *x[1:]] for x in rows]
        closing = None if k % 4 == 0 else balance if k % 4 < 3 else balance + 7
        out += [(f"s{k}", *x, opening, closing) for x in rows]
    return out


def test_best_of_all(spark):
    rows = statements()
    found = {}
    for x in solver.solve(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(x["statement_id"], {})[x["source_seq"]] = x
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        orders = {
            "source": sorted(own, key=lambda r: r[1]), "source_reversed": sorted(own, key=lambda r: -r[1]),
            "date": sorted(own, key=lambda r: (r[2], r[1])), "date_reversed": sorted(own, key=lambda r: (-r[2].toordinal(), r[1])),
        }
        scores = {}
        for name, part in orders.items():
            cells = [r[3:6] for r in part]
            scores[name] = max(total(cells, own[0][6], own[0][7], s) for s in itertools.product((False, True), repeat=len(part)))
        got = found[key]
        assert len(got) == len(own)
        name, score = next((x["order"], x["score"]) for x in got.values())
        assert abs(score - max(scores.values())) < 1e-6 and abs(scores[name] - score) < 1e-6
        part = orders[name]
        assert abs(total([r[3:6] for r in part], own[0][6], own[0][7], [got[r[1]]["swapped"] for r in part]) - score) < 1e-6


def test_closing_decides_the_order(spark):
    """Balances of a reversed statement fit in either order but for the closing one."""
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [("a", 0, day, None, 10.0, 110.0, None, 100.0), ("a", 1, day, None, None, 100.0, None, 100.0)]
    assert {x["order"] for x in solver.solve(spark.createDataFrame(rows, SCHEMA)).collect()} == {"source"}
    assert solver.solve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_sides_prove_nothing():
    """A row without an amount scores -1 where its balance is printed, whatever came before."""
    assert solver.beam([(None, None, 100.0)], 100.0) == (-1.0, [False])
    assert solver.beam([(None, None, None), (None, 5.0, 105.0)], 100.0) == (46.0, [False, False])


def test_wrong_side_is_found_from_the_balance(spark):
    import datetime

    day = datetime.date(2025, 1, 1)
    rows = [("a", 0, day, 100.0, None, 900.0, 1000.0, 1200.0), ("a", 1, day, None, 200.0, 700.0, 1000.0, 1200.0), ("a", 2, day, None, 500.0, 1200.0, 1000.0, 1200.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r["source_seq"], r["swapped"], r["order"]) for r in solver.solve(df).orderBy("source_seq").collect()] == [(0, False, "source"), (1, True, "source"), (2, False, "source")]
    sides = [(r["debit"], r["credit"]) for r in solver.solve_printed(df).orderBy("source_seq").collect()]
    assert sides == [(100.0, None), (200.0, None), (None, 500.0)]


def test_only_runs_are_searched(spark, monkeypatch):
    """A long statement with a missing balance now and then: the longest array that the search gets is a run."""
    import datetime

    balance, rows = 1000.0, []
    for k in range(400):
        amount, debit = 10.0 + k, k % 3 == 0
        balance += -amount if debit else amount
        shown = None if k % 10 in (3, 4) else balance
        wrong = k % 10 == 4
        rows.append(("a", k, datetime.date(2024, 1, 1) + datetime.timedelta(days=k), *((amount, None) if debit != wrong else (None, amount)), shown, 1000.0, None))
    df = spark.createDataFrame(rows, SCHEMA)
    open_runs = solver._variants(df).where("run_ends and run_rows > 1 and before is not null").groupBy("variant", "run").count()
    assert open_runs.agg({"count": "max"}).first()[0] == 3
    got = {r["source_seq"]: r["swapped"] for r in solver.solve(df).collect()}
    assert got == {k: k % 10 == 4 for k in range(400)}


def test_runs_without_proof_keep_their_sides(spark):
    """No balance before, or none behind: nothing is swapped."""
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [("a", 0, day, 5.0, None, None, None, None), ("a", 1, day, 7.0, None, 100.0, None, None), ("a", 2, day, None, 3.0, None, None, None), ("b", 0, day, 1.0, None, None, 9.0, None)]
    found = solver.solve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 4 and not any(r["swapped"] for r in found)


def test_rows_are_dealt_into_many_parts_before_they_widen(spark):
    """Parts of the four orders aren't those that Spark makes of the narrow rows' bytes."""
    rows = spark.createDataFrame([("s", k, None, None, 5.0, 5.0 * (k + 1)) for k in range(9)], "statement_id string, source_seq long, date date, debit double, credit double, balance double")
    assert solver.solve_printed(rows).rdd.getNumPartitions() == PARTS
    assert selection._single(rows.withColumn("method", F.lit("a"))).rdd.getNumPartitions() == PARTS
