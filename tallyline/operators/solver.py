"""Ledger solver: which order of rows and which sides fit the printed balances best.

A printed balance fixes the state, so a statement falls into runs, each of some rows without a balance and the one with
a balance that ends them. A run of one row is decided in a window, by the balance before it and its own. Only where
rows between two known balances lack theirs is there a choice to search: each such run is an array, and a beam over it
gives the sides of its rows. Runs that no balance ends, or that begin before any is known, have nothing to prove a swap and keep
their sides. So what a task searches is a run and never a statement.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import PARTS
from .reconcile import zero

ORDERS = ("source", "source_reversed", "date", "date_reversed")
HIT, FREE, OPEN, SWAP, WORST, CLOSE, FAR = 45.0, 1.0, -1.0, 4.0, 80.0, 80.0, -60.0


def _order(name: str) -> list:
    seq = F.col("source_seq")
    return {"source": [seq.asc()], "source_reversed": [seq.desc()], "date": [F.col("date").asc_nulls_last(), seq.asc()], "date_reversed": [F.col("date").desc_nulls_last(), seq.asc()]}[name]


def _closing_points(last: Column, closing: Column, known: Column, tolerance: float) -> Column:
    """What the printed closing balance says about the last row of an order."""
    return F.when(closing.isNull() | (known == 0), 0.0).when(F.abs(last - closing) <= tolerance, CLOSE).otherwise(FAR)


def _with(ledger: DataFrame, **tables: DataFrame | None) -> DataFrame:
    """ledger with a column from each of tables(statement_id, column); its own column, or nulls, without one."""
    for name, table in tables.items():
        if table is not None:
            ledger = ledger.drop(name).join(table, "statement_id", "left")
        elif name not in ledger.columns:
            ledger = ledger.withColumn(name, F.lit(None).cast("double"))
    return ledger


def _variants(rows: DataFrame) -> DataFrame:
    """Every row in every order: its place, the balance known before it, its run, and how many rows and balances the run has."""
    # Every row becomes four and wider here, so parts that Spark makes of so many bytes before would be too large after.
    rows, orders = rows.repartition(PARTS, "statement_id"), []
    for k, name in enumerate(ORDERS):
        w = W.partitionBy("statement_id").orderBy(*_order(name))
        above = w.rowsBetween(W.unboundedPreceding, -1)
        known = F.coalesce(F.last("balance", ignorenulls=True).over(above), F.col("opening"))
        orders.append(F.struct(F.lit(k).alias("variant"), F.row_number().over(w).alias("place"), F.count("balance").over(above).alias("run"), known.alias("before")))
    has = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    out = rows.withColumns({"has": has, "move": zero("credit") - zero("debit"), "v": F.array(*orders)})
    out = out.withColumn("v", F.explode("v")).select("*", "v.*").drop("v")
    run = W.partitionBy("statement_id", "variant", "run")
    return out.withColumns({"run_rows": F.count("*").over(run), "run_ends": F.count("balance").over(run) > 0})


def _local(rows: DataFrame, tolerance: float) -> DataFrame:
    """swapped and points of rows that are decided by themselves."""
    error = lambda m: F.abs(F.col("balance") - (F.col("before") + m))
    of = lambda m: F.when(F.col("balance").isNull(), FREE).when(F.col("before").isNull() | ~F.col("has"), OPEN).when(error(m) <= tolerance, HIT).otherwise(-F.least(F.lit(WORST), 5 + error(m) / 1000))
    plain, turned = of(F.col("move")), of(-F.col("move")) - SWAP
    # In a run of several rows the balance before isn't that of the row above, so it proves nothing here.
    single = (F.col("run_rows") == 1) & F.col("has")
    swapped = F.coalesce(single & (turned > plain), F.lit(False))
    return rows.withColumns({"swapped": swapped, "points": F.when(swapped, turned).otherwise(plain)})


def _searched(rows: DataFrame, width: int, tolerance: float) -> DataFrame:
    """swapped and points of the rows of runs, each run an array; the run's points are those of its last row."""
    @F.pandas_udf("struct<points: double, swaps: array<boolean>>")
    def search(has: pd.Series, moves: pd.Series, ends: pd.Series, start: pd.Series) -> pd.DataFrame:
        found = [beam([((None, m) if h else (None, None)) + (None if k + 1 < len(ms) else end,) for k, (h, m) in enumerate(zip(hs, ms, strict=True))], begin, None, width, tolerance) for hs, ms, end, begin in zip(has, moves, ends, start, strict=True)]
        return pd.DataFrame({"points": [x for x, _ in found], "swaps": [x for _, x in found]})

    cell = F.struct("place", "source_seq", "has", "move", "balance")
    runs = rows.groupBy("statement_id", "variant", "run").agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.first("before").alias("before"), F.first("closing").alias("closing"))
    part = lambda name: F.transform("cells", lambda c: c[name])
    runs = runs.withColumn("s", search(part("has"), part("move"), F.element_at("cells", -1)["balance"], F.col("before")))
    each = F.transform("cells", lambda c, i: c.withField("swapped", F.get("s.swaps", i)).withField("points", F.when(i == F.size("cells") - 1, F.col("s.points")).otherwise(0.0)))
    return runs.select("statement_id", "variant", "closing", F.inline(each))


def _best(rows: DataFrame, tolerance: float) -> DataFrame:
    """The rows of each statement's best order, earlier ones first among equals, with its score and name."""
    one = W.partitionBy("statement_id", "variant")
    last = _closing_points(F.max_by("balance", "place").over(one), F.col("closing"), F.count("balance").over(one), tolerance)
    rows = rows.withColumn("score", F.round(F.sum("points").over(one) + last, 6))
    rows = rows.withColumn("best", F.max(F.struct("score", (-F.col("variant")).alias("v"))).over(W.partitionBy("statement_id")))
    rows = rows.where(F.col("variant") == -F.col("best.v"))
    return rows.withColumn("order", F.element_at(F.array(*map(F.lit, ORDERS)), F.col("variant") + 1)).drop("best", "points", "variant", "closing")


def solve_printed(ledger: DataFrame, opening: DataFrame | None = None, closing: DataFrame | None = None, tolerance: float = 0.01) -> DataFrame:
    """Rows of statements that print every balance, in the best order, with sides swapped where that fits better.

    opening and closing: (statement_id, opening or closing) where they are printed. All orders are scored over one
    shuffle by statement. Rows around missing balances keep their sides here; `solve` searches them.
    """
    rows = _local(_variants(_with(ledger, opening=opening, closing=closing)), tolerance)
    out = _best(rows.drop("has", "move", "run", "before", "run_rows", "run_ends", "opening"), tolerance)
    side = lambda a, b: F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))
    out = out.withColumns({"new_debit": side("debit", "credit"), "new_credit": side("credit", "debit")}).drop("debit", "credit")
    return out.withColumnsRenamed({"new_debit": "debit", "new_credit": "credit"})


def beam(rows: list[tuple], opening: float | None, closing: float | None = None, width: int = 512, tolerance: float = 0.01) -> tuple[float, list[bool]]:
    """Best score and which rows to swap, for (debit, credit, balance) in order; states are running balances, `width` at most."""
    states: dict[float | None, tuple[float, tuple]] = {None if opening is None else round(opening, 2): (0.0, ())}
    for debit, credit, balance in rows:
        move = None if debit is None and credit is None else (credit or 0.0) - (debit or 0.0)
        after: dict[float | None, tuple[float, tuple]] = {}
        for before, (score, path) in states.items():
            for swap in (False,) if move is None else (False, True):
                known = before is not None and move is not None
                then = before + (-move if swap else move) if known else before
                if balance is None:
                    gain, state = FREE, None if then is None else round(then, 2)
                else:
                    error = abs(balance - then) if known else None
                    gain, state = OPEN if error is None else HIT if error <= tolerance else -min(WORST, 5 + error / 1000), round(balance, 2)
                value = score + gain - SWAP * swap
                if state not in after or value > after[state][0]:
                    after[state] = (value, (path, swap))
        states = after if len(after) <= width else dict(sorted(after.items(), key=lambda x: -x[1][0])[:width])
    score, path = max(states.values(), key=lambda x: x[0])
    if closing is not None and any(r[2] is not None for r in rows):
        last = rows[-1][2]
        score += CLOSE if last is not None and abs(last - closing) <= tolerance else FAR
    swaps: list[bool] = []
    while path:
        path, swap = path
        swaps.append(swap)
    return score, swaps[::-1]


def solve(ledger: DataFrame, opening: DataFrame | None = None, closing: DataFrame | None = None, width: int = 512, tolerance: float = 0.01, least: int = 2) -> DataFrame:
    """(statement_id, source_seq, swapped, score, order) of all rows, in each statement's best order; runs of `least` rows or more are searched."""
    rows = _with(ledger, opening=opening, closing=closing).select("statement_id", "source_seq", "date", "debit", "credit", "balance", "opening", "closing")
    rows = _variants(rows)
    open_ = F.col("run_ends") & (F.col("run_rows") >= least) & F.col("before").isNotNull()
    columns = ("statement_id", "source_seq", "variant", "place", "balance", "closing", "swapped", "points")
    own = _local(rows.where(~open_), tolerance).select(*columns)
    found = _searched(rows.where(open_), width, tolerance).select(*columns)
    return _best(own.unionByName(found), tolerance).select("statement_id", "source_seq", "swapped", "score", "order")


def solve_missing(ledger: DataFrame, width: int = 512) -> DataFrame:
    """`solve` by search alone, of single rows as well; what the windows of `solve` must agree with."""
    return solve(ledger, width=width, least=1)
