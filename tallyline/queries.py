"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import candidates as C
from .operators import exports, findings, gates, layout, reconcile, selection, solver
from .plans import ledgers as L
from .sources import cells as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if there is one."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DEBITS, CREDITS = "FROM flows WHERE date IS NOT NULL AND debit >= {}", "FROM flows WHERE date IS NOT NULL AND credit >= {}"
PARTY = "trim(regexp_replace(regexp_replace(upper(party), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def pairs_sql(least_in: float, least_out: float, days: int, also: str) -> str:
    """Pairs by equality of statement and bucket of days; a credit is in the bucket of its date and the one after."""
    bucket = f"(date - DATE '1970-01-01') // {days + 1}"
    return f"""WITH {L.FLOWS_SQL}, c AS (SELECT statement_id, source_seq AS in_seq, date AS in_date, credit, {PARTY} AS in_party, unnest([{bucket}, {bucket} + 1]) AS in_bucket {CREDITS.format(least_in)}),
d AS (SELECT statement_id AS sid, source_seq AS out_seq, date AS out_date, debit, {PARTY} AS out_party, {bucket} AS out_bucket {DEBITS.format(least_out)}),
pairs AS (SELECT * FROM c JOIN d ON sid = statement_id AND out_bucket = in_bucket AND out_date BETWEEN in_date AND in_date + {days} AND {also})"""


FLOW_SQL = pairs_sql(100_000, 80_000, 1, "debit >= 0.8 * credit")
BRIDGE_SQL = pairs_sql(50_000, 50_000, 3, "debit BETWEEN credit * 0.97 AND credit * 1.03") + """, scored AS (SELECT *, out_date - in_date AS days_gap,
  CASE WHEN abs(debit / credit - 1) <= 0.01 THEN 40 WHEN abs(debit / credit - 1) <= 0.03 THEN 25 ELSE 0 END + CASE WHEN out_date - in_date <= 1 THEN 30 ELSE 15 END
  + CASE WHEN in_party <> '' AND in_party = out_party THEN 20 ELSE 0 END AS score FROM pairs)"""
CENTS = "coalesce(SUM(CAST({} AS DECIMAL(18,2))), 0)"


def sums(x: str) -> str:
    return f"CAST({CENTS.format(x)} AS DOUBLE)"


@query(BRIDGE_SQL + " SELECT statement_id, in_seq, out_seq, in_date, out_date, credit, debit, CAST(days_gap AS INTEGER) AS days_gap, CAST(score AS INTEGER) AS score FROM scored")
def bridge(spark, d):
    return findings.bridge(L.flows(spark, d)).select("statement_id", "in_seq", "out_seq", "in_date", "out_date", "credit", "debit", "days_gap", "score")


@query(FLOW_SQL + " SELECT statement_id, in_seq, out_seq, in_date, out_date, credit, debit FROM pairs")
def fund_flow(spark, d):
    return findings.fund_flow(L.flows(spark, d)).select("statement_id", "in_seq", "out_seq", "in_date", "out_date", "credit", "debit")


@query(FLOW_SQL + """ SELECT f.statement_id, f.source_seq, f.date, f.debit, f.credit FROM flows f WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.statement_id = f.statement_id AND f.source_seq IN (p.in_seq, p.out_seq))""")
def rapid_movement(spark, d):
    return findings.rapid_movement(L.flows(spark, d)).select("statement_id", "source_seq", "date", "debit", "credit")


@query(pairs_sql(50_000, 50_000, 3, "in_party = out_party AND in_party <> '' AND debit / credit BETWEEN 0.9 AND 1.1") + " SELECT DISTINCT statement_id, in_seq, out_seq, in_date, out_date, credit, debit, in_party AS party FROM pairs")
def circles(spark, d):
    return findings.circles(L.flows(spark, d)).select("statement_id", "in_seq", "out_seq", "in_date", "out_date", "credit", "debit", F.col("in_party").alias("party"))


@query(BRIDGE_SQL + """ SELECT statement_id, in_seq, out_seq, debit, place, CASE WHEN score >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM
 (SELECT *, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY score DESC, in_date, in_seq, out_seq, debit) AS INTEGER) AS place FROM scored) WHERE place <= 250""")
def chains(spark, d):
    return findings.chains(L.flows(spark, d)).select("statement_id", "in_seq", "out_seq", "debit", "place", "priority")


@query(f"""WITH {L.ACCOUNTS_SQL}, g AS (SELECT *, CAST(date - lag(date) OVER (PARTITION BY statement_id ORDER BY date, source_seq) AS INTEGER) AS gap_days FROM accounts)
SELECT statement_id, source_seq, date, gap_days FROM g WHERE gap_days >= 90 AND coalesce(debit, 0) + coalesce(credit, 0) >= 100000""")
def dormant(spark, d):
    return findings.dormant(L.accounts(spark, d)).select("statement_id", "source_seq", "date", "gap_days")


@query(f"""WITH {L.FLOWS_SQL}, a AS (SELECT *, {PARTY} AS party_key, coalesce(debit, 0) + coalesce(credit, 0) AS amount FROM flows),
m AS (SELECT statement_id, party_key, median(amount) AS median_amount, count(*) AS n FROM a WHERE amount > 0 AND party_key <> '' GROUP BY ALL HAVING count(*) >= 3)
SELECT a.statement_id, source_seq, date, amount, round(median_amount, 4) AS median_amount, n AS party_rows FROM a JOIN m USING (statement_id, party_key) WHERE amount >= 50000 AND amount >= 3 * median_amount""")
def behaviour(spark, d):
    return findings.behaviour(L.flows(spark, d)).select("statement_id", "source_seq", "date", "amount", F.round("median_amount", 4).alias("median_amount"), "party_rows")


@query(f"""WITH {L.FLOWS_SQL}, x AS (SELECT * REPLACE (floor(debit / 10000) * 10000 AS debit, floor(credit / 10000) * 10000 AS credit) FROM flows),
c AS (SELECT *, count(*) OVER (PARTITION BY statement_id, date, debit, credit) AS n FROM x) SELECT statement_id, source_seq, date, debit, credit FROM c WHERE n > 1""")
def duplicates(spark, d):
    return findings.duplicates(_floored(spark, d)).select("statement_id", "source_seq", "date", "debit", "credit")


def _floored(spark, d):
    return L.flows(spark, d).withColumns({c: (F.floor(F.col(c) / 10000) * 10000).cast("double") for c in ("debit", "credit")})


@query(f"""WITH {L.FLOWS_SQL}, x AS (SELECT *, floor((coalesce(debit, 0) + coalesce(credit, 0)) / 10000) * 10000 AS amount, {PARTY} AS p FROM flows),
c AS (SELECT *, count(*) OVER (PARTITION BY statement_id, date, amount, p) AS n FROM x) SELECT statement_id, source_seq, date, p AS party, n AS copies FROM c WHERE n > 1""")
def fingerprints(spark, d):
    return findings.fingerprints(_floored(spark, d)).select("statement_id", "source_seq", "date", T.party(F.col("party")).alias("party"), "copies")


@query(f"WITH {L.FLOWS_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY statement_id, date) AS n FROM flows) SELECT statement_id, source_seq, date, n AS day_rows FROM c WHERE n >= 15")
def velocity(spark, d):
    return findings.velocity(L.flows(spark, d)).select("statement_id", "source_seq", "date", "day_rows")


@query(f"WITH {L.FLOWS_SQL}, x AS (SELECT *, floor((coalesce(debit, 0) + coalesce(credit, 0)) / 10000) * 10000 AS amount FROM flows) SELECT statement_id, source_seq, CAST(amount AS DOUBLE) AS amount FROM x WHERE amount >= 50000")
def round_values(spark, d):
    return findings.round_values(_floored(spark, d)).select("statement_id", "source_seq", findings.amount().alias("amount"))


TOTALS = f"SELECT statement_id, count(*) AS n_rows, {sums('credit')} AS credits, {sums('debit')} AS debits, CAST({CENTS.format('credit')} - {CENTS.format('debit')} AS DOUBLE) AS net, min(date) AS first_date, max(date) AS last_date FROM flows GROUP BY statement_id"


@query(f"WITH {L.FLOWS_SQL} {TOTALS}")
def ledger_totals(spark, d):
    return findings.totals(L.flows(spark, d))


@query(f"""WITH {L.FLOWS_SQL}, a AS (SELECT statement_id, coalesce(debit, 0) + coalesce(credit, 0) AS amount FROM flows)
SELECT statement_id, round(quantile_cont(amount, 0.95), 4) AS q95, round(quantile_cont(amount, 0.99), 4) AS q99 FROM a WHERE amount > 0 GROUP BY statement_id""")
def amount_percentiles(spark, d):
    return findings.percentiles(L.flows(spark, d))


@query(f"""WITH {L.FLOWS_SQL}, f AS (SELECT * REPLACE (CASE WHEN source_seq % 5 = 0 THEN ' - ' WHEN source_seq % 7 = 0 THEN 'n/a' ELSE party END AS party) FROM flows),
p AS (SELECT statement_id, {PARTY} AS party_key, count(*) AS n_rows, {CENTS.format('credit')} AS c, {CENTS.format('debit')} AS d, min(date) AS first_date, max(date) AS last_date FROM f GROUP BY ALL),
k AS (SELECT *, sum(c) OVER (PARTITION BY statement_id) AS credits, sum(d) OVER (PARTITION BY statement_id) AS debits FROM p WHERE party_key NOT IN ('', 'N A', 'NA', 'UNKNOWN'))
SELECT statement_id, party_key, n_rows, CAST(c AS DOUBLE) AS party_credits, CAST(d AS DOUBLE) AS party_debits, round(CAST(c AS DOUBLE) / CAST(credits AS DOUBLE), 6) AS credit_share, round(CAST(d AS DOUBLE) / CAST(debits AS DOUBLE), 6) AS debit_share, first_date, last_date,
  CAST(row_number() OVER (PARTITION BY statement_id ORDER BY c DESC, d DESC, party_key) AS INTEGER) AS place FROM k""")
def concentration(spark, d):
    """Some rows without a party: shares are of those with one."""
    k = F.col("source_seq")
    rows = L.flows(spark, d).withColumn("party", F.when(k % 5 == 0, " - ").when(k % 7 == 0, "n/a").otherwise(F.col("party")))
    return findings.concentration(rows).drop("net")


#: What the narrations of `accounts` name, by their form (see ledgers); written out apart from the library's rules.
RAIL = """CASE source_seq % 12 WHEN 0 THEN 'UPI' WHEN 1 THEN 'NEFT' WHEN 2 THEN 'ATM/CASH' WHEN 3 THEN 'IMPS' WHEN 4 THEN 'CARD' WHEN 5 THEN 'LOAN/FINANCE' WHEN 6 THEN 'INTEREST'
  WHEN 7 THEN 'ATM/CASH' WHEN 8 THEN 'CHEQUE' WHEN 9 THEN 'TRANSFER' WHEN 10 THEN 'RECHARGE/UTILITY' ELSE 'OTHER / UNIDENTIFIED' END"""
CATEGORY = """CASE WHEN source_seq % 12 IN (0, 3, 9) THEN 'Other Debit / Expense' WHEN source_seq % 12 IN (1, 8, 11) THEN 'Other Credit / Receipt' WHEN source_seq % 12 = 2 THEN 'Cash Withdrawal'
  WHEN source_seq % 12 = 4 THEN 'Online / Merchant' WHEN source_seq % 12 = 5 THEN 'Loan / Finance' WHEN source_seq % 12 = 6 THEN 'Interest' WHEN source_seq % 12 = 7 THEN 'Cash Deposit' ELSE 'Recharge / Utility' END"""
RICH_SQL = f"""{L.ACCOUNTS_SQL}, named AS (SELECT *, {RAIL} AS rail, {CATEGORY} AS category, coalesce(debit, 0) + coalesce(credit, 0) AS amount FROM accounts),
q AS (SELECT statement_id, round(quantile_cont(amount, 0.95), 4) AS q95, round(quantile_cont(amount, 0.99), 4) AS q99 FROM named WHERE amount > 0 GROUP BY statement_id),
marks AS (SELECT DISTINCT a.statement_id, a.source_seq AS i, b.source_seq AS o FROM accounts a JOIN accounts b ON a.statement_id = b.statement_id AND a.credit >= 100000 AND b.debit >= 80000 AND b.debit >= 0.8 * a.credit AND b.date BETWEEN a.date AND a.date + 1),
rich AS (SELECT n.*, EXISTS (SELECT 1 FROM marks m WHERE m.statement_id = n.statement_id AND n.source_seq IN (m.i, m.o)) AS rapid,
  CASE WHEN amount > 0 AND amount >= q99 THEN 'Top 1% by transaction amount' WHEN amount > 0 AND amount >= q95 THEN 'Top 5% by transaction amount' END AS top, q99 FROM named n LEFT JOIN q USING (statement_id)),
final AS (SELECT *, concat_ws('; ', top, CASE WHEN rail = 'OTHER / UNIDENTIFIED' THEN 'Payment rail not identified from narration' END, CASE WHEN rapid THEN 'Same/next-day large onward movement' END) AS reason FROM rich),
enriched AS (SELECT *, CASE WHEN amount >= greatest(coalesce(q99, 0), 1000000) OR rapid THEN 'CRITICAL' WHEN reason <> '' THEN 'REVIEW' ELSE 'NORMAL' END AS priority FROM final)"""


def _enriched(spark, d):
    return findings.enrich(L.accounts(spark, d))


@query(f"WITH {RICH_SQL} SELECT statement_id, source_seq, rail, category, rapid, reason, priority FROM enriched")
def enrich(spark, d):
    return _enriched(spark, d).select("statement_id", "source_seq", "rail", "category", "rapid", "reason", "priority")


@query(f"WITH {RICH_SQL} SELECT statement_id, source_seq, reason, priority FROM enriched WHERE priority <> 'NORMAL'")
def flags(spark, d):
    return findings.flags(_enriched(spark, d)).select("statement_id", "source_seq", "reason", "priority")


def profile_sql(by: str) -> str:
    return f"SELECT {by}, count(*) AS n_rows, {sums('credit')} AS credits, {sums('debit')} AS debits FROM named GROUP BY {by}"


def _named(spark, d):
    rows = L.accounts(spark, d)
    evidence = F.concat_ws(" ", "narration", "reference")
    return rows.withColumns({"rail": T.rail(evidence), "category": T.category(evidence, F.col("debit"), F.col("credit"))})


NAMED_SQL = f"{L.ACCOUNTS_SQL}, named AS (SELECT *, {RAIL} AS rail, {CATEGORY} AS category FROM accounts)"


@query(f"WITH {NAMED_SQL} {profile_sql('rail')}")
def rail_profile(spark, d):
    return findings.profile(_named(spark, d), "rail")


@query(f"WITH {NAMED_SQL} {profile_sql('category')}")
def category_profile(spark, d):
    return findings.profile(_named(spark, d), "category")


@query(f"WITH {NAMED_SQL}, r AS ({profile_sql('rail')}), c AS ({profile_sql('category')}) SELECT 'Rail' AS section, rail AS name, n_rows, credits, debits FROM r UNION ALL SELECT 'Category', category, n_rows, credits, debits FROM c")
def export_flow(spark, d):
    return findings.flow(_named(spark, d))


@query(f"""WITH {RICH_SQL} SELECT statement_id, count(*) AS n_rows, {sums('credit')} AS credits, {sums('debit')} AS debits, count(*) FILTER (WHERE priority <> 'NORMAL') AS flagged,
 CAST(floor(100 * count(*) FILTER (WHERE priority <> 'NORMAL') / count(*)) AS BIGINT) AS flagged_percent FROM enriched GROUP BY statement_id""")
def kpis(spark, d):
    return exports.kpis(_enriched(spark, d))


CHECK_SQL = f"""{L.FAULTY_SQL}, s AS (SELECT *, coalesce(credit, 0) - coalesce(debit, 0) AS move, last_value(balance IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY source_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  count(*) OVER (PARTITION BY statement_id ORDER BY source_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest FROM faulty),
l AS (SELECT *, lead(balance, 1) OVER w AS b1, lead(balance, 2) OVER w AS b2, lead(move, 1) OVER w AS m1, lead(move, 2) OVER w AS m2 FROM s WINDOW w AS (PARTITION BY statement_id ORDER BY source_seq)),
v AS (SELECT *, CASE WHEN balance IS NULL THEN '{reconcile.STATUSES[0]}' WHEN before IS NULL THEN '{reconcile.STATUSES[1]}' WHEN debit IS NULL AND credit IS NULL THEN '{reconcile.STATUSES[2]}'
  WHEN abs(balance - (before + move)) <= 0.01 THEN 'MATCH' ELSE 'MISMATCH' END AS status, coalesce(abs(b1 - (balance + m1)) <= 0.01, FALSE) AS f1, coalesce(abs(b2 - (b1 + m2)) <= 0.01, FALSE) AS f2 FROM l),
checked AS (SELECT *, status = 'MISMATCH' AND CASE WHEN rest >= 2 THEN f1 AND f2 ELSE rest = 1 AND f1 END AS gap_explained FROM v)"""


@query(f"""WITH {CHECK_SQL} SELECT statement_id, source_seq, status, gap_explained, CASE WHEN status IN ('MATCH', 'MISMATCH') THEN round(before + move, 2) WHEN status = 'OPENING / REFERENCE' THEN round(balance, 2) END AS expected FROM checked""")
def balance_check(spark, d):
    return reconcile.balance_check(L.faulty(spark, d)).select("statement_id", "source_seq", "status", "gap_explained", F.round("expected", 2).alias("expected"))


@query(f"WITH {CHECK_SQL} SELECT statement_id, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatches, count(*) FILTER (WHERE gap_explained) AS gaps FROM checked GROUP BY statement_id")
def balance_mismatches(spark, d):
    return reconcile.balance_check(L.faulty(spark, d)).groupBy("statement_id").agg(F.count_if(F.col("status") == "MISMATCH").alias("mismatches"), F.count_if("gap_explained").alias("gaps"))


def flip_sql(before: str) -> str:
    return f"""(debit IS NULL) <> (credit IS NULL) AND coalesce(debit, credit) > 0.01 AND abs(-move - (balance - {before})) <= 0.01 AND NOT abs(move - (balance - {before})) <= 0.01"""


@query(f"WITH {CHECK_SQL} SELECT statement_id, source_seq, CASE WHEN {flip_sql('before')} THEN credit ELSE debit END AS debit, CASE WHEN {flip_sql('before')} THEN debit ELSE credit END AS credit FROM checked")
def repair_side(spark, d):
    return reconcile.repair_side(L.faulty(spark, d)).select("statement_id", "source_seq", "debit", "credit")


@query(f"WITH {CHECK_SQL}, o AS (SELECT *, coalesce(before, opening) AS ob FROM checked) SELECT statement_id, source_seq, coalesce({flip_sql('ob')}, FALSE) AS flipped FROM o")
def repair_side_opening(spark, d):
    rows = L.faulty(spark, d)
    opening = rows.groupBy("statement_id").agg(F.first("opening").alias("opening"))
    return reconcile.repair_side(rows.drop("opening"), opening=opening).select("statement_id", "source_seq", "flipped")


@query(f"""WITH {CHECK_SQL}, b AS (SELECT statement_id, source_seq, balance, opening, CASE WHEN source_seq % 5 <> 0 THEN debit END AS debit, CASE WHEN source_seq % 5 <> 0 THEN credit END AS credit, coalesce(before, opening) AS ob FROM checked),
x AS (SELECT *, coalesce(credit, 0) - coalesce(debit, 0) AS move, round(balance - ob, 2) AS change FROM b), y AS (SELECT *, coalesce({flip_sql('ob')}, FALSE) AS flip, coalesce(debit IS NULL AND credit IS NULL AND abs(change) > 0.01, FALSE) AS fill FROM x)
SELECT statement_id, source_seq, CASE WHEN fill AND change < 0 THEN -change WHEN flip THEN credit ELSE debit END AS debit, CASE WHEN fill AND change > 0 THEN change WHEN flip THEN debit ELSE credit END AS credit, fill AS filled FROM y""")
def repair_side_fill(spark, d):
    """Every fifth row without an amount: the change from the last balance, the opening's for the first rows, is filled in."""
    rows = L.faulty(spark, d)
    opening = rows.groupBy("statement_id").agg(F.first("opening").alias("opening"))
    rows = rows.drop("opening").withColumns({c: F.when(F.col("source_seq") % 5 != 0, F.col(c)) for c in ("debit", "credit")})
    return reconcile.repair_side(rows, opening=opening, fill=True).select("statement_id", "source_seq", "debit", "credit", "filled")


@query(f"WITH {CHECK_SQL}, o AS (SELECT *, lag(balance) OVER (PARTITION BY statement_id ORDER BY source_seq) AS lb FROM checked) SELECT statement_id, source_seq, coalesce({flip_sql('lb')}, FALSE) AS flipped FROM o")
def repair_movement(spark, d):
    return reconcile.repair_movement(L.faulty(spark, d).withColumn("source_text", F.col("narration"))).select("statement_id", "source_seq", "flipped")


@query(f"WITH {L.ACCOUNTS_SQL}, b AS (SELECT statement_id, date < lag(date) OVER (PARTITION BY statement_id ORDER BY source_seq) AS back FROM accounts) SELECT statement_id, count(*) FILTER (WHERE back) AS reversals FROM b GROUP BY statement_id")
def date_reversals(spark, d):
    return reconcile.date_reversals(L.accounts(spark, d))


@query(f"WITH {L.ACCOUNTS_SQL} SELECT statement_id, source_seq, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY date NULLS LAST, source_seq) AS INTEGER) AS place FROM accounts")
def sort_evidence(spark, d):
    return reconcile.evidence_order(L.accounts(spark, d)).select("statement_id", "source_seq", "place")


@query(f"""WITH {CHECK_SQL}, b AS (SELECT statement_id, date < lag(date) OVER (PARTITION BY statement_id ORDER BY source_seq) AS back FROM checked), r AS (SELECT statement_id, count(*) FILTER (WHERE back) AS reversals FROM b GROUP BY statement_id),
g AS (SELECT statement_id, count(*) AS n_rows, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatches FROM checked GROUP BY statement_id)
SELECT statement_id, n_rows, mismatches, reversals, mismatches = 0 AND reversals <= greatest(2, floor(n_rows * 0.02)) AS passed FROM g JOIN r USING (statement_id)""")
def integrity_gate(spark, d):
    return gates.integrity(L.faulty(spark, d)).select("statement_id", "n_rows", "mismatches", "reversals", "passed")


ANCHOR_SQL = f"""{L.FAULTY_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY source_seq) AS n FROM faulty),
anchors AS (SELECT statement_id, CASE WHEN balance IS NULL THEN 'AMBIGUOUS' WHEN abs(round(balance - (opening + coalesce(credit, 0) - coalesce(debit, 0)), 2)) <= 0.01 THEN 'VERIFIED' ELSE 'CONFLICTING' END AS status FROM f WHERE n = 1)"""


def _anchors(spark, d):
    rows = L.faulty(spark, d)
    opening = rows.groupBy("statement_id").agg(F.first("opening").alias("opening")).withColumn("source", F.lit("explicit_opening"))
    return gates.opening_anchor(rows.drop("opening"), opening)


@query(f"WITH {ANCHOR_SQL} SELECT statement_id, status FROM anchors")
def opening_anchor(spark, d):
    return _anchors(spark, d).select("statement_id", "status")


@query(f"""WITH {L.FAULTY_SQL}, f AS (SELECT *, CASE WHEN CAST(statement_id AS BIGINT) % 6 <> 0 THEN opening END AS o, coalesce(credit, 0) - coalesce(debit, 0) AS move, row_number() OVER (PARTITION BY statement_id ORDER BY source_seq) AS n FROM faulty),
a AS (SELECT statement_id, round(o + move, 2) AS e, round(balance - (o + move), 2) + 0.0 AS x, balance, o FROM f WHERE n = 1), s AS (SELECT *, CASE WHEN o IS NULL THEN 'NOT_PRESENT' WHEN balance IS NULL THEN 'AMBIGUOUS' WHEN abs(x) <= 0.01 THEN 'VERIFIED' ELSE 'CONFLICTING' END AS status FROM a)
SELECT statement_id, CASE WHEN balance IS NOT NULL THEN e END AS expected, x AS difference, status, CASE WHEN status IN ('VERIFIED', 'NOT_PRESENT') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM s""")
def opening_anchor_diag(spark, d):
    rows = L.faulty(spark, d)
    opening = rows.groupBy("statement_id").agg(F.first("opening").alias("opening")).where(F.col("statement_id").cast("long") % 6 != 0).withColumn("source", F.lit("explicit_opening"))
    return gates.opening_anchor(rows.drop("opening"), opening).select("statement_id", "expected", "difference", "status", "confidence")


RATES_SQL = "rates AS (SELECT statement_id, count(*) AS n_rows, round(avg(CASE WHEN balance IS NOT NULL THEN 1 ELSE 0 END), 6) AS balance_rate, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatches, count(*) FILTER (WHERE gap_explained) AS gaps FROM checked GROUP BY statement_id)"


@query(f"""WITH {CHECK_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY source_seq) AS n FROM checked), a AS (SELECT statement_id, CASE WHEN balance IS NULL THEN 'AMBIGUOUS' WHEN abs(round(balance - (opening + move), 2)) <= 0.01 THEN 'VERIFIED' ELSE 'CONFLICTING' END AS status FROM f WHERE n = 1), {RATES_SQL}
SELECT statement_id, a.status, CASE WHEN a.status = 'VERIFIED' THEN TRUE WHEN a.status = 'AMBIGUOUS' THEN balance_rate >= 0.95 ELSE FALSE END AS accepted FROM a JOIN rates USING (statement_id)""")
def anchor_policy(spark, d):
    return gates.anchor_policy(_anchors(spark, d), gates.recovery_rates(L.faulty(spark, d))).select("statement_id", "status", "accepted")


@query(f"WITH {CHECK_SQL}, {RATES_SQL} SELECT statement_id, n_rows, balance_rate, mismatches, gaps FROM rates")
def recovery_rates(spark, d):
    return gates.recovery_rates(L.faulty(spark, d)).select("statement_id", "n_rows", "balance_rate", "mismatches", "gaps")


@query(f"WITH {CHECK_SQL}, {RATES_SQL} SELECT statement_id, CASE WHEN mismatches > 0 THEN 'REVIEW REQUIRED' WHEN gaps > 0 THEN 'PASS WITH SOURCE GAPS' ELSE 'PASS' END AS quality FROM rates")
def quality_status(spark, d):
    return gates.quality_status(L.faulty(spark, d)).select("statement_id", "quality")


@query(f"""WITH {L.FAULTY_SQL}, s AS (SELECT statement_id, {sums('debit')} AS withdrawal, {sums('credit')} AS deposit, max_by(balance, source_seq) AS closing FROM printed GROUP BY statement_id),
o AS (SELECT statement_id, {sums('debit')} AS debits, {sums('credit')} AS credits, max_by(balance, source_seq) FILTER (WHERE balance IS NOT NULL) AS last_balance FROM faulty GROUP BY statement_id)
SELECT statement_id, debits, credits, coalesce(abs(debits - withdrawal) <= 0.01 AND abs(credits - deposit) <= 0.01 AND abs(last_balance - closing) <= 0.01, FALSE) AS matched FROM o JOIN s USING (statement_id)""")
def summary_anchor(spark, d):
    clean = L.printed(spark, d).groupBy("statement_id").agg(F.sum(findings.cents("debit")).alias("w"), F.sum(findings.cents("credit")).alias("c"), F.max_by("balance", "source_seq").alias("closing"))
    summary = clean.select("statement_id", F.coalesce("w", F.lit(0)).cast("double").alias("withdrawal"), F.coalesce("c", F.lit(0)).cast("double").alias("deposit"), "closing")
    return gates.summary_anchor(L.faulty(spark, d), summary).select("statement_id", "debits", "credits", "matched")


@query(f"""WITH {L.CANDIDATES_SQL}, s AS (SELECT *, coalesce(credit, 0) - coalesce(debit, 0) AS move, last_value(balance IGNORE NULLS) OVER (PARTITION BY statement_id, method ORDER BY source_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  date < lag(date) OVER (PARTITION BY statement_id, method ORDER BY source_seq) AS back, count(*) OVER (PARTITION BY statement_id, method, date, narration, debit, credit, balance) AS n FROM candidates)
SELECT statement_id, method, count(*) AS n_rows, round(avg(CASE WHEN balance IS NOT NULL THEN 1 ELSE 0 END), 6) AS balance_rate, count(*) FILTER (WHERE abs(balance - (before + move)) > 0.01) AS mismatches,
  count(*) FILTER (WHERE back) AS reversals, count(*) FILTER (WHERE n > 1) AS duplicates FROM s GROUP BY statement_id, method""")
def candidate_stats(spark, d):
    return C.stats(L.candidates(spark, d)).select("statement_id", "method", "n_rows", "balance_rate", "mismatches", "reversals", "duplicates")


@query(f"""WITH k AS ({SQL["candidate_stats"]}), r AS (SELECT *, round(0.25 * least(n_rows, 10000) + 100 + 70 * balance_rate - 35 * mismatches - 2 * duplicates - 10 * reversals, 4) AS score FROM k)
SELECT statement_id, method, score, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY mismatches = 0 DESC, mismatches, balance_rate DESC, n_rows DESC, method) AS INTEGER) AS place FROM r""")
def candidate_rank(spark, d):
    return C.ranked(C.acceptance(C.stats(L.candidates(spark, d)))).select("statement_id", "method", "score", "place")


@query(f"""WITH {L.CANDIDATES_SQL} SELECT DISTINCT statement_id, date, CAST(debit AS DECIMAL(18,2)) AS debit, CAST(credit AS DECIMAL(18,2)) AS credit, CAST(balance AS DECIMAL(18,2)) AS balance FROM candidates""")
def merge_candidates(spark, d):
    rows = L.candidates(spark, d)
    return C.merged(rows, C.stats(rows)).select("statement_id", "date", *(findings.cents(c).alias(c) for c in ("debit", "credit", "balance")))


@query(f"""WITH {CHECK_SQL}, m AS (SELECT statement_id, count(*) FILTER (WHERE status = 'MISMATCH') AS wrong FROM checked GROUP BY statement_id),
k AS (SELECT DISTINCT statement_id, date, CAST(debit AS DECIMAL(18,2)) AS d, CAST(credit AS DECIMAL(18,2)) AS c, CAST(balance AS DECIMAL(18,2)) AS b FROM printed WHERE source_seq % 11 <> 0),
x AS (SELECT f.statement_id, f.source_seq, k.statement_id IS NOT NULL AS shared FROM faulty f LEFT JOIN k ON k.statement_id = f.statement_id AND k.date IS NOT DISTINCT FROM f.date AND d IS NOT DISTINCT FROM CAST(f.debit AS DECIMAL(18,2)) AND c IS NOT DISTINCT FROM CAST(f.credit AS DECIMAL(18,2)) AND b IS NOT DISTINCT FROM CAST(f.balance AS DECIMAL(18,2))),
y AS (SELECT *, bool_or(shared) OVER (PARTITION BY statement_id) AS any_shared FROM x) SELECT statement_id, source_seq FROM y JOIN m USING (statement_id) WHERE shared OR wrong = 0 OR NOT any_shared""")
def ocr_consensus(spark, d):
    return C.consensus(L.faulty(spark, d), L.printed(spark, d).where(F.col("source_seq") % 11 != 0)).select("statement_id", "source_seq")


@query(f"WITH {L.ACCOUNTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY statement_id, date, reference ORDER BY source_seq) AS n FROM accounts) SELECT statement_id, source_seq FROM k WHERE n = 1")
def dedupe_keep_first(spark, d):
    return C.keep_first(L.accounts(spark, d), ["statement_id", "date", "reference"]).select("statement_id", "source_seq")


@query(f"""WITH {L.ACCOUNTS_SQL}, x AS (SELECT *, CAST(statement_id AS BIGINT) % 2 = 0 AS placed, unnest(range(CASE WHEN source_seq % 4 = 0 THEN 2 ELSE 1 END)) AS copy FROM accounts),
n AS (SELECT *, row_number() OVER (PARTITION BY statement_id, date, narration, debit, credit ORDER BY copy, source_seq) AS k FROM x)
SELECT statement_id, count(*) AS n_rows FROM n WHERE placed OR k = 1 GROUP BY statement_id""")
def dedupe_candidate(spark, d):
    """Rows printed twice: both stay where the source's rows tell them apart, else the first does."""
    rows = L.accounts(spark, d).withColumn("balance", F.lit(None).cast("double"))
    twice = F.explode(F.when(F.col("source_seq") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("copy", twice)
    placed = F.when(F.col("statement_id").cast("long") % 2 == 0, F.col("source_seq") * 2 + F.col("copy"))
    return C.deduplicated(rows.withColumns({"source_row": placed, "source_page": F.lit(1)})).groupBy("statement_id").agg(F.count("*").alias("n_rows"))


@query(f"WITH {L.FAULTY_SQL} SELECT statement_id, source_seq, debit, credit FROM printed")
def solve_ledger_fast(spark, d):
    """Sides turned around in every 37th row are found again from the balances."""
    k = F.col("source_seq")
    side = lambda a, b: F.when(k % 37 == 0, F.col(b)).otherwise(F.col(a))
    rows = L.printed(spark, d)
    opening = rows.groupBy("statement_id").agg(F.first("opening").alias("opening"))
    turned = rows.select("statement_id", "source_seq", "date", "balance", side("debit", "credit").alias("debit"), side("credit", "debit").alias("credit"))
    return solver.solve_printed(turned, opening).select("statement_id", "source_seq", "debit", "credit")


#: Every choice of sides of every run between known balances, in each of four orders.
SOLVE_SQL = f"""WITH {L.FAULTY_SQL}, c AS (SELECT statement_id, max_by(balance, source_seq) AS closing FROM printed GROUP BY statement_id),
v AS (SELECT f.statement_id, source_seq, variant, debit, credit, balance, opening, closing, coalesce(credit, 0) - coalesce(debit, 0) AS move, debit IS NOT NULL OR credit IS NOT NULL AS has,
  row_number() OVER (PARTITION BY f.statement_id, variant ORDER BY CASE variant WHEN 0 THEN source_seq WHEN 1 THEN -source_seq WHEN 2 THEN date - DATE '1970-01-01' ELSE DATE '1970-01-01' - date END, source_seq) AS place FROM faulty f JOIN c USING (statement_id), (SELECT unnest(range(4)) AS variant)),
g AS (SELECT *, count(balance) OVER w AS run, coalesce(last_value(balance IGNORE NULLS) OVER w, opening) AS before FROM v WINDOW w AS (PARTITION BY statement_id, variant ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
runs AS (SELECT statement_id, variant, run, count(*) AS n, min(before) AS before, max(balance) AS ends, list(move ORDER BY place) AS moves, list(has ORDER BY place) AS has FROM g GROUP BY ALL),
masks AS (SELECT *, unnest(range(CASE WHEN ends IS NULL OR before IS NULL THEN 1 ELSE CAST(pow(2, n) AS BIGINT) END)) AS mask FROM runs),
tried AS (SELECT *, list_sum([CASE WHEN (mask >> CAST(n - i AS BIGINT)) & 1 = 1 THEN -moves[i] ELSE moves[i] END FOR i IN range(1, n + 1)]) AS moved FROM masks),
points AS (SELECT *, n - CASE WHEN ends IS NULL THEN 0 ELSE 1 END - 4 * bit_count(mask) + CASE WHEN ends IS NULL THEN 0 WHEN before IS NULL OR NOT has[n] THEN -1 WHEN abs(ends - (before + moved)) <= 0.01 THEN 45 ELSE -least(80, 5 + abs(ends - (before + moved)) / 1000) END AS points FROM tried),
best AS (SELECT *, row_number() OVER (PARTITION BY statement_id, variant, run ORDER BY round(points, 6) DESC, mask) AS k FROM points),
lasts AS (SELECT statement_id, variant, max_by(balance, place) AS b, max_by(balance IS NULL, place) AS blank, any_value(closing) AS closing, count(balance) AS known FROM g GROUP BY ALL),
orders AS (SELECT b.statement_id, b.variant, round(sum(points) + any_value(CASE WHEN known = 0 THEN 0 WHEN NOT blank AND abs(l.b - closing) <= 0.01 THEN 80 ELSE -60 END), 6) AS score FROM best b JOIN lasts l ON l.statement_id = b.statement_id AND l.variant = b.variant WHERE k = 1 GROUP BY ALL),
chosen AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY score DESC, variant) AS k FROM orders)
SELECT g.statement_id, g.source_seq, (b.mask >> CAST(b.n - (row_number() OVER (PARTITION BY g.statement_id, g.variant, g.run ORDER BY place)) AS BIGINT)) & 1 = 1 AS swapped, round(o.score, 4) AS score, ['source', 'source_reversed', 'date', 'date_reversed'][o.variant + 1] AS "order"
FROM g JOIN chosen o ON o.statement_id = g.statement_id AND o.variant = g.variant AND o.k = 1 JOIN best b ON b.statement_id = g.statement_id AND b.variant = g.variant AND b.run = g.run AND b.k = 1"""


@query(SOLVE_SQL)
def solve_ledger(spark, d):
    """All rows, with the printed closing balance; tests/test_solver.py has a comparison with every choice of sides."""
    closing = L.printed(spark, d).groupBy("statement_id").agg(F.max_by("balance", "source_seq").alias("closing"))
    return solver.solve(L.faulty(spark, d), closing=closing).withColumn("score", F.round("score", 4))


@query(f"WITH {L.FAULTY_SQL} SELECT statement_id, date, concat('N', CAST(source_seq AS VARCHAR)) AS reference, CASE WHEN source_seq % 3 = 0 THEN 'ORDER GOODS' ELSE 'ORDER' END AS narration, debit, credit, round(balance, 2) AS balance FROM printed")
def layout_rows(spark, d):
    return layout.layout_rows(L.words(spark, d)).select("statement_id", "date", "reference", "narration", "debit", "credit", F.round("balance", 2).alias("balance"))


@query(f"WITH {L.FAULTY_SQL}, p AS (SELECT DISTINCT statement_id FROM printed) SELECT statement_id, 's1' AS sheet, 3 AS header_row, CAST(5 AS BIGINT) AS score FROM p")
def header_detect(spark, d):
    return S.headers(L.cells(spark, d))


@query(f"WITH {L.FAULTY_SQL} SELECT statement_id, date, narration, reference, debit, credit, round(balance, 2) AS balance FROM printed")
def standardize_ledger(spark, d):
    return S.standardize(L.cells(spark, d)).select("statement_id", "date", "narration", "reference", "debit", "credit", F.round("balance", 2).alias("balance"))


def _money(c: str) -> str:
    return f"printf('%.2f', {c})"


@query(f"""WITH {L.FAULTY_SQL} SELECT statement_id, source_seq, strftime(date, '%d-%m-%Y') AS date, narration, reference, CASE WHEN debit IS NOT NULL THEN {_money('debit')} ELSE '0.00' END AS debit,
 CASE WHEN credit IS NOT NULL THEN {_money('credit')} ELSE '0.00' END AS credit, coalesce({_money('balance')}, '-') AS balance FROM faulty""")
def export_transactions(spark, d):
    return exports.transactions(L.faulty(spark, d))


@query(f"""WITH {L.FAULTY_SQL} SELECT statement_id, source_seq, CAST(50 + CASE WHEN balance > 0 THEN 20 ELSE 0 END + CASE WHEN length(narration) > 50 THEN 15 WHEN length(narration) > 20 THEN 10 ELSE 5 END AS INTEGER) AS confidence FROM faulty""")
def extraction_confidence(spark, d):
    return exports.extraction_confidence(L.faulty(spark, d)).select("statement_id", "source_seq", "confidence")


@query(f"WITH {L.ACCOUNTS_SQL} SELECT statement_id, source_seq FROM accounts WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-06-30'")
def period_guard(spark, d):
    rows = L.accounts(spark, d)
    periods = rows.select("statement_id").distinct().select("statement_id", F.lit("1995-01-01").cast("date").alias("first_day"), F.lit("1997-06-30").cast("date").alias("last_day"))
    return exports.period_guard(rows, periods).select("statement_id", "source_seq")


@query(f"WITH {L.ACCOUNTS_SQL} SELECT statement_id, source_seq, narration FROM accounts WHERE lower(narration) LIKE '%amazon%'")
def search_any_column(spark, d):
    return S.search_any_column(L.accounts(spark, d).select("statement_id", "source_seq", "narration"), "amazon")


def tall_sql(cells: list[str], columns: str) -> str:
    """Rows (statement_id, columns) of w, one of each of cells."""
    return " UNION ALL ".join(f"SELECT statement_id, {k + 1} AS place, {cell}" for k, cell in enumerate(cells)) if columns else ""


FAULTY_RAIL = RAIL.replace("source_seq", "c.source_seq")
SAME_SQL = "same AS (SELECT statement_id, count(*) AS n FROM (SELECT statement_id, count(*) OVER (PARTITION BY statement_id, date, narration, debit, credit) AS m FROM faulty WHERE date IS NOT NULL) WHERE m > 1 GROUP BY statement_id)"


@query(f"""WITH {CHECK_SQL}, {SAME_SQL}, w AS (SELECT c.statement_id, count(*) AS a, count(*) FILTER (WHERE date IS NULL) AS b, count(*) FILTER (WHERE coalesce(debit, 0) + coalesce(credit, 0) = 0) AS c, count(*) FILTER (WHERE balance IS NULL) AS d,
  count(*) FILTER (WHERE {FAULTY_RAIL} = 'OTHER / UNIDENTIFIED') AS e, coalesce(any_value(same.n), 0) AS f, count(*) FILTER (WHERE status = 'MISMATCH') AS g, count(*) FILTER (WHERE gap_explained) AS h FROM checked c LEFT JOIN same USING (statement_id) GROUP BY c.statement_id)
{tall_sql([f"'{name}' AS counter, {x} AS n, '{meaning}' AS meaning FROM w" for x, (name, meaning) in zip("abcdefgh", findings.QUALITY.items())], "n")}""")
def data_quality(spark, d):
    return findings.data_quality(_named_faulty(spark, d))


def _named_faulty(spark, d):
    rows = L.faulty(spark, d)
    return rows.withColumn("rail", T.rail(F.concat_ws(" ", "narration", "reference")))


_MASTER_VALUES = ["all_", "NULL", "credits", "debits", "credits - debits", "top1", "top5", "rapid", "round_", "velocity", "same_", "cash", "unnamed", "wrong"]
_MASTER_BASIS = {5: "concat('Threshold ₹', format('{:,.2f}', q99))", 6: "concat('Threshold ₹', format('{:,.2f}', q95))"}
_MASTER_CELLS = [
    f"'{name}' AS finding, CAST({_MASTER_VALUES[k]} AS DOUBLE) AS value, {'concat(strftime(first_date, $$%d-%m-%Y$$), $$ to $$, strftime(last_date, $$%d-%m-%Y$$))' if k == 1 else 'CAST(NULL AS VARCHAR)'} AS value_text, {_MASTER_BASIS.get(k, f'$${basis}$$')} AS basis, '{use}' AS interpretation, {'CASE WHEN wrong > 0 THEN $$CRITICAL$$ ELSE $$PASS$$ END' if k == 13 else f'$${status}$$'} AS status FROM w"
    for k, (name, basis, use, status) in enumerate(findings.MASTER)
]


@query(f"""WITH {CHECK_SQL}, {SAME_SQL}, m AS (SELECT *, coalesce(debit, 0) + coalesce(credit, 0) AS amount, count(*) OVER (PARTITION BY statement_id, date) AS day_rows FROM checked),
q AS (SELECT statement_id, round(quantile_cont(amount, 0.95), 4) AS q95, round(quantile_cont(amount, 0.99), 4) AS q99 FROM m WHERE amount > 0 GROUP BY statement_id),
marks AS (SELECT DISTINCT a.statement_id, a.source_seq AS i, b.source_seq AS o FROM faulty a JOIN faulty b ON a.statement_id = b.statement_id AND a.credit >= 100000 AND b.debit >= 80000 AND b.debit >= 0.8 * a.credit AND b.date BETWEEN a.date AND a.date + 1),
ends AS (SELECT statement_id, i AS s FROM marks UNION SELECT statement_id, o FROM marks), rapid AS (SELECT statement_id, count(*) AS n FROM ends GROUP BY statement_id),
w AS (SELECT c.statement_id, count(*) AS all_, {CENTS.format('credit')} AS credits, {CENTS.format('debit')} AS debits, min(date) AS first_date, max(date) AS last_date, any_value(q95) AS q95, any_value(q99) AS q99, count(*) FILTER (WHERE amount >= q99) AS top1, count(*) FILTER (WHERE amount >= q95) AS top5,
  coalesce(any_value(rapid.n), 0) AS rapid, count(*) FILTER (WHERE amount >= 50000 AND CAST(amount AS DECIMAL(18,2)) % 10000 = 0) AS round_, count(*) FILTER (WHERE day_rows >= 15) AS velocity, coalesce(any_value(same.n), 0) AS same_,
  count(*) FILTER (WHERE {FAULTY_RAIL} = 'ATM/CASH') AS cash, count(*) FILTER (WHERE {FAULTY_RAIL} = 'OTHER / UNIDENTIFIED') AS unnamed, count(*) FILTER (WHERE status = 'MISMATCH') AS wrong
  FROM m c LEFT JOIN q USING (statement_id) LEFT JOIN same USING (statement_id) LEFT JOIN rapid USING (statement_id) GROUP BY c.statement_id)
{tall_sql(_MASTER_CELLS, "n")}""")
def master_findings(spark, d):
    return findings.master(L.faulty(spark, d))


_KINDS = [
    SQL["bridge"],
    SQL["circles"],
    f"""WITH {L.FLOWS_SQL}, g AS (SELECT *, date - lag(date) OVER (PARTITION BY statement_id ORDER BY date, source_seq) AS gap FROM flows) SELECT * FROM g WHERE gap >= 90 AND coalesce(debit, 0) + coalesce(credit, 0) >= 100000""",
    SQL["behaviour"],
    f"""WITH {L.FLOWS_SQL}, c AS (SELECT statement_id, count(*) OVER (PARTITION BY statement_id, date, CAST(coalesce(debit, 0) + coalesce(credit, 0) AS DECIMAL(18,2)), {PARTY}) AS n FROM flows) SELECT * FROM c WHERE n > 1""",
]


@query(f"""WITH kinds AS ({" UNION ALL ".join(f"SELECT statement_id, {k} AS k, count(*) AS cases FROM ({text}) GROUP BY statement_id" for k, text in enumerate(_KINDS))}),
f AS (SELECT DISTINCT statement_id FROM (WITH {L.FLOWS_SQL} SELECT * FROM flows)), every AS (SELECT * FROM kinds UNION ALL SELECT statement_id, 5, 0 FROM f ANTI JOIN kinds USING (statement_id)),
t(k, area, question) AS (VALUES {", ".join(f"({k}, $${area}$$, $${question}$$)" for k, (area, question) in enumerate(findings.QUESTIONS.items()))})
SELECT statement_id, area, cases, question FROM every JOIN t USING (k)""")
def questions(spark, d):
    return findings.questions(L.flows(spark, d))


@query(f"""WITH {L.ACCOUNTS_SQL}, p AS (SELECT *, CASE source_seq % 12 WHEN 0 THEN 'NATION' WHEN 1 THEN 'SALARY NATION' WHEN 2 THEN 'CASH WITHDRAWAL' WHEN 3 THEN 'NATION' WHEN 4 THEN 'PURCHASE AMAZON' WHEN 5 THEN 'EMI LOAN PIRAMAL' WHEN 6 THEN ''
  WHEN 7 THEN 'BY CASH DEPOSIT SELF' WHEN 8 THEN 'CHQ PAID CTS' WHEN 9 THEN 'TO SAVINGS' WHEN 10 THEN 'RECHARGE JIO' ELSE 'goods for nation' END AS counterparty FROM accounts)
SELECT statement_id, source_seq, counterparty, CASE source_seq % 12 WHEN 0 THEN concat('Net Banking - ', counterparty) WHEN 1 THEN 'Salary' WHEN 4 THEN 'POS transaction - PURCHASE AMAZON' WHEN 5 THEN 'Loan / Finance - EMI LOAN PIRAMAL' WHEN 6 THEN 'Interest' WHEN 7 THEN 'Cash Deposit' WHEN 8 THEN 'Cheque Deposit' ELSE narration END AS particulars FROM p""")
def counterparties(spark, d):
    rows = L.accounts(spark, d)
    return rows.select("statement_id", "source_seq", T.counterparty(F.col("narration")).alias("counterparty"), T.particulars(F.col("narration"), F.col("debit"), F.col("credit")).alias("particulars"))


@query("SELECT source, round(avg(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END), 6) AS ratio FROM documents GROUP BY source")
def doc_text_ratio(spark, d):
    return L.table(spark, d, "documents").groupBy("source").agg(F.round(F.avg((F.trim("text") != "").cast("int")), 6).alias("ratio"))


@query("SELECT page_id, sha256(html) AS evidence FROM pages")
def evidence_hash(spark, d):
    return L.table(spark, d, "pages").select("page_id", S.evidence_hash(F.col("html").cast("binary")).alias("evidence"))


REFERENCES = """CASE source_seq % 6 WHEN 0 THEN concat('UPI/', CAST(source_seq + 1000000 AS VARCHAR(20)), ' to 31-') WHEN 1 THEN concat(CAST(source_seq + 12345678 AS VARCHAR(20)), ' : paid  for') WHEN 2 THEN 'Advice up to 15-'
  WHEN 3 THEN concat('NEFT:AB-', CAST(source_seq AS VARCHAR(20)), '/X99 NO') WHEN 4 THEN '' ELSE concat('ph UTR', CAST(source_seq + 10000 AS VARCHAR(20))) END"""
IDS = r"(?i)\b(?:UPI|IMPS|NEFT|RTGS|NACH|ECS|ACH|CLIN|DAP|FINANCE|UTR|RRN|REF|TRN|TXN|CHQ|CHEQUE|CTS)[/_:\-]?[A-Z0-9][A-Z0-9/_:\-]{4,}|\b\d{8,}\b"


@query(f"""WITH {L.ACCOUNTS_SQL}, r AS (SELECT statement_id, source_seq, narration, {REFERENCES} AS own FROM accounts), i AS (SELECT *, array_to_string(regexp_extract_all(own, '{IDS}'), ' ') AS ids, trim(regexp_replace(regexp_replace(own, '{IDS}', ' ', 'g'), '[ :]+', ' ', 'g')) AS rest FROM r)
SELECT statement_id, source_seq, CASE WHEN source_seq % 6 = 2 THEN concat(narration, ' up to 15-') WHEN ids = '' OR rest = 'NO' THEN narration WHEN rest = 'ph' THEN concat(narration, ' Ph') ELSE concat(narration, ' ', rest) END AS narration,
  CASE WHEN source_seq % 6 = 2 THEN 'Advice' WHEN own = '' THEN array_to_string(regexp_extract_all(narration, '{IDS}'), ' ') ELSE ids END AS reference FROM i""")
def reference_cleanup(spark, d):
    """Identifiers with remarks, with a piece of a period, with nothing worth keeping, none at all, and those of the narration."""
    rows = L.accounts(spark, d).withColumn("reference", F.expr(REFERENCES.replace("VARCHAR(20)", "STRING")))
    narration, reference = T.cleaned_reference(F.col("narration"), F.col("reference"))
    return rows.select("statement_id", "source_seq", narration.alias("narration"), reference.alias("reference"))


@query(f"""WITH {L.FAULTY_SQL} SELECT statement_id, round(min(opening), 2) AS opening, {sums('debit')} AS withdrawal, {sums('credit')} AS deposit, round(max_by(balance, source_seq), 2) AS closing FROM printed GROUP BY statement_id""")
def statement_summary(spark, d):
    sums_of = L.printed(spark, d).groupBy("statement_id").agg(F.min("opening").alias("o"), F.coalesce(F.sum(findings.cents("debit")), F.lit(0)).cast("double").alias("w"), F.coalesce(F.sum(findings.cents("credit")), F.lit(0)).cast("double").alias("c"), F.max_by("balance", "source_seq").alias("b"))
    shown = lambda c: F.concat(F.format_string("%,.2f", F.abs(F.col(c))), F.when(F.col(c) < 0, " (DR)").otherwise(" CR"))
    o, w, c, b = (shown(x) for x in "owcb")
    # Amounts beside their labels, in two orders, or all labels before all amounts.
    k = F.pmod(F.col("statement_id").cast("long"), F.lit(3))
    beside = F.concat(F.lit("Account 77\nopening balance : INR "), o, F.lit("\nTotal Withdrawal Amount : "), w, F.lit("\nTotal Deposits : "), c, F.lit("\nClosing Balance , "), b)
    turned = F.concat(F.lit("debit 3 credit 4\nClosing Balance "), b, F.lit(" Total Deposit Amount "), c, F.lit(" Opening  Balance "), o, F.lit(" Total Withdrawals "), w, F.lit(" 77.00"))
    apart = F.concat(F.lit("Opening Balance Total Withdrawal Amount Total Deposit Amount Closing Balance\n"), F.concat_ws("\n", o, w, c, b))
    text = F.when(k == 0, beside).when(k == 1, turned).otherwise(apart)
    return sums_of.select("statement_id", T.statement_summary(text).alias("s")).select("statement_id", "s.*")


#: Texts of statements by the bits of a key, and how many words of each bank they hold, counted by a join.
BANK_TEXT = "concat_ws(' ', c_name, CASE WHEN c_custkey % 2 = 0 THEN 'HDFC Bank Ltd.' END, CASE WHEN c_custkey % 3 = 0 THEN 'State-Bank of India' END, CASE WHEN c_custkey % 5 = 0 THEN 'SBI Card' END, CASE WHEN c_custkey % 7 < 2 THEN 'Kotak Mahindra' END, CASE WHEN c_custkey % 11 < 3 THEN 'Axis Finance' END, CASE WHEN c_custkey % 13 = 0 THEN 'Customer ID / Branch Code / ICICI Bank' END, CASE WHEN c_custkey % 4 = 3 THEN 'statement of account' END, CASE WHEN c_custkey % 17 = 0 THEN 'Bank of Baroda (BOB) & Yes Bank' END, c_mktsegment)"


@query(f"""WITH t AS (SELECT c_custkey, trim(regexp_replace(lower({BANK_TEXT}), '[^a-z0-9]+', ' ', 'g')) AS x FROM customer),
k(o, bank, word) AS (VALUES (1, 'HDFC', 'hdfc'), (1, 'HDFC', 'hdfc bank'), (1, 'HDFC', 'hdfc bank ltd'), (1, 'HDFC', 'cif'), (1, 'HDFC', 'statement of account'), (2, 'ICICI', 'icici'), (2, 'ICICI', 'icici bank'), (2, 'ICICI', 'customer id'), (2, 'ICICI', 'branch code'),
  (3, 'SBI', 'sbi'), (3, 'SBI', 'state bank of india'), (3, 'SBI', 'sb account'), (3, 'SBI', 'sbi card'), (4, 'AXIS', 'axis bank'), (4, 'AXIS', 'axis'), (4, 'AXIS', 'axis finance'), (5, 'KOTAK', 'kotak'), (5, 'KOTAK', 'kotak mahindra'),
  (6, 'YES', 'yes bank'), (6, 'YES', 'yes foundation'), (7, 'BANK_OF_BARODA', 'bank of baroda'), (7, 'BANK_OF_BARODA', 'bob'), (8, 'PNB', 'pnb'), (8, 'PNB', 'punjab national bank')),
h AS (SELECT c_custkey, o, bank, count(*) AS n FROM t JOIN k ON contains(x, word) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, o) AS place FROM h)
SELECT t.c_custkey, coalesce(bank, 'GENERIC') AS bank, CAST(round(least(0.99, 0.45 + 0.12 * coalesce(n, 0)), 2) AS DOUBLE) AS confidence FROM t LEFT JOIN b ON b.c_custkey = t.c_custkey AND place = 1""")
def bank_format_detect(spark, d):
    return L.table(spark, d, "customer").select("c_custkey", T.bank_format(F.expr(BANK_TEXT)).alias("b")).select("c_custkey", "b.bank", "b.confidence")


@query(f"WITH {L.FAULTY_SQL} SELECT statement_id, source_seq, CASE WHEN source_seq % 3 = 0 THEN 'ORDER GOODS' ELSE 'ORDER' END AS narration FROM printed")
def wrapped_narration(spark, d):
    rows = L.printed(spark, d).withColumn("narration", F.lit("ORDER"))
    return layout.wrapped_narration(rows, layout.lines(L.words(spark, d))).select("statement_id", "source_seq", "narration")


@query(f"WITH {L.FAULTY_SQL} SELECT statement_id, date, debit, credit, round(balance, 2) AS balance, concat('N', CAST(source_seq AS VARCHAR)) AS narration FROM printed")
def layout_fixed_bands(spark, d):
    return layout.fixed_bands(L.band_words(spark, d)).select("statement_id", "date", "debit", "credit", F.round("balance", 2).alias("balance"), "narration")


REFERENCE_SHOWN = "CASE WHEN source_seq % 2 = 0 THEN CAST(source_seq + 5050000000 AS VARCHAR) ELSE concat('R', CAST(source_seq AS VARCHAR)) END"


@query(f"WITH {L.SIDES_SQL} SELECT statement_id, date, narration, {REFERENCE_SHOWN} AS reference, debit, credit, round(balance, 2) AS balance FROM sides")
def layout_rows_phrases(spark, d):
    """Headings of several words, value dates and reference numbers beside the amounts."""
    return layout.position_rows(L.column_words(spark, d)).select("statement_id", "date", "narration", "reference", "debit", "credit", F.round("balance", 2).alias("balance"))


@query(f"""WITH {L.SIDES_SQL}, b AS (SELECT *, coalesce(credit, 0) - coalesce(debit, 0) AS move, coalesce(last_value(balance IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY source_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opening) AS before FROM sides),
f AS (SELECT *, coalesce({flip_sql('before')}, FALSE) AS flip FROM b)
SELECT statement_id, date, narration, CASE WHEN source_seq % 2 = 1 THEN {REFERENCE_SHOWN} ELSE '' END AS reference, CASE WHEN flip THEN credit ELSE debit END AS debit, CASE WHEN flip THEN debit ELSE credit END AS credit, round(balance, 2) AS balance FROM f""")
def layout_rows_generic(spark, d):
    """The same pages by shares, distances and balances; a side that the balance disproves is turned."""
    opening = L.accounts(spark, d).groupBy("statement_id").agg(F.first("opening").alias("opening"))
    return layout.generic_rows(L.column_words(spark, d), opening).select("statement_id", "date", "narration", "reference", "debit", "credit", F.round("balance", 2).alias("balance"))


@query(f"WITH {L.FAULTY_SQL} SELECT statement_id, date, concat('N', CAST(source_seq AS VARCHAR)) AS narration, debit, credit, abs(round(balance, 2)) AS balance FROM printed")
def layout_rows_scanned(spark, d):
    return layout.scanned_rows(L.scanned_words(spark, d)).select("statement_id", "date", "narration", "debit", "credit", F.round("balance", 2).alias("balance"))


@query(f"""WITH {L.FAULTY_SQL}, p AS (SELECT statement_id, source_seq, date, abs(round(balance, 2)) AS balance, round(coalesce(debit, credit), 2) AS amount FROM printed),
b AS (SELECT *, lag(balance) OVER (PARTITION BY statement_id ORDER BY source_seq) AS before, greatest(amount, balance) AS most FROM p)
SELECT statement_id, date, concat('N', CAST(source_seq AS VARCHAR), 'X') AS narration, CASE WHEN abs(balance - before + most) <= greatest(0.05, most * 0.0001) AND NOT abs(balance - before - most) <= greatest(0.05, most * 0.0001) THEN most END AS debit,
  CASE WHEN NOT coalesce(abs(balance - before + most) <= greatest(0.05, most * 0.0001) AND NOT abs(balance - before - most) <= greatest(0.05, most * 0.0001), FALSE) THEN most END AS credit, balance FROM b""")
def line_rows(spark, d):
    """Lines of a date, a name, an amount and a balance with CR, without columns."""
    rows = L._on_pages(L.printed(spark, d), 15)
    y = 100.0 + F.col("at") * 40.0
    cells = [(F.lit(40), y, F.date_format("date", "dd-MM-yyyy")), (F.lit(120), y, F.concat(F.lit("N"), F.col("source_seq").cast("string"), F.lit("X"))), (F.lit(300), y + 6, L._SHOWN("amount")), (F.lit(400), y + 12, L._SHOWN("balance")), (F.lit(480), y + 15, F.lit("CR"))]
    words = L._drawn(rows.withColumn("amount", F.coalesce("debit", "credit")), cells)
    return layout.line_rows(words).select("statement_id", "date", "narration", "debit", "credit", "balance")


@query(f"""WITH {L.FAULTY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY source_seq) - 1 AS k FROM printed)
SELECT statement_id, CAST(k // 15 + 1 AS INTEGER) AS source_page, k % 15 + 2 AS source_row, date, narration, concat('R', CAST(source_seq AS VARCHAR)) AS reference, debit, credit, CASE WHEN source_seq % 6 <> 0 THEN round(balance, 2) END AS balance FROM n""")
def standardize_ragged(spark, d):
    return S.standardize_tables(L.tables(spark, d)).select("statement_id", "source_page", "source_row", "date", "narration", "reference", "debit", "credit", F.round("balance", 2).alias("balance"))


@query(f"WITH {L.FAULTY_SQL}, n AS (SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY source_seq) - 1 AS k FROM printed) SELECT statement_id, CAST(k // 20 AS INTEGER) AS source_page, count(*) AS n_rows FROM n GROUP BY ALL")
def provenance(spark, d):
    return exports.provenance(layout.layout_rows(L.words(spark, d)))


@query(f"WITH {CHECK_SQL}, m AS (SELECT statement_id, count(*) FILTER (WHERE status = 'MISMATCH') AS wrong FROM checked GROUP BY statement_id) SELECT statement_id, source_seq, status = 'MISMATCH' AND wrong = 1 AS review FROM checked JOIN m USING (statement_id)")
def balance_review_mark(spark, d):
    return C.review_marks(L.faulty(spark, d)).select("statement_id", "source_seq", "review")


@query(SQL["candidate_stats"].replace("SELECT statement_id, method, count(*)", "SELECT statement_id, method, CASE WHEN n_rows < 10 THEN 'too few rows' WHEN balance_rate < 0.4 THEN 'balances missing' WHEN mismatches > greatest(5, floor(n_rows * 0.25)) THEN 'too many mismatches' ELSE '' END AS reason FROM (SELECT statement_id, method, count(*)") + ")")
def candidate_acceptance(spark, d):
    return C.acceptance(C.stats(L.candidates(spark, d))).select("statement_id", "method", "reason")


@query(f"WITH {L.ACCOUNTS_SQL} SELECT statement_id, source_seq, date, narration, reference, debit, credit, opening AS balance FROM accounts WHERE date IS NOT NULL")
def normalize_candidate(spark, d):
    texts = L.accounts(spark, d).select("statement_id", "source_seq", F.col("date").cast("string").alias("date"), "narration", "reference", "debit", F.col("credit").cast("string").alias("credit"), F.col("opening").alias("balance"))
    return C.normalized(texts).drop("source_page", "source_row")


@query(f"WITH {L.ACCOUNTS_SQL} SELECT statement_id, source_seq, date, narration, reference, debit, credit, opening AS balance, party FROM accounts")
def project_schema(spark, d):
    from .schema import LEDGER

    rows = L.accounts(spark, d).withColumnRenamed("opening", "balance").withColumn("value_date", F.col("date"))
    return exports.projected(rows, LEDGER)


_SUMMARY_VALUES = ["NULL", "NULL", "all_", "credits", "debits", "credits - debits", "review", "critical", "mismatches", "gaps"]
_SUMMARY_CELLS = [f"'{name}' AS metric, CAST({x} AS DOUBLE) AS value, {('$$accounts$$', 'concat(CAST(all_ AS VARCHAR), $$ row(s)$$)')[k] if k < 2 else 'CAST(NULL AS VARCHAR)'} AS value_text FROM w" for k, (name, x) in enumerate(zip(exports.SUMMARY, _SUMMARY_VALUES))]


@query(f"""WITH {RICH_SQL}, b AS (SELECT statement_id, count(*) AS all_, {CENTS.format('credit')} AS credits, {CENTS.format('debit')} AS debits, count(*) FILTER (WHERE priority = 'REVIEW') AS review, count(*) FILTER (WHERE priority = 'CRITICAL') AS critical FROM enriched GROUP BY statement_id),
w AS (SELECT *, 0 AS mismatches, 0 AS gaps FROM b) {tall_sql(_SUMMARY_CELLS, "n")}""")
def export_summary(spark, d):
    """Of accounts with whole chains of balances, so no mismatch."""
    rows = L.printed(spark, d)
    sources = rows.groupBy("statement_id").agg(F.lit("accounts").alias("source_type"), F.concat(F.count("*").cast("string"), F.lit(" row(s)")).alias("location"))
    return exports.summary(findings.enrich(rows), gates.recovery_rates(rows), sources)


@query(f"WITH {NAMED_SQL}, p AS ({profile_sql('rail')}) SELECT * FROM p ORDER BY n_rows DESC, rail LIMIT 5")
def report_profile(spark, d):
    return exports.report_profile(findings.profile(_named(spark, d), "rail"), "rail", most=5)


@query(FLOW_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY in_date, in_seq, out_seq, debit) AS place FROM pairs)
SELECT statement_id, in_seq, out_seq, in_date, out_date, credit, debit, CAST(place AS INTEGER) AS place FROM o WHERE place <= 40""")
def report_fund_flow(spark, d):
    return exports.report_fund_flow(findings.first_fund_flow(L.flows(spark, d), 40)).select("statement_id", "in_seq", "out_seq", "in_date", "out_date", "credit", "debit", "place")


@query(f"""WITH {RICH_SQL} SELECT statement_id, count(*) AS n_rows, count(*) FILTER (WHERE priority = 'REVIEW') AS review, count(*) FILTER (WHERE priority = 'CRITICAL') AS critical, count(*) FILTER (WHERE rapid) AS rapid, CAST(0 AS BIGINT) AS mismatches FROM enriched GROUP BY statement_id""")
def quick_summary(spark, d):
    rows = L.printed(spark, d)
    return exports.quick_summary(findings.enrich(rows), gates.recovery_rates(rows))


@query(f"""WITH {RICH_SQL}, f AS (SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY source_seq) AS place FROM enriched WHERE priority <> 'NORMAL'),
m AS (SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY i) AS place FROM marks),
parts AS (SELECT statement_id, 'top_review_rows' AS part, place FROM f WHERE place <= 60 UNION ALL SELECT statement_id, 'fund_flow', place FROM m WHERE place <= 40
  UNION ALL SELECT statement_id, 'summary', unnest(range(1, 15)) FROM (SELECT DISTINCT statement_id FROM accounts) UNION ALL SELECT statement_id, 'data_quality', unnest(range(1, 9)) FROM (SELECT DISTINCT statement_id FROM accounts))
SELECT statement_id, part, CAST(place AS INTEGER) AS place FROM parts""")
def assistant_context(spark, d):
    """Which entries there are; what they hold is that of the queries of their parts."""
    rows = L.printed(spark, d)
    # Three parts read these rows, of which this query needs these columns; on disk they are made once.
    rich = findings.enrich(rows).select(*rows.columns, "amount", "rail", "rapid", "q95", "q99", "priority").persist(StorageLevel.DISK_ONLY)
    return exports.assistant_context(findings.master(rows, enriched=rich), findings.flags(rich), findings.fund_flow(rows), findings.data_quality(rich)).select("statement_id", "part", "place")


@query(f"WITH {L.ACCOUNTS_SQL} SELECT statement_id, count(*) FILTER (WHERE NOT date BETWEEN DATE '1995-01-01' AND DATE '1997-06-30') AS removed FROM accounts GROUP BY statement_id")
def period_removed(spark, d):
    rows = L.accounts(spark, d)
    periods = rows.select("statement_id").distinct().select("statement_id", F.lit("1995-01-01").cast("date").alias("first_day"), F.lit("1997-06-30").cast("date").alias("last_day"))
    return exports.period_removed(rows, periods)


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type FROM e WHERE n = 1 ORDER BY event_id DESC LIMIT 25")
def session_history(spark, d):
    return C.upserted(L.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"""WITH {L.FAULTY_SQL}, b AS (SELECT *, lag(balance) OVER (PARTITION BY statement_id ORDER BY source_seq) AS before, coalesce(debit, credit) AS amount FROM faulty)
SELECT statement_id, source_seq, CASE WHEN abs(balance - before - amount) <= greatest(0.05, amount * 0.0001) THEN 'Credit' WHEN abs(balance - before + amount) <= greatest(0.05, amount * 0.0001) THEN 'Debit'
  WHEN source_seq % 12 IN (0, 2, 8) THEN 'Debit' ELSE 'Credit' END AS direction FROM b""")
def direction_inference(spark, d):
    from pyspark.sql import Window as W

    rows = L.faulty(spark, d).withColumn("before", F.lag("balance").over(W.partitionBy("statement_id").orderBy("source_seq")))
    return rows.select("statement_id", "source_seq", T.direction(F.col("narration"), F.coalesce("debit", "credit"), F.col("balance"), F.col("before")).alias("direction"))


@query(f"""WITH {L.FAULTY_SQL} SELECT statement_id, source_seq, round(balance, 2) AS cell, CASE WHEN source_seq % 2 = 0 THEN -abs(round(balance, 2)) ELSE round(balance, 2) END AS printed FROM faulty""")
def money_variants(spark, d):
    """Balances written out with commas, by their sign as a minus or as DR, and read by both parsers."""
    b = F.round("balance", 2)
    plain = F.format_string("%,.2f", F.abs(b))
    cell = F.when(b < 0, F.concat(plain, F.lit(" DR"))).when(b.isNotNull(), F.concat(F.lit("INR "), plain))
    word = F.when((F.col("source_seq") % 2 == 0) | (b < 0), F.concat(F.lit("-"), plain)).when(b.isNotNull(), plain)
    return L.faulty(spark, d).select("statement_id", "source_seq", T.money(cell).alias("cell"), T.printed_money(word).alias("printed"))


def judged_sql(source: str, out: str, lenient: str) -> str:
    """CTEs that judge every candidate (statement_id, method, seq, date, debit, credit, balance) of source."""
    turned = lambda of, before: f"SELECT * REPLACE (CASE WHEN {flip_sql(before)} THEN credit ELSE debit END AS debit, CASE WHEN {flip_sql(before)} THEN debit ELSE credit END AS credit) FROM {of}"
    w, move = "(PARTITION BY statement_id, method ORDER BY seq)", "coalesce(credit, 0) - coalesce(debit, 0) AS move"
    before = f"last_value(balance IGNORE NULLS) OVER (PARTITION BY statement_id, method ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before"
    return f"""{out}_b AS (SELECT *, {move}, {before}, date < lag(date) OVER {w} AS back, count(*) OVER (PARTITION BY statement_id, method, date, narration, debit, credit, balance) AS copies FROM {source}),
{out}_s AS (SELECT statement_id, method, count(*) AS n_rows, round(avg(CASE WHEN balance IS NOT NULL THEN 1 ELSE 0 END), 6) AS balance_rate, count(*) FILTER (WHERE abs(balance - (before + move)) > 0.01) AS mismatches, count(*) FILTER (WHERE back) AS reversals, count(*) FILTER (WHERE copies > 1) AS duplicates FROM {out}_b GROUP BY ALL),
{out}_1 AS (SELECT statement_id, method, seq, debit, credit, balance, {move}, lag(balance) OVER {w} AS lb FROM {source}), {out}_2 AS ({turned(out + '_1', 'lb')}),
{out}_3 AS (SELECT statement_id, method, seq, debit, credit, balance, {move}, {before} FROM {out}_2), {out}_4 AS ({turned(out + '_3', 'before')}),
{out}_5 AS (SELECT statement_id, method, seq, debit, credit, balance, {move}, before FROM {out}_4),
{out}_6 AS (SELECT statement_id, method, count(*) FILTER (WHERE abs(balance - (before + move)) > 0.01) AS wrong, min_by(balance - move, seq) AS starts, {sums('debit')} AS d, {sums('credit')} AS c, max_by(balance, seq) FILTER (WHERE balance IS NOT NULL) AS b FROM {out}_5 GROUP BY ALL),
{out}_7 AS (SELECT *, round(0.25 * least(n_rows, 10000) + 100 + 70 * balance_rate - 35 * mismatches - 2 * duplicates - 10 * reversals, 4) AS score, n_rows >= 10 AND balance_rate >= 0.95 AND mismatches = 0 AS proven, method = '{lenient}' AND wrong = 1 AS spared,
  CAST(statement_id AS BIGINT) % 4 <> 0 AND NOT coalesce(abs(starts - opening) <= 0.011, FALSE) AS conflict, CAST(statement_id AS BIGINT) % 5 <> 2 OR coalesce(abs(d - withdrawal) <= 0.01 AND abs(c - deposit) <= 0.01 AND abs(b - closing) <= 0.01, FALSE) AS agrees
  FROM {out}_s JOIN {out}_6 USING (statement_id, method) JOIN known USING (statement_id)),
{out} AS (SELECT *, CASE WHEN n_rows < 10 THEN 'too few rows' WHEN balance_rate < 0.4 THEN 'balances missing' WHEN mismatches > greatest(5, floor(n_rows * 0.25)) THEN 'too many mismatches' WHEN wrong > 0 AND NOT spared THEN 'balances do not follow'
  WHEN NOT spared AND NOT agrees THEN 'summary differs' WHEN NOT spared AND conflict AND NOT proven THEN 'opening differs' ELSE '' END AS reason FROM {out}_7)"""


SELECT_SQL = f"""WITH {L.EXTRACTIONS_SQL}, known AS (SELECT statement_id, min(opening) AS opening, {sums('debit')} AS withdrawal, {sums('credit')} AS deposit, max_by(balance, seq) AS closing FROM dated GROUP BY statement_id),
{judged_sql('extractions', 'judged', 'bands')}, placed AS (SELECT *, reason = '' AND row_number() OVER (PARTITION BY statement_id ORDER BY reason = '' DESC, score DESC, CASE method WHEN 'bands' THEN 1 WHEN 'layout' THEN 2 ELSE 3 END) = 1 AS chosen FROM judged),
none AS (SELECT statement_id FROM placed GROUP BY statement_id HAVING NOT bool_or(chosen)),
distinct_rows AS (SELECT e.*, row_number() OVER (PARTITION BY statement_id, date, CAST(debit AS DECIMAL(18,2)), CAST(credit AS DECIMAL(18,2)), CAST(balance AS DECIMAL(18,2)) ORDER BY score DESC, e.method, seq) AS nth, e.method AS m FROM extractions e SEMI JOIN none USING (statement_id) JOIN judged USING (statement_id, method)),
merged AS (SELECT statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY date, seq, m) AS seq, date, narration, debit, credit, balance, 'consensus' AS method FROM distinct_rows WHERE nth = 1),
{judged_sql('merged', 'again', '')}, every AS (SELECT statement_id, method, score, proven, conflict, spared, reason, chosen, balance_rate FROM placed UNION ALL SELECT statement_id, method, score, proven, conflict, spared, reason, reason = '', balance_rate FROM again),
rare AS (SELECT *, chosen AND CAST(statement_id AS BIGINT) % 2 = 0 AND balance_rate < 0.9 AS is_rare FROM every)
SELECT statement_id, method, score, proven, reason = '' AND (conflict OR spared) AS requires_review, CASE WHEN is_rare THEN 'balances too rare for the text' ELSE reason END AS reason, chosen AND NOT is_rare AS chosen FROM rare"""


@query(SELECT_SQL)
def select_extraction(spark, d):
    """Of three extractions of each account one is taken, by figures, integrity, summary, opening and coverage, or a consensus."""
    rows, sid = L.dated(spark, d), F.col("statement_id").cast("long")
    known = rows.groupBy("statement_id").agg(F.min("opening").alias("opening"), F.coalesce(F.sum(findings.cents("debit")), F.lit(0)).cast("double").alias("withdrawal"), F.coalesce(F.sum(findings.cents("credit")), F.lit(0)).cast("double").alias("deposit"), F.max_by("balance", "source_seq").alias("closing"))
    opening = known.where(sid % 4 != 0).select("statement_id", "opening", F.lit("explicit_opening").alias("source"))
    texts = known.select("statement_id", (sid % 2 == 0).alias("speaks"), F.lit(1.0).alias("text_ratio"))
    found = selection.selected(L.extractions(spark, d), ("bands", "layout", "table"), opening, known.where(sid % 5 == 2).drop("opening"), texts, lenient=("bands",))
    return found.select("statement_id", "method", "score", "proven", "requires_review", "reason", "chosen")


@query("""WITH p AS (SELECT source, CASE WHEN doc_id % 10 < CAST(substr(source, 4) AS BIGINT) % 10 THEN ' ' ELSE text END AS text FROM documents), r AS (SELECT source, round(avg(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END), 6) AS ratio FROM p GROUP BY source)
SELECT source, ratio, CASE WHEN ratio < 0.5 THEN 'PDF — Scanned/OCR' ELSE 'PDF — Digital native' END AS source_type, CASE WHEN ratio < 0.7 THEN 'Scanned' ELSE 'Digital' END AS mode FROM r""")
def doc_text_mode(spark, d):
    """Documents as pages of their source, some of them blank."""
    blank = F.col("doc_id") % 10 < F.substring("source", 4, 9).cast("long") % 10
    return gates.text_modes(L.table(spark, d, "documents").withColumn("text", F.when(blank, " ").otherwise(F.col("text"))), "source")


@query(f"""WITH {L.FAULTY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY source_seq) + 3 AS source_row FROM printed)
SELECT statement_id, CASE WHEN source_seq % 2 = 0 THEN 's1' ELSE 's3' END AS source_sheet, source_row, CAST(CASE WHEN source_seq % 2 = 0 THEN 1 ELSE 3 END AS BIGINT) * 1000000000 + source_row AS source_seq, date, debit, credit, round(balance, 2) AS balance FROM n""")
def src_multi_sheet_union(spark, d):
    return S.standardize_sheets(L.sheets(spark, d))[0].select("statement_id", "source_sheet", "source_row", "source_seq", "date", "debit", "credit", F.round("balance", 2).alias("balance"))


@query(f"""WITH {L.FAULTY_SQL}, c AS (SELECT statement_id, count(*) FILTER (WHERE source_seq % 2 = 0) AS a, count(*) FILTER (WHERE source_seq % 2 = 1) AS b FROM printed GROUP BY statement_id)
SELECT statement_id, 's1' AS sheet, 3 AS header_row, CAST(5 AS BIGINT) AS score, a AS n_rows, CASE WHEN a = 0 THEN 'no rows' ELSE '' END AS skipped FROM c UNION ALL SELECT statement_id, 's3', 3, 5, b, CASE WHEN b = 0 THEN 'no rows' ELSE '' END FROM c
UNION ALL SELECT statement_id, 's2', NULL, NULL, 0, 'no header' FROM c""")
def src_sheets(spark, d):
    return S.standardize_sheets(L.sheets(spark, d))[1]


#: Narrations of two words and a name by key, and the ordered rules of rails and categories, written out for another engine.
WORDS_SQL = """SELECT c_custkey, concat_ws(' ', (['PAID', 'RTGS', 'ACHDR LTD', 'to ZERODHA', 'LIC', 'Housingfina', 'gst on', 'interest', 'Electric', 'trf', 'cheque', 'Debit Card', 'NEFT', 'self'])[1 + c_custkey % 14],
  (['x', 'premium', 'EMI', 'jio', 'bank charges', 'ONLINE', 'cash deposit', 'imps', 'securities', 'credit card', 'cts'])[1 + c_custkey % 11], lower(c_mktsegment), c_name) AS narration, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS debit, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal END AS credit FROM customer"""


@query(f"""WITH t AS (SELECT *, upper(narration) AS x, coalesce(debit, 0) AS d, coalesce(credit, 0) AS c FROM ({WORDS_SQL}))
SELECT c_custkey, CASE WHEN regexp_matches(x, '\\bUPI\\b|UPI/|BHIM|PHONEPE|GPAY|GOOGLEPAY|PAYTM|VPA') THEN 'UPI' WHEN regexp_matches(x, '\\bIMPS\\b') THEN 'IMPS' WHEN regexp_matches(x, '\\bNEFT\\b') THEN 'NEFT' WHEN regexp_matches(x, '\\bRTGS\\b') THEN 'RTGS'
  WHEN regexp_matches(x, '\\bNACH\\b|\\bECS\\b|\\bACH\\b|ACHDR|NACHDR') THEN 'NACH/ECS/ACH' WHEN regexp_matches(x, '\\bATM\\b|CASH WITHDRAWAL|CASH DEPOSIT') THEN 'ATM/CASH' WHEN regexp_matches(x, '\\bCHQ\\b|\\bCHEQUE\\b|\\bCTS\\b|CAS PRES') THEN 'CHEQUE'
  WHEN regexp_matches(x, 'CREDIT CARD|DEBIT CARD|CARD PAYMENT|POS') THEN 'CARD' WHEN regexp_matches(x, 'BROKING|BROKER|ZERODHA|ANGEL ONE|ANGELONE|SECURITIES') THEN 'BROKING/INVESTMENT' WHEN regexp_matches(x, 'PREMIUM|INSURANCE|LIC') THEN 'INSURANCE/PREMIUM'
  WHEN regexp_matches(x, 'LOAN|HOUSINGFINA|PIRAMAL|EMI') THEN 'LOAN/FINANCE' WHEN regexp_matches(x, 'BANK CHARGES|CHARGES|GST ON') THEN 'BANK CHARGES' WHEN contains(x, 'INTEREST') THEN 'INTEREST' WHEN regexp_matches(x, 'RECHARGE|JIO|VODAFONE|ELECTRIC') THEN 'RECHARGE/UTILITY'
  WHEN regexp_matches(x, '\\bTFR\\b|TRANSFER|TRF') THEN 'TRANSFER' ELSE 'OTHER / UNIDENTIFIED' END AS rail,
CASE WHEN contains(x, 'CASH DEPOSIT') THEN 'Cash Deposit' WHEN contains(x, 'CASH WITHDRAWAL') THEN 'Cash Withdrawal' WHEN contains(x, 'BANK CHARGES') THEN 'Bank Charges' WHEN contains(x, 'INTEREST') THEN 'Interest' WHEN regexp_matches(x, 'PREMIUM|LIC') THEN 'Insurance / Premium'
  WHEN regexp_matches(x, 'LOAN|HOUSINGFINA|PIRAMAL|EMI') THEN 'Loan / Finance' WHEN regexp_matches(x, 'BROKING|ANGEL ONE|ZERODHA|SECURITIES') THEN 'Investment / Broking' WHEN contains(x, 'CREDIT CARD') THEN 'Credit Card' WHEN regexp_matches(x, 'RECHARGE|JIO|VODAFONE') THEN 'Recharge / Utility'
  WHEN regexp_matches(x, 'ONLINE|AMAZON|FLIPKART|SHOPSY') THEN 'Online / Merchant' WHEN contains(x, 'SELF') THEN 'Self / Internal' WHEN c > 0 AND d = 0 THEN 'Other Credit / Receipt' WHEN d > 0 AND c = 0 THEN 'Other Debit / Expense' ELSE 'Other' END AS category FROM t""")
def classify_narrations(spark, d):
    """Every rule of both lists in mixed narrations, so that their order decides."""
    k = F.col("c_custkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    one = pick(("PAID", "RTGS", "ACHDR LTD", "to ZERODHA", "LIC", "Housingfina", "gst on", "interest", "Electric", "trf", "cheque", "Debit Card", "NEFT", "self"))
    two = pick(("x", "premium", "EMI", "jio", "bank charges", "ONLINE", "cash deposit", "imps", "securities", "credit card", "cts"))
    rows = L.table(spark, d, "customer").select(k, F.concat_ws(" ", one, two, F.lower("c_mktsegment"), "c_name").alias("narration"), F.when(k % 3 == 0, F.col("c_acctbal")).alias("debit"), F.when(k % 3 == 1, F.col("c_acctbal")).alias("credit"))
    return rows.select(k, T.rail(F.col("narration")).alias("rail"), T.category(F.col("narration"), F.col("debit"), F.col("credit")).alias("category"))
