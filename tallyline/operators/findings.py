"""Findings: priorities for a human review, not conclusions. Each takes a ledger and returns a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import DEFAULT, Thresholds
from ..storage import released, shuffles_dropped, written
from .joins import Band, days_join
from .quantiles import quantiles
from .reconcile import balance_check, zero


def amount() -> Column:
    return zero("debit") + zero("credit")


def cents(value: Column | str) -> Column:
    """Money as an exact decimal, so that sums don't depend on their order."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(18,2)")


def _sides(ledger: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Dated credits and debits of at least `least`, named by role."""
    who = F.col("party") if "party" in ledger.columns else F.lit("")
    side = lambda name, prefix: ledger.where((F.col(name) >= least) & F.col("date").isNotNull()).select("statement_id", F.col("source_seq").alias(f"{prefix}_seq"), F.col("date").alias(f"{prefix}_date"), F.col(name).alias(name), T.party(who).alias(f"{prefix}_party"))
    return side("credit", "in"), side("debit", "out")


def fund_flow(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """A large credit and a debit of most of it within a day."""
    credits, _ = _sides(ledger, t.rapid_amount)
    _, debits = _sides(ledger, t.rapid_amount * t.rapid_share)
    return _onward(credits, debits, t)


def _onward(credits: DataFrame, debits: DataFrame, t: Thresholds) -> DataFrame:
    pairs = days_join(credits, debits, ["statement_id"], "in_date", "out_date", t.rapid_days, F.col("debit") >= t.rapid_share * F.col("credit"))
    return pairs.withColumn("share", F.round(F.col("debit") / F.col("credit"), 4))


def _leading(counts: DataFrame, most: int, *order: Column) -> DataFrame:
    """(statement_id, columns of counts but n): the groups that the first `most` rows of each statement lie in; counts: a row a group, n rows each."""
    before = F.coalesce(F.sum("n").over(W.partitionBy("statement_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before", before).where(F.col("before") < most).drop("before", "n")


def first_fund_flow(ledger: DataFrame, most: int, t: Thresholds = DEFAULT) -> DataFrame:
    """The pairs of `fund_flow` that the first `most` by (in_date, in_seq) of each statement are among.

    A credit has a pair if the largest debit that it may meet is large enough, so pairs needn't be made to find the first
    `most` credits with one; each brings a pair at least. Only these credits are joined then.
    """
    credits, _ = _sides(ledger, t.rapid_amount)
    _, debits = _sides(ledger, t.rapid_amount * t.rapid_share)
    tops = debits.groupBy("statement_id", "out_date").agg(F.max("debit").alias("top"))
    tops = tops.select("statement_id", F.explode(F.array(*(F.date_sub("out_date", k) for k in range(t.rapid_days + 1)))).alias("in_date"), "top").groupBy("statement_id", "in_date").agg(F.max("top").alias("top"))
    found = credits.join(tops, ["statement_id", "in_date"]).where(F.col("top") >= t.rapid_share * F.col("credit")).drop("top")
    days = _leading(found.groupBy("statement_id", "in_date").agg(F.count("*").alias("n")), most, F.col("in_date"))
    place = F.rank().over(W.partitionBy("statement_id").orderBy("in_date", "in_seq"))
    first = found.join(days, ["statement_id", "in_date"], "left_semi").withColumn("nth", place).where(F.col("nth") <= most).drop("nth")
    near = days.select("statement_id", F.explode(F.array(*(F.date_add("in_date", k) for k in range(t.rapid_days + 1)))).alias("out_date")).distinct()
    return _onward(first, debits.join(near, ["statement_id", "out_date"], "left_semi"), t)


def rapid_movement(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The rows that are part of such a pair."""
    pairs = fund_flow(ledger, t)
    marks = pairs.select("statement_id", F.col("in_seq").alias("source_seq")).union(pairs.select("statement_id", "out_seq")).distinct()
    return ledger.join(marks, ["statement_id", "source_seq"], "left_semi")


def bridge(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """A credit and a debit of about its amount within days, with a score."""
    return _bridges(*_sides(ledger, t.bridge_amount), t)


def _bridges(credits: DataFrame, debits: DataFrame, t: Thresholds) -> DataFrame:
    pairs = days_join(credits, debits, ["statement_id"], "in_date", "out_date", t.bridge_days, band=Band("credit", "debit", 1 - t.bridge_share, 1 + t.bridge_share))
    ratio, days = F.col("debit") / F.col("credit"), F.datediff("out_date", "in_date")
    score = F.when(F.abs(ratio - 1) <= 0.01, 40).when(F.abs(ratio - 1) <= 0.03, 25).otherwise(0) + F.when(days <= 1, 30).otherwise(15)
    score = score + F.when((F.col("in_party") != "") & (F.col("in_party") == F.col("out_party")), 20).otherwise(0)
    return pairs.withColumns({"days_gap": days, "ratio": F.round(ratio, 4), "score": score, "kind": F.when(F.abs(ratio - 1) <= 0.03, "near-exact").otherwise("similar-value")})


def chains(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The strongest bridges of each statement.

    All bridges are counted by score and day first, so that only those of the first groups are made again and put in order.
    """
    credits, debits = _sides(ledger, t.bridge_amount)
    group = ["statement_id", "score", "in_date"]
    groups = _leading(_bridges(credits, debits, t).groupBy(*group).agg(F.count("*").alias("n")), t.chains, F.desc("score"), F.col("in_date"))
    days = groups.select("statement_id", "in_date").distinct()
    near = days.select("statement_id", F.explode(F.array(*(F.date_add("in_date", k) for k in range(t.bridge_days + 1)))).alias("out_date")).distinct()
    some = _bridges(credits.join(days, ["statement_id", "in_date"], "left_semi"), debits.join(near, ["statement_id", "out_date"], "left_semi"), t)
    best = W.partitionBy("statement_id").orderBy(F.desc("score"), "in_date", "in_seq", "out_seq", "debit")
    rows = some.join(groups, group, "left_semi").withColumn("place", F.row_number().over(best)).where(F.col("place") <= t.chains)
    return rows.withColumn("priority", F.when(F.col("score") >= 70, "HIGH").otherwise("MEDIUM"))


def circles(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Money in from a party and out to the same one within days."""
    # Distinct rows on both sides make distinct pairs, which are many more.
    credits, debits = (side.distinct() for side in _sides(ledger, t.bridge_amount))
    ratio = F.col("debit") / F.col("credit")
    also = ratio.between(t.circle_low, t.circle_high)
    # The quotient decides; the band only deals amounts out, a little wider for what its products round away.
    band = Band("credit", "debit", t.circle_low - 1e-9, t.circle_high + 1e-9)
    credits, debits = credits.where("in_party <> ''"), debits.withColumn("in_party", F.col("out_party")).where("in_party <> ''")
    return days_join(credits, debits, ["statement_id", "in_party"], "in_date", "out_date", t.bridge_days, also, band).withColumn("ratio", F.round(ratio, 4))


def dormant(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Large rows after a long silence.

    Only the first row of a day can follow one, so silences are looked for among days, and no statement is put in order whole.
    """
    rows = ledger.where(F.col("date").isNotNull())
    days = rows.groupBy("statement_id", "date").agg(F.min(F.struct("source_seq")).alias("first"))
    days = days.withColumn("gap_days", F.datediff("date", F.lag("date").over(W.partitionBy("statement_id").orderBy("date")))).where(F.col("gap_days") >= t.dormant_days)
    days = days.select(F.col("statement_id").alias("of"), F.col("date").alias("day"), "first", "gap_days")
    found = rows.join(days, F.col("statement_id").eqNullSafe(F.col("of")) & (F.col("date") == F.col("day")) & (F.struct("source_seq") == F.col("first")))
    # Of rows of one number the first is a single one.
    nth = F.row_number().over(W.partitionBy("statement_id", "date").orderBy("source_seq"))
    found = found.withColumn("nth", nth).where("nth = 1").drop("nth", "first")
    return found.where(amount() >= max(t.bridge_amount, t.dormant_amount)).select(*ledger.columns, "gap_days")


def behaviour(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Rows of several times the party's median amount."""
    rows = ledger.withColumns({"party_key": T.party(F.col("party")), "amount": amount()}).where((F.col("amount") > 0) & (F.col("party_key") != ""))
    base = quantiles(rows, ["statement_id", "party_key"], "amount", {"median_amount": 0.5}).withColumnRenamed("n", "party_rows").where(F.col("party_rows") >= t.behaviour_rows)
    found = rows.join(base, ["statement_id", "party_key"])
    found = found.where((F.col("amount") >= t.bridge_amount) & (F.col("amount") >= t.behaviour_times * F.col("median_amount")))
    return found.withColumn("times", F.round(F.col("amount") / F.col("median_amount"), 2))


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once; counted before the join, so a hot key is one row on its side."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
    return rows.join(many, keys)


def duplicates(ledger: DataFrame) -> DataFrame:
    """Rows of equal date, narration and amounts; all of them."""
    rows = ledger.where(F.col("date").isNotNull()).withColumns({"same_text": F.coalesce("narration", F.lit("")), "same_debit": F.coalesce(cents("debit"), cents(F.lit(-1))), "same_credit": F.coalesce(cents("credit"), cents(F.lit(-1)))})
    return _repeated(rows, ["statement_id", "date", "same_text", "same_debit", "same_credit"]).drop("same_text", "same_debit", "same_credit")


def fingerprints(ledger: DataFrame) -> DataFrame:
    """Rows whose date, amount, rail, party and reference repeat."""
    rows, named = _fingerprinted(ledger)
    found = named.join(_same(named), ["statement_id", "fingerprint"])
    found = found.select(*(F.col(k).alias(f"same_{k}") for k in FINGERPRINTED), "fingerprint", "copies")
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"same_{k}")) for k in FINGERPRINTED[1:]), F.col("statement_id") == F.col("same_statement_id"))
    return rows.join(found, on).select("statement_id", "fingerprint", *(c for c in ledger.columns if c != "statement_id"), "copies")


#: What a fingerprint is made of; rows that have the same are known by it before any text is made.
FINGERPRINTED = ("statement_id", "moved", "date", "rail", "party", "reference")


def _fingerprinted(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ledger with its amounts as `moved`, and each combination of FINGERPRINTED with its rows (n) and its fingerprint."""
    rows = ledger.withColumn("moved", cents(amount()))
    reference = F.substring(F.upper(F.regexp_replace(F.coalesce("reference", F.lit("")), r"\s", "")), 1, 32)
    parts = [F.coalesce(F.date_format("date", "yyyyMMdd"), F.lit("NA")), F.col("moved").cast("string"), F.col("rail"), T.party(F.col("party")), reference]
    return rows, rows.groupBy(*FINGERPRINTED).agg(F.count("*").alias("n")).withColumn("fingerprint", F.concat_ws("|", *parts))


def _same(named: DataFrame) -> DataFrame:
    """(statement_id, fingerprint, copies) of fingerprints that several rows have."""
    return named.groupBy("statement_id", "fingerprint").agg(F.sum("n").alias("copies")).where("copies > 1")


def velocity(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Rows of days that have many."""
    many = ledger.where(F.col("date").isNotNull()).groupBy("statement_id", "date").agg(F.count("*").alias("day_rows")).where(F.col("day_rows") >= t.velocity_rows)
    return ledger.join(many, ["statement_id", "date"])


def round_values(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return ledger.where((amount() >= t.round_amount) & (F.pmod(cents(amount()), F.lit(t.round_step).cast("decimal(18,2)")) == 0))


def totals(ledger: DataFrame) -> DataFrame:
    """Rows, sums, net and period of each statement."""
    sums = {k: F.coalesce(F.sum(cents(k)), F.lit(0)) for k in ("credit", "debit")}
    return ledger.groupBy("statement_id").agg(F.count("*").alias("n_rows"), sums["credit"].cast("double").alias("credits"), sums["debit"].cast("double").alias("debits"), (sums["credit"] - sums["debit"]).cast("double").alias("net"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def percentiles(ledger: DataFrame) -> DataFrame:
    """Exact 95 and 99 % points of the positive amounts of each statement."""
    found = quantiles(ledger.withColumn("amount", amount()), ["statement_id"], "amount", {"q95": 0.95, "q99": 0.99})
    return found.select("statement_id", F.round("q95", 4).alias("q95"), F.round("q99", 4).alias("q99"))


# Reasons for a review.
TOP_1, TOP_5, UNNAMED, ONWARD = "Top 1% by transaction amount", "Top 5% by transaction amount", "Payment rail not identified from narration", "Same/next-day large onward movement"


def classified(ledger: DataFrame) -> DataFrame:
    """Rows with identifiers apart from narrations, and rail, counterparty, category and particulars from both."""
    narration, reference = T.cleaned_reference(F.col("narration"), F.col("reference"))
    rows = ledger.withColumns({"narration": narration, "reference": reference})
    rows = rows.withColumn("evidence", F.trim(F.concat_ws(" ", "narration", "reference")))
    evidence = F.col("evidence")
    return rows.withColumns({"rail": T.rail(evidence), "counterparty": T.counterparty(evidence), "category": T.category(evidence, F.col("debit"), F.col("credit")), "particulars": T.particulars(evidence, F.col("debit"), F.col("credit")), "amount": amount()}).drop("evidence")


def enrich(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Rail, counterparty, category and particulars of each row, why it stands out and its priority.

    q95 and q99, the statement's percentiles of positive amounts, stay as columns for what is counted by them later.
    """
    rows = classified(ledger).join(percentiles(ledger), "statement_id", "left")
    rapid = rapid_movement(ledger, t).select("statement_id", "source_seq").distinct().withColumn("is_rapid", F.lit(True))
    rows = rows.join(rapid, ["statement_id", "source_seq"], "left").withColumn("rapid", F.coalesce("is_rapid", F.lit(False))).drop("is_rapid")
    top = F.when((F.col("amount") > 0) & (F.col("amount") >= F.col("q99")), TOP_1).when((F.col("amount") > 0) & (F.col("amount") >= F.col("q95")), TOP_5)
    reasons = F.array_compact(F.array(top, F.when(F.col("rail") == T.NO_RAIL, UNNAMED), F.when(F.col("rapid"), ONWARD)))
    critical = (F.col("amount") >= F.greatest(F.coalesce("q99", F.lit(0.0)), F.lit(t.critical_amount))) | F.col("rapid")
    rows = rows.withColumn("reason", F.array_join(reasons, "; "))
    return rows.withColumn("priority", F.when(critical, "CRITICAL").when(F.col("reason") != "", "REVIEW").otherwise("NORMAL"))


def flags(enriched: DataFrame) -> DataFrame:
    return enriched.where(F.col("priority").isin("REVIEW", "CRITICAL"))


def profile(enriched: DataFrame, by: str) -> DataFrame:
    """Rows and sums by rail, category or any other column; nulls are a group."""
    return enriched.groupBy(by).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(cents("credit")), F.lit(0)).cast("double").alias("credits"), F.coalesce(F.sum(cents("debit")), F.lit(0)).cast("double").alias("debits"))


def flow(enriched: DataFrame) -> DataFrame:
    """Profiles by rail and by category in one table."""
    part = lambda by, name: profile(enriched, by).select(F.lit(name).alias("section"), F.col(by).alias("name"), "n_rows", "credits", "debits")
    return part("rail", "Rail").unionByName(part("category", "Category"))


def concentration(ledger: DataFrame) -> DataFrame:
    """Sums, shares and period of each party; place: by credits, then debits, largest first.

    Shares are of what the statement's rows with a party add up to; 0 where that is nothing. Rows without a party count nowhere.
    """
    rows = ledger.withColumn("party_key", T.party(F.col("party"))).where("party_key != ''")
    sums = lambda c: F.coalesce(F.sum(cents(c)), F.lit(0))
    by = rows.groupBy("statement_id", "party_key").agg(F.count("*").alias("n_rows"), sums("credit").alias("c"), sums("debit").alias("d"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    whole = by.groupBy("statement_id").agg(F.sum("c").alias("credits"), F.sum("d").alias("debits"))
    share = lambda part, all_: F.round(F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(all_).cast("double")), F.lit(0.0)), 6)
    place = F.row_number().over(W.partitionBy("statement_id").orderBy(F.desc("c"), F.desc("d"), "party_key"))
    return by.join(whole, "statement_id").select("statement_id", "party_key", "n_rows", F.col("c").cast("double").alias("party_credits"), F.col("d").cast("double").alias("party_debits"), share("c", "credits").alias("credit_share"), share("d", "debits").alias("debit_share"), (F.col("c") - F.col("d")).cast("double").alias("net"), "first_date", "last_date", place.alias("place"))


# Counters of data quality and what they mean.
QUALITY = {
    "Rows extracted": "Total normalized transactions",
    "Missing transaction date": "Date not extracted",
    "Missing both debit and credit": "No monetary movement recorded",
    "Missing reported balance": "Balance unavailable in source",
    "Unidentified rail": "Classification limitation; not a fraud finding",
    "Potential duplicate rows": "Requires source verification",
    "Balance mismatches": "Sequential reconciliation",
    "Balance evidence gaps": "Source-gap/reset points; no transaction fabricated",
}


def _tall(wide: DataFrame, names: list[str], name: str, **columns: Column) -> DataFrame:
    """A row for each of names, with the columns that each of them is made of: lists in the order of names."""
    cells = F.array(*(F.struct(F.lit(k + 1).alias("place"), F.lit(n).alias(name), *(v[k].alias(c) for c, v in columns.items())) for k, n in enumerate(names)))
    return wide.select("statement_id", F.inline(cells))


def data_quality(enriched: DataFrame) -> DataFrame:
    """Counters of each statement, a row each, in order."""
    checked = balance_check(enriched)
    same = duplicates(enriched).groupBy("statement_id").agg(F.count("*").alias("same"))
    counts = checked.groupBy("statement_id").agg(
        F.count("*").alias("all"), F.count_if(F.col("date").isNull()).alias("undated"), F.count_if(amount() == 0).alias("still"),
        F.count_if(F.col("balance").isNull()).alias("blank"), F.count_if(F.col("rail") == T.NO_RAIL).alias("unnamed"),
        F.count_if(F.col("status") == "MISMATCH").alias("wrong"), F.count_if("gap_explained").alias("gaps"),
    ).join(same, "statement_id", "left").fillna(0, ["same"])
    values = [F.col(c) for c in ("all", "undated", "still", "blank", "unnamed", "same", "wrong", "gaps")]
    return _tall(counts, list(QUALITY), "counter", n=values, meaning=[F.lit(m) for m in QUALITY.values()])


# Areas of findings and what an investigator has to ask about each.
QUESTIONS = {
    "Fund trail": "Which source credit is followed by a near-equal debit, and what supporting invoice/loan/asset document explains the movement?",
    "Circularity": "Do the near-equal inflow/outflow pairs represent genuine consideration or circular movement between related parties?",
    "Dormant activation": "What changed immediately before the account became active after the long inactivity period?",
    "Behaviour deviation": "Why do these transactions materially exceed the counterparty's normal observed transaction size?",
    "Repeated fingerprint": "Are repeated transaction fingerprints genuine recurring payments or duplicate/constructed entries?",
    "No bridge anomaly": "No configured bridge anomaly was identified; absence of a flag is not proof of absence of irregularity.",
}


def questions(ledger: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """What to ask about each statement: a row for each kind of finding that has rows, or one that says there are none.

    The ledger is written once, and the kinds are counted one after the other, so the shuffles of one kind alone are on disk at a time.
    """
    columns = ["statement_id", "source_seq", "date", "debit", "credit", "party", "rail", "reference"]
    rows = written(ledger.select(*columns), "ledger")
    shuffles_dropped(rows)
    kinds = [lambda: bridge(rows, t), lambda: circles(rows, t), lambda: dormant(rows, t), lambda: behaviour(rows, t), lambda: _same(_fingerprinted(rows)[1])]
    counts = []
    for k, kind in enumerate(kinds):
        n = F.sum("copies") if k == len(kinds) - 1 else F.count("*")
        counts.append(written(kind().groupBy("statement_id").agg(n.alias("n")).select("statement_id", F.lit(k).alias("k"), "n"), "counts"))
        shuffles_dropped(rows)
    every = written(rows.select("statement_id").distinct().select("statement_id", F.lit(len(kinds)).alias("k"), F.lit(0).cast("long").alias("n")), "statements")
    released(rows)
    found = reduce(DataFrame.unionByName, counts)
    none = every.join(found.select("statement_id").distinct(), "statement_id", "left_anti")
    text = lambda words: F.element_at(F.array(*map(F.lit, words)), F.col("k") + 1)
    return found.unionByName(none).select("statement_id", text(QUESTIONS).alias("area"), F.col("n").alias("cases"), text(QUESTIONS.values()).alias("question"))


# The main findings, what each is based on, what it is for and its status if it says nothing else.
MASTER = [
    ("Transaction volume", "Entire evidence set", "Factual scope", "INFORMATIONAL"),
    ("Period covered", "Transaction dates", "Coverage", "INFORMATIONAL"),
    ("Total credits", "Credit column", "Funds received", "INFORMATIONAL"),
    ("Total debits", "Debit column", "Funds paid/out", "INFORMATIONAL"),
    ("Net flow", "Credits minus debits", "Aggregate flow", "INFORMATIONAL"),
    ("Top 1% amount transactions", "Unavailable", "High-value review", "REVIEW"),
    ("Top 5% amount transactions", "Unavailable", "High-value review", "REVIEW"),
    ("Rapid same/next-day onward movements", "Credit followed by >=80% debit within 1 day", "Fund-flow review", "REVIEW"),
    ("Large round-value transactions", ">= ₹50,000 and multiple of ₹10,000", "Pattern review", "REVIEW"),
    ("High transaction-velocity rows", "15+ transactions on same date", "Activity-pattern review", "REVIEW"),
    ("Potential duplicate rows", "Same date + narration + debit + credit", "Data-quality review", "REVIEW"),
    ("Cash/ATM activity", "Payment rail classification", "Cash-flow review", "REVIEW"),
    ("Unidentified payment rail", "Narration did not expose a known rail", "Data-quality only; not suspicious by itself", "DATA QUALITY"),
    ("Balance mismatches", "Sequential balance reconciliation", "Evidence integrity", "CRITICAL"),
]


def master(ledger: DataFrame, t: Thresholds = DEFAULT, enriched: DataFrame | None = None) -> DataFrame:
    """The main figures of each statement, a row each in order: value (of the period: text), basis, interpretation, status.

    enriched: what `enrich` makes of ledger, where that is at hand.
    """
    rich = enrich(ledger, t) if enriched is None else enriched
    per_day = velocity(ledger, t).groupBy("statement_id").agg(F.count("*").alias("velocity"))
    same = duplicates(ledger).groupBy("statement_id").agg(F.count("*").alias("same"))
    wrong = balance_check(ledger).groupBy("statement_id").agg(F.count_if(F.col("status") == "MISMATCH").alias("wrong"))
    is_round = (amount() >= t.round_amount) & (F.pmod(cents(amount()), F.lit(t.round_step).cast("decimal(18,2)")) == 0)
    total = lambda c: F.coalesce(F.sum(cents(c)), F.lit(0))
    base = rich.groupBy("statement_id").agg(
        F.count("*").alias("all"), total("credit").alias("credits"), total("debit").alias("debits"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.first("q95").alias("q95"), F.first("q99").alias("q99"),
        F.count_if(F.col("amount") >= F.col("q99")).alias("top1"), F.count_if(F.col("amount") >= F.col("q95")).alias("top5"),
        F.count_if("rapid").alias("rapid"), F.count_if(is_round).alias("round"), F.count_if(F.col("rail") == "ATM/CASH").alias("cash"), F.count_if(F.col("rail") == T.NO_RAIL).alias("unnamed"),
    )
    for part in (per_day, same, wrong):
        base = base.join(part, "statement_id", "left")
    day = lambda c: F.coalesce(F.date_format(c, "dd-MM-yyyy"), F.lit("-"))
    order = ("all", None, "credits", "debits", None, "top1", "top5", "rapid", "round", "velocity", "same", "cash", "unnamed", "wrong")
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c else F.lit(None).cast("double") for c in order]
    values[4] = (F.col("credits") - F.col("debits")).cast("double")
    texts = [F.lit(None).cast("string") for _ in MASTER]
    texts[1] = F.concat(day("first_date"), F.lit(" to "), day("last_date"))
    basis = [F.lit(b) for _, b, _, _ in MASTER]
    for k, q in ((5, "q99"), (6, "q95")):
        basis[k] = F.when(F.col(q).isNull(), basis[k]).otherwise(F.concat(F.lit("Threshold ₹"), F.format_number(q, 2)))
    status = [F.lit(s) for *_, s in MASTER]
    status[13] = F.when(values[13] > 0, "CRITICAL").otherwise("PASS")
    return _tall(base, [m[0] for m in MASTER], "finding", value=values, value_text=texts, basis=basis, interpretation=[F.lit(i) for _, _, i, _ in MASTER], status=status)
