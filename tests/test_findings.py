"""Findings on small ledgers whose results are worked out by hand, and quantiles against sorted lists."""

import dataclasses
import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyline.functions import text as T
from tallyline.operators import candidates, exports, findings, gates, selection
from tallyline.operators.joins import PARTS, Band, days_join
from tallyline.operators.quantiles import quantiles
from tallyline.schema import DEFAULT

SCHEMA = "statement_id string, source_seq long, date date, narration string, reference string, debit double, credit double, balance double, party string, rail string"


def ledger(spark, rows):
    """rows: (day of January, debit, credit, balance, party)."""
    day = lambda k: None if k is None else datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    return spark.createDataFrame([("s", n, day(k), f"row {n}", "", d, c, b, p, "OTHER") for n, (k, d, c, b, p) in enumerate(rows)], SCHEMA)


def linear(values, q):
    h = (len(values) - 1) * q
    low = int(h)
    high = min(low + 1, len(values) - 1) if h > low else low
    return values[low] + (values[high] - values[low]) * (h - low)


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles(spark, seed):
    """Keys of one row, of a value repeated, of values over many sizes; nulls, zeros and negatives don't count."""
    r = random.Random(seed)
    values = {"one": [7.0], "same": [3.5] * 500, "wide": [10 ** r.uniform(-3, 9) for _ in range(700)], "near": [100 + r.random() for _ in range(301)], "cents": [r.randint(1, 400) / 100 for _ in range(900)]}
    rows = [(k, v) for k, some in values.items() for v in some] + [("one", None), ("one", 0.0), ("wide", -5.0), ("none", None)]
    r.shuffle(rows)
    found = quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"a": 0.5, "b": 0.95, "c": 1.0, "d": 0.0}).collect()
    assert {row["k"] for row in found} == set(values)
    for row in found:
        some = sorted(values[row["k"]])
        assert row["n"] == len(some)
        for name, q in (("a", 0.5), ("b", 0.95), ("c", 1.0), ("d", 0.0)):
            assert row[name] == pytest.approx(linear(some, q), rel=1e-12)


def test_band_join_is_the_plain_one(spark):
    r = random.Random(4)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=r.randint(0, 12))
    left = [("s", k, day(), float(r.choice([100, 97, 103, 1000, 0.5, r.randint(1, 2000)]))) for k in range(120)]
    right = [("s", k, day(), r.choice([1.0, 0.97, 1.03]) * left[r.randrange(120)][3]) for k in range(120)] + [("s", 500, day(), 0.0), ("s", 501, day(), None)]
    a, b = spark.createDataFrame(left, "statement_id string, i long, d1 date, c double"), spark.createDataFrame(right, "statement_id string, j long, d2 date, e double")
    got = {(x["i"], x["j"]) for x in days_join(a, b, ["statement_id"], "d1", "d2", 3, band=Band("c", "e", 0.97, 1.03)).collect()}
    assert got == {(i, j) for _, i, d1, c in left for _, j, d2, e in right if e is not None and 0 <= (d2 - d1).days <= 3 and c * 0.97 <= e <= c * 1.03}


def test_shares_are_of_rows_with_a_party(spark):
    rows = ledger(spark, [(1, None, 100.0, None, "ABC"), (2, None, 300.0, None, " - "), (3, None, None, None, "XYZ"), (4, None, 300.0, None, None)])
    found = {r["party_key"]: (r["credit_share"], r["debit_share"], r["place"]) for r in findings.concentration(rows).collect()}
    assert found == {"ABC": (1.0, 0.0, 1), "XYZ": (0.0, 0.0, 2)}


@pytest.mark.parametrize("rows, reason", [
    ([(1, 5.0, None, 95.0, "")], ""), ([(None, 5.0, None, 95.0, "")], "undated rows"), ([(1, 5.0, 0.0, 95.0, "")], "both sides in a row"),
    ([(1, float("inf"), None, 95.0, "")], "amounts that are not finite"), ([(1, None, 5.0, float("nan"), "")], "amounts that are not finite"), ([(1, -5.0, None, 95.0, "")], "negative amounts"),
    ([(1, None, None, 95.0, "")], "movements missing"), ([(9 - k, 1.0, None, None, "") for k in range(5)], "dates run backwards"), ([(1, 5.0, None, 95.0, ""), (2, 5.0, None, 80.0, "")], "balances do not follow"),
])
def test_integrity_names_the_first_broken_rule(spark, rows, reason):
    found = gates.integrity(ledger(spark, rows)).first()
    assert (found["reason"], found["passed"]) == (reason, reason == "")


def test_summary_anchor_detects_wrong_extraction(spark):
    rows = ledger(spark, [(1, 100.0, None, 1400.0, ""), (2, None, 300.0, 1700.0, "")])
    summary = lambda w: spark.createDataFrame([("s", w, 300.0, 1700.0)], "statement_id string, withdrawal double, deposit double, closing double")
    assert gates.summary_anchor(rows, summary(100.0)).first()["matched"] and not gates.summary_anchor(rows, summary(100.02)).first()["matched"]


def test_reference_is_cleaned_before_rows_are_named(spark):
    """What stands in the reference beside its identifier belongs to the narration, and is seen by the rules."""
    rows = ledger(spark, [(1, 5.0, None, None, "")]).withColumns({"narration": F.lit("payment"), "reference": F.lit("UPI/ABC1234567 SALARY")})
    found = findings.enrich(rows).first()
    assert (found["narration"], found["reference"], found["rail"]) == ("payment SALARY", "UPI/ABC1234567", "UPI")
    assert found["reason"] == findings.TOP_1


def test_questions_of_a_quiet_statement(spark):
    rows = ledger(spark, [(1, 5.0, None, None, "A"), (2, None, 7.0, None, "B")])
    assert [(r["area"], r["cases"]) for r in findings.questions(rows).collect()] == [("No bridge anomaly", 0)]
    busy = ledger(spark, [(1, None, 100000.0, None, "A"), (2, 100000.0, None, None, "A"), (2, 100000.0, None, None, "A")])
    found = {r["area"]: (r["cases"], r["question"]) for r in findings.questions(busy).collect()}
    assert set(found) == {"Fund trail", "Circularity", "Repeated fingerprint"} and found["Fund trail"][0] == 2
    assert all("fraud" not in q.lower() for _, q in found.values())


def test_questions_make_the_ledger_once(spark, monkeypatch):
    """Kinds are counted one after the other from a written ledger; the ledger's own plan is run once."""
    made, plain = [], findings.written
    rows = ledger(spark, [(1, None, 100000.0, None, "A"), (2, 100000.0, None, None, "A")])
    monkeypatch.setattr(findings, "written", lambda df, name: made.append((name, df.inputFiles())) or plain(df, name))
    findings.questions(rows)
    assert [name for name, _ in made] == ["ledger", *["counts"] * 5, "statements"]
    assert all("tallyline-ledger-" in f for _, files in made[1:] for f in files) and all(files for _, files in made[1:])


def test_tables_in_order(spark):
    rows = ledger(spark, [(1, None, 100.0, 100.0, "A"), (2, 30.0, None, 70.0, "B"), (3, 30.0, None, 50.0, "B")])
    rich = findings.enrich(rows)
    assert [r["finding"] for r in findings.master(rows).orderBy("place").collect()] == [m[0] for m in findings.MASTER]
    found = {r["metric"]: (r["value"], r["value_text"]) for r in exports.summary(rich, gates.recovery_rates(rows)).collect()}
    assert list(found) and found["Net Flow"] == (40.0, None) and found["Balance Mismatches"] == (1.0, None) and found["Source"] == (None, "-")
    assert {r["counter"]: r["n"] for r in findings.data_quality(rich).collect()}["Balance mismatches"] == 1


def extraction(spark, method, wrong=0, n=12, opening=1000.0):
    """n rows of 10, `wrong` of them with balances that don't follow."""
    rows, balance = [], opening
    for k in range(n):
        balance += 10.0
        rows.append(("s", k, datetime.date(2024, 1, 1 + k), f"r{k}", None, 10.0, balance + (500.0 if k and k <= wrong else 0.0), method))
    return spark.createDataFrame(rows, "statement_id string, source_seq long, date date, narration string, debit double, credit double, balance double, method string")


def test_selection(spark):
    """The proven candidate wins; an opening that conflicts leaves it for review or, without proof, rejects it and the consensus
    of what there is; a mismatch rejects, unless the method is lenient and it is the only one; rare balances reject in the end."""
    named = lambda df, sid: df.withColumn("statement_id", F.lit(sid))
    clean, balance = extraction(spark, "b"), F.col("balance")
    both = extraction(spark, "a", wrong=1).unionByName(clean)
    short = clean.withColumn("balance", F.when(F.col("source_seq") < 10, balance))  # too few balances for proof
    some = clean.withColumn("balance", F.when(F.col("source_seq") < 8, balance))
    last = extraction(spark, "a").withColumn("balance", F.when(F.col("source_seq") == 11, balance + 500).otherwise(balance))
    rows = None
    for sid, part in (("plain", both), ("opened", both), ("short", short), ("last", last), ("digital", some), ("scanned", some)):
        rows = named(part, sid) if rows is None else rows.unionByName(named(part, sid))
    opening = spark.createDataFrame([("opened", 900.0, "explicit_opening"), ("short", 900.0, "explicit_opening")], "statement_id string, opening double, source string")
    texts = spark.createDataFrame([("digital", True, 1.0), ("scanned", True, 0.2), ("plain", False, 1.0)], "statement_id string, speaks boolean, text_ratio double")
    verdicts = selection.selected(rows, ("a", "b"), opening=opening, texts=texts)
    found = {(r["statement_id"], r["method"]): (r["reason"], r["chosen"], r["requires_review"]) for r in verdicts.collect()}
    assert found["plain", "a"] == found["opened", "a"] == found["last", "a"] == ("balances do not follow", False, False)
    assert found["plain", "b"] == ("", True, False) and found["opened", "b"] == ("", True, True)
    assert found["short", "b"][0] == found["short", "consensus"][0] == "opening differs"
    assert found["digital", "b"][:2] == ("balances too rare for the text", False) and found["scanned", "b"][:2] == ("", True)
    taken = selection.selected_rows(rows, verdicts, ("a", "b")).groupBy("statement_id", "method").agg(F.count("*").alias("n"), F.max("look_at").alias("odd")).collect()
    assert {tuple(r) for r in taken} == {("plain", "b", 12, False), ("opened", "b", 12, False), ("scanned", "b", 12, False)}
    spared = {r["statement_id"]: (r["reason"], r["chosen"], r["requires_review"]) for r in selection.judged(named(extraction(spark, "a", wrong=2), "two").unionByName(named(last, "one")), lenient=("a",)).withColumn("chosen", F.col("reason") == "").collect()}
    assert spared == {"one": ("", True, True), "two": ("balances do not follow", False, False)}


def test_consensus(spark):
    """Two halves that fail alone are one statement together."""
    whole = extraction(spark, "a")
    halves = whole.where("source_seq < 8").unionByName(whole.where("source_seq > 4").withColumn("method", F.lit("b")))
    found = {r["method"]: (r["reason"], r["chosen"], r["n_rows"]) for r in selection.selected(halves, ("a", "b")).collect()}
    assert found == {"a": ("too few rows", False, 8), "b": ("too few rows", False, 7), "consensus": ("", True, 12)}
    assert selection.selected_rows(halves, selection.selected(halves, ("a", "b")), ("a", "b")).count() == 12


def test_normalized_candidates(spark):
    """Sides are only put right where a statement has a row with both; rows of unlike source rows both stay."""
    rows = spark.createDataFrame([("s", 0, "2024-01-01", None, 5.0, 105.0), ("s", 1, "2024-01-02", 7.0, None, 112.0), ("t", 0, "2024-01-01", None, 5.0, 105.0), ("t", 1, "2024-01-02", 7.0, None, 112.0), ("t", 2, "2024-01-03", 1.0, 2.0, None), ("t", 3, "x", 1.0, None, None)], "statement_id string, source_seq long, date string, debit double, credit double, balance double")
    found = {(r["statement_id"], r["source_seq"]): (r["debit"], r["credit"]) for r in candidates.normalized(rows).collect()}
    assert found == {("s", 0): (None, 5.0), ("s", 1): (7.0, None), ("t", 0): (None, 5.0), ("t", 1): (None, 7.0), ("t", 2): (1.0, 2.0)}
    same = candidates.normalized(rows.where("source_seq = 0").union(rows.where("source_seq = 0")))
    assert candidates.deduplicated(same).count() == 2
    assert candidates.deduplicated(same.withColumn("source_row", F.monotonically_increasing_id())).count() == 4


def test_first_fund_flow_has_the_first_pairs(spark):
    """The first pairs of a report are those of all pairs, though only the first credits with a pair are joined."""
    rows = ledger(spark, [(1 + k // 4, None, 100_000.0 + k, None, "") if k % 4 < 2 else (1 + k // 4, 70_000.0 + 3_000 * k, None, None, "") for k in range(60)])
    first = lambda pairs: [(r["in_seq"], r["out_seq"], r["place"]) for r in exports.report_fund_flow(pairs, 7).orderBy("place").collect()]
    whole, some = findings.fund_flow(rows), findings.first_fund_flow(rows, 7)
    assert len(first(whole)) == 7 and first(some) == first(whole)
    assert some.select("in_seq").distinct().count() <= 7 < whole.select("in_seq").distinct().count()


def test_chains_order_few_bridges(spark):
    """The strongest bridges are ordered without putting all of them in order: what a window sees is the first groups."""
    rows = ledger(spark, [(1 + k // 2, None, 60_000.0 + 500 * (k % 7), None, "") if k % 2 else (1 + k // 2, 60_000.0 + 300 * (k % 11), None, None, "") for k in range(80)])
    t = dataclasses.replace(DEFAULT, chains=6)
    every = findings.bridge(rows).collect()
    wanted = sorted((-r["score"], r["in_date"], r["in_seq"], r["out_seq"]) for r in every)[:6]
    assert len(every) > 60 and sorted((-r["score"], r["in_date"], r["in_seq"], r["out_seq"]) for r in findings.chains(rows, t).collect()) == wanted
    plan = findings.chains(rows, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan  # bridges are cut down to the first groups before they are put in order


def test_dormant_is_a_days_first_row(spark):
    rows = ledger(spark, [(1, None, 200_000.0, None, ""), (None, None, 200_000.0, None, "")]).unionByName(ledger(spark, [(1, None, 200_000.0, None, "")] * 2).withColumn("date", F.date_add("date", 200)))
    found = [(r["source_seq"], r["gap_days"]) for r in findings.dormant(rows).collect()]
    assert found == [(0, 200)]
    plan = findings.dormant(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(date" in plan and "Aggregate [statement_id" in plan


def test_circles_are_distinct_before_they_are_paired(spark):
    rows = ledger(spark, [(1, None, 60_000.0, None, ""), (2, 60_000.0, None, None, "")]).withColumn("party", F.lit("Acme"))
    twice = rows.unionByName(rows)
    assert findings.circles(twice).count() == 1
    assert findings.circles(twice)._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].lstrip().startswith("Project")


@pytest.mark.parametrize("name, key", [(None, ""), ("", ""), (" n.a. ", ""), ("N/A", ""), ("unknown!", ""), ("Acme  & Co.\n", "ACME CO"), ("NA x", "NA X")])
def test_party_keys(spark, name, key):
    assert spark.createDataFrame([(name,)], "p string").select(T.party(F.col("p"))).first()[0] == key


def test_pairs_are_made_in_many_parts(spark):
    """The parts that pairs are made in aren't put together by the bytes of the rows."""
    rows = ledger(spark, [(1, None, 200_000.0, None, ""), (2, 190_000.0, None, None, "")])
    assert findings.fund_flow(rows).rdd.getNumPartitions() == PARTS


def test_fingerprints_are_made_once_for_like_rows(spark):
    """Rows with nulls and with other spellings of a party share a fingerprint; texts are made of combinations, not of rows."""
    rows = ledger(spark, [(1, 5.0, None, None, "A.B"), (1, 5.0, None, None, "a b"), (1, 5.0, None, None, "a b"), (None, 7.0, None, None, None), (None, 7.0, None, None, ""), (2, 5.0, None, None, "a b")])
    found = findings.fingerprints(rows)
    assert sorted((r["source_seq"], r["copies"]) for r in found.collect()) == [(0, 3), (1, 3), (2, 3), (3, 2), (4, 2)]
    assert found.columns == ["statement_id", "fingerprint", *rows.columns[1:], "copies"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [statement_id" in plan and "moved" in plan


def test_assistant_context_makes_enriched_rows_once(spark):
    """The main figures from rows that are enriched already are the same, and the query keeps those rows for all its parts."""
    import __spark_entry__ as driver
    from tallyline.plans import ledgers

    rows = ledgers.printed(spark, driver.SMOKE_DIR)
    one, two = findings.master(rows), findings.master(rows, enriched=findings.enrich(rows))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    plan = driver.queries()["assistant_context"](spark, driver.SMOKE_DIR)._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") >= 3
