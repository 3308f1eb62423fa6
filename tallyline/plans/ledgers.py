"""Ledgers made from the driver's tables, and the SQL that makes the same ones.

`flows`: a statement per region; orders are credits, their lines debits. `accounts`: a statement per customer, orders on
either side. `printed`: accounts with running balances, `faulty`: those with known faults. `texts`: accounts with
narrations and references in the usual forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, supplier = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "supplier"))
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("string").alias("statement_id"), F.col("n_name").alias("home"))
    placed = orders.join(home, F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("double")
    credits = placed.select("statement_id", (F.col("o_orderkey") * 8).alias("source_seq"), F.col("o_orderdate").cast("date").alias("date"), none.alias("debit"), F.col("o_totalprice").alias("credit"), F.col("home").alias("party"))
    seller = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("party"))
    lines = table(spark, sf_dir, "lineitem").join(placed.select("o_orderkey", "statement_id"), F.col("l_orderkey") == F.col("o_orderkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    debits = lines.select("statement_id", (F.col("l_orderkey") * 8 + 1 + F.col("l_linenumber") % 7).alias("source_seq"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("debit"), none.alias("credit"), "party")
    return credits.unionByName(debits).withColumns({"narration": F.lit(""), "reference": F.lit(""), "balance": none, "rail": F.lit("OTHER")})


FLOWS_SQL = """flows AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS statement_id, o_orderkey * 8 AS source_seq, CAST(o_orderdate AS DATE) AS date, CAST(NULL AS DOUBLE) AS debit, o_totalprice AS credit, n_name AS party
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT CAST(h.n_regionkey AS VARCHAR), l_orderkey * 8 + 1 + l_linenumber % 7, CAST(l_shipdate AS DATE), l_extendedprice, NULL, s.n_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation h ON c_nationkey = h.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey)"""

_SIDES = {"debit": "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END", "credit": "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END"}
# Narrations by order key, as SQL that both engines take.
_TEXTS = """CASE o_orderkey % 12
  WHEN 0 THEN concat('UPI/DR/', CAST(100000 + o_orderkey AS VARCHAR(20)), '/', upper(n_name), ' STORES')
  WHEN 1 THEN concat('NEFT CR SALARY ', n_name) WHEN 2 THEN 'ATM CASH WITHDRAWAL' WHEN 3 THEN concat('IMPS/CR/', n_name)
  WHEN 4 THEN 'POS PURCHASE AMAZON' WHEN 5 THEN 'EMI LOAN PIRAMAL' WHEN 6 THEN 'INTEREST CREDIT' WHEN 7 THEN 'BY CASH DEPOSIT SELF'
  WHEN 8 THEN 'CHQ PAID CTS' WHEN 9 THEN 'TRANSFER TO SAVINGS' WHEN 10 THEN 'RECHARGE JIO' ELSE concat('goods for ', lower(n_name)) END"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("o_custkey").cast("string").alias("statement_id"), F.col("o_orderkey").alias("source_seq"), F.col("o_orderdate").cast("date").alias("date"), F.expr(_TEXTS.replace("VARCHAR(20)", "STRING")).alias("narration"), F.concat(F.lit("REF"), (F.col("o_orderkey") % 50).cast("string")).alias("reference"), *(F.expr(x).alias(c) for c, x in _SIDES.items()), F.col("n_name").alias("party"), F.col("c_acctbal").alias("opening"))


ACCOUNTS_SQL = f"""accounts AS (
  SELECT CAST(o_custkey AS VARCHAR) AS statement_id, o_orderkey AS source_seq, CAST(o_orderdate AS DATE) AS date, {_TEXTS} AS narration,
    concat('REF', CAST(o_orderkey % 50 AS VARCHAR)) AS reference, {_SIDES["debit"]} AS debit, {_SIDES["credit"]} AS credit, n_name AS party, c_acctbal AS opening
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _running() -> Column:
    move = (F.coalesce("credit", F.lit(0.0)) - F.coalesce("debit", F.lit(0.0))).cast("decimal(18,2)")
    return (F.col("opening").cast("decimal(18,2)") + F.sum(move).over(W.partitionBy("statement_id").orderBy("source_seq"))).cast("double")


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts(spark, sf_dir).withColumn("balance", _running())


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 37th row on the wrong side, every 29th without a balance, every 53rd with a wrong one."""
    k = F.col("source_seq")
    side = lambda a, b: F.when(k % 37 == 0, F.col(b)).otherwise(F.col(a))
    rows = printed(spark, sf_dir).withColumn("balance", F.when(k % 29 == 0, None).when(k % 53 == 0, F.col("balance") + 500).otherwise(F.col("balance")))
    return rows.select(*(c for c in rows.columns if c not in ("debit", "credit")), side("debit", "credit").alias("debit"), side("credit", "debit").alias("credit"))


FAULTY_SQL = f"""{ACCOUNTS_SQL}, printed AS (
  SELECT *, CAST(CAST(opening AS DECIMAL(18,2)) + SUM(CAST(coalesce(credit, 0) - coalesce(debit, 0) AS DECIMAL(18,2))) OVER (PARTITION BY statement_id ORDER BY source_seq) AS DOUBLE) AS balance FROM accounts),
faulty AS (
  SELECT statement_id, source_seq, date, narration, reference, party, opening, CASE WHEN source_seq % 37 = 0 THEN credit ELSE debit END AS debit, CASE WHEN source_seq % 37 = 0 THEN debit ELSE credit END AS credit,
    CASE WHEN source_seq % 29 = 0 THEN NULL WHEN source_seq % 53 = 0 THEN balance + 500 ELSE balance END AS balance FROM printed)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractions of each account: the faulty one, and one without every 11th row."""
    a = faulty(spark, sf_dir).withColumn("method", F.lit("layout"))
    b = printed(spark, sf_dir).where(F.col("source_seq") % 11 != 0).withColumn("method", F.lit("table"))
    return a.unionByName(b)


CANDIDATES_SQL = f"""{FAULTY_SQL}, candidates AS (
  SELECT statement_id, source_seq, date, narration, debit, credit, balance, 'layout' AS method FROM faulty
  UNION ALL SELECT statement_id, source_seq, date, narration, debit, credit, balance, 'table' FROM printed WHERE source_seq % 11 <> 0)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed pages: a header on the first page only, 20 rows a page, a line under every third row."""
    small = printed(spark, sf_dir)
    n = F.row_number().over(W.partitionBy("statement_id").orderBy("source_seq")) - 1
    rows = small.withColumns({"page": F.floor(n / 20).cast("int"), "y": 100.0 + (n % 20) * 30.0})
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c)))
    at = lambda x, y, t: F.struct(F.lit(float(x)).alias("x0"), y.alias("y0"), F.lit(float(x) + 40).alias("x1"), (y + 10).alias("y1"), t.alias("text"))
    y = F.col("y")
    cells = F.array(at(40, y, F.date_format("date", "dd/MM/yyyy")), at(120, y, F.lit("ORDER")), at(300, y, F.concat(F.lit("N"), F.col("source_seq").cast("string"))), at(420, y, number("debit")), at(520, y, number("credit")), at(620, y, number("balance")))
    more = F.when(F.col("source_seq") % 3 == 0, F.array(at(120, y + 14, F.lit("GOODS"))))
    body = rows.select("statement_id", "page", F.explode(F.filter(F.concat(cells, F.coalesce(more, F.array().cast(rows.select(cells.alias("c")).schema["c"].dataType))), lambda w: w["text"].isNotNull())).alias("w"))
    top = F.lit(60.0)
    head = F.array(*(at(x, top, F.lit(t)) for x, t in ((40, "Date"), (120, "Narration"), (300, "Reference"), (420, "Debit"), (520, "Credit"), (620, "Balance"))))
    heads = small.select("statement_id").distinct().select("statement_id", F.lit(0).alias("page"), F.explode(head).alias("w"))
    return body.unionByName(heads).select("statement_id", "page", "w.*")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets: a title, then a header in the fourth row, then the rows."""
    small = printed(spark, sf_dir)
    row = F.row_number().over(W.partitionBy("statement_id").orderBy("source_seq")) + 3
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%,.2f", F.col(c)))
    values = F.array(F.date_format("date", "dd-MM-yyyy"), F.col("narration"), F.col("reference"), number("debit"), number("credit"), number("balance"))
    body = small.withColumn("row", row).select("statement_id", "row", F.posexplode(values).alias("col", "value"))
    heads = F.array(*map(F.lit, ("Txn Date", "Description", "Chq/Ref No", "Withdrawal Amt", "Deposit Amt", "Closing Balance")))
    top = small.select("statement_id").distinct()
    head = top.select("statement_id", F.lit(3).alias("row"), F.posexplode(heads).alias("col", "value"))
    title = top.select("statement_id", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("Account statement by date").alias("value"))
    return body.unionByName(head).unionByName(title).where(F.col("value").isNotNull()).select("statement_id", F.lit("s1").alias("sheet"), "row", "col", "value")


def band_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed pages whose columns stand in fixed bands, words of a row at slightly different heights."""
    small = printed(spark, sf_dir)
    n = F.row_number().over(W.partitionBy("statement_id").orderBy("source_seq")) - 1
    rows = small.withColumns({"page": F.floor(n / 20).cast("int"), "y": 100.0 + (n % 20) * 30.0})
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c)))
    at = lambda x, d, t: F.struct(F.lit(float(x)).alias("x0"), (F.col("y") + d).alias("y0"), F.lit(float(x) + 30).alias("x1"), (F.col("y") + d + 8).alias("y1"), t.alias("text"))
    cells = F.array(at(20, 0, F.date_format("date", "dd/MM/yyyy")), at(80, 3, number("debit")), at(160, -3, number("credit")), at(210, 5, number("balance")), at(330, -5, F.concat(F.lit("N"), F.col("source_seq").cast("string"))))
    return rows.select("statement_id", "page", F.explode(F.filter(cells, lambda w: w["text"].isNotNull())).alias("w")).select("statement_id", "page", "w.*")


def _drawn(rows: DataFrame, cells: list[tuple[Column, Column, Column]]) -> DataFrame:
    """(statement_id, page, x0, y0, x1, y1, text) of rows with statement_id and page; cells: (x, y, text), nulls are left out; a character is 5 wide."""
    word = lambda x, y, t: F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.length(t) * 5).cast("double").alias("x1"), (y + 9).cast("double").alias("y1"), t.alias("text"))
    found = F.filter(F.array(*(word(*c) for c in cells)), lambda w: w["text"].isNotNull())
    return rows.select("statement_id", "page", F.inline(found))


def _on_pages(rows: DataFrame, a_page: int) -> DataFrame:
    n = F.row_number().over(W.partitionBy("statement_id").orderBy("source_seq")) - 1
    return rows.withColumns({"page": F.floor(n / a_page).cast("int") + 1, "at": n % a_page})


def _sides(rows: DataFrame) -> DataFrame:
    """Every 37th row on the wrong side, every 29th without a balance."""
    k = F.col("source_seq")
    side = lambda a, b: F.when(k % 37 == 0, F.col(b)).otherwise(F.col(a))
    return rows.withColumns({"debit": side("debit", "credit"), "credit": side("credit", "debit"), "balance": F.when(k % 29 != 0, F.col("balance"))})


_SHOWN = lambda c: F.format_string("%,.2f", F.abs(F.col(c)))


def column_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native pages with phrases as headings on the first page only, a value date and a reference beside the amounts, of
    `_sides`; overdrawn balances end in DR, missing ones are a dash."""
    rows = _on_pages(_sides(printed(spark, sf_dir)), 18)
    y, k = 100.0 + F.col("at") * 30.0, F.col("source_seq")
    money = lambda c: F.when(F.col(c).isNotNull(), _SHOWN(c))
    date = F.date_format("date", "dd/MM/yyyy")
    reference = F.when(k % 2 == 0, (k + 5_050_000_000).cast("string")).otherwise(F.concat(F.lit("R"), k.cast("string")))
    balance = F.coalesce(F.concat(money("balance"), F.when(F.col("balance") < 0, "DR").otherwise("")), F.lit("-"))
    at = lambda x: F.lit(x)
    body = _drawn(rows, [(at(40), y, date), (at(120), y, F.lit("ORDER")), (at(150), y, F.concat(F.lit("N"), k.cast("string"))), (at(320), y, reference), (at(455), y, date), (at(570), y, money("debit")), (at(680), y, money("credit")), (at(790), y, balance)])
    top = rows.where("page = 1 and at = 0")
    heads = ((40, "Tran"), (63, "Date"), (120, "Narration"), (320, "Chq./Ref.No."), (455, "Value"), (483, "Date"), (570, "Withdrawal"), (625, "Amt."), (680, "Deposit"), (720, "Amt."), (790, "Closing"), (830, "Balance"))
    return body.unionByName(_drawn(top, [(at(x), F.lit(60.0), F.lit(t)) for x, t in heads]))


SIDES_SQL = f"""{FAULTY_SQL}, sides AS (SELECT statement_id, source_seq, date, opening, CASE WHEN source_seq % 37 = 0 THEN credit ELSE debit END AS debit, CASE WHEN source_seq % 37 = 0 THEN debit ELSE credit END AS credit,
    CASE WHEN source_seq % 29 <> 0 THEN balance END AS balance, concat('ORDER N', CAST(source_seq AS VARCHAR)) AS narration FROM printed)"""


def scanned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewed pages of two widths: every 5th row's amount is split at its point, every 7th row's first date is impossible."""
    rows = _on_pages(printed(spark, sf_dir), 12)
    k, wide = F.col("source_seq"), F.when(F.col("page") % 2 == 0, 1.5).otherwise(1.0)
    y = lambda skew: 120.0 + F.col("at") * 60.0 + F.lit(skew) * (k % 3)
    at = lambda x: F.lit(x) * wide
    whole = lambda c: F.when(F.col(c).isNotNull() & (k % 5 != 0), _SHOWN(c))
    left = lambda c: F.when(F.col(c).isNotNull() & (k % 5 == 0), F.substring_index(_SHOWN(c), ".", 1))
    right = lambda c: F.when(F.col(c).isNotNull() & (k % 5 == 0), F.concat(F.lit("."), F.substring_index(_SHOWN(c), ".", -1)))
    date = F.date_format("date", "dd-MM-yyyy")
    first = F.when(k % 7 == 0, F.concat(F.lit("4"), F.substring(date, 2, 9))).otherwise(date)
    cells = [(at(40), y(4), first), (at(140), y(2), date), (at(300), y(0), F.concat(F.lit("N"), k.cast("string")))]
    for c, x in (("debit", 500), ("credit", 650), ("balance", 800)):
        cells += [(at(x), y(1), whole(c)), (at(x), y(3), left(c)), (at(x) + 45, y(5), right(c))]
    top = rows.where("page = 1 and at = 0")
    heads = ((60, "Post"), (85, "Date"), (300, "Narration"), (500, "Debit"), (650, "Credit"), (800, "Balance"))
    return _drawn(rows, [*cells, (at(980), y(0), F.lit("."))]).unionByName(_drawn(top, [(F.lit(x), F.lit(50.0 + x / 100), F.lit(t)) for x, t in heads]))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statement_id, page, table_no, row, cells): tables of ragged rows, a header in the second row of each, every 6th row without its last cell, every 8th with one too many."""
    rows = _on_pages(printed(spark, sf_dir), 15)
    k = F.col("source_seq")
    money = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%,.2f", F.col(c))).otherwise("")
    cells = F.array(F.date_format("date", "dd-MM-yyyy"), F.col("narration"), F.concat(F.lit("R"), k.cast("string")), money("debit"), money("credit"), money("balance"))
    ragged = F.when(k % 6 == 0, F.slice(cells, 1, 5)).when(k % 8 == 0, F.concat(cells, F.array(F.lit("9,999.00")))).otherwise(cells)
    body = rows.select("statement_id", "page", (F.col("at") + 2).alias("row"), ragged.alias("cells"))
    some = lambda row, *texts: rows.where("at = 0").select("statement_id", "page", F.lit(row).alias("row"), F.array(*map(F.lit, texts)).alias("cells"))
    title, head = some(0, "Statement of account", "by date"), some(1, "Txn Date", "Description", "Chq/Ref No", "Withdrawal Amt", "Deposit Amt", "Closing Balance")
    return body.unionByName(title).unionByName(head).withColumn("table_no", F.lit(0))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose rows are numbered by date, with running balances in that order."""
    rows = accounts(spark, sf_dir)
    by = W.partitionBy("statement_id").orderBy("date", "source_seq")
    rows = rows.withColumns({"order_key": F.col("source_seq"), "source_seq": F.row_number().over(by).cast("long")})
    return rows.withColumn("balance", _running())


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extractions of each account: `layout` with some sides turned and some balances missing, `table` without some rows,
    `bands` whole but with every balance of some statements 500 off in a single row."""
    rows, k = dated(spark, sf_dir), F.col("order_key")
    side = lambda a, b: F.when(k % 7 == 0, F.col(b)).otherwise(F.col(a))
    one = rows.withColumns({"debit": side("debit", "credit"), "credit": side("credit", "debit"), "balance": F.when(k % 29 != 0, F.col("balance")), "method": F.lit("layout")})
    two = rows.where(k % 23 != 0).withColumn("method", F.lit("table"))
    off = (F.col("statement_id").cast("long") % 3 == 0) & (F.col("source_seq") == 4)
    three = rows.withColumns({"balance": F.when(off, F.col("balance") + 500).otherwise(F.col("balance")), "method": F.lit("bands")})
    return one.unionByName(two).unionByName(three).drop("opening")


EXTRACTIONS_SQL = f"""{ACCOUNTS_SQL}, numbered AS (SELECT *, source_seq AS k, row_number() OVER (PARTITION BY statement_id ORDER BY date, source_seq) AS seq FROM accounts),
dated AS (SELECT statement_id, k, seq, date, narration, debit, credit, opening, CAST(CAST(opening AS DECIMAL(18,2)) + SUM(CAST(coalesce(credit, 0) - coalesce(debit, 0) AS DECIMAL(18,2))) OVER (PARTITION BY statement_id ORDER BY seq) AS DOUBLE) AS balance FROM numbered),
extractions AS (SELECT statement_id, seq, date, narration, CASE WHEN k % 7 = 0 THEN credit ELSE debit END AS debit, CASE WHEN k % 7 = 0 THEN debit ELSE credit END AS credit, CASE WHEN k % 29 <> 0 THEN balance END AS balance, 'layout' AS method FROM dated
  UNION ALL SELECT statement_id, seq, date, narration, debit, credit, balance, 'table' FROM dated WHERE k % 23 <> 0
  UNION ALL SELECT statement_id, seq, date, narration, debit, credit, CASE WHEN CAST(statement_id AS BIGINT) % 3 = 0 AND seq = 4 THEN balance + 500 ELSE balance END, 'bands' FROM dated)"""


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`cells` with every second row on another sheet, and a sheet of notes without a header."""
    grid = cells(spark, sf_dir)
    key = printed(spark, sf_dir).withColumn("row", F.row_number().over(W.partitionBy("statement_id").orderBy("source_seq")) + 3).select("statement_id", "row", (F.col("source_seq") % 2 == 1).alias("other"))
    body = grid.where("row > 3").join(key, ["statement_id", "row"]).withColumn("sheet", F.when(F.col("other"), "s3").otherwise("s1")).drop("other")
    top = grid.where("row <= 3").drop("sheet")
    top = top.withColumn("sheet", F.explode(F.array(F.lit("s1"), F.lit("s3"))))
    notes = grid.select("statement_id").distinct().select("statement_id", F.lit("s2").alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("notes on the balance").alias("value"))
    return body.unionByName(top).unionByName(notes)
