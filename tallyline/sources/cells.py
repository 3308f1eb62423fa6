"""Ledgers from grids of cells: cells(statement_id, sheet, row, col, value), and from files that hold such grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Words that head a ledger's columns, and the names of each column; the longest name found wins.
TARGETS = ["post date", "transaction date", "value date", "date", "description", "narration", "particular", "remarks", "cheque no", "reference", "debit", "withdrawal", "credit", "deposit", "balance"]
SYNONYMS = {
    "date": ["post date", "transaction date", "txn date", "transaction dt", "date"],
    "narration": ["transaction particulars", "transaction description", "description", "narration", "particulars", "particular", "remarks", "details"],
    "reference": ["chq ref no", "cheque ref no", "cheque no", "chq no", "instrument no", "reference no", "reference", "ref no", "utr no", "utr", "transaction id", "txn id", "rrn"],
    "debit": ["withdrawal amt", "withdrawal amount", "debit amt", "debit rs", "debit", "withdrawal", "withdraw"],
    "credit": ["deposit amt", "deposit amount", "credit amt", "credit rs", "credit", "deposit"],
    "balance": ["closing balance", "closing bal", "balance rs", "balance"],
}
SHEET = ["statement_id", "sheet"]


def headers(cells: DataFrame, within: int = 60, least: int = 3) -> DataFrame:
    """The header row of each sheet: among its first rows the first with the most cells that hold a target word."""
    name = T.norm(F.col("value"))
    hit = name.rlike("|".join(TARGETS))
    w = W.partitionBy(*SHEET).orderBy(F.desc("score"), "row")
    rows = cells.where(F.col("row") < within).groupBy(*SHEET, "row").agg(F.count_if(hit).alias("score")).where(F.col("score") >= least)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*SHEET, F.col("row").alias("header_row"), "score")


def picked(cells: DataFrame, head: DataFrame) -> DataFrame:
    """(statement_id, sheet, target, col, combined): the column whose heading holds the longest name of each target, leftmost first.

    A column that is headed as both debit and credit is combined, and goes before others for these two.
    """
    row = cells.join(head, SHEET).where(F.col("row") == F.col("header_row")).withColumn("name", T.norm(F.col("value")))
    longest = lambda names: F.greatest(F.lit(0), *(F.when(F.col("name").contains(x), F.lit(len(x))).otherwise(0) for x in names))
    targets = F.array(*(F.struct(F.lit(t).alias("target"), longest(names).alias("size")) for t, names in SYNONYMS.items()))
    w = W.partitionBy(*SHEET, "target").orderBy(F.desc("combined"), F.desc("size"), "col")
    both = F.col("name").rlike("withdrawal|debit") & F.col("name").rlike("deposit|credit")
    found = row.select(*SHEET, "header_row", "col", both.alias("both"), F.inline(targets)).where("size > 0")
    found = found.withColumn("combined", F.col("both") & F.col("target").isin("debit", "credit"))
    return found.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*SHEET, "header_row", "target", "col", "combined")


def standardize(cells: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """Ledger rows of all sheets; sheets without a header (by `headers`, or in head) are left out; the physical row is kept."""
    columns = picked(cells, headers(cells) if head is None else head)
    body = cells.join(columns, [*SHEET, "col"]).where(F.col("row") > F.col("header_row"))
    # An amount of a combined column belongs to the side that DR or CR at its end names.
    side = F.when(F.col("target") == "debit", F.upper("value").rlike(r"DR\s*\)?\s*$")).otherwise(F.upper("value").rlike(r"CR\s*\)?\s*$"))
    body = body.where(~F.col("combined") | side)
    wide = body.groupBy(*SHEET, "row").pivot("target", list(SYNONYMS)).agg(F.first("value"))
    amounts = {c: F.abs(T.money(F.col(c))) for c in ("debit", "credit")} | {"balance": T.money(F.col("balance"))}
    # From a generator: a projection would be put into the filter and again into what is selected.
    values = F.inline(F.array(F.struct(*(v.alias(k) for k, v in (amounts | {"date": T.parse_date(F.col("date"))}).items()))))
    out = wide.select(*SHEET, "row", "narration", "reference", values)
    out = out.where(F.coalesce(F.col("debit"), F.col("credit"), F.col("balance"), F.col("date").cast("timestamp").cast("double")).isNotNull())
    return out.select("statement_id", F.col("row").cast("long").alias("source_seq"), F.col("sheet").alias("source_sheet"), "date", F.coalesce("narration", F.lit("")).alias("narration"), "reference", "debit", "credit", "balance")


# Words that a table's header row is known by.
TABLE_TERMS = ("date", "description", "narration", "debit", "credit", "withdrawal", "deposit", "balance")


def standardize_tables(tables: DataFrame, within: int = 8, least: int = 3) -> DataFrame:
    """Ledger rows of tables(statement_id, page, table_no, row, cells: array) whose rows may be of any length.

    A table's header is the first of its first rows whose text holds the most terms, three at least; tables without one are
    left out, rows above it too. Rows are padded with blanks or cut to the header's length. Null cells are blanks, rows
    without cells are none, and don't count among the first ones. Rows of a page are numbered by table and row.
    """
    from ..operators.layout import terms_of

    key = ["statement_id", "page", "table_no"]
    clean = F.transform("cells", lambda c: F.coalesce(F.trim(c), F.lit("")))
    rows = tables.where(F.size("cells") > 0).select(*key, "row", clean.alias("cells"))
    joined = F.array_join(F.transform("cells", T.norm), " ")
    w = W.partitionBy(*key).orderBy("row")
    scored = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= within).withColumn("score", terms_of(joined, TABLE_TERMS)).where(F.col("score") >= least)
    best = F.max_by(F.struct(F.col("row").alias("header_row"), F.size("cells").alias("size")), F.struct("score", -F.col("row")))
    heads = scored.groupBy(*key).agg(best.alias("h")).select(*key, "h.*")
    under = rows.join(heads, key).where(F.col("row") >= F.col("header_row"))
    fitted = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.col("size") - F.size("cells")))), F.lit(1), F.col("size"))
    sheet = F.concat_ws("/", F.col("page").cast("string"), F.col("table_no").cast("string")).alias("sheet")
    cells = under.select("statement_id", sheet, "row", F.posexplode(fitted).alias("col", "value"))
    out = standardize(cells, heads.select("statement_id", sheet, "header_row"))
    place = lambda k: F.split("source_sheet", "/")[k].cast("long")
    seq = place(0) * 1_000_000_000 + place(1) * 1_000_000 + F.col("source_seq")
    return out.withColumns({"source_page": place(0).cast("int"), "source_row": F.col("source_seq"), "source_seq": seq})


def standardize_sheets(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger rows of all sheets of each statement, one sheet after the other, and what came of each sheet.

    sheets: (statement_id, sheet, header_row, score, n_rows, skipped): header_row and score are null where no header was
    found; skipped says why a sheet gave no rows, and is empty for the others. Rows are numbered by sheet name and row.
    """
    head = headers(cells)
    ledger = standardize(cells, head)
    counts = ledger.groupBy("statement_id", F.col("source_sheet").alias("sheet")).agg(F.count("*").alias("n_rows"))
    every = cells.select(*SHEET).distinct().join(head, SHEET, "left").join(counts, SHEET, "left").fillna(0, ["n_rows"])
    skipped = F.when(F.col("header_row").isNull(), "no header").when(F.col("n_rows") == 0, "no rows").otherwise("")
    sheets = every.withColumn("skipped", skipped)
    place = sheets.select(*SHEET, F.row_number().over(W.partitionBy("statement_id").orderBy("sheet")).alias("nth")).withColumnRenamed("sheet", "source_sheet")
    ledger = ledger.withColumn("source_row", F.col("source_seq")).join(place, ["statement_id", "source_sheet"])
    return ledger.withColumn("source_seq", F.col("nth").cast("long") * 1_000_000_000 + F.col("source_row")).drop("nth"), sheets


def csv_cells(spark: SparkSession, path: str, columns: int = 64) -> DataFrame:
    """Cells of the CSV files in a folder and below it; a file is a statement, known by its path. Rows keep their order within a file.

    Files are read by Spark, a row at a time, with quoted line ends and doubled quotes; blank lines don't count. Cells
    beyond `columns` in a row are left out.
    """
    schema = ", ".join(f"c{k} string" for k in range(columns))
    rows = spark.read.option("recursiveFileLookup", True).csv(path, schema=schema, header=False, multiLine=True, quote='"', escape='"')
    rows = rows.select(F.col("_metadata.file_path").alias("statement_id"), F.monotonically_increasing_id().alias("at"), F.array(*(f"c{k}" for k in range(columns))).alias("values"))
    numbered = rows.withColumn("row", F.row_number().over(W.partitionBy("statement_id").orderBy("at")) - 1)
    cells = numbered.select("statement_id", F.lit("csv").alias("sheet"), "row", F.posexplode("values").alias("col", "value"))
    return cells.where(F.col("value").isNotNull())


def evidence_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def search_any_column(df: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Rows in which any column, as text, holds the pattern, whatever its case."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    found = [F.contains(F.lower(x), F.lit(pattern.lower())) if literal else x.rlike(f"(?i){pattern}") for x in texts]
    return df.where(F.array_contains(F.array(*found), True))
