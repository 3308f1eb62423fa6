from tallyline.sources import cells as S


def test_csv(spark, tmp_path):
    body = 'Statement by date\nTxn Date,Narration,Reference,Debit,Credit,Balance\n01/02/2024,"UPI, to A ""B""",R1,"1,250.50",,900\n02/02/2024,SALARY,,,500,1400\n'
    (tmp_path / "one.csv").write_text(body)
    rows = S.standardize(S.csv_cells(spark, str(tmp_path))).orderBy("source_seq").collect()
    assert [(str(r["date"]), r["narration"], r["debit"], r["credit"], r["balance"]) for r in rows] == [("2024-02-01", 'UPI, to A "B"', 1250.5, None, 900.0), ("2024-02-02", "SALARY", None, 500.0, 1400.0)]


def test_search(spark):
    df = spark.createDataFrame([("Amazon (x)", 1), (None, 12)], "a string, b int")
    assert S.search_any_column(df, "AMAZON").count() == 1
    assert S.search_any_column(df, "(x)", literal=True).count() == 1
    assert S.search_any_column(df, "^1$").count() == 1


def test_combined_column(spark):
    """An amount under a combined heading goes to the side that DR or CR names, and to none without."""
    sheet = [("Date", "Narration", "Withdrawal/Deposit", "Balance"), ("01/02/2024", "A", "1,250.50 DR", "900"), ("02/02/2024", "B", "500 (Cr)", "1400"), ("03/02/2024", "C", "7", "1400")]
    cells = spark.createDataFrame([("s", "x", r, c, v) for r, row in enumerate(sheet) for c, v in enumerate(row)], "statement_id string, sheet string, row int, col int, value string")
    rows = S.standardize(cells).orderBy("source_seq").collect()
    assert [(r["narration"], r["debit"], r["credit"], r["balance"]) for r in rows] == [("A", 1250.5, None, 900.0), ("B", None, 500.0, 1400.0), ("C", None, None, 1400.0)]


def test_csv_quoted_lines_and_folders(spark, tmp_path):
    """Line ends within quotes stay in their cell; equal names in two folders are two statements; rows may be of any length."""
    for name, amount in (("a", "5"), ("b", "7")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.csv").write_text(f'Date,Narration,Debit,Credit,Balance\n01/02/2024,"first\nsecond, ""third""",{amount},,9\n\n02/02/2024,B,,1\n03/02/2024,C,,2,3,4,5\n')
    rows = S.standardize(S.csv_cells(spark, str(tmp_path))).orderBy("statement_id", "source_seq").collect()
    assert len({r["statement_id"] for r in rows}) == 2
    assert [(r["narration"], r["debit"], r["credit"], r["balance"]) for r in rows[:3]] == [('first\nsecond, "third"', 5.0, None, 9.0), ("B", None, 1.0, None), ("C", None, 2.0, 3.0)]
    assert rows[3]["debit"] == 7.0


def test_sheets_are_recorded(spark):
    head = ("Date", "Narration", "Debit", "Credit", "Balance")
    grid = [("s", "a", 0, head), ("s", "a", 1, ("01/02/2024", "A", "5", None, "9")), ("s", "b", 0, ("just", "notes", None, None, None)), ("s", "c", 4, head), ("t", "a", 0, head), ("t", "a", 2, ("01/02/2024", "T", None, "1", "2"))]
    cells = spark.createDataFrame([(k, s, r, c, v) for k, s, r, row in grid for c, v in enumerate(row) if v is not None], "statement_id string, sheet string, row int, col int, value string")
    ledger, sheets = S.standardize_sheets(cells)
    assert [(r["statement_id"], r["source_sheet"], r["source_row"], r["narration"]) for r in ledger.orderBy("statement_id", "source_seq").collect()] == [("s", "a", 1, "A"), ("t", "a", 2, "T")]
    assert sorted((r["statement_id"], r["sheet"], r["header_row"], r["n_rows"], r["skipped"]) for r in sheets.collect() if r["header_row"] is not None) == [("s", "a", 0, 1, ""), ("s", "c", 4, 0, "no rows"), ("t", "a", 0, 1, "")]
    assert [(r["sheet"], r["score"], r["skipped"]) for r in sheets.where("header_row is null").collect()] == [("b", None, "no header")]


def test_ragged_tables(spark):
    """The header is the first row of the most terms among the first eight; rows are padded or cut; tables without a header give none."""
    head = ["Date", "Narration", "Debit", "Credit", "Balance"]
    one = [["Statement"], head, ["01/02/2024", "A", "5", None], ["02/02/2024", "B", "", "7", "12", "99"], [], None, ["03/02/2024"]]
    two = [["x"]] * 8 + [head, ["01/02/2024", "late", "5", "", ""]]
    rows = [("s", 1, t, r, c) for t, table in enumerate((one, two)) for r, c in enumerate(table)]
    found = S.standardize_tables(spark.createDataFrame(rows, "statement_id string, page int, table_no int, row int, cells array<string>")).orderBy("source_seq").collect()
    assert [(r["narration"], r["debit"], r["credit"], r["balance"], r["source_row"], r["source_page"]) for r in found] == [("A", 5.0, None, None, 2, 1), ("B", None, 7.0, 12.0, 3, 1), ("", None, None, None, 6, 1)]


def test_values_of_cells_are_parsed_once(spark):
    """Dates and amounts aren't parsed again for the filter that looks for rows without any."""
    grid = [["Date", "Narration", "Debit", "Credit", "Balance"], ["05-01-2024", "a", "5.00", None, "95.00"], [None, "b", None, None, None]]
    cells = spark.createDataFrame([("s", "x", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None], "statement_id string, sheet string, row int, col int, value string")
    found = S.standardize(cells)
    assert [(r["source_seq"], r["debit"], r["balance"]) for r in found.collect()] == [(1, 5.0, 95.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("d-M-yyyy") == 1
