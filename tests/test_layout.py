"""Positioned words to rows: drawn pages, and lines, cells and dates against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyline.operators import layout

WORDS = "statement_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def drawn(pages, height=800.0, statement="s"):
    """pages: lists of (x, height from the bottom, text); a text's words follow each other."""
    out = []
    for page, texts in enumerate(pages, 1):
        for x, y, body in ((float(a), b, c) for a, b, c in texts):
            for word in body.split():
                out.append((statement, page, x, height - y, x + 5.0 * len(word), height - y + 9, word))
                x += 5.0 * len(word) + 3
    return out


def found(spark, rows, words, *columns):
    out = rows(spark.createDataFrame(words, WORDS)).orderBy("source_seq").collect()
    return [tuple(r[c] for c in columns) for r in out]


HEAD = [(40, 740, "Date"), (100, 740, "Description"), (300, 740, "Withdrawal"), (390, 740, "Deposit"), (480, 740, "Balance")]
FIRST = [(40, 700, "10/04/2025"), (100, 700, "UPI PAYMENT"), (390, 700, "500.00"), (480, 700, "1500.00")]
SECOND = [(40, 640, "11/04/2025"), (100, 640, "ATM CASH"), (300, 640, "200.00"), (480, 640, "1300.00")]


@pytest.mark.parametrize("rows", [layout.position_rows, layout.generic_rows, layout.scanned_rows])
def test_layout_is_carried_to_pages_without_header(spark, rows):
    got = found(spark, rows, drawn([HEAD + FIRST, [(x, 740, t) for x, _, t in SECOND]]), "narration", "debit", "credit", "balance", "source_page")
    assert got == [("UPI PAYMENT", None, 500.0, 1500.0, 1), ("ATM CASH", 200.0, None, 1300.0, 2)]


def test_wrapped_narration(spark):
    words = drawn([HEAD + FIRST + [(100, 682, "RAHUL SHARMA HDFC BANK")] + SECOND])
    assert found(spark, layout.layout_rows, words, "narration", "debit", "credit", "balance") == [("UPI PAYMENT RAHUL SHARMA HDFC BANK", None, 500.0, 1500.0), ("ATM CASH", 200.0, None, 1300.0)]
    # At the top of a page, above its first row, it belongs to the last row of the page before.
    words = drawn([HEAD + FIRST, [(100, 760, "RAHUL SHARMA")] + SECOND])
    assert [n for n, in found(spark, layout.layout_rows, words, "narration")] == ["UPI PAYMENT RAHUL SHARMA", "ATM CASH"]


SEVEN = [(40, 650, "Tran Date"), (105, 650, "Narration"), (320, 650, "Chq./Ref.No."), (455, 650, "Value Date"), (570, 650, "Withdrawal Amt."), (680, 650, "Deposit Amt."), (790, 650, "Closing Balance")]
SEVEN_PAGES = [
    SEVEN + [(40, 610, "01/04/2016"), (105, 610, "PROGRAM MANAGEMENT FEE"), (570, 610, "100.00"), (790, 610, "900.00"), (455, 610, "01/04/2016")]
    + [(40, 570, "02/04/2016"), (105, 570, "LOCKER RENT - BRN 305"), (320, 570, "5050000411060"), (570, 570, "10,000.00"), (790, 570, " - ")],
    [(40, 650, "03/04/2016"), (105, 650, "CASH DEP GOPAL AHMED"), (680, 650, "125,000.00"), (790, 650, "115,900.00"), (455, 650, "03/04/2016")]
    + [(40, 610, "04/04/2016"), (105, 610, "CREDIT INTEREST CAPITALISED"), (680, 610, "115.00"), (790, 610, "116,015.00")],
]


@pytest.mark.parametrize("rows", [layout.position_rows, layout.generic_rows])
def test_seven_columns_on_two_pages(spark, rows):
    """Phrases head the columns, and neither value dates nor reference numbers become amounts."""
    got = found(spark, rows, drawn(SEVEN_PAGES, 700.0), "date", "debit", "credit", "balance", "source_page")
    assert [(str(d), *rest) for d, *rest in got] == [("2016-04-01", 100.0, None, 900.0, 1), ("2016-04-02", 10000.0, None, None, 1), ("2016-04-03", None, 125000.0, 115900.0, 2), ("2016-04-04", None, 115.0, 116015.0, 2)]
    texts = found(spark, rows, drawn(SEVEN_PAGES, 700.0), "narration")
    assert texts[0] == ("PROGRAM MANAGEMENT FEE",) and texts[3] == ("CREDIT INTEREST CAPITALISED",)


def test_reference_column(spark):
    words = drawn([[(40, 650, "Date"), (120, 650, "Narration"), (300, 650, "Reference"), (420, 650, "Debit"), (520, 650, "Credit"), (620, 650, "Balance"), (40, 610, "10/04/2025"), (120, 610, "UPI PAYMENT"), (300, 610, "UPI/123456"), (520, 610, "500.00"), (620, 610, "1500.00"), (120, 590, "RAHUL SHARMA HDFC BANK"), (40, 550, "11/04/2025"), (120, 550, "ATM CASH"), (420, 550, "200.00"), (620, 550, "1300.00")]], 700.0)
    for rows in (layout.layout_rows, lambda w: layout.with_continuations(layout.generic_rows(w), layout.lines(w))):
        assert found(spark, rows, words, "narration", "reference", "debit", "credit", "balance") == [("UPI PAYMENT RAHUL SHARMA HDFC BANK", "UPI/123456", None, 500.0, 1500.0), ("ATM CASH", "", 200.0, None, 1300.0)]


def centres(spark, texts, profile):
    page_lines = layout.lines(spark.createDataFrame(drawn([texts]), WORDS))
    out = layout.columns_of(layout.header_lines(page_lines, profile), profile).collect()
    return {c["column"]: c["x"] for c in out[0]["centres"]} if out else None


def test_combined_column(spark):
    """One heading for both sides, or two headings at one place; amounts say DR or CR."""
    head = [(40, 740, "Date"), (100, 740, "Narration"), (300, 740, "Withdrawal (Dr) Deposit (Cr)"), (600, 740, "Balance")]
    for profile in (layout.POSITIONS, layout.GENERIC):
        got = centres(spark, head, profile)
        assert "debit" not in got and "credit" not in got and 340 < got["movement"] < 400
    words = drawn([head + [(40, 700, "10/04/2025"), (100, 700, "A"), (350, 700, "500.00Cr"), (600, 700, "1500.00"), (40, 660, "11/04/2025"), (100, 660, "B"), (350, 660, "200.00(Dr)"), (600, 660, "1300.00")]])
    assert found(spark, layout.position_rows, words, "narration", "debit", "credit", "balance") == [("A", None, 500.0, 1500.0), ("B", 200.0, None, 1300.0)]
    near = [(40, 740, "Date"), (300, 740, "Withdrawal"), (317, 740, "Deposit"), (600, 740, "Balance")]
    assert set(centres(spark, near, layout.GENERIC)) == {"date", "movement", "balance"}
    assert set(centres(spark, near, layout.POSITIONS)) == {"date", "debit", "credit", "balance"}


@pytest.mark.parametrize("head", [[(40, 740, "Date Narration"), (300, 740, "Debit"), (400, 740, "Credit")], [(40, 740, "Narration"), (300, 740, "Debit"), (400, 740, "Balance")], [(40, 740, "Date Narration Particulars"), (400, 740, "Balance")]])
def test_headers_that_lack_a_column_are_rejected(spark, head):
    assert centres(spark, head, layout.POSITIONS) is None


def test_phrase_before_word(spark):
    got = centres(spark, [(40, 740, "Value Date"), (150, 740, "Txn Date"), (300, 740, "Debit"), (400, 740, "Balance")], layout.POSITIONS)
    assert got["date"] == pytest.approx((157.5 + 178) / 2) and got["value"] == pytest.approx((52.5 + 78) / 2)


def test_torn_year_and_both_sides(spark):
    """A year low on the next page completes a date; of two amounts the one that the balance proves stays."""
    head = [(40, 740, "Date"), (100, 740, "Narration"), (300, 740, "Debit"), (390, 740, "Credit"), (480, 740, "Balance")]
    first = head + [(40, 700, "01/04/2024"), (100, 700, "A"), (390, 700, "500.00"), (480, 700, "1500.00"), (40, 660, "07-04-"), (100, 660, "B"), (300, 660, "100.00"), (390, 660, "7.00"), (480, 660, "1400.00")]
    got = found(spark, layout.position_rows, drawn([first, [(40, 300, "2024"), (60, 300, "2031")]]), "narration", "date", "debit", "credit")
    assert [(n, str(d), a, b) for n, d, a, b in got] == [("A", "2024-04-01", None, 500.0), ("B", "2024-04-07", 100.0, None)]
    assert [n for n, in found(spark, layout.position_rows, drawn([first, [(40, 700, "2024")]]), "narration")] == ["A"]  # too high up
    assert [n for n, in found(spark, layout.position_rows, drawn([first, [], [(40, 300, "2024")]]), "narration")] == ["A"]  # not the next page


def test_generic_without_header_and_open_sides(spark):
    """Shares of the width stand in for a header; an amount in no movement column takes its side from words or the balance, and
    what is printed nowhere is filled in only when asked for."""
    def row(y, date, text, amount, balance, x=545):
        return [(40, y, date), (340, y, text), (x, y, amount), (900, y, balance)]

    words = drawn([[(10, 750, "Some Bank"), (990, 750, "x")] + row(700, "10/04/2025", "PAID BY DEBIT", "100.00", "900.00") + row(660, "11/04/2025", "SOMETHING", "50.00", "950.00") + row(620, "12/04/2025", "OTHER", "7.00", "970.00") + row(580, "13/04/2025", "NOTHING", "", "1,000.00") + row(540, "14/04/2025", "WRONG", "30.00", "1,030.00", x=660)])
    opening = spark.createDataFrame([("s", 1000.0)], "statement_id string, opening double")
    got = found(spark, lambda w: layout.generic_rows(w, opening), words, "debit", "credit", "balance")
    assert got == [(100.0, None, 900.0), (None, 50.0, 950.0), (None, None, 970.0), (None, None, 1000.0), (None, 30.0, 1030.0)]
    got = found(spark, lambda w: layout.generic_rows(w, opening, fill=True), words, "debit", "credit", "balance")
    assert got == [(100.0, None, 900.0), (None, 50.0, 950.0), (None, 20.0, 970.0), (None, 30.0, 1000.0), (None, 30.0, 1030.0)]
    overdrawn = drawn([[(990, 750, "x")] + row(700, "10/04/2025", "PAID", "100.00", "50.00DR", x=660)])
    assert found(spark, layout.generic_rows, overdrawn, "debit", "balance") == [(100.0, -50.0)]


def test_generic_turns_sides_by_the_balance(spark):
    body = [(40, 700, "10/04/2025"), (100, 700, "A"), (300, 700, "500.00"), (480, 700, "1500.00")] + SECOND
    opening = spark.createDataFrame([("s", 1000.0)], "statement_id string, opening double")
    assert found(spark, lambda w: layout.generic_rows(w, opening), drawn([HEAD + body]), "debit", "credit") == [(None, 500.0), (200.0, None)]


@pytest.mark.parametrize("texts, amount", [(["5,750.44CR"], 5750.44), (["5,750", ".44CR"], 5750.44), (["5,750.", "44CR"], 5750.44), (["12", "x", "7.00"], 7.0), (["abc"], None), ([], None), (["₹", "1,250"], 1250.0), (["a1", "b22"], 22.0), (["9.00", "-"], 9.0)])
def test_cell_amount(spark, texts, amount):
    df = spark.createDataFrame([(texts,)], "t array<string>")
    assert df.select(layout.cell_amount(F.col("t")).alias("v")).first()["v"] == amount


@pytest.mark.parametrize("line, date", [("40-06-2021 10-06-2021 x", "2021-06-10"), ("01/02/2024 x 05/02/2024", "2024-02-01"), ("40-06-2021 x", "None"), ("x", "None"), ("41.06.2021 42.06.2021 01.06.2021", "None")])
def test_row_date(spark, line, date):
    assert str(spark.range(1).select(layout.row_date(F.lit(line)).alias("v")).first()["v"]) == date


def plain_lines(words, reach):
    """First group whose running mean is within reach, words from the top."""
    groups = []
    for y, x, _, text in sorted(words):
        for g in groups:
            if abs(y - g["y"]) <= reach:
                n = len(g["words"])
                g["y"] = (g["y"] * n + y) / (n + 1)
                g["words"].append((x, text))
                break
        else:
            groups.append({"y": y, "words": [(x, text)]})
    return [" ".join(t for _, t in sorted(g["words"])) for g in groups]


def test_running_mean_lines(spark):
    r = random.Random(3)
    rows, want = [], {}
    for page in range(12):
        words, y = [], 0.0
        for k in range(r.randint(0, 60)):
            y += r.choice([0, 0, 1, 4, 9, 17, 18.5, 30])
            words.append((y, float(r.randint(0, 500)), 0.0, f"w{k}"))
        rows += [("s", page, x, y, x + 5, y, t) for y, x, _, t in words]
        want[page] = plain_lines(words, 18.0)
    r.shuffle(rows)
    got = {}
    for row in layout.running_mean_lines(spark.createDataFrame(rows, WORDS)).orderBy("page", "line_no").collect():
        got.setdefault(row["page"], []).append(row["line"])
    assert got == {k: v for k, v in want.items() if v}


def test_scanned_pages(spark):
    """Skewed lines, split amounts, an impossible first date, and shares of the last header on a page of another width."""
    head = [(100, 740, "Post Date"), (300, 736, "Description"), (560, 740, "Debit"), (660, 744, "Credit"), (780, 740, "Balance"), (990, 740, ".")]
    one = [(100, 700, "40-06-2021"), (180, 704, "10-06-2021"), (300, 695, "UPI SHOP"), (560, 700, "5,750"), (590, 702, ".44DR"), (780, 698, "1,000.00")]
    two = [(50, 600, "11-06-2021"), (150, 600, "SALARY"), (330, 606, "75.00"), (390, 600, "1,075.00"), (495, 600, ".")]
    words = drawn([head + one, two])
    got = found(spark, layout.scanned_rows, words, "date", "narration", "debit", "credit", "balance")
    assert [(str(d), *x) for d, *x in got] == [("2021-06-10", "UPI SHOP", 5750.44, None, 1000.0), ("2021-06-11", "SALARY", None, 75.0, 1075.0)]
    faint = spark.createDataFrame([(*w, 14.0) for w in words], WORDS + ", conf double")
    assert layout.scanned_rows(faint).count() == 0


def test_lines_of_single_rows(spark):
    """The largest amount is the movement, those with CR or DR (or in a line that says BAL) the balance; sides from the change, then from words."""
    texts = [(40, 700, "10/04/2025 OPENING SALARY 900.00 1,000.00 CR"), (40, 660, "11 Apr 2025 SHOP 100.00 BAL 900.00"), (40, 620, "12-04-2025 NEFT 5,000.00"), (40, 580, "no date 7.00"), (40, 540, "13-04-2025 nothing else")]
    got = found(spark, layout.line_rows, drawn([texts]), "narration", "debit", "credit", "balance")
    assert got[0] == ("OPENING SALARY", None, 1000.0, 1000.0) and got[2] == ("NEFT", None, 5000.0, None)
    assert got[1][0] == "SHOP BAL" and got[1][3] == 900.0


@pytest.mark.parametrize("rows", [layout.position_rows, layout.layout_rows, layout.generic_rows, layout.scanned_rows, layout.line_rows])
def test_empty_and_blank(spark, rows):
    assert rows(spark.createDataFrame([], WORDS)).count() == 0
    assert rows(spark.createDataFrame([("s", 1, 1.0, 1.0, 2.0, 2.0, None), ("s", 1, 5.0, 1.0, 9.0, 2.0, "")], WORDS)).count() == 0


def test_statements_and_repeated_rows(spark):
    """Layouts don't pass from one statement to another; a row printed twice on a page counts once."""
    words = drawn([HEAD + FIRST + [(x, 650, t) for x, _, t in FIRST]], statement="a") + drawn([[(x, 740, t) for x, _, t in SECOND]], statement="b")
    assert found(spark, layout.position_rows, words, "statement_id", "credit") == [("a", 500.0)]


def test_header_rule_in_words():
    """Phrases are runs of whole words, as the fixed values write them."""
    for profile in (layout.POSITIONS, layout.GENERIC, layout.SCANNED):
        for phrases in profile.phrases.values():
            assert all(re.findall("[a-z0-9]+", p) for p in phrases)


@pytest.mark.parametrize("rows", [layout.position_rows, layout.layout_rows, layout.generic_rows, layout.scanned_rows])
def test_words_are_read_once(spark, rows):
    """Layouts, rows and continuing lines come from the same shuffle of lines, not from one each."""
    words = spark.createDataFrame(drawn([HEAD + [(40, 100, "01/02/2024"), (150, 100, "A"), (400, 100, "500.00"), (600, 100, "1,500.00")]]), WORDS)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert len(rows(words.mapInArrow(counted, words.schema)).collect()) == 1
    assert read.value == words.count()
