"""From positioned words to rows: words(statement_id, page, x0, y0, x1, y1, text), y grows downwards.

A page's words become lines, the line that names the most columns gives the centres of the columns, and a page without
one takes those of the page before it. Lines keep their words in an array, so that a word finds its column, a cell its
amount and a row its date within one line of one page: words are shuffled once, by page, and only one row a page is
ordered within its statement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .candidates import keep_first
from .reconcile import repair_side

PAGE = ["statement_id", "page"]
#: Rows of a page have numbers of their own in the order of a statement.
PAGE_ROWS = 1_000_000
COLUMNS = ("date", "value", "narration", "reference", "debit", "credit", "movement", "balance")
MOVED = ("debit", "credit", "movement")


@dataclass(frozen=True)
class Profile:
    """How headers are read: the terms that make one, the phrases and then words that head each column, the distance at
    which withdrawals and deposits are one column, and how far below its header a page's rows begin."""

    terms: tuple[str, ...]
    phrases: dict[str, tuple[str, ...]]
    words: dict[str, tuple[str, ...]]
    one_column: float
    below: float


# Header terms, phrases and words of the columns, for pages whose columns are all headed.
POSITIONS = Profile(
    terms=("date", "value date", "description", "narration", "particular", "reference", "debit", "credit", "withdrawal", "deposit", "balance"),
    phrases={
        "movement": ("withdrawal (dr) / deposit (cr)", "withdrawal dr deposit cr", "withdrawal (dr) deposit (cr)"),
        "date": ("post date", "transaction date", "txn date"),
        "value": ("value date",),
        "reference": ("reference", "ref no", "chq/ref no", "cheque/ref no", "cheque no", "chq no", "chq.no", "instrument no", "transaction id", "txn id", "utr no", "utr", "rrn"),
        "balance": ("closing balance",),
    },
    words={
        "date": ("date",), "value": ("value",), "narration": ("description", "narration", "particular", "details", "remarks", "transaction"),
        "reference": ("reference", "ref", "cheque", "chq", "utr"), "debit": ("debit", "withdrawal", "withdraw"), "credit": ("credit", "deposit"), "balance": ("balance",),
    },
    one_column=8.0, below=4.0,
)
# The same for any bank's native pages.
GENERIC = Profile(
    terms=("date", "value date", "description", "narration", "particular", "details", "remarks", "reference", "ref no", "cheque", "chq", "debit", "withdrawal", "withdraw", "credit", "deposit", "balance"),
    phrases={
        "movement": ("withdrawal (dr) deposit (cr)", "withdrawal dr deposit cr", "debit (dr) credit (cr)"),
        "date": ("tran date", "transaction date", "post date", "txn date"),
        "value": ("value date", "value dt", "value"),
        "reference": ("chq/ref no", "cheque/ref no", "reference no", "ref no", "cheque no", "chq no", "chq.no", "instrument no", "transaction id", "txn id", "utr no"),
        "balance": ("closing balance", "balance"),
    },
    words={
        "date": ("date",), "value": ("value",), "narration": ("description", "narration", "particular", "particulars", "details", "remarks"),
        "reference": ("reference", "ref", "cheque", "chq", "instrument", "utr", "rrn"), "debit": ("debit", "withdrawal", "withdraw"), "credit": ("credit", "deposit"), "balance": ("balance",),
    },
    one_column=12.0, below=5.0,
)
# The same for scanned pages.
SCANNED = Profile(
    terms=("date", "description", "narration", "particular", "debit", "credit", "withdrawal", "deposit", "balance"),
    phrases={},
    words={
        "date": ("date",), "narration": ("description", "narration", "particular", "details", "remarks"), "reference": ("reference", "ref", "cheque", "chq", "instrument", "utr", "rrn"),
        "debit": ("debit", "withdrawal", "withdraw"), "credit": ("credit", "deposit"), "balance": ("balance",),
    },
    one_column=-1.0, below=8.0,
)
# Centres of columns as shares of a page's width, where no page so far has a header: native pages, scanned pages.
NATIVE_SHARES = {"date": 0.12, "value": 0.24, "narration": 0.34, "reference": 0.52, "debit": 0.68, "credit": 0.79, "balance": 0.92}
SCANNED_SHARES = {"date": 0.142, "narration": 0.381, "reference": 0.569, "debit": 0.692, "credit": 0.806, "balance": 0.927}
# How dates and amounts look in print.
DATE = r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b"
AMOUNT = r"(?i)^(?:₹\s*)?\(?\d[\d,]*(?:\.\d+)?\)?(?:\s*(?:CR|DR))?$"
YEAR = r"^20\d{2}$"
#: A year that a page break tore from its date stands below this height.
TORN_YEAR_Y = 400.0


def lines(words: DataFrame, step: float = 2.0) -> DataFrame:
    """Words of one rounded height as a line: its words from left to right, and its text."""
    y = F.bround(F.col("y0") / step) * step
    return _as_lines(words, y).repartition(*PAGE)


def _of_pages(words: DataFrame) -> DataFrame:
    """Words of some page. Layouts and rows are both made of all columns of all lines of these, so that Spark makes and
    shuffles the lines once: a filter or a choice of columns on one side would be moved below the shuffle and make two of it."""
    return words.where(F.col("statement_id").isNotNull() & F.col("page").isNotNull())


def _as_lines(words: DataFrame, y: Column) -> DataFrame:
    width = [F.max("width").alias("width")] if "width" in words.columns else []
    out = words.groupBy(*PAGE, y.alias("y")).agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("words"), *width)
    return out.withColumn("line", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def running_mean_lines(words: DataFrame, reach: float = 18.0) -> DataFrame:
    """Lines of slightly skewed pages: from the top, a word joins the line whose mean height so far is within reach, else it
    begins a line. Heights only grow, so that line can only be the last one; the state of the fold over a page's words is
    that line's mean and size. Words of equal height go from left to right; a line's y is its rounded mean."""
    order = F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "text")))
    width = [F.max("width").alias("width")] if "width" in words.columns else []
    pages = words.where(F.col("y0").isNotNull()).groupBy(*PAGE).agg(order.alias("all"), *width)

    def step(state: Column, word: Column) -> Column:
        y = word["y0"].cast("double")
        joins = F.coalesce(y - state["mean"] <= reach, F.lit(False))
        n = F.when(joins, state["n"]).otherwise(0)
        line = state["line"] + F.when(joins, 0).otherwise(1)
        mean = F.when(joins, (state["mean"] * n + y) / (n + 1)).otherwise(y)
        return F.struct(mean.alias("mean"), (n + 1).alias("n"), line.alias("line"), F.concat(state["of"], F.array(line)).alias("of"))

    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0).alias("n"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("of"))
    placed = pages.withColumn("of", F.aggregate("all", start, step, lambda s: s["of"]))
    each = placed.select(*PAGE, *[c for c in ("width",) if width], F.explode(F.arrays_zip("all", "of")).alias("w"))
    each = each.select(*PAGE, *[c for c in ("width",) if width], F.col("w.of").alias("line_no"), F.col("w.all.y0").alias("y0"), F.col("w.all.x0").alias("x0"), F.col("w.all.x1").alias("x1"), F.col("w.all.text").alias("text"))
    out = each.groupBy(*PAGE, "line_no").agg(F.bround(F.avg("y0")).alias("y"), F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("words"), *([F.max("width").alias("width")] if width else []))
    return out.withColumn("line", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """df with these columns, from a generator: a projection would be put into the next one each time it is used."""
    return df.select(*(c for c in df.columns if c not in values), F.inline(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))


def terms_of(line: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms a line holds."""
    return T.let(T.norm(line), lambda name: reduce(lambda a, b: a + b, (name.contains(t).cast("int") for t in terms)))


def header_lines(page_lines: DataFrame, profile: Profile = POSITIONS, least: int = 3) -> DataFrame:
    """(statement_id, page, y, words, terms): the first line of each page that holds the most terms, at least three."""
    found = page_lines.withColumn("terms", terms_of(F.col("line"), profile.terms)).where(F.col("terms") >= least)
    best = F.max_by(F.struct("y", "words", "terms"), F.struct("terms", -F.col("y")))
    return found.groupBy(*PAGE).agg(best.alias("h")).select(*PAGE, "h.*")


#: Words of the longest phrases.
PHRASE_WORDS = 4


def _runs(m: int) -> Column:
    """Runs of m neighbouring names of `named`, in order."""
    return F.expr(f"if(size(named) < {m}, array(), transform(sequence(1, size(named) - {m - 1}), i -> array_join(transform(slice(named, i, {m}), w -> w.name), '|')))")


def _phrase(phrase: str) -> str:
    """SQL for the centre of the first run of words that are those of phrase: between the centres of its first and its last word."""
    target = re.findall(r"[a-z0-9]+", phrase.lower())
    m = len(target)
    at = f"array_position(runs{m}, '{'|'.join(target)}')"
    return f"if({at} > 0, (get(named, cast({at} - 1 as int)).x + get(named, cast({at} + {m - 2} as int)).x) / 2, null)"


def _word(tokens: tuple[str, ...]) -> str:
    """SQL for the least centre of the words that hold one of tokens."""
    holds = " or ".join(f"contains(w.name, '{t}')" for t in tokens)
    return f"array_min(transform(filter(named, w -> {holds}), w -> w.x))"


def columns_of(headers: DataFrame, profile: Profile = POSITIONS) -> DataFrame:
    """(statement_id, page, header_y, centres: array of (x, place, column), sorted) of headers that name a date, a balance and
    a movement; other headers are left out."""
    return _centred(headers, profile).where(F.col("centres").isNotNull()).select(*PAGE, F.col("y").alias("header_y"), "centres")


def _centred(headers: DataFrame, profile: Profile) -> DataFrame:
    """headers with their centres, null where they don't name a date, a balance and a movement, or have no words.

    A column's centre is that of its first phrase found, else of the first word that names it. Withdrawals and deposits
    that are headed as one column, by a phrase or as good as one place, are a movement column whose amounts say CR or DR.
    """
    rows = _once(headers, named=F.transform("words", lambda w: F.struct(((w["x0"] + w["x1"]) / 2).alias("x"), T.norm(w["text"]).alias("name"))))
    rows = _once(rows, **{f"runs{m}": _runs(m) for m in range(1, PHRASE_WORDS + 1)})
    first = lambda parts: f"coalesce({', '.join([*parts, 'cast(null as double)'])})"
    phrase = lambda c: [_phrase(p) for p in profile.phrases.get(c, ())]
    out, into = _word(("withdrawal", "withdraw")), _word(("deposit", "credit"))
    rows = _once(rows, movement=F.expr(first([*phrase("movement"), f"if(abs({out} - {into}) <= {profile.one_column}, ({out} + {into}) / 2, null)"])))
    centre = {c: first([*phrase(c), _word(profile.words[c])]) if c in profile.words else "cast(null as double)" for c in COLUMNS}
    centre |= {c: f"if(movement is null, {centre[c]}, null)" for c in ("debit", "credit")} | {"movement": "movement"}
    each = F.expr(f"array({', '.join(f"struct(cast({centre[c]} as double) as x, {k} as place, '{c}' as column)" for k, c in enumerate(COLUMNS))})")
    rows = _once(rows, centres=F.sort_array(F.filter(each, lambda c: c["x"].isNotNull())))
    has = lambda *names: F.exists("centres", lambda c: c["column"].isin(*names))
    return rows.withColumn("centres", F.when(has("date") & has("balance") & has(*MOVED), F.col("centres")))


#: SQL for an array of (column, low, high) that meet halfway between neighbouring `centres`; the outer ones are open.
MIDWAY = """transform(centres, (c, i) -> struct(c.column as column, if(i = 0, double('-Infinity'), (get(centres, i - 1).x + c.x) / 2) as low,
  if(i = size(centres) - 1, double('Infinity'), (c.x + get(centres, i + 1).x) / 2) as high))"""
#: SQL for the words of a line as cells: their centres, texts and columns.
CELLS = """transform(transform(words, w -> struct((w.x0 + w.x1) / 2 as x, trim(w.text) as text)),
  w -> struct(w.x as x, w.text as text, get(filter(bands, b -> w.x >= b.low and w.x < b.high), 0).column as column))"""


def _shares(shares: dict[str, float]) -> Column:
    return F.sort_array(F.array(*(F.struct(F.lit(v).alias("x"), F.lit(COLUMNS.index(c)).alias("place"), F.lit(c).alias("column")) for c, v in shares.items())))


def page_layouts(page_lines: DataFrame, profile: Profile, shares: dict[str, float] | None = None, scaled: bool = False) -> DataFrame:
    """(statement_id, page, width, header_y, centres, bands, torn_year) of every page that has its columns from a header of its
    own, or the last one before it, or from shares of its width.

    header_y is -1 without a header of its own, so that nothing of the page is skipped. scaled: carried centres keep their
    share of the page's width. torn_year: the year printed low on the page right after, for a date that the break tore.
    """
    scale = F.max("width") if "width" in page_lines.columns else F.max(F.array_max(F.transform("words", lambda w: w["x1"])))
    year = F.get(F.transform(F.filter("words", lambda w: w["text"].rlike(YEAR)), lambda w: F.struct(w["x0"].alias("x"), w["text"].alias("year"))), 0)
    # The line of `header_lines`, and what else a page has for its layout, in one grouping.
    some = _once(page_lines, terms=terms_of(F.col("line"), profile.terms))
    head = F.max_by(F.struct("y", "words"), F.when(F.col("terms") >= 3, F.struct("terms", -F.col("y"))))
    pages = some.groupBy(*PAGE).agg(scale.cast("double").alias("width"), F.min(F.when(F.col("y") > TORN_YEAR_Y, year))["year"].alias("year"), head.alias("h"))
    rows = _centred(pages.select(*PAGE, "width", "year", "h.*"), profile)
    rows = rows.select(*PAGE, "width", "year", "centres", F.when(F.col("centres").isNotNull(), F.col("y")).alias("header_y"))
    times = lambda c, by: F.transform(c, lambda x: x.withField("x", x["x"] * by))
    w = W.partitionBy("statement_id").orderBy("page")
    kept = times(F.col("centres"), 1 / F.col("width")) if scaled else F.col("centres")
    before = F.last("kept", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    following = F.lead(F.struct("page", "year")).over(w)
    rows = rows.withColumn("kept", kept).withColumns({"before": before, "following": following})
    found = [F.col("centres"), times(F.col("before"), F.col("width")) if scaled else F.col("before")]
    if shares:
        found.append(times(_shares(shares), F.col("width")))
    rows = rows.withColumns({"header_y": F.coalesce("header_y", F.lit(-1.0)), "centres": F.coalesce(*found), "torn_year": F.when(F.col("following.page") == F.col("page") + 1, F.col("following.year"))})
    rows = rows.where(F.col("centres").isNotNull())
    return _once(rows.select(*PAGE, "width", "header_y", "centres", "torn_year"), bands=F.expr(MIDWAY))


def _under(below: float) -> Column:
    """Whether a line stands under its page's header."""
    return (F.col("header_y") < 0) | (F.col("y") > F.col("header_y") + below)


def placed(page_lines: DataFrame, layouts: DataFrame, below: float, token: Column) -> DataFrame:
    """Lines under their page's header that have a token, with it and cells: their words' centres, texts and columns, from left to right."""
    rows = page_lines.drop("width").join(layouts, PAGE).where(_under(below))
    rows = _once(rows, token=token).where(F.col("token").isNotNull())
    return _once(rows, cells=F.expr(CELLS)).drop("words", "bands")


def _bucket(column: str) -> Column:
    return F.expr(f"transform(filter(cells, c -> c.column = '{column}'), c -> c.text)")


def _joined(texts: Column) -> Column:
    return F.trim(F.array_join(texts, " "))


def _last_money(texts: Column) -> Column:
    """The rightmost amount among texts."""
    return F.get(F.filter(F.transform(F.reverse(texts), T.text_money), lambda v: v.isNotNull()), 0)


def cell_amount(texts: Column) -> Column:
    """Amount of a cell whose number a reader may have split, without its sign: neighbours that break a number (one ends or
    the next begins with a point or comma) are one, and the rightmost that is an amount wins; else the end of all of them."""

    def fold(done: Column, t: Column) -> Column:
        last = F.coalesce(F.get(done, F.size(done) - 1), F.lit(""))
        torn = (last.rlike(r"\d[.,]$") & t.rlike(r"^\d")) | (last.rlike(r"\d$") & t.rlike(r"^[.,]\d"))
        return F.when(torn, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, t)))).otherwise(F.concat(done, F.array(t)))

    value = lambda t: F.abs(T.text_money(t))

    def amount(clean: Column) -> Column:
        whole = F.when(F.size(clean) == 1, clean).otherwise(F.aggregate(clean, F.array().cast("array<string>"), fold))
        good = F.filter(F.transform(F.filter(F.reverse(whole), lambda t: t.rlike(AMOUNT)), value), lambda v: v.isNotNull())
        rest = F.regexp_extract(F.regexp_replace(F.array_join(clean, ""), " ", ""), r"(?i)(\d[\d,]*(?:\.\d+)?(?:CR|DR)?)$", 1)
        return F.coalesce(F.get(good, 0), T.let(F.nullif(rest, F.lit("")), value))

    clean = F.transform(texts, lambda t: F.trim(F.regexp_replace(t, "₹", "")))
    return T.let(clean, lambda c: F.when(F.size(c) > 0, amount(c)))


def row_date(line: Column) -> Column:
    """The first date of a line, or the second if the first is none of the calendar's."""
    found = F.transform(F.regexp_extract_all(line, F.lit(f"({DATE})"), F.lit(1)), T.parse_date)
    return F.coalesce(F.get(found, 0), F.get(found, 1))


def _source(rows: DataFrame, *others: str) -> DataFrame:
    """Rows numbered within their page, equal rows of a page once; with the columns others."""
    nth = F.row_number().over(W.partitionBy(*PAGE).orderBy("y"))
    rows = rows.withColumn("source_seq", F.col("page").cast("long") * PAGE_ROWS + nth).withColumnsRenamed({"page": "source_page", "y": "source_y", "line": "source_text"})
    rows = keep_first(rows, ["statement_id", "source_page", "date", "narration", "debit", "credit", "balance"])
    return rows.select("statement_id", "source_seq", "source_page", "source_y", "source_text", "date", "narration", "reference", "debit", "credit", "balance", *others)


# Words of a repeated header, for native and for scanned pages.
REPEATED = ("date", "narration", "description", "debit", "credit", "balance")
REPEATED_SCANNED = ("post date", "value date", "description", "narration", "debit", "credit", "balance")


def position_rows(words: DataFrame) -> DataFrame:
    """Ledger rows of pages whose columns are headed: lines that begin with a date and have an amount in a movement column.

    A date that the page break tore gets its year from the next page. Where a line has amounts on both sides, the balance
    of the row above tells which one holds; if it doesn't, both stay for the integrity gate to reject. Lines without a
    movement aren't rows; equal rows of a page count once. Pages before the first header have none. Balances keep
    their sign, movements have none but their side.
    """
    rows = _positions(words)
    return rows.where("is_row and first").select(*ROW)


#: Columns of the rows of this module.
ROW = ("statement_id", "source_seq", "source_page", "source_y", "source_text", "date", "narration", "reference", "debit", "credit", "balance")


def _positions(words: DataFrame, continued: bool = False) -> DataFrame:
    """The lines of `position_rows` (is_row, and first: the first of equal rows of a page), ordered within their statement by
    source_page and source_y; continued: with the lines that may go on with a narration (goes_on), wherever they stand."""
    page_lines = lines(_of_pages(words))
    rows = page_lines.join(page_layouts(page_lines, POSITIONS), PAGE, "left" if continued else "inner")
    torn = F.regexp_extract("line", r"^\s*(\d{1,2}[-/.]\d{1,2}[-/.])", 1)
    rows = _once(rows, torn=F.when(_under(POSITIONS.below), F.nullif(torn, F.lit(""))), goes_on=T.is_continuation(F.col("line")) if continued else F.lit(False))
    rows = rows.where("torn is not null or goes_on")
    rows = _once(rows, cells=F.when(F.col("torn").isNotNull() & (terms_of(F.col("line"), REPEATED) < 3), F.expr(CELLS))).drop("words", "bands")
    rows = rows.where("cells is not null or goes_on")
    of = lambda text: F.nullif(F.regexp_extract(text, f"({DATE})", 1), F.lit(""))
    token = F.coalesce(of(_joined(_bucket("date"))), of(F.col("line")), F.concat("torn", "torn_year"))
    rows = _once(rows, date=F.when(F.col("cells").isNotNull(), T.parse_date(token))).where("date is not null or goes_on")

    # The rightmost amount of a combined column that says which side it is on.
    sided = F.filter(F.reverse(_bucket("movement")), lambda t: F.regexp_replace(F.upper(t), " ", "").rlike(r"(?:DR|CR)\)?$") & T.text_money(t).isNotNull())
    sided = F.get(sided, 0)
    is_debit = F.regexp_replace(F.upper(sided), " ", "").rlike(r"DR\)?$")
    combined = F.size(_bucket("movement")) > 0
    debit = F.when(combined, F.when(is_debit, F.abs(T.text_money(sided)))).otherwise(F.abs(_last_money(_bucket("debit"))))
    credit = F.when(combined, F.when(~is_debit, F.abs(T.text_money(sided)))).otherwise(F.abs(_last_money(_bucket("credit"))))
    other = F.filter("cells", lambda c: c["text"].rlike(AMOUNT) & ~F.coalesce(c["column"].isin("balance", "date", "value"), F.lit(False)))
    rows = _once(rows, debit=debit, credit=credit, balance=_last_money(_bucket("balance")), only=F.when(F.size(other) == 1, F.abs(T.text_money(F.get(other, 0)["text"]))), narration=F.coalesce(F.nullif(_joined(_bucket("narration")), F.lit("")), F.col("line")), reference=_joined(_bucket("reference")))
    # A single amount under no movement column, with DR or CR beside it.
    unsided = F.col("debit").isNull() & F.col("credit").isNull()
    beside = lambda word: unsided & F.upper("line").rlike(rf"\b{word}\b")
    rows = rows.withColumns({"debit": F.when(beside("DR"), F.col("only")).otherwise(F.col("debit")), "credit": F.when(beside("CR") & ~beside("DR"), F.col("only")).otherwise(F.col("credit"))})
    rows = _once(rows, is_row=F.col("date").isNotNull() & (F.col("debit").isNotNull() | F.col("credit").isNotNull())).where("is_row or goes_on")

    above = W.partitionBy("statement_id").orderBy("page", "y").rowsBetween(W.unboundedPreceding, -1)
    change = F.col("balance") - F.last(F.when(F.col("is_row"), F.struct("balance")), ignorenulls=True).over(above)["balance"]
    out, into = F.abs(change + F.col("debit")) <= 0.01, F.abs(change - F.col("credit")) <= 0.01
    rows = rows.withColumns({"out": F.coalesce(out & ~into, F.lit(False)), "into": F.coalesce(into & ~out, F.lit(False))})
    rows = rows.withColumns({"debit": F.when(~F.col("into"), F.col("debit")), "credit": F.when(~F.col("out"), F.col("credit"))})
    nth = F.sum(F.col("is_row").cast("int")).over(W.partitionBy(*PAGE).orderBy("y").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("source_seq", F.col("page").cast("long") * PAGE_ROWS + nth).withColumnsRenamed({"page": "source_page", "y": "source_y", "line": "source_text"})
    equal = W.partitionBy("statement_id", "source_page", "is_row", "date", "narration", "debit", "credit", "balance").orderBy("source_seq", "source_y")
    return rows.withColumn("first", F.row_number().over(equal) == 1).select(*ROW, "is_row", "first", "goes_on")


def layout_rows(words: DataFrame, most: int = 8) -> DataFrame:
    """`position_rows`, each with the lines that go on with its narration, on its page or at the top of the ones after it: the
    first `most` of them, as `with_continuations` adds them, in one pass over the lines."""
    rows = _positions(words, continued=True).withColumn("own", F.col("is_row") & F.col("first")).where("own or goes_on")
    so_far = W.partitionBy("statement_id").orderBy("source_page", "source_y").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("of", F.last(F.when(F.col("own"), F.col("source_seq")), ignorenulls=True).over(so_far)).where("of is not null")
    own = F.first(F.when(F.col("own"), F.struct(*(c for c in ROW if c != "statement_id"))), ignorenulls=True)
    more = F.sort_array(F.collect_list(F.when(~F.col("own"), F.struct("source_page", "source_y", F.trim("source_text").alias("t")))))
    rows = rows.groupBy("statement_id", "of").agg(own.alias("own"), F.transform(F.slice(more, 1, most), lambda s: s["t"]).alias("more"))
    return rows.select("statement_id", "own.*", "more").withColumn("narration", _appended()).drop("more")


def _appended() -> Column:
    """The narration with the texts of `more` that it doesn't hold yet."""
    return F.aggregate(F.coalesce("more", F.array().cast("array<string>")), F.coalesce("narration", F.lit("")), lambda n, t: F.when(F.contains(n, t), n).otherwise(F.trim(F.concat_ws(" ", n, t))))


def with_continuations(rows: DataFrame, page_lines: DataFrame, most: int = 8) -> DataFrame:
    """rows (of this module) with the narrations of up to `most` continuing lines below them appended.

    Only lines above the first row of a page need another page: the last row of the pages before, of which there is one a page.
    """
    w = W.partitionBy(*PAGE).orderBy("y")
    at = rows.select("statement_id", F.col("source_page").alias("page"), F.col("source_y").alias("y"), "source_seq")
    more = page_lines.join(at, [*PAGE, "y"], "left").withColumn("own", F.last("source_seq", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lasts = page_lines.select(*PAGE).distinct().join(at.groupBy(*PAGE).agg(F.max("source_seq").alias("last")), PAGE, "left")
    lasts = lasts.withColumn("before", F.last("last", ignorenulls=True).over(W.partitionBy("statement_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)))
    more = more.where(F.col("source_seq").isNull() & T.is_continuation(F.col("line"))).join(lasts.select(*PAGE, "before"), PAGE)
    more = more.withColumn("source_seq", F.coalesce("own", "before")).where(F.col("source_seq").isNotNull())
    texts = F.slice(F.sort_array(F.collect_list(F.struct("page", "y", F.trim("line").alias("t")))), 1, most)
    more = more.groupBy("statement_id", "source_seq").agg(F.transform(texts, lambda s: s["t"]).alias("more"))
    return rows.join(more, ["statement_id", "source_seq"], "left").withColumn("narration", _appended()).drop("more")


def generic_rows(words: DataFrame, opening: DataFrame | None = None, fill: bool = False) -> DataFrame:
    """Ledger rows of any bank's native pages, by the columns of a header or by shares of the page's width.

    A row is a line that begins with a date and has an amount in the right half. Of its amounts the rightmost in the balance
    column is the balance, or the rightmost of several that isn't under a movement column; numbers of the reference's
    zone are none. The movement is the rightmost under a movement column, else of the rest. A side that no column, CR or DR
    tells stays open until the change of the balance is that amount, from opening (statement_id, opening) on, which also
    turns sides that it disproves; fill: an amount that is missing on both sides is taken from the balances.
    """
    page_lines = lines(_of_pages(words))
    begins = rf"^\s*({DATE})"
    token = F.when(F.col("line").rlike(begins) & ~T.is_noise(F.col("line")), F.regexp_extract("line", begins, 1))
    rows = placed(page_lines, page_layouts(page_lines, GENERIC, NATIVE_SHARES), GENERIC.below, token)
    rows = _once(rows, date=T.parse_date(F.col("token"))).where(F.col("date").isNotNull())

    money = f"filter(transform(cells, c -> struct(c.x as x, trim(replace(c.text, '₹', '')) as text, c.column as column)), c -> c.text rlike r'{AMOUNT}')"
    rows = _once(rows, money=F.expr(money)).where(F.expr("exists(money, c -> c.x > width * 0.5)"))
    moved = f"coalesce(c.column in {MOVED}, false)"
    last = lambda cells: f"get({cells}, size({cells}) - 1)"
    right = f"if(size(money) >= 2, {last(f'filter(array({last('money')}), c -> not {moved})')}, null)"
    rows = _once(rows, balance_cell=F.expr(f"coalesce({last("filter(money, c -> c.column = 'balance')")}, {right})"), **{f"at_{c}": F.expr(f"get(filter(centres, c -> c.column = '{c}'), 0).x") for c in ("reference", "narration", "value")})
    beyond = "at_reference + greatest(8.0D, width * 0.015D)"
    rows = _once(rows, choices=F.expr(f"filter(money, c -> (balance_cell is null or abs(c.x - balance_cell.x) > 8) and (at_reference is null or c.x > {beyond} or {moved}))"))
    movement = F.expr(f"coalesce({last(f'filter(choices, c -> {moved})')}, {last('choices')})")
    rows = _once(rows, movement=movement)
    ends = lambda side: F.regexp_replace(F.upper("movement.text"), " ", "").rlike(f"{side}$")
    says = lambda words: F.upper("line").rlike(rf"\b(?:{words})\b")
    column = F.coalesce(F.col("movement.column"), F.lit(""))
    side = (
        F.when(column.isin("debit", "credit"), column).when(column == "movement", F.when(ends("DR"), "debit").when(ends("CR"), "credit"))
        .when(says("DR|DEBIT|WITHDRAWAL|WITHDRAW"), "debit").when(says("CR|CREDIT|DEPOSIT"), "credit")
    )
    amount = F.abs(T.printed_money(F.col("movement.text")))
    rows = _once(rows, routed=_routed())
    narration, reference = (F.expr(f"trim(array_join(transform(filter(routed, c -> c.place = '{kind}'), c -> c.text), ' '))") for kind in "nr")
    rows = _once(rows, debit=F.when(side == "debit", amount), credit=F.when(side == "credit", amount), amount=amount, balance=T.printed_money(F.col("balance_cell.text")), narration=F.coalesce(F.nullif(narration, F.lit("")), F.col("line")), reference=reference)
    rows = _source(rows, "amount")
    if opening is not None:
        rows = rows.join(opening.select("statement_id", "opening"), "statement_id", "left")
    above = W.partitionBy("statement_id").orderBy("source_seq").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.last("balance", ignorenulls=True).over(above), F.col("opening") if opening is not None else F.lit(None).cast("double"))
    rows = rows.withColumns({"change": F.col("balance") - before, "sideless": F.col("debit").isNull() & F.col("credit").isNull()})
    proved = lambda sign: F.col("sideless") & (F.abs(F.col("change") - sign * F.col("amount")) <= 0.01)
    rows = rows.withColumns({"debit": F.when(proved(-1), F.col("amount")).otherwise(F.col("debit")), "credit": F.when(proved(1), F.col("amount")).otherwise(F.col("credit"))})
    return repair_side(rows.drop("opening", "amount", "change", "sideless"), opening=opening, fill=fill).drop("flipped", "filled")


def _routed() -> Column:
    """Words of a row with their places, n for its narration and r for its reference: by their distances to the centres of both
    columns; dates, amounts and mere signs go nowhere."""
    place = """case when abs(c.x - at_reference) <= greatest(55.0D, at_reference * 0.12D) then 'r' when c.x >= at_narration - 40 and (at_reference is null or c.x < at_reference - 20) then 'n'
      when c.x >= at_narration - 40 then 'r' when at_narration is null then 'n' end"""
    dated = f"(c.text rlike r'^{DATE}$' or coalesce(abs(c.x - at_value) < 35 and c.text rlike r'{DATE}', false))"
    free = rf"filter(cells, c -> c.text rlike r'[\p{{L}}\p{{N}}]' and not c.text rlike r'{AMOUNT}' and not {dated})"
    return F.expr(f"transform({free}, c -> struct(c.text as text, {place} as place))")


def scanned_rows(words: DataFrame, least_confidence: float = 15.0, reach: float = 18.0) -> DataFrame:
    """Ledger rows of pages that a reader of images made words of (with a column `conf` where it tells its confidence).

    Lines by running means, columns by a page's header, by the last header's shares of the width, or by fixed shares; the
    second date of a line where the first is impossible; amounts put together where they were split.
    """
    some = words.where(F.trim("text") != "")
    some = some.where(F.col("conf") >= least_confidence) if "conf" in words.columns else some
    page_lines = running_mean_lines(_of_pages(some), reach).repartition(*PAGE)
    token = F.when(F.col("line").rlike(DATE) & (terms_of(F.col("line"), REPEATED_SCANNED) < 2), F.lit(True))
    rows = placed(page_lines, page_layouts(page_lines, SCANNED, SCANNED_SHARES, scaled=True), SCANNED.below, token)
    rows = _once(rows, date=row_date(F.col("line")), **{c: cell_amount(_bucket(c)) for c in ("debit", "credit", "balance")})
    rows = rows.where(F.col("date").isNotNull() & (F.col("debit").isNotNull() | F.col("credit").isNotNull()))
    rest = F.trim(F.regexp_replace("line", rf"^(.*?){DATE}", "$1"))
    return _source(_once(rows, narration=F.coalesce(F.nullif(_joined(_bucket("narration")), F.lit("")), rest), reference=_joined(_bucket("reference"))))


def gap_lines(words: DataFrame, gap: float = 18.0) -> DataFrame:
    """Lines that end where the next word lies lower by more than gap; a line's y is that of its first word."""
    w = W.partitionBy(*PAGE).orderBy("y0", "x0")
    new = F.coalesce((F.col("y0") - F.lag("y0").over(w) > gap).cast("int"), F.lit(0))
    rows = words.where(F.trim("text") != "").repartition(*PAGE).withColumn("new", new).withColumn("line_no", F.sum("new").over(w))
    out = rows.groupBy(*PAGE, "line_no").agg(F.min("y0").alias("y"), F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))).alias("words"))
    return out.withColumn("line", F.array_join(F.transform("words", lambda x: x["text"]), " "))


# Dates (a word between two numbers only if it is a month's) and amounts within a line of text.
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
LINE_DATE = rf"(?i)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{1,2}}\s+(?:{MONTHS})[a-z]{{0,6}}\s+\d{{2,4}})\b"
LINE_AMOUNT = r"(?i)(?<![a-z0-9.,])(?:₹\s*)?\(?\d[\d,]*(?:\.\d+)?\)?(?:\s*(?:CR|DR))?(?![a-z0-9])"


def line_rows(words: DataFrame) -> DataFrame:
    """Ledger rows from single lines with a date, by the roles of their amounts, where nothing tells columns apart.

    The largest amount is the movement. Amounts that say CR or DR, or all of a line that says BAL, are balances, of which
    the largest counts; numbers of dates and within words aren't amounts. The side is that of the change from the last balance, else of the narration's words.
    """
    rows = gap_lines(words)
    token = F.regexp_extract("line", f"({LINE_DATE})", 1)
    rows = _once(rows.where(F.col("line").rlike(LINE_DATE)), token=token, rest=F.regexp_replace("line", LINE_DATE, " "))
    raw = F.transform(F.regexp_extract_all("rest", F.lit(f"({LINE_AMOUNT})"), F.lit(1)), lambda t: F.struct(t.alias("raw"), T.printed_money(t).alias("value")))
    rows = _once(rows, money=F.filter(raw, lambda m: m["value"].isNotNull())).where(F.size("money") > 0)
    says = F.upper("line").contains("BAL")
    balances = F.filter("money", lambda m: says | F.upper(m["raw"]).rlike("(?:CR|DR)$"))
    narration = F.regexp_replace(F.regexp_replace(F.regexp_replace("rest", LINE_AMOUNT, " "), r"\s+", " "), r"^[ \-:|]+|[ \-:|]+$", "")
    rows = _once(rows, date=T.parse_words_date(F.col("token")), amount=F.array_max(F.transform("money", lambda m: F.abs(m["value"]))), balance=F.array_max(F.transform(balances, lambda m: m["value"])), narration=F.coalesce(F.nullif(narration, F.lit("")), F.trim("line")))
    rows = rows.where(F.col("date").isNotNull())
    before = F.last("balance", ignorenulls=True).over(W.partitionBy("statement_id").orderBy("page", "y").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("side", T.direction(F.col("narration"), F.col("amount"), F.col("balance"), before))
    nth = F.row_number().over(W.partitionBy(*PAGE).orderBy("y"))
    return rows.select("statement_id", (F.col("page").cast("long") * PAGE_ROWS + nth).alias("source_seq"), F.col("page").alias("source_page"), F.col("y").alias("source_y"), F.substring("line", 1, 1500).alias("source_text"), "date", F.substring("narration", 1, 500).alias("narration"), F.lit("").alias("reference"), F.when(F.col("side") == "Debit", F.col("amount")).alias("debit"), F.when(F.col("side") == "Credit", F.col("amount")).alias("credit"), "balance")


# Left and right edges of the columns of one bank's printed pages.
BANDS = {"debit": (70, 145), "credit": (145, 205), "balance": (205, 260), "reference": (250, 320), "narration": (320, 495)}


def fixed_bands(words: DataFrame, reach: float = 6.0) -> DataFrame:
    """Rows of pages whose columns are known: each date takes the words within reach of its height, by band.

    Heights are dealt into buckets of twice the reach, so that this is an equality join.
    """
    date = T.parse_date(F.col("text"))
    bucket = lambda y: F.floor(y / (2 * reach))
    dates = words.where(F.col("x0") < 70).withColumn("date", date).where(F.col("date").isNotNull()).select(*PAGE, F.col("y0").alias("y"), "date")
    dates = dates.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("y") - reach), bucket(F.col("y") + reach)))))
    near = dates.join(words.withColumn("bucket", bucket(F.col("y0"))), [*PAGE, "bucket"]).where(F.abs(F.col("y0") - F.col("y")) <= reach)
    cell = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("x0") >= BANDS[c][0]) & (F.col("x0") < BANDS[c][1]), F.struct("x0", "text")))), lambda s: s["text"]), " ")
    out = near.groupBy(*PAGE, "y", "date").agg(*(cell(c).alias(c) for c in BANDS)).withColumns({c: T.text_money(F.col(c)) for c in ("debit", "credit", "balance")})
    return out.where(F.col("balance").isNotNull() & (F.col("debit").isNotNull() != F.col("credit").isNotNull()))


def wrapped_narration(ledger: DataFrame, page_lines: DataFrame, most: int = 8) -> DataFrame:
    """Lines that go on with the narration of the nth dated line of a page, appended to its nth row; pages without a dated line add to the row before."""
    w = W.partitionBy("statement_id").orderBy("page", "y")
    dated = T.starts_with_date(F.col("line"))
    island = page_lines.withColumn("row_no", F.sum(dated.cast("int")).over(w)).where(~dated & T.is_continuation(F.col("line")) & (F.col("row_no") > 0))
    nth = W.partitionBy("statement_id", "row_no").orderBy("page", "y")
    some = island.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most)
    more = some.groupBy("statement_id", "row_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", F.trim("line").alias("t")))), lambda s: s["t"]), " ").alias("more"))
    numbered = ledger.withColumn("row_no", F.row_number().over(W.partitionBy("statement_id").orderBy("source_seq")))
    joined = numbered.join(more, ["statement_id", "row_no"], "left")
    fresh = F.col("more").isNotNull() & ~F.coalesce(F.contains(F.col("narration"), F.col("more")), F.lit(False))
    return joined.withColumn("narration", F.when(fresh, F.concat_ws(" ", "narration", "more")).otherwise(F.col("narration"))).drop("row_no", "more")
