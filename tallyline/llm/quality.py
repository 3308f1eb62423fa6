"""Operator 5, quality rules with risk-controlled cutoffs.

Every text is measured once, in Arrow batches; the measures are a small table in the shared folder. Each rule
compares one measure with a cutoff, above which a text is rejected.

- On one half of the labelled rows, by a hash of the id, each stratum (language) picks for each rule the cutoff
  that parts bad from good texts best, and ranks the rules by that.
- On the other half the rules are switched on in this order, and each number of rules is tested: the exact
  binomial probability of so few rejected good texts, if the true share were `RISK`, must be at most `DELTA`
  divided by the number of tests (strata times rules). Only rule sets that pass may be used; among them the one
  that parts best is. So with probability 1 - DELTA no stratum's rules reject more than RISK of its good texts.
- A stratum without enough labels for any test keeps what the base rules keep: with so few, no exact test can pass.
- The risk is that of the method's rules over all labelled good texts, those that the base rules reject among them.

Strata are chosen and tested in a task each, from counts by rule and cutoff, and their cutoffs are joined to the rows.
Very long texts are measured whole, in memory linear in their length. Null text has no words; null languages and
empty ones are one stratum; null labels don't count, of repeated labels the largest does. A labelled document is one trial of a
test however often its row is repeated; of unlike rows of one id that with the least stratum and measures counts. An empty
table gives an empty result, repeated rows a row each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import released, written
from .tokenizing import balanced

SYMBOLS = b"#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"!?.,;:"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    k = len(seen)
    if k < 1 << 21:
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * k + ids[2:]
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then lines with a word, capitals, marks, distinct words."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, SPACE))
    less = lambda gone: len(data) - len(data.translate(None, gone))
    return len(words), chars, less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), less(CAPITALS), less(MARKS), len(set(words))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct")
RISK, DELTA = 0.03, 0.05
#: What a share of good texts costs against the same share of bad ones.
WEIGHT = 10


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def grids() -> dict[str, list[float]]:
    """The cutoffs among which a stratum chooses, by rule."""
    shares = [round(0.005 * 1.12**k, 4) for k in range(47)]
    return {
        "symbols": shares, "capitals": shares, "marks": [round(0.1 * 1.08**k, 4) for k in range(47)], "repetition": shares,
        "same_words": [round(0.02 * k, 2) for k in range(1, 50)], "same_lines": shares, "long_words": [round(4 + 0.2 * k, 1) for k in range(60)],
    }


def rules() -> dict[str, tuple[Column, list[float]]]:
    """Measure and cutoffs by rule."""
    measure = {
        "symbols": _share("n_symbols", "word_chars"), "capitals": _share("n_capitals", "word_chars"), "marks": _share("n_marks", "n_words"), "repetition": _share("n_repeat_words", "n_words"),
        "same_words": F.lit(1) - _share("n_distinct", "n_words"), "same_lines": _share("n_dup_lines", "n_lines"), "long_words": _share("word_chars", "n_words"),
    }
    return {k: (measure[k], grid) for k, grid in grids().items()}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id_col, stratum, the measures) for each row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).cast("string").alias("qr_text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in balanced(whole, 2):
                found = np.array([measures(x) for x in pc.fill_null(batch.column(2), "").to_pylist()], dtype=np.int64).reshape(-1, len(NAMES))
                yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(len(NAMES)))], names=[id_col, "stratum", *NAMES])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(measure, f"`{id_col}` {kind}, stratum string, " + ", ".join(f"{x} long" for x in NAMES))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Exact probability of k or fewer of n."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def ranked_cutoffs(counts: dict[str, dict[tuple[bool, int], int]]) -> list[tuple[str, float]]:
    """The rules of one stratum with their best cutoffs, the best rule first; from counts by good and bin of each rule. Ties go to the later name and the higher cutoff."""
    out: list[tuple[float, str, float]] = []
    for rule, n in counts.items():
        grid = grids()[rule]
        size = {g: sum(v for (x, _), v in n.items() if x == g) for g in (True, False)}
        if not size[True] or not size[False]:
            continue
        above = lambda g, b: sum(v for (x, k), v in n.items() if x == g and k > b) / size[g]  # noqa: B023, E731
        gain, b = max((above(False, b) - WEIGHT * above(True, b), b) for b in range(len(grid)))
        if gain > 0:
            out.append((gain, rule, grid[b]))
    return [(rule, cutoff) for _, rule, cutoff in sorted(out, reverse=True)]


#: What a stratum's cutoffs look like in a table.
CHOSEN = "array<struct<rule:int,cutoff:double>>"


def failed() -> Column:
    """How many of the row's rules (column `chosen`) must be switched on until it is rejected; null if none rejects it."""
    values = F.array(*(x.cast("double") for x, _ in rules().values()))
    above = F.transform("chosen", lambda c: F.element_at(values, c["rule"] + 1) > c["cutoff"])
    return F.nullif(F.coalesce(F.array_position(above, True), F.lit(0)), F.lit(0)).cast("int")


def certified(tests: dict[str, dict[bool, list[int]]], sizes: dict[str, dict[bool, int]], risk: float, delta: float, n_tests: int | None = None) -> dict[str, int]:
    """By stratum the number of rules to switch on, among those that pass the exact test; n_tests: of all strata."""
    n_tests = n_tests or sum(len(x[True]) for x in tests.values()) or 1
    out = {}
    for stratum, rejected in tests.items():
        good, bad = max(sizes[stratum].get(True, 0), 1), max(sizes[stratum].get(False, 0), 1)
        passed = [k for k, x in enumerate(rejected[True]) if binomial_tail(x, good, risk) <= delta / n_tests]
        if passed:
            out[stratum] = 1 + max(passed, key=lambda k: (rejected[False][k] / bad - WEIGHT * rejected[True][k] / good, -k))
    return out


def fitted(rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, chosen: its rules and cutoffs) from the labelled rows of a table of measures; strata without any have no row."""
    names = list(grids())
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("qr_id")).agg(F.max(F.col(label_col) > 0).alias("good"))
    # Repeated rows aren't independent trials, so each labelled id has one.
    one = rows.join(marked, rows[id_col] == F.col("qr_id")).groupBy("qr_id").agg(F.first("good").alias("good"), F.min(F.struct("stratum", *NAMES)).alias("row"))
    known = written(one.select("row.*", "good", F.pmod(F.xxhash64("qr_id"), F.lit(2)).alias("half")).select("stratum", "good", "half", *NAMES), "labelled")
    below = lambda measure, grid: F.size(F.filter(F.array(*map(F.lit, grid)), lambda x: x < measure))
    bins = [F.struct(F.lit(k).alias("rule"), below(*x).alias("bin")) for k, x in enumerate(rules().values())]
    # A row's bin is the number of cutoffs below its measure, so it is above cutoff b if its bin is larger than b.
    first = known.where("half = 0").select("stratum", "good", F.explode(F.array(*bins)).alias("x")).groupBy("stratum", "good", "x.rule", "x.bin").agg(F.count("*").alias("n"))

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A stratum's counts are at most two by the number of cutoffs."""
        counts: dict[str, dict[tuple[bool, int], int]] = {}
        for good, rule, b, n in pdf[["good", "rule", "bin", "n"]].itertuples(index=False):
            counts.setdefault(names[rule], {})[bool(good), int(b)] = int(n)
        found = [{"rule": names.index(rule), "cutoff": cutoff} for rule, cutoff in ranked_cutoffs(counts)]
        return pd.DataFrame({"stratum": [key[0]], "chosen": [found]})

    ranked = written(first.groupBy("stratum").applyInPandas(choose, f"stratum string, chosen {CHOSEN}").where("size(chosen) > 0"), "ranked")
    n_tests = ranked.agg(F.sum(F.size("chosen"))).first()[0] or 1
    later = known.where("half = 1").join(ranked, "stratum").select("stratum", "good", "chosen", failed().alias("k")).groupBy("stratum", "good", "k").agg(F.first("chosen").alias("chosen"), F.count("*").alias("n"))

    def certify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = [dict(rule=int(x["rule"]), cutoff=float(x["cutoff"])) for x in pdf["chosen"].iloc[0]]
        pdf = pdf.assign(k=pd.to_numeric(pdf["k"]).fillna(np.inf))
        sizes = {g: int(pdf["n"][pdf["good"] == g].sum()) for g in (True, False)}
        tests = {g: [int(pdf["n"][(pdf["good"] == g) & (pdf["k"] <= k + 1)].sum()) for k in range(len(chosen))] for g in (True, False)}
        best = certified({key[0]: tests}, {key[0]: sizes}, risk, delta, n_tests)
        return pd.DataFrame({"stratum": [key[0]], "chosen": [chosen[: best.get(key[0], 0)]]})

    out = written(later.groupBy("stratum").applyInPandas(certify, f"stratum string, chosen {CHOSEN}").where("size(chosen) > 0"), "cutoffs")
    released(known, ranked)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The measures of each row, base_failed and kept."""
    rows = written(measured(docs, id_col, text_col, stratum_col), "measures")
    cutoffs = fitted(rows, labels, id_col=id_col, label_col=label_col)
    return rows.join(cutoffs, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & failed().isNull()).drop("chosen")
