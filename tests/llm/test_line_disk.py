"""What operator 7 keeps on disk at once, and that it makes a line's features once."""

import glob
import random

from pyspark.sql import functions as F

from tallyline.llm import components, line_dedup, storage

from .conftest import text
from .test_line_recall import letter_edits


def test_features_are_made_once(spark):
    """A value that a filter needs as well is not made again for it."""
    nodes = spark.createDataFrame([(1, text(1, 20), 100)], "node long, line string, size int")
    for rows in (line_dedup.blocks(nodes), line_dedup.features(nodes)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all") == 2 and plan.count("split(line") == 1


def test_lines_are_normalised_once(spark):
    docs = spark.createDataFrame([(1, "One, two\n\n THREE ΣΣ-Σ \n--\nx")], "doc_id long, text string")
    rows = line_dedup._rows(docs, "doc_id", "text")
    assert rows._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1
    assert [(r["pos"], r["line"]) for r in rows.collect()] == [(0, "one two"), (2, "three σς σ"), (4, "x")]


def test_tables_go_when_they_are_done(spark, monkeypatch):
    """When keys are shuffled there is one table with texts, and parts of the keys that are done are gone."""
    lines = [x for k in range(40) for x in (text(k, 20), letter_edits(random.Random(k), text(k, 20), 1))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    plain, seen = components.written, []
    folder = storage.shared_folder(spark)
    before = set(glob.glob(f"{folder}/tallyline-*"))

    def spied(df, name, *args, **kwargs):
        out = plain(df, name, *args, **kwargs)
        if name == "shared":
            new = set(glob.glob(f"{folder}/tallyline-*")) - before
            texts = [x for x in new if "line" in spark.read.parquet(x).columns]
            seen.append((len([x for x in texts if "-short-" not in x]), len(glob.glob(f"{folder}/tallyline-keys-*/part=*")) - len([x for x in before if "-keys-" in x])))
        return out

    monkeypatch.setattr(components, "written", spied)
    gone = line_dedup.deduplicated(docs, count_col="gone").where("gone > 0").count()
    assert gone == 40
    assert seen == [(1, components.PARTS - k) for k in range(components.PARTS)]


def test_distances_are_within_bounds(spark):
    """Whatever of the limit is tried first: a bound is given if and only if the distance is within the limit."""
    r, pairs = random.Random(3), []
    for k in range(120):
        s = text(k, r.randint(1, 90))
        t = letter_edits(r, s, r.randint(1, max(1, len(s) // 4)))
        words = t.split()
        at = r.randrange(len(words) + 1)
        t = " ".join(words[:at] + text(1000 + k, r.randint(1, 3)).split() + words[at:]) if k % 3 else t
        pairs.append((k, -k, max(len(s), len(t)) // 5, s, t))
    rows = spark.createDataFrame(pairs, "u long, v long, limit int, s string, t string")
    plain = rows.select("u", "limit", F.expr("levenshtein(s, t)").alias("e"))
    found = plain.join(line_dedup._distances(rows).select("u", "d", "least"), "u").collect()
    assert len(found) == 120 and 30 < sum(x["e"] <= x["limit"] for x in found) < 120
    for x in found:
        assert (x["d"] is None) == (x["e"] > x["limit"]) and (x["d"] is None or x["e"] <= x["d"] <= x["limit"]) and (x["d"] is not None or x["least"] == x["limit"] + 1)
