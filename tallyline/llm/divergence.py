"""Operator 11, audit of how sources differ in their terms: a sort-based, streaming count of terms and of partial pairs.

1. Texts are read once. A task folds its documents into partial runs (lang, term, source, documents, occurrences) before
   anything is shuffled, so a term in every document is a few rows a task and not a row a document.
2. Partial runs are dealt by (lang, term) and sorted by (lang, term, source); one scan adds up equal neighbours. The end
   of a (lang, term) run gives its document frequency; runs of `least` documents or more stay, with their counts.
3. Shares of a group are p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V)), in exact integers.
4. The kept runs are sorted and scanned again: a run adds to the sums of those pairs of sources that both have its term.
   With z the share of a term that a source hasn't got, the distance of a and b is
     V |z_a - z_b|  +  own(a, b) + own(b, a)  +  both(a, b),
   own(a, b) = sum over a's terms of |p_a - z_b| - |z_a - z_b|, which needs a's sums and its few shares below z_b only,
   both(a, b) = sum over common terms of |p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|, from the scan.
   So terms that only one or none of two sources has make no rows, though they count.

Every row is a document of its own, repeated ones as well; no id is read. Null or empty texts have no terms, but their
group counts as occurring; null langs and sources are ''. Ties are ordered by the UTF-8 bytes of the item. An empty table gives an
empty result; a lang of one source has no pairs, one without kept terms only pairs of value 0. Very long texts are taken
in pieces; what a task holds is bounded by FOLDED entries and the distinct terms of one text. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_words import LETTERS, word_pieces, word_table
from .storage import released, written
from .tokenizing import balanced

SCALE = 1_000_000_000
PRIOR = 5
#: Entries of a task's partial runs before they are sent on.
FOLDED = 400_000
#: Sources of which a scan keeps the sums of all pairs; beyond, sums are sent on more often.
HELD = 2048
ROWS = 50_000
TABLE = word_table(LETTERS)
PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("opens", pa.int64())])
PAIRS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("both", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial runs of (lang, source, text) rows."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in groups.items():
            terms = list(counts)
            for at in range(0, len(terms), ROWS):
                some = terms[at : at + ROWS]
                same = lambda x, k=len(some): pa.array([x], pa.string()).take(pa.array(np.zeros(k, np.int32)))
                columns = [same(lang), pa.array(some, pa.binary()).cast(pa.string()), same(source), pa.array([docs[t] for t in some], pa.int64()), pa.array([counts[t] for t in some], pa.int64())]
                yield pa.record_batch(columns, schema=PARTIAL)
        groups.clear()

    for whole in batches:
        for batch in balanced(whole, 2):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                pieces = word_pieces(text, TABLE)
                words = next(pieces, [])
                counts.update(words)
                distinct = set(words)
                for words in pieces:
                    counts.update(words)
                    distinct.update(words)
                docs.update(distinct)
            if sum(len(c) for c, _ in groups.values()) > FOLDED:
                yield from sent()
    yield from sent()


def _differs(table: pa.Table, names: list[str]) -> np.ndarray:
    """For each row whether it differs from the row before in any of names; the first one does."""
    n = table.num_rows
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for name in names:
        c = table.column(name)
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy()
    return out


def _whole_runs(batches: Iterator[pa.RecordBatch], folded) -> Iterator[pa.Table]:
    """Tables of sorted rows in which every (lang, term) run is whole; folded shortens a table before its last run is kept back."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = folded((pa.concat_tables([kept, table]) if kept is not None else table).combine_chunks())
        last = int(np.flatnonzero(_differs(table, ["lang", "term"]))[-1]) if table.num_rows else 0
        if last:
            yield table.slice(0, last)
        kept = table.slice(last)
    if kept is not None and kept.num_rows:
        yield kept


def _added(table: pa.Table) -> pa.Table:
    """Equal neighbours by (lang, term, source) added up."""
    if not table.num_rows:
        return table
    starts = np.flatnonzero(_differs(table, ["lang", "term", "source"]))
    out = table.take(pa.array(starts))
    for k, name in ((3, "docs"), (4, "n")):
        out = out.set_column(k, name, pa.array(np.add.reduceat(table.column(name).to_numpy(), starts)))
    return out


def _runs(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sources and counts of terms in `least` documents or more of their lang."""
        for table in _whole_runs(batches, _added):
            opens = _differs(table, ["lang", "term"])
            starts = np.flatnonzero(opens)
            sizes = np.diff([*starts, table.num_rows])
            n = table.column("n").to_numpy()
            stays = np.repeat(np.add.reduceat(table.column("docs").to_numpy(), starts) >= least, sizes)
            total = np.repeat(np.add.reduceat(n, starts), sizes)
            columns = [*(table.column(c).combine_chunks() for c in ("lang", "term", "source")), pa.array(n), pa.array(total), pa.array(opens.astype(np.int64))]
            yield from pa.table(columns, schema=RUNS).filter(pa.array(stays)).to_batches(max_chunksize=ROWS)

    return scan


class _Sums:
    """Sums of the pairs of one lang's sources, as far as they have been met."""

    def __init__(self) -> None:
        self.lang, self.place, self.sums = None, {}, np.zeros((0, 0), np.int64)

    def sent(self) -> Iterator[pa.RecordBatch]:
        names = list(self.place)
        for a in range(len(names)):
            row = self.sums[a, : len(names)]
            yield from _pair_rows(self.lang, names, a, row)
        self.place, self.sums = {}, np.zeros((0, 0), np.int64)

    def added(self, names: list[str], block: np.ndarray) -> None:
        """block: sums of names by names."""
        for x in names:
            self.place.setdefault(x, len(self.place))
        if len(self.place) > len(self.sums):
            more = 2 * len(self.place) - len(self.sums)
            self.sums = np.pad(self.sums, ((0, more), (0, more)))
        at = [self.place[x] for x in names]
        self.sums[np.ix_(at, at)] += block


def _pair_rows(lang: str, names: list[str], a: int, row: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the non-zero sums of source a with others, the smaller name first."""
    found = np.flatnonzero(row)
    if len(found):
        ends = [sorted((names[a], names[b])) for b in found]
        yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array([x for x, _ in ends], pa.string()), pa.array([y for _, y in ends], pa.string()), pa.array(row[found])], schema=PAIRS)


def _common_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums both(a, b) of rows (lang, term, source, p, z) sorted by (lang, term)."""
    held = _Sums()
    for whole in _whole_runs(batches, lambda t: t):
        edges = np.flatnonzero(_differs(whole, ["lang"]))
        for start, stop in zip(edges, [*edges[1:], whole.num_rows], strict=True):
            table = whole.slice(start, stop - start)
            lang = table.column("lang")[0].as_py()
            if lang != held.lang:
                yield from held.sent()
                held.lang = lang
            coded = table.column("source").combine_chunks().dictionary_encode()
            names, column = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            row = np.cumsum(_differs(table, ["term"])) - 1
            z = np.zeros(len(names), np.int64)
            z[column] = table.column("z").to_numpy()
            p = np.tile(z, (row[-1] + 1, 1))
            p[row, column] = table.column("p").to_numpy()
            large = len(names) > HELD
            if len(held.place) + len(names) > HELD and not large:
                yield from held.sent()
            block = np.zeros((0 if large else len(names), len(names)), np.int64)
            for a in range(len(names) - 1):
                some, own, rest = p[row[column == a]], z[a], z[a + 1 :]
                mine, others = some[:, a : a + 1], some[:, a + 1 :]
                # Where the other source hasn't the term its share is z, and this is 0.
                both = (np.abs(mine - others) - np.abs(mine - rest) - np.abs(own - others) + np.abs(own - rest)).sum(axis=0)
                if large:
                    yield from _pair_rows(lang, names, a, np.concatenate([np.zeros(a + 1, np.int64), both]))
                else:
                    block[a, a + 1 :] = both
            if not large:
                held.added(names, block)
    yield from held.sent()


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return docs.select(named(lang_col, "lang"), named(source_col, "source"), named(text_col, "text").cast("binary").alias("text"))


def term_runs(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, source, n, total: occurrences in the lang, opens: 1 at the first source) of terms in `least` documents of the lang or more."""
    partial = _texts(docs, text_col, lang_col, source_col).mapInArrow(_partial, _ddl(PARTIAL))
    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(_runs(least), _ddl(RUNS))


def _share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (size + PRIOR terms)) in exact integers; null if there are no terms."""
    whole = lambda x: x.cast("decimal(20,0)")
    top, low = whole(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), whole(size + PRIOR * terms)
    return F.when(terms > 0, F.call_function("div", top, low) + 1)


def weighed(docs: DataFrame, runs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, size: N, terms: V, lang_size, z) of every group that occurs; runs is a written table."""
    named = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    every = docs.select(named(lang_col, "lang"), named(source_col, "source")).distinct()
    sizes = runs.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = runs.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.sum("opens").alias("terms"))
    out = every.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "lang_size", "terms"])
    return out.withColumn("z", _share(F.lit(0).cast("long"), F.col("size"), F.col("terms")))


def audited(docs: DataFrame, least: int = 30, most: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source to the others of its lang (`pair`), and the
    `most` terms that it has more of than its lang (`term`)."""
    runs = written(term_runs(docs, least, text_col, lang_col, source_col), "runs")
    groups = written(weighed(docs, runs, lang_col, source_col), "groups")
    shares = runs.join(groups, ["lang", "source"]).select("lang", "term", "source", "z", "total", "lang_size", "terms", _share(F.col("n"), F.col("size"), F.col("terms")).alias("p"))

    over = shares.withColumn("value", F.col("p") - _share(F.col("total"), F.col("lang_size"), F.col("terms"))).where("value > 0")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = over.select("lang", "source", "term", "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    dealt = shares.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = dealt.mapInArrow(_common_terms, _ddl(PAIRS)).groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))
    # A source's own sums, and its shares below the largest z of its lang.
    top = groups.groupBy("lang").agg(F.max("z").alias("top_z"))
    low = shares.join(top, "lang").where("p < top_z").groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    low = low.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("low"))
    sums = shares.groupBy("lang", "source").agg(F.sum("p").alias("p_sum"), F.count("*").alias("own_terms"))
    each = groups.join(sums, ["lang", "source"], "left").join(low, ["lang", "source"], "left").fillna(0, ["p_sum", "own_terms"])
    each = written(each.select("lang", "source", "terms", F.coalesce("z", F.lit(0)).alias("z"), "p_sum", "own_terms", "low"), "sources")
    one = each.toDF("lang", "a", "terms", "z_a", "p_a", "k_a", "low_a")
    two = each.drop("terms").toDF("lang", "b", "z_b", "p_b", "k_b", "low_b")
    apart = "abs(z_a - z_b)"
    own = lambda a, b: f"p_{a} - k_{a} * z_{b} + 2 * aggregate(coalesce(low_{a}, array()), 0L, (s, x) -> s + x.m * greatest(0L, z_{b} - x.p)) - k_{a} * {apart}"
    pairs = one.join(two, "lang").where("a < b").select("lang", "a", "b", F.expr(f"terms * {apart} + {own('a', 'b')} + {own('b', 'a')}").alias("apart"))
    pairs = pairs.join(both, ["lang", "a", "b"], "left").withColumn("value", F.col("apart") + F.coalesce("both", F.lit(0)))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", "value", F.inline(ends))
    far = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(far).alias("rank"))
    return pairs.unionByName(terms)
