"""Operator 4, toxicity by maximum-scoring segments.

Training (labelled rows outside the held-out fold, `SAMPLE` of them at most, chosen by a hash of the id):
- Log-odds of toxic against other documents for words, by document frequency, with Dirichlet priors: a word's
  prior is its leading five characters, theirs the leading four, theirs no evidence. A word that was never
  seen gets the log-odds of its beginning.
- From a quarter of the sample that the counts don't use: the scores of tokens of non-toxic texts give the
  scale lambda of the extreme-value law (E exp(lambda s) = 1) and, with the best segments of these texts, its
  constant K; a logistic curve over log(1 + evidence) turns the evidence of a document into a probability.

Scoring (all rows, one pass without a shuffle): token scores are log-odds less a drift; a linear-time scan
(Ruzzo and Tompa) finds all maximal segments. A segment of score S in n tokens counts as far as
lambda S - ln(K n) is positive, which is minus the log of its expected number by chance; a document's
evidence is the sum over its significant segments.

Null text counts as empty; texts without words have no evidence and the curve's lowest score. Unlabelled,
null-labelled and repeated labels: the largest label of an id counts, null ones don't. Ties can't arise: a text's score
depends on its words alone. Very long texts are scored whole, in time and memory linear in their length. Without any toxic or
any other training label every score is 0. Null ids are never held out. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenizing import balanced

#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 30_000
#: Weight of a prior, in documents.
PRIOR = 2.0
#: Taken from each token's log-odds, so that a text's expected score is negative.
DRIFT = 1.0
#: A word or beginning counts for itself if it is in this many sampled documents; so the model is bounded by the sample.
SEEN = 3
REMEMBERED = 400_000
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_`~"


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def beginnings(word: bytes) -> tuple[str, str, str]:
    """The word without its marks, its first five characters and its first four; each with a sign of its kind."""
    w = (word.strip(EDGES) or word).decode()
    return "w" + w, "5" + w[:5], "4" + w[:4]


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, stop, score) of all maximal scoring segments, in order: Ruzzo and Tompa's scan over the runs of positive scores."""
    positive = scores > 0
    if not positive.any():
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    turns = np.flatnonzero(np.diff(np.concatenate([[0], positive.view(np.int8), [0]])))
    found: list[list] = []  # start, stop, sum before, sum after, index of the last one with a lower sum before
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        now = [a, b, total[a], total[b], -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= now[3]:
                now[4] = j
                found.append(now)
                break
            now[0], now[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, float(r - left)) for a, b, left, r, _ in found]


@dataclass
class Model:
    """Log-odds of words and beginnings, the constants of the extreme-value law and of the logistic curve."""

    odds: dict[str, float]
    scale: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -50.0

    def token(self, word: bytes) -> float:
        w, five, four = beginnings(word)
        found = self.odds.get(w)
        if found is None:
            found = self.odds.get(five)
        if found is None:
            found = self.odds.get(four, 0.0)
        return found - DRIFT


class Scorer:
    """Token scores are looked up in what this worker saw before."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def scores(self, text: str) -> np.ndarray:
        found, known = words(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(found).difference(known):
            known[w] = self.model.token(w)
        return np.fromiter(map(known.__getitem__, found), np.float64, len(found))

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the significant segments with their evidence."""
        s, m = self.scores(text), self.model
        chance = m.log_k + math.log(max(len(s), 1))
        return len(s), [(a, b, e) for a, b, x in maximal_segments(s) if (e := m.scale * x - chance) > 0]


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, text, label) of at most sample training rows; the sampled ids and labels are small and are broadcast."""
    train = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    train = train.groupBy(F.col(id_col).alias("tx_id")).agg(F.max(label_col).cast("int").alias("tx_label"))
    train = train.orderBy(F.xxhash64("tx_id"), "tx_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("tx_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("tx_text"))
    return texts.join(F.broadcast(train), "tx_id").select("tx_text", "tx_label", (F.crc32(F.col("tx_id").cast("string")) % 20 >= 15).alias("tx_later"))


def log_odds(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> dict[str, float]:
    """Log-odds of every unit, beginnings first: (documents that have it + prior) by class."""
    out: dict[str, float] = {}

    def of(c1: int, c0: int, parent: float) -> float:
        ratio = math.exp(parent)
        p1 = ratio * n1 / (ratio * n1 + n0)
        return math.log((c1 + PRIOR * p1) / n1) - math.log((c0 + PRIOR * (1 - p1)) / n0)

    for kind in "45w":
        for unit in (u for u in counts if u[0] == kind):
            up = 0.0 if kind == "4" else out.get("4" + unit[1:5], 0.0)
            up = up if kind != "w" else out.get("5" + unit[1:6], up)
            out[unit] = of(*counts[unit], up)
    return out


def scale_of(histogram: dict[float, int]) -> float:
    """The positive root of E exp(lambda s) = 1; 1 if there is none."""
    s, n = np.array(list(histogram)), np.array(list(histogram.values()), dtype=float)
    if not len(s) or s.max() <= 0 or (s * n).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    mean = lambda x: float((n * np.exp(x * s)).sum() / n.sum())
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with step halving; a ridge keeps them finite where the classes are apart."""
    def loss(w: np.ndarray) -> float:
        z = w[0] * x + w[1]
        return float((np.logaddexp(0, z) - y * z).sum() + 0.05 * (w[0] ** 2))

    w = np.array([0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -50, 50)))
        g, h = p - y, p * (1 - p)
        grad = np.array([(g * x).sum() + 0.1 * w[0], g.sum()])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if size * np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of at most sample labelled rows outside the held-out fold."""
    rows = labelled(docs, labels, id_col, text_col, label_col, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = {u for w in set(words(text)) for u in beginnings(w)}
                seen[label > 0].update(units | {"n"})
        units = list(seen[0].keys() | seen[1].keys())
        yield pa.record_batch([pa.array(units, pa.string()), *(pa.array([seen[k][u] for u in units], pa.int64()) for k in (1, 0))], names=["unit", "c1", "c0"])

    counts = rows.where(~F.col("tx_later")).select("tx_text", "tx_label").mapInArrow(count, "unit string, c1 long, c0 long")
    counts = counts.groupBy("unit").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"), (F.sum("c1") + F.sum("c0")).alias("c"))
    kept = {r["unit"]: (r["c1"], r["c0"]) for r in counts.where(F.col("c") >= SEEN).collect()}
    n1, n0 = kept.pop("n", (0, 0))
    if not n1 or not n0:
        return Model({})
    model = Model(log_odds(kept, n1, n0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document: its tokens, label, segment scores; and the histogram of the token scores of the others."""
        scorer, bins = Scorer(sent.value), Counter()
        schema = pa.schema([("n", pa.int64()), ("label", pa.int32()), ("found", pa.list_(pa.float64()))])
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = scorer.scores(text)
                out.append((len(s), label, sorted((x for _, _, x in maximal_segments(s)), reverse=True)))
                if not label:
                    values, n = np.unique(np.round(s, 1), return_counts=True)
                    bins.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
        yield pa.RecordBatch.from_pylist([{"n": n, "label": -1, "found": [v]} for v, n in bins.items()], schema=schema)

    later = rows.where("tx_later").select("tx_text", "tx_label").mapInArrow(calibrate, "n long, label int, found array<double>").collect()
    histogram: Counter = Counter()
    for r in later:
        if r["label"] < 0:
            histogram[r["found"][0]] += r["n"]
    texts = [r for r in later if r["label"] >= 0]
    model.scale = scale_of(histogram)
    best = [model.scale * r["found"][0] - math.log(r["n"]) for r in texts if r["label"] == 0 and r["found"]]
    model.log_k = float(np.mean(best)) - 0.5772 if best else 0.0
    y = np.array([min(r["label"], 1) for r in texts], dtype=float)
    if y.min(initial=1) == y.max(initial=0):
        return model
    x = np.array([sum(max(0.0, model.scale * s - model.log_k - math.log(max(r["n"], 1))) for s in r["found"]) for r in texts])
    model.slope, model.offset = logistic(np.log1p(x), y)
    return model


def probability(model: Model, evidence: np.ndarray) -> np.ndarray:
    """Of each document to be toxic, from its evidence."""
    return 1 / (1 + np.exp(-np.clip(model.slope * np.log1p(evidence) + model.offset, -50, 50)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, evidence, passages: array of start and stop token and evidence) for each row."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("tx_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("evidence", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m)
        for whole in batches:
            for batch in balanced(whole, 1):
                found = [scorer.passages(x)[1] for x in pc.fill_null(batch.column(1), "").to_pylist()]
                evidence = np.array([math.fsum(e for *_, e in x) for x in found])
                value = probability(m, evidence)
                spans = pa.array([[{"start": a, "stop": b, "evidence": e} for a, b, e in x] for x in found], kind)
                yield pa.record_batch([batch.column(0), pa.array(value), pa.array(evidence), spans], names=[id_col, "score", "evidence", "passages"])

    return rows.mapInArrow(score, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double, evidence double, passages array<struct<start:long,stop:long,evidence:double>>")


def kept(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below limit; in one pass, whatever their ids."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m)
        for whole in batches:
            for batch in balanced(whole, place):
                evidence = np.array([math.fsum(e for *_, e in scorer.passages(x)[1]) for x in pc.fill_null(batch.column(place), "").to_pylist()])
                yield batch.filter(pa.array(probability(m, evidence) < limit))

    return docs.mapInArrow(keep, docs.schema)
