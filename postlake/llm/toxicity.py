"""Toxic passages by maximum-scoring segments of token log-odds.

Words and their beginnings get log-odds between toxic and clean documents with an
informative Dirichlet prior; units that chance could explain count as neutral.  Over
a whole text, every word has a score (its longest known unit's, or a small drift
below zero) and the maximal scoring segments are found in one linear scan.  A
segment's score is judged by the extreme-value law of such maxima: in n clean
words about K n exp(-lambda S) segments reach S.  What a document's segments hold
beyond chance is summed and calibrated to a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import tokens
from postlake.llm.common import NO_ID, batch_texts, id_of, written

#: Lengths in bytes of the word beginnings that are units besides whole words.
PREFIXES = (6, 5, 4)
_PASSAGE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
_SCORED = "k long, n_words long, evidence double, passages array<struct<start:long,length:long,score:double,expected:double>>"


@dataclass(frozen=True)
class Model:
    """units: sorted hashes; odds: their log-odds; decay and rate: lambda and K; slope and bias: the calibration."""

    units: np.ndarray
    odds: np.ndarray
    drift: float = 0.05
    decay: float = 1.0
    rate: float = 0.01
    slope: float = 0.0
    bias: float = 0.0

    def probability(self, evidence):
        return 1 / (1 + np.exp(-(self.bias + self.slope * np.log1p(evidence))))


def unit_hashes(text: pa.Array) -> tuple[tokens.Words, list[np.ndarray]]:
    """The words of a slice and, from longest to shortest, the hashes of their units; a word without that beginning has 0."""
    words = tokens.Words(text, tokens.ALNUM_FOLDED, spans=True)
    data, _ = tokens.text_bytes(text)
    lengths = words.ends - words.starts
    units = [words.hashes]
    for size in PREFIXES:
        cut = np.zeros(len(lengths), np.uint64)
        longer = np.flatnonzero(lengths > size)
        cut[longer] = tokens.mix(tokens.hash_words(data, words.starts[longer], np.full(len(longer), size), tokens.ALNUM_FOLDED) ^ np.uint64(size))
        units.append(cut)
    return words, units


def word_scores(units: list[np.ndarray], model: Model) -> np.ndarray:
    scores = np.full(len(units[0]), -model.drift)
    todo = np.arange(len(scores))
    for unit in units:
        if not len(model.units) or not len(todo):
            break
        at = np.minimum(np.searchsorted(model.units, unit[todo]), len(model.units) - 1)
        known = model.units[at] == unit[todo]
        scores[todo[known]] = model.odds[at[known]]
        todo = todo[~known]
    return scores


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, length, score) of a sequence, in one linear scan.

    Each is a run of words none of whose ends can be cut or extended to a higher
    sum; runs are disjoint.  Only words above zero are visited, between them the
    running sums suffice.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    up = np.flatnonzero(scores > 0)
    found: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier one with a lower sum before
    for start, before, after in zip(up.tolist(), sums[up].tolist(), sums[up + 1].tolist(), strict=True):
        end = start + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append([start, end, before, after, j])
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(s, e - s, r - lo) for s, e, lo, r, _ in found]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, toxic, n): in how many documents of a slice a unit occurs."""
    for batch in batches:
        for part in tokens.slices(batch):
            words, units = unit_hashes(part.column("text"))
            row = words.rows().astype(np.uint64)
            toxic = np.asarray(part.column("toxic"))
            for unit in units:
                order = np.lexsort((row, unit))
                u, r = unit[order], row[order]
                new = np.append(True, (u[1:] != u[:-1]) | (r[1:] != r[:-1]))[: len(u)] & (u != 0)
                u, r = u[new], r[new].astype(np.int64)
                for label in (0, 1):
                    some, n = np.unique(u[toxic[r] == label], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(np.full(len(some), label, np.int32)), pa.array(n)], names=["unit", "toxic", "n"])


def log_odds(counts: DataFrame, toxic: int, clean: int, strength: float = 100.0) -> DataFrame:
    """Add odds and gain to (unit, t, c), the toxic and clean documents that hold a unit.

    odds: log-odds of document frequencies, under a Dirichlet prior that weighs
    ``strength`` documents and has the pooled shares.  gain: n KL(t / n || share
    of toxic documents); chance alone reaches a gain of g with a probability of at
    most exp(-g).
    """
    n, base = F.col("t") + F.col("c"), toxic / (toxic + clean)
    prior = F.lit(strength) * n / F.lit(float(toxic + clean))
    part = lambda c, total: F.log((F.col(c) + prior) / (F.lit(total + strength) - F.col(c) - prior + 1))
    term = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / n / F.lit(share))).otherwise(0.0)
    return counts.withColumn("odds", part("t", toxic) - part("c", clean)).withColumn("gain", term("t", base) + term("c", 1 - base))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_odds: float = 2.5, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit to at most ``max_rows`` labelled documents, those with the smallest hashes of their ids.

    A unit of ``least_docs`` documents or more enters the model if its gain is
    beyond what the best of all units would reach by chance; the sample bounds
    their number.  Of several texts with one id that with the smallest hash
    counts, of several labels the largest; null ids and labels other than 0 and 1
    do not.  Without both classes the model knows no unit and scores every text
    alike.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    train = written(texts.join(F.broadcast(chosen), "k").groupBy("k", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = Model(np.zeros(0, np.uint64), np.zeros(0))
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rest = toxic + clean
        return Model(empty.units, empty.odds, bias=0.0 if not rest else float(np.log((toxic + 0.5) / (clean + 0.5))))
    each = train.select("text", "toxic").mapInArrow(_counted, "unit long, toxic int, n long")
    counts = each.groupBy("unit").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    tested = written(counts.where(F.col("t") + F.col("c") >= least_docs))
    chance = float(np.log(max(tested.count(), 1))) + 1
    known = log_odds(tested, toxic, clean).where((F.col("gain") >= chance) & (F.abs("odds") >= least_odds)).select("unit", "odds").toPandas()
    units = known["unit"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(units)
    return calibrated(Model(units[order], known["odds"].to_numpy(float)[order]), train)


def _each(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[int, np.ndarray, list]]:
    """Label, word scores and segment scores of every training document."""
    for batch in batches:
        for part in tokens.slices(batch):
            words, units = unit_hashes(part.column("text"))
            scores = word_scores(units, model)
            for label, a, b in zip(part.column("toxic").to_pylist(), words.first[:-1], words.first[1:], strict=True):
                yield label, scores[a:b], [s for _, _, s in segments(scores[a:b])]


def calibrated(model: Model, train: DataFrame) -> Model:
    """Fit the extreme-value law to clean documents and the probability to all.

    decay solves sum of p(s) exp(decay * s) = 1 over the scores s of clean words;
    rate follows from how many segments of clean documents reach their median.
    """

    def law(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Counter(), Counter()
        for label, scores, segments_ in _each(batches, model):
            if not label:
                value, number = np.unique(scores, return_counts=True)
                words.update(dict(zip(value.tolist(), number.tolist(), strict=True)))
                found.update(round(s, 1) for s in segments_)
        for kind, seen in enumerate((words, found)):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(seen), pa.int32()), pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["kind", "value", "n"])

    rows = train.select("text", "toxic").mapInArrow(law, "kind int, value double, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")).orderBy("kind", "value").toPandas()
    (value, number), (score, often) = [rows.loc[rows["kind"] == kind, ["value", "n"]].to_numpy(float).T for kind in (0, 1)]
    positive, number = float(model.odds.max(initial=1.0)), np.append(number, [1.0, 1.0])  # one more word of the drift and of the best unit, so that there is a root
    value = np.append(value, [-model.drift, positive])
    decay = _root(lambda x: float((number * np.exp(np.minimum(x * value, 500))).sum() / number.sum()) - 1)
    middle = float(score[np.searchsorted(np.cumsum(often), often.sum() / 2)]) if len(score) else 0.0
    rate = (often[score >= middle].sum() + 1) / number.sum() * np.exp(decay * middle)
    model = Model(model.units, model.odds, model.drift, decay, float(rate))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(label, beyond_chance(np.array(found), len(scores), model)) for label, scores, found in _each(batches, model)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.float64())], names=["toxic", "evidence"])

    rows = train.select("text", "toxic").mapInArrow(weigh, "toxic int, evidence double").toPandas()
    slope, bias = _logistic(np.log1p(rows["evidence"].to_numpy()), rows["toxic"].to_numpy(float))
    return Model(model.units, model.odds, model.drift, decay, float(rate), slope, bias)


def _root(f) -> float:
    """The positive zero of a convex function that starts below zero, between 1e-3 and 10."""
    lo, hi = 1e-3, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def beyond_chance(scores: np.ndarray, n: int, model: Model) -> float:
    """Sum of log(1 / expected number) over segments that clean text of this length would hold less than once."""
    if not len(scores):
        return 0.0
    surprise = model.decay * scores - np.log(max(model.rate * n, 1e-12))
    return float(np.maximum(surprise, 0).sum())


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and bias by Newton steps with a small ridge."""
    w, design = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * w)
    return max(float(w[0]), 0.0), float(w[1])


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: one row per input row with the id, n_words, score (0 to 1), evidence and passages.

    passages are the maximal scoring segments that clean text of the document's
    length would hold less than once: start and length in words, score and the
    expected number.  Words are runs of ASCII letters, digits and characters
    beyond ASCII, A-Z lower-cased.

    Null and empty texts have no words, no passages and the score of no evidence.
    Null and repeated ids are rows like others; other columns are not read.  Of
    segments that score alike the earlier one comes first.  An empty table gives none.
    """
    batch_texts(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in tokens.slices(batch):
                words, units = unit_hashes(part.column("text"))
                scores = word_scores(units, model)
                evidence, passages = np.zeros(part.num_rows), [[]] * part.num_rows
                for i in np.unique(np.searchsorted(words.first, np.flatnonzero(scores > 0), side="right") - 1).tolist():
                    own = scores[words.first[i] : words.first[i + 1]]
                    found = segments(own)
                    evidence[i] = beyond_chance(np.array([s for _, _, s in found]), len(own), model)
                    expected = [model.rate * len(own) * np.exp(-model.decay * s) for _, _, s in found]
                    passages[i] = [{"start": a, "length": n, "score": s, "expected": float(e)} for (a, n, s), e in zip(found, expected, strict=True) if e < 1]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(words.counts), pa.array(evidence), pa.array(passages, _PASSAGE)], names=["k", "n_words", "evidence", "passages"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCORED)
    score = 1 / (1 + F.exp(-(F.lit(model.bias) + F.lit(model.slope) * F.log1p("evidence"))))
    return rows.select(id_of(F.col("k")).alias(id_col), "n_words", score.alias("score"), "evidence", "passages")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents with all their columns, without those whose score (see toxic_passages) is ``limit`` or more.

    Rows pass through one by one, so nothing is shuffled: null and empty texts get
    the score of no evidence, repeated rows and null ids are rows like others, and
    no other column is read.
    """
    batch_texts(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in tokens.slices(batch, text_col):
                words, units = unit_hashes(part.column(text_col).cast(pa.string()))
                scores = word_scores(units, model)
                keep = np.full(part.num_rows, model.probability(0.0) < limit)
                for i in np.unique(np.searchsorted(words.first, np.flatnonzero(scores > 0), side="right") - 1).tolist():
                    own = scores[words.first[i] : words.first[i + 1]]
                    keep[i] = model.probability(beyond_chance(np.array([s for _, _, s in segments(own)]), len(own), model)) < limit
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
