"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w . x - threshold_k): all thresholds share the weights ``w``; thresholds ascend. Features are words and
word beginnings of a vocabulary; one that occurs c times among the n words of a whole text has the value c / (c + 1 + n / 500).
Vocabulary, weights and thresholds are fitted on a bounded sample of labelled texts with an L1 penalty, so features that only
look toxic by chance get no weight, and then once more without it. The expected severity is the sum over k of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

U = np.uint64
#: Labelled texts of each grade that the model is fitted on (about), words in the vocabulary, texts that must hold a word.
SAMPLE = 1500
VOCABULARY = 4096
LEAST_TEXTS = 4
#: Training steps and penalty of a weight.
STEPS = 400
LASSO = 1e-3
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
RIDGE = 1e-4
SIEVE = 1 << 16


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of each word and of each beginning of ``BEGINNINGS`` bytes that a longer word has, and each row's words."""
    hashes, offsets = tk.words(data, at, tk.LETTERS)
    row = tk.rows_of(offsets)
    buf = data[at[0] : at[-1]]
    starts = tk.word_starts(buf, at - at[0], tk.LETTERS)
    sums, salts, alive = np.zeros(len(starts), U), tk.seeded(BEGINNINGS[-1] + 1, 71) | U(1), np.ones(len(starts), bool)
    parts, rows = [hashes], [row]
    owned = (at - at[0])[row + 1] if len(row) else at[:0]
    for j in range(BEGINNINGS[-1] + 1):
        place = starts + j
        value = tk.LETTERS.value[buf[np.minimum(place, len(buf) - 1)]] if len(buf) else sums
        alive = alive & (place < owned) & (value != 0)
        if j in BEGINNINGS:
            parts.append(tk.mix(sums[alive] + U(j)))
            rows.append(row[alive])
        with np.errstate(over="ignore"):
            sums = sums + value * salts[j]
    return np.concatenate(parts), np.concatenate(rows), np.diff(offsets)


def value(count: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return count / (count + 1.0 + n_words / 500.0)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = tk.bytes_of(batch.column(1))
        for lo, hi in tk.chunks(at):
            hashes, row, n = features(data, at[lo : hi + 1])
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])) if len(row) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(row)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=hi - lo))])
            whole = pa.array(tk.sequences(hashes[new], ends).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), tk.listed(hashes[new], ends), tk.listed(counts.astype(np.int64), ends), pa.array(n), whole], names=["grade", "words", "counts", "n", "whole"])


class Ordinal:
    """Vocabulary (sorted hashes), shared weights and ascending thresholds."""

    def __init__(self, every: np.ndarray, counts: np.ndarray, offsets: np.ndarray, n_words: np.ndarray, grades: np.ndarray, top: int) -> None:
        owner = tk.rows_of(offsets)
        words, index = np.unique(every, return_inverse=True)
        toxic = grades[owner] > 0
        n1, n0 = max(int((grades > 0).sum()), 1), max(int((grades == 0).sum()), 1)
        in1, in0 = np.bincount(index[toxic], minlength=len(words)), np.bincount(index[~toxic], minlength=len(words))
        p1, p0 = in1 / n1, in0 / n0
        pooled = (in1 + in0) / (n1 + n0)
        z = np.abs(p1 - p0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n1 + 1 / n0))
        z[in1 + in0 < LEAST_TEXTS] = 0
        chosen = np.sort(np.argsort(-z, kind="stable")[:VOCABULARY])
        chosen = chosen[z[chosen] > 0]
        self.words = words[chosen]
        place = np.full(len(words), -1)
        place[chosen] = np.arange(len(chosen))
        x = np.zeros((len(grades), len(chosen)), np.float32)
        hit = place[index] >= 0
        x[owner[hit], place[index[hit]]] = value(counts[hit], n_words[owner[hit]])
        self._fit(x, grades, top, LASSO, 0.0)
        keep = self.weights != 0
        self.words = self.words[keep]
        self._fit(x[:, keep], grades, top, 0.0, RIDGE)
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.words & U(SIEVE - 1)).astype(np.int64)] = True

    def _fit(self, x: np.ndarray, grades: np.ndarray, top: int, lasso: float, ridge: float) -> None:
        """Proximal gradient steps with momentum; thresholds are a first one and gaps of at least 0.1."""
        above = (grades[:, None] > np.arange(top)[None, :]).astype(np.float32)
        share = np.full(len(grades), 1.0 / max(len(grades), 1), np.float32)
        w, first, gaps = np.zeros(x.shape[1], np.float32), 1.0, np.full(top - 1, 1.0)
        last, ahead, t = w, w, 1.0
        rate = 4.0 / max(float((x * x).sum(1).mean()) if len(x) else 1.0, 1.0) * 4
        for _ in range(STEPS):
            thresholds = first + np.concatenate([[0.0], np.cumsum(gaps)])
            p = 1 / (1 + np.exp(-np.clip((x @ ahead)[:, None] - thresholds, -30, 30)))
            pull = (p - above) * share[:, None]
            step = ahead - rate * (x.T @ pull.sum(1).astype(np.float32) + ridge * ahead)
            w, last = np.sign(step) * np.maximum(np.abs(step) - rate * lasso, 0), w
            first += 2.0 * float(pull.sum())
            gaps = np.maximum(gaps + 2.0 * np.array([pull[:, k + 1 :].sum() for k in range(top - 1)]), 0.1)
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead = w + np.float32((before - 1) / t) * (w - last)
        self.weights, self.thresholds = w.astype(np.float64), first + np.concatenate([[0.0], np.cumsum(gaps)])

    def above(self, hashes: np.ndarray, row: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold k."""
        score = np.zeros(len(n_words))
        maybe = np.flatnonzero(self.sieve[(hashes & U(SIEVE - 1)).astype(np.int64)])
        if len(maybe) and len(self.words):
            spot = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
            hit = self.words[spot] == hashes[maybe]
            which, count = np.unique(row[maybe][hit] * len(self.words) + spot[hit], return_counts=True)
            of = which // len(self.words)
            score += np.bincount(of, self.weights[which % len(self.words)] * value(count, n_words[of]), minlength=len(score))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))


def sampled(marks: DataFrame, top: int, sample: int) -> DataFrame:
    """About ``sample`` of ``marks(doc_id, grade)`` of each grade, three times as many of grade 0, by a hash of their id; the bound is hard at twice that."""
    counts = {r["grade"]: r["n"] for r in marks.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    rate = F.lit(0.0)
    for grade, n in counts.items():
        rate = F.when(F.col("grade") == grade, min(1.0, sample * (3 if grade == 0 else 1) / n)).otherwise(rate)
    return marks.where(chance < rate).orderBy(F.xxhash64("doc_id"), "grade").limit(6 * sample * (top + 1))


def fit(labelled: DataFrame, top: int) -> Ordinal | None:
    """A model from a bounded sample ``labelled(text, grade)`` with grades 0 to ``top``; None unless two grades occur. Only features reach the driver."""
    rows = labelled.select("grade", "text").mapInArrow(_words_of, "grade int, words array<long>, counts array<long>, n long, whole long").toArrow()
    grades = rows.column("grade").to_numpy()
    if len(set(grades.tolist())) < 2:
        return None
    words, counts = (rows.column(name).combine_chunks() for name in ("words", "counts"))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
    # The same rows in any order give the same model.
    order = np.lexsort((rows.column("whole").to_numpy().view(U), grades))
    words, counts = (c.take(pa.array(order)) for c in (words, counts))
    ends = np.concatenate([[0], np.cumsum(np.diff(ends)[order])])
    return Ordinal(words.flatten().to_numpy().view(U), counts.flatten().to_numpy(), ends, rows.column("n").to_numpy()[order], grades[order], top)


def _scored(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tk.bytes_of(batch.column(1))
            for lo, hi in tk.chunks(at):
                p = model.above(*features(data, at[lo : hi + 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32))], names=["doc_id", "severity", "grade"])

    return run


def grade_of(toxic: str = "toxic", quality: str = "quality") -> Column:
    """Severity grade of a label: 0 clean, 1 toxic, 2 toxic and of low quality."""
    return F.when(F.col(toxic) == 0, 0).when(F.col(toxic) == 1, F.when(F.col(quality) == 0, 2).otherwise(1)).cast("int")


def score_toxicity(docs: DataFrame, labels: DataFrame, grade: Column | None = None, top: int = 2, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, severity (0 to ``top``), grade (most thresholds passed), toxic.

    Labels without an id or grade are ignored; a document with several labels counts once for each. Null and empty texts
    have no features and get the severity of a text without any telling word. Null ids are scored like others but never
    learned from. Texts of any length are read whole; a text on a threshold has passed it; repeated rows get equal results. Without labels of two grades nothing can be learned: severity and grade are null and toxic is null. Other
    columns are ignored; empty tables give no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(label_id).cast("long").alias("doc_id"), (grade if grade is not None else grade_of()).alias("grade")).where("doc_id is not null and grade is not null")
    chosen = sampled(marks, top, sample)
    labelled = source.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "grade")
    model = fit(labelled, top)
    if model is None:
        return source.select("doc_id", F.lit(None).cast("double").alias("severity"), F.lit(None).cast("int").alias("grade"), F.lit(None).cast("boolean").alias("toxic"))
    out = source.mapInArrow(_scored(model), "doc_id long, severity double, grade int")
    return out.withColumn("toxic", F.col("grade") >= 1)
