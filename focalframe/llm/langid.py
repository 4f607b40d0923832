"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a logistic classifier over hashed character n-grams (orders 1 to 3, square roots of
counts, unit length) is fitted on a bounded sample of labelled texts. Decoding sums, over the bits, the logistic loss
against each codeword, weighted by how well the bit's classifier separates the sample; the language of least loss wins.
The score is its share of exp(-loss). A decision is ambiguous when the runner-up comes close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

U = np.uint64
#: Buckets of hashed n-grams, texts per language that the classifiers are fitted on (about); with more than ``MANY`` languages fewer
#: of each, but ``LEAST``.
BUCKETS = 1 << 13
SAMPLE = 300
MANY = 16
LEAST = 30
#: Rows in a block of features, training steps, penalty, and the score under which a decision counts as ambiguous.
ROWS = 128
STEPS = 150
RIDGE = 1e-4
AMBIGUOUS = 0.5


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fold = np.full(256, 32, np.uint8)
    for a, b in ((97, 123), (128, 256)):
        fold[a:b] = np.arange(a, b)
    fold[65:91] = np.arange(97, 123)
    ones, twos = ((tk.seeded(n, seed) % U(BUCKETS)).astype(np.int32) for n, seed in ((256, 3), (65536, 7)))
    return fold, ones, twos


FOLD, ONES, TWOS = _tables()


def ngram_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of hashed n-gram counts, for the rows between the offsets ``at``."""
    rows = len(at) - 1
    buf, row = FOLD[data[at[0] : at[-1]]], np.repeat(np.arange(rows), np.diff(at)) * BUCKETS
    counts = np.zeros(rows * BUCKETS, np.int64)
    if len(buf):
        counts += np.bincount((row + ONES[buf])[buf != 32], minlength=len(counts))
    if len(buf) > 1:
        pair = buf[:-1].astype(np.uint32) << 8 | buf[1:]
        same = row[:-1] == row[1:]
        counts += np.bincount((row[:-1] + TWOS[pair])[same & (pair != 0x2020)], minlength=len(counts))
    if len(buf) > 2:
        three = ((pair[:-1] << 8 | buf[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 13)
        same = (row[:-2] == row[2:]) & (buf[1:-1] != 32)
        counts += np.bincount((row[:-2] + three)[same], minlength=len(counts))
    x = np.sqrt(counts.reshape(rows, BUCKETS).astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """Rows of +1 and -1 for ``n`` classes: the exhaustive code up to five classes, else the best of 64 random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = np.arange(1, 1 << (n - 1))
        return np.where((bits[None, :] >> np.arange(n)[:, None]) & 1, -1.0, 1.0)
    random, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(64):
        code = random.choice([-1.0, 1.0], (n, length))
        apart = int(((length - code @ code.T) / 2 + length * np.eye(n)).min())
        if apart > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart
    return best


class Model:
    """Languages, codewords, and the classifiers' weights."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray) -> None:
        self.names, self.code = names, codewords(len(names))
        target = self.code[y]
        share = (1.0 / (len(names) * np.bincount(y, minlength=len(names))[y]))[:, None]
        w, b = np.zeros((BUCKETS, target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
        last, ahead, t = w, w, 1.0
        for _ in range(STEPS):
            pull = (-share * target / (1 + np.exp(np.clip(target * (x @ ahead + b), -30, 30)))).astype(np.float32)
            w, last = ahead - 8.0 * (x.T @ pull + RIDGE * ahead), w
            b = b - 2.0 * pull.sum(0)
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead = w + np.float32((before - 1) / t) * (w - last)
        self.w, self.b = w, b
        right = ((target * (x @ w + b) > 0) * share).sum(0) if len(x) else np.ones(target.shape[1])
        self.trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
        self.trust = self.trust / max(self.trust.mean(), 1e-9)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and whether the decision is ambiguous, for each row of features."""
        margin = x @ self.w + self.b
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        return best, score, score < AMBIGUOUS


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = tk.bytes_of(column)
    for lo, hi in tk.chunks(at):
        for i in range(lo, hi, ROWS):
            j = min(i + ROWS, hi)
            yield i, j, data, at[i : j + 1]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in _blocks(batch.column(1)):
            vectors = pa.array([x.tobytes() for x in ngram_features(data, at).astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), vectors], names=["lang", "x"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from ``labelled(key, text, lang)``; None without any row.

    About ``sample`` texts of each language are taken by a hash of their key, so the same rows give the same model; every
    language is learned, with more than ``MANY`` of them each from fewer texts.
    """
    langs = sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not langs:
        return None
    sample = min(sample, max(LEAST, sample * MANY // len(langs)))
    rates = labelled.sparkSession.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in langs], "lang string, rate double")
    chance = (F.pmod(F.xxhash64("key"), F.lit(1_000_003)) / 1_000_003.0)
    chosen = labelled.join(F.broadcast(rates), "lang").where(chance < F.col("rate")).orderBy(F.xxhash64("key"), "text").limit(2 * sample * len(langs))
    rows = chosen.select("lang", "text").mapInArrow(_featured, "lang string, x binary").collect()
    if not rows:
        return None
    names = sorted({r["lang"] for r in rows})
    y, x = np.array([names.index(r["lang"]) for r in rows]), np.empty((len(rows), BUCKETS), np.float32)
    for i in range(len(rows)):
        x[i] = np.frombuffer(rows[i]["x"], np.float16)
        rows[i] = None
    return Model(names, x, y)


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.names)
        for batch in batches:
            best, score, unsure = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
            for _, _, data, at in _blocks(batch.column(batch.schema.get_field_index("__text"))):
                for out, part in zip((best, score, unsure), model.decode(ngram_features(data, at))):
                    out.append(part)
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "__text"]
            kept = [name for name in batch.schema.names if name != "__text"]
            made = [names.take(pa.array(np.concatenate(best))), pa.array(np.concatenate(score).astype(np.float64)), pa.array(np.concatenate(unsure))]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, "__lang", "__score", "__unsure"])

    return run


def has_letter(text: str):
    return F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and ambiguous added or replaced.

    Learns from rows with a label and a letter whose crc32 of the id (as text) modulo 4 is not 2. ``lang_pred`` is ``und``
    with score 0, and ambiguous, where the text is null or has no letter, and everywhere when there is nothing to learn
    from. A null id is never learned from and not held out. Repeated rows get equal results; of languages with equal loss the first by name
    wins. Texts of any length are read whole. Empty tables stay empty.
    """
    held = F.crc32(F.col(id_col).cast("string")) % 4 == 2
    learned = docs.where(~held & F.col(lang_col).isNotNull() & has_letter(text_col))
    model = fit(learned.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), sample)
    made = ("held_out", "lang_pred", "score", "ambiguous")
    kept = [c for c in docs.columns if c.lower() not in made]
    out = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(held, F.lit(False)).alias("held_out"), has_letter(text_col).alias("__letters"), F.col(text_col).cast("string").alias("__text"))
    if model is None:
        out = out.withColumns({"__lang": F.lit("und"), "__score": F.lit(0.0), "__unsure": F.lit(True)}).drop("__text")
    else:
        schema = out.drop("__text").schema
        for name, kind in (("__lang", "string"), ("__score", "double"), ("__unsure", "boolean")):
            schema = schema.add(name, kind)
        out = out.mapInArrow(_predicted(model), schema)
    known = F.col("__letters")
    return out.select(*(F.col(f"`{c}`") for c in kept), "held_out", F.when(known, F.col("__lang")).otherwise("und").alias("lang_pred"), F.when(known, F.col("__score")).otherwise(0.0).alias("score"), F.when(known, F.col("__unsure")).otherwise(True).alias("ambiguous"))
