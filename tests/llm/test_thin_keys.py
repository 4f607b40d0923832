"""The n-gram join moves as much for each key however many buckets there are, and makes the sets of those texts only that its sketches cannot part."""

import itertools
import random

import numpy as np
import pyarrow as pa
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from focalframe.llm import common, line_dedup, ngram_join
from focalframe.llm.common import table


def texts(n, words, passage="", seed=0):
    rnd = random.Random(seed)
    return [" ".join(f"w{rnd.randrange(1 << 30)}" for _ in range(words)) + passage for _ in range(n)]


def test_bytes_of_a_key_do_not_grow_with_the_buckets():
    batch = pa.RecordBatch.from_arrays([pa.array(texts(600, 120))], names=["text"])

    def sent(buckets):
        return sum(c.nbytes for b in ngram_join._keyed(5, 80, buckets)(iter([batch])) for c in b.columns if pa.types.is_binary(c.type))

    assert sent(48) < 1.1 * sent(6)


def tables_made(monkeypatch, *modules):
    made = []

    def noted(df, what):
        out = common.written(df, what)
        made.append((what, out.count()))
        return out

    for m in modules:
        monkeypatch.setattr(m, "written", noted)
    return made


def test_long_texts_around_one_passage_are_parted_by_their_sketches(spark, monkeypatch):
    made = tables_made(monkeypatch, ngram_join)
    passage = " " + " ".join(f"said{i}" for i in range(40))
    docs = [(i, t) for i, t in enumerate(texts(60, 2500, passage) + texts(1, 1200, passage, 1))]
    docs += [(100, docs[3][1] + " one more"), (101, None)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: 3 if i == 100 else i for i, _ in docs}
    assert [n for what, n in made if what == "sets"] == [2]


def test_wide_sketches_bound_the_difference():
    rnd = np.random.default_rng(0)
    for n, m in itertools.product((300, 700, 1100, 3000), (0, 100, 900)):
        a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rnd.integers(n // 2, n)], rnd.integers(0, 1 << 62, m).astype(np.uint64)]))
        both, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        wide, fixed = ngram_join.wide_sketches(both, at), ngram_join.fixed_sketches(both, at)
        for k, size in enumerate((len(a), len(b))):
            assert wide[k].is_valid == (size > 512)
        folded = [np.bitwise_xor.reduce(np.frombuffer(w.as_py(), np.uint64).reshape(-1, 8), axis=0) if w.is_valid else f for w, f in zip(wide, fixed)]
        assert (np.array(folded) == fixed).all()
        if all(w.is_valid for w in wide):
            x, y = (np.frombuffer(w.as_py(), np.uint64) for w in wide)
            x, y = (np.bitwise_xor.reduce(z.reshape(-1, min(len(x), len(y))), axis=0) for z in (x, y))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_stages_leave_only_tables_that_their_results_read(spark):
    docs = table(spark, DATA, "documents")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.ngram_join):
        before = len(common._WRITTEN)
        out = stage(spark, docs, DATA)
        assert len(common._WRITTEN) - before <= 2
        assert out.count() and out.where(F.length("text") > 0).count()
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
