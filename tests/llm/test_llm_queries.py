"""Every query with an oracle against it, and the contracts of the others, on the smallest tables."""

import pytest
from conftest import DATA, plain

from focalframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_mixing_meets_its_targets(spark):
    r = queries.op4_source_mixing(spark, DATA).toPandas()
    by = r.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 0.05 * by.target + 64).all()
    assert (r.taken <= 3 * r["size"]).all() and abs(by.target.sum() - r["size"].sum()) < 1e-6 * r["size"].sum()


def test_language_accuracy(spark):
    r = queries.op9_language_id(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    m = r.merge(docs, on="doc_id")
    assert (m[m.held_out].lang == m[m.held_out].lang_pred).mean() > 0.97 and r.score.between(0, 1).all()


def test_toxicity_on_labels_held_out(spark):
    from focalframe.llm.toxicity import score_toxicity

    data = DATA.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    r = score_toxicity(docs, labels.where("doc_id % 3 <> 0")).toPandas().merge(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "y").toPandas(), on="doc_id")
    assert r[r.y == 1].toxic.mean() > 0.75 and r[r.y == 0].toxic.mean() < 0.01
    assert r[r.y == 1].severity.mean() > 5 * r[r.y == 0].severity.mean()
