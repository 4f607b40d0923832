"""The stages, each on its predecessor's rows, against what brute force says of it."""

from conftest import DATA
from test_edges import brute_components

import corpus_pipeline as pipeline
from focalframe.llm.common import table, written


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_join", "benchmark_decontamination", "source_mixing"]
    rows = {}
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, DATA), name)
        rows[name] = out.toPandas()
        if name != "source_mixing":
            assert out.columns == columns
            assert set(rows[name].doc_id) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "ngram_join":
            before = docs.orderBy("doc_id").collect()
            keep = {before[i]["doc_id"] for i, _, c in brute_components([r["text"] for r in before], 5, 80) if c == i}
            assert set(rows[name].doc_id) == keep
        docs = out
    assert (rows["line_dedup"].text.str.len() == rows["line_dedup"].n_chars).all()
    assert len(rows["source_mixing"]) == len(rows["benchmark_decontamination"])
    again = pipeline.run(spark, DATA).toPandas()
    assert sorted(map(repr, again.values.tolist())) == sorted(map(repr, rows["source_mixing"].values.tolist()))


def test_empty_and_null_rows_pass_through_all_stages(spark, tmp_path):
    text = "the same few words are said here again and again by all"
    long = " ".join(f"word{i * i % 7919} of the very long text" for i in range(20_000))
    rows = [(1, text, "en", "s", 3), (2, None, "en", None, None), (3, "", None, "s", 0), (None, text + " more", "en", "s", 5), (1, text, "en", "s", 3), (4, long, "en", "s", len(long))]
    rows = [(*r, "clash", 7, "x", 1.0) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, class_id string, size int, component_id string, n_removed double"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, DATA), "edge")
        assert docs.count() <= len(data)
