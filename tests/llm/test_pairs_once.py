"""Line deduplication makes each key and each pair once, and finds the wanted lines without moving texts."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from focalframe.llm import line_dedup, links


def test_short_lines_are_keyed_by_runs_of_one_length():
    table = line_dedup.run_table(line_dedup.SHORT, 0.8)
    assert all(table[n].sum() == 1 for n in range(6, line_dedup.SHORT))
    words = np.arange(1, 11, dtype=np.uint64) << np.uint64(40)
    keys = [k for _, k in line_dedup.run_keys(words, np.array([0, 10]), 0.8, np.zeros(0, np.uint64), table)]
    assert sum(map(len, keys)) == 8


def test_picked_keys_do_not_depend_on_the_lines_beside():
    words = np.random.default_rng(2).integers(0, 1 << 63, 30 * 700, dtype=np.uint64)
    at, none, table = np.arange(0, len(words) + 1, 30), np.zeros(0, np.uint64), line_dedup.run_table(line_dedup.SHORT, 0.8)
    *_, (rows, keys) = line_dedup.run_keys(words, at, 0.8, none, table)
    assert (np.bincount(rows) == line_dedup.PICKED).all()
    for i in (0, 350, 699):
        *_, (_, alone) = line_dedup.run_keys(words[at[i] : at[i + 1]], np.array([0, 30]), 0.8, none, table)
        assert set(alone.tolist()) == set(keys[rows == i].tolist())


def test_filter_loses_no_wanted_class_and_passes_few_others(spark):
    ids = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 200_000)
    found = line_dedup.id_filter(spark.createDataFrame([(int(x),) for x in ids[:100_000]], "id long"))
    place = (ids.view(np.uint64) >> np.uint64(64 - (len(found) * 8).bit_length() + 1)).astype(np.int64)
    passed = np.unpackbits(found)[place] == 1
    assert len(found) * 8 > line_dedup.FILTER_PART and passed[:100_000].all() and passed[100_000:].mean() < 0.1


def test_a_pair_that_shares_several_keys_is_made_once(spark):
    keys = {i: [k for k in (1, 2, 3, 4) if (i + k) % 4] for i in range(12)}
    rows = [(k, i, keys[i] if i else None, i % 5, 1 + i % 2, 7 + i % 3) for i in keys for k in keys[i]]
    members = spark.createDataFrame(rows, "key long, id long, keys array<long>, c long, parts int, band int").withColumn("parts", F.lit(2))
    got = [tuple(r) for r in links.meetings(members, lambda x, y: F.lit(True)).collect()]
    want = {(a, b) for a, b in itertools.combinations(keys, 2) if a % 5 != b % 5 and abs(a % 3 - b % 3) < 2 and set(keys[a]) & set(keys[b])}
    assert set(got) == want and all(got.count(p) == 1 for p in want if p[0])
    assert {tuple(r) for r in links.across(members, lambda x, y: F.lit(True)).collect()} == want
