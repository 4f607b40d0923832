"""Operators against brute force that knows nothing of how they find their candidates."""

import collections
import itertools
import random

import pyarrow as pa
from test_edges import edited, levenshtein, norm, sentence

from focalframe.llm import decontam, langid, line_dedup, mixing, textkernel, url_filter


def groups_by_edit_distance(lines):
    group = list(range(len(lines)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(range(len(lines)), 2):
        x, y = lines[a], lines[b]
        if x == y or 5 * abs(len(x) - len(y)) <= max(len(x), len(y)) and 5 * levenshtein(x, y) <= max(len(x), len(y)):
            p, q = sorted((find(a), find(b)))
            group[q] = p
    return [find(i) for i in range(len(lines))]


def test_line_dedup_finds_all_lines_of_the_edit_similarity(spark):
    rnd = random.Random(8)
    texts = []
    for n in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 19, 20, 25, 40, 60):
        for _ in range(3):
            base = sentence(rnd, n)
            texts.append(base)
            for share in (1, n // 5, n // 5 + 1):
                words = edited(rnd, base, share).split()
                at = rnd.randrange(n)
                texts.append(" ".join(words))
                texts.append(" ".join([*base.split()[:at], "more", *base.split()[at:]]))
                texts.append(" ".join(words[:at] + words[at + 1 :]))
    evenly = sentence(rnd, 20).split()
    texts.append(" ".join(evenly))
    evenly[3::5] = ["other"] * 4
    texts.append(" ".join(evenly))
    texts = [t for t in dict.fromkeys(texts) if len(t.split()) >= 3]
    assert {len(t.split()) for t in texts} >= {3, 4, 5, 6}
    want = groups_by_edit_distance([norm(t) for t in texts])
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [int(g != i) for i, g in enumerate(want)]
    assert sum(got.values()) > 150


def test_lines_of_four_words_are_similar_to_five(spark):
    docs = [(1, "please read the terms"), (2, "please read the terms now"), (3, "please read these terms"), (4, "read the terms"), (5, "quite another short line"), (6, "quite another short line"), (7, "please read the terms")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1}
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df, short_copies=True).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1}


def test_kernels_run_where_the_package_is_not(tmp_path):
    """Every kernel is pickled as tasks are and loaded by a process that cannot import the package."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from focalframe.llm import conversation, html_extract, langid, links, ngram_join, topk, toxicity, warc
    from focalframe.operators import dense, projects, register

    step, walk, ending = conversation.tables()
    kernels = [
        line_dedup._lines(5), line_dedup._keyed(4, 0.8, 3, __import__("numpy").zeros(0, "u8")), line_dedup._line_words, line_dedup._similar(0.8, 5), line_dedup._marks_near(0.8), links._grouped(3, line_dedup._marks_near(0.8)),
        conversation._cut(9, 9, conversation.KINDS), conversation._edit(step, walk, ending), conversation._summed(step), conversation._walked(step, walk), conversation._chained, conversation._hashed,
        html_extract._learn, html_extract._extract, toxicity._words_of, register._band_sums("affine", 6), dense.phase_shift,
    ]
    assert langid and ngram_join and topk and warc and projects
    (tmp_path / "kernels").write_bytes(cloudpickle.dumps(kernels))
    import importlib.util

    where = [os.path.dirname(os.path.dirname(importlib.util.find_spec(m).origin)) for m in ("pyspark", "numpy", "pyarrow")]
    code = f"import pickle, sys; sys.path[:] = [p for p in sys.path if p and 'repo' not in p] + {where!r}; n = len(pickle.load(open({str(tmp_path / 'kernels')!r}, 'rb'))); import importlib.util; assert importlib.util.find_spec('focalframe') is None; print(n)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, check=False)
    assert out.stdout.strip() == str(len(kernels)), out.stderr[-800:]


def test_line_dedup_takes_copies_of_short_lines(spark):
    docs = [(1, "Contact us\n\n---\nread more"), (2, "contact us!\n\n---\nnothing else"), (3, "contact them\nread  more")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), short_copies=True).collect()}
    assert got == {1: docs[0][1], 2: "\n---\nnothing else", 3: "contact them"}


def test_line_dedup_splits_scripts_without_spaces(spark):
    docs = [(1, "今天的天气非常好，我们去公园散步吧。"), (2, "今天的天气非常好，我们去公园走路吧！"), (3, "昨日は雨が降っていたので家にいました。"), (4, "昨日は雨が降っていたので家にいました"), (5, "abc今天 déjà vu"), (6, "完全不同的另外一句话在这里出现了")]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}
    hashes, at = textkernel.words(*textkernel.bytes_of(pa.array(["abc今天x，y", "ABC 今 天 x y", "𠀀𠀁"])), textkernel.LINES)
    assert at.tolist() == [0, 5, 10, 12] and hashes[:5].tolist() == hashes[5:10].tolist()


def test_shards_of_the_mix_are_drawn(spark):
    sources = spark.createDataFrame([(1, 30_000, 70_000), (2, 20_000, 30_000)], "sid long, blocks long, slots long").selectExpr("*", "(sid - 1) * 70000L AS first_slot", "100000L AS n_slots")
    counts = mixing.shard_counts(mixing.mixture_slots(sources, shard=100)).toPandas()
    ones = counts[counts.sid == 1].n
    assert counts.n.sum() == 100_000 and ones.sum() == 70_000 and len(ones) == 1000
    assert 18 < ones.var() < 24  # 100 * 0.7 * 0.3 = 21


def test_mix_holds_the_words_of_its_blocks(spark):
    docs = [(i, " ".join(f"{s}{i}.{j}" for j in range(n)), s) for s, sizes in (("a", (150, 3, 70)), ("b", (200, 0, 31))) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix, taken = mixing.mixture(df).toPandas(), mixing.mix_sources(df).toPandas()
    assert sorted(mix.place) == list(range(len(mix))) and set(mix.shard) == {0}
    streams = {s: " ".join(t for _, t, source in docs if source == s and t).split() for s in "ab"}
    for r in mix.itertuples():
        assert r.text.split() == streams[r.source][64 * r.block : 64 * (r.block + 1)]
    for r in taken.itertuples():
        assert r.taken == sum(w.startswith(f"{r.source}{r.doc_id}.") for t in mix.text for w in t.split())


def test_bad_sections_of_a_broad_host_are_judged_apart(spark):
    for n, prefix in ((3, "/"), (40, "/"), (3, "/a/b/c/d/e/"), (40, "/a/b/c/d/e/")):
        pages = [(100 * s + i, f"http://host.test{prefix}s{s}/p{s}.{i}") for s in range(n) for i in range(100)]
        labels = [(p, int(p < 100)) for p, _ in pages]
        got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"))
        assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == set(range(100))


def test_every_language_is_learned(spark):
    rows = [(f"{n}.{i}", f"x{n}y z{n}w " * 5, f"l{n:03}") for n in range(270) for i in range(2)]
    assert langid.fit(spark.createDataFrame(rows, "key string, text string, lang string")).names == [f"l{n:03}" for n in range(270)]


def windows_by_brute_force(texts, items, k=5, similarity=0.8):
    """Every (document, item) with a window, laid at any word, of weighted Jaccard similarity ``similarity``, and its best one."""
    found = {}
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            a, b = text.lower().split(), item.lower().split()
            if not a or not b:
                continue
            n = min(k, len(b))
            bag = lambda w: collections.Counter(tuple(w[p : p + n]) for p in range(len(w) - n + 1))
            want, best = bag(b), (0, 0)
            for p in range(max(1, len(a) - len(b) + 1)):
                have = bag(a[p : p + len(b)])
                both = sum((have & want).values())
                best = max(best, (both / max(sum(have.values()) + sum(want.values()) - both, 1), -p))
            if best[0] >= similarity:
                found[i, j] = (round(best[0], 9), -best[1])
    return found


def test_decontamination_against_all_windows(spark):
    rnd = random.Random(5)
    items = [sentence(rnd, n) for n in (2, 4, 6, 20, 20, 50, 100, 100)] + ["same " * 30]
    texts = []
    for item in items:
        w, noise = item.split(), lambda: sentence(rnd, 40).split()
        half = len(w) // 2
        texts += [noise() + w + noise(), noise() + w[half:] + w[:half] + noise(), w[: -max(1, len(w) // 10)], noise() + w[: half] + ["x"] + w[half:] + noise(), noise() + w[3:] + noise() + w]
        for share in (25, 12, 6):
            near = list(w)
            near[share // 2 :: share] = ["other"] * len(near[share // 2 :: share])
            texts.append(noise() + near + noise())
    texts = [" ".join(t) for t in texts] + ["same " * 300, "", sentence(rnd, 3000) + " " + items[6] + " " + sentence(rnd, 3000)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start_word"]) for r in decontam.contaminated(docs, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    want = windows_by_brute_force(texts, items)
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) >= 40
    assert sum(got[x] == want[x] for x in got) >= 0.97 * len(got)
    assert (8 * 6 + 1, 6) in got and got[8 * 6 + 1, 6][0] > 0.9
