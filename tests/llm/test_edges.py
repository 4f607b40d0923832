"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force where there is one."""

import hashlib
import itertools
import pickle
import random
import re

import numpy as np
import pytest
from pyspark import cloudpickle

from focalframe.llm import decontam, html_extract, langid, line_dedup, links, mixing, ngram_join, textkernel, topk, toxicity, url_filter, warc

WORDS = [f"w{i}" for i in range(400)]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(rnd, text, n):
    words = text.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return " ".join(words)


def corpus(seed=1):
    rnd = random.Random(seed)
    docs = [sentence(rnd, rnd.choice([3, 8, 20, 60, 150])) for _ in range(60)]
    docs += [edited(rnd, docs[i], k) for i in range(20) for k in (1, 3)] + docs[:5] + [" \t\n ", "", None, "one", "one", "One two", "one two"]
    docs.append(" ".join(WORDS * 60))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(docs)], "doc_id long, text string, component_id string, key double")


def brute_components(docs, k, percent):
    sets = []
    for t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    comp = list(range(len(docs)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            comp[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 50)])
def test_ngram_join_against_brute_force(spark, k, percent):
    docs = corpus(k)
    got = ngram_join.ngram_jaccard_join(frame(spark, docs), k, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(docs, k, percent)


def test_ngram_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_jaccard_join(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(rows).collect()), key=repr)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=repr)


def test_parity_sketch_bounds_the_difference():
    rnd = np.random.default_rng(0)
    for _ in range(20):
        a = np.unique(rnd.integers(0, 1 << 62, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rnd.integers(100, 300)], rnd.integers(0, 1 << 62, 50).astype(np.uint64)]))
        s = ngram_join.fixed_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert sum(int(x).bit_count() for x in s[0] ^ s[1]) <= len(np.setxor1d(a, b))


def test_bands_cover_all_links():
    for percent in (50, 80, 90):
        bands = ngram_join.Bands(percent)
        bands.upto(400)
        for a in range(1, 200):
            for b in range(a, 100 * a // percent + 1):
                i, j = (int(x) for x in bands.of(np.array([a, b])))
                assert j - i <= 1 and bands.blocks[i] > (a + b) * (100 - percent) // (100 + percent)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in links.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert got == want


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    rnd = random.Random(2)
    for _ in range(200):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(90))]
        b = list(a) if rnd.random() < 0.5 else [rnd.randrange(4) for _ in range(rnd.randrange(20))]
        for _ in range(rnd.randrange(5)):
            if b:
                b[rnd.randrange(len(b))] = rnd.randrange(4)
        assert line_dedup.edit_distance(np.array(a), np.array(b)) == levenshtein(a, b)


def norm(line):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(4)
    base = [sentence(rnd, rnd.choice([2, 6, 30, 300])) for _ in range(40)]
    docs = ["\n".join(rnd.choice([b, b.upper() + "!", edited(rnd, b, 1) if len(b.split()) > 20 else b]) for b in rnd.sample(base, 5)) for _ in range(40)] + ["", None, "\n\n", "solo line of its own right here"]
    rows = [(i, t, len(t or ""), "keep", 5) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, n_removed string, fp int")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    lines = []
    for i, t in enumerate(docs):
        for j, line in enumerate((t or "").split("\n")):
            w = norm(line)
            if len(w) >= 5:
                lines.append((i, j, w))
    group = list(range(len(lines)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(range(len(lines)), 2):
        x, y = lines[a][2], lines[b][2]
        near = levenshtein(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9 if x != y else True
        if near:
            p, q = sorted((find(a), find(b)))
            group[q] = p
    drop = {(lines[i][0], lines[i][1]) for i in range(len(lines)) if find(i) != i}
    assert drop
    for i, t in enumerate(docs):
        want = None if t is None else "\n".join(line for j, line in enumerate(t.split("\n")) if (i, j) not in drop)
        assert got[i]["text"] == want and got[i]["fp"] == 5
        assert got[i]["n_removed"] == len([1 for d, _ in drop if d == i])
        assert got[i]["n_lines"] == (0 if t is None else len(t.split("\n")))
        if t is not None:
            assert got[i]["n_chars"] == len(want)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    line = "the very same line of six words"
    rows = spark.createDataFrame([(None, line), (1, line), (1, line), (2, line)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(rows).collect()) == [("1", line), ("1", line), ("2", ""), ("None", line)]


def test_decontamination(spark):
    rnd = random.Random(6)
    items = [sentence(rnd, n) for n in (3, 12, 40, 55)]
    near = items[2].split()
    near[20] = "changed"
    far = items[3].split()
    far[5::6] = ["x"] * len(far[5::6])
    docs = [sentence(rnd, 200), sentence(rnd, 50) + ". " + items[1].upper() + "! " + sentence(rnd, 30), " ".join(near[:-1]), "pre " + " ".join(far), items[0], None, "", sentence(rnd, 30) + " " + items[3] + " " + items[3], " ".join(near) + " end"]
    d = spark.createDataFrame([(i, t, 0, "q") for i, t in enumerate(docs)] + [(None, items[1], 0, "q")], "doc_id long, text string, item_id int, m string")
    b = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (None, "a b c d e f")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (4, 0), (7, 3)} | ({(8, 2)} & set(got)) | ({(2, 2)} & set(got))
    assert got[1, 1]["start_word"] == 50 and got[1, 1]["similarity"] == 1 and got[7, 3]["start_word"] == 30
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    a, c = set(shingles(items[2].split())), set(shingles(near))
    assert ((8, 2) in got) == (len(a & c) / len(a | c) >= 0.8)
    left = {r["doc_id"] for r in decontam.decontaminate(d, b).collect()}
    assert left == {0, 2, 3, 5, 6, 8, None} - {i for i, _ in got}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(d, none).count() == 0 and decontam.decontaminate(d, none).count() == len(docs) + 1
    assert decontam.contaminated(d.where("false"), b).count() == 0


def test_multi_index_blocks_find_the_whole_radius(spark):
    rnd = random.Random(1)
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        edge = [64 * i // (decontam.RADIUS + 1) for i in range(decontam.RADIUS + 2)]
        assert any((a >> lo) & ((1 << hi - lo) - 1) == (b >> lo) & ((1 << hi - lo) - 1) for lo, hi in zip(edge, edge[1:]))


def test_mixing_edges(spark):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, " ", None), (4, "d e", None), (None, "f", "t"), (4, "d e", None), (5, "x " * 500, "u")]
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, block int")
    r = mixing.mix_sources(df).toPandas()
    assert len(r) == len(rows) and (r.taken <= 3 * r["size"]).all() and r["size"].sum() == 508
    by = r.groupby("source", dropna=False).target.first()
    assert by["s"] == 9 and by["t"] == 3 and abs(by.sum() - 508) < 1e-9
    again = mixing.mix_sources(df).toPandas()
    assert sorted(map(repr, r.values.tolist())) == sorted(map(repr, again.values.tolist()))
    assert mixing.mix_sources(df.where("false")).count() == 0


def test_top_k_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    v = np.concatenate([rnd.integers(-9, 9, (400, 6)), np.zeros((20, 6), int), rnd.integers(-9, 9, (1, 6)).repeat(30, 0)])
    rows = [(i, [int(x) for x in r]) for i, r in enumerate(v)]
    vectors = spark.createDataFrame([*rows, (None, [1] * 6), (900, None), (901, [1, 2])], "vec_id long, v array<long>")
    queries = vectors.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "v AS q")
    for leaf in (8, 256):
        topk.LEAF = leaf
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors, queries).collect()}
        for q in range(0, len(v), 10):
            want = sorted(((-int(v[q] @ v[i]), i) for i in range(len(v)) if i != q))[:5]
            assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in want]
    assert topk.top_k(vectors.where("false"), queries).count() == 0
    few = topk.top_k(vectors.where("vec_id < 3"), queries.where("query_id = 0")).collect()
    assert len(few) == 2


def test_integer_vectors_leave_out_bad_rows(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, None), (3, [float("nan"), 0.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["v"]) for r in topk.integer_vectors(df).collect()] == [(1, [128, -1])]


def test_kd_tree_prunes():
    pts = np.random.default_rng(1).normal(size=(2000, 2))
    tree = topk.KDTree(np.arange(2000), pts, 16)
    q = np.array([[1.0, 0.5]])
    best = next(tree.search(q, np.array([-1]), 5, [None]))
    assert sorted(-i for _, i in best) == sorted(np.argsort(-(pts @ q[0]))[:5].tolist())


def test_url_rules(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/1", "http://x.example.net", "https://x.net/?q", "ftp://example.com/de/x#y", "http://a.org/fr/", "http://notnet/", "http://badexample.com/de/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(7, 1), (None, 1), (8, None)], "page_id long, bad int")
    r = {x["page_id"]: x for x in url_filter.judge_urls(pages, labels).collect()}
    assert [r[i]["rule"] for i in range(9)] == [None, None, "example.net/en/", None, "net/", "example.com/de/", "org/fr/", None, None]
    assert (r[0]["host"], r[0]["path"], r[2]["host"], r[4]["path"], r[5]["path"]) == ("", "", "a.example.net", "/", "/de/x")
    assert [r[i]["verdict"] for i in (2, 4, 5, 6)] == ["allow", "block", "block", "allow"]
    assert url_filter.judge_urls(pages.where("false"), labels).count() == 0
    assert {x["verdict"] for x in url_filter.judge_urls(pages.where("page_id in (1, 7)"), labels.where("false")).collect()} == {"allow"}


def test_templates_split_by_labels(spark):
    rows = [(i, "h", f"/{'spam' if i % 2 else 'news'}/{i}", 1 if i % 2 else 0) for i in range(200)]
    t = url_filter.path_templates(spark.createDataFrame(rows, "page_id long, host string, path string, bad int")).toPandas()
    assert set(t.template) == {"/spam/*", "/news/*"}


def test_warc_round_trip(spark):
    html = ["", "\r\n\r\nWARC/1.0\r\n\r\n", None, "abc\r\n", "\r\n\r\n", "é\r\n\r\n\r\n", "abc\r\n", "tail\r", "x" * 300_000, "tail\r"]
    rows = [(i if i != 6 else None, f"http://H.b/{i}\r\n", h, "f") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    captures, index = warc.archive(pages)
    got = {r["page_id"]: r for r in captures.collect()}
    keep = {}
    for i, _, h, _ in rows:
        keep[h or ""] = max((x for x in (keep.get(h or ""), i) if x is not None), default=None)
    for i, _, h, _ in rows:
        data = (h or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == __import__("base64").b32encode(hashlib.sha1(data).digest()).decode()
        first = keep[h or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert r["html"] == (None if r["record_type"] == "revisit" else h or "")
    placed = index.orderBy("position").collect()
    order = [(r["url_key"], r["date"]) for r in placed]
    assert order == sorted(order) and len(order) == len(rows) and [r["position"] for r in placed] == list(range(len(rows)))
    assert sorted((r["page_id"] or -1, r["record_type"], r["offset"]) for r in captures.collect()) == sorted((r["page"] or -1, r["record_type"], r["offset"]) for r in placed)
    least = {r["page_id"]: r["record_type"] for r in warc.archive(pages, least_bytes=6)[0].collect()}
    assert least[0] == "response" and least[3] == "response"
    empty, none = warc.archive(pages.where("false"))
    assert empty.count() == 0 and none.count() == 0


def test_runs_in_pieces_are_merged_in_order(spark):
    import pyarrow as pa

    rnd = random.Random(3)
    rows = [(rnd.randrange(3), f"k{rnd.randrange(9)}", "d", rnd.choice([None, *range(5)]), "f", i) for i in range(200)]
    kept = pa.schema([("url_key", pa.string()), ("date", pa.string()), ("page", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k + 1] for r in rows], f.type) for k, f in enumerate(kept))], names=["run", *kept.names])
    out = pa.Table.from_batches(list(warc._merged(kept.append(pa.field("place", pa.int64())))(iter([batch.slice(0, 90), batch.slice(90)])))).to_pylist()
    key = lambda r: (r["url_key"], r["date"], -1 if r["page"] is None else r["page"], r["offset"])
    assert [key(r) for r in out] == sorted(map(key, out)) and [r["place"] for r in out] == list(range(200))


def test_loser_tree():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((rnd.randrange(50),) for _ in range(rnd.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


PAGE = "<html><head><title>T{i}</title><style>x</style></head><body><header>Site</header><nav><ul><li><a href=1>Home</a><li><a>News</a></ul></nav><div class=content><h1>Title {i}</h1><p>Body one of {i} &amp; more<br>text<p>Second <b>part {i}<p class='share-this'>share</p><div class=promo-box>constant plug</div><p>Follow us every day</div><div class='comments'><p>reader {i}</div><footer>(c) site</footer></body></html>"


def test_wrappers_without_article(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", PAGE.format(i=i), "t") for i in range(12)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    assert got == {i: f"Title {i}\nBody one of {i} & more text\nSecond part {i}" for i in range(12)}


PLAIN = "<html><body><div><ul><li>Home of all<li>About us here<li>Shop for things</ul></div><div><h1>Title {i}</h1><p>Body {i} says {j} and more words of its own than any other part, so that it weighs most of all here, which a page's text does nearly everywhere; it goes on for one more clause.<p>Join our list and never miss a thing<p>Second part {j}</div><div><p>Reader {j} wrote this</p></div><div>All rights reserved by the site</div></body></html>"


def test_the_wrapper_decides_where_tags_and_classes_say_nothing(spark):
    import hashlib

    pages = [(i, f"http://h/{i}", PLAIN.format(i=i, j=hashlib.md5(str(i).encode()).hexdigest())) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, html in pages:
        j = hashlib.md5(str(i).encode()).hexdigest()
        assert got[i] == f"Title {i}\nBody {i} says {j} and more words of its own than any other part, so that it weighs most of all here, which a page's text does nearly everywhere; it goes on for one more clause.\nSecond part {j}"
        alone = html_extract.main_text(html_extract.parse(html), {})
        assert alone != got[i] and "Join our list" in alone


def test_one_pivot_a_host_whatever_the_partitions(spark):
    pages = [(i, f"http://h{i % 3}/{i}", PLAIN.format(i=i, j=i * i) if i % 4 else PAGE.format(i=i)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [sorted(map(tuple, html_extract.extract_main_text(df.repartition(n)).collect())) for n in (1, 7)]
    assert got[0] == got[1]


def test_a_teaser_in_an_article_is_not_the_text(spark):
    page = "<html><body><div><h2>Head {0}</h2><p>" + "word{0} " * 60 + "</p></div><article><p>short teaser {0}</p></article></body></html>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page.format(i)) for i in range(6)] + [(9, "http://other/", page.format(9))], "page_id long, url string, html string")
    for r in html_extract.extract_main_text(pages).collect():
        assert r["text"].startswith(f"Head {r['page_id']}\nword") and "teaser" not in r["text"]


def test_html_edges(spark):
    rows = [(1, None, None), (2, "http://a/x", ""), (None, "u", "plain &lt;b&gt; text"), (4, "http://a/x", "<article><p>a&nbsp; b<p>c<aside>no</aside></article>tail"), (5, "http://a/y", "<div>" * 3000 + "deep" + "</div>" * 3000), (4, "http://a/x", "<article><p>a&nbsp; b<p>c<aside>no</aside></article>tail")]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted([("1", "", 0), ("2", "", 0), ("None", "plain <b> text", 14), ("4", "a b\nc", 5), ("5", "deep", 4), ("4", "a b\nc", 5)])
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_simple_tree_matching_against_plain_recursion():
    rnd = random.Random(8)

    def tree(depth):
        node = html_extract.Node(rnd.choice("ab"), "")
        node.kids = [tree(depth - 1) for _ in range(rnd.randrange(4))] if depth else []
        return node

    def slow(a, b):
        if a.label != b.label:
            return 0
        m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + slow(x, y))
        return 1 + m[-1][-1]

    for _ in range(100):
        a, b = tree(3), tree(3)
        assert html_extract.matched(a, b, {}) == slow(a, b)


def test_wide_and_deep_pages_are_matched_like_others():
    rnd = random.Random(9)
    wide = ["<div>" + "".join(f"<p class={rnd.choice('abcd')}>t<b>{'<i></i>' * rnd.randrange(3)}</b></p>" for _ in range(n)) + "</div>" for n in (230, 260)]
    a, b = (html_extract.parse(x) for x in wide)
    x, y = ([k for k in r.kids[0].kids] for r in (a, b))
    pair = lambda p, q: 0 if p.label != q.label else 2 + min(len(p.kids[1].kids), len(q.kids[1].kids))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + pair(p, q))
    assert html_extract.matched(a, b, {}) == 2 + best[-1][-1]
    pairs = html_extract.aligned_kids(a.kids[0], b.kids[0], {})
    assert sum(w for _, _, w in pairs) == best[-1][-1]
    at = [(x.index(p), y.index(q)) for p, q, _ in pairs]
    assert len({i for i, _ in at}) == len({j for _, j in at}) == len(at) and sorted(at) == sorted(at, key=lambda t: t[1])
    deep = [html_extract.parse("<div>" * n + "deep" + "</div>" * n + "<p>after") for n in (600, 450)]
    assert html_extract.matched(*deep, {}) == 452 and html_extract.matched(deep[0], deep[0], {}) == deep[0].size
    assert [b.text for b in html_extract.blocks(deep[0])] == ["deep", "after"]


def test_long_paths_take_as_many_rounds_as_forks(spark, monkeypatch):
    rounds = []
    led = url_filter._without_forks
    monkeypatch.setattr(url_filter, "_without_forks", lambda rows: rounds.append(1) or led(rows))
    long = "/".join(f"s{i}" for i in range(2000))
    urls = [f"http://h.test/{long}/a", f"http://h.test/{long}/b", f"http://h.test/{long}/b", "http://h.test/x/y", "http://other.test/" + long, "http://other.test/", None]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["template"] for r in url_filter.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert len(rounds) <= 3 and got == {0: "/+" * 2000 + "/*", 1: "/+" * 2001, 2: "/+" * 2001, 3: "/*/*", 4: "/*" * 2000, 5: "", 6: ""}


def test_language_edges(spark):
    rows = [(i, t, lang, "s", 2) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), (None, "en"), ("123 !!", "de"), ("", None), ("the dog and the cat", None)] * 20)]
    df = spark.createDataFrame([*rows, (None, "the end of the day", "en", "s", 2)], "doc_id long, text string, lang string, lang_pred string, score int")
    r = langid.identify(df).toPandas()
    assert len(r) == 121 and (r[r.text.isna() | r.text.isin(["", "123 !!"])].lang_pred == "und").all()
    assert (r[r.text == "the dog and the cat"].lang_pred == "en").all() and r.score.between(0, 1).all()
    blank = langid.identify(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).first()
    assert (blank["lang_pred"], blank["score"], blank["ambiguous"]) == ("und", 0.0, True)
    assert langid.identify(df.where("false")).count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n and all((np.abs(code.sum(0)) < n))


def test_toxicity_edges(spark):
    rows = [(i, "you stupid thing" if i % 2 else "a nice day", "g") for i in range(60)] + [(None, None, "g"), (99, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(60)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    r = toxicity.score_toxicity(docs, labels).toPandas()
    assert len(r) == 62 and r[r.doc_id.isin(range(1, 60, 2))].toxic.all() and not r[r.doc_id.isin(range(0, 60, 2))].toxic.any()
    assert r.severity.between(0, 2).all()
    assert toxicity.score_toxicity(docs, labels.where("false")).toPandas().severity.isna().all()
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_ordinal_thresholds_ascend():
    rnd = np.random.default_rng(0)
    grades = rnd.integers(0, 3, 300)
    rows = [np.unique(rnd.integers(0, 50, 10)).astype(np.uint64) if g == 0 else np.array([100 + g, *rnd.integers(0, 50, 5)], np.uint64) for g in grades]
    rows = [np.unique(r) for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    m = toxicity.Ordinal(np.concatenate(rows), np.ones(offsets[-1], np.int64), offsets, np.full(300, 10), grades, 2)
    assert m.thresholds[1] > m.thresholds[0]


def test_word_kernel_against_regex():
    import pyarrow as pa

    texts = ["", None, "a", " a  b\tc\n", "Äpfel und ÄPFEL", "x" * 5000 + " y", "a a A", "\x0b\x0c"]
    h, at = textkernel.words(*textkernel.bytes_of(pa.array(texts)), textkernel.SPACED)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for ws in words for w in ws]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_kernels_do_not_carry_the_tables_that_the_driver_made():
    textkernel.sequences(np.arange(1 << 18, dtype=np.uint64), np.array([0, 1 << 18]))
    assert len(cloudpickle.dumps(textkernel.sequences)) < 1_000_000
    sent = pickle.loads(cloudpickle.dumps(textkernel.sequences))
    words, at = np.arange(5000, dtype=np.uint64), np.array([0, 7, 7, 5000])
    assert (sent(words, at) == textkernel.sequences(words, at)).all()
