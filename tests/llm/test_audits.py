"""Conversation repair, filter audit and licence scan against brute force: nulls, ties, repeats, long texts, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re

from focalframe.llm import conversation, filter_audit, license_scan, queries

SPACE = " \t\n\v\f\r"


def cheapest(turns):
    """(cost, audit, repaired turns) by trying every edit at every turn, least first, with the best rest remembered."""
    best = {}

    def rest(i, said):
        # ``said`` is what the grammar still cares about: '', 's', or the last of 'u' and 'a'.
        if (i, said) in best:
            return best[i, said]
        goes = "a" if said == "u" else "u"
        found = [(0, "", [])] if i == len(turns) and said in ("", "a") else []
        if i < len(turns):
            role, text, must, short = turns[i]
            c, a, r = rest(i + 1, said)
            found.append((c + 3, "D" + a, r))
            if not must:
                c, a, r = rest(i + 1, goes)
                found.append((c + 2 + short, "R" + a, [f"{'user' if goes == 'u' else 'assistant'}:{text}", *r]))
                if role[:1] == goes or (role[:1] == "s" and said == ""):
                    c, a, r = rest(i + 1, role[:1])
                    found.append((c + short, "K" + a, [f"{role}:{text}", *r]))
        c, a, r = after_insert(i, goes)
        found.append((c + 2, "I" + a, [f"{'user' if goes == 'u' else 'assistant'}:", *r]))
        best[i, said] = min(found, key=lambda x: x[:2])
        return best[i, said]

    def after_insert(i, said):
        """At most one more insertion follows: two of them lead back to where they began."""
        goes = "a" if said == "u" else "u"
        found = [(0, "", [])] if i == len(turns) and said == "a" else []
        if i < len(turns):
            role, text, must, short = turns[i]
            c, a, r = rest(i + 1, said)
            found.append((c + 3, "D" + a, r))
            if not must:
                c, a, r = rest(i + 1, goes)
                found.append((c + 2 + short, "R" + a, [f"{'user' if goes == 'u' else 'assistant'}:{text}", *r]))
                if role[:1] == goes:
                    found.append((c + short, "K" + a, [f"{role}:{text}", *r]))
        if said == "u":
            c, a, r = after_insert(i, "a")
            found.append((c + 2, "I" + a, ["assistant:", *r]))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "~", [])

    return rest(0, "")


def reported(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            said = text.rstrip(SPACE)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        numbers = [t for t, _, _ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "what?", "  ", "", "A long answer, cut", "Done!\n", "One. Two", None, "x"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux"]
    rows = [(conv, rnd.choice([None, turn, turn + (conv or 0) % 2]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.4 else f"text {turn}.{rnd.randrange(6)}{rnd.choice(['', '.'])}")
            for conv in [*range(30), None] for turn in range(rnd.randrange(1, 14))]
    rows += [(77, t, ["user", "assistant"][t % 2], f"turn {t % 90}.") for t in range(200)] + [(77, 5, "user", "same.")] * 40 + [(78, 0, "user", "y" * 300_000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, word int, state string, cost string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "clash", "x") for r in rows], SCHEMA)


def test_repair_against_brute_force_at_any_size_of_piece(spark):
    rows = conversations(4)
    want = reported(rows)
    for size, chars in ((4096, 1 << 22), (7, 1 << 22), (1, 50)):
        report, edited = conversation.repair_conversations(frame(spark, rows).repartition(3), max_turns=size, max_chars=chars)
        got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in report.collect()}
        assert got == want
        pieces = sorted(edited.collect(), key=lambda r: (r["part"], r["seq"]))
        for conv in want:
            mine = [e for p in pieces if p["conv_id"] == conv for e in p["edits"]]
            assert "".join(e["edit"] for e in mine) == want[conv][6]
            assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in mine if e["edit"] != "D").encode()).hexdigest() == want[conv][7]
            roles = "".join(e["role"][:1] for e in mine if e["edit"] != "D")
            assert re.fullmatch("(s?(ua)+)?", roles)


def test_repair_of_nothing(spark):
    report, edited = conversation.repair_conversations(frame(spark, []))
    assert report.count() == 0 and edited.count() == 0


def test_walks_of_random_codes_are_least(spark):
    rnd = random.Random(2)
    step, walk, ending = conversation.tables()
    for _ in range(2000):
        turns = [(rnd.choice(["system", "user", "assistant", "tool"]), "t", rnd.random() < 0.2, int(rnd.random() < 0.2)) for _ in range(rnd.randrange(9))]
        codes = [conversation.KINDS.get(r[0], 3) | 4 * must | 8 * (short and not must) for r, _, must, short in turns]
        turns = [(r, t, must, int(bool(c & 8))) for (r, t, must, _), c in zip(turns, codes)]
        words, word, state, audit = [], 0, 0, ""
        for code in reversed(codes):
            words.append(word)
            word = step[word][code]
        for code in codes:
            letters, state = walk[words.pop()][code][state]
            audit += letters
        assert audit + ending[state] == cheapest(turns)[1]


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"Hi {t}. ok?") for c in (1, None) for t in [None, *range(60)]]
    got = sorted(map(repr, map(tuple, conversation.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())))
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got == sorted(map(repr, want))


def failed(doc_id, text, docs):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return fails + "E" * any(x is not None and doc_id is not None and x < doc_id and (t or "") == text for x, t, *_ in docs)


def audited(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = [(source or "", set(failed(i, text or "", docs)), i is not None and i in good, i is not None and i in toxic) for i, text, source, *_ in docs]
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                go = [r for r in left if letter in r[1]]
                stay = [r for r in left if letter not in r[1]]
                fail = [r for r in rows if r[0] == part and letter in r[1]]
                out[part, "".join(order), step] = (len(stay), len(go), len(fail) - len(go), sum(r[1] == {letter} for r in fail), sum(r[2] for r in go), sum(r[3] for r in go))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(go)
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    texts = [None, "", " \n", "A#1", "same words " * 40, long, long[:-1] + "#", long[:100] + "Ä" + long[101:], long] + [" ".join(rnd.choice(words) for _ in range(n)) + rnd.choice(["", "&", " ABCDEFGHIJ" * 4]) for n in (3, 60, 70, 80, 300) for _ in range(3)]
    rows = [(i, rnd.choice(texts), rnd.choice(["a", "b", None, ""]), "clash", 1, "x") for i in range(70)]
    return rows + [(None, texts[5], "a", "clash", 1, "x"), (None, texts[5], "a", "clash", 1, "x"), (0, texts[5], "b", "c", 2, "y"), rows[3], rows[3], (5, "", "a", "c", 2, "y")]


def test_audit_against_brute_force(spark):
    docs, labels = corpus(), [(i, i % 2, i % 3) for i in range(50)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (7, None, None)]
    want = audited(docs, labels)
    data = spark.createDataFrame(docs, "doc_id long, text string, source string, fails string, n_chars int, class string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for bits in (64, 1):
        # With hashes of one bit many different texts share all their hashes and must be told apart by the comparison.
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in filter_audit.audit_filters(data, marks, hash_bits=bits).collect()}
        assert got == want
    none = filter_audit.audit_filters(data, marks.where("false")).selectExpr("max(good_lost + toxic_lost)", "count(*)").first()
    assert none[0] == 0 and none[1] == len(want)
    assert filter_audit.audit_filters(data.where("false"), marks).count() == 0


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scanned(text, templates, share=0.8):
    w = tokens(text)
    base = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    blocks = set()
    for label, notice in templates:
        t = tokens(notice)
        for s in range(max(1, len(w) - len(t) + 1)) if t and w else []:
            held = len(set(w[s : s + len(t)]) & set(t)) / len(set(t))
            if held >= share - 1e-12:
                blocks.add((s, min(len(t), len(w)), label, " ".join(t), round(held, 9)))
    labels = sorted({x for _, x in base})
    score = 1.0 if base else max([0.0, *(b[-1] for b in blocks)])
    return (len(w), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(labels), ",".join(sorted({*labels, *(b[2] for b in blocks)})), round(score, 9), tuple(sorted(blocks)))


def test_licences_against_every_block(spark):
    rnd = random.Random(6)
    noise = lambda n: " ".join(rnd.choice(["the", "of", "license", "version", "this", "work", "word", "über", "apache", "2", "0"]) for _ in range(n))
    templates = [*license_scan.TEMPLATES, ("odd", "one one one two"), ("none", "--"), ("apache", "Licensed under the Apache License, Version 2.0"), ("twice", "Released under the MIT License")]
    texts = [None, "", " .. ", "CC", "by cc by", "All rights\nreserved. all RIGHTS reserved", noise(3000), "one two", "one", "MIT License"]
    for _, notice in templates:
        w = notice.split()
        texts += [notice, f"{noise(5)} {notice} {noise(40)}", " ".join(reversed(w)), " ".join(w[1:]), f"{noise(9)} {' '.join(w[: max(1, len(w) * 8 // 10)])} {noise(3)}", " ".join(w[::2]), " ".join(x + " word" if i == 1 else x for i, x in enumerate(w))]
    texts += [noise(20_000) + " " + templates[0][1] + " " + noise(500), texts[10], texts[10]]
    docs = spark.createDataFrame([(i if i % 9 else None, t, "clash", 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string, word int, w string")
    got = license_scan.scan_licenses(docs, license_scan.templates_of(spark, templates)).collect()
    key = lambda x: repr(x)
    rows = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9), tuple((b["start"], b["n_words"], b["label"], b["template"], round(b["containment"], 9)) for b in r["blocks"])) for r in got), key=key)
    assert rows == sorted(((i if i % 9 else None, *scanned(t, templates)) for i, t in enumerate(texts)), key=key)
    assert license_scan.scan_licenses(docs.where("false"), license_scan.templates_of(spark)).count() == 0
    bare = license_scan.scan_licenses(docs, license_scan.templates_of(spark).where("false")).collect()
    assert sorted(r["labels"] for r in bare) == sorted(scanned(t, [])[5] for t in texts)


def test_queries_return_their_columns(spark):
    data = "/root/testdata/sf0.001"
    assert queries.op11_conversation_repair(spark, data).columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert queries.op13_license_scan(spark, data).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
