import random
import re
import time

import numpy as np
import pytest

from gossamer.llm import decontaminate as D

ITEMS = [
    (0, "Alice has 12 apples and gives Bob 5 of them every day for 3 weeks, so how many apples will Alice still have when Bob leaves for Paris?"),
    (1, "the quick brown fox jumps over the lazy dog near the river while seven old owls watch from a hollow tree"),
    (2, "too short"),
    (3, None),
]
PAD = "some other words that say nothing of interest come before and after it here . "


def swap(text, **to):
    for a, b in to.items():
        text = text.replace(a.lstrip("_"), b)
    return text


def test_finds_copies_and_other_parameters(spark, docs):
    q = ITEMS[0][1]
    other = swap(q, Alice="Zoe", Bob="Tim", Paris="Rome", _12="1,300.5", _5="7", _3="9", weeks="months")
    mixed = q.replace("Alice has 12", "Zoe has 12").replace("Bob leaves", "Alice leaves").replace("gives Bob", "gives Paris").replace("for 3", "for 5").replace("still", "still")
    texts = [
        None, "", PAD * 3, PAD + q + PAD, PAD + q.upper() + PAD, PAD + other + PAD, q.lower(), PAD + mixed + PAD, q[: len(q) // 2],
        PAD * 2000 + ITEMS[1][1] + PAD, ITEMS[1][1] + " " + other, "too short",
    ]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for most in (D.MAX_BYTES, 1):
        got = sorted((r.doc_id, r.item_id, r.kind) for r in D.leaks(docs(texts), bench, max_bytes=most).collect())
        assert got == [(3, 0, "literal"), (4, 0, "literal"), (5, 0, "template"), (6, 0, "literal"), (9, 1, "literal"), (10, 0, "template"), (10, 1, "literal")]


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.leaks(docs([]), bench).count() == 0
    assert D.leaks(docs([ITEMS[0][1]]), bench.limit(0)).count() == 0
    rows = D.marked(docs([ITEMS[1][1]] * 2, [7, 7]).withColumnRenamed("lang", "Leaks"), bench).collect()
    assert [len(r.leaks) for r in rows] == [1, 1]


@pytest.mark.parametrize("text", ["", "1", "a", "3.5", ".5 a1b2 É", "x" * 10])
def test_words(text):
    w = D.words_of(text.encode())
    want = {"": [], "1": ["1"], "a": ["a"], "3.5": ["3.5"], ".5 a1b2 É": ["5", "a", "1", "b", "2", "É"], "x" * 10: ["x" * 10]}[text]
    assert [text.encode()[a:b].decode() for a, b in zip(w.start, w.end)] == want


def test_hash_of_a_word_does_not_depend_on_its_place():
    a, b = D.words_of(b"alpha beta gamma"), D.words_of(b"xx gamma  Alpha")
    assert a.literal[0] == b.literal[2] and a.literal[2] == b.literal[1] != a.literal[1]
    assert b.template[2] == D.NAME and D.words_of("é É".encode()).literal[0] == D.words_of("é É".encode()).literal[1]


def brute_words(text):
    """(lower-cased word, template, whether a slot) by the rule, with a regular expression."""
    out = []
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|[a-zA-Z\u0080-\uffff]+", text):
        w, low = m[0], m[0].lower()
        kind = "#N" if w[0].isdigit() else "#U" if low in D.UNITS else "#P" if w[0].isupper() else low
        out.append((low, kind, kind[0] == "#"))
    return out


def brute_leaks(text, items):
    """All items against one text, by trying every shift."""
    doc, out = brute_words(text), []
    for item_id, t in items:
        own, done = brute_words(t), None
        for form in (0, 1):
            gram = lambda ws, k: tuple(w[form] for w in ws[k : k + 5])
            told = lambda ws, k: not form or sum(not w[2] for w in ws[k : k + 5]) >= 2
            place = {}
            for k in range(len(own) - 4):
                if told(own, k):
                    place.setdefault(gram(own, k), k)
            if done or not place or form and len(place) < 3:
                continue
            met = [(p, place[gram(doc, p)]) for p in range(len(doc) - 4) if told(doc, p) and gram(doc, p) in place]
            best = max(((len({q for p, q in met if s <= p - q <= s + D.SLACK}), -s) for s in {p - q for p, q in met}), default=(0, 0))
            near = [(p, q) for p, q in met if -best[1] <= p - q <= -best[1] + D.SLACK]
            if best[0] < 0.8 * len(place) - 1e-9:
                continue
            shifts = [p - q for p, q in near]
            centre = min(set(shifts), key=lambda x: (-shifts.count(x), x))
            pick = {}
            for p, q in sorted(near, key=lambda c: (abs(c[0] - c[1] - centre), c[0])):
                pick.setdefault(q, p)
            if form:
                slots = {q + k: p + k for q, p in sorted(pick.items()) for k in range(5) if own[q + k][2]}
                pairs = [(own[q][0], doc[p][0]) for q, p in slots.items()]
                sides = [sum(max(sum(x == y for y in pairs) for x in pairs if x[side] == v) for v in {x[side] for x in pairs}) for side in (0, 1)]
                if pairs and min(sides) < 0.9 * len(pairs):
                    continue
            done = (item_id, len(pick) / len(place), "template" if form else "literal")
        if done:
            out.append(done)
    return out


@pytest.mark.parametrize("most", [D.MAX_BYTES, 1])
def test_whole_documents_against_brute_force(spark, sf, most):
    """All of sf0.001, and the benchmark's texts with other numbers, names and order among the documents."""
    r = random.Random(3)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for k, (_, t) in enumerate(items[:60]):
        words = t.split()
        if k % 3 == 0:
            words = [w if r.random() < 0.9 else r.choice(["Zoe", "17", "km", "other", "2,5"]) for w in words]
        if k % 3 == 1:
            words = [re.sub(r"[0-9]+", "88", w) for w in words] * 2
        if k % 3 == 2:  # other numbers and names, one for one
            words = [re.sub(r"\b[A-Z]", "Zu", w).translate(str.maketrans("0123456789", "3456789012")) for w in words]
        texts[10**6 + k] = PAD * (k % 4) + " ".join(words) + " " + PAD
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id, x.item_id, round(x.coverage, 9), x.kind) for x in D.leaks(d, bench, max_bytes=most).collect())
    want = sorted((i, item, round(c, 9), kind) for i, t in texts.items() for item, c, kind in brute_leaks(t, items))
    assert got == want and len({x[0] for x in want}) > 25 and len({x[3] for x in want}) == 2


def test_repeated_words_take_linear_time():
    bench = D.Benchmark([(0, b"the " * 60), (1, b"the " * 9 + b"cat"), (2, b"one two three four five six")], 5, 0.8)
    text = b"the " * 80_000
    began = time.time()
    assert [x["item_id"] for x in D.batch_leaks([text], bench, 0.9)[0]] == [0]
    assert time.time() - began < 1


def test_phrases_of_many_items_bring_no_candidates():
    phrase = "what is the sum of all of these numbers when taken one after the other "
    items = [(k, (phrase + " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + j)}" for j in range(12))).encode()) for k in range(500)]
    bench = D.Benchmark(items, 5, 0.8)
    assert np.diff(bench.bound).max() < 50
    assert D.batch_leaks([phrase.encode() * 40], bench, 0.9) == [[]]
    assert [x["item_id"] for x in D.batch_leaks([b"before " + items[77][1] + b" after"], bench, 0.9)[0]] == [77]


def test_clashing_columns_ties_and_null_ids(spark, docs):
    d = docs([ITEMS[1][1], None, ITEMS[1][1]], [None, 1, None]).selectExpr("*", "'x' AS _name", "3 AS item", "'y' AS LEAKS")
    bench = spark.createDataFrame([(1, ITEMS[1][1]), (9, ITEMS[1][1]), (None, "")], "item_id long, text string")
    for most in (D.MAX_BYTES, 1):
        got = sorted((r.doc_id or 0, sorted(x.item_id for x in r.leaks), r.item) for r in D.marked(d, bench, max_bytes=most).collect())
        assert got == [(0, [1, 9], 3), (0, [1, 9], 3), (1, [], 3)]
