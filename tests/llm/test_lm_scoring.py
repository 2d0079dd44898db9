import math

import numpy as np
import pytest

from gossamer.llm import lm_scoring as L
from gossamer.llm.common import crc_bucket

TEXTS = ["the cat sat on the mat", None, "", "THE cat\tate  the\nrat", "a " * 500, "ñandú über", "the cat sat on the mat", "zzz the"] * 6


def brute_model(texts, depth):
    """Context-tree weighting by definition, over dictionaries."""
    counts = {}
    for t in texts:
        s = [10] * depth + list(b" ".join((t or "").encode().lower().split()) + b"\n")
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for j in range(8):
                    key = tuple(s[i - d : i]), 1 << j | s[i] >> (8 - j)
                    counts.setdefault(key, [0, 0])[s[i] >> (7 - j) & 1] += 1
    g = math.lgamma
    pe = {k: g(a + 0.5) + g(b + 0.5) - g(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    kids = {}
    for c, n in counts:
        if c:
            kids.setdefault((c[1:], n), []).append((c, n))
    memo = {}

    def pw(k):
        if k not in memo:
            memo[k] = pe[k] if len(k[0]) == depth else np.logaddexp(pe[k], sum(map(pw, kids[k]))) - math.log(2)
        return memo[k]

    def bit(context, node):
        kept, total = 1.0, 0.0
        for d in range(depth + 1):
            k = tuple(context[len(context) - d :]), node
            if k not in counts:
                return total + kept * last if d else 0.5
            a, b = counts[k]
            last = (b + 0.5) / (a + b + 1)
            stop = 1.0 if d == depth else math.exp(pe[k] - math.log(2) - pw(k))
            if d == depth:
                return total + kept * last
            total, kept = total + kept * stop * last, kept * (1 - stop)

    def score(t):
        s = [10] * depth + list(b" ".join((t or "").encode().lower().split()) + b"\n")
        out = 0.0
        for i in range(depth, len(s)):
            for j in range(8):
                p = min(max(bit(s[i - depth : i] if depth else [], 1 << j | s[i] >> (8 - j)), 1e-7), 1 - 1e-7)
                out += math.log10(p if s[i] >> (7 - j) & 1 else 1 - p)
        return out

    return score


@pytest.mark.parametrize("depth", [0, 2, 3])
def test_weighting_matches_definition(depth):
    train, other = TEXTS[:5], ["the cap ate", "Qq", "", "über ñ mat"]
    keys, n = L.count_grams([(t or "").encode() for t in train], depth)
    model, brute = L.Model(keys, n.astype(float), depth), brute_model(train, depth)
    got, left = L.score([(t or "").encode() for t in train + other], depth, L.Logs(model.grams, model.logs))
    got = [x + float((model.log10(k) * n).sum()) for x, (k, n) in zip(got, left)]
    assert np.allclose(got, [brute(t) for t in train + other], rtol=1e-4, atol=1e-3)


def test_probabilities_of_a_byte_sum_to_one():
    keys, n = L.count_grams([b"abracadabra the cat"] * 3, 3)
    m = L.Model(keys, n.astype(float), 3)
    for context in (b"abr", b"zzz", b"\n\n\n", b"he "):
        c = int.from_bytes(context, "big")
        assert abs((10.0 ** m.log10(np.uint64(c << 8) | np.arange(256, dtype=np.uint64)).astype(float)).sum() - 1) < 1e-4


@pytest.mark.parametrize("head", [1 << 17, 2])
def test_query_matches_brute_force(docs, monkeypatch, head):
    monkeypatch.setattr("gossamer.llm.lookup.HEAD", head)
    monkeypatch.setattr(L, "FLUSH", 5)
    rows = {r.doc_id: r for r in L.scored(docs(TEXTS), depth=2).collect()}
    train = [t for i, t in enumerate(TEXTS) if crc_bucket(i, 10)]
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = {}
    for t in train:
        for w in words(t):
            c[w] = c.get(w, 0) + 1
    n, v, brute = sum(c.values()), len(c), brute_model(train, 2)
    for i, t in enumerate(TEXTS):
        w = words(t)
        base = sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc_bucket(i, 10) == 0, len(w), sum(x in c for x in w), n)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - brute(t)) < 1e-2


def test_bounded_model_and_empty_tables(docs):
    assert L.scored(docs([])).count() == 0
    assert L.scored(docs(TEXTS), depth=4, max_grams=1, head_grams=0).count() == len(TEXTS)


def test_very_long_text_repeated_rows_and_clashing_columns(docs):
    long = "the cat sat on a mat " * 100_000
    d = docs(["the cat", long, "the cat"], [1, 2, 1]).selectExpr("*", "'x' AS score", "1 AS _row", "2 AS near")
    rows = sorted((r.doc_id, r.n_tokens, r.score) for r in L.scored(d).collect())
    assert [r[:2] for r in rows] == [(1, 3), (1, 3), (2, 600_001)] and rows[0] == rows[1] and rows[2][2] < rows[0][2] < 0
