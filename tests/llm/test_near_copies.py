import random

import pytest

from gossamer.llm import simhash as S
from tests.llm.test_simhash import brute_similar, changed


def chained(words, share, r):
    """A text whose words are replaced by others of its own, so that all texts keep one vocabulary."""
    return [r.choice(words) if r.random() < share else w for w in words]


def same_groups(docs, texts, **how):
    got = {x.doc_id: x.component_id for x in S.similar_groups(docs(texts), **how).collect()}
    assert [got[i] for i in range(len(texts))] == brute_similar(texts)


@pytest.mark.parametrize("crowd, side", [(1, 3), (1, 256), (32, 256)])
def test_crowds_of_one_vocabulary(docs, monkeypatch, crowd, side):
    """All texts hold the same words, so no pivot stands near every pair."""
    monkeypatch.setattr(S, "SIDE", side)
    r = random.Random(5)
    vocabulary = [f"v{k}" for k in range(60)]
    texts = []
    for _ in range(30):
        words = vocabulary + [r.choice(vocabulary) for _ in range(340)]
        r.shuffle(words)
        texts += [" ".join(words), " ".join(chained(words, 0.005, r))]
    start = [r.choice(vocabulary) for _ in range(400)]
    for _ in range(60):  # a walk: neighbours are near copies, its ends are not
        start = chained(start, 0.012, r)
        texts.append(" ".join(start))
    same_groups(docs, texts, crowd=crowd)
    assert len(set(brute_similar(texts))) < len(texts) - 40


def test_groups_equal_exact_similarity(docs):
    """Pairs on both sides of 0.8, in every length, equal brute force over the shingles."""
    r = random.Random(11)
    texts = []
    for n in (6, 25, 40, 150, 600):
        for share in (0.005, 0.015, 0.02, 0.022, 0.025, 0.03, 0.04):
            for _ in range(4):
                words = [f"w{int(r.paretovariate(0.4)) % 5000}" for _ in range(n)]
                texts += [" ".join(words), changed(words, share, r)]
    same_groups(docs, texts + ["", None, " ", "one", "One", "a b c d e", "a b c d e f"])


def test_fingerprints_and_exact_similarity_both_link(docs):
    """Components over the links of both: brute force of fingerprints within two bits and of similarity."""
    from tests.llm.test_simhash import brute_fp

    r = random.Random(2)
    texts = ["", None, "one"]
    for n in (4, 12, 60, 300):
        words = [f"w{int(r.paretovariate(0.5)) % 900}" for _ in range(n)]
        texts += [" ".join(words), changed(words, 0.02, r), " ".join([*words, "x"])]
    long = " ".join(f"w{k}" for k in range(40))
    twins = [f"{long} " * 12 + f"{long} ".join(f"q{k}{z} " for k in range(4)) for z in "abcdef"]
    texts += twins  # repeated shingles weigh on fingerprints, not on sets
    prints = [brute_fp(t, 5) for t in texts]
    want = list(brute_similar(texts))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    rows = S.near_copies(docs(texts)).collect()
    got = {x.doc_id: x.component_id for x in rows}
    assert [got[i] for i in range(len(texts))] == want and len(rows) == len(texts)
    assert [x.fingerprint & (1 << 64) - 1 for x in sorted(rows)] == prints
    assert want != list(brute_similar(texts))  # fingerprints link what sets do not
