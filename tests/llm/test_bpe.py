import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gossamer.llm import bpe as B
from gossamer.llm import queries as Q
from gossamer.llm import token_counts as C

TEXTS = [
    None, "", "Hello world, it's 2024!  \n\n\tthe  end ", "<|endoftext|>a<|endoftext|><|endoftext|> b<|endoftext", "naïve Ünïcode ςσ 東京 😀‍\U0001f525\x1c\x85　x",
    "a" * 3000, "ab" * 700 + "ñ" * 900, " " * 5000 + "x", "don't DON'T we'll", "the quick brown fox " * 2000, "\x00\x01\xff",
]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return B.Automaton(**B.read_vocabulary(Q.VOCABULARY)), Tokenizer.from_file(Q.VOCABULARY)


def test_known_texts(both):
    mine, library = both
    for t in TEXTS[1:]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.decode(ids).decode() == library.decode(ids, skip_special_tokens=False) == t


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeiorstn' \n0123.,é", max_size=80)))
def test_random_texts(both, text):
    mine, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids and mine.decode(ids).decode() == text


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), max_size=12), st.text(alphabet="abc", max_size=14))
def test_small_vocabularies_against_merging(pairs, word):
    """Any merge list over three letters, against merging rank by rank."""
    made, merges = [b"a", b"b", b"c"], []
    for i, j in pairs:
        a, b = made[i % len(made)], made[j % len(made)]
        if a + b not in made:
            merges.append((a, b))
            made.append(a + b)
    parts = [bytes([x]) for x in word.encode()]
    for a, b in merges:
        k, out = 0, []
        while k < len(parts):
            if parts[k : k + 2] == [a, b]:
                out.append(a + b)
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out
    automaton = B.Automaton(merges, {}, {})
    assert [automaton.labels[s] for s in automaton.encode_word(word.encode())] == parts


def test_operators(spark, docs, both):
    library = both[1]
    d, v = docs(TEXTS), B.Vocabulary(spark, Q.VOCABULARY)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    rows = B.decoded(B.encoded(d, v), v).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == want and [r.decoded for r in rows] == [t or "" for t in TEXTS]
    assert [r.n_tokens for r in rows] == [len(x) for x in want]
    assert B.encoded(d, v, decode=True).orderBy("doc_id").collect() == rows
    counted = C.token_counts(d.union(d.limit(3)), v).orderBy("doc_id").collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in counted) == sorted((i, len((TEXTS[i] or "").encode()), len(want[i])) for i in [*range(len(TEXTS)), 0, 1, 2])
    assert C.token_counts(docs([]), v).count() == 0 and B.encoded(docs([]), v).count() == 0


def test_counts_through_the_join(docs, spark, both, monkeypatch):
    monkeypatch.setattr("gossamer.llm.lookup.HEAD", 2)
    got = C.token_counts(docs(TEXTS), B.Vocabulary(spark, Q.VOCABULARY)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(both[1].encode(t or "", add_special_tokens=False).ids) for t in TEXTS]


def test_dead_merges_are_skipped():
    a = B.Automaton([(b"b", b"b"), (b"c", b"b"), (b"cb", b"b"), (b"cbb", b"a")], {}, {})
    read = lambda w: [a.labels[s] for s in a.encode_word(w)]
    assert read(b"cbb") == [b"c", b"bb"] and read(b"cbbb") == [b"c", b"bb", b"b"] and read(b"cbba") == [b"c", b"bb", b"a"]
    assert len(a.labels) == 258


def test_words_against_the_library_after_the_table_is_cleared(both, monkeypatch):
    monkeypatch.setattr(B, "ARCS", 20)
    a = B.Automaton(**B.read_vocabulary(Q.VOCABULARY))
    for t in TEXTS[2:]:
        assert a.encode(t) == both[1].encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("part, key, value", [("model", "ignore_merges", True), ("model", "type", "Unigram"), (None, "normalizer", {"type": "NFC"}), ("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "type", "Whitespace")])
def test_other_settings_are_refused(tmp_path, part, key, value):
    data = json.load(open(Q.VOCABULARY))
    data["model"] |= {"vocab": {"a": 0}, "merges": []}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(data))
    assert B.read_vocabulary(str(path))["ids"] == {b"a": 0}
    (data[part] if part else data)[key] = value
    path.write_text(json.dumps(data))
    with pytest.raises(ValueError):
        B.read_vocabulary(str(path))


def test_queries_against_the_library_on_whole_documents(spark, both):
    """op8 and op9 over every document of sf0.01."""
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: x.ids for r, x in zip(rows, both[1].encode_batch([r.text or "" for r in rows], add_special_tokens=False))}
    text = {r.doc_id: r.text or "" for r in rows}
    got = {r.doc_id: r for r in Q.op8_bpe(spark, d).collect()}
    assert got.keys() == ids.keys()
    for i, r in got.items():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[i]), sha(",".join(map(str, ids[i]))), sha(text[i]))
    counted = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op9_token_counts(spark, d).collect()}
    assert counted == {(i, len(text[i].encode()), len(x), len(x) > 1024) for i, x in ids.items()}


def test_repeated_rows_and_clashing_columns(spark, docs):
    v = B.Vocabulary(spark, Q.VOCABULARY)
    d = docs(["Hello there", None]).selectExpr("*", "'x' AS Ids", "1.5 AS n_tokens", "'y' AS decoded")
    out = B.encoded(d.union(d), v, decode=True).orderBy("doc_id").collect()
    assert [(r.doc_id, len(r.ids), r.n_tokens, r.decoded) for r in out] == [(0, 2, 2, "Hello there")] * 2 + [(1, 0, 0, "")] * 2
    more = docs(["Hello there"] * 2, [3, 3]).selectExpr("*", "'x' AS key", "'z' AS near", "7 AS n_bytes", "0 AS _row")
    assert [(r.n_bytes, r.n_tokens) for r in C.token_counts(more, v).collect()] == [(11, 2)] * 2
