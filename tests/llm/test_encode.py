import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataquery.llm import encode as C

PIECES = ["'", "s", "re", "'ll", " ", "  ", "\n", "\t", "é", "日本", "a", "Word", "22", "!?", " x", " ", "<|endoftext|>", "🙂", "\r\n", "é", " "]


@pytest.fixture(scope="module")
def encoder():
    return C.Encoder()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=40), st.lists(st.floats(0, 1), max_size=6))
def test_joined_chunks_are_exact(pieces, places):
    encoder = C.Encoder()
    text = "".join(pieces)
    edges = sorted({0, len(text), *(int(p * len(text)) for p in places)})
    parts = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    assert encoder.join(encoder.encode(parts)).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.text(max_size=200)))
def test_whole_texts_are_exact(text):
    encoder = C.Encoder()
    assert encoder.whole([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_runs_of_one_letter(encoder):
    texts = [" " * 300_000 + "x", "x" * 200_000, "\n" * 100_000, "=" * 100_000, "a" + " \n" * 50_000 + "b", "日" * 50_000]
    assert [x.tolist() for x in encoder.whole(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_that_the_faster_search_gives_up_on(encoder, monkeypatch):
    monkeypatch.setattr(C, "_BLANKS", __import__("re").compile("(?!)"))
    texts = ["a b", " " * 1_000_000 + "x", "", "c"]
    assert [x.tolist() for x in encoder.whole(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pieces_without_white_space(encoder):
    text = "x" * 60_000 + "y z"
    ends = C.cuts(text)
    parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert len(parts) > 5 and encoder.join(encoder.encode(parts)).tolist() == encoder.tokenizer.encode(text).ids


def test_cuts_depend_on_content_only():
    random.seed(1)
    words = ["".join(random.choice("abcdefg") for _ in range(random.randint(2, 9))) for _ in range(3000)]
    shared = " ".join(words)
    one, two = ({t[a:b] for a, b in zip([0, *C.cuts(t)], C.cuts(t), strict=False)} for t in (shared, "some other beginning " * 40 + shared))
    assert len(one & two) > 0.8 * len(one)
    assert "".join(shared[a:b] for a, b in zip([0, *C.cuts(shared)], C.cuts(shared), strict=False)) == shared
    assert C.cuts("") == [] and C.cuts("a") == [1]


def test_corpus(spark, encoder):
    long = " ".join(f"word{i % 97}" for i in range(4000))
    texts = [None, "", " ", "Hello <|endoftext|> world", long, long + " tail", "x" * 20_000, "a\r\nb\u0000c", long]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(4, long, "again"), (None, "lost", "x")]
    got = {r.doc_id: r.ids for r in C.encoded_corpus(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()}
    assert got == {i: encoder.tokenizer.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert 50256 not in got[3]
    assert C.encoded_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []
