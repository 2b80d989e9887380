import random

import pytest
from conftest import rows

from strataquery.llm import leak as L

ITEM = "An auditor found 223 shared basket rows in BrittleBucket; only Replay could verify them after 2025-01-03. Which edit in ReleaseFolder keeps lazy circuit ordering while LexerTask continues expanding up to ten basket pages?"
WORDS = L.words(ITEM)


def changed(words, every, how, seed=0):
    random.seed(seed)
    out = []
    for i, w in enumerate(words, 1):
        if i % every == 0:
            out += {"replace": ["zzz"], "drop": [], "add": [w, "zzz"]}[how]
        else:
            out.append(w)
    return out


def at(doc):
    places = {}
    for j, w in enumerate(doc):
        places.setdefault(w, []).append(j)
    return places


@pytest.mark.parametrize("how", ["replace", "drop", "add"])
def test_changed_passages_are_found(how):
    for start in range(0, len(WORDS) - 18):
        doc = ["x", "y", *changed(WORDS[start : start + 18], 8, how), "q", "r"]
        span, wrong = L.passage(doc, WORDS, at(doc))
        assert span >= 15 and wrong <= 3
        seen = {}
        assert set(L.fingerprints(doc, seen)) & set(L.fingerprints(WORDS, seen))


def test_short_and_torn_runs_are_none():
    for doc in (WORDS[:9], WORDS[:14], ["x"], [], changed(WORDS, 3, "replace"), [w for p in range(0, 36, 9) for w in [*WORDS[p : p + 9], *"abcdefghij"]]):
        assert L.passage(doc, WORDS, at(doc)) == (0, 0)


def test_every_long_enough_run_shares_a_fingerprint():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(50)]
    seen = {}
    for _ in range(200):
        run = [random.choice(vocabulary) for _ in range(L.K + L.WINDOW - 1)]
        one, two = ([random.choice(vocabulary) for _ in range(random.randrange(9))] + run + [random.choice(vocabulary) for _ in range(random.randrange(9))] for _ in range(2))
        assert set(L.fingerprints(one, seen)) & set(L.fingerprints(two, seen))


def test_words():
    assert L.words("// Foo_bar\r\n * <b>Ünï9</b>, x<y 日本") == ["foo", "bar", "ünï9", "x", "y", "日本"]


def test_leaks(spark):
    docs = [(1, "# Title\n" + ITEM.upper().replace(" ", "\n// ")), (2, " ".join(changed(WORDS[3:25], 8, "replace"))), (3, " ".join(WORDS[:9])), (4, None), (5, ""), (6, "x " * 30_000 + ITEM), (1, "# Title\n" + ITEM.upper().replace(" ", "\n// ")), (None, ITEM), (7, "<p>" + ITEM.replace(" ", "</p> <p>") + "</p>")]
    items = [(10, ITEM), (10, ITEM), (11, "too short"), (12, None), (None, ITEM), (13, " ".join(f"other{i}" for i in range(40)))]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as item"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc_id")
    assert rows(L.leaks(df, asked), "doc_id", "item_id") == [(1, 10), (2, 10), (6, 10), (7, 10)]
    assert rows(L.leaks(df.where("false"), asked)) == rows(L.leaks(df, asked.where("false"))) == []


def test_words_of_generics_stay_and_long_tags_go():
    assert L.words("List<string> a<b>c</b> Map<Key, Value>") == ["list", "string", "a", "c", "map", "key", "value"]
    assert L.words('x <a href="' + "y/" * 500 + '" title=\'z w\'>link</a> y') == ["x", "link", "y"]
    assert L.words("for (i<n; i++) keep these words -> end") == ["for", "i", "n", "i", "keep", "these", "words", "end"]
    assert len(L.words("<a b " * 20_000)) == 40_000 and len(L.words('<a b="' * 20_000)) >= 1


def test_hot_prints_are_split(spark):
    found = spark.createDataFrame([(i, 7) for i in range(300)] + [(1, 8)], "doc_id long, print long")
    asked = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 9)], "item_id long, print long")
    assert rows(L._met(found, asked, 0), "doc_id", "item_id") == rows(L._met(found, asked), "doc_id", "item_id")
