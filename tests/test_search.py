import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataquery.operators import index as I
from strataquery.operators import search as S

FILES = [(1, "a/cache.cs", "cache cache reader\nreader"), (2, "a/b.cs", "cache tile"), (3, "c.ts", "Tile\nreader writer"), (4, "d.ts", None), (5, "e.ts", "")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file_id long, path string, text string")


@pytest.fixture(scope="module")
def index(files):
    return I.postings(files)


def test_postings_keep_every_occurrence(index):
    assert rows(index.where("file_id = 1"), "token", "lines", "tf") == [("cache", (1, 1), 2), ("reader", (1, 2), 2)]
    assert rows(I.trigram_index(I.vocabulary(index)).where("trigram = 'ead'"), "token") == [("reader",)]


def test_stored_postings_merge_case_splits_and_repeats(spark):
    raw = [("Foo", 1, [1, 2]), ("foo", 1, [9]), ("foo", 1, [9]), (None, 1, [1]), ("bar", None, [1]), ("bar", 2, []), ("bar", 2, None)]
    assert rows(I.stored_postings(spark.createDataFrame(raw, "token string, file_id long, lines array<int>"))) == [("foo", 1, 3)]


def search(spark, files, index, terms, **more):
    return S.scored(I.ContentIndex.over(index, files), S.exact(index, S.term_table(spark, terms)), **more)


def test_tf_idf(spark, files, index):
    got = {r.file_id: r for r in search(spark, files, index, ["cache", "READER", "cache"]).collect()}
    assert got[1].score == pytest.approx(2 / 4 * math.log(5 / 2) * 2, abs=1e-9)
    assert (got[1].occurrences, got[1].terms_matched, got[2].terms_matched) == (4, 2, 1)
    assert [r.file_id for r in S.all_terms(search(spark, files, index, ["cache", "reader"]), 2).collect()] == [1]


def test_rarer_tokens_score_more(spark, files, index):
    score = lambda t, f: search(spark, files, index, [t]).where(F.col("file_id") == f).first().score
    assert score("writer", 3) > score("tile", 3)


def test_stem_bonus_and_other_scores(spark, files, index):
    plain, bonus = (search(spark, files, index, ["cache"], **m).orderBy("file_id").collect() for m in ({}, {"bonus": S.stem_bonus(["Cache"])}))
    assert bonus[0].score == pytest.approx(plain[0].score + 0.02 * math.log(5 / 2), abs=1e-9)
    assert bonus[1].score == plain[1].score
    for kind in ("bm25", "smoothed"):
        assert all(r.score > 0 for r in search(spark, files, index, ["cache"], score=kind).collect())


def test_expansions_agree(spark, index):
    vocab, terms = I.vocabulary(index), S.term_table(spark, ["ead", "ile"])
    assert rows(S.containing(vocab, terms)) == rows(S.containing_by_trigrams(vocab, terms)) == [(0, "reader"), (1, "tile")]
    assert rows(S.matching(vocab, ["TI.*|w.*r", "zzz"])) == [(0, "tile"), (0, "writer")]


@pytest.mark.parametrize("pattern", ["(?=a)b", r"(a)\1", "x" * 300])
def test_refused_patterns(pattern):
    with pytest.raises(ValueError, match="patterns"):
        S.token_pattern(pattern)


def test_pages(spark, files, index):
    result = search(spark, files, index, ["cache", "tile", "reader"])
    first, rest = (S.best(result, n, o).collect() for n, o in ((1, 0), (0, 1)))
    assert [r.rank for r in first + rest] == [1, 2, 3]
    assert [r.path for r in first + rest] == [r.path for r in result.orderBy(F.desc("score"), "path").collect()]
    with pytest.raises(ValueError, match="offset"):
        S.best(result, 1, 9)


def test_phrases_and_patterns(files):
    assert rows(S.per_file(S.phrase_lines(files, ["CACHE reader", "tile"]), "phrase_idx"), "file_id", "lines") == [(1, (1,)), (2, (1,)), (3, (1,))]
    assert rows(S.per_file(S.regex_lines(files, ["^cache", "r$"]), "pattern_idx", 2), "file_id") == [(1,)]
    assert rows(S.without(files.select("file_id"), S.regex_lines(files, ["cache"]))) == [(3,), (4,), (5,)]
    with pytest.raises(ValueError, match="no token"):
        S.phrase_lines(files, ["+-"])


@pytest.mark.parametrize(("pattern", "expected"), [("throw new \\w+Exception", ["throw new ", "Exception"]), ("a|bcd", []), ("(?:abc)+x?", ["abc"]), ("(abc)def", ["abc", "def"]), ("abc*def", ["def"])])
def test_needed_literals(pattern, expected):
    assert [x for x in S.literals(pattern) if len(x) >= 3] == expected


def test_auto_balance(spark):
    flood = [(i, f"f{i:03}", 0, 1, i / 1000) for i in range(150)] + [(0, "f000", 1, 1, 1.0), (200, "g", 1, 2, 0.5)]
    got = S.auto_balance(spark.createDataFrame(flood, "file_id long, path string, term_idx int, occ long, score double")).collect()
    assert {r.file_id for r in got} == {0, 200, *range(130, 150)}
    even = spark.createDataFrame(flood[-3:], "file_id long, path string, term_idx int, occ long, score double")
    assert S.auto_balance(even).count() == 3


def test_context_merges_neighbours(spark, files):
    text = spark.createDataFrame([(1, "\n".join(map(str, range(1, 21))))], "file_id long, text string")
    lines = I.file_lines(text)
    hits = lines.where("line in ('3', '6', '15')").select("file_id", "line_no")
    assert rows(S.context(hits, lines, 2, 1), "start_line", "n_lines", "n_matches") == [(1, 7, 2), (13, 4, 1)]


def test_tokens_are_pushed_to_the_scan(spark, data):
    from strataquery.plans.content import _prepared

    index = _prepared(spark, data)
    for terms, pushed in ((["cache"], "EqualTo(token,cache)"), (["cache", "tile"], "In(token, [cache,tile])")):
        plan = S.scored(index, S.exact(index.postings, S.term_table(spark, terms)))._jdf.queryExecution().toString()
        assert pushed in plan and "ReadSchema: struct<token:string,file_id:bigint,tf:bigint,df:bigint,token_count:bigint>" in plan


def test_requests_are_planned():
    assert S.split_terms(["a", "b c", "d-e"]) == (["a"], ["b c", "d-e"])
    with pytest.raises(ValueError, match="one kind"):
        S.split_terms(["a", "b c"], every=True)
    with pytest.raises(ValueError, match="scope"):
        S.inverted(None, None, scoped=False)
    with pytest.raises(ValueError, match="not counted"):
        S.inverted(None, None, scoped=True, count_only=True)
    assert S.stem_bonus(["a", "b"]) is None and S.stem_bonus(["a"], "substring") is None


def test_candidates_hold_all_matches(spark, files):
    for patterns, every in ((["cache.*reader"], False), (["writer", "tile$"], False), (["cache", "\\w+"], False), (["cache", "\\w+"], True), (["reader", "writer"], True)):
        left = {r.file_id for r in S.candidates(files.where("text is not null"), patterns, every).collect()}
        hits = S.per_file(S.regex_lines(files, patterns), "pattern_idx", len(patterns) if every else None)
        assert {r.file_id for r in hits.collect()} <= left


def test_results_are_shaped_to_a_budget(spark):
    rows_ = [(i, f"p{i}", list(range(20)), ["tok", "other"]) for i in range(1, 6)]
    df = spark.createDataFrame(rows_, "rank long, path string, lines array<int>, tokens array<string>")
    for budget, lines, tokens, n in ((10_000, 20, 2, 5), (600, 10, 2, 5), (250, 3, 2, 5), (130, 1, 2, 5), (90, 1, 1, 5), (40, 1, 1, 2), (5, None, None, 0)):
        got = S.shaped(df, budget).collect()
        assert len(got) == n and all((r.n_lines, r.n_tokens) == (lines, tokens) and r.bytes <= budget for r in got)


def test_many_tokens_are_joined(spark, files, index, monkeypatch):
    found = S.containing(I.vocabulary(index), S.term_table(spark, ["e"]))
    few = rows(I.narrowed(index, found), "file_id", "token")
    monkeypatch.setattr(I, "NAMED_TOKENS", 1)
    assert rows(I.narrowed(index, found), "file_id", "token") == few != []
