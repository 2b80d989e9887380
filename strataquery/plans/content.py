"""Queries of the content index and the retrieval modes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.functions import text as X
from strataquery.operators import index as I
from strataquery.operators import search as S
from strataquery.plans.skew import salted_join
from strataquery.sources import store
from strataquery.sources.tables import spread, table

# ---- inputs -------------------------------------------------------------------------------------


def _documents(spark, folder):
    return spread(table(spark, folder, "documents", F.col("doc_id").alias("file_id"), "text", F.coalesce("path", F.concat(F.lit("none/"), "doc_id")).alias("path")))


def _prepared(spark, folder):
    """The content index of the folder's postings and files, built when they are first searched or have changed."""
    rows, files = table(spark, folder, "postings", "token", "file_id", "lines"), table(spark, folder, "file_stats", "file_id", "path")
    return I.content_index(spark, "postings", [f"{folder}/postings.parquet", f"{folder}/file_stats.parquet"], rows, files)


def _prepared_documents(spark, folder):
    """The content index built from the texts themselves."""
    docs = _documents(spark, folder)
    rows = I.postings(docs).select("token", "file_id", "lines")
    return I.content_index(spark, "texts", [f"{folder}/documents.parquet"], rows, docs.select("file_id", "path"))


def _index(spark, folder):
    return _prepared(spark, folder).postings.select("token", "file_id", "tf")


def _files(spark, folder):
    return _prepared(spark, folder).listed


_IDX = """WITH kept AS (SELECT DISTINCT lower(token) AS token, file_id, lines FROM postings WHERE token IS NOT NULL AND file_id IS NOT NULL AND len(lines) > 0),
idx AS (SELECT token, file_id, sum(len(lines))::BIGINT AS tf FROM kept GROUP BY ALL),
counts AS (SELECT file_id, sum(tf)::BIGINT AS token_count FROM idx GROUP BY ALL),
files AS (SELECT file_id, min(path) AS path FROM file_stats WHERE file_id IS NOT NULL GROUP BY ALL),
df AS (SELECT token, count(*) AS df, sum(tf)::BIGINT AS total FROM idx GROUP BY ALL)"""
_DOCS = """WITH docs AS (SELECT doc_id AS file_id, text, coalesce(path, concat('none/', doc_id)) AS path FROM documents),
split AS (SELECT file_id, string_split_regex(text, '\\r?\\n') AS parts FROM docs WHERE text IS NOT NULL),
cut AS (SELECT file_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM split),
lines AS (SELECT file_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM cut)"""
_OCC = (
    _DOCS
    + """,
occ AS (SELECT file_id, line_no, unnest(list_transform(list_filter(regexp_extract_all(line, '[\\p{L}\\p{N}_\\x{0900}-\\x{0903}\\x{093A}\\x{093B}\\x{093E}-\\x{094C}\\x{094E}\\x{094F}\\x{0955}-\\x{0957}\\x{0962}\\x{0963}]+'),
    lambda t: length(t) >= 2), lambda t: lower(replace(regexp_replace(t, 'Σ$', 'ς'), 'İ', 'i̇')))) AS token FROM lines)"""
)

# ---- index --------------------------------------------------------------------------------------


def tokenize_count(spark, folder):
    return I.occurrences(_documents(spark, folder)).groupBy("file_id").agg(F.count("*").alias("n_tokens"))


def postings_build(spark, folder):
    built = I.postings(_documents(spark, folder))
    return built.select("token", "file_id", "tf", F.element_at("lines", 1).alias("first_line"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x).alias("line_sum"))


def index_totals(spark, folder):
    return I.occurrences(_documents(spark, folder)).agg(F.count("*").alias("total_tokens"), F.count_distinct("token").alias("unique_tokens"), F.count_distinct("file_id").alias("n_files"))


def token_df(spark, folder):
    return _prepared(spark, folder).vocabulary


def reverse_index(spark, folder):
    return _index(spark, folder).groupBy("file_id").agg(F.count("*").alias("n_tokens"), F.min("token").alias("first_token"), F.max("token").alias("last_token"))


def trigram_build(spark, folder):
    return I.trigram_index(_prepared(spark, folder).vocabulary).groupBy("trigram").agg(F.count("*").alias("n_tokens"))


def file_stems(spark, folder):
    return _files(spark, folder).select("file_id", X.stem(F.col("path")).alias("stem"), X.normal_stem(X.stem(F.col("path"))).alias("normal_stem"), X.extension(F.col("path")).alias("ext"))


# ---- tokens -------------------------------------------------------------------------------------


def _search(spark, folder, found, **options):
    index = _prepared(spark, folder)
    return S.scored(index, found(index), **options)


def _exact(spark, terms):
    return lambda index: S.exact(index.postings, S.term_table(spark, terms))


def tfidf_single(spark, folder):
    """One token: files whose name is the token get the bonus."""
    return S.best(_search(spark, folder, _exact(spark, ["cache"]), bonus=S.stem_bonus(["cache"])), 50)


def tfidf_multi_or(spark, folder):
    return _search(spark, folder, _exact(spark, ["cache", "lease", "Tile", "return", "cache"]))


def tfidf_multi_and(spark, folder):
    return S.all_terms(_search(spark, folder, _exact(spark, ["return", "string", "public"])), 3)


def stem_bonus(spark, folder):
    """A search for one token, all files; the bonus is for files whose name is the token, and for searches of one token only."""
    return _search(spark, folder, _exact(spark, ["Tile", "tile"]), bonus=S.stem_bonus(["Tile", "tile"]))


def tfidf_smoothed(spark, folder):
    return _search(spark, folder, _exact(spark, ["cache", "lease", "void"]), score="smoothed", bonus=S.stem_bonus(["cache", "lease", "void"]))


def tfidf_smoothed_single(spark, folder):
    return _search(spark, folder, _exact(spark, ["tile"]), score="smoothed", bonus=S.stem_bonus(["tile"]))


def bm25(spark, folder):
    return _search(spark, folder, _exact(spark, ["cache", "lease", "void"]), score="bm25", bonus=S.stem_bonus(["cache", "lease", "void"]))


def bm25_single(spark, folder):
    return _search(spark, folder, _exact(spark, ["tile"]), score="bm25", bonus=S.stem_bonus(["tile"]))


def substring_search(spark, folder):
    return _search(spark, folder, lambda i: S.containing(i.vocabulary, S.term_table(spark, ["cach", "lea", "qu"])))


def trigram_search(spark, folder):
    return _search(spark, folder, lambda i: S.containing_by_trigrams(i.vocabulary, S.term_table(spark, ["cach", "lea", "reserv"])))


def token_regex(spark, folder):
    return _search(spark, folder, lambda i: S.matching(i.vocabulary, ["re.*er", "un\\w+d|idle"]))


def token_regex_and(spark, folder):
    return S.all_terms(_search(spark, folder, lambda i: S.matching(i.vocabulary, ["re.*", "\\w*[0-9]+"])), 2)


def count_only(spark, folder):
    index = _prepared(spark, folder)
    hits = S.narrowed(index.postings, S.containing(index.vocabulary, S.term_table(spark, ["cache", "tile"]))).join(index.listed, "file_id")
    return hits.agg(F.count_distinct("file_id").alias("n_files"), F.sum("tf").alias("occurrences"))


def broad_terms(spark, folder):
    """Terms of a substring search with the tokens they reach, the too short ones marked."""
    return S.broad_terms(_prepared(spark, folder).vocabulary, S.term_table(spark, ["ca", "cach", "qu", "zzzz"]))


def files_only(spark, folder):
    return _search(spark, folder, _exact(spark, ["lease", "crane"])).select("path", "occurrences")


def invert_match(spark, folder):
    index = _prepared(spark, folder)
    scope = index.listed.where(X.in_scope(F.col("path"), "src", extensions=["cs", "ts"]))
    return S.inverted(scope, index.postings.where(F.col("token") == "return"), scoped=True)


def auto_balance(spark, folder):
    index = _prepared(spark, folder)
    hits = S.narrowed(index.postings, S.exact(index.postings, S.term_table(spark, ["return", "palette", "no_such_token"]))).join(index.listed, "file_id")
    score = S.tf_idf(F.col("tf"), F.col("token_count"), F.lit(index.n_files), F.col("df"))
    return S.auto_balance(hits.select("file_id", "path", "term_idx", F.col("tf").alias("occ"), score.alias("score")))


def scope_filters(spark, folder):
    hits = _search(spark, folder, _exact(spark, ["return", "cache"]))
    return hits.where(X.in_scope(F.col("path"), "SRC", files=["er", "cache"], extensions=["CS", "rs"], exclude_dirs=["cache", "tile"], exclude=["test"]))


def scope_coverage(spark, folder):
    path = F.col("path")
    return S.coverage(_files(spark, folder), _prepared(spark, folder).counts, X.in_scope(path, "src"), X.extension(path))


def page_offset(spark, folder):
    return S.best(_search(spark, folder, _exact(spark, ["string", "void"])), 15, 10)


def page_token(spark, folder):
    """The second page of ten by the token of the first; the token holds as long as request and index stay the same."""
    request, index = {"terms": ["string", "void"], "size": 10}, _prepared(spark, folder)
    epoch = index.total_tokens  # changes with the index
    token = store.page_token(epoch, 10, request)
    return S.best(_search(spark, folder, _exact(spark, request["terms"])), request["size"], store.page_from(token, epoch, request))


def logged_queries(spark, folder):
    """All logged requests scored again at once: query_id, file, score, occurrences, terms matched."""
    asked = table(spark, folder, "file_scores", "query_id", "terms").where("query_id is not null").distinct()
    terms = asked.select("query_id", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("token"))
    index = _prepared(spark, folder)
    # A stop word is in many requests and in many files: its postings are split, its requests repeated.
    sizes = index.vocabulary.select("token", F.col("df").alias("n"))
    hits = salted_join(index.postings, terms, ["token"], sizes, "n", F.xxhash64("file_id")).join(index.listed, "file_id")
    value = S.tf_idf(F.col("tf"), F.col("token_count"), F.lit(index.n_files), F.col("df"))
    return hits.groupBy("query_id", "file_id").agg(F.round(F.sum(value), 9).alias("score"), F.sum("tf").alias("occurrences"), F.count("*").alias("terms_matched"))


def response_shape(spark, folder):
    """A result with its lines and tokens cut to two budgets, lines first, then tokens, then files."""
    wanted = ["return", "string", "cache"]
    rows = table(spark, folder, "postings", "token", "file_id", "lines").where("file_id is not null and size(lines) > 0").where(F.lower("token").isin(wanted))
    per_file = rows.groupBy("file_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"), F.sort_array(F.collect_set(F.lower("token"))).alias("tokens"))
    top = S.page(per_file.join(_files(spark, folder), "file_id"), [F.desc(F.size("lines")), F.asc("path")], 40)
    parts = [S.shaped(top, budget).withColumn("budget", F.lit(budget)) for budget in (16384, 1200)]
    return parts[0].union(parts[1])


def response_budget(spark, folder):
    """Ranked files as long as their paths fit into 2 KiB together."""
    from pyspark.sql import Window

    ranked = S.best(_search(spark, folder, _exact(spark, ["string"])), 200)
    used = F.sum(F.octet_length("path") + 2).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", used).where("used <= 2048").select("rank", "path", "used")


# ---- lines --------------------------------------------------------------------------------------


def phrase_search(spark, folder):
    return S.per_file(S.phrase_lines(_documents(spark, folder), ["known gap"]), "phrase_idx").select("file_id", F.size("lines").alias("n_lines"), "occurrences")


def phrase_or(spark, folder):
    return S.per_file(S.phrase_lines(_documents(spark, folder), ["share a key", "Twice gives the"]), "phrase_idx").select("file_id", F.size("lines").alias("n_lines"), F.element_at("lines", 1).alias("first_line"))


def phrase_and(spark, folder):
    return S.per_file(S.phrase_lines(_documents(spark, folder), ["the same", "public "]), "phrase_idx", 2).select("file_id", F.size("lines").alias("n_lines"))


def mixed_terms(spark, folder):
    """Plain terms are tokens, others phrases; any of them matches."""
    return S.mixed(_prepared_documents(spark, folder), _documents(spark, folder), ["gauge", "known gap", "foo-bar", "lexer"])


def auto_phrase(spark, folder):
    """A request of phrases only, by the same planner."""
    return S.mixed(_prepared_documents(spark, folder), _documents(spark, folder), ["the same", "throw new"])


def phrase_rank(spark, folder):
    """Files with a phrase, most occurrences first."""
    docs = _documents(spark, folder)
    found = S.per_file(S.phrase_lines(docs, ["the same"]), "phrase_idx").join(docs.select("file_id", "path"), "file_id")
    return S.by_occurrences(found.select("file_id", "path", "occurrences"), 30)


def regex_rank(spark, folder):
    docs = _documents(spark, folder)
    found = S.per_file(S.regex_lines(docs, [r"^\s*return .*;$", r"^using "]), "pattern_idx").join(docs.select("file_id", "path"), "file_id")
    return S.by_occurrences(found.select("file_id", "path", "occurrences"), 30)


def line_regex_or(spark, folder):
    return S.per_file(S.regex_lines(_documents(spark, folder), [r"^\s*return .*;$", r"\bEXEC\b"]), "pattern_idx").select("file_id", F.size("lines").alias("n_lines"), "occurrences")


def line_regex_and(spark, folder):
    return S.per_file(S.regex_lines(_documents(spark, folder), [r"^using ", r"throw new \w+Exception"]), "pattern_idx", 2).select("file_id", F.size("lines").alias("n_lines"), "occurrences")


_THROWS = [r"throw new \w+Exception\(.*\);", r"raiserror *\(|RAISERROR *\("]


def literal_prefilter(spark, folder):
    return S.per_file(S.regex_lines(S.candidates(_documents(spark, folder), _THROWS[:1]), _THROWS[:1]), "pattern_idx").select("file_id", F.size("lines").alias("n_lines"), "occurrences")


def literal_prefilter_or(spark, folder):
    """Any of several patterns, after the literals they need."""
    patterns = [_THROWS[0], r"Subscribe\(\w+", r"CREATE +TABLE"]
    return S.per_file(S.regex_lines(S.candidates(_documents(spark, folder), patterns), patterns), "pattern_idx").select("file_id", F.size("lines").alias("n_lines"), "occurrences")


def literal_prefilter_and(spark, folder):
    """All of several patterns; one without literals restricts nothing beforehand."""
    patterns = [_THROWS[0], r"using System", r"\d+"]
    return S.per_file(S.regex_lines(S.candidates(_documents(spark, folder), patterns, every=True), patterns), "pattern_idx", 3).select("file_id", F.size("lines").alias("n_lines"), "occurrences")


def line_invert(spark, folder):
    docs = _documents(spark, folder)
    return S.without(docs.where(X.in_scope(F.col("path"), extensions=["cs"])).select("file_id", "path"), S.regex_lines(docs, [r"\breturn\b"]))


def context_islands(spark, folder):
    docs = _documents(spark, folder)
    return S.context(S.regex_lines(docs, [r"\bEXEC\b|^using "]), I.file_lines(docs), 2, 2)


def context_before_after(spark, folder):
    docs = _documents(spark, folder)
    return S.context(S.phrase_lines(docs, ["throw new"]), I.file_lines(docs), 3, 1)


def stale_lines(spark, folder):
    """Per file: lines of the index entry of a token, and those that still hold it."""
    docs = _documents(spark, folder)
    entries = I.postings(docs).where("token = 'return'").select("file_id", F.explode(F.array_distinct("lines")).alias("line_no"))
    now = I.file_lines(docs).where(F.rlike("line", F.lit("[a-z]")))
    kept = entries.join(now, ["file_id", "line_no"], "left").groupBy("file_id")
    return kept.agg(F.count("*").alias("indexed"), F.sum(F.coalesce(F.contains(F.lower("line"), F.lit("return")), F.lit(False)).cast("long")).alias("still_there"))


_NAMES = """tokenize_count postings_build index_totals token_df reverse_index trigram_build file_stems tfidf_single tfidf_multi_or tfidf_multi_and stem_bonus
tfidf_smoothed bm25 substring_search trigram_search token_regex token_regex_and count_only files_only invert_match auto_balance scope_filters scope_coverage
page_offset logged_queries response_budget phrase_search phrase_or phrase_and mixed_terms line_regex_or line_regex_and literal_prefilter line_invert
context_islands context_before_after stale_lines tfidf_smoothed_single bm25_single broad_terms page_token response_shape auto_phrase phrase_rank regex_rank literal_prefilter_or
literal_prefilter_and""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# ---- SQL ----------------------------------------------------------------------------------------

_TFIDF = "tf / greatest(token_count, 1) * ln((SELECT count(*) FROM files) / df)"


def _scored(found: str, value: str = _TFIDF) -> str:
    return f"""{_IDX}, vocab AS (SELECT token FROM df), found AS ({found}),
scored AS (SELECT file_id, path, round(sum({value}), 9) AS score, sum(tf)::BIGINT AS occurrences, count(DISTINCT term_idx) AS terms_matched
    FROM idx JOIN found USING (token) JOIN df USING (token) JOIN counts USING (file_id) JOIN files USING (file_id) GROUP BY ALL)
"""


def _terms(*terms: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(terms)) + ") t(token, term_idx)"


def _like(*terms: str) -> str:
    return f"SELECT vocab.token, term_idx FROM vocab JOIN ({_terms(*terms)}) t ON contains(vocab.token, t.token)"


_N = "(SELECT count(*) FROM files)"
_AVG = f"((SELECT sum(token_count) FROM counts) / {_N})"
_PATH = "regexp_extract(path, '[^/]*$')"
_STEM = f"regexp_replace({_PATH}, '(.)\\.[^.]*$', '\\1')"
_BONUS = "CASE WHEN lower(regexp_replace(" + _STEM + ", '[^\\p{{L}}\\p{{N}}]', '', 'g')) = '{0}' THEN 0.02 ELSE 0 END"
_IDF = f"(ln(({_N} + 1) / (df + 1)) + 1)"
_SMOOTHED = f"(ln(1 + tf) / ln(1 + greatest(token_count, 1)) / (ln(2) / ln(1 + {_AVG})) / {_AVG} + {{0}}) * {_IDF}"
_BM25 = f"ln(1 + greatest({_N} - df + 0.5, 0.0) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(token_count, 1) / {_AVG})) / {_AVG} + {{0}})"
_RANKED = "SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rank FROM scored"
_PHRASE = lambda *p: "(" + " OR ".join(f"contains(lower(line), '{x}')" for x in p) + ")"
_GROUPS = """, wanted AS (SELECT file_id, line_no, max(is_hit) AS is_hit FROM (SELECT file_id, unnest(generate_series(hit - {0}, hit + {1})) AS line_no, hit FROM hits) s,
    LATERAL (SELECT (hit = line_no)::INT AS is_hit) GROUP BY ALL),
shown AS (SELECT lines.*, is_hit, line_no - row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS island FROM lines JOIN wanted USING (file_id, line_no))
SELECT file_id, min(line_no) AS start_line, count(*) AS n_lines, sum(is_hit)::BIGINT AS n_matches, string_agg(line, chr(10) ORDER BY line_no) AS text FROM shown GROUP BY file_id, island"""

SQL = {
    "tokenize_count": f"{_OCC} SELECT file_id, count(*) AS n_tokens FROM occ GROUP BY ALL",
    "postings_build": f"{_OCC} SELECT token, file_id, count(*) AS tf, min(line_no)::INT AS first_line, sum(line_no)::BIGINT AS line_sum FROM occ GROUP BY ALL",
    "index_totals": f"{_OCC} SELECT count(*) AS total_tokens, count(DISTINCT token) AS unique_tokens, count(DISTINCT file_id) AS n_files FROM occ",
    "token_df": f"{_IDX} SELECT token, df, total FROM df",
    "reverse_index": f"{_IDX} SELECT file_id, count(*) AS n_tokens, min(token) AS first_token, max(token) AS last_token FROM idx GROUP BY ALL",
    "trigram_build": f"{_IDX} SELECT trigram, count(*) AS n_tokens FROM (SELECT DISTINCT token, substr(token, i, 3) AS trigram FROM (SELECT token, unnest(generate_series(1, length(token) - 2)) AS i FROM df)) GROUP BY ALL",
    "file_stems": f"{_IDX} SELECT file_id, {_STEM} AS stem, lower(regexp_replace({_STEM}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS normal_stem, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM files",
    "tfidf_single": _scored(_terms("cache"), f"(tf / greatest(token_count, 1) + {_BONUS.format('cache')}) * ln({_N} / df)") + f"SELECT * FROM ({_RANKED}) WHERE rank <= 50",
    "tfidf_multi_or": f"{_scored(_terms('cache', 'lease', 'tile', 'return'))} SELECT * FROM scored",
    "tfidf_multi_and": f"{_scored(_terms('return', 'string', 'public'))} SELECT * FROM scored WHERE terms_matched = 3",
    "stem_bonus": _scored(_terms("tile"), f"(tf / greatest(token_count, 1) + {_BONUS.format('tile')}) * ln({_N} / df)") + "SELECT * FROM scored",
    "tfidf_smoothed": _scored(_terms("cache", "lease", "void"), _SMOOTHED.format("0")) + "SELECT * FROM scored",
    "tfidf_smoothed_single": _scored(_terms("tile"), _SMOOTHED.format(_BONUS.format("tile"))) + "SELECT * FROM scored",
    "bm25": _scored(_terms("cache", "lease", "void"), _BM25.format("0")) + "SELECT * FROM scored",
    "bm25_single": _scored(_terms("tile"), _BM25.format(_BONUS.format("tile"))) + "SELECT * FROM scored",
    "broad_terms": f"{_IDX} SELECT term, count(token) AS n_tokens, length(term) < 4 AS broad FROM (VALUES ('ca'), ('cach'), ('qu'), ('zzzz')) t(term) LEFT JOIN df ON contains(token, term) GROUP BY term",
    "page_token": f"{_scored(_terms('string', 'void'))} SELECT * FROM ({_RANKED}) WHERE rank > 10 AND rank <= 20",
    "auto_phrase": f"""{_DOCS}, found AS (SELECT p, file_id, count(*) AS occ FROM lines JOIN (VALUES ('the same'), ('throw new')) v(p) ON contains(lower(line), p) GROUP BY ALL),
phrases AS (SELECT file_id, greatest(ln((SELECT count(*) FROM docs) / count(*) OVER (PARTITION BY p)), 1.0) * occ AS score, occ FROM found)
SELECT file_id, round(sum(score), 9) AS score, sum(occ)::BIGINT AS occurrences FROM phrases GROUP BY ALL""",
    "phrase_rank": f"""{_DOCS} SELECT file_id, path, occurrences, row_number() OVER (ORDER BY occurrences DESC, path) AS rank FROM (SELECT file_id, path, count(*) AS occurrences FROM lines JOIN docs USING (file_id)
    WHERE {_PHRASE('the same')} GROUP BY ALL) ORDER BY occurrences DESC, path LIMIT 30""",
    "regex_rank": f"""{_DOCS} SELECT file_id, path, occurrences, row_number() OVER (ORDER BY occurrences DESC, path) AS rank FROM (SELECT file_id, path, count(*) AS occurrences FROM lines JOIN docs USING (file_id)
    JOIN (VALUES ('^\\s*return .*;$'), ('^using ')) v(p) ON regexp_matches(line, p) GROUP BY ALL) ORDER BY occurrences DESC, path LIMIT 30""",
    "literal_prefilter_or": f"{_DOCS} SELECT file_id, count(DISTINCT line_no)::INT AS n_lines, count(*) AS occurrences FROM lines JOIN (VALUES ('throw new \\w+Exception\\(.*\\);'), ('Subscribe\\(\\w+'), ('CREATE +TABLE')) v(p) ON regexp_matches(line, p) GROUP BY ALL",
    "literal_prefilter_and": f"{_DOCS} SELECT file_id, count(DISTINCT line_no)::INT AS n_lines, count(*) AS occurrences FROM lines JOIN (VALUES ('throw new \\w+Exception\\(.*\\);'), ('using System'), ('\\d+')) v(p) ON regexp_matches(line, p) GROUP BY ALL HAVING count(DISTINCT p) = 3",
    "response_shape": f"""{_IDX}, r AS (SELECT file_id, lower(token) AS token, lines FROM postings WHERE file_id IS NOT NULL AND len(lines) > 0 AND lower(token) IN ('return', 'string', 'cache')),
per AS (SELECT file_id, list_sort(list_distinct(flatten(list(lines)))) AS lines, list_sort(list_distinct(list(token))) AS tokens FROM r GROUP BY ALL),
top AS (SELECT path, lines, tokens, row_number() OVER (ORDER BY len(lines) DESC, path) AS rank FROM per JOIN files USING (file_id) QUALIFY rank <= 40),
cuts AS (SELECT * FROM (VALUES (0, 1000000, 1000000), (1, 10, 1000000), (2, 3, 1000000), (3, 1, 1000000), (4, 1, 1)) v(phase, n, m)),
shown AS (SELECT phase, rank, path, lines[:n] AS lines, tokens[:m] AS tokens FROM top, cuts),
cost AS (SELECT *, strlen(path) + 8 * len(lines) + list_sum(list_transform(tokens, lambda t: strlen(t) + 3)) AS c FROM shown),
picked AS (SELECT budget, coalesce(min(phase) FILTER (total <= budget), 4) AS phase FROM (SELECT phase, sum(c) AS total FROM cost GROUP BY ALL), (VALUES (16384), (1200)) b(budget) GROUP BY budget)
SELECT * FROM (SELECT rank, path, len(lines)::INT AS n_lines, len(tokens)::INT AS n_tokens, (sum(c) OVER (PARTITION BY budget ORDER BY rank))::BIGINT AS bytes, budget FROM cost JOIN picked USING (phase)) WHERE bytes <= budget""",
    "substring_search": _scored(_like("cach", "lea", "qu")) + "SELECT * FROM scored",
    "trigram_search": _scored(_like("cach", "lea", "reserv")) + "SELECT * FROM scored",
    "token_regex": _scored("SELECT token, 0 AS term_idx FROM vocab WHERE regexp_full_match(token, 're.*er') UNION ALL SELECT token, 1 FROM vocab WHERE regexp_full_match(token, 'un\\w+d|idle')") + "SELECT * FROM scored",
    "token_regex_and": _scored("SELECT token, 0 AS term_idx FROM vocab WHERE regexp_full_match(token, 're.*') UNION ALL SELECT token, 1 FROM vocab WHERE regexp_full_match(token, '\\w*[0-9]+')") + "SELECT * FROM scored WHERE terms_matched = 2",
    "count_only": f"{_IDX}, vocab AS (SELECT token FROM df), found AS ({_like('cache', 'tile')}) SELECT count(DISTINCT file_id) AS n_files, sum(tf)::BIGINT AS occurrences FROM idx JOIN found USING (token) JOIN files USING (file_id)",
    "files_only": _scored(_terms("lease", "crane")) + "SELECT path, occurrences FROM scored",
    "invert_match": f"{_IDX} SELECT * FROM files WHERE starts_with(lower(path), 'src/') AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('cs', 'ts') AND file_id NOT IN (SELECT file_id FROM idx WHERE token = 'return')",
    "auto_balance": f"""{_IDX}, found AS ({_terms('return', 'palette')}),
hits AS (SELECT file_id, path, term_idx, tf, {_TFIDF} AS score FROM idx JOIN found USING (token) JOIN df USING (token) JOIN counts USING (file_id) JOIN files USING (file_id)),
totals AS (SELECT term_idx, sum(tf) AS occ FROM hits GROUP BY ALL),
plan AS (SELECT arg_max(term_idx, (occ, term_idx)) AS dominant, max(occ) AS most, min(occ) AS least, coalesce((SELECT occ FROM totals ORDER BY occ DESC, term_idx DESC LIMIT 1 OFFSET 1), 0) AS second, count(*) AS terms FROM totals),
merged AS (SELECT file_id, path, round(sum(score), 9) AS score, sum(tf)::BIGINT AS occurrences, count(DISTINCT term_idx) AS terms_matched, min(term_idx) AS only_term FROM hits GROUP BY ALL),
judged AS (SELECT merged.*, terms >= 2 AND most >= least * 10 AND terms_matched = 1 AND only_term = dominant AS flood, least(greatest(second * 2, 20), 100) AS cap FROM merged, plan)
SELECT file_id, path, score, occurrences, terms_matched FROM judged QUALIFY NOT flood OR row_number() OVER (PARTITION BY flood ORDER BY score DESC, path) <= cap""",
    "scope_filters": _scored(_terms("return", "cache"))
    + """SELECT * FROM scored WHERE starts_with(lower(path), 'src/') AND (contains(lower(path), 'er') OR contains(lower(path), 'cache')) AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('cs', 'rs')
    AND NOT (contains(lower(path), '/cache/') OR starts_with(lower(path), 'cache/')) AND NOT (contains(lower(path), '/tile/') OR starts_with(lower(path), 'tile/')) AND NOT contains(lower(path), 'test')""",
    "scope_coverage": f"""{_IDX}, flagged AS (SELECT path, file_id IN (SELECT file_id FROM idx) AS known, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM files WHERE starts_with(lower(path), 'src/'))
SELECT count(*) AS matched, count(*) FILTER (known) AS indexed, count(*) FILTER (NOT known) AS unindexed, coalesce(string_agg(DISTINCT ext, ',' ORDER BY ext) FILTER (NOT known), '') AS unindexed_extensions FROM flagged""",
    "page_offset": f"{_scored(_terms('string', 'void'))} SELECT * FROM ({_RANKED}) WHERE rank > 10 AND rank <= 25",
    "logged_queries": f"""{_IDX}, asked AS (SELECT DISTINCT query_id, terms FROM file_scores WHERE query_id IS NOT NULL),
terms AS (SELECT query_id, unnest(list_distinct(list_transform(terms, lambda t: lower(t)))) AS token FROM asked)
SELECT query_id, file_id, round(sum({_TFIDF}), 9) AS score, sum(tf)::BIGINT AS occurrences, count(*) AS terms_matched
FROM idx JOIN terms USING (token) JOIN df USING (token) JOIN counts USING (file_id) JOIN files USING (file_id) GROUP BY ALL""",
    "response_budget": f"{_scored(_terms('string'))} SELECT rank, path, used FROM (SELECT *, sum(strlen(path) + 2) OVER (ORDER BY rank)::BIGINT AS used FROM ({_RANKED}) WHERE rank <= 200) WHERE used <= 2048",
    "phrase_search": f"{_DOCS} SELECT file_id, count(*)::INT AS n_lines, count(*) AS occurrences FROM lines WHERE {_PHRASE('known gap')} GROUP BY ALL",
    "phrase_or": f"{_DOCS} SELECT file_id, count(*)::INT AS n_lines, min(line_no)::INT AS first_line FROM lines WHERE {_PHRASE('share a key', 'twice gives the')} GROUP BY ALL",
    "phrase_and": f"{_DOCS} SELECT file_id, count(*)::INT AS n_lines FROM lines WHERE {_PHRASE('the same', 'public ')} GROUP BY ALL HAVING bool_or({_PHRASE('the same')}) AND bool_or({_PHRASE('public ')})",
    "mixed_terms": f"""{_OCC}, tf AS (SELECT token, file_id, count(*) AS tf FROM occ GROUP BY ALL), n AS (SELECT file_id, count(*) AS token_count FROM occ GROUP BY ALL),
hits AS (SELECT file_id, tf / token_count * ln((SELECT count(*) FROM docs) / count(*) OVER (PARTITION BY token)) AS score, tf AS occ FROM tf JOIN n USING (file_id) WHERE token IN ('gauge', 'lexer')),
found AS (SELECT p, file_id, count(*) AS occ FROM lines JOIN (VALUES ('known gap'), ('foo-bar')) v(p) ON contains(lower(line), p) GROUP BY ALL),
phrases AS (SELECT file_id, greatest(ln((SELECT count(*) FROM docs) / count(*) OVER (PARTITION BY p)), 1.0) * occ AS score, occ FROM found)
SELECT file_id, round(sum(score), 9) AS score, sum(occ)::BIGINT AS occurrences FROM (SELECT * FROM hits UNION ALL SELECT * FROM phrases) GROUP BY ALL""",
    "line_regex_or": f"{_DOCS} SELECT file_id, count(DISTINCT line_no)::INT AS n_lines, count(*) AS occurrences FROM lines JOIN (VALUES ('^\\s*return .*;$'), ('\\bEXEC\\b')) v(p) ON regexp_matches(line, p) GROUP BY ALL",
    "line_regex_and": f"{_DOCS} SELECT file_id, count(DISTINCT line_no)::INT AS n_lines, count(*) AS occurrences FROM lines JOIN (VALUES ('^using '), ('throw new \\w+Exception')) v(p) ON regexp_matches(line, p) GROUP BY ALL HAVING count(DISTINCT p) = 2",
    "literal_prefilter": f"{_DOCS} SELECT file_id, count(*)::INT AS n_lines, count(*) AS occurrences FROM lines WHERE regexp_matches(line, 'throw new \\w+Exception\\(.*\\);') GROUP BY ALL",
    "line_invert": f"{_DOCS} SELECT file_id, path FROM docs WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) = 'cs' AND file_id NOT IN (SELECT file_id FROM lines WHERE regexp_matches(line, '\\breturn\\b'))",
    "context_islands": f"{_DOCS}, hits AS (SELECT file_id, line_no AS hit FROM lines WHERE regexp_matches(line, '\\bEXEC\\b|^using '))" + _GROUPS.format(2, 2),
    "context_before_after": f"{_DOCS}, hits AS (SELECT file_id, line_no AS hit FROM lines WHERE {_PHRASE('throw new')})" + _GROUPS.format(3, 1),
    "stale_lines": f"""{_OCC}, entries AS (SELECT DISTINCT file_id, line_no FROM occ WHERE token = 'return')
SELECT file_id, count(*) AS indexed, count(*) FILTER (contains(lower(line), 'return') AND regexp_matches(line, '[a-z]')) AS still_there FROM entries JOIN lines USING (file_id, line_no) GROUP BY ALL""",
}
