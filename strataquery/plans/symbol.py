"""Queries over definitions, files and call graphs, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions import text as X
from strataquery.operators import graph as G
from strataquery.operators import index as I
from strataquery.operators import symbols as Y
from strataquery.plans.content import _IDX, _files, _index, _prepared
from strataquery.sources.tables import table

_COLUMNS = ("def_id", "file_id", "name", "kind", "line_start", "line_end", "parent", "attributes", "base_types")


def _defs(spark, folder, *columns):
    return Y.once(table(spark, folder, "definitions", *(columns or _COLUMNS)))


def _placed(spark, folder, *columns):
    return _defs(spark, folder, *columns).join(_files(spark, folder), "file_id")


def _stats(spark, folder):
    return Y.latest_stats(table(spark, folder, "code_stats", "def_id", "cyclomatic_complexity", "cognitive_complexity", "max_nesting_depth", "param_count", "return_count", "call_count", "lambda_count", "parsed_at"))


# ---- filters and ranking ------------------------------------------------------------------------


def def_filter_kind_parent(spark, folder):
    rows = _placed(spark, folder, "def_id", "file_id", "name", "kind", "parent")
    return rows.where(Y.kinds("method", "property", "constructor") & Y.any_contains("parent", ["cache", "tile"]) & Y.any_contains("path", [".cs", ".ts"])).select("def_id", "name", "kind", "path")


def def_attribute(spark, folder):
    return _defs(spark, folder).where(Y.has_attribute("Route")).select("def_id", "name", F.size("attributes").alias("n_attributes"))


def def_base_direct(spark, folder):
    return _defs(spark, folder).where(Y.has_base("anchor")).select("def_id", "name", F.array_join("base_types", ",").alias("bases"))


def transitive_bases(spark, folder):
    """Names whose base types lead to a seed in at most nine steps, with the least number of steps."""
    defs = _defs(spark, folder, "def_id", "name", "base_types")
    edges = defs.select(F.lower("name").alias("dst"), F.explode(F.transform("base_types", Y.base_name)).alias("src")).where("src <> dst").distinct()
    seeds = defs.where(Y.has_base("anchor")).select(F.lit(1).alias("root"), F.lower("name").alias("node")).distinct()
    return G.reach(edges, seeds, 9).groupBy(F.col("node").alias("name")).agg(F.min("depth").cast("long").alias("steps"))


def def_name_modes(spark, folder):
    """The same request by substring, exact name and pattern."""
    rows = _defs(spark, folder, "def_id", "name")
    term = Y.first_term(["cache", "reader"])
    return rows.where(term.isNotNull() | F.rlike("name", F.lit("^(Get|Read)[A-Z]"))).select(
        "def_id", "name", term.alias("term"), (F.lower("name").isin("cache", "reader")).alias("exact"), F.rlike("name", F.lit("^(Get|Read)[A-Z]")).alias("by_pattern")
    )


def def_tier_rank(spark, folder):
    rows = _defs(spark, folder, "def_id", "name", "kind", "parent").where(Y.any_contains("name", ["cache", "cachereader"]))
    order = Y.relevance(["cache", "cachereader"])
    top = rows.orderBy(*order).limit(60)
    return top.select("def_id", "name", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def def_parent_rank(spark, folder):
    """Ranked by how well the holder's name fits, then the own name: the holder's tier comes first."""
    rows = _defs(spark, folder, "def_id", "name", "kind", "parent").where(Y.any_contains("name", ["read", "get"]) & Y.any_contains("parent", ["cache", "tile"]))
    order = Y.relevance(["read", "get"], ["cache", "tile"])
    return rows.orderBy(*order).limit(60).select("def_id", "name", "parent", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def def_exclude_dir(spark, folder):
    """Definitions of a scope without some of its folders."""
    rows = _placed(spark, folder, "def_id", "file_id", "name", "kind")
    return rows.where(Y.kinds("class", "interface") & X.in_scope(F.col("path"), "src", extensions=["cs", "ts"], exclude_dirs=["cache", "tile"], exclude=["test"])).select("def_id", "name", "path")


def def_stats_threshold(spark, folder):
    rows = _defs(spark, folder, "def_id", "file_id", "name").join(_stats(spark, folder), "def_id")
    return rows.where("cyclomatic_complexity >= 20 and max_nesting_depth >= 3 and param_count >= 2").select("def_id", "name", "cyclomatic_complexity", "cognitive_complexity")


def def_metric_sort(spark, folder):
    """The 50 first definitions by each of the eight metrics."""
    defs, stats = _defs(spark, folder, "def_id", "name", "line_start", "line_end"), _stats(spark, folder)
    parts = [Y.by_metric(defs, stats, m, 50).withColumn("metric_name", F.lit(m)) for m in Y.METRICS]
    return functools.reduce(DataFrame.union, parts)


def code_stats_latest(spark, folder):
    return _stats(spark, folder).groupBy("max_nesting_depth").agg(F.count("*").alias("n"), F.sum("cyclomatic_complexity").alias("cyclomatic"), F.sum("cognitive_complexity").alias("cognitive"))


def contains_line(spark, folder):
    """All definitions around each of four lines of every file, smallest first; and the same for methods of some holders."""
    defs = _defs(spark, folder, "def_id", "file_id", "kind", "parent", "line_start", "line_end")
    points = _files(spark, folder).select("file_id", F.explode(F.array(*map(F.lit, (1, 40, 120, 400)))).alias("line"))
    met = Y.covering(points, defs)
    place = F.row_number().over(Window.partitionBy("file_id", "line", "filtered").orderBy(F.col("line_end") - F.col("line_start"), "def_id"))
    some = met.where(Y.kinds("method", "constructor") & Y.any_contains("parent", ["cache", "tile", "view"]))
    every = met.withColumn("filtered", F.lit(False)).union(some.withColumn("filtered", F.lit(True)))
    return every.select("file_id", "line", "filtered", "def_id", (F.col("line_end") - F.col("line_start")).alias("span"), place.cast("long").alias("place"))


def innermost_span(spark, folder):
    """For every definition's first line the innermost callable around it."""
    defs = _defs(spark, folder, "def_id", "file_id", "kind", "line_start", "line_end").where("file_id is not null")
    points = defs.select(F.col("def_id").alias("point_id"), "file_id", F.col("line_start").alias("line"))
    return Y.innermost(points, defs.where(F.col("kind").isin(*Y.CALLABLE_KINDS)).select("def_id", "file_id", "line_start", "line_end"), ["point_id"])


def term_breakdown(spark, folder):
    terms = ["cache", "tile", "zzz", "reader"]
    found = _defs(spark, folder, "def_id", "name").withColumn("term_idx", Y.first_term(terms)).where("term_idx is not null").groupBy("term_idx").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame(list(enumerate(terms)), "term_idx int, term string")
    return asked.join(found, "term_idx", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def missing_terms(spark, folder):
    """Terms no class matches, and whether another kind does."""
    terms = ["cache", "zzz", "attach"]
    rows = _defs(spark, folder, "def_id", "name", "kind")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    met = rows.join(F.broadcast(asked), F.contains(F.lower("name"), F.col("term"))).groupBy("term").agg(F.sum((F.col("kind") == "enum").cast("long")).alias("wanted"), F.count("*").alias("others"))
    reason = F.when(F.col("others").isNull(), "not in the index").otherwise("other kinds only")
    return asked.join(met, "term", "left").where("coalesce(wanted, 0) = 0").select("term", reason.alias("reason"))


def usage_count(spark, folder):
    """Files whose text uses the name as a token."""
    vocab = _prepared(spark, folder).vocabulary.select(F.col("token"), "df")
    return _defs(spark, folder, "def_id", "name").join(vocab, F.lower("name") == F.col("token"), "left").select("def_id", F.coalesce("df", F.lit(0)).alias("usages"))


def auto_summary(spark, folder):
    rows = _placed(spark, folder, "def_id", "file_id", "name", "kind", "line_start", "line_end").withColumn("folder", F.concat_ws("/", F.slice(F.split(X.directory(F.col("path")), "/"), 1, 2)))
    return Y.summary(rows)


def kind_correct(spark, folder):
    """A request without results: the same without its kind, counted per kind."""
    rows = _defs(spark, folder, "def_id", "name", "kind").where(Y.any_contains("name", ["attach"]))
    asked = rows.where(Y.kinds("enum"))
    counts = rows.groupBy("kind").agg(F.count("*").alias("n"))
    return counts.withColumn("asked", asked.agg(F.count("*")).scalar()).where("asked = 0").select("kind", "n")


def name_autocorrect(spark, folder):
    asked = spark.createDataFrame([("CacheRaeder",), ("FactoryServise",), ("Atach",), ("zzzzqqqq",)], "asked string")
    return Y.corrected(_defs(spark, folder, "def_id", "name"), asked)


def value_source(spark, folder):
    """String literals in attributes of properties and fields."""
    rows = _defs(spark, folder, "def_id", "kind", "attributes").where(Y.kinds("property", "field"))
    return rows.select("def_id", F.explode("attributes").alias("a")).select("def_id", F.explode(F.regexp_extract_all("a", F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)).alias("value")).distinct()


def audit_empty(spark, folder):
    """Files with tokens but without definitions."""
    counts = _prepared(spark, folder).counts.where("token_count > 20")
    return _files(spark, folder).join(counts, "file_id").join(_defs(spark, folder, "def_id", "file_id").select("file_id"), "file_id", "left_anti").select("file_id", "path", "token_count")


def cross_validate(spark, folder):
    """Files of the list without definitions, and definitions' files that are not in the list."""
    files, defs = _files(spark, folder).select("file_id"), _defs(spark, folder, "def_id", "file_id").where("file_id is not null").select("file_id").distinct()
    one = files.join(defs, "file_id", "left_anti").select("file_id", F.lit("no definitions").alias("side"))
    return one.union(defs.join(files, "file_id", "left_anti").select("file_id", F.lit("not listed").alias("side")))


def test_definitions(spark, folder):
    rows = _placed(spark, folder, "def_id", "file_id", "attributes")
    return rows.where(Y.is_test(F.col("path"))).select("def_id", Y.is_test_file(F.col("path")).alias("in_test_file"))


def selector_status(spark, folder):
    """Base types as selectors of the components that carry their names."""
    defs = _defs(spark, folder, "def_id", "name", "kind", "base_types")
    edges = defs.select("def_id", F.explode("base_types").alias("child"))
    return G.selector_status(edges, defs.where(Y.kinds("class", "interface")).select(F.col("def_id").alias("component"), F.col("name").alias("selector")))


# ---- files --------------------------------------------------------------------------------------


def file_name_rank(spark, folder):
    stem = X.stem(F.col("path"))
    rows = _files(spark, folder).where(F.contains(F.lower(X.basename(F.col("path"))), F.lit("tile")))
    order = [X.match_tier(stem, ["tile"]), F.char_length(stem), F.col("path")]
    return rows.orderBy(*order).limit(40).select("path", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def glob_search(spark, folder):
    return _files(spark, folder).where(F.rlike(X.basename(F.col("path")), F.lit(X.glob_pattern("*Ca?he*.cs"))) | F.rlike(X.basename(F.col("path")), F.lit(X.glob_pattern("Tile*")))).select("file_id", "path")


def file_filters(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "path", "n_chars").where("path is not null")
    depth = F.size(F.split("path", "/"))
    return docs.where(F.rlike(X.basename(F.col("path")), F.lit("^[A-F]")) & X.extension(F.col("path")).isin("cs", "md") & (depth <= 3) & F.col("n_chars").between(200, 4000)).select("doc_id", "path", depth.alias("depth"))


def dir_file_counts(spark, folder):
    """Every directory with the number of files anywhere below it."""
    parts = F.split(X.directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return _files(spark, folder).where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_files"))


# ---- references ---------------------------------------------------------------------------------


def grep_refs(spark, folder):
    """Files that use a defined class name as a token but do not define it, compared by whole id."""
    names = _defs(spark, folder, "def_id", "file_id", "name", "kind").where(Y.kinds("class") & F.col("file_id").isNotNull()).select(F.lower("name").alias("token"), "file_id").distinct()
    used = _index(spark, folder).join(names.select("token").distinct(), "token", "left_semi")
    return used.join(names, ["token", "file_id"], "left_anti").groupBy("token").agg(F.count("*").alias("n_files"))


def fuzzy_interface(spark, folder):
    """Interfaces I<name> and classes that follow their names, by the first letters both share."""
    defs = _defs(spark, folder, "def_id", "name", "kind")
    classes = defs.where(Y.kinds("class")).select("name").distinct()
    asked = spark.createDataFrame([("ICacheReader",), ("ITile",), ("IFactoryServiceHub",), ("Iface",)], "interface string")
    return classes.join(F.broadcast(asked), G.implements(F.col("name"), F.col("interface"))).select("interface", "name")


_NAMES = """def_filter_kind_parent def_parent_rank def_exclude_dir def_attribute def_base_direct transitive_bases def_name_modes def_tier_rank def_stats_threshold def_metric_sort code_stats_latest contains_line
innermost_span term_breakdown missing_terms usage_count auto_summary kind_correct name_autocorrect value_source audit_empty cross_validate test_definitions selector_status
file_name_rank glob_search file_filters dir_file_counts grep_refs fuzzy_interface""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# ---- SQL ----------------------------------------------------------------------------------------

_D = "WITH d AS (SELECT DISTINCT def_id, file_id, name, kind, line_start, line_end, parent, attributes, base_types FROM definitions WHERE def_id IS NOT NULL)"
_F = ", f AS (SELECT file_id, min(path) AS path FROM file_stats WHERE file_id IS NOT NULL GROUP BY ALL)"
_S = """, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY def_id ORDER BY parsed_at DESC NULLS LAST, cyclomatic_complexity DESC NULLS LAST, cognitive_complexity DESC NULLS LAST, max_nesting_depth DESC NULLS LAST, param_count DESC NULLS LAST, return_count DESC NULLS LAST, call_count DESC NULLS LAST, lambda_count DESC NULLS LAST) AS age FROM code_stats WHERE def_id IS NOT NULL) WHERE age = 1)"""
_ATTR = "lower(regexp_extract(trim(regexp_replace(regexp_replace({0}, '\\(.*$', ''), '<.*$', '')), '([^.:]*)[.:]*$', 1))"
_BASE = "lower(trim(split_part(b, '<', 1)))"
_TIER = "CASE WHEN lower({0}) = '{1}' THEN 0 WHEN starts_with(lower({0}), '{1}') THEN 1 ELSE 2 END"
_TIERS = ", ".join("CASE WHEN lower({0}) = '{%d}' THEN 0 WHEN starts_with(lower({0}), '{%d}') THEN 1 WHEN contains(lower({0}), '{%d}') THEN 2 ELSE 3 END" % (i, i, i) for i in (1, 2))
_TYPE = "CASE WHEN kind IN ('class', 'interface', 'enum', 'struct', 'record') THEN 0 ELSE 1 END"
_BASENAME = "regexp_extract(path, '[^/]*$')"
_STEM = f"regexp_replace({_BASENAME}, '(.)\\.[^.]*$', '\\1')"
_BARE = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(parent, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '<.*$', ''), '^.*(\.|::)', ''), '^\s+|\s+$', '', 'g')), '')"

SQL = {
    "def_filter_kind_parent": f"""{_D}{_F} SELECT def_id, name, kind, path FROM d JOIN f USING (file_id) WHERE kind IN ('method', 'property', 'constructor')
        AND (contains(lower(parent), 'cache') OR contains(lower(parent), 'tile')) AND (contains(lower(path), '.cs') OR contains(lower(path), '.ts'))""",
    "def_attribute": f"{_D} SELECT def_id, name, len(attributes)::INT AS n_attributes FROM d WHERE len(list_filter(attributes, lambda a: {_ATTR.format('a')} = 'route')) > 0",
    "def_base_direct": f"{_D} SELECT def_id, name, array_to_string(base_types, ',') AS bases FROM d WHERE len(list_filter(base_types, lambda b: contains(lower(b), 'anchor'))) > 0",
    "transitive_bases": f"""{_D.replace('WITH d', 'WITH RECURSIVE d')}, e AS (SELECT DISTINCT lower(name) AS name, {_BASE} AS base FROM (SELECT name, unnest(base_types) AS b FROM d)),
        walk AS (SELECT DISTINCT lower(name) AS name, 0 AS steps FROM d WHERE len(list_filter(base_types, lambda b: contains(lower(b), 'anchor'))) > 0
        UNION SELECT e.name, steps + 1 FROM walk JOIN e ON e.base = walk.name AND e.name <> e.base WHERE steps < 9) SELECT name, min(steps)::BIGINT AS steps FROM walk GROUP BY ALL""",
    "def_name_modes": f"""{_D}, t AS (SELECT def_id, name, CASE WHEN contains(lower(name), 'cache') THEN 0 WHEN contains(lower(name), 'reader') THEN 1 END AS term, lower(name) IN ('cache', 'reader') AS exact,
        regexp_matches(name, '^(Get|Read)[A-Z]') AS by_pattern FROM d) SELECT * FROM t WHERE term IS NOT NULL OR by_pattern""",
    "def_tier_rank": f"""{_D} SELECT * FROM (SELECT def_id, name, row_number() OVER (ORDER BY least({_TIER.format('name', 'cache')}, {_TIER.format('name', 'cachereader')}), {_TYPE}, strlen(name), name, def_id) AS rank
        FROM d WHERE contains(lower(name), 'cache')) WHERE rank <= 60""",
    "def_parent_rank": f"""{_D} SELECT * FROM (SELECT def_id, name, parent, row_number() OVER (ORDER BY least({_TIERS.format('parent', 'cache', 'tile')}), least({_TIERS.format('name', 'read', 'get')}), {_TYPE}, strlen(name), name, def_id) AS rank
        FROM d WHERE (contains(lower(name), 'read') OR contains(lower(name), 'get')) AND (contains(lower(parent), 'cache') OR contains(lower(parent), 'tile'))) WHERE rank <= 60""",
    "def_exclude_dir": f"""{_D}{_F} SELECT def_id, name, path FROM d JOIN f USING (file_id) WHERE kind IN ('class', 'interface') AND starts_with(lower(path), 'src/') AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('cs', 'ts')
        AND NOT (contains(lower(path), '/cache/') OR starts_with(lower(path), 'cache/')) AND NOT (contains(lower(path), '/tile/') OR starts_with(lower(path), 'tile/')) AND NOT contains(lower(path), 'test')""",
    "def_stats_threshold": f"{_D}{_S} SELECT def_id, name, cyclomatic_complexity, cognitive_complexity FROM d JOIN s USING (def_id) WHERE cyclomatic_complexity >= 20 AND max_nesting_depth >= 3 AND param_count >= 2",
    "def_metric_sort": f"""{_D}{_S}, m AS (SELECT def_id, name, metric, metric_name FROM (SELECT def_id, name, line_start, line_end, coalesce(cyclomatic_complexity, 0) AS cyclomatic_complexity, coalesce(cognitive_complexity, 0) AS cognitive_complexity,
        coalesce(max_nesting_depth, 0) AS max_nesting_depth, coalesce(param_count, 0) AS param_count, coalesce(return_count, 0) AS return_count, coalesce(call_count, 0) AS call_count, coalesce(lambda_count, 0) AS lambda_count,
        greatest(line_end - line_start, 0) + 1 AS lines FROM d LEFT JOIN s USING (def_id)) UNPIVOT (metric FOR metric_name IN (cyclomatic_complexity, cognitive_complexity, max_nesting_depth, param_count, return_count, call_count, lambda_count, lines)))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY metric DESC, def_id) AS rank FROM m) WHERE rank <= 50""",
    "code_stats_latest": f"{_D}{_S} SELECT max_nesting_depth, count(*) AS n, sum(cyclomatic_complexity)::BIGINT AS cyclomatic, sum(cognitive_complexity)::BIGINT AS cognitive FROM s GROUP BY ALL",
    "contains_line": f"""{_D}{_F}, m AS (SELECT file_id, line, def_id, line_end - line_start AS span, kind, parent FROM d JOIN f USING (file_id), (VALUES (1), (40), (120), (400)) v(line) WHERE line BETWEEN line_start AND line_end),
        e AS (SELECT *, false AS filtered FROM m UNION ALL SELECT *, true FROM m WHERE kind IN ('method', 'constructor') AND (contains(lower(parent), 'cache') OR contains(lower(parent), 'tile') OR contains(lower(parent), 'view')))
        SELECT file_id, line, filtered, def_id, span, row_number() OVER (PARTITION BY file_id, line, filtered ORDER BY span, def_id) AS place FROM e""",
    "innermost_span": f"""{_D} SELECT p.def_id AS point_id, arg_min(s.def_id, (s.line_end - s.line_start, s.def_id)) AS def_id FROM d p JOIN d s ON s.file_id = p.file_id AND p.line_start BETWEEN s.line_start AND s.line_end
        AND s.kind IN ('method', 'constructor', 'function', 'storedProcedure', 'sqlFunction') GROUP BY ALL""",
    "term_breakdown": f"""{_D} SELECT term, count(def_id) AS n FROM (VALUES (0, 'cache'), (1, 'tile'), (2, 'zzz'), (3, 'reader')) v(i, term) LEFT JOIN (SELECT def_id, CASE WHEN contains(lower(name), 'cache') THEN 0
        WHEN contains(lower(name), 'tile') THEN 1 WHEN contains(lower(name), 'zzz') THEN 2 WHEN contains(lower(name), 'reader') THEN 3 END AS i FROM d) USING (i) GROUP BY ALL""",
    "missing_terms": f"""{_D} SELECT term, CASE WHEN count(def_id) = 0 THEN 'not in the index' ELSE 'other kinds only' END AS reason FROM (VALUES ('cache'), ('zzz'), ('attach')) v(term) LEFT JOIN d ON contains(lower(name), term)
        GROUP BY term HAVING count(*) FILTER (kind = 'enum') = 0""",
    "usage_count": f"{_IDX}, d AS (SELECT DISTINCT def_id, name FROM definitions WHERE def_id IS NOT NULL) SELECT def_id, coalesce(df, 0) AS usages FROM d LEFT JOIN df ON token = lower(name)",
    "auto_summary": f"""{_D}{_F}, g AS (SELECT d.*, array_to_string(string_split(regexp_replace(path, '(^|/)[^/]*$', ''), '/')[:2], '/') AS folder FROM d JOIN f USING (file_id)),
        k AS (SELECT folder, kind, count(*) AS n FROM g GROUP BY ALL), c AS (SELECT folder, sum(n)::BIGINT AS total, string_agg(concat(kind, '=', n), ',' ORDER BY concat(kind, '=', n)) AS kinds FROM k GROUP BY ALL),
        p AS (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY line_end - line_start DESC, name, def_id) AS place FROM g WHERE {_TYPE} = 0),
        l AS (SELECT folder, string_agg(name, ',' ORDER BY place) AS longest FROM p WHERE place <= 3 GROUP BY ALL) SELECT folder, total, kinds, coalesce(longest, '') AS longest FROM c LEFT JOIN l USING (folder)""",
    "kind_correct": f"{_D}, m AS (SELECT * FROM d WHERE contains(lower(name), 'attach')) SELECT kind, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM m WHERE kind = 'enum') GROUP BY ALL",
    "name_autocorrect": f"""{_D}, n AS (SELECT DISTINCT name FROM d WHERE name IS NOT NULL), p AS (SELECT asked, name, round(jaro_winkler_similarity(lower(asked), lower(name)), 6) AS similarity FROM n,
        (VALUES ('CacheRaeder'), ('FactoryServise'), ('Atach'), ('zzzzqqqq')) v(asked) WHERE least(strlen(asked), strlen(name)) >= 0.6 * greatest(strlen(asked), strlen(name)))
        SELECT asked, arg_max(name, (similarity, name)) AS name, max(similarity) AS similarity FROM p WHERE similarity >= 0.8 GROUP BY asked""",
    "value_source": f"""{_D}, a AS (SELECT def_id, unnest(attributes) AS a FROM d WHERE kind IN ('property', 'field')) SELECT DISTINCT def_id, unnest(regexp_extract_all(a, '"((?:[^"\\\\]|\\\\.)*)"', 1)) AS value FROM a""",
    "audit_empty": f"{_IDX} SELECT file_id, path, token_count FROM files JOIN counts USING (file_id) WHERE token_count > 20 AND file_id NOT IN (SELECT file_id FROM definitions WHERE file_id IS NOT NULL)",
    "cross_validate": f"{_D}{_F} SELECT file_id, 'no definitions' AS side FROM f WHERE file_id NOT IN (SELECT file_id FROM d WHERE file_id IS NOT NULL) UNION ALL SELECT DISTINCT file_id, 'not listed' FROM d WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM f)",
    "test_definitions": f"""{_D}{_F} SELECT def_id, regexp_matches(lower(path), '_tests\\.|\\.test\\.|\\.spec\\.|/tests?/') AS in_test_file FROM d JOIN f USING (file_id)
        WHERE len(list_filter(attributes, lambda a: regexp_replace({_ATTR.format('a')}, 'attribute$', '') IN ('test', 'testcase', 'fact', 'theory', 'testmethod', 'rstest', 'proptest', 'quickcheck', 'test_case'))) > 0
        OR regexp_matches(lower(path), '\\.(spec|test)\\.(ts|tsx|js)$')""",
    "selector_status": f"""{_D}, c AS (SELECT lower(name) AS child, count(DISTINCT def_id) AS candidates FROM d WHERE kind IN ('class', 'interface') GROUP BY ALL), e AS (SELECT DISTINCT lower(unnest(base_types)) AS child FROM d)
        SELECT child, CASE WHEN candidates IS NULL THEN 'unresolved' WHEN candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(candidates, 0) AS candidates FROM e LEFT JOIN c USING (child)""",
    "file_name_rank": f"""{_D}{_F} SELECT * FROM (SELECT path, row_number() OVER (ORDER BY {_TIER.format(_STEM, 'tile')}, length({_STEM}), path) AS rank FROM f WHERE contains(lower({_BASENAME}), 'tile')) WHERE rank <= 40""",
    "glob_search": f"{_D}{_F} SELECT file_id, path FROM f WHERE regexp_matches({_BASENAME}, '^.*Ca.he.*\\.cs$') OR regexp_matches({_BASENAME}, '^Tile.*')",
    "file_filters": f"""SELECT doc_id, path, len(string_split(path, '/'))::INT AS depth FROM documents WHERE path IS NOT NULL AND regexp_matches({_BASENAME}, '^[A-F]') AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('cs', 'md')
        AND len(string_split(path, '/')) <= 3 AND n_chars BETWEEN 200 AND 4000""",
    "dir_file_counts": f"""{_D}{_F}, p AS (SELECT string_split(regexp_replace(path, '(^|/)[^/]*$', ''), '/') AS parts FROM f WHERE contains(path, '/')),
        a AS (SELECT array_to_string(parts[:n], '/') AS folder FROM (SELECT parts, unnest(generate_series(1, len(parts))) AS n FROM p)) SELECT folder, count(*) AS n_files FROM a GROUP BY ALL""",
    "fuzzy_interface": f"""{_D}, c AS (SELECT DISTINCT name FROM d WHERE kind = 'class' AND name IS NOT NULL), p AS (SELECT interface, name, lower(interface[2:]) AS stem, lower(name) AS low FROM c, (VALUES ('ICacheReader'), ('ITile'), ('IFactoryServiceHub'), ('Iface')) v(interface)),
        q AS (SELECT *, strlen(stem) AS n, len(list_filter(generate_series(1, least(length(stem), length(low))), lambda i: starts_with(low, stem[:i]))) AS common FROM p)
        SELECT interface, name FROM q WHERE regexp_matches(interface, '^I\\p{{Lu}}') AND (low = stem OR (n >= 5 AND (contains(low, stem) OR (common >= 4 AND common * 2 >= n))))""",
    "grep_refs": f"""{_IDX}, n AS (SELECT DISTINCT lower(name) AS token, file_id FROM definitions WHERE kind = 'class' AND file_id IS NOT NULL AND def_id IS NOT NULL)
        SELECT token, count(*) AS n_files FROM idx WHERE token IN (SELECT token FROM n) AND (token, file_id) NOT IN (SELECT token, file_id FROM n) GROUP BY ALL""",
}
