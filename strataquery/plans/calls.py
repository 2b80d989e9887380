"""Queries of call resolution on small inline symbols, and of source bodies and comments."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.functions import text as X
from strataquery.functions.parsers import parsed
from strataquery.operators import graph as G
from strataquery.operators import index as I
from strataquery.operators import symbols as Y
from strataquery.plans.callgraph import _SITES as _CODE
from strataquery.plans.callgraph import _call_tables
from strataquery.plans.content import _DOCS, _IDX, _documents, _files, _prepared
from strataquery.plans.symbol import _defs
from strataquery.sources.tables import table

_METHOD = r"^\s*(?:public|private|protected|internal)\b[A-Za-z0-9_ <>\[\],]*? ([A-Za-z_][A-Za-z0-9_]*)\("

# Inline symbols: an interface with two classes, a generic base, a built-in receiver, a free function.
_CLASSES = [("Store", ["IStore<T>", "Base"]), ("CachedStore", ["Store", "IStore"]), ("Other", []), ("IStore", []), ("Base", [])]
_METHODS = [(1, "Load", "method", "Store"), (2, "Load", "method", "CachedStore"), (3, "Load", "method", "IStore"), (4, "Load", "method", "Other"), (5, "load", "function", None), (6, "Store", "constructor", "Store"), (7, "Push", "method", "Stack")]
_SITES = [
    (1, "Load", "Store", "Other"), (2, "Load", "IStore", "Other"), (3, "Load", None, "Other"), (4, "Load", None, None), (5, "Push", "Stack", "Other"),
    (6, "LOAD", "istore", None), (7, "Store", "Store", None), (8, "Load", "Missing", "Store"), (9, "Load", "app.CachedStore", None), (10, "Load", "Base", None),
]


def callsite_resolve(spark, folder):
    """Which definitions each call of the inline symbols means."""
    calls = spark.createDataFrame(_SITES, "call_id int, method string, receiver string, caller_class string")
    return G.resolved_calls(calls, spark.createDataFrame(_METHODS, "def_id int, name string, kind string, parent string"), spark.createDataFrame(_CLASSES, "name string, bases array<string>"))


def callsite_verify(spark, folder):
    """Whether calls with and without receivers can mean methods of Store, with and without interfaces."""
    sites = spark.createDataFrame(_VERIFIED, "call_id int, receiver string, caller string")
    bases = spark.createDataFrame(_CLASSES, "name string, bases array<string>")
    target = F.array(*[F.lit(b) for b in _CLASSES[0][1]])
    rows = sites.join(F.broadcast(bases), sites["caller"] == bases["name"], "left").withColumn("bases", F.coalesce("bases", F.array().cast("array<string>")))
    test = lambda interfaces: G.accepts_call(F.lit("Store"), F.col("receiver"), F.col("caller"), F.col("bases"), target, F.lit(False), interfaces)
    return rows.select("call_id", test(True).alias("accepted"), test(False).alias("directly"))


_P = lambda name, kind, **more: {"name": name, "type": kind, "ref": None, "optional": False, "rest": False, **more}
_OVERLOADS = {
    "none": [],
    "one": [_P("a", "int")],
    "two": [_P("a", "int"), _P("b", "string", optional=True)],
    "out": [_P("a", "int", ref="out")],
    "list": [_P("a", "string"), _P("rest", "int[]", rest=True)],
}
_ARGUMENTS = {
    "()": [], "(int)": [{"type": "int"}], "(?)": [{"type": None}], "(b: string, a: int)": [{"name": "b", "type": "string"}, {"name": "a", "type": "int"}], "(out int)": [{"type": "int", "ref": "out"}],
    "(string, int, int)": [{"type": "string"}, {"type": "int"}, {"type": "int"}], "(string, int[])": [{"type": "string"}, {"type": "int[]"}], "(string, int[], int)": [{"type": "string"}, {"type": "int[]"}, {"type": "int"}],
}


@F.pandas_udf(T.BooleanType())
def _binds(arguments: pd.Series, parameters: pd.Series) -> pd.Series:
    """Whether parameters take arguments, batch by batch; equal texts are read once."""
    read = {text: json.loads(text) for text in {*arguments, *parameters}}
    return pd.Series([G.binds(read[a], read[p]) for a, p in zip(arguments, parameters, strict=True)], dtype="bool")


def overload_resolve(spark, folder):
    """Applicable overloads per call and whether one, several or none remain."""
    calls = spark.createDataFrame([(k, json.dumps(v)) for k, v in _ARGUMENTS.items()], "call string, arguments string")
    candidates = spark.createDataFrame([("f", k, json.dumps(v)) for k, v in _OVERLOADS.items()], "name string, overload string, parameters string")
    met = calls.withColumn("name", F.lit("f")).join(candidates, "name").where(_binds("arguments", "parameters"))
    status = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    per = met.groupBy("call").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_list("overload"))).alias("overloads"))
    return calls.select("call").join(per, "call", "left").select("call", status.alias("status"), F.coalesce("overloads", F.lit("")).alias("overloads"))


def symbol_id(spark, folder):
    """A digest of holder, name and kind per definition; equal symbols get equal ids."""
    part = lambda c: F.concat(F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    return _defs(spark, folder, "def_id", "name", "kind", "parent").select("def_id", F.sha2(F.concat(*[part(F.col(c)) for c in ("parent", "name", "kind")]), 256).alias("symbol_id"))


def body_budget(spark, folder):
    """At most eight lines of each C# method, as long as 300 lines last in all."""
    docs = _documents(spark, folder).where(X.extension(F.col("path")) == "cs")
    methods = parsed(docs, "code_symbols", "cs").where("kind = 'method'").select("file_id", "name", "line", (F.least(F.col("end_line") - F.col("line") + 1, F.lit(8))).alias("n"))
    order = ["file_id", "line", "name"]
    first = methods.orderBy(*order).limit(300)  # every method takes a line, so no more can be shown
    used = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used", used).where(F.col("used") - F.col("n") < 300).select("file_id", "name", "line", F.least(F.col("n"), 300 - (F.col("used") - F.col("n"))).alias("shown"))


def doc_comments(spark, folder):
    """Per C# method the first line of the comment above it, blank lines in between passed over."""
    lines = I.file_lines(_documents(spark, folder).where(X.extension(F.col("path")) == "cs"))
    w = Window.partitionBy("file_id").orderBy("line_no")
    blank, doc = F.trim("line") == "", F.rlike("line", F.lit(r"^\s*(///|/\*\*|\*/|\*)"))
    marked = lines.select(
        "file_id",
        "line_no",
        F.regexp_extract("line", _METHOD, 1).alias("name"),
        F.last(F.when(~blank, F.col("line_no")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("above"),
        F.coalesce(F.last(F.when(~doc, F.col("line_no")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("no_doc"),
    )
    upper = marked.select("file_id", F.col("line_no").alias("above"), (F.col("no_doc") + 1).alias("doc_start"))
    return marked.where("name <> ''").join(upper, ["file_id", "above"]).where("doc_start <= above").select("file_id", "line_no", "name", "doc_start")


def body_text(spark, folder):
    """Lines 2 to 9 of the body of each C# method, eight at most, with their text, as long as 400 lines last in all.

    A body runs to the line before the next method of its file. Methods come in order of file and line.
    """
    methods = _call_tables(spark, folder)[1].where("lang = 'cs'").select("file_id", "name", F.col("line_no").alias("start"))
    lines = I.file_lines(_documents(spark, folder).where(X.extension(F.col("path")) == "cs"))
    last = lines.groupBy("file_id").agg(F.max("line_no").alias("n_lines"))
    following = F.lead("start").over(Window.partitionBy("file_id").orderBy("start"))
    spans = methods.withColumn("next", following).join(last, "file_id").select("file_id", "name", "start", F.coalesce(F.col("next") - 1, F.col("n_lines")).alias("end"))
    wanted = spans.select("file_id", "name", "start", (F.col("start") + 1).alias("from"), F.least(F.col("start") + 8, F.col("end")).alias("to")).where(F.col("to") >= F.col("from"))
    first = wanted.orderBy("file_id", "start").limit(400)  # every method here shows a line, so no more can be shown
    used = F.sum(F.col("to") - F.col("from") + 1).over(Window.orderBy("file_id", "start").rowsBetween(Window.unboundedPreceding, 0))
    kept = first.withColumn("used", used).where(F.col("used") - (F.col("to") - F.col("from") + 1) < 400)
    shown = kept.select("file_id", "name", "start", F.explode(F.sequence("from", F.least(F.col("to"), F.col("to") - (F.col("used") - 400)))).alias("line_no"))
    return shown.join(lines, ["file_id", "line_no"]).select("file_id", "name", "line_no", "line")


def zero_hints(spark, folder):
    """For requests without results (name, kind, file, extension): why, by up to five suggestions a hint.

    Nearest names; other kinds the name has; files whose stems are near the file asked for; extensions the
    definitions do not cover, with whether the content index does; and names that only texts use.
    """
    asked = spark.createDataFrame([("CacheRaeder", "class", "cachereadr", "cs"), ("return", "method", "tille", "py"), ("qqqqq", "enum", "zzzzzzzz", "xml"), ("Attach", "table", "cache", "cs")], "asked string, kind string, file string, ext string")
    defs = _defs(spark, folder, "def_id", "file_id", "name", "kind").where("name is not null")
    files = _files(spark, folder)
    near = Y.corrected(defs, asked.select("asked"), top=5).select("asked", F.lit("nearest name").alias("hint"), F.col("name").alias("value"))
    same = defs.select(F.lower("name").alias("low"), F.col("kind").alias("other")).distinct()
    kinds = asked.join(same, F.lower("asked") == F.col("low")).where("kind <> other").select("asked", F.lit("other kind"), "other")
    stems = files.select(F.lower(X.stem(F.col("path"))).alias("name")).distinct()
    known = asked.select("asked", "file").join(stems, F.contains("name", "file"), "left_semi").select("asked").withColumn("there", F.lit(True))
    lost = asked.join(known, "asked", "left").where("there is null").select("asked", "file")
    by_file = Y.corrected(stems, lost.select(F.col("file").alias("asked")).distinct(), top=5).withColumnRenamed("asked", "file")
    names = lost.join(by_file, "file").select("asked", F.lit("near file"), "name")
    ext = lambda rows: rows.select(X.extension(F.col("path")).alias("ext")).distinct()
    defined = ext(files.join(defs.select("file_id").distinct(), "file_id", "left_semi"))
    indexed = ext(files.join(_prepared(spark, folder).counts, "file_id", "left_semi")).withColumn("indexed", F.lit(True))
    uncovered = asked.select("asked", "ext").join(defined, "ext", "left_anti").join(indexed, "ext", "left")
    unsupported = uncovered.select("asked", F.lit("unsupported extension"), F.when(F.col("indexed"), F.concat("ext", F.lit(" (in texts)"))).otherwise(F.col("ext")))
    content = _prepared(spark, folder).vocabulary.join(F.broadcast(asked), F.col("token") == F.lower("asked")).join(same, F.col("token") == F.col("low"), "left_anti").select("asked", F.lit("in text only"), F.col("df").cast("string"))
    return near.union(kinds).union(names).union(unsupported).union(content)


def caller_popularity(spark, folder):
    """Occurrences of each method's name in all texts; callers are ranked by it, tests last."""
    methods = table(spark, folder, "definitions", "def_id", "name", "kind", "attributes").where("kind = 'method' and def_id is not null").dropDuplicates(["def_id"])
    vocab = _prepared(spark, folder).vocabulary
    return methods.join(vocab, F.lower("name") == F.col("token"), "left").select("def_id", Y.has_attribute("TestMethod").alias("is_test"), F.coalesce("total", F.lit(0)).alias("popularity"))


_NAMES = "callsite_resolve callsite_verify overload_resolve symbol_id body_budget body_text doc_comments zero_hints caller_popularity".split()
QUERIES = {name: globals()[name] for name in _NAMES}


def _values(rows: list, columns: str) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]::VARCHAR[]"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


_VERIFIED = [(1, "Store", "Other"), (2, "IStore", "Other"), (3, "Base", "Other"), (4, "StoreService", "Other"), (5, None, "Store"), (6, None, "Other"), (7, None, "CachedStore"), (8, "Base", "Store")]
_BUILTIN = ", ".join(f"'{b.lower()}'" for b in G.BUILTIN_RECEIVERS)
SQL = {
    "callsite_resolve": f"""WITH s AS (SELECT *, lower(regexp_extract(split_part(receiver, '<', 1), '[^.]*$')) AS r FROM {_values(_SITES, 'call_id, method, receiver, caller_class')}),
        m AS (SELECT * FROM {_values(_METHODS, 'def_id, name, kind, parent')}), b AS (SELECT lower(name) AS p, lower(split_part(unnest(bases), '<', 1)) AS r FROM {_values(_CLASSES, 'name, bases')})
        SELECT DISTINCT call_id, def_id FROM s JOIN m ON lower(m.name) = lower(s.method) WHERE (receiver IS NULL OR r NOT IN ({_BUILTIN})) AND CASE
        WHEN receiver IS NOT NULL THEN lower(parent) = r OR EXISTS (SELECT 1 FROM b WHERE b.p = lower(parent) AND b.r = s.r)
        WHEN caller_class IS NOT NULL THEN lower(parent) = lower(caller_class) ELSE kind NOT IN ('method', 'constructor') END""",
    "callsite_verify": f"""WITH b AS (SELECT name, list_transform(bases, lambda x: lower(split_part(x, '<', 1))) AS bases FROM {_values(_CLASSES, 'name, bases')}), t AS (SELECT bases AS target_bases FROM b WHERE name = 'Store'),
        s AS (SELECT call_id, lower(receiver) AS r, receiver, lower(caller) AS c, coalesce(bases, []) AS caller_bases, target_bases FROM {_values(_VERIFIED, 'call_id, receiver, caller')} LEFT JOIN b ON name = caller, t),
        n AS (SELECT *, lower(receiver[2:]) AS stem FROM s), i AS (SELECT *, regexp_matches(receiver, '^I[A-Z]') AND (stem = 'store' OR (length(stem) >= 5 AND contains('store', stem))) AS follows FROM n)
        SELECT call_id, CASE WHEN receiver IS NOT NULL THEN r IN ('store', 'istore') OR list_contains(target_bases, r) OR follows ELSE c IN ('store', 'istore') OR list_contains(caller_bases, 'store') END AS accepted,
        CASE WHEN receiver IS NOT NULL THEN r = 'store' ELSE c = 'store' END AS directly FROM i""",
    "overload_resolve": """SELECT * FROM (VALUES ('()', 'resolved', 'none'), ('(int)', 'ambiguous', 'one,two'), ('(?)', 'ambiguous', 'list,one,two'), ('(b: string, a: int)', 'resolved', 'two'), ('(out int)', 'resolved', 'out'),
        ('(string, int, int)', 'resolved', 'list'), ('(string, int[])', 'resolved', 'list'), ('(string, int[], int)', 'none', '')) v(call, status, overloads)""",
    "body_text": f"""{_CODE}, m AS (SELECT file_id, name, line_no AS start FROM methods WHERE lang = 'cs'), n AS (SELECT file_id, max(line_no) AS n_lines FROM code WHERE lang = 'cs' GROUP BY ALL),
        s AS (SELECT file_id, name, start, coalesce(lead(start) OVER (PARTITION BY file_id ORDER BY start) - 1, n_lines) AS stop FROM m JOIN n USING (file_id)),
        w AS (SELECT *, start + 1 AS a, least(start + 8, stop) AS b FROM s), u AS (SELECT *, sum(b - a + 1) OVER (ORDER BY file_id, start) AS used FROM w WHERE b >= a),
        k AS (SELECT file_id, name, unnest(generate_series(a, least(b, b - (used - 400)::BIGINT))) AS line_no FROM u WHERE used - (b - a + 1) < 400)
        SELECT file_id, name, line_no, line FROM k JOIN code USING (file_id, line_no)""",
    "zero_hints": f"""{_IDX}, asked AS (SELECT * FROM (VALUES ('CacheRaeder', 'class', 'cachereadr', 'cs'), ('return', 'method', 'tille', 'py'), ('qqqqq', 'enum', 'zzzzzzzz', 'xml'), ('Attach', 'table', 'cache', 'cs')) v(asked, kind, file, ext)),
        d AS (SELECT DISTINCT def_id, file_id, name, kind FROM definitions WHERE def_id IS NOT NULL AND name IS NOT NULL), n AS (SELECT DISTINCT name FROM d),
        stems AS (SELECT DISTINCT lower(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')) AS name FROM files),
        lost AS (SELECT asked, file FROM asked WHERE NOT EXISTS (SELECT 1 FROM stems WHERE contains(name, file))),
        pairs AS (SELECT 'nearest name' AS hint, asked, asked AS text, name FROM asked, n UNION ALL SELECT 'near file', asked, file, name FROM lost, stems),
        alike AS (SELECT hint, asked, name, round(jaro_winkler_similarity(lower(text), lower(name)), 6) AS s FROM pairs WHERE least(strlen(text), strlen(name)) >= 0.6 * greatest(strlen(text), strlen(name))),
        defined AS (SELECT DISTINCT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM files WHERE file_id IN (SELECT file_id FROM d)), indexed AS (SELECT DISTINCT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM files JOIN counts USING (file_id))
        SELECT asked, hint, name AS value FROM (SELECT *, row_number() OVER (PARTITION BY hint, asked ORDER BY s DESC, name DESC) AS r FROM alike WHERE s >= 0.8) WHERE r <= 5
        UNION ALL SELECT DISTINCT asked, 'other kind', d.kind FROM asked JOIN d ON lower(d.name) = lower(asked) AND d.kind <> asked.kind
        UNION ALL SELECT asked, 'unsupported extension', CASE WHEN ext IN (SELECT ext FROM indexed) THEN concat(ext, ' (in texts)') ELSE ext END FROM asked WHERE ext NOT IN (SELECT ext FROM defined)
        UNION ALL SELECT asked, 'in text only', df::VARCHAR FROM asked JOIN df ON token = lower(asked) WHERE lower(asked) NOT IN (SELECT lower(name) FROM d)""",
    "symbol_id": """WITH d AS (SELECT DISTINCT def_id, name, kind, parent FROM definitions WHERE def_id IS NOT NULL)
        SELECT def_id, sha256(concat(strlen(coalesce(parent, '')), ':', coalesce(parent, ''), strlen(coalesce(name, '')), ':', coalesce(name, ''), strlen(coalesce(kind, '')), ':', coalesce(kind, ''))) AS symbol_id FROM d""",
    "doc_comments": f"""{_DOCS}, l AS (SELECT lines.* FROM lines JOIN docs USING (file_id) WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) = 'cs'),
        m AS (SELECT file_id, line_no, regexp_extract(line, '{_METHOD}', 1) AS name, max(CASE WHEN trim(line) <> '' THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
        coalesce(max(CASE WHEN NOT regexp_matches(line, '^\\s*(///|/\\*\\*|\\*/|\\*)') THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no), 0) AS no_doc FROM l)
        SELECT a.file_id, a.line_no::INT AS line_no, a.name, (b.no_doc + 1)::INT AS doc_start FROM m a JOIN m b ON a.file_id = b.file_id AND a.above = b.line_no WHERE a.name <> '' AND b.no_doc + 1 <= b.line_no""",
    "caller_popularity": """WITH kept AS (SELECT DISTINCT lower(token) AS token, file_id, lines FROM postings WHERE token IS NOT NULL AND file_id IS NOT NULL AND len(lines) > 0), t AS (SELECT token, sum(len(lines))::BIGINT AS total FROM kept GROUP BY ALL),
        m AS (SELECT DISTINCT def_id, name, attributes FROM definitions WHERE kind = 'method' AND def_id IS NOT NULL)
        SELECT def_id, len(list_filter(attributes, lambda a: lower(regexp_extract(a, '^[^(<]*')) = 'testmethod')) > 0 AS is_test, coalesce(total, 0) AS popularity FROM m LEFT JOIN t ON token = lower(name)""",
}
