"""Queries of implementers, template trees, root election and index information, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.functions import text as X
from strataquery.functions.parsers import parsed
from strataquery.functions.registry import register
from strataquery.operators import graph as G
from strataquery.operators import index as I
from strataquery.operators import symbols as Y
from strataquery.operators.hierarchy import bare_name
from strataquery.plans.callgraph import _levels
from strataquery.plans.content import _DOCS, _IDX, _documents, _files, _index, _prepared
from strataquery.plans.skew import numbered
from strataquery.plans.symbol import _ATTR, _D, _F, _defs, _placed
from strataquery.session import stored
from strataquery.sources.store import ignored, with_folders
from strataquery.sources.tables import table


def implementers(spark, folder):
    """Classes, structs and records that list an interface, type arguments aside, among their bases."""
    defs = _defs(spark, folder, "def_id", "name", "kind", "base_types")
    named = defs.where(Y.kinds("interface")).select(F.lower("name").alias("interface")).distinct()
    listed = defs.where(Y.kinds("class", "struct", "record")).select("def_id", "name", F.explode("base_types").alias("b")).select("def_id", "name", Y.base_name(F.col("b")).alias("interface"))
    return listed.join(named, "interface").select("interface", "def_id", "name").distinct()


def root_election(spark, folder):
    """Method names asked for: one definition is the root, several classes make the name ambiguous."""
    asked = spark.createDataFrame([("Resolve",), ("Purge",), ("NoSuchMethod",)], "method string")
    defs = _defs(spark, folder, "def_id", "name", "kind", "parent").where(Y.kinds("method", "function", "constructor"))
    per = defs.withColumn("holder", bare_name(F.col("parent"))).join(F.broadcast(asked), F.lower("name") == F.lower("method"))
    counts = per.groupBy("method").agg(F.count("*").alias("n_definitions"), F.count_distinct("holder").alias("n_holders"))
    status = F.when(F.col("n_definitions").isNull(), "missing").when(F.col("n_definitions") == 1, "root").otherwise("ambiguous")
    return asked.join(counts, "method", "left").select("method", status.alias("status"), F.coalesce("n_definitions", F.lit(0)).alias("n_definitions"), F.coalesce("n_holders", F.lit(0)).alias("n_holders"))


def class_scope(spark, folder):
    """Files that can hold callers of a class: with the class, its I-form, its bases, types that list it, or a longer token that holds its name."""
    asked = spark.createDataFrame([("planner",), ("cachereader",), ("tile",)], "class string")
    defs = _defs(spark, folder, "def_id", "name", "kind", "base_types").where(Y.kinds("class", "struct", "record", "interface"))
    listed = defs.select(F.lower("name").alias("name"), F.explode("base_types").alias("b")).select("name", Y.base_name(F.col("b")).alias("base"))
    bases = listed.join(asked, F.col("name") == F.col("class")).select("class", F.col("base").alias("token"))
    lists = listed.join(asked, F.col("base") == F.col("class")).select("class", F.col("name").alias("token"))
    own = asked.select("class", F.explode(F.array("class", F.concat(F.lit("i"), "class"))).alias("token"))
    longer = _prepared(spark, folder).vocabulary.select("token").join(F.broadcast(asked), F.contains("token", "class") & (F.char_length("token") > F.char_length("class"))).select("class", "token")
    wanted = bases.union(lists).union(own).union(longer).distinct()
    return _index(spark, folder).join(wanted, "token").select("class", "file_id").distinct()


def production_only(spark, folder):
    """Methods that are no tests and lie in no test files, per kind."""
    rows = _placed(spark, folder, "def_id", "file_id", "kind", "attributes").where(Y.kinds("method", "constructor", "function"))
    return rows.where(~Y.is_test(F.col("path")) & ~Y.is_test_file(F.col("path"))).groupBy("kind").agg(F.count("*").alias("n"))


def _components(spark, folder):
    """(selector, template, file_id) of every component of the TypeScript texts."""
    docs = _documents(spark, folder).where((X.extension(F.col("path")) == "ts") & F.col("text").isNotNull())
    return docs.select("file_id", F.inline(X.components(F.col("text")))).where("selector <> ''").withColumn("selector", F.lower("selector"))


def _template_edges(spark, folder):
    """(src, dst): selectors of components and those used in their templates."""
    used = F.explode(F.regexp_extract_all("template", F.lit(r"<([a-z][a-z0-9]*-[a-z0-9-]+)"), 1)).alias("dst")
    return _components(spark, folder).select(F.col("selector").alias("src"), used).where("src <> dst").distinct()


def _selectors(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "root string, node string")


_DOWN, _UP = ("app-callee", "app-lantern", "app-scope"), ("app-tide", "app-lattice", "app-receiver")


def template_tree_down(spark, folder):
    """Selectors below components; each comes once in a tree."""
    return G.reach(_template_edges(spark, folder), _selectors(spark, *_DOWN), 3)


def template_tree_up(spark, folder):
    edges = _template_edges(spark, folder).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reach(edges, _selectors(spark, *_UP), 3)


def template_states(spark, folder):
    """The trees with what each selector stands for: one component, several (which are not gone into), or none."""
    counts = stored(_components(spark, folder).groupBy(F.col("selector").alias("node")).agg(F.count("*").alias("candidates")), "components")
    tree = G.reach(_template_edges(spark, folder), _selectors(spark, *_DOWN), 5, stop=counts.where("candidates > 1"))
    state = F.when(F.col("candidates").isNull(), "unresolved").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return tree.join(counts, "node", "left").select("root", "node", "depth", state.alias("state"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def list_entries(spark, folder):
    """Folders and files below src, three levels deep: an extension filter holds for files, not for folders."""
    rows = with_folders(_files(spark, folder).select("path", F.lit(0).cast("long").alias("size"))).where(X.under(F.col("path"), "src"))
    shallow = rows.where(F.size(F.split("path", "/")) <= 4)
    return shallow.where(F.col("is_dir") | (X.extension(F.col("path")) == "cs")).select("path", "is_dir")


def author_ids(spark, folder):
    """Authors with dense numbers from 0 in the order of name and mailbox."""
    rows = table(spark, folder, "authors", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("email", F.lit("")).alias("email")).distinct()
    return numbered(rows, ["name", "email"], "pool_id")


def registered_functions(spark, folder):
    """The library's functions in SQL."""
    register(spark)
    _defs(spark, folder, "def_id", "name", "kind").where("kind = 'class' and name is not null").createOrReplaceTempView("sq_classes")
    return spark.sql("SELECT name, round(max(jaro_winkler(lower(name), 'cachereader')), 6) AS similarity FROM sq_classes GROUP BY name HAVING max(jaro_winkler(lower(name), 'cachereader')) >= 0.85")


def ignored_files(spark, folder):
    """Listed files that rules of an ignore file leave, the last rule that fits decides."""
    return _files(spark, folder).where(~ignored(F.col("path"), ["*.ts", "!*View*.ts", "/src/**/cache/", "tile*/", "# a remark", "", "lib/*.rs"])).select("path")


def index_info(spark, folder):
    """One row: files, indexed files, tokens and occurrences of the content index."""
    index = _index(spark, folder)
    totals = index.agg(F.count_distinct("file_id").alias("indexed_files"), F.count_distinct("token").alias("unique_tokens"), F.sum("tf").alias("total_tokens"))
    return totals.withColumn("files", _files(spark, folder).agg(F.count("*")).scalar())


def file_info(spark, folder):
    """Per document: lines, line ends and bytes."""
    text = F.col("text")
    ends = F.when(F.contains(text, F.lit("\r\n")), "crlf").when(F.contains(text, F.lit("\n")), "lf").otherwise("none")
    return _documents(spark, folder).where("text is not null").select("file_id", F.size(X.lines(text)).alias("n_lines"), ends.alias("line_end"), F.octet_length(text).alias("n_bytes"))


def injected_fields(spark, folder):
    """Calls through injected fields of C# and TypeScript classes with the types the fields declare."""
    parts = [parsed(_documents(spark, folder).where(X.extension(F.col("path")) == x), "code_calls", x) for x in ("cs", "ts")]
    calls = parts[0].union(parts[1])
    return calls.where("receiver like '\\_%' and receiver_type is not null").groupBy("receiver_type", "name").agg(F.count("*").alias("n_calls"))


def extension_methods(spark, folder):
    return parsed(_documents(spark, folder).where(X.extension(F.col("path")) == "cs"), "extension_methods")


def vocabulary_growth(spark, folder):
    """Definition names that are no tokens of any text."""
    vocab = _prepared(spark, folder).vocabulary.select("token")
    names = _defs(spark, folder, "def_id", "name", "kind").select(F.lower("name").alias("token"), "kind").distinct()
    return names.join(vocab, "token", "left_anti").groupBy("kind").agg(F.count("*").alias("n_names"))


_NAMES = "implementers root_election class_scope production_only template_tree_down template_tree_up template_states list_entries author_ids registered_functions ignored_files index_info file_info injected_fields extension_methods vocabulary_growth".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
_BARE = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(parent, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '<.*$', ''), '^.*(\.|::)', ''), '^\s+|\s+$', '', 'g')), '')"


_PARTS = f"""t AS (SELECT lower(regexp_extract(p, 'selector:\\s*''([^'']+)''', 1)) AS src, regexp_extract(p, 'template:\\s*`([^`]*)`', 1) AS template
        FROM (SELECT unnest(string_split(regexp_replace(text, '@(?:Component|Directive|Pipe|Injectable|NgModule)\\s*\\(', chr(1), 'g'), chr(1))) AS p FROM documents WHERE {_EXT} = 'ts' AND text IS NOT NULL)),
        e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, unnest(regexp_extract_all(template, '<([a-z][a-z0-9]*-[a-z0-9-]+)', 1)) AS dst FROM t WHERE src <> '') WHERE src <> dst), up AS (SELECT dst AS src, src AS dst FROM e)"""


SQL = {
    "implementers": f"""{_D}, i AS (SELECT DISTINCT lower(name) AS interface FROM d WHERE kind = 'interface'), l AS (SELECT def_id, name, unnest(base_types) AS b FROM d WHERE kind IN ('class', 'struct', 'record'))
        SELECT DISTINCT interface, def_id, name FROM l JOIN i ON interface = lower(trim(split_part(b, '<', 1)))""",
    "root_election": f"""{_D}, m AS (SELECT method, def_id, {_BARE} AS holder FROM (VALUES ('Resolve'), ('Purge'), ('NoSuchMethod')) v(method) LEFT JOIN d ON lower(name) = lower(method) AND kind IN ('method', 'function', 'constructor'))
        SELECT method, CASE WHEN count(def_id) = 0 THEN 'missing' WHEN count(def_id) = 1 THEN 'root' ELSE 'ambiguous' END AS status, count(def_id) AS n_definitions, count(DISTINCT holder) AS n_holders FROM m GROUP BY method""",
    "class_scope": f"""{_IDX}, asked AS (SELECT * FROM (VALUES ('planner'), ('cachereader'), ('tile')) v(class)), l AS (SELECT DISTINCT lower(name) AS name, lower(trim(split_part(b, '<', 1))) AS base FROM (SELECT name, unnest(base_types) AS b FROM definitions
        WHERE def_id IS NOT NULL AND kind IN ('class', 'struct', 'record', 'interface'))), w AS (SELECT class, base AS token FROM l JOIN asked ON name = class UNION SELECT class, name FROM l JOIN asked ON base = class UNION SELECT class, unnest([class, 'i' || class]) FROM asked
        UNION SELECT class, token FROM df JOIN asked ON contains(token, class) AND length(token) > length(class)) SELECT DISTINCT class, file_id FROM idx JOIN w USING (token)""",
    "production_only": f"""{_D}{_F} SELECT kind, count(*) AS n FROM d JOIN f USING (file_id) WHERE kind IN ('method', 'constructor', 'function')
        AND NOT coalesce(len(list_filter(attributes, lambda a: regexp_replace({_ATTR.format('a')}, 'attribute$', '') IN ('test', 'testcase', 'fact', 'theory', 'testmethod', 'rstest', 'proptest', 'quickcheck', 'test_case'))) > 0, false)
        AND NOT regexp_matches(lower(path), '\\.(spec|test)\\.(ts|tsx|js)$') AND NOT regexp_matches(lower(path), '_tests\\.|\\.test\\.|\\.spec\\.|/tests?/') GROUP BY ALL""",
    "template_tree_down": f"WITH {_PARTS}{_levels('e', 3, _DOWN)} SELECT * FROM walk",
    "template_tree_up": f"WITH {_PARTS}{_levels('up', 3, _UP)} SELECT * FROM walk",
    "template_states": f"""WITH {_PARTS}, c AS MATERIALIZED (SELECT src AS node, count(*) AS candidates FROM t WHERE src <> '' GROUP BY src), several AS (SELECT node FROM c WHERE candidates > 1){_levels('e', 5, _DOWN, stop='several')}
        SELECT root, node, depth, CASE WHEN candidates IS NULL THEN 'unresolved' WHEN candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, coalesce(candidates, 0) AS candidates FROM walk LEFT JOIN c USING (node)""",
    "list_entries": f"""{_D}{_F}, p AS (SELECT path, string_split(path, '/') AS s FROM f), e AS (SELECT DISTINCT array_to_string(s[:n], '/') AS path, true AS is_dir FROM (SELECT s, unnest(generate_series(1, len(s) - 1)) AS n FROM p)
        UNION ALL SELECT path, false FROM p WHERE {_EXT} = 'cs') SELECT path, is_dir FROM e WHERE starts_with(lower(path), 'src/') AND len(string_split(path, '/')) <= 4""",
    "author_ids": "SELECT name, email, row_number() OVER (ORDER BY name, email) - 1 AS pool_id FROM (SELECT DISTINCT coalesce(name, '') AS name, coalesce(email, '') AS email FROM authors)",
    "registered_functions": f"{_D} SELECT DISTINCT name, round(jaro_winkler_similarity(lower(name), 'cachereader'), 6) AS similarity FROM d WHERE kind = 'class' AND name IS NOT NULL AND jaro_winkler_similarity(lower(name), 'cachereader') >= 0.85",
    "ignored_files": f"""{_D}{_F}, r AS (SELECT path, regexp_matches(path, '(^|/)[^/]*\\.ts$') AS a, regexp_matches(path, '(^|/)[^/]*View[^/]*\\.ts$') AS b, regexp_matches(path, '^src/(?:.*/)?cache/') AS c, regexp_matches(path, '(^|/)tile[^/]*/') AS d, regexp_matches(path, '^lib/[^/]*\\.rs$') AS e FROM f)
        SELECT path FROM r WHERE NOT ((a AND NOT b) OR c OR d OR e)""",
    "index_info": f"{_IDX} SELECT count(DISTINCT file_id) AS indexed_files, count(DISTINCT token) AS unique_tokens, sum(tf)::BIGINT AS total_tokens, (SELECT count(*) FROM files) AS files FROM idx",
    "file_info": f"{_DOCS} SELECT file_id, len(parts)::INT AS n_lines, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'crlf' WHEN contains(text, chr(10)) THEN 'lf' ELSE 'none' END AS line_end, strlen(text)::INT AS n_bytes FROM cut JOIN docs USING (file_id)",
    "vocabulary_growth": f"{_IDX} SELECT kind, count(*) AS n_names FROM (SELECT DISTINCT lower(name) AS token, kind FROM definitions WHERE def_id IS NOT NULL) WHERE token NOT IN (SELECT token FROM df) GROUP BY ALL",
}
