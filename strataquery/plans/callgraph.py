"""Call sites of C#, TypeScript and Rust texts, the call graph they make, and queries over it, with their SQL.

Sites are found line by line in expressions: the class and method a line stands in are carried down, and a
receiver's type is what the method's line or the file's fields declare. Sites and methods are kept in tables
that are built once per state of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strataquery.functions import text as X
from strataquery.operators import graph as G
from strataquery.operators import symbols as Y
from strataquery.operators.hierarchy import bare_name
from strataquery.plans.content import _DOCS, _IDX, _documents, _prepared
from strataquery.plans.symbol import _BARE, _BASE, _D, _defs
from strataquery.sources.store import kept

LANGUAGES = ("cs", "ts", "rs")
_MODIFIER = "public|internal|private|protected|static|sealed|abstract|partial|export|default|readonly"
_CLASS = {
    "cs": rf"^\s*(?:(?:{_MODIFIER}) )*(?:class|interface|struct|record) ([A-Za-z_]\w*)",
    "ts": rf"^\s*(?:(?:{_MODIFIER}) )*(?:class|interface) ([A-Za-z_]\w*)",
    "rs": r"^\s*impl(?:<[^>]*>)? (?:[A-Za-z_][\w:<>]* for )?([A-Za-z_]\w*)",
}
_METHOD = {
    "cs": r"^\s*(?:public|private|protected|internal)\b[A-Za-z0-9_ <>\[\],]*? ([A-Za-z_]\w*)\(",
    "ts": r"^\s+(?:(?:public|private|protected|static|async) )*([A-Za-z_]\w*)\([^)]*\)\s*(?::[^{;=]+)?\{\s*$",
    "rs": r"^\s*(?:pub(?:\([a-z]+\))? )?(?:async |const |unsafe )*fn ([A-Za-z_]\w*)",
}
_DECLARED = {"cs": r"([A-Z]\w*)(?:<[^>]*>)?\?? (_?[A-Za-z]\w*)(?:;| =|,|\))", "ts": r"(\w+)\??: ([A-Z]\w*)", "rs": r"([a-z_]\w*): &?(?:mut )?([A-Z]\w*)"}
_BASES = r"(?:: |, |extends |implements |impl )([A-Za-z_]\w*)"
_SITE = r"(?:[A-Za-z_]\w*(?:\.|::))?[A-Za-z_]\w*\("
_KEYWORDS = ("if", "for", "foreach", "while", "switch", "catch", "return", "using", "lock", "match", "nameof", "typeof", "sizeof", "constructor", "function", "fn", "new", "Ok", "Some", "Err")
_OWN = ("this", "self", "Self", "base", "super")


def _by_language(pattern: dict[str, str], group: int = 1, column: str = "line") -> Column:
    out = F.lit("")
    for lang, p in pattern.items():
        out = F.when(F.col("lang") == lang, F.regexp_extract(column, p, group)).otherwise(out)
    return F.nullif(out, F.lit(""))


def _call_tables(spark, folder):
    """sites (lang, file_id, line_no, src_class, src, receiver, rtype, dst) and methods (lang, file_id, line_no, class, name, bases)."""

    def build():
        docs = _documents(spark, folder).withColumn("lang", X.extension(F.col("path"))).where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
        lines = docs.select("lang", "file_id", F.posexplode(X.lines(F.col("text"))).alias("at", "line")).select("lang", "file_id", (F.col("at") + 1).alias("line_no"), "line")
        w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        method = _by_language(_METHOD)
        marked = lines.withColumns({"own": F.when(~method.isin(*_KEYWORDS), method), "owner": _by_language(_CLASS)})
        bases = F.when(F.col("owner").isNotNull(), F.array_remove(F.regexp_extract_all("line", F.lit(_BASES), 1), F.col("owner")))
        inside = marked.withColumn("own_bases", bases).withColumns(
            {
                "src": F.last("own", True).over(w),
                "mline": F.last(F.when(F.col("own").isNotNull(), F.col("line_no")), True).over(w),
                "class": F.last("owner", True).over(w),
                "bases": F.last("own_bases", True).over(w),
            }
        )
        methods = inside.where("own is not null").select("lang", "file_id", "line_no", "class", F.col("own").alias("name"), F.coalesce("bases", F.array().cast("array<string>")).alias("bases"))
        # Types by name: what a method's own line says, else the file's first other line.
        pairs = F.lit(None)
        for lang, p in _DECLARED.items():
            name, kind = (F.regexp_extract_all("line", F.lit(p), i) for i in ((2, 1) if lang == "cs" else (1, 2)))
            pairs = F.when(F.col("lang") == lang, F.arrays_zip(name.alias("n"), kind.alias("t"))).otherwise(pairs)
        declared = inside.select("file_id", F.when(F.col("own").isNotNull(), F.col("line_no")).alias("scope"), "line_no", F.explode(pairs).alias("d"))
        first = F.min_by(F.col("d.t"), F.struct("line_no", F.col("d.t"))).alias("t")
        local = declared.where("scope is not null").groupBy("file_id", F.col("scope").alias("mline"), F.col("d.n").alias("receiver")).agg(first)
        field = declared.where("scope is null").groupBy("file_id", F.col("d.n").alias("receiver")).agg(first)
        sites = inside.where("own is null and src is not null").select("lang", "file_id", "line_no", "mline", F.col("class").alias("src_class"), "src", F.explode(F.regexp_extract_all("line", F.lit(_SITE), 0)).alias("site"))
        sites = sites.withColumns({"receiver": F.nullif(F.regexp_extract("site", r"^(\w+)(?:\.|::)", 1), F.lit("")), "dst": F.regexp_extract("site", r"(\w+)\($", 1)}).where(~F.col("dst").isin(*_KEYWORDS))
        typed = sites.join(local.withColumnRenamed("t", "t1"), ["file_id", "mline", "receiver"], "left").join(field.withColumnRenamed("t", "t2"), ["file_id", "receiver"], "left")
        own = F.col("receiver").isNull() | F.col("receiver").isin(*_OWN)
        rtype = F.when(own, F.col("src_class")).when(F.rlike("receiver", F.lit("^[A-Z]")), F.col("receiver")).otherwise(F.coalesce("t1", "t2"))
        out = typed.select("lang", "file_id", "line_no", "src_class", "src", "receiver", rtype.alias("rtype"), "dst")
        return {"sites": out, "methods": methods}, lambda written: {}

    tables, _ = kept(spark, "calls", [f"{folder}/documents.parquet"], build)
    return tables["sites"], tables["methods"]


def _edges(spark, folder):
    """(src, dst) of calls by method names that some text defines."""
    sites, methods = _call_tables(spark, folder)
    return sites.join(methods.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").where("src <> dst").select("src", "dst").distinct()


def _up(edges):
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


_ROOTS = ("Purge", "Notify", "Balance", "Rename")


def _roots(spark, *names):
    return spark.createDataFrame([(n, n) for n in names or _ROOTS], "root string, node string")


def call_sites(spark, folder):
    """Call sites by language and by what is known of the receiver."""
    how = F.when(F.col("receiver").isNull(), "none").when(F.col("receiver").isin(*_OWN), "own").when(F.col("rtype").isNull(), "unknown").when(F.col("receiver") == F.col("rtype"), "a type").otherwise("declared")
    return _call_tables(spark, folder)[0].groupBy("lang", how.alias("how")).agg(F.count("*").alias("n_sites"), F.count_distinct("src_class", "src").alias("n_callers"))


def code_methods(spark, folder):
    """Methods of three languages with their classes and these classes' bases."""
    return _call_tables(spark, folder)[1].select("lang", "file_id", "line_no", "class", "name", F.array_join("bases", ",").alias("bases"))


def typed_calls(spark, folder):
    """Resolved calls: the receiver's type is the method's class, its interface by name, or one of its bases. Built-in receivers mean nothing.

    Both sides meet on type and method name together, so a common method name alone is no hot key.
    """
    sites, methods = _call_tables(spark, folder)
    low = F.lower("class")
    keys = F.array_distinct(F.concat(F.array(low, F.concat(F.lit("i"), low)), F.transform("bases", F.lower)))
    offered = methods.where("class is not null").select(F.explode(keys).alias("type"), F.lower("name").alias("method"), F.col("class").alias("dst_class"), F.col("name").alias("dst")).distinct()
    asked = sites.where("rtype is not null").where(~F.lower("rtype").isin([b.lower() for b in G.BUILTIN_RECEIVERS])).select(F.lower("rtype").alias("type"), F.lower("dst").alias("method"), "src_class", "src")
    return asked.join(offered, ["type", "method"]).groupBy("src_class", "src", "dst_class", "dst").agg(F.count("*").alias("n_sites"))


def call_edges(spark, folder):
    return _edges(spark, folder)


def call_tree_down(spark, folder):
    return G.reach(_edges(spark, folder), _roots(spark), 3)


def call_tree_up(spark, folder):
    return G.reach(_up(_edges(spark, folder)), _roots(spark), 3)


def call_tree_budget(spark, folder):
    """Ten callees per level by name, forty nodes in all."""
    return G.within_budget(G.reach(_edges(spark, folder), _roots(spark, "Purge", "Notify"), 3, per_level=10), 40)


def call_tree_shared(spark, folder):
    """Trees of several methods that share a budget of sixty nodes."""
    return G.within_budget(G.reach(_up(_edges(spark, folder)), _roots(spark), 3), 60, shared=True)


def _tests(spark, folder):
    """(node): names of definitions that carry a test's attribute."""
    return _defs(spark, folder, "def_id", "name", "attributes").where(Y.is_test(F.lit(""))).where("name is not null").select(F.col("name").alias("node")).distinct()


def call_tree_ranked(spark, folder):
    """The five most popular callers per level, tests after all others; popularity is how often texts of the index use the name."""
    totals = _prepared(spark, folder).vocabulary.select(F.col("token"), "total")
    edges = _up(_edges(spark, folder))
    ranks = edges.select("dst").distinct().join(totals, F.lower("dst") == F.col("token"), "left").join(_tests(spark, folder).withColumnRenamed("node", "dst").withColumn("is_test", F.lit(1)), "dst", "left")
    ranks = ranks.select(F.col("dst").alias("node"), F.coalesce("is_test", F.lit(0)).alias("is_test"), F.coalesce("total", F.lit(0)).alias("popularity"))
    return G.reach(edges, _roots(spark), 2, per_level=5, order=[F.asc("is_test"), F.desc("popularity"), F.asc("node")], ranks=ranks)


def impact_tests(spark, folder):
    """Tests that reach a changed method through its callers, with depth and chain; a path ends at a test, and tests are exempt from caps."""
    tests = _tests(spark, folder)
    tree = G.reach(_up(_edges(spark, folder)), _roots(spark), 10, chains=True, stop=tests)
    return tree.where("depth > 0").join(tests, "node", "left_semi").select("root", "node", "depth", F.array_join("chain", ">").alias("chain"))


def node_kinds(spark, folder):
    """Nodes of the trees of callers by the kinds their names are defined as."""
    tree = G.reach(_up(_edges(spark, folder)), _roots(spark), 3).select("root", "node")
    kinds = _defs(spark, folder, "def_id", "name", "kind").select(F.col("name").alias("node"), "kind").distinct()
    return tree.join(kinds, "node", "left").groupBy("root", F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n_nodes"))


def low_counts(spark, folder):
    """Methods with one to three callers, and how often texts use the name: a gap calls for a search of the texts."""
    callers = _edges(spark, folder).groupBy("dst").agg(F.count("*").alias("n_callers")).where("n_callers between 1 and 3")
    totals = _prepared(spark, folder).vocabulary.select("token", "total")
    return callers.join(totals, F.lower("dst") == F.col("token"), "left").select(F.col("dst").alias("method"), "n_callers", F.coalesce("total", F.lit(0)).alias("in_texts"))


def _declared(spark, folder):
    """(class, interface, method): interfaces among the direct bases of classes, structs and records that declare a method."""
    defs = _defs(spark, folder, "def_id", "name", "kind", "parent", "base_types").where("name is not null")
    listed = defs.where(Y.kinds("class", "struct", "record")).select("name", F.explode("base_types").alias("b")).select(F.lower("name").alias("class"), Y.base_name(F.col("b")).alias("interface")).distinct()
    interfaces = defs.where(Y.kinds("interface")).select(F.lower("name").alias("interface")).distinct()
    methods = defs.where(Y.kinds("method", "function")).select(F.lower(bare_name(F.col("parent"))).alias("interface"), F.lower("name").alias("method")).distinct()
    return listed.join(interfaces, "interface").join(methods, "interface").select("class", "interface", "method")


def interface_gate(spark, folder):
    return _declared(spark, folder)


def sibling_groups(spark, folder):
    """(def_id, group): methods that are one interface's method in different classes; one row per method and group, never their pairs."""
    methods = _defs(spark, folder, "def_id", "name", "kind", "parent").where(Y.kinds("method", "function")).select("def_id", F.lower("name").alias("method"), F.lower(bare_name(F.col("parent"))).alias("class"))
    gate = _declared(spark, folder)
    own = gate.select(F.col("interface").alias("class"), "interface", "method").distinct()
    return methods.join(gate.union(own).distinct(), ["class", "method"]).select("def_id", F.concat_ws(".", "interface", "method").alias("group")).distinct()


_NAMES = """call_sites code_methods typed_calls call_edges call_tree_down call_tree_up call_tree_budget call_tree_shared call_tree_ranked impact_tests node_kinds low_counts interface_gate sibling_groups""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# ---- SQL ----------------------------------------------------------------------------------------


def _case(patterns: dict[str, str]) -> str:
    return "nullif(CASE lang " + " ".join(f"WHEN '{k}' THEN regexp_extract(line, '{p}', 1)" for k, p in patterns.items()) + " END, '')"


_LIST = lambda values: ", ".join(f"'{v}'" for v in values)
_TYPES = "CASE lang " + " ".join(f"WHEN '{k}' THEN list_zip(regexp_extract_all(line, '{p}', {2 if k == 'cs' else 1}), regexp_extract_all(line, '{p}', {1 if k == 'cs' else 2}))" for k, p in _DECLARED.items()) + " END"
_SITES = (
    _DOCS
    + f""", code AS (SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS lang, l.* FROM lines l JOIN docs USING (file_id) WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ({_LIST(LANGUAGES)})),
marked AS (SELECT *, CASE WHEN {_case(_METHOD)} NOT IN ({_LIST(_KEYWORDS)}) THEN {_case(_METHOD)} END AS own, {_case(_CLASS)} AS owner FROM code),
based AS (SELECT *, CASE WHEN owner IS NOT NULL THEN list_filter(regexp_extract_all(line, '{_BASES}', 1), lambda b: b <> owner) END AS own_bases FROM marked),
inside AS MATERIALIZED (SELECT *, last_value(own IGNORE NULLS) OVER w AS src, last_value(CASE WHEN own IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS mline, last_value(owner IGNORE NULLS) OVER w AS class,
    last_value(own_bases IGNORE NULLS) OVER w AS bases FROM based WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
methods AS MATERIALIZED (SELECT lang, file_id, line_no, class, own AS name, coalesce(bases, []) AS bases FROM inside WHERE own IS NOT NULL),
declared AS (SELECT file_id, scope, line_no, d[1] AS n, d[2] AS t FROM (SELECT file_id, CASE WHEN own IS NOT NULL THEN line_no END AS scope, line_no, unnest({_TYPES}) AS d FROM inside)),
local AS (SELECT file_id, scope AS mline, n AS receiver, arg_min(t, (line_no, t)) AS t1 FROM declared WHERE scope IS NOT NULL GROUP BY ALL),
field AS (SELECT file_id, n AS receiver, arg_min(t, (line_no, t)) AS t2 FROM declared WHERE scope IS NULL GROUP BY ALL),
cut_sites AS (SELECT lang, file_id, line_no, mline, class AS src_class, src, unnest(regexp_extract_all(line, '{_SITE}')) AS site FROM inside WHERE own IS NULL AND src IS NOT NULL),
named AS (SELECT *, nullif(regexp_extract(site, '^(\\w+)(?:\\.|::)', 1), '') AS receiver, regexp_extract(site, '(\\w+)\\($', 1) AS dst FROM cut_sites),
sites AS MATERIALIZED (SELECT lang, file_id, line_no, src_class, src, receiver, dst, CASE WHEN receiver IS NULL OR receiver IN ({_LIST(_OWN)}) THEN src_class WHEN regexp_matches(receiver, '^[A-Z]') THEN receiver ELSE coalesce(t1, t2) END AS rtype
    FROM named LEFT JOIN local USING (file_id, mline, receiver) LEFT JOIN field USING (file_id, receiver) WHERE dst NOT IN ({_LIST(_KEYWORDS)})),
down AS MATERIALIZED (SELECT DISTINCT src, dst FROM sites WHERE src <> dst AND dst IN (SELECT name FROM methods)),
up AS (SELECT dst AS src, src AS dst FROM down)"""
)
_TESTS = f""", d AS (SELECT DISTINCT def_id, name, kind, attributes FROM definitions WHERE def_id IS NOT NULL),
tests AS MATERIALIZED (SELECT DISTINCT name AS node FROM d WHERE name IS NOT NULL AND len(list_filter(attributes, lambda a: regexp_replace(lower(regexp_extract(trim(regexp_replace(regexp_replace(a, '\\(.*$', ''), '<.*$', '')), '([^.:]*)[.:]*$', 1)), 'attribute$', '') IN ({_LIST(Y.TEST_ATTRIBUTES)}))) > 0)"""


def _levels(edges: str, depth: int, roots: tuple[str, ...] = _ROOTS, cap: int = 0, order: str = "node", ranks: str = "", stop: str = "", chains: bool = False) -> str:
    """CTEs l0 to l<depth> of a breadth-first search, and walk with all of them."""
    chain = ", n AS chain" if chains else ""
    out = [f"l0 AS MATERIALIZED (SELECT n AS root, n AS node, 0 AS depth{chain} FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in roots)}) v(n))"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT root, node FROM l{i}" for i in range(k))
        ended = f" AND l.node NOT IN (SELECT node FROM {stop})" if stop and k > 1 else ""
        grown = ", min(concat(l.chain, '>', e.dst)) AS chain" if chains else ""
        step = f"SELECT l.root, e.dst AS node, {k} AS depth{grown} FROM l{k - 1} l JOIN {edges} e ON e.src = l.node WHERE (l.root, e.dst) NOT IN ({seen}){ended} GROUP BY l.root, e.dst"
        if cap:
            step = f"SELECT root, node, depth FROM (SELECT s.*, row_number() OVER (PARTITION BY root ORDER BY {order}) AS place FROM ({step}) s {ranks}) WHERE place <= {cap}"
        out.append(f"l{k} AS MATERIALIZED ({step})")
    every = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth + 1))
    return ", " + ", ".join(out) + f", walk AS ({every})"


_RANKS = "LEFT JOIN df ON df.token = lower(s.node)"
_GATE = f"""{_D}, n AS (SELECT * FROM d WHERE name IS NOT NULL), listed AS (SELECT DISTINCT lower(name) AS class, {_BASE} AS interface FROM (SELECT name, unnest(base_types) AS b FROM n WHERE kind IN ('class', 'struct', 'record'))),
m AS (SELECT DISTINCT lower({_BARE}) AS interface, lower(name) AS method FROM n WHERE kind IN ('method', 'function')),
gate AS (SELECT class, interface, method FROM listed JOIN m USING (interface) WHERE interface IN (SELECT lower(name) FROM n WHERE kind = 'interface'))"""

SQL = {
    "call_sites": f"""{_SITES} SELECT lang, CASE WHEN receiver IS NULL THEN 'none' WHEN receiver IN ({_LIST(_OWN)}) THEN 'own' WHEN rtype IS NULL THEN 'unknown' WHEN receiver = rtype THEN 'a type' ELSE 'declared' END AS how,
        count(*) AS n_sites, count(DISTINCT CASE WHEN src_class IS NOT NULL THEN (src_class, src) END) AS n_callers FROM sites GROUP BY ALL""",
    "code_methods": f"{_SITES} SELECT lang, file_id, line_no::INT AS line_no, class, name, array_to_string(bases, ',') AS bases FROM methods",
    "typed_calls": f"""{_SITES}, offered AS (SELECT DISTINCT unnest(list_concat([lower(class), 'i' || lower(class)], list_transform(bases, lambda b: lower(b)))) AS type, lower(name) AS method, class AS dst_class, name AS dst FROM methods WHERE class IS NOT NULL)
        SELECT src_class, src, dst_class, o.dst, count(*) AS n_sites FROM sites s JOIN offered o ON o.type = lower(s.rtype) AND o.method = lower(s.dst) WHERE lower(rtype) NOT IN ({_LIST(b.lower() for b in G.BUILTIN_RECEIVERS)}) GROUP BY ALL""",
    "call_edges": f"{_SITES} SELECT src, dst FROM down",
    "call_tree_down": f"{_SITES}{_levels('down', 3)} SELECT * FROM walk",
    "call_tree_up": f"{_SITES}{_levels('up', 3)} SELECT * FROM walk",
    "call_tree_budget": f"{_SITES}{_levels('down', 3, ('Purge', 'Notify'), cap=10)} SELECT root, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS n FROM walk) WHERE n <= 40",
    "call_tree_shared": f"{_SITES}{_levels('up', 3)} SELECT * FROM walk ORDER BY depth, node, root LIMIT 60",
    "call_tree_ranked": _SITES
    + _IDX.replace("WITH kept", ", kept", 1).replace("files AS", "listed_files AS").replace("counts AS", "token_counts AS")
    + _TESTS
    + _levels("up", 2, cap=5, order="(s.node IN (SELECT node FROM tests))::INT, coalesce(total, 0) DESC, s.node", ranks=_RANKS)
    + " SELECT * FROM walk",
    "impact_tests": f"{_SITES}{_TESTS}{_levels('up', 10, stop='tests', chains=True)} SELECT root, node, depth, chain FROM walk WHERE depth > 0 AND node IN (SELECT node FROM tests)",
    "node_kinds": f"""{_SITES}{_levels('up', 3)}, k AS (SELECT DISTINCT name AS node, kind FROM definitions WHERE def_id IS NOT NULL) SELECT root, coalesce(kind, 'unknown') AS kind, count(*) AS n_nodes FROM walk LEFT JOIN k USING (node) GROUP BY ALL""",
    "low_counts": _SITES
    + _IDX.replace("WITH kept", ", kept", 1).replace("files AS", "listed_files AS").replace("counts AS", "token_counts AS")
    + """, c AS (SELECT dst, count(*) AS n FROM down GROUP BY dst HAVING count(*) BETWEEN 1 AND 3) SELECT dst AS method, n AS n_callers, coalesce(total, 0) AS in_texts FROM c LEFT JOIN df ON token = lower(dst)""",
    "interface_gate": f"{_GATE} SELECT * FROM gate",
    "sibling_groups": f"""{_GATE}, own AS (SELECT * FROM gate UNION SELECT interface, interface, method FROM gate)
        SELECT DISTINCT def_id, concat(interface, '.', method) AS "group" FROM (SELECT def_id, lower(name) AS method, lower({_BARE}) AS class FROM d WHERE kind IN ('method', 'function')) JOIN own USING (class, method)""",
}
