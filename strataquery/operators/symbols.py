"""Search over definitions: filters, ranking, line containment, audits and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions.fuzzy import jaro_winkler_udf
from strataquery.functions.text import match_tier

#: Kinds that rank first, and kinds that can be called (fixed values).
TYPE_KINDS = ("class", "interface", "enum", "struct", "record")
CALLABLE_KINDS = ("method", "constructor", "function", "storedProcedure", "sqlFunction")
KINDS = TYPE_KINDS + CALLABLE_KINDS + ("property", "field", "delegate", "event", "enumMember", "typeAlias", "variable", "xmlElement", "table", "view", "userDefinedType", "column", "sqlIndex")
#: Attribute names that mark tests (fixed values).
TEST_ATTRIBUTES = (
    "test", "testcase", "testcasesource", "fact", "skippablefact", "theory", "skippabletheory", "testmethod", "datatestmethod", "uitestmethod", "testinitialize", "testcleanup",
    "testfixturesetup", "testfixtureteardown", "rstest", "test_case", "wasm_bindgen_test", "traced_test", "test_context", "proptest", "quickcheck",
)
#: Lines per bin of a range join.
BIN = 64


def once(definitions: DataFrame) -> DataFrame:
    """One row per def_id; repeated rows of the tables are equal."""
    return definitions.where("def_id is not null").dropDuplicates(["def_id"])


def latest_stats(code_stats: DataFrame) -> DataFrame:
    """The latest parse of each def_id; equal times are settled by the greater metrics."""
    metrics = [c for c in code_stats.columns if c not in ("def_id", "parsed_at")]
    last = code_stats.where("def_id is not null").groupBy("def_id").agg(F.max(F.struct("parsed_at", *metrics)).alias("s"))
    return last.select("def_id", *[F.col(f"s.{m}").alias(m) for m in metrics])


def kinds(*names: str) -> Column:
    """Filter by kind; an unknown kind is an error."""
    unknown = set(names) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    return F.col("kind").isin(*names)


def any_contains(column: str, terms: list[str]) -> Column:
    """Whether a string contains any term, without case; null does not."""
    test = F.lit(False)
    for t in terms:
        test |= F.contains(F.lower(column), F.lit(t.lower()))
    return F.coalesce(test, F.lit(False))


def attribute_name(attribute: Column) -> Column:
    """Name of an attribute without arguments, type arguments and qualifier, in lower case."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(attribute, r"\(.*$", ""), "<.*$", ""))
    return F.lower(F.regexp_extract(bare, r"([^.:]*)[.:]*$", 1))


def has_attribute(name: str) -> Column:
    return F.coalesce(F.exists("attributes", lambda a: attribute_name(a) == name.lower()), F.lit(False))


def is_test(path: Column) -> Column:
    """Whether a definition is a test, by its attributes or its file's name."""
    marks = F.exists("attributes", lambda a: F.regexp_replace(attribute_name(a), "attribute$", "").isin(*TEST_ATTRIBUTES) | F.rlike(a, F.lit(r"^cfg\s*\(\s*(test|(all|any)\(([^)]*,)?\s*test\s*(,[^)]*)?\))\s*\)$")))
    return F.coalesce(marks, F.lit(False)) | F.coalesce(F.rlike(F.lower(path), F.lit(r"\.(spec|test)\.(ts|tsx|js)$")), F.lit(False))


def is_test_file(path: Column) -> Column:
    return F.rlike(F.lower(F.translate(path, "\\", "/")), F.lit(r"_tests\.|\.test\.|\.spec\.|/tests?/"))


def base_name(base: Column) -> Column:
    """Base type without type arguments, in lower case."""
    return F.lower(F.trim(F.substring_index(base, "<", 1)))


def has_base(part: str) -> Column:
    return F.coalesce(F.exists("base_types", lambda b: F.contains(F.lower(b), F.lit(part.lower()))), F.lit(False))


def first_term(terms: list[str], column: str = "name") -> Column:
    """Index of the first term the value contains, null without one."""
    low = F.lower(column)
    return F.coalesce(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(i)) for i, t in enumerate(terms)])


def relevance(names: list[str] | None = None, parents: list[str] | None = None) -> list[Column]:
    """Order of matches: parent tier, name tier, types first, short names, name, def_id."""
    order = []
    if parents:
        order.append(F.coalesce(match_tier(F.col("parent"), parents), F.lit(3)))
    if names:
        order.append(match_tier(F.col("name"), names))
    return [*order, F.when(F.col("kind").isin(*TYPE_KINDS), 0).otherwise(1), F.octet_length("name"), F.col("name"), F.col("def_id")]


def covering(points: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """points (file_id, line) with the spans (file_id, line_start, line_end) that cover them.

    Both sides meet in bins of `width` lines, so one huge file is spread over as many keys as it has bins.
    """
    p = points.withColumn("__bin", F.floor(F.col("line") / width))
    s = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.greatest("line_start", "line_end") / width))))
    return p.join(s, ["file_id", "__bin"]).where("line between line_start and line_end").drop("__bin")


def innermost(points: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """For each point (key columns) the def_id of the smallest covering span, ties by def_id."""
    met = covering(points, spans)
    return met.groupBy(*key).agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "def_id")).alias("best")).select(*key, F.col("best.def_id").alias("def_id"))


#: What definitions can be sorted by: seven metrics of their code, and their lines (fixed values).
METRICS = ("cyclomatic_complexity", "cognitive_complexity", "max_nesting_depth", "param_count", "return_count", "call_count", "lambda_count", "lines")


def by_metric(definitions: DataFrame, stats: DataFrame, metric: str, size: int) -> DataFrame:
    """(def_id, name, metric, rank): the `size` definitions with most of a metric, ties by def_id; without stats it is 0. Other metrics are an error."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known are {', '.join(METRICS)}")
    if metric == "lines":
        rows = definitions.withColumn("metric", F.greatest(F.col("line_end") - F.col("line_start"), F.lit(0)) + 1)
    else:
        rows = definitions.join(stats.select("def_id", metric), "def_id", "left").withColumn("metric", F.coalesce(metric, F.lit(0)))
    order = [F.desc("metric"), F.asc("def_id")]
    top = rows.select("def_id", "name", "metric").orderBy(*order).limit(size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def version_base(name: Column) -> Column:
    """The name without a version: four digits or more, or v and digits, at its end."""
    return F.regexp_extract(name, r"^(.*?)[\s_.\-]*(?:\d{4,}|[vV]\d+)$", 1)


def corrected(names: DataFrame, asked: DataFrame, least: float = 0.8, ratio: float = 0.6, top: int = 1) -> DataFrame:
    """(asked, name, similarity): for each asked name the `top` most alike of names (name), ties by the later name.

    Lengths in bytes must be comparable, which is tested before the similarity; names that differ in a
    version number only are no correction. asked is as small as the request and broadcast.
    """
    a, b = F.lower("asked"), F.lower("name")
    shorter, longer = F.least(F.octet_length(a), F.octet_length(b)), F.greatest(F.octet_length(a), F.octet_length(b))
    pairs = names.select("name").distinct().join(F.broadcast(asked), shorter >= ratio * longer)
    other = (version_base(a) != "") & (version_base(a) == version_base(b)) & (a != b)
    scored = pairs.where(~other).withColumn("similarity", F.round(jaro_winkler_udf(a, b), 6)).where(F.col("similarity") >= least)
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("similarity"), F.desc("name")))
    return scored.select("asked", "name", "similarity").withColumn("__place", place).where(F.col("__place") <= top).drop("__place")


def summary(rows: DataFrame, top: int = 3) -> DataFrame:
    """Per group (column `folder`): definitions, counts per kind as text, and the longest types."""
    size = F.col("line_end") - F.col("line_start") + 1
    per_kind = rows.groupBy("folder", "kind").agg(F.count("*").alias("n"))
    counts = per_kind.groupBy("folder").agg(F.sum("n").alias("total"), F.expr("concat_ws(',', array_sort(collect_list(kind || '=' || n)))").alias("kinds"))  # one entry per kind
    order = Window.partitionBy("folder").orderBy(size.desc(), "name", "def_id")
    longest = rows.where(F.col("kind").isin(*TYPE_KINDS)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    names = longest.groupBy("folder").agg(F.expr("concat_ws(',', transform(array_sort(collect_list(struct(place, name))), x -> x.name))").alias("longest"))
    return counts.join(names, "folder", "left").withColumn("longest", F.coalesce("longest", F.lit("")))
