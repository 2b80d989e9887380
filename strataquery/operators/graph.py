"""Bounded traversal of graphs given as edges: call trees, type hierarchies, template trees."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.session import stored

#: Calls on these receivers resolve to nothing (fixed values).
BUILTIN_RECEIVERS = (
    "Promise", "Array", "Map", "Set", "Object", "String", "Number", "Boolean", "Date", "RegExp", "Error", "Symbol", "BigInt", "Function", "Math", "JSON", "Reflect", "Proxy",
    "Intl", "Int8Array", "Uint8Array", "Uint8ClampedArray", "Int16Array", "Uint16Array", "Int32Array", "Uint32Array", "Float32Array", "Float64Array", "BigInt64Array",
    "BigUint64Array", "ArrayBuffer", "SharedArrayBuffer", "DataView", "WeakMap", "WeakSet", "WeakRef", "FinalizationRegistry", "console", "window", "document", "globalThis",
    "navigator", "localStorage", "sessionStorage", "setTimeout", "setInterval", "fetch", "Iterator", "Generator", "AsyncGenerator", "AsyncIterator", "TypeError", "RangeError",
    "ReferenceError", "SyntaxError", "URIError", "EvalError", "Task", "List", "Dictionary", "HashSet", "Queue", "Stack", "Console", "Convert", "Enum", "Guid", "Nullable", "Tuple",
    "ValueTuple", "Span", "Memory",
)


def reach(
    edges: DataFrame,
    roots: DataFrame,
    depth: int | None = 3,
    per_level: int | None = None,
    order: list[Column] | None = None,
    chains: bool = False,
    stop: DataFrame | Column | None = None,
    siblings: DataFrame | None = None,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """(root, node, depth[, chain]): nodes reached from roots (root, node) over edges (src, dst).

    Breadth first, all roots at once; a node is taken once per root, at its least depth. depth None goes on
    until nothing new is met. per_level caps the new nodes per root and level after ordering; nodes of stop
    (node), or for which it holds, end a path and are exempt from the cap. ranks (node and columns that order uses) joins them to the
    nodes. siblings (node, group): with a node all nodes of its groups are taken at the same depth. The edges are stored once, and every level is.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    first = roots.select("root", "node", F.lit(0).alias("depth"), F.array(F.col("node").cast("string")).alias("chain"))
    first = first if chains else first.drop("chain")
    levels = [frontier := stored(first.distinct() if siblings is None else _with_siblings(first, siblings, chains), "level")]
    if stop is None:
        ended = lambda rows: rows.withColumn("__end", F.lit(None).cast("boolean"))
    elif isinstance(stop, Column):
        ended = lambda rows: rows.withColumn("__end", F.when(stop, F.lit(True)))
    else:
        ends = stop.select("node").distinct().withColumn("__end", F.lit(True))
        ended = lambda rows: rows.join(ends, "node", "left")
    level = 0
    while depth is None or level < depth:
        level += 1
        source = frontier if stop is None or level == 1 else ended(frontier).where("__end is null").select(*frontier.columns)
        step = source.withColumnRenamed("node", "src").join(edges, "src").select("root", F.col("dst").alias("node"), F.lit(level).alias("depth"), *([F.concat("chain", F.array(F.col("dst").cast("string"))).alias("chain")] if chains else []))
        step = step.groupBy("root", "node", "depth").agg(F.min("chain").alias("chain")) if chains else step.distinct()
        if siblings is not None:
            step = _with_siblings(step, siblings, chains)
        seen = functools.reduce(DataFrame.union, [x.select("root", "node") for x in levels])
        step = step.join(seen, ["root", "node"], "left_anti").select(*frontier.columns)
        if per_level:
            place = F.row_number().over(Window.partitionBy("root", "__end").orderBy(*(order or [F.col("node")])))
            step = ended(step if ranks is None else step.join(ranks, "node", "left")).withColumn("__place", place).where(F.col("__end").isNotNull() | (F.col("__place") <= per_level)).select(*frontier.columns)
        frontier = stored(step, "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return functools.reduce(DataFrame.union, levels)


def _with_siblings(step: DataFrame, siblings: DataFrame, chains: bool) -> DataFrame:
    """step with the other nodes of its nodes' groups, each once, at the same depth."""
    step = stored(step, "step")
    groups = step.join(siblings.select("node", "group"), "node").groupBy("root", "group").agg(F.min("depth").alias("depth"), *([F.min("chain").alias("chain")] if chains else []))
    more = groups.join(siblings.select("group", F.col("node")), "group").select(*step.columns)
    every = step.union(more).groupBy("root", "node").agg(F.min("depth").alias("depth"), *([F.min("chain").alias("chain")] if chains else []))
    return every.select(*step.columns)


def within_budget(tree: DataFrame, budget: int = 200, shared: bool = False) -> DataFrame:
    """The first `budget` nodes of each root, breadth first; shared: of all roots together, which take turns by depth."""
    order = (Window.orderBy("depth", "node", "root") if shared else Window.partitionBy("root").orderBy("depth", "node"))
    if shared:  # the window sees no more rows than the budget
        tree = tree.orderBy("depth", "node", "root").limit(budget)
    return tree.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= budget).drop("__n")


def implements(class_name: Column, interface: Column) -> Column:
    """Whether a class follows an interface's name: the same stem, the stem inside, or half of it in front."""
    stem = F.lower(F.substr(interface, F.lit(2)))
    low = F.lower(class_name)
    n = F.octet_length(stem)
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.octet_length(low)), F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substr(low, i, F.lit(1)) == F.substr(stem, i, F.lit(1))), i).otherwise(acc))
    return F.rlike(interface, F.lit("^I\\p{Lu}")) & ((low == stem) | ((n >= 5) & (F.contains(low, stem) | ((common >= 4) & (common * 2 >= n)))))


def accepts_call(target: Column, receiver: Column, caller: Column, caller_bases: Column, target_bases: Column, extension: Column, interfaces: bool = True) -> Column:
    """Whether a parsed call can mean a method of target.

    With a receiver: the target itself, its interface by name, one of its bases, or a class that follows
    it. Without: the caller's class is the target or names it among its bases. Extension methods always.
    """
    t, r, c = F.lower(target), F.lower(receiver), F.lower(caller)
    by_name = (r == F.concat(F.lit("i"), t)) | (F.startswith(t, F.lit("i")) & (r == F.substr(t, F.lit(2)))) | F.exists(target_bases, lambda b: F.lower(F.substring_index(b, "<", 1)) == r) | implements(target, receiver) | implements(receiver, target)
    known = (r == t) | (by_name if interfaces else F.lit(False))
    alone = (c == t) | ((c == F.concat(F.lit("i"), t)) | F.exists(caller_bases, lambda b: F.lower(F.substring_index(b, "<", 1)) == t) if interfaces else F.lit(False))
    return extension | F.when(receiver.isNotNull(), known).otherwise(F.coalesce(alone, F.lit(False)))


def resolved_calls(calls: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(call_id, def_id) of calls (call_id, method, receiver, caller_class, is_constructor) among methods (def_id, name, kind, parent).

    classes has (name, bases). Built-in receivers resolve to nothing. With a receiver the parent is the
    receiver, or lists it among its bases; without, the parent is the caller's class; calls from outside
    any class reach free functions only.
    """
    low = [b.lower() for b in BUILTIN_RECEIVERS]
    short = F.lower(F.substring_index(F.substring_index("receiver", "<", 1), ".", -1))
    asked = calls.withColumn("__r", short).where(F.col("receiver").isNull() | ~F.col("__r").isin(low)).withColumn("__m", F.lower("method"))
    bases = classes.select(F.lower("name").alias("__p"), F.explode("bases").alias("b")).select("__p", F.lower(F.substring_index("b", "<", 1)).alias("__r")).distinct().withColumn("__lists", F.lit(True))
    met = asked.join(methods.withColumn("__m", F.lower("name")).withColumn("__p", F.lower("parent")), "__m").join(bases, ["__p", "__r"], "left")
    ok = (
        F.when(F.col("receiver").isNotNull(), (F.col("__p") == F.col("__r")) | F.col("__lists"))
        .when(F.col("caller_class").isNotNull(), F.col("__p") == F.lower("caller_class"))
        .otherwise(~F.col("kind").isin("method", "constructor"))
    )
    return met.where(F.coalesce(ok, F.lit(False))).select("call_id", "def_id").distinct()


def binds(arguments: list[dict], parameters: list[dict], arity: int | None = None, generic_arity: int = 0) -> bool:
    """Whether a callable's parameters take a call's arguments.

    An argument has name, type (None if unknown) and ref; a parameter name, type, ref, optional and rest
    (a trailing list). Named arguments bind by name, others to the next free place. Known types must be equal.
    """
    if arity is not None and arity != generic_arity:
        return False
    rest = bool(parameters) and parameters[-1]["rest"]
    taken: dict[int, int] = {}
    spread: bool | None = None  # whether the trailing list got elements (or one whole list)
    free = iter(range(len(parameters)))
    for argument in arguments:
        if argument.get("name"):
            place = next((i for i, p in enumerate(parameters) if p["name"] == argument["name"]), None)
        else:
            place = next((i for i in free if i not in taken), len(parameters) - 1 if rest else None)
        if place is None:
            return False
        parameter = parameters[place]
        if place in taken and not (parameter["rest"] and not argument.get("name") and spread):
            return False
        if argument.get("ref") != parameter.get("ref"):
            return False
        kind, wanted = argument.get("type"), parameter["type"]
        if parameter["rest"]:
            if kind is None:
                spread = spread or len(arguments) > len(parameters)
            elif kind == wanted and place not in taken:
                spread = False
            elif kind == wanted.removesuffix("[]") and wanted.endswith("[]"):
                spread = True
            else:
                return False
        elif kind is not None and kind != wanted:
            return False
        taken[place] = taken.get(place, 0) + 1
    return all(i in taken or p.get("optional") or p["rest"] for i, p in enumerate(parameters))


def selector_status(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(child, status, candidates): whether a child selector has one, several or no component (component, selector)."""
    per = components.groupBy(F.lower("selector").alias("child")).agg(F.count_distinct("component").alias("candidates"))
    status = F.when(F.col("candidates").isNull(), "unresolved").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    children = edges.select(F.lower("child").alias("child")).distinct()
    return children.join(per, "child", "left").select("child", status.alias("status"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
