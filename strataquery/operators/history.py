"""Commit history: logs and blame read from text, histories, authors, activity and branch status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions.text import clean
from strataquery.session import stored

SEPARATOR = "\x1e"


def read_log(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, file_commits) of a log's records (seq, record), which were separated by NUL.

    A record `COMMIT:hash RS time RS mail RS name RS subject` starts a commit (RS is the record
    separator); the records after it are paths. Malformed commit records and the paths after them are
    skipped; a subject that holds the separator is put together again. The window over seq runs per log
    (column `log`, one log if absent).
    """
    if "log" not in records.columns:
        records = records.withColumn("log", F.lit(0))
    parts = F.split("record", SEPARATOR)
    is_head = F.startswith("record", F.lit("COMMIT:"))
    good = is_head & (F.size(parts) >= 5) & F.rlike(F.element_at(parts, 1), F.lit("^COMMIT:[0-9a-f]{40}$")) & F.rlike(F.try_element_at(parts, F.lit(2)), F.lit("^-?\\d+$"))
    heads = records.withColumn("hash", F.when(good, F.substr(F.element_at(parts, 1), F.lit(8))).when(is_head, F.lit("")))
    filled = heads.withColumn("of", F.last("hash", ignorenulls=True).over(Window.partitionBy("log").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    commits = heads.where(good).select(
        "hash",
        F.timestamp_seconds(F.element_at(parts, 2).cast("long")).alias("ts"),
        F.element_at(parts, 3).alias("email"),
        F.element_at(parts, 4).alias("name"),
        F.array_join(F.slice(parts, 5, F.size(parts)), SEPARATOR).alias("subject"),
    )
    paths = filled.where(~is_head & (F.col("of") != "") & (F.btrim("record", F.lit(" \r\n")) != "")).select(clean(F.btrim("record", F.lit(" \r\n"))).alias("path"), F.col("of").alias("hash"))
    return commits, paths.distinct()


def read_blame(lines: DataFrame) -> DataFrame:
    """(path, line_no, hash8, name, email, ts, content) of porcelain blame lines (path, seq, line).

    Headers of a commit come once; later lines of the same commit take them by a join on its hash.
    """
    head = F.regexp_extract("line", r"^([0-9a-f]{40}) \d+ (\d+)", 1)
    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"hash": F.nullif(head, F.lit("")), "no": F.nullif(F.regexp_extract("line", r"^([0-9a-f]{40}) \d+ (\d+)", 2), F.lit("")).cast("int")})
    filled = marked.withColumns({"of": F.last("hash", True).over(w), "at": F.last("no", True).over(w)})
    value = lambda key: F.max(F.when(F.startswith("line", F.lit(f"{key} ")), F.substr("line", F.lit(len(key) + 2))))
    headers = filled.groupBy("of").agg(value("author").alias("name"), value("author-mail").alias("email"), value("author-time").alias("time"))
    content = filled.where(F.startswith("line", F.lit("\t"))).select("path", "of", F.col("at").alias("line_no"), F.substr("line", F.lit(2)).alias("content"))
    return content.join(headers, "of").select(
        "path", "line_no", F.left("of", F.lit(8)).alias("hash8"), "name", F.regexp_replace("email", "[<>]", "").alias("email"), F.timestamp_seconds(F.col("time").cast("long")).alias("ts"), "content"
    )


def blame_range(blame: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Lines first to last (only first, if not given) of every blamed file."""
    return blame.where(F.col("line_no").between(first, last if last is not None else first))


def blame_summary(blame: DataFrame) -> DataFrame:
    """Per path: lines, different authors and commits, first and last time."""
    who = F.struct("name", "email")
    return blame.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_distinct(who).alias("n_authors"), F.count_distinct("hash8").alias("n_commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def still_valid(cache: DataFrame, head: DataFrame) -> DataFrame:
    """(name, valid): a cached history holds if it ends at the head and was made of as much history (name, head, shallow; head, shallow)."""
    now = head.select(F.col("head").alias("__head"), F.col("shallow").alias("__shallow"))
    return cache.join(F.broadcast(now.limit(1)), how="left").select("name", (F.col("head").eqNullSafe(F.col("__head")) & F.col("shallow").eqNullSafe(F.col("__shallow"))).alias("valid"))


def under_prefix(path: Column, prefix: str) -> Column:
    """The path itself or anything below; an empty prefix is everything."""
    return F.lit(True) if not prefix else (path == prefix) | F.startswith(path, F.lit(prefix.rstrip("/") + "/"))


def between(ts: Column, first: str | None, last: str | None) -> Column:
    """Days from first to last, both whole."""
    test = F.lit(True)
    if first:
        test &= ts >= F.to_timestamp(F.lit(first))
    if last:
        test &= ts < F.to_timestamp(F.date_add(F.to_date(F.lit(last)), 1))
    return test


def file_history(commits: DataFrame, touched: DataFrame, path: str, size: int, author: str | None = None, first: str | None = None, last: str | None = None, message: str | None = None) -> DataFrame:
    """The newest commits of a path with the number of all before the limit."""
    rows = commits.join(touched.where(under_prefix(F.col("path"), path)).select("commit_id").distinct(), "commit_id", "left_semi").where(between(F.col("ts"), first, last))
    if author:
        rows = rows.where(F.contains(F.lower("name"), F.lit(author.lower())) | F.coalesce(F.contains(F.lower("email"), F.lit(author.lower())), F.lit(False)))
    if message:
        rows = rows.where(F.contains(F.lower("subject"), F.lit(message.lower())))
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(F.desc("ts"), F.asc("commit_id")).limit(size).withColumn("total", total)


def authors(commits: DataFrame, touched: DataFrame, prefix: str, top: int | None = None) -> DataFrame:
    """Per author: distinct commits below the prefix, first and last; with top the authors with most commits, ties by author."""
    hit = touched.where(under_prefix(F.col("path"), prefix)).select("commit_id").distinct()
    found = _authors(commits, hit)
    return found.orderBy(F.desc("n_commits"), "author_id").limit(top) if top else found


def _authors(commits: DataFrame, hit: DataFrame) -> DataFrame:
    return commits.join(hit, "commit_id", "left_semi").groupBy("author_id").agg(F.count("*").alias("n_commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def activity(commits: DataFrame, touched: DataFrame, prefix: str = "") -> DataFrame:
    """Per file: commits, last change, and authors as one sorted text (one entry per author)."""
    rows = touched.where(under_prefix(F.col("path"), prefix)).join(commits, "commit_id")
    who = F.concat_ws("; ", F.array_sort(F.collect_set("author")))
    return rows.groupBy("path").agg(F.count_distinct("commit_id").alias("n_commits"), F.max("ts").alias("last_modified"), who.alias("authors"))


def ahead_behind(edges: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: commits reachable from ours only and from theirs only; edges (src child, dst parent).

    Both sides are walked to their ends, however far apart they are, in one breadth-first search.
    """
    from strataquery.operators.graph import reach

    heads = ours.select(F.lit(0).alias("root"), "node").union(theirs.select(F.lit(1).alias("root"), "node"))
    sides = stored(reach(edges, heads, depth=None).select("root", "node"), "sides")
    a, b = (sides.where(F.col("root") == side).select("node") for side in (0, 1))
    ahead, behind = (x.join(y, "node", "left_anti").agg(F.count("*").alias(n)) for x, y, n in ((a, b, "ahead"), (b, a, "behind")))
    return ahead.withColumn("behind", behind.scalar())


#: Remote branches that a branch is compared with, in this order (fixed values).
BASES = ("main", "master")


def branch_report(edges: DataFrame, heads: DataFrame, remotes: DataFrame, fetched: Column) -> DataFrame:
    """(branch, base, ahead, behind, related, fetch): branches (branch, node) against the first of BASES they share a commit with.

    edges lead from child to parent; remotes has (name, node); fetched is the age of the last fetch in seconds.
    Without a shared commit base, ahead and behind are null; related then tells whether there was nothing to compare with.
    """
    from strataquery.operators.graph import reach

    known = remotes.where(F.col("name").isin(*BASES))
    roots = heads.select(F.concat(F.lit("b:"), "branch").alias("root"), "node").union(known.select(F.concat(F.lit("r:"), "name"), "node"))
    seen = stored(reach(edges, roots, depth=None).select("root", "node"), "ancestors")
    own = seen.where("root like 'b:%'").select(F.substr("root", F.lit(3)).alias("branch"), "node")
    theirs = seen.where("root like 'r:%'").select(F.substr("root", F.lit(3)).alias("name"), "node")
    shared = own.join(theirs, "node").groupBy("branch", "name").agg(F.count("*").alias("n_shared"))
    rank = F.array_position(F.array(*map(F.lit, BASES)), F.col("name"))
    base = shared.groupBy("branch").agg(F.min_by(F.struct("name", "n_shared"), rank).alias("base"))
    sizes = seen.groupBy("root").agg(F.count("*").alias("n"))
    mine = sizes.where("root like 'b:%'").select(F.substr("root", F.lit(3)).alias("branch"), F.col("n").alias("n_own"))
    other = sizes.where("root like 'r:%'").select(F.substr("root", F.lit(3)).alias("name"), F.col("n").alias("n_their"))
    met = heads.select("branch").join(mine, "branch").join(base, "branch", "left").withColumn("name", F.col("base.name")).join(other, "name", "left")
    n = F.col("base.n_shared")
    related = F.col("name").isNotNull() | (F.lit(known.isEmpty()))
    return met.select("branch", F.col("name").alias("base"), (F.col("n_own") - n).alias("ahead"), (F.col("n_their") - n).alias("behind"), related.alias("related"), fetch_age(fetched).alias("fetch"))


def fetch_age(seconds: Column) -> Column:
    """How stale the last fetch is."""
    return F.when(seconds < 3600, "none").when(seconds < 86400, "hours").when(seconds < 7 * 86400, "days").otherwise("stale")
