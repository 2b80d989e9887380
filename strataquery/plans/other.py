"""Queries of commit history, reconciliation, evaluation, edits, parsers and streams, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.functions import parsers as P
from strataquery.functions import text as X
from strataquery.operators import edit as E
from strataquery.operators import evaluation as M
from strataquery.operators import history as H
from strataquery.operators import reconcile as R
from strataquery.operators.increment import clean_path, run_states
from strataquery.plans.content import _DOCS, _IDX, _OCC, _documents, _prepared
from strataquery.session import scratch
from strataquery.sources import store
from strataquery.sources.tables import table
from strataquery.streaming import changes as C

# ---- history: orders are commits, customers authors, parts files --------------------------------


def _commits(spark, folder):
    orders = table(spark, folder, "orders", F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("subject"))
    who = table(spark, folder, "customer", F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"), F.lower(F.col("c_mktsegment")).alias("email"))
    return orders.join(who, "author_id")


def _touched(spark, folder):
    parts = table(spark, folder, "part", F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type", F.concat("p_name", F.lit("_"), "p_partkey")).alias("path"))
    return table(spark, folder, "lineitem", F.col("l_orderkey").alias("commit_id"), "l_partkey").distinct().join(parts, "l_partkey").select("commit_id", "path")


def author_summary(spark, folder):
    return H.authors(_commits(spark, folder), _touched(spark, folder), "Brand#12")


def author_summary_top(spark, folder):
    return H.authors(_commits(spark, folder), _touched(spark, folder), "Brand#12", top=10)


def _told(spark, folder):
    """The given commits with their authors, each once, in the order of a log: commit_id, hash, ts, name, email, subject."""
    rows = table(spark, folder, "commits", "commit_id", "hash", "ts", "author_id", "subject", "recorded_at").where("rlike(hash, '^[0-9a-f]{40}$') and ts is not null")
    last = rows.groupBy("hash").agg(F.max(F.struct("recorded_at", "ts", "commit_id", "author_id", "subject")).alias("c")).select("hash", "c.commit_id", "c.ts", "c.author_id", "c.subject")
    who = table(spark, folder, "authors", "author_id", "name", "email").where("author_id is not null")
    text = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x1f\\x{1e}]", " ")
    return last.join(who, "author_id").select("commit_id", "hash", F.date_trunc("second", "ts").alias("ts"), text("name").alias("name"), text("email").alias("email"), text("subject").alias("subject"))


def log_read(spark, folder):
    """A log written from the given commits and read again: one record per commit, then a record per path. One log per month."""
    told = _told(spark, folder)
    head = F.concat_ws(H.SEPARATOR, F.concat(F.lit("COMMIT:"), "hash"), F.unix_seconds("ts").cast("string"), "email", "name", "subject")
    paths = F.array(F.concat(F.lit("src/f"), (F.col("commit_id") % 50).cast("string")), F.concat(F.lit("lib/g"), (F.col("commit_id") % 7).cast("string")))
    records = told.select(F.date_format("ts", "yyyy-MM").alias("log"), "commit_id", F.posexplode(F.concat(F.array(head), paths)).alias("at", "record"))
    commits, touched = H.read_log(records.select("log", (F.col("commit_id") * 4 + F.col("at")).alias("seq"), "record"))
    return touched.join(commits, "hash").groupBy("path").agg(F.count_distinct("hash").alias("n_commits"), F.count_distinct("name", "email").alias("n_authors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _blame(spark, folder):
    """Blame written from the given commits and read again: a commit's headers stand at its first line of a file only."""
    told = _told(spark, folder)
    lines = told.select("hash", "name", "email", "ts", "subject", F.concat(F.lit("src/f"), (F.col("commit_id") % 50).cast("string")).alias("path"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "commit_id")
    no = F.row_number().over(Window.partitionBy("path").orderBy("k", "commit_id"))
    placed = lines.withColumn("no", no)
    first = F.array(F.concat(F.lit("author "), "name"), F.concat(F.lit("author-mail <"), "email", F.lit(">")), F.concat(F.lit("author-time "), F.unix_seconds("ts").cast("string")))
    head = F.concat_ws(" ", "hash", F.col("no").cast("string"), F.col("no").cast("string"))
    told_lines = F.concat(F.array(head), F.when(F.col("k") == 0, first).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("\t"), "subject")))
    return H.read_blame(placed.select("path", "no", F.posexplode(told_lines).alias("at", "line")).select("path", (F.col("no") * 8 + F.col("at")).alias("seq"), "line"))


def blame_lines(spark, folder):
    return H.blame_range(_blame(spark, folder), 2, 5).select("path", "line_no", "hash8", "name", "email", "ts", "content")


def blame_summary(spark, folder):
    return H.blame_summary(H.blame_range(_blame(spark, folder), 1, 20))


def cache_valid(spark, folder):
    """Histories cached at the end of each run: valid as long as their last commit is the head and no commit came in late."""
    commits = table(spark, folder, "commits", "hash", "ts", "recorded_at").where("hash is not null and ts is not null")
    runs = table(spark, folder, "index_runs", "run_id", "finished_at").where("finished_at is not null")
    state = [F.max_by("hash", F.struct("ts", "hash")).alias("head"), F.count_distinct("hash").cast("string").alias("shallow")]
    cached = commits.join(F.broadcast(runs), F.col("recorded_at") <= F.col("finished_at")).groupBy(F.col("run_id").cast("string").alias("name")).agg(*state)
    return H.still_valid(cached, commits.agg(*state))


def file_activity(spark, folder):
    commits = _commits(spark, folder).select("commit_id", "ts", F.concat("name", F.lit(" <"), "email", F.lit(">")).alias("author"))
    return H.activity(commits, _touched(spark, folder))


def file_history(spark, folder):
    return H.file_history(_commits(spark, folder), _touched(spark, folder), "Brand#12", 40, author="customer", first="1995-01-01", last="1997-12-31", message="urgent").select("commit_id", "ts", "name", "total")


def first_commit(spark, folder):
    rows = _touched(spark, folder).join(_commits(spark, folder).select("commit_id", "ts"), "commit_id")
    return rows.groupBy("path").agg(F.min_by("commit_id", F.struct("ts", "commit_id")).alias("commit_id"), F.min("ts").alias("ts"))


def deleted_files(spark, folder):
    """Files of the history that are not at its head (the small parts are)."""
    head = table(spark, folder, "part", F.concat_ws("/", "p_brand", "p_type", F.concat("p_name", F.lit("_"), "p_partkey")).alias("path"), "p_size").where("p_size <= 25")
    return H.activity(_commits(spark, folder).withColumn("author", F.col("name")), _touched(spark, folder)).join(head, "path", "left_anti").select("path", "n_commits", "last_modified")


def commit_log(spark, folder):
    """The given commits, each once with its latest record, per author: number, first, last, subjects."""
    rows = table(spark, folder, "commits", "commit_id", "hash", "ts", "author_id", "subject", "recorded_at").where("hash is not null")
    last = rows.groupBy("hash").agg(F.max(F.struct("recorded_at", "ts", "author_id", "subject")).alias("c"))
    return last.groupBy(F.col("c.author_id").alias("author_id")).agg(F.count("*").alias("n_commits"), F.min("c.ts").alias("first_ts"), F.max("c.ts").alias("last_ts"), F.count("c.subject").alias("n_subjects"))


def commits_per_month(spark, folder):
    rows = table(spark, folder, "commits", "hash", "ts", "subject").where(H.between(F.col("ts"), "2025-02-01", "2025-08-31")).where(F.contains(F.lower("subject"), F.lit("the ")))
    return rows.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.count_distinct("hash").alias("n_commits"))


def author_pool(spark, folder):
    """Authors interned: each pair of name and mailbox once, named by its digest."""
    rows = table(spark, folder, "authors", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("email", F.lit("")).alias("email"))
    return rows.groupBy("name", "email").agg(F.count("*").alias("n_rows")).withColumn("pool_id", F.md5(F.concat("name", F.lit("|"), "email")))


def branch_status(spark, folder):
    """Ahead and behind of two heads in a small graph, as in the fixture of the SQL."""
    edges = spark.createDataFrame([(5, 4), (4, 2), (7, 6), (6, 3), (3, 2), (2, 1), (8, 7), (8, 4)], "src int, dst int")
    one = lambda n: spark.createDataFrame([(n,)], "node int")
    return H.ahead_behind(edges, one(5), one(8))


_PARENTS = [(5, 4), (4, 2), (7, 6), (6, 3), (3, 2), (2, 1), (8, 7), (8, 4), (20, 19), (31, 30)]


def branch_report(spark, folder):
    """Three branches of a small graph against its remote ones: one is ahead and behind, one is related to the second choice only, one to none."""
    edges = spark.createDataFrame(_PARENTS, "src int, dst int")
    heads = spark.createDataFrame([("feature", 5), ("old", 20), ("lost", 31)], "branch string, node int")
    remotes = spark.createDataFrame([("main", 8), ("master", 19), ("other", 31)], "name string, node int")
    return H.branch_report(edges, heads, remotes, F.lit(90_000))


# ---- snapshots and quality ----------------------------------------------------------------------


def reconcile_drift(spark, folder):
    """Inputs of the first and the last run: added, removed, modified."""
    states = run_states(table(spark, folder, "fingerprints", "obs_id", "run_id", "path", "content_hash", "seen_at"), [101, 110])
    return R.drift(states.where("run_id = 101"), states.where("run_id = 110"), "key", "digest").withColumnRenamed("key", "path")


def reconcile_times(spark, folder):
    """Inputs of the last run against the names the first one saw, by times of change alone."""
    seen = table(spark, folder, "fingerprints", "obs_id", "run_id", "path", "modified_nanos", "seen_at").where("path is not null").select("run_id", clean_path(F.col("path")).alias("path"), "obs_id", "seen_at", F.timestamp_micros(F.floor(F.col("modified_nanos") / 1000)).alias("modified"))
    now = seen.where("run_id = 110").groupBy("path").agg(F.max_by("modified", F.struct("seen_at", "obs_id")).alias("modified")).where("modified is not null")
    created = table(spark, folder, "index_runs", "run_id", "started_at").where("run_id = 101").agg(F.min("started_at")).scalar()
    return R.drift_by_time(seen.where("run_id = 101").select("path"), now, created)


def delta_check(spark, folder):
    """Results parsed from the inputs of one run against the inputs of the next: applied, parsed again, given up or removed."""
    states = run_states(table(spark, folder, "fingerprints", "obs_id", "run_id", "path", "content_hash", "seen_at"), [108, 110])
    parsed_ = states.where("run_id = 108").select(F.col("key").alias("path"), "digest", (F.octet_length("key") % 4 + 1).alias("attempt"))
    return R.checked_delta(parsed_, states.where("run_id = 110").select(F.col("key").alias("path"), "digest"))


def stale_runs(spark, folder):
    """Runs whose index was older than two days, or orphaned, when the last run ended; a run without an end has no age."""
    runs = table(spark, folder, "index_runs", "run_id", "status", "finished_at")
    now = runs.agg(F.max("finished_at")).scalar()
    age = F.unix_seconds(now) - F.unix_seconds("finished_at")
    seen = table(spark, folder, "fingerprints", "run_id").distinct()
    orphan = store.orphans(runs.select(F.col("run_id").alias("root")), seen.select(F.col("run_id").alias("root"))).select(F.col("root").alias("run_id"), F.lit(True).alias("orphan"))
    return runs.join(orphan, "run_id", "left").select("run_id", (F.coalesce(age, F.lit(0)) > 2 * 86400).alias("stale"), F.coalesce("orphan", F.lit(False)).alias("orphan"))


def index_sidecar(spark, folder):
    """What the description beside the prepared index says of it."""
    index = _prepared(spark, folder)
    return spark.createDataFrame([(index.n_files, index.total_tokens)], "files long, total_tokens long")


def dataset_parts(spark, folder):
    """Postings written in parts by their tokens' first letter, with a description, and read again."""
    made = store.Dataset(spark, f"{scratch(spark, 'dataset')}/{store.index_name(folder, ['parquet'])}")
    rows = table(spark, folder, "postings", F.lower(F.left("token", F.lit(1))).alias("part"), "token", "file_id", "tf").where("rlike(token, '^[A-Za-z]')")
    made.write(rows, folder, ["parquet"], by="part")
    if made.stale():
        raise ValueError("a dataset that was just written is stale")
    return made.read().groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_tokens"))


def save_points(spark, folder):
    """When a history that saves after five quiet minutes, ten at most, would be saved, by user of the event stream."""
    rows = table(spark, folder, "events", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return C.save_points(rows, "20 minutes", "60 minutes")


def json_fields(spark, folder):
    """Logged results as JSON and back: what is parsed of a text, and what is written of a row."""
    rows = table(spark, folder, "file_scores", "query_id", "path", "occurrences", "terms").where("query_id is not null")
    written = F.to_json(F.struct("query_id", "path", "occurrences", "terms"), {"ignoreNullFields": "false"})
    back = F.from_json("j", "query_id string, path string, occurrences int, terms array<string>")
    return rows.select(written.alias("j")).distinct().select(F.get_json_object("j", "$.path").alias("path"), back.alias("b")).groupBy("b.query_id").agg(F.count("*").alias("n"), F.count("path").alias("n_paths"), F.sum("b.occurrences").alias("occurrences"), F.max(F.size("b.terms")).alias("n_terms"))


def spelling_distance(spark, folder):
    """Names at most two edits from what was asked, with the distance."""
    names = table(spark, folder, "definitions", "name").where("name is not null").distinct()
    asked = spark.createDataFrame([("CacheReader",), ("TileServce",), ("Atach",)], "asked string")
    near = names.join(F.broadcast(asked), F.abs(F.char_length("name") - F.char_length("asked")) <= 2)
    return near.select("asked", "name", F.levenshtein("asked", "name").alias("distance")).where("distance <= 2")


def _judged(spark, folder):
    rows = table(spark, folder, "file_scores", "query_id", "path", "tf_idf", "occurrences", "terms_matched").where("query_id is not null and path is not null")
    score = F.coalesce(F.when(F.isnan("tf_idf"), None).otherwise(F.col("tf_idf")), F.lit(0.0))
    per = rows.groupBy("query_id", "path").agg(F.max(score).alias("score"), F.max(F.coalesce("occurrences", F.lit(0))).alias("occ"), F.max("terms_matched").alias("terms"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    return per.withColumn("rank", rank), per.select("query_id", "path", F.least(F.greatest(F.col("occ") + F.col("terms") - 2, F.lit(0)), F.lit(3)).cast("int").alias("grade"))


def ndcg_mrr(spark, folder):
    runs, judgments = _judged(spark, folder)
    return M.quality(runs.select("query_id", "rank", "path"), judgments)


def mean_quality(spark, folder):
    runs, judgments = _judged(spark, folder)
    return M.mean_quality(M.quality(runs.select("query_id", "rank", "path"), judgments))


# ---- edits --------------------------------------------------------------------------------------


def _texts(spark, folder):
    return _documents(spark, folder).where("text is not null")


def edit_lines(spark, folder):
    return _texts(spark, folder).select("file_id", F.md5(E.edit_lines(F.col("text"), [(2, 3, ["first", "second"]), (1, 0, ["top"]), (5, 5, [])])).alias("digest"))


def replace_nth(spark, folder):
    text = F.col("text")
    return _texts(spark, folder).select("file_id", F.md5(E.replace_nth(text, "return", "yield", 2)).alias("second"), F.md5(E.replace_nth(text, "the", "THE", 0)).alias("every"), E.occurrences_of(text, "return").alias("n"))


def regex_replace(spark, folder):
    return _texts(spark, folder).select("file_id", F.md5(F.regexp_replace("text", r"([a-z]+)Async\(", "$1(")).alias("digest"), F.regexp_count("text", F.lit(r"[a-z]+Async\(")).cast("long").alias("n"))


def insert_anchor(spark, folder):
    text = F.col("text")
    after, before = E.insert_line(text, "using System;", "using Extra;"), E.insert_line(text, "return", "// first", before=True)
    return _texts(spark, folder).select("file_id", F.md5(after).alias("after"), F.md5(before).alias("before"))


def replace_checked(spark, folder):
    """Replacements that hold only in their context or for an expected number of occurrences, and why others do not."""
    text = F.col("text")
    near = E.replace_checked(text, "return", "yield", 1, context="using System;")
    count = E.replace_checked(text, "return", "yield", 0, expected=3)
    return _texts(spark, folder).select("file_id", near.alias("near"), count.alias("count")).select("file_id", F.md5("near.text").alias("near"), "near.problem", F.md5("count.text").alias("count"), F.col("count.problem").alias("count_problem"))


def unified_diff(spark, folder):
    changed = E.replace_nth(F.col("text"), "return", "yield", 1)
    return _texts(spark, folder).where(F.contains("text", F.lit("return"))).select("file_id", E.unified_diff(F.col("text"), changed).alias("diff"))


def nearest_match(spark, folder):
    near = E.nearest_line('throw new ArgumentException("missing palette");')(F.col("text"))
    rows = _documents(spark, folder).where(X.extension(F.col("path")) == "cs").where("text is not null")
    return rows.select("file_id", near.alias("m")).where("m.line is not null").select("file_id", "m.line", "m.ratio")


# ---- parsers ------------------------------------------------------------------------------------


def _by_extension(spark, folder, *extensions):
    return _documents(spark, folder).where(X.extension(F.col("path")).isin(*extensions))


def sql_ddl_symbols(spark, folder):
    return P.parsed(_by_extension(spark, folder, "sql"), "sql_symbols").where("kind in ('table', 'storedProcedure', 'view')").select("file_id", "kind", "schema", "name", "line")


def sql_columns(spark, folder):
    return P.parsed(_by_extension(spark, folder, "sql"), "sql_symbols").where("kind = 'column'").groupBy("schema").agg(F.count("*").alias("n_columns"))


def sql_calls(spark, folder):
    return P.parsed(_by_extension(spark, folder, "sql"), "sql_calls")


def sql_stats(spark, folder):
    """Lines of SQL texts that are neither blank nor comments, a stand-in for their complexity."""
    rows = _by_extension(spark, folder, "sql").where("text is not null")
    kept = F.filter(X.lines(F.col("text")), lambda line: (F.trim(line) != "") & ~F.startswith(F.trim(line), F.lit("--")))
    return rows.select("file_id", F.size(kept).alias("cyclomatic"))


def xml_elements(spark, folder):
    return P.parsed(_by_extension(spark, folder, "xml"), "xml_elements").select("file_id", "element_id", "parent_id", "path", "line", "end_line", "content", "is_leaf")


def xml_search(spark, folder):
    """Elements called cache, leaves that speak of it shown by their parents, in that order."""
    rows = P.parsed(_by_extension(spark, folder, "xml"), "xml_elements")
    low = lambda c: F.contains(F.lower(c), F.lit("cache"))
    named = rows.where(low("name")).select("file_id", "element_id", F.lit("name").alias("how"), F.col("line"), F.lit(0).alias("n_children"))
    speaking = rows.where(~low("name") & low("content"))
    promoted = speaking.where("is_leaf and parent_id is not null").groupBy("file_id", F.col("parent_id").alias("element_id")).agg(F.count("*").cast("int").alias("n_children"))
    promoted = promoted.join(named.select("file_id", "element_id"), ["file_id", "element_id"], "left_anti").join(rows.select("file_id", "element_id", "line"), ["file_id", "element_id"])
    direct = speaking.where("not is_leaf or parent_id is null").select("file_id", "element_id", F.lit("text").alias("how"), "line", F.lit(0).alias("n_children"))
    return named.union(promoted.select("file_id", "element_id", F.lit("promoted"), "line", "n_children")).union(direct)


def custom_elements(spark, folder):
    """Custom elements in the inline templates of components, and the components' selectors."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def elements(html: pd.Series) -> pd.Series:
        return html.map(P.custom_elements)

    rows = _by_extension(spark, folder, "ts").where("text is not null").select("file_id", F.inline(X.components(F.col("text"))))
    return rows.where("template <> ''").select("file_id", "selector", F.explode(elements("template")).alias("child"))


def code_symbols(spark, folder):
    parts = [P.parsed(_by_extension(spark, folder, x), "code_symbols", x).withColumn("language", F.lit(x)) for x in ("cs", "ts", "rs")]
    return parts[0].union(parts[1]).union(parts[2]).select("language", "file_id", "kind", "name", "parent", "line", "end_line", "params", "cyclomatic", "cognitive", "nesting", "returns", "lambdas")


def code_calls(spark, folder):
    """Calls inside methods and functions of three languages, by the scanner; the ordinal counts them within one."""
    parts = [P.parsed(_by_extension(spark, folder, x), "code_calls", x).withColumn("language", F.lit(x)) for x in ("cs", "ts", "rs")]
    return parts[0].union(parts[1]).union(parts[2])


def cs_methods(spark, folder):
    """Names of methods of C# files, by the scanner."""
    rows = P.parsed(_by_extension(spark, folder, "cs"), "code_symbols", "cs").where("kind = 'class'")
    return rows.groupBy("name").agg(F.count("*").alias("n"))


# ---- streams and files --------------------------------------------------------------------------


def stream_windows(spark, folder):
    schema = table(spark, folder, "events").schema
    return C.tumbling(C.file_stream(spark, f"{folder}/events.parquet", schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"))


def stream_sessions(spark, folder):
    """Bursts of a user's events with less than half an hour between them."""
    schema = table(spark, folder, "events").schema
    return C.sessions(C.file_stream(spark, f"{folder}/events.parquet", schema).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key")), "30 minutes")


def stream_delta_index(spark, folder):
    """The content index built from a stream of documents, as totals per file."""
    schema = table(spark, folder, "documents").schema
    rows = C.file_stream(spark, f"{folder}/documents.parquet", schema).where("doc_id is not null")
    events = rows.select(F.col("doc_id").cast("string").alias("path"), F.lit("modify").alias("op"), F.timestamp_seconds(F.col("doc_id")).alias("ts"), "text")
    index = C.StreamedIndex(spark).run(events)
    return index.groupBy("file_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_distinct")).select("n_tokens", "n_distinct")


def table_files(spark, folder):
    """Parquet files below the data folder with their sizes."""
    return store.files(spark, folder, ["parquet"]).select("path", "size")


_NAMES = """author_summary_top log_read blame_lines blame_summary cache_valid reconcile_times delta_check stale_runs index_sidecar dataset_parts save_points json_fields spelling_distance replace_checked
author_summary file_activity file_history first_commit deleted_files commit_log commits_per_month author_pool branch_status branch_report reconcile_drift ndcg_mrr mean_quality
edit_lines replace_nth regex_replace insert_anchor unified_diff nearest_match sql_ddl_symbols sql_columns sql_calls sql_stats xml_elements xml_search custom_elements code_symbols
code_calls cs_methods stream_windows stream_sessions stream_delta_index table_files""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# ---- SQL ----------------------------------------------------------------------------------------

_STAR = """WITH c AS (SELECT o_orderkey AS commit_id, o_orderdate AS ts, o_custkey AS author_id, o_orderpriority AS subject, c_name AS name, lower(c_mktsegment) AS email FROM orders JOIN customer ON c_custkey = o_custkey),
t AS (SELECT DISTINCT l_orderkey AS commit_id, concat_ws('/', p_brand, p_type, concat(p_name, '_', p_partkey)) AS path FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_UNDER = "(path = 'Brand#12' OR starts_with(path, 'Brand#12/'))"
_PATH = r"regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"
_STATE = f"SELECT run_id, {_PATH} AS path, arg_max(lower(content_hash), (seen_at, obs_id)) AS digest FROM fingerprints WHERE content_hash IS NOT NULL AND path IS NOT NULL GROUP BY ALL"
_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
_TOLD = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY recorded_at DESC NULLS LAST, ts DESC, commit_id DESC NULLS LAST, author_id DESC NULLS LAST, subject DESC NULLS LAST) AS age FROM commits WHERE regexp_matches(hash, '^[0-9a-f]{40}$') AND ts IS NOT NULL),
told AS (SELECT commit_id, hash, date_trunc('second', ts) AS ts, regexp_replace(coalesce(name, ''), '[\\x00-\\x1f]', ' ', 'g') AS name, regexp_replace(coalesce(email, ''), '[\\x00-\\x1f]', ' ', 'g') AS email,
    regexp_replace(coalesce(subject, ''), '[\\x00-\\x1f]', ' ', 'g') AS subject FROM l JOIN authors USING (author_id) WHERE age = 1)"""
_BLAME = _TOLD + """, b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k, commit_id) AS line_no FROM (SELECT *, concat('src/f', commit_id % 50) AS path, unnest([0, 1, 2]) AS k FROM told))"""
_QUALITY = """WITH per AS (SELECT query_id, path, max(coalesce(CASE WHEN isnan(tf_idf) THEN NULL ELSE tf_idf END, 0.0)) AS score, max(coalesce(occurrences, 0)) AS occ, max(terms_matched) AS terms
    FROM file_scores WHERE query_id IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank, least(greatest(occ + terms - 2, 0), 3) AS grade FROM per),
i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, path) AS place FROM r WHERE grade > 0) WHERE place <= 10 GROUP BY ALL),
g AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, coalesce(1 / min(rank) FILTER (rank <= 10 AND grade >= 2), 0) AS mrr,
    coalesce(count(*) FILTER (rank <= 50 AND grade > 0) / nullif(count(*) FILTER (grade > 0), 0), 0) AS recall, max((rank = 1 AND grade = 3)::INT) AS success_at_1, sum((rank <= 10 AND grade = 0)::INT)::BIGINT AS negatives_at_10 FROM r GROUP BY ALL),
q AS (SELECT query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg_at_10, round(mrr, 6) AS mrr_at_10, round(recall, 6) AS recall_at_50, success_at_1, negatives_at_10 FROM g LEFT JOIN i USING (query_id))"""
_EDIT = """WITH d AS (SELECT doc_id AS file_id, text, ends_with(text, chr(10)) AS ended FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, string_split(CASE WHEN ended THEN text[:-2] ELSE text END, chr(10)) AS x FROM d)"""
_SQLDOCS = _DOCS + f", s AS (SELECT l.* FROM lines l JOIN docs USING (file_id) WHERE {_EXT} = 'sql')"

SQL = {
    "author_summary": f"{_STAR} SELECT author_id, count(*) AS n_commits, min(ts) AS first_ts, max(ts) AS last_ts FROM c WHERE commit_id IN (SELECT commit_id FROM t WHERE {_UNDER}) GROUP BY ALL",
    "file_activity": f"{_STAR} SELECT path, count(*) AS n_commits, max(ts) AS last_modified, string_agg(DISTINCT concat(name, ' <', email, '>'), '; ' ORDER BY concat(name, ' <', email, '>')) AS authors FROM t JOIN c USING (commit_id) GROUP BY path",
    "file_history": f"""{_STAR}, h AS (SELECT * FROM c WHERE commit_id IN (SELECT commit_id FROM t WHERE {_UNDER}) AND ts >= '1995-01-01' AND ts < '1998-01-01' AND (contains(lower(name), 'customer') OR contains(email, 'customer'))
        AND contains(lower(subject), 'urgent')) SELECT commit_id, ts, name, (SELECT count(*) FROM h) AS total FROM h ORDER BY ts DESC, commit_id LIMIT 40""",
    "first_commit": f"{_STAR} SELECT path, arg_min(commit_id, (ts, commit_id)) AS commit_id, min(ts) AS ts FROM t JOIN c USING (commit_id) GROUP BY path",
    "deleted_files": f"""{_STAR} SELECT path, count(*) AS n_commits, max(ts) AS last_modified FROM t JOIN c USING (commit_id)
        WHERE path NOT IN (SELECT concat_ws('/', p_brand, p_type, concat(p_name, '_', p_partkey)) FROM part WHERE p_size <= 25) GROUP BY path""",
    "commit_log": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY recorded_at DESC NULLS LAST, ts DESC NULLS LAST, author_id DESC NULLS LAST, subject DESC NULLS LAST) AS age FROM commits WHERE hash IS NOT NULL)
        SELECT author_id, count(*) AS n_commits, min(ts) AS first_ts, max(ts) AS last_ts, count(subject) AS n_subjects FROM l WHERE age = 1 GROUP BY ALL""",
    "commits_per_month": "SELECT date_trunc('month', ts) AS month, count(DISTINCT hash) AS n_commits FROM commits WHERE ts >= '2025-02-01' AND ts < '2025-09-01' AND contains(lower(subject), 'the ') GROUP BY ALL",
    "author_pool": "SELECT coalesce(name, '') AS name, coalesce(email, '') AS email, count(*) AS n_rows, md5(concat(coalesce(name, ''), '|', coalesce(email, ''))) AS pool_id FROM authors GROUP BY ALL",
    "branch_status": """WITH RECURSIVE e AS (SELECT * FROM (VALUES (5, 4), (4, 2), (7, 6), (6, 3), (3, 2), (2, 1), (8, 7), (8, 4)) v(src, dst)), w AS (SELECT h AS head, h AS node FROM (VALUES (5), (8)) v(h) UNION SELECT head, dst FROM w JOIN e ON src = node)
        SELECT count(*) FILTER (head = 5 AND node NOT IN (SELECT node FROM w WHERE head = 8)) AS ahead, count(*) FILTER (head = 8 AND node NOT IN (SELECT node FROM w WHERE head = 5)) AS behind FROM w""",
    "branch_report": f"""WITH RECURSIVE e AS (SELECT * FROM (VALUES {', '.join(map(str, _PARENTS))}) v(src, dst)), h AS (SELECT * FROM (VALUES ('feature', 5), ('old', 20), ('lost', 31)) v(branch, node)), r AS (SELECT * FROM (VALUES ('main', 8, 1), ('master', 19, 2)) v(name, node, place)),
        o AS (SELECT branch, node FROM h UNION SELECT branch, dst FROM o JOIN e ON src = node), t AS (SELECT name, place, node FROM r UNION SELECT name, place, dst FROM t JOIN e ON src = node),
        b AS (SELECT branch, arg_min(name, place) AS base FROM o JOIN t USING (node) GROUP BY branch)
        SELECT branch, base, CASE WHEN base IS NOT NULL THEN (SELECT count(*) FROM o WHERE o.branch = h.branch AND node NOT IN (SELECT node FROM t WHERE t.name = base)) END AS ahead,
        CASE WHEN base IS NOT NULL THEN (SELECT count(*) FROM t WHERE t.name = base AND node NOT IN (SELECT node FROM o WHERE o.branch = h.branch)) END AS behind, base IS NOT NULL AS related, 'days' AS fetch FROM h LEFT JOIN b USING (branch)""",
    "reconcile_drift": f"""WITH s AS ({_STATE}), a AS (SELECT path, digest AS was FROM s WHERE run_id = 101), b AS (SELECT path, digest AS now FROM s WHERE run_id = 110)
        SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'modified' END AS status FROM a FULL JOIN b USING (path) WHERE was IS DISTINCT FROM now""",
    "ndcg_mrr": f"{_QUALITY} SELECT * FROM q",
    "mean_quality": f"{_QUALITY} SELECT count(*) AS n_queries, round(avg(ndcg_at_10), 6) AS ndcg_at_10, round(avg(mrr_at_10), 6) AS mrr_at_10, round(avg(recall_at_50), 6) AS recall_at_50, round(avg(success_at_1), 6) AS success_at_1, sum(negatives_at_10)::BIGINT AS negatives_at_10 FROM q",
    "edit_lines": f"""{_EDIT}, a AS (SELECT *, CASE WHEN len(x) >= 5 THEN list_concat(x[:4], x[6:]) ELSE x END AS y FROM l), b AS (SELECT *, CASE WHEN len(x) >= 3 THEN list_concat(y[:1], ['first', 'second'], y[4:]) ELSE y END AS z FROM a)
        SELECT file_id, md5(concat(array_to_string(list_concat(['top'], z), chr(10)), CASE WHEN ended THEN chr(10) ELSE '' END)) AS digest FROM b""",
    "replace_nth": f"""{_EDIT}, p AS (SELECT *, string_split(text, 'return') AS s FROM d) SELECT file_id, md5(CASE WHEN len(s) > 2 THEN concat(array_to_string(s[:2], 'return'), 'yield', array_to_string(s[3:], 'return')) ELSE text END) AS second,
        md5(replace(text, 'the', 'THE')) AS every, len(s) - 1 AS n FROM p""",
    "regex_replace": f"{_EDIT} SELECT file_id, md5(regexp_replace(text, '([a-z]+)Async\\(', '\\1(', 'g')) AS digest, len(regexp_extract_all(text, '[a-z]+Async\\(')) AS n FROM d",
    "insert_anchor": f"""{_EDIT}, k AS (SELECT file_id, text, instr(text, 'using System;') AS pos, instr(text, 'return') AS r FROM d),
        e AS (SELECT *, CASE WHEN pos > 0 AND instr(text[pos:], chr(10)) > 0 THEN pos + instr(text[pos:], chr(10)) - 1 ELSE 0 END AS stop, CASE WHEN r > 0 AND instr(text[r:], chr(10)) > 0 THEN r + instr(text[r:], chr(10)) - 1 ELSE 0 END AS r_stop,
            CASE WHEN contains(text[:r - 1], chr(10)) THEN r - 1 - length(regexp_extract(text[:r - 1], '[^\\n]*$')) ELSE 0 END AS r_start FROM k),
        x AS (SELECT *, CASE WHEN stop > 1 AND text[stop - 1:stop - 1] = chr(13) THEN concat(chr(13), chr(10)) ELSE chr(10) END AS nl, CASE WHEN r_stop > 1 AND text[r_stop - 1:r_stop - 1] = chr(13) THEN concat(chr(13), chr(10)) ELSE chr(10) END AS r_nl FROM e)
        SELECT file_id, md5(CASE WHEN pos = 0 OR (stop > 0 AND (starts_with(text[stop + 1:], concat('using Extra;', nl)) OR text[stop + 1:] = 'using Extra;')) THEN text
            WHEN stop = 0 THEN concat(text, chr(10), 'using Extra;') ELSE concat(text[:stop], 'using Extra;', nl, text[stop + 1:]) END) AS after,
            md5(CASE WHEN r = 0 OR ends_with(text[:r_start], concat(chr(10), '// first', r_nl)) OR text[:r_start] = concat('// first', r_nl) THEN text ELSE concat(text[:r_start], '// first', r_nl, text[r_start + 1:]) END) AS before FROM x""",
    "replace_checked": f"""{_EDIT}, p AS (SELECT *, string_split(text, 'return') AS s FROM d), q AS (SELECT *, len(s) - 1 AS n,
            regexp_matches(text, 'using\\s+System;[^\\n]*\\n?[^\\n]*return|return[^\\n]*\\n?[^\\n]*using\\s+System;') AS near FROM p),
        r AS (SELECT *, CASE WHEN n = 0 THEN 'not found' WHEN NOT near THEN 'not in its context' END AS p1, CASE WHEN n = 0 THEN 'not found' WHEN n <> 3 THEN concat('occurrences: ', n) END AS p2 FROM q)
        SELECT file_id, md5(CASE WHEN p1 IS NULL THEN concat(s[1], 'yield', array_to_string(s[2:], 'return')) ELSE text END) AS near, p1 AS problem, md5(CASE WHEN p2 IS NULL THEN replace(text, 'return', 'yield') ELSE text END) AS "count", p2 AS count_problem FROM r""",
    "author_summary_top": f"{_STAR} SELECT author_id, count(*) AS n_commits, min(ts) AS first_ts, max(ts) AS last_ts FROM c WHERE commit_id IN (SELECT commit_id FROM t WHERE {_UNDER}) GROUP BY ALL ORDER BY n_commits DESC, author_id LIMIT 10",
    "log_read": f"""{_TOLD}, p AS (SELECT *, unnest([concat('src/f', commit_id % 50), concat('lib/g', commit_id % 7)]) AS path FROM told)
        SELECT path, count(DISTINCT hash) AS n_commits, count(DISTINCT (name, email)) AS n_authors, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY ALL""",
    "blame_lines": f"{_BLAME} SELECT path, line_no::INT AS line_no, hash[:8] AS hash8, name, regexp_replace(email, '[<>]', '', 'g') AS email, ts, subject AS content FROM b WHERE line_no BETWEEN 2 AND 5",
    "blame_summary": f"""{_BLAME} SELECT path, count(*) AS n_lines, count(DISTINCT (name, regexp_replace(email, '[<>]', '', 'g'))) AS n_authors, count(DISTINCT hash[:8]) AS n_commits, min(ts) AS first_ts, max(ts) AS last_ts FROM b WHERE line_no <= 20 GROUP BY ALL""",
    "cache_valid": """WITH c AS (SELECT * FROM commits WHERE hash IS NOT NULL AND ts IS NOT NULL), h AS (SELECT arg_max(hash, (ts, hash)) AS head, count(DISTINCT hash) AS n FROM c),
        r AS (SELECT run_id::VARCHAR AS name, arg_max(hash, (ts, hash)) AS head, count(DISTINCT hash) AS n FROM c JOIN index_runs ON recorded_at <= finished_at GROUP BY ALL) SELECT name, r.head = h.head AND r.n = h.n AS valid FROM r, h""",
    "reconcile_times": f"""WITH s AS (SELECT run_id, {_PATH} AS path, arg_max(modified_nanos // 1000, (seen_at, obs_id)) AS m FROM fingerprints WHERE path IS NOT NULL GROUP BY ALL), a AS (SELECT path FROM s WHERE run_id = 101), b AS (SELECT path, m FROM s WHERE run_id = 110 AND m IS NOT NULL),
        t AS (SELECT epoch_us(min(started_at)) AS created FROM index_runs WHERE run_id = 101)
        SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN m IS NULL THEN 'removed' ELSE 'modified' END AS status FROM (SELECT path, 1 AS was FROM a) FULL JOIN b USING (path), t WHERE was IS NULL OR m IS NULL OR m > created - 2000000""",
    "delta_check": f"""WITH s AS ({_STATE}), a AS (SELECT path, digest, strlen(path) % 4 + 1 AS attempt FROM s WHERE run_id = 108), b AS (SELECT path, digest AS now FROM s WHERE run_id = 110)
        SELECT path, CASE WHEN now IS NULL THEN 'remove' WHEN now = digest THEN 'apply' WHEN attempt < 3 THEN 'again' ELSE 'keep old' END AS verdict FROM a LEFT JOIN b USING (path)""",
    "stale_runs": """WITH n AS (SELECT max(finished_at) AS now FROM index_runs) SELECT run_id, coalesce(epoch(date_trunc('second', now))::BIGINT - epoch(date_trunc('second', finished_at))::BIGINT, 0) > 2 * 86400 AS stale,
        run_id NOT IN (SELECT run_id FROM fingerprints WHERE run_id IS NOT NULL) AS orphan FROM index_runs, n""",
    "index_sidecar": f"{_IDX} SELECT (SELECT count(*) FROM files) AS files, (SELECT sum(token_count) FROM counts)::BIGINT AS total_tokens",
    "dataset_parts": "SELECT lower(token[1]) AS part, count(*) AS n, count(DISTINCT token) AS n_tokens FROM postings WHERE regexp_matches(token, '^[A-Za-z]') GROUP BY ALL",
    "save_points": """WITH g AS (SELECT user_id AS key, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS stretch FROM g), b AS (SELECT *, min(ts) OVER p AS f, max(ts) OVER p AS t FROM s WINDOW p AS (PARTITION BY key, stretch)),
        k AS (SELECT *, (epoch_us(ts) - epoch_us(f)) // 3600000000 AS turn FROM b)
        SELECT key, least(f + (turn + 1) * INTERVAL 1 HOUR, t + INTERVAL 20 MINUTE) AS save_ts, count(*) AS n_changes FROM k GROUP BY key, f, t, turn""",
    "json_fields": """WITH r AS (SELECT DISTINCT query_id, path, occurrences, terms FROM file_scores WHERE query_id IS NOT NULL) SELECT query_id, count(*) AS n, count(path) AS n_paths, sum(occurrences)::BIGINT AS occurrences, max(len(terms))::INT AS n_terms FROM r GROUP BY ALL""",
    "spelling_distance": """SELECT asked, name, levenshtein(asked, name)::INT AS distance FROM (SELECT DISTINCT name FROM definitions WHERE name IS NOT NULL), (VALUES ('CacheReader'), ('TileServce'), ('Atach')) v(asked)
        WHERE abs(length(name) - length(asked)) <= 2 AND levenshtein(asked, name) <= 2""",
    "stream_delta_index": f"{_OCC} SELECT count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM occ WHERE file_id IS NOT NULL GROUP BY file_id",
    "sql_stats": f"{_DOCS} SELECT file_id, len(list_filter(parts, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '--')))::INT AS cyclomatic FROM cut JOIN docs USING (file_id) WHERE {_EXT} = 'sql'",
    "sql_calls": f"""{_SQLDOCS}, c AS (SELECT file_id, line_no, regexp_replace(regexp_replace(line, '--.*$', ''), '''[^'']*''', '') AS line, sum(regexp_matches(line, '(?i)^\\s*GO(?:\\s+\\d+)?\\s*;?\\s*$')::INT) OVER (PARTITION BY file_id ORDER BY line_no) AS batch FROM s),
        a AS (SELECT file_id, batch, line_no, unnest(regexp_extract_all(line, '(?i)\\b(?:EXEC(?:UTE)?|FROM|JOIN|INSERT\\s+INTO|UPDATE|DELETE\\s+FROM|MERGE\\s+INTO)\\s+(?:\\[\\w+\\]|[\\w@#$]+)(?:\\s*\\.\\s*(?:\\[\\w+\\]|[\\w@#$]+))*')) AS m FROM c),
        b AS (SELECT file_id, batch, line_no, CASE WHEN regexp_matches(m, '(?i)^EXEC') THEN 'sqlExecute' ELSE 'sqlRelation' END AS kind, list_filter(string_split(regexp_replace(regexp_replace(m, '(?i)^(?:EXEC(?:UTE)?|FROM|JOIN|INSERT\\s+INTO|UPDATE|DELETE\\s+FROM|MERGE\\s+INTO)\\s+', ''), '[\\[\\]\\s]', '', 'g'), '.'), lambda x: x <> '') AS parts FROM a),
        n AS (SELECT file_id, batch, line_no, kind, parts[-1] AS name, parts[-2] AS schema FROM b)
        SELECT file_id, kind, arg_min(schema, line_no) AS schema, arg_min(name, line_no) AS name, min(line_no)::INT AS line FROM n WHERE NOT regexp_matches(name, '^[#@]') AND lower(name) NOT IN ('inserted', 'deleted', 'set', 'select') AND coalesce(lower(schema), '') NOT IN ('sys', 'information_schema')
        GROUP BY file_id, batch, kind, lower(coalesce(schema, '')), lower(name)""",
    "cs_methods": f"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '//[^\\n]*', '', 'g'), '"[^"\\n]*"', '', 'g') AS t FROM documents WHERE text IS NOT NULL AND {_EXT} = 'cs') SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '\\bclass\\s+(\\w+)', 1)) AS name FROM d) GROUP BY name""",
    "sql_columns": f"""{_SQLDOCS}, c AS (SELECT file_id, line_no, trim(regexp_replace(line, '--.*$', '')) AS line FROM s), g AS (SELECT *, CASE WHEN regexp_matches(line, '^CREATE ') THEN regexp_extract(line, '^CREATE\\s+TABLE\\s+\\[\\w+\\]\\.\\[(\\w+)\\]', 1) WHEN line LIKE ')%' OR line = 'GO' THEN '' END AS start FROM c),
        w AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no) AS schema FROM g) SELECT schema, count(*) AS n_columns FROM w WHERE schema <> '' AND start IS NULL AND regexp_matches(line, '^\\[\\w+\\]\\s+[A-Z]') GROUP BY ALL""",
    "custom_elements": f"""WITH t AS (SELECT doc_id AS file_id, regexp_extract(p, 'selector:\\s*''([^'']+)''', 1) AS selector, regexp_extract(p, 'template:\\s*`([^`]*)`', 1) AS template
        FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '@(?:Component|Directive|Pipe|Injectable|NgModule)\\s*\\(', chr(1), 'g'), chr(1))) AS p FROM documents WHERE {_EXT} = 'ts' AND text IS NOT NULL))
        SELECT file_id, selector, unnest(list_distinct(regexp_extract_all(lower(template), '<([a-z][a-z0-9]*-[a-z0-9-]*)', 1))) AS child FROM t WHERE template <> ''""",
    "sql_ddl_symbols": f"""{_SQLDOCS}, m AS (SELECT file_id, line_no, regexp_extract(line, '^\\s*CREATE\\s+(?:OR\\s+ALTER\\s+)?(TABLE|PROCEDURE|VIEW)\\s+\\[(\\w+)\\]\\.\\[(\\w+)\\]', ['k', 's', 'n']) AS g FROM s)
        SELECT file_id, CASE g.k WHEN 'TABLE' THEN 'table' WHEN 'VIEW' THEN 'view' ELSE 'storedProcedure' END AS kind, g.s AS schema, g.n AS name, line_no::INT AS line FROM m WHERE g.k <> ''""",
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT ts, user_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT ts, user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
        SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id AS key, count(*) AS n_events FROM s GROUP BY user_id, burst""",
}
