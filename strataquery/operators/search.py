"""Content search: which files match, how well, and which page of them is shown.

Scores use document frequencies and the number of files of the whole index; scope filters come after.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquery.functions.text import TOKEN, normal_stem, stem, trigrams
from strataquery.operators.index import ContentIndex, file_lines, narrowed, trigram_index
from strataquery.session import stored

#: Terms below this length match so many tokens that a warning goes with the result (fixed value).
BROAD = 4
#: A prefilter that keeps more than this share of the files is not worth its pass (fixed value).
WORTH = 0.5
#: Added to a term's frequency where the file's name is the term (fixed value).
STEM_BONUS = 0.02


def term_table(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(term, term_idx) of the distinct terms in lower case; as small as the request."""
    distinct = list(dict.fromkeys(t.lower() for t in terms))
    return spark.createDataFrame([(t, i) for i, t in enumerate(distinct)], "term string, term_idx int")


def exact(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_idx, token) of terms that are tokens."""
    return terms.select("term_idx", F.col("term").alias("token"))


def containing(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_idx, token) of tokens that contain a term; the request is broadcast, the vocabulary scanned once."""
    return vocab.join(F.broadcast(terms), F.contains(F.col("token"), F.col("term"))).select("term_idx", "token")


def containing_by_trigrams(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """As containing, by intersecting the terms' trigrams first; for terms of three characters or more."""
    asked = terms.select("term_idx", "term", F.explode(F.array_distinct(trigrams(F.col("term")))).alias("trigram"))
    needed = F.broadcast(asked.groupBy("term_idx", "term").agg(F.count("*").alias("needed")))
    found = trigram_index(vocab).join(F.broadcast(asked), "trigram").groupBy("term_idx", "token").agg(F.count("*").alias("met"))
    return found.join(needed, "term_idx").where((F.col("met") == F.col("needed")) & F.contains("token", "term")).select("term_idx", "token")


def token_pattern(pattern: str) -> str:
    """A whole-token, case-blind pattern; look-around and back-references are refused."""
    if len(pattern) > 256 or re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError("patterns have at most 256 characters, no look-around and no back-references")
    return f"(?id)^(?:{pattern})$"


def matching(vocab: DataFrame, patterns: list[str]) -> DataFrame:
    """(term_idx, token) of tokens that match a pattern as a whole."""
    hit = F.array_compact(F.array(*[F.when(F.rlike("token", F.lit(token_pattern(p))), F.lit(i)) for i, p in enumerate(patterns)]))
    return vocab.select("token", F.explode(hit).alias("term_idx")).select("term_idx", "token")


def tf_idf(tf: Column, count: Column, files: Column, df: Column, bonus: Column | None = None) -> Column:
    """(tf / tokens of the file + bonus) * ln(files / df)."""
    share = tf / F.greatest(count, F.lit(1))
    return (share if bonus is None else share + bonus) * F.ln(files / df)


def smoothed_tf_idf(tf: Column, count: Column, files: Column, df: Column, average: Column, bonus: Column | None = None) -> Column:
    """(log-frequency over the log of the file's length, both relative to an average file, + bonus) * smoothed inverse document frequency."""
    share = F.log1p(tf) / F.log1p(F.greatest(count, F.lit(1))) / (F.log1p(F.lit(1.0)) / F.log1p(average)) / average
    return (share if bonus is None else share + bonus) * (F.ln((files + 1) / (df + 1)) + 1)


def bm25(tf: Column, count: Column, files: Column, df: Column, average: Column, bonus: Column | None = None, k1: float = 1.2, b: float = 0.75) -> Column:
    """BM25 over an average file's length, and the bonus times the same inverse document frequency."""
    idf = F.ln(1 + F.greatest(files - df + 0.5, F.lit(0.0)) / (df + 0.5))
    value = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.greatest(count, F.lit(1)) / average)) / average
    return value if bonus is None else value + bonus * idf


def stem_bonus(terms: list[str], mode: str = "token") -> Column | None:
    """STEM_BONUS for files whose name is the term, in searches for one token as it is; None for all others."""
    distinct = {t.lower() for t in terms}
    if mode != "token" or len(distinct) != 1:
        return None
    return F.when(normal_stem(stem(F.col("path"))) == re.sub(r"[\W_]", "", distinct.pop()), STEM_BONUS).otherwise(0.0)


def scored(index: ContentIndex, found: DataFrame, score: str = "tf_idf", bonus: Column | None = None) -> DataFrame:
    """(file_id, path, score, occurrences, terms_matched) of the files with tokens of found (term_idx, token).

    Scores use the whole index for the number of files and document frequencies, are rounded to 9 places
    and tie by path.
    """
    hits = narrowed(index.postings, found).join(index.listed, "file_id")
    tf, c, n, d, average = F.col("tf"), F.col("token_count"), F.lit(index.n_files), F.col("df"), F.lit(index.average)
    value = {"tf_idf": lambda: tf_idf(tf, c, n, d, bonus), "smoothed": lambda: smoothed_tf_idf(tf, c, n, d, average, bonus), "bm25": lambda: bm25(tf, c, n, d, average, bonus)}[score]()
    return hits.groupBy("file_id", "path").agg(F.round(F.sum(value), 9).alias("score"), F.sum("tf").alias("occurrences"), F.count_distinct("term_idx").alias("terms_matched"))


def all_terms(result: DataFrame, n: int) -> DataFrame:
    """Files that match every term."""
    return result.where(F.col("terms_matched") >= n)


def page(result: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + size in order, with their rank; size 0 means all. An offset behind the end is an error.

    A page behind the first is read at once, with the row before it, whose absence shows an offset behind the end.
    """
    rank = F.row_number().over(Window.orderBy(*order)).cast("long")  # over the page alone, which is as small as asked for
    if not offset:
        return (result.orderBy(*order).limit(size) if size else result).withColumn("rank", rank)
    ordered = result.orderBy(*order).offset(offset - 1)
    shown = (ordered.limit(size + 1) if size else ordered).withColumn("rank", rank + (offset - 1))
    if not size:
        shown = stored(shown, "page")
        if shown.isEmpty():
            raise ValueError("the offset lies behind the last result")
        return shown.where(F.col("rank") > offset)
    found = shown.collect()  # size + 1 rows at most
    if not found:
        raise ValueError("the offset lies behind the last result")
    return result.sparkSession.createDataFrame([r for r in found if r["rank"] > offset], shown.schema)


def best(result: DataFrame, size: int, offset: int = 0) -> DataFrame:
    return page(result, [F.desc("score"), F.asc("path")], size, offset)


def auto_balance(per_term: DataFrame, cap: int | None = None) -> DataFrame:
    """Keeps a term that is ten times as frequent as the rarest from flooding the result.

    per_term has (file_id, path, term_idx, occ, score). Of files that match the dominant term only, the
    cap best stay (twice the second term's occurrences, between 20 and 100, if not given).
    """
    totals = per_term.groupBy("term_idx").agg(F.sum("occ").alias("occ")).where("occ > 0")
    w = Window.orderBy(F.desc("occ"), F.desc("term_idx"))  # one row per term of the request
    plan = totals.withColumn("r", F.row_number().over(w)).agg(
        F.max(F.when(F.col("r") == 1, F.col("term_idx"))).alias("dominant"), F.max("occ").alias("most"), F.min("occ").alias("least"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("occ"))), F.lit(0)).alias("second"), F.count("*").alias("terms")
    )
    plan = plan.withColumn("cap", F.lit(cap) if cap else F.least(F.greatest(F.col("second") * 2, F.lit(20)), F.lit(100))).withColumn("on", F.expr("terms >= 2 and most >= least * 10"))
    files = per_term.where("occ > 0").groupBy("file_id", "path").agg(F.round(F.sum("score"), 9).alias("score"), F.sum("occ").alias("occurrences"), F.count_distinct("term_idx").alias("terms_matched"), F.min("term_idx").alias("only"))
    columns = ["file_id", "path", "score", "occurrences", "terms_matched"]
    judged = files.withColumn("plan", plan.select(F.struct("on", "dominant", "cap")).scalar()).withColumn("flood", F.expr("plan.on and terms_matched = 1 and only = plan.dominant"))
    order = [F.desc("score"), F.asc("path")]
    few = judged.where("flood").orderBy(*order).limit(cap or 100).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return judged.where("not flood").select(*columns).union(few.where("place <= plan.cap").select(*columns))


def phrase_lines(files: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase_idx, file_id, line_no) of lines that contain a phrase, without case. A phrase without a token is an error."""
    for phrase in phrases:
        if not re.search(r"\w", phrase):
            raise ValueError(f"no token in phrase {phrase!r}")
    low = F.lower("line")
    hit = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(i)) for i, p in enumerate(phrases)]))
    return file_lines(files).select("file_id", "line_no", F.explode(hit).alias("phrase_idx"))


def regex_lines(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern_idx, file_id, line_no) of lines that match a case-sensitive pattern."""
    for p in patterns:
        token_pattern(p)
    hit = F.array_compact(F.array(*[F.when(F.rlike("line", F.lit(f"(?d){p}")), F.lit(i)) for i, p in enumerate(patterns)]))
    return file_lines(files).select("file_id", "line_no", F.explode(hit).alias("pattern_idx"))


def literals(pattern: str, least: int = 3) -> list[str]:
    """Literal fragments every match must contain."""
    from re import _constants as c
    from re import _parser

    found, run = [], []
    for op, value in [*_parser.parse(pattern), (None, None)]:
        if op is c.LITERAL:
            run.append(chr(value))
            continue
        if len(run) >= least:
            found.append("".join(run))
        run = []
        if op is c.SUBPATTERN and value[1] == value[2] == 0:
            inner = value[3]
            if all(o is c.LITERAL for o, _ in inner) and len(inner) >= least:
                found.append("".join(chr(v) for _, v in inner))
        elif op is c.MAX_REPEAT and value[0] >= 1 and all(o is c.LITERAL for o, _ in value[2]) and len(value[2]) >= least:
            found.append("".join(chr(v) for _, v in value[2]))
    return found


def prefiltered(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose whole text contains every literal the pattern needs; pushed before lines are made."""
    test = F.lit(True)
    for part in literals(pattern):
        test &= F.contains("text", F.lit(part))
    return files.where(test)


def per_file(hits: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """(file_id, lines, occurrences) over all keys; with n, only files with that many different keys."""
    out = hits.groupBy("file_id").agg(F.sort_array(F.collect_set("line_no")).alias("lines"), F.count("*").alias("occurrences"), F.count_distinct(key).alias("keys"))
    return (out.where(F.col("keys") == n) if n else out).drop("keys")


def without(scope: DataFrame, hits: DataFrame) -> DataFrame:
    """Files of the scope without a hit."""
    return scope.join(hits.select("file_id").distinct(), "file_id", "left_anti")


def context(hits: DataFrame, all_lines: DataFrame, before: int, after: int) -> DataFrame:
    """(file_id, start_line, n_lines, match_lines, text): hits with lines around, neighbours merged into groups."""
    spread = hits.select("file_id", F.col("line_no").alias("hit"), F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after)).alias("line_no"))
    wanted = spread.groupBy("file_id", "line_no").agg(F.max((F.col("hit") == F.col("line_no")).cast("int")).alias("is_hit"))
    shown = all_lines.join(wanted, ["file_id", "line_no"])
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))
    groups = shown.withColumn("island", island).groupBy("file_id", "island")
    return groups.agg(
        F.min("line_no").alias("start_line"),
        F.count("*").alias("n_lines"),
        F.sum("is_hit").alias("n_matches"),
        F.expr("concat_ws('\n', transform(array_sort(collect_list(struct(line_no, line))), x -> x.line))").alias("text"),
    ).drop("island")


def is_plain(term: str) -> bool:
    """Whether a term is one token; others are searched as phrases."""
    return bool(re.fullmatch(TOKEN.replace(r"\p{IsAlphabetic}\p{N}_", r"\w"), term))


def split_terms(terms: list[str], every: bool = False) -> tuple[list[str], list[str]]:
    """(tokens, phrases) of a request: a term with other characters than a token's is a phrase.

    If there are both, a file matches by any of them; asking for all is an error.
    """
    plain, phrases = [t for t in terms if is_plain(t)], [t for t in terms if not is_plain(t)]
    if plain and phrases and every:
        raise ValueError("tokens and phrases together cannot all be asked for; search for one kind at a time")
    return plain, phrases


def inverted(scope: DataFrame, hits: DataFrame, scoped: bool, count_only: bool = False) -> DataFrame:
    """Files of an explicit scope without a hit. A request without a scope, or for counts only, is an error."""
    if not scoped:
        raise ValueError("files without a match are listed within a scope only: give a folder, an extension or names of files")
    if count_only:
        raise ValueError("files without a match are listed, not counted")
    return without(scope, hits)


def broad_terms(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_tokens, broad): tokens that contain a term, and whether it is so short that a warning is due."""
    counts = containing(vocab, terms).groupBy("term_idx").agg(F.count("*").alias("n_tokens"))
    return terms.join(counts, "term_idx", "left").select("term", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), (F.char_length("term") < BROAD).alias("broad"))


def mixed(index: ContentIndex, files: DataFrame, terms: list[str]) -> DataFrame:
    """(file_id, score, occurrences) of files with any of the tokens or phrases; a phrase scores max(ln(N / files), 1) per occurrence."""
    plain, phrases = split_terms(terms)
    n = F.lit(index.n_files)
    parts = []
    if plain:
        hits = narrowed(index.postings, exact(index.postings, term_table(files.sparkSession, plain)))
        parts.append(hits.select("file_id", tf_idf(F.col("tf"), F.col("token_count"), n, F.col("df")).alias("score"), F.col("tf").alias("occ")))
    if phrases:
        found = stored(phrase_lines(files, phrases).groupBy("phrase_idx", "file_id").agg(F.count("*").alias("occ")), "phrases")
        df = F.broadcast(found.groupBy("phrase_idx").agg(F.count("*").alias("df")))  # one row per phrase
        parts.append(found.join(df, "phrase_idx").select("file_id", (F.greatest(F.ln(n / F.col("df")), F.lit(1.0)) * F.col("occ")).alias("score"), "occ"))
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return rows.groupBy("file_id").agg(F.round(F.sum("score"), 9).alias("score"), F.sum("occ").alias("occurrences"))


def by_occurrences(found: DataFrame, size: int, offset: int = 0) -> DataFrame:
    """Files of a phrase or line pattern search, most occurrences first, ties by path."""
    return page(found, [F.desc("occurrences"), F.asc("path")], size, offset)


def candidates(files: DataFrame, patterns: list[str], every: bool = False) -> DataFrame:
    """Files that can match any (every) of the patterns, by the literals their texts must hold.

    All files if a pattern of an any-search has no literal, or if more than WORTH of them are left.
    """
    tests = []
    for pattern in patterns:
        parts = literals(pattern)
        test = F.lit(True) if parts else None
        for part in parts:
            test &= F.contains("text", F.lit(part))
        tests.append(test)
    known = [t for t in tests if t is not None]
    if not known or (not every and len(known) < len(tests)):
        return files
    test = known[0]
    for other in known[1:]:
        test = test & other if every else test | other
    share = files.agg(F.avg(F.coalesce(test, F.lit(False)).cast("int"))).first()[0]
    return files if share is None or share > WORTH else files.where(test)


def shaped(ranked: DataFrame, budget: int, steps: tuple[int, ...] = (10, 3, 1)) -> DataFrame:
    """(rank, path, n_lines, n_tokens, bytes): a ranked result (rank, path, lines, tokens) cut to a budget of bytes.

    Phase by phase, as far as needed: lines per file down to the steps, then tokens per file down to the
    last step, then whole files from the end. A row costs its path, 8 bytes a line and its tokens with 3
    bytes each. The result is as small as a page, and so is every frame here.
    """
    cost = lambda lines, tokens: F.octet_length("path") + 8 * F.size(lines) + F.aggregate(tokens, F.lit(0), lambda a, t: a + F.octet_length(t) + 3)
    phases = [(F.col("lines"), F.col("tokens"))] + [(F.slice("lines", 1, n), F.col("tokens")) for n in steps] + [(F.slice("lines", 1, steps[-1]), F.slice("tokens", 1, steps[-1]))]
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ranked
    for i, phase in enumerate(phases):
        rows = rows.withColumn(f"__all{i}", F.sum(cost(*phase)).over(every))
    choice = F.coalesce(*[F.when(F.col(f"__all{i}") <= budget, F.lit(i)) for i in range(len(phases))], F.lit(len(phases) - 1))
    rows = rows.withColumn("__phase", choice)
    pick = lambda k: F.coalesce(*[F.when(F.col("__phase") == i, phase[k]) for i, phase in enumerate(phases)])
    cut = rows.select("rank", "path", pick(0).alias("lines"), pick(1).alias("tokens"))
    used = F.sum(cost(F.col("lines"), F.col("tokens"))).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return cut.select("rank", "path", F.size("lines").alias("n_lines"), F.size("tokens").alias("n_tokens"), used.cast("long").alias("bytes")).where(F.col("bytes") <= budget)


def coverage(files: DataFrame, indexed: DataFrame, scope: Column, ext: Column) -> DataFrame:
    """One row: files in scope, those in the index, those not, and the extensions of these."""
    flagged = files.where(scope).join(indexed.select("file_id").distinct().withColumn("known", F.lit(True)), "file_id", "left")
    return flagged.agg(
        F.count("*").alias("matched"),
        F.count("known").alias("indexed"),
        F.sum(F.col("known").isNull().cast("long")).alias("unindexed"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("known").isNull(), ext)))).alias("unindexed_extensions"),
    )
