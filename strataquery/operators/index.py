"""The content index: lines, occurrences, postings, vocabulary and trigrams of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.functions.text import lines, tokens, trigrams
from strataquery.plans.skew import maybe_broadcast
from strataquery.session import stored
from strataquery.sources.store import kept


def file_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, line) of files (file_id, text); lines count from 1."""
    return files.select("file_id", F.posexplode(lines(F.col("text"))).alias("at", "line")).select("file_id", (F.col("at") + 1).alias("line_no"), "line")


def occurrences(files: DataFrame, least: int = 2) -> DataFrame:
    """(file_id, line_no, token), one row per occurrence."""
    return file_lines(files).select("file_id", "line_no", F.explode(tokens(F.col("line"), least)).alias("token"))


def postings(files: DataFrame, least: int = 2) -> DataFrame:
    """(token, file_id, lines, tf): one entry of lines per occurrence, in order."""
    return occurrences(files, least).groupBy("token", "file_id").agg(F.sort_array(F.collect_list("line_no")).alias("lines"), F.count("*").alias("tf"))


def stored_postings(rows: DataFrame) -> DataFrame:
    """(token, file_id, tf) of a stored index whose rows may differ in case, be split or be repeated."""
    kept = rows.where("token is not null and file_id is not null and size(lines) > 0").select(F.lower("token").alias("token"), "file_id", "lines")
    distinct = kept.repartition("token", "file_id").dropDuplicates(["token", "file_id", "lines"])
    return distinct.groupBy("token", "file_id").agg(F.sum(F.size("lines")).cast("long").alias("tf"))


def token_counts(index: DataFrame) -> DataFrame:
    """(file_id, token_count) of postings (file_id, tf)."""
    return index.groupBy("file_id").agg(F.sum("tf").alias("token_count"))


def vocabulary(index: DataFrame) -> DataFrame:
    """(token, df, total) over all files, whatever the scope of a search."""
    return index.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def trigram_index(vocab: DataFrame) -> DataFrame:
    """(trigram, token), each pair once."""
    return vocab.select("token", F.explode(F.array_distinct(trigrams(F.col("token")))).alias("trigram")).select("trigram", "token")


@dataclass
class ContentIndex:
    """A prepared index: postings (token, file_id, tf, df, token_count) sorted by token, vocabulary, and files with paths and counts.

    Document frequencies and token counts lie beside the postings, so a search reads the row groups of its
    tokens and needs no pass over the rest.
    """

    postings: DataFrame
    vocabulary: DataFrame
    files: DataFrame
    n_files: int
    total_tokens: int

    @classmethod
    def over(cls, index: DataFrame, files: DataFrame) -> ContentIndex:
        """An index of postings (token, file_id, tf) and files (file_id, path) that is not stored."""
        counts = token_counts(index)
        full = index.select("token", "file_id", "tf").join(vocabulary(index).select("token", "df"), "token").join(counts, "file_id")
        known = counts.join(files.select("file_id", "path").withColumn("listed", F.lit(True)), "file_id", "full").withColumn("listed", F.coalesce("listed", F.lit(False)))
        return cls(full, vocabulary(index), known, files.count(), index.agg(F.sum("tf")).first()[0] or 0)

    @property
    def average(self) -> float:
        """Tokens per file, over all files of the list."""
        return max(self.total_tokens / max(self.n_files, 1), 1.0)

    @property
    def counts(self) -> DataFrame:
        """(file_id, token_count) of files with postings, whether they are in the list or not."""
        return self.files.where("token_count is not null").select("file_id", "token_count")

    @property
    def listed(self) -> DataFrame:
        """(file_id, path) of the files of the list."""
        return self.files.where("listed").select("file_id", "path")


def content_index(spark: SparkSession, name: str, sources: list[str], rows: DataFrame, files: DataFrame) -> ContentIndex:
    """The prepared index of stored postings (token, file_id, lines) and a list of files (file_id, path); built once per state of sources."""

    def build():
        index = stored_postings(rows)
        vocab, counts = vocabulary(index), token_counts(index)
        listed = files.where("file_id is not null").groupBy("file_id").agg(F.min("path").alias("path")).withColumn("listed", F.lit(True))
        known = counts.join(listed, "file_id", "full").select("file_id", "path", "token_count", F.coalesce("listed", F.lit(False)).alias("listed"))
        full = index.join(vocab.select("token", "df"), "token").join(counts, "file_id").select("token", "file_id", "tf", "df", "token_count")
        tables = {"postings": full.repartitionByRange("token").sortWithinPartitions("token", "file_id"), "vocabulary": vocab.repartitionByRange("token").sortWithinPartitions("token"), "files": known}

        def figures(written: dict[str, DataFrame]) -> dict:
            about = written["files"].agg(F.sum(F.col("listed").cast("long")).alias("n"), F.sum("token_count").alias("total")).first()
            return {"n_files": about.n or 0, "total_tokens": about.total or 0}

        return tables, figures

    tables, figures = kept(spark, name, sources, build)
    return ContentIndex(tables["postings"], tables["vocabulary"], tables["files"], **figures)


#: Tokens of an expansion that are handed to the scan by name.
NAMED_TOKENS = 1000


def narrowed(index: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of index with a token of found (term_idx, token), once per term; few tokens are pushed down to the scan by name."""
    few = found.limit(NAMED_TOKENS + 1).collect()
    if len(few) > NAMED_TOKENS:
        return index.join(maybe_broadcast(stored(found, "found")), "token")
    tokens_ = sorted({r.token for r in few})
    picked = index.where(F.col("token").isin(tokens_))
    small = found.sparkSession.createDataFrame([(r.term_idx, r.token) for r in few], "term_idx int, token string")
    return picked.join(F.broadcast(small), "token")
