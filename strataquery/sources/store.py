"""Datasets on disk: files read with their encodings, stored tables with a description beside them."""

from __future__ import annotations

import base64
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.functions.text import fnv1a
from strataquery.session import lasting, scratch, shared_dir

#: Files above this size are not read.
LARGEST = 50 << 20
VERSION = 1


def decoded(content: Column) -> Column:
    """Text of bytes by their mark: UTF-16 of either order, UTF-8 with or without mark; broken bytes are replaced."""
    mark = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n + 1, LARGEST)
    return (
        F.when(F.startswith(mark, F.lit("FFFE")), F.decode(rest(2), "UTF-16LE"))
        .when(F.startswith(mark, F.lit("FEFF")), F.decode(rest(2), "UTF-16BE"))
        .when(mark == "EFBBBF", F.decode(rest(3), "UTF-8"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def files(spark: SparkSession, root: str, extensions: list[str] | None = None, hidden: bool = False, ignore: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, size, modified[, text]) below root, without files of hidden folders and of ignored patterns."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace("path", rf"^(?:file:)?/*\Q{base.lstrip('/')}\E/", "")
    rows = rows.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    if not hidden:
        rows = rows.where(~F.rlike("path", F.lit(r"(^|/)\.")))
    if extensions:
        rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions]))
    for pattern in ignore or []:
        rows = rows.where(~F.rlike("path", F.lit(pattern)))
    if content:
        rows = rows.where(F.col("size") <= LARGEST).withColumn("text", decoded(F.col("content"))).drop("content")
    return rows


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether rules of an ignore file leave a path out; the last rule that fits decides, `!` takes back.

    A rule with a slash before its end holds from the root, others anywhere; a final slash means folders
    only; `*` and `?` stay within a name, `**` does not. Blank lines and remarks say nothing.
    """
    verdict = F.lit(False)
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        body = rule[1:] if back else rule
        folder = body.endswith("/")
        body = body.rstrip("/")
        rooted = "/" in body
        parts, out = re.split(r"(/\*\*/|\*\*/|/\*\*|\*\*|\*|\?)", body.lstrip("/")), ""
        for part in parts:
            out += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
        pattern = ("^" if rooted else "(^|/)") + out + ("/" if folder else "(/|$)")
        verdict = F.when(F.rlike(path, F.lit(pattern)), F.lit(not back)).otherwise(verdict)
    return verdict


def with_folders(listed: DataFrame) -> DataFrame:
    """(path, size, is_dir): the files and every folder above them."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    folders = listed.select(F.explode(above).alias("path")).distinct().select("path", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_dir"))
    return listed.select("path", "size", F.lit(False).alias("is_dir")).union(folders)


def index_name(root: str, extensions: list[str]) -> str:
    """Name of the dataset for a folder and its extensions."""
    return f"{fnv1a(root + '|' + ','.join(sorted(e.lower() for e in extensions))):016x}"


class Dataset:
    """A table in one folder with a description: version, root, extensions, time and length of life."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, df: DataFrame, root: str, extensions: list[str], max_age: int = 86400, by: str | None = None) -> None:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.folder}/data")
        about = [(json.dumps({"version": VERSION, "root": root, "extensions": extensions, "created": int(time.time()), "max_age": max_age}),)]
        self.spark.createDataFrame(about, "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/meta")

    def meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/meta").first()[0])

    def stale(self, now: float | None = None) -> bool:
        """Older than its length of life, or of another version."""
        about = self.meta()
        return about["version"] != VERSION or (now or time.time()) - about["created"] > about["max_age"]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/data")


def orphans(metas: DataFrame, roots: DataFrame) -> DataFrame:
    """Descriptions (name, root) whose root is not among roots any more."""
    return metas.join(roots, "root", "left_anti")


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Puts a small description in place by one rename that replaces an earlier one: readers see the old or the new, never none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, staged = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.staged"))
    stream = target.getFileSystem(conf).create(staged, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf).rename(staged, target, options)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small description, or None."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def state_of(spark: SparkSession, *paths: str) -> str:
    """A mark that changes when one of the files or folders does: bytes, number of files, time of change."""
    parts = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            about = fs.getContentSummary(at)
            parts.append(f"{path}|{about.getLength()}|{about.getFileCount()}|{fs.getFileStatus(at).getModificationTime()}")
        else:
            parts.append(f"{path}|")
    return f"{fnv1a(chr(10).join(parts)):016x}"


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[], tuple[dict[str, DataFrame], Callable[[dict[str, DataFrame]], dict]]]) -> tuple[dict[str, DataFrame], dict]:
    """Tables built once per state of their source files, and the figures that belong to them.

    build gives the tables and a function from the written tables to figures. A description in the shared folder
    names where they lie and is put in place last, so a build that dies leaves nothing visible; one that runs
    twice is read from whichever is described last. A changed source or another VERSION means a new build.
    """
    at = f"{shared_dir(spark)}/{name}-{state_of(spark, *sources)}.json"
    about = read_json(spark, at)
    if about is None or about["version"] != VERSION:
        tables, figures = build()
        with lasting():
            folder = scratch(spark, name)
        for label, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{folder}/{label}")
        written = {label: spark.read.schema(df.schema).parquet(f"{folder}/{label}") for label, df in tables.items()}
        about = {"version": VERSION, "folder": folder, "sources": sources, "created": int(time.time()), "schemas": {label: df.schema.json() for label, df in tables.items()}, "figures": figures(written)}
        write_json(spark, at, about)
    schemas = {label: T.StructType.fromJson(json.loads(x)) for label, x in about["schemas"].items()}
    return {label: spark.read.schema(x).parquet(f"{about['folder']}/{label}") for label, x in schemas.items()}, about["figures"]


# ---- pages --------------------------------------------------------------------------------------


def page_token(epoch: int, offset: int, request: dict) -> str:
    """A token to go on with a request where a page ended."""
    text = f"{epoch}.{offset}.{fnv1a(json.dumps(request, sort_keys=True)):016x}"
    return "p1." + base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def page_from(token: str, epoch: int, request: dict) -> int:
    """The offset of a token; an error if the index or the request has changed since."""
    try:
        head, body = token.split(".", 1)
        was, offset, mark = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)).decode().split(".")
        if head != "p1":
            raise ValueError
    except ValueError as e:
        raise ValueError("this is no page token") from e
    if int(was) != epoch:
        raise ValueError("the index has changed; start again")
    if mark != f"{fnv1a(json.dumps(request, sort_keys=True)):016x}":
        raise ValueError("the token belongs to another request")
    return int(offset)


def checked_arguments(given: dict, known: list[str], least: float = 0.8) -> dict:
    """given, if all its keys are known; else an error that names the most alike known key."""
    from strataquery.functions.fuzzy import jaro_winkler

    for key in given:
        if key not in known:
            score, name = max((jaro_winkler(key.lower(), k.lower()), k) for k in known)
            raise ValueError(f"unknown argument {key!r}" + (f"; did you mean {name!r}?" if score >= least else ""))
    return given
