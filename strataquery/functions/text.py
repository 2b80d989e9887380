"""Column functions on text, tokens and paths; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters, digits or underscores.
TOKEN = r"[\p{IsAlphabetic}\p{N}_]+"


def tokens(line: Column, least: int = 2) -> Column:
    """Tokens of a line: split and filtered by length in characters first, lower-cased second."""
    return F.transform(F.filter(F.regexp_extract_all(line, F.lit(TOKEN), 0), lambda t: F.char_length(t) >= least), F.lower)


def lines(text: Column) -> Column:
    """Lines without line ends; a final line end starts no further line."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trigrams(token: Column) -> Column:
    """All windows of three characters; none for shorter tokens."""
    n = F.char_length(token)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(token, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def normal_stem(value: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(value, r"[^\p{IsAlphabetic}\p{N}]", ""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Path without the file name; empty at the top."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def clean(path: Column) -> Column:
    """`/` between parts, none doubled, no `./` before and no `/` behind; `.` is the root."""
    text = F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/")
    text = F.regexp_replace(F.regexp_replace(text, r"^(\./)+", ""), "/$", "")
    return F.when(text == ".", "").otherwise(text)


def under(path: Column, folder: str) -> Column:
    """Whether path lies below folder, without case; the folder itself does not."""
    prefix = folder.rstrip("/").lower() + "/"
    return F.startswith(F.lower(path), F.lit(prefix))


def excluded(path: Column, part: str) -> Column:
    """Whether a directory of the path is called part, without case."""
    low = F.lower(path)
    return F.contains(low, F.lit(f"/{part.lower()}/")) | F.startswith(low, F.lit(f"{part.lower()}/"))


def in_scope(path: Column, folder: str | None = None, files: list[str] | None = None, extensions: list[str] | None = None, exclude_dirs: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """The scope filters of a search, in one predicate."""
    test = F.lit(True)
    if folder:
        test &= under(path, folder)
    if files:
        wanted = F.lit(False)
        for part in files:
            wanted |= F.contains(F.lower(path), F.lit(part.lower()))
        test &= wanted
    if extensions:
        test &= extension(path).isin([e.lower() for e in extensions])
    for part in exclude_dirs or []:
        test &= ~excluded(path, part)
    for part in exclude or []:
        test &= ~F.contains(F.lower(path), F.lit(part.lower()))
    return test


def match_tier(value: Column, terms: list[str]) -> Column:
    """0 for an exact match without case, 1 for a prefix, 2 for anything else; the best over all terms."""
    low = F.lower(value)
    tiers = [F.when(low == t.lower(), 0).when(F.startswith(low, F.lit(t.lower())), 1).otherwise(2) for t in terms]
    return F.least(*tiers) if len(tiers) > 1 else tiers[0]


def glob_pattern(pattern: str) -> str:
    """`*` and `?` of a file-name glob as a regular expression, open behind if it ends in a wildcard."""
    import re

    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return "^" + body + ("" if pattern[-1:] in "*?" else "$")


def fnv1a(text: str) -> int:
    """64-bit FNV-1a; names an index by its root and extensions."""
    value = 0xCBF29CE484222325
    for byte in text.encode():
        value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    return value


def components(text: Column) -> Column:
    """Selector and inline template of every component of a TypeScript text, '' where it has none.

    A decorator's selector goes with its own template; what stands before the first decorator is read as one more.
    """
    parts = F.split(text, r"(?=@(?:Component|Directive|Pipe|Injectable|NgModule)\s*\()")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"selector:\s*'([^']+)'", 1).alias("selector"), F.regexp_extract(p, r"template:\s*`([^`]*)`", 1).alias("template")))
