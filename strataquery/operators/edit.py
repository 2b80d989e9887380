"""Text edits as column expressions; only diffs and similarity need Python."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_lines(text: Column, edits: list[tuple[int, int, list[str]]]) -> Column:
    """Text with line ranges (first, last, new lines) replaced; all numbers count lines of the original, from 1.

    last < first inserts before first (at most one behind the last line), no new lines delete. Overlapping
    ranges are an error; inserts overlap nothing. A final line end is no line. Numbers behind the end of a
    text leave that text as it is.
    """
    real = sorted((a, b) for a, b, _ in edits if b >= a)
    if any(a < 1 for a, _, _ in edits) or any(p[1] >= q[0] for p, q in zip(real, real[1:], strict=False)):
        raise ValueError("ranges overlap or begin before line 1")
    ended = F.endswith(text, F.lit("\n"))
    body = F.when(ended, F.substr(text, F.lit(1), F.char_length(text) - 1)).otherwise(text)
    lines = F.split(body, "\n")
    n = F.size(lines)
    out = lines
    for first, last, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        keep = last + 1 if last >= first else first
        fits = (n >= last) if last >= first else (n + 1 >= first)
        tail = F.when(F.size(out) >= keep, F.slice(out, keep, F.size(out))).otherwise(F.array().cast("array<string>"))
        head = F.slice(out, 1, first - 1) if first > 1 else F.array().cast("array<string>")
        out = F.when(fits, F.concat(head, F.array(*[F.lit(x) for x in new]).cast("array<string>"), tail)).otherwise(out)
    joined = F.array_join(out, "\n")
    return F.when(ended, F.concat(joined, F.lit("\n"))).otherwise(joined)


def replace_nth(text: Column, old: str, new: str, nth: int) -> Column:
    """Text with the nth occurrence of old replaced (0: all); unchanged if there are fewer."""
    if not old:
        raise ValueError("nothing to look for")
    if not nth:
        return F.replace(text, F.lit(old), F.lit(new))
    parts = F.split(text, "\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    swapped = F.concat(F.array_join(F.slice(parts, 1, nth), old), F.lit(new), F.array_join(F.slice(parts, nth + 1, F.greatest(F.size(parts) - nth, F.lit(0))), old))
    return F.when(F.size(parts) > nth, swapped).otherwise(text)


def occurrences_of(text: Column, part: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def insert_line(text: Column, anchor: str, line: str, before: bool = False) -> Column:
    """Text with a new line after (before) the first line that holds anchor, with that line's kind of end.

    As it is without such a line, or if the new line stands there already.
    """
    at = F.instr(text, anchor)
    head = F.substr(text, F.lit(1), at - 1)
    start = F.when(F.contains(head, F.lit("\n")), F.char_length(head) - F.char_length(F.substring_index(head, "\n", -1))).otherwise(0)  # characters before the anchor's line
    end = F.call_function("locate", F.lit("\n"), text, at)  # 0 for a last line without an end
    crlf = (end > 1) & (F.substr(text, end - 1, F.lit(1)) == "\r")
    stop = F.when(crlf, F.lit("\r\n")).otherwise(F.lit("\n"))
    own = F.concat(F.lit(line), stop)
    if before:
        there = F.endswith(F.substr(text, F.lit(1), start), F.concat(F.lit("\n"), own)) | (F.substr(text, F.lit(1), start) == own)
        whole = F.concat(F.substr(text, F.lit(1), start), own, F.substr(text, start + 1))
        return F.when((at == 0) | there, text).otherwise(whole)
    rest = F.substr(text, end + 1)
    whole = F.when(end > 0, F.concat(F.substr(text, F.lit(1), end), own, rest)).otherwise(F.concat(text, F.lit("\n" + line)))
    there = F.startswith(rest, own) | (rest == line)
    return F.when((at == 0) | ((end > 0) & there), text).otherwise(whole)


def insert_after(text: Column, anchor: str, line: str) -> Column:
    return insert_line(text, anchor, line)


def replace_checked(text: Column, old: str, new: str, nth: int = 0, context: str | None = None, expected: int | None = None) -> Column:
    """(text, problem): replace_nth, if what was expected holds; else the text as it is and why.

    context must stand within the text, on the line of an occurrence or next to it; there blanks may be of
    any length. expected is the number of occurrences.
    """
    n = occurrences_of(text, old)
    problem = F.when(n == 0, "not found").when(F.lit(nth) > n, "fewer occurrences")
    if expected is not None:
        problem = problem.when(n != expected, F.concat(F.lit("occurrences: "), n.cast("string")))
    if context is not None:
        import re

        loose = r"\s+".join(re.escape(w) for w in context.split())
        near = rf"{loose}[^\n]*\n?[^\n]*{re.escape(old)}|{re.escape(old)}[^\n]*\n?[^\n]*{loose}"
        problem = problem.when(~F.rlike(text, F.lit(near)), "not in its context")
    done = F.when(problem.isNull(), replace_nth(text, old, new, nth)).otherwise(text)
    return F.struct(done.alias("text"), problem.alias("problem"))



@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff with three lines of context, at most 200 lines and then a mark."""

    def diff(a: str | None, b: str | None) -> str:
        rows = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm=""))
        return "\n".join(rows if len(rows) <= 200 else [*rows[:200], f"... {len(rows) - 200} more lines"])

    return pd.Series([diff(a, b) for a, b in zip(before, after, strict=True)])


def nearest(text: str, wanted: str, least: float = 0.4, budget: int = 10_000_000) -> tuple[int, float] | None:
    """(first line, ratio) of the window of lines most like wanted, None below `least` or for texts over 512,000 bytes.

    Windows whose letters cannot reach 0.4 are passed over; the work on the others is bounded by budget cells.
    """
    if len(text.encode()) > 512_000 or not wanted:
        return None
    lines, size = text.splitlines(), wanted.count("\n") + 1
    best, matcher = None, difflib.SequenceMatcher(None, b=wanted, autojunk=False)
    for i in range(len(lines) - size + 1):
        window = "\n".join(lines[i : i + size])
        budget -= len(window) * len(wanted)
        if budget < 0:
            break
        matcher.set_seq1(window)
        if matcher.real_quick_ratio() < least or matcher.quick_ratio() < max(least, best[1] if best else 0):
            continue
        ratio = matcher.ratio()
        if ratio >= least and (best is None or ratio > best[1]):
            best = (i + 1, ratio)
    return best


def nearest_line(wanted: str):
    """A column function: struct<line, ratio> of the lines most like wanted."""

    @F.pandas_udf(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("ratio", T.DoubleType())]))
    def find(texts: pd.Series) -> pd.DataFrame:
        found = [nearest(t, wanted) if t else None for t in texts]
        return pd.DataFrame({"line": pd.array([f[0] if f else None for f in found], "Int32"), "ratio": [round(f[1], 6) if f else None for f in found]})

    return find
