"""Evaluation texts leaking into training text.

Words of both sides are hashed to k-grams; of every WINDOW neighbouring k-grams the least hash is kept
(winnowing), so any WORDS_KEPT = K + WINDOW - 1 shared words in a row share a fingerprint. A passage of 15 words with
one in eight changed always has such a run. Fingerprints of both sides meet in one join; every pair of
document and item that met is then settled on the texts by extending the hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.plans.skew import BROADCAST_BYTES, input_bytes, maybe_broadcast, salted_join
from strataquery.session import stored

#: Words of a k-gram, and neighbouring k-grams of which one is kept.
K, WINDOW = 4, 2
#: Least words of a passage; changed words allowed per word; words skipped at most at one place.
LEAST_WORDS, CHANGED, SKIP = 15, 1 / 7, 4

_WORD = re.compile(r"[^\W_]+")
#: A tag with its attributes, of any length. What stands in `<>` right behind a word is a tag only if its name is one of HTML's (fixed values).
_ATTRIBUTES = r"""(?:\s+[\w:.\-@#*()\[\]]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?)*\s*/?>"""
_INLINE = r"(?:a|abbr|b|big|br|cite|code|del|div|em|font|h[1-6]|hr|i|img|ins|kbd|li|mark|ol|p|pre|q|s|samp|small|span|strike|strong|sub|sup|table|td|th|tr|tt|u|ul|var|wbr)"
_TAG = re.compile(rf"<(?:/[A-Za-z][\w:.\-]*\s*>|(?<!\w<)[A-Za-z][\w:.\-]*{_ATTRIBUTES}|{_INLINE}{_ATTRIBUTES})", re.I)
_BASE = 0x100000001B3


def words(text: str) -> list[str]:
    """Runs of letters or digits without case; markup tags count as white space."""
    return _WORD.findall(_TAG.sub(" ", text).lower() if "<" in text else text.lower())


def fingerprints(tokens: list[str], seen: dict[str, int]) -> np.ndarray:
    """The kept k-gram hashes of a word sequence, each once. seen caches the words' hashes."""
    n = len(tokens) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    values = []
    for w in tokens:
        v = seen.get(w)
        if v is None:
            v = seen[w] = xxhash.xxh3_64_intdigest(w)
        values.append(v)
    h = np.array(values, np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(K):
        grams = grams * np.uint64(_BASE) + h[j : j + n]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0x9E3779B97F4A7C15)
    kept = grams
    for j in range(1, min(WINDOW, n)):
        kept = np.minimum(kept[:-1], grams[j:])
    return np.unique(kept).view(np.int64)


def passage(doc: list[str], item: list[str], at: dict[str, list[int]], least: int = LEAST_WORDS, changed: float = CHANGED) -> tuple[int, int]:
    """(words, changes) of the longest passage of item in doc with few enough changes; (0, 0) without one.

    at gives the places of the item's words in doc. Hits are exact runs of K words; each is extended
    both ways over replaced, left out and added words, and cut back to where the changes are few enough.
    """
    best = (0, 0)
    done: set[tuple[int, int]] = set()
    n, m = len(item), len(doc)
    for i in range(n - K + 1):
        for j in at.get(item[i], ()):
            if (i, j) in done or item[i : i + K] != doc[j : j + K]:
                continue
            runs = [*reversed(_extend(item, doc, i, j, -1)), *_extend(item, doc, i, j, 1)]
            for run in runs:
                done.update((run[0] + k, run[1] + k) for k in range(run[2]))
            # Between neighbouring runs as many words are changed as the longer gap has.
            edges = []
            merged: list[list[int]] = []
            for a, b, size in runs:
                if merged and a == merged[-1][0] + merged[-1][2] and b == merged[-1][1] + merged[-1][2]:
                    merged[-1][2] += size
                else:
                    merged.append([a, b, size])
            for p, q in zip(merged, merged[1:], strict=False):
                edges.append(max(q[0] - p[0] - p[2], q[1] - p[1] - p[2]))
            for s in range(len(merged)):
                wrong = 0
                for e in range(s, len(merged)):
                    if e > s:
                        wrong += edges[e - 1]
                    span = merged[e][0] + merged[e][2] - merged[s][0]
                    if span >= least and wrong <= changed * span and span - wrong > best[0] - best[1]:
                        best = (span, wrong)
    return best


def _extend(item: list[str], doc: list[str], i: int, j: int, step: int) -> list[tuple[int, int, int]]:
    """Exact runs (item place, doc place, length) from (i, j) on in one direction, in the order they are met."""
    n, m = len(item), len(doc)
    runs = []
    if step < 0:
        i, j = i - 1, j - 1
    inside = lambda a, b: 0 <= a < n and 0 <= b < m
    while True:
        size = 0
        while inside(i, j) and item[i] == doc[j]:
            i, j, size = i + step, j + step, size + 1
        if size:
            runs.append((i + 1, j + 1, size) if step < 0 else (i - size, j - size, size))
        for a, b in _SKIPS:
            x, y = i + step * a, j + step * b
            if inside(x, y) and item[x] == doc[y] and inside(x + step, y + step) and item[x + step] == doc[y + step]:
                i, j = x, y
                break
        else:
            return runs


#: Words skipped in item and document at one place, fewest first.
_SKIPS = sorted(((a, b) for a in range(SKIP + 1) for b in range(SKIP + 1) if a or b), key=lambda x: (max(x), x[0] + x[1]))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            out.append(fingerprints(words(text), seen))
            if len(seen) > 500_000:
                seen.clear()
        lens = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate([*out, np.zeros(0, np.int64)])))], names=["id", "prints"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, item_id, item) to (doc_id, item_id, words, changes)."""
    doc, held, at = None, [], {}
    for batch in batches:
        ids, items = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        rows = []
        for k, text in enumerate(batch.column(1)):
            text = text.as_py()
            if ids[k] != doc or text != whole:
                doc, whole, held, at = ids[k], text, words(text), {}
                for j, w in enumerate(held):
                    at.setdefault(w, []).append(j)
            span, wrong = passage(held, words(batch.column(3)[k].as_py()), at)
            if span:
                rows.append((doc, items[k], span, wrong))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "words", "changes"])


def _met(found: DataFrame, asked: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Fingerprints of both sides joined; where the items' are too many to broadcast, hot ones are split over tasks."""
    if input_bytes(asked) <= limit:
        return found.join(F.broadcast(asked), "print")
    found = stored(found, "found")
    return salted_join(found, asked, ["print"], found.groupBy("print").agg(F.count("*").alias("n")), "n", F.xxhash64("doc_id"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words, changes): documents with a passage of an item, whole or in part.

    Null, empty and wordless texts leak nothing; so do items under LEAST_WORDS words. Repeated rows count once.
    """
    docs = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    questions = items.where("item_id is not null and text <> ''").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).distinct()
    shape = "id long, prints array<long>"
    asked = stored(questions.select("item_id", "item").mapInArrow(_prints, shape).select(F.col("id").alias("item_id"), F.explode("prints").alias("print")).distinct(), "asked")
    found = docs.mapInArrow(_prints, shape).select(F.col("id").alias("doc_id"), F.explode("prints").alias("print"))
    hits = stored(_met(found, asked).select("doc_id", "item_id").distinct(), "hits")
    pairs = docs.join(maybe_broadcast(hits), "doc_id").join(maybe_broadcast(questions), "item_id").select("doc_id", "text", "item_id", "item")
    return pairs.mapInArrow(_settle, "doc_id long, item_id long, words int, changes int").groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "changes")).alias("most")).select("doc_id", "item_id", "most.words", "most.changes")


def p7_found(spark, folder):
    from strataquery.sources.tables import spread, table

    return leaks(spread(table(spark, folder, "documents", "doc_id", "text")), table(spark, folder, "eval_items", "item_id", "text")).select("doc_id", "item_id")
