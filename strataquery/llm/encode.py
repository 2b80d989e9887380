"""Encoding of the whole corpus with a public tokenizer, shared passages encoded once.

Texts are cut where a rolling hash of the characters before says so, so equal passages give equal chunks
wherever they stand. Documents none of whose chunks stands elsewhere have nothing to share and are encoded in
one piece where they lie. Of all others every distinct chunk is encoded once, with a mark on the first token
of each piece that the tokenizer's pattern splits text into. Chunks then meet again by document, and every
join is repaired: the pattern looks ahead only, so a text's pieces from one boundary on depend on nothing
before it. The last pieces of the left side, which the cut may have changed, are encoded again with the first
of the right side until a boundary of both agrees; from there on the right side's tokens hold as they are.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.plans.skew import maybe_broadcast, salted_join
from strataquery.session import stored

#: Where the vocabulary files are, and the default one.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k"
#: Characters: the hash's window, chunks' usual, least and greatest length.
WINDOW, USUAL, LEAST, GREATEST = 24, 768, 256, 8192
#: Marks a token that begins a piece.
START = 1 << 24
#: What the vocabulary's texts are split by (fixed value); runs of white space on which its search would run out of stack.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_BLANKS = re.compile(r"\s{4096}")


def cuts(text: str) -> list[int]:
    """Ends of text's chunks. A cut stands before white space, where the hash of the characters before is low."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = (codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    space = (codes == 32) | (codes == 10) | (codes == 13) | (codes == 9)
    places = np.flatnonzero(space[1:] & ~space[:-1]) + 1  # about one in six characters
    places = places[places >= LEAST]
    up, down = _powers(1 << (n - 1).bit_length())
    total = np.cumsum(mixed * up[:n])  # total[i - 1]: of the first i characters
    rolled = (total[places - 1] - total[places - 1 - WINDOW]) * down[places]  # of the WINDOW characters before
    places = places[(rolled >> np.uint64(32)) % np.uint64(USUAL // 6) == 0]
    ends, at = [], 0
    for p in places.tolist():
        while p - at > GREATEST:
            at += GREATEST
            ends.append(at)
        if p - at >= LEAST:
            at = p
            ends.append(at)
    while n - at > GREATEST:
        at += GREATEST
        ends.append(at)
    return [*ends, n] if at < n else ends


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base and of its inverse."""
    base = 0x9E3779B97F4A7C15
    both = (np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    return tuple(np.r_[np.uint64(1), np.cumprod(x)[:-1]] for x in both)


@cache
def _tokenizer(folder: str, vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{folder}/{vocabulary}.json")
    tokenizer.encode_special_tokens = True
    return tokenizer


@cache
def _ranked(folder: str, vocabulary: str):
    """The same vocabulary in a faster library, which knows no pieces."""
    import tiktoken

    table, _ = _token_bytes(folder, vocabulary)
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(table) if t}, special_tokens={})


@cache
def _token_bytes(folder: str, vocabulary: str) -> tuple[list[bytes], np.ndarray]:
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip())]
    table = [b""] * (max(rank for rank, _ in pairs) + 1)
    for rank, token in pairs:
        table[rank] = token
    return table, np.array([len(t) for t in table], np.int64)


class Encoder:
    """Marked encoding and exact joining of chunks with one vocabulary."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
        self.tokenizer, self.ranked = _tokenizer(folder, vocabulary), _ranked(folder, vocabulary)
        self.table, self.lengths = _token_bytes(folder, vocabulary)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids per text; the first token of each piece carries START."""
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            ids = np.array(e.ids, np.int32)
            words = np.array(e.word_ids, np.int64)
            if len(ids):
                ids[np.r_[True, words[1:] != words[:-1]]] |= START
            out.append(ids)
        return out

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids per text, without marks."""
        out: list[np.ndarray | None] = [None if _BLANKS.search(t) else self._fast(t) for t in texts]
        hard = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(hard, self.encode([texts[i] for i in hard]) if hard else [], strict=True):
            out[i] = ids & (START - 1)
        return out

    def _fast(self, text: str) -> np.ndarray | None:
        """None if the faster library's search gives up on a text."""
        try:
            return np.array(self.ranked.encode_ordinary(text), np.int32)
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
            return None

    def _bytes(self, tokens: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, (tokens & (START - 1)).tolist()))

    def _places(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(first token of each piece, its byte, length in bytes)."""
        ends = np.cumsum(self.lengths[tokens & (START - 1)])
        first = np.flatnonzero(tokens & START)
        return first, np.r_[0, ends][first], int(ends[-1]) if len(ends) else 0

    def _settled(self, first: np.ndarray, byte: np.ndarray, size: int) -> int:
        """Number of leading pieces that text after the end cannot change.

        A piece is settled if it ends before the end and the three bytes that its longest contraction needs are there.
        """
        k = len(first) - 1
        while k > 0 and byte[k - 1] + 3 > size:
            k -= 1
        return max(k, 0)

    def join(self, chunks: list[np.ndarray]) -> np.ndarray:
        """Ids of the chunks' texts in one piece, equal to encoding them together."""
        if len(chunks) == 1:
            return chunks[0] & (START - 1)
        done: list[np.ndarray] = []
        left, raw, wait = chunks[0], b"", 0
        for number, right in enumerate(chunks[1:], 2):
            if left is not None:
                first, byte, size = self._places(left)
                k = self._settled(first, byte, size)
                done.append(left[: first[k]])
                raw, left = self._bytes(left[first[k] :]), None
            if len(raw) < wait and number < len(chunks):
                raw += self._bytes(right)
                continue
            left, raw = self._meet(raw, right, done)
            wait = 2 * len(raw) if left is None else 0
        done.append(left if left is not None else self.encode([raw.decode()])[0])
        return np.concatenate(done) & (START - 1)

    def _meet(self, raw: bytes, right: np.ndarray, done: list[np.ndarray]) -> tuple[np.ndarray | None, bytes]:
        """Encodes raw with more and more of right until both agree on a boundary.

        Then (raw's tokens up to there and right's from there, b""); if they never agree, (None, all bytes).
        """
        first, byte, size = self._places(right)
        pieces = 4
        while True:
            whole = pieces >= len(first)
            head = right if whole else right[: first[pieces]]
            text = raw + self._bytes(head)
            tokens = self.encode([text.decode()])[0]
            f, b, n = self._places(tokens)
            settled = self._settled(f, b, n)
            mine = b[: settled + 1] - len(raw)  # boundaries that hold, seen from right
            agreed = np.intersect1d(mine[mine >= 0], byte, assume_unique=True)
            if agreed.size:
                at = int(agreed[0])
                upto = f[np.searchsorted(b, at + len(raw))]
                return np.concatenate([tokens[:upto], right[first[np.searchsorted(byte, at)] :]]), b""
            if whole:
                return None, text
            pieces *= 4


def _cut(texts: bool):
    """Batches of (doc_id, own, text) to chunks: (key, chunk), or (doc_id, own, seq, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            held = 0
            for doc, own, whole in zip(ids, owns, batch.column(2), strict=True):
                whole, at = whole.as_py(), 0
                for seq, end in enumerate(cuts(whole)):
                    chunk = whole[at:end]
                    at = end
                    key = xxhash.xxh3_128_digest(chunk)
                    rows.append((key, chunk) if texts else (doc, own, seq, key))
                    held += len(chunk)
                if held > 4_000_000:
                    yield _rows(rows, texts)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, texts)

    return run


def _rows(rows: list[tuple], texts: bool) -> pa.RecordBatch:
    schema = pa.schema([("key", pa.binary()), ("chunk", pa.string())] if texts else [("doc_id", pa.int64()), ("own", pa.int64()), ("seq", pa.int32()), ("key", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _encode_whole(folder: str, vocabulary: str):
    """(doc_id, text) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(folder, vocabulary)
        for batch in batches:
            at = 0
            while at < len(batch):  # a few megabytes of text at once
                upto, size = at, 0
                while upto < len(batch) and size < 4_000_000:
                    size += len(batch.column(1)[upto].as_py())
                    upto += 1
                part = batch.slice(at, upto - at)
                ids = encoder.whole(part.column(1).to_pylist())
                lens = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])
                at = upto

    return run


def _encode(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(folder, vocabulary)
        for batch in batches:
            chunks = batch.column(1).to_pylist()
            for at in range(0, len(chunks), 512):
                ids = encoder.encode(chunks[at : at + 512])
                lens = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), batch.column(2).slice(at, 512), lists], names=["key", "uses", "ids"])

    return run


def _assemble(folder: str, vocabulary: str):
    """(doc_id, parts list<struct<seq, ids>>) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(folder, vocabulary)
        for batch in batches:
            parts = batch.column(1)
            structs = parts.values
            seq, lists = structs.field("seq").to_numpy(), structs.field("ids")
            tokens, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows = parts.offsets.to_numpy()
            out = []
            for a, b in zip(rows[:-1], rows[1:], strict=True):
                _, at = np.unique(seq[a:b], return_index=True)  # repeated rows count once
                out.append(encoder.join([tokens[edges[a + i] : edges[a + i + 1]] for i in at]))
            lens = np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(out).astype(np.int32)))], names=["doc_id", "ids"])

    return run


def encoded_corpus(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every text, without special tokens; look-alikes are plain text.

    An empty list for an empty and for a null text. Rows equal in doc_id and text come out once; without
    doc_id they are left out. folder and vocabulary name the tokenizer's files, present on every machine.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    full = docs.where("text <> ''").select("doc_id", F.xxhash64("text").alias("own"), "text")
    places = stored(full.mapInArrow(_cut(False), "doc_id long, own long, seq int, key binary"), "places")
    uses = stored(places.groupBy("key").agg(F.count("*").alias("uses")).where("uses > 1"), "uses")
    # Documents with a chunk that stands elsewhere too; rows with several keep one.
    sharing = stored(salted_join(places, uses.select("key"), ["key"], uses, "uses", F.xxhash64("doc_id", "seq")).select("doc_id", "own").distinct(), "sharing")
    known = maybe_broadcast(sharing)
    alone = full.join(known, ["doc_id", "own"], "left_anti").select("doc_id", "text").mapInArrow(_encode_whole(folder, vocabulary), "doc_id long, ids array<int>")
    chunks = full.join(known, ["doc_id", "own"], "left_semi").mapInArrow(_cut(True), "key binary, chunk string").groupBy("key", "chunk").agg(F.count("*").alias("uses"))
    once = stored(chunks.select("key", "chunk", "uses").mapInArrow(_encode(folder, vocabulary), "key binary, uses long, ids array<int>"), "chunks")
    met = salted_join(places.join(known, ["doc_id", "own"], "left_semi"), once.select("key", "ids"), ["key"], once.select("key", "uses"), "uses", F.xxhash64("doc_id"))
    whole = met.groupBy("doc_id", "own").agg(F.collect_list(F.struct("seq", "ids")).alias("parts")).select("doc_id", "parts")
    blank = docs.where("text is null or text = ''").select("doc_id").distinct().select("doc_id", F.array().cast("array<int>").alias("ids"))
    return alone.union(whole.mapInArrow(_assemble(folder, vocabulary), "doc_id long, ids array<int>")).union(blank)


def p6_ids(spark, folder):
    from strataquery.sources.tables import spread, table

    return encoded_corpus(spread(table(spark, folder, "documents", "doc_id", "text")))


def p6_lengths(spark, folder):
    """Documents and tokens per source."""
    from strataquery.sources.tables import table

    documents = table(spark, folder, "documents", "doc_id", "text", "source")
    ids = encoded_corpus(documents.select("doc_id", "text")).select("doc_id", F.size("ids").alias("n"))
    return documents.select("doc_id", "source").join(ids, "doc_id").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_tokens"))
