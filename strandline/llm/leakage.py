"""Problem 9: evaluation texts leaking into training text, by Wu-Manber multi-pattern search over words.

The patterns are all runs of ``span`` consecutive words of the test items. The shift table says for each block of
``BLOCK`` words how far a search window ending at it may move without passing an occurrence; a block that no pattern
holds allows the full shift of ``span - BLOCK + 1`` words. The scan looks at blocks one full shift apart: every
occurrence holds exactly one whole such block, so windows between blocks that no pattern holds are skipped unread.
At the other blocks the windows that the shift leaves open are looked up in buckets by their suffix block and
fingerprint; where all their words' fingerprints agree the words themselves are compared, one by one.

The items are the stated query set: they are taken in groups of ``block_words`` words, each a pass over the documents,
so that what a worker holds has a fixed bound.

Words are maximal runs of letters or digits in lower case. Defined results: null or short texts and items match
nothing; null ids are left out; repeated rows give one result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SPAN, BLOCK = 12, 3
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordPrints(dict):
    """Fingerprints (8 bytes for each word) of the chunks between white space; up to ``keep`` are remembered."""

    def __init__(self, keep: int = 400_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, chunk: str) -> bytes:
        out = b"".join(xxhash.xxh64_digest(w) for w in _WORD.findall(chunk.lower()))
        if len(self) < self.keep:
            self[chunk] = out
        return out

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""


def words_of(text: str | None) -> list[str]:
    return [w for chunk in (text or "").split() for w in _WORD.findall(chunk.lower())]


def _blocks(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n words from each place."""
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = (h ^ words[at + j]) * _ODD
        h ^= h >> np.uint64(31)
    return h


class Patterns:
    """Shift table, buckets and words of a group of items."""

    def __init__(self, items: list[tuple[object, str | None]], span: int = SPAN):
        prints = WordPrints()
        self.span, self.full = span, span - BLOCK + 1
        words, item, first = [], [], []
        self.texts: list[str] = []
        blocks, shift = [], []
        base = 0
        for i, (_, text) in enumerate(items):
            w = np.frombuffer(prints.of(text), np.uint64)
            if len(w) < span:
                continue
            words.append(w)
            self.texts += words_of(text)
            n = len(w) - span + 1
            item.append(np.full(n, i))
            first.append(base + np.arange(n))
            k = np.arange(len(w) - BLOCK + 1)
            blocks.append(_blocks(w, k, BLOCK))
            shift.append(np.maximum(0, span - BLOCK - k))
            base += len(w)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.size = len(self.words)
        if not self.size:
            return
        b, s = np.concatenate(blocks), np.concatenate(shift)
        order = np.lexsort((s, b))
        self.block, at = np.unique(b[order], return_index=True)
        self.shift = s[order][at]
        self.seen = np.zeros(1 << 20, bool)  # first look: the low bits of the blocks
        self.seen[self.block & np.uint64((1 << 20) - 1)] = True
        first, item = np.concatenate(first), np.concatenate(item)
        key = _blocks(self.words, first, span)
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.item = key[order], first[order], item[order]

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Place in the block table, or -1."""
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.seen[h & np.uint64((1 << 20) - 1)])
        i = np.minimum(np.searchsorted(self.block, h[maybe]), len(self.block) - 1)
        hit = self.block[i] == h[maybe]
        out[maybe[hit]] = i[hit]
        return out

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first word, item number, place of the first word in the items) of all occurrences, by fingerprints of words."""
        none = np.zeros(0, np.int64)
        if not self.size or len(words) < self.span:
            return none, none, none
        at = np.arange(0, len(words) - BLOCK + 1, self.full)
        i = self._lookup(_blocks(words, at, BLOCK))
        at, reach = at[i >= 0], self.span - BLOCK - self.shift[i[i >= 0]]
        n = reach + 1  # windows that start 0..reach words before the block
        start = np.repeat(at, n) - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        start = start[(start >= 0) & (start + self.span <= len(words))]
        start = start[self._lookup(_blocks(words, start + self.span - BLOCK, BLOCK)) >= 0]  # suffix
        key = _blocks(words, start, self.span)
        lo, hi = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        start, lo, n = start[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        entry = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(start, n)
        same = np.ones(len(start), bool)
        for j in range(self.span):
            same &= words[start + j] == self.words[self.first[entry] + j]
        return start[same], self.item[entry[same]], self.first[entry[same]]


def item_groups(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, str]]]:
    group, size = [], 0
    for i, text in items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        n = len(text.split())
        if group and size + n > block_words:
            yield group
            group, size = [], 0
        group.append((i, text))
        size += n
    if group:
        yield group


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, block_words: int = 1_000_000, rows: int = 256) -> DataFrame:
    """(doc_id, item_id, n_spans): documents that share at least ``span`` consecutive words with an item, and in how many places."""
    if span < BLOCK:
        raise ValueError(f"span must be at least {BLOCK}")
    spark = docs.sparkSession
    kinds = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, n_spans bigint"
    src = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    item_type = to_arrow_type(items.schema[item_id].dataType)
    out = None
    gap = b"\0" * 8 * span
    for group in item_groups(items, item_id, item_text, block_words):
        held = spark.sparkContext.broadcast((Patterns(group, span), [i for i, _ in group]))

        def scan(batches, held=held):
            patterns, ids = held.value
            prints = WordPrints()
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    texts = [prints.of(t) for t in part.column(1).to_pylist()]
                    begin = np.cumsum([0, *(len(t) // 8 + span for t in texts)])
                    start, item, first = patterns.search(np.frombuffer(gap.join(texts) + gap, np.uint64))
                    doc = np.searchsorted(begin, start, side="right") - 1
                    own = {int(d): words_of(part.column(1)[int(d)].as_py()) for d in np.unique(doc)}
                    same = np.array([own[d][s : s + span] == patterns.texts[f : f + span] for d, s, f in zip(doc.tolist(), (start - begin[doc]).tolist(), first.tolist())], bool)
                    doc, item = doc[same], item[same]
                    both, n = np.unique(np.stack([doc, item], 1), axis=0, return_counts=True) if len(doc) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(both[:, 0])), pa.array([ids[i] for i in both[:, 1]], item_type), pa.array(n)], ["doc_id", "item_id", "n_spans"])

        found = src.mapInArrow(scan, kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], kinds)
    return out.groupBy("doc_id", "item_id").agg(F.sum("n_spans").alias("n_spans"))
