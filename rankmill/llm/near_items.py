"""Problem 8, reworded passages: whole items that stand in a document with some of their words changed.

A SimHash is taken of each item and of windows of about its size in the documents. A
multi-index over four 16-bit blocks finds all pairs of fingerprints within ``radius`` bits: one
block of such a pair differs in at most a quarter of them, so each item stands in the index under
every block that near its own. Candidates are verified, at every place near the window, by the
exact weighted similarity of their word shingles.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.leakage import BLOCKS, SHINGLE, BitSums, Votes, fingerprints, shingle_similarity, word_bits, words_of
from rankmill.operators.storage import spread

#: Entries of the index that is broadcast at once (four bytes each, for each of four blocks).
INDEX_ENTRIES = 4_000_000
#: Sizes of windows grow by this factor, from size to size.
GRID = 1.06
#: Windows begin at every word up to this size, and at every (size / STRIDE)-th word beyond it.
STRIDE = 16
CHUNK = 1 << 15
#: Candidates whose words are compared at once.
COMPARED = 1 << 14


def window_size(n: int) -> int:
    """The size of the windows that are held against an item of ``n`` words: the largest of the grid up to ``n``."""
    size = 1
    while (more := max(size + 1, math.floor(size * GRID))) <= n:
        size = more
    return size


def near_blocks(distance: int) -> np.ndarray:
    """All 16-bit masks with at most ``distance`` bits."""
    return np.array([sum(1 << b for b in bits) for d in range(distance + 1) for bits in combinations(range(16), d)], dtype=np.uint16)


def entries_per_item(radius: int) -> int:
    return sum(math.comb(16, d) for d in range(radius // BLOCKS + 1))


class ItemIndex:
    """Items by the size of their windows, each with a multi-index that is complete up to ``radius``."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int, shingle: int, similarity: float) -> None:
        self.radius, self.shingle, self.similarity = radius, shingle, similarity
        own = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.ids = np.array([i for i, _ in own], dtype=np.int64)
        self.words = [w for _, w in own]
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        self.code: dict[str, int] = {}
        for w in self.words:
            for x in w:
                self.code.setdefault(x, len(self.code))
        self.holds = np.zeros((len(own), len(self.code) + 1), dtype=bool)  # the last column: words that no item has
        prints = np.zeros(len(own), dtype=np.uint64)
        for k, w in enumerate(self.words):
            self.holds[k, [self.code[x] for x in w]] = True
            prints[k] = fingerprints(np.array([word_bits(x) for x in w], dtype=np.uint64), len(w))[0]
        self.prints = prints
        #: Words that an item and a window must share to be similar enough.
        self.shared = np.ceil(np.maximum(1, self.length - shingle + 1) * 2 * similarity / (1 + similarity) - 1e-9)
        self.sizes: dict[int, list] = {}
        masks = near_blocks(radius // BLOCKS)
        by_size: dict[int, list[int]] = {}
        for k, n in enumerate(self.length.tolist()):
            by_size.setdefault(window_size(n), []).append(k)
        for size, members in by_size.items():
            at = np.array(members, dtype=np.int32)
            index = []
            for block in prints[at].view(np.uint16).reshape(-1, BLOCKS).T:
                near = (block[:, None] ^ masks[None, :]).ravel()
                order = np.argsort(near, kind="stable")
                count = np.bincount(near, minlength=1 << 16)
                index.append((np.repeat(at, len(masks))[order], np.cumsum(count) - count, count))
            self.sizes[size] = index

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``prints``, item) within the radius, all of them."""
        found = []
        for block, (item, start, count) in zip(prints.view(np.uint16).reshape(-1, BLOCKS).T, self.sizes[size]):
            n = count[block]
            at = np.flatnonzero(n)
            n = n[at]
            ends = np.cumsum(n)
            left = np.repeat(at, n)
            right = item[np.repeat(start[block[at]] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            near = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append(left[near] * np.int64(len(self.ids)) + right[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.ids), pairs % len(self.ids)

    def found(self, texts: list[str | None], votes: Votes) -> list[tuple[int, int]]:
        """(position of text, item id) of each text that holds a passage of an item's length that is similar enough."""
        words: list[str] = []
        ends = []
        for t in texts:
            words += words_of(t)
            ends.append(len(words))
        if not words or not len(self.ids):
            return []
        end = np.array(ends, dtype=np.int64)
        begin = np.concatenate([[0], end[:-1]])
        get, none = self.code.get, len(self.code)
        known = np.fromiter((get(w, none) for w in words), dtype=np.int64, count=len(words))
        bits = votes.of(words)
        out: set[tuple[int, int]] = set()
        longest = max(self.sizes)
        for chunk in range(0, len(words), CHUNK):
            sums = BitSums(bits[chunk : chunk + CHUNK + longest])
            for size in self.sizes:
                stride = max(1, size // STRIDE)
                starts = window_starts(begin, end, size, stride, chunk, min(chunk + CHUNK, len(words)))
                if not len(starts):
                    continue
                prints = sums.majority(size, starts - chunk)
                left, item = self.candidates(size, prints)
                for k in range(0, len(left), COMPARED):
                    self._verify(words, known, begin, end, starts[left[k : k + COMPARED]], item[k : k + COMPARED], size, stride, out)
        return sorted((d, int(self.ids[k])) for d, k in out)

    def _verify(self, words, known, begin, end, start, item, size, stride, out) -> None:
        doc = np.searchsorted(end, start, side="right")
        lengths = self.length[item]
        low = np.maximum(begin[doc], start - (lengths - size) - stride + 1)
        high = np.minimum(end[doc], start + size + (lengths - size) + stride - 1)
        fits = high - low >= lengths
        start, item, doc, low, high = start[fits], item[fits], doc[fits], low[fits], high[fits]
        # No window between ``low`` and ``high`` shares more words with the item than stand there.
        reach = int((high - low).max(initial=0))
        at = low[:, None] + np.arange(reach)[None, :]
        inside = at < high[:, None]
        shared = (self.holds[item[:, None], known[np.minimum(at, len(known) - 1)]] & inside).sum(axis=1)
        for k in np.flatnonzero(shared >= self.shared[item]).tolist():
            pair = (int(doc[k]), int(item[k]))
            if pair in out:
                continue
            own = self.words[pair[1]]
            n = len(own)
            if any(shingle_similarity(words[p : p + n], own, self.shingle) >= self.similarity for p in range(int(low[k]), int(high[k]) - n + 1)):
                out.add(pair)


def window_starts(begin: np.ndarray, end: np.ndarray, size: int, stride: int, low: int, high: int) -> np.ndarray:
    """Where windows of ``size`` words begin in texts from ``begin`` to ``end``, from ``low`` up to ``high``: every ``stride``-th word of a text, and its last place."""
    first = max(0, int(np.searchsorted(end, low, side="right")))
    last = int(np.searchsorted(begin, high))
    b, n = begin[first:last], (end - begin)[first:last] - size
    b, n = b[n >= 0], n[n >= 0]
    if not len(b):
        return np.zeros(0, dtype=np.int64)
    count = -(-n // stride) + 1
    total = np.cumsum(count)
    step = np.arange(total[-1]) - np.repeat(total - count, count)
    starts = np.repeat(b, count) + np.minimum(step * stride, np.repeat(n, count))
    return starts[(starts >= low) & (starts < high)]


_indexes: dict[str, tuple[ItemIndex, Votes]] = {}


def near_items(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, shingle: int = SHINGLE, similarity: float = 0.8, radius: int = 11, index_entries: int = INDEX_ENTRIES) -> DataFrame:
    """(doc_id, item_id), once each: documents that hold a passage of an item's length that is at least ``similarity`` alike.

    Likeness is the weighted Jaccard similarity of shingles of ``shingle`` words, weighted by how often each
    occurs; ``shingle=1`` compares the words whatever their order. Candidates lie within ``radius`` of 64 bits
    of the item's SimHash; what that loses is measured in the tests. Null and empty texts
    hold nothing, nor do texts with fewer words than the item; items without a word are held by none;
    repeated rows change nothing. Items go along in blocks of ``index_entries`` index entries, each a
    pass over the documents, so any number of items is served; ids are integers.
    """
    if not 0 <= radius < 64 or not 0 < similarity <= 1 or shingle < 1:
        raise ValueError("0 <= radius < 64, 0 < similarity <= 1 and shingle >= 1 are needed")
    spark = documents.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    passes = 1 + items.count() * entries_per_item(radius) // index_entries
    docs = spread(documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t <> ''"))
    found = None
    for k in range(passes):
        block = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k).toLocalIterator()]
        sent = spark.sparkContext.broadcast(ItemIndex(block, radius, shingle, similarity))
        part = docs.mapInArrow(_scanner(sent, uuid.uuid4().hex), "d long, i long")
        found = part if found is None else found.unionByName(part)
    return found.distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def _scanner(sent, key: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = (sent.value, Votes())
        index, votes = _indexes[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                pairs = index.found(part.column(1).to_pylist(), votes)
                if pairs:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([p[0] for p in pairs])), pa.array([p[1] for p in pairs], pa.int64())], names=["d", "i"])

    return scan
