"""Problem 8: passages of evaluation items inside training text.

Every window of an item (12 words, or the whole of a shorter item) and every window of that
size in a document gets a SimHash. A multi-index over four 16-bit blocks finds all pairs of
windows within a Hamming distance of three; equal windows have distance zero, so none is
missed. Candidates are verified by the exact weighted similarity of their word shingles.
Near copies are also looked for in longer windows, whose candidates come from the shingles
themselves, so that none is missed either.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.operators.storage import spread

WINDOW = 12
RADIUS = 3
BLOCKS = 4
SHINGLE = 5
#: Item windows whose index is broadcast at once (about 100 bytes each); more go through the documents in several passes.
INDEX_WINDOWS = 200_000
STEP = 1 << 15

_word = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, ignoring case."""
    return _word.findall(text.lower()) if text else []


def word_bits(word: str) -> int:
    """A word's 64 votes, a bit each."""
    return xxhash.xxh64_intdigest(word)


class BitSums:
    """Of a sequence of 64-bit numbers: for runs of them, in how many each bit is set. Counts lie in bit planes, so that an operation on 64-bit numbers counts for all bits at once."""

    def __init__(self, bits: np.ndarray) -> None:
        self.levels = [[bits]]  # planes, lowest first, of the counts over 2 ** k numbers from each place on

    def _level(self, k: int) -> list[np.ndarray]:
        while len(self.levels) <= k:
            step = 1 << len(self.levels) - 1
            self.levels.append(_added([p[:-step] for p in self.levels[-1]], [p[step:] for p in self.levels[-1]]))
        return self.levels[k]

    def majority(self, size: int, starts: np.ndarray | None = None) -> np.ndarray:
        """The bits that are set in more than half of the ``size`` numbers from each place on, or from each of ``starts``."""
        n = len(self.levels[0][0]) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        total, at = None, 0
        for k in range(size.bit_length() - 1, -1, -1):
            if size >> k & 1:
                own = [p[at : at + n] if starts is None else p[starts + at] for p in self._level(k)]
                total = own if total is None else _added(total, own)
                at += 1 << k
        return _at_least(total, size // 2 + 1)


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two counts in planes."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        y = b[i] if i < len(b) else None
        if y is None and carry is None:
            out.append(x)
        elif y is None or carry is None:
            z = carry if y is None else y
            out.append(x ^ z)
            carry = x & z
        else:
            both = x ^ y
            out.append(both ^ carry)
            carry = x & y | both & carry
    return out if carry is None else [*out, carry]


def _at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    if least >> len(planes):
        return np.zeros_like(planes[0])
    out = np.full_like(planes[0], ~np.uint64(0))
    for i, p in enumerate(planes):
        out = p & out if least >> i & 1 else p | out
    return out


def fingerprints(bits: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of ``size`` words, given their bits: what most of them vote for."""
    return BitSums(bits).majority(size)


def shingle_similarity(a: list[str], b: list[str], size: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the word shingles, weighted by how often each occurs; windows shorter than a shingle are one."""
    own = [Counter(tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))) for x in (a, b)]
    both = sum((own[0] & own[1]).values())
    return both / max(1, sum((own[0] | own[1]).values()))


class WindowIndex:
    """Windows of items by their size, each with a multi-index over blocks of its fingerprint."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW) -> None:
        self.sizes: dict[int, tuple] = {}
        by: dict[int, tuple[list, list, list]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            if size:
                ids, windows, prints = by.setdefault(size, ([], [], []))
                ids += [item] * (len(words) - size + 1)
                windows += [words[i : i + size] for i in range(len(words) - size + 1)]
                prints.append(fingerprints(np.array([word_bits(w) for w in words], dtype=np.uint64), size))
        for size, (ids, windows, prints) in by.items():
            fp = np.concatenate(prints)
            index = []
            for block in fp.view(np.uint16).reshape(-1, BLOCKS).T:
                order = np.argsort(block, kind="stable")
                count = np.bincount(block, minlength=1 << 16)
                index.append((order, np.cumsum(count) - count, count))
            self.sizes[size] = (np.array(ids), windows, fp, index)

    def candidates(self, size: int, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``fp``, item window) with a Hamming distance of at most ``radius`` (under BLOCKS: complete)."""
        _, _, own, index = self.sizes[size]
        found = []
        for block, (order, start, count) in zip(fp.view(np.uint16).reshape(-1, BLOCKS).T, index):
            n = count[block]
            at = np.flatnonzero(n)
            n = n[at]
            ends = np.cumsum(n)
            left = np.repeat(at, n)
            right = order[np.repeat(start[block[at]] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            near = np.bitwise_count(fp[left] ^ own[right]) <= radius
            found.append(left[near] * np.int64(len(own)) + right[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(own), pairs % len(own)


class Votes:
    """The votes of each distinct word met so far; starts anew beyond MAX_WORDS."""

    MAX_WORDS = 200_000

    def __init__(self) -> None:
        self.bits: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.bits) > self.MAX_WORDS:
            self.bits.clear()
        for w in {*words}.difference(self.bits):
            self.bits[w] = word_bits(w)
        return np.fromiter(map(self.bits.__getitem__, words), dtype=np.uint64, count=len(words))


def leaks_in(texts: list[str | None], index: WindowIndex, votes: Votes, similarity: float, radius: int) -> list[tuple[int, int]]:
    """(position of text, item) for each item of which the text holds a window that is at least ``similarity`` alike; 1.0: the same words."""
    words: list[str] = []
    lengths = []
    for t in texts:
        own = words_of(t)
        lengths.append(len(own))
        words += own
    if not words or not index.sizes:
        return []
    doc_of, bits, longest = np.repeat(np.arange(len(texts)), lengths), votes.of(words), max(index.sizes)
    found: set[tuple[int, int]] = set()
    for at in range(0, len(bits), STEP):
        sums = BitSums(bits[at : at + STEP + longest - 1])
        for size, (ids, windows, _, _) in index.sizes.items():
            fp = sums.majority(size)[:STEP]
            if not len(fp):
                continue
            inside = np.flatnonzero(doc_of[at : at + len(fp)] == doc_of[at + size - 1 : at + size - 1 + len(fp)])
            left, right = index.candidates(size, np.ascontiguousarray(fp[inside]), radius)
            for p, r in zip((inside[left] + at).tolist(), right.tolist()):
                pair = (int(doc_of[p]), int(ids[r]))
                if pair in found:
                    continue
                own = words[p : p + size]
                if own == windows[r] or similarity < 1 and shingle_similarity(own, windows[r]) >= similarity:
                    found.add(pair)
    return sorted(found)


def near_window(similarity: float) -> int:
    """The fewest words in which one changed word, wherever it stands, leaves two windows ``similarity`` alike."""
    return math.ceil(SHINGLE * (1 + similarity) / (1 - similarity)) + SHINGLE - 1


class NearIndex:
    """Items by their word shingles, for windows of ``window`` and of ``near_window`` words or of a whole shorter item."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float, window: int = WINDOW) -> None:
        self.sizes, self.similarity = (window, near_window(similarity)), similarity
        self.items = [(item, words_of(text)) for item, text in items]
        self.holders: dict[tuple, list[int]] = {}
        for k, (_, words) in enumerate(self.items):
            for gram in set(_shingles(words)):
                self.holders.setdefault(gram, []).append(k)

    def found(self, text: str | None) -> set[int]:
        """Items of which a window is ``similarity`` alike to one of the text's of its size; complete, as such windows share shingles."""
        words = words_of(text)
        grams = _shingles(words)
        hits: dict[int, list[int]] = defaultdict(list)
        for p, gram in enumerate(grams):
            for k in self.holders.get(gram, ()):
                hits[k].append(p)
        out: set[int] = set()
        for k, at in hits.items():
            item, own = self.items[k]
            held = {grams[p] for p in at}
            for size in {min(s, len(own)) for s in self.sizes}:
                common = size - SHINGLE + 1
                least = 2 * common * self.similarity / (1 + self.similarity) - 1e-9  # shingles that two such windows share
                if item in out or common < 1 or len(at) < least or len(words) < size:
                    continue
                left, right = (_dense(np.array([g in held for g in x]), common, least) for x in (grams, _shingles(own)))
                if any(shingle_similarity(words[p : p + size], own[q : q + size]) >= self.similarity for p in left for q in right):
                    out.add(item)
        return out


def _shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def _dense(hit: np.ndarray, length: int, least: float) -> list[int]:
    """Where ``length`` places begin of which at least ``least`` are hit."""
    sums = np.concatenate([[0], np.cumsum(hit)])
    return np.flatnonzero(sums[length:] - sums[:-length] >= least).tolist()


_indexes: dict[str, tuple[WindowIndex, NearIndex | None, Votes]] = {}


def leaked_items(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, similarity: float = 0.8, radius: int = RADIUS, index_windows: int = INDEX_WINDOWS) -> DataFrame:
    """(doc_id, item_id), once each: documents that hold a window of an item that is at least ``similarity`` alike.

    The default finds near copies (five-word shingles, 0.8): all pairs of windows of ``window``
    or of ``near_window(similarity)`` words (49 for 0.8; the whole of a shorter item) that are so
    alike, found by their shingles. ``similarity=1.0`` asks for the item's words in its order with no other word between, and
    is complete at any radius. Null and empty texts hold nothing; items without a word are held by
    none; repeated rows change nothing. The index of the items is broadcast in blocks of
    ``index_windows`` windows, so any number of items is served; document ids and item ids are integers.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError("the blocks guarantee radii from 0 to 3")
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    spark = documents.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = items.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0  # a word and a separator take two characters at least
    passes = max(1, int(total // index_windows) + 1) if total > index_windows else 1
    docs = spread(documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t <> ''"))
    found = None
    for k in range(passes):
        block = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k).toLocalIterator()]
        sent = spark.sparkContext.broadcast((WindowIndex(block, window), NearIndex(block, similarity, window) if similarity < 1 else None))
        part = docs.mapInArrow(_scanner(sent, uuid.uuid4().hex, similarity, radius), "d long, i long")
        found = part if found is None else found.unionByName(part)
    return found.distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def _scanner(sent, key: str, similarity: float, radius: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = (*sent.value, Votes())
        index, near, votes = _indexes[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                pairs = leaks_in(texts, index, votes, similarity, radius)
                if near is not None:
                    pairs = sorted({*pairs, *((k, i) for k, t in enumerate(texts) for i in near.found(t))})
                if pairs:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([p[0] for p in pairs])), pa.array([p[1] for p in pairs], pa.int64())], names=["d", "i"])

    return scan
