"""Problem 7: byte-pair encoding of a corpus, by speculation and verification.

Words come from the vocabulary's split pattern. Each distinct word is first cut greedily into
the longest vocabulary entries; a cut is the byte-pair encoding exactly if every two adjacent
tokens are compatible, that is, if merging their bytes never merges across their border. That
is tested for all adjacent pairs of a batch at once; only words with a failing pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.operators.storage import spread

# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a worker keeps encoded; beyond it the store starts anew.
MAX_WORDS = 300_000
TOP = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Merges:
    """A byte-level vocabulary whose identifiers rise in the order of its merges."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        alphabet = byte_alphabet()
        self.ids = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        pairs = []
        for m in merges:
            a, b = m if not isinstance(m, str) else m.split(" ")
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.left[made], self.right[made] = x, y
            pairs.append((x << 20 | y, made))
        codes = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        codes = codes[np.argsort(codes[:, 0])]
        self.pair, self.made = codes[:, 0], codes[:, 1]
        if (self.made <= np.maximum(self.pair >> 20, self.pair & (1 << 20) - 1)).any():
            raise ValueError("a merge's identifier must be above those of its parts")
        self.merge = dict(pairs)
        self.byte = [self.ids[bytes([b])] for b in range(256)]
        #: Entries that merging their own bytes gives; others are never proposed.
        whole = {t: i for t, i in self.ids.items() if self.exact(t) == [i]}
        self.proposed = whole
        self.longest: dict[bytes, int] = {}
        for t in whole:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))

    @classmethod
    def from_file(cls, path: str) -> Merges:
        """From the JSON file of a byte-level vocabulary."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], model["merges"])

    def exact(self, word: bytes) -> list[int]:
        """Byte-pair encoding by merging: the earliest merge first, of equal ones the leftmost."""
        ids = [self.byte[b] for b in word]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := self.merge.get(m << 20 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, m, ids[after[i]]))
            if before[i] >= 0 and (x := self.merge.get(ids[before[i]] << 20 | m)) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], m))
        return [i for i in ids if i >= 0]

    def greedy(self, word: bytes) -> list[int]:
        """The longest proposed entry, again and again."""
        get, longest = self.proposed.get, self.longest
        if (whole := get(word)) is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + longest.get(word[at : at + 2], 1)), at, -1):
                if (i := get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a[i] + b[i] ends in these two tokens.

        The states at the border are walked back in time, by undoing the later of the two
        merges beside it (of two equal ones the right, as the left is merged first). A merge
        across the border would have happened if its place in the order comes before the left
        piece is used up, and not after the right one is.
        """
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_used, y_used = np.full(len(a), TOP), np.full(len(a), TOP)
        while len(at):
            code = x << 20 | y
            k = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            merged = np.where(self.pair[k] == code, self.made[k], TOP)
            crossed = (merged < x_used) & (merged <= y_used) & (merged != TOP)
            good[at[crossed]] = False
            undo_x = x > y
            ended = np.where(undo_x, self.right[x], self.left[y]) < 0
            go = ~crossed & ~ended
            at, x, y, x_used, y_used, undo_x = at[go], x[go], y[go], x_used[go], y_used[go], undo_x[go]
            x_used, y_used = np.where(undo_x, x, x_used), np.where(undo_x, y_used, y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Encoding of each word, and how many needed exact merging."""
        cut = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        flat = np.fromiter((i for c in cut for i in c), dtype=np.int64, count=int(sizes.sum()))
        word = np.repeat(np.arange(len(cut)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1])
        failing = np.unique(word[inner[~self.compatible(flat[inner], flat[inner + 1])]])
        for w in failing.tolist():
            cut[w] = self.exact(words[w])
        return cut, len(failing)


class Encoder:
    """Encodes batches of texts; keeps the distinct words it has met."""

    def __init__(self, merges: Merges) -> None:
        import regex

        self.merges, self.find = merges, regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and flat ids; null and empty texts have no ids."""
        if len(self.code) > MAX_WORDS:
            self.clear()
        code = self.code
        codes: list[int] = []
        ends = [0]
        fresh: list[str] = []
        for t in texts:
            if t:
                for w in self.find(t):
                    c = code.get(w)
                    if c is None:
                        c = code[w] = len(code)
                        fresh.append(w)
                    codes.append(c)
            ends.append(len(codes))
        if fresh:
            cut, _ = self.merges.encode_words([w.encode("utf-8") for w in fresh])
            size = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter((i for c in cut for i in c), dtype=np.int32, count=int(size.sum()))])
        words = np.array(codes, dtype=np.int64)
        size = self.size[words]
        after = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[words] - after[:-1], size) + np.arange(after[-1])]
        return after[np.array(ends)], ids


_encoders: dict[str, Encoder] = {}


def encode_corpus(df: DataFrame, item: str, text: str, vocabulary: str, ids: str = "ids") -> DataFrame:
    """(item, ids): the token ids of each text by the byte-level vocabulary file at ``vocabulary``, without special tokens.

    The text is taken exactly as stored; the strings of special tokens are ordinary text. Null
    and empty texts give an empty list; each row gives one row, in a map-only plan. The tables (a few MB, fixed by the vocabulary) are broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(Merges.from_file(vocabulary))
    key = uuid.uuid4().hex
    kind = df.schema[item].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(sent.value)
        own = _encoders[key]
        for batch in batches:
            step = 500  # texts at a time, so that a batch's ids stay few MB
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                offsets, flat = own.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[item, ids])

    return spread(df.select(F.col(item), F.col(text).alias("__text"))).mapInArrow(encode, f"`{item}` {kind}, `{ids}` array<int>")
