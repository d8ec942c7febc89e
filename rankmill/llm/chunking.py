"""Problem 5: splitting oversized items at natural boundaries, by content-defined chunking.

A rolling hash over the last WINDOW tokens is taken at every token. A landmark is a token whose
hash is lower than that of every other token within ``reach`` tokens; it moves to the nearest
natural boundary (end of a sentence) within ``snap`` tokens, if there is one. Landmarks and where
they move depend on the tokens near them alone and are at least ``reach`` + 1 - 2 ``snap`` tokens
apart, so each is a cut; gaps beyond the maximum size are cut, from their left end, into the longest pieces
that fit and end at a natural boundary. An edit therefore alters cuts within ``reach`` + ``snap`` + WINDOW
tokens (or the minimum size) of it and up to the next landmark, and none after it. With ``reach`` = 0 every token is a landmark, and pieces are the longest
that fit and end at a natural boundary.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
_token = re.compile(r"[^ \t\n]+")
_sentence_end = re.compile(r"""[.!?][)\]"']*$""")


def tokens_of(text: str) -> list[str]:
    """Tokens are separated by runs of blanks, tabs or newlines."""
    return _token.findall(text)


def sentence_ends(tokens: list[str]) -> np.ndarray:
    """Positions (from 1) of tokens that end a sentence: . ! or ? and closing marks, before a token that begins with A-Z."""
    upper = [t[0] <= "Z" and t[0] >= "A" for t in tokens]
    return np.array([i + 1 for i in range(len(tokens) - 1) if upper[i + 1] and _sentence_end.search(tokens[i])], dtype=np.int64)


def rolling_hashes(tokens: list[str], window: int = WINDOW) -> np.ndarray:
    """At each token, a hash of it and of the up to ``window`` - 1 tokens before it."""
    n = len(tokens)
    known: dict[str, int] = {}
    h = np.fromiter((known[t] if t in known else known.setdefault(t, xxhash.xxh64_intdigest(t)) for t in tokens), dtype=np.uint64, count=n)
    rolled = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(min(window, n)):
        rolled[k:] += h[: n - k] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return rolled ^ rolled >> np.uint64(29)


def _least_before(h: np.ndarray, reach: int) -> np.ndarray:
    """At each place, the least of the ``reach`` values before it; the highest value where there is none."""
    low = np.concatenate([np.full(reach, np.iinfo(np.uint64).max, dtype=np.uint64), h[:-1]])
    size = 1  # low[i] is the least of ``size`` values from i on
    while size < reach:
        step = min(size, reach - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return low


def landmarks(tokens: list[str], reach: int, window: int = WINDOW) -> np.ndarray:
    """Positions (from 1) whose rolling hash is lower than all others within ``reach`` tokens."""
    if reach <= 0 or not tokens:
        return np.arange(1, len(tokens) + 1, dtype=np.int64)
    h = rolling_hashes(tokens, window)
    return np.flatnonzero((h < _least_before(h, reach)) & (h < _least_before(h[::-1], reach)[::-1])).astype(np.int64) + 1


def snapped(marks: np.ndarray, ends: np.ndarray, snap: int) -> list[int]:
    """Each landmark at its nearest boundary within ``snap`` tokens, the earlier of two equally near; in place where there is none."""
    if not len(ends):
        return marks.tolist()
    k = np.searchsorted(ends, marks)
    before, after = ends[np.maximum(k - 1, 0)], ends[np.minimum(k, len(ends) - 1)]
    best = np.where(np.abs(before - marks) <= np.abs(after - marks), before, after)
    return np.where(np.abs(best - marks) <= snap, best, marks).tolist()


def pieces_of(tokens: list[str], least: int, most: int, overlap: int, reach: int = 0) -> list[tuple[int, int]]:
    """First and last token (from 1, both included) of each piece. See the module's text.

    A cut is the last token of a piece; the next piece begins ``overlap`` tokens before its end. ``reach`` > 0 must be
    ``least`` - 1 at least; landmarks then move by (``reach`` + 1 - ``least``) / 2 at most, so that
    none but the last piece has fewer than ``least`` tokens.
    """
    n = len(tokens)
    if n <= most:
        return [(1, n)] if n else []
    ends = sentence_ends(tokens)
    return _by_landmark(tokens, ends, least, most, overlap, reach) if reach > 0 else _longest(ends.tolist(), n, least, most, overlap)


def _longest(ends: list[int], n: int, least: int, most: int, overlap: int) -> list[tuple[int, int]]:
    out, first = [], 1
    while n - first + 1 > most:
        low, high = first + least - 1, first + most - 1
        e = bisect_right(ends, high) - 1
        last = ends[e] if e >= 0 and ends[e] >= low else high
        out.append((first, last))
        first = last - overlap + 1
    return [*out, (first, n)]


def _by_landmark(tokens: list[str], ends: np.ndarray, least: int, most: int, overlap: int, reach: int) -> list[tuple[int, int]]:
    n, natural = len(tokens), ends.tolist()
    cuts: list[int] = []
    at = 0
    for mark in [c for c in snapped(landmarks(tokens, reach), ends, (reach + 1 - least) // 2) if least <= c < n] + [n]:
        while mark - at > (room := most - overlap if at else most):  # beyond its overlap, a piece takes so many tokens
            high = min(at + room, mark - least)
            e = bisect_right(natural, high) - 1
            at = natural[e] if e >= 0 and natural[e] >= at + least else high
            cuts.append(at)
        if mark > at:
            cuts.append(mark)
            at = mark
    return [(max(1, before - overlap + 1), cut) for before, cut in zip([0, *cuts], cuts)]


def n_tokens(text: Column) -> Column:
    """Number of tokens of ``tokens_of``; 0 for empty, null for null."""
    inner = F.regexp_replace(text, "\\A[ \\t\\n]+|[ \\t\\n]+\\z", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[ \\t\\n]+")))


def split_oversized(df: DataFrame, item: str, text: str, most: int = 512, least: int = 51, overlap: int = 50, reach: int = 0, only_oversized: bool = True) -> DataFrame:
    """(item, piece_no, first_token, last_token) of each text with more than ``most`` tokens.

    Consecutive pieces share ``overlap`` tokens (< ``least``, so that each goes on); none has
    more than ``most``. ``reach``: see ``pieces_of``. ``only_oversized=False`` also gives texts that fit, as one piece.
    Null texts and texts without a token have no pieces, nor have rows of a null item; a row
    that stands twice gives its pieces twice. Sizes are counted in the JVM, so that only oversized
    texts reach Python.
    """
    if not 0 <= overlap < least <= most:
        raise ValueError("0 <= overlap < least <= most is needed")
    if reach and (reach < least - 1 or most - overlap < 2 * least):
        raise ValueError("landmarks need a reach of the minimum size less one, and room for two such pieces between overlaps")
    kind = df.schema[item].dataType.simpleString()
    rows = df.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL")
    rows = rows.where(n_tokens(F.col("text")) > (most if only_oversized else 0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, number, spans = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = pieces_of(tokens_of(t), least, most, overlap, reach)
                who += [i] * len(own)
                number += range(1, len(own) + 1)
                spans += own
            if who:
                ends = np.array(spans, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(number, pa.int32()), pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=[item, "piece_no", "first_token", "last_token"])

    return rows.mapInArrow(cut, f"`{item}` {kind}, piece_no int, first_token int, last_token int")
