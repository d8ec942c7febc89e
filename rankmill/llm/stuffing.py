"""Problem 9: keyword-stuffed pages, link lists and product tags.

Two measurements per page are combined, neither of which knows any language. Clause structure:
words in a phrase of some length that a sentence end closes, unless it is as short as a
keyword and says what other phrases of the page say too. Repetition: the page's words go into a suffix
array, which holds the repeated maximal substrings that a suffix automaton does, and the characters
are marked that those of two words or more cover which occur AGAIN times; a single word counts, from
its second time on, where it stands between marks. Few words that are shuffled, without a mark, are told by
their share of the run. A run of words without clause structure counts as stuffing if repeated substrings, links and
tags cover enough of its characters; a page is stuffed if more than half of its words count.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.operators.storage import spread

#: A clause has this many words or more (nine Han or kana characters count as five words), and isn't longer than a sentence can be.
LEAST_WORDS = 4
SENTENCE = 60
#: Nor has it more links than this part of its other words.
LINKED = 0.2
#: A closed phrase of up to so many words can be a keyword; it is one if other phrases share this part of its characters, in strings of SHARED words or more.
KEYWORD = 7
SHARED = 3
SAID_AGAIN = 0.5
#: A string of two words or more must stand so often to count as repeated.
AGAIN = 3
#: Words between two marks that are taken as an item of a list; there, a single word counts as repeated.
ITEM = 3
#: A run without clause structure is stuffing if repeats, links and tags cover this share of its characters.
COVERED = 0.4
#: So is one of which words that stand in it AGAIN times, and make up this part of its words each, cover CROWDED of the characters.
OFTEN = 0.01
CROWDED = 0.6
#: More than this share of the page's words.
STUFFED = 0.5

_link = re.compile(r"<a\s[^<>]*>[^<>]*(?:</a>)?|(?:https?://|www\.)[^\s<>]+|#\w+", re.IGNORECASE)
_markup = re.compile(r"<(?!a\s)[a-zA-Z/!?][^<>]*>|&(?:#x?\w{1,6}|\w{2,8});")
_character = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_symbol = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\u3040-\u30ff\u3400-\u9fff]+")


#: Bits of a code point's kind.
WORD, LOWER, CASELESS, SPACE, HAN, STOP, FULL_STOP, CLOSING, COMMA, FULL_COMMA, COLON, MARK, LINE = (1 << i for i in range(13))
#: Code points from here on stand in no word.
BEYOND = 0x32000


@functools.cache
def _kinds() -> np.ndarray:
    """The kinds of each code point: in words (letters and digits), without case, a sentence end before a blank or anywhere, and so on."""
    kinds = np.zeros(BEYOND + 1, dtype=np.uint16)
    for c in map(chr, range(BEYOND)):
        if c.isalnum():
            kinds[ord(c)] = WORD | LOWER * c.islower() | CASELESS * (c.isalpha() and c.lower() == c.upper())
        elif c.isspace():
            kinds[ord(c)] = SPACE
    for bit, chars in ((STOP, ".!?؟।۔"), (FULL_STOP, "。！？"), (CLOSING, "\"')]»”"), (COMMA, ",;:"), (FULL_COMMA, "、，；："), (COLON, ":"), (MARK, "|★»•·/>"), (LINE, "\n\r")):
        kinds[[ord(c) for c in chars]] |= bit
    kinds[0x3040:0x3100] |= HAN
    kinds[0x3400:0xA000] |= HAN
    return kinds


class Pages:
    """Where the words of some pages stand, one page after the other, and what stands between them."""

    def __init__(self, texts: list[str]) -> None:
        parts, spans, at = [], [], 0
        for text in texts:
            own = _markup.sub(lambda m: " " * len(m.group()), text) if "<" in text or "&" in text else text
            low = own.lower()
            if "#" in low or "://" in low or "www." in low or "<a" in low:
                spans += [(at + m.start(), at + m.end()) for m in _link.finditer(own)]
            parts.append(own)
            at += len(own) + 1
        self.clean = clean = "\n".join(parts)
        points = np.minimum(np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), BEYOND)
        kind = np.append(_kinds()[points], np.uint16(SPACE))  # a text ends like a line
        inside = kind[:-1] & WORD > 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.weight = np.ones(len(self.starts))
        han = kind[:-1] & HAN > 0
        if han.any():
            count = np.concatenate([[0], np.cumsum(han)])
            own = count[self.ends] - count[self.starts]
            self.weight = np.where(own > 0, own * 5 / 9 + (own < self.ends - self.starts), 1.0)
        self.begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])[:-1]])
        self.page = np.searchsorted(self.begins, self.starts, side="right") - 1
        self.last = np.append(self.page[1:] != self.page[:-1], True)[: len(self.page)]
        links = np.array(spans, dtype=np.int64).reshape(-1, 2)
        self.in_link = _within(self.starts, links)
        own = np.where(self.in_link, np.searchsorted(links[:, 0], self.starts, side="right"), 0)
        self.link_begins = self.in_link & np.append(True, own[1:] != own[:-1])[: len(own)]
        # What follows each word: a sentence end (closing marks may follow that), a mark of a list outside links, a comma, a line end.
        blank = np.append(kind[1:] & SPACE > 0, True)
        at = np.flatnonzero(kind & STOP)
        after = at + 1
        while len(more := np.flatnonzero(kind[after] & CLOSING)):
            after[more] += 1
        self.stop = self._before(np.concatenate([at[kind[after] & SPACE > 0], np.flatnonzero(kind & FULL_STOP)]))
        self.comma = self._before(np.flatnonzero((kind & COMMA > 0) & blank | (kind & FULL_COMMA > 0)))
        self.line = self._before(np.flatnonzero(kind & LINE))
        marks = np.flatnonzero((kind & MARK > 0) & blank | (kind & COLON > 0) & np.append(kind[1:] & COLON > 0, False))
        self.mark = self._before(marks[~_within(marks, links)])
        # A line begins anew with a capital or a digit; where letters have no case, after a line as short as a keyword.
        self.fresh_line = self.line.copy()
        at = np.flatnonzero(self.line[:-1])
        if len(at):
            first = kind[self.starts[at + 1]]
            fresh, no_case = first & LOWER == 0, first & CASELESS > 0
            if no_case.any():
                row = _numbered(self.line)
                fresh &= ~no_case | (np.bincount(row, weights=self.weight)[row[at]] <= KEYWORD)
            self.fresh_line[at] = fresh

    @functools.cached_property
    def words(self) -> list[str]:
        return [self.clean[a:b].lower() for a, b in zip(self.starts.tolist(), self.ends.tolist())]

    def _before(self, places: np.ndarray) -> np.ndarray:
        """Whether one of these places comes after each word, before the next one of its page."""
        out = np.zeros(len(self.starts), dtype=bool)
        if len(places):
            at = np.searchsorted(self.starts, places) - 1
            own = at >= 0
            own[own] = self.page[at[own]] == np.searchsorted(self.begins, places[own], side="right") - 1
            out[at[own]] = True
        return out


def _within(at: np.ndarray, spans: np.ndarray) -> np.ndarray:
    if not len(spans):
        return np.zeros(len(at), dtype=bool)
    k = np.searchsorted(spans[:, 0], at, side="right") - 1
    return (k >= 0) & (at < spans[np.maximum(k, 0), 1])


def _numbered(border: np.ndarray) -> np.ndarray:
    """The number of the part that each word is in; a part ends with a word that has a border after it."""
    return np.cumsum(np.concatenate([[0], border[:-1]])) if len(border) else np.zeros(0, dtype=np.int64)


def closed_phrases(page: Pages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrase of each word, whether it can be a clause (closed by a sentence end, and of LEAST_WORDS to SENTENCE words outside links), and whether it then is as short as a keyword.

    A phrase goes back from its end to the end before, a mark, or the beginning of a line that doesn't go on in lower case.
    """
    phrase = _numbered(page.stop | page.mark | page.fresh_line | page.last)
    n = phrase[-1] + 1
    closed = np.zeros(n, dtype=bool)
    closed[phrase[page.stop]] = True  # a stop ends its phrase
    size = np.bincount(phrase, weights=page.weight * ~page.in_link, minlength=n)
    linked = np.bincount(phrase, weights=page.link_begins, minlength=n) > LINKED * size
    clause = closed & (size >= LEAST_WORDS) & (size <= SENTENCE) & ~linked
    return phrase, clause[phrase], (clause & (size <= KEYWORD))[phrase]


def symbols_of(words: list[str]) -> tuple[list[str], np.ndarray]:
    """What is compared for repetition, and the word of each: the words, those with Han or kana by character, as no space parts them."""
    if not _character.search("".join(words)):
        return words, np.arange(len(words))
    parts = [_symbol.findall(w) for w in words]
    return [x for p in parts for x in p], np.repeat(np.arange(len(words)), [len(p) for p in parts])


def repeated_prefix(codes: np.ndarray, times: int = 2) -> np.ndarray:
    """For each place of a sequence of integers, the length of the longest substring beginning there that occurs ``times`` times or more.

    Suffixes are sorted by doubling; neighbours in that order share the longest prefixes, which are measured from the ranks of each doubling.
    """
    n = len(codes)
    if n < times:
        return np.zeros(n, dtype=np.int64)
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    while ranks[-1].max() < n - 1:
        size = 1 << (len(ranks) - 1)
        now = ranks[-1]
        then = np.full(n, -1, dtype=np.int64)
        then[: max(0, n - size)] = now[size:]
        ranks.append(np.unique(now * (n + 1) + then, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = np.zeros(n - 1, dtype=bool)
        inside = np.maximum(a, b) + (1 << k) <= n
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        shared[same] += 1 << k
        a, b = a + (same << k), b + (same << k)
    common = np.lib.stride_tricks.sliding_window_view(shared, times - 1).min(axis=1)  # what ``times`` neighbours share
    out = np.zeros(n, dtype=np.int64)
    for k in range(times):
        np.maximum.at(out, order[k : k + len(common)], common)
    return out


def covered_by(length: np.ndarray, least: int) -> np.ndarray:
    """The places that substrings of these lengths cover, those of ``least`` or more."""
    n = len(length)
    change = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(length >= least)
    np.add.at(change, at, 1)
    np.add.at(change, at + length[at], -1)
    return np.cumsum(change[:-1]) > 0


def keyword_phrases(page: Pages, phrase: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Whether each word stands in a short closed phrase of which other phrases share SAID_AGAIN of the characters, in strings of SHARED words or more."""
    symbols, of = symbols_of(page.words)
    codes = np.unique(np.array(symbols, dtype=object), return_inverse=True)[1].astype(np.int64)
    part = phrase[of]
    ends = np.append(part[1:] != part[:-1], True)
    # A border of its own after each phrase keeps substrings inside phrases.
    width = 1 + ends.astype(np.int64)
    place = np.cumsum(width) - width
    sequence = -1 - np.arange(int(width.sum()), dtype=np.int64)
    sequence[place] = codes
    covered = covered_by(repeated_prefix(sequence), SHARED)[place]
    size = np.fromiter(map(len, symbols), dtype=np.int64, count=len(symbols))
    n = int(phrase[-1]) + 1
    share = np.bincount(part, weights=size * covered, minlength=n) / np.bincount(part, weights=size, minlength=n)
    return short & (share >= SAID_AGAIN)[phrase]


#: Characters of pages that are looked at together.
TOGETHER = 1 << 19


def stuffed_shares(texts: list[str | None]) -> list[float]:
    """For each page, the share of its words that stand in stuffing. 0 for null, and for texts without a word."""
    out = [0.0] * len(texts)
    some: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            some.append(i)
            size += len(t)
        if some and (size >= TOGETHER or i == len(texts) - 1):
            for k in _possible([texts[j] for j in some]):
                out[some[k]] = stuffed_share(texts[some[k]])
            some, size = [], 0
    return out


def _possible(texts: list[str]) -> list[int]:
    """The pages that can have more than STUFFED of their words in stuffing: that has to lie outside clauses, and only a short closed phrase can turn out to be none."""
    pages = Pages(texts)
    if not len(pages.starts):
        return []
    _, clause, short = closed_phrases(pages)
    outside = np.bincount(pages.page, weights=~clause | short, minlength=len(texts))
    return np.flatnonzero(outside > STUFFED * np.bincount(pages.page, minlength=len(texts))).tolist()


def stuffed_share(text: str | None) -> float:
    """The share of one page; see ``stuffed_shares``."""
    if not text or not _possible([text]):
        return 0.0
    page = Pages([text])
    n = len(page.starts)
    phrase, clause, short = closed_phrases(page)
    if short.any():
        clause = clause & ~keyword_phrases(page, phrase, short)
    bare = ~clause
    if bare.sum() <= STUFFED * n:
        return 0.0  # stuffing lies in bare runs only, so the page can't pass
    symbols, of = symbols_of(page.words)
    codes = np.unique(np.array(symbols, dtype=object), return_inverse=True)[1].astype(np.int64)
    item = _numbered(page.stop | page.mark | page.line | page.comma | page.in_link)
    alone = (np.bincount(item) <= ITEM)[item][of] & ~np.fromiter(map(bool, map(_character.match, symbols)), dtype=bool, count=len(symbols))
    covered = covered_by(repeated_prefix(codes, AGAIN), 2) | (alone & (np.bincount(codes) > 1)[codes]) | page.in_link[of]
    size = np.fromiter(map(len, symbols), dtype=np.int64, count=len(symbols))
    run = np.cumsum(np.concatenate([[0], bare[1:] != bare[:-1]]))
    chars = np.bincount(run[of], weights=size)
    stuffed = np.bincount(run[of], weights=size * covered) >= COVERED * chars
    _, kind, times = np.unique(run[of] * (codes.max() + 1) + codes, return_inverse=True, return_counts=True)
    crowd = times[kind] >= np.maximum(AGAIN, OFTEN * np.bincount(run[of])[run[of]])
    stuffed |= np.bincount(run[of], weights=size * crowd) >= CROWDED * chars
    return float((bare & stuffed[run]).sum() / n)


def stuffed_pages(df: DataFrame, item: str, text: str, more_than: float = STUFFED) -> DataFrame:
    """(item) of the pages of which more than this share of the words is stuffing; map-only.

    Null, empty and blank texts, and texts without a letter or digit, are not stuffed. A row
    that stands twice comes out twice; rows with a null item are left out. A page is judged whole, at any length.
    """
    kind = df.schema[item].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [share > more_than for share in stuffed_shares(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=[item])

    return spread(df.where(F.col(item).isNotNull() & (F.col(text) != "")).select(F.col(item), F.col(text).alias("__text"))).mapInArrow(judge, f"`{item}` {kind}")
