"""Segments of a text (unwrapped lines) and their statistics."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

#: Statistics of a segment; the last five are averages over the neighbourhood in the document.
NAMES = (
    "log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "common_share", "sentence_ends", "separators", "commas", "log_run", "distinct_share", "letter_ratio", "has_marker",
    "sentence_affinity", "near_common", "near_ends", "near_run", "near_marker", "near_affinity",
)
_NEAR = (4, 5, 8, 11, 12)
#: A frequent word makes up this share of all words at least, so there are at most its inverse.
FREQUENT = 1e-4
#: Log-odds of a segment without words.
_NO_WORDS = -3.0
_REACH = 2

_QUOTE = re.compile(r"^\s*>+ ?")
_MARKER = re.compile(r"(?:[-*•+–·]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)])\s")
_INLINE = (("/", re.compile(r"\s/\s")), ("|", re.compile(r"\s\|\s")), (";", re.compile(r";\s")), (",", re.compile(r",\s")))
_STOP = re.compile(r"[^\W\d_][.!?](?=\s|$)")
_PLAIN = ".,;:'\"()-?!"
_LETTER, _DIGIT, _SPACE, _SYMBOL, _STOP_SIGN, _CUT_SIGN, _BAR = 1, 2, 4, 8, 16, 32, 64
_PRIME = np.uint64(0x100000001B3)
_BLOCK = 0x10000


def _class_of(c: str) -> int:
    """The classes of a character as bits."""
    signs = (_STOP_SIGN if c in ".!?" else 0) | (_CUT_SIGN if c in ".!?:;,|\t" else 0) | (_BAR if c in ";|\t" else 0)
    if c.isspace():
        return _SPACE | signs
    if c.isalnum():
        return _DIGIT if c.isdecimal() else _LETTER
    return signs if c in _PLAIN else _SYMBOL | signs


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of the code points of the basic plane."""
    chars = [chr(i) for i in range(_BLOCK)]
    lower = [c.lower() for c in chars]
    return np.array([_class_of(c) for c in chars], np.uint8), np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(lower)], np.uint64)


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _PRIME)], dtype=np.uint64)


def _word_hash(word: str) -> int:
    codes = np.array([ord(c) for c in word], np.uint64)
    return int((codes * _powers(1 << 12)[np.minimum(np.arange(len(codes)), (1 << 12) - 1)]).sum(dtype=np.uint64))


def _unwrapped(block: list[str]) -> list[str]:
    """The lines of a block, joined to one if the block is hard-wrapped text.

    A block is wrapped if (nearly) every line is full: the first word of the next line would not have
    fitted within the longest line.
    """
    lines = [_QUOTE.sub("", x).rstrip() for x in block]
    width = max(map(len, lines))
    if len(lines) < 2 or width < (30 if len(lines) > 2 else 40):
        return lines
    full = sum(len(a) + 1 + len((b.split(None, 1) or [""])[0]) > width for a, b in zip(lines, lines[1:]))
    if full < 0.9 * (len(lines) - 1):
        return lines
    return ["".join(x[:-1] if x.endswith("-") else x + " " for x in lines).rstrip()]


def _itemized(line: str) -> list[str]:
    """The entries of a line that enumerates in running text, else the line itself.

    A line enumerates if one separator cuts it into five entries or more and there is at most one
    sentence end for six cuts. Table rows framed by bars stay whole.
    """
    if len(line) < 40 or line[0] in "|+":
        return [line]
    for sign, separator in _INLINE:
        if line.count(sign) < 4:
            continue
        cuts = len(separator.findall(line))
        if cuts >= 4 and 6 * len(_STOP.findall(line)) <= cuts:
            return separator.split(line)
    return [line]


def segments(text: str) -> list[str]:
    """The text's lines without blank ones; hard-wrapped paragraphs are one segment each, entries of an inline list one each."""
    out: list[str] = []
    block: list[str] = []
    for line in text.split("\n"):
        if line.strip():
            block.append(line)
        elif block:
            out += _unwrapped(block)
            block = []
    if block:
        out += _unwrapped(block)
    return [z for z in (y.strip() for x in out if x.strip() for y in _itemized(x.strip())) if z]


def word_hashes(words: Iterable[str]) -> np.ndarray:
    """Sorted hashes of words, in the form that ``statistics`` looks them up in."""
    return np.unique(np.array([_word_hash(w) for w in words], np.uint64))


@dataclass(frozen=True)
class Lexicon:
    """Words by hash: common ones (sorted), frequent ones (sorted) with the log-odds of standing in a segment that ends sentences."""

    common: np.ndarray
    frequent: np.ndarray
    odds: np.ndarray

    @classmethod
    def of(cls, common: Iterable[str], counts: Iterable[tuple[int, int, int]] = ()) -> Lexicon:
        """From common words and (hash, places, places in segments with a sentence end) of the frequent words."""
        rows = sorted((h & 0xFFFFFFFFFFFFFFFF, (inside + 0.5) / (n + 1.0)) for h, n, inside in counts)
        share = np.array([p for _, p in rows])
        return cls(word_hashes(common), np.array([h for h, _ in rows], np.uint64), np.log(share / (1 - share)))


class _Lines:
    """Lines as one array of code points, their classes and their words."""

    def __init__(self, lines: Sequence[str]):
        self.n = len(lines)
        self.text = text = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le"), np.uint32)
        self.sizes = np.array([len(x) for x in lines])
        self.start = np.cumsum(np.r_[0, self.sizes[:-1] + 1])
        classes, lower = _tables()
        basic = np.minimum(text, _BLOCK - 1)
        self.kind, self.low = classes[basic], lower[basic]
        for code in np.unique(text[text >= _BLOCK]):
            self.kind[text == code] = _class_of(chr(code))
            self.low[text == code] = code
        self.space, self.letter = self.has(_SPACE), self.has(_LETTER)
        self.before, self.after = np.r_[True, self.space[:-1]], np.r_[self.space[1:], True]
        self.stop = self.has(_STOP_SIGN) & self.after & np.r_[False, self.letter[:-1]]

    def has(self, bit: int) -> np.ndarray:
        return (self.kind & bit) > 0

    def per_line(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, self.start, dtype=np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, line) of every run of letters, compared by a 64-bit hash of its lower case."""
        letter = self.letter
        begin = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
        if not len(begin):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        end = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
        at = np.flatnonzero(letter)
        place = np.minimum(at - np.repeat(begin, end - begin), (1 << 12) - 1)
        hashes = np.add.reduceat(self.low[at] * _powers(1 << 12)[place], np.cumsum(np.r_[0, (end - begin)[:-1]]), dtype=np.uint64)
        return hashes, np.searchsorted(self.start, begin, "right") - 1


def word_counts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, places, places in segments with a sentence end) of every word of the texts."""
    lines = [line for t in texts for line in segments(t)]
    if not lines:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = _Lines(lines)
    hashes, line = view.words()
    found, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    return found, n, np.bincount(at, view.per_line(view.stop)[line] > 0, len(found)).astype(np.int64)


def _own(lines: Sequence[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(characters, statistics but those of the neighbourhood) of lines without blanks around them."""
    view = _Lines(lines)
    text, space, before, after, start, sizes = view.text, view.space, view.before, view.after, view.start, view.sizes
    has, per_line = view.has, view.per_line
    wide = space & after & ~before & (text != 10)
    slash = (text == ord("/")) & before & after
    cut = has(_CUT_SIGN) | slash | wide
    words = np.maximum(1, per_line(~space & before))
    # words between cuts
    gap = space | cut
    head = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    piece = np.cumsum(cut | (text == 10))[head]
    owner = np.searchsorted(start, head, "right") - 1
    first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, np.int64)
    length = np.diff(np.r_[first, len(piece)])
    square = np.bincount(owner[first], length * length, view.n)
    plain = np.bincount(owner[first], length, view.n)
    hashes, line = view.words()
    found = np.bincount(line, minlength=view.n).astype(float)
    listed = np.bincount(line, np.isin(hashes, lexicon.common), view.n)
    odds = np.zeros(len(hashes))
    if len(lexicon.frequent):
        at = np.minimum(np.searchsorted(lexicon.frequent, hashes), len(lexicon.frequent) - 1)
        known = lexicon.frequent[at] == hashes
        odds = np.where(known, lexicon.odds[at], 0.0)
    order = np.lexsort((hashes, line))
    fresh = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])] if len(order) else np.zeros(0, bool)
    distinct = np.bincount(line[order], fresh, view.n)
    m = np.maximum(1, found)
    chars = np.maximum(1, sizes).astype(float)
    return chars, np.column_stack([
        np.log(words),
        np.minimum(20.0, per_line(~space) / words),
        per_line(has(_SYMBOL)) / chars,
        per_line(has(_DIGIT)) / chars,
        listed / m,
        np.minimum(0.3, per_line(view.stop) / words),
        np.minimum(1.0, per_line(has(_BAR) | slash | wide) / words),
        np.minimum(1.0, per_line(text == ord(",")) / words),
        np.log1p(square / np.maximum(1, plain)),
        distinct / m,
        per_line(view.letter) / chars,
        [1.0 if _MARKER.match(x) else 0.0 for x in lines],
        np.where(found > 0, np.bincount(line, odds, view.n) / m, _NO_WORDS),
    ])


def statistics(texts: Sequence[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, characters, statistics) of every segment of the texts."""
    split = [segments(t) for t in texts]
    who = np.repeat(np.arange(len(texts)), [len(x) for x in split])
    if not len(who):
        return who, np.zeros(0), np.zeros((0, len(NAMES)))
    chars, own = _own([line for x in split for line in x], lexicon)
    total, weight = np.zeros((len(who), len(_NEAR))), np.zeros(len(who))
    place = np.arange(len(who))
    for step in range(-_REACH, _REACH + 1):
        other = np.clip(place + step, 0, len(who) - 1)
        inside = (other == place + step) & (who[other] == who)
        w = np.where(inside, chars[other], 0.0)
        total += own[other][:, _NEAR] * w[:, None]
        weight += w
    return who, chars, np.hstack([own, total / weight[:, None]])
