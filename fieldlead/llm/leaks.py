"""Evaluation texts inside training text, found by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Container, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldlead.llm.words import atoms
from fieldlead.llm.shipping import ship_package

#: Words that a tile must have at least.
MIN_TILE = 12
#: Items are taken in blocks of at most this many words (or one item): what is broadcast has this bound.
BLOCK_WORDS = 500_000
#: A worker keeps this many blocks in memory; beyond, each is read again from the local copy for every chunk of texts.
RESIDENT_BLOCKS = 8
_CHUNK_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial (Karp-Rabin) hash of every window of ``size`` ids."""
    count = len(ids) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = out * _BASE + ids[i : i + count].astype(np.uint64)
    return out


def tiles(text: np.ndarray, item: np.ndarray, at_text: np.ndarray, at_item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id sequences from seeds: (place in text, place in item, length).

    The longest of the ``matches`` is marked first (ties: the earlier place in the item, then in the text);
    what the marks leave of the others is cut, and dropped below ``least``. No place is covered twice on
    either side.
    """
    used_text, used_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    out = []
    heap = [(-n, j, i) for i, j, n in matches(text, item, at_text, at_item, least)]
    heapq.heapify(heap)
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = ~(used_text[i : i + n] | used_item[j : j + n])
        if free.all():
            used_text[i : i + n] = True
            used_item[j : j + n] = True
            out.append((i, j, n))
            continue
        for x, y, m in _runs(free, i, j, least):
            heapq.heappush(heap, (-m, y, x))
    return out


def matches(text: np.ndarray, item: np.ndarray, at_text: np.ndarray, at_item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal runs of equal ids from seeds: (place in text, place in item, length).

    Seeds are pairs of places whose ``least`` ids have one hash. Seeds that follow each other on a
    diagonal are one match; a match is cut to the ids that are really equal.
    """
    if not len(at_text):
        return []
    order = np.lexsort((at_text, at_text - at_item))
    a, b = at_text[order], at_item[order]
    start = np.r_[True, (np.diff(a) != 1) | (np.diff(b) != 1)]
    heads = np.flatnonzero(start)
    sizes = np.diff(np.r_[heads, len(a)])
    queue: list[tuple[int, int, int]] = []
    for h, n in zip(heads.tolist(), sizes.tolist()):
        i, j, length = int(a[h]), int(b[h]), n + least - 1
        queue += _runs(text[i : i + length] == item[j : j + length], i, j, least)
    return queue


def _runs(good: np.ndarray, i: int, j: int, least: int) -> list[tuple[int, int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, good.view(np.int8), 0]))
    return [(i + int(s), j + int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2]) if e - s >= least]


def _common_steps(a: Sequence[str], ties_a: Container[int], i: int, b: Sequence[str], ties_b: Container[int], j: int, way: int) -> tuple[list[int], list[int]]:
    """Where words begin on both sides, from the boundary before (i, j) on (``way`` 1) or back from it (-1); both lists start with i and j.

    A step is the shortest pair of equal pieces, a piece being an atom or atoms tied at line ends: there
    is at most one, for pieces of different lengths differ. So the finest reading that both sides allow is
    found without trying readings.
    """
    at_a, at_b = [i], [j]
    while True:
        p, q = (i, j) if way > 0 else (i - 1, j - 1)
        if not (0 <= p < len(a) and 0 <= q < len(b)):
            return at_a, at_b
        x, y = a[p], b[q]
        while x != y:
            if len(x) < len(y) and (p if way > 0 else p - 1) in ties_a:
                p += way
                x = x + a[p] if way > 0 else a[p] + x
                fits = y.startswith(x) if way > 0 else y.endswith(x)
            elif len(y) < len(x) and (q if way > 0 else q - 1) in ties_b:
                q += way
                y = y + b[q] if way > 0 else b[q] + y
                fits = x.startswith(y) if way > 0 else x.endswith(y)
            else:
                return at_a, at_b
            if not fits:
                return at_a, at_b
        i, j = (p + 1, q + 1) if way > 0 else (p, q)
        at_a.append(i)
        at_b.append(j)


def stepped_tiles(matches: list[tuple[np.ndarray, np.ndarray]], text: int, item: int, least: int) -> list[tuple[int, int]]:
    """Greedy string tiling of matches given by their word boundaries on both sides: (words, atoms of the item) of each tile."""
    used_text, used_item = np.zeros(text, bool), np.zeros(item, bool)
    heap = [(1 - len(a), int(b[0]), int(a[0]), n) for n, (a, b) in enumerate(matches)]
    pool = list(matches)
    heapq.heapify(heap)
    out = []
    while heap:
        *_, n = heapq.heappop(heap)
        a, b = pool[n]
        taken_text, taken_item = np.cumsum(np.r_[0, used_text]), np.cumsum(np.r_[0, used_item])
        free = (taken_text[a[1:]] == taken_text[a[:-1]]) & (taken_item[b[1:]] == taken_item[b[:-1]])
        if free.all():
            used_text[a[0] : a[-1]] = True
            used_item[b[0] : b[-1]] = True
            out.append((len(a) - 1, int(b[-1] - b[0])))
            continue
        for x, _, m in _runs(free, 0, 0, least):
            part = a[x : x + m + 1], b[x : x + m + 1]
            heapq.heappush(heap, (-m, int(part[1][0]), int(part[0][0]), len(pool)))
            pool.append(part)
    return out


class ItemBlock:
    """A bounded number of items as id sequences over their own vocabulary, with an index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        parsed = [atoms(t or "") for _, t in rows]
        self.vocabulary: dict[str, int] = {}
        for t, _ in parsed:
            for w in t:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids = [r[0] for r in rows]
        self.ties = [frozenset(x) for _, x in parsed]
        self.items = [np.fromiter((self.vocabulary[w] for w in t), np.int64, len(t)) for t, _ in parsed]
        hashes, owner, place = [], [], []
        for n, item in enumerate(self.items):
            h = gram_hashes(item, least)
            hashes.append(h)
            owner.append(np.full(len(h), n))
            place.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.seeds = h[order]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.least = least
        self.broken = any(self.ties)
        self._starts: tuple | None = None

    def _index(self) -> tuple[int, dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]], list[list[str]]]:
        """(L, places by the L letters that follow, the same for places just before a tie of the item, the items as atoms).

        No run of ``least`` words of an item has fewer than L letters in whatever reading, so a run begins
        with equal L letters on both sides.
        """
        if self._starts is None:
            names = list(self.vocabulary)
            spelled = [[names[i - 1] for i in item] for item in self.items]
            sizes = [np.cumsum([0, *map(len, t)]) for t in spelled]
            letters = min((int((s[self.least :] - s[: -self.least]).min()) for s in sizes if len(s) > self.least), default=0)
            everywhere: dict[str, list[tuple[int, int]]] = {}
            tied: dict[str, list[tuple[int, int]]] = {}
            for n, (t, s) in enumerate(zip(spelled, sizes)):
                whole, near = "".join(t), _before(self.ties[n], self.least)
                for j in range(len(t)):
                    key = whole[s[j] : s[j] + letters]
                    if len(key) == letters:
                        everywhere.setdefault(key, []).append((n, j))
                        if j in near:
                            tied.setdefault(key, []).append((n, j))
            self._starts = letters, everywhere, tied, spelled
        return self._starts

    def _tied_matches(self, text: list[str], ties: list[int]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """Matches in which a word is broken at a line end on either side, by item."""
        letters, everywhere, tied, spelled = self._index()
        if not letters:
            return {}
        whole, size = "".join(text), np.cumsum([0, *map(len, text)]).tolist()
        near, own = _before(ties, self.least), frozenset(ties)
        out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        seen: set[tuple[int, int, int]] = set()
        for i in range(len(text)) if tied else sorted(near):
            table = everywhere if i in near else tied
            for n, j in table.get(whole[size[i] : size[i] + letters], ()):
                if (n, i, j) in seen:
                    continue
                a, b = _common_steps(text, own, i, spelled[n], self.ties[n], j, 1)
                before_a, before_b = _common_steps(text, own, i, spelled[n], self.ties[n], j, -1)
                a, b = np.array(before_a[:0:-1] + a), np.array(before_b[:0:-1] + b)
                seen.update((n, x, y) for x, y in zip(a.tolist(), b.tolist()))
                if len(a) > self.least and (a[-1] - a[0] > len(a) - 1 or b[-1] - b[0] > len(a) - 1):
                    out.setdefault(n, []).append((a, b))
        return out

    def scan(self, texts: list[tuple[list[str], list[int]]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(number of the text, item id, tiles, longest tile, words covered, words of the item) of every pair that shares a tile.

        ``texts`` are atoms with their ties.
        """
        if not len(self.seeds):
            return
        get = self.vocabulary.get
        parts = [np.array([get(w, 0) for w in t] + [0], np.int64) for t, _ in texts]
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        flat = np.concatenate(parts)
        h = gram_hashes(flat, self.least)
        unknown = np.cumsum(np.r_[0, flat == 0])
        whole = unknown[self.least :] == unknown[: -self.least]
        low = np.searchsorted(self.seeds, h[whole], "left")
        high = np.searchsorted(self.seeds, h[whole], "right")
        at = np.flatnonzero(whole)
        hit = high > low
        at, low, high = at[hit], low[hit], high[hit]
        document = np.searchsorted(ends, at, "right")
        tied = {d: m for d, (t, ties) in enumerate(texts) if (ties or self.broken) and (m := self._tied_matches(t, ties))}
        for d in sorted({*np.unique(document).tolist(), *tied}):
            mine = document == d
            counts = high[mine] - low[mine]
            seed = np.repeat(low[mine], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            where = np.repeat(at[mine], counts) - starts[d]
            owner, place = self.owner[seed], self.place[seed]
            steps = tied.get(d, {})
            for item in sorted({*np.unique(owner).tolist(), *steps}):
                own = owner == item
                found = [(n, n) for _, _, n in tiles(parts[d], self.items[item], where[own], place[own], self.least)] if item not in steps else []
                if item in steps:
                    plain = [(np.arange(i, i + n + 1), np.arange(j, j + n + 1)) for i, j, n in matches(parts[d], self.items[item], where[own], place[own], self.least)]
                    found = stepped_tiles(plain + steps[item], len(parts[d]), len(self.items[item]), self.least)
                if found:
                    yield int(d), self.ids[item], len(found), max(n for n, _ in found), sum(m for _, m in found), len(self.items[item])


def _before(ties: Iterable[int], least: int) -> set[int]:
    """Places from which a run of ``least`` words may meet a tie."""
    return {i for t in ties for i in range(max(0, t - least + 1), t + 1)}


_RESULT = "tiles int, longest_tile int, covered_words int, item_words int"


def shared_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_tile: int = MIN_TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that share at least one tile of ``min_tile`` words with an item; one row per document row and item.

    Columns: doc_id, item_id, tiles, longest_tile, covered_words, item_words. Passages that stand in
    another order in the document are several tiles and add up in ``covered_words``. The longest common
    run of words is always the first tile.

    Items are read in blocks of at most ``block_words`` words, which are broadcast; documents are never
    shuffled, each is read and cut into words once and meets every block, so neither a hot document nor a
    phrase that is common in the corpus can unbalance a task. The number of blocks follows from a count of
    the item table: any number of items is covered, and the blocks don't show in the result. Null and
    blank texts and items share nothing; repeated documents give one row each; repeated rows of the item
    table count once. Texts are compared as ``atoms`` reads them: a hyphen at a line end, in either text,
    may or may not split its word, whichever lets the two agree; ``longest_tile`` counts words of the
    finest reading that both allow, ``covered_words`` and ``item_words`` the item's own pieces.
    """
    spark = docs.sparkSession
    ship_package(spark)
    size = F.coalesce(F.size(F.split(F.col(f"`{item_text}`"), r"[^\p{L}\p{N}]+")), F.lit(0))
    total = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-int(total[0]) // max(1, block_words // 2)))
    picked = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null").distinct()
    source = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).where("t is not null")
    schema = f"{doc_id} {dict(docs.dtypes)[doc_id]}, {item_id} {dict(items.dtypes)[item_id]}, {_RESULT}"
    names = [doc_id, item_id, *[c.split()[0] for c in _RESULT.split(", ")]]
    shared = []
    for b in range(blocks):
        own = picked if blocks == 1 else picked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        shared.append(spark.sparkContext.broadcast(ItemBlock([(r.i, r.t) for r in own.orderBy("i", "t").collect()], min_tile)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["t"].str.len().to_numpy()
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(sizes) // _CHUNK_CHARS)) + 1):
                if not len(part):
                    continue
                texts = [atoms(t) for t in pdf["t"].iloc[part]]
                for block in shared:
                    rows = [(pdf["d"].iloc[part[n]], *rest) for n, *rest in block.value.scan(texts)]
                    if len(shared) > RESIDENT_BLOCKS:
                        vars(block).pop("_value", None)
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    return source.mapInPandas(scan, schema)


def leaks(passages: DataFrame, min_words: int = MIN_TILE, min_coverage: float = 0.5) -> DataFrame:
    """Pairs whose tiles cover enough of the item: a run of ``min_words`` words, or ``min_coverage`` of the item in pieces of any order.

    The coverage is tested on all tiles together, which is what catches reordered passages; a run of
    ``min_words`` words counts whatever its share of a long item is.
    """
    coverage = F.col("covered_words") / F.col("item_words")
    return passages.withColumn("coverage", coverage).where((F.col("longest_tile") >= min_words) | (F.col("coverage") >= min_coverage))
