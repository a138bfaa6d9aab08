"""Benchmark passages in documents by greedy string tiling.

Windows of ``MIN_MATCH`` words shared with a benchmark item are the seeds: rolling
Karp-Rabin hashes of the documents' words are looked up in the items' hashes. For each
document and item with a seed, tiles are laid greedily: the longest match of words that
no tile covers yet comes first, again and again, down to ``MIN_MATCH`` words. Tiles may
come in any order, so a reordered passage is covered as well. The document is
contaminated when its tiles cover ``COVERAGE`` of the item's words.

A round of tiling finds the longest common length by halving, with Karp-Rabin hashes of
all free windows of a length, so that it takes the words of both sides and not their pairs.
Windows that many items share are no seeds as long as they alone can't reach the coverage.

Items are broadcast in blocks of bounded size; the documents pass once for each block,
without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER, RangeHash, chunks, mix, powers, small_batches, text_only, utf8, words

MIN_MATCH, COVERAGE = 5, 0.6
#: Words of items that are broadcast at once.
BLOCK_WORDS = 2_000_000
#: Items that share a window from which it may be left out of the seeds.
COMMON = 16
#: Items that seeds of a document name at once.
SLICE = 1 << 18

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK = pow(int(_STEP), -1, 1 << 64)
_SCHEMA = "doc_id bigint, item_id bigint, n_tiles int, n_covered int, n_words int, coverage double"


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of every ``n`` words in a row."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * _STEP + h[k : k + len(out)]
    return mix(out)


class Items:
    """Some items' words and windows, and their seeds sorted by hash."""

    def __init__(self, ids: list, texts: list[str], min_match: int, coverage: float = COVERAGE):
        self.ids, self.min_match = ids, min_match
        column = pa.array(texts, pa.string())
        data, offsets = utf8(column)
        data = LOWER[data]
        start, end, before = words(data, offsets)
        h = RangeHash(data)(start, end)
        self.words = [h[a:b] for a, b in zip(before, before[1:], strict=False)]
        #: An item shorter than a window is one window of its own length.
        self.sizes = sorted({min(min_match, len(w)) for w in self.words if len(w)})
        self.windows = [windows(w, min(min_match, len(w))) if len(w) else w for w in self.words]
        self.seeds = {}
        for n in self.sizes:
            mine = [k for k, w in enumerate(self.words) if len(w) and min(min_match, len(w)) == n]
            own = [np.unique(self.windows[k]) for k in mine]
            key, cuts = np.concatenate(own), np.cumsum([0, *map(len, own)])
            item, keep = np.repeat(mine, np.diff(cuts)), np.ones(len(key), bool)
            every, many = np.unique(key, return_counts=True)
            common = many[np.searchsorted(every, key)]
            for k, a, b in zip(mine, cuts, cuts[1:], strict=False):
                if common[a:b].max() > COMMON:
                    keep[a:b] = ~self._idle(k, key[a:b], common[a:b], n, coverage)
            key, item = key[keep], item[keep]
            order = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.seeds[n] = key[order], item[order], sieve

    def _idle(self, k: int, keys: np.ndarray, common: np.ndarray, n: int, coverage: float) -> np.ndarray:
        """Which windows are left out: the most common ones, as many as can't reach the coverage of their item alone."""
        out, touched = np.zeros(len(keys), bool), np.zeros(len(self.words[k]), bool)
        for i in np.argsort(-common, kind="stable"):
            if common[i] <= COMMON:
                break
            more = touched.copy()
            for at in np.flatnonzero(self.windows[k] == keys[i]):
                more[at : at + n] = True
            if more.sum() >= coverage * len(more):
                break
            out[i], touched = True, more
        return out

    def candidates(self, found: np.ndarray, n: int) -> np.ndarray:
        """Items that have one of the found hashes (distinct ones) among their seeds; expanded by slices."""
        key, item, _ = self.seeds[n]
        lo, hi = np.searchsorted(key, found, "left"), np.searchsorted(key, found, "right")
        total, out = np.cumsum(hi - lo), np.zeros(0, np.int64)
        a = 0
        while a < len(found):
            done = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, done + SLICE, "right")))
            size = (hi - lo)[a:b]
            at = np.repeat(lo[a:b] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out = np.union1d(out, item[at])
            a = b
        return out


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[int, int]:
    """(tiles, covered words) of an item's words (hashes) by greedy string tiling with a document's.

    The longest match of free words comes first; of equal ones the earliest in the item,
    then in the document. Matches of one length are all marked in one round.
    """
    x, y = _Rolling(item), _Rolling(doc)
    tiles = covered = 0
    most = min(len(item), len(doc))
    while True:
        length = _longest(x, y, least, most)
        if length < least:
            return tiles, covered
        most = length
        a, h = x.free(length)
        b, g = y.free(length)
        both = np.intersect1d(h, g)
        keep = np.isin(g, both)
        places: dict[int, list[int]] = {}
        for j, k in zip(b[keep][::-1].tolist(), g[keep][::-1].tolist(), strict=True):
            places.setdefault(k, []).append(j)
        keep = np.isin(h, both)
        end = 0
        for i, k in zip(a[keep].tolist(), h[keep].tolist(), strict=True):
            if i < end:
                continue
            at = places[k]
            while at and y.used[at[-1] : at[-1] + length].any():
                at.pop()
            if at:
                j = at.pop()
                x.used[i : i + length] = y.used[j : j + length] = True
                end, tiles, covered = i + length, tiles + 1, covered + length


class _Rolling:
    """Words of one side, which of them tiles cover, and Karp-Rabin hashes of any number of words in a row."""

    def __init__(self, h: np.ndarray):
        self.used = np.zeros(len(h), bool)
        self.down = powers(_BACK, len(h) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(int(_STEP), len(h))[: len(h)])])

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of ``n`` words without a covered one."""
        total = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(total[n:] == total[: len(total) - n])
        return at, (self.prefix[at + n] - self.prefix[at]) * self.down[at]


def _longest(x: _Rolling, y: _Rolling, least: int, most: int) -> int:
    """The length of the longest common run of free words, from ``least`` on; less if there is none."""
    low = least - 1
    while low < most:
        n = (low + most + 1) // 2 if low >= least else least
        if len(np.intersect1d(x.free(n)[1], y.free(n)[1])):
            low = n
        else:
            most = n - 1
    return low


def _reach(at: np.ndarray, n: int) -> int:
    """Item words that windows at some places touch: no tiling covers more."""
    return int(np.minimum(np.diff(at), n).sum()) + n if len(at) else 0


def _met(h: np.ndarray, x: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """A document's words in windows that the item has too; words of separate runs are kept apart by one that matches nothing."""
    hit = np.flatnonzero(np.isin(x, own))
    inside = np.zeros(len(h) + 1, np.int64)
    np.add.at(inside, hit, 1)
    np.add.at(inside, hit + n, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(h[at], gaps, np.arange(len(gaps), dtype=np.uint64) * _STEP + np.uint64(1))


def _leaks(items: Items, text: pa.Array, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item, tiles, covered, words) of every contaminated row of a batch."""
    data, offsets = utf8(text)
    data = LOWER[data]
    start, end, before = words(data, offsets)
    h = RangeHash(data)(start, end)
    row = np.repeat(np.arange(len(text)), np.diff(before))
    out = []
    for n in items.sizes:
        key, _, sieve = items.seeds[n]
        x = windows(h, n)
        some = np.flatnonzero(sieve[(x & np.uint64((1 << 20) - 1)).astype(np.int64)])
        some = some[row[some] == row[some + n - 1]]
        some = some[np.isin(x[some], key)]
        for r in np.unique(row[some]):
            own, mine = h[before[r] : before[r + 1]], x[before[r] : before[r + 1] - n + 1]
            has = np.unique(mine)
            for k in items.candidates(np.unique(x[some[row[some] == r]]), n).tolist():
                size, theirs = len(items.words[k]), items.windows[k]
                hit = np.flatnonzero(has[np.minimum(np.searchsorted(has, theirs), len(has) - 1)] == theirs)
                if _reach(hit, n) < coverage * size:
                    continue
                tiles, covered = tile(items.words[k], _met(own, mine, theirs, n), n)
                if covered >= coverage * size:
                    out.append((int(r), k, tiles, covered, size))
    return sorted(out)


def item_blocks(benchmark: DataFrame, min_match: int, coverage: float, block_words: int):
    """Items in blocks of at most ``block_words`` words (one item at least)."""
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        own = len(r.text) // 2 + 1
        if ids and size + own > block_words:
            yield Items(ids, texts, min_match, coverage)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += own
    if ids:
        yield Items(ids, texts, min_match, coverage)


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item whose tiles reach the coverage; clean documents have none.

    Null or empty texts and items without words match nothing, nor do items whose ``item_id``
    is null; repeated rows repeat the result; other columns are not used. Items of fewer
    than ``min_match`` words match as a whole.
    """
    spark = docs.sparkSession
    out = None
    for items in item_blocks(benchmark, min_match, coverage, block_words):
        shared = spark.sparkContext.broadcast(items)

        def scan(batches, shared=shared):
            items = shared.value
            for batch in chunks(batches):
                found = _leaks(items, batch.column(1), coverage)
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                cols = [pa.array([f[k] for f in found], pa.int32()) for k in (2, 3, 4)]
                share = pa.array([f[3] / f[4] for f in found], pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([items.ids[f[1]] for f in found], pa.int64()), *cols, share],
                    names=["doc_id", "item_id", "n_tiles", "n_covered", "n_words", "coverage"],
                )

        part = text_only(docs, "doc_id").mapInArrow(scan, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _SCHEMA) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without the contaminated ones; rows of null and empty texts stay.

    Each row is judged by itself, repeated ones alike; an empty table stays empty.
    """
    where = docs.columns.index("text")
    small_batches(docs.sparkSession)
    for items in item_blocks(benchmark, min_match, coverage, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def scan(batches, shared=shared):
            import pyarrow.compute as pc

            for batch in chunks(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in _leaks(shared.value, pc.fill_null(batch.column(where), ""), coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
