"""Groups of spelling variants: words one inserted, deleted or replaced code point apart, found through FM-indexes.

The words of a corpus are counted first, with map-side combination; from then on only
the vocabulary is handled. Of two words one error apart, one half of either stays whole:
the search scheme matches a word's left half exactly and extends to the right across the
other with one error, or its right half and extends to the left.

An index is over a sorted list of words, each between delimiters; a pattern is an interval
of suffix ranks, extended by one character at a time on either side: to the left in the
index of the words, to the right in that of the reversed words. Either search moves in one
direction, so the two intervals needn't be kept in step. A delimiter's rank is its word's
number, so that the interval of a whole word says which words it is.

The vocabulary is dealt into blocks by halves: a word goes as a query to the block of its
own half, and is indexed in those of the halves that words of its length, one shorter and
one longer would look for. A half that many words share is split by index words and by
queries, so that no block has much more than ``BLOCK_CHARS``.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, ensure_checkpoint_dir, text_only

MIN_CHARS, MIN_COUNT, TYPO, RATIO = 5, 3, 97, 2
#: Characters of a block's rows, of the words that a task counts at once, and queries that are searched together.
BLOCK_CHARS, COUNTED, TOGETHER = 1 << 20, 1 << 18, 1 << 13
#: Shared halves whose table is broadcast; beyond that it is joined.
BROADCAST_ROWS = 100_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: bytes, typo: int = TYPO) -> Counter:
    """A text's words by number, one code point of some deleted as their checksum with the doc_id says (a null one is an empty string)."""
    begun = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall(text.lower().decode())).items():  # of bytes: A-Z only
        h = crc32(run.encode(), begun)
        if h % typo == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """``word, n`` of all words of ``min_chars`` code points that occur ``min_count`` times or more."""

    def flush(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def scan(batches):
        counts: Counter = Counter()
        for batch in chunks(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for word, n in words_of(doc, text, typo).items():
                    if len(word) >= min_chars:
                        counts[word] += n
            if len(counts) >= COUNTED:
                yield flush(counts)
                counts.clear()
        yield flush(counts)

    found = text_only(docs, "doc_id").mapInArrow(scan, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Words:
    """Code points of many words, end to end, as numbers from 1 in the order of an alphabet."""

    def __init__(self, words: list[str], alphabet: np.ndarray, backwards: bool):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.searchsorted(alphabet, points).astype(np.int64) + 1
        if backwards:
            ends = np.repeat(self.start + self.size - 1, self.size)
            self.codes = self.codes[ends - (np.arange(len(points)) - np.repeat(self.start, self.size))]


class FMIndex:
    """Suffix ranks of distinct words in sorted order, each between delimiters."""

    def __init__(self, words: Words, letters: int):
        m, self.letters = len(words.size), letters
        # delimiter k stands before word k, the last one after the last word
        text = np.zeros(len(words.codes) + m + 1, np.int64)
        text[np.arange(len(words.codes)) + np.repeat(np.arange(m), words.size) + 1] = words.codes
        self.m, self.n = m, len(text)
        before = text[self._sorted(text, m) - 1]
        before[0] = letters + 1  # nothing stands before the first delimiter
        self.before = before
        self.keys = np.sort(before * (self.n + 1) + np.arange(self.n))

    @staticmethod
    def _sorted(text: np.ndarray, m: int) -> np.ndarray:
        """Suffix array by doubling; delimiters differ and are in order of place, so suffixes are compared within words only."""
        rank = text + m
        rank[text == 0] = np.arange(m + 1)
        step, n = 1, len(text)
        while True:
            key = rank * (n + m + len(text) + 2)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
            if rank[order[-1]] == n - 1:
                return order
            step *= 2

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a character more before them."""
        at, past = code * (self.n + 1), code > 0  # letters stand after the first delimiter too
        return np.searchsorted(self.keys, at + low) + past, np.searchsorted(self.keys, at + high) + past

    def letters_before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, code) of the letters that stand before some of an interval's suffixes."""
        width, wide = high - low, high - low > self.letters
        few, many = np.flatnonzero(~wide), np.flatnonzero(wide)
        row = np.repeat(few, width[few])
        at = np.arange(len(row)) + np.repeat(low[few] - np.cumsum(width[few]) + width[few], width[few])
        code = np.unique(row * (self.letters + 2) + self.before[at])
        row, code = code // (self.letters + 2), code % (self.letters + 2)
        some = (code > 0) & (code <= self.letters)
        row, code = row[some], code[some]
        if len(many):
            wide_row, wide_code = np.repeat(many, self.letters), np.tile(np.arange(1, self.letters + 1), len(many))
            a, b = self.extend(wide_code, low[wide_row], high[wide_row])
            row, code = np.concatenate([row, wide_row[a < b]]), np.concatenate([code, wide_code[a < b]])
        return row, code

    def search(self, queries: Words, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the words one error away from a query whose last ``exact`` characters they end with."""
        found = []
        for k in range(0, len(exact), TOGETHER):
            q, low, high = self._exact(queries, exact, np.arange(k, min(k + TOGETHER, len(exact))))
            found += self._near(queries, q, queries.size[q] - exact[q] - 1, low, high)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate([q * self.m + w for q, w in found]))  # a word may be reached by several errors
        return pair // self.m, pair % self.m

    def _exact(self, queries: Words, exact: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = np.ones(len(q), np.int64), np.full(len(q), self.m + 1, np.int64)  # delimiters after words
        done = [], [], []
        step = 1
        while len(q):
            low, high = self.extend(queries.codes[queries.start[q] + queries.size[q] - step], low, high)
            alive = low < high
            full = alive & (exact[q] == step)
            for to, x in zip(done, (q, low, high), strict=True):
                to.append(x[full])
            alive &= ~full
            q, low, high = q[alive], low[alive], high[alive]
            step += 1
        return tuple(np.concatenate(x) if x else q for x in done)

    def _near(self, queries: Words, q, j, low, high) -> list[tuple[np.ndarray, np.ndarray]]:
        """Extends to the left; ``j`` is the next character of the query, the second set of states has had its error."""
        found = []
        q1 = j1 = low1 = high1 = np.zeros(0, np.int64)
        while len(q) or len(q1):
            more, none = [(q1, j1, low1, high1)], np.zeros(0, np.int64)
            nxt = (none, none, none, none)
            if len(q):
                row, code = self.letters_before(low, high)
                a, b = self.extend(code, low[row], high[row])
                more.append((q[row], j[row], a, b))  # a letter that the query lacks
                left = j[row] >= 0
                row, code, a, b = row[left], code[left], a[left], b[left]
                same = queries.codes[queries.start[q[row]] + j[row]] == code
                more.append((q[row][~same], j[row][~same] - 1, a[~same], b[~same]))  # another letter
                nxt = (q[row][same], j[row][same] - 1, a[same], b[same])
                lacks = j >= 0
                more.append((q[lacks], j[lacks] - 1, low[lacks], high[lacks]))  # a letter that the word lacks
            # by now those with an error match exactly
            q1, j1, low1, high1 = (np.concatenate(x) for x in zip(*more, strict=True))
            over = j1 < 0
            if over.any():
                a, b = self.extend(np.zeros(over.sum(), np.int64), low1[over], high1[over])
                who = np.repeat(q1[over], b - a)
                found.append((who, np.arange(len(who)) + np.repeat(a - np.cumsum(b - a) + (b - a), b - a)))
            go = ~over
            q1, j1, low1, high1 = q1[go], j1[go], low1[go], high1[go]
            low1, high1 = self.extend(queries.codes[queries.start[q1] + j1], low1, high1)
            alive = low1 < high1
            q1, j1, low1, high1 = q1[alive], j1[alive] - 1, low1[alive], high1[alive]
            q, j, low, high = nxt
        return found


def near_words(words: list[str], queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of the words one error away, which have the query's right half, or its left half, as it is."""
    points = np.frombuffer("".join([*words, *queries]).encode("utf-32-le"), np.uint32)
    alphabet = np.unique(points)
    order = np.array(sorted(range(len(words)), key=(words if right else [w[::-1] for w in words]).__getitem__), np.int64)
    index = FMIndex(Words([words[i] for i in order], alphabet, not right), len(alphabet))
    asked = Words(queries, alphabet, not right)
    exact = asked.size - asked.size // 2 if right else asked.size // 2
    q, w = index.search(asked, exact)
    return q, order[w]


def _search_block(table: pa.Table) -> pa.Table:
    """Of one block's queries: how many near words it has here, and the first of them by falling number and then by word."""
    rows = table.select(["word", "n", "query", "side", "part"]).to_pydict()
    right = rows["side"][0] == "right"
    number, shares, asked = {}, set(), {}
    for word, n, query, part in zip(rows["word"], rows["n"], rows["query"], rows["part"], strict=True):
        if query:
            asked[word] = part
        else:
            number[word] = n
            shares.add((word, part))
    words, queries = list(number), list(asked)
    out = {"word": [], "n_near": [], "form": [], "form_n": []}
    if words and queries:
        best: dict[str, tuple[int, tuple[int, str]]] = {}
        for i, k in zip(*(x.tolist() for x in near_words(words, queries, right)), strict=True):
            q, w = queries[i], words[k]
            # here for another half's sake, or one with the left half too, which the other side finds
            if (w, asked[q]) not in shares or right and w.startswith(q[: len(q) // 2]):
                continue
            n, first = best.get(q, (0, (1, "")))
            best[q] = n + 1, min(first, (-number[w], w))
        for q, (n, (less, w)) in best.items():
            for c, x in zip(out, (q, n, w, -less), strict=True):
                out[c].append(x)
    return pa.table({c: pa.array(x, pa.string() if c in ("word", "form") else pa.int64()) for c, x in out.items()})


def _halves(side: str) -> list[tuple[bool, Column]]:
    """(whether as a query, half) of a word on one side."""
    size, word = F.length("word"), F.col("word")
    half = (lambda n: F.substring(word, F.lit(1), n)) if side == "left" else (lambda n: F.right(word, n))
    cut = lambda n: F.floor(n / 2).cast("int") if side == "left" else F.ceil(n / 2).cast("int")
    return [(True, F.array(half(cut(size)))), (False, F.array_distinct(F.array(*[half(cut(size + d)) for d in (-1, 0, 1)])))]


def neighbours(words: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``word, n_near, form, form_n`` of the words of ``word, n`` that have near ones: their number, and the most frequent one (ties: the smallest)."""
    rows = [
        words.select("word", "n", F.lit(query).alias("query"), F.lit(side).alias("side"), F.explode(half).alias("part"))
        for side in ("left", "right")
        for query, half in _halves(side)
    ]
    rows = rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])
    chars = F.sum(F.length("word") + 1)
    sizes = rows.groupBy("side", "part").agg(*[F.coalesce(chars_of, F.lit(0)).alias(c) for c, chars_of in (("asked", F.sum(F.when(F.col("query"), F.length("word") + 1))), ("kept", F.sum(F.when(~F.col("query"), F.length("word") + 1))))])
    shared = sizes.where(F.greatest("asked", "kept") > block_chars).checkpoint()
    total = words.agg(F.coalesce(chars, F.lit(0)).alias("chars")).first().chars
    blocks = max(1, -(-6 * total // block_chars))
    i = j = F.lit(0).cast("long")
    split = shared.count()
    if split:
        parts = lambda c: F.coalesce(F.ceil(F.col(c) / block_chars), F.lit(1)).cast("long")
        rows = rows.join(F.broadcast(shared) if split <= BROADCAST_ROWS else shared, ["side", "part"], "left")
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts(c), F.lit(1)) - 1))
        own = lambda c: F.pmod(F.xxhash64("word"), F.greatest(parts(c), F.lit(1)))
        names = ["word", "n", "query", "side", "part"]
        asked = rows.where("query").select(*names, every("kept").alias("i"), own("asked").alias("j"))
        rows = asked.unionAll(rows.where("not query").select(*names, own("kept").alias("i"), every("asked").alias("j")))
        i, j = F.col("i"), F.col("j")
    rows = rows.select("word", "n", "query", "side", "part", F.pmod(F.xxhash64("side", "part", i, j), F.lit(blocks)).alias("block"))
    found = rows.groupBy("side", "block").applyInArrow(_search_block, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the last word that following forms comes to.

    A form is ``RATIO`` times as frequent as its word, so chains have no loops and at most
    some 60 links; each round halves them.
    """
    links = links.select("word", F.col("form").alias("root"))
    for _ in range(64):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    return links.select("word", "root")


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo: int = TYPO, ratio: int = RATIO, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of the corpus.

    ``n_near`` words are one code point away; ``form`` is the most frequent of them (ties:
    the smallest in code point order) if it is ``ratio`` times as frequent as the word,
    else null, as is its count ``form_n``; ``root`` is where forms lead to in the end, the
    word itself without one. Null and empty texts have no words; a null doc_id counts as
    an empty string in the checksum; a repeated row counts again. Other columns are not
    used; an empty table gives no words. ``min_chars`` is 2 at least, for both halves.
    """
    if min_chars < 2:
        raise ValueError("words of one character have no halves")
    ensure_checkpoint_dir(docs.sparkSession)
    words = vocabulary(docs, min_chars, min_count, typo).checkpoint()
    near = words.join(neighbours(words, block_chars), "word", "left")
    follows = F.col("form_n") >= ratio * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), *[F.when(follows, F.col(c)).alias(c) for c in ("form", "form_n")]).checkpoint()
    last = roots(near.where("form is not null"))
    return near.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
