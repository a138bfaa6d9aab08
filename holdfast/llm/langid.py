"""Language of a text by multinomial naive Bayes over hashed character n-grams.

The counts of every (language, bucket) are summed by Spark over all training documents;
the log-probability matrix, languages x buckets, is broadcast by its seen entries, and each
batch is scored as a sparse product in numpy, some languages at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, utf8

#: Buckets of the hash; a power of two.
BUCKETS = 1 << 14
#: Languages that are scored at once; of the matrix, so many rows are laid out in full.
WIDE = 128
ORDERS = (1, 2, 3)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are not learned from; those without a doc_id are among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of letters in a batch of UTF-8 texts, and its row.

    Letters are folded to lower case, everything else to one gap character.
    """
    codes, starts = _letters(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (rows[1:] != rows[:-1])  # runs of gaps become one
    codes, rows = codes[keep], rows[keep]
    where, who, h = [], [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        end = len(codes) - n + 1
        h = h[:end] * np.uint32(0x01000193) ^ codes[n - 1 :]
        if n in ORDERS:
            mixed = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            inside = rows[:end] == rows[n - 1 :]
            if n == 1:
                inside &= codes > 0
            where.append(((mixed ^ mixed >> np.uint32(15)) & np.uint32(buckets - 1))[inside])
            who.append(rows[:end][inside])
    if not where:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(where), np.concatenate(who)


_FOLD = np.zeros(0x10000, np.uint32)


def _fold() -> np.ndarray:
    """Lower-case code of each code point of the basic plane, 0 for all but letters."""
    if not _FOLD[ord("a")]:
        for c in range(0x10000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                _FOLD[c] = ord(low[0])
    return _FOLD


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    fold = _fold()
    high = points > 0xFFFF
    codes = fold[np.where(high, 0, points)]
    if high.any():
        for c in np.unique(points[high]):
            if chr(c).isalpha():
                codes[points == c] = c
    return codes, first[offsets]


class Model:
    """Log-probabilities of languages: one for each seen bucket, and one of each language for all others."""

    def __init__(self, langs: list[str], seen: list[tuple[np.ndarray, np.ndarray]], docs: list[float], buckets: int):
        self.langs, self.buckets = langs, buckets
        total = [n.sum() + 0.5 * buckets for _, n in seen]
        self.other = np.log([0.5 / t for t in total])
        self.at = [at.astype(np.int32) for at, _ in seen]
        self.logs = [np.log((n + 0.5) / t) for (_, n), t in zip(seen, total, strict=True)]
        self.prior = np.log(np.array(docs) / sum(docs)) if langs else np.zeros(0)
        self._first: np.ndarray | None = None

    def _matrix(self, a: int) -> np.ndarray:
        if a == 0 and self._first is not None:
            return self._first
        m = np.repeat(self.other[a : a + WIDE, None], self.buckets, axis=1)
        for row, at, logs in zip(m, self.at[a : a + WIDE], self.logs[a : a + WIDE], strict=False):
            row[at] = logs
        if a == 0:
            self._first = m
        return m

    def classify(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's best language, its posterior, and the number of n-grams; the first one of equals."""
        n = len(offsets) - 1
        where, who = grams(data, offsets, self.buckets)
        best, index, total = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n)
        for a in range(0, len(self.langs), WIDE):
            m = self._matrix(a)
            out = np.empty((n, len(m)))
            for j, row in enumerate(m):
                out[:, j] = np.bincount(who, weights=row[where], minlength=n) + self.prior[a + j]
            top = out.max(1)
            index[top > best] = a + out.argmax(1)[top > best]
            high = np.maximum(best, top)
            total = total * np.exp(best - high) + np.exp(out - high[:, None]).sum(1)
            best = high
        return index, 1 / np.maximum(total, 1.0), np.bincount(who, minlength=n)


def train(docs: DataFrame, buckets: int = BUCKETS) -> Model:
    """Counts over every row with text and a language; ``docs`` holds training rows only."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")

    def scan(batches):
        seen: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for batch in chunks(batches, limit=1 << 20):
            col = batch.column(0).dictionary_encode()
            names = col.dictionary.to_pylist()
            lang = np.asarray(col.indices)
            where, who = grams(*utf8(batch.column(1)), buckets)
            flat = np.bincount(lang[who].astype(np.int64) * buckets + where, minlength=len(names) * buckets).reshape(len(names), buckets)
            for k, name in enumerate(names):
                seen[name] = seen.get(name, 0) + flat[k]
                number[name] = number.get(name, 0) + int((lang == k).sum())
        for name, row in seen.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(row[at], number[name]), pa.int64())],
                names=["lang", "bucket", "n"],
            )

    sums = rows.mapInArrow(scan, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per = sums.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).orderBy("lang")
    langs, seen, prior = [], [], []
    for r in per.toLocalIterator():  # a row of at most `buckets` counts for each language
        at, n = np.array(r.bucket), np.array(r.n, float)
        langs.append(r.lang)
        seen.append((at[at >= 0], n[at >= 0]))
        prior.append(n[at < 0].sum())
    return Model(langs, seen, prior, buckets)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Columns ``doc_id, lang_pred, score`` for every row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    The score is the posterior of the language, one row per input row; other columns are
    not used. A map over partitions: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in chunks(batches, limit=1 << 20):
            best, share, n = m.classify(*utf8(batch.column(1)))
            none = (n == 0) | (len(m.langs) == 0)
            best[none], share[none] = len(m.langs), 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, lang_pred string, score double")
