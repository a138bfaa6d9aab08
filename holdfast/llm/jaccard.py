"""Similar texts by an exact set-similarity join of their word shingles.

A text is the set of its shingles (64-bit hashes), and texts of equal sets are one node.
Two sets are similar when their Jaccard similarity is ``p / q`` or more. Shingles are put
into one global order, rare ones first, and three filters prune pairs without losing one:

prefix      similar sets share a shingle within the first ``n - ceil(n * p / q) + 1`` of each;
length      the smaller one has ``p / q`` of the larger one's shingles at least;
positional  the shingles that both prefixes share and what can still follow the last of them make up the overlap.

What is left is checked by counting. Components are wanted, not pairs: each node is
first held against ``TRIED`` nodes for each of its shingles, those before it in the order of
their hashes, and only nodes that are then still in different components meet in pairs.
Shingles of many nodes are salted over tasks in both steps; copies of a text count once a task
before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import LOWER, RangeHash, chunks, mix, text_only, utf8, words
from .decontaminate import windows

SHINGLE, SIMILARITY = 5, (4, 5)
#: Shares of the shingles' hashes whose occurrences are counted for the global order; any order is exact.
BUCKETS = 1 << 16
#: Postings of a bucket from which its shingles are salted, if that is also ``SKEW`` times the mean.
HOT, SKEW = 1 << 14, 2
#: Bits of the sieve that picks the sets to be checked; it comes to the driver as bitmaps, 128 KB at most.
SIEVE = 1 << 20
#: Nodes of a shingle that each of its nodes is first held against.
TRIED = 4
#: Pairs of a set that are counted out in the first step.
KEPT = 2
#: Nodes of a shingle that meet in one task.
DENSE = 256

#: Columns of a set's sketch.
SKETCH = [f"s{k}" for k in range(8)]

_NO_SPACE = np.ones(256, dtype=bool)
_NO_SPACE[[9, 10, 11, 12, 13, 32]] = False


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every row, their rows, and the rows' numbers of them; a text of fewer than ``n`` words is one shingle."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, before = words(data, offsets, _NO_SPACE)
    h = RangeHash(data)(start, end)
    count = np.diff(before)
    row = np.repeat(np.arange(len(count)), count)
    x = windows(h, n)
    at = np.flatnonzero(row[: len(x)] == row[n - 1 :])
    keys, rows = [x[at]], [row[at]]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            keys.append(windows(h, k)[before[short]])
            rows.append(short)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], row[new], np.bincount(row[new], minlength=len(count))


def set_ids(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row's set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ np.uint64(0x9E3779B97F4A7C15)))])
    end = np.cumsum(size)
    return mix(total[end] - total[end - size] + size.astype(np.uint64)).view(np.int64)


def sketches(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """512 bits of every row's set, eight longs: of each share of the hashes, whether their number is odd.

    Two sets' sketches differ in no more bits than the sets in shingles.
    """
    slot = (key >> np.uint64(32)).astype(np.int64) & 511
    odd = np.bincount(row * 512 + slot, minlength=n * 512).reshape(n, 512) & 1
    return np.packbits(odd.astype(bool), axis=1, bitorder="little").view(np.int64)


def _new(ids: np.ndarray, known: set[int]) -> np.ndarray:
    """Which sets a task hasn't met before, as far as it remembers."""
    if len(known) > 500_000:
        known.clear()
    out = np.zeros(len(ids), bool)
    for r, i in enumerate(ids.tolist()):
        if i not in known:
            known.add(i)
            out[r] = True
    return out


def _occurrences(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles of all documents by bucket; the driver takes one row a bucket."""

    def scan(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches):
            key, _, _ = shingles(batch.column(0), n)
            total += np.bincount((key & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in text_only(docs).mapInArrow(scan, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def _postings(docs: DataFrame, n: int, similarity: tuple[int, int], hot: int) -> DataFrame:
    """``shingle, salt, set, at`` of every set's prefix, rare shingles first; ``at`` holds the set's size and the place in it.

    ``salt`` is 0 but for shingles of buckets with very many occurrences.
    """
    p, q = similarity
    occurrences = _occurrences(docs, n)
    salts = np.maximum(1, -(-occurrences // max(hot, SKEW * int(occurrences.mean()))))
    seen = docs.sparkSession.sparkContext.broadcast((occurrences, salts))

    def scan(batches):
        occurrences, salts = seen.value
        known: set[int] = set()  # sets of this task, so that a copy is posted once
        for batch in chunks(batches):
            key, row, size = shingles(batch.column(0), n)
            ids = set_ids(key, size)
            new = _new(ids, known)
            some = new[row]
            key, row = key[some], row[some]
            size = np.where(new, size, 0)
            bucket = (key & np.uint64(BUCKETS - 1)).astype(np.int64)
            order = np.lexsort((key, occurrences[bucket], row))
            key, row, bucket = key[order], row[order], bucket[order]
            pos = np.arange(len(key)) - (np.cumsum(size) - size)[row]
            first = pos < (size - -(-size * p // q) + 1)[row]
            key, row, pos, bucket = key[first], row[first], pos[first], bucket[first]
            salt = np.where(salts[bucket] > 1, 1 + np.mod(ids[row] >> 20, salts[bucket]), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(salt, pa.int32()), pa.array(ids[row]), pa.array(size[row].astype(np.int64) << 32 | pos)],
                names=["shingle", "salt", "set", "at"],
            )

    return text_only(docs).mapInArrow(scan, "shingle bigint, salt int, set bigint, at bigint")


def _verified(docs: DataFrame, pairs: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (``a, b``) whose sets are similar, by counting."""
    p, q = similarity
    needed = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    slot = F.col("set").bitwiseAND(F.lit(SIEVE - 1)) + 1
    maps = needed.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    sieve = np.zeros(SIEVE, bool)
    for r in maps.collect():
        bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        sieve[(r.part - 1) * len(bits) : r.part * len(bits)] = bits
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def scan(batches):
        known: set[int] = set()
        for batch in chunks(batches):
            key, row, size = shingles(batch.column(0), n)
            ids = set_ids(key, size)
            some = shared.value[ids & (SIEVE - 1)] & _new(ids, known)
            offsets = np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[some[row]].view(np.int64)))], names=["set", "keys"]
            )

    sets = text_only(docs).mapInArrow(scan, "set bigint, keys array<bigint>").join(needed, "set", "left_semi").dropDuplicates(["set"])
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("keys").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("keys").alias("y")), "b")
    return both.where(F.size(F.array_intersect("x", "y")) * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _close(similarity: tuple[int, int], both: Column) -> Column:
    """Whether the sketches of ``x`` and ``y`` leave a pair of so many shingles: of these at most (q - p) / (q + p) are in one set only."""
    p, q = similarity
    return sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SKETCH), F.lit(0)) * (p + q) <= both * (q - p)


def _behind(similarity: tuple[int, int]) -> Column:
    """The larger number of shingles behind the prefix, of sets of ``n`` and ``m``."""
    p, q = similarity
    return F.greatest(*[F.ceil(F.col(c) * p / q) - 1 for c in "nm"])


def _enough(similarity: tuple[int, int]) -> Column:
    """Whether the ``shared`` shingles of both prefixes, all of them, leave a pair of ``n`` and ``m`` shingles.

    What the sets share beyond them stands behind the prefix in the set whose prefix ends first,
    and behind the last shared one in both (``follow`` counts that one).
    """
    p, q = similarity
    most = F.col("shared") + F.least(_behind(similarity), F.col("follow") - 1)
    return most * (p + q) >= (F.col("n") + F.col("m")) * p


def _tried(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of distinct sets, numbered in their shingle (and salt), with those before them."""
    w = Window.partitionBy(*by).orderBy("set")
    before = F.collect_list(F.struct("set", "at")).over(w.rowsBetween(-TRIED, -1))
    return rows.select("*", before.alias("before"), F.row_number().over(w).alias("number"))


class Join:
    """Links of similar sets in two steps, both exact; ``docs`` are read again by each."""

    def __init__(self, docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, dense: int | None = None, hot: int | None = None):
        self.docs, self.shingle, self.similarity, self.dense = docs, shingle, similarity, dense or DENSE
        w = Window.partitionBy("shingle", "salt")
        posted = _postings(docs, shingle, similarity, hot or HOT).select("*", F.min("set").over(w).alias("a"), F.max("set").over(w).alias("b"))
        shared = posted.where("a <> b or salt > 0").drop("a", "b").dropDuplicates(["shingle", "salt", "set"])
        self.met = _tried(shared, "shingle", "salt").checkpoint()

    def first(self, sketched: DataFrame) -> DataFrame:
        """Similar pairs of a set and some of the sets of its prefix's shingles; of a salted shingle, also of its salts' first ones.

        Of those that the sketches (``set, s0, ...``) leave and that meet at half the needed number of
        shingles, the ``KEPT`` that meet most often are counted out for each set: links are wanted
        here, and what isn't linked by them is left to ``rest``.
        """
        firsts = _tried(self.met.where(F.col("salt") > 0).where(F.col("number") <= TRIED).drop("before", "number"), "shingle")
        met = reduce(DataFrame.unionByName, (t.select("set", "at", F.explode("before").alias("lead")) for t in (self.met, firsts)))
        n, m = F.shiftright("at", 32), F.shiftright("lead.at", 32)
        p, q = self.similarity
        met = met.where(F.least(n, m) * q >= F.greatest(n, m) * p).groupBy("set", F.col("lead.set").alias("lead"), n.alias("n"), m.alias("m")).agg(F.count("*").alias("shared"))
        met = met.where(F.col("shared") * 2 * (p + q) >= (F.col("n") + F.col("m")) * p - _behind(self.similarity) * (p + q))
        mine = sketched.select("set", *SKETCH)
        pairs = met.join(mine, "set").alias("x").join(mine.withColumnRenamed("set", "lead").alias("y"), "lead").where(_close(self.similarity, F.col("n") + F.col("m")))
        place = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("shared"), "lead"))
        pairs = pairs.select("set", "lead", place.alias("place")).where(F.col("place") <= KEPT).select(*_pair("set", "lead")).distinct().checkpoint()
        return _verified(self.docs, pairs, self.shingle, self.similarity)

    def rest(self, labels: DataFrame) -> DataFrame:
        """Similar pairs of sets of different components (``set, component`` and the sketch).

        Here a pair meets at every shingle that both prefixes share, so their number bounds the
        overlap as well (see ``_enough``); few pairs are left to be counted out.
        """
        rows = self.met.select("shingle", "set", "at").join(labels.select("set", "component"), "set")
        parts = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many")).where("lo <> hi")
        rows = rows.join(parts.select("shingle", F.ceil(F.col("many") / self.dense).cast("int").alias("salts")), "shingle").checkpoint()
        rows = rows.join(labels.select("set", *SKETCH), "set")
        n, m = F.shiftright("x.at", 32), F.shiftright("y.at", 32)
        p, q = self.similarity
        may = (
            (F.col("x.shingle") == F.col("y.shingle"))
            & (F.col("x.set") < F.col("y.set"))
            & (F.col("x.component") != F.col("y.component"))
            & (F.least(n, m) * q >= F.greatest(n, m) * p)
            & _close(self.similarity, n + m)
        )
        plain, hot = rows.where("salts = 1"), rows.where("salts > 1")
        x = hot.withColumn("salt", F.pmod(F.xxhash64("set"), F.col("salts")).cast("int")).alias("x")
        y = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
        ends = [F.col("x.set").alias("a"), F.col("y.set").alias("b"), n.alias("n"), m.alias("m")]
        ends.append(F.least(n - F.col("x.at").bitwiseAND(F.lit(0xFFFFFFFF)), m - F.col("y.at").bitwiseAND(F.lit(0xFFFFFFFF))).alias("follow"))
        met = plain.alias("x").join(plain.alias("y"), may).select(*ends)
        met = met.unionByName(x.join(y, may & (F.col("x.salt") == F.col("y.salt"))).select(*ends))
        shared = met.groupBy("a", "b", "n", "m").agg(F.count("*").alias("shared"), F.min("follow").alias("follow"))
        pairs = shared.where(_enough(self.similarity)).select("a", "b").checkpoint()
        return _verified(self.docs, pairs, self.shingle, self.similarity)
