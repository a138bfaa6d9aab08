"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors become integers, floor(64 * x), kept as narrow as they fit. Rows are dealt to shares
by the nearest of some centres (of a bounded sample), equally, and packed into groups; in
a group rows of one centre stand together and are cut into small blocks. A block keeps each
component's largest and smallest value; a query's bound for the block is the sum over
components of the larger product. Blocks are taken by falling bound and scored through their
rows until the next bound is below the k-th score; equal bounds are still taken, as ties go to
the smaller id. Where most blocks of a group are above it, all are scored at once.

A query is a row of some group itself: its k-th score there is where all others start
from. Groups are dealt to shares of some megabytes, packs of queries to parts; a share and
a part meet in a cell, one task, which holds the share's groups and reads the part's packs
one after another. A pack meets the groups by falling bound of the whole group, and only
queries whose bound reaches their k-th score go into it. The last step takes the k best of
all cells. Neither rows nor queries pass through the driver, nothing that grows with them is
broadcast, and the plan is the same for any number of them.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import ensure_checkpoint_dir

K = 20
EVERY = 20
#: Rows of a group, of a block, and of a pack of queries.
GROUP, BLOCK, PACK = 8192, 16, 256
#: Bytes of groups that a cell holds (about), packs of queries that it reads, and bytes that come to a worker at once.
SHARE_BYTES, CELL_PACKS, BATCH_BYTES = 64 << 20, 4096, 16 << 20
#: Rows that centres are found from (about so many, by hash), and centres.
SAMPLE, CENTRES = 4096, 256
#: Share of a group's blocks above the k-th score from which all of them are scored at once.
MOST = 0.3

_NONE = -(1 << 63)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and integer components; null vectors and those with a null or non-finite component are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    codes = F.transform(x, lambda v: F.floor(v * 64.0))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), codes.alias("codes"))


def _matrix(ids: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of components; shorter vectors are filled up with zeros."""
    offsets = codes.offsets.to_numpy().astype(np.int64)
    flat = codes.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    width = int(size.max(initial=0))
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return ids.to_numpy(zero_copy_only=False), out


def centres(rows: DataFrame, total: int) -> np.ndarray:
    """Means of a sample's rows around some of them; none for an empty sample."""
    share = min(1.0, SAMPLE / max(1, total))
    few = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)) < int(share * (1 << 31))).select("codes")
    held = [np.array(r.codes, float) for r in few.toLocalIterator() if r.codes]
    if not held:
        return np.zeros((0, 0))
    width = max(map(len, held))
    x = np.stack([np.pad(v, (0, width - len(v))) for v in held])
    x = x[np.lexsort(x.T)]
    c = x[np.linspace(0, len(x) - 1, min(CENTRES, len(x))).astype(int)]
    for _ in range(2):
        near = nearest(x, c)
        c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if not len(c):
        return np.zeros(len(x), np.int64)
    width = max(x.shape[1], c.shape[1])
    x, c = np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(float), np.pad(c, ((0, 0), (0, width - c.shape[1])))
    return (x @ c.T - 0.5 * np.square(c).sum(1)).argmax(1)


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Integers as bytes of the narrowest kind that holds them, and its width."""
    for size in (2, 4, 8):
        limit = 1 << 8 * size - 1
        if size == 8 or not x.size or (x.min() >= -limit and x.max() < limit):
            return size, x.astype(f"<i{size}").tobytes()
    raise AssertionError


def _unpack(size: int, width: int, ids: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(codes, f"<i{size}").reshape(len(i), width)


_PACKED = "size int, width int, ids binary, codes binary, nth bigint"


_NAMES = ["size", "width", "ids", "codes", "nth"]


def _packed(ids: np.ndarray, x: np.ndarray, nth: int) -> list[pa.Array]:
    """One row of ``_PACKED``, the ``nth`` of its partition."""
    size, codes = _narrow(x)
    ids = pa.array([ids.astype(np.int64).tobytes()], pa.binary())
    return [pa.array([size], pa.int32()), pa.array([x.shape[1]], pa.int32()), ids, pa.array([codes], pa.binary()), pa.array([nth], pa.int64())]


def groups(rows: DataFrame, c: np.ndarray, shares: int) -> DataFrame:
    """Rows dealt to shares by their centre, and packed: sorted by centre, ``GROUP`` rows at most."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(c)

    def centred(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                near = nearest(_matrix(part.column(0), part.column(1))[1], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near, pa.int32())], names=["vec_id", "codes", "centre"])

    def packs(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        nth = count()

        def out():
            width = max(x.shape[1] for _, x, _ in held)
            ids, near = np.concatenate([i for i, _, _ in held]), np.concatenate([n for _, _, n in held])
            x = np.vstack([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x, _ in held])
            held.clear()
            if width:
                lead = np.abs(x).argmax(1)
                order = np.lexsort((ids, x[np.arange(len(x)), lead], lead, near))
                ids, x = ids[order], x[order]
            return pa.RecordBatch.from_arrays(_packed(ids, x, next(nth)), names=_NAMES)

        n = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(batch.num_rows - at, GROUP - n))
                held.append((*_matrix(part.column(0), part.column(1)), part.column(2).to_numpy()))
                n += part.num_rows
                at += part.num_rows
                if n == GROUP:
                    yield out()
                    n = 0
        if n:
            yield out()

    near = rows.mapInArrow(centred, "vec_id bigint, codes array<bigint>, centre int")
    # neighbouring shares for a centre, one row after another by hash: no centre is more than its part of any share
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-shares // 4))))
    dealt = near.repartition(shares, "centre", spread) if len(c) > 1 else near.repartition(shares)
    return dealt.mapInArrow(packs, _PACKED).checkpoint()


def queries(packed: DataFrame, k: int, every: int) -> DataFrame:
    """``vec_id, codes, kth`` of the queries: their k-th score in their own group, null with fewer rows."""

    def scan(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, x = _unpack(*(batch.column(j)[r].as_py() for j in range(4)))
                some, group = np.flatnonzero(ids % every == 0), Group(ids, x)
                for at in range(0, len(some), PACK):
                    part = some[at : at + PACK]
                    best = Best(ids[part], x[part], np.full(len(part), _NONE), k)
                    best.meet(group)
                    kth = [s[-1] if len(s) == k and abs(s[-1]) < 1 << 62 else None for s in best.scores]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * x.shape[1], pa.int32()), pa.array(x[part].ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[part]), lists, pa.array(kth, pa.int64())], names=["vec_id", "codes", "kth"]
                    )

    found = packed.mapInArrow(scan, "vec_id bigint, codes array<bigint>, kth bigint")
    return found.groupBy("vec_id").agg(F.min(F.struct("codes", "kth")).alias("q")).select("vec_id", "q.codes", "q.kth")


def _reach(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


class Group:
    """Rows that are met together, in blocks; their largest and smallest components are made once for a kind of numbers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, block: int = BLOCK):
        self.ids, self.x, self.block, self.reach = ids, x, block, _reach(x)
        self.cuts, self._made = np.arange(0, len(x), block), {}

    def made(self, kind: type, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, blocks' largest and blocks' smallest components."""
        if (kind, width) not in self._made:
            x = np.pad(self.x, ((0, 0), (0, width - self.x.shape[1]))).astype(np.int64 if kind is object else kind).astype(kind)
            self._made = {(kind, width): (x, np.maximum.reduceat(x, self.cuts, axis=0), np.minimum.reduceat(x, self.cuts, axis=0))}
        return self._made[kind, width]


class Best:
    """Some queries and the k best rows that they have met; ``kth`` is the score that a row must reach."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
        self.ids, self.q, self.k, self.reach = ids, q, k, _reach(q)
        self.kth = [None if s == _NONE else int(s) for s in kth.tolist()]
        self.rows, self.scores = [np.zeros(0, np.int64)] * len(ids), [[]] * len(ids)
        self.scored = self.blocks = 0

    def _with(self, group: Group) -> tuple[type, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A kind of numbers that is exact for the scores, the queries, and what ``group`` has made for it."""
        width = max(self.q.shape[1], group.x.shape[1])
        largest = self.reach * group.reach * max(width, 1)
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object
        q = np.pad(self.q, ((0, 0), (0, width - self.q.shape[1]))).astype(np.int64 if kind is object else kind).astype(kind)
        return kind, q, *group.made(kind, width)

    def _least(self, kind: type) -> np.ndarray:
        return np.array([-np.inf if s is None else s for s in self.kth], object if kind is object else np.float64)

    def take(self, ids: np.ndarray, x: np.ndarray, block: int = BLOCK) -> None:
        """Meet the rows of one group."""
        self.meet(Group(ids, x, block))

    def meet_all(self, groups: list[Group]) -> None:
        """Meet groups by falling bound, each with the queries that it may still have rows for."""
        bounds = []
        for group in groups:
            kind, q, _, high, low = self._with(group)
            bounds.append(np.maximum(q, 0) @ high.max(0) + np.minimum(q, 0) @ low.min(0))
        for at in sorted(range(len(groups)), key=lambda g: -bounds[g].max()):
            live = np.flatnonzero(bounds[at] >= self._least(object if bounds[at].dtype == object else np.float64))
            if len(live):
                self.meet(groups[at], live)

    def meet(self, group: Group, some: np.ndarray | None = None) -> None:
        """Meet the rows of one group, all queries or some."""
        kind, q, x, high, low = self._with(group)
        ids, cuts, block = group.ids, group.cuts, group.block
        some = np.arange(len(q)) if some is None else some
        q, own, least = q[some], self.ids[some], self._least(kind)[some]
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T

        def rows_of(blocks: np.ndarray, i: int) -> np.ndarray:
            rows = (cuts[blocks][:, None] + np.arange(block)).ravel()
            rows = rows[rows < len(x)]
            return rows[ids[rows] != own[i]]

        for i in np.flatnonzero([self.kth[n] is None for n in some]).tolist():  # a start: the k-th score of the blocks of the largest bounds
            score = x[rows_of(np.argsort(-bounds[i].astype(np.float64), kind="stable")[: 2 + self.k // block], i)] @ q[i]
            if len(score) >= self.k:
                least[i] = self.kth[some[i]] = int(sorted(score.tolist())[-self.k])
        live = bounds >= least[:, None]
        self.blocks += live.size
        if kind is not object and live.mean() > MOST:
            self.scored += live.size
            score = q @ x.T
            score[own[:, None] == ids[None, :]] = -np.inf
            fits = (score >= least[:, None]) & (score > -np.inf)
            for i in np.flatnonzero(fits.any(1)).tolist():
                at = np.flatnonzero(fits[i])
                self._merge(some[i], ids[at], score[i, at])
            return
        for i in np.flatnonzero(live.any(1)).tolist():
            n, left = some[i], np.flatnonzero(live[i])
            order = left[np.argsort(-bounds[i, left].astype(np.float64), kind="stable")]
            for at in range(0, len(order), 16):
                part = order[at : at + 16]
                if self.kth[n] is not None:
                    part = part[bounds[i, part] >= self.kth[n]]
                if not len(part):
                    if kind is object:
                        continue
                    break
                self.scored += len(part)
                rows = rows_of(part, i)
                score = x[rows] @ q[i]
                if self.kth[n] is not None:
                    rows, score = rows[keep := score >= self.kth[n]], score[keep]
                self._merge(n, ids[rows], score)

    def _merge(self, i: int, rows: np.ndarray, score: np.ndarray) -> None:
        k = self.k
        if len(rows) > 4 * k and score.dtype != object:  # all of the k-th score and above
            keep = score >= -np.partition(-score, k - 1)[k - 1]
            rows, score = rows[keep], score[keep]
        rows, score = np.concatenate([self.rows[i], rows]), [*self.scores[i], *map(int, score)]
        best = sorted(range(len(score)), key=lambda j: (-score[j], rows[j]))[:k]
        self.rows[i], self.scores[i] = rows[best], [score[j] for j in best]
        if len(best) == k:
            self.kth[i] = self.scores[i][-1] if self.kth[i] is None else max(self.kth[i], self.scores[i][-1])


def packs(chosen: DataFrame) -> DataFrame:
    """Queries in packs, with their k-th scores."""

    def scan(batches):
        nth = count()
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                kth = part.column(2).fill_null(_NONE).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([*_packed(*_matrix(part.column(0), part.column(1)), next(nth)), pa.array([kth.tobytes()], pa.binary())], names=[*_NAMES, "kth"])

    return chosen.mapInArrow(scan, f"{_PACKED}, kth binary")


def cells(packed: DataFrame, asked: DataFrame, share_bytes: int, cell_packs: int) -> DataFrame:
    """Every share of groups beside every part of the packs: one partition a cell, its groups first."""
    wide = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("ids") + F.length("codes")), F.lit(0)).alias("bytes")).first()
    spread = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-wide.bytes // share_bytes), min(wide.n, spread))
    parts = max(1, -(-asked.count() // cell_packs))

    def dealt(rows: DataFrame, among: int, others: int, cell, last: int, kth) -> DataFrame:
        # the nth row of each partition, counted across the partitions
        own = F.pmod(F.spark_partition_id() + F.col("nth") * rows.rdd.getNumPartitions(), F.lit(among))
        every = rows.select("*", own.alias("own")).select("*", F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"))
        return every.select(cell.cast("int").alias("cell"), F.lit(last).alias("last"), *_NAMES[:4], kth.alias("kth"))

    both = dealt(packed, shares, parts, F.col("other") * shares + F.col("own"), 0, F.lit(None).cast("binary")).union(
        dealt(asked, parts, shares, F.col("own") * shares + F.col("other"), 1, F.col("kth"))
    )
    return both.repartitionById(shares * parts, F.col("cell")).sortWithinPartitions("last")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, share_bytes: int = SHARE_BYTES, cell_packs: int = CELL_PACKS) -> DataFrame:
    """Columns ``query_id, rank, vec_id, score`` for queries whose ``vec_id`` is divisible by ``every``.

    All candidates if there are fewer than k; an id is no candidate for itself. A repeated
    query id is one query (its smallest vector); repeated rows are candidates as often as
    they occur. Vectors of different lengths are filled up with zeros. Ranks are exact for
    all integers; a score beyond the range of a long is shown as its nearest end. Null or
    non-finite vectors and null ids take no part, and other columns are not used. An empty
    table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # groups are long rows
    rows = usable(vectors)
    packed = groups(rows, centres(rows, vectors.count()), int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = packs(queries(packed, k, every)).checkpoint()

    def search(batches):
        held: list[Group] = []  # a partition is one cell
        for batch in batches:
            for r in range(batch.num_rows):
                last, *row, kth = (batch.column(j)[r].as_py() for j in range(1, 7))
                if not last:
                    held.append(Group(*_unpack(*row)))
                    continue
                best = Best(*_unpack(*row), np.frombuffer(kth, np.int64), k)
                best.meet_all(held)
                size = [len(s) for s in best.scores]
                scores = [min(max(s, -(1 << 63)), (1 << 63) - 1) for own in best.scores for s in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(best.ids, size)), pa.array(np.concatenate(best.rows)), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"]
                )

    found = cells(packed, asked, share_bytes, cell_packs).mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
asked AS (SELECT vec_id, min(c) AS c FROM v WHERE vec_id % {EVERY} = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * d.c[i])) AS BIGINT) AS score
  FROM asked q, v d WHERE d.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
