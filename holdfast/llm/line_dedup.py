"""Removal of lines that many documents share, through sharded minimal perfect hashes.

A first pass counts the documents of every long line's 128-bit hash, with map-side
combination, so that a line in a third of all documents is one row a task. Hashes found
often enough are dealt into shards by their bits; each shard's task builds a minimal
perfect hash over its distinct hashes, which gives every one its own place in arrays of
fingerprints, counts and keeping documents. The second pass probes the arrays from each
document's lines: no line is shuffled or joined.

The arrays are broadcast in blocks of ``BLOCK_BYTES`` at most. If there are more blocks
than one, the documents pass once for each, with the text checkpointed between.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, ensure_checkpoint_dir, mix, text_only

MIN_CHARS, MIN_DOCS = 40, 5
#: Hashes of a shard, and bytes of arrays that are broadcast at once.
SHARD_KEYS, BLOCK_BYTES = 1 << 15, 48 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A line's key as UTF-8, or None if it has fewer code points than ``min_chars``."""
    if len(line) < min_chars:
        return None
    key = line.strip().lower()  # of bytes: the six ASCII white space characters, and A-Z only
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _hashes(keys: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) for k in keys]), dtype="<u8").reshape(-1, 2)


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``a, b`` (a key's hash), ``n`` (documents) and ``keep`` (largest doc_id) of the keys found often enough."""

    def scan(batches):
        for batch in chunks(batches):
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                keys += own
                ids += [doc] * len(own)
            h = _hashes(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], names=["a", "b", "doc_id"])

    lines = text_only(docs, F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")).mapInArrow(scan, "a bigint, b bigint, doc_id bigint")
    counts = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
    return counts.where(F.col("n") >= min_docs)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, the keys that collide in one going to the next."""

    GAMMA = 2

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(ones)])
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = max(64, -(-cls.GAMMA * len(keys) // 64) * 64)
            at = cls._place(keys, len(sizes), size)
            once = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(once, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[~once[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; -1 for some keys that were not built in, any place for the others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.start[level] + self._place(keys[left], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) > 0
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.rank[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out


_COUNTS = ["__n_lines", "__n_dropped"]
_SHARD = "shard int, sizes array<int>, bits binary, prints binary, counts binary, keeps binary"


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its perfect hash, and arrays of fingerprint, count and keeping document by place."""

    def build(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        keys = a + b * np.uint64(0x9E3779B97F4A7C15)
        ph = PerfectHash.build(keys)
        place = ph(keys)
        prints, counts, keeps = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
        prints[place], counts[place], keeps[place] = b, np.minimum(table.column("n").to_numpy(), (1 << 32) - 1), table.column("keep").to_numpy()
        return pa.table(
            {
                "shard": pa.array(table.column("shard").to_numpy()[:1], pa.int32()),
                "sizes": pa.array([ph.sizes], pa.list_(pa.int32())),
                **{n: pa.array([x.tobytes()], pa.binary()) for n, x in (("bits", ph.bits), ("prints", prints), ("counts", counts), ("keeps", keeps))},
            }
        )

    return lines.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, _SHARD)


class Probe:
    """Some shards' arrays, as a task uses them."""

    def __init__(self, rows: list, shards: int, min_docs: int):
        self.shards, self.min_docs = shards, min_docs
        self.of = {
            r.shard: (
                PerfectHash(list(r.sizes), np.frombuffer(r.bits, np.uint64)),
                np.frombuffer(r.prints, np.uint64),
                np.frombuffer(r.counts, np.uint32),
                np.frombuffer(r.keeps, np.int64),
            )
            for r in rows
        }

    def drops(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which lines (hashes and their documents) go."""
        out = np.zeros(len(h), bool)
        shard = np.mod(h[:, 0].view(np.int64), self.shards)
        keys = h[:, 0] + h[:, 1] * np.uint64(0x9E3779B97F4A7C15)
        for s in np.unique(shard):
            if s not in self.of:
                continue
            ph, prints, counts, keeps = self.of[s]
            rows = np.flatnonzero(shard == s)
            place = ph(keys[rows])
            rows, place = rows[place >= 0], place[place >= 0]
            own = prints[place] == h[rows, 1]
            rows, place = rows[own], place[own]
            out[rows] = (counts[place] >= self.min_docs) & (keeps[place] != doc[rows])
        return out


def _blocks(table: DataFrame, limit: int):
    """The shards' rows in blocks of at most ``limit`` bytes (one shard at least)."""
    block, size = [], 0
    for r in table.toLocalIterator():
        own = sum(len(r[c]) for c in ("bits", "prints", "counts", "keeps"))
        if block and size + own > limit:
            yield block
            block, size = [], 0
        block.append(r)
        size += own
    if block:
        yield block


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, block_bytes: int = BLOCK_BYTES, counts: bool = True) -> DataFrame:
    """``docs`` with shared lines removed from ``text``, and with ``n_lines`` and ``n_dropped`` unless ``counts`` is false.

    Keys of ``min_chars`` code points or more in ``min_docs`` documents or more (rows; a
    repeated row is another document) lose all their lines except in the largest doc_id
    that holds them. Null and empty texts are one empty line. All other columns stay.
    Columns called ``n_lines`` or ``n_dropped`` are replaced by the counts, if these are
    wanted. A null doc_id counts as smallest. An empty table stays empty.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    lines = frequent_lines(docs, min_chars, min_docs).checkpoint()
    shards = max(1, -(-lines.count() // SHARD_KEYS))
    table = build_shards(lines, shards).checkpoint()
    where, who = docs.columns.index("text"), docs.columns.index("doc_id")
    fill = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumns({"text": fill, **{c: F.lit(0).cast("bigint") for c in _COUNTS}})
    shared = None
    for block in list_or_empty(_blocks(table, block_bytes)):
        first = shared is None
        if not first:
            out = out.checkpoint()
            shared.destroy()
        shared = spark.sparkContext.broadcast(Probe(block, shards, min_docs))
        out = out.mapInArrow(_pass(shared, where, who, min_chars, first), out.schema)
    return out.select(*names, *([F.col(c).alias(c.strip("_")) for c in _COUNTS] if counts else []))


def list_or_empty(blocks):
    """The blocks, or one empty block, as lines are counted in any case."""
    some = False
    for b in blocks:
        some = True
        yield b
    if not some:
        yield []


def _pass(shared, where: int, who: int, min_chars: int, first: bool):
    def scan(batches):
        probe = shared.value
        for batch in chunks(batches):
            texts = batch.column(where).cast(pa.binary()).to_pylist()
            doc = pc.fill_null(batch.column(who), -(1 << 63)).to_numpy(zero_copy_only=False)
            split = [t.split(b"\n") for t in texts]
            keys, at = [], []
            for r, lines in enumerate(split):
                for k, line in enumerate(lines):
                    if (key := line_key(line, min_chars)) is not None:
                        keys.append(key)
                        at.append((r, k))
            gone: dict[int, set[int]] = {}
            if keys:
                rows = np.fromiter((r for r, _ in at), np.int64, len(at))
                for i in np.flatnonzero(probe.drops(_hashes(keys), doc[rows])):
                    gone.setdefault(at[i][0], set()).add(at[i][1])
            for r, ks in gone.items():
                texts[r] = b"\n".join([line for k, line in enumerate(split[r]) if k not in ks])
            cols = list(batch.columns)
            cols[where] = pa.array(texts, pa.binary()).cast(pa.string())
            dropped = np.zeros(batch.num_rows, np.int64)
            for r, ks in gone.items():
                dropped[r] = len(ks)
            if first:
                cols[-2] = pa.array([len(x) for x in split], pa.int64())
                cols[-1] = pa.array(dropped)
            else:
                cols[-1] = pc.add(cols[-1], pa.array(dropped))
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return scan


def oracle(min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    """The query's rows as DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM d),
keyed AS (SELECT r, doc_id, line, k, translate(trim(line, {blank}), '{upper}', '{lower}') AS key FROM l),
often AS (
  SELECT key, count(DISTINCT r) AS n, max(doc_id) AS keep FROM keyed WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT r) >= {min_docs}),
marked AS (SELECT keyed.*, often.key IS NOT NULL AND keyed.doc_id <> often.keep AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id"""
