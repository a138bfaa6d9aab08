"""Helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a task works on; bounds the Python workers' memory.
CHUNK_BYTES = 1 << 20
#: Rows of texts that come to a worker at once.
BATCH_ROWS = 1000

#: Odd multiplier of the polynomial hashes (mod 2**64) and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only in local mode (tests) set a folder without one."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: batches of ``BATCH_ROWS`` at most keep workers and executors small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_only(docs: DataFrame, *keep: str) -> DataFrame:
    """The key columns and the text, null text as empty; other columns are not read."""
    small_batches(docs.sparkSession)
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column has about ``limit`` bytes each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the rows' offsets into them, without a copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class RangeHash:
    """Karp-Rabin hashes (mod 2**64) of many byte ranges of one array at once."""

    _up = powers(_BASE, 1)
    _down = powers(_INV, 1)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(RangeHash._up) < n:
            RangeHash._up, RangeHash._down = powers(_BASE, n + n // 4), powers(_INV, n + n // 4)
        self.prefix = np.zeros(n, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[: n - 1], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * self._down[start]
        return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes, so that any of their bits can be used."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_bytes(words: list[bytes]) -> np.ndarray:
    """The same hashes as ``RangeHash`` gives, of separate byte strings."""
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    end = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end
    return RangeHash(data)(start, end)


#: ASCII lower case for bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: digits, letters and everything beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of lower-cased bytes, and the number of words before each row."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = word_byte[data]
    edge = inside[1:] != inside[:-1]
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    # a row's end also ends its last word
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    if len(cut) and len(start):
        k = np.searchsorted(start, cut, side="left") - 1
        hit = cut[(k >= 0) & (end[np.maximum(k, 0)] > cut)]
        start, end = np.sort(np.concatenate([start, hit])), np.sort(np.concatenate([end, hit]))
    return start, end, np.searchsorted(start, offsets, side="left")
