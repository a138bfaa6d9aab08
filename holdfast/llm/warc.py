"""WARC archives in seekable Zstandard bundles.

A bundle is one file. Its records are gathered into frames of some ``FRAME_BYTES``, each
compressed by itself; then follow a frame that decoders skip, which maps every record to
its frame and its place within the frame's bytes, and the seek table of the frames' sizes
as the file's footer. Any record is read by the footer, the map and one frame. Plain
Zstandard tools read a bundle as the WARC file that it is.

Of pages with equal payloads one is written as a response and the others as revisits of
it. Only digests and ids are shuffled to find these; pages are bundled where they are read.

Spark's own writer puts the bundles into whatever store it knows: each is a row of the
text sink, whose line separator, the footer's last four bytes, completes it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from base64 import b32encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import ensure_checkpoint_dir, remove, small_batches

#: Bytes of records in a frame, and of frames in a bundle, at least (a record is never cut).
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 4 << 20
LEVEL = 3
#: Payloads of which there are several whose table is broadcast; beyond that it is joined.
BROADCAST_ROWS = 200_000

# fixed values of the seekable format
_TABLE, _MAP, _MAGIC = 0x184D2A5E, 0x184D2A5D, b"\xb1\xea\x92\x8f"
_ENTRY = np.dtype([("record", "S16"), ("page_id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
_NO_PAGE = -(1 << 63)

# fixed values of WARC 1.1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return b32encode(digest).decode()


def _urn(*said) -> bytes:
    return hashlib.md5(":".join(map(str, said)).encode()).digest()


def _record(kind: str, record: bytes, block: bytes, fields: list[tuple[str, object]], date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=record)}>"), ("WARC-Date", date), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, digest: bytes, n_bytes: int, refers_to: int | None, place: tuple[int, int], date: str) -> tuple[bytes, bytes]:
    """(record's id, record): a response with its payload, or, without one, a revisit. ``place`` tells revisits apart."""
    first = _urn("response", refers_to if payload is None else page_id, digest.hex())
    record = first if payload is not None else _urn("revisit", page_id, *place)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    fields = [("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("X-Page-Id", page_id)]
    if payload is None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.UUID(bytes=first)}>"), ("X-Refers-To-Page-Id", refers_to)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return record, _record("revisit" if payload is None else "response", record, http + (payload or b""), fields, date)


class Bundle:
    """A bundle that is being written."""

    def __init__(self, place: tuple, frame_bytes: int = FRAME_BYTES, date: str = "1970-01-01T00:00:00Z"):
        from zstandard import ZstdCompressor

        self.press = ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frame_bytes, self.frames, self.sizes, self.entries, self.open, self.filled, self.size = frame_bytes, [], [], [], [], 0, 0
        info = _urn("warcinfo", *place)
        self.add(info, None, _record("warcinfo", info, b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")], date))

    def add(self, record: bytes, page_id: int | None, said: bytes) -> None:
        if self.filled and self.filled + len(said) > self.frame_bytes:
            self._close()
        self.entries.append((record, _NO_PAGE if page_id is None else page_id, len(self.frames), self.filled, len(said)))
        self.open.append(said)
        self.filled += len(said)

    def _close(self) -> None:
        if self.open:
            data = b"".join(self.open)
            self._put(self.press.compress(data), len(data))
            self.open, self.filled = [], 0

    def _put(self, frame: bytes, plain: int) -> None:
        self.frames.append(frame)
        self.sizes.append((len(frame), plain))
        self.size += len(frame)

    def end(self, footer: bytes = b"") -> bytes:
        """The whole bundle; without ``footer`` its last four bytes are left to what writes it."""
        self._close()
        table = np.array(self.entries, _ENTRY).tobytes()
        self._put(struct.pack("<II", _MAP, len(table)) + table, 0)
        sizes = np.array(self.sizes, "<u4").tobytes()
        return b"".join(self.frames) + struct.pack("<II", _TABLE, len(sizes) + 9) + sizes + struct.pack("<IB", len(self.frames), 0) + footer


class Opened:
    """A bundle's bytes with its seek table and its map of records."""

    def __init__(self, data: bytes):
        from zstandard import ZstdDecompressor

        if data[-4:] != _MAGIC:
            raise ValueError("a bundle ends with the seek table's magic number")
        n, flags = struct.unpack("<IB", data[-9:-4])
        wide = 12 if flags & 0x80 else 8
        sizes = np.frombuffer(data, "<u4", n * wide // 4, len(data) - 9 - n * wide).reshape(n, -1).astype(np.int64)
        ends = np.cumsum(sizes[:, 0])
        self.data, self.frames, self.starts, self.plain = data, n - 1, ends - sizes[:, 0], sizes[:, 1]
        self.ends, self.unpress = ends, ZstdDecompressor()
        self.map = np.frombuffer(data[self.starts[-1] + 8 : ends[-1]], _ENTRY)

    def frame(self, k: int) -> bytes:
        return self.unpress.decompress(self.data[self.starts[k] : self.ends[k]], max_output_size=int(self.plain[k]))

    def record(self, entry) -> bytes:
        return self.frame(entry["frame"])[entry["offset"] : entry["offset"] + entry["length"]]


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def parse(said: bytes) -> tuple | None:
    """(page_id, url, n_bytes, digest, kind, refers_to, payload) of one record; None if it isn't a page. A payload is held against its digest."""
    head, _, rest = said.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not the start of a record")
    f = _fields(head)
    if f["warc-type"] not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(f["content-length"])].partition(b"\r\n\r\n")
    digest, n_bytes = f["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"])
    number = lambda c: int(f[c]) if c in f else None
    if f["warc-type"] == "revisit":
        payload = None
    elif len(payload) != n_bytes or base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"payload of {f['warc-record-id']} is not what its digest says")
    return number("x-page-id"), f.get("warc-target-uri"), n_bytes, digest, f["warc-type"], number("x-refers-to-page-id"), payload


_ROW = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [*(x.split()[0] for x in _ROW.split(", ")), "payload"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, n_bytes, refers_to, revisits`` of all pages; ``html`` is null for those that revisit others.

    Of rows with equal payloads of ``min_bytes`` or more, the one of the largest page_id
    (then the largest url; a null is smallest) is the response. Of entirely equal rows one
    is it.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumns({"n_bytes": F.octet_length("html").cast("bigint"), "key": F.unhex(F.sha2("html", 256))})
    enough = rows.where(F.col("n_bytes") >= min_bytes)
    groups = enough.groupBy("key", "page_id", "url").agg(F.count("*").alias("copies")).groupBy("key")
    several = groups.agg(F.max(F.struct("page_id", "url", "copies")).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    several = several.select("key", "first").checkpoint()
    hint = F.broadcast if several.count() <= BROADCAST_ROWS else (lambda df: df)
    rows = rows.join(hint(several), "key", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    response = F.col("first").isNull() | is_first
    sha1 = F.unhex(F.sha1("html")).alias("sha1")
    told = lambda df, response: df.select("page_id", "url", F.when(response, F.col("html")).alias("html"), "sha1", "n_bytes", F.when(~response, F.col("refers_to")).alias("refers_to"), (~response).alias("revisits"))
    rows = rows.select("*", sha1, F.col("first.page_id").alias("refers_to"))
    if several.where("first.copies > 1").isEmpty():
        return told(rows, response)
    repeated = F.col("first").isNotNull() & is_first & (F.col("first.copies") > 1)
    same = rows.where(repeated).groupBy("page_id", "url", "key", "sha1", "n_bytes", "refers_to").agg(F.first("html").alias("html"), F.count("*").alias("copies"))
    same = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return told(rows.where(~repeated), response).unionByName(told(same, F.col("copy") == 1))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``page_id, url, html`` as bundles into a new folder, one record a row.

    Null html is an empty payload; a null page_id or url is left out of the record. Control
    characters and spaces of urls are percent-encoded. Other columns are not used. An empty
    table leaves a folder without records.
    """

    names = ["page_id", "url", "html", "sha1", "n_bytes", "refers_to", "revisits"]

    def pack(batches):
        part = TaskContext.get().partitionId()
        number, n, bundle = 0, 0, None
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64).to_pydict()
                for page_id, url, html, sha1, n_bytes, refers_to, revisits in zip(*(rows[c] for c in names), strict=True):
                    bundle, n = bundle or Bundle((part, number), frame_bytes, date), n + 1
                    record, said = page_record(page_id, url, None if revisits else html.encode(), sha1, n_bytes, refers_to, (part, n), date)
                    bundle.add(record, page_id, said)
                    if bundle.size >= bundle_bytes:
                        yield _one(bundle)
                        number, bundle = number + 1, None
        if bundle:
            yield _one(bundle)

    def _one(bundle):
        return pa.RecordBatch.from_arrays([pa.array([bundle.end()], pa.binary())], names=["bundle"])

    bundles = plan(pages, min_bytes).mapInArrow(pack, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    bundles.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", _MAGIC.decode("latin-1")).text(folder)


def _bundles(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")


def _opened(batches) -> Iterator[tuple[str, Opened]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), Opened(batch.column(1)[k].as_py())


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All page records of a folder's bundles: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and, if wanted, ``html`` (null for revisits).

    Every payload is held against its length and digest; a bundle that doesn't fit fails.
    """

    def scan(batches):
        for _, bundle in _opened(batches):
            ends = np.append(np.searchsorted(bundle.map["frame"], np.arange(bundle.frames)), len(bundle.map))
            for k in range(bundle.frames):
                said = bundle.frame(k)
                found = [parse(said[e["offset"] : e["offset"] + e["length"]]) for e in bundle.map[ends[k] : ends[k + 1]]]
                if found := [x if payloads else (*x[:-1], None) for x in found if x]:
                    yield _rows(found)

    rows = _bundles(spark, folder).mapInArrow(scan, f"{_ROW}, payload binary").withColumn("html", F.col("payload").cast("string")).drop("payload")
    return rows if payloads else rows.drop("html")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """``path, record_id, page_id, frame, frame_start, offset, length`` of every record: where its frame starts in the file, and where it does in the frame."""

    def scan(batches):
        for path, bundle in _opened(batches):
            m = bundle.map
            pages = m["page_id"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * len(m)),
                    pa.array([f"urn:uuid:{uuid.UUID(bytes=x.ljust(16, bytes(1)))}" for x in m["record"].tolist()], pa.string()),
                    pa.array(pages, pa.int64(), mask=pages == _NO_PAGE),
                    *(pa.array(x.astype(np.int64)) for x in (m["frame"], bundle.starts[m["frame"]], m["offset"], m["length"])),
                ],
                names=["path", "record_id", "page_id", "frame", "frame_start", "offset", "length"],
            )

    return _bundles(spark, folder).mapInArrow(scan, "path string, record_id string, page_id bigint, frame bigint, frame_start bigint, offset bigint, length bigint")


def fetch(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """``record_id`` and the row of ``read`` of the records that ``ids`` (``record_id``) names; only their frames are decompressed."""
    wanted = index(spark, folder).join(ids.select("record_id").distinct(), "record_id").groupBy("path").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("wanted"))

    def scan(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                bundle, last, said = Opened(batch.column(0)[k].as_py()), -1, b""
                for e in sorted(batch.column(1)[k].as_py(), key=lambda e: (e["frame"], e["offset"])):
                    if e["frame"] != last:
                        last, said = e["frame"], bundle.frame(e["frame"])
                    if row := parse(said[e["offset"] : e["offset"] + e["length"]]):
                        rows = _rows([row])
                        yield pa.RecordBatch.from_arrays([pa.array([e["record_id"]]), *rows.columns], names=["record_id", *rows.schema.names])

    found = _bundles(spark, folder).join(wanted, "path").select("content", "wanted").mapInArrow(scan, f"record_id string, {_ROW}, payload binary")
    return found.withColumn("html", F.col("payload").cast("string")).drop("payload")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``read``'s rows, without html, of bundles written for ``pages`` in the checkpoint folder and removed again."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    place = f"{place.rstrip('/')}/bundles-{uuid.uuid4().hex}"
    try:
        write(pages, place, min_bytes)
        return read(spark, place, payloads=False).checkpoint()
    finally:
        remove(spark, place)


def oracle(min_bytes: int = 0) -> str:
    """The query's rows as DuckDB SQL; base32 from the digest's bits."""
    value = " + ".join(f"{1 << 4 - b} * CAST(substr(bits, 5 * i + {b + 1}, 1) AS INTEGER)" for b in range(5))
    return f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, CAST(octet_length(payload) AS BIGINT) AS n, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits FROM p),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM d
  WINDOW w AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {value}, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN k > 1 AND n >= {min_bytes} THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k > 1 AND n >= {min_bytes} THEN first END AS refers_to
FROM r"""
