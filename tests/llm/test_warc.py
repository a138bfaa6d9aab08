"""Bundles against the rows that they were written from, byte by byte, and against other readers of the format."""

import base64
import glob
import hashlib
import io
import random
import tempfile

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from holdfast.llm import queries, warc
from tests.conftest import DATA

SHAPE = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two é 日本 𝔘 \r\n\r\nWARC/1.1\r\n</p>"), (3, "http://a/3", "<p>one</p>"), (4, None, None), (5, "http://a b/\n5", ""),
    (6, "http://a/6", "x" * 700_000), (7, "http://a/7", "<p>one</p>"), (8, "http://a/8", "twice"), (8, "http://a/8", "twice"), (8, "http://a/0", "twice"), (9, "u", "nul \x00 byte"),
    (None, "http://n", "no id"), (None, "http://m", "no id"), (None, None, "no id"), (10, "http://a/10", "<p>one</p> "),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SHAPE).withColumns({"sha1": F.lit("clash"), "refers_to": F.lit(1)}).repartition(3)


def expected(rows, min_bytes=0):
    """(page_id, bytes, digest, kind, refers_to) by row."""
    out, left = [], list(rows)
    by = {}
    for r in left:
        by.setdefault((r[2] or "").encode(), []).append(r)
    for payload, some in by.items():
        some = sorted(some, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
        for k, r in enumerate(some):
            again = k > 0 and len(payload) >= min_bytes
            out.append((r[0], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", some[0][0] if again else None))
    return sorted(map(repr, out))


def told(df):
    return sorted(repr(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in df.collect())


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(spark, min_bytes):
    assert told(warc.round_trip(frame(spark), min_bytes)) == expected(ROWS, min_bytes)


@pytest.fixture(scope="module")
def folder(spark):
    r = random.Random(2)
    rows = [*ROWS, *((k, f"http://b/{k}", "".join(r.choices("abcdefgh <>", k=r.randint(0, 3000)))) for k in range(100, 400))]
    place = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/bundles"
    warc.write(frame(spark, rows), place, frame_bytes=4000, bundle_bytes=60_000)
    return place, rows


def test_html_comes_back(spark, folder):
    place, rows = folder
    got = warc.read(spark, place)
    assert told(got) == expected(rows)
    htmls = {(r[0], r[2] or "") for r in rows}
    assert {(r.page_id, r.html) for r in got.where("record_type = 'response'").collect()} <= htmls
    assert {r.html for r in got.where("record_type = 'revisit'").collect()} == {None}
    assert {r.url for r in got.collect() if r.page_id in (4, 5)} == {None, "http://a%20b/%0A5"}


def test_bundles_are_plain_zstandard_and_seekable(folder):
    files = [f for f in glob.glob(f"{folder[0]}/part-*") if len(open(f, "rb").read())]
    assert len(files) > 3
    for f in files:
        data = open(f, "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        opened = warc.Opened(data)
        assert opened.ends[-1] + 17 + 8 * len(opened.ends) == len(data) and opened.plain.sum() == len(plain)
        assert b"".join(opened.frame(k) for k in range(opened.frames)) == plain
        for e in opened.map:
            said = opened.record(e)
            assert said.startswith(b"WARC/1.1\r\nWARC-Type: ") and said.endswith(b"\r\n\r\n") and len(opened.frame(e["frame"])) <= max(4000, len(said))


def test_records_are_found_by_the_index(spark, folder):
    place, rows = folder
    index = warc.index(spark, place)
    pages = index.where("page_id >= 100")
    assert pages.select("record_id").distinct().count() == 300 and index.count() == len(rows) + sum(1 for r in index.collect() if r.offset == 0 and r.frame == 0)
    some = pages.where("page_id % 50 = 0").select("record_id", F.col("page_id").alias("id"))
    got = {r.record_id: r for r in warc.fetch(spark, place, some).collect()}
    html = {r[0]: r[2] for r in rows}
    assert len(got) == 6 and all(got[r.record_id].html == html[r.id] and got[r.record_id].page_id == r.id for r in some.collect())
    # by hand: one frame's bytes of the file are enough
    r = pages.first()
    with open(r.path.removeprefix("file:"), "rb") as f:
        f.seek(r.frame_start)
        said = zstandard.ZstdDecompressor().decompressobj().decompress(f.read(1 << 20))[r.offset : r.offset + r.length]
    assert warc.parse(said)[0] == r.page_id


def test_broken_bundles_fail():
    bundle = warc.Bundle((0, 0))
    good = warc.page_record(1, "u", b"text", hashlib.sha1(b"text").digest(), 4, None, (0, 1), "2020-01-01T00:00:00Z")
    bundle.add(good[0], 1, good[1])
    data = bundle.end(b"\xb1\xea\x92\x8f")
    assert warc.parse(warc.Opened(data).record(warc.Opened(data).map[1]))[6] == b"text"
    with pytest.raises(ValueError, match="magic"):
        warc.Opened(data[:-1])
    with pytest.raises(ValueError, match="digest"):
        warc.parse(good[1].replace(b"text", b"tuxt", 2))


def test_many_copies_and_empty_table(spark):
    copies = [(k, f"u{k}", "same") for k in range(500)] + [(k, "v", "") for k in range(300)]
    got = warc.round_trip(frame(spark, copies))
    assert told(got) == expected(copies) and got.where("record_type = 'response'").count() == 2
    assert warc.round_trip(frame(spark).where(F.lit(False))).count() == 0


def test_query_is_as_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/sf0.001/pages.parquet'")
    cursor = db.execute(queries.ORACLES["op11_warc"])
    names = [c[0] for c in cursor.description]
    want = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in cursor.fetchall())
    assert told(queries.op11_warc(spark, f"{DATA}/sf0.001")) == want


def test_sql_on_odd_rows():
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    rows = [r for r in ROWS if "\x00" not in (r[2] or "")]
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(map(repr, db.execute(warc.oracle()).fetchall())) == expected(rows)
