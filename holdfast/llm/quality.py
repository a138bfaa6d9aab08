"""Quality of texts by a regularised quadratic discriminant.

Statistics of each text (shares of character classes, word lengths, repetition, lines)
are transformed to be nearer to normal. Each class has a mean and a covariance, shrunk
towards the pooled one and towards its diagonal; the score is the logistic of the
difference of the classes' log-densities, by Mahalanobis distances through the
covariances' Cholesky factors, which are computed once and sent with the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER, RangeHash, chunks, ensure_checkpoint_dir, text_only, utf8, words

#: Score at which a document counts as good.
ACCEPT = 0.3
#: Labelled documents that are learned from, by their hash (about so many, or all if there are fewer).
TRAIN_DOCS = 200_000
#: Weight of the pooled covariance, of its diagonal, and the scale of the log-density difference.
POOL, DIAGONAL, TEMPER = 0.7, 0.1, 1.0

FEATURES = (
    "log_chars", "upper", "digit", "space", "newline", "bang", "bar", "symbol", "stop", "comma", "beyond_ascii",
    "log_words", "word_length", "long_words", "distinct", "same_as_last", "distinct_triples", "line_length", "repeated_lines", "short_lines",
)

_CLASSES = np.zeros((256, 10), dtype=bool)
for _k, _chars in enumerate((range(65, 91), range(48, 58), (32, 9), (10,), b"!", b"|", b"#$%&*+<=>@[]^_{}~/\\", b".?;:", b",", range(128, 256))):
    _CLASSES[list(_chars), _k] = True
_CLASS = np.where(_CLASSES.any(1), _CLASSES.argmax(1), 10).astype(np.int64)


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys in each row."""
    mixed = keys ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    mixed, row = mixed[order], row[order]
    new = np.ones(len(mixed), bool)
    new[1:] = mixed[1:] != mixed[:-1]
    return np.bincount(row[new], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text; finite for every input, empty ones too."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row_of = np.repeat(np.arange(n), size)
    share = np.bincount(row_of * 11 + _CLASS[data], minlength=n * 11).reshape(n, 11)[:, :10] / np.maximum(size, 1)[:, None]
    low = LOWER[data]
    start, end, before = words(low, offsets)
    count = np.diff(before)
    row, some = np.repeat(np.arange(n), count), np.maximum(count, 1)
    length = end - start
    key = RangeHash(low)(start, end)
    mean = np.bincount(row, weights=length, minlength=n) / some
    long = np.bincount(row, weights=length > 12, minlength=n) / some
    near = np.zeros(len(key), bool)
    for back in (1, 2, 3):
        if len(key) > back:
            near[back:] |= (key[back:] == key[:-back]) & (row[back:] == row[:-back])
    near = np.bincount(row, weights=near, minlength=n) / some
    distinct = _distinct(key, row, n) / some
    if len(key) > 2:
        three = key[:-2] * np.uint64(3) + key[1:-1] * np.uint64(0x9E3779B97F4A7C15) ^ key[2:]
        inside = row[:-2] == row[2:]
        triples = np.where(count > 2, _distinct(three[inside], row[:-2][inside], n) / np.maximum(count - 2, 1), 1.0)
    else:
        triples = np.ones(n)
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    # lines run from just after a break, or a row's start, to the next break or the row's end
    starts = np.sort(np.concatenate([breaks + 1, offsets[:-1]]))
    of = np.repeat(np.arange(n), 1 + np.bincount(row_of[breaks], minlength=n)) if len(breaks) else np.arange(n)
    lines = np.bincount(of, minlength=n)
    repeated = 1 - _distinct(RangeHash(data)(starts, ends), of, n) / lines
    short = np.bincount(of, weights=(ends - starts) < 30, minlength=n) / lines
    root = np.sqrt(share)
    return np.column_stack(
        [np.log1p(size), root, np.log1p(count), np.log1p(mean), np.sqrt(long), distinct, np.sqrt(near), triples, np.log1p(size / lines), np.sqrt(repeated), np.sqrt(short)]
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are not learned from; those without a doc_id are among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id`` and ``x`` for every row, null text as empty."""

    def scan(batches):
        for batch in chunks(batches):
            x = statistics(*utf8(batch.column(1)))
            flat = pa.array(x.ravel(), pa.float64())
            x = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    return text_only(docs, "doc_id").mapInArrow(scan, "doc_id bigint, x array<double>")


class Model:
    """Means, log-determinants and inverse Cholesky factors of both classes."""

    def __init__(self, n: np.ndarray, total: np.ndarray, outer: np.ndarray, pool: float = POOL, diagonal: float = DIAGONAL):
        d = total.shape[1]
        n = n + 1e-9
        self.known = bool((n > 1).all())
        mean = total / n[:, None]
        scatter = outer - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / max(n.sum() - 2, 1)
        self.prior = float(np.log(n[1] / n[0])) if self.known else 0.0
        self.parts = []
        for k in (0, 1):
            c = (1 - pool) * scatter[k] / max(n[k] - 1, 1) + pool * pooled
            c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-5 * np.eye(d)
            factor = np.linalg.cholesky(c)
            self.parts.append((mean[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        logs = [-0.5 * (np.square((x - m) @ inverse.T).sum(1) + det) for m, inverse, det in self.parts]
        return 1 / (1 + np.exp(np.clip(-(TEMPER * (logs[1] - logs[0]) + self.prior), -500, 500)))


def known(labels: DataFrame, sample: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, quality`` that are learned from: labels of 0 or 1, not held out, some ``sample`` of them by hash; small enough to broadcast."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out())
    share = min(1.0, sample / max(1, rows.count()))
    return F.broadcast(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(share * (1 << 31))))


def train(rows: DataFrame, labels: DataFrame) -> Model:
    """From features and what is ``known`` of their documents.

    The classes' counts, sums and products are added up by Spark; a fixed number of them
    comes to the driver. Repeated labels of a document count as often as they occur.
    With fewer than two rows of a class every score is 0.5.
    """
    d = len(FEATURES)

    def scan(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    z = x[y == k]
                    sums[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.ravel())], names=["at", "v"])

    joined = rows.join(labels, "doc_id").select("x", "quality")
    sums = np.zeros(2 * (1 + d + d * d))
    for r in joined.mapInArrow(scan, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r["v"]
    sums = sums.reshape(2, -1)
    return Model(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns ``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Texts are read once: their statistics are checkpointed, then learned from and scored.
    Null texts are scored as empty ones, repeated rows alike; a row without a doc_id is
    held out. Other columns are not used; an empty table gives no rows.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = features(docs).checkpoint()
    model = train(rows, known(labels))

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = rows.select("doc_id", "x").mapInArrow(scan, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``accept``; texts aren't shuffled.

    Only labelled texts are learned from; each row is then judged by its text alone: null
    texts as empty ones, repeated rows alike, rows without a doc_id too. An empty table
    stays empty.
    """
    labels = known(labels)
    model = train(features(docs.join(labels.select("doc_id"), "doc_id", "left_semi")), labels)
    where = docs.columns.index("text")

    def scan(batches):
        import pyarrow.compute as pc

        for batch in chunks(batches):
            yield batch.filter(pa.array(model.score(statistics(*utf8(pc.fill_null(batch.column(where), "")))) >= accept))

    return docs.mapInArrow(scan, docs.schema)
