"""Near-duplicate documents by SimHash, with pigeonring filtering.

The 64 bits stand in a ring of ``SEGMENTS`` segments. If two fingerprints differ in at
most ``d`` bits, then from some segment on every chain of the next 1, 2, ... segments
differs in no more than its proportional share, ``length * d / SEGMENTS``, of bits. While
that share is below one bit the chain must be equal: these bits are the join key. The
longer chains' budgets are the join's condition, and the full distance comes last.

Equal fingerprints are one node. Keys that very many nodes share are not joined with
themselves: there each node is listed under every fingerprint one bit away, and two nodes
listed together are two bits apart at most (exact for d = 2; up to d in general by
the radius d // 2 and a check), so that the work grows with the nodes and not their pairs.
Components of the links come from alternating large and small stars.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from ._arrow import chunks, ensure_checkpoint_dir, text_only

SHINGLE, DISTANCE = 3, 2
SEGMENTS = 5
#: Nodes of a key that are compared with each other; keys with more take the way by neighbours.
DENSE = 256
#: Ids of documents to be removed that are broadcast (some 32 MB); more of them are joined by a shuffle.
FEW = 1_000_000
_KEY = "near_duplicate_key__"


def fingerprint(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of lower-cased words; none for a text without words."""
    words = text.lower().split()  # of bytes: ASCII white space and A-Z
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    parts = zip(*(words[k:] for k in range(shingle)), strict=False)
    return np.fromiter((digest(b" ".join(p), 42) for p in parts), np.uint64, len(words) - shingle + 1)


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes: bits set in over half of them."""
    size = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        every = np.concatenate([hashes[k] for k in some])
        start = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        bits = np.unpackbits(every.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > size[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and its 64-bit fingerprint as a signed long, for every row."""

    def scan(batches):
        for batch in chunks(batches, limit=1 << 20):
            hashes = [fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_majority(hashes).view(np.int64))], names=["doc_id", "fp"])

    return text_only(docs, "doc_id").mapInArrow(scan, "doc_id bigint, fp bigint")


def _masks(segments: int) -> list[int]:
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")


def _chain(segments: int, start: int, length: int) -> int:
    m = _masks(segments)
    return reduce(lambda a, k: a | m[(start + k) % segments], range(length), 0)


def links(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """``a, b``: pairs of nodes (``node, fp``, distinct fingerprints) that connect all nodes at most ``distance`` bits apart.

    Every pair linked directly is within the distance; a pair within it is linked
    directly or through others.
    """
    if not 0 < distance < segments:
        raise ValueError("distance must be over 0 and below the number of segments")
    equal = max(k for k in range(1, segments) if k * distance < segments)
    keyed = nodes.select(
        "node",
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("turn"), F.col("fp").bitwiseAND(_long(_chain(segments, k, equal))).alias("key")) for k in range(segments)])
        ).alias("k"),
    ).select("node", "fp", "k.turn", "k.key")
    crowded = keyed.groupBy("turn", "key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("turn", "key").checkpoint()
    plain = keyed.join(crowded, ["turn", "key"], "left_anti")
    x, y = plain.alias("x"), plain.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    # the chains' budgets, one condition for each turn and length
    ok = F.lit(False)
    for k in range(segments):
        budget = [F.bit_count(differ.bitwiseAND(_long(_chain(segments, k, n)))) <= n * distance // segments for n in range(equal + 1, segments + 1)]
        ok = ok | ((F.col("x.turn") == k) & reduce(lambda a, b: a & b, budget))
    near = x.join(y, (F.col("x.turn") == F.col("y.turn")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & ok)
    near = near.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return near.unionByName(_by_neighbours(keyed.join(crowded, ["turn", "key"], "left_semi"), distance)).distinct()


def _by_neighbours(rows: DataFrame, distance: int) -> DataFrame:
    """Links among crowded keys' nodes: nodes with a common fingerprint ``distance / 2`` bits away.

    For an odd distance one of both sides is listed one bit further out.
    """
    flips = [1 << k for k in range(64)]

    def around(radius: int) -> Column:
        out = [F.col("fp")]
        if radius >= 1:
            out += [F.col("fp").bitwiseXOR(_long(f)) for f in flips]
        if radius >= 2:
            out += [F.col("fp").bitwiseXOR(_long(f | g)) for i, f in enumerate(flips) for g in flips[:i]]
        return F.explode(F.array(*out))

    if distance > 4:
        raise ValueError("crowded keys are handled up to a distance of 4")
    rows = rows.select("node", "fp").distinct()
    half = rows.select("node", "fp", around(distance // 2).alias("z"))
    if distance % 2 == 0:
        first = half.groupBy("z").agg(F.min("node").alias("a"))
        return half.join(first, "z").where("a < node").select("a", F.col("node").alias("b"))
    wide = rows.select("node", "fp", around(distance // 2 + 1).alias("z"))
    met = half.join(wide.select("z", F.col("node").alias("other"), F.col("fp").alias("fp2")), "z")
    met = met.where((F.col("node") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance))
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of all nodes of ``edges`` (``a, b``), by alternating stars."""
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct().checkpoint()
    before = None
    while True:
        # large star: neighbours above a node move to the smallest in its neighbourhood
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: neighbours below a node, and the node, move to the smallest of them
        least = now.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = now.join(least, "hi")
        now = moved.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct().checkpoint()
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        before = mark


#: Components of texts without any doc_id lie beyond this; they are shown as null.
_NAMELESS = (1 << 63) - 1 - (1 << 40)


def _lead(key: str) -> Column:
    """The smallest doc_id of a group of equal texts; one of its own, beyond all others, if none has any."""
    return F.coalesce(F.min("doc_id"), F.lit(_NAMELESS + 1) + F.pmod(F.xxhash64(key), F.lit(1 << 40)))


def _shown(component: Column) -> Column:
    return F.when(component <= _NAMELESS, component).alias("component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    ``component_id`` is the smallest doc_id that can be reached over fingerprints at most
    ``distance`` bits apart, its own included. Texts without words have fingerprint zero
    and link like others; null text is empty. Repeated rows give repeated result rows,
    and other columns are not used. A row whose doc_id is null takes part in linking; the
    component is null where no id can be reached.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    fps = fingerprints(docs, shingle).checkpoint()
    nodes = fps.groupBy("fp").agg(_lead("fp").alias("node")).checkpoint()
    found = components(links(nodes, distance))
    named = nodes.join(found, "node", "left").select("fp", _shown(F.coalesce("component", "node")))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _set_prints(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fingerprints of sets of shingle hashes; zero for an empty set."""
    return _majority(np.split(key, np.cumsum(size)[:-1])) if len(size) else np.zeros(0, np.uint64)


def near_copies(docs: DataFrame, shingle: int = jaccard.SHINGLE, distance: int = DISTANCE, similarity: tuple[int, int] = jaccard.SIMILARITY) -> DataFrame:
    """``doc_id, set, component_id`` for every row, complete for texts of a Jaccard similarity of ``similarity`` or more.

    Texts are sets of shingles, and a set's fingerprint the majority of its shingles' hashes.
    Links are fingerprints at most ``distance`` bits apart, and all pairs of similar
    sets (``jaccard``); both make up the same components. Otherwise as ``near_duplicates``.
    """
    ensure_checkpoint_dir(docs.sparkSession)

    def scan(batches):
        for batch in chunks(batches, limit=1 << 19):
            key, row, size = jaccard.shingles(batch.column(1), shingle)
            sketch = jaccard.sketches(key, row, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(jaccard.set_ids(key, size)), pa.array(_set_prints(key, size).view(np.int64)), *map(pa.array, np.ascontiguousarray(sketch.T))],
                names=["doc_id", "set", "fp", *jaccard.SKETCH],
            )

    said = "".join(f", {c} bigint" for c in jaccard.SKETCH)
    rows = text_only(docs, "doc_id").mapInArrow(scan, f"doc_id bigint, set bigint, fp bigint{said}").checkpoint()
    sets = rows.groupBy("set").agg(_lead("set").alias("lead"), *[F.first(c).alias(c) for c in ("fp", *jaccard.SKETCH)]).checkpoint()
    prints = sets.groupBy("fp").agg(F.min("lead").alias("node")).checkpoint()

    def named(pairs: DataFrame) -> DataFrame:
        ends = (sets.select(F.col("set").alias(k), F.col("lead").alias(f"{k}_lead")) for k in ("a", "b"))
        return pairs.join(next(ends), "a").join(next(ends), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))

    join = jaccard.Join(docs, shingle, similarity)
    edges = links(prints, distance).unionByName(named(join.first(sets)))
    edges = edges.unionByName(sets.join(prints, "fp").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    found = components(edges)
    labels = sets.join(found.withColumnRenamed("node", "lead"), "lead", "left").select("set", F.coalesce("component", "lead").alias("component"), *jaccard.SKETCH).checkpoint()
    more = join.rest(labels)
    ends = (labels.select(F.col("set").alias(k), F.col("component").alias(f"{k}_part")) for k in ("a", "b"))
    more = more.join(next(ends), "a").join(next(ends), "b").select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))
    merged = components(more).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    final = labels.join(merged, "component", "left").select("set", _shown(F.coalesce("merged", "component")))
    return rows.join(final, "set").select("doc_id", "set", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, similarity: tuple[int, int] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: one row of each component's smallest doc_id stays.

    With a ``similarity``, components are those of ``near_copies``. Rows repeated with one
    doc_id count as one document: the row of the smallest text stays. A row without a
    doc_id goes where its component has an id, else it stays. Null and empty texts are
    near-duplicates of each other; an empty table stays empty.

    Only ids are joined, broadcast while they are at most ``FEW``: the texts are not
    shuffled then, and else by their own doc_id.
    """
    found = (near_copies(docs, shingle, distance, similarity) if similarity else near_duplicates(docs, shingle, distance).withColumnRenamed("fp", "set")).checkpoint()
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("many"), F.min("component_id").alias("component_id"))
    # of an id whose rows are in several components, the row that stays is that of the smallest one
    moved = ids.where("many > 1 or doc_id <> component_id").select("doc_id", F.expr("many > 1 and doc_id = component_id").alias("again")).checkpoint()
    few = F.broadcast if moved.count() <= FEW else lambda t: t
    out = docs.where("doc_id is not null").join(few(moved.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    again = moved.where("again").select("doc_id")
    if not again.isEmpty():
        whole = F.struct(*[F.col(c) for c in docs.columns])
        one = docs.join(few(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("row"))
        out = out.unionByName(one.select("row.*"))
    nameless = found.where("doc_id is null and component_id is not null").select("set").distinct()
    if not nameless.isEmpty():
        out = out.unionByName(_without(docs.where("doc_id is null"), nameless, shingle, bool(similarity)))
    else:
        out = out.unionByName(docs.where("doc_id is null"))
    return out


def _without(docs: DataFrame, gone: DataFrame, shingle: int, sets: bool) -> DataFrame:
    """Rows whose set (or fingerprint) isn't among some."""
    names = docs.columns
    where = names.index("text")

    def scan(batches):
        import pyarrow.compute as pc

        for batch in chunks(batches):
            text = pc.fill_null(batch.column(where), "")
            if sets:
                key, _, size = jaccard.shingles(text, shingle)
                ids = jaccard.set_ids(key, size)
            else:
                ids = _majority([fingerprint(t, shingle) for t in text.cast(pa.binary()).to_pylist()]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=[*names, _KEY])

    named = docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(_KEY, T.LongType())]))
    return named.join(gone.withColumnRenamed("set", _KEY), _KEY, "left_anti").select(*names)
