"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

Every token of either tokenizer is a byte interval of space + text. A chunk's intervals
are sorted by start (``lexsort``), their ends accumulated to a running maximum, and a
group breaks where a start reaches that maximum: there both tokenizers end a token.
Within the groups, overlapping pairs are expanded from each A token's range of B tokens,
which are at most as many as the tokens; those that end together are the links.

A link's shorter token is a suffix of the longer one, so the id pairs that can ever be
linked are given by the two vocabularies (a few hundred thousand for the usual ones,
``possible_links``), however large the corpus is: their counts may be broadcast.

Texts are encoded by the tokenizers' own libraries. A text is cut before single spaces
and line breaks between visible characters, where neither tokenizer has a token across;
what lies between two cuts is encoded once and remembered, up to ``REMEMBERED`` of them.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import chunks, ensure_checkpoint_dir, text_only

#: Units (a word and what touches it) that a worker remembers, and how many are encoded at once.
REMEMBERED, AT_ONCE = 600_000, 4096

#: Before a single space or line break between visible characters; other white space stays within a unit.
_CUT = re.compile(r"""(?=[ \n][\w('"])(?<=[\w.,;:!?)'"])""")
#: Units after which, and before which, such a cut may be.
_FOLLOWS = re.compile(r"""[ \n](?=[\w('"]).*[\w.,;:!?)'"]\Z""", re.S)
_SPACE = "▁"


class Files(NamedTuple):
    """Contents of the tokenizers' files, as they are sent to tasks."""

    a: str
    b: bytes

    @classmethod
    def read(cls, a: str | None = None, b: str | None = None) -> Files:
        """From paths on the driver; the installed public vocabularies unless given."""
        if a is None or b is None:
            import public_tokenizers

            a, b = a or str(public_tokenizers.path("byte_bpe_50k.json")), b or str(public_tokenizers.path("piece_bpe_32k.model"))
        with open(a, encoding="utf-8") as fa, open(b, "rb") as fb:
            return cls(fa.read(), fb.read())


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


#: The byte-level tokenizer's own pattern (fixed), and characters whose classes no version of Unicode has changed.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATER = re.compile(r"[^\x00-\u024f]")
#: Units that are encoded as one text.
_JOINED = 64


class Pair:
    """Both tokenizers, and every id's bytes."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=files.b)
        byte = _byte_of_char()
        self.a_bytes, special = [b""] * self.a.get_vocab_size(), {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        for said, i in self.a.get_vocab().items():
            self.a_bytes[i] = special[i].encode() if i in special else bytes(byte[c] for c in said)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(_SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: No B piece goes on across a space after another character, or a line break, so units can be encoded by themselves.
        self.cut = not any(re.search(rf"[^{_SPACE}]{_SPACE}|\n", p) for p in pieces)
        self.ranked = self._ranked(json.loads(files.a), special)

    def _ranked(self, said: dict, special: dict[int, str]):
        """The same byte pairs by rank, if ids are in the order of the merges: much faster, for characters whose classes are settled."""
        model, before = said["model"], said["pre_tokenizer"] or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        first = len(model["vocab"]) - len(pairs)
        if said["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or any(model["vocab"][x + y] != first + k for k, (x, y) in enumerate(pairs)):
            return None
        import tiktoken

        return tiktoken.Encoding("pairs", pat_str=_SPLIT, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes) if i not in special}, special_tokens={})

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units that start with a space, which B puts there itself, or a line break, before which B's space goes again."""
        if self.ranked and not any(map(_LATER.search, units)):
            a = [self.ranked.encode_ordinary(u) for u in units]
        else:
            a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        b = self.b.encode([u[u[0] == " " :] for u in units], num_threads=1)
        return a, [ids[u[0] != " " :] for u, ids in zip(units, b, strict=True)]

    def encode_joined(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """As ``encode``; units that may follow each other in a text are encoded as one, and its ids cut where they end."""
        if len(units) > 1 and self.cut and all(map(_FOLLOWS.match, units)):
            (a,), (b,) = self.encode(["".join(units)])
            ends = np.cumsum([len(u.encode()) for u in units])
            at = [(np.cumsum(size[ids]), ids) for size, ids in ((self.a_size, a), (self.b_size, b))]
            cuts = [np.searchsorted(end, ends) + 1 for end, _ in at]
            if all(len(end) == c[-1] and (end[c - 1] == ends).all() for (end, _), c in zip(at, cuts, strict=True)):
                return tuple([ids[i:j] for i, j in zip([0, *c[:-1].tolist()], c.tolist(), strict=True)] for (_, ids), c in zip(at, cuts, strict=True))
        return self.encode(units)

    def possible_links(self) -> int:
        """Id pairs of which one's bytes end with the other's."""
        a, b = ({x: sum(y == x for y in (side if len(x) == 1 else ())) or 1 for x in side if x} for side in (self.a_bytes, self.b_bytes))
        tails = lambda x: (x[k:] for k in range(len(x)))
        return sum(b.get(t, 0) for x in self.a_bytes for t in tails(x)) + sum(a.get(t, 0) for x in self.b_bytes for t in tails(x) if t != x)


class Alignment(NamedTuple):
    """Of tokens in order: the group of each A and each B token, and the overlapping pairs."""

    group_a: np.ndarray
    group_b: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray
    #: which overlaps end together
    linked: np.ndarray


def coalesce(size_a: np.ndarray, size_b: np.ndarray) -> Alignment:
    """Groups and overlaps of two ways to cut the same bytes, given the tokens' lengths in order."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    start_a, start_b = end_a - size_a, end_b - size_b
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    count = high - low
    over_a = np.repeat(np.arange(len(count)), count)
    over_b = np.arange(len(over_a)) - np.repeat(np.cumsum(count) - count - low, count)
    return Alignment(group[: len(size_a)], group[len(size_a) :], over_a, over_b, end_a[over_a] == end_b[over_b])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions of the ranges that start somewhere and are so long."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


class _Side:
    """One tokenizer's ids of the remembered units, end to end."""

    def __init__(self, spelled: list[bytes], size: np.ndarray):
        self.spelled, self.size = spelled, size
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def keep(self, at: np.ndarray) -> None:
        """Only these units stay, in this order."""
        self.ids, count = self.of(at)
        self.ends = np.concatenate([[0], np.cumsum(count)])

    def learn(self, found: list[list[int]]) -> None:
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units' ids, and how many each has."""
        count = self.ends[at + 1] - self.ends[at]
        return self.ids[_ranges(self.ends[at], count)], count


class Aligner:
    """What a worker needs to align chunks of texts, with what it remembers."""

    def __init__(self, files: Files):
        self.pair = Pair(files)
        self.a, self.b = _Side(self.pair.a_bytes, self.pair.a_size), _Side(self.pair.b_bytes, self.pair.b_size)
        self.width = len(self.pair.b_bytes)
        self.known: dict[str, int] = {}
        #: by unit: whether both tokenizers give it back, and the number of chunks that had it since others were forgotten
        self.good, self.chunks = np.zeros(0, bool), np.zeros(0, np.int32)
        #: every id with each of the marks that can follow it
        self.said = [f"{i}{mark}" for n in (len(self.pair.a_bytes), self.width) for i in range(n) for mark in ("", ",", "|", ";")]

    def _learn(self, units: list[str]) -> None:
        for k in range(0, len(units), AT_ONCE):
            some = units[k : k + AT_ONCE]
            found = [self.pair.encode_joined(some[i : i + _JOINED]) for i in range(0, len(some), _JOINED)]
            a, b = ([ids for part in found for ids in part[side]] for side in (0, 1))
            good = np.empty(len(some), bool)
            for i, u in enumerate(some):
                want = u.encode()
                good[i] = b"".join(map(self.a.spelled.__getitem__, a[i])) == want and b"".join(map(self.b.spelled.__getitem__, b[i])) == want
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
            self.good, self.chunks = np.concatenate([self.good, good]), np.concatenate([self.chunks, np.zeros(len(some), np.int32)])
            self.a.learn(a)
            self.b.learn(b)

    def _forget(self) -> None:
        """Units of one chunk alone go, or all if that isn't half of them."""
        stay = np.flatnonzero(self.chunks > 1)
        if len(stay) > REMEMBERED // 2:
            stay = stay[:0]
        names = list(self.known)
        self.known = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.good, self.chunks = self.good[stay], np.zeros(len(stay), np.int32)
        self.a.keep(stay)
        self.b.keep(stay)

    def units(self, text: str) -> list[str]:
        return [] if not text else _CUT.split(" " + text) if self.pair.cut else [" " + text]

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """By text: number of A tokens, B tokens and groups, the groups, number of links; then all links."""
        split = [self.units(t) for t in texts]
        new = set(chain.from_iterable(split)) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = set(chain.from_iterable(split)) - self.known.keys()
        self._learn(sorted(new))
        number = np.array([len(u) for u in split], np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, number.sum())
        self.chunks[np.unique(at)] += 1
        text_of = np.repeat(np.arange(len(texts)), number)
        whole = np.ones(len(texts), bool)
        whole[text_of[~self.good[at]]] = False
        at, text_of = at[whole[text_of]], text_of[whole[text_of]]
        ids_a, count_a = self.a.of(at)
        ids_b, count_b = self.b.of(at)
        n_a, n_b = (np.bincount(text_of, c, len(texts)).astype(np.int64) for c in (count_a, count_b))
        found = coalesce(self.a.size[ids_a], self.b.size[ids_b])
        groups = np.bincount(np.repeat(text_of, count_a)[_last_of(found.group_a)], minlength=len(texts))
        link_a, link_b = found.over_a[found.linked], found.over_b[found.linked]
        links = ids_a[link_a].astype(np.int64) * self.width + ids_b[link_b]
        n_links = np.bincount(np.repeat(text_of, count_a)[link_a], minlength=len(texts))
        return n_a, n_b, groups, self._say(ids_a, ids_b, found, n_a + n_b), n_links, links

    def _say(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, size: np.ndarray) -> list[str]:
        """Each text's groups, as ``a1,a2|b1;a3|b2,b3``."""
        key = np.concatenate([2 * found.group_a, 2 * found.group_b + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        step = np.diff(key)
        # the next token is of the same group and side, of the same group's other side, of another group
        mark = np.append(np.where(step == 0, 1, np.where(key[1:] & 1, 2, 3)), 0)
        ends = np.cumsum(size)
        mark[ends[size > 0] - 1] = 0
        code = 4 * np.concatenate([ids_a, ids_b + len(self.pair.a_bytes)])[order].astype(np.int64) + mark if len(order) else order
        said = list(map(self.said.__getitem__, code.tolist()))
        return ["".join(said[e - n : e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]


def _last_of(group: np.ndarray) -> np.ndarray:
    """Where groups end."""
    return np.flatnonzero(np.append(np.diff(group) > 0, True)) if len(group) else np.zeros(0, np.int64)


#: The aligner of a worker lives on between its tasks.
_KEPT: dict[int, Aligner] = {}


def alignments(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, links``: how the two tokenizers' tokens of each text correspond.

    ``groups`` lists ids as ``a1,a2|b1;a3|b2,b3``; ``links`` has one number a link, A's id
    times B's vocabulary size plus B's id (``link_ids`` takes it apart). One row per input
    row. Null and empty texts, and those that a tokenizer doesn't give back byte for byte
    (as it normalises them), have no tokens: zeros, no groups, no links. Other columns are
    not used; an empty table stays empty. A map over partitions, without a shuffle; a
    worker holds one chunk of texts and ``REMEMBERED`` units.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(files or Files.read())

    def scan(batches):
        kept = hash(shared.value)
        if kept not in _KEPT:
            _KEPT.clear()
            _KEPT[kept] = Aligner(shared.value)
        for batch in chunks(batches):
            n_a, n_b, groups, said, n_links, links = _KEPT[kept].align(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(n_links)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups)),
                    pa.array(said, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(links, pa.int64())),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
            )

    return text_only(docs, "doc_id").mapInArrow(scan, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, links array<bigint>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """``link, n``: how often each id pair is linked; bounded by the vocabularies."""
    return aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))


def link_ids(files: Files) -> int:
    """The number that a link is divided by: quotient and remainder are A's and B's id."""
    return len(Pair(files).b_bytes)


def score_links(aligned: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` (links whose count is the highest of their B id) and ``count_sum`` for ``links``."""
    table = counts.toArrow()
    link, n = table.column("link").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(link)
    link, n = link[order], n[order]
    most = np.zeros(width, np.int64)
    np.maximum.at(most, link % width, n)
    shared = aligned.sparkSession.sparkContext.broadcast((link, n, n == most[link % width]))
    others = [c for c in aligned.columns if c != "links"]

    def scan(batches):
        link, n, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("links"))
            size = np.diff(lists.offsets.to_numpy())
            row, at = np.repeat(np.arange(len(size)), size), np.searchsorted(link, lists.flatten().to_numpy())
            total = np.zeros(len(size), np.int64)
            np.add.at(total, row, n[at])
            figures = [size.astype(np.int64), np.bincount(row[best[at]], minlength=len(size)), total]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), *(pa.array(x, pa.int64()) for x in figures)], names=[*others, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {k}" for c, k in aligned.dtypes if c != "links")
    return aligned.mapInArrow(scan, f"{kinds}, n_links bigint, n_best bigint, count_sum bigint")


def aligned_documents(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum`` of every row of ``docs``.

    As ``alignments``; ``groups_sha256`` is empty where there are no tokens. What a text's
    links are is checkpointed between their counting and their scoring.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    files = files or Files.read()
    found = alignments(docs, files)
    said = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found = found.select("doc_id", "n_a", "n_b", "n_groups", said, "links").checkpoint()
    return score_links(found, link_counts(found), link_ids(files))
