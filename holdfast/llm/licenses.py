"""License statements: an exact set-similarity join of text blocks with templates.

Blocks are all windows of consecutive words twice as long as the template, across line
breaks. A block matches when it holds at least ``threshold`` of the template's distinct
words. Words are ordered by their frequency over all documents, rarest first, and three
filters prune pairs without losing one:

prefix      a matching block shares a word with the first ``n - need + 1`` words of the template;
length      the words around a shared one that a block can hold are at least ``need``;
positional  what can still follow the first shared word, in either, makes up ``need``.

What is left is checked by counting in a sliding window; that a window holds the threshold
is the join's result (``contained``). The labels are chosen from it: the window must hold the
words that name the license (``NAMES``), and of matches that overlap only the fullest one
counts. Templates are few and fixed, so their index is broadcast; the documents are mapped
without a shuffle.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import LOWER, RangeHash, chunks, hash_bytes, text_only, utf8, words

THRESHOLD = 0.8

# Phrases of the base labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Statements that licenses are named or granted by.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved"),
]
# Words that name a license. Of these, a block holds all that the template has.
NAMES = {
    "mit": "mit", "apache-2": "apache 2", "cc-by-nc": "cc by nc noncommercial", "cc-by": "attribution", "cc-by-sa": "sharealike",
    "gpl-3": "gnu 3", "bsd": "redistribution", "mpl-2": "mozilla 2", "proprietary": "all rights reserved",
}

_SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, contained string"


class Taken:
    """Ranges of words, both ends in them, joined where they meet."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, b) - 1
        return k >= 0 and self.ends[k] >= a

    def add(self, a: int, b: int) -> None:
        i, j = bisect_left(self.ends, a), bisect_right(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


def frequencies(docs: DataFrame, wanted: list[str]) -> dict[str, int]:
    """Occurrences of the wanted words over all documents; one row a word comes to the driver."""
    hashes = hash_bytes([w.encode() for w in wanted])
    order = np.argsort(hashes)
    table = hashes[order]

    def scan(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in chunks(batches):
            data, offsets = utf8(batch.column(0))
            data = LOWER[data]
            start, end, _ = words(data, offsets)
            h = RangeHash(data)(start, end)
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            total += np.bincount(at[table[at] == h], minlength=len(table))
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array(total, pa.int64())], names=["word", "n"])

    out = text_only(docs).mapInArrow(scan, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {wanted[r.word]: r.n for r in out}


class Index:
    """Templates with their words rarest first, and the prefixes' inverted lists."""

    def __init__(self, templates: list[tuple[str, str]], seen: dict[str, int], threshold: float):
        universe = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (seen.get(w, 0), w))
        self.rank = {w.encode(): k for k, w in enumerate(universe)}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted({self.rank[w.encode()] for w in t.split()}) for _, t in templates]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.width = [2 * len(t.split()) for _, t in templates]
        self.named = [{self.rank[w.encode()] for w in NAMES.get(label, "").split() if w in t.split()} for label, t in templates]
        self.lists: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            for i, w in enumerate(s[: len(s) - self.need[t] + 1]):
                self.lists.setdefault(w, []).append((t, i))
        self.probe = np.sort(hash_bytes([w for w, k in self.rank.items() if k in self.lists]))

    def regions(self, hits: np.ndarray, first: int, end: int) -> list[tuple[int, int]]:
        """Ranges of words that windows around the hits cover, joined where they meet."""
        wide = max(self.width)
        cut = np.flatnonzero(np.diff(hits) >= 2 * wide)
        lo, hi = hits[np.append(0, cut + 1)], hits[np.append(cut, len(hits) - 1)]
        return list(zip(np.maximum(first, lo - wide + 1).tolist(), np.minimum(end, hi + wide).tolist(), strict=True))

    def match(self, block: list[bytes], hits: list[int]) -> tuple[list[tuple[int, int, int, int]], set[int]]:
        """(shared words, template, first word, last word) of the fullest matches, and all templates contained; ``hits`` are the places of words of the lists."""
        places: dict[int, list[int]] = {}
        for i in hits:
            for t, _ in self.lists.get(self.rank.get(block[i], -1), ()):
                places.setdefault(t, []).append(i)
        out, contained = [], set()
        for t, at in places.items():
            wide, end = self.width[t], -1
            for n, i in enumerate(at):
                if n and i - at[n - 1] < wide:
                    end = min(len(block), i + wide)
                    continue
                if n:
                    out += self._windows(block, t, start, end, contained)
                start, end = max(0, i - wide + 1), min(len(block), i + wide)
            out += self._windows(block, t, start, end, contained)
        fullest = lambda f: (f[0], f[0] / len(self.sets[f[1]]))
        kept: list[tuple[int, int, int, int]] = []
        fuller = Taken()
        for _, some in groupby(sorted(out, key=fullest, reverse=True), fullest):
            own = [f for f in some if not fuller.meets(f[2], f[3])]
            for f in own:
                fuller.add(f[2], f[3])
            kept += own
        return kept, contained

    def _windows(self, block: list[bytes], t: int, start: int, end: int, contained: set[int]) -> list[tuple[int, int, int, int]]:
        """Matches of one template among some words, the fullest and shortest of those that overlap; ``contained`` gets it if some window holds the threshold."""
        own, need, get = set(self.sets[t]), self.need[t], self.rank.get
        here = [(i, w) for i in range(start, end) if (w := get(block[i])) in own]
        mine = sorted({w for _, w in here})
        if len(mine) < need:
            return []
        j, i = mine[0], self.sets[t].index(mine[0])
        if min(len(self.sets[t]) - i, sum(w >= j for w in mine)) < need:
            return []
        many: dict[int, int] = {}
        found, left = [], 0
        for k, w in here:
            many[w] = many.get(w, 0) + 1
            while k - here[left][0] >= self.width[t] or many[here[left][1]] > 1:
                v = here[left][1]
                many[v] -= 1
                if not many[v]:
                    del many[v]
                left += 1
            if len(many) >= need:
                contained.add(t)
                if self.named[t] <= many.keys():
                    found.append((len(many), t, here[left][0], k))
        found.sort(key=lambda f: (-f[0], f[3] - f[2]))
        out, taken = [], Taken()
        for f in found:
            if not taken.meets(f[2], f[3]):
                taken.add(f[2], f[3])
                out.append(f)
        return out


def license_labels(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """License labels of every document's whole text.

    One row per input row; an empty table stays empty. Null and empty texts have no words
    and no labels; ``score`` is the largest containment of a matching template, 1 with a
    base phrase, else 0. ``contained`` has the labels of all templates that some block
    contains to the threshold, whether or not they are chosen. Other columns are not used.
    """
    index = Index(templates, frequencies(docs, sorted({w for _, t in templates for w in t.split()})), threshold)
    phrases = [([w.encode() for w in p.split()], label) for p, label in PHRASES]
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches):
        ix = shared.value
        keys = [hash_bytes(p) for p, _ in phrases]
        for batch in chunks(batches):
            n = batch.num_rows
            data, offsets = utf8(batch.column(1))
            data = LOWER[data]
            start, end, before = words(data, offsets)
            h = RangeHash(data)(start, end)
            row = np.repeat(np.arange(n), np.diff(before))
            count, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            base: dict[int, set[str]] = {}
            for (p, label), key in zip(phrases, keys, strict=True):
                at = np.arange(max(0, len(h) - len(p) + 1))
                for k in range(len(p)):
                    at = at[h[at + k] == key[k]]
                for i in at:
                    r = row[i]
                    if row[i + len(p) - 1] == r and [data[start[i + k] : end[i + k]].tobytes() for k in range(len(p))] == p:
                        w = i - before[r]
                        count[r] += 1
                        first[r] = w if first[r] < 0 else min(first[r], w)
                        last[r] = max(last[r], w)
                        base.setdefault(int(r), set()).add(label)
            found: dict[int, set[str]] = {}
            contained: dict[int, set[str]] = {}
            score = np.zeros(n)
            at = np.minimum(np.searchsorted(ix.probe, h), len(ix.probe) - 1)
            hits = np.flatnonzero(ix.probe[at] == h)
            if len(hits):
                for r in np.unique(row[hits]):
                    i, j = before[r], before[r + 1]
                    mine = hits[np.searchsorted(hits, i) : np.searchsorted(hits, j)]
                    for a, b in ix.regions(mine, i, j):
                        said = [data[start[k] : end[k]].tobytes() for k in range(a, b)]
                        matches, every = ix.match(said, (mine[np.searchsorted(mine, a) : np.searchsorted(mine, b)] - a).tolist())
                        if every:
                            contained.setdefault(int(r), set()).update(ix.labels[t] for t in every)
                        for both, t, _, _ in matches:
                            found.setdefault(int(r), set()).add(ix.labels[t])
                            score[r] = max(score[r], both / len(ix.sets[t]))
            for r in base:
                score[r] = 1.0
            none = first < 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(before), pa.int64()),
                    pa.array(count),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array([",".join(sorted(base.get(r, ()))) for r in range(n)], pa.string()),
                    pa.array([",".join(sorted(base.get(r, set()) | found.get(r, set()))) for r in range(n)], pa.string()),
                    pa.array(score),
                    pa.array([",".join(sorted(contained.get(r, ()))) for r in range(n)], pa.string()),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "contained"],
            )

    return text_only(docs, "doc_id").mapInArrow(scan, _SCHEMA)


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows as plain DuckDB SQL, with every line held against every template.

    It holds for texts whose statements stand on one line each, as written in the templates.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    listed = lambda t: "[" + ", ".join(f"'{w}'" for w in t.split()) + "]"
    rows = ", ".join(f"('{label}', {listed(' '.join(sorted(set(t.split()))))})" for label, t in templates)
    phrase = ", ".join(f"({listed(p)}, '{label}')" for p, label in PHRASES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '{word}') AS ws FROM d),
templates(label, ts) AS (VALUES {rows}),
phrases(ps, label) AS (VALUES {phrase}),
places AS (
  SELECT w.r, p.label, unnest(list_filter(range(1, len(ws) - len(ps) + 2), lambda i: ws[i:i + len(ps) - 1] = ps)) - 1 AS place FROM w, phrases p),
base AS (
  SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
lines AS (SELECT DISTINCT r, unnest(string_split(t, chr(10))) AS line FROM d),
blocks AS (SELECT r, regexp_extract_all(line, '{word}') AS bs FROM lines),
found AS (
  SELECT r, label, len(list_intersect(ts, bs)) / len(ts) AS share FROM blocks, templates
  WHERE len(list_intersect(ts, bs)) >= ceil({threshold} * len(ts) - 1e-9)),
labelled AS (SELECT r, label FROM found UNION SELECT r, label FROM places),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM labelled GROUP BY r),
best AS (SELECT r, max(share) AS share, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY r)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.b AS BIGINT) AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CAST(CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END AS DOUBLE) AS score, coalesce(best.labels, '') AS contained
FROM w LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)"""
