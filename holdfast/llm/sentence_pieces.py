"""SentencePiece encoding and decoding through suffix arrays.

A batch's distinct units (a run of spaces and the word after it) are laid end to end and
their suffixes sorted. Every piece of the vocabulary is found in the suffix array by
binary search: its range gives all its occurrences, which are edges between positions.
The edges are sorted by end position and relaxed from left to right over all units at
once, and tokens are read off backwards.

The vocabulary is of the BPE kind, so relaxing follows merges and not sums of scores: a
piece may end a position's segmentation if merging would leave the piece before it
and the piece itself apart. For every prefix exactly one piece does (the encodings of
a text's prefixes are unique), which gives what merging by score gives. Whether two pieces
stay apart is found by undoing their merges along the border, and kept for the next time.

Characters outside the vocabulary become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import chunks, mix, text_only

#: Bytes of distinct units whose suffixes are sorted at once, and units that a worker remembers.
BATCH_BYTES, REMEMBERED = 1 << 18, 200_000

_SPACE = "▁"
_END = 0xFF  # no byte of UTF-8
_WIDTH = 16


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Vocabulary:
    """Pieces of a model, as bytes with a plain space for the space mark; made on the driver and sent to tasks."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
        self.byte_id = [0] * 256
        self.out: list[bytes] = []  # of each id, for decoding
        normal = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.out.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                said = piece.replace(_SPACE, " ")
                self.out.append(said.encode())
                normal.append((len(said) > 1, -sp.get_score(i), i, said))
        # ranks: single characters, then merges in the order of their scores
        normal.sort()
        self.text = [said.encode() for *_, said in normal]
        self.id_of = np.array([i for _, _, i, _ in normal], np.int32)
        rank = {said: r for r, (*_, said) in enumerate(normal)}
        n, said_by = len(normal), [said for *_, said in normal]
        self.left, self.right, self.merged = list(range(n)), list(range(n)), {}
        for r, (many, _, _, said) in enumerate(normal):
            if many:
                parts = _merge([rank.get(c, -1) for c in said], r, rank, said_by)
                if parts is None:
                    self.text[r] = b""  # merging never makes it
                else:
                    self.left[r], self.right[r] = parts
                    self.merged[parts] = r
        joined = "\n".join(said for *_, said in normal)
        #: Units may be cut before spaces and around line breaks, as no piece crosses these.
        self.cut = not re.search(r"[^ \n] ", joined) and not any("\n" in said for *_, said in normal)


def _merge(parts: list[int], limit: int, rank: dict[str, int], text: list[str]) -> tuple[int, int] | None:
    """The last two parts of a piece, by merging with ranks below its own; None if it doesn't come to two."""
    if -1 in parts:
        return None
    while len(parts) > 2:
        best, at = limit, -1
        for k in range(len(parts) - 1):
            r = rank.get(text[parts[k]] + text[parts[k + 1]], limit)
            if r < best:
                best, at = r, k
        if at < 0:
            return None
        parts[at : at + 2] = [best]
    return (parts[0], parts[1]) if len(parts) == 2 else None


_UNITS = re.compile(rb" +[^ \n]*|\n|[^ \n]+")


class Encoder:
    """What a worker needs of a vocabulary to encode, with what it has found so far."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._forget()
        some = [r for r, t in enumerate(v.text) if t]
        self.rank = np.array(some, np.int32)
        self.size = np.array([len(v.text[r]) for r in some], np.int32)
        self.low = np.array([v.text[r][:_WIDTH] for r in some], f"S{_WIDTH}")
        self.high = np.array([v.text[r][:_WIDTH].ljust(_WIDTH, b"\xff") for r in some], f"S{_WIDTH}")
        self.n = len(v.text)
        self.keys, self.apart = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _stay(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces ``a`` and ``b`` apart."""
        left, right, merged, limit = self.v.left, self.v.right, self.v.merged, self.n
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if right[a] != a and (a > b or left[b] == b):
                limit, a = a, right[a]
            elif left[b] != b:
                limit, b = b + 1, left[b]
            else:
                return True

    def _all_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * self.n + b
        slot = (mix(code.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)
        new = self.keys[slot] != code
        out = self.apart[slot]
        if new.any():
            some, back = np.unique(code[new], return_inverse=True)
            said = np.fromiter((self._stay(c // self.n, c % self.n) for c in some.tolist()), bool, len(some))
            out[new] = said[back]
            at = slot[new]
            self.keys[at], self.apart[at] = code[new], said[back]
            # two codes of one slot: the flag of the one whose key was written last
            at = (mix(some.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)
            won = self.keys[at] == some
            self.apart[at[won]] = said[won]
        return out

    def _edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of all pieces in the text, and of the bytes of other characters."""
        pos = np.flatnonzero(((data & 0xC0) != 0x80) & (data != _END)).astype(np.int32)
        padded = np.concatenate([data, np.full(64, _END, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, _WIDTH)[pos]
        key = np.ascontiguousarray(view)
        halves = key.view(">u8").astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        pos, suffixes = pos[order], key[order].view(f"S{_WIDTH}").ravel()
        lo, hi = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        count = hi - lo
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        start = pos[np.arange(count.sum()) + np.repeat(lo - np.cumsum(count) + count, count)]
        long = np.flatnonzero(self.size[piece] > _WIDTH)
        if len(long):
            keep = np.ones(len(piece), bool)
            for i in long:
                text = self.v.text[self.rank[piece[i]]]
                keep[i] = padded[start[i] : start[i] + len(text)].tobytes() == text
            piece, start = piece[keep], start[keep]
        end, token = start + self.size[piece], self.rank[piece]
        single = np.zeros(len(data) + 1, bool)
        width = np.zeros(len(data) + 1, np.int64)
        at = np.sort(pos)
        width[at] = np.diff(np.append(at, len(data)))
        # a character's bytes end where the next character or the unit's end mark stands
        ends = np.flatnonzero(data == _END)
        if len(ends):
            nearest = ends[np.minimum(np.searchsorted(ends, at), len(ends) - 1)]
            width[at] = np.minimum(width[at], np.where(nearest > at, nearest - at, width[at]))
        single[start[end - start == width[start]]] = True
        other = at[~single[at]]
        if len(other):
            of = np.repeat(other, width[other])
            byte = of + np.arange(len(of)) - np.repeat(np.cumsum(width[other]) - width[other], width[other])
            start, end, token = np.concatenate([start, byte.astype(np.int32)]), np.concatenate([end, byte.astype(np.int32) + 1]), np.concatenate([token, self.n + data[byte].astype(np.int32)])
        return start, end, token

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All units' ids, and how many each has."""
        data = np.frombuffer(b"\xff".join(units) + b"\xff", np.uint8)
        size = np.array([len(u) for u in units], np.int64)
        first = np.cumsum(size + 1) - size - 1
        start, end, token = self._edges(data)
        begin = np.repeat(first, size + 1).astype(np.int32)
        reach = end - begin[start]
        order = np.argsort(reach.astype(np.uint16) if reach.max(initial=0) < 1 << 16 else reach, kind="stable")
        start, end, token, reach = start[order], end[order], token[order], reach[order]
        cuts = np.flatnonzero(np.diff(reach)) + 1
        last = np.full(len(data) + 1, -2, np.int32)  # -2: not reached, -1: whatever follows stays apart
        last[first] = -1
        came, said = np.zeros(len(data) + 1, np.int32), np.zeros(len(data) + 1, np.int32)
        for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(start)), strict=True):
            before = last[start[a:b]]
            ok = before == -1
            test = np.flatnonzero((before >= 0) & (token[a:b] < self.n))
            if len(test):
                ok[test] = self._all_stay(before[test], token[a:b][test])
            ok |= (before >= 0) & (token[a:b] >= self.n)
            e, t = end[a:b][ok], token[a:b][ok]
            last[e] = np.where(t < self.n, t, -1)
            came[e], said[e] = start[a:b][ok], t
        # backwards over all units
        who, at, step, found = np.arange(len(units)), first + size, 0, []
        while len(who):
            more = at > first[who]
            who, at = who[more], at[more]
            found.append((who, said[at]))
            at = came[at]
            step += 1
        who, tok = np.concatenate([w for w, _ in found]), np.concatenate([t for _, t in found])
        back = np.repeat(np.arange(len(found)), [len(w) for w, _ in found])
        order = np.lexsort((-back, who))
        tok = tok[order]
        ids = np.where(tok < self.n, self.v.id_of[np.minimum(tok, self.n - 1)], np.array(self.v.byte_id, np.int32)[np.maximum(tok - self.n, 0)]).astype(np.int32)
        return ids, np.bincount(who, minlength=len(units))

    def _learn(self, units: list[bytes]) -> None:
        ids, size = self.encode_units(units)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and how many each has; a word that several texts share is encoded once."""
        if len(self.known) > REMEMBERED:
            self._forget()
        mark = _SPACE.encode()
        split, seen = [], set()
        for t in texts:
            t = b" " + (t.replace(mark, b" ") if mark in t else t) if t else b""
            units = _UNITS.findall(t) if self.v.cut else [t] if t else []
            split.append(units)
            seen.update(units)
        batch, size = [], 0
        for u in seen - self.known.keys():
            batch.append(u)
            size += len(u)
            if size >= BATCH_BYTES:
                self._learn(batch)
                batch, size = [], 0
        if batch:
            self._learn(batch)
        number = np.array([len(units) for units in split], np.int64)
        at = np.array([*map(self.known.__getitem__, chain.from_iterable(split))], np.int64)
        size = self.ends[at + 1] - self.ends[at]
        ids = self.ids[np.arange(size.sum()) + np.repeat(self.ends[at] - np.cumsum(size) + size, size)]
        total = np.concatenate([[0], np.cumsum(size)])
        cut = np.concatenate([[0], np.cumsum(number)])
        return ids, total[cut[1:]] - total[cut[:-1]]


def decode_ids(out: list[bytes], ids: list[int]) -> str:
    """Text of a list of ids: pieces and bytes joined, less the space put before the text."""
    data = b"".join(map(out.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: each text's ids, and the text that decoding them gives back.

    One row per input row; null and empty texts have no ids and decode to an empty text.
    Decoding gives back every text, only that a space mark (U+2581) in it becomes a space.
    Other columns are not used. A map over partitions, without a shuffle; a worker holds
    one chunk of texts, the suffixes of ``BATCH_BYTES`` (or its longest unit) and a table of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())

    def scan(batches):
        encoder = Encoder(shared.value)
        for batch in chunks(batches):
            ids, size = encoder.encode(batch.column(1).cast(pa.binary()).to_pylist())
            ends = np.concatenate([[0], np.cumsum(size)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            listed = ids.tolist()
            decoded = [decode_ids(encoder.v.out, listed[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), lists, pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"]
            )

    return text_only(docs, "doc_id").mapInArrow(scan, "doc_id bigint, n_tokens bigint, ids array<int>, decoded string")


def decode(tokens: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text, null or unknown ids in a list nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast((vocabulary or Vocabulary()).out)

    def scan(batches):
        out = shared.value
        for batch in batches:
            texts = [decode_ids(out, [i for i in x or () if i is not None and 0 <= i < len(out)]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(scan, "doc_id bigint, text string")
