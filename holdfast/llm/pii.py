"""Personal data in text, plain or disguised, with spans into the source text.

Plain identifiers come from the base patterns over the text itself. Disguised ones
come from two chained transducers, each of which records which source characters
every output character came from: the first folds look-alike characters one by one
and deletes invisible ones; the second rewrites tokens (spelled digits, ``at`` and
``dot`` in their disguises). The same detectors run over the rewritten text and
their spans are mapped back to source characters.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import chunks, text_only

KINDS = ("email", "ip", "card", "phone")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Characters that are drawn like ASCII ones, and invisible characters.
_LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O",
    "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-",
    "−": "-", " ": " ", " ": " ", " ": " ",
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_FOLD = {ord(k): v for k, v in _LOOKALIKE.items()}
# full-width, circled, raised and mathematical forms of ASCII characters
_FOLD |= {c: s for c in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)) if len(s := unicodedata.normalize("NFKC", chr(c))) == 1 and s.isascii()}
_FOLD |= {zero + k: chr(0x30 + k) for zero in (0x0660, 0x06F0, 0x0966) for k in range(10)}  # other digits
_FOLDABLE = re.compile("[" + re.escape("".join(map(chr, _FOLD)) + _INVISIBLE) + "]")
#: Whether there is any: two classes, as one that spans planes is searched far more slowly.
_LOW = re.compile("[" + re.escape("".join(chr(c) for c in _FOLD if c < 0x10000) + _INVISIBLE) + "]")
_HIGH = re.compile("[\U0001d400-\U0001d7ff]")

# Spelled digits of the corpus languages.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
}
# Tens, which a digit may follow, and words that repeat the next digit.
_TENS = {"twenty": "2", "thirty": "3", "forty": "4", "fourty": "4", "fifty": "5", "sixty": "6", "seventy": "7", "eighty": "8", "ninety": "9"}
_TIMES = {"double": 2, "triple": 3}
_UNIT = "one|two|three|four|five|six|seven|eight|nine"
_TWO = rf"(?:{'|'.join(_TENS)})(?:[ -]?(?:{_UNIT})(?![^\W_]))?"
_TEENS = "|".join(w for w, d in _SPELLED.items() if len(d) > 1)
_HUNDREDS = rf"(?:{_UNIT})[ -]hundred(?:[ -](?:and[ -])?(?:{_TWO}|(?:{_TEENS}|{_UNIT})(?![^\W_])))?"
_COMPOUND = rf"{_HUNDREDS}|{_TWO}|(?:{'|'.join(_TIMES)}) (?:zero|oh|{_UNIT}|[0-9])"
_WORDS = _COMPOUND + "|" + "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w)))
_DIGIT = f"(?:{_WORDS}|[0-9])"
_DOT_WORD = "dot|point|punkt|punto"
#: A dot between digits: worded, or in brackets.
_DOT = rf"[ ]?[\[({{<][ ]?(?:{_DOT_WORD}|\.)[ ]?[\])}}>][ ]?|[ ]?(?:{_DOT_WORD})[ ]?"
#: Runs of four digits or more, in groups joined by spaces, hyphens, commas or dots in their disguises.
_RUN = re.compile(
    rf"(?i)(?<![^\W_])(?:(?:plus|más|mas|\+)[ ]?)?{_DIGIT}(?:(?:[ ,-]{{1,2}}|{_DOT}|\.)?{_DIGIT}){{3,}}(?![^\W\d_])"
)
_RUN_TOKEN = re.compile(rf"(?i)plus|más|mas|({_DOT})|{_WORDS}|[0-9]+|[ ,.+-]")
_SPELLED_WORD = re.compile(f"(?i){_WORDS}")
_PART = re.compile(rf"({_DOT_WORD}|[\[({{<]\.)|(\.)|([0-9])|({'|'.join(_TENS)}|{'|'.join(_TIMES)}|{_TEENS}|hundred)|{'|'.join(w for w, d in _SPELLED.items() if len(d) == 1)}")
_DOTTED = re.compile(f"(?i){_DOT}")
_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_MARK_AT = rf"\s?{_OPEN}(?:at|@|arroba|arobase){_CLOSE}\s?|\s@\s|\s(?:AT|at)(?: the rate(?: of)?)?\s|\s(?:arroba|arobase)\s"
_MARK_DOT = rf"\s?{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}\s?|\s(?:DOT|dot|punto|point|punkt)\s|\s\.\s"
_LOCAL, _LABEL = r"[A-Za-z0-9_%+-]++", r"[A-Za-z0-9-]++"
_ADDRESS = rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:(?:{_MARK_DOT}|\.){_LOCAL})*+(?:{_MARK_AT}|@){_LABEL}(?:(?:{_MARK_DOT}|\.){_LABEL})+"
#: An address written out with marks; plain dots may stand between labels too, but one mark at least is needed.
_WITHIN = re.compile(_ADDRESS)
#: The same, not from within a chain of labels: where the whole chain is no local part, its rest is none either, so long chains take no long time.
_WRITTEN = re.compile(rf"(?<!\sdot\s)(?<!\sDOT\s)(?<!\s\.\s)(?<!dot[\])}}>])(?<!dot[\])}}>]\s){_ADDRESS}")
_MARK = re.compile(rf"({_MARK_AT})|({_MARK_DOT})")
#: The same with underscores or hyphens around the words.
_GLUED = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9.]++(?:([_-])(?!at\1)[a-z0-9.]++)*([_-])at\2[a-z0-9]++(?:\2(?!dot\2)[a-z0-9]++)*(?:\2dot\2[a-z0-9]++)+(?![a-z0-9_-])")
_GLUE = re.compile(r"(?i)([_-])(?:(at)|dot)\1")
#: A mark that prose doesn't have; an address without one needs a worded dot before a known top level.
_STRONG = re.compile(r"(?i)[\[({<]\s?(?:at|@|arroba|arobase|dot|punkt|point|punto|\.)\s?[\])}>]|\s@\s|\sat the rate|\s(?:arroba|arobase)\s")
#: Dots that only prose has behind a plain " at ".
_ABROAD = re.compile(r"\s(?:punto|point|punkt)\s")
_PLAIN_AT = re.compile(r"\s(?:AT|at)\s")
#: Letters set apart, with an @ among them.
_APART = re.compile(r"(?<!\S)[A-Za-z0-9](?: [A-Za-z0-9._%+@-](?!\S))++")
_WHOLE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WORDED_DOT = re.compile(r"(?i)\sdot\s")
_BRACKETED = re.compile(r"[\[({<]\s?(?:at|@|arroba|arobase|dot|punkt|point|punto|\.)")
# Common top levels, words that stand before " at " in prose, and words after which a single word is a noun or verb and no name.
_TOPS = frozenset(
    "com net org edu gov mil int info biz name pro mobi io co me us uk de fr es it nl eu ch at ru cn jp in br au ca pl se no dk fi be cz pt gr ie mx ar cl nz za kr tr il hk sg ai tv dev app online site xyz shop tech blog example test".split()
)
_NO_LOCAL = frozenset(
    "a an the i you he she it we they me him her us them that this there here who what and or but not is are was were be been am met meet see saw look looked looking stay stayed arrive arrived stop stopped start started begin began end ended open opens close closed live lived work worked sit sat stand stood point pointed laugh laughed aim good bad best up down out in on off all only even just now then not".split()
)
_BEFORE_NOUN = frozenset("a an the my our your his her its their this that these those some any no every each another i you he she we they it who which".split())
_LAST_WORD = re.compile(r"([A-Za-z]+)\s+\Z")
_NAME_TOP = re.compile(r"\.[A-Za-z]{2,24}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> list[tuple[int, int, int]]:
    """Base matches as (kind, start, end): leftmost, non-overlapping per kind."""
    found = [(0, *span) for span in _emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


class Trace:
    """Text under rewriting, and where each of its pieces starts and ends in the source."""

    def __init__(self, text: str):
        self.text, self.at, self.source = text, [0], [(0, len(text), True)]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Trace:
        """Replace (start, end, new) in order; each replacement maps back to its whole range."""
        out, new, at, source, here, last = Trace(""), [], [], [], 0, 0

        def put(s: str, span: tuple[int, int, bool]) -> None:
            nonlocal here
            if s:
                new.append(s)
                at.append(here)
                source.append(span)
                here += len(s)

        def keep(a: int, b: int) -> None:
            while a < b:  # piece by piece, so that chained rewrites stay exact
                k = bisect.bisect_right(self.at, a) - 1
                stop = min(b, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                put(self.text[a:stop], (self.back(a, a + 1)[0], self.back(stop - 1, stop)[1], self.source[k][2]))
                a = stop

        for a, b, s in edits:
            keep(last, a)
            put(s, (*self.back(a, b), False))
            last = b
        keep(last, len(self.text))
        out.text, out.at, out.source = "".join(new), at or [0], source or [(0, 0, True)]
        return out

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source range of a range of this text."""
        i, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        a, _, plain_a = self.source[i]
        b, b_end, plain_b = self.source[j]
        return (a + start - self.at[i] if plain_a else a), (b + end - self.at[j] if plain_b else b_end)


def _number(word: str) -> str | None:
    """Digits that a spelled number stands for."""
    if word in _SPELLED:
        return _SPELLED[word]
    hundreds, many, rest = word.partition("hundred")
    if many:
        rest = rest.strip(" -").removeprefix("and").strip(" -")
        return _SPELLED[hundreds.strip(" -")] + ((_number(rest) or "").zfill(2) if rest else "00")
    for tens, digit in _TENS.items():
        if word.startswith(tens):
            return digit + (_SPELLED[word[len(tens) :].strip(" -")] if len(word) > len(tens) else "0")
    times, _, one = word.partition(" ")
    return _SPELLED.get(one, one) * _TIMES[times] if times in _TIMES else None


#: How digit words, dots and what repeats a digit begin.
_HEADS = frozenset(w[:3] for w in (*_SPELLED, *_TENS, *_TIMES, *_DOT_WORD.split("|"), "hundred", "plus", "más", "mas"))
_parts: dict[str, tuple[int, int, bool] | None] = {}


def _part(token: str) -> tuple[int, int, bool] | None:
    """Digits and dots that a token may stand for, and whether any is worded; None for a token that ends a run."""
    bare = token.rstrip(".,;:!?)\"'")
    if bare.isalpha() and bare[:3] not in _HEADS and bare[:2] not in _HEADS:
        return None
    found = _PART.findall(token)
    if not found:
        return None if any(map(str.isalpha, token)) else (0, 0, False)
    digits = sum(0 if dot or point else 1 if digit else 3 if many else 1 for dot, point, digit, many in found)
    return digits, sum(bool(dot or point) for dot, point, _, _ in found), any(not point and not digit for _, point, digit, _ in found)


def _may_spell(low: str) -> bool:
    """Whether tokens in a row may make up an identifier; far cheaper than looking for runs."""
    digits = dots = worded = 0
    if len(_parts) > 100_000:
        _parts.clear()
    for token in low.split():
        if token[:3] not in _HEADS and token.isalpha() and token[:2] not in _HEADS:
            digits = dots = worded = 0
            continue
        try:
            part = _parts[token]
        except KeyError:
            part = _part(token)
            if len(token) <= 40:
                _parts[token] = part
        if part is None:
            digits = dots = worded = 0
            continue
        digits, dots, worded = digits + part[0], dots + part[1], worded or part[2]
        if worded and (digits >= 8 or dots >= 3 and digits >= 4):
            return True
    return False


def _spelled(m: re.Match) -> Iterator[tuple[int, int, str]]:
    spelled, dots = _SPELLED_WORD.search(m[0]), len(_DOTTED.findall(m[0]))
    if not spelled and not dots:
        return
    edits = []
    said = list(m[0])
    for t in _RUN_TOKEN.finditer(m[0]):
        word = t[0].lower()
        new = "." if t[1] else _number(word) or {"plus": "+", "más": "+", "mas": "+"}.get(word)
        if new is None and word in " ,-":
            new = "" if spelled else None
        if new is not None and new != t[0]:
            edits.append((m.start() + t.start(), m.start() + t.end(), new))
            said[t.start() : t.end()] = [new] + [""] * (t.end() - t.start() - 1)
    text = "".join(said)
    # the least that an identifier has: three dots for an address, eight digits else
    if text.count(".") >= 3 or len(_digits(text)) >= 8:
        yield from edits


def _written(now: str) -> Iterator[tuple[int, int, str]]:
    """Edits that turn written-out addresses into plain ones; each match is judged by itself."""
    m = _WRITTEN.search(now)
    while m:
        marks = [(m.start() + x.start(), m.start() + x.end(), "@" if x[1] else ".") for x in _MARK.finditer(m[0])]
        said = _MARK.sub(lambda x: "@" if x[1] else ".", m[0])
        fits = said.count("@") == 1 and _NAME_TOP.search(said) and not (_ABROAD.search(m[0]) and _PLAIN_AT.search(m[0]))
        if fits and not any(_STRONG.search(now, a, b) for a, b, _ in marks):
            local = said.split("@")[0].lower()
            before = _LAST_WORD.search(now, max(0, m.start() - 12), m.start())
            prose = local in _NO_LOCAL or local.isalpha() and before and before[1].lower() in _BEFORE_NOUN
            fits = _WORDED_DOT.search(m[0]) and said.rsplit(".", 1)[1].lower() in _TOPS and not prose
        if fits:
            yield from marks
            m = _WRITTEN.search(now, m.end())
        else:  # an address may start within what only looks like one
            m = _WITHIN.search(now, marks[0][1] if marks else m.end())
    for m in _GLUED.finditer(now):
        marks = [(m.start() + x.start(), m.start() + x.end(), "@" if x[2] else ".") for x in _GLUE.finditer(m[0])]
        if sum(new == "@" for *_, new in marks) == 1 and now[marks[-1][1] : m.end()].lower() in _TOPS:
            yield from marks


def normalise(text: str) -> Trace | None:
    """The text rewritten by both transducers; None if nothing in it is disguised."""
    trace = None
    if not text.isascii() and (_LOW.search(text) or _HIGH.search(text)):
        trace = Trace(text).rewrite([(*m.span(), _FOLD.get(ord(m[0]), "")) for m in _FOLDABLE.finditer(text)])
    now = trace.text if trace else text
    edits: list[tuple[int, int, str]] = []
    low = now.lower()
    if _may_spell(low):
        for run in _RUN.finditer(now):
            edits += _spelled(run)
    if " @ " in low:
        for m in _APART.finditer(now):
            if _WHOLE.fullmatch(m[0].replace(" ", "")):
                edits += [(k, k + 1, "") for k in range(m.start() + 1, m.end(), 2)]
    apart = {k for k, _, _ in edits}
    if "dot" in low or " @ " in low or "at the rate" in low or "arroba" in low or "arobase" in low or _BRACKETED.search(low):
        edits += [e for e in _written(now) if not apart.intersection(range(e[0], e[1]))]
    if edits:
        edits.sort()
        kept, last = [], 0
        for e in edits:
            if e[0] >= last:
                kept.append(e)
                last = e[1]
        trace = (trace or Trace(text)).rewrite(kept)
    return trace


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; added ones overlap no base span of their kind."""
    base = detect(text)
    trace = normalise(text)
    if trace is None:
        return base, base
    every = set(base)
    for kind, start, end in detect(trace.text):
        a, b = trace.back(start, end)
        k = bisect.bisect_left(base, (kind, b, -1)) - 1  # the last base span of its kind that starts before its end
        if k < 0 or base[k][0] != kind or base[k][2] <= a:
            every.add((kind, a, b))
    return base, sorted(every)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_disguised bigint, base_spans string, spans string"


def pii_spans(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each document's whole text.

    One row per input row, repeated rows included; null and empty texts have no spans;
    columns other than ``doc_id`` and ``text`` are not used. A map over partitions:
    no shuffle, and memory is bounded by one chunk of rows (or the longest text).
    ``n_*`` count base spans; ``n_disguised`` counts the added ones.
    """

    def scan(batches):
        for batch in chunks(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = find(text)
                rows.append([sum(s[0] == k for s in base) for k in range(4)] + [len(every) - len(base), _said(base), _said(every)])
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.string()) for c in cols[5:])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_disguised", "base_spans", "spans"],
            )

    return text_only(docs, "doc_id").mapInArrow(scan, _SCHEMA)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, last = [], 0
    for kind, a, b in sorted(find(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[kind].upper()}]"]
            last = b
    return "".join([*out, text[last:]])

