"""Each operator against a plain way of its own, and its edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from holdfast.llm import _arrow, decontaminate, langid, licenses, line_dedup, main_text, pii, quality, sentence_pieces, simhash, topk
from tests.llm.held_out_pages import PAGES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\n \t"), (4, "word " * 40_000), (5, "same text here"), (5, "same text here"), (None, "no id at all"), (7, "x" * 50_000), (8, "ünïcödé 日本語 𝔘 a\x00b")]


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS).repartition(2)


def odd(spark, clash=()):
    out = docs(spark, ODD)
    for c in clash:
        out = out.withColumn(c, F.lit("clash"))
    return out


# --- personal data


def brute_base(text):
    out = []
    for k, (pattern, fits) in enumerate(
        [
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
        ]
    ):
        out += [(k, *m.span()) for m in re.finditer(pattern, text) if fits(m[0])]
    return out


def test_pii_base_is_the_patterns():
    r = random.Random(3)
    bits = ["a@b.c", "1.2.3.4", "300.1.1.1", "+1 (386) 555-3733", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", ".", "@", "-", "7", "x", "é", "+", "(", "1234567"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert pii.detect(text) == brute_base(text), text


@pytest.mark.parametrize(
    ("text", "kind", "said"),
    [
        ("write bob.smith [at] mail (dot) example [dot] com now", "email", "bob.smith [at] mail (dot) example [dot] com"),
        ("to joe at example dot com please", "email", "joe at example dot com"),
        ("bоb@exаmple.com", "email", "bоb@exаmple.com"),
        ("call plus one three eight six five five five three seven three three", "phone", "plus one three eight six five five five three seven three three"),
        ("at one nine two dot one six eight dot one dot one.", "ip", "one nine two dot one six eight dot one dot one"),
        ("card ４111 1111 1111 1111!", "card", "４111 1111 1111 1111"),
        ("joe@exam​ple.com", "email", "joe@exam​ple.com"),
    ],
)
def test_pii_disguises_map_back(text, kind, said):
    base, every = pii.find(text)
    assert (pii.KINDS.index(kind), text.index(said), text.index(said) + len(said)) in every
    assert set(base) <= set(every)


@pytest.mark.parametrize(
    ("said", "kind"),
    [
        ("192[.]168[.]1[.]1", "ip"), ("192(dot)168(dot)1(dot)1", "ip"), ("192 dot 168 dot 1 dot 1", "ip"), ("10.0[.]0.1", "ip"),
        ("one two seven dot zero dot zero dot one", "ip"), ("eight dot eight dot eight dot eight", "ip"), ("acht punkt acht punkt acht punkt acht", "ip"),
        ("ocho punto cero punto ocho punto uno", "ip"), ("un point deux point trois point quatre", "ip"),
        ("plus vier neun drei null eins zwei drei fünf sechs", "phone"), ("plus trois trois un deux six sept huit neuf zéro", "phone"),
    ],
)
def test_pii_dots_and_digit_words(said, kind):
    _, every = pii.find(f"it is {said}, they say")
    assert every == [(pii.KINDS.index(kind), 6, 6 + len(said))]
    assert pii.find("version 3 point 4 of one dot two, one two three four") == ([], [])


def test_pii_evidence_is_in_the_match():
    passage = "look at example.com or joe at example.org"
    far = passage + " and on. " + "word " * 50
    assert pii.find(far + "bob [at] mail.example")[1] == [(0, len(far), len(far) + 21)]
    text = "look at bob.smith [at] mail.com"
    assert pii.find(text)[1] == [(0, 8, len(text))]


def test_pii_leaves_prose_alone():
    for text in ("he was at the shop and one of two or three men came", "zero tolerance", "in section 1.2.3 of 4", "look at this . com"):
        assert pii.find(text) == ([], [])


def test_pii_long_numbers_and_texts():
    zeros = "0" * 10_000 + "1.2.3.4"
    assert pii.detect(zeros) == [(1, 0, len(zeros))] and pii.detect("0" * 10_000 + ".0.0." + "9" * 5000) == []
    many = "a@b.cd " * 20_000
    assert len(pii.find(many + "joe [at] mail.example")[1]) == 20_001


@pytest.mark.parametrize(
    ("said", "kind"),
    [
        ("john_at_example_dot_com", "email"), ("john-at-my-site-dot-co-dot-uk", "email"), ("john at the rate example dot com", "email"), ("joe [at] foo (dot) museum", "email"),
        ("ten dot zero dot zero dot one", "ip"), ("one ninety-two dot one sixty eight dot one dot one", "ip"), ("192 dot 168 dot 0 dot 1", "ip"),
        ("plus forty-four twenty seven nine four six zero one two", "phone"), ("plus one double five five triple six one two", "phone"), ("𝐣𝐨𝐞@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.com", "email"),
    ],
)
def test_pii_more_disguises(said, kind):
    assert pii.find(f"it is {said}, they say")[1] == [(pii.KINDS.index(kind), 6, 6 + len(said))]


def test_pii_added_spans_precision_and_recall():
    """Disguised identifiers between sentences of prose with "at", "dot" and spelled numbers: all are found, and nothing else."""
    r = random.Random(11)
    prose = ["he met at noon dot com", "see you at home dot the end", "we were at the shop at five", "one of two or three of ten", "look at that dot", "a point of order", "forty-four of them and twenty one", "at page 3 . 4"]
    digit = "zero one two three four five six seven eight nine".split()
    word = lambda: "".join(r.choice("bcdfgklmn") + r.choice("aeiou") for _ in range(3))

    def disguised():
        at, dot = r.choice([(" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), ("_at_", "_dot_"), (" @ ", " . ")])
        spell = lambda n: " ".join(digit[int(c)] for c in str(n))
        return r.choice(
            [
                (0, f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'de'])}"),
                (1, " dot ".join(spell(r.randint(0, 255)) for _ in range(4))),
                (3, "plus " + " ".join(r.choice(digit) for _ in range(r.randint(8, 15)))),
            ]
        )

    for _ in range(400):
        text, want = "", []
        for _ in range(r.randint(1, 4)):
            text += r.choice(prose) + ". So: "
            kind, said = disguised()
            want.append((kind, len(text), len(text) + len(said)))
            text += said + "; "
        assert pii.find(text)[1] == sorted(want), text


def test_pii_rows(spark):
    got = pii.pii_spans(odd(spark, ["spans", "n_email"])).collect()
    assert len(got) == len(ODD) and all(r.spans == "" for r in got)
    assert pii.pii_spans(docs(spark, [])).count() == 0
    (r,) = pii.pii_spans(docs(spark, [(1, "é a@b.cd")])).collect()
    assert (r.n_email, r.base_spans) == (1, "email:2:8")
    assert pii.masked("é a@b.cd!") == "é [EMAIL]!"


# --- pages


@pytest.fixture(scope="module")
def hand_model():
    return main_text.Model(main_text._hand_counts())


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_held_out_pages_come_back(hand_model, k):
    page, lines = PAGES[k]
    assert page not in main_text.LABELLED and hand_model.text(page) == "\n".join(lines)


def test_held_out_pages_with_a_trained_model(spark):
    """Training on pages of the table doesn't spoil others; rows repeat, other columns clash, null ids stay."""
    marked = [(1000 + k, "u", f"<body><nav><a href='/'>x</a></nav><div class='ad'>y</div><article><h1>T {k}</h1><p>{'words and more of them ' * (k % 9)}</p></article><footer>z</footer></body>") for k in range(200)]
    rows = marked + [(k, "u", page) for k, (page, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0]), (None, None, PAGES[1][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "label")})
    got = collections.defaultdict(list)
    for r in main_text.main_text(pages).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    for k, (_, lines) in enumerate(PAGES):
        assert got[k] == ["\n".join(lines)] * (2 if k == 0 else 1)
    assert got[None] == ["\n".join(PAGES[1][1])]


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='x'><p>one</p><p>two</p></div><nav><p>three</p></nav></body>",
        "<body><article><h1>A &amp; b</h1><p>one</p></article><div class='ad'><p>two</p></div></body>",
        "<body><div><div><div>one two</div></div></div><div class='comments'><p>three</p></div></body>",
    ],
)
def test_marginals_and_text_are_the_sums_over_all_labellings(hand_model, page):
    nodes, blocks = main_text.parse(page)
    weight, total = collections.defaultdict(float), 0.0
    texts = collections.Counter(n.parent for n in nodes if n.chars)
    for labels in itertools.product(range(3), repeat=len(nodes)):
        w = hand_model.root(nodes[0].part)[labels[0]]
        for k, (n, e) in enumerate(zip(nodes, main_text.seen(nodes), strict=True)):
            w += hand_model.emission(*e)[labels[k]] / max(1, texts[n.parent]) ** 0.5
            if n.parent >= 0:
                w += hand_model.potential(n.part, n.hint, labels[n.parent])[labels[k]]
        total += math.exp(w)
        for k, y in enumerate(labels):
            weight[k, y] += math.exp(w)
    for k, p in enumerate(hand_model.marginals(nodes)):
        assert p == pytest.approx([weight[k, y] / total for y in range(3)])
    assert hand_model.text(page) == "\n".join(said for k, said in blocks if weight[k, main_text.CONTENT] > total / 2)


def test_pages_own_marks_are_not_labels():
    nodes, _ = main_text.parse('<article><p>a</p><rect data-y="1"></rect></article>')
    assert all(n.label is None for n in nodes) and main_text.labelled(nodes)[1] == main_text.CONTENT


@pytest.mark.parametrize("page", ["<a" * 1_000_000, '<a "' * 500_000, "</div>" * 100_000, "<div>" * 20_000 + "</p>" * 20_000, "<x-a>" * 50_000 + "<li></li>" * 10_000, "<!-- " * 200_000, "<p title='" * 200_000])
def test_long_and_broken_pages(hand_model, page):
    began = time.process_time()
    hand_model.text(page)
    assert time.process_time() - began < 20


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>unclosed <b>bold"), (4, "u", "<" * 5000), (5, "u", "<script>var t='</p>'</script><!-- x"), (6, "u", "<article>a &lt; b&nbsp; c<br>d</article>" * 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.main_text(pages).collect()}
    assert got[1] == got[2] == got[5] == "" and got[6] == "a < b c d"
    assert main_text.main_text(pages.where("page_id > 9")).count() == 0


def test_elements_without_their_end_keep_the_page():
    said = lambda page: [t for _, t in main_text.parse(page)[1]]
    for tag in ('<svg width="1"/>', "<svg>", "<button>", "<object>", "<noscript>", "<template>", "<select>"):
        assert said(f"<div><p>a</p>{tag}<p>b</p></div><p>c</p>") == ["a", "b", "c"]
    for tag in ("title-bar", "button-group", "select-box"):
        assert said(f"<{tag}>x</{tag}><p>a</p>") == ["x", "a"]
    assert said("<p>a</p><script>if (a < b) '<p>x</p>'") == ["a"]
    model = main_text.Model(main_text._hand_counts())
    long = "Long sentences of prose stand in the body of an article, with commas, clauses and a full stop at their end."
    page = "<body><article><h1>Title</h1><p>{0}</p>{1}<p>{0}</p></article></body>"
    for extra in ('<svg width="1"/>', "<button>Buy", "<object>", "<button>Buy</button>", f"<noscript><p>{long[:60]}</p></noscript>", "<select><option>One<option>Two</select>"):
        assert model.text(page.format(long, extra)) == f"Title\n{long}\n{long}", extra


# --- decontamination


def test_reordered_passages(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(5)] + [(8, "tiny item"), (9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[1][1].split()
    rows = [
        (1, "before " + items[0][1].upper() + ", after"),
        (2, " ".join(w[20:] + ["gap"] + w[:20])),
        (3, " ".join(w[:12])),
        (4, " ".join(word() for _ in range(500))),
        (5, "a tiny, item!"),
        (6, None),
    ]
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (5, 8)}
    assert got[2, 1].n_tiles == 2 and got[2, 1].n_covered == 40
    kept = decontaminate.drop_leaks(docs(spark, rows), bench, block_words=50)
    assert sorted(x.doc_id for x in kept.collect()) == [3, 4, 6] and kept.columns == docs(spark, rows).columns
    assert decontaminate.leaks(docs(spark, rows), bench.where("item_id > 99")).count() == 0
    assert decontaminate.leaks(odd(spark, ["item_id", "coverage"]), bench).count() == 0


def test_tiles_are_greedy():
    def brute(a, b, least):
        used_a, used_b, tiles = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] < least:
                return sum(tiles)
            tiles.append(best[0])
            used_a |= set(range(-best[1], -best[1] + best[0]))
            used_b |= set(range(-best[2], -best[2] + best[0]))

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("xyz") for _ in range(r.randint(3, 14))] for _ in range(2))
        ids = {w: np.uint64(decontaminate.mix(np.array([k + 1], np.uint64))[0]) for k, w in enumerate("xyz")}
        x, y = (np.array([ids[w] for w in side], np.uint64) for side in (a, b))
        assert decontaminate.tile(x, y, 3)[1] == brute(a, b, 3)
        own = decontaminate.windows(x, 3)
        assert decontaminate.tile(x, decontaminate._met(y, decontaminate.windows(y, 3), own, 3), 3)[1] == brute(a, b, 3)


def test_repeated_words_and_shared_stems():
    """Work and memory stay with the words, not with the pairs of their places."""
    import tracemalloc

    stem = "which of the following statements about the matter is true "
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = ["same " * 20_000] + [stem + " ".join(word() for _ in range(20)) for _ in range(10_000)]
    items = decontaminate.Items(list(range(len(texts))), texts, 5)
    asked = ["same " * 20_000, stem + " ".join(word() for _ in range(400)), "x " + texts[77] + " y", "same " * 12_001, "same " * 11_999]
    tracemalloc.start()
    got = decontaminate._leaks(items, pa.array(asked), 0.6)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert [(row, item, covered) for row, item, _, covered, _ in got] == [(0, 0, 20_000), (2, 77, 30), (3, 0, 12_001)]
    stems = decontaminate.Items(list(range(50)), [stem + f"w{k}" for k in range(50)], 5)
    assert len(decontaminate._leaks(stems, pa.array([stem]), 0.6)) == 50  # a stem that is most of its items counts


def test_drop_leaks_edge_cases(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30))), (None, "same text here"), (2, None)], "item_id long, text string")
    rows = [(1, "so w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18"), (1, "w0 w1 w2 w3 w4 w5"), *ODD]
    table = docs(spark, rows).withColumns({c: F.lit("clash") for c in ("item_id", "coverage", "n_tiles")})
    kept = decontaminate.drop_leaks(table, bench)
    assert collections.Counter((x.doc_id, x.text) for x in kept.collect()) == collections.Counter(rows[1:]) and kept.columns == table.columns
    assert decontaminate.drop_leaks(docs(spark, []), bench).count() == 0


# --- language


def test_language(spark):
    said = {"en": "the cat and the dog with this", "de": "der hund und die katze mit dem", "fr": "le chien avec les élèves où"}
    rows = [(k, " ".join(random.Random(k).sample(said[x].split(), 5)), x) for k in range(300) for x in [list(said)[k % 3]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert all(got[k].lang_pred == x and 0 <= got[k].score <= 1 for k, _, x in rows if zlib.crc32(str(k).encode()) % 4 == 2)
    strange = {(r.doc_id, r.lang_pred) for r in langid.predict(odd(spark, ["score"]), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= strange and (4, "und") not in strange
    none = langid.train(table.where("false"))
    assert {r.lang_pred for r in langid.predict(odd(spark), none).collect()} == {"und"}


def test_language_against_plain_counting(spark, monkeypatch):
    """Counts, log-probabilities and posteriors in plain Python, with languages scored two at a time."""
    monkeypatch.setattr(langid, "WIDE", 2)
    r = random.Random(4)
    words_of = {x: ["".join(r.choice("abcdeéßøñ" if x != "zz" else "xyzXÄ𝔘") for _ in range(r.randint(1, 6))) for _ in range(30)] for x in ("aa", "bb", "cc", "dd", "zz")}
    rows = [(k, " ".join(r.choices(words_of[x], k=r.randint(1, 12))) + r.choice(["", "!", " 12, a"]), x) for k in range(80) for x in [r.choice(list(words_of))]]
    rows += [(200, "no language", None), (201, None, "aa"), (202, "", "bb"), (203, "a" * 20_000, "cc"), (None, "dd ee", "dd"), (3, rows[3][1], rows[3][2])]

    def buckets(text):
        codes = [0 if not c.isalpha() else ord(c.lower()[0]) if ord(c) <= 0xFFFF else ord(c) for c in text]
        codes = [c for i, c in enumerate(codes) if c or i == 0 or codes[i - 1]]
        out = []
        for n in (1, 2, 3):
            for i in range(len(codes) - n + 1):
                if n == 1 and not codes[i]:
                    continue
                h = 0
                for c in codes[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                h = (h * 0x9E3779B1 + (n * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF
                out.append((h ^ h >> 15) & (langid.BUCKETS - 1))
        return out

    held = lambda k: k is None or zlib.crc32(str(k).encode()) % 4 == 2
    counts, number = collections.defaultdict(collections.Counter), collections.Counter()
    for k, text, x in rows:
        if not held(k) and x is not None and text is not None:
            counts[x].update(buckets(text))
            number[x] += 1
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = collections.defaultdict(list)
    for x in langid.predict(table, langid.train(table.where(~langid.held_out()))).collect():
        got[x.doc_id].append(x)
    for k, text, _ in rows:
        seen = buckets(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert got[k][0].lang_pred == "und" and got[k][0].score == 0.0
            continue
        logs = {}
        for x in sorted(counts):
            total = sum(counts[x].values()) + 0.5 * langid.BUCKETS
            logs[x] = math.log(number[x] / sum(number.values())) + sum(math.log((counts[x][b] + 0.5) / total) for b in seen)
        best = max(sorted(logs), key=logs.get)
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        for x in got[k]:
            assert x.score == pytest.approx(share) and (x.lang_pred == best or share < 0.5001)
    assert table.where("doc_id is null").select(langid.held_out().alias("h")).first().h is True


# --- licenses


def test_licenses_against_counting(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "This is licensed under the\nApache License, Version 2.0."), (3, "licensed CC BY-NC 4.0 text"), (4, "All Rights Reserved"),
        (5, "all the rights of the reserved"), (6, "cc by nc cc BY nc"), *[((k or 0) + 100, t) for k, t in ODD if k != 5],
    ]
    got = {r.doc_id: r for r in licenses.license_labels(docs(spark, rows).withColumn("labels", F.lit("clash"))).collect()}
    for k, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        ws = word.findall(low)
        places = [(i, label) for p, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        found = {label for label, t in licenses.TEMPLATES for line in low.split("\n") if len(set(t.split()) & set(word.findall(line))) >= math.ceil(0.8 * len(set(t.split())) - 1e-9)}
        r = got[k]
        assert (r.n_words, r.n_base) == (len(ws), len(places))
        assert r.first_word == min((i for i, _ in places), default=None) and r.last_word == max((i for i, _ in places), default=None)
        assert r.labels == ",".join(sorted(found | {x for _, x in places}))


def wrapped(text, wide, mark="# "):
    out = [""]
    for w in text.split():
        if len(out[-1]) + len(w) >= wide:
            out.append("")
        out[-1] += w + " "
    return "\n".join(mark + x for x in out)


def license_of(spark, texts):
    got = {r.doc_id: r.labels for r in licenses.license_labels(docs(spark, list(enumerate(texts)))).collect()}
    return [got[k] for k in range(len(texts))]


def test_wrapped_license_statements(spark):
    texts, want = [], []
    for wide in (30, 80):
        for label, t in licenses.TEMPLATES:
            texts.append("some code = 1\n\n" + wrapped(t.capitalize(), wide) + "\n" + "other words " * 300)
            want.append(label)
    assert [label in got.split(",") for got, label in zip(license_of(spark, texts), want, strict=True)] == [True] * len(want)


def test_license_names_decide(spark):
    by = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    cases = [
        ("Released under the BSD License", ""), ("Licensed under the GNU General Public License, version 2.0", ""), ("Licensed under CC BY 4.0", ""),
        ("Licensed under CC BY-SA 4.0", ""), (by.format(""), "cc-by"), (by.format("-NonCommercial"), "cc-by-nc"), (by.format("-ShareAlike"), "cc-by-sa"),
        ("all " + "word " * 50 + "rights " + "word " * 50 + "reserved", ""), ("Released under the MIT License. All rights reserved.", "mit,proprietary"),
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "apache-2,mit"),
    ]
    assert license_of(spark, [t for t, _ in cases]) == [label for _, label in cases]


# --- quality


def test_quality(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("abcdeflmno") for _ in range(r.randint(2, 9))) for _ in range(80)) + "."
    rows = [(k, good() if k % 3 else good().upper().replace(" ", "!! ")) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(600)] + [(1, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality_scores(docs(spark, rows), labels).collect()}
    assert len(got) == 600 and all(got[k].predicted == int(k % 3 > 0) for k in range(600))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    kept = quality.keep_good(docs(spark, rows), labels)
    assert {x.doc_id for x in kept.collect()} == {k for k in range(600) if k % 3}
    scores = [x.score for x in quality.quality_scores(odd(spark, ["x", "quality"]), labels).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert {x.score for x in quality.quality_scores(odd(spark), labels.where("quality = 7")).collect()} == {0.5}
    assert quality.quality_scores(docs(spark, []), labels).count() == 0


def test_quality_against_plain_densities(spark):
    """Class moments, shrinkage and log-densities by their formulas, over the operator's own statistics; held-out and null ids aren't learned from."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows = [(k, " ".join(word(r.randint(2, 9 if k % 3 else 3)) for _ in range(r.randint(5, 60))) + "!" * (k % 4)) for k in range(120)] + [(None, "no id"), (7, "again"), (500, None)]
    marks = [(k, int(k % 3 > 0), 0) for k in range(100)] + [(None, 1, 0), (5, 1, 1), (501, 0, 0), (6, None, 0), (8, 7, 0)]
    table = docs(spark, rows).withColumns({c: F.lit("clash") for c in ("quality", "x", "score")})
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    scores = quality.quality_scores(table, labels).collect()
    x = {}
    for f in quality.features(docs(spark, rows)).collect():
        x.setdefault(f.doc_id, []).append(np.array(f.x))
    own = {0: [], 1: []}
    for k, y, _ in marks:
        if k is not None and y in (0, 1) and zlib.crc32(str(k).encode()) % 5:
            own[y] += x.get(k, [])
    scatter = {y: (np.array(v) - np.mean(v, 0)).T @ (np.array(v) - np.mean(v, 0)) for y, v in own.items()}
    pooled = (scatter[0] + scatter[1]) / (len(own[0]) + len(own[1]) - 2)

    def log_density(v, y):
        c = (1 - quality.POOL) * scatter[y] / (len(own[y]) - 1) + quality.POOL * pooled
        c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + 1e-5 * np.eye(len(c))
        e = v - np.mean(own[y], 0)
        return math.log(len(own[y])) - 0.5 * (e @ np.linalg.solve(c, e) + np.linalg.slogdet(c)[1])

    want = sorted(1 / (1 + math.exp(min(500, log_density(v, 0) - log_density(v, 1)))) for vs in x.values() for v in vs)
    assert sorted(s.score for s in scores) == pytest.approx(want, abs=1e-6)
    assert all(s.held_out == (s.doc_id is None or zlib.crc32(str(s.doc_id).encode()) % 5 == 0) and s.predicted == int(s.score >= 0.3) for s in scores)
    kept = quality.keep_good(table, labels)
    by = {(s.doc_id, round(s.score, 9)): s.predicted for s in scores}
    assert kept.count() == sum(s.predicted for s in scores) and len(by) >= len(rows) - 1 and kept.columns == table.columns


def test_statistics_of_a_text():
    text = "Ab, ab AB 12!\nshort\nshort\n" + "long words everywhere " * 3
    f = dict(zip(quality.FEATURES, quality.statistics(*_arrow.utf8(pa.array([text, "", "é"])))[0], strict=True))
    words = re.findall(r"[0-9a-z]+", text.lower())
    size = len(text)
    assert f["upper"] ** 2 == pytest.approx(3 / size) and f["digit"] ** 2 == pytest.approx(2 / size) and f["newline"] ** 2 == pytest.approx(3 / size)
    assert f["log_words"] == pytest.approx(math.log1p(len(words))) and f["distinct"] == pytest.approx(len(set(words)) / len(words))
    triples = list(zip(words, words[1:], words[2:], strict=False))
    assert f["distinct_triples"] == pytest.approx(len(set(triples)) / len(triples))
    lines = text.split("\n")
    assert f["repeated_lines"] ** 2 == pytest.approx(1 - len(set(lines)) / len(lines)) and f["short_lines"] ** 2 == pytest.approx(sum(len(x) < 30 for x in lines) / len(lines))


def test_keep_good_edge_cases(spark):
    r = random.Random(7)
    rows = [(k, " ".join(r.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(50)) if k % 2 else "!!! BUY $$$ " * 9) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    extra = [(900, None), (901, ""), (902, rows[1][1] * 500), (None, rows[1][1]), (903, rows[3][1]), (903, rows[3][1]), (904, rows[0][1])]
    kept = quality.keep_good(docs(spark, rows + extra).withColumn("quality", F.lit("clash")), labels)
    got = collections.Counter(x.doc_id for x in kept.collect())
    assert got[None] == 1 and got[903] == 2 and got[904] == 0 and all(got[k] == k % 2 for k in range(200)) and got[900] == got[901]
    assert quality.keep_good(docs(spark, []), labels).count() == 0
    assert quality.keep_good(docs(spark, rows), labels.where("false")).count() == len(rows)


# --- search


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_is_exact(spark, scale):
    r = np.random.default_rng(4)
    x = (r.normal(size=(400, 8)) * scale).tolist()
    x[7], x[9] = x[3], x[3]  # ties
    rows = [(k, v) for k, v in enumerate(x)] + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (940, [0.5, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)), k=5).collect()
    ints = {k: [math.floor(64 * c) for c in v] for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    for q in ints:
        if q % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(ints[q], ints[k], strict=False)), k) for k in ints if k != q)[:5]
            assert [(g.rank, -g.score, g.vec_id) for g in sorted(got, key=lambda g: g.rank) if g.query_id == q] == [(n + 1, s, k) for n, (s, k) in enumerate(want)]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert topk.top_k(few).count() == 2 and topk.top_k(few.where("false")).count() == 0


def test_top_k_edge_cases(spark):
    """Repeated ids and rows, ties, empty vectors, more than one share and part, a third of the rows in one place."""
    r = random.Random(5)
    rows = [(k, [r.choice([-1.0, 0.0, 0.5]) for _ in range(4)] if k % 3 else [0.25] * 4) for k in range(90)]
    rows += [(40, [9.0, 0.0, 0.0, 0.0]), (41, [0.5] * 4), (41, [0.5] * 4), (100, []), (None, [1.0] * 4), (120, [float("-inf")] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("codes", "centre", "kth", "score")})
    got = collections.defaultdict(list)
    for x in topk.top_k(table, 6, share_bytes=200, cell_packs=2).collect():
        got[x.query_id].append((x.rank, x.score, x.vec_id))
    ints = [(k, [math.floor(64 * c) for c in v]) for k, v in rows if k is not None and k != 120]
    for q in (0, 20, 40, 60, 80, 100):
        own = min(v for k, v in ints if k == q)
        want = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), k) for k, v in ints if k != q)[:6]
        assert sorted(got[q]) == [(n + 1, -s, k) for n, (s, k) in enumerate(want)]
    assert set(got) == {0, 20, 40, 60, 80, 100}


def test_top_k_plan_does_not_grow(spark):
    """Whatever the number of queries: one plan, nothing of theirs broadcast, each cell of shares and parts once."""
    r = np.random.default_rng(7)
    x = np.floor(r.normal(size=(6000, 8)) * 64)
    sizes = []
    for n in (600, 6000):
        rows = spark.createDataFrame([(k, (v / 64).tolist()) for k, v in enumerate(x[:n])], "vec_id long, embedding array<double>")
        got = topk.top_k(rows, 3, every=2, share_bytes=8 << 10, cell_packs=4)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan.splitlines()))
        assert got.count() == 3 * n // 2 and "broadcast" not in plan.lower()
    assert sizes[0] == sizes[1]
    found = collections.defaultdict(list)
    for g in got.collect():
        found[g.query_id].append((g.rank, g.score, g.vec_id))
    for q in range(0, 6000, 500):
        score = x @ x[q]
        want = sorted(((-int(s), k) for k, s in enumerate(score.tolist()) if k != q))[:3]
        assert sorted(found[q]) == [(n + 1, -s, k) for n, (s, k) in enumerate(want)]


def test_groups_are_pruned():
    """Groups whose bound no query reaches aren't opened."""
    r = np.random.default_rng(2)
    middle = r.normal(size=(10, 16)) * 300
    x = [np.floor(m + r.normal(size=(300, 16)) * 10).astype(np.int64) for m in middle]
    groups = [topk.Group(np.arange(300) + 300 * k, v) for k, v in enumerate(x)]
    best = topk.Best(groups[0].ids[::20], x[0][::20], np.full(15, topk._NONE), 20)
    best.meet_all(groups)
    assert best.blocks < 15 * 19 * 4
    for i in range(15):
        score = np.vstack(x) @ x[0][20 * i]
        assert best.rows[i].tolist() == sorted((k for k in range(3000) if k != 20 * i), key=lambda k: (-score[k], k))[:20]


def test_blocks_are_pruned():
    """Of vectors in clusters, far less than all blocks are scored, and the result is that of scoring all."""
    r = np.random.default_rng(1)
    middle = r.normal(size=(40, 16)) * 300
    x = np.floor(middle[np.sort(r.integers(0, 40, 4000))] + r.normal(size=(4000, 16)) * 20).astype(np.int64)
    ids = np.arange(4000)
    best = topk.Best(ids[::20], x[::20], np.full(200, topk._NONE), 20)
    best.take(ids, x)
    assert best.scored < 0.2 * best.blocks
    for i, q in enumerate(ids[::20]):
        score = x @ x[q]
        assert best.rows[i].tolist() == sorted((k for k in ids.tolist() if k != q), key=lambda k: (-score[k], k))[:20]


# --- lines


def brute_lines(rows, min_chars, min_docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(list)
    for k, t in rows:
        for x in {key(line) for line in (t or "").split("\n")}:
            if len(x) >= min_chars:
                holders[x].append(k)
    gone = {x: max(ks) for x, ks in holders.items() if len(ks) >= min_docs}
    out = {}
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if not (key(line) in gone and gone[key(line)] != k)]
        out[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_line_dedup_against_counting(spark, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    r = random.Random(6)
    pool = [f"Line number {k} of the pool" + "é" * r.randint(0, 3) for k in range(60)] + ["short", ""]
    rows = [(k, "\n".join(r.choice([str.upper, str, lambda s: f"  {s}\t"])(r.choice(pool)) for _ in range(r.randint(0, 9)))) for k in range(120)] + [(500, None), (501, "")]
    out = line_dedup.drop_shared_lines(docs(spark, rows).withColumn("n_lines", F.lit("clash")), 24, 3, block).collect()
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.text) for x in out} == brute_lines(rows, 24, 3)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert sorted(line_dedup.PerfectHash.build(keys)(keys).tolist()) == list(range(len(keys)))


def test_odd_lines(spark):
    assert line_dedup.drop_shared_lines(odd(spark)).count() == len(ODD)
    own = line_dedup.drop_shared_lines(odd(spark, ["n_lines", "n_dropped"]), counts=False)
    assert {r.n_lines for r in own.collect()} == {"clash"} and own.columns == odd(spark, ["n_lines", "n_dropped"]).columns
    assert line_dedup.drop_shared_lines(docs(spark, [])).count() == 0


# --- near duplicates


def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, distance):
    group = {k: k for k in prints}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    ks = sorted(prints)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {k: root(k) for k in ks}


def test_fingerprints(spark):
    rows = [(k, t) for k, t in ODD if k not in (5, None)]
    for r in simhash.fingerprints(docs(spark, rows)).collect():
        assert r.fp & (1 << 64) - 1 == brute_print(dict(rows)[r.doc_id])


@pytest.mark.parametrize(("distance", "dense"), [(2, 256), (2, 1), (1, 1), (3, 256), (3, 1)])
def test_links_find_all_components(spark, distance, dense):
    r = random.Random(distance)
    prints = {}
    for c in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            for b in r.sample(range(64), r.randint(0, 3)):
                x ^= 1 << b
            prints[len(prints)] = x
    nodes = {}
    for k, x in prints.items():
        nodes.setdefault(x, k)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(k, signed(x)) for x, k in nodes.items()], "node long, fp long")
    found = simhash.links(table, distance, dense=dense)
    for e in found.collect():
        assert (prints[e.a] ^ prints[e.b]).bit_count() <= distance
    want = brute_groups({k: x for x, k in nodes.items()}, distance)
    got = {x.node: x.component for x in simhash.components(found).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_near_duplicates(spark):
    base = " ".join(f"w{k % 97}x{k}" for k in range(900))
    rows = [(10, base), (4, base), (30, base.replace("w5x5 ", "")), (2, "another text of its own"), (7, None), (6, " \n")]
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute_groups({k: brute_print(t) for k, t in rows}, 2)
    kept = simhash.keep_one(docs(spark, rows)).collect()
    assert {x.doc_id for x in kept} == {v for v in got.values()}
    assert simhash.near_duplicates(odd(spark, ["fp", "component_id"])).count() == len(ODD)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [1 << 14, 3])
def test_near_copies_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash.jaccard, "DENSE", 2)
    monkeypatch.setattr(simhash.jaccard, "HOT", hot)
    monkeypatch.setattr(simhash.jaccard, "SKEW", 0)
    r = random.Random(8)
    rows = []
    for _ in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 5, 12, 60, 200]))]
        for _ in range(r.randint(1, 8)):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                text[r.randrange(len(text))] = f"x{r.randint(0, 5)}"
            rows.append((len(rows), " ".join(text).upper() if r.random() < 0.2 else " ".join(text)))
    rows += [(k + 1000, t) for k, t in ODD if k not in (5, None)]

    def cut(text):
        ws = (text or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    def set_print(text):
        key, _, _ = simhash.jaccard.shingles(pa.array([text or ""]), 5)
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in key.tolist()) > len(key))

    sets, prints = {k: cut(t) for k, t in rows}, {k: set_print(t) for k, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and sets[a]
    ids = sorted(sets)
    group = {k: k for k in ids}
    for _ in ids:
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if group[a] != group[b] and (similar(a, b) or (prints[a] ^ prints[b]).bit_count() <= 2):
                    group = {k: min(group[a], group[b]) if v in (group[a], group[b]) else v for k, v in group.items()}
    far = [(a, b) for a in ids for b in ids if a < b and similar(a, b) and (prints[a] ^ prints[b]).bit_count() > 2]
    assert len(far) > 5
    assert {x.doc_id: x.component_id for x in simhash.near_copies(docs(spark, rows)).collect()} == group
    kept = simhash.keep_one(docs(spark, rows), 5, similarity=(4, 5)).collect()
    assert {x.doc_id for x in kept} == set(group.values())
    if hot == 3:
        return
    assert simhash.near_copies(odd(spark, ["set", "component_id"])).count() == len(ODD)
    assert simhash.near_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize("similarity", [None, (4, 5)])
def test_keep_one_edge_cases(spark, similarity):
    """Repeated rows, rows without an id, nulls, long texts, clashing columns, an empty table."""
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [
        (5, "a text that stands here three times"), (5, "a text that stands here three times"), (5, "a text that stands here three times"), (9, "a text that stands here three times"),
        (None, "a text that stands here three times"), (None, "text without any id at all"), (None, "another text without an id at all"), (7, "one more text on its own"),
        (3, None), (4, ""), (8, long), (6, long + " end"),
    ]
    table = docs(spark, rows).withColumns({c: F.lit("clash") for c in ("set", "fp", "component_id", "near_duplicate_key")})
    kept = simhash.keep_one(table, 5, similarity=similarity)
    want = [(3, None), (5, rows[0][1]), (6, long + " end"), (7, rows[7][1]), (None, rows[6][1]), (None, rows[5][1])]
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(want, key=str)
    assert kept.columns == table.columns
    assert simhash.keep_one(docs(spark, []), 5, similarity=similarity).count() == 0


def test_rows_without_an_id_link_only_their_own(spark):
    rows = [(5, "first text of its own here"), (None, "first text of its own here"), (9, "second one that differs wholly"), (None, "second one that differs wholly"), (None, "a third, of no id")]
    for found in (simhash.near_duplicates(docs(spark, rows)), simhash.near_copies(docs(spark, rows))):
        assert sorted(((x.doc_id, x.component_id) for x in found.collect()), key=str) == sorted([(5, 5), (None, 5), (9, 9), (None, 9), (None, None)], key=str)


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return sentence_pieces.Vocabulary()


def test_pieces_are_the_library_s(spark, vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.vocabulary_path())
    r = random.Random(1)
    texts = ["".join(r.choice("aab bcthe in▁\n.éß日𝔘") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["", " ", "  a  b", "<s> </s> <unk> <0x0A> a\x00b", "x" * 3000, "   " * 50, "Привет, восстановление"]
    rows = list(enumerate(texts))
    got = {x.doc_id: x for x in sentence_pieces.encode(docs(spark, rows).withColumn("ids", F.lit("clash")), vocabulary).collect()}
    for k, t in rows:
        assert got[k].ids == sp.encode(t) and got[k].n_tokens == len(got[k].ids) and got[k].decoded == t.replace("▁", " ")
    again = sentence_pieces.decode(spark.createDataFrame([(k, got[k].ids) for k in got] + [(-1, None), (-2, [None, 10**6])], "doc_id long, ids array<int>"), vocabulary)
    assert {x.doc_id: x.text for x in again.collect()} == {**{k: t.replace("▁", " ") for k, t in rows}, -1: "", -2: ""}


def test_odd_pieces(spark, vocabulary):
    got = sentence_pieces.encode(odd(spark, ["n_tokens"]), vocabulary).collect()
    assert len(got) == len(ODD)
    assert collections.Counter(x.decoded for x in got) == collections.Counter(t or "" for _, t in ODD)
    assert sentence_pieces.encode(docs(spark, []), vocabulary).count() == 0


# --- shared kernels


def test_words_and_hashes():
    rows = ["ab cd", "", "ef", "gh-ij ", "kl"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    start, end, before = _arrow.words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == ["ab", "cd", "ef", "gh", "ij", "kl"]
    assert np.diff(before).tolist() == [2, 0, 1, 2, 1]
    assert (_arrow.RangeHash(data)(start, end) == _arrow.hash_bytes([b"ab", b"cd", b"ef", b"gh", b"ij", b"kl"])).all()
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256("".encode()).hexdigest()


def test_license_matches_are_all_kept_beside_the_chosen_ones(spark):
    rows = [(1, "this work is licensed under a creative commons attribution noncommercial 4 0 international license"), (2, "all rights reserved"), (3, "nothing here")]
    got = {r.doc_id: (r.labels, r.contained) for r in licenses.license_labels(docs(spark, rows)).collect()}
    assert got == {1: ("cc-by-nc", "cc-by,cc-by-nc,cc-by-sa"), 2: ("proprietary", "proprietary"), 3: ("", "")}
    assert licenses.license_labels(docs(spark, rows).where(F.lit(False))).count() == 0


def test_license_statements_without_end_take_linear_time():
    index = licenses.Index(licenses.TEMPLATES, {}, licenses.THRESHOLD)
    took = []
    for n in (20_000, 200_000):
        block = [w.encode() for w in ("released under the mit license and this work is licensed under cc by nc 4 0 x all rights reserved ".split() * (n // 20))]
        began = time.process_time()
        kept, _ = index.match(block, [i for i, w in enumerate(block) if index.rank.get(w) in index.lists])
        took.append(time.process_time() - began)
        assert len(kept) == 3 * (n // 20)
    assert took[1] < 25 * max(took[0], 0.05)


def test_taken_ranges_are_as_all_compared():
    r = random.Random(8)
    for _ in range(200):
        taken, every = licenses.Taken(), []
        for _ in range(20):
            a = r.randint(0, 40)
            b = a + r.randint(0, 6)
            assert taken.meets(a, b) == any(a <= d and c <= b for c, d in every)
            taken.add(a, b)
            every.append((a, b))


@pytest.mark.parametrize(
    ("text", "kind", "said"),
    [
        ("at one hundred ninety two dot one sixty eight dot one dot one.", "ip", "one hundred ninety two dot one sixty eight dot one dot one"),
        ("ip two hundred and ten dot zero dot one dot twelve", "ip", "two hundred and ten dot zero dot one dot twelve"),
        ("mail j o h n @ e x a m p l e . c o m now", "email", "j o h n @ e x a m p l e . c o m"),
        ("juan arroba ejemplo punto com", "email", "juan arroba ejemplo punto com"),
        ("écrire à luc arobase exemple point fr", "email", "luc arobase exemple point fr"),
        ("a_at_" + "b" * 50 + "_dot_com", "email", "a_at_" + "b" * 50 + "_dot_com"),
        ("x" * 60 + "_at_example_dot_com", "email", "x" * 60 + "_at_example_dot_com"),
        ("a_at_b_dot_c_dot_d_dot_e_dot_com", "email", "a_at_b_dot_c_dot_d_dot_e_dot_com"),
        ("user at a dot b dot c dot d dot e dot com", "email", "user at a dot b dot c dot d dot e dot com"),
        ("anna dot b dot c dot d dot e dot f at host dot org", "email", "anna dot b dot c dot d dot e dot f at host dot org"),
    ],
)
def test_pii_has_no_caps_and_reads_hundreds_and_other_marks(text, kind, said):
    _, every = pii.find(text)
    assert every == [(pii.KINDS.index(kind), text.index(said), text.index(said) + len(said))]


@pytest.mark.parametrize("text", ["Our office at amazon dot com headquarters", "The meeting at booking dot com", "They shop at target dot com", "It peaked at that point in time", "one hundred people met at noon."])
def test_pii_leaves_prose_alone(text):
    assert pii.find(text) == ([], [])


def test_pii_chains_without_end_take_little_time():
    began = time.process_time()
    for text in ("a dot " * 100_000, "a_b_" * 50_000 + " dot", "x [dot] " * 60_000, "a . " * 60_000 + "dot", "a@b dot c " * 20_000):
        pii.find(text)
    assert time.process_time() - began < 20
