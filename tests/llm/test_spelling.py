"""Spelling variants against all pairs of words compared one by one."""

import collections
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from holdfast.llm import queries, spelling
from tests.conftest import DATA
from tests.llm.test_operators import odd


def apart(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, min_chars=5, min_count=3, typo=97):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    near = collections.defaultdict(set)
    shapes = collections.defaultdict(set)  # words that give the same when a code point goes or is left open
    for w in n:
        for k in range(len(w)):
            shapes[w[:k] + "?" + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in n:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for some in shapes.values():
        for w in some:
            near[w] |= some - {w}
    form = {}
    for w, ws in near.items():
        if ws and n[best := min(ws, key=lambda v: (-n[v], v))] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, c, len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return out


def rows_of(df):
    return {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect()}


@pytest.mark.parametrize("right", [True, False])
def test_search_finds_all_with_one_error_across_the_other_half(right):
    r = random.Random(1)
    for _ in range(100):
        words, asked = (sorted({"".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(n)}) for a, n in (("abé", 40), ("abéz", 20)))
        words = r.sample(words, len(words))
        got = set(zip(*(x.tolist() for x in spelling.near_words(words, asked, right)), strict=True))
        half = lambda w: w[len(w) // 2 :] if right else w[: len(w) // 2]
        rest = lambda v, w: v[: len(v) - len(half(w))] if right else v[len(half(w)) :]
        fits = lambda v, w: (v.endswith(half(w)) if right else v.startswith(half(w))) and apart(rest(v, w), rest(w, w))
        assert got == {(i, k) for i, w in enumerate(asked) for k, v in enumerate(words) if fits(v, w)}


@pytest.mark.parametrize("block", [1 << 20, 300, 40])
def test_variants_are_as_all_pairs(spark, block):
    """Small blocks split halves that many words share, by words and by queries."""
    r = random.Random(7)
    roots = ["".join(r.choice("abcd") for _ in range(r.randint(4, 9))) for _ in range(60)] + ["straße", "niñoñ", "ÉTÉété"]
    rows = [(k, " ".join(r.choice(roots)[r.randint(0, 1) :] + r.choice(["", "", "", "s"]) for _ in range(40)) + ", Mixed-Case×words") for k in range(40)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    want = brute([*rows, rows[0]], typo=7)
    assert len(want) > 80 and any(w[3] for w in want)
    assert rows_of(spelling.variants(df, typo=7, block_chars=block)) == want


def test_query_is_as_all_pairs(spark):
    table = pq.read_table(f"{DATA}/sf0.001/documents.parquet", columns=["doc_id", "text"])
    assert rows_of(queries.op12_spelling(spark, f"{DATA}/sf0.001")) == brute(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)] + [("x", "w3")], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w20"} and spelling.roots(chain).count() == 21


def test_odd_rows_ties_empty_table_and_clashing_columns(spark):
    got = {r.word: r for r in spelling.variants(odd(spark, ("word", "n", "form"))).collect()}
    assert set(got) == set() and spelling.variants(odd(spark).where(F.lit(False))).count() == 0
    text = "worda worda worda worda worda worda wordb wordb wordb wordb wordb wordb wordc wordc wordc " + "y" * 3000 + (" " + "x" * 3000) * 3
    got = {r.word[:5]: r for r in spelling.variants(spark.createDataFrame([(None, text), (1, None), (2, "")], "doc_id long, text string"), typo=1 << 40).collect()}
    assert set(got) == {"worda", "wordb", "wordc", "xxxxx"}
    assert (got["wordc"].form, got["wordc"].n_near, got["worda"].form, got["worda"].root, got["xxxxx"].n_near) == ("worda", 2, None, "worda", 0)
