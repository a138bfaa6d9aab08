"""Token alignment against whole texts encoded by the libraries and groups found offset by offset."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from holdfast.llm import queries, token_align
from tests.conftest import DATA
from tests.llm.test_operators import odd

TEXTS = [
    None, "", " ", "a", "a b", "  two  spaces ", "line\nbreaks\n\nand\r\nmore \n x", "tabs\tand nbsp", "don't 's stop, 'quoted' (text) 12 345", "naïve Größe élève niño",
    "日本語 とemoji 👍🏽 и кириллица", "▁ mark", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x41> x", "é ﬁ Ａ ½", "x" * 3000, "\x00\x01 ctrl\x7f", "a  b   c    d", "same same same",
    "same same same", "ᲀ Ⴧ 𞤀 new letters", "tail space ", "\nstarts", " starts", " sep  ​zero ﻿bom", "ſt. Ωmega (a) \"b\" 'c' d) e( f",
]


@pytest.fixture(scope="module")
def pair():
    return token_align.Pair(token_align.Files.read())


@pytest.fixture(scope="module")
def whole():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def tokens(pair, whole, text):
    """Ids of the whole text by the libraries, none if they don't give it back."""
    if not text:
        return [], []
    a, b = whole[0].encode(" " + text, add_special_tokens=False).ids, whole[1].encode(text)
    if any(b"".join(spelled[i] for i in ids) != b" " + text.encode() for spelled, ids in ((pair.a_bytes, a), (pair.b_bytes, b))):
        return [], []
    return a, b


def brute(pair, whole, rows):
    ends = lambda spelled, ids: [int(x) for x in np.cumsum([len(spelled[i]) for i in ids])]
    found, count = [], collections.Counter()
    for k, text in rows:
        a, b = tokens(pair, whole, text)
        ea, eb = ends(pair.a_bytes, a), ends(pair.b_bytes, b)
        at_b = {e: j for j, e in enumerate(eb)}
        links = [(a[i], b[at_b[e]]) for i, e in enumerate(ea) if e in at_b]
        count.update(links)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            m, n = ea.index(cut, i) + 1, eb.index(cut, j) + 1
            groups.append("|".join(",".join(map(str, ids)) for ids in (a[i:m], b[j:n])))
            i, j = m, n
        found.append((k, a, b, groups, links))
    most = collections.Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return {
        (k, len(a), len(b), len(g), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls))
        for k, a, b, g, ls in found
    }


def test_documents_are_as_brute_force(spark, pair, whole):
    got = {tuple(r) for r in token_align.aligned_documents(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(pair, whole, enumerate(TEXTS))


def test_query_is_as_brute_force(spark, pair, whole):
    table = pq.read_table(f"{DATA}/sf0.001/documents.parquet", columns=["doc_id", "text"])
    got = {tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum")) for r in queries.op13_token_align(spark, f"{DATA}/sf0.001").collect()}
    assert got == brute(pair, whole, zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def test_coalesce_is_as_interval_by_interval():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 30))
        cuts = [np.unique(np.append(r.integers(1, n + 1, int(r.integers(0, n))), n)) for _ in range(2)]
        a, b = (np.diff(np.append(0, c)) for c in cuts)
        got = token_align.coalesce(a, b)
        both = np.intersect1d(*cuts)
        assert got.group_a.tolist() == np.searchsorted(both, cuts[0]).tolist() and got.group_b.tolist() == np.searchsorted(both, cuts[1]).tolist()
        over = [(i, j) for i, e in enumerate(cuts[0]) for j, f in enumerate(cuts[1]) if max(e - a[i], f - b[j]) < min(e, f)]
        assert list(zip(got.over_a.tolist(), got.over_b.tolist(), strict=True)) == over
        assert got.linked.tolist() == [cuts[0][i] == cuts[1][j] for i, j in over]


def test_forgetting_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{(k * 7 + i) % 61}x" for i in range(20)) for k in range(40)]
    files = token_align.Files.read()
    want = token_align.Aligner(files).align(texts)
    monkeypatch.setattr(token_align, "REMEMBERED", 30)
    small = token_align.Aligner(files)
    parts = [small.align(texts[k : k + 2]) for k in range(0, 40, 2)]
    assert sum((p[3] for p in parts), []) == want[3] and np.concatenate([p[5] for p in parts]).tolist() == want[5].tolist()
    assert len(small.known) <= 30 + 40


def test_links_are_bounded_by_the_vocabularies(pair):
    assert 100_000 < pair.possible_links() < 1_000_000


def test_odd_rows_empty_table_and_clashing_columns(spark):
    got = token_align.aligned_documents(odd(spark, ("n_a", "links", "groups")))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 9 and rows[1].n_a == rows[2].n_links == 0 and rows[1].groups_sha256 == "" and rows[7].n_a > 0 and None in rows
    assert token_align.aligned_documents(odd(spark).where(F.lit(False))).count() == 0


def test_link_numbers_are_both_ids(spark, pair):
    width = token_align.link_ids(token_align.Files.read())
    (row,) = token_align.alignments(spark.createDataFrame([(1, "the cat")], "doc_id long, text string")).collect()
    assert [(pair.a_bytes[x // width], pair.b_bytes[x % width]) for x in row.links] == [(b" the", b" the"), (b" cat", b" cat")]
