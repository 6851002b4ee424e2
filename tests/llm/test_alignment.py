"""Operator 11 against a brute-force alignment token by token."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op11_alignment as al

ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a\tb \n c  ", "  lead", "trail  \n", "naïve café — “quotes” 🙂🙂", "▁ x", "x▁y", "<|endoftext|> hi", "hi<|endoftext|>there", "<s> </s> <unk> <0x41>",
    "日本語のテキスト 日本語", "Привет мир привет", "x" * 3000, "ab " * 700, "ﬁ ligature", "\x00 nul \x00", "don't we'll I'm", "1234567890 12,345.67", " no break  em", "a\u0085b c", "new\r\nline", "é combining", "﻿bom",
]


def brute(texts):
    """The digest columns for a list of (doc_id, text), from whole texts and byte by byte."""
    import public_tokenizers
    from tokenizers import Tokenizer

    by = al.aligner(*al.default_tokenizers())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    letters = al.byte_letters()
    entry = {i: bytes(letters[c] for c in e) for e, i in tok.get_vocab(with_added_tokens=False).items() if all(c in letters for c in e)}
    rows, held = [], Counter()
    for doc, text in texts:
        a, b, whole = [], [], (" " + (text or "")).encode()
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, by.b.encode(text)
            if b"".join(entry[x] for x in a) != whole or b"".join(by.b_bytes[x] for x in b) != whole:
                a, b = [], []
        owner = {}
        at, ends_a, ends_b = 0, [], []
        for k, x in enumerate(a):
            for _ in entry[x]:
                owner[at] = k
                at += 1
            ends_a.append(at)
        links, at = set(), 0
        for k, x in enumerate(b):
            for _ in by.b_bytes[x]:
                links.add((owner[at], k))
                at += 1
            ends_b.append(at)
        cuts, groups, i_a, i_b = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for hi in cuts:
            j_a, j_b = ends_a.index(hi, i_a) + 1, ends_b.index(hi, i_b) + 1
            groups.append((a[i_a:j_a], b[i_b:j_b]))
            i_a, i_b = j_a, j_b
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        pairs = [(a[x], b[y]) for x, y in links]
        held.update(set(pairs))
        rows.append((doc, len(a), len(b), len(groups), pairs, hashlib.sha256(text.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted((i, na, nb, ng, len(p), sum(held[x] == best[x[0]] for x in p), sum(held[x] for x in p), sha, ns) for i, na, nb, ng, p, sha, ns in rows)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]


def test_odd_texts_equal_brute_force(spark):
    texts = list(enumerate(ODD)) + [(100, ODD[11]), (100, ODD[11])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_a", F.lit("clash"))
    got = sorted(map(tuple, al.document_links(docs).select(*COLUMNS).collect()))
    assert got == brute(texts)
    assert al.document_links(docs.limit(0)).count() == 0


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, al.document_links(docs).select(*COLUMNS).collect())) == brute(texts)


@pytest.mark.parametrize("sizes", [(500, 2000), (500, 10**9), (10**9, 500)])
def test_cells_of_any_size_give_the_same_counts(spark, sizes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    by = al.aligner(*al.default_tokenizers())
    rows = spark.createDataFrame(al.marked(docs, *al.default_tokenizers()).toPandas(), al._MARKED)
    whole = al.looked_up(rows, al.pair_counts(rows, by.b_size), by.a_size, by.b_size)
    parts = al.looked_up(rows, al.pair_counts(rows, by.b_size, gathered=100), by.a_size, by.b_size, *sizes)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_segments_are_forgotten_and_texts_with_odd_segments_stay_apart(monkeypatch):
    by = al.Aligner(*al.default_tokenizers())
    monkeypatch.setattr(al, "SEGMENTS", 3)
    first = by.known(["a b c d e", "x▁y z", None])
    (codes, _, none), known = first
    assert none == [] and list(known.counts[0]) == [1, 1, 1, 1, 1, 0, 1]
    again, other = by.known(["e d", "e"])
    assert other is not known and again == [[0, 1], [0]] and other.texts[0] == known.texts[codes[4]]


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(3)

    def random_csr(n, m):
        dense = rng.random((n, m)) < 0.2
        return dense.astype(int), al.Csr(np.concatenate(([0], np.cumsum(dense.sum(axis=1)))), np.nonzero(dense)[1], m)

    for n, k, m in ((5, 7, 6), (1, 1, 1), (20, 3, 9)):
        (x, a), (y, b) = random_csr(n, k), random_csr(k, m)
        rows, cols, values = al.product(a, b)
        dense = np.zeros((n, m), int)
        dense[rows, cols] = values
        assert (dense == x @ y).all() and (values > 0).all()
        t = b.transposed()
        assert (np.diff(t.starts) == y.sum(axis=0)).all() and t.width == k


def test_alignments_give_spans_links_and_shared_groups(spark):
    docs = spark.createDataFrame([(1, "naïve tokenizers"), (2, None), (3, "ab▁c")], "doc_id long, text string")
    got = {r.doc_id: r for r in al.alignments(docs, shared=True).collect()}
    assert not got[2].ok and not got[3].ok and got[3].links == []
    r = got[1]
    assert r.a_ends[-1] == r.b_ends[-1] == r.group_ends[-1] == len(" naïve tokenizers".encode())
    span = lambda ends, i: (ends[i - 1] if i else 0, ends[i])
    for x in r.links:
        (a0, a1), (b0, b1) = span(r.a_ends, x.a), span(r.b_ends, x.b)
        assert x.bytes == min(a1, b1) - max(a0, b0) > 0
    assert {(x.a, x.b) for x in r.links} <= {(x.a, x.b) for x in r.shared}
