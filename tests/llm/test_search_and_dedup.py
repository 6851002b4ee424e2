"""Operators 1, 7, 8 and 10 against brute force, with the odd rows each must handle."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import common, op1_topk, op7_line_dedup, op8_simhash, op10_decontaminate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in texts], DOCS)


def sentences(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


# --- components


def test_components_of_chains_stars_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (5, None), (100, 101)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 130)}


# --- 1: top-k


def brute_top(vectors, k=5):
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors}
    out = []
    for q in (i for i in ints if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 40)])
def test_topk_is_exact_with_ties_and_several_blocks(spark, blocks):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=64) / 8]) for i in range(300)]
    vectors += [(i, vectors[7][1]) for i in range(300, 340)]  # copies: ties
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = op1_topk.top_k(df, F.col("vec_id") % 50 == 0, 5, *blocks)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(vectors)


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (1, [0.5, 0.5]), (50, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = op1_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 128)]
    assert op1_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.integers(-256, 256, (50, 64)).astype(float), rng.integers(-256, 256, (50, 64)).astype(float)
    for n in op1_topk.LEVELS:
        assert (op1_topk.segment_features(x, n) @ op1_topk.segment_features(y, n).T >= x @ y.T - 1e-6).all()


# --- 7: line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip(" \t\n\x0b\x0c\r"):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abcde  ") for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    got = {r.doc_id: r.text for r in op7_line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_odd_rows(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "\n\n\n\n"), (7, "\n\n\n\n"), (None, "q\na\nb\nc"), (8, "r\nr\nr\nr\nr")]
    out = op7_line_dedup.dedup_lines(docs_of(spark, rows).withColumn("n_lines", F.lit(9)))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert got[None] == ("q\na\nb\nc", 4, 0) and got[1] == ("d", 4, 3) and got[2] == ("x\ny", 6, 4)
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5][2] == 0 and got[6][2] == got[7][2] == 0
    assert got[8] == ("r", 5, 4)
    assert op7_line_dedup.dedup_lines(docs_of(spark, rows).limit(0)).count() == 0


# --- 8: SimHash


def brute_fingerprint(text):
    words = [w for w in op_words(text or "") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    base = [sentences(rng, 300) for _ in range(15)]
    texts = base + [" ".join(w if rng.random() > 0.004 else "x" for w in rng.choice(base).split()) for _ in range(60)]
    texts += ["", None, " \t", "One", "one", "ONE two", "Ünï ünÏ", "a b c", base[0].upper()]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash.near_duplicates(docs_of(spark, rows)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i][1] for i in range(len(texts))] == brute_components(fps)


def test_links_find_every_distance_up_to_three(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(3):  # chains of steps of one to four bits
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            fps.append(x)
    fps += [0, 0xFFFFFFFFFFFFFFFF, 1, 7, 0x8000000000000000, 0xC000000000000000 ^ 1]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in dict.fromkeys(signed)], "fp long")
    linked = {r.node: r.component for r in common.components(op8_simhash.links(op8_simhash.with_neighbour_in_half(df))).collect()}
    groups = brute_components(fps)
    of = {s: g for s, g in zip(signed, groups, strict=True)}
    for a, b in itertools.combinations(of, 2):
        assert (of[a] == of[b]) == (linked.get(a, a) == linked.get(b, b))


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (6, None), (7, "")]
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in op8_simhash.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert [x[2] for x in got] == [5, 6, 6, 5, 5]
    assert op8_simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


# --- 10: decontamination


def brute_leak(item, text):
    a, b = op10_decontaminate._WORD.findall(item.lower()), op10_decontaminate._WORD.findall(text.lower())
    size = min(13, len(a))
    for start in range(-len(a) + 1, len(b)):
        for p in range(len(a) - size + 1):
            if sum(0 <= start + p + j < len(b) and a[p + j] == b[start + p + j] for j in range(size)) >= 0.8 * size - 1e-9:
                return True
    return False


def test_masks_survive_every_two_substitutions():
    for bad in itertools.combinations(range(13), 2):
        assert any(all(s + i not in bad for i, x in enumerate(m) if x == "1") for m in op10_decontaminate.MASKS for s in range(14 - len(m)))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(i, sentences(rng, n)) for i, n in enumerate([30, 40, 13, 8, 5, 3, 1, 20])] + [(8, None), (9, ""), (10, "!!!")]
    texts = []
    for i in range(120):
        words = sentences(rng, 80).split()
        item = (items[rng.randrange(8)][1]).split()
        part = item[rng.randrange(3) :] if len(item) > 13 else item
        part = [w if rng.random() > 0.12 else "zz" for w in part]
        at = rng.randrange(80)
        texts.append((i, " ".join(words[:at] + part + words[at:]) if i % 2 else " ".join(words)))
    texts += [(500, None), (501, ""), (502, items[0][1].upper()), (503, " ".join(items[0][1].split()[:13]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in texts for i, x in items if t and x and op10_decontaminate._WORD.findall(x) and brute_leak(x, t)}
    for bits in (27, 8):  # in 256 bits, most hashes without a partner pass too
        got = op10_decontaminate.leaks(docs_of(spark, texts), bench, least=1, bits=bits).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    kept = {r.doc_id for r in op10_decontaminate.clean(docs_of(spark, texts), bench, least=1).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in want}
    assert op10_decontaminate.leaks(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert op10_decontaminate.leaks(docs_of(spark, texts).limit(0), bench).count() == 0


def test_huge_components_are_exact_or_leave(spark):
    rows = [(0, [3e15, -3e15]), (1, [3e15, 1.0]), (2, [2e15, -1e15]), (3, [1e30, 1.0]), (4, [1e9, 1e9]), (5, [-3e15, 3e15])]
    got = {r.vec_id: r.score for r in op1_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect()}
    a = [int(256 * 3e15), int(256 * -3e15)]
    exact = {i: a[0] * int(256 * x) + a[1] * int(256 * y) for i, (x, y) in rows if i not in (0, 3)}
    assert got == {i: min(2**63 - 1, max(-(2**63), x)) for i, x in exact.items()}


def test_rows_that_repeat_lose_their_lines_and_odd_columns_stay(spark):
    text = "\n".join(f"line {i}" for i in range(6))
    rows = [(1, text, i) for i in range(3)] + [(None, "a\nb\nc", 7), (0, "x\na\nb\nc", 8), (2, None, 9), (3, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k int").withColumns({c: F.lit(c) for c in ("r", "row", "at", "new", "_t")})
    out = op7_line_dedup.dedup_lines(df).collect()
    assert sorted(r.n_removed for r in out if r.doc_id == 1) == [0, 6, 6] and sorted(r._k for r in out) == [0, 1, 2, 7, 8, 9, 9]
    assert {r.text for r in out if r.doc_id == 0} == {"x"} and all((r.r, r.row, r._t) == ("r", "row", "_t") for r in out)


def overlap(item, text):
    """The best overlap by the operator's own steps, within one process."""
    cache = op10_decontaminate._Hashes()
    own, words = (op10_decontaminate.word_hashes(x, cache) for x in (item, text))
    rows = lambda x: {h: (np.frombuffer(at, np.int32), np.frombuffer(t, np.uint8).reshape(-1, op10_decontaminate.AROUND)) for h, at, t in op10_decontaminate._by_hash(x, op10_decontaminate.masks_of(len(own)), lambda h: np.ones(len(h), bool))}
    seeds, hits = rows(own), rows(words)
    places = [op10_decontaminate.shifts(*hits[h], *seeds[h], len(own)) for h in hits.keys() & seeds.keys()]
    best = [op10_decontaminate.best_overlap(own, words[a:z], (at - a).tolist()) for a, z, at in op10_decontaminate.stretches(np.unique(np.concatenate(places)), len(own), len(words))]
    return max(best, key=lambda x: x or ())


def test_repeated_words_take_bounded_memory():
    import tracemalloc

    for n, m in ((4000, 4000), (60_000, 300)):
        for item, text in (("word " * m, "word " * n), ("a b " * (m // 2), "a b " * (n // 2))):
            tracemalloc.start()
            assert overlap(item, text) == (m, 0, m)
            assert tracemalloc.get_traced_memory()[1] < 200_000_000
            tracemalloc.stop()


def test_places_by_convolution_are_all_differences():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = (np.unique(rng.integers(0, 500, rng.integers(1, 60))) for _ in range(2))
        assert op10_decontaminate.all_differences(x, y).tolist() == sorted({int(a - b) for a in x for b in y})


def test_leaks_of_copies_and_of_items_that_repeat(spark):
    words = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(1, words), (1, words), (None, words), (2, "p q r s t u v w x y z a b")], "item_id long, text string")
    docs = docs_of(spark, [(i % 2, f"so {words}") for i in range(6)] + [(None, f"{words} end"), (9, "w1 w2 w3 w4 w5 alone"), (8, "p q r s t u v w x y z a"), (7, "q r s t u v w x y z a b c")])
    got = sorted(((r.doc_id, r.item_id, r.start, r.words, r.matched) for r in op10_decontaminate.leaks(docs, bench).collect()), key=str)
    want = [(i % 2, k, 1, 40, 40) for i in range(6) for k in (1, 1, None)] + [(None, k, 0, 40, 40) for k in (1, 1, None)] + [(8, 2, 0, 12, 12), (7, 2, 0, 12, 12)]
    assert got == sorted(want, key=str)
    assert sorted(r.doc_id for r in op10_decontaminate.clean(docs, bench).collect()) == [9]
    assert op10_decontaminate.items_of(spark.createDataFrame([(1, "the"), (2, "a b c d")], "item_id long, text string")).count() == 0


def test_words_of_many_texts_are_those_of_each():
    cache, rng = op10_decontaminate._Hashes(), random.Random(9)
    signs = "aAbßİΣς_9é中文\u0301\u00ad\u0378𝔸٣ \t\n.,-\u2028\u00a0\x00"
    texts = ["", "ΑΣ", "Σ", "İx", "_", "...", "x" * 9000, "y" * 8999 + "z " + "y" * 9000, "ΑΣ"] + ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(300)]
    known = {}
    for stretch in (1, 7, 1 << 17):
        words, ends = op10_decontaminate.words_of(texts, cache, stretch)
        for text, part in zip(texts, np.split(words, ends)[:-1], strict=True):
            for word, h in zip(op10_decontaminate._WORD.findall(text.lower()), part.tolist(), strict=True):
                assert known.setdefault(word, h) == h
        assert ends[-1] == len(words)
    assert len(set(known.values())) == len(known) > 500
    assert all(bool(op10_decontaminate._WORD.match(chr(i))) == bool(x) for i, x in enumerate(cache.letters.tolist()))


def test_hits_of_many_texts_are_those_of_each(monkeypatch):
    cache, rng = op10_decontaminate._Hashes(), random.Random(4)
    texts = ["", "w1"] + [sentences(rng, rng.randrange(40), 3) for _ in range(60)] + ["", "w1 w2 w1", ""]
    masks, passing = op10_decontaminate.MASKS, lambda h: h % np.uint64(3) > 0
    alone = []
    for i, text in enumerate(texts):
        words = op10_decontaminate.word_hashes(text, cache)
        for mask in masks:
            h = op10_decontaminate.mask_hashes(words, mask)
            for x in np.unique(h[passing(h)]):
                at = np.flatnonzero(h == x)
                around = [bytes(int(words[j] % 254) + 2 if 0 <= j < len(words) else 0 for j in range(k - 10, k + 13)) for k in at]
                alone.append((i, int(x.astype(np.int64)), at.tolist(), around))
    words, ends = op10_decontaminate.words_of(texts, cache)
    for hits in (1 << 17, 5):  # rows in one batch, or in many
        monkeypatch.setattr(op10_decontaminate, "HITS", hits)
        together = []
        for h, text, edges, places, around in op10_decontaminate.hits_in(words, ends, masks, passing):
            at, tags = (op10_decontaminate._binary(edges, x).to_pylist() for x in (places, around))
            together += [(i, x, np.frombuffer(a, np.int32).tolist(), [t[j : j + 23] for j in range(0, len(t), 23)]) for i, x, a, t in zip(text.tolist(), h.tolist(), at, tags, strict=True)]
        assert sorted(together) == sorted(alone) and len(alone) > 1000


def test_hits_of_a_long_text_take_time_in_proportion():
    import time

    words = op10_decontaminate.word_hashes(" ".join(f"w{i}" for i in range(40_000)), op10_decontaminate._Hashes())
    began = time.process_time()
    assert sum(1 for _ in op10_decontaminate._by_hash(words, ("11111",), lambda h: np.ones(len(h), bool))) == 39_996
    assert time.process_time() - began < 4


def test_texts_share_the_work_of_a_stretch(monkeypatch):
    seen = []
    inner = op10_decontaminate.mask_hashes
    monkeypatch.setattr(op10_decontaminate, "mask_hashes", lambda words, mask: seen.append(mask) or inner(words, mask))
    words, ends = op10_decontaminate.words_of(["one two three four five six"] * 1000, op10_decontaminate._Hashes())
    found = list(op10_decontaminate.hits_in(words, ends, ("11111",), lambda h: np.ones(len(h), bool)))
    assert seen == ["11111"] and sum(len(h) for h, *_ in found) == 2000


def test_short_items_and_odd_columns_of_decontamination(spark):
    bench = spark.createDataFrame([(1, "the"), (2, "alpha beta gamma delta epsilon zeta"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the cat"), (2, "say alpha beta gamma delta epsilon zeta now"), (None, None), (4, "")], "doc_id long, text string").withColumns({"item_id": F.lit("i"), "start": F.lit("s")})
    assert [(r.doc_id, r.item_id) for r in op10_decontaminate.leaks(docs, bench).collect()] == [(2, 2)]
    kept = op10_decontaminate.clean(docs, bench)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4] and kept.columns == docs.columns
    assert {r.item_id for r in op10_decontaminate.short_items(bench).collect()} == {1, 3}
