"""The pipeline's stages on a small corpus against brute force, and the entry's registration."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import entry, op8_simhash, op10_decontaminate

SYLLABLES = {"en": ["the", "ing", "er", "and", "on", "th", "sh", "ou"], "de": ["sch", "ü", "ein", "ung", "be", "ich", "der", "ß"]}


def prose(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 9]) for i in range(0, n, 9))


def edited(rng, text, share):
    return "\n".join(" ".join(w if rng.random() > share else "new" + str(rng.randrange(99)) for w in line.split(" ")) for line in text.split("\n"))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    folder = str(tmp_path_factory.mktemp("corpus"))
    bench = [(i, prose(rng, "en", 40).replace("\n", " ")) for i in range(5)]
    rows = [(i, prose(rng, "en" if i % 3 else "de", rng.randrange(80, 400)), "en" if i % 3 else "de") for i in range(60)]
    for i in range(60, 75):  # copies of 0..4 with few edits, exact copies of 5..9, leaks
        rows.append((i, edited(rng, rows[i % 5][1], 0.01) if i < 65 else rows[i % 5 + 5][1] if i < 70 else prose(rng, "en", 60) + "\n" + bench[i % 5][1], "en"))
    rows += [(80, "12345 67890 !!", "en"), (81, "", "en"), (82, None, None), (83, "the thing and another", None), (None, prose(rng, "en", 90), "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t) if t else None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_do_their_work(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]
    one = stages["language_id"](spark, docs, corpus).cache()
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {80, 81, 82}
    two = stages["line_dedup"](spark, one, corpus).cache()
    assert all(r.n_chars == len(r.text) for r in two.collect()) and two.columns == docs.columns
    three = stages["near_dedup"](spark, one, corpus).cache()  # on the texts before line dedup: copies are still there
    text = {r.doc_id: r.text for r in one.collect() if r.doc_id is not None}
    sets = {i: shingles(t) for i, t in text.items()}
    parent = {i: i for i in text}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(text), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert {r.doc_id for r in three.collect()} == {i for i in text if find(i) == i} | {None}
    four = stages["decontaminate"](spark, three, corpus).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    cache = op10_decontaminate._Hashes()
    held = [h for _, t in items if len(h := op10_decontaminate.word_hashes(t, cache)) >= op10_decontaminate.LEAST_ITEM]
    leaked = {r.doc_id for r in three.collect() if any(holds(own, op10_decontaminate.word_hashes(r.text, cache)) for own in held)}
    assert leaked == set(range(70, 75)) and {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - leaked
    packed = stages["packing"](spark, four, corpus).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in four.collect()}


def holds(own, words):
    """Whether the item lies anywhere on the words: all places are tried."""
    n, size = len(own), min(13, len(own))
    around = np.concatenate([np.zeros(n, np.uint64), words, np.zeros(n, np.uint64)])
    same = np.cumsum(np.pad(np.lib.stride_tricks.sliding_window_view(around, n) == own, ((0, 0), (1, 0))), axis=1)
    return bool((same[:, size:] - same[:, :-size] >= np.ceil(0.8 * size - 1e-9)).any())


def test_run_and_empty_table(spark, corpus, tmp_path):
    assert corpus_pipeline.run(spark, corpus).count() > 0
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_large_groups_of_near_copies_are_found_whole(spark):
    rng = random.Random(3)
    base = prose(rng, "en", 300)
    rows = [(i, edited(rng, base, 0.008)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in op8_simhash.one_of_each(df).collect()}
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert kept == {find(i) for i in range(len(rows))}


def test_meetings_of_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op8_simhash, "BLOCK", 7)
    test_large_groups_of_near_copies_are_found_whole(spark)
    test_pairs_in_large_buckets_of_a_template_are_found(spark)


def test_rows_without_ids_and_with_odd_columns(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, "en", 120) for _ in range(3))
    rows = [(None, a), (None, a), (5, a), (7, edited(rng, a, 0.004)), (8, b), (8, c), (8, c), (9, None), (10, ""), (None, " \n"), (None, c + " x")]
    df = spark.createDataFrame([(*r, k, "z") for k, r in enumerate(rows)], "doc_id long, text string, gone int, h string")
    got = sorted(((r.doc_id, r.text) for r in op8_simhash.one_of_each(df).collect()), key=str)
    assert got == sorted([(5, a), (8, b), (8, c), (9, None)], key=str)
    assert op8_simhash.one_of_each(df).columns == df.columns and op8_simhash.one_of_each(df.limit(0)).count() == 0


def test_each_operator_has_its_query():
    names = [n.split("_")[0] for n in entry.QUERIES]
    assert names == [f"op{i}" for i in range(1, 14)] + ["pipeline"] and set(entry.ORACLES) <= set(entry.QUERIES)


def test_pairs_in_large_buckets_of_a_template_are_found(spark):
    """Texts of one template, unlike each other but in pairs: most share only buckets with many others."""
    rng = random.Random(4)
    base = prose(rng, "en", 800).split()
    rows = []
    for k in range(100):
        both, own = rng.sample(range(0, 800, 5), 3), [rng.sample(range(0, 800, 5), 8) for _ in range(2)]
        for j in range(2):
            words = [f"own{k}x{j}x{i}" if i in own[j] else f"both{k}x{i}" if i in both else w for i, w in enumerate(base)]
            rows.append((2 * k + j, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, number = [shingles(t) for _, t in rows], {r.h: r.id for r in op8_simhash.keyed(df).collect()}
    links = [tuple(sorted((number[r.a], number[r.b]))) for r in op8_simhash.near_links(op8_simhash.keyed(df).select("h", "text")).collect()]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]

    def groups(edges):
        parent = list(range(len(rows)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        return [find(i) for i in range(len(rows))]

    assert set(links) <= set(pairs) and groups(links) == groups(pairs)


def test_a_template_of_unlike_texts_sends_no_sets(spark, monkeypatch):
    """Texts that share three quarters of a template meet by sketches only: what travels as sets is a small part."""
    rng = random.Random(5)
    shared = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(shared + [f"w{rng.randrange(10**9)}" for _ in range(100)])) for i in range(3000)]
    rows += [(3000, rows[7][1] + " end"), (3001, rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    asked, real = [], op8_simhash.shingle_sets
    monkeypatch.setattr(op8_simhash, "shingle_sets", lambda rows, wanted: (asked.append(wanted.count()), real(rows, wanted))[1])
    assert {r.doc_id for r in op8_simhash.one_of_each(df).collect()} == set(range(3000))
    assert asked[0] < 600  # sketches let about one in 30,000 pairs of similarity 0.6 pass
