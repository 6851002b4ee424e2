"""Operator 12 against brute force over all pairs, its sketches, and groups of several blocks."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op12_odd_sketch as od


def brute(docs, least=85):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= least * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    out = [(i, len(sets[k]), ids.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def copies(rng, base, n, share):
    """n copies of words, each with a share of its words replaced."""
    return [" ".join(f"x{rng.random()}" if rng.random() < share else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("sizes", [(od.BLOCK, od.BLOCK_BYTES), (16, 10**9), (4096, 30_000)])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = copies(rng, base, 60, 0.01) + copies(rng, base, 60, 0.016) + copies(rng, [f"v{i}" for i in range(60)], 30, 0.01)
    texts += [" ".join(f"u{i}" for i in range(k, k + 200)) for k in range(0, 160, 8)]  # a chain
    texts += ["a b c d e", "A b\tc D e", "a b", "a  B", "one", "", " ", None, None, "x y z " * 400, "x y z " * 300]
    docs = list(enumerate(rng.sample(texts, len(texts)))) + [(3, texts[0]), (None, texts[1]), (None, "alone here"), (5, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got, want = rows(od.near_duplicates(df, 85, *sizes)), brute(docs)
    assert got == want
    assert len({r[2] for r in want}) < len(docs) - 60


def test_equals_sql_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert rows(od.op12_odd_sketch(spark, sf)) == sorted(con.execute(od.ORACLE).fetchall(), key=str)


def test_empty_table(spark):
    assert od.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_tell_similarities_and_lose_none_at_the_threshold():
    rng = np.random.default_rng(4)
    most = od.most_bits(0.85)
    for similarity, passes in ((0.85, 1), (0.9, 1), (0.7, 0.35), (0.6, 0.05)):
        kept, guess = 0, []
        for _ in range(60):
            both = round(600 * similarity)
            x = rng.integers(0, 2**63, 600, dtype=np.uint64)
            sets = [np.concatenate((x[:both], x[both : (both + 600) // 2])), np.concatenate((x[:both], x[(both + 600) // 2 :]))]
            a, b = (od.odd_sketch(od.min_hashes(np.sort(s))) for s in sets)
            differ = int(np.bitwise_count(a ^ b).sum())
            kept += differ <= most
            guess.append(float(od.estimate(differ)))
        assert abs(np.mean(guess) - similarity) < 0.02
        assert kept == 60 if passes == 1 else kept <= 60 * passes
