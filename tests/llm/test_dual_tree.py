"""Operator 13 against brute force, its pruning and the odd rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op13_dual_tree as dt

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 75 + 75 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("block", [dt.BLOCK, 40])
def test_equals_brute_force_with_ties_copies_and_odd_rows(spark, block):
    rng = random.Random(5)
    text = lambda n: " ".join(f"W{int(rng.random() ** 3 * 60)}" for _ in range(n))
    docs = [(i, text(rng.randrange(1, 30))) for i in range(400)] + [(i, "w1 W2, w3!") for i in range(400, 460)]
    docs += [(None, "w1 w2 w3"), (None, None), (500, ""), (501, " -- "), (7, "w5 w5"), (7, "w5 w5"), (502, "Éa éa x" + "y" * 5000 + " w9" * 3000)]
    items = [(1, "w1 w2 w3"), (2, text(8)), (3, None), (4, "unknown"), (5, "É éa w9 w9"), (5, "w40"), (None, "w7-w8")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    got = rows(dt.ranked_search(spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0)), d, block=block))
    want = brute(items, docs)
    assert got == want and len(want) > 30


def test_equals_sql_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(dt.op13_dual_tree(spark, sf)) == sorted(con.execute(dt.ORACLE).fetchall(), key=str)


def test_empty_tables(spark):
    items, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert dt.ranked_search(items, docs).count() == dt.ranked_search(some, docs).count() == 0


def test_node_bounds_hold_and_prune_most_of_the_work():
    rng = np.random.default_rng(2)
    vector = lambda topic: (np.unique(rng.integers(topic * 20, topic * 20 + 20, 12)), None)
    docs = [(v, rng.integers(1, 900, len(v))) for v in (vector(i // 100)[0] for i in range(4000))]
    items = [(v, rng.integers(1, 900, len(v))) for v in (vector(i // 2)[0] for i in range(80))]
    tree = dt.hierarchy(docs, np.arange(4000), [dt.LEAF, dt.FAN])
    assert len(tree[-1]) == 1 and len(tree[1]) == 250
    known = dt.Items(list(range(80)), dt.hierarchy(items, np.zeros(80, np.int64), [dt.FAN]), 800)
    best, weights = dt.Best(80, 10), np.zeros(800, np.int64)
    dt.search(known, tree, best, weights)
    assert not weights.any() and best.scored < 0.1 * 80 * 4000
    for j, (cols, values) in enumerate(items):
        weights[cols] = values
        exact = np.array([(weights[c] * v).sum() for c, v in docs])
        for level in tree[1:]:
            fan = {250: 16, 32: 128, 4: 1024, 1: 8192}[len(level)]
            assert (np.maximum.reduceat(exact, np.arange(0, 4000, fan)) <= level.bounds(np.arange(len(level)), weights)).all()
        order = np.lexsort((np.arange(4000), -exact))[:10]
        order = order[exact[order] > 0]
        assert best.ids[j].tolist() == order.tolist() and best.scores[j].tolist() == exact[order].tolist()
        weights[cols] = 0
