"""Pivot search against the plain exact search; what it leaves out."""

import numpy as np
import pytest

from sparkloom.operators import pivots as pv
from sparkloom.operators import retrieval as rt


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize(("size", "pivots"), [(20, 30), (5000, 256), (7, 2)])
def test_equals_the_plain_search_with_ties_copies_and_odd_rows(spark, size, pivots):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    make = lambda n: (centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, 8))).tolist()
    data = [(f"c{i:04}", x) for i, x in enumerate(make(600))]
    data += [(f"t{i:03}", data[3][1]) for i in range(40)] + [("zero", [0.0] * 8), ("none", None), ("short", [1.0]), ("hole", [None] * 8), ("nan", [float("nan")] * 8)]
    v = spark.createDataFrame(data, "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(i, x) for i, x in enumerate([*make(15), data[3][1], [0.0] * 8, None, [1.0]])], "query_id long, vector array<double>")
    index = pv.build_pivots(v, 8, size, pivots)
    assert index.rows.sum() == 640
    good = v.filter("chunk_id NOT IN ('hole', 'nan', 'short')")
    got = pv.pivot_search(q, index, 6)
    assert rows(got.hits) == rows(rt.vector_search(q, good, 6))
    many = pv.pivot_search(q, index, 10**6)
    assert many.hits.count() == 16 * 640


def test_blocks_far_away_are_left_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    make = lambda n: (centres[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, 16))).tolist()
    v = spark.createDataFrame([(i, x) for i, x in enumerate(make(2000))], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(make(40))], "query_id long, vector array<double>")
    got = pv.pivot_search(q, pv.build_pivots(v, 16, 50), 10)
    assert rows(got.hits) == rows(rt.vector_search(q, v, 10))
    assert got.met.count() < 0.25 * got.pairs


def test_empty_tables(spark):
    v = spark.createDataFrame([], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert pv.pivot_search(q, pv.build_pivots(v, 2), 3).hits.count() == 0
    some = spark.createDataFrame([(5, [0.0, 2.0])], "chunk_id long, vector array<double>")
    assert pv.pivot_search(q.limit(0), pv.build_pivots(some, 2), 3).hits.count() == 0
