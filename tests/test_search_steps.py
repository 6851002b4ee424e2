import sys
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import documents as dx
from sparkloom.functions import text as tx
from sparkloom.operators import indexing as ix
from sparkloom.operators import retrieval as rt
from sparkloom.operators import snapshots as sn
from sparkloom.sources.tables import write_index


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(120)] + ["w1 w2 common"] * 150 + [""]
    rows = [(f"c{i:04}", f"d{i % 50}", "", "", t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, title string, heading_path string, embed_text string").repartition(3)
    asked = [(i, " ".join(rng.choice(words, 4))) for i in range(9)] + [(20, "common w1"), (21, "unknown"), (22, "")]
    return chunks, spark.createDataFrame(asked, "query_id long, query string")


def hits(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "doc_id", "score", "rank").collect()))


def joined(queries, index, k):
    """BM25 by a join of all pairs."""
    q = queries.select("query_id", F.explode(rt.tx.tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(index.term_stats, "term")
    average = index.doc_stats.agg(F.avg("dl")).first()[0]
    share = F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / average))
    scored = index.postings.join(q, "term").groupBy("query_id", "chunk_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * share), 9).alias("score"))
    return rt.top_k(scored.filter("score > 0"), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def test_keyword_search_by_chunk_equals_the_join(spark, corpus, monkeypatch):
    chunks, queries = corpus
    index = rt.build_keyword_index(chunks)
    want = hits(joined(queries, index, 7))
    assert len(want) > 60 and [x[1] for x in want if x[0] == 20] == [f"c{i:04}" for i in range(120, 127)]  # of equal chunks the first
    found = rt.keyword_search(queries, index, 7)
    assert hits(found) == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair of a query and a chunk is made in rows
    assert hits(rt.keyword_search(queries, rt.index_of(index.postings), 7)) == want
    for name, n in {"QUERY_BLOCK": 3, "ROW_BLOCK": 100, "TOGETHER": 2, "CELLS": 64}.items():
        monkeypatch.setattr(rt, name, n)
    assert hits(rt.keyword_search(queries, index, 7)) == want


def test_a_task_sends_its_best_rows_once():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(6, 4)), np.round(rng.normal(size=(500, 4)))
    queries = pd.DataFrame({"query_id": range(6), "vector": x.tolist()})
    rows = pd.DataFrame({"chunk_id": [f"c{i:03}" for i in range(500)], "vector": [*y[:-1].tolist(), [np.inf, 0.0, 0.0, 1.0]]})
    got = pd.concat(rt._nearest(queries, (rows.iloc[a : a + 10] for a in range(0, 500, 10)), 5))
    assert len(got) == 6 * 5  # however many batches
    ok = np.linalg.norm(y[:-1], axis=1) > 0
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(unit(x) @ unit(y[:-1][ok]).T, 9)
    for i in range(6):
        want = sorted(zip(-score[i], rows["chunk_id"][:-1][ok], strict=True))[:5]
        assert got["chunk_id"][got["query_id"] == i].tolist() == [c for _, c in want]


def test_block_max_search_scores_chunks_not_pairs(spark, corpus, tmp_path):
    chunks, queries = corpus
    index = sn.write_snapshot(chunks, f"file://{tmp_path}/s", 4)
    found = sn.block_max_search(queries, index, 7).hits
    assert hits(found) == hits(rt.keyword_search(queries, rt.build_keyword_index(chunks), 7))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # nothing is summed up by query and chunk


def test_an_upsert_stores_what_several_steps_read(spark, corpus):
    chunks, _ = corpus
    diff = chunks.select("chunk_id", F.when(F.col("chunk_id") < "c0010", "removed").when(F.col("chunk_id") < "c0020", "changed").otherwise("unchanged").alias("status"))
    for of in (rt.build_keyword_index(chunks), rt.index_of(rt.postings_of(chunks))):
        got = ix.upsert_index(of, diff, chunks)
        assert "MapInArrow" not in got.postings._jdf.queryExecution().optimizedPlan().toString()
        want = rt.build_keyword_index(chunks.filter("chunk_id >= 'c0010'"))
        rows = lambda x: sorted(map(tuple, x.postings.select("term", "chunk_id", "doc_id", "tf", "dl").collect()))
        assert rows(got) == rows(want)


def test_stored_ids_take_about_their_content(spark, tmp_path):
    ids = spark.range(20_000).select(F.lit("t").alias("term"), F.concat(F.lit("chk_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20)).alias("chunk_id"))
    write_index(str(tmp_path), 2, postings=ids)
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 20_000 * 18  # 10 bytes each, 24 as text


def test_contradictions_are_members_with_their_links(spark):
    from sparkloom.operators import memory as me

    rows = [(f"m{i:03}", "semantic", "active", "Solar" if i % 2 else "solar", f"rule {i % 3}", i) for i in range(30)] + [("x", "semantic", "active", "wind", "rule 1", 1), ("y", "semantic", "archived", "wind", "rule 2", 1), ("z", "semantic", "active", "solar", None, 1)]
    mem = spark.createDataFrame(rows, "memory_id string, memory_type string, status string, concept string, abstraction string, at long").withColumn("created_at", F.timestamp_seconds("at").cast("timestamp_ntz"))
    pairs = [(p.memory_a, p.memory_b) for p in me.contradicting_pairs(mem).collect()]
    got = {r.memory_id: r for r in me.contradicting_members(mem).collect()}
    assert len(got) == 30 and {m: r.n_links for m, r in got.items()} == {m: sum(m in p for p in pairs) for m in got}
    assert {r.side for r in got.values()} == {"m027", "m028", "m029"} and sum(r.n_links for r in got.values()) == 2 * len(pairs)


def test_built_in_vector_search_leaves_pairs_below_a_known_kth_score(spark):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.integers(-2, 3, 70 if i % 3 else 4).astype(float).tolist()) for i in range(300)], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(i, rng.integers(-2, 3, 70 if i % 4 else 4).astype(float).tolist()) for i in range(9)], "query_id long, vector array<double>")
    want = sorted(map(tuple, rt.vector_search(q, v, 5).collect()))
    for numbers in (10**6, 100):  # in one block, in blocks
        found = rt.vector_search_sql(q, v, 5, numbers)
        assert sorted(map(tuple, found.collect())) == want and len(want) == 45
        assert "least" in found._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_counted_in_python_are_sparks_for_every_sign(spark):
    signs = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"x_1-{'y'.join(signs[a : a + 500])} İstanbul ΟΔΟΣ" for a in range(0, len(signs), 500)]
    rows = spark.createDataFrame([(str(i), "d", "", "", t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, title string, heading_path string, embed_text string")
    got = {r.chunk_id: (dict(zip(r.terms, r.tfs, strict=True)), r.dl) for r in rt.forward_of(rows).collect()}
    want = {r.chunk_id: Counter(r.t) for r in rows.select("chunk_id", tx.tokenize(F.col("embed_text")).alias("t")).collect()}
    assert got == {k: (dict(n), n.total()) for k, n in want.items()}


def test_workers_hold_small_batches_whatever_the_table(spark):
    """A worker's memory follows its batches: 10,000 whole texts a batch were its peak on large tables."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    most = []

    def extract(files):
        return files.assign(title=str(len(files)), body="b")[["uri", "title", "body"]]

    files = spark.range(0, 5000, 1, 1).select(F.col("id").cast("string").alias("uri"), F.lit("x").alias("format"), F.lit(b"a").alias("content"))
    most.append(dx.extract_registered(files, {"x": extract}).agg(F.max(F.col("title").cast("int"))).first()[0])
    rows = files.select(F.col("uri").alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit("").alias("title"), F.lit("").alias("heading_path"), F.lit("a").alias("embed_text"))
    docs = rows.select("doc_id", F.lit("s").alias("source_id"), "title", F.lit("a").alias("body"))
    for step in (lambda: rt.forward_of(rows), lambda: rt.postings_of(rows), lambda: rt.embed_chunks(rows, rt.hashing_embedder), lambda: dx.chunk_documents(docs)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert step().count() >= 5000
        most.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(most) <= 1000


def test_hits_meet_chunks_without_a_shuffle_of_the_texts(spark):
    chunks = spark.createDataFrame([(f"c{i}", "child", f"p{i // 4}", f"text {i}", "t") for i in range(40)] + [(f"p{i}", "parent", None, f"whole {i}", "t") for i in range(10)], "chunk_id string, chunk_level string, parent_chunk_id string, body_text string, title string")
    hits = spark.createDataFrame([(1, "c5", 1), (1, "gone", 2), (2, "c39", 1)], "query_id long, chunk_id string, rank int")
    out = rt.expand_parents(hits, chunks)
    assert sorted((r.query_id, r.chunk_id, r.text) for r in out.collect()) == [(1, "c5", "whole 1"), (1, "gone", ""), (2, "c39", "whole 9")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_pairs_are_left_out_without_rounding_them(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(300, 6)), np.zeros((2, 6)), np.eye(6)[:1].repeat(30, axis=0)])
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, [1.0, 2.0]), (901, None)], "chunk_id long, vector array<double>")
    queries = vectors.filter("chunk_id % 9 = 0 OR chunk_id IN (301, 320, 900)").withColumnRenamed("chunk_id", "query_id")
    got = rt.vector_search_sql(queries, vectors, 7)
    join = next(line for line in spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple").split("\n") if "Join" in line)
    assert "round(" not in join.lower()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {900: [(900, 1.0)]}
    for r in queries.collect():
        if r.query_id < 900 and x[r.query_id].any():
            score = np.round(unit @ unit[r.query_id], 9)
            want[r.query_id] = [(int(i), score[i]) for i in sorted(np.flatnonzero(x.any(axis=1)), key=lambda i: (-score[i], i))[:7]]
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert found.keys() == want.keys() and all([i for i, _ in found[q]] == [i for i, _ in want[q]] for q in want)
