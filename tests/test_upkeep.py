"""Purge and repair over all stores, on a small base with a text that two documents share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import indexing as ix
from sparkloom.operators import retrieval as rt
from sparkloom.operators import upkeep as up



def stores(spark, spoil=False):
    chunks = [("c1", "d1", "h1", "alpha words"), ("c2", "d1", "shared", "both say this"), ("c3", "d2", "shared", "both say this"), ("c4", "d2", "h4", "delta"), ("c5", "d3", "h5", "epsilon")]
    rows = [(c, d, "child", h, t, "", "") for c, d, h, t in chunks] + [("p1", "d1", "parent", "hp", "x", "", "")]
    table = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_level string, content_hash string, embed_text string, title string, heading_path string")
    kids = table.filter("chunk_level = 'child'")
    bad = ["c4", "c5"] if spoil else []
    vectors = rt.embed_chunks(kids.filter(~F.col("chunk_id").isin(bad)), rt.hashing_embedder)
    cache = kids.filter(~F.col("content_hash").isin(["h5"] if spoil else [])).dropDuplicates(["content_hash"])
    cache = rt.embed_chunks(cache, rt.hashing_embedder, key="content_hash")
    registry = spark.createDataFrame([("s1", "d1", "ready", 1), ("s2", "d2", "ready", 2), ("s3", "d3", "ready", 3)], "source_id string, doc_id string, status string, seq int")
    docs = spark.createDataFrame([("d1", "s1"), ("d2", "s2"), ("d3", "s3"), *([("d9", "s9")] if spoil else [])], "doc_id string, source_id string")
    postings = rt.postings_of(kids.filter(~F.col("chunk_id").isin(bad)))
    ids = vectors.select("chunk_id")
    if spoil:
        table = table.union(spark.createDataFrame([("c9", "d9", "child", "h9", "orphan text", "", "")], table.schema))
        ids = ids.union(spark.createDataFrame([("ghost",)], "chunk_id string"))
        cache = cache.union(spark.createDataFrame([("nobody", [0.0])], cache.schema))
        postings = postings.union(spark.createDataFrame([("t", "ghost", "d", 1, 1)], postings.schema))
    out = up.Stores(registry, docs, table, vectors, ids, postings, cache)
    return up.refreshed(out) if not spoil else up.replace(up.refreshed(out), manifest=spark.createDataFrame([(9, 9, 9)], "document_count long, child_chunk_count long, embedding_count long"))


def ids(df, key="chunk_id"):
    return sorted({r[key] for r in df.collect()})


def test_purge_keeps_cached_vectors_that_another_document_uses(spark):
    base = stores(spark)
    one = up.purge(base, source_ids=spark.createDataFrame([("s1",), ("s1",)], "source_id string"), at=F.lit("2024-01-01").cast("timestamp"))
    assert ids(one.documents, "doc_id") == ["d2", "d3"] and ids(one.chunks) == ["c3", "c4", "c5"] == ids(one.embeddings) == ids(one.vector_ids) == ids(one.postings)
    assert ids(one.cache, "content_hash") == ["h4", "h5", "shared"]
    latest = {r.source_id: r.status for r in ix.latest_by_key(one.registry, "source_id", ["seq"]).collect()}
    assert latest == {"s1": "tombstoned", "s2": "ready", "s3": "ready"}
    m = one.manifest.first()
    assert (m.source_count, m.document_count, m.child_chunk_count, m.embedding_count) == (2, 2, 3, 3) and str(m.built_at).startswith("2024-01-01")
    both = up.purge(base, doc_ids=spark.createDataFrame([("d1",), ("d2",), ("no such",)], "doc_id string"))
    assert ids(both.cache, "content_hash") == ["h5"] and both.registry.count() == 3
    assert up.purge(base).documents.count() == 3


def test_repair_leaves_no_repairable_issue_and_embeds_only_what_is_missing(spark, tmp_path):
    log = str(tmp_path / "asked")

    def embed(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return rt.hashing_embedder(texts)

    base, raw = stores(spark, spoil=True), spark.createDataFrame([("s1",), ("s2",)], "source_id string")
    check = lambda s: ix.validate_index(s.registry, raw, s.documents, s.chunks, s.embeddings, s.vector_ids, s.postings.select("chunk_id").distinct(), s.manifest, s.cache)
    issues = check(base)
    plan = [(r.step, r.code, r.n) for r in up.repair_plan(issues).orderBy("step").collect()]
    assert [p[1] for p in plan] == list(up.STEPS) and plan[0] == (1, "ORPHAN_PROCESSED_DOC", 1)
    out = up.repair(base, issues, embed)
    left = check(out).collect()
    assert [(r.code, r.resource_id) for r in left] == [("MISSING_RAW", "s3")] and not left[0].repairable
    assert ids(out.embeddings) == ids(out.vector_ids) == ids(out.postings) == ["c1", "c2", "c3", "c4", "c5"]
    assert ids(out.cache, "content_hash") == ["h1", "h4", "h5", "shared"]
    assert set(open(log).read().split("\n")) == {"epsilon", ""}  # delta's vector is cached
    got = {r.chunk_id: r.vector for r in out.embeddings.collect()}
    assert got["c4"] == pytest.approx(np.asarray(rt.hashing_embedder(["delta"]))[0].tolist())


def every_check(s, raw):
    return (s.registry, raw, s.documents, s.chunks, s.embeddings, s.vector_ids, s.postings.select("chunk_id").distinct(), s.manifest, s.cache)


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_checks_by_digest_are_those_by_joins(spark, buckets):
    base, raw = stores(spark, spoil=True), spark.createDataFrame([("s1",), ("s2",)], "source_id string")
    twice = base.chunks.filter("chunk_id IN ('c1', 'p1')")
    base = up.replace(base, chunks=base.chunks.union(twice), documents=base.documents.union(spark.createDataFrame([("empty", "s1"), ("empty", "s1")], base.documents.schema)))
    got, want = (sorted(map(str, f(*every_check(base, raw), *more).collect())) for f, more in ((ix.validate_by_digest, [buckets]), (ix.validate_index, [])))
    assert got == want and len(got) >= 12


def test_a_clean_base_opens_no_bucket(spark):
    base, raw = stores(spark), spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "source_id string")
    base = up.replace(base, manifest=spark.createDataFrame(base.manifest.collect(), base.manifest.schema))
    out = ix.validate_by_digest(*every_check(base, raw))
    assert out.count() == 0 and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_diff_by_digest_equals_the_diff(spark):
    old, new = stores(spark).chunks, stores(spark).chunks.filter("chunk_id <> 'c5'")
    new = new.withColumn("content_hash", F.when(F.col("chunk_id") == "c2", "other").otherwise(F.col("content_hash"))).union(spark.createDataFrame([("n1", "d7", "child", "h", "t", "", "")], new.schema))
    rows = lambda d: sorted((r.chunk_id, r.doc_id, r.content_hash, r.status) for r in d.collect())
    assert rows(ix.diff_by_digest(old, new)) == rows(ix.diff_snapshots(old, new))
    moved = rows(ix.diff_by_digest(old, new, ix.document_digests(old), ix.document_digests(new), unchanged=False))
    assert moved == [r for r in rows(ix.diff_snapshots(old, new)) if r[3] != "unchanged"] and len(moved) == 3
