"""Purge and repair over all stores of a knowledge base: documents, chunks, embeddings, both indexes, cache, registry, manifest.

A content hash may belong to chunks of several documents, so cached vectors go only when no chunk is left that uses them: hashes
of what goes are compared with those of what stays, and nothing else is read twice. Every function returns all stores.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialized
from . import indexing as ix
from . import retrieval as rt


@dataclass
class Stores:
    """registry (source_id, status, seq[, doc_id]), documents (doc_id, source_id), chunks (chunk_id, doc_id, chunk_level, content_hash, embed_text),
    embeddings (chunk_id, vector), vector_ids (chunk_id), postings (chunk_id, ...), cache (content_hash, vector), manifest."""

    registry: DataFrame
    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    vector_ids: DataFrame
    postings: DataFrame
    cache: DataFrame
    manifest: DataFrame | None = None


def children(stores: Stores) -> DataFrame:
    return stores.chunks.filter("chunk_level = 'child'")


def refreshed(stores: Stores, at: Column | None = None) -> Stores:
    """The stores with a manifest of what they hold: counts by the sources' latest status, and when it was made."""
    latest = ix.latest_by_key(stores.registry.select("source_id", "status", "seq"), "source_id", ["seq"])
    manifest = ix.build_manifest(latest, stores.documents, stores.chunks, stores.embeddings)
    return replace(stores, manifest=manifest.withColumn("built_at", F.current_timestamp() if at is None else at))


def without_documents(stores: Stores, doc_ids: DataFrame) -> Stores:
    """The stores without some documents (doc_id): their chunks, vectors and postings go, and cached vectors that no other document uses.

    A chunk id that another document has too, which the integrity check reports, stays in the indexes.
    """
    gone = doc_ids.select("doc_id").distinct()
    lost = materialized(children(stores).join(gone, "doc_id", "left_semi").select("chunk_id", "content_hash"), "lost")
    chunks = stores.chunks.join(gone, "doc_id", "left_anti")
    kept = chunks.filter("chunk_level = 'child'")
    ids = materialized(lost.select("chunk_id").distinct().join(kept, "chunk_id", "left_anti"), "gone-ids")
    hashes = materialized(lost.select("content_hash").distinct().join(kept, "content_hash", "left_anti"), "gone-hashes")
    drop = lambda df, rows, key: df.join(rows, key, "left_anti")
    return replace(
        stores, documents=drop(stores.documents, gone, "doc_id"), chunks=chunks, embeddings=drop(stores.embeddings, ids, "chunk_id"), vector_ids=drop(stores.vector_ids, ids, "chunk_id"),
        postings=drop(stores.postings, ids, "chunk_id"), cache=drop(stores.cache, hashes, "content_hash"),
    )


def purge(stores: Stores, source_ids: DataFrame | None = None, doc_ids: DataFrame | None = None, at: Column | None = None) -> Stores:
    """The stores without the documents of some sources (source_id), which get a tombstone in the registry, and without single documents (doc_id)."""
    spark = stores.documents.sparkSession
    sources = spark.createDataFrame([], "source_id string") if source_ids is None else source_ids.select("source_id").distinct()
    gone = stores.documents.join(sources, "source_id", "left_semi").select("doc_id")
    if doc_ids is not None:
        gone = gone.union(doc_ids.select("doc_id"))
    out = without_documents(stores, materialized(gone.distinct(), "purged"))
    last = stores.registry.agg(F.max("seq").alias("last"))
    stones = sources.crossJoin(F.broadcast(last)).select("source_id", F.lit("tombstoned").alias("status"), (F.coalesce("last", F.lit(0)) + 1).alias("seq"))
    return refreshed(replace(out, registry=stores.registry.unionByName(stones, allowMissingColumns=True)), at)


#: Codes of the integrity check in the order in which they are mended, and what is done.
STEPS = {
    "ORPHAN_PROCESSED_DOC": "remove documents", "STALE_VECTOR_ENTRY": "remove vector entries", "STALE_KEYWORD_ENTRY": "remove postings", "ORPHANED_CACHE": "remove cached vectors",
    "MISSING_EMBEDDINGS": "embed missing chunks", "VECTOR_INDEX_MISMATCH": "add missing vectors", "KEYWORD_INDEX_MISMATCH": "add missing postings", "MANIFEST_MISMATCH": "refresh the manifest",
}


def repair_plan(issues: DataFrame) -> DataFrame:
    """step, action, code, n: what repair does about issues (code, resource_id, repairable), in order; n counts the issues of a code."""
    spark = issues.sparkSession
    order = spark.createDataFrame([(i, a, c) for i, (c, a) in enumerate(STEPS.items(), 1)], "step int, action string, code string")
    return issues.filter("repairable").groupBy("code").agg(F.count("*").alias("n")).join(F.broadcast(order), "code").select("step", "action", "code", "n")


def repair(stores: Stores, issues: DataFrame, embed_fn: rt.EmbedFn, dims: int = rt.DIMENSIONS, at: Column | None = None) -> Stores:
    """The stores with what the repairable issues (as validate_index gives them) name mended, in the order of STEPS.

    Only missing chunks are embedded, each distinct content once and none whose vector the cache has; only missing chunks get new
    postings. The manifest comes last. Issues that are not repairable stay.
    """
    issues = materialized(issues.filter("repairable").select("code", "resource_id"), "issues")
    named = lambda code, key: issues.filter(F.col("code") == code).select(F.col("resource_id").alias(key)).distinct()
    out = without_documents(stores, named("ORPHAN_PROCESSED_DOC", "doc_id"))
    stale = named("STALE_VECTOR_ENTRY", "chunk_id")
    out = replace(out, embeddings=out.embeddings.join(stale, "chunk_id", "left_anti"), vector_ids=out.vector_ids.join(stale, "chunk_id", "left_anti"))
    out = replace(out, postings=out.postings.join(named("STALE_KEYWORD_ENTRY", "chunk_id"), "chunk_id", "left_anti"), cache=out.cache.join(named("ORPHANED_CACHE", "content_hash"), "content_hash", "left_anti"))

    kids = children(out).dropDuplicates(["chunk_id"])
    missing = materialized(kids.join(out.embeddings.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "content_hash", "embed_text"), "missing")
    known = out.cache.groupBy("content_hash").agg(F.first("vector").alias("vector"))
    new = missing.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("embed_text").alias("embed_text"))
    fresh = materialized(rt.embed_chunks(new, embed_fn, dims=dims, key="content_hash"), "embedded")
    found = missing.join(known.unionByName(fresh), "content_hash").select("chunk_id", "vector")
    embeddings = out.embeddings.select("chunk_id", "vector").unionByName(found)
    absent = kids.select("chunk_id").join(out.vector_ids, "chunk_id", "left_anti")
    lacking = kids.join(out.postings.select("chunk_id"), "chunk_id", "left_anti")
    postings = out.postings.unionByName(rt.postings_of(lacking).select(*out.postings.columns))
    out = replace(out, embeddings=embeddings, vector_ids=out.vector_ids.select("chunk_id").unionByName(absent), postings=postings, cache=out.cache.select("content_hash", "vector").unionByName(fresh))
    return refreshed(out, at)
