"""Imports, incremental indexing, integrity, repair, manifests, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..sources.tables import materialized, small
from .retrieval import KeywordIndex, apply_filters, build_keyword_index, forward_of, index_of, listed, postings_of  # noqa: F401


def latest_by_key(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key of an append log, without sorting it."""
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def running_sum(df: DataFrame, part: list[str], run: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the running sum of value in each part, by order.

    run, a number that only grows with the order, cuts a part into runs: their totals are summed up first, so a task sorts one
    run and never a whole part.
    """
    rows = df.withColumns({"_run": run, "_v": value})
    totals = rows.groupBy(*part, "_run").agg(F.sum("_v").alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(W.partitionBy(*part).orderBy("_run")) - F.col("_total")).drop("_total")
    mine = [f"_{i}" for i in range(len(part) + 1)]
    keys = [*part, "_run"]
    before = before.withColumnsRenamed(dict(zip(keys, mine, strict=True)))
    joined = rows.join(before, [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, mine, strict=True)])
    inside = F.sum("_v").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn(name, F.col("_before") + inside).drop("_run", "_v", "_before", *mine)


def stale_ids(actual: DataFrame, expected: DataFrame, key: str = "chunk_id") -> DataFrame:
    return actual.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti")


def missing_ids(actual: DataFrame, expected: DataFrame, key: str = "chunk_id") -> DataFrame:
    return stale_ids(expected, actual, key)


UPLOAD_RUN = 10_000

# --- Imports


def validate_import(files: DataFrame, sources: DataFrame, max_bytes: int, supported) -> DataFrame:
    """files (uri, fingerprint, byte_size, suffix) with status new, duplicate, unsupported or error."""
    live = sources.select(F.col("uri").alias("s_uri"), F.col("fingerprint").alias("s_fp")).distinct()
    out = files.join(live, (F.col("uri") == F.col("s_uri")) & (F.col("fingerprint") == F.col("s_fp")), "left")
    status = F.when(~F.col("suffix").isin(*supported), "unsupported").when(F.col("byte_size") > max_bytes, "error").when(F.col("s_uri").isNotNull(), "duplicate").otherwise("new")
    return out.withColumn("status", status).drop("s_uri", "s_fp")


def import_summary(validated: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_files")
    return validated.agg(F.count("*").alias("total_files"), n("new"), n("duplicate"), n("unsupported"), n("error"), F.sum("byte_size").alias("total_bytes")).withColumn("ready", (F.col("error_files") == 0) & (F.col("new_files") > 0))


def import_progress(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "pending").alias("processed"), n("ingested").alias("ingested"), n("skipped").alias("skipped"), n("failed").alias("failed"))


def needs_reprocess(sources: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """Rows of sources (doc_id, fingerprint) without state, or whose fingerprint or pipeline version changed."""
    s = state.select("doc_id", F.col("source_fingerprint").alias("was"), F.col("pipeline_version").alias("at_version"), F.lit(True).alias("known"))
    out = sources.join(s, "doc_id", "left")
    same = F.col("known").isNotNull() & F.col("was").eqNullSafe(F.col("fingerprint")) & F.col("at_version").eqNullSafe(F.lit(version))
    return out.filter(~same).drop("was", "at_version", "known")


def split_failed(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose extraction gave text, and an error record for each of the others."""
    failed = extracted.filter("quality = 'failed'").select("doc_id", F.lit("EXTRACTION_FAILED").alias("code"), F.lit("no text could be extracted").alias("message"))
    return extracted.filter("quality <> 'failed'"), failed


def build_documents(extracted: DataFrame, intake: DataFrame) -> DataFrame:
    """Document records: extracted text (source_id, title, body[, language]) with intake data (source_id, uri, format, tags)."""
    language = F.coalesce("language", F.lit("en")) if "language" in extracted.columns else F.lit("en")
    return extracted.join(intake, "source_id").select(
        tx.doc_id(F.col("source_id")).alias("doc_id"), "source_id", "title", language.alias("language"), "format", tx.count_words(F.col("body")).alias("word_count"), F.length("body").alias("char_count"), tx.count_headings(F.col("body")).alias("heading_count"), F.col("uri").alias("source_uri"), "tags", "body"
    )


# --- Incremental index


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_id, doc_id, content_hash and status added, changed, removed or unchanged of the child chunks of two whole indexes."""
    child = lambda d, p: d.filter("chunk_level = 'child'").select("chunk_id", F.col("doc_id").alias(f"{p}_doc"), F.col("content_hash").alias(f"{p}_hash"))
    both = child(old, "old").join(child(new, "new"), "chunk_id", "full_outer")
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    return both.select("chunk_id", F.coalesce("new_doc", "old_doc").alias("doc_id"), F.coalesce("new_hash", "old_hash").alias("content_hash"), status.alias("status"))


def diff_chunks(old: DataFrame, new: DataFrame, ingested: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """diff_snapshots for a batch: only documents of the batch, or deleted (doc_id) ones, are compared; all others are left alone.

    ingested (doc_id) names the documents of the batch; by default those with chunks in new. One that is named and has no chunks
    left loses all it had.
    """
    touched = (new if ingested is None else ingested).select("doc_id")
    if deleted is not None:
        touched = touched.union(deleted.select("doc_id"))
    return diff_snapshots(old.join(touched.distinct(), "doc_id", "left_semi"), new)


def document_digests(chunks: DataFrame) -> DataFrame:
    """doc_id, digest: what a document's child chunks are, whatever their order. An index keeps these rows, so a batch's diff needs its own only."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "chunk_id", "content_hash").cast("decimal(38,0)"))
    kids = chunks.filter("chunk_level = 'child'").groupBy("doc_id")
    return kids.agg(F.concat_ws("/", h(1), h(2), F.count("*")).alias("digest"))


def diff_by_digest(old: DataFrame, new: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None, unchanged: bool = True) -> DataFrame:
    """diff_snapshots in two steps: documents whose digests (before, after: doc_id, digest) are equal leave before chunks are compared.

    Their chunks are listed as unchanged from new alone, or, with unchanged=False, not read at all.
    """
    before = document_digests(old) if before is None else before
    after = document_digests(new) if after is None else after
    both = before.withColumnRenamed("digest", "was").join(after, "doc_id", "full_outer")
    moved = materialized(both.filter(~F.col("was").eqNullSafe(F.col("digest"))).select("doc_id"), "moved")
    of = lambda d: d.join(moved, "doc_id", "left_semi")
    diff = diff_snapshots(of(old), of(new))
    if not unchanged:
        return diff.filter("status <> 'unchanged'")
    same = new.filter("chunk_level = 'child'").join(moved, "doc_id", "left_anti")
    return diff.unionByName(same.select("chunk_id", "doc_id", "content_hash", F.lit("unchanged").alias("status")))


def cache_key(provider: str, model: str, dims: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{provider}:{model}:{dims}:"), F.col("content_hash")), 256)


def plan_embeddings(chunks: DataFrame, cache: DataFrame, provider: str, model: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """Chunks whose vector is in cache (cache_key, vector), and the distinct content to embed for the others."""
    keyed = chunks.withColumn("cache_key", cache_key(provider, model, dims))
    hits = keyed.join(cache, "cache_key").withColumn("cache_hit", F.lit(True))
    misses = keyed.join(cache, "cache_key", "left_anti").groupBy("cache_key").agg(F.min("content_hash").alias("content_hash"), F.min("embed_text").alias("embed_text"), F.count("*").alias("n_chunks"))
    return hits, misses


def merge_embeddings(diff: DataFrame, old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vectors (chunk_id, vector, cache_hit): added and changed chunks get a fresh one, removed ones go, all others keep theirs.

    Chunks of documents that the diff does not speak of keep their vector too.
    """
    moved = diff.filter("status <> 'unchanged'").select("chunk_id", "status")
    kept = old.select("chunk_id", "vector").join(moved, "chunk_id", "left_anti").withColumn("cache_hit", F.lit(True))
    new = moved.filter("status IN ('added', 'changed')").select("chunk_id").join(fresh.select("chunk_id", "vector"), "chunk_id").withColumn("cache_hit", F.lit(False))
    return kept.unionByName(new)


def upsert_index(index: KeywordIndex, diff: DataFrame, new_chunks: DataFrame) -> KeywordIndex:
    """The index without removed and changed chunks, with added and changed ones; statistics follow.

    The moves of the diff and the new postings are stored, as several steps read them.
    """
    diff = materialized(diff.filter("status <> 'unchanged'").select("chunk_id", "status"), "moved")
    gone = diff.filter("status IN ('removed', 'changed')").select("chunk_id")
    added = new_chunks.join(diff.filter("status IN ('added', 'changed')").select("chunk_id"), "chunk_id", "left_semi")
    if index.forward is None:
        return index_of(materialized(index.postings.join(gone, "chunk_id", "left_anti").unionByName(postings_of(added)), "postings"))
    forward = materialized(index.forward.join(gone, "chunk_id", "left_anti").unionByName(forward_of(added)), "forward")
    return index_of(listed(forward), forward)


def reindex(sources: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> dict[str, DataFrame | KeywordIndex]:
    """Full rebuild from chunks: the keyword index, the vectors of the chunks there are (stale ones go), and the manifest."""
    kids = chunks.filter("chunk_level = 'child'")
    vectors = embeddings.join(kids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return {"keyword": build_keyword_index(kids), "vectors": vectors, "manifest": build_manifest(sources, documents, chunks, vectors)}


def purge(tables: dict[str, DataFrame], registry: DataFrame, source_ids: DataFrame, doc_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the documents; the sources get a tombstone line in the registry log (source_id, status, seq)."""
    kept = {k: t.join(doc_ids, "doc_id", "left_anti") for k, t in tables.items()}
    last = registry.agg(F.max("seq").alias("last"))
    stones = source_ids.select("source_id").distinct().crossJoin(F.broadcast(last)).select("source_id", F.lit("tombstoned").alias("status"), (F.col("last") + 1).alias("seq"))
    return kept | {"registry": registry.unionByName(stones)}


def assert_dimensions(embeddings: DataFrame, dims: int) -> DataFrame:
    """One row: lengths found and whether all equal dims."""
    n = embeddings.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.count("*").alias("n"))
    return n.withColumn("ok", (F.col("n") == 0) | ((F.col("least") == dims) & (F.col("most") == dims)))


# --- Manifest, integrity, health


def build_manifest(sources: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    one = [
        sources.filter("status <> 'tombstoned'").agg(F.count("*").alias("source_count")),
        documents.agg(F.count("*").alias("document_count")),
        chunks.filter("chunk_level = 'child'").agg(F.count("*").alias("child_chunk_count")),
        embeddings.agg(F.count("*").alias("embedding_count")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one).withColumn("chunk_count", F.col("child_chunk_count"))


_ISSUE = ("severity", "code", "message", "resource_id", "repairable")


# The codes and messages of the checks are results.
_MANIFEST_TESTS = (("document_count <> d", "Manifest document_count does not match processed documents"), ("child_chunk_count <> c", "Manifest chunk_count does not match processed chunks"), ("embedding_count <> 0 AND embedding_count <> e", "Manifest embedding_count does not match embeddings"))


def _issues(rows: DataFrame, severity: str, code: str, message: Column, resource: Column, repairable: bool) -> DataFrame:
    values = (F.lit(severity), F.lit(code), message, resource.cast("string"), F.lit(repairable))
    return rows.select(*[v.alias(n) for v, n in zip(values, _ISSUE, strict=True)])


def validate_index(registry: DataFrame, raw: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, vector_ids: DataFrame, keyword_ids: DataFrame, manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """Issues found by anti-joins between registry (source_id, doc_id, status), raw (source_id), documents (doc_id),
    chunks, embeddings (chunk_id), the ids of both indexes, the manifest and the cache (content_hash, or cache_key; see key_of_cache)."""
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    live = registry.filter("status <> 'tombstoned'")
    kids = chunks.filter("chunk_level = 'child'").select("chunk_id", "doc_id", "content_hash")
    ids = kids.select("chunk_id").distinct()
    doc, cid, sid = F.col("doc_id"), F.col("chunk_id"), F.col("source_id")
    n = F.col("n").cast("string")
    found = [
        _issues(live.select("source_id").distinct().join(raw.select("source_id"), "source_id", "left_anti"), "error", "MISSING_RAW", text("Registry source ", sid, " has no raw directory"), sid, False),
        _issues(documents.select("doc_id").join(live.select("doc_id"), "doc_id", "left_anti"), "warning", "ORPHAN_PROCESSED_DOC", text("Processed document ", doc, " not referenced by any active source"), doc, True),
        _issues(documents.select("doc_id").join(chunks.select("doc_id"), "doc_id", "left_anti"), "error", "MISSING_ARTIFACT", text("Document ", doc, " missing chunks"), doc, False),
        _issues(kids.join(embeddings.select("chunk_id"), "chunk_id", "left_anti").groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("n")), "error", "MISSING_EMBEDDINGS", text("Document ", doc, " missing embeddings for ", n, " chunk(s)"), doc, True),
    ]
    for name, actual, missing in (("VECTOR", vector_ids, "error"), ("KEYWORD", keyword_ids, "warning")):
        low = name.capitalize()
        found += [
            _issues(stale_ids(actual, ids), "warning", f"STALE_{name}_ENTRY", text(f"{low} index contains chunk not in processed store: ", cid), cid, True),
            _issues(missing_ids(actual, ids).agg(F.count("*").alias("n")).filter("n > 0"), missing, f"{name}_INDEX_MISMATCH", text(f"{low} index missing ", n, " chunk(s)"), F.lit(None), True),
        ]
    counts = manifest.crossJoin(F.broadcast(documents.agg(F.count("*").alias("d")))).crossJoin(F.broadcast(kids.agg(F.count("*").alias("c")))).crossJoin(F.broadcast(embeddings.agg(F.count("*").alias("e"))))
    for test, what in _MANIFEST_TESTS:
        found.append(_issues(counts.filter(test), "warning", "MANIFEST_MISMATCH", F.lit(what), F.lit(None), True))
    ch = F.col("content_hash")
    found.append(_issues(cache.select("content_hash").distinct().join(kids.select("content_hash"), "content_hash", "left_anti"), "info", "ORPHANED_CACHE", text("Embedding cache row has no matching chunk: ", ch), ch, True))
    found.append(_issues(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1"), "error", "DUPLICATE_CHUNK_ID", text("Chunk ID ", cid, " appears ", n, " times across documents"), cid, False))
    return reduce(DataFrame.unionByName, found)


#: What is compared with what: check, store and kind of the ids looked at, store and kind of those they are looked up in.
_COMPARED = (
    ("raw", "registry", "source", "raw", "source"),
    ("orphan", "documents", "doc", "registry", "doc"),
    ("artifact", "documents", "doc", "chunks", "doc"),
    ("embedding", "chunks", "child", "embeddings", "child"),
    ("stale vector", "vector", "child", "chunks", "child"),
    ("vector gap", "chunks", "child", "vector", "child"),
    ("stale keyword", "keyword", "child", "chunks", "child"),
    ("keyword gap", "chunks", "child", "keyword", "child"),
    ("cache", "cache", "hash", "chunks", "hash"),
)


def held_ids(buckets: int, **stores: DataFrame) -> DataFrame:
    """store, kind, id, n, bucket: how often each store (kind, id) holds an id; every store is read once."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(s).alias("store"), "kind", "id") for s, d in stores.items()])
    return rows.groupBy("store", "kind", "id").agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def bucket_digests(held: DataFrame) -> DataFrame:
    """store, kind, bucket and, whatever their order, what its ids are: digest (of the distinct ids), rows, most (of one id), nulls."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(38,0)"))
    return held.groupBy("store", "kind", "bucket").agg(F.concat_ws("/", part(1), part(2), F.count("*")).alias("digest"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.count_if(F.col("id").isNull()).alias("nulls"))


def validate_by_digest(registry: DataFrame, raw: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, vector_ids: DataFrame, keyword_ids: DataFrame, manifest: DataFrame, cache: DataFrame, buckets: int = 1024) -> DataFrame:
    """The rows of validate_index. Every store is read once; ids are compared only in buckets whose digests differ, so a clean base needs no join at all."""
    of = lambda d, kind, key: d.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    live = registry.filter("status <> 'tombstoned'")
    each = lambda *pairs: F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("id")) for k, c in pairs]))
    child = F.col("chunk_level") == "child"
    of_chunk = F.array(F.struct(F.lit("any").alias("kind"), F.col("chunk_id").alias("id")), F.struct(F.lit("doc").alias("kind"), F.col("doc_id").alias("id")))
    of_child = F.array(F.struct(F.lit("child").alias("kind"), F.col("chunk_id").alias("id")), F.struct(F.lit("hash").alias("kind"), F.col("content_hash").alias("id")))
    stores = {
        "registry": live.select(each(("source", "source_id"), ("doc", "doc_id"))), "raw": of(raw, "source", "source_id"), "documents": of(documents, "doc", "doc_id"),
        "chunks": chunks.select(F.inline(F.when(child, F.concat(of_chunk, of_child)).otherwise(of_chunk))), "embeddings": of(embeddings, "child", "chunk_id"),
        "vector": of(vector_ids, "child", "chunk_id"), "keyword": of(keyword_ids, "child", "chunk_id"), "cache": of(cache, "hash", "content_hash"),
    }
    held = materialized(held_ids(buckets, **stores), "held")
    digests = {(r.store, r.kind, r.bucket): r for r in bucket_digests(held).collect()}  # a row a store, kind and bucket
    rows = lambda store, kind: sum(r.rows for k, r in digests.items() if k[:2] == (store, kind))

    def found(check: str) -> DataFrame | None:
        """id, n of what a check finds; None if no bucket has to be opened."""
        _, a, ka, b, kb = next(x for x in _COMPARED if x[0] == check)
        one, two = ({k[2]: r for k, r in digests.items() if k[:2] == (s, kind)} for s, kind in ((a, ka), (b, kb)))
        open_ = [x for x, r in one.items() if x not in two or r.digest != two[x].digest or r.nulls or two[x].nulls]
        if not open_:
            return None
        ids = lambda s, kind: held.filter((F.col("store") == s) & (F.col("kind") == kind) & F.col("bucket").isin(open_)).select("id", "n")
        return ids(a, ka).join(ids(b, kb).select("id"), "id", "left_anti")

    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    i, n = F.col("id"), F.col("n").cast("string")
    repeated = lambda d: d.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    out = []

    def add(check: str, severity: str, code: str, message, resource, repairable: bool, shape=lambda d: d) -> None:
        d = found(check)
        if d is not None:
            out.append(_issues(shape(d), severity, code, message, resource, repairable))

    def of_documents(d: DataFrame) -> DataFrame:
        missing = d.select(i.alias("chunk_id"))
        return chunks.filter(child).join(missing, "chunk_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.countDistinct("chunk_id").alias("n"))

    counted = lambda d: d.agg(F.count("*").alias("n")).filter("n > 0")
    add("raw", "error", "MISSING_RAW", text("Registry source ", i, " has no raw directory"), i, False)
    add("orphan", "warning", "ORPHAN_PROCESSED_DOC", text("Processed document ", i, " not referenced by any active source"), i, True, repeated)
    add("artifact", "error", "MISSING_ARTIFACT", text("Document ", i, " missing chunks"), i, False, repeated)
    add("embedding", "error", "MISSING_EMBEDDINGS", text("Document ", i, " missing embeddings for ", n, " chunk(s)"), i, True, of_documents)
    for name, severity in (("vector", "error"), ("keyword", "warning")):
        add(f"stale {name}", "warning", f"STALE_{name.upper()}_ENTRY", text(f"{name.capitalize()} index contains chunk not in processed store: ", i), i, True)
        add(f"{name} gap", severity, f"{name.upper()}_INDEX_MISMATCH", text(f"{name.capitalize()} index missing ", n, " chunk(s)"), F.lit(None), True, counted)
    counts = manifest.withColumns({"d": F.lit(rows("documents", "doc")), "c": F.lit(rows("chunks", "child")), "e": F.lit(rows("embeddings", "child"))})
    for test, what in _MANIFEST_TESTS:
        out.append(_issues(counts.filter(test), "warning", "MANIFEST_MISMATCH", F.lit(what), F.lit(None), True))
    add("cache", "info", "ORPHANED_CACHE", text("Embedding cache row has no matching chunk: ", i), i, True)
    if any(r.most > 1 for k, r in digests.items() if k[:2] == ("chunks", "any")):
        twice = held.filter("store = 'chunks' AND kind = 'any' AND n > 1")
        out.append(_issues(twice, "error", "DUPLICATE_CHUNK_ID", text("Chunk ID ", i, " appears ", n, " times across documents"), i, False))
    return reduce(DataFrame.unionByName, out)


def repair_index(issues: DataFrame, postings: DataFrame, documents: DataFrame, cache: DataFrame) -> dict[str, DataFrame]:
    """postings, documents and cache without what the repairable issues name."""
    named = lambda *codes: issues.filter(F.col("repairable") & F.col("code").isin(*codes)).select(F.col("resource_id").alias("bad")).distinct()
    drop = lambda df, key, *codes: df.join(named(*codes), F.col(key) == F.col("bad"), "left_anti")
    return {"postings": drop(postings, "chunk_id", "STALE_KEYWORD_ENTRY", "STALE_VECTOR_ENTRY"), "documents": drop(documents, "doc_id", "ORPHAN_PROCESSED_DOC"), "cache": drop(cache, "content_hash", "ORPHANED_CACHE")}


def health_report(manifest: DataFrame, chunks: DataFrame, vector_ids: DataFrame, keyword_ids: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: counts of the stores, issues by severity, healthy, warnings."""
    n = lambda d, name: F.broadcast(d.agg(F.count("*").alias(name)))
    bad = lambda s: F.count_if(F.col("severity") == s)
    one = manifest.select("document_count", "child_chunk_count").crossJoin(n(chunks.filter("chunk_level = 'child'"), "chunk_rows")).crossJoin(n(vector_ids, "vector_count")).crossJoin(n(keyword_ids, "keyword_count"))
    one = one.crossJoin(F.broadcast(issues.agg(bad("error").alias("errors"), bad("warning").alias("warnings"), bad("info").alias("infos"))))
    c = F.col
    notes = F.array_compact(F.array(F.when(c("vector_count") != c("chunk_rows"), F.lit("vector index out of step")), F.when(c("keyword_count") != c("chunk_rows"), F.lit("keyword index out of step")), F.when(c("child_chunk_count") != c("chunk_rows"), F.lit("manifest out of step"))))
    return one.withColumns({"healthy": (c("errors") == 0) & (F.size(notes) == 0), "notes": F.array_join(notes, "; ")})


def overview(**named: tuple[DataFrame, list[str]]) -> DataFrame:
    """area, label, n: rows of each table by its label columns."""
    parts = [d.groupBy(F.concat_ws("/", *labels).alias("label")).agg(F.count("*").alias("n")).select(F.lit(a).alias("area"), "label", "n") for a, (d, labels) in named.items()]
    return reduce(DataFrame.unionByName, parts)


def admit_uploads(files: DataFrame, max_file: int, max_total: int, max_files: int, supported, blocked) -> DataFrame:
    """files (batch_id, pos, name, size) with verdict accepted, rejected or stopped and the reason.

    Valid files are taken in order until the running total would pass the limit; that one and all after it stop.
    """
    suffix = F.lower(F.regexp_extract("name", r"(\.[^./\\]+)$", 1))
    reason = (
        F.when(F.col("pos") > max_files, "too many files").when(F.col("name").rlike(r"\.\.|[/\\]") | (F.col("name") == ""), "bad name").when(suffix.isin(*blocked), "blocked type")
        .when(~suffix.isin(*supported), "unsupported type").when(F.col("size") == 0, "empty file").when(F.col("size") > max_file, "file too large")
    )
    rows = files.withColumn("reason", reason)
    rows = running_sum(rows, ["batch_id"], F.floor(F.col("pos") / UPLOAD_RUN), ["pos"], F.when(F.col("reason").isNull(), F.col("size")).otherwise(0), "running")
    rows = rows.withColumn("over", F.col("running") > max_total)
    return rows.select("batch_id", "pos", "name", F.when(F.col("over"), "stopped").when(F.col("reason").isNotNull(), "rejected").otherwise("accepted").alias("verdict"), F.when(F.col("over"), F.lit("total limit")).otherwise(F.col("reason")).alias("reason"))
