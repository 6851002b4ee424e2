"""Queries of the document pipeline: import, extraction, chunks, indexes, retrieval, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import documents as dx
from ..functions import text as tx
from ..operators import everywhere as ev
from ..operators import indexing as ix
from ..operators import packed as pk
from ..operators import pivots as pv
from ..operators import retrieval as rt
from ..operators import snapshots as sn
from ..operators import upkeep as up
from ..sources.tables import chats_to_documents, materialized, read_jsonl, scan_files, scratch, spread, table, write_index, write_jsonl
from ..streaming import jobs as st
from . import views as v
from .registry import query
from .views import with_ctes

_S = v._STRIP

# --- Text functions and sources


@query("f1_detect_format", with_ctes("files", "SELECT event_id, CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'txt' WHEN 'pdf' THEN 'pdf' ELSE CASE fingerprint WHEN 'f0' THEN 'pdf' WHEN 'f1' THEN 'html' ELSE 'txt' END END AS format FROM files"))
def f1(spark, sf):
    content = F.when(F.col("fingerprint") == "f0", "%PDF-1.4").when(F.col("fingerprint") == "f1", " <!DOCTYPE html>").otherwise("word").cast("binary")
    return v.file_events(spark, sf).select("event_id", tx.detect_format(F.col("path"), content).alias("format"))


@query("f2_hashes", f"SELECT doc_id, 'sha256:' || sha256(text) AS fingerprint, 'sha256:' || sha256({_S.format('text')}) AS content_hash FROM documents")
def f2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"), tx.content_hash(F.col("text")).alias("content_hash"))


_LF2 = "regexp_replace(text, chr(10) || '{3,}', chr(10) || chr(10), 'g')"


@query("t1_normalize", f"SELECT doc_id, {_S.format(_LF2)} AS body FROM documents")
def t1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_body(F.col("text")).alias("body"))


@query("t2_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words, CAST(len(regexp_extract_all(text, '(?m)^#{1,6}\s+')) AS INTEGER) AS headings, CAST(length(text) AS INTEGER) AS chars FROM documents")
def t2(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.count_words(c).alias("words"), tx.count_headings(c).alias("headings"), F.length(c).alias("chars"))


@query("t3_extract_html", with_ctes("page_texts", "SELECT page_id, title, body, quality FROM page_texts"))
def t3(spark, sf):
    return dx.extract_html(spread(table(spark, sf, "pages").select("page_id", "html")))


_URL = "'u' || regexp_replace(coalesce(url, ''), '[^A-Za-z0-9:/._-]', '', 'g')"


@query(
    "t3_html_markdown",
    f"""SELECT page_id, '## Page ' || page_id || chr(10) || chr(10) || 'See [the **page**](' || u || ') and _all_ of `it  x`.' || chr(10) || chr(10) || '  * one' || chr(10) || '    1. in ' || page_id || chr(10) || '    2. [in](' || u || ')' || chr(10) || '  * two' || chr(10) || chr(10) ||
'id | url' || chr(10) || '---|---' || chr(10) || page_id || ' | ' || u || chr(10) || chr(10) || '    a  b' || chr(10) || '      ' || page_id || chr(10) || chr(10) || '> said' AS body FROM (SELECT page_id, {_URL} AS u FROM pages)""".replace("`it  x`", "`it x`"),
)
def t3b(spark, sf):
    u, n = F.concat(F.lit("u"), F.regexp_replace(F.coalesce("url", F.lit("")), "[^A-Za-z0-9:/._-]", "")), F.col("page_id").cast("string")
    parts = ["<body><nav>x</nav><main><h2>Page ", n, '</h2><p>See <a href="', u, '">the <b>page</b></a> and <em>all</em> of\n <code>it  x</code>.</p><ul><li>one<ol><li>in ', n, "<li><a href=", u, ">in</a></ol><li>two</ul><table><tr><th>id</th><th>url</th></tr><tr><td>", n, "<td>", u, "</table><pre>a  b\n  ", n, "\n</pre><blockquote><p>said</blockquote></main><footer>f</footer></body>"]
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return dx.extract_html(spread(table(spark, sf, "pages")).select("page_id", html.alias("html"))).select("page_id", "body")


@query("f7_quality_gate", with_ctes("page_texts", "SELECT CAST(page_id AS VARCHAR) AS doc_id, quality, CASE WHEN quality = 'failed' THEN 'EXTRACTION_FAILED' END AS code FROM page_texts"))
def f7(spark, sf):
    good, failed = ix.split_failed(t3(spark, sf).withColumn("doc_id", F.col("page_id").cast("string")))
    return good.select("doc_id", "quality", F.lit(None).cast("string").alias("code")).unionByName(failed.select("doc_id", F.lit("failed").alias("quality"), "code"))


@query("u2_registered_extractor", "SELECT url AS uri, url AS title, replace(html, '<', '[') AS body, CASE WHEN length(trim(html)) = 0 THEN 'failed' ELSE 'full' END AS quality FROM pages")
def u2(spark, sf):
    def extract(files):
        return files.assign(title=files["uri"], body=[bytes(c).decode().replace("<", "[") for c in files["content"]])

    files = spread(table(spark, sf, "pages")).select(F.col("url").alias("uri"), F.lit("snapshot").alias("format"), F.encode("html", "UTF-8").alias("content"))
    return dx.extract_registered(files, {"snapshot": extract}).drop("format")


_MD = "'---' || chr(10) || 'title: T' || conv_id || chr(10) || 'language: fr' || chr(10) || '---' || chr(10) || text"


@query("t4_markdown", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'T' || conv_id ELSE 'Turn ' || turn END AS title, CASE WHEN turn % 2 = 0 THEN 'fr' ELSE 'en' END AS language, " + _S.format("CASE WHEN turn % 2 = 0 THEN text ELSE '# Turn ' || turn || chr(10) || text END") + " AS body FROM conversations")
def t4(spark, sf):
    front = F.concat(F.lit("---\ntitle: T"), F.col("conv_id").cast("string"), F.lit("\nlanguage: fr\n---\n"), "text")
    head = F.concat(F.lit("# Turn "), F.col("turn").cast("string"), F.lit("\n"), "text")
    rows = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 2 == 0, front).otherwise(head))
    return dx.extract_markdown(rows, F.lit("stem")).select("conv_id", "turn", "title", "language", "body")


@query("t5_extract_text", with_ctes("docs_old", "SELECT doc_id, title, body FROM docs_old"))
def t5(spark, sf):
    return v.docs(spark, sf).select("doc_id", "title", "body")


@query("t6_documents", with_ctes("docs_old", r"SELECT doc_id, source_id, title, 'en' AS language, 'txt' AS format, CAST(len(regexp_extract_all(body, '\S+')) AS INTEGER) AS word_count, CAST(length(body) AS INTEGER) AS char_count, uri AS source_uri FROM docs_old"))
def t6(spark, sf):
    d = v.docs(spark, sf)
    intake = d.select("source_id", "uri", F.lit("txt").alias("format"), F.array(F.lit("a")).alias("tags"))
    return ix.build_documents(d.select("source_id", "title", "body"), intake).select("doc_id", "source_id", "title", "language", "format", "word_count", "char_count", "source_uri")


_SLUG = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '-')"


@query("t7_slugs", with_ctes("docs_old", rf"SELECT doc_id, CASE WHEN {_SLUG} = '' THEN 'section' ELSE {_SLUG} END AS heading_slug, substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM docs_old"))
def t7(spark, sf):
    t = F.col("title")
    return v.docs(spark, sf).select("doc_id", tx.slugify_heading(t).alias("heading_slug"), tx.slugify(t).alias("slug"))


_CHAT = "SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text, CAST(count(*) AS INTEGER) AS n_turns FROM conversations GROUP BY conv_id"


@query("s4_chat_documents", _CHAT)
def s4(spark, sf):
    return chats_to_documents(table(spark, sf, "conversations"))


@query("s2_jsonl", "SELECT item_id, text FROM benchmark")
def s2(spark, sf):
    path = scratch(spark, "jsonl")
    write_jsonl(table(spark, sf, "benchmark").select("item_id", "text"), path)
    return read_jsonl(spark, path, "item_id long, text string")


@query("s5_index_tables", with_ctes("chunks_old", "SELECT doc_id, chunk_level, count(*) AS n FROM chunks_old GROUP BY ALL"))
def s5(spark, sf):
    path = scratch(spark, "index")
    write_index(path, 8, chunks=v.chunks(spark, sf))
    return spark.read.parquet(f"{path}/chunks").groupBy("doc_id", "chunk_level").agg(F.count("*").alias("n"))


@query("s1_scan_files", "SELECT coalesce(lang, 'none') AS lang, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, 'txt' AS format FROM documents GROUP BY ALL")
def s1(spark, sf):
    path = scratch(spark, "tree")
    table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(path)
    return scan_files(spark, path).groupBy(F.regexp_extract("uri", "lang=([^/]+)", 1).alias("lang"), "format").agg(F.sum("byte_size").alias("bytes"))


_INBOX = r"""SELECT item_id, short AS titled, sha256(body) AS body_hash, CAST(len(regexp_extract_all(body, '\S+')) AS INTEGER) AS tokens FROM (SELECT item_id, short, trim(CASE WHEN short AND len(ls) > 1 THEN array_to_string(ls[2:], chr(10) || chr(10)) ELSE whole END, chr(10) || ' ') AS body
FROM (SELECT *, coalesce(length(ls[1]) < 120, false) AS short FROM (SELECT *, list_filter(string_split(whole, chr(10)), lambda x: trim(x) <> '') AS ls FROM (SELECT item_id, trim(text, chr(10) || ' ') AS whole FROM benchmark))))"""


@query("x1_inbox_stream", _INBOX)
def x1(spark, sf):
    path = scratch(spark, "inbox")
    table(spark, sf, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(f"{path}/in")
    for _ in range(2):  # the second run finds every file unchanged
        st.stream_inbox(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    docs, chunks, _ = st.read_inbox(spark, f"{path}/out")
    parents = chunks.filter("chunk_level = 'parent'").groupBy("doc_id").agg(F.sum("token_count").cast("int").alias("tokens"))
    return docs.join(parents, "doc_id").select(F.regexp_extract("source_id", r"item_id=(\d+)", 1).cast("long").alias("item_id"), (~F.col("title").startswith("part-")).alias("titled"), F.sha2("body", 256).alias("body_hash"), "tokens")


_PLUGGED = "SELECT item_id, 'page ' || item_id AS title, sha256(replace(trim(text, chr(10) || ' '), 'e', 'E')) AS body_hash FROM benchmark"


@query("x1_plugged_inbox", _PLUGGED)
def x1b(spark, sf):
    def extract(files):
        number = files["uri"].str.extract(r"item_id=(\d+)", expand=False)
        return files.assign(title="page " + number, body=[bytes(c).decode().strip("\n ").replace("e", "E") for c in files["content"]])

    path = scratch(spark, "inbox")
    rows = table(spark, sf, "benchmark").select("item_id", "text")
    rows.repartition("item_id").write.partitionBy("item_id").text(f"{path}/in")
    # Plain text files go to the plugged function too: it is asked before the built-in formats.
    st.stream_inbox(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", extractors={"txt": extract}).awaitTermination()
    docs, _, _ = st.read_inbox(spark, f"{path}/out")
    return docs.select(F.regexp_extract("source_id", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "title", F.sha2("body", 256).alias("body_hash"))


def chat_docs(spark, sf):
    c = s4(spark, sf)
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("conv_id").cast("string").alias("source_id"), F.lit("chat").alias("title"), tx.normalize_body(F.col("text")).alias("body"))


@query("t8_outline", with_ctes("outline", "SELECT CAST(conv_id AS VARCHAR) AS doc_id, section_index, role AS heading_path, role AS section_title, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset FROM outline"))
def t8(spark, sf):
    return dx.parse_outline(chat_docs(spark, sf)).drop("section")


@query("t10_chat_chunks", with_ctes("chat_chunks", f"SELECT chunk_id, doc_id, doc_id AS source_id, chunk_level, parent_chunk_id, CAST(chunk_index AS INTEGER) AS chunk_index, heading_path, 'chat' AS title, CAST(token_count AS INTEGER) AS token_count, CAST(length(body_text) AS INTEGER) AS char_count, 'sha256:' || sha256({_S.format('embed_text')}) AS content_hash, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset FROM chat_chunks"))
def t10b(spark, sf):
    return dx.chunk_documents(chat_docs(spark, sf)).drop("embed_text", "body_text")


@query("t9_windows", f"SELECT doc_id, CAST(unnest(range(len(w))) AS INTEGER) AS i, sha256(unnest(w)) AS h FROM (SELECT doc_id, {v._win(_S.format('text'), 'ws', 128, 112)} AS w FROM (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS ws FROM documents))")
def t9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(tx.split_by_tokens(F.col("text"), 128, 16)).alias("i", "w")).select("doc_id", "i", F.sha2("w", 256).alias("h"))


@query("t10_chunks", with_ctes("chunks_old", "SELECT chunk_id, doc_id, chunk_level, parent_chunk_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(token_count AS INTEGER) AS token_count, content_hash FROM chunks_old"))
def t10(spark, sf):
    return v.chunks(spark, sf).select("chunk_id", "doc_id", "chunk_level", "parent_chunk_id", "chunk_index", "token_count", "content_hash")


@query("t12_tokens", f"SELECT doc_id, array_to_string({v._TOK.format('text')}, ' ') AS tokens FROM documents")
def t12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


_KW = "list_filter(regexp_extract_all(lower({0}), '[a-zA-Z]{{4,}}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "))[1:12]"


@query("t13_keywords", f"SELECT item_id, array_to_string({_KW.format('text')}, ' ') AS keywords FROM benchmark")
def t13(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(tx.extract_keywords(F.col("text")), " ").alias("keywords"))


# --- Imports and the incremental index

_FILES = "SELECT n, uri, fingerprint, length(text) * 1000 AS byte_size, CASE WHEN n % 19 = 0 THEN 'exe' ELSE 'txt' END AS suffix FROM sources_new"


def _files(spark, sf):
    return v.sources(spark, sf, "new").select("n", "uri", "fingerprint", (F.length("text") * 1000).cast("long").alias("byte_size"), F.when(F.col("n") % 19 == 0, "exe").otherwise("txt").alias("suffix"))


_STATUS = f"SELECT f.n, f.byte_size, CASE WHEN suffix <> 'txt' THEN 'unsupported' WHEN byte_size > 5000000 THEN 'error' WHEN s.uri IS NOT NULL THEN 'duplicate' ELSE 'new' END AS status FROM ({_FILES}) f LEFT JOIN (SELECT DISTINCT uri, fingerprint FROM sources_old) s ON f.uri = s.uri AND f.fingerprint = s.fingerprint"


@query("f3_validate_import", with_ctes("sources_old sources_new", f"SELECT n, status FROM ({_STATUS})"))
def f3(spark, sf):
    return ix.validate_import(_files(spark, sf), v.sources(spark, sf), 5_000_000, ["txt"]).select("n", "status")


@query("f3_import_summary", with_ctes("sources_old sources_new", f"SELECT count(*) AS total_files, count(*) FILTER (status = 'new') AS new_files, count(*) FILTER (status = 'duplicate') AS duplicate_files, count(*) FILTER (status = 'unsupported') AS unsupported_files, count(*) FILTER (status = 'error') AS error_files, CAST(sum(byte_size) AS BIGINT) AS total_bytes, count(*) FILTER (status = 'error') = 0 AND count(*) FILTER (status = 'new') > 0 AS ready FROM ({_STATUS})"))
def f3b(spark, sf):
    return ix.import_summary(ix.validate_import(_files(spark, sf), v.sources(spark, sf), 5_000_000, ["txt"]))


@query("a2_import_progress", with_ctes("sources_old sources_new", f"SELECT count(*) AS total, count(*) AS processed, count(*) FILTER (status = 'new') AS ingested, count(*) FILTER (status = 'duplicate') AS skipped, count(*) FILTER (status IN ('error', 'unsupported')) AS failed FROM ({_STATUS})"))
def a2(spark, sf):
    s = F.col("status")
    r = f3(spark, sf).withColumn("status", F.when(s == "new", "ingested").when(s == "duplicate", "skipped").otherwise("failed"))
    return ix.import_progress(r)


@query("f4_needs_reprocess", with_ctes("docs_old docs_new", "SELECT a.doc_id FROM docs_new a LEFT JOIN docs_old b ON a.doc_id = b.doc_id AND b.n % 7 <> 0 WHERE b.doc_id IS NULL OR a.fingerprint <> b.fingerprint OR b.n % 11 = 0"))
def f4(spark, sf):
    state = v.docs(spark, sf).filter("n % 7 <> 0").select("doc_id", F.col("fingerprint").alias("source_fingerprint"), F.when(F.col("n") % 11 == 0, "1").otherwise("2").alias("pipeline_version"))
    return ix.needs_reprocess(v.docs(spark, sf, "new").select("doc_id", "fingerprint"), state, "2").select("doc_id")


@query("f5_filters", with_ctes("chunks_old", "SELECT chunk_id FROM chunks_old WHERE chunk_level = 'child' AND token_count BETWEEN 100 AND 400 AND starts_with(title, 'A') AND chunk_index <= 2 AND title NOT IN ('')"))
def f5(spark, sf):
    spec = [("chunk_level", "eq", "child"), ("token_count", "range", (100, 400)), ("title", "prefix", "A"), ("chunk_index", "lte", 2), ("heading_path", "in", ["content"]), ("chunk_index", "gte", 0), ("tags", "contains", "x"), ("tags", "contains_any", ["x", "z"])]
    return ix.apply_filters(v.chunks(spark, sf).withColumn("tags", F.array(F.lit("x"), F.lit("y"))), spec).select("chunk_id")


_DIFF = "SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN a.chunk_id IS NULL THEN 'added' WHEN b.chunk_id IS NULL THEN 'removed' WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT * FROM chunks_old WHERE chunk_level = 'child') a FULL JOIN (SELECT * FROM chunks_new WHERE chunk_level = 'child') b ON a.chunk_id = b.chunk_id"


def diff(spark, sf):
    return ix.diff_snapshots(v.chunks(spark, sf), v.chunks(spark, sf, "new"))


@query("j1_chunk_diff", with_ctes("chunks_old chunks_new", _DIFF))
def j1(spark, sf):
    return diff(spark, sf).select("chunk_id", "doc_id", "status")


@query("j1_digest_diff", with_ctes("chunks_old chunks_new", _DIFF))
def j1c(spark, sf):
    return ix.diff_by_digest(v.stored_chunks(spark, sf), v.stored_chunks(spark, sf, "new")).select("chunk_id", "doc_id", "status")


def batch_docs(spark, sf):
    """The documents a batch brings: every third new one."""
    return v.docs(spark, sf, "new").filter("n % 3 = 0")


def batch_diff(spark, sf, old=None, new=None):
    """The diff of a batch: its documents are ingested, and those gone are named as deleted. old, new: chunks that are stored already."""
    ingested = v.sources(spark, sf, "new").filter("n % 3 = 0").select(tx.doc_id(F.col("source_id")).alias("doc_id"))
    deleted = v.sources(spark, sf).filter("n % 17 = 0").select(tx.doc_id(F.col("source_id")).alias("doc_id"))
    return ix.diff_chunks(v.chunks(spark, sf) if old is None else old, dx.chunk_documents(batch_docs(spark, sf)) if new is None else new, ingested, deleted)


def _batch(spark, sf):
    """Old chunks and a batch's, both stored: the texts are cut once."""
    return v.stored_chunks(spark, sf), materialized(dx.chunk_documents(batch_docs(spark, sf)), "new-chunks")


_TOUCHED = "SELECT doc_id FROM docs_new WHERE n % 3 = 0 UNION SELECT doc_id FROM docs_old WHERE n % 17 = 0"
_BATCH = f"SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN a.chunk_id IS NULL THEN 'added' WHEN b.chunk_id IS NULL THEN 'removed' WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT * FROM chunks_old WHERE chunk_level = 'child' AND doc_id IN ({_TOUCHED})) a FULL JOIN (SELECT * FROM chunks_new WHERE chunk_level = 'child' AND doc_id IN (SELECT doc_id FROM docs_new WHERE n % 3 = 0)) b ON a.chunk_id = b.chunk_id"


@query("j1_batch_diff", with_ctes("chunks_old chunks_new", _BATCH))
def j1b(spark, sf):
    return batch_diff(spark, sf).select("chunk_id", "doc_id", "status")


_KEY = "sha256('hash:m1:32:' || content_hash)"


@query("j2_embedding_plan", with_ctes("chunks_old chunks_new", f"SELECT {_KEY} AS cache_key, count(*) AS n_chunks FROM chunks_new WHERE chunk_level = 'child' AND content_hash NOT IN (SELECT content_hash FROM chunks_old WHERE chunk_level = 'child') GROUP BY content_hash"))
def j2(spark, sf):
    cache = v.children(spark, sf).select(ix.cache_key("hash", "m1", 32).alias("cache_key")).distinct().withColumn("vector", F.array(F.lit(0.0)))
    return ix.plan_embeddings(v.children(spark, sf, "new"), cache, "hash", "m1", 32)[1].select("cache_key", "n_chunks")


@query("j2_merge_embeddings", with_ctes("chunks_old chunks_new", f"SELECT chunk_id, status = 'unchanged' AS cache_hit FROM ({_DIFF}) WHERE status <> 'removed'"))
def j2b(spark, sf):
    vec = lambda d: d.select("chunk_id", F.array(F.lit(0.0)).alias("vector"))
    return ix.merge_embeddings(diff(spark, sf), vec(v.children(spark, sf)), vec(v.children(spark, sf, "new"))).select("chunk_id", "cache_hit")


_CHUNK_TOKENS = v._TOK.format("title || ' content ' || embed_text")


@query("p4_upsert_index", with_ctes("chunks_new", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest({_CHUNK_TOKENS}) AS term FROM chunks_new WHERE chunk_level = 'child') GROUP BY term"))
def p4(spark, sf):
    old, new = v.stored_chunks(spark, sf), v.stored_chunks(spark, sf, "new")
    return ix.upsert_index(v.index(spark, sf, of=old), ix.diff_snapshots(old, new), new.filter("chunk_level = 'child'")).term_stats.select("term", "df")


@query("p4_batch_upsert", with_ctes("chunks_old chunks_new", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest({_CHUNK_TOKENS}) AS term FROM (SELECT chunk_id, title, embed_text FROM chunks_old WHERE chunk_level = 'child' AND doc_id NOT IN ({_TOUCHED}) UNION ALL SELECT chunk_id, title, embed_text FROM chunks_new WHERE chunk_level = 'child' AND doc_id IN (SELECT doc_id FROM docs_new WHERE n % 3 = 0))) GROUP BY term"))
def p4b(spark, sf):
    old, new = _batch(spark, sf)
    return ix.upsert_index(v.index(spark, sf, of=old), batch_diff(spark, sf, old, new), new.filter("chunk_level = 'child'")).term_stats.select("term", "df")


@query("w1_latest_record", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS last_id FROM events GROUP BY user_id")
def w1(spark, sf):
    return ix.latest_by_key(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("last_id"))


# --- Indexes


@query("r1_keyword_index", with_ctes("terms", "SELECT term, df, round(idf, 6) AS idf FROM terms"))
def r1(spark, sf):
    return v.index(spark, sf).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query("r1_doc_stats", with_ctes("stats", "SELECT chunk_id, dl FROM stats"))
def r1b(spark, sf):
    return v.index(spark, sf).doc_stats


@query("r2_keyword_search", with_ctes("kw", "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM kw"))
def r2(spark, sf):
    return rt.keyword_search(v.search_queries(spark, sf), v.index(spark, sf)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_DOT = "list_dot_product(CAST({0}.embedding AS DOUBLE[]), CAST({1}.embedding AS DOUBLE[]))"
_COS = f"SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round({_DOT.format('q', 'e')} / (sqrt({_DOT.format('q', 'q')}) * sqrt({_DOT.format('e', 'e')})), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0"
_VEC = f"SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({_COS})) WHERE rank <= 20"


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


@query("r3_vector_search", _VEC)
def r3(spark, sf):
    return rt.vector_search(*_vectors(spark, sf)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("r3_vector_search_sql", _VEC)
def r3b(spark, sf):
    return rt.vector_search_sql(*_vectors(spark, sf)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("r3_pivot_search", _VEC)
def r3c(spark, sf):
    q, vectors = _vectors(spark, sf)
    return pv.pivot_search(q, pv.build_pivots(vectors, 64)).hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _embed(key: str, text: str, src: str) -> str:
    counts = "list_transform(range(32), lambda d: CAST(len(list_filter(toks, lambda w: (unicode(w[1]) + 7 * length(w)) % 32 = d)) AS DOUBLE))"
    return f"SELECT {key}, {counts} AS vec FROM (SELECT {key}, {v._TOK.format(text)} AS toks FROM {src})"


v.CTE["cvec"] = (("chunks_old",), _embed("chunk_id", "embed_text", "chunks_old WHERE chunk_level = 'child'"))
v.CTE["qvec"] = ((), _embed("item_id", "text", "benchmark"))
v.CTE["vec"] = (
    ("cvec", "qvec"),
    "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.item_id AS query_id, c.chunk_id, round(list_dot_product(q.vec, c.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(c.vec, c.vec))), 9) AS score FROM qvec q, cvec c WHERE list_dot_product(q.vec, q.vec) > 0 AND list_dot_product(c.vec, c.vec) > 0)) WHERE rank <= 20",
)
v.CTE["fused"] = (("kw", "vec"), "SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM vec UNION ALL SELECT query_id, chunk_id, rank FROM kw) GROUP BY ALL")
v.CTE["hybrid"] = (("fused",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 24")
v.CTE["capped"] = (("hybrid",), "SELECT * FROM (SELECT query_id, chunk_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT h.*, c.doc_id, row_number() OVER (PARTITION BY query_id, c.doc_id ORDER BY h.rank) AS nth FROM hybrid h JOIN chunks_old c ON c.chunk_id = h.chunk_id AND c.chunk_level = 'child') WHERE nth <= 2) WHERE rank <= 8")
v.CTE["expanded"] = (("capped",), r"SELECT x.*, coalesce(p.body_text, c.body_text, '') AS text, len(regexp_extract_all(coalesce(p.body_text, c.body_text, ''), '\S+')) AS tokens FROM capped x LEFT JOIN chunks_old c ON c.chunk_id = x.chunk_id AND c.chunk_level = 'child' LEFT JOIN chunks_old p ON p.chunk_id = c.parent_chunk_id AND p.chunk_level = 'parent'")
v.CTE["budget"] = (("expanded",), "SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM expanded) WHERE rank = 1 OR running <= 4000")
v.CTE["bundle"] = (("budget",), "SELECT b.query_id, CAST(b.rank AS INTEGER) AS rank, '[' || b.rank || ']' AS cite_key, b.chunk_id, b.doc_id, coalesce(d.title, b.doc_id) AS title, d.uri AS source_uri, b.text, b.score, b.tokens FROM budget b LEFT JOIN docs_old d ON d.doc_id = b.doc_id")


@query("p5_embed_chunks", with_ctes("cvec", "SELECT chunk_id, array_to_string(list_transform(vec, lambda x: CAST(CAST(round(x / sqrt(list_dot_product(vec, vec)) * 1000000) AS BIGINT) AS VARCHAR)), ',') AS vector FROM cvec"))
def p5(spark, sf):
    e = rt.embed_chunks(v.children(spark, sf), rt.hashing_embedder)
    return e.select("chunk_id", F.array_join(F.transform("vector", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",").alias("vector"))


@query("p6_dimensions", "SELECT CAST(min(len(embedding)) AS INTEGER) AS least, CAST(max(len(embedding)) AS INTEGER) AS most, count(*) AS n, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS ok FROM embeddings")
def p6(spark, sf):
    return ix.assert_dimensions(table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector"), 64)


# --- Retrieval


def _search(spark, sf):
    docs = materialized(v.docs(spark, sf), "docs")
    chunks = materialized(dx.chunk_documents(docs), "chunks")
    q = v.search_queries(spark, sf)
    vectors = rt.embed_chunks(chunks.filter("chunk_level = 'child'"), rt.hashing_embedder)
    return q, v.index(spark, sf, of=chunks), vectors, rt.embed_chunks(q, rt.hashing_embedder, key="query_id", text="query"), chunks, docs


@query("r4_fusion", with_ctes("fused", "SELECT query_id, chunk_id, score FROM fused"))
def r4(spark, sf):
    q, index, vec, qvec, *_ = _search(spark, sf)
    return rt.rrf({"vector": rt.vector_search(qvec, vec), "keyword": rt.keyword_search(q, index)}).select("query_id", "chunk_id", "score")


@query("r5_hybrid_search", with_ctes("hybrid", "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM hybrid WHERE rank <= 10"))
def r5(spark, sf):
    q, index, vec, qvec, *_ = _search(spark, sf)
    return rt.hybrid_search(q, index, vec, qvec)


_FILTERED = "(SELECT * FROM {0} WHERE chunk_id IN (SELECT chunk_id FROM chunks_old WHERE chunk_level = 'child' AND token_count BETWEEN 100 AND 400 AND chunk_index <= 1))"
_TOP20 = "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {0} QUALIFY rank <= 20"
v.CTE["vecscore"] = (("cvec", "qvec"), "SELECT q.item_id AS query_id, c.chunk_id, round(list_dot_product(q.vec, c.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(c.vec, c.vec))), 9) AS score FROM qvec q, cvec c")


@query(
    "r5_filtered_search",
    with_ctes(
        "kwscore vecscore",
        f"SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (({_TOP20.format(_FILTERED.format('vecscore'))}) UNION ALL (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {_FILTERED.format('kwscore')}) WHERE rank <= 20 AND score > 0)) GROUP BY ALL)) WHERE rank <= 10",
    ),
)
def r5b(spark, sf):
    q, index, vec, qvec, chunks, _ = _search(spark, sf)
    only = rt.apply_filters(chunks, [("chunk_level", "eq", "child"), ("token_count", "range", (100, 400)), ("chunk_index", "lte", 1)])
    return rt.hybrid_search(q, index, vec, qvec, only=only)


@query("r2_indexed_search", with_ctes("kw", "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM kw"))
def r2b(spark, sf):
    path, q = scratch(spark, "index"), v.search_queries(spark, sf)
    pk.write_packed(v.children(spark, sf), path, 8)
    terms = q.select(F.explode(tx.tokenize(F.col("query"))).alias("term"))
    return rt.keyword_search(q, pk.read_packed(spark, path, terms, 8)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("r2_block_max_search", with_ctes("kw", "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM kw"))
def r2c(spark, sf):
    index = sn.write_snapshot(v.children(spark, sf), scratch(spark, "snapshots"), 8)
    return sn.block_max_search(v.search_queries(spark, sf), index).hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _upserted(spark, sf):
    """An index on disk over the old chunks and the snapshot after the batch of batch_diff; of both only what the index holds is stored."""
    level = F.lit("child").alias("chunk_level")
    before = sn.write_snapshot(v.children(spark, sf), scratch(spark, "snapshots"), 8)
    new = materialized(sn.numbered(rt.forward_of(dx.chunk_documents(batch_docs(spark, sf)).filter("chunk_level = 'child'"), "content_hash"), 0), "new-rows")
    held = lambda rows: rows.select("chunk_id", "doc_id", "content_hash", level)
    return before, sn.upsert_snapshot(before, batch_diff(spark, sf, held(before.read("forward")), held(new)), new)


v.CTE["postings_batch"] = (
    ("chunks_old", "chunks_new"),
    f"SELECT term, chunk_id, doc_id, count(*) AS tf FROM (SELECT chunk_id, doc_id, unnest({_CHUNK_TOKENS}) AS term FROM (SELECT chunk_id, doc_id, title, embed_text FROM chunks_old WHERE chunk_level = 'child' AND doc_id NOT IN ({_TOUCHED}) UNION ALL SELECT chunk_id, doc_id, title, embed_text FROM chunks_new WHERE chunk_level = 'child' AND doc_id IN (SELECT doc_id FROM docs_new WHERE n % 3 = 0))) GROUP BY ALL",
)


@query("p4_snapshot_search", with_ctes("kw", "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM kw", {"postings": "postings_batch"}))
def p4d(spark, sf):
    _, index = _upserted(spark, sf)
    return sn.block_max_search(v.search_queries(spark, sf), index).hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("s5_old_snapshot_search", with_ctes("kw", "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM kw"))
def s5b(spark, sf):
    before, _ = _upserted(spark, sf)
    index = sn.open_snapshot(spark, before.path, 1)
    return sn.block_max_search(v.search_queries(spark, sf), index).hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("r6_cap_per_doc", with_ctes("kw", "SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS nth FROM kw) WHERE nth <= 1) WHERE rank <= 8"))
def r6(spark, sf):
    return rt.cap_per_doc(rt.keyword_search(v.search_queries(spark, sf), v.index(spark, sf)), 1).select("query_id", "chunk_id", "rank")


def bundle(spark, sf):
    return rt.retrieve(*_search(spark, sf))


@query("j3_expand_parents", with_ctes("kw", "SELECT k.query_id, k.chunk_id, sha256(coalesce(p.body_text, c.body_text, '')) AS text_hash FROM kw k LEFT JOIN chunks_old c ON c.chunk_id = k.chunk_id AND c.chunk_level = 'child' LEFT JOIN chunks_old p ON p.chunk_id = c.parent_chunk_id AND p.chunk_level = 'parent'"))
def j3(spark, sf):
    chunks = v.stored_chunks(spark, sf)
    hits = rt.keyword_search(v.search_queries(spark, sf), v.index(spark, sf, of=chunks))
    return rt.expand_parents(hits, chunks).select("query_id", "chunk_id", F.sha2("text", 256).alias("text_hash"))


@query("r7_token_budget", with_ctes("kw", r"SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(tokens AS INTEGER) AS tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM (SELECT k.*, len(regexp_extract_all(c.body_text, '\S+')) AS tokens FROM kw k JOIN chunks_old c ON c.chunk_id = k.chunk_id AND c.chunk_level = 'child')) WHERE rank = 1 OR running <= 1500"))
def r7(spark, sf):
    chunks = v.stored_chunks(spark, sf)
    hits = rt.keyword_search(v.search_queries(spark, sf), v.index(spark, sf, of=chunks))
    return rt.trim_to_budget(rt.expand_parents(hits, chunks, expand=False), 1500).select("query_id", "chunk_id", "rank", "tokens")


@query("r8_context_bundle", with_ctes("bundle", "SELECT query_id, rank, cite_key, chunk_id, title, source_uri, score, CAST(tokens AS INTEGER) AS tokens FROM bundle"))
def r8(spark, sf):
    return bundle(spark, sf).select("query_id", "rank", "cite_key", "chunk_id", "title", "source_uri", "score", "tokens")


@query("j4_citations", with_ctes("bundle", "SELECT query_id, cite_key, title, source_uri, substr(text, 1, 240) AS excerpt FROM bundle"))
def j4(spark, sf):
    return bundle(spark, sf).select("query_id", "cite_key", "title", "source_uri", "excerpt")


@query("r9_prompt", with_ctes("bundle", "SELECT query_id, sha256(string_agg(cite_key || ' ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg(cite_key || ' ' || title || ' — ' || source_uri, chr(10) ORDER BY rank)) AS prompt_hash FROM bundle GROUP BY query_id"))
def r9(spark, sf):
    return rt.format_context(bundle(spark, sf)).select("query_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query("r10_confidence", with_ctes("bundle", "SELECT b.item_id AS query_id, coalesce(n, 0) AS n, round(CASE WHEN n IS NULL THEN 0.2::DOUBLE ELSE least(least(0.5::DOUBLE + 0.05::DOUBLE * n, 0.85::DOUBLE) + 0.1::DOUBLE, 0.95::DOUBLE) END, 6) AS confidence FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n FROM bundle GROUP BY query_id) k ON k.query_id = b.item_id"))
def r10(spark, sf):
    return rt.evidence_confidence(v.search_queries(spark, sf), bundle(spark, sf))


@query("r11_global_search", with_ctes("mem", "SELECT category, id, title, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY stamp DESC, id) AS rank FROM (SELECT 'memories' AS category, memory_id AS id, title, epoch_us(updated_at) AS stamp FROM mem WHERE contains(lower(concat_ws(' ', title, summary, concept, abstraction)), 'er') UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), source, doc_id FROM documents WHERE contains(lower(text), 'er') UNION ALL SELECT 'decisions', CAST(item_id AS VARCHAR), NULL, item_id FROM benchmark WHERE contains(lower(text), 'er'))) WHERE rank <= 7"))
def r11(spark, sf):
    m = v.memories(spark, sf).select(F.col("memory_id").alias("id"), "title", F.concat_ws(" ", "title", "summary", "concept", "abstraction").alias("text"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text", F.col("doc_id").alias("at"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit(None).cast("string").alias("title"), "text", F.col("item_id").alias("at"))
    return rt.global_search("ER", 7, memories=m, documents=d, decisions=b)


def everywhere_queries(spark, sf):
    """query_id, query: queries of one to twelve letters, in mixed case, and one that nothing holds."""
    b, i = table(spark, sf, "benchmark"), F.col("item_id")
    kinds = [F.concat(F.lit("User "), (i % 10).cast("string")), F.substring("text", 1, 12), F.lit("PURCH"), F.lit("e"), F.concat(F.lit("r "), (i % 9).cast("string")), F.lit("no such words"), F.substring("text", 3, 2)]
    query_ = F.lit(None).cast("string")
    for n, k in enumerate(kinds):
        query_ = F.when(i % len(kinds) == n, k).otherwise(query_)
    return b.select(i.alias("query_id"), query_.alias("query"))


v.CTE["gq"] = ((), "SELECT item_id, CASE item_id % 7 WHEN 0 THEN 'User ' || (item_id % 10) WHEN 1 THEN substr(text, 1, 12) WHEN 2 THEN 'PURCH' WHEN 3 THEN 'e' WHEN 4 THEN 'r ' || (item_id % 9) WHEN 5 THEN 'no such words' ELSE substr(text, 3, 2) END AS text FROM benchmark")
v.CTE["qterms_gq"] = (("gq",), f"SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({v._TOK.format('text')}) AS term FROM gq) GROUP BY ALL")
v.CTE["qvec_gq"] = (("gq",), _embed("item_id", "text", "gq"))
v.CTE["domains"] = (
    ("mem", "execs"),
    """SELECT 'memories' AS category, memory_id AS id, title, concat_ws(' ', title, summary, concept, abstraction) AS text, epoch_us(updated_at) AS stamp FROM mem
UNION ALL SELECT 'decisions', CAST(item_id AS VARCHAR), NULL, text, item_id FROM benchmark
UNION ALL SELECT 'workflows', workflow_id || '/' || memory_type, workflow_id, workflow_id || ' ' || memory_type || ' of ' || count(*) || ' memories', epoch_us(max(updated_at)) FROM mem WHERE workflow_id IS NOT NULL GROUP BY workflow_id, memory_type
UNION ALL SELECT 'automations', automation_id, automation_id, automation_id || ' last ' || arg_max(status, execution_id), epoch_us(max(started_at)) FROM execs GROUP BY automation_id""",
)


@query(
    "r11_search_everywhere",
    with_ctes(
        "hybrid gq domains",
        "SELECT query_id, 'knowledge' AS category, chunk_id AS id, CAST(NULL AS VARCHAR) AS title, CAST(rank AS INTEGER) AS rank FROM hybrid WHERE rank <= 5 UNION ALL SELECT query_id, category, id, title, CAST(rank AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY stamp DESC, id) AS rank FROM (SELECT g.item_id AS query_id, d.* FROM gq g JOIN domains d ON contains(lower(d.text), lower(g.text)))) WHERE rank <= 5",
        {"qterms": "qterms_gq", "qvec": "qvec_gq"},
    ),
)
def r11b(spark, sf):
    q = everywhere_queries(spark, sf)
    _, index, vec, _, _, _ = _search(spark, sf)
    hits = rt.hybrid_search(q, index, vec, rt.embed_chunks(q, rt.hashing_embedder, key="query_id", text="query"), k=5)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    mem, runs = v.memories(spark, sf), v.executions(spark, sf)
    m = mem.select(F.col("memory_id").alias("id"), "title", F.concat_ws(" ", "title", "summary", "concept", "abstraction").alias("text"), micros(F.col("updated_at")).alias("at"))
    d = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit(None).cast("string").alias("title"), "text", F.col("item_id").alias("at"))
    w = mem.filter("workflow_id IS NOT NULL").groupBy("workflow_id", "memory_type").agg(F.count("*").alias("n"), micros(F.max("updated_at")).alias("at"))
    w = w.select(F.concat_ws("/", "workflow_id", "memory_type").alias("id"), F.col("workflow_id").alias("title"), F.concat("workflow_id", F.lit(" "), "memory_type", F.lit(" of "), F.col("n").cast("string"), F.lit(" memories")).alias("text"), "at")
    a = runs.groupBy("automation_id").agg(F.max_by("status", "execution_id").alias("status"), micros(F.max("started_at")).alias("at"))
    a = a.select(F.col("automation_id").alias("id"), F.col("automation_id").alias("title"), F.concat("automation_id", F.lit(" last "), "status").alias("text"), "at")
    return ev.search_everywhere(q, hits, 5, memories=m, decisions=d, workflows=w, automations=a)


# --- Manifest, integrity, health


def _state(spark, sf):
    """A broken state: every 23rd id missing from the indexes, invented ids, orphans, a duplicate, a wrong manifest."""
    full = materialized(v.docs(spark, sf), "docs")
    d = full.drop("body")
    c = materialized(dx.chunk_documents(full).drop("embed_text", "body_text"), "chunks")
    kids = c.filter("chunk_level = 'child'")
    registry = d.filter("n % 29 <> 0").select("source_id", "doc_id", F.when(F.col("n") % 31 == 0, "tombstoned").otherwise("ready").alias("status"), F.lit(1).alias("seq"))
    raw = d.filter("n % 37 <> 0").select("source_id")
    some = kids.filter(F.conv(F.substring("chunk_id", 5, 4), 16, 10).cast("int") % 23 != 0)
    ids = some.select("chunk_id").union(spark.createDataFrame([("chk_invented",)], "chunk_id string"))
    cache = some.select("content_hash").union(spark.createDataFrame([("sha256:none",)], "content_hash string"))
    manifest = d.agg((F.count("*") + 1).alias("document_count"), F.lit(5).cast("long").alias("child_chunk_count"), F.lit(0).cast("long").alias("embedding_count"))
    return registry, raw, d, c, some, ids, cache, manifest


_HEX = "CAST('0x' || substr(chunk_id, 5, 4) AS INTEGER) % 23 <> 0"
for _n, _q in {
    "reg": (("docs_old",), "SELECT source_id, doc_id, CASE WHEN n % 31 = 0 THEN 'tombstoned' ELSE 'ready' END AS status FROM docs_old WHERE n % 29 <> 0"),
    "kids": (("chunks_old",), "SELECT * FROM chunks_old WHERE chunk_level = 'child'"),
    "held": (("kids",), f"SELECT * FROM kids WHERE {_HEX}"),
    "idx": (("held",), "SELECT chunk_id FROM held UNION ALL SELECT 'chk_invented'"),
    "gaps": (("idx",), "SELECT count(*) AS n FROM (SELECT DISTINCT chunk_id FROM kids) WHERE chunk_id NOT IN (SELECT chunk_id FROM idx)"),
    "issues": (
        ("reg", "gaps"),
        """SELECT 'error' AS severity, 'MISSING_RAW' AS code, 'Registry source ' || source_id || ' has no raw directory' AS message, source_id AS resource_id, false AS repairable FROM reg WHERE status <> 'tombstoned' AND source_id NOT IN (SELECT source_id FROM docs_old WHERE n % 37 <> 0)
UNION ALL SELECT 'warning', 'ORPHAN_PROCESSED_DOC', 'Processed document ' || doc_id || ' not referenced by any active source', doc_id, true FROM docs_old WHERE doc_id NOT IN (SELECT doc_id FROM reg WHERE status <> 'tombstoned')
UNION ALL SELECT 'error', 'MISSING_ARTIFACT', 'Document ' || doc_id || ' missing chunks', doc_id, false FROM docs_old WHERE doc_id NOT IN (SELECT doc_id FROM chunks_old)
UNION ALL SELECT 'error', 'MISSING_EMBEDDINGS', 'Document ' || doc_id || ' missing embeddings for ' || count(DISTINCT chunk_id) || ' chunk(s)', doc_id, true FROM kids WHERE chunk_id NOT IN (SELECT chunk_id FROM held) GROUP BY doc_id
UNION ALL SELECT 'warning', 'STALE_VECTOR_ENTRY', 'Vector index contains chunk not in processed store: chk_invented', 'chk_invented', true
UNION ALL SELECT 'warning', 'STALE_KEYWORD_ENTRY', 'Keyword index contains chunk not in processed store: chk_invented', 'chk_invented', true
UNION ALL SELECT 'error', 'VECTOR_INDEX_MISMATCH', 'Vector index missing ' || n || ' chunk(s)', NULL, true FROM gaps WHERE n > 0
UNION ALL SELECT 'warning', 'KEYWORD_INDEX_MISMATCH', 'Keyword index missing ' || n || ' chunk(s)', NULL, true FROM gaps WHERE n > 0
UNION ALL SELECT 'warning', 'MANIFEST_MISMATCH', 'Manifest document_count does not match processed documents', NULL, true
UNION ALL SELECT 'warning', 'MANIFEST_MISMATCH', 'Manifest chunk_count does not match processed chunks', NULL, true
UNION ALL SELECT 'info', 'ORPHANED_CACHE', 'Embedding cache row has no matching chunk: sha256:none', 'sha256:none', true
UNION ALL SELECT 'error', 'DUPLICATE_CHUNK_ID', 'Chunk ID ' || chunk_id || ' appears ' || count(*) || ' times across documents', chunk_id, false FROM chunks_old GROUP BY chunk_id HAVING count(*) > 1""",
    ),
}.items():
    v.CTE[_n] = _q


def _issues(spark, sf):
    registry, raw, d, c, some, ids, cache, manifest = _state(spark, sf)
    return ix.validate_index(registry, raw, d, c, some, ids, ids, manifest, cache)


@query("p1_integrity", with_ctes("issues", "SELECT * FROM issues"))
def p1(spark, sf):
    return _issues(spark, sf)


@query("p1_integrity_by_digest", with_ctes("issues", "SELECT * FROM issues"))
def p1b(spark, sf):
    registry, raw, d, c, some, ids, cache, manifest = _state(spark, sf)
    return ix.validate_by_digest(registry, raw, d, c, some, ids, ids, manifest, cache)


@query("p2_repair", with_ctes("issues", "SELECT 'documents' AS part, count(*) AS n FROM docs_old WHERE doc_id NOT IN (SELECT resource_id FROM issues WHERE code = 'ORPHAN_PROCESSED_DOC') UNION ALL SELECT 'cache', count(*) FROM held UNION ALL SELECT 'postings', count(DISTINCT chunk_id) FROM held"))
def p2(spark, sf):
    registry, raw, d, c, some, ids, cache, manifest = _state(spark, sf)
    issues = ix.validate_index(registry, raw, d, c, some, ids, ids, manifest, cache)
    out = ix.repair_index(issues, ids.distinct(), d, cache)
    n = lambda k: out[k].agg(F.lit(k).alias("part"), F.count("*").alias("n"))
    return n("documents").union(n("cache")).union(n("postings"))


@query("p3_purge", with_ctes("docs_old chunks_old", "SELECT 'documents' AS part, count(*) AS n FROM docs_old WHERE n % 10 <> 3 UNION ALL SELECT 'chunks', count(*) FROM chunks_old WHERE doc_id NOT IN (SELECT doc_id FROM docs_old WHERE n % 10 = 3) UNION ALL SELECT 'tombstoned', count(*) FROM docs_old WHERE n % 10 = 3"))
def p3(spark, sf):
    d = v.docs(spark, sf)
    gone = d.filter("n % 10 = 3")
    registry = d.select("source_id", F.lit("ready").alias("status"), F.lit(1).alias("seq"))
    out = ix.purge({"documents": d, "chunks": v.chunks(spark, sf)}, registry, gone.select("source_id"), gone.select("doc_id"))
    latest = ix.latest_by_key(out["registry"], "source_id", ["seq"]).filter("status = 'tombstoned'")
    n = lambda name, x: x.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n("documents", out["documents"]).union(n("chunks", out["chunks"])).union(n("tombstoned", latest))


def _stores(spark, sf):
    """The broken state of _state as stores that can be mended, and its issues."""
    docs = materialized(v.docs(spark, sf), "docs")
    chunks = materialized(dx.chunk_documents(docs), "chunks")
    d, kids = docs.drop("body"), chunks.filter("chunk_level = 'child'")
    live = d.filter("n % 29 <> 0").select("source_id", "doc_id", F.when(F.col("n") % 31 == 0, "tombstoned").otherwise("ready").alias("status"), F.lit(1).alias("seq"))
    some = kids.filter(F.conv(F.substring("chunk_id", 5, 4), 16, 10).cast("int") % 23 != 0)
    vectors = materialized(rt.embed_chunks(some, rt.hashing_embedder), "vectors")
    invented = spark.createDataFrame([("chk_invented",)], "chunk_id string")
    one = ["term", "chunk_id", "doc_id", "tf", "dl"]
    postings = rt.postings_of(some).select(*one).unionByName(invented.select(F.lit("x").alias("term"), "chunk_id", F.lit("d").alias("doc_id"), F.lit(1).cast("long").alias("tf"), F.lit(1).cast("long").alias("dl")))
    cache = some.select("chunk_id", "content_hash").join(vectors, "chunk_id").groupBy("content_hash").agg(F.first("vector").alias("vector"))
    cache = cache.unionByName(spark.createDataFrame([("sha256:none", [0.0])], "content_hash string, vector array<double>"))
    manifest = d.agg((F.count("*") + 1).alias("document_count"), F.lit(5).cast("long").alias("child_chunk_count"), F.lit(0).cast("long").alias("embedding_count"))
    stores = up.Stores(live, d, chunks, vectors, some.select("chunk_id").union(invented), materialized(postings, "postings"), materialized(cache, "cache"), manifest)
    return stores, d.filter("n % 37 <> 0").select("source_id")


def _checked(stores, raw):
    return ix.validate_index(stores.registry, raw, stores.documents, stores.chunks, stores.embeddings, stores.vector_ids, stores.postings.select("chunk_id").distinct(), stores.manifest, stores.cache)


_LIVE = "(SELECT doc_id FROM reg WHERE status <> 'tombstoned')"


@query(
    "p2_repair_stores",
    with_ctes(
        "reg kids issues",
        f"""SELECT 'left: ' || code AS part, count(*) AS n FROM issues WHERE code = 'MISSING_RAW' GROUP BY code UNION ALL SELECT 'left: MISSING_ARTIFACT', count(*) FROM issues WHERE code = 'MISSING_ARTIFACT' AND resource_id IN {_LIVE} HAVING count(*) > 0
UNION ALL SELECT 'left: DUPLICATE_CHUNK_ID', count(*) FROM (SELECT chunk_id FROM chunks_old WHERE doc_id IN {_LIVE} GROUP BY chunk_id HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'embeddings', count(DISTINCT chunk_id) FROM kids WHERE doc_id IN {_LIVE} UNION ALL SELECT 'indexed', count(DISTINCT chunk_id) FROM kids WHERE doc_id IN {_LIVE} UNION ALL SELECT 'cache', count(DISTINCT content_hash) FROM kids WHERE doc_id IN {_LIVE}
UNION ALL SELECT 'manifest: ' || document_count || ' ' || chunk_count, 1 FROM (SELECT (SELECT count(*) FROM docs_old WHERE doc_id IN {_LIVE}) AS document_count, (SELECT count(*) FROM kids WHERE doc_id IN {_LIVE}) AS chunk_count)""",
    ),
)
def p2b(spark, sf):
    stores, raw = _stores(spark, sf)
    out = up.repair(stores, _checked(stores, raw), rt.hashing_embedder)
    out = up.replace(out, postings=materialized(out.postings, "postings"), embeddings=materialized(out.embeddings, "embeddings"), cache=materialized(out.cache, "cache"))
    n = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    left = _checked(out, raw).groupBy(F.concat(F.lit("left: "), "code").alias("part")).agg(F.count("*").alias("n"))
    made = out.manifest.select(F.concat_ws(" ", F.lit("manifest:"), "document_count", "child_chunk_count").alias("part"), F.lit(1).cast("long").alias("n"))
    return left.union(n("embeddings", out.embeddings)).union(n("indexed", out.postings.select("chunk_id").distinct())).union(n("cache", out.cache)).union(made)


@query("p2_repair_plan", with_ctes("issues", "SELECT CAST(list_position(['ORPHAN_PROCESSED_DOC', 'STALE_VECTOR_ENTRY', 'STALE_KEYWORD_ENTRY', 'ORPHANED_CACHE', 'MISSING_EMBEDDINGS', 'VECTOR_INDEX_MISMATCH', 'KEYWORD_INDEX_MISMATCH', 'MANIFEST_MISMATCH'], code) AS INTEGER) AS step, code, count(*) AS n FROM issues WHERE repairable GROUP BY code"))
def p2c(spark, sf):
    return up.repair_plan(_issues(spark, sf)).select("step", "code", "n")


_GONE = "SELECT doc_id FROM docs_old WHERE n % 10 = 3 OR n % 41 = 0"


@query(
    "p3_purge_cascade",
    with_ctes(
        "kids held",
        f"""SELECT 'documents' AS part, count(*) AS n FROM docs_old WHERE doc_id NOT IN ({_GONE}) UNION ALL SELECT 'chunks', count(*) FROM chunks_old WHERE doc_id NOT IN ({_GONE}) UNION ALL SELECT 'tombstoned', count(*) FROM docs_old WHERE n % 10 = 3 AND n % 29 <> 0 UNION ALL
SELECT 'embeddings', count(*) FROM held WHERE chunk_id IN (SELECT chunk_id FROM kids WHERE doc_id NOT IN ({_GONE})) UNION ALL SELECT 'cache', count(DISTINCT content_hash) + 1 FROM held WHERE content_hash IN (SELECT content_hash FROM kids WHERE doc_id NOT IN ({_GONE}))
UNION ALL SELECT 'manifest', count(*) FROM kids WHERE doc_id NOT IN ({_GONE})""",
    ),
)
def p3b(spark, sf):
    stores, _ = _stores(spark, sf)
    sources = stores.documents.filter("n % 10 = 3 AND n % 29 <> 0").select("source_id")
    docs = stores.documents.filter("n % 41 = 0 OR n % 10 = 3").select("doc_id")
    out = up.purge(stores, sources, docs)
    latest = ix.latest_by_key(out.registry.select("source_id", "status", "seq"), "source_id", ["seq"]).filter("status = 'tombstoned' AND seq > 1")
    n = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    parts = [n("documents", out.documents), n("chunks", out.chunks), n("tombstoned", latest), n("embeddings", out.embeddings), n("cache", out.cache), out.manifest.select(F.lit("manifest"), "child_chunk_count")]
    return reduce(lambda a, b: a.union(b), parts)


@query("u1_set_differences", with_ctes("idx", "SELECT 'stale' AS side, chunk_id FROM (SELECT DISTINCT chunk_id FROM idx) WHERE chunk_id NOT IN (SELECT chunk_id FROM kids) UNION ALL SELECT 'missing', chunk_id FROM (SELECT DISTINCT chunk_id FROM kids) WHERE chunk_id NOT IN (SELECT chunk_id FROM idx)"))
def u1(spark, sf):
    _, _, _, c, _, ids, _, _ = _state(spark, sf)
    kids = c.filter("chunk_level = 'child'")
    return ix.stale_ids(ids, kids).select(F.lit("stale").alias("side"), "chunk_id").union(ix.missing_ids(ids, kids).select(F.lit("missing"), "chunk_id"))


_MANIFEST = "SELECT (SELECT count(*) FROM reg WHERE status <> 'tombstoned') AS source_count, (SELECT count(*) FROM docs_old) AS document_count, (SELECT count(*) FROM kids) AS child_chunk_count, (SELECT count(*) FROM held) AS embedding_count, (SELECT count(*) FROM kids) AS chunk_count"


@query("a1_manifest", with_ctes("reg held", _MANIFEST))
def a1(spark, sf):
    registry, raw, d, c, some, *_ = _state(spark, sf)
    return ix.build_manifest(registry, d, c, some)


@query("p4_reindex", with_ctes("reg held terms", f"SELECT m.*, (SELECT count(*) FROM terms) AS terms FROM ({_MANIFEST}) m"))
def p4c(spark, sf):
    registry, _, d, _, some, *_ = _state(spark, sf)
    chunks = v.stored_chunks(spark, sf)
    vectors = some.select("chunk_id").union(spark.createDataFrame([("chk_invented",)], "chunk_id string")).withColumn("vector", F.array(F.lit(0.0)))
    built = ix.reindex(registry, d, chunks, vectors)
    return built["manifest"].crossJoin(built["keyword"].term_stats.agg(F.count("*").alias("terms")))


@query("a8_health", with_ctes("issues", "SELECT (SELECT count(*) FROM docs_old) + 1 AS document_count, CAST(5 AS BIGINT) AS child_chunk_count, (SELECT count(*) FROM kids) AS chunk_rows, (SELECT count(*) FROM idx) AS vector_count, (SELECT count(*) FROM idx) AS keyword_count, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, false AS healthy, 'vector index out of step; keyword index out of step; manifest out of step' AS notes FROM issues"))
def a8(spark, sf):
    registry, raw, d, c, some, ids, cache, manifest = _state(spark, sf)
    issues = ix.validate_index(registry, raw, d, c, some, ids, ids, manifest, cache)
    return ix.health_report(manifest, c, ids, ids, issues)


@query("w4_admit_uploads", with_ctes("files", "SELECT batch_id, pos, name, CASE WHEN over THEN 'stopped' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS verdict, CASE WHEN over THEN 'total limit' ELSE reason END AS reason FROM (SELECT *, sum(CASE WHEN reason IS NULL THEN size ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY pos) > 2000000 AS over FROM (SELECT *, CASE WHEN pos > 60 THEN 'too many files' WHEN ends_with(name, '.exe') THEN 'blocked type' WHEN NOT (ends_with(name, '.md') OR ends_with(name, '.txt') OR ends_with(name, '.pdf')) THEN 'unsupported type' WHEN size = 0 THEN 'empty file' WHEN size > 90000 THEN 'file too large' END AS reason FROM (SELECT substr(path, 8, 1) AS batch_id, CAST(row_number() OVER (PARTITION BY substr(path, 8, 1) ORDER BY event_id) AS INTEGER) AS pos, substr(path, 8) AS name, size FROM files)))"))
def w4(spark, sf):
    from pyspark.sql import Window as W

    f = v.file_events(spark, sf)
    batch = F.substring("path", 8, 1)
    files = f.select(batch.alias("batch_id"), F.row_number().over(W.partitionBy(batch).orderBy("event_id")).alias("pos"), F.substring("path", 8, 100).alias("name"), "size")
    return ix.admit_uploads(files, 90_000, 2_000_000, 60, [".md", ".txt", ".pdf"], [".exe"])


@query("a7_overview", with_ctes("mem execs", "SELECT 'memories' AS area, memory_type || '/' || status AS label, count(*) AS n FROM mem GROUP BY ALL UNION ALL SELECT 'executions', status, count(*) FROM execs GROUP BY ALL UNION ALL SELECT 'documents', source, count(*) FROM documents GROUP BY ALL"))
def a7(spark, sf):
    return ix.overview(memories=(v.memories(spark, sf), ["memory_type", "status"]), executions=(v.executions(spark, sf), ["status"]), documents=(table(spark, sf, "documents"), ["source"]))
