"""The views the queries read, derived from the driver's tables: once as DataFrames, once as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import documents as dx
from ..functions import text as tx
from ..operators import retrieval
from ..sources.tables import materialized, spread, table

CONCEPTS = ("Budget", "budget", "Solar", "solar power", "Hiring", "TRAVEL", "travel")
AS_OF = "2024-02-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def sources(spark: SparkSession, sf: str, version: str = "old") -> DataFrame:
    """source_id, uri, text, fingerprint: the documents, or (new) with every 10th edited, every 17th gone, every 13th renamed."""
    d, edited = spread(table(spark, sf, "documents").select("doc_id", "text", "source")), F.lit(version == "new")
    n = F.col("doc_id")
    text = F.when(edited & (n % 10 == 0), F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    sid = F.when(edited & (n % 13 == 0), F.concat(F.lit("new_"), n.cast("string"))).otherwise(F.concat(F.lit("src_"), n.cast("string")))
    rows = d.filter(~edited | (n % 17 != 0)).select(n.alias("n"), sid.alias("source_id"), F.concat(F.lit("file:///"), "source", F.lit("/"), n.cast("string"), F.lit(".txt")).alias("uri"), text.alias("text"))
    return rows.withColumn("fingerprint", tx.fingerprint(F.col("text")))


def docs(spark, sf, version="old") -> DataFrame:
    """doc_id, source_id, uri, title, body: extracted and normalized."""
    s = sources(spark, sf, version)
    x = dx.extract_text(s, F.col("n").cast("string"))
    return x.select(tx.doc_id(F.col("source_id")).alias("doc_id"), "source_id", "uri", "title", tx.normalize_body(F.col("body")).alias("body"), "fingerprint", "n")


def chunks(spark, sf, version="old") -> DataFrame:
    return dx.chunk_documents(docs(spark, sf, version))


def children(spark, sf, version="old") -> DataFrame:
    return chunks(spark, sf, version).filter("chunk_level = 'child'")


def stored_chunks(spark, sf, version="old") -> DataFrame:
    return materialized(chunks(spark, sf, version), "chunks")


def index(spark, sf, version="old", of: DataFrame | None = None) -> retrieval.KeywordIndex:
    """The keyword index over child chunks; it is built once and stored."""
    kids = children(spark, sf, version) if of is None else of.filter("chunk_level = 'child'")
    return retrieval.build_keyword_index(kids)


def search_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def events(spark, sf, stream: bool = False) -> DataFrame:
    rows = table(spark, sf, "events")
    if stream:
        rows = spark.readStream.schema(rows.schema).parquet(f"{sf}/events.parque[t]")  # as a glob: the table may be one file
    return rows.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))


def memories(spark, sf) -> DataFrame:
    """The wide memory table: one row an event."""
    e, k, kind = events(spark, sf), F.col("k"), F.col("event_type")
    memory_type = F.when(kind == "view", "working").when(kind.isin("click", "error"), "episodic").when(kind == "purchase", "semantic").otherwise("procedural")
    e = e.withColumn("memory_type", memory_type)
    is_ = lambda t: F.col("memory_type") == t
    mid = F.concat(F.lit("mem_"), F.col("event_id").cast("string"))
    earlier = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    name = F.concat(F.lit("proc_"), (k % 5).cast("string"))
    versions = W.partitionBy("memory_type", name).orderBy("ts", "event_id")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    uid, ks = F.col("user_id").cast("string"), k.cast("string")
    return e.select(
        mid.alias("memory_id"), "memory_type", F.when(k % 9 == 0, "archived").when((k % 9 == 1) & is_("working"), "expired").otherwise("active").alias("status"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.when(is_("working"), F.col("ts") + F.expr("INTERVAL 60 MINUTES")).alias("expires_at"), F.when(is_("working"), text("task_", uid)).alias("task_id"),
        F.when(is_("episodic"), F.when(kind == "click", "workflow_execution").otherwise("failure")).alias("event_type"), F.when(is_("episodic"), text(kind, " ", ks)).alias("title"), F.when(is_("episodic"), text("user ", uid, " ", kind)).alias("summary"),
        F.when(is_("episodic"), F.col("ts")).alias("occurred_at"), F.when(is_("episodic") & (k % 3 != 0), text("ref_", (k % 13).cast("string"))).alias("source_ref"),
        F.when(is_("semantic"), F.element_at(F.array(*map(F.lit, CONCEPTS)), k % 7 + 1)).alias("concept"), F.when(is_("semantic"), text("rule ", (k % 3).cast("string"))).alias("abstraction"),
        F.when(is_("semantic"), F.last(F.when(is_("episodic"), mid), ignorenulls=True).over(earlier)).alias("promoted_from"), F.when(is_("semantic"), (k % 11) / F.lit(10.0)).alias("confidence"),
        F.when(is_("procedural"), name).alias("procedure_name"), F.when(is_("procedural"), F.row_number().over(versions)).alias("version"), F.when(is_("procedural"), F.lag(mid).over(versions)).alias("previous_version_id"),
        F.array(text("u", (F.col("user_id") % 3).cast("string")), kind).alias("tags"), F.when(F.col("event_id") % 5 != 0, text("wf_", (F.col("user_id") % 4).cast("string"))).alias("workflow_id"), F.when(F.col("event_id") % 3 != 0, text("agent_", (F.col("user_id") % 6).cast("string"))).alias("agent_id"),
    )


def executions(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        F.concat(F.lit("exec_"), F.col("event_id").cast("string")).alias("execution_id"), F.concat(F.lit("auto_"), (F.col("user_id") % 20).cast("string")).alias("automation_id"), F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))).alias("ended_at"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), (F.col("k") % 4).alias("retry_count"),
    )


SUFFIX_OF = (".md", ".txt", ".pdf", ".exe", "")


def file_events(spark, sf, stream: bool = False) -> DataFrame:
    """path, ts, fingerprint, size of a watched folder."""
    e = events(spark, sf, stream)
    return e.select("event_id", F.concat(F.lit("/inbox/"), F.col("user_id").cast("string"), F.element_at(F.array(*map(F.lit, SUFFIX_OF)), F.col("k") % 5 + 1)).alias("path"), "ts", F.concat(F.lit("f"), (F.col("k") % 3).cast("string")).alias("fingerprint"), (F.col("k") * 1000).cast("long").alias("size"))


STRATEGY_OF = ("analytical", "strategic", "operational", "creative", "first_principles", "weighted_scoring")


def decision_requests(spark, sf) -> DataFrame:
    """decision_id, question, strategy, option_hints, require_knowledge."""
    b, i = table(spark, sf, "benchmark"), F.col("item_id")
    first = F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, 4)
    return b.select(i.alias("decision_id"), F.col("text").alias("question"), F.element_at(F.array(*map(F.lit, STRATEGY_OF)), (i % 6 + 1).cast("int")).alias("strategy"), F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(first).alias("option_hints"), (i % 7 != 0).alias("require_knowledge"))


def evidence(spark, sf) -> DataFrame:
    """decision_id, rank, relevance: evidence of fixed relevance for the scoring queries; d4_bundle_decide takes retrieved bundles."""
    b = table(spark, sf, "benchmark").filter("item_id % 7 <> 0 AND item_id % 5 <> 0")
    n = b.select(F.col("item_id").alias("decision_id"), F.explode(F.sequence(F.lit(1), (F.col("item_id") % 4 + 1).cast("int"))).alias("rank"))
    return n.withColumn("relevance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("decision_id") * 3 + F.col("rank")) % 12) / F.lit(10.0))))


def route_requests(spark, sf) -> DataFrame:
    i = F.col("item_id")
    sets = [[], ["latency"], ["cost", "coding"], ["reasoning"], ["local"], ["quality", "latency"], ["coding", "reasoning", "cost"]]
    chosen = F.lit(None).cast("array<string>")
    for n, s in enumerate(sets):
        chosen = F.when(i % 7 == n, F.array(*map(F.lit, s)).cast("array<string>")).otherwise(chosen)
    return table(spark, sf, "benchmark").select(
        i.alias("request_id"), chosen.alias("priorities"), F.when(i % 4 == 0, 100000).when(i % 11 == 0, 5000000).otherwise(0).alias("min_context"), (i % 3 == 0).alias("structured"), (i % 5 == 0).alias("multimodal"), F.when(i % 13 == 0, F.lit("custom")).alias("override_provider")
    )


# --- The same as DuckDB CTEs

_KIND = "CASE event_type WHEN 'view' THEN 'working' WHEN 'click' THEN 'episodic' WHEN 'error' THEN 'episodic' WHEN 'purchase' THEN 'semantic' ELSE 'procedural' END"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _sources(v: str) -> str:
    new = v == "new"
    text = "CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END" if new else "text"
    sid = "CASE WHEN doc_id % 13 = 0 THEN 'new_' || doc_id ELSE 'src_' || doc_id END" if new else "'src_' || doc_id"
    where = "WHERE doc_id % 17 <> 0" if new else ""
    return f"SELECT *, 'sha256:' || sha256(text) AS fingerprint FROM (SELECT doc_id AS n, {sid} AS source_id, 'file:///' || source || '/' || doc_id || '.txt' AS uri, {text} AS text FROM documents {where})"


def _docs(v: str) -> str:
    return rf"""
SELECT 'doc_' || substr(sha256(source_id || ':default'), 1, 16) AS doc_id, source_id, uri, fingerprint, n, CASE WHEN short THEN ls[1] ELSE CAST(n AS VARCHAR) END AS title,
  {_STRIP.format("regexp_replace(CASE WHEN short AND len(ls) > 1 THEN array_to_string(ls[2:], chr(10) || chr(10)) ELSE whole END, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS body
FROM (SELECT *, coalesce(length(ls[1]) < 120, false) AS short FROM (
  SELECT *, list_filter(string_split(whole, chr(10)), lambda x: {_STRIP.format("x")} <> '') AS ls FROM (SELECT *, {_STRIP.format("text")} AS whole FROM sources_{v})))"""


def _win(text: str, ws: str, size: int, step: int) -> str:
    return f"CASE WHEN len({ws}) = 0 THEN [] WHEN len({ws}) <= {size} THEN [{text}] ELSE list_transform(range(CAST(ceil((len({ws}) - {size}) / {float(step)}) AS BIGINT) + 1), lambda i: array_to_string({ws}[i * {step} + 1 : i * {step} + {size}], ' ')) END"


def _chunks(v: str) -> str:
    head = "'Document: ' || title || ' > content' || chr(10) || chr(10) || "
    made = lambda level: f"'chk_' || substr(sha256(doc_id || '|content|sha256:' || sha256({_STRIP.format('embed_text')}) || '|' || chunk_index || '|{level}'), 1, 20)"
    return rf"""
SELECT chunk_id, doc_id, source_id, 'parent' AS chunk_level, CAST(NULL AS VARCHAR) AS parent_chunk_id, chunk_index, title, len(ws) AS token_count, 'sha256:' || sha256({_STRIP.format('embed_text')}) AS content_hash, embed_text, body_text FROM parents_{v}
UNION ALL
SELECT {made('child')} AS chunk_id, doc_id, source_id, 'child', parent_chunk_id, chunk_index, title, len(regexp_extract_all(body_text, '\S+')), 'sha256:' || sha256({_STRIP.format('embed_text')}), embed_text, body_text FROM (
  SELECT *, {head} body_text AS embed_text FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, source_id ORDER BY p, c) - 1 AS chunk_index FROM (
      SELECT doc_id, source_id, title, parent_chunk_id, p, unnest(kids) AS body_text, unnest(range(len(kids))) AS c, len(kids) AS many FROM (
        SELECT doc_id, source_id, title, chunk_id AS parent_chunk_id, chunk_index AS p, {_win("body_text", "ws", 512, 448)} AS kids FROM parents_{v}))
    WHERE many = 1 OR len(regexp_extract_all(body_text, '\S+')) >= 32))"""


def _parents(v: str) -> str:
    return rf"""
SELECT *, 'chk_' || substr(sha256(doc_id || '|content|sha256:' || sha256({_STRIP.format('embed_text')}) || '|' || chunk_index || '|parent'), 1, 20) AS chunk_id FROM (
  SELECT *, regexp_extract_all(body_text, '\S+') AS ws, 'Document: ' || title || ' > content' || chr(10) || chr(10) || body_text AS embed_text FROM (
    SELECT doc_id, source_id, title, unnest(parts) AS body_text, unnest(range(len(parts))) AS chunk_index FROM (
      SELECT *, {_win("body", "bw", 2048, 2048)} AS parts FROM (SELECT *, regexp_extract_all(body, '\S+') AS bw FROM docs_{v}))))"""


_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"

#: name: (CTEs it needs, SQL)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), r"SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k FROM events"),
    "mem": (
        ("ev",),
        f"""SELECT 'mem_' || event_id AS memory_id, memory_type, CASE WHEN k % 9 = 0 THEN 'archived' WHEN k % 9 = 1 AND memory_type = 'working' THEN 'expired' ELSE 'active' END AS status, ts AS created_at, ts AS updated_at,
  CASE WHEN memory_type = 'working' THEN ts + INTERVAL 60 MINUTE END AS expires_at, CASE WHEN memory_type = 'working' THEN 'task_' || user_id END AS task_id,
  CASE WHEN memory_type = 'episodic' THEN CASE WHEN kind = 'click' THEN 'workflow_execution' ELSE 'failure' END END AS event_type, CASE WHEN memory_type = 'episodic' THEN kind || ' ' || k END AS title,
  CASE WHEN memory_type = 'episodic' THEN 'user ' || user_id || ' ' || kind END AS summary, CASE WHEN memory_type = 'episodic' THEN ts END AS occurred_at, CASE WHEN memory_type = 'episodic' AND k % 3 <> 0 THEN 'ref_' || (k % 13) END AS source_ref,
  CASE WHEN memory_type = 'semantic' THEN ([{", ".join(f"'{c}'" for c in CONCEPTS)}])[k % 7 + 1] END AS concept, CASE WHEN memory_type = 'semantic' THEN 'rule ' || (k % 3) END AS abstraction,
  CASE WHEN memory_type = 'semantic' THEN last_value(CASE WHEN memory_type = 'episodic' THEN 'mem_' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS promoted_from,
  CASE WHEN memory_type = 'semantic' THEN (k % 11) / 10.0::DOUBLE END AS confidence, CASE WHEN memory_type = 'procedural' THEN 'proc_' || (k % 5) END AS procedure_name,
  CASE WHEN memory_type = 'procedural' THEN CAST(row_number() OVER (PARTITION BY memory_type, k % 5 ORDER BY ts, event_id) AS INTEGER) END AS version, CASE WHEN memory_type = 'procedural' THEN lag('mem_' || event_id) OVER (PARTITION BY memory_type, k % 5 ORDER BY ts, event_id) END AS previous_version_id,
  ['u' || (user_id % 3), kind] AS tags, CASE WHEN event_id % 5 <> 0 THEN 'wf_' || (user_id % 4) END AS workflow_id, CASE WHEN event_id % 3 <> 0 THEN 'agent_' || (user_id % 6) END AS agent_id
FROM (SELECT *, event_type AS kind, {_KIND} AS memory_type FROM ev)""",
    ),
    "execs": (("ev",), "SELECT 'exec_' || event_id AS execution_id, 'auto_' || (user_id % 20) AS automation_id, ts AS started_at, ts + to_seconds(CAST(floor(value) AS BIGINT)) AS ended_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, k % 4 AS retry_count FROM ev"),
    "files": (("ev",), "SELECT event_id, '/inbox/' || user_id || (['.md', '.txt', '.pdf', '.exe', ''])[k % 5 + 1] AS path, ts, 'f' || (k % 3) AS fingerprint, CAST(k * 1000 AS BIGINT) AS size FROM ev"),
    "reqs": ((), r"SELECT item_id AS decision_id, text AS question, (['analytical', 'strategic', 'operational', 'creative', 'first_principles', 'weighted_scoring'])[item_id % 6 + 1] AS strategy, CASE WHEN item_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')[1:4] END AS option_hints, item_id % 7 <> 0 AS require_knowledge FROM benchmark"),
    "evid": ((), "SELECT decision_id, rank, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((decision_id * 3 + rank) % 12) / 10.0::DOUBLE)) AS relevance FROM (SELECT item_id AS decision_id, unnest(range(1, item_id % 4 + 2)) AS rank FROM benchmark WHERE item_id % 7 <> 0 AND item_id % 5 <> 0)"),
    "routes": ((), "SELECT item_id AS request_id, CASE item_id % 7 WHEN 0 THEN [] WHEN 1 THEN ['latency'] WHEN 2 THEN ['cost', 'coding'] WHEN 3 THEN ['reasoning'] WHEN 4 THEN ['local'] WHEN 5 THEN ['quality', 'latency'] ELSE ['coding', 'reasoning', 'cost'] END AS priorities, CASE WHEN item_id % 4 = 0 THEN 100000 WHEN item_id % 11 = 0 THEN 5000000 ELSE 0 END AS min_context, item_id % 3 = 0 AS structured, item_id % 5 = 0 AS multimodal, CASE WHEN item_id % 13 = 0 THEN 'custom' END AS override_provider FROM benchmark"),
    "postings": (("chunks_old",), f"SELECT term, chunk_id, doc_id, count(*) AS tf FROM (SELECT chunk_id, doc_id, unnest({_TOK.format("title || ' content ' || embed_text")}) AS term FROM chunks_old WHERE chunk_level = 'child') GROUP BY ALL"),
    "stats": (("postings",), "SELECT chunk_id, CAST(sum(tf) AS BIGINT) AS dl FROM postings GROUP BY chunk_id"),
    "corpus": (("stats",), "SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM stats"),
    "rawidf": (("postings", "corpus"), "SELECT term, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM postings GROUP BY term"),
    "terms": (("rawidf",), "SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf"),
    "qterms": ((), f"SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL"),
    "kwscore": (
        ("postings", "stats", "corpus", "terms", "qterms"),
        "SELECT q.query_id, p.chunk_id, p.doc_id, round(sum(q.qtf * t.idf * (p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * s.dl / c.avgdl)))), 9) AS score FROM qterms q JOIN postings p ON q.term = p.term JOIN terms t ON t.term = q.term JOIN stats s ON s.chunk_id = p.chunk_id CROSS JOIN corpus c GROUP BY ALL",
    ),
    "kw": (("kwscore",), "SELECT query_id, chunk_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kwscore) WHERE rank <= 20 AND score > 0"),
}
#: Sections of the chat documents: a heading line "## role", an empty line, the text; two line feeds between turns.
CTE["outline"] = (
    (),
    """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS section_index, role, text, head + length(role) + 3 AS start_offset, head + size AS end_offset FROM (
  SELECT *, length(role) + length(text) + 5 + CASE WHEN turn < last THEN 2 ELSE 0 END AS size, coalesce(sum(length(role) + length(text) + 7) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head
  FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)) WHERE text <> ''""",
)
CTE["chat_parents"] = (
    ("outline",),
    f"""SELECT *, 'chk_' || substr(sha256(doc_id || '|' || role || '|sha256:' || sha256({_STRIP.format('embed_text')}) || '|' || chunk_index || '|parent'), 1, 20) AS chunk_id FROM (
  SELECT *, 'Document: chat > ' || role || chr(10) || chr(10) || body_text AS embed_text, regexp_extract_all(body_text, '\\S+') AS ws, row_number() OVER (PARTITION BY doc_id ORDER BY section_index, p) - 1 AS chunk_index FROM (
    SELECT CAST(conv_id AS VARCHAR) AS doc_id, section_index, role, start_offset, end_offset, unnest(parts) AS body_text, unnest(range(len(parts))) AS p FROM (SELECT *, {_win("text", "tw", 2048, 2048)} AS parts FROM (SELECT *, regexp_extract_all(text, '\\S+') AS tw FROM outline))))""",
)
CTE["chat_chunks"] = (
    ("chat_parents",),
    f"""SELECT chunk_id, doc_id, 'parent' AS chunk_level, CAST(NULL AS VARCHAR) AS parent_chunk_id, chunk_index, role AS heading_path, len(ws) AS token_count, embed_text, body_text, start_offset, end_offset FROM chat_parents
UNION ALL SELECT 'chk_' || substr(sha256(doc_id || '|' || role || '|sha256:' || sha256({_STRIP.format('embed_text')}) || '|' || chunk_index || '|child'), 1, 20), doc_id, 'child', up, chunk_index, role, len(regexp_extract_all(body_text, '\\S+')), embed_text, body_text, start_offset, end_offset FROM (
  SELECT *, 'Document: chat > ' || role || chr(10) || chr(10) || body_text AS embed_text, row_number() OVER (PARTITION BY doc_id ORDER BY p, c) - 1 AS chunk_index FROM (
    SELECT doc_id, role, start_offset, end_offset, chunk_id AS up, chunk_index AS p, unnest(kids) AS body_text, unnest(range(len(kids))) AS c, len(kids) AS many FROM (SELECT *, {_win("body_text", "ws", 512, 448)} AS kids FROM chat_parents)) WHERE many = 1 OR len(regexp_extract_all(body_text, '\\S+')) >= 32)""",
)
#: Titles and texts of the pages at hand: an article of headings, paragraphs and breaks.
_ART = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_BLOCKS = f"regexp_replace(regexp_replace(regexp_replace({_ART}, '\\s+', ' ', 'g'), '<h1[^>]*>', chr(10) || chr(10) || '# ', 'g'), '</?(p|br|h1)[^>]*>', chr(10) || chr(10), 'g')"
_PLAIN = "replace(replace(replace({0}, '&quot;', '\"'), '&amp;', '&'), '&amp', '&')"
CTE["page_texts"] = (
    (),
    f"""SELECT *, CASE WHEN body = '' THEN 'failed' WHEN length(body) <= 50 THEN 'degraded' ELSE 'full' END AS quality FROM (SELECT page_id, {_PLAIN.format("trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))")} AS title, {_STRIP.format(f"regexp_replace({_PLAIN.format(f"regexp_replace({_BLOCKS}, '</?[a-z][^>]*>', '', 'g')")}, '\\s*' || chr(10) || '\\s*' || chr(10) || '\\s*', chr(10) || chr(10), 'g')")} AS body FROM pages)""",
)
for _v in ("old", "new"):
    CTE[f"sources_{_v}"] = ((), _sources(_v))
    CTE[f"docs_{_v}"] = ((f"sources_{_v}",), _docs(_v))
    CTE[f"parents_{_v}"] = ((f"docs_{_v}",), _parents(_v))
    CTE[f"chunks_{_v}"] = ((f"parents_{_v}",), _chunks(_v))


#: CTEs that are read several times and cost much.
_STORED = {"chunks_old", "chunks_new", "docs_old", "docs_new", "postings", "stats", "rawidf", "terms", "kwscore", "cvec", "qvec", "mem", "issues"}


def with_ctes(needs: str, sql: str, swap: dict[str, str] | None = None) -> str:
    """sql with the CTEs it needs (space-separated names) and theirs; swap names other definitions for some."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            below, text = CTE[(swap or {}).get(name, name)]
            for b in below:
                add(b)
            done[name] = text

    for n in needs.split():
        add(n)
    return ("WITH " + ",\n".join(f"{k} AS {'MATERIALIZED ' if k in _STORED else ''}({v})" for k, v in done.items()) + "\n" if done else "") + sql
