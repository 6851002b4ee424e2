"""Inbox ingest, change detection, debouncing, sessions and triggers; batch frames pass through the same code."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from ..functions import documents as dx
from ..functions import text as tx
from ..operators import automation
from ..sources.tables import SUFFIXES, discard, scratch, there


def _session(events: DataFrame, key: str, gap_seconds: float, watermark: str | None) -> tuple[DataFrame, object]:
    """Sessions end at the gap: an event exactly one gap later opens a new one, so the window is a microsecond shorter."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows, F.session_window("ts", f"{gap_seconds - 1e-6:.6f} seconds")


def debounce(events: DataFrame, gap_seconds: float = 2, watermark: str | None = None) -> DataFrame:
    """path, first, last, n, fingerprint: bursts of events (path, ts, fingerprint) on a path, with the last fingerprint."""
    rows, window = _session(events, "path", gap_seconds, watermark)
    grouped = rows.groupBy("path", window).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.max_by("fingerprint", F.struct("ts", "event_id")).alias("fingerprint"))
    return grouped.select("path", "first", "last", "n", "fingerprint")


def working_sessions(events: DataFrame, ttl_seconds: float = 3600, watermark: str | None = None) -> DataFrame:
    """task_id, opened_at, expires_at, syncs: each sync (task_id, ts) pushes the expiry; one at or after it opens a new record."""
    rows, window = _session(events, "task_id", ttl_seconds, watermark)
    grouped = rows.groupBy("task_id", window).agg(F.min("ts").alias("opened_at"), F.max("ts").alias("last"), F.count("*").alias("syncs"))
    return grouped.select("task_id", "opened_at", (F.col("last") + F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))).alias("expires_at"), "syncs")


def changes(events: DataFrame) -> DataFrame:
    """Batch twin of stream_changes: event_id, uri and new, changed or unchanged against the event before."""
    before = F.lag("fingerprint").over(W.partitionBy("uri").orderBy("ts", "event_id"))
    return events.withColumn("was", before).select("event_id", "uri", F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("fingerprint"), "changed").otherwise("unchanged").alias("change"))


def stream_changes(stream: DataFrame) -> DataFrame:
    """The same over a stream (event_id, uri, fingerprint, ts): state is the last fingerprint of each uri."""

    def step(key, batches, state):
        was = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event, fp in zip(rows["event_id"], rows["fingerprint"], strict=True):
            out.append((event, key[0], "new" if was is None else "changed" if fp != was else "unchanged"))
            was = fp
        state.update((was,))
        yield pd.DataFrame(out, columns=["event_id", "uri", "change"])

    return stream.groupBy("uri").applyInPandasWithState(step, "event_id long, uri string, change string", "fingerprint string", "append", "NoTimeout")


def stream_triggers(completions: DataFrame, automations: DataFrame) -> DataFrame:
    """Triggers of a stream of finished workflows; the automations are a static table."""
    return automation.match_completions(completions, automations)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there now into Parquet files under path, and read them back. Run again, it goes on with what has come since."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def replay(events: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], cuts: list[str], tick: dict[str, str]) -> DataFrame:
    """The rows that build makes of a stream over events (with ts), as if they came in slices of time: one run for each cut (a time as text) and one for the rest.

    tick gives the columns of one last row as text (all others are null) that lies far enough ahead to let the watermark close what is
    open; build's own rows for it stay open and are never written. For backfills and tests.
    """
    spark, ts = events.sparkSession, F.col("ts")
    edges = [None, *cuts, None]
    slices = [events.filter((F.lit(True) if a is None else ts >= F.lit(a).cast("timestamp")) & (F.lit(True) if z is None else ts < F.lit(z).cast("timestamp"))) for a, z in itertools.pairwise(edges)]
    last = spark.range(1).select(*[F.lit(tick.get(c)).cast(kind).alias(c) for c, kind in events.dtypes])
    out = None
    for part in [*slices, last]:
        part.write.mode("append").parquet(f"{path}/in")
        out = run_to_table(build(spark.readStream.schema(events.schema).parquet(f"{path}/in")), f"{path}/out")
    return out


BUILT_IN = ("txt", "markdown", "html")


def ingest_batch(files: DataFrame, extractors: dict[str, dx.Extractor] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and errors of a batch of files (uri, content, format, fingerprint, modified).

    extractors (format: function, as register_extractor takes them; by default the registered ones) go before the built-in formats.
    """
    plugged = dx.registered() if extractors is None else extractors
    text = F.decode("content", "UTF-8")
    stem = F.regexp_extract("uri", r"([^/]*?)(\.[^./]*)?$", 1)
    own = ["uri", "format", "fingerprint", "modified"]
    base = files.filter(~F.col("format").isin(list(plugged))).select(*own, text.alias("text"), stem.alias("stem"))
    plain = dx.extract_text(base.filter("format = 'txt'"), F.col("stem")).select(*own, "title", "body")
    marked = dx.extract_markdown(base.filter("format = 'markdown'"), F.col("stem")).select(*own, "title", "body")
    html = base.filter("format = 'html'").mapInPandas(_pages, "uri string, format string, fingerprint string, modified timestamp, title string, body string")
    docs = plain.unionByName(marked).unionByName(html)
    if plugged:
        got = dx.extract_registered(files, plugged).select("uri", "title", "body")
        docs = docs.unionByName(files.select(*own, stem.alias("stem")).join(got, "uri").select(*own, F.coalesce("title", "stem").alias("title"), "body"))
    docs = docs.withColumn("quality", tx.extraction_quality(F.col("body"), F.col("format")))
    done = docs.filter("quality <> 'failed'").select(tx.doc_id(F.col("uri")).alias("doc_id"), F.col("uri").alias("source_id"), "title", tx.normalize_body(F.col("body")).alias("body"), "format", "fingerprint", "modified")
    unknown = files.filter(~F.col("format").isin([*BUILT_IN, *plugged])).select("uri", F.lit("NO_EXTRACTOR").alias("code"))
    return done, docs.filter("quality = 'failed'").select("uri", F.lit("EXTRACTION_FAILED").alias("code")).unionByName(unknown)


def _pages(batches):
    for b in batches:
        got = [dx.html_to_markdown(t) for t in b["text"]]
        yield pd.DataFrame({"uri": b["uri"], "format": b["format"], "fingerprint": b["fingerprint"], "modified": b["modified"], "title": [t or s for (t, _), s in zip(got, b["stem"], strict=True)], "body": [x for _, x in got]})


_FILE = "uri string, content binary, format string, fingerprint string, modified timestamp"


def _moved(key, batches, state):
    """The newest file of a uri if its content is not that of the state, which then is its fingerprint. Files without content only tell the state."""
    rows = pd.concat(list(batches)).sort_values("modified", kind="stable")
    told, files = rows[rows["content"].isna()], rows[rows["content"].notna()]
    was = state.get[0] if state.exists else (told["fingerprint"].iloc[-1] if len(told) else None)
    out = files.iloc[-1:]
    if len(out) and out["fingerprint"].iloc[0] == was:
        out = out.iloc[:0]
    now = out["fingerprint"].iloc[0] if len(out) else was
    if now is not None:
        state.update((now,))
    yield out[["uri", "content", "format", "fingerprint", "modified"]]


def _known_files(spark: SparkSession, sink: str, checkpoint: str) -> DataFrame:
    """A stream of what the sink held when this checkpoint began: uri, fingerprint, modified of each document's newest file, without content."""
    at = f"{checkpoint.rstrip('/')}-known"
    if not there(spark, f"{at}/_SUCCESS"):
        docs = _inbox_table(spark, sink, "documents")
        empty = spark.createDataFrame([], _FILE).select("uri", "fingerprint", "modified")
        known = empty if docs is None else docs.groupBy(F.col("source_id").alias("uri")).agg(F.max_by("fingerprint", F.struct("modified", "batch")).alias("fingerprint"), F.max("modified").alias("modified"))
        known.write.mode("overwrite").parquet(at)
    return spark.readStream.schema("uri string, fingerprint string, modified timestamp").parquet(at)


def stream_inbox(spark: SparkSession, folder: str, sink: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, extractors: dict[str, dx.Extractor] | None = None) -> StreamingQuery:
    """Ingest new and changed files of a folder into sink/documents, sink/chunks and sink/errors (read them by read_inbox).

    The last fingerprint of every uri is the stream's state, so a batch reads its own files and nothing of the history: a file whose
    content is that of its latest one is skipped. Only a new checkpoint over a sink that holds documents reads their fingerprints,
    once. A batch (of this checkpoint) writes its own partition of each table, documents last, and overwrites it if it runs again: a
    failure in between leaves nothing behind that a rerun does not replace. A changed file comes in as a later batch's rows;
    read_inbox gives each document as its newest file left it, so old chunks are retired. extractors as in ingest_batch.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    rows = files.filter(suffix.isin(*SUFFIXES)).select(F.col("path").alias("uri"), "content", tx.detect_format(F.col("path"), F.col("content")).alias("format"), tx.fingerprint(F.col("content")).alias("fingerprint"), F.col("modificationTime").alias("modified"))
    both = rows.unionByName(_known_files(spark, sink, checkpoint), allowMissingColumns=True)
    moved = both.groupBy("uri").applyInPandasWithState(_moved, _FILE, "fingerprint string", "append", "NoTimeout")
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def step(batch: DataFrame, batch_id: int) -> None:
        session, mine = batch.sparkSession, f"{run}-{batch_id}"
        kept = scratch(session, "inbox")
        batch.write.parquet(f"{kept}/files")  # the state is asked once; what follows reads its answer
        files = session.read.schema(_FILE).parquet(f"{kept}/files")
        docs, failed = ingest_batch(files, extractors)
        docs.write.parquet(f"{kept}/documents")
        docs = session.read.schema(docs.schema).parquet(f"{kept}/documents")
        for name, df in (("chunks", dx.chunk_documents(docs)), ("errors", failed), ("documents", docs)):
            df.write.mode("overwrite").parquet(f"{sink}/{name}/batch={mine}")
        if after:
            after(docs, batch_id)
        discard(session, kept)

    return moved.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _inbox_table(spark: SparkSession, sink: str, name: str) -> DataFrame | None:
    """All batches of a table of the sink, with the batch; None before the first batch."""
    try:
        return spark.read.parquet(f"{sink}/{name}").withColumn("batch", F.col("batch").cast("string"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_inbox(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents and chunks as the newest file of each document left them, and all errors."""
    docs, chunks, errors = (_inbox_table(spark, sink, name) for name in ("documents", "chunks", "errors"))
    latest = docs.groupBy("doc_id").agg(F.max_by("batch", F.struct("modified", "batch")).alias("batch"))
    current = lambda df: df.join(latest, ["doc_id", "batch"], "left_semi").drop("batch")
    return current(docs), current(chunks), errors.drop("batch")
