"""Readers and writers: file trees, JSON lines, chat exports, index artifacts."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Ids here are hex digits, which a codec without entropy coding leaves at twice their content.
PACKED = "zstd"
SUFFIXES = ("md", "markdown", "txt", "pdf", "docx", "html", "htm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt over all cores where its files give fewer partitions than that; large tables stay as they lie.

    For tables whose rows cost much (texts, pages): a small file is one partition and would be one core's work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with the session's Arrow batches cut to so many rows at most: a worker holds a batch of whole texts at once."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def scratch_root(spark: SparkSession) -> str:
    """The session's folder under the one that spark.checkpoint.dir names (shared by all executors).

    Only on a local master a temporary folder stands in where it is unset; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/sparkloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all the session stored between steps; results not yet written cannot be read after that."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on any file system Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what materialized or scratch has left under path and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_counted: WeakKeyDictionary[DataFrame, dict[int, bool]] = WeakKeyDictionary()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows; else as it is, to be joined by shuffle. A frame is counted once."""
    known = _counted.setdefault(df, {})
    if rows not in known:
        known[rows] = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if known[rows] else df


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back.

    Tables that several steps read, like chunks and postings, are built once this way; a lost executor loses nothing.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_files(spark: SparkSession, path: str, suffixes=SUFFIXES, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """uri, content, byte_size, modified, format, fingerprint of the supported files under path; content is null above max_bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    rows = files.filter(suffix.isin(*suffixes)).select(F.col("path").alias("uri"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"))
    return rows.withColumns({"format": tx.detect_format(F.col("uri"), F.col("content")), "fingerprint": tx.fingerprint(F.col("content"))})


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a known schema, one a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_postings(spark: SparkSession, path: str, terms: DataFrame | list[str], buckets: int = 16) -> DataFrame:
    """The postings of some terms (a list, or a table with term) from an index that write_index wrote: other buckets are pruned.

    Of a table only the numbers of its buckets come to the driver; its terms are joined.
    """
    listed = not isinstance(terms, DataFrame)
    wanted = spark.createDataFrame([(t,) for t in terms], "term string") if listed else terms.select("term").distinct()
    numbers = [r.b for r in wanted.select(bucket_of("term", buckets).alias("b")).distinct().collect()]
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(numbers)).drop("bucket")
    return rows.filter(F.col("term").isin(list(terms))) if listed else rows.join(small(wanted), "term", "left_semi")


def chats_to_documents(messages: DataFrame) -> DataFrame:
    """One Markdown document a conversation of messages (conv_id, turn, role, text[, author]): a section a turn, in order."""
    named = [F.col(c) for c in ("role", "author") if c in messages.columns]
    role = F.coalesce(*[F.nullif(c, F.lit("")) for c in named], F.lit("unknown"))
    text = F.col("text")
    if dict(messages.dtypes)["text"].startswith("array"):
        text = F.array_join("text", "\n")
    turn = F.struct("turn", F.concat(F.lit("## "), role, F.lit("\n\n"), F.coalesce(text, F.lit(""))).alias("block"))
    # A message without a conversation is one of its own.
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = messages.select("conv_id", own.alias("own"), turn.alias("t")).groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return turns.select("conv_id", F.array_join(F.transform("ts", lambda t: t.block), "\n\n").alias("text"), F.size("ts").alias("n_turns"))


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_index(path: str, buckets: int = 16, **tables: DataFrame) -> None:
    """Parquet tables under path, in buckets of term (postings, term statistics) or doc_id where they have one; only the buckets written are replaced.

    A bucket of term is sorted by term, so a search reads the buckets of its terms only, and in them only their row groups.
    """
    for name, df in tables.items():
        out = df
        key = next((c for c in ("term", "doc_id") if c in df.columns), None)
        if key:
            out = df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").sortWithinPartitions("bucket", key)
            out.write.mode("overwrite").option("compression", PACKED).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            out.write.mode("overwrite").option("compression", PACKED).parquet(f"{path}/{name}")
