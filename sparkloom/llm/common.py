"""What the training-data operators share: tables, stored intermediates, components."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else, as the contracts ask."""
    return F.translate(col, UPPER, LOWER)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with the session's Arrow batches cut to so many rows: whole texts at the usual 10,000 a batch take too much memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The session's folder under the one all executors share, spark.checkpoint.dir.

    Only on a local master a temporary folder stands in where that is unset; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/sparkloom-{spark.sparkContext.applicationId}"


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*frames: DataFrame, spark: SparkSession) -> None:
    """Delete what stored() wrote for these frames, which nothing reads any more, and let Spark clear shuffle files of jobs that are done."""
    for df in frames:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark.range(1).count()  # the last job's plan is held until the next one runs
    spark._jvm.System.gc()  # shuffle files go when their plan is collected, which else may be long after


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component = the smallest node reachable.

    Every node first goes to its smallest neighbour and the edges are drawn anew between these: dense groups
    shrink to a few edges at once, and the edges themselves are joined only this one time. What is left goes
    through min-label rounds. Joined tables are stored, so both sides are plain exchanges that adaptive execution
    can split when a hub holds many edges. Null ends are ignored.
    """
    good = stored(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), tag)
    ends = good.union(good.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), tag)
    up = lambda name: least.select(F.col("node").alias(f"{name}_node"), F.col("to").alias(f"{name}_to"))
    drawn = good.join(up("x"), F.col("a") == F.col("x_node")).join(up("y"), F.col("b") == F.col("y_node"))
    drawn = stored(drawn.filter("x_to <> y_to").select(F.least("x_to", "y_to").alias("a"), F.greatest("x_to", "y_to").alias("b")).distinct(), tag)
    # A node's smallest neighbour may have one of its own.
    chain = least.join(up("x"), F.col("to") == F.col("x_node")).filter("to <> x_to").select(F.col("x_to").alias("a"), F.col("to").alias("b")).distinct()
    rest = stored(drawn.union(chain), tag)
    if rest.isEmpty():
        return least.select("node", F.col("to").alias("component"))
    roots = _min_labels(rest, tag).select(F.col("node").alias("r"), F.col("component").alias("c"))
    return stored(least.join(roots, F.col("to") == F.col("r"), "left").select("node", F.coalesce("c", "to").alias("component")), tag)


def _min_labels(edges: DataFrame, tag: str) -> DataFrame:
    """The components by min-label steps with pointer jumping: rounds grow with the logarithm of the longest chain."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), tag)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), tag)
    while True:
        told = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "component")
        near = stored(told.union(labels).groupBy("node").agg(F.min("component").alias("component")), tag)
        root = near.select(F.col("node").alias("r"), F.col("component").alias("c2"))
        hop = stored(near.join(root, near.component == root.r).select("node", F.col("c2").alias("component")), tag)
        old = labels.select("node", F.col("component").alias("was"))
        moved = hop.join(old, "node").filter("component <> was").limit(1).count()
        labels = hop
        if not moved:
            return labels
