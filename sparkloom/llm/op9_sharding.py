"""Sharding by a k-d tree of distributed weighted medians (DataFrame functions only).

Rows are points in metadata space: text size, source and language (by rank of their bytes) and place in the id order,
each scaled to 4096 steps. A node that must feed k shards is split along its widest dimension (largest byte-weighted
standard deviation) where floor(k/2)/k of its bytes lie below, until every leaf feeds one shard. The law
is ``bytes``: sizes are near equal.

A split point is found by histograms: 4096 bins on the dimension, then 4096 and 4096 more on a hash of
the text inside the cut bin. Only the histograms (at most ``shards * 4096`` rows each, a bound that does
not depend on the data) reach the driver; all the nodes of a level share a job. Equal texts share the
metadata of their first row and one hash, so they stay in one shard, unless a group has more than a
thirty-second of a shard's bytes: then its rows are dealt into parts of about that size, each row by a number of its own.

Defined results: a null text has no bytes (size 16) and equals the empty text in its crc32; null source,
language or doc_id count as a value of their own. Repeated rows are rows. With fewer rows than shards some
shards stay empty. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, table

STEPS, SHARDS, OVERHEAD, PARTS, SLOT_ROWS = 4096, 40, 16, 32, 100_000
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_place")


def _ranks(rows: DataFrame, column: str) -> DataFrame:
    """value, step: a category's place among the categories by falling bytes, scaled to STEPS; all beyond the first STEPS - 1 share the last step.

    At most STEPS - 1 rows, so it is broadcast. Values that share a step are told apart by the hash inside it.
    """
    most = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("\0")).alias("value")).agg(F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "value").limit(STEPS - 1).collect()
    scale = (STEPS - 1) / max(1, len(most))
    return rows.sparkSession.createDataFrame([(r.value, int(i * scale)) for i, r in enumerate(most)], f"{column}_value string, d_{column} int")


def _points(docs: DataFrame, shards: int) -> DataFrame:
    """Per row doc_id, size, text_crc32, the dimensions, and u: 24 hash bits of the unit it moves with."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.monotonically_increasing_id().alias("r"))
    rows = stored(rows, "op9-rows")
    groups = rows.groupBy("h1", "h2", "size").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "source", "lang")).alias("one"))
    groups = stored(groups, "op9-groups")
    sums = groups.agg(F.sum(F.col("size") * F.col("copies")), F.min("one.doc_id"), F.max("one.doc_id"), F.max("size")).first()
    part = max(1.0, (sums[0] or 0) / shards / PARTS)
    low, span = sums[1] or 0, max(1, (sums[2] or 0) - (sums[1] or 0))
    top = max(2.0, float(sums[3] or 2))
    whole = rows.join(groups.withColumnsRenamed({"h1": "g1", "h2": "g2", "size": "gs"}), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("size") == F.col("gs")))
    parts = F.ceil(F.col("size") * F.col("copies") / F.lit(part))
    salt = F.when((F.col("copies") > 1) & (parts > 1), F.pmod(F.xxhash64("r"), parts)).otherwise(F.lit(0))
    place = F.coalesce(F.floor((F.col("one.doc_id") - F.lit(low)) * F.lit(float(STEPS - 1)) / F.lit(float(span))), F.lit(0))
    for c in ("source", "lang"):
        whole = whole.withColumn(f"of_{c}", F.coalesce(F.col(f"one.{c}").cast("string"), F.lit("\0")))
        whole = whole.join(F.broadcast(_ranks(rows, c)), F.col(f"of_{c}") == F.col(f"{c}_value"), "left").withColumn(f"d_{c}", F.coalesce(f"d_{c}", F.lit(STEPS - 1)))
    return whole.select(
        "doc_id", "size", "text_crc32", "r", "d_source", "d_lang",
        F.floor(F.log(F.col("size").cast("double")) * F.lit(float(STEPS - 1)) / F.log(F.lit(top))).cast("int").alias("d_size"),
        place.cast("int").alias("d_place"),
        F.shiftrightunsigned(F.xxhash64("h1", "h2", salt), 40).cast("int").alias("u"),
    )


def _cut(bins: list[tuple[int, int]], want: float) -> tuple[int, float]:
    """The bin in which the running weight passes want, and what is still wanted inside it."""
    done = 0.0
    for b, w in bins:
        if done + w >= want:
            return b, want - done
        done += w
    return bins[-1][0], float(bins[-1][1])


def _per_node(live: list, of: dict) -> Column:
    """For a row the column of its node; null for other nodes."""
    return F.coalesce(*[F.when(F.col("node") == n[0], of[n]) for n in live])


def _histogram(points: DataFrame, live: list, value: dict, keep: dict | None = None) -> dict:
    """Bytes per value for each live node, from the rows where keep holds: at most STEPS entries a node."""
    rows = points.filter(_per_node(live, keep) if keep else F.col("node").isin([n[0] for n in live]))
    out = defaultdict(list)
    for r in rows.groupBy("node", _per_node(live, value).cast("long").alias("bin")).agg(F.sum("size").alias("w")).orderBy("node", "bin").collect():
        out[r.node].append((r.bin, r.w))
    return out


def place_in_tree(points: DataFrame, shards: int) -> DataFrame:
    """points with node, the shard of each row. A node is (first shard, number of shards); rows hold the first."""
    points = stored(points.withColumn("node", F.lit(0)), "op9-points")
    level = [(0, shards)]
    while level := [n for n in level if n[1] > 1]:
        w = F.col("size").cast("double")
        moments = [x for d in DIMENSIONS for x in (F.sum(w * F.col(d)).alias(f"{d}_1"), F.sum(w * F.col(d) * F.col(d)).alias(f"{d}_2"))]
        stats = {r.node: r for r in points.groupBy("node").agg(F.sum(w).alias("w"), *moments).collect()}
        live = [n for n in level if n[0] in stats]
        if not live:
            break
        widest, want = {}, {}
        for n in live:
            r = stats[n[0]]
            spread = {d: r[f"{d}_2"] / r.w - (r[f"{d}_1"] / r.w) ** 2 for d in DIMENSIONS}
            widest[n] = max(DIMENSIONS, key=lambda d: (round(spread[d], 6), d))
            want[n] = r.w * (n[1] // 2) / n[1]
        high, low = F.shiftright("u", 12), F.col("u").bitwiseAND(STEPS - 1)
        bins = _histogram(points, live, {n: F.col(widest[n]) for n in live})
        cut = {n: _cut(bins[n[0]], want[n]) for n in live}
        at = {n: F.col(widest[n]) == cut[n][0] for n in live}
        bins = _histogram(points, live, dict.fromkeys(live, high), at)
        mid = {n: _cut(bins[n[0]], cut[n][1]) for n in live}
        bins = _histogram(points, live, dict.fromkeys(live, low), {n: at[n] & (high == mid[n][0]) for n in live})
        following, to = [], {}
        for n in live:
            last, rest = _cut(bins[n[0]], mid[n][1])
            weight = dict(bins[n[0]])[last]
            u = mid[n][0] * STEPS + last - (rest < weight / 2)  # the border nearer to the wanted weight
            left, right = (n[0], n[1] // 2), (n[0] + n[1] // 2, n[1] - n[1] // 2)
            below = (F.col(widest[n]) < cut[n][0]) | (at[n] & (F.col("u") <= u))
            to[n] = F.when(below, F.lit(left[0])).otherwise(F.lit(right[0]))
            following += [left, right]
        points = stored(points.withColumn("node", F.coalesce(_per_node(live, to), F.col("node"))), "op9-points")
        level = following
    return points


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text, source, lang)."""
    placed = place_in_tree(_points(docs, shards), shards).select("doc_id", "size", "text_crc32", "r", F.col("node").cast("int").alias("shard"))
    runs = max(1, placed.count() // (shards * SLOT_ROWS))
    placed = stored(placed.withColumn("run", F.pmod(F.xxhash64("r"), F.lit(max(8, runs)))), "op9-placed")
    first = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    first = stored(first.select("shard", "run", (F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")).alias("before")), "op9-slots")
    order = W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size", "r")
    return placed.join(first, ["shard", "run"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.row_number().over(order) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark, sf_dir) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
