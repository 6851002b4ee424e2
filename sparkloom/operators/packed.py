"""A keyword index on disk in one version, in packets: it is written where the texts are cut, and a search reads the buckets of its terms.

A task gathers the postings of some chunks, one after the other, and writes them in a packet for each bucket of term, beside a
packet of the chunks' ids. Nothing is shuffled or stored on the way. The packets of the same chunks have the same first number,
so a search puts its terms' postings together by it, still packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import PACKED, bucket_of
from .retrieval import EPSILON, FORWARD, WEIGHTS, KeywordIndex, forward_of, listed
from .snapshots import DOCUMENTS, from_packet, numbered, packets, to_packet

_PACKETS = "bucket int, first long, packet binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for packet in b.column("packet"):
            got = from_packet(packet.as_py())
            yield pa.RecordBatch.from_arrays([got["terms"], got["sizes"].cast(pa.int64())], names=["term", "n"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for packet in b.column("packet"):
            got = from_packet(packet.as_py())
            yield pa.RecordBatch.from_arrays([got["chunk_id"], got["dl"].cast(pa.int64())], names=["chunk_id", "dl"])


def _stats(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_PACKETS).parquet(f"{path}/postings").filter(F.col("bucket") == DOCUMENTS)
    return rows.select("packet").mapInArrow(_documents, "chunk_id string, dl long")


def write_packed(chunks: DataFrame, path: str, buckets: int = 16) -> None:
    """Postings, and terms with their df, of chunks under path, in buckets of term."""
    spark = chunks.sparkSession
    packets(numbered(forward_of(chunks), 0), buckets, documents=True).write.mode("overwrite").option("compression", PACKED).partitionBy("bucket").parquet(f"{path}/postings")
    held = spark.read.schema(_PACKETS).parquet(f"{path}/postings").filter(F.col("bucket") != DOCUMENTS)
    df = held.select("packet").mapInArrow(_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    df.withColumn("bucket", bucket_of("term", buckets)).write.mode("overwrite").option("compression", PACKED).partitionBy("bucket").parquet(f"{path}/terms")


def _picked(batches: Iterator[pa.RecordBatch], terms: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """The packets, less what they hold of other terms."""
    for b in batches:
        for i, bucket in enumerate(b.column("bucket").to_pylist()):
            row = b.slice(i, 1)
            if bucket != DOCUMENTS and terms is not None:
                got = from_packet(row.column("packet")[0].as_py())
                wanted = pc.is_in(got["terms"], value_set=terms).to_numpy(zero_copy_only=False)
                if not wanted.any():
                    continue
                sizes = got["sizes"].to_numpy()
                of = pa.array(np.repeat(wanted, sizes))
                packet = to_packet(**got | {"terms": got["terms"].filter(pa.array(wanted)), "sizes": pa.array(sizes[wanted]), "at": got["at"].filter(of), "tf": got["tf"].filter(of)})
                row = pa.RecordBatch.from_arrays([row.column("bucket"), row.column("first"), pa.array([packet], pa.binary())], names=["bucket", "first", "packet"])
            yield row


def _rows(group: pa.Table) -> pa.Table:
    """The forward rows of the chunks of some packets, as far as these hold their terms."""
    names = [c.split()[0] for c in FORWARD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
    empty = pa.table([pa.array([], k) for k in kinds], names=names)
    held = [(bucket, from_packet(p.as_py())) for bucket, p in zip(group["bucket"].to_pylist(), group["packet"], strict=True)]
    documents, some = next(got for bucket, got in held if bucket == DOCUMENTS), [got for bucket, got in held if bucket != DOCUMENTS]
    if not some:
        return empty
    no = documents["no"].to_numpy()
    at = np.concatenate([np.searchsorted(no, got["no"].to_numpy()[got["at"].to_numpy()]) for got in some])
    terms = pa.concat_arrays([got["terms"].take(pa.array(np.repeat(np.arange(len(got["terms"])), got["sizes"].to_numpy()))) for got in some])
    tf = np.concatenate([got["tf"].to_numpy().astype(np.int64) for got in some])
    order = np.argsort(at, kind="stable")
    hit, sizes = np.unique(at, return_counts=True)
    edges, kept = pa.array(np.concatenate([[0], sizes.cumsum()]), pa.int32()), pa.array(hit)
    lists = [pa.ListArray.from_arrays(edges, terms.take(pa.array(order))), pa.ListArray.from_arrays(edges, pa.array(tf[order]))]
    return pa.table([documents["chunk_id"].take(kept), documents["doc_id"].take(kept), documents["dl"].cast(pa.int64()).take(kept), *lists], names=names)


def read_packed(spark: SparkSession, path: str, terms: DataFrame, buckets: int = 16) -> KeywordIndex:
    """What a search for some terms (term) needs of an index that write_packed wrote with so many buckets: other buckets are pruned."""
    wanted = terms.select("term").distinct()
    numbers = [r.b for r in wanted.select(bucket_of("term", buckets).alias("b")).distinct().collect()]  # no more than buckets
    few = wanted.limit(WEIGHTS + 1).toArrow()["term"].combine_chunks()
    shared = spark.sparkContext.broadcast(few if len(few) <= WEIGHTS else None)
    held = spark.read.schema(_PACKETS).parquet(f"{path}/postings").filter(F.col("bucket").isin([DOCUMENTS, *numbers]))
    picked = held.select("bucket", "first", "packet").mapInArrow(lambda batches: _picked(batches, shared.value), _PACKETS)
    forward = picked.groupBy("first").applyInArrow(_rows, FORWARD)
    stats, df = _stats(spark, path), spark.read.schema("term string, df long, bucket int").parquet(f"{path}/terms")
    raw = F.log(F.lit(stats.count()) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = F.lit(df.agg(F.avg(raw)).first()[0]).cast("double")
    known = df.filter(F.col("bucket").isin(numbers)).select("term", "df", F.when(raw < 0, F.lit(EPSILON) * mean).otherwise(raw).alias("idf"))
    return KeywordIndex(listed(forward), stats, known, forward)
