"""Exact vector search that leaves blocks of vectors out before anything of them is shuffled.

Vectors of length one lie on a sphere, where a cosine is a distance and distances obey the triangle inequality. Vectors are put
into the cell of their nearest pivot and cut into blocks: rings around the pivot, of at most so many rows. A block is known by
its pivot and its least and largest distance from it, so a query's distance to the pivot bounds its distance to the whole block.
A query first meets the nearest blocks that hold k rows; their k-th distance is a bound for its results, and after that it meets
only blocks that come closer. Pivots are a bounded sample of the vectors: they decide how much is left out, never what is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialized
from .retrieval import LEG, QUERY_BLOCK, _best, top_k

#: Most and fewest pivots; rows of a block; rings of a cell; squared distances closer than this count as equal (scores have nine digits).
PIVOTS, FEWEST, ROWS, RINGS, SLACK = 256, 16, 4096, 64, 1e-8


@dataclass
class PivotIndex:
    """placed (chunk_id, vector, block); pivots, one a row; and of every block its pivot's number, rows, least and largest distance."""

    placed: DataFrame
    pivots: np.ndarray
    cell: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray


@dataclass
class PivotSearch:
    """The hits, the pairs of a query and a block that met (query_id, block), and how many pairs there are."""

    hits: DataFrame
    met: DataFrame
    pairs: int


def _unit(column: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have that length, no null or non-finite number and are not zero; and these at length one."""
    ok, rows = np.zeros(len(column), bool), []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dims and None not in v:
            x = np.array(v, np.float64)
            n = np.linalg.norm(x)
            if 0 < n < np.inf:
                ok[i] = True
                rows.append(x / n)
    return ok, np.array(rows).reshape(-1, dims)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))


def build_pivots(vectors: DataFrame, dims: int, rows: int = ROWS, pivots: int = PIVOTS) -> PivotIndex:
    """The index of vectors (chunk_id, vector): rows with another length, a null, a number that is not finite, or all zeros are left out."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["chunk_id"]
    usable = vectors.filter(F.size("vector") == dims).select("chunk_id", "vector")
    wanted = min(pivots, max(FEWEST, -(-2 * usable.count() // rows)))
    sample = pa.array([r.vector for r in usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).collect()], pa.list_(pa.float64()))
    centres = _unit(sample, dims)[1]
    if not len(centres):
        centres = np.eye(1, dims)

    def place(batches):
        for b in batches:
            ok, x = _unit(b.column("vector"), dims)
            d = _distances(x, centres)
            cell = d.argmin(axis=1)
            values = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dims, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id").filter(pa.array(ok)), values, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])], names=["chunk_id", "vector", "cell", "dist"])

    near = materialized(usable.mapInArrow(place, f"chunk_id {kind}, vector array<double>, cell int, dist double"), "placed")
    steps = [i / RINGS for i in range(1, RINGS)]
    cells = {r.cell: r for r in near.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("dist", steps, 10_000).alias("d")).collect()}  # a row a pivot
    edges, parts, base, first = {}, {}, {}, 0
    for c, r in sorted(cells.items()):
        rings = min(RINGS, -(-r.n // rows))
        edges[c] = np.array([r.d[i * RINGS // rings - 1] for i in range(1, rings)])
        parts[c] = -(-r.n // (rings * rows))  # a cell with more rows than that has several blocks in each ring
        base[c], first = first, first + rings * parts[c]

    def number(batches):
        for b in batches:
            cell, dist, h = (b.column(c).to_numpy() for c in ("cell", "dist", "h"))
            block = [base[c] + int(np.searchsorted(edges[c], d, "right")) * parts[c] + int(x) % parts[c] for c, d, x in zip(cell.tolist(), dist.tolist(), h.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("chunk_id", "vector", "cell", "dist")], pa.array(block, pa.int32())], names=["chunk_id", "vector", "cell", "dist", "block"])

    placed = near.withColumn("h", F.xxhash64("chunk_id")).mapInArrow(number, f"chunk_id {kind}, vector array<double>, cell int, dist double, block int")
    placed = materialized(placed, "blocks")
    known = sorted(map(tuple, placed.groupBy("block").agg(F.first("cell"), F.count("*"), F.min("dist"), F.max("dist")).collect()))  # a row a block, 1/rows of the vectors
    cell, n, least, most = (np.array([k[i] for k in known]) for i in range(1, 5))
    order = spark.createDataFrame([(int(k[0]), i) for i, k in enumerate(known)], "was int, block int")
    return PivotIndex(placed.withColumnRenamed("block", "was").join(F.broadcast(order), "was").select("chunk_id", "vector", "block"), centres, cell.astype(int), n, least, most)


def _meet(asked: DataFrame, index: PivotIndex, k: int, kinds: tuple[str, str]) -> DataFrame:
    """The k best rows of every asked (query_id, block, vector) pair's block; a block with many queries meets them in parts."""
    asked = materialized(asked, "asked")
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(float(QUERY_BLOCK))).cast("int").alias("parts"))
    parts = materialized(parts, "parts")
    a = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    b = index.placed.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = a.select("query_id", "vector", "block", "part").groupBy("block", "part").cogroup(b.select("chunk_id", "vector", "block", "part").groupBy("block", "part"))
    return both.applyInPandas(lambda x, y: _best(x, y, k), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def pivot_search(queries: DataFrame, index: PivotIndex, k: int = LEG) -> PivotSearch:
    """query_id, chunk_id, score, rank: exact cosine top k, as vector_search gives it, for queries (query_id, vector) of the index's length.

    The blocks' figures (five numbers for as many rows as a block has) go to all tasks; vectors travel only to the queries that
    come near their block. Repeated query ids are one query's rows, as they are there.
    """
    dims, kind = index.pivots.shape[1], dict(queries.dtypes)["query_id"]
    kinds = (kind, dict(index.placed.dtypes)["chunk_id"])
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((index.pivots, index.cell, index.rows, index.least, index.most))

    def asks(first: bool):
        def run(batches):
            pivots, cell, rows, least, most = shared.value
            for b in batches:
                ok, x = _unit(b.column("vector"), dims)
                ids, kth = b.column("query_id").filter(pa.array(ok)), b.column("kth").to_numpy(zero_copy_only=False)[ok]
                d = _distances(x, pivots)[:, cell]
                nearest = np.maximum(0, np.maximum(d - most, least - d))
                # The first blocks of a query: those its distance to which is least, until they hold k rows.
                order = np.lexsort((np.broadcast_to(np.arange(len(cell)), d.shape), d, nearest), axis=1) if len(cell) else d.astype(int)
                held = np.cumsum(rows[order], axis=1) if len(cell) else d
                met = np.zeros(d.shape, bool)
                np.put_along_axis(met, order, (held - rows[order] < k) if len(cell) else met, axis=1)
                if not first:
                    met = ~met & (nearest**2 <= kth[:, None] + SLACK)
                q, block = np.nonzero(met)
                values = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * dims, pa.array(x[q].ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(block, pa.int32()), values], names=["query_id", "block", "vector"])

        return run

    schema = f"query_id {kind}, block int, vector array<double>"
    q = queries.select("query_id", "vector").filter(F.size("vector") == dims)
    start = materialized(q.withColumn("kth", F.lit(4.0)).mapInArrow(asks(True), schema), "first")
    found = materialized(_meet(start, index, k, kinds), "found")
    best = top_k(found, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)
    # A cosine is 1 - d²/2; a query with fewer than k rows so far has no bound.
    kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, 2 - 2 * F.min("score")).alias("kth")).withColumnRenamed("query_id", "of")
    bound = q.join(kth, F.col("query_id") == F.col("of"), "left").select("query_id", "vector", F.coalesce("kth", F.lit(4.0)).alias("kth"))
    more = materialized(bound.mapInArrow(asks(False), schema), "more")
    hits = top_k(found.union(_meet(more, index, k, kinds)), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)
    met = start.select("query_id", "block").union(more.select("query_id", "block"))
    return PivotSearch(hits, met, queries.count() * len(index.cell))
