"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors become integers floor(256 x). A vector is cut into segments; with a segment's mean m, deviation s
and length L, the squared distance of two vectors is at least ``sum L ((m-m')**2 + (s-s')**2)``, and so
their inner product at most ``sum L (m m' + s s')``. The bounds are taken coarse to fine (few to many
segments); after each level the pairs that cannot reach the query's k-th best exact score leave, and the
survivors get their exact score.

Queries and candidates are dealt into blocks of bounded size and every query block meets every candidate
block once in a task of its own (a stated query set against all rows, in blocks); each meeting returns at
most k rows a query. Nothing is broadcast or collected.

Defined results: rows whose vec_id is null, whose vector is null, empty or holds null or non-finite
components, or one that is 2**62 or more when scaled, take no part. Scores beyond a long become its ends. Vectors of another dimension than the query's are no candidates. Of rows that
share a vec_id one is kept (the smallest packed vector). A query without candidates has no row. Ties go
to the smaller vec_id. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, table

QUERY_BLOCK, ROW_BLOCK, LEVELS, SCALE, MOST = 1024, 8192, (2, 8, 16), 256.0, 2.0**62
HITS = "query_id long, vec_id long, score long"


def pack(batches):
    """Arrow batches of (vec_id, embedding) to (vec_id, vec): the integers as little-endian 64-bit bytes."""
    for pdf in batches:
        keep, vecs = [], []
        for i, (vec_id, x) in enumerate(zip(pdf["vec_id"], pdf["embedding"], strict=True)):
            if vec_id is None or pd.isna(vec_id) or x is None or len(x) == 0:
                continue
            x = np.asarray(x, dtype=np.float64)
            if np.isfinite(x).all() and np.abs(SCALE * x).max() < MOST:
                keep.append(i)
                vecs.append(np.floor(SCALE * x).astype("<i8").tobytes())
        yield pd.DataFrame({"vec_id": pdf["vec_id"].iloc[keep].astype("int64").to_numpy(), "vec": pd.Series(vecs, dtype=object)})


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment sqrt(L) times mean and deviation; the dot product of two such rows is the bound."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        root = np.sqrt(part.shape[1])
        out += [root * part.mean(axis=1), root * part.std(axis=1)]
    return np.stack(out, axis=1)


def best_of_block(q_ids, q, r_ids, r, k: int) -> list[tuple[int, int, int]]:
    """The k best of rows r for each query of q: (query_id, vec_id, score)."""
    most = q.shape[1] * int(np.abs(q).max()) * int(np.abs(r).max())  # of a sum of products
    exact = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    q, r = q.astype(exact), r.astype(exact)
    order = np.argsort(r_ids, kind="stable")
    r_ids, r = r_ids[order], r[order]
    found = []
    levels = [(segment_features(q.astype(float), n), segment_features(r.astype(float), n)) for n in LEVELS]
    coarse = levels[0][0] @ levels[0][1].T
    for i, q_id in enumerate(q_ids):
        left = np.flatnonzero(r_ids != q_id)
        if not len(left):
            continue
        bound = coarse[i, left]
        if len(left) > k:
            tried = left[np.argpartition(-bound, k - 1)[:k]]
            floor = (r[tried] @ q[i]).min()
            slack = 1e-9 * max(1.0, abs(float(floor))) + 1e-6 * (1 + np.abs(q[i]).sum())
            left = left[bound >= floor - slack]
            for fine_q, fine_r in levels[1:]:
                bound = fine_r[left] @ fine_q[i]
                if len(left) > 4 * k:  # a better k-th score from the most promising rows
                    tried = left[np.argpartition(-bound, k - 1)[:k]]
                    floor = max(floor, (r[tried] @ q[i]).min())
                left = left[bound >= floor - slack]
        score = r[left] @ q[i]
        top = (np.lexsort((r_ids[left], -score)) if exact is not object else sorted(range(len(left)), key=lambda t: (-score[t], r_ids[left[t]])))[:k]
        found += [(int(q_id), int(r_ids[left][t]), min(2**63 - 1, max(-(2**63), int(score[t])))) for t in top]
    return found


def meet(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            dims = lambda p: p["vec"].map(len)
            for d in dims(queries).unique():
                a, b = queries[dims(queries) == d], rows[dims(rows) == d]
                if len(a) and len(b):
                    grid = lambda p: np.frombuffer(b"".join(p["vec"]), "<i8").reshape(len(p), -1)
                    found += best_of_block(a["vec_id"].to_numpy(), grid(a), b["vec_id"].to_numpy(), grid(b), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors (vec_id, embedding) for each row where is_query holds."""
    packed = vectors.select("vec_id", "embedding").mapInPandas(pack, "vec_id long, vec binary")
    packed = stored(packed.groupBy("vec_id").agg(F.min("vec").alias("vec")), "op1-vectors")
    n, n_q = packed.agg(F.count("*"), F.count_if(is_query)).first()
    rows, blocks = max(1, -(-n // row_block)), max(1, -(-n_q // query_block))
    deal = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).cast("int")
    q = packed.filter(is_query).select("vec_id", "vec", deal(blocks, 1).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"))
    r = packed.select("vec_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"), deal(rows, 2).alias("r"))
    met = q.groupBy("q", "r").cogroup(r.groupBy("q", "r")).applyInPandas(meet(k), HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
