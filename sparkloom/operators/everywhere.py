"""Search over all domains for a table of queries: hybrid search in the knowledge base, substrings everywhere else.

Substrings are found through an inverted index of letter runs: a row is listed under every run of one, two and three letters it
holds. A query looks up the rarest run of three letters it has (a shorter query itself), and what that lists is verified on the
row's text. So a table of queries is one join, and no query scans a store.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialized, small
from . import retrieval as rt

RUN, LIMIT = 3, 10


def runs_of(text: str, longest: int = RUN) -> set[str]:
    """All runs of one to three letters of a text."""
    return {text[i : i + n] for n in range(1, longest + 1) for i in range(len(text) - n + 1)}


def run_index(rows: DataFrame) -> DataFrame:
    """run, category, id for every row (category, id, text): which runs its text, in lower case, holds. Null texts are not listed."""

    def listed(batches):
        for b in batches:
            sets = [list(runs_of(t.as_py())) for t in b.column("text")]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array([r for s in sets for r in s], pa.string()), b.column("category").take(at), b.column("id").take(at)], names=["run", "category", "id"])

    return rows.filter("text IS NOT NULL").select("category", "id", F.lower("text").alias("text")).mapInArrow(listed, "run string, category string, id string")


def keys_of(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, needle and run, the rarest run to look up, for queries (query_id, query); none for a query that is empty or holds a run no row has."""
    needles = queries.select("query_id", F.lower("query").alias("needle")).filter("length(needle) > 0")
    size = F.length("needle")
    short = F.array("needle")
    long = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - (RUN - 1), F.lit(1))), lambda i: F.substring("needle", i, F.lit(RUN))))
    runs = needles.select("query_id", "needle", F.explode(F.when(size < RUN, short).otherwise(long)).alias("run"))
    counts = index.join(small(runs.select("run").distinct()), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))
    known = runs.join(counts, "run", "left")
    return known.groupBy("query_id", "needle").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.count_if(F.col("n").isNull()).alias("unknown")).filter("unknown = 0").drop("unknown")


def substring_search(queries: DataFrame, rows: DataFrame, index: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """query_id, category, id, title, rank: per query and category the newest rows (category, id, title, text, at) whose text holds the query, case aside.

    index, if it is at hand, is run_index(rows). Null queries, empty ones, and rows with a null text find nothing.
    """
    index = materialized(run_index(rows), "runs") if index is None else index
    keys = materialized(keys_of(queries, index), "needles")
    listed = index.join(small(keys), "run").select("query_id", "needle", "category", "id")
    found = listed.join(rows.withColumns({"c": F.col("category"), "i": F.col("id")}).drop("category", "id"), (F.col("category") == F.col("c")) & (F.col("id") == F.col("i")))
    held = found.filter(F.contains(F.lower("text"), F.col("needle")))
    return rt.top_k(held, ["query_id", "category"], [F.desc("at"), F.col("id")], limit).select("query_id", "category", "id", "title", "rank")


def search_everywhere(queries: DataFrame, knowledge: DataFrame, limit: int = LIMIT, **categories: DataFrame) -> DataFrame:
    """query_id, category, id, title, rank: knowledge hits (query_id, chunk_id, rank, as hybrid_search gives them; titles from doc rows are the caller's)
    beside what substring_search finds in the other categories (id, title, text, at), all in one table."""
    named = [d.select(F.lit(c).alias("category"), F.col("id").cast("string").alias("id"), "title", "text", F.col("at").cast("long").alias("at")) for c, d in categories.items()]
    rows = materialized(reduce(DataFrame.unionByName, named), "domains")
    title = F.col("title") if "title" in knowledge.columns else F.lit(None).cast("string")
    hits = knowledge.filter(F.col("rank") <= limit).select("query_id", F.lit("knowledge").alias("category"), F.col("chunk_id").alias("id"), title.alias("title"), "rank")
    return hits.unionByName(substring_search(queries, rows, limit=limit))
