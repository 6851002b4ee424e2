"""Line dedup over overlapping windows of three consecutive lines.

Every window of three lines is hashed (128 bits); windows that occur more than once anywhere are found by
one aggregation; all occurrences but the first, in order of (doc_id, line), cover their three lines, and the
covered lines of a document, merged over its windows, are removed.

Defined results: lines end at line feeds only. A window without any non-blank line is none. Documents of
fewer than three lines have no windows and stay. A null text stays null; a text may become empty. In a run
of one repeated line, later windows overlap the first and only the first line stays. Every row is a document: of rows
that repeat, all but one lose their windows. Rows that share a doc_id go by a hash of the text, then in any
order; a null doc_id comes first. Extra columns pass through (n_lines and n_removed are replaced). An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, table

WIDTH, NO_ID = 3, -(2**63)
SPACE_ONLY = r"^[\x20\x09-\x0D]*$"


def numbered(docs: DataFrame) -> DataFrame:
    """row (all of docs' columns), text, k (doc_id), t (a hash of the text) and r, a number of its own for every row; stored, so that it stays."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("r"))
    return stored(rows.select("row", "r", "row.text", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64("row.text").alias("t")).drop("text"), "op7-rows").withColumn("text", F.col("row.text"))


def windows(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """k, t, r, pos, h1, h2 for every window of width lines that is not blank."""
    lines = rows.select("k", "t", "r", F.split("text", "\n").alias("lines")).filter(F.size("lines") >= width)

    def window(i: Column) -> Column:
        ls = [F.get("lines", i + j) for j in range(width)]
        blank = F.concat(*ls).rlike(SPACE_ONLY)
        return F.when(~blank, F.struct(i.alias("pos"), F.xxhash64(*ls).alias("h1"), F.xxhash64(F.lit(width), *ls[::-1]).alias("h2")))

    w = lines.select("k", "t", "r", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - width), window)).alias("w"))
    return w.filter("w IS NOT NULL").select("k", "t", "r", "w.pos", "w.h1", "w.h2")


def covered(wins: DataFrame) -> DataFrame:
    """of (r), at: the first lines of the windows of a row that occurred before."""
    here = F.struct("k", "t", "r", "pos")
    repeated = wins.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = stored(repeated.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first"), "op7-repeated")
    later = wins.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).filter(here != F.col("first"))
    return later.groupBy(F.col("r").alias("of")).agg(F.collect_set("pos").alias("at"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())]))
def _without(text: pd.Series, at: pd.Series) -> pd.DataFrame:
    out = []
    for t, starts in zip(text, at, strict=True):
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        if starts is not None and len(starts):
            gone = np.zeros(len(lines), bool)
            for j in range(WIDTH):
                gone[np.asarray(starts) + j] = True
            kept = [x for x, g in zip(lines, gone, strict=True) if not g]
            out.append(("\n".join(kept), len(lines), int(gone.sum())))
        else:
            out.append((t, len(lines), 0))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the shortened text, and n_lines and n_removed (lines before, lines removed)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = numbered(small_batches(docs).select(*[F.col(f"`{c}`") for c in own]))
    done = rows.join(covered(stored(windows(rows), "op7-windows")), F.col("r") == F.col("of"), "left").select("row", _without("text", "at").alias("new"))
    return done.select(*[F.col("new.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in own], "new.n_lines", "new.n_removed")


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT rid, doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win
  FROM (SELECT rid, doc_id, ls, unnest(range(len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3)
  WHERE regexp_matches(ls[pos + 1] || ls[pos + 2] || ls[pos + 3], '[^\x20\x09-\x0D]')
), n AS (SELECT rid, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, rid, pos) AS nth FROM w),
c AS (SELECT rid, list(DISTINCT pos + j) AS gone FROM (SELECT rid, pos, unnest([0, 1, 2]) AS j FROM n WHERE nth > 1) GROUP BY rid)
SELECT d.doc_id, CASE WHEN c.gone IS NULL THEN d.text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(c.gone, i - 1)), chr(10)) END AS text,
  CAST(coalesce(len(ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(c.gone), 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN c ON d.rid = c.rid
"""
