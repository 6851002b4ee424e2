"""Ranked lexical search by dual trees: hierarchies over items and documents prune whole batches exactly.

A score is the product of two sparse vectors: an item's term weights and a document's saturated term frequencies. Items
are taken in blocks of bounded text. A block's terms go to all tasks (their number is bounded by the block), the documents
are scanned once for them and stored as vectors over these terms, and their document frequencies are counted in Spark.
Every task then builds a hierarchy over each batch of its vectors, sorted by their rarest term so that likes lie together:
a node holds the largest value of each coordinate below it. The block's items have such a hierarchy too. A pair of nodes
is bounded by the product of its maxima; where that is below the weakest k-th score of the node's items, all pairs below
leave at once. What survives down to one item and one document is its score. A task's k best of an item start from
what it has seen, so they are exact for its documents; the k best of all tasks are cut by rank, k rows a task and item.

Scores are integers. Terms are runs of ASCII letters and digits and all other than ASCII signs, only A-Z lower-cased.

Defined results: null texts have no terms; an item without terms, and documents without one of its terms, give no row.
Rows are documents and items of their own, repeated or not; equal scores go to the smaller doc_id, null ids come last.
Extra columns are ignored. A text of any length is counted whole. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: Results an item, documents of a leaf, children of a node, documents of a hierarchy, characters of a block of items.
K, LEAF, FAN, BATCH, BLOCK = 10, 16, 8, 8192, 2_000_000
NO_ID = 2**63 - 1
#: Bytes to what they are read as: separators to spaces, A-Z to a-z, all others to themselves.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


# --- Documents as vectors


def vectors(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tf (packed, ids rising: which of the terms in place it holds how often) of the rows of docs with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches):
        place = shared.value
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                terms = terms_of(text.as_py())
                if terms:
                    held = sorted((place[t], n) for t, n in Counter(terms).items() if t in place)
                    both = np.array(held, np.int64).reshape(-1, 2)
                    rows.append((i, len(terms), both[:, 0].astype(np.uint32).tobytes(), both[:, 1].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "n", "ids", "tf"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary, tf binary")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many of rows (ids) hold each of the block's terms."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("ids"):
                total[np.frombuffer(x.as_py(), np.uint32)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "df"])

    df = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        df[r.id] = r.df
    return df


# --- Hierarchies


@dataclass
class Level:
    """Nodes side by side: node i holds the coordinates cols[starts[i]:starts[i + 1]], rising, with their largest values below."""

    starts: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    least_id: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.starts[i], self.starts[i + 1]
        return self.cols[a:z], self.values[a:z]

    def up(self, fan: int) -> Level:
        """The level above: each node over fan of these."""
        n = len(self)
        node = np.repeat(np.arange(n) // fan, np.diff(self.starts))
        order = np.lexsort((self.cols, node))
        node, cols, values = node[order], self.cols[order], self.values[order]
        first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (cols[1:] != cols[:-1])))) if len(cols) else np.zeros(0, np.int64)
        above = -(-n // fan)
        starts = np.searchsorted(node[first], np.arange(above + 1))
        return Level(starts, cols[first], np.maximum.reduceat(values, first) if len(first) else values, np.minimum.reduceat(self.least_id, np.arange(0, n, fan)))

    def bounds(self, nodes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The product of each of some nodes with a weight vector."""
        sizes = self.starts[nodes + 1] - self.starts[nodes]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return np.zeros(len(nodes), np.int64)
        at = np.arange(ends[-1]) + np.repeat(self.starts[nodes] - ends + sizes, sizes)
        sums = np.concatenate(([0], np.cumsum(self.values[at] * weights[self.cols[at]])))
        return sums[ends] - sums[ends - sizes]


def hierarchy(rows: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, fans: list[int]) -> list[Level]:
    """Levels over vectors (cols, values), the vectors themselves first, up to a single node; fans: how many go under a node, the last one for all higher levels."""
    sizes = [len(c) for c, _ in rows]
    whole = lambda k: np.concatenate([r[k] for r in rows]).astype(np.int64)
    levels = [Level(np.concatenate(([0], np.cumsum(sizes))), whole(0), whole(1), ids)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].up(fans[min(len(levels), len(fans)) - 1]))
    return levels


@dataclass
class Items:
    """The items of a block, sorted by their rarest term, and their hierarchy; size is the number of the block's terms."""

    item_ids: list[int | None]
    levels: list[Level]
    size: int


def items_of(block: list[tuple], place: dict[bytes, int], df: np.ndarray, n: int) -> Items | None:
    """The items (item_id, text) of a block that hold a term some document holds; n counts the documents with terms."""
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    found = []
    for i, text in block:
        held = sorted((place[t], c) for t, c in Counter(terms_of(text)).items() if df[place[t]])
        if held:
            cols, count = np.array(held, np.int64).T
            found.append((int(cols[np.lexsort((cols, df[cols]))[0]]), i, cols, count * weight[cols]))
    if not found:
        return None
    found.sort(key=lambda x: (x[0], x[1] is None, x[1]))
    return Items([x[1] for x in found], hierarchy([x[2:] for x in found], np.zeros(len(found), np.int64), [FAN]), len(place))


class Best:
    """The k best documents of each item so far: scores falling, ties by id; and the k-th score (0 while there are fewer)."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores, self.ids = [[np.zeros(0, np.int64)] * items for _ in range(2)]
        self.kth, self.kth_id = np.zeros(items, np.int64), np.full(items, NO_ID)
        #: How many documents were scored.
        self.scored = 0

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scored += len(ids)
        good = (scores > self.kth[item]) | ((scores == self.kth[item]) & (scores > 0) & (ids <= self.kth_id[item]))
        if not good.any():
            return
        scores, ids = np.concatenate((self.scores[item], scores[good])), np.concatenate((self.ids[item], ids[good]))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.kth[item], self.kth_id[item] = self.scores[item][-1], self.ids[item][-1]


def search(items: Items, docs: list[Level], best: Best, weights: np.ndarray) -> None:
    """Offer best every document of a hierarchy that can be among an item's k best. weights: zeros for all terms, left so."""
    fans = [FAN ** level for level in range(len(items.levels))]

    def visit(level: int, node: int, depth: int, among: np.ndarray) -> None:
        """The item node against the document nodes among of depth (0: single documents)."""
        first, last = node * fans[level], min((node + 1) * fans[level], len(items.item_ids))
        cols, values = items.levels[level].row(node)
        weights[cols] = values
        bound = docs[depth].bounds(among, weights)
        weights[cols] = 0
        if level == 0 and depth == 0:
            best.offer(node, bound, docs[0].least_id[among])
            return
        worst = best.kth[first:last].min()
        open_ = bound >= max(worst, 1)
        if level == 0:
            open_ &= (bound > worst) | (docs[depth].least_id[among] <= best.kth_id[node])
        among, bound = among[open_], bound[open_]
        if not len(among):
            return
        if level == 0:
            # Nodes with the highest bounds first, a few at a time: the k-th score rises and the rest may leave.
            order = np.argsort(-bound, kind="stable")
            for a in range(0, len(order), FAN):
                some = order[a : a + FAN]
                if bound[some[0]] < best.kth[node]:
                    break
                visit(0, node, depth - 1, below(depth, among[some]))
            return
        if depth:
            depth, among = depth - 1, below(depth, among)
        for child in range(node * FAN, min((node + 1) * FAN, len(items.levels[level - 1]))):
            visit(level - 1, child, depth, among)

    def below(depth: int, nodes: np.ndarray) -> np.ndarray:
        fan = LEAF if depth == 1 else FAN
        out = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return out[out < len(docs[depth - 1])]

    visit(len(items.levels) - 1, 0, len(docs) - 1, np.zeros(1, np.int64))


def best_documents(rows: DataFrame, items: Items, df: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """item (its place), item_id, score, doc_id: each task's k best of its rows (as vectors gives them) for every item."""
    shared = rows.sparkSession.sparkContext.broadcast((items, df))

    def run(batches):
        items, df = shared.value
        best, weights, held = Best(len(items.item_ids), k), np.zeros(items.size, np.int64), []

        def searched():
            # Documents with one rarest term, then one next to it, lie together.
            held.sort(key=lambda r: (r[0], r[1]))
            search(items, hierarchy([r[2] for r in held], np.array([r[1] for r in held], np.int64), [LEAF, FAN]), best, weights)
            held.clear()

        for b in batches:
            for i, total, ids, tf in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "tf")), strict=True):
                ids, tf = np.frombuffer(ids, np.uint32).astype(np.int64), np.frombuffer(tf, np.uint32).astype(np.int64)
                m = 100 - 75 + 75 * total * n // length
                rare = ids[np.argsort(df[ids], kind="stable")[:2]]
                held.append((tuple(rare.tolist()), NO_ID if i is None else i, (ids, 1_000_000_000 * tf // (1000 * tf + 8 * m))))
                if len(held) == BATCH:
                    searched()
        if held:
            searched()
        out = [(j, items.item_ids[j], s, None if d == NO_ID else d) for j in range(len(items.item_ids)) for s, d in zip(best.scores[j].tolist(), best.ids[j].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["item", "item_id", "score", "doc_id"])

    return rows.filter(F.octet_length("ids") > 0).mapInArrow(run, "item long, item_id long, score long, doc_id long")


def blocks_of(items: DataFrame, block: int) -> Iterator[list[tuple]]:
    """Rows (item_id, text) of items in blocks of so many characters, or one longer item."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        if held and size + len(r.text or "") > block:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text or "")
    if held:
        yield held


def ranked_search(items: DataFrame, docs: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) with a score above 0 of every row of items (item_id, text)."""
    found = []
    for number, part in enumerate(blocks_of(items, block)):
        place = {t: i for i, t in enumerate(sorted({t for _, text in part for t in terms_of(text)}))}
        rows = stored(vectors(docs, place), "op13-vectors")
        n, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = frequencies(rows, len(place))
        known = items_of(part, place, df, n)
        if known:
            found.append(best_documents(rows, known, df, n, length, k).withColumn("block", F.lit(number)))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = reduce(DataFrame.union, found)
    rank = F.row_number().over(W.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_dual_tree(spark, sf_dir) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, len_ AS n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len_, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(s.n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
score AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
