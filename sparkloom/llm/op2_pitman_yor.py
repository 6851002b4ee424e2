"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling, and its scores.

Tokens are words (A-Z lower-cased, runs of other than ASCII white space) and one end a text. A restaurant is a
context, the whole word before (for a text's first word the end sign); all contexts share the empty context as
parent; its base is uniform over the V known tokens and one unknown. A cell is a dish (word) in a restaurant: its
customers are the training tokens, its tables are customers of the parent.

1. Texts are tokenized once, into batches of local word numbers with the words' 64-bit hashes, and stored.
2. Each batch sends its distinct (context, word) pairs with their training counts to the context's bucket, packed. There
   they are added up. Contexts with more tokens than a bucket should hold are split by the pair instead; there
   are at most HEAVY of them, so what is known of these restaurants is a small table every task gets.
3. Gibbs. Cells with one customer have one table. The others are dealt by word, so that a dish's cells in
   all contexts and its row in the parent lie together, and swept: a cell's customers leave, with their tables and the
   parent's customers those were; then they sit down one after another given everybody else (how long until the next
   new table opens is drawn at once, beta-geometric). A dish's cells go in GROUPS turns, each seeing what the turns before
   did; then the dish's customers in the parent are seated anew. Dishes are sampled in parallel; between sweeps the
   table totals of all restaurants are added up anew and joined to the cells. A block of customers is drawn by
   sequential seating (for two customers that is the exact conditional).
4. Predictions. After BURN_IN sweeps, SAMPLES sweeps are averaged: in a context, the mean discounted share of the
   cell plus the mean back-off weight times the parent's mean probability. Both levels sum to one exactly.
5. Scoring. The batches' pairs go to the buckets again and their words to the words' buckets; shares and probabilities
   come back in the batch's order and are added up for each text there. Nothing but scalars and the heavy contexts is collected.

Sampling is seeded by bucket and place in it: reruns and lost tasks give the same.

Defined results: a null text is empty: the end token alone. Rows that repeat count and are scored as often.
A null doc_id is scored, not trained on, and not held out. Without any training token every score is
that of the uniform base. Extra columns are ignored. An empty table gives no rows. A text's tokens are held by one task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small_batches, stored, table

FOLDS, HELD_OUT, SAMPLES, BURN_IN, STRENGTH, GROUPS = 7, 2, 2, 1, (1.0, 0.1), 4
BATCH_TOKENS, BATCH_DOCS, BUCKET_TOKENS, HEAVY, PART, PIECE, SLICES = 2_000_000, 60_000, 3_000_000, 50_000, 65_536, 1 << 19, 2
END = b"\n"

#: Packed rows: kind tells what the bytes hold; rows of a batch or a bucket are sent, sorted and read in order.
_NAMES = ["bucket", "kind", "batch", "part", *"abcdef"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
_ROW = "bucket int, kind int, batch long, part long, a binary, b binary, c binary, d binary, e binary, f binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    rows = [r + (None,) * (len(_NAMES) - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], names=_NAMES)


def _read(batches):
    """The packed rows of Arrow batches, one at a time."""
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(len(_NAMES))), strict=True)


def _grouped(rows, key: int):
    """Runs of rows with an equal key."""
    run: list[tuple] = []
    for r in rows:
        if run and r[key] != run[0][key]:
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def _array(row: tuple, i: int, kind=np.uint64) -> np.ndarray:
    """The i-th bytes of a packed row as numbers."""
    return np.frombuffer(row[4 + i], kind)


def _by_bucket(rows: DataFrame, buckets: int, *order: str) -> DataFrame:
    """Packed rows dealt by bucket, so many partitions that a task holds few buckets at any size, in order within them."""
    return rows.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket", *(order or ("part", "kind", "batch")))


def training(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


def bucket_of(u: np.ndarray, w: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """A pair's bucket: that of its context, but for heavy contexts (sorted) one by the pair."""
    split = np.isin(u, heavy) if len(heavy) else np.zeros(len(u), bool)
    mixed = np.where(split, (u ^ (w * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9), u)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


# --- Batches of texts


class Vocabulary(dict):
    """Words to running numbers."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def tokenized(docs: DataFrame) -> DataFrame:
    """A packed row a batch of texts: doc_ids, (null, training) marks, lengths, word numbers, word hashes; part: training tokens."""

    def run(batches):
        batch = TaskContext.get().partitionId() << 24
        words, parts, docs_, size = Vocabulary(), [], [], 0

        def packed():
            ids = np.array([0 if i is None else i for i, _ in docs_], np.int64)
            trained = np.array([training(i) for i, _ in docs_], np.uint8)
            n = np.array([k for _, k in docs_], np.int64)
            marks = np.stack([np.array([i is None for i, _ in docs_], np.uint8), trained])
            hashes, tokens = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.concatenate(parts)
            order = np.argsort(-np.bincount(tokens), kind="stable")  # frequent words get small numbers: their upper bytes compress away
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            planes = number[tokens].view(np.uint8).reshape(-1, 4).T
            return _rows([(0, 0, batch, int((n * trained).sum()), ids.tobytes(), marks.tobytes(), n.tobytes(), planes.tobytes(), hashes[order].tobytes())])

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ws = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                ws.append(END)
                parts.append(np.fromiter(map(words.__getitem__, ws), np.uint32, len(ws)))
                docs_.append((i, len(ws)))
                size += len(ws)
                if size >= BATCH_TOKENS or len(docs_) >= BATCH_DOCS:
                    yield packed()
                    batch += 1
                    words, parts, docs_, size = Vocabulary(), [], [], 0
        if docs_:
            yield packed()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROW)


class Batch:
    """A batch of texts as stored: its documents, tokens, and distinct (context, word) pairs in the order they are sent."""

    def __init__(self, row: tuple):
        self.id = row[2]
        self.doc_ids, marks = np.frombuffer(row[4], np.int64), np.frombuffer(row[5], np.uint8).reshape(2, -1)
        self.no_id, self.trained = marks[0].astype(bool), marks[1].astype(bool)
        self.n, self.hashes = np.frombuffer(row[6], np.int64), np.frombuffer(row[8], np.uint64)
        self.words = np.ascontiguousarray(np.frombuffer(row[7], np.uint8).reshape(4, -1).T).view(np.uint32).ravel()

    def pairs(self, heavy: np.ndarray, buckets: int):
        """(buckets, context numbers, word numbers, places of each token's pair) of the pairs, by bucket."""
        words = self.words.astype(np.int64)
        end = int(np.flatnonzero(self.hashes == np.uint64(xxhash.xxh64_intdigest(END)))[0])
        before = np.concatenate(([end], words[:-1]))  # the token before a text is the end of the one before
        codes, at = np.unique((before << 32) | words, return_inverse=True)
        u, w = codes >> 32, codes & 0xFFFFFFFF
        to = bucket_of(self.hashes[u], self.hashes[w], heavy, buckets)
        order = np.argsort(to, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return to[order], u[order], w[order], back[at]


def _parts(to: np.ndarray):
    """(bucket, part, from, to) of at most PART entries each of entries that lie by bucket."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])).tolist()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        for part, at in enumerate(range(a, z, PART)):
            yield int(to[a]), part, at, min(z, at + PART)


def send_pairs(tokens: DataFrame, heavy: np.ndarray, buckets: int, which: tuple[int, int] = (0, 1)) -> DataFrame:
    """Kind 1: the pairs of a batch for a bucket: context and word hashes, training counts. which (k, n): only every n-th bucket from k on."""

    def run(batches):
        for row in _read(batches):
            b = Batch(row)
            to, u, w, at = b.pairs(heavy, buckets)
            n = np.bincount(at, np.repeat(b.trained, b.n), len(to)).astype(np.uint32)
            hu, hw = b.hashes[u], b.hashes[w]
            for bucket, part, a, z in _parts(to):
                if bucket % which[1] == which[0]:
                    yield _rows([(bucket, 1, b.id, part, hu[a:z].tobytes(), hw[a:z].tobytes(), n[a:z].tobytes())])

    return tokens.mapInArrow(run, _ROW)


class Cells:
    """The distinct (context, word) pairs of a bucket with their training counts."""

    def __init__(self, u, w, n):
        self.order = np.lexsort((w, u))
        u, w, n = u[self.order], w[self.order], n[self.order]
        new_u = np.concatenate(([True], u[1:] != u[:-1]))
        first = np.flatnonzero(new_u | np.concatenate(([True], w[1:] != w[:-1])))
        self.of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))  # cell of each sorted entry
        self.u, self.w, self.c = u[first], w[first], np.add.reduceat(n, first)
        self.context = np.cumsum(new_u[first]) - 1
        self.contexts = u[np.flatnonzero(new_u)]

    def per_context(self, x) -> np.ndarray:
        return np.bincount(self.context, x, len(self.contexts))


def _pairs_of(rows: list[tuple]):
    joined = lambda i, t: np.frombuffer(b"".join(r[i] for r in rows), t)
    return joined(4, np.uint64), joined(5, np.uint64), joined(6, np.uint32).astype(np.int64)


def count_cells(pairs: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """To the words' buckets, kind 0: words, their customers and cells in a bucket of pairs; kind 1: cells with two customers and more
    (w, u, c, n: how many cells their context has, 0 for heavy ones). Kind 2: heavy contexts' cells in a bucket."""
    none = np.empty(0, np.uint64)

    def sent(kind: int, batch: int, w: np.ndarray, *more: np.ndarray):
        to = bucket_of(w, w, none, buckets)
        order = np.lexsort((w, to))
        for bucket, part, a, z in _parts(to[order]):
            yield (bucket, kind, batch, part, *(x[order[a:z]].tobytes() for x in (w, *more)))

    def run(batches):
        for rows in _grouped(_read(batches), 0):
            u, w, n = _pairs_of(rows)
            keep = n > 0
            if not keep.any():
                continue
            cells, at = Cells(u[keep], w[keep], n[keep]), rows[0][0]
            size = cells.per_context(None)
            split = np.isin(cells.contexts, heavy)
            live = np.flatnonzero(cells.c > 1)
            words, of = np.unique(cells.w, return_inverse=True)
            yield _rows(list(sent(0, at, words, np.bincount(of, cells.c).astype(np.int64), np.bincount(of).astype(np.int64))))
            yield _rows(list(sent(1, at, cells.w[live], cells.u[live], cells.c[live], np.where(split, 0, size)[cells.context[live]].astype(np.int32))))
            yield _rows([(0, 2, at, 0, cells.contexts[split].tobytes(), size[split].tobytes())])

    return _by_bucket(pairs, buckets).mapInArrow(run, _ROW)


# --- Seating


@dataclass
class Model:
    """What is known of the whole: training tokens and their kinds, discounts, strengths; root totals and heavy contexts of the seating."""

    tokens: int
    known: int
    buckets: int
    heavy: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    discount: tuple[float, float] = (0.5, 0.5)
    strength: tuple[float, float] = STRENGTH
    cells: int = 0
    once: int = 0
    customers: float = 0.0
    tables: float = 0.0
    #: Sums over the samples: probability of an unknown word, and the own part of a word that occurred once.
    unknown: float = 0.0
    single: float = 0.0
    #: Heavy contexts: their customers and mean tables.
    contexts: dict[int, tuple[float, float]] = field(default_factory=dict)

    def base(self) -> float:
        """Weight of a new table in the root, for one word."""
        return (self.strength[0] + self.discount[0] * self.tables) / (self.known + 1)

    def sampled(self, counts: bool) -> None:
        """Take the root totals as those of a sample, if they count."""
        if counts:
            self.unknown += self.base() / (self.strength[0] + self.customers)
            self.single += self.root_share(1, 1)

    def root_share(self, customers, tables):
        """The part of a word's probability in the root that is its own."""
        return (customers - self.discount[0] * tables) / (self.strength[0] + self.customers)


def seat(customers: np.ndarray, weight, discount: float, rng) -> np.ndarray:
    """Tables after the customers of each dish sat down one by one; weight(which, tables): that of a next table with this dish."""
    tables = np.minimum(customers, 1).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    seated = np.ones(len(live), np.float64)
    while len(live):
        p = rng.beta(np.maximum(weight(live, tables[live]), 1e-12), np.maximum(seated - discount * tables[live], 1e-12))
        wait = np.floor(np.log(1.0 - rng.random(len(live))) / np.log1p(-np.clip(p, 1e-15, 1 - 1e-12))) + 1
        seated = seated + np.maximum(wait, 1)
        stay = seated <= customers[live]
        live, seated = live[stay], seated[stay]
        tables[live] += 1
    return tables


def seat_cells(m: Model, c, t, total, dish, c0, t0, rng) -> tuple[np.ndarray, np.ndarray]:
    """New tables of cells (customers c, tables t, tables of their whole context, dish) and the dishes' root customers c0; t0 are root tables."""
    (d0, d), (s0, s) = m.discount, m.strength
    place = np.arange(len(dish)) - np.searchsorted(dish, dish)
    t, c0 = t.copy(), c0.copy()
    for turn in range(GROUPS):
        own = np.flatnonzero(place % GROUPS == turn)
        of, was = dish[own], t[own]
        others = c0[of] - was
        mass = np.maximum(others - d0 * np.minimum(t0[of], others), 0) + m.base()
        size, free = s0 + m.customers - was, s + d * (total[own] - was)
        t[own] = seat(c[own], lambda i, k: (free[i] + d * k) * (mass[i] + k) / (size[i] + k), d, rng)  # noqa: B023
        c0 += np.bincount(of, t[own] - was, len(c0)).astype(c0.dtype)
    return t, c0


def _state_rows(bucket: int, part: int, runs, u, c, n, t, total):
    """A packed part of a bucket's cells (kind 1): cells a dish, from dish number `runs[0]` on; batch: their extra tables."""
    return (bucket, 1, int((t - 1).sum()), part, runs.astype(np.int64).tobytes(), u.tobytes(), c.tobytes(), n.astype(np.int32).tobytes(), t.astype(np.int32).tobytes(), total.astype(np.int32).tobytes())


def _root_row(bucket: int, w, count, c0, t0, acc):
    """A bucket's dishes in the root (kind 0); batch: their tables."""
    return (bucket, 0, int(t0.sum()), -1, w.tobytes(), count.tobytes(), c0.tobytes(), t0.tobytes(), acc.tobytes())


def first_seating(counts: DataFrame, sizes: dict[int, int], buckets: int) -> DataFrame:
    """The state to start from, one table a cell: kind 0 roots (words that occur twice or more), kind 1 parts of cells, kind 2 words
    that occur once, kind 3 sums for the model: words, those once, cells of words, words with one and two cells, live cells, those of two."""
    known = counts.sparkSession.sparkContext.broadcast(sizes)

    def run(batches):
        for rows in _grouped(_read(batches), 0):
            bucket = rows[0][0]
            join = lambda kind, i, t: np.frombuffer(b"".join(r[4 + i] for r in rows if r[1] == kind), t)  # noqa: B023, E731
            w, of = np.unique(join(0, 0, np.uint64), return_inverse=True)
            count, cells = (np.bincount(of, join(0, i, np.int64), len(w)).astype(np.int64) for i in (1, 2))
            lw, u, c, n = join(1, 0, np.uint64), join(1, 1, np.uint64), join(1, 2, np.int64), join(1, 3, np.int32)
            order = np.lexsort((u, lw))
            lw, u, c, n = lw[order], u[order], c[order], n[order].copy()
            contexts, of = np.unique(u[n == 0], return_inverse=True)
            n[n == 0] = np.array([known.value[int(k)] for k in contexts], np.int32)[of]
            many = count > 1
            yield _rows([(bucket, 2, 0, 0, w[~many].tobytes()), (bucket, 3, 0, 0, np.array([len(w), (~many).sum(), cells.sum(), (cells == 1).sum(), (cells == 2).sum(), len(c), (c == 2).sum()], np.int64).tobytes())])
            w, count, cells = w[many], count[many], cells[many]
            if len(w):
                yield _rows([_root_row(bucket, w, count, cells, np.ones(len(w), np.int64), np.zeros(len(w)))])
            dish = np.searchsorted(w, lw)
            for part, a in enumerate(range(0, len(u), PIECE)):
                z = min(len(u), a + PIECE)
                own = dish[a:z]
                one = np.ones(z - a, np.int64)
                yield _rows([_state_rows(bucket, part, np.concatenate(([own[0]], np.bincount(own - own[0]))), u[a:z], c[a:z], n[a:z], one, 0 * one)])

    return _by_bucket(counts.filter("kind < 2"), buckets, "kind", "batch", "part").mapInArrow(run, _ROW)


def _cells_of(row: tuple):
    """Dish numbers, u, c, n, t and summed tables of a part of cells."""
    runs = _array(row, 0, np.int64)
    return np.repeat(runs[0] + np.arange(len(runs) - 1), runs[1:]), _array(row, 1), _array(row, 2, np.int64), *(_array(row, i, np.int32).astype(np.int64) for i in (3, 4, 5))


def _context_order(u: np.ndarray, buckets: int):
    """Buckets of contexts, and the order in which cells lie by them."""
    to = bucket_of(u, u, np.empty(0, np.uint64), buckets)
    order = np.argsort(to, kind="stable")
    return to[order], order


def extra_tables(state: DataFrame, buckets: int) -> DataFrame:
    """Kind 2, for each part of cells: how many tables more than cells the context of each cell has, added up over all its cells."""

    def ask(batches):
        for row in _read(batches):
            _, u, _, _, t, _ = _cells_of(row)
            to, order = _context_order(u, buckets)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])).tolist()
            u, t = u[order], (t - 1).astype(np.int32)[order]
            yield _rows([(int(to[a]), 0, row[0], row[3], u[a:z].tobytes(), t[a:z].tobytes()) for a, z in zip(cuts[:-1], cuts[1:], strict=True)])

    def tell(batches):
        for rows in _grouped(_read(batches), 0):
            _, of = np.unique(np.frombuffer(b"".join(r[4] for r in rows), np.uint64), return_inverse=True)
            more = np.bincount(of, np.frombuffer(b"".join(r[5] for r in rows), np.int32)).astype(np.int32)[of]
            at = 0
            for r in rows:
                z = at + len(r[5]) // 4
                yield _rows([(r[2], 2, r[0], r[3], more[at:z].tobytes())])
                at = z

    return _by_bucket(state.filter("kind = 1").mapInArrow(ask, _ROW), buckets).mapInArrow(tell, _ROW)


def sweep(state: DataFrame, m: Model, number: int, account: bool) -> DataFrame:
    """The state after one more Gibbs sweep. With account the seating before it is a sample and is added to the sums."""

    def run(batches):
        for rows in _grouped(_read(batches), 0):
            bucket, root = rows[0][0], rows[0]
            rng = np.random.default_rng([number, bucket])
            w, count, c0, t0 = (_array(root, i, np.int64) for i in range(4))
            acc = _array(root, 4, np.float64) + (m.root_share(c0, t0) if account else 0)
            for part in _grouped(rows[1:], 3):
                dish, u, c, n, t, total = _cells_of(part[0])
                _, order = _context_order(u, m.buckets)
                more = np.empty(len(u), np.int64)
                more[order] = np.frombuffer(b"".join(r[4] for r in part[1:]), np.int32)
                first, last = dish[0], dish[-1] + 1
                now, mine = seat_cells(m, c, t, n + more, dish - first, c0[first:last], t0[first:last], rng)
                c0 = np.concatenate((c0[:first], mine, c0[last:]))
                yield _rows([_state_rows(bucket, part[0][3], _array(part[0], 0, np.int64), u, c, n, now, total + t * account)])
            free = (m.strength[0] + m.discount[0] * (m.tables - t0)) / (m.known + 1)
            t0 = seat(c0, lambda i, k: free[i] + m.discount[0] * k / (m.known + 1), m.discount[0], rng)  # noqa: B023
            yield _rows([_root_row(bucket, w, count, c0, t0, acc)])

    return _by_bucket(state.filter("kind < 2").union(extra_tables(state, m.buckets)), m.buckets).mapInArrow(run, _ROW)


def refresh(state: DataFrame, m: Model) -> None:
    """Root totals of the seating, added up anew."""
    extra, tables = state.agg(F.sum(F.when(F.col("kind") == 1, F.col("batch"))), F.sum(F.when(F.col("kind") == 0, F.col("batch")))).first()
    m.customers, m.tables = float(m.cells + (extra or 0)), float(m.once + (tables or 0))


def _sums(rows: DataFrame, read, kind: str = "long") -> dict:
    """Numbers read(row) -> (keys, values) from packed rows, added up by key; for few keys."""

    def run(batches):
        for row in _read(batches):
            keys, values = read(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(keys).view(np.int64)), pa.array(np.asarray(values, {"long": np.int64, "double": np.float64}[kind]))], names=["k", "x"])

    return {r.k: r.x for r in rows.mapInArrow(run, f"k long, x {kind}").groupBy("k").agg(F.sum("x").alias("x")).collect()}


def fit(tokens: DataFrame, strength: tuple[float, float] = STRENGTH) -> tuple[Model, DataFrame, DataFrame]:
    """The model, its words that occur once (packed rows of kind 2) and its state after the last sweep."""
    n = tokens.agg(F.sum("part")).first()[0] or 0
    m = Model(n, 0, max(1, -(-n // BUCKET_TOKENS)), strength=strength)
    m.heavy = heavy_contexts(tokens, n)
    counts = stored(count_cells(send_pairs(tokens, m.heavy, m.buckets), m.heavy, m.buckets), "op2-counts")
    forget(spark=tokens.sparkSession)
    # How many cells the heavy contexts have: at most HEAVY keys (see heavy_contexts).
    sizes = {k % (1 << 64): x for k, x in _sums(counts.filter("kind = 2"), lambda r: (_array(r, 0), _array(r, 1, np.int64))).items()} if len(m.heavy) else {}
    state = stored(first_seating(counts, sizes, m.buckets), "op2-state")
    single_words = stored(state.filter("kind = 2"), "op2-once")
    sums = _sums(state.filter("kind = 3"), lambda r: (np.arange(7), _array(r, 0, np.int64)))
    m.known, m.once, m.cells, once, twice, live, pairs_twice = (sums.get(i, 0) for i in range(7))
    share = lambda a, b: float(np.clip(a / (a + 2 * b), 0.1, 0.95)) if a + b else 0.5
    m.discount = share(once, twice), share(m.cells - live, pairs_twice)
    forget(counts, spark=counts.sparkSession)
    for k in range(BURN_IN + SAMPLES):
        refresh(state, m)
        m.sampled(k > BURN_IN)
        old, state = state, stored(sweep(state, m, k, k > BURN_IN), "op2-state")
        forget(old, spark=tokens.sparkSession)
    refresh(state, m)
    m.sampled(True)
    if len(m.heavy):

        def tables(row):
            _, u, _, _, t, total = _cells_of(row)
            keep = np.isin(u, m.heavy)
            of, at = np.unique(u[keep], return_inverse=True)
            return of, np.bincount(at, ((t + total) / SAMPLES - 1)[keep], len(of))

        def customers(row):
            w, count = _array(row, 0), _array(row, 1, np.int64)
            keep = np.isin(w, m.heavy)
            return w[keep], count[keep]

        extra, held = _sums(state.filter("kind = 1"), tables, "double"), _sums(state.filter("kind = 0"), customers)
        m.contexts = {k % (1 << 64): (x, sizes.get(k % (1 << 64), 0) + extra.get(k, 0.0)) for k, x in held.items()}
    return m, single_words, state


def heavy_contexts(tokens: DataFrame, n: int) -> np.ndarray:
    """The words with more training tokens than a bucket should hold and 1/HEAVY of all, sorted; maybe some with an eighth less.

    Batches tell of words with an eighth of that share in them at least: what the others hold of a heavy word is less than an eighth.
    """
    least = max(BUCKET_TOKENS, n / HEAVY)

    def run(batches):
        for row in _read(batches):
            b = Batch(row)
            count = np.bincount(b.words, np.repeat(b.trained, b.n), len(b.hashes))
            keep = np.flatnonzero(count > least / max(n, 1) / 8 * count.sum())
            yield pa.RecordBatch.from_arrays([pa.array(b.hashes[keep].view(np.int64)), pa.array(count[keep])], names=["w", "n"])

    found = tokens.mapInArrow(run, "w long, n double").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") > least * 7 / 8).select("w").toPandas()
    return np.sort(found["w"].to_numpy(np.int64).view(np.uint64))


# --- Scores


def deal_cells(state: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """Kind 0, to the buckets of pairs: contexts, words and summed tables of the cells."""

    def run(batches):
        for rows in _grouped(_read(batches), 0):
            words = _array(rows[0], 0)
            for row in rows[1:]:
                dish, u, _, _, t, total = _cells_of(row)
                w = words[dish]
                to = bucket_of(u, w, heavy, buckets)
                order = np.argsort(to, kind="stable")
                u, w, t = u[order], w[order], (t + total)[order]
                yield _rows([(bucket, 0, row[0], row[3], u[a:z].tobytes(), w[a:z].tobytes(), t[a:z].tobytes()) for bucket, _, a, z in _parts(to[order])])

    return _by_bucket(state.filter("kind < 2"), buckets).mapInArrow(run, _ROW)


def answer_pairs(requests: DataFrame, state: DataFrame, m: Model) -> DataFrame:
    """Kind 2, to a batch: the discounted share of each of its pairs in a bucket, and the back-off weight of each run of a context."""
    heavy, d, s = m.heavy, m.discount[1], m.strength[1]
    known = state.sparkSession.sparkContext.broadcast(m.contexts)
    both = requests.union(deal_cells(state, heavy, m.buckets))

    def run(batches):
        for rows in _grouped(_read(batches), 0):
            told, asked = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
            if not asked:
                continue
            u, w, n = _pairs_of(asked)
            joined = lambda i, t: np.frombuffer(b"".join(r[i] for r in told), t)  # noqa: B023, E731
            lt = joined(6, np.int64)
            x = Cells(np.concatenate((u, joined(4, np.uint64))), np.concatenate((w, joined(5, np.uint64))), np.concatenate((n, 0 * lt)))
            sampled = np.bincount(x.of, np.concatenate((np.zeros(len(n)), lt))[x.order], len(x.c)) / SAMPLES
            t = np.where(x.c > 1, sampled, x.c)
            customers, tables = x.per_context(x.c), x.per_context(t)
            for i in np.flatnonzero(np.isin(x.contexts, heavy)):
                customers[i], tables[i] = known.value[int(x.contexts[i])]
            cell = np.empty(len(x.of), np.int64)
            cell[x.order] = x.of
            cell = cell[: len(n)]
            share = ((x.c - d * t) / (s + customers[x.context])).astype(np.float32)[cell]
            back = ((s + d * tables) / (s + customers))[x.context].astype(np.float32)[cell]
            at = 0
            for r in asked:
                z = at + len(r[4]) // 8
                runs = np.flatnonzero(np.concatenate(([True], u[at + 1 : z] != u[at : z - 1])))
                yield _rows([(r[0], 2, r[2], r[3], share[at:z].tobytes(), back[at:z][runs].tobytes())])
                at = z

    return _by_bucket(both, m.buckets, "kind", "batch", "part").mapInArrow(run, _ROW)


def send_words(tokens: DataFrame, buckets: int) -> DataFrame:
    """Kind 5: the words of a batch for a word bucket, as hashes."""
    none = np.empty(0, np.uint64)

    def run(batches):
        for row in _read(batches):
            b = Batch(row)
            to = bucket_of(b.hashes, b.hashes, none, buckets)
            order = np.argsort(to, kind="stable")
            for bucket, part, a, z in _parts(to[order]):
                yield _rows([(bucket, 5, b.id, part, b.hashes[order[a:z]].tobytes())])

    return tokens.mapInArrow(run, _ROW)


def answer_words(requests: DataFrame, once: DataFrame, state: DataFrame, m: Model) -> DataFrame:
    """Kind 1, to a batch: training count and mean root probability of its words in a bucket."""
    both = requests.union(once).union(state.filter("kind = 0"))
    unknown, single = m.unknown / SAMPLES, (m.single + m.unknown) / SAMPLES

    def run(batches):
        for rows in _grouped(_read(batches), 0):
            w, count, p = [], [], []
            for r in rows:
                if r[1] == 0:
                    c0, t0 = _array(r, 2, np.int64), _array(r, 3, np.int64)
                    w.append(_array(r, 0))
                    count.append(_array(r, 1, np.int64))
                    p.append((_array(r, 4, np.float64) + m.root_share(c0, t0) + m.unknown) / SAMPLES)
                elif r[1] == 2:
                    w.append(_array(r, 0))
                    count.append(np.ones(len(w[-1]), np.int64))
                    p.append(np.full(len(w[-1]), single))
                else:
                    break
            w, count, p = (np.concatenate([*x, np.zeros(1, t)]) for x, t in ((w, np.uint64), (count, np.int64), (p, np.float64)))
            order = np.argsort(w[:-1])
            for r in rows:
                if r[1] == 5:
                    h = _array(r, 0)
                    at = np.searchsorted(w[:-1], h, sorter=order)
                    at = np.append(order, len(order))[at]
                    ok = w[at] == h
                    yield _rows([(r[0], 1, r[2], r[3], np.where(ok & (count[at] > 0), count[at], 0).tobytes(), np.where(ok & (count[at] > 0), p[at], unknown).astype(np.float32).tobytes())])

    return _by_bucket(both, m.buckets, "kind", "batch", "part").mapInArrow(run, _ROW)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def gather(tokens: DataFrame, words: DataFrame, pairs: DataFrame, m: Model, by_token: bool = False) -> DataFrame:
    """The scores of each text from its batch and the answers to it; with by_token also token_scores, log10 of each token's probability."""
    size, none = float(m.tokens + m.known + 1), np.empty(0, np.uint64)

    def run(batches):
        for rows in _grouped(_read(batches), 2):
            b = Batch(rows[0])
            joined = lambda kind, i, t: np.frombuffer(b"".join(r[i] for r in rows if r[1] == kind), t)  # noqa: B023, E731
            order = np.argsort(bucket_of(b.hashes, b.hashes, none, m.buckets), kind="stable")
            count, p = np.empty(len(order), np.int64), np.empty(len(order))
            count[order], p[order] = joined(1, 4, np.int64), joined(1, 5, np.float32)
            to, u, w, at = b.pairs(m.heavy, m.buckets)
            starts = np.concatenate([[a for _, _, a, _ in _parts(to)]]).astype(np.int64)
            new = np.concatenate(([True], u[1:] != u[:-1]))
            new[starts] = True
            back = joined(2, 5, np.float32).astype(np.float64)[np.cumsum(new) - 1]
            each = np.log10(joined(2, 4, np.float32) + back * p[w])[at]
            ends = np.concatenate(([0], np.cumsum(b.n)))
            add = lambda x: np.add.reduceat(x, ends[:-1])  # noqa: B023, E731
            known = count[b.words]
            out = [pa.array(b.doc_ids, mask=b.no_id), pa.array(b.n), pa.array(add((known > 0).astype(np.int64))), pa.array(add(np.log10((known + 1) / size))), pa.array(add(each))]
            names = [c.split()[0] for c in SCORES.split(", ")]
            if by_token:
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(each)))
                names.append("token_scores")
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = tokens.union(words).union(pairs).repartition(3 * m.buckets, "batch").sortWithinPartitions("batch", "kind", "bucket", "part")
    return rows.mapInArrow(run, SCORES + (", token_scores array<double>" if by_token else ""))


def score_texts(docs: DataFrame, by_token: bool = False, strength: tuple[float, float] = STRENGTH) -> tuple[DataFrame, Model]:
    """doc_id, n_tokens, n_known, base_score, score (log10) for each row of docs (doc_id, text); the model."""
    tokens = stored(tokenized(docs), "op2-tokens")
    m, once, state = fit(tokens, strength)
    words = stored(answer_words(send_words(tokens, m.buckets), once, state, m), "op2-answers")
    forget(spark=tokens.sparkSession)
    pairs = []
    for k in range(SLICES):  # a slice of the buckets at a time: the pairs on their way take up a part of the disk only
        asked = send_pairs(tokens, m.heavy, m.buckets, (k, SLICES))
        pairs.append(stored(answer_pairs(asked, state, m), "op2-pairs"))
        forget(spark=tokens.sparkSession)
    return gather(tokens, words, reduce(DataFrame.union, pairs), m, by_token), m


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: perplexity and base_perplexity (per token) over all rows of scores."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def op2_pitman_yor(spark, sf_dir) -> DataFrame:
    scores, m = score_texts(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")
