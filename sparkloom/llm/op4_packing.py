"""Packing by lexical retrieval: a sharded BM25 index finds the neighbours that fill a seed's window.

Each document is tokenized once. Its full windows of WINDOW ids are sequences of their own; the tail goes
to the index. Tails are dealt into tasks by range of a min-hash of their id pairs, so similar ones lie
together and no key can gather too many rows (ties split by doc_id). A task reads its range in shards of
SHARD new tails and builds an inverted index with BM25 weights over each shard; document frequencies are those of
all documents, a table of at most the tokenizer's vocabulary that the tasks sum up and all get. The first
unused tail is the seed; the unused neighbours with the best scores follow until the window is full, the last
one cut, its rest unused still. What is left of a shard (less than a window) joins the next one; the last rest
of a task becomes sequences whose lengths are powers of two, so nothing is padded.

The ids are those of the byte-level BPE file; they are made with its rank file (the same vocabulary), whose
library is several times faster. A control string of that file inside a text is its one id, as there.

Defined results: a null or empty text is the end id alone. Repeated rows are packed as often as they occur.
A null doc_id is carried along. Extra columns are ignored. Long texts are cut into as many windows as they
need. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, table

WINDOW, SHARD, DENSE, END_ID, VOCABULARY, K1, B = 1024, 1024, 16, 0, 50_257, 1.5, 0.75
# The tokens the named file adds to its vocabulary, which it finds inside texts whatever is asked about special tokens.
ADDED = {"<|endoftext|>": 50_256}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokenizer:
    """Text to ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of the text and the end id."""
        text = text or ""
        ids = self.coder.encode(text, allowed_special="all") if any(x in text for x in ADDED) else self.coder.encode_ordinary(text)
        ids.append(END_ID)
        return np.array(ids, np.uint16)


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for a worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def min_hash(ids: np.ndarray) -> int:
    """The smallest hash of two neighbouring ids, shifted to fit a signed long."""
    x = ids.astype(np.uint64)
    pairs = x[:-1] * np.uint64(1 << 16) + x[1:] if len(x) > 1 else x
    pairs = (pairs ^ (pairs >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return int(((pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).min() >> np.uint64(1))


TOKENIZED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("crcs", pa.list_(pa.int64())), ("head", pa.binary()), ("tail", pa.binary()), ("key", pa.int64()), ("df", pa.binary())])
_TOKENIZED = "doc_id long, n long, crcs array<long>, head binary, tail binary, key long, df binary"


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def tokenize(docs: DataFrame, path: str, keep_ids: bool) -> DataFrame:
    """A row a document, and a row with df (how many documents hold each id) for each task."""

    def run(batches):
        coder = tokenizer(path)
        df = np.zeros(VOCABULARY, np.uint32)
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = coder.ids(text.as_py())
                df[np.unique(ids)] += 1
                full = len(ids) // WINDOW * WINDOW
                crcs = [crc(ids[a : a + WINDOW]) for a in range(0, full, WINDOW)]
                rows.append((i, len(ids), crcs, ids[:full].tobytes() if keep_ids else None, ids[full:].tobytes(), min_hash(ids), None))
            yield batch_of(rows, TOKENIZED)
        yield batch_of([(None, None, None, None, None, None, df.tobytes())], TOKENIZED)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TOKENIZED)


def frequencies(tokenized: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents and the document frequency of each id."""

    def run(batches):
        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            for x in b.column("df"):
                total += np.frombuffer(x.as_py(), np.uint32)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids])], names=["id", "df"])

    df = np.zeros(VOCABULARY, np.int64)
    for r in tokenized.filter("df IS NOT NULL").select("df").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        df[r.id] = r.df
    return tokenized.filter("df IS NULL").count(), df


class Shard:
    """An inverted index over some tails with BM25 weights, and what of each tail is still unused."""

    def __init__(self, tails: list[tuple], idf: np.ndarray):
        #: (doc_id, doc tokens, start of the unused rest in the document, its ids)
        self.tails = tails
        self.left = [len(t[3]) for t in tails]
        parts = [np.unique(t[3], return_counts=True) for t in tails]
        self.terms = [p[0].astype(np.int64) for p in parts]
        doc = np.repeat(np.arange(len(tails)), [len(p[0]) for p in parts])
        term = np.concatenate(self.terms)
        tf = np.concatenate([p[1] for p in parts]).astype(np.float64)
        size = np.array(self.left, np.float64)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (size / size.mean())[doc]))).astype(np.float32)
        held = np.bincount(term, minlength=VOCABULARY)
        # Terms that many tails hold are rows of a matrix, all others posting lists.
        common = np.flatnonzero(held * DENSE > len(tails))
        self.row = np.full(VOCABULARY, -1)
        self.row[common] = np.arange(len(common))
        dense = self.row[term] >= 0
        self.matrix = np.zeros((len(common), len(tails)), np.float32)
        self.matrix[self.row[term[dense]], doc[dense]] = weight[dense]
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 scores of all tails for the seed's ids."""
        terms = self.terms[seed]
        rows = self.row[terms]
        asked = np.zeros(len(self.matrix), np.float32)
        asked[rows[rows >= 0]] = 1
        terms = terms[rows < 0]
        a = self.starts[terms]
        n = self.starts[terms + 1] - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return asked @ self.matrix + np.bincount(self.doc[at], self.weight[at], len(self.tails))

    def neighbours(self, seed: int) -> np.ndarray:
        """The tails of the shard by falling score for the seed's ids, ties in order."""
        return np.argsort(-np.round(self.scores(seed), 3), kind="stable")

    def take(self, i: int, most: int) -> tuple:
        """Up to most ids of tail i: (doc_id, start, ids, doc tokens)."""
        doc_id, n, start, ids = self.tails[i]
        used = len(ids) - self.left[i]
        got = ids[used : used + most]
        self.left[i] -= len(got)
        return doc_id, start + used, got, n

    def windows(self) -> Iterator[list[tuple]]:
        """Full windows, each a list of pieces; stops when less than a window is left."""
        total, seed = sum(self.left), 0
        while total >= WINDOW:
            while not self.left[seed]:
                seed += 1
            pieces = [self.take(seed, WINDOW)]
            room = WINDOW - len(pieces[0][2])
            if room:
                for i in self.neighbours(seed):
                    if self.left[i]:
                        pieces.append(self.take(int(i), room))
                        room -= len(pieces[-1][2])
                        if not room:
                            break
            total -= WINDOW
            yield pieces

    def rest(self) -> list[tuple]:
        return [(d, n, start + len(ids) - left, ids[len(ids) - left :]) for (d, n, start, ids), left in zip(self.tails, self.left, strict=True) if left]


def powers_of_two(rest: list[tuple]) -> Iterator[list[tuple]]:
    """The pieces of the rest, cut into sequences whose lengths are powers of two, long ones first."""
    total = sum(len(t[3]) for t in rest)
    rest = list(rest)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        pieces = []
        while room:
            d, n, start, ids = rest.pop(0)
            pieces.append((d, start, ids[:room], n))
            if len(ids) > room:
                rest.insert(0, (d, n, start + room, ids[room:]))
            room -= len(pieces[-1][2])
        yield pieces


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (16-bit, null without keep_ids)."""
    tokenized = stored(tokenize(docs, tokenizer_path or default_tokenizer(), keep_ids), "op4-tokens")
    n, df = frequencies(tokenized)
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))

    def run(batches):
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(pieces):
            nonlocal sequence
            at = 0
            for doc_id, start, ids, n in pieces:
                rows.append((doc_id, start, len(ids), crc(ids), n, sequence, at, ids.tobytes() if keep_ids else None))
                at += len(ids)
            sequence += 1

        def flush():
            out = batch_of(rows, PIECES)
            rows.clear()
            return out

        held: list[tuple] = []
        fresh = ids_held = 0
        for b in batches:
            for doc_id, n, crcs, head, tail in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "crcs", "head", "tail")), strict=True):
                for k, x in enumerate(crcs):
                    rows.append((doc_id, k * WINDOW, WINDOW, x, n, sequence, 0, head[2 * k * WINDOW : 2 * (k + 1) * WINDOW] if keep_ids else None))
                    sequence += 1
                if tail:
                    held.append((doc_id, n, len(crcs) * WINDOW, np.frombuffer(tail, np.uint16)))
                    fresh, ids_held = fresh + 1, ids_held + len(tail) // 2
                if fresh >= SHARD and ids_held >= WINDOW:  # rests of less than a window wait for that many new tails
                    shard = Shard(held, idf.value)
                    for pieces in shard.windows():
                        emit(pieces)
                    held, fresh = shard.rest(), 0
                    ids_held = sum(len(t[3]) for t in held)
                if len(rows) >= 4096:
                    yield flush()
        if held:
            shard = Shard(held, idf.value)
            for pieces in shard.windows():
                emit(pieces)
            for pieces in powers_of_two(shard.rest()):
                emit(pieces)
        yield flush()

    tails = tokenized.filter("df IS NULL").drop("df")
    return tails.repartitionByRange("key", "doc_id", "n").sortWithinPartitions("key", "doc_id", "n").mapInArrow(run, _PIECES)


def op4_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
