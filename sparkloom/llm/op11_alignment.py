"""Cross-tokenizer alignment by products of sparse token-byte matrices.

A text's tokens under two tokenizers A and B are rows of two incidence matrices over its bytes, kept in hand-built
CSR. The rows of A·Bᵀ, gathered the way of Gustavson, are the overlap links: which B tokens share bytes with an A
token, and how many. Bytes at which tokens of both end cut a text into groups; the product of the tokens' group
matrices gives the shared-group links. The matrices of a batch are those of its distinct segments side by side: no
token of either tokenizer reaches over a space that follows a non-space, so texts are cut there (B's pieces are
asked first), and a worker encodes and multiplies a segment once, however many texts hold it.

How many documents hold a pair of ids linked is counted over the corpus: tasks add up their documents' pairs,
Spark sums them by pair, and a row for each A id (at most as long as B's vocabulary) holds its partners. The counts
go back to the documents' pairs in cells: a block of A ids, dealt by size, times a part of the documents, so neither
a frequent id nor a large table is one task's work and no table is broadcast.

Defined results: texts null, empty or whose joined bytes differ from the text with a space before it (by either
tokenizer) have no tokens: zeros and an empty digest; they hold no pair. Repeated rows are documents. A null doc_id
is carried along. Extra columns are ignored. A text of any length is encoded whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: Pairs of the counts a cell holds, pairs of documents a cell looks up, distinct pairs a task gathers before it writes them.
TABLE, LOOKED_UP, GATHERED = 1_000_000, 8_000_000, 2_000_000
#: Segments that a worker keeps aligned, and their characters.
SEGMENTS, SEGMENT_BYTES = 300_000, 16_000_000
SPACE = "▁"
#: A space after a non-space (Unicode's and more) and before anything: both tokenizers end a token there.
_CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- Sparse matrices


@dataclass
class Csr:
    """Row i holds the columns cols[starts[i]:starts[i + 1]], rising; values are ones."""

    starts: np.ndarray
    cols: np.ndarray
    width: int

    def transposed(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))[order]
        return Csr(np.concatenate(([0], np.cumsum(np.bincount(self.cols, minlength=self.width)))), rows, len(self.starts) - 1)


def spans(lengths: np.ndarray) -> Csr:
    """The incidence matrix of tokens that lie side by side: a token's row names its bytes."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def membership(group: np.ndarray, n: int) -> Csr:
    """The incidence matrix of tokens and the group of each."""
    return Csr(np.arange(len(group) + 1), group, n)


def product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, columns and values of a·b in order: a row of the product is the sum of the rows of b that a's row names."""
    sizes = np.diff(b.starts)[a.cols]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(b.starts[a.cols] - ends + sizes, sizes)
    rows = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), sizes)
    key = rows * max(1, b.width) + b.cols[at]
    if np.any(key[1:] < key[:-1]):
        key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if total else np.zeros(0, np.int64)
    rows, cols = np.divmod(key[first], max(1, b.width))
    return rows, cols, np.diff(np.concatenate((first, [total])))


# --- Tokenizers


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in entry): i for entry, i in vocabulary.items() if all(c in letters for c in entry) and not entry.startswith("<|")}
        self.encode_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a_size = max(vocabulary.values()) + 1
        self.a_bytes = [b""] * self.a_size
        for x, i in ranks.items():
            self.a_bytes[i] = x
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if self.a_size * self.b_size >= 1 << 32:
            raise ValueError("a pair of ids must fit into 32 bits")
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.place: dict[str, int] = {}
        self.held = 0
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Each id in decimal with the sign that may follow it: a comma, or | after a group's last A and ; after its last B.
        self.words = [b"%d%s" % (i, s) for s, n in ((b",", self.a_size), (b"|", self.a_size), (b",", self.b_size), (b";", self.b_size)) for i in range(n)]
        self.table = Known(self.align([]))

    def segments(self, text: str | None) -> list[str]:
        """The text cut at spaces, which are the next segment's first character and not written."""
        return (_CUT.split(text) if self.cut else [text]) if text else []

    def align(self, segments: list[str]) -> Aligned:
        return Aligned(self, segments)

    def known(self, texts: list[str | None]) -> tuple[list[list[int]], Known]:
        """The segments of texts as numbers, and what is known of each number. Segments stay known until they are too many or too long."""
        if len(self.place) > SEGMENTS or self.held > SEGMENT_BYTES:
            self.place, self.held, self.table = {}, 0, Known(self.align([]))
        place, n = self.place, len(self.place)
        coded = [[place.setdefault(s, len(place)) for s in self.segments(t)] for t in texts]
        fresh = list(itertools.islice(place, n, None))
        if fresh:
            self.held += sum(map(len, fresh))
            self.table.add(self.align(fresh))
        return coded, self.table


class Aligned:
    """Tokens, groups and links of segments, by one product for all of them; ok tells which have tokens."""

    def __init__(self, by: Aligner, segments: list[str]):
        self.by = by
        self.ok = np.ones(len(segments), bool)
        (self.a, self.n_a), (self.b, self.n_b) = self._encoded(segments)
        a, b = spans(by.a_len[self.a]), spans(by.b_len[self.b])
        self.a_ends, self.b_ends = a.starts[1:], b.starts[1:]
        self.link_a, self.link_b, self.shared_bytes = product(a, b.transposed())
        self.bounds = np.intersect1d(self.a_ends, self.b_ends)
        self.a_group, self.b_group = np.searchsorted(self.bounds, self.a_ends), np.searchsorted(self.bounds, self.b_ends)
        at = lambda n: np.concatenate(([0], np.cumsum(n)))
        self.a_from, self.b_from = at(self.n_a), at(self.n_b)
        #: The first group and the first link of each segment, and the end.
        groups_a = np.concatenate((self.a_group, [len(self.bounds)]))
        self.group_from = groups_a[self.a_from]
        self.link_from = np.searchsorted(self.link_a, self.a_from)
        self.n_groups, self.n_links = np.diff(self.group_from), np.diff(self.link_from)
        self.keys = (self.a[self.link_a] * by.b_size + self.b[self.link_b]).astype(np.uint32)

    def _encoded(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids by A and by B of all segments one after another, and how many each has.

        Segments that end in a non-space end where tokens end, so they are encoded as one text; all others, and these if the bytes of
        that text come out otherwise, are encoded one by one.
        """
        by = self.by
        tables, lengths = (by.a_bytes, by.b_bytes), (by.a_len, by.b_len)
        encode = lambda s: (by.encode_a(" " + s), by.b.encode(s, num_threads=1))
        right = lambda both, s: all(b"".join(map(x.__getitem__, ids)) == (" " + s).encode() for ids, x in zip(both, tables, strict=True))
        plain = [i for i, s in enumerate(segments) if by.cut and not s[-1:].isspace()]
        text = " ".join([segments[i] for i in plain])
        both = encode(text) if plain else ([], [])
        if plain and not right(both, text):
            plain, both = [], ([], [])
        ends = np.cumsum([len(segments[i].encode()) + 1 for i in plain])
        rest = sorted(set(range(len(segments))) - set(plain))
        each = [encode(segments[i]) for i in rest]
        self.ok[rest] = [right(e, segments[i]) for e, i in zip(each, rest, strict=True)]
        order = np.argsort(np.array([*plain, *rest], np.int64), kind="stable")
        out = []
        for k, n in enumerate(lengths):
            ids = np.array(both[k], np.int64)
            size = np.diff(np.searchsorted(np.cumsum(n[ids]), ends, "right"), prepend=0)
            more = [e[k] if self.ok[i] else [] for e, i in zip(each, rest, strict=True)]
            ids, size = np.concatenate([ids, *(np.array(x, np.int64) for x in more)]), np.concatenate((size, [len(x) for x in more])).astype(np.int64)
            out.append((ids[ranges((np.cumsum(size) - size)[order], size[order])], size[order]))
        return out

    def shared_group_links(self) -> tuple[np.ndarray, np.ndarray]:
        """A tokens and B tokens of one group, all pairs of them: the product of the group matrices."""
        n = len(self.bounds)
        return product(membership(self.a_group, n), membership(self.b_group, n).transposed())[:2]

    def n_shared(self) -> np.ndarray:
        """The number of shared-group links of each segment, by the sums of the two matrices' columns."""
        n = len(self.bounds)
        size = np.bincount(self.a_group, minlength=n) * np.bincount(self.b_group, minlength=n)
        return np.diff(np.concatenate(([0], np.cumsum(size)))[self.group_from])

    def texts(self) -> list[bytes]:
        """Each segment's groups written out: a1,a2|b1;a3|b2,b3."""
        by, n = self.by, len(self.bounds)
        last = lambda g: np.concatenate((g[1:] != g[:-1], [True])) if len(g) else np.zeros(0, bool)
        code_a = self.a + by.a_size * last(self.a_group)
        code_b = 2 * by.a_size + self.b + by.b_size * last(self.b_group)
        before = np.concatenate(([0], np.cumsum(np.bincount(self.b_group, minlength=n))))[self.a_group]
        upto = np.cumsum(np.bincount(self.a_group, minlength=n))[self.b_group] if n else self.b_group
        codes = np.zeros(len(code_a) + len(code_b), np.int64)
        codes[np.arange(len(code_a)) + before] = code_a
        codes[np.arange(len(code_b)) + upto] = code_b
        words = list(map(by.words.__getitem__, codes.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(words[x:y])[:-1] for x, y in zip([0, *ends], ends, strict=False)]


class Known:
    """What Aligned tells of segments, for those of several batches."""

    COUNTS = ("ok", "n_a", "n_b", "n_groups", "n_links", "shared")

    def __init__(self, x: Aligned):
        self.counts, self.keys, self.texts = self._counts(x), x.keys, x.texts()

    def _counts(self, x: Aligned) -> np.ndarray:
        return np.array([x.ok, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_shared()], np.int64)

    def add(self, x: Aligned) -> None:
        self.counts = np.concatenate((self.counts, self._counts(x)), axis=1)
        self.keys = np.concatenate((self.keys, x.keys))
        self.texts += x.texts()

    def link_from(self) -> np.ndarray:
        return np.cumsum(self.counts[4]) - self.counts[4]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(*paths: str) -> Aligner:
    """One pair of tokenizers for a worker process."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the next."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


# --- Documents

_MARKED = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, keys binary, times binary"
MARKED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared")], ("groups_sha256", pa.string()), ("keys", pa.binary()), ("times", pa.binary())])


def marked(docs: DataFrame, *paths: str) -> DataFrame:
    """For every row of docs (doc_id, text) a number uid, its counts, the digest of its groups, its distinct linked pairs (keys) and how often it holds each (times)."""

    def run(batches):
        by = aligner(*paths)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            coded, x = by.known(b.column("text").to_pylist())
            link_from, words, rows = x.link_from(), x.texts, []
            for i, codes in zip(b.column("doc_id").to_pylist(), coded, strict=True):
                uid += 1
                at = np.array(codes, np.int64)
                counts = x.counts[:, at]
                if not codes or not counts[0].all():
                    rows.append((uid, i, 0, 0, 0, 0, 0, "", b"", b""))
                    continue
                held, n = np.unique(at, return_counts=True)
                links = x.counts[4][held]
                keys, which = np.unique(x.keys[ranges(link_from[held], links)], return_inverse=True)
                times = np.bincount(which, np.repeat(n, links)).astype(np.uint32)
                digest = hashlib.sha256(b";".join(map(words.__getitem__, codes))).hexdigest()
                rows.append((uid, i, *map(int, counts[1:].sum(axis=1)), digest, keys.tobytes(), times.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(MARKED)], schema=MARKED)

    return small_batches(docs, 500).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MARKED)


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, shared: bool = False) -> DataFrame:
    """doc_id, ok and the alignment itself for every row of docs (doc_id, text): a_ids and a_ends, b_ids and b_ends (byte offsets in the
    text with a space before it), group_ends, links (a and b count tokens of the document; bytes is how many they share) and, if asked for,
    the shared-group links (in a group of m and n tokens m·n of them)."""
    first = default_tokenizers()
    paths = (a_path or first[0], b_path or first[1])
    link = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())]))
    pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    lists = ("a_ids", "a_ends", "b_ids", "b_ends", "group_ends")
    schema = pa.schema([("doc_id", pa.int64()), ("ok", pa.bool_()), *[(c, pa.list_(pa.int64())) for c in lists], ("links", link), ("shared", pair)])

    def run(batches):
        by = aligner(*paths)
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                segments = by.segments(t.as_py())
                x = by.align(segments)
                ok = bool(segments) and bool(x.ok.all())
                if not ok:
                    x = by.align([])
                links = [{"a": int(p), "b": int(q), "bytes": int(n)} for p, q, n in zip(x.link_a, x.link_b, x.shared_bytes, strict=True)]
                pairs = [{"a": int(p), "b": int(q)} for p, q in zip(*x.shared_group_links(), strict=True)] if shared else None
                values = (i, ok, *[v.tolist() for v in (x.a, x.a_ends, x.b, x.b_ends, x.bounds)], links, pairs)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    kinds = f"doc_id long, ok boolean, {', '.join(f'{c} array<long>' for c in lists)}, links array<struct<a:long,b:long,bytes:long>>, shared array<struct<a:long,b:long>>"
    return small_batches(docs, 500).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def pair_counts(rows: DataFrame, b_size: int, gathered: int = GATHERED) -> DataFrame:
    """a, best, bs and ns for each A id of rows (keys): its partners in order, how many rows hold each pair, and the largest of these numbers."""

    def run(batches):
        keys, n, fresh, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def merged():
            new, count = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (keys[:0], n[:0])
            both, which = np.unique(np.concatenate((keys, new)), return_inverse=True)
            return both, np.bincount(which, np.concatenate((n, count)), len(both)).astype(np.int64)

        def rows_of(keys, n):
            a, b = np.divmod(keys.astype(np.int64), b_size)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n)], names=["a", "b", "n"])

        for b in batches:
            for x in b.column("keys"):
                fresh.append(np.frombuffer(x.as_py(), np.uint32))
                size += len(fresh[-1])
            if size >= gathered:
                (keys, n), fresh, size = merged(), [], 0
                if len(keys) >= gathered:
                    yield rows_of(keys, n)
                    keys, n = keys[:0], n[:0]
        yield rows_of(*merged())

    counts = rows.select("keys").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    partners = counts.groupBy("a").agg(F.max("n").alias("best"), F.sort_array(F.collect_list(F.struct("b", "n"))).alias("bn"))
    return partners.select("a", "best", F.col("bn.b").alias("bs"), F.col("bn.n").alias("ns"))


def looked_up(rows: DataFrame, counts: DataFrame, a_size: int, b_size: int, table_pairs: int = TABLE, cell_pairs: int = LOOKED_UP) -> DataFrame:
    """uid, n_best and count_sum for the rows (uid, keys, times) that hold pairs, from counts (as pair_counts gives it)."""
    sizes = counts.select("a", F.size("bs").alias("n")).orderBy("a").collect()  # no more than A's vocabulary
    before = np.cumsum([r.n for r in sizes]) - [r.n for r in sizes] if sizes else []
    block = np.zeros(a_size, np.int64)
    for r, x in zip(sizes, before, strict=True):
        block[r.a] = x // table_pairs
    blocks = int(block.max()) + 1
    total = rows.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    parts = max(1, -(-total // (4 * blocks * cell_pairs)))

    def cut(batches):
        for b in batches:
            out = []
            for uid, k, t in zip(b.column("uid").to_pylist(), b.column("keys"), b.column("times"), strict=True):
                keys, times = np.frombuffer(k.as_py(), np.uint32), np.frombuffer(t.as_py(), np.uint32)
                of = block[keys // b_size]
                at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                for x, y in zip(at, [*at[1:], len(keys)], strict=True):
                    out.append((int(of[x]) * parts + uid % parts, uid, keys[x:y].tobytes(), times[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["cell", "uid", "keys", "times"])

    def number(batches):
        for b in batches:
            of = block[b.column("a").to_numpy()]
            at = np.repeat(np.arange(b.num_rows), parts)
            yield pa.RecordBatch.from_arrays([pa.array(of[at] * parts + np.tile(np.arange(parts), b.num_rows)), *[b.column(c).take(pa.array(at)) for c in ("a", "best", "bs", "ns")]], names=["cell", "a", "best", "bs", "ns"])

    pieces = rows.filter(F.octet_length("keys") > 0).select("uid", "keys", "times").mapInArrow(cut, "cell long, uid long, keys binary, times binary")
    tables = counts.mapInArrow(number, "cell long, a int, best long, bs array<int>, ns array<long>")
    both = tables.unionByName(pieces, allowMissingColumns=True)

    def run(batches):
        cell, known, keys, count, best = None, [], None, None, None
        for b in batches:
            cells, a = b.column("cell").to_numpy(), b.column("a")
            out = []
            for i in range(b.num_rows):
                if cells[i] != cell:
                    cell, known, keys = cells[i], [], None
                if a[i].is_valid:
                    bs, ns = (b.column(c)[i].values.to_numpy() for c in ("bs", "ns"))
                    known.append((a[i].as_py() * b_size + bs.astype(np.int64), ns, np.full(len(ns), b.column("best")[i].as_py())))
                    continue
                if keys is None:
                    keys, count, best = (np.concatenate(x) for x in zip(*known, strict=True))
                mine, times = np.frombuffer(b.column("keys")[i].as_py(), np.uint32), np.frombuffer(b.column("times")[i].as_py(), np.uint32)
                at = np.searchsorted(keys, mine)
                n = count[at]
                out.append((b.column("uid")[i].as_py(), int(times[n == best[at]].sum()), int((times * n).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["uid", "n_best", "count_sum"])

    # Tables come first in a cell, in the order of A ids; then the documents' pairs.
    dealt = both.repartition(blocks * parts, "cell").sortWithinPartitions("cell", F.col("a").asc_nulls_last(), "uid")
    found = dealt.mapInArrow(run, "uid long, n_best long, count_sum long")
    return found.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def document_links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_shared (shared-group links), n_best, count_sum, groups_sha256 for every row of docs (doc_id, text)."""
    first = default_tokenizers()
    paths = (a_path or first[0], b_path or first[1])
    rows = stored(marked(docs, *paths), "op11-marked")
    by = aligner(*paths)
    counts = stored(pair_counts(rows, by.b_size), "op11-counts")
    sums = looked_up(rows, counts, by.a_size, by.b_size).withColumnRenamed("uid", "of")
    out = rows.join(sums, F.col("uid") == F.col("of"), "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", number("n_best"), number("count_sum"), "groups_sha256")


def op11_alignment(spark, sf_dir) -> DataFrame:
    return document_links(table(spark, sf_dir, "documents"))
