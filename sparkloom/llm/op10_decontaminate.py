"""Benchmark decontamination by spaced-seed hashing.

Words of the benchmark items are hashed under fixed masks that look at some positions of a short stretch
and ignore others. The same masks run over every document, and the hashes of both sides are joined; a hash they share
is a hit and fixes how the item lies along the document. There the two are compared word by word: the document holds the
item where a stretch of MIN_WORDS words (the whole item, if shorter) agrees in at least 0.8 of its words, in place. Up to
two substitutions in such a stretch leave at least one mask intact wherever they fall. Items shorter
than MIN_WORDS use the run of words that must survive their substitutions.

The documents are tokenized once, whatever the size of the benchmark, many texts at a time in arrays (words_of, hits_in):

- seeds: a row for each hash of an item, with its places and, for each, a byte for every word around it (tags).
- a bitmap of the seeds' hashes, of at most 2**BITS bits, goes to all tasks; it only keeps hashes without a partner from
  being shuffled. A benchmark of any size works; one of over 10 million words lets more of them pass.
- hits: a row for each of a document's hashes that pass, likewise with places and tags; joined with the seeds on the hash.
- pairs of places whose tags agree as a match must stay, by item and text; only texts with such pairs are read again.
- the stretch of the text that an item's pairs lie on is joined with the item and compared word by word.

Texts and items are known by 128-bit hashes, so copies share their result. Seeds, and what a text holds, are broadcast where
Spark finds them small, else joined by shuffle, where adaptive execution splits a frequent hash. A row holds one text's or
one item's places at most.

Words are lower-cased runs of word characters. Defined results: null or empty texts and items hold nothing
and match nothing. Items of fewer words than the parameter least (LEAST_ITEM) are too common to tell a leak: they are not searched (see short_items). Repeated rows each get their result. Extra columns pass through the filter. An empty
table, or an empty benchmark, gives no pairs and filters nothing. Long texts are compared whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache as once

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, table

MIN_WORDS, SIMILARITY, LEAST_ITEM, PAIRS, BITS = 13, 0.8, 5, 1 << 18, 27
#: Fixed masks: 1 looks at the word, 0 ignores it. Any two substitutions in 13 words miss one of them somewhere.
MASKS = ("11111", "110111", "1101011")
#: Words before a hash's place, and in all, that may lie in one stretch with it.
BEFORE, AROUND = 10, 23
#: Characters of text that are hashed at a time, and hits that make a batch of rows; letters of a word beyond which it is hashed by itself.
STRETCH, HITS, LONG = 1 << 17, 1 << 17, 1 << 12
_WORD, _GAP = re.compile(r"\w+"), re.compile(r"\W")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits for each number (one to one, 0 stays 0)."""
    for factor, shift in ((0x9E3779B97F4A7C15, 30), (0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
        x = x * np.uint64(factor)
        x ^= x >> np.uint64(shift)
    return x


@once
def _numbers() -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point, 0 where it is no word character, and an odd one for each place in a word."""
    points = np.arange(0x110000, dtype=np.uint64)
    word = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)  # with _, what \w is
    word[ord("_")] = True
    return np.where(word, _mixed(points), np.uint64(0)), _mixed(points[:LONG] + np.uint64(1 << 32)) | np.uint64(1)


class _Hashes:
    """Hashes of the words of a text: the sum of letter times place, mixed."""

    def __init__(self):
        self.letters, self.places = _numbers()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words of the lower-cased text, and where each begins."""
        letters = self.letters.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.dtype("<u4")), mode="clip")
        inside = letters != 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begins, lengths = edges[::2], edges[1::2] - edges[::2]
        if not len(begins):
            return np.empty(0, np.uint64), begins
        first = np.cumsum(lengths) - lengths
        letters = letters[inside]
        letters *= self.places.take(np.arange(len(letters)) - np.repeat(first, lengths), mode="clip")
        out = _mixed(np.add.reduceat(letters, first))
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self.long(text[begins[i] : begins[i] + lengths[i]])
        return out, begins

    @staticmethod
    def long(word: str) -> int:
        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def words_of(texts: list[str], cache: _Hashes, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all the texts, one text behind the other, and where each text ends among them."""
    low = [text.lower() for text in texts]
    whole, at, parts, begins = "\n".join(low), 0, [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    while at < len(whole):  # up to a character outside of words
        gap = _GAP.search(whole, at + stretch)
        end, last = (gap.end(), gap.start()) if gap else (len(whole), len(whole))
        huge = end
        if end - at > 2 * stretch + LONG:  # a word of this size gets no arrays
            huge = at + stretch
            while huge > at and not _GAP.match(whole, huge - 1):
                huge -= 1
        part, begin = cache.of(whole[at:huge])
        parts.append(part)
        begins.append(begin + at)
        if huge < end:
            parts.append(np.array([cache.long(whole[huge:last])], np.uint64))
            begins.append(np.array([huge]))
        at = end
    ends = np.cumsum(np.fromiter((len(text) + 1 for text in low), np.int64, len(low)))
    return np.concatenate(parts), np.searchsorted(np.concatenate(begins), ends)


def word_hashes(text: str | None, cache: _Hashes) -> np.ndarray:
    return words_of([text or ""], cache)[0]


def mask_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the words under the mask for each place where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, xxhash.xxh64_intdigest(mask.encode()), np.uint64)
    for at in (i for i, x in enumerate(mask) if x == "1"):
        out = (out ^ words[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of n words."""
    if n >= MIN_WORDS:
        return MASKS
    lost = n - -(-n * 4 // 5)
    return ("1" * -(-(n - lost) // (lost + 1)),)


def hits_in(words: np.ndarray, ends: np.ndarray, masks, passing) -> Iterator[tuple[np.ndarray, ...]]:
    """(hashes, texts, edges, places, tags): each hash of each text that passes, with the text's number; between two edges lie its places in the
    text and, for each, a byte for every one of the AROUND words around it, 0 beyond the text. ends: where each text ends among the words."""
    begins = np.concatenate([np.zeros(1, np.int64), ends])[:-1]
    laid = np.zeros(len(words) + AROUND * (len(ends) + 1), np.uint8)  # the texts, with AROUND zeros between them
    laid[BEFORE + np.arange(len(words)) + AROUND * np.repeat(np.arange(len(ends)), ends - begins)] = words % np.uint64(254) + np.uint64(2)
    around = np.lib.stride_tricks.sliding_window_view(laid, AROUND)
    for mask in masks:
        h = mask_hashes(words, mask)
        at = np.flatnonzero(passing(h))
        text = np.searchsorted(ends, at, side="right")
        within = at + len(mask) <= ends[text]
        at, text = at[within], text[within]
        order = np.lexsort((h[at], text))
        at, text = at[order], text[order]
        h = h[at]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
        for a, z in _spans(first, HITS):
            edges = np.append(first[a:z], first[z] if z < len(first) else len(at))
            here, of = at[edges[0] : edges[-1]], text[edges[0] : edges[-1]]
            yield h[edges[:-1]].astype(np.int64), text[edges[:-1]], edges - edges[0], (here - begins[of]).astype(np.int32), around[here + AROUND * of]


def _spans(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(from, to) for runs of these growing numbers that lie within the same multiple of size."""
    cuts = [0, *(np.flatnonzero(np.diff(at // size)) + 1).tolist(), len(at)] if len(at) else []
    yield from zip(cuts, cuts[1:])


def _by_hash(words: np.ndarray, masks, passing) -> Iterator[tuple[int, bytes, bytes]]:
    """(hash, places, tags) for each hash of the words that passes."""
    for hashes, _, edges, places, around in hits_in(words, np.array([len(words)]), masks, passing):
        for h, a, z in zip(hashes.tolist(), edges.tolist(), edges[1:].tolist()):
            yield h, places[a:z].tobytes(), around[a:z].tobytes()


def all_differences(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """All distinct differences here - there, by a convolution of where they are."""
    low, high = int(here.min()) - int(there.max()), int(here.max()) - int(there.min())
    size = 1 << int(high - low + 1).bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[here - here.min()] = 1
    y[there.max() - there] = 1
    both = np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size)[: high - low + 1]
    return np.flatnonzero(both > 0.5) + low


def shifts(here: np.ndarray, my_tags: np.ndarray, there: np.ndarray, its_tags: np.ndarray, n: int) -> np.ndarray:
    """Distinct places of an item's first word in the text (may be negative) where the tags allow a match; n: the item's words.

    Where a hash recurs so often in both that it makes more than PAIRS pairs, all places are given, by a convolution:
    memory stays in proportion to the texts.
    """
    if len(here) * len(there) > PAIRS:
        return all_differences(here, there)
    size = min(n, MIN_WORDS)
    same = (my_tags[:, None, :] == its_tags[None, :, :]) & (my_tags[:, None, :] != 0)
    total = np.zeros((*same.shape[:2], AROUND + 1), np.int16)
    np.cumsum(same, axis=2, out=total[:, :, 1:])
    good = (total[:, :, size:] - total[:, :, :-size]).max(axis=2) >= np.ceil(SIMILARITY * size - 1e-9)
    return np.unique((here[:, None].astype(np.int64) - there[None, :])[good])


def stretches(at: np.ndarray, n: int, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, places) for the stretches of a text of that length that an item of n words lies on at these sorted places; touching ones are one."""
    for part in np.split(at, np.flatnonzero(np.diff(at) > n) + 1):
        yield max(0, int(part[0])), min(length, int(part[-1]) + n), part


def best_overlap(own: np.ndarray, words: np.ndarray, places) -> tuple[int, int, int] | None:
    """(agreeing words, minus start, length) of the best verified overlap of the item at one of the places in the words."""
    best = None
    size = min(MIN_WORDS, len(own))
    for start in places:
        a, z = max(0, start), min(len(words), start + len(own))
        same = np.zeros(len(own) + 1, np.int64)
        same[1 + a - start : 1 + z - start] = own[a - start : z - start] == words[a:z]
        total = np.cumsum(same)
        good = np.flatnonzero(total[size:] - total[:-size] >= np.ceil(SIMILARITY * size - 1e-9))
        if len(good):
            first, last = max(a - start, int(good[0])), min(z - start, int(good[-1]) + size)
            row = (int(total[last] - total[first]), -(start + first), last - first)
            best = max(best or row, row)
            if best[0] == len(own):  # the whole item word by word; later places are no better
                break
    return best


def _rows(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _in_batches(kinds: dict[str, pa.DataType], rows: Iterator[tuple], batch_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > batch_bytes:
            yield _rows(kinds, out)
            out, size = [], 0
    yield _rows(kinds, out)


def _binary(edges: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A value for the bytes of the rows between two edges."""
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.array(edges * width, pa.int32()).buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])


def _keys(*names: str) -> list:
    """Two hashes that stand for a text."""
    return [F.xxhash64("text").alias(names[0]), F.xxhash64(F.lit(1), F.col("text")).alias(names[1])]


def items_of(benchmark: DataFrame, least: int = LEAST_ITEM) -> DataFrame:
    """i1, i2, n, words: the distinct texts of items that are searched, as word hashes."""

    def run(batches):
        cache = _Hashes()
        for b in batches:
            for i1, i2, t in zip(*(b.column(c).to_pylist() for c in ("i1", "i2", "text")), strict=True):
                if len(h := word_hashes(t, cache)) >= max(1, least):
                    yield i1, i2, len(h), h.tobytes()

    kinds = {"i1": pa.int64(), "i2": pa.int64(), "n": pa.int32(), "words": pa.binary()}
    texts = small_batches(benchmark).filter("text IS NOT NULL").select(*_keys("i1", "i2"), "text").dropDuplicates(["i1", "i2"])
    return stored(texts.mapInArrow(lambda batches: _in_batches(kinds, run(batches)), "i1 long, i2 long, n int, words binary"), "op10-items")


def seeds_of(items: DataFrame) -> DataFrame:
    """h, i1, i2, n, there, its_tags: every hash of an item with its places there."""

    def run(batches):
        for b in batches:
            for i1, i2, n, words in zip(*(b.column(c).to_pylist() for c in ("i1", "i2", "n", "words")), strict=True):
                for h, at, around in _by_hash(np.frombuffer(words, np.uint64), masks_of(n), lambda h: np.ones(len(h), bool)):
                    yield h, i1, i2, n, at, around

    kinds = {"h": pa.int64(), "i1": pa.int64(), "i2": pa.int64(), "n": pa.int32(), "there": pa.binary(), "its_tags": pa.binary()}
    return stored(items.mapInArrow(lambda batches: _in_batches(kinds, run(batches)), "h long, i1 long, i2 long, n int, there binary, its_tags binary"), "op10-seeds")


def bitmap_of(seeds: DataFrame, bits: int = BITS) -> np.ndarray:
    """Which upper parts of hashes occur in the seeds: 512 bits for each seed, at most 2**bits (16 MB at the default), as 64-bit words."""
    bits = min(bits, max(12, (512 * seeds.count()).bit_length()))
    place = seeds.select(F.shiftrightunsigned("h", 64 - bits).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("b"))
    set_ = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[set_.column("w").to_numpy()] = set_.column("b").to_numpy().astype(np.uint64)
    return out


def hits_of(docs: DataFrame, bitmap: np.ndarray, masks: tuple[str, ...]) -> DataFrame:
    """h, t1, t2, here, my_tags: every hash of a text that the bitmap lets pass, with its places there."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        cache, bits = _Hashes(), shared.value
        right = np.uint64(64 - 6 - (len(bits).bit_length() - 1))

        def passing(h):
            place = h >> right
            return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)

        for b in batches:
            t1, t2 = (b.column(c).to_numpy() for c in ("t1", "t2"))
            for a, z in _spans(np.cumsum(pc.binary_length(b.column("text")).to_numpy(), dtype=np.int64), STRETCH):
                words, ends = words_of(b.column("text").slice(a, z - a).to_pylist(), cache)
                for h, text, edges, places, around in hits_in(words, ends, masks, passing):
                    columns = [pa.array(h), pa.array(t1[a + text]), pa.array(t2[a + text]), _binary(edges, places), _binary(edges, around)]
                    yield pa.RecordBatch.from_arrays(columns, names=["h", "t1", "t2", "here", "my_tags"])

    texts = small_batches(docs).filter("text IS NOT NULL").select(*_keys("t1", "t2"), "text")
    return texts.mapInArrow(run, "h long, t1 long, t2 long, here binary, my_tags binary")


def candidates(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """t1, t2, items [(i1, i2, n, places)]: where items may lie on a text."""

    def run(batches):
        for b in batches:
            for t1, t2, i1, i2, n, *rest in zip(*(b.column(c).to_pylist() for c in ("t1", "t2", "i1", "i2", "n", "here", "my_tags", "there", "its_tags")), strict=True):
                here, there = (np.frombuffer(x, np.int32) for x in (rest[0], rest[2]))
                mine, its = (np.frombuffer(x, np.uint8).reshape(-1, AROUND) for x in (rest[1], rest[3]))
                found = shifts(here, mine, there, its, n)
                if len(found):
                    yield t1, t2, i1, i2, n, found.astype(np.int64).tobytes()

    kinds = {"t1": pa.int64(), "t2": pa.int64(), "i1": pa.int64(), "i2": pa.int64(), "n": pa.int32(), "at": pa.binary()}
    pairs = hits.join(seeds, "h").select("t1", "t2", "i1", "i2", "n", "here", "my_tags", "there", "its_tags")
    near = pairs.mapInArrow(lambda batches: _in_batches(kinds, run(batches)), "t1 long, t2 long, i1 long, i2 long, n int, at binary")
    return stored(near.groupBy("t1", "t2").agg(F.collect_set(F.struct("i1", "i2", "n", "at")).alias("items")), "op10-near")


def found_in(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_ITEM, bits: int = BITS) -> DataFrame:
    """t1, t2, i1, i2, start, words, matched: the best overlap of each text with each item it holds."""
    items = items_of(benchmark, least)
    seeds = seeds_of(items)
    sizes = sorted(r.n for r in items.select(F.least("n", F.lit(MIN_WORDS)).alias("n")).distinct().collect())  # 13 rows at most
    masks = tuple(dict.fromkeys(m for n in sizes for m in masks_of(n)))
    near = candidates(hits_of(docs, bitmap_of(seeds, bits), masks), seeds)
    small_batches(docs)

    def cut(batches):
        cache = _Hashes()
        for b in batches:
            for t1, t2, text, held in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("text"), b.column("items"), strict=True):
                words = word_hashes(text.as_py(), cache)
                places: dict[tuple, list] = {}
                for x in held.as_py():
                    places.setdefault((x["i1"], x["i2"], x["n"]), []).append(np.frombuffer(x["at"], np.int64))
                for (i1, i2, n), parts in places.items():
                    for a, z, at in stretches(np.unique(np.concatenate(parts)), n, len(words)):
                        yield t1, t2, i1, i2, a, words[a:z].tobytes(), (at - a).tobytes()

    def compare(batches):
        for b in batches:
            for t1, t2, i1, i2, a, text, at, own in zip(*(b.column(c).to_pylist() for c in ("t1", "t2", "i1", "i2", "from", "text_words", "at", "words")), strict=True):
                best = best_overlap(np.frombuffer(own, np.uint64), np.frombuffer(text, np.uint64), np.frombuffer(at, np.int64).tolist())
                if best:
                    yield t1, t2, i1, i2, best[0], best[1] - a, best[2]

    pieces = {"t1": pa.int64(), "t2": pa.int64(), "i1": pa.int64(), "i2": pa.int64(), "from": pa.int64(), "text_words": pa.binary(), "at": pa.binary()}
    overlaps = {"t1": pa.int64(), "t2": pa.int64(), "i1": pa.int64(), "i2": pa.int64(), "matched": pa.int32(), "before": pa.int64(), "words": pa.int32()}
    texts = docs.filter("text IS NOT NULL").select(*_keys("t1", "t2"), "text").join(near, ["t1", "t2"])
    parts = texts.mapInArrow(lambda batches: _in_batches(pieces, cut(batches)), "t1 long, t2 long, i1 long, i2 long, `from` long, text_words binary, at binary")
    held = parts.join(items.drop("n"), ["i1", "i2"]).mapInArrow(lambda batches: _in_batches(overlaps, compare(batches)), "t1 long, t2 long, i1 long, i2 long, matched int, before long, words int")
    best = held.groupBy("t1", "t2", "i1", "i2").agg(F.max(F.struct("matched", "before", "words")).alias("best"))
    return stored(best.select("t1", "t2", "i1", "i2", (-F.col("best.before")).cast("int").alias("start"), "best.words", "best.matched"), "op10-found")


def short_items(benchmark: DataFrame, least: int = LEAST_ITEM) -> DataFrame:
    """The items that are not searched."""
    return benchmark.filter(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))) < least)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_ITEM, bits: int = BITS) -> DataFrame:
    """doc_id, item_id, start, words, matched: one row for each item that a document holds (word places)."""
    found = found_in(docs, benchmark, least, bits)
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *_keys("t1", "t2"))
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), *_keys("i1", "i2"))
    return texts.join(found, ["t1", "t2"]).join(items, ["i1", "i2"]).select("doc_id", "item_id", "start", "words", "matched")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_ITEM, bits: int = BITS) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    gone = found_in(docs, benchmark, least, bits).select("t1", "t2").distinct()
    one, two = _keys("t1", "t2")
    return docs.join(gone, (one == gone["t1"]) & (two == gone["t2"]), "left_anti")


def op10_decontaminate(spark, sf_dir) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
