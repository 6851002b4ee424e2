"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits meet in a fingerprint between them: within 1 bit of one and 2 of the other
(distance 3), or within 1 of both. Every distinct fingerprint emits the variants around it, the variants
are shuffled, and where a variant is within 1 bit of some fingerprint (the centre), all that emitted it lie
within 3 bits of the centre: one link to the centre each verifies and joins them, so even a group of
thousands of near copies gives links in proportion to its size and never pairs.

Which variants: meeting points are of even parity wherever one side is odd, so odd fingerprints emit their
64 neighbours and even ones themselves and those two-bit variants whose bits lie in one half (of three
differing bits two always share a half); even pairs at distance 2 meet in the 64 odd neighbours of both.
Before that, fingerprints without any other within one bit in a 32-bit half (at distance 3 or less one
half differs by at most one bit) leave by the same ball hashing on halves: they cannot have a link.

Texts are lower-cased (A-Z), words are runs of other than ASCII white space, shingles are n words joined by
a space (repeats included; a shorter text is one shingle); a bit is 1 if set in over half the XXH64 hashes.

Defined results: null and empty texts, and those without a word, have fingerprint zero and link like any
other. A null doc_id gets a row and joins its group, and the group's smallest non-null id names it. Repeated
rows are rows. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import op12_odd_sketch as sketches
from .common import components, small_batches, stored, table

SHINGLE, SEED, NO_ID = 3, 42, -(2**63)


def hash_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest bit first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:z], SEED) for a, z in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        total += hash_counts(hashes[at : at + 65_536])
    return int(((2 * total > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def with_neighbour_in_half(fps: DataFrame) -> DataFrame:
    """The fingerprints fp that have another one within a bit in their upper or lower half."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))  # the bit above tells the halves apart
    rows = fps.select("fp", F.explode(F.array(low, high)).alias("key"))
    exact = stored(rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")), "op8-halves")
    steps = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])
    tried = rows.select("fp", F.explode(steps).alias("step"), "key").select("fp", F.col("key").bitwiseXOR(F.col("step")).alias("key"))
    # The keys grow with the corpus: merge joins at every size, never a broadcast.
    near = tried.join(exact.hint("merge"), F.col("key") == F.col("k")).select("fp")
    same = rows.join(exact.filter("n > 1").hint("merge"), F.col("key") == F.col("k")).select("fp")
    return stored(near.union(same).distinct(), "op8-near")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints within 3 bits that connect exactly what all such pairs connect."""
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    ones = F.array(*[F.lit(signed(1 << b)).cast("long") for b in range(64)])
    twos = F.array(*[F.lit(signed((1 << i) | (1 << j))).cast("long") for i in range(64) for j in range(i) if i // 32 == j // 32])
    even = fps.filter(F.bit_count("fp") % 2 == 0)
    one = fps.select("fp", F.explode(ones).alias("step"), F.lit(1).alias("far"))
    two = even.select("fp", F.explode(twos).alias("step"), F.lit(2).alias("far"))
    out = even.select("fp", F.lit(0).cast("long").alias("step"), F.lit(0).alias("far")).union(one).union(two)
    variants = out.select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("v"), "far")
    # Of a variant's emitters the smallest near one is the centre; a variant lies within 2 bits of at most 2,081 fingerprints.
    near = F.min(F.when(F.col("far") <= 1, F.col("fp")))
    groups = variants.groupBy("v").agg(near.alias("centre"), F.count("*").alias("n")).filter("n > 1 AND centre IS NOT NULL")
    groups = stored(groups.select(F.col("v").alias("met"), "centre"), "op8-met")
    return variants.join(groups.hint("merge"), F.col("v") == F.col("met")).filter("fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    marked = stored(fingerprints(docs, shingle), "op8-fingerprints")
    first = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "op8-distinct")
    linked = components(links(with_neighbour_in_half(first.select("fp"))).select("a", "b"), "op8-components")
    named = first.join(linked, first.fp == linked.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    roots = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "op8-roots")
    owner = stored(named.join(roots, "root").select(F.col("fp").alias("f"), "component_id"), "op8-owner")
    return marked.join(owner, marked.fp == owner.f).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# --- The near-duplicate stage: five-word shingles, similarity 0.8 ---
#
# Fingerprints within 3 of 64 bits are texts of similarity 0.98 or so: at 0.8 they differ in 10 bits, beyond
# any ball that can be emitted. So the stage takes the pairs the ball hashing finds and looks for the rest
# of the near copies in bands of min-hashes. Texts that share a band are first compared by their odd sketches,
# 128 bytes each; only what sketches or balls connect, a family, sends its shingle sets, once, and is confirmed on
# them. A template that thousands of unlike texts share costs sketches, not sets.

STAGE_SHINGLE, SIMILARITY, BANDS, BAND_ROWS, BLOCK, LOST = 5, 0.8, 24, 4, 4096, 1e-6


def shingle_hashes(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; none for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64) if words else h
    out = np.zeros(n, np.uint64)
    for i in range(shingle):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def band_keys(samples: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(samples[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes(), i) >> 1 for i in range(BANDS)]


def keyed(docs: DataFrame) -> DataFrame:
    """row (all of docs' columns), text, id, and h, a 64-bit hash of the text: copies share it, and so do all texts without a word."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", "row.text", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    return rows.withColumn("h", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))


def marked_texts(rows: DataFrame) -> DataFrame:
    """h, fp (fingerprint), bands (a key a band), sketch (both null without a word), n (size of the shingle set) for each distinct text of rows (h, text)."""

    def run(batches):
        for b in batches:
            known = {}
            for h, t in zip(b.column("h").to_pylist(), b.column("text"), strict=True):
                if h in known:
                    continue
                text = t.as_py()
                s = shingle_hashes(text)
                samples = sketches.min_hashes(s) if len(s) else None
                known[h] = (fingerprint(text, STAGE_SHINGLE), None if samples is None else band_keys(samples), None if samples is None else sketches.odd_sketch(samples).tobytes(), len(s))
            fps, bands, bits, sizes = zip(*known.values(), strict=True) if known else ((),) * 4
            columns = [pa.array(list(known), pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "fp", "bands", "sketch", "n"])

    marked = small_batches(rows).select("h", "text").mapInArrow(run, "h long, fp long, bands array<long>, sketch binary, n long")
    return marked.groupBy("h").agg(*[F.first(c).alias(c) for c in ("fp", "bands", "sketch", "n")])


def shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, s: the shingle sets, packed, of the texts of rows (h, text) that are wanted (h)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([shingle_hashes(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], names=["h", "s"])

    return rows.join(wanted.withColumnRenamed("h", "w"), F.col("h") == F.col("w"), "left_semi").dropDuplicates(["h"]).select("h", "text").mapInArrow(run, "h long, s binary")


def ball_pairs(marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts by the ball hashing: those with one fingerprint, and one for each link of two fingerprints."""
    first = stored(marked.groupBy("fp").agg(F.min("h").alias("h"), F.count("*").alias("n")), "op8-fps")
    found = links(with_neighbour_in_half(first.select("fp")))
    of = lambda name: first.select(F.col("fp").alias(f"{name}_fp"), F.col("h").alias(f"{name}_h"))
    near = found.join(of("x"), F.col("a") == F.col("x_fp")).join(of("y"), F.col("b") == F.col("y_fp")).select(F.col("x_h").alias("a"), F.col("y_h").alias("b"))
    same = marked.select(F.col("h").alias("a"), "fp").join(first.filter("n > 1").select(F.col("fp").alias("x_fp"), F.col("h").alias("b")), F.col("fp") == F.col("x_fp")).select("a", "b")
    return near.union(same).filter("a <> b")


def near_links(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that connect all texts of rows (h, text) whose shingle sets have the similarity or more and share a fingerprint ball or a band.

    24 bands of 4 min-hashes miss 0.0003% of the pairs at exactly 0.8 and their sketches 0.0001%, fewer above; nothing else is
    left out. Groups beyond BLOCK texts are compared in pairs of blocks (link_groups), whatever their size.
    """
    least, most = round(100 * similarity, 6), sketches.most_bits(similarity, lost=LOST)
    marked = stored(marked_texts(rows), "op8-marked")
    keys = marked.filter("n > 0").select("h", F.explode("bands").alias("g"))
    shared = stored(keys.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("g").alias("k")), "op8-shared")
    bits = marked.select(F.col("h").alias("node"), "n", "sketch")
    # Sketches and sets are wide: they are joined by merge at every size, never broadcast.
    met = keys.join(shared.hint("merge"), F.col("g") == F.col("k")).join(bits.hint("merge"), F.col("h") == F.col("node"))
    near = sketches.link_groups(stored(met.select("g", "node", "n", "sketch", F.lit(None).cast("binary").alias("s")), "op8-near"), least, most, "op8-near", BLOCK)
    family = stored(components(near.union(ball_pairs(marked)), "op8-families").select(F.col("node").alias("f"), F.col("component").alias("g")), "op8-family")
    sets = shingle_sets(rows, family.select(F.col("f").alias("h"))).select(F.col("h").alias("j"), "s")
    whole = bits.filter("n > 0").join(family.hint("merge"), F.col("node") == F.col("f")).join(sets.hint("merge"), F.col("node") == F.col("j"))
    return sketches.link_groups(stored(whole.select("g", "node", "n", "sketch", "s"), "op8-sets"), least, most, "op8-sets", BLOCK)


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of copies and near copies: that with the smallest doc_id (rows without one come last), then the smallest text hash.

    Rows are compared by their texts, whatever their ids: a repeated id names as many documents as it has texts. Rows equal
    in doc_id and text are one. Null and empty texts and those without a word are copies of each other. Extra columns pass through.
    """
    rows = keyed(docs)
    linked = components(near_links(rows.select("h", "text"), similarity), "op8-similar").select("node", "component")
    ids = rows.groupBy("h").agg(F.min(F.nullif("id", F.lit(NO_ID))).alias("id"))
    last = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    best = ids.join(linked, F.col("h") == F.col("node"), "left").groupBy(F.coalesce("component", "h").alias("g")).agg(F.min(last).alias("best"))
    best = stored(best.select(F.col("best.h").alias("best_h"), F.coalesce("best.id", F.lit(NO_ID)).alias("best_id")), "op8-kept")
    kept = rows.join(best.hint("merge"), (F.col("h") == F.col("best_h")) & (F.col("id") == F.col("best_id")), "left_semi")
    return kept.dropDuplicates(["h", "id"]).select("row.*")
