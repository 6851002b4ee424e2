"""MinHash near-duplicates with odd sketches.

A text's set is its distinct five-word shingles. SAMPLES min-hashes are drawn of every set; BANDS bands of ROWS of them name
the buckets in which texts may meet, and all of them are folded into an odd sketch: each sample flips one of BITS bits. The
bits in which two sketches differ count the samples that differ, which tells similarities near the threshold apart far
better than bands do. A pair whose sketches differ in more bits than MOST cannot be similar enough (but for one in 10^9 of
the pairs right at the threshold); only what passes is confirmed on whole sets.

Links are found in groups, first among sketches, then among sets:

1. Distinct sets (copies are one) that share a bucket are compared by sketch. Each task gives back only the links that
   join its part of a bucket, so a group of thousands of near copies gives thousands of links and not millions of pairs.
2. What sketches connect is a family. A family's sets travel together, once, and are compared whole where sketches allow it.

A group that is too large for a task is dealt into blocks twice, by two hashes; what that leaves apart in a group then
meets the whole group in pairs of blocks (link_groups). No pair that shares a band is left out.

Words are runs of other than ASCII white space after lower-casing A-Z. Defined results: texts with fewer than five words
are one shingle; null texts and those without a word have an empty set and link to nothing. Repeated rows are rows. A null
doc_id gets a row; a group's smallest non-null id names it, and where there is none component_id is null and all of the
group is kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, stored, table

SHINGLE, LEAST, SAMPLES, BANDS, ROWS, BITS = 5, 85, 512, 24, 5, 1024
#: Texts of a block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 4096, 48_000_000
_rng = np.random.default_rng(12)
_TIMES, _PLUS = (_rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The rising distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = (ends - size)[:n]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(line[a:z]) for a, z in zip(starts.tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n))


def min_hashes(shingles: np.ndarray, block: int = 64) -> np.ndarray:
    """The smallest of SAMPLES hashes of a set; a block of shingles at a time stays in the cache."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for i in range(0, len(low), block):
        x = low[i : i + block, None] * _TIMES
        x += _PLUS
        np.minimum(best, x.min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(samples[i * ROWS : (i + 1) * ROWS].tobytes(), i) >> 1 for i in range(BANDS)]


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit words: bit j is the parity of the number of samples that fall on it."""
    x = (samples.astype(np.uint64) << np.uint64(32)) | np.arange(len(samples), dtype=np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    odd = np.bincount((x >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def most_bits(least: float, samples: int = SAMPLES, bits: int = BITS, lost: float = 1e-9) -> int:
    """The number of bits that sketches of sets with this similarity exceed with a probability under lost."""
    size = np.arange(bits + 1)
    differ = np.zeros(samples + 1)  # probability that so many samples differ
    differ[0] = 1
    for _ in range(samples):
        differ[1:] = differ[1:] * least + differ[:-1] * (1 - least)
        differ[0] *= least
    state, total = np.zeros(bits + 1), np.zeros(bits + 1)
    state[0] = 1
    for n in range(samples + 1):
        total += differ[n] * state
        for _ in range(2):  # a sample that differs flips a bit of either sketch
            up, down = state * (1 - size / bits), state * (size / bits)
            state = np.concatenate(([0], up[:-1])) + np.concatenate((down[1:], [0]))
    return int(np.flatnonzero(total[::-1].cumsum()[::-1] < lost)[0])


def estimate(differing: np.ndarray, samples: int = SAMPLES, bits: int = BITS) -> np.ndarray:
    """The similarity that so many differing bits of two sketches suggest."""
    return 1 + bits * np.log(np.maximum(1 - 2 * differing / bits, 1e-9)) / (4 * samples)


# --- Rows

MARKED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(12), "text").alias("t2"))


def marked(docs: DataFrame) -> DataFrame:
    """A number uid for every row of docs, its text's hashes t1 and t2, its set's h1 and h2 and size n, its bands and its sketch."""

    def run(batches):
        uid, known = TaskContext.get().partitionId() << 40, {}
        for b in batches:
            rows, last = [], known
            known = {}
            for i, text, t1, t2 in zip(*(b.column(c) for c in ("doc_id", "text", "t1", "t2")), strict=True):
                uid += 1
                of = (t1.as_py(), t2.as_py())
                mark = known.get(of) or last.get(of)
                if mark is None:
                    s = shingle_set(text.as_py())
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                    samples = min_hashes(s)
                    mark = (*digest, len(s), *((band_keys(samples), odd_sketch(samples).tobytes()) if len(s) else (None, None)))
                known[of] = mark
                rows.append((uid, i.as_py(), *of, *mark))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(MARKED)], schema=MARKED)

    kinds = "uid long, doc_id long, t1 long, t2 long, h1 long, h2 long, n long, bands array<long>, sketch binary"
    return small_batches(keyed(docs)).select("doc_id", "text", "t1", "t2").mapInArrow(run, kinds)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and s, the packed set, for the rows of wanted (node, t1, t2): their texts are read again."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], names=["node", "s"])

    # Copies of a wanted text go before the join: one hash for each text is enough.
    texts = keyed(docs).select("text", F.col("t1").alias("x1"), F.col("t2").alias("x2"))
    met = texts.join(wanted, (F.col("x1") == F.col("t1")) & (F.col("x2") == F.col("t2"))).groupBy("node").agg(F.first("text").alias("text"))
    return small_batches(met, 200).select("node", "text").mapInArrow(run, "node long, s binary")


# --- Links


def _linked(rows: list[tuple], least: int, most: int) -> list[tuple[int, int]]:
    """Links (a, b) that join what is similar in one meeting of rows (node, part, side, n, sketch, s).

    Rows of side 0 meet those of side 1, rows of side 2 all. Two rows of one part, or of parts that a link has joined, meet no
    more. With sets (s) a pair is confirmed on them, without the sketches decide.
    """
    node, size = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    side = np.array([r[2] for r in rows])
    part = np.unique([r[1] for r in rows], return_inverse=True)[1]
    sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
    sets = [np.frombuffer(r[5], np.uint64) for r in rows] if rows[0][5] is not None else None
    found = []
    for i in np.flatnonzero(side != 1).tolist():
        at = np.flatnonzero((part != part[i]) & (side > 0) & (100 * np.minimum(size, size[i]) >= least * np.maximum(size, size[i])))
        if not len(at):
            continue
        differ = np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1)
        at = at[np.argsort(differ, kind="stable")[: int((differ <= most).sum())]]
        # The nearest first, a few at a time: parts that a link joins need no further test.
        while len(at):
            some, at = at[:64], at[64:]
            if sets:
                mine, joined = sets[i], np.concatenate([sets[j] for j in some])
                place = np.minimum(np.searchsorted(mine, joined), len(mine) - 1)
                ends = np.cumsum(size[some])
                both = np.diff(np.cumsum(mine[place] == joined)[ends - 1], prepend=0)
                some = some[100 * both >= least * (size[some] + size[i] - both)]
            for j in some:
                if part[j] != part[i]:
                    found.append((max(node[i], node[j]), min(node[i], node[j])))
                    part[part == part[j]] = part[i]
            at = at[part[at] != part[i]]
    return found


def _meetings(least: int, most: int):
    def run(batches):
        group, held = None, []
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("g", "x", "y", "node", "part", "side", "n", "sketch", "s")), strict=True):
                if row[:3] != group:
                    if len(held) > 1:
                        out += _linked(held, least, most)
                    group, held = row[:3], []
                held.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out = _linked(held, least, most) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def link_groups(rows: DataFrame, least: int, most: int, tag: str, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that connect all that is similar inside the groups g of rows (g, node, n, sketch, s), n the size of a set, s the set or null.

    A group of one block is compared whole in one task. Larger groups are dealt into blocks by one hash and then by another. What
    these links leave apart in a group meets all of it: texts outside the group's largest part, in blocks, with blocks of the
    whole group, one meeting a task.
    """
    run = _meetings(least, most)
    weight = F.coalesce(F.octet_length("s"), F.lit(0)).cast("long") + F.octet_length("sketch")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum(weight) / F.lit(block_bytes))).cast("int")
    groups = stored(rows.groupBy("g").agg(F.count("*").alias("m"), blocks.alias("blocks")).filter("m > 1"), f"{tag}-sizes").select(F.col("g").alias("of"), "blocks")

    def met(df: DataFrame) -> DataFrame:
        keys = ["g", "x", "y"]
        out = small_batches(df, 200).select(*keys, "node", "part", F.col("side").cast("int").alias("side"), "n", "sketch", "s")
        return out.repartition(*keys).sortWithinPartitions(*keys, "node", "side").mapInArrow(run, "a long, b long")

    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
    all_ = rows.join(groups.hint("merge"), F.col("g") == F.col("of"))
    whole = all_.withColumns({"part": F.col("node"), "side": F.lit(2), "x": deal(1, F.col("blocks")), "y": F.lit(0)})
    links = stored(met(whole), f"{tag}-links")
    if groups.filter("blocks > 1").isEmpty():
        return links
    large = all_.filter("blocks > 1")
    parted = lambda links: _with_parts(large, components(links, f"{tag}-parts"))
    again = parted(links).withColumns({"side": F.lit(2), "x": deal(2, F.col("blocks")), "y": F.lit(1)})
    links = stored(links.union(met(again)), f"{tag}-links")
    known = stored(parted(links).select("g", "node", "part", "blocks"), f"{tag}-known")
    sizes = known.groupBy("g", "part", "blocks").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("g", "blocks").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.sum("m").alias("m"), F.max("m").alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    few = F.ceil((F.col("m") - F.col("most")) * F.col("blocks") / F.col("m")).cast("int")
    mixed = stored(mixed.select(F.col("g").alias("mg"), "main", few.alias("few")), f"{tag}-mixed")
    if mixed.isEmpty():
        return links
    left = known.select(F.col("g").alias("kg"), F.col("node").alias("kn"), "part").join(mixed.hint("merge"), F.col("kg") == F.col("mg"))
    rest = large.join(left.hint("merge"), (F.col("g") == F.col("kg")) & (F.col("node") == F.col("kn")))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["g", "node", "part", "n", "sketch", "s"]
    every = rest.select(*columns, each(F.col("few")).alias("x"), deal(3, F.col("blocks")).alias("y"), F.lit(1).alias("side"))
    outside = rest.filter("part <> main").select(*columns, deal(4, F.col("few")).alias("x"), each(F.col("blocks")).alias("y"), F.lit(0).alias("side"))
    return links.union(met(every.union(outside)))


def _with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    named = parts.select(F.col("node").alias("p"), "component")
    return rows.join(named, F.col("node") == F.col("p"), "left").withColumn("part", F.coalesce("component", "node")).drop("p", "component")


def near_duplicates(docs: DataFrame, least: int = LEAST, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text); least: the similarity of links in hundredths."""
    most = most_bits(least / 100)
    rows = stored(marked(docs), "op12-marked")
    first = [F.first(c).alias(c) for c in ("n", "bands", "sketch", "t1", "t2")]
    classes = stored(rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("first"), *first), "op12-classes")

    keys = classes.select("node", F.explode("bands").alias("g"))
    shared = keys.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("g").alias("k"))
    met = keys.join(stored(shared, "op12-shared").hint("merge"), F.col("g") == F.col("k")).select("g", "node")
    sketches = classes.select(F.col("node").alias("i"), "n", "sketch")
    near = met.join(sketches.hint("merge"), F.col("node") == F.col("i")).select("g", "node", "n", "sketch", F.lit(None).cast("binary").alias("s"))
    near = stored(near, "op12-near")
    family = components(link_groups(near, least, most, "op12-near", block, block_bytes), "op12-families").select(F.col("node").alias("f"), F.col("component").alias("g"))
    family = stored(family, "op12-family")
    wanted = classes.join(family.hint("merge"), F.col("node") == F.col("f"))
    sets = sets_of(docs, wanted.select("node", "t1", "t2")).select(F.col("node").alias("j"), "s")
    whole = stored(wanted.select("g", "node", "n", "sketch").join(sets.hint("merge"), F.col("node") == F.col("j")).drop("j"), "op12-sets")
    found = components(link_groups(whole, least, most, "op12-sets", block, block_bytes), "op12-components").select(F.col("node").alias("c"), "component")

    named = classes.select("h1", "h2", "node", "first").join(found, F.col("node") == F.col("c"), "left").select("h1", "h2", F.coalesce("component", "node").alias("root"), "first")
    named = stored(named, "op12-named")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    owner = stored(named.join(ids, F.col("root") == F.col("r")).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "component_id"), "op12-owner")
    out = rows.select("doc_id", "n", "h1", "h2").join(owner, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_odd_sketch(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, doc_id) AS component_id, coalesce(m.c, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
