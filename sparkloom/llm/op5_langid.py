"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point). A trigram binds its letters'
vectors, rotated by their place, into one by multiplication; a text bundles its trigrams by addition; so
does a language over its training texts. The language whose prototype has the largest cosine with the text's
vector wins, and the cosine (0 at least) is the score.

Bundling is linear, so prototypes come from trigram counts per language that the tasks add up; they are
collected to the driver and broadcast: one vector a language, at most MAX_LANGS of them. Training texts count
equally (their trigram shares are summed).

Texts are lower-cased; letters are what str.isalpha holds for, everything between is one border sign.
Defined results: null texts and those without a letter are ``und`` with score 0. With no learned language all
are ``und``. Ties go to the smaller name. Repeated rows are rows (and weigh as such in training). A null doc_id
is held out of training. Extra columns pass through, but columns of the result's own names (lang_pred, score) are replaced.
An empty table gives no rows. More than MAX_LANGS languages are an error: prototypes are held by every task.
"""

from __future__ import annotations

import re
import sys
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

DIMENSION, MAX_LANGS, UNKNOWN, FLOOR, SHORT, TRAIN_ROWS, MOST_GRAMS = 1024, 1000, "und", 0.2, 64, 1000, 12_000


_OTHER = re.compile(r"[\W\d_]+")


@cache
def _odd_numbers() -> np.ndarray:
    """By code point: whether the pattern takes a sign for a letter though str.isalpha does not (numbers that are no digits, like fractions)."""
    return np.array([c.isalnum() and not c.isalpha() and not c.isdecimal() for c in map(chr, range(sys.maxunicode + 1))])


_CODE = 1 << 21  # code points are below this


@lru_cache(maxsize=50_000)
def letter(code: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(code + 1)).integers(0, 2, DIMENSION, dtype=np.int8) * 2 - 1


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text, as numbers of three code points, and their counts."""
    core = _OTHER.sub(" ", (text or "").lower()).strip(" ")
    if _odd_numbers()[np.frombuffer(core.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
        core = " ".join("".join(" " if _odd_numbers()[ord(x)] else x for x in core).split())
    if not core:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.frombuffer(f" {core} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = (c[:-2] * np.uint64(_CODE) + c[1:-1]) * np.uint64(_CODE) + c[2:]
    return np.unique(grams, return_counts=True)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams, one a row."""
    places = [(grams // np.uint64(_CODE**2)), (grams // np.uint64(_CODE)) % np.uint64(_CODE), grams % np.uint64(_CODE)]
    out = np.ones((len(grams), DIMENSION), np.int8)
    for turn, codes in zip((2, 1, 0), places, strict=True):
        known, at = np.unique(codes, return_inverse=True)
        out *= np.stack([np.roll(letter(int(k)), turn) for k in known])[at]
    return out


def bundle(grams: np.ndarray, weights: np.ndarray, block: int = 2048) -> np.ndarray:
    total = np.zeros(DIMENSION)
    for i in range(0, len(grams), block):
        total += weights[i : i + block].astype(np.float32) @ gram_vectors(grams[i : i + block]).astype(np.float32)
    return total


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all the labelled rows of docs (doc_id, text, lang) that are not held out."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, TRAIN_ROWS):
                b = whole.slice(at, TRAIN_ROWS)
                counts: dict[str, list] = {}
                for i, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("text"), strict=True):
                    if lang is not None and not held_out(i):
                        g, n = trigrams(text.as_py())
                        if len(g):
                            counts.setdefault(lang, []).append((g, n / n.sum()))
                for lang, parts in counts.items():
                    g, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    sums[lang] = sums.get(lang, 0) + bundle(g, np.bincount(of, np.concatenate([p[1] for p in parts])))
                if len(sums) > MAX_LANGS:
                    raise ValueError(f"more than {MAX_LANGS} languages")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = small_batches(docs).select("doc_id", "lang", "text").filter("lang IS NOT NULL").mapInArrow(run, "lang string, v array<double>")
    summed = rows.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v"))
    found = {r.lang: np.array([e.x for e in r.v]) for r in summed.orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return {k: v / np.linalg.norm(v) for k, v in found.items() if np.linalg.norm(v) > 0}


def classify(texts, names: list[str], prototypes: np.ndarray) -> tuple[list[str], list[float], list[int]]:
    """Languages, scores and numbers of distinct trigrams of a batch of texts; the trigram vectors are made once for the batch."""
    grams = [trigrams(t) for t in texts]
    langs, scores, sizes = [UNKNOWN] * len(grams), [0.0] * len(grams), [len(g) for g, _ in grams]
    if not names:
        return langs, scores, sizes
    known = np.unique(np.concatenate([g for g, _ in grams])) if grams else []
    if not len(known):
        return langs, scores, sizes
    vectors = gram_vectors(known).astype(np.float32) if len(known) <= MOST_GRAMS else None
    for i, (g, n) in enumerate(grams):
        if len(g):
            v = n.astype(np.float32) @ vectors[np.searchsorted(known, g)] if vectors is not None else bundle(g, n)
            size = np.linalg.norm(v)
            cos = np.round(prototypes @ v / size, 9) if size else np.zeros(len(names))
            k = int(np.argmax(cos))
            langs[i], scores[i] = names[k], float(min(1.0, max(0.0, cos[k])))
    return langs, scores, sizes


def identify(docs: DataFrame, model: dict[str, np.ndarray], batch: int = 128, sized: str | None = None) -> DataFrame:
    """docs with lang_pred and score; with sized, a column of that name holds the number of distinct trigrams."""
    names = sorted(model)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.stack([model[k] for k in names]) if names else np.empty((0, DIMENSION))))
    own, more = [c for c in docs.columns if c not in ("lang_pred", "score")], [sized] if sized else []

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                langs, scores, sizes = classify((t.as_py() for t in b.column("text")), *shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[pa.array(sizes, pa.int64()) for _ in more]], names=[*own, "lang_pred", "score", *more])

    from pyspark.sql.types import DoubleType, LongType, StringType

    schema = docs.select(*own).schema.add("lang_pred", StringType()).add("score", DoubleType())
    for c in more:
        schema = schema.add(c, LongType())
    return small_batches(docs).select(*own).mapInArrow(run, schema)


def known_language(docs: DataFrame, model: dict[str, np.ndarray], floor: float = FLOOR) -> DataFrame:
    """docs without those that are und or no more like any language than random words of as many distinct trigrams.

    Random words score 0.1 or so at first (three deviations of the vectors' noise) and more the more of a language's
    trigrams they hit: by trial 0.12 at 500 letters, 0.16 at 3,000 and 0.2, the most the limit grows to, at 10,000.
    Under SHORT trigrams texts of a language score no more than random ones: all stay.
    """
    sized = "grams"
    while sized in {c.lower() for c in docs.columns}:  # a column of the caller's own keeps its name
        sized += "_"
    limit = F.least(F.lit(floor), 3 / F.sqrt(F.lit(DIMENSION)) + 0.00106 * F.sqrt(sized))
    kept = (F.col("lang_pred") != UNKNOWN) & ((F.col(sized) < SHORT) | (F.col("score") >= limit))
    return identify(docs, model, sized=sized).filter(kept).select(*docs.columns)


def op5_langid(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0)) == 0).alias("held_out"), "lang_pred", "score")
