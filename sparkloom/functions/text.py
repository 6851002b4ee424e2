"""Column functions: normal form, counts, slugs, hashes, tokens, formats, titles."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text counts it (the patterns' plain class is ASCII only).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"(?U)[^\s\x1c-\x1f]+"
TOKEN = r"[\p{L}\p{N}_]+"
#: The words keywords leave out.
STOP_WORDS = ("should", "would", "could", "which", "what", "when", "where", "there", "their", "about")


def strip(col: Column) -> Column:
    """Without white space at either end; looks at the ends only."""
    return F.btrim(col, F.lit(BLANKS))


def normalize_text(col: Column) -> Column:
    """Line ends to LF, three or more of them to two, trimmed."""
    lf = F.regexp_replace(col, r"\r\n?", "\n")
    return strip(F.regexp_replace(lf, r"\n{3,}", "\n\n"))


def repair_headings(col: Column) -> Column:
    """Heading levels may rise by one at most over the heading before."""
    line = r"^(#{1,6})\s+(.*)$"
    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, text: Column) -> Column:
        marks = F.length(F.regexp_extract(text, line, 1))
        level = F.when((state.level > 0) & (marks > state.level + 1), state.level + 1).otherwise(marks)
        fixed = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.regexp_extract(text, line, 2))
        return F.struct(F.when(marks > 0, level).otherwise(state.level).alias("level"), F.array_append(state.out, F.when(marks > 0, fixed).otherwise(text)).alias("out"))

    repaired = F.aggregate(F.split(col, "\n"), start, step, lambda s: F.array_join(s.out, "\n"))
    return F.when(col.rlike(r"(?m)^#{1,6}\s+"), repaired).otherwise(col)


def normalize_body(col: Column) -> Column:
    return let(normalize_text(col), repair_headings)


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def count_words(col: Column) -> Column:
    return F.size(words(col))


def count_headings(col: Column) -> Column:
    return F.size(F.regexp_extract_all(col, F.lit(r"(?m)^#{1,6}\s+"), F.lit(0)))


def fingerprint(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def content_hash(col: Column) -> Column:
    return fingerprint(strip(col))


def doc_id(source_id: Column, boundary: str = "default") -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat(source_id, F.lit(f":{boundary}")), 256), 1, 16))


def chunk_id(doc: Column, path: Column, embed_text: Column, index: Column, level: str) -> Column:
    payload = F.concat_ws("|", doc, path, content_hash(embed_text), index.cast("string"), F.lit(level))
    return F.concat(F.lit("chk_"), F.substring(F.sha2(payload, 256), 1, 20))


def slugify_heading(col: Column) -> Column:
    kept = F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_\s-]", "")
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(kept, r"[\s_-]+", "-"), F.lit("-")), F.lit("")), F.lit("section"))


def slugify(col: Column, size: int = 60) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "-"), F.lit("-")), 1, size)


def tokenize(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


#: Characters on whose class no Unicode versions in use differ; one of them is not.
_UNSETTLED = re.compile("[^\\x00-\u07ff\u2000-\u2bff\u3000-\u30ff\u3400-\u9fea\uac00-\ud7a3]")
_WORDS = re.compile(r"\w+")
_patterns: dict[str, str] = {}


def python_token(spark) -> str:
    """TOKEN as a pattern for Python: its word characters, but for those on which the two Unicode versions differ."""
    version = spark._jvm.java.lang.System.getProperty("java.version")
    if version not in _patterns:
        mine = {c for c in range(0x800, sys.maxunicode + 1) if chr(c).isalnum()}
        sign = F.decode(F.unhex(F.lpad(F.hex("id"), 8, F.lit("0"))), "UTF-32")
        its = set(spark.range(0x800, max(mine) + 0x1000).filter("id NOT BETWEEN 55296 AND 57343").filter(sign.rlike(f"^{TOKEN}$")).toArrow()["id"].to_pylist())
        few = lambda codes: "".join(re.escape(chr(c)) for c in sorted(codes))
        _patterns[version] = rf"(?:[^\W{few(mine - its)}]" + (f"|[{few(its - mine)}])+" if its - mine else ")+")
    return _patterns[version]


#: For ASCII: a blank for each sign that is no word character.
_BLANKED = "".join(chr(c) if chr(c).isalnum() or chr(c) == "_" else " " for c in range(128))


def python_words(text: str) -> list[str]:
    """The runs of word characters as Python has them."""
    return text.translate(_BLANKED).split() if text.isascii() else _WORDS.findall(text)


def python_tokens(text: str, token: str) -> list[str]:
    """The tokens of a text that Spark has lower-cased, as tokenize gives them; token: python_token."""
    return re.compile(token).findall(text) if not text.isascii() and _UNSETTLED.search(text) else python_words(text)


def extract_keywords(col: Column, most: int = 12) -> Column:
    found = F.regexp_extract_all(F.lower(col), F.lit("[a-zA-Z]{4,}"), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)), 1, most)


def let(value: Column, use) -> Column:
    """use(value) with value computed once, also where use reads it often or inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_by_tokens(col: Column, size: int, overlap: int = 0) -> Column:
    """Windows of size words, each starting size - overlap words after the last; a short text as it is."""
    step = size - overlap

    def cut(ws: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(ws) - size) / F.lit(float(step)))).cast("int")
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(ws, i * step + 1, F.lit(size)), " "))
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).when(F.size(ws) <= size, F.array(strip(col))).otherwise(windows)

    return let(words(col), cut)


def detect_format(path: Column, content: Column) -> Column:
    """By suffix, else by the first bytes; txt where nothing tells."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    # Formats by suffix, and by the first bytes below.
    known = {"md": "markdown", "markdown": "markdown", "txt": "txt", "pdf": "pdf", "docx": "docx", "html": "html", "htm": "html"}
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    by_suffix = F.lit(None).cast("string")
    for s, f in known.items():
        by_suffix = F.when(suffix == s, F.lit(f)).otherwise(by_suffix)
    start = F.lower(F.ltrim(head))
    by_bytes = (
        F.when(head.startswith("%PDF"), "pdf")
        .when(head.startswith("PK") & head.contains("word/"), "docx")
        .when(start.startswith("<!doctype") | start.startswith("<html"), "html")
        .when(head.startswith("---") | head.startswith("#"), "markdown")
        .otherwise("txt")
    )
    return F.coalesce(by_suffix, by_bytes)


def extraction_quality(body: Column, fmt: Column) -> Column:
    size = F.length(strip(F.coalesce(body, F.lit(""))))
    return F.when(size == 0, "failed").when((fmt == "html") & (size <= 50), "degraded").when((fmt == "pdf") & (size < 100), "degraded").otherwise("full")
