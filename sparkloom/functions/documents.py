"""Extraction, outlines and two-level chunks of documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import small_batches
from . import text as tx

TITLE_SIZE = 120


def extract_text(docs: DataFrame, stem: Column) -> DataFrame:
    """docs (text) with title and body: a short first line is the title and leaves the body."""
    others = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    # Blank lines leave below, so a CR LF may cut twice; most texts have line feeds alone, which need no pattern.
    cut = lambda whole: F.when(reduce(lambda a, b: a | b, [F.contains(whole, F.lit(c)) for c in others]), F.split(whole, f"[\n{others}]")).otherwise(F.split(whole, "\n"))

    def parts(whole: Column, lines: Column) -> Column:
        first = F.get(lines, F.lit(0))
        short = F.coalesce(F.length(first) < TITLE_SIZE, F.lit(False))
        body = F.when(short & (F.size(lines) > 1), F.array_join(F.slice(lines, 2, F.size(lines)), "\n\n")).otherwise(whole)
        return F.struct(F.when(short, first).alias("title"), body.alias("body"))

    found = tx.let(tx.strip(F.coalesce(F.col("text"), F.lit(""))), lambda whole: tx.let(F.filter(cut(whole), lambda x: tx.strip(x) != ""), lambda lines: parts(whole, lines)))
    return docs.withColumn("_x", found).withColumns({"title": F.coalesce("_x.title", stem), "body": F.col("_x.body")}).drop("_x")


def extract_markdown(docs: DataFrame, stem: Column) -> DataFrame:
    """docs (text) with title, language and body: flat front matter first, then the first top heading, then the stem."""
    front = r"(?s)^---[^\S\n]*\n(.*?)\n---[^\S\n]*\n"
    matter = F.regexp_extract("text", front, 1)
    body = F.regexp_replace("text", front, "")
    value = lambda key: F.nullif(F.btrim(F.regexp_extract(matter, rf"(?m)^{key}:[^\S\n]*(.+)$", 1), F.lit(" \"'")), F.lit(""))
    heading = F.nullif(tx.strip(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return docs.withColumns({"title": F.coalesce(value("title"), heading, stem), "language": F.coalesce(value("language"), F.lit("en")), "body": tx.strip(body)})


class _Text(HTMLParser):
    """The readable text of a page as Markdown blocks, gathered for the page, its body, article and main."""

    # The tags that are left out, and those that begin a block.
    SKIP = {"script", "style", "nav", "footer", "header", "noscript", "head"}
    BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "br", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = {"page": [], "body": [], "article": [], "main": []}
        self.open = dict.fromkeys(self.out, 0) | {"page": 1}
        self.skipped, self.title, self.in_title = 0, "", False

    def put(self, text: str) -> None:
        for k, parts in self.out.items():
            if self.open[k]:
                parts.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag in self.SKIP:
            self.skipped += 1
        elif tag in self.open:
            self.open[tag] += 1
        if tag in self.BLOCK and not self.skipped:
            self.put("\n\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.BLOCK and not self.skipped:
            self.put("\n\n")
        if tag in self.open and self.open[tag] and tag != "page":
            self.open[tag] -= 1

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skipped:
            self.put(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        best = next((p for k in ("main", "article", "body", "page") if (p := "".join(self.out[k]).strip())), "")
        return re.sub(r"\s*\n\s*\n\s*", "\n\n", best).strip()


def html_to_text(html: str | None) -> tuple[str | None, str]:
    """Title (null without one) and text of a page."""
    page = _Text()
    page.feed(html or "")
    page.close()
    return page.title.strip() or None, page.text()


@dataclass
class _Block:
    """An open block: its tag, the blocks closed inside it, the text since the last of them, and what belongs to its kind."""

    tag: str
    blocks: list[str] = field(default_factory=list)
    inline: str = ""
    rows: list[list[str]] = field(default_factory=list)
    number: int = 0


class _Markdown(HTMLParser):
    """A page as Markdown by a stack of open blocks: links, emphasis, code, images, lists in lists, quotes, tables and pre keep their form."""

    # The tags of HTML by what becomes of them.
    SKIP = frozenset("script style nav footer header noscript head".split())
    PLAIN = frozenset("html body main article section div p dl dt dd figure figcaption form fieldset address details summary aside tbody thead tfoot caption".split())
    HEAD = frozenset("h1 h2 h3 h4 h5 h6".split())
    OTHER = frozenset("ul ol li blockquote pre table tr td th".split())
    MARK = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`", "tt": "`", "del": "~~", "s": "~~"}
    #: A tag whose end may be left out ends where one of these begins, unless a block of the third kind lies between.
    ENDS = {"p": (PLAIN | HEAD | OTHER, frozenset()), "li": (frozenset({"li"}), frozenset({"ul", "ol"})), "tr": (frozenset({"tr", "tbody", "tfoot"}), frozenset({"table"})), "td": (frozenset({"td", "th", "tr"}), frozenset({"table"})), "th": (frozenset({"td", "th", "tr"}), frozenset({"table"}))}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.marks = [_Block("page")], []
        self.skipped, self.in_title, self.title = 0, False, ""
        self.found: dict[str, str] = {}

    # What is open

    def flush(self) -> None:
        top = self.stack[-1]
        if top.tag == "pre":
            return
        text = re.sub(r" *\n *", "  \n", top.inline.replace("  \n", "\n")).strip()
        if text:
            top.blocks.append(text)
        top.inline = ""

    def push(self, tag: str) -> None:
        while (ends := self.ENDS.get(self.stack[-1].tag)) and tag in ends[0]:
            self.pop()
        for k, (starts, between) in self.ENDS.items():
            if tag in starts and k != "p":
                above = [b.tag for b in self.stack]
                at = max((i for i, t in enumerate(above) if t == k), default=-1)
                if at > 0 and not between & set(above[at + 1 :]):
                    while len(self.stack) > at:
                        self.pop()
        self.flush()
        self.stack.append(_Block(tag))

    def pop(self) -> None:
        self.flush()
        block = self.stack.pop()
        self.marks = [m for m in self.marks if m[0] is not block]
        above = self.stack[-1]
        text = "\n\n".join(block.blocks)
        if block.tag in ("main", "article", "body") and text and block.tag not in self.found:
            self.found[block.tag] = text
        if block.tag in self.HEAD:
            text = f"{'#' * int(block.tag[1])} {' '.join(text.split())}" if text else ""
        elif block.tag == "pre":
            text = "\n".join(f"    {x}".rstrip() for x in block.inline.strip("\n").split("\n")) if block.inline.strip() else ""
        elif block.tag == "blockquote":
            text = "\n".join(f"> {x}".rstrip() for x in text.split("\n")) if text else ""
        elif block.tag in ("ul", "ol"):
            text = "\n".join(f"  {x}" if x else "" for x in "\n".join(block.blocks).split("\n")) if block.blocks else ""
        elif block.tag == "li":
            above.number += 1
            mark = f"{above.number}. " if above.tag == "ol" else "* "
            # Lists in an item are indented by themselves, all else after the first line by its mark.
            inner = [x if re.match(r"  (\* |\d+\. )", x) else "\n".join(f"  {y}" for y in x.split("\n")) for x in block.blocks]
            text = mark + "\n".join(inner).removeprefix("  ") if inner else ""
        elif block.tag in ("td", "th"):
            row = next((b for b in reversed(self.stack) if b.tag == "tr"), None)
            if row is not None:
                row.rows = row.rows or [[]]
                row.rows[0].append(" ".join(text.split()))
                return
        elif block.tag == "tr":
            table = next((b for b in reversed(self.stack) if b.tag == "table"), None)
            if table is not None and block.rows:
                table.rows.append(block.rows[0])
                return
        elif block.tag == "table" and block.rows:
            lines = [" | ".join(r) for r in block.rows]
            lines.insert(1, "|".join(["---"] * len(block.rows[0])))
            text = "\n\n".join([*([text] if text else []), "\n".join(lines)])
        if text:
            above.blocks.append(text)

    # What comes

    def handle_starttag(self, tag, attrs):
        values, top = dict(attrs), self.stack[-1]
        if tag == "title":
            self.in_title = True
        elif tag in self.SKIP:
            self.skipped += 1
        elif self.skipped:
            return
        elif tag in self.PLAIN or tag in self.HEAD or tag in self.OTHER:
            self.push(tag)
        elif tag == "br":
            top.inline += "\n"
        elif tag == "hr":
            self.flush()
            top.blocks.append("* * *")
        elif tag == "img":
            top.inline += f"![{values.get('alt') or ''}]({values.get('src') or ''})" if values.get("src") else values.get("alt") or ""
        elif tag == "a" or tag in self.MARK and top.tag != "pre":
            self.marks.append((top, tag, len(top.inline), values.get("href")))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif any(b.tag == tag for b in self.stack[1:]):
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()
        else:
            self.mark(tag)

    def mark(self, tag: str) -> None:
        """Put the text since an inline tag opened between its marks; what a block has ended in between stays as it is."""
        top = self.stack[-1]
        for i in range(len(self.marks) - 1, -1, -1):
            block, name, at, href = self.marks[i]
            if name == tag:
                del self.marks[i:]
                inner = top.inline[at:] if block is top else ""
                text = inner.strip()
                if text and (tag != "a" or href):
                    before, after = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
                    done = f"[{text}]({href})" if tag == "a" else f"{self.MARK[tag]}{text}{self.MARK[tag]}"
                    top.inline = top.inline[:at] + before + done + after
                return

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skipped:
            top = self.stack[-1]
            if any(b.tag == "pre" for b in self.stack):
                top.inline += data
            elif top.tag not in ("ul", "ol", "table", "tr") or data.strip():
                text = re.sub(r"\s+", " ", data)
                top.inline += text[1:] if text[:1] == " " and top.inline[-1:] in ("", " ", "\n") else text

    def text(self) -> str:
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        whole = "\n\n".join(self.stack[0].blocks)
        return next((t for k in ("main", "article", "body") if (t := self.found.get(k))), whole).strip("\n")


def html_to_markdown(html: str | None) -> tuple[str | None, str]:
    """Title (null without one) and Markdown of a page's main part, else its article, its body, or all of it."""
    page = _Markdown()
    page.feed(html or "")
    page.close()
    return page.title.strip() or None, page.text()


def extract_html(pages: DataFrame, markdown: bool = True) -> DataFrame:
    """page_id, title, body, quality of pages (page_id, url, html); bodies are Markdown with links, lists, tables and code, or plain text."""
    convert = html_to_markdown if markdown else html_to_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [convert(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "title": [t for t, _ in got], "body": [x for _, x in got]})

    out = small_batches(pages).select("page_id", "html").mapInPandas(run, "page_id long, title string, body string")
    return out.withColumn("quality", tx.extraction_quality(F.col("body"), F.lit("html")))


Extractor = Callable[[pd.DataFrame], pd.DataFrame]
_extractors: dict[str, Extractor] = {}


def register_extractor(fmt: str, fn: Extractor) -> None:
    """A caller's function for a format: a frame (uri, content) to a frame (uri, title, body)."""
    _extractors[fmt] = fn


def unregister_extractor(fmt: str) -> None:
    _extractors.pop(fmt, None)


def registered() -> dict[str, Extractor]:
    """The extractors that register_extractor has been given in this process."""
    return dict(_extractors)


def _each_file(fn: Extractor):
    """fn for a batch of files; if it fails, for each file alone, and a file it fails on has an empty body."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return fn(frame)[["uri", "title", "body"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield one(b)
            except Exception:  # whatever a caller's function raises
                for i in range(len(b)):
                    try:
                        yield one(b.iloc[i : i + 1].reset_index(drop=True))
                    except Exception:
                        yield pd.DataFrame({"uri": [b["uri"].iloc[i]], "title": [None], "body": [""]})

    return run


def extract_registered(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """uri, format, title, body, quality of files (uri, format, content) whose format has an extractor, by default a registered one.

    A file its extractor fails on has the quality failed; the others of its batch are extracted.
    """
    schema, out = "uri string, title string, body string", None
    for fmt, fn in sorted((registered() if extractors is None else extractors).items()):
        part = small_batches(files).filter(F.col("format") == fmt).select("uri", "content")
        got = part.mapInPandas(_each_file(fn), schema).withColumn("format", F.lit(fmt))
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = files.sparkSession.createDataFrame([], f"{schema}, format string")
    return out.withColumn("quality", tx.extraction_quality(F.col("body"), F.col("format")))


# --- Outlines and chunks

#: How a heading and a fenced block look.
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)
FENCE = re.compile(r"^```.*?^```", re.MULTILINE | re.DOTALL)
_TOKEN = re.compile(rf"(?:{FENCE.pattern}|\S)+", re.MULTILINE | re.DOTALL)


@dataclass(frozen=True)
class Chunking:
    """Sizes in words: child windows with their overlap, parents, and the least a child of several may have."""

    size: int = 512
    overlap: int = 64
    parent_size: int = 2048
    least: int = 32
    keep_preamble: bool = False  # text before the first heading as a section of its own; else it is lost


def _slug(title: str) -> str:
    return re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", title.lower())).strip("-") or "section"


def sections(body: str, keep_preamble: bool = False) -> list[tuple[str, str, str, int, int]]:
    """(heading path, title, text, start, end) of the sections with text; a body without headings is one section."""
    heads = [(len(h[1]), h[2].strip(), h.start(), h.end()) for h in HEADING.finditer(body)] if "#" in body else []
    paths: list[str | None] = [None] * 7  # the path of the open section of each level
    spans = [] if heads and not keep_preamble else [("content", "content", 0, heads[0][2] if heads else len(body))]
    for (level, title, _, start), end in zip(heads, [*(h[2] for h in heads), len(body)][1:], strict=True):
        above = next((p for p in reversed(paths[:level]) if p is not None), None)
        path = _slug(title) if above is None else f"{above}/{_slug(title)}"
        paths[level:] = [path] + [None] * (6 - level)
        spans.append((path, title, start, end))
    return [(path, title, text, a, z) for path, title, a, z in spans if (text := body[a:z].strip()) or not heads]


def windows(text: str, size: int, overlap: int = 0) -> list[str]:
    """Windows of size words, each size - overlap words after the last; a fenced block is one word. A short text stays as it is."""
    return [part for part, _ in _windows(text, text.split(), size, overlap)]


def _windows(text: str, words: list[str], size: int, overlap: int = 0) -> list[tuple[str, list[str]]]:
    """The windows of a text, whose words are given, each with its words: a text is split once, whatever is cut out of it."""
    fenced = "```" in text
    tokens = _TOKEN.findall(text) if fenced else words
    if len(tokens) <= size:
        return [(text.strip(), words)] if tokens else []
    parts = [(" ".join(t), t) for a in range(0, len(tokens) - overlap, size - overlap) if (t := tokens[a : a + size])]
    return [(part, part.split()) for part, _ in parts] if fenced else parts


_SECTION = "heading_path string, section_title string, section string, start_offset long, end_offset long"


def parse_outline(docs: DataFrame, keep_preamble: bool = False) -> DataFrame:
    """One row a section of docs (doc_id, body, ...): doc_id, section_index and the section."""

    def run(batches):
        for b in batches:
            rows = [(d, i, *s) for d, body in zip(b["doc_id"], b["body"], strict=True) for i, s in enumerate(sections(body or "", keep_preamble))]
            yield pd.DataFrame(rows, columns=["doc_id", "section_index", "heading_path", "section_title", "section", "start_offset", "end_offset"])

    return small_batches(docs).select("doc_id", "body").mapInPandas(run, f"doc_id string, section_index long, {_SECTION}")


CHUNKS = (
    "chunk_id string, doc_id string, source_id string, chunk_level string, parent_chunk_id string, chunk_index int, heading_path string, title string, "
    "token_count int, char_count int, content_hash string, embed_text string, body_text string, start_offset long, end_offset long"
)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def chunks_of(doc_id: str, source_id: str, title: str | None, body: str, how: Chunking) -> Iterator[tuple]:
    """The chunk rows of a document: each parent, then its children; both levels are numbered over the document."""
    count = {"parent": 0, "child": 0}

    def said(path: str, text: str) -> tuple[str, str]:
        embed = f"Document: {title or ''} > {path}\n\n{text}"
        return "sha256:" + _sha(embed.strip()), embed

    def row(level: str, path: str, text: str, words: list[str], up: str | None, span: tuple[int, int], content: str, embed: str) -> tuple:
        index = count[level]
        count[level] += 1
        chunk_id = "chk_" + _sha("|".join((doc_id, path, content, str(index), level)))[:20]
        return chunk_id, doc_id, source_id, level, up, index, path, title, len(words), len(text), content, embed, text, *span

    for path, _, inner, *span in sections(body, how.keep_preamble):
        for text, words in _windows(inner, inner.split(), how.parent_size):
            whole = said(path, text)
            parent = row("parent", path, text, words, None, span, *whole)
            yield parent
            parts = _windows(text, words, how.size, how.overlap) or [(text, words)]
            for part, its in parts:
                if len(parts) == 1 or len(its) >= how.least:
                    yield row("child", path, part, its, parent[0], span, *(whole if part == text else said(path, part)))


def chunk_documents(docs: DataFrame, how: Chunking = Chunking(), rows: int = 2000) -> DataFrame:
    """Parent and child chunks of docs (doc_id, source_id, title, body).

    A document's chunks are made whole by one Arrow function, so running numbers need no window and nothing is shuffled;
    it yields every so many rows, whatever the documents' lengths. A null title reads as empty; a null body has no chunks.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CHUNKS.split(", ")])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for doc in zip(*((x.as_py() for x in b.column(c)) for c in ("doc_id", "source_id", "title", "body")), strict=True):
                if doc[0] is None or doc[3] is None:  # asked here: a filter would make Spark work the texts out twice
                    continue
                for chunk in chunks_of(*doc, how):
                    held.append(chunk)
                    if len(held) >= rows:
                        yield _batch(held)
                        held = []
        yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(schema.types)], names=names)

    return small_batches(docs).select("doc_id", "source_id", "title", "body").mapInArrow(run, CHUNKS)
