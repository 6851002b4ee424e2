"""Text, extraction, outlines, chunks, sources and the inbox stream."""

import datetime
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import documents as dx
from sparkloom.functions import text as tx
from sparkloom.sources import tables as src
from sparkloom.streaming import jobs as st


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\r\nb\rc", "a\nb\nc"),
        ("a\n\n\n\nb\n", "a\n\nb"),
        ("# A\n#### B\n##### C\n# D", "# A\n## B\n### C\n# D"),
        ("plain", "plain"),
        ("  # A\n\n### B", "# A\n\n## B"),
    ],
)
def test_normalize_body(spark, text, want):
    assert one(spark, text, tx.normalize_body) == want


def test_hashes_ids_and_slugs(spark):
    import hashlib

    assert one(spark, " a ", tx.content_hash) == "sha256:" + hashlib.sha256(b"a").hexdigest()
    assert one(spark, "s1", tx.doc_id) == "doc_" + hashlib.sha256(b"s1:default").hexdigest()[:16]
    assert one(spark, "Hello, World_x -- É!", tx.slugify_heading) == "hello-world-x-é"
    assert one(spark, "!!!", tx.slugify_heading) == "section"
    assert one(spark, "Hello, World! " * 10, tx.slugify) == ("hello-world-" * 10)[:60]


def test_counts_see_unicode_space(spark):
    assert one(spark, "a b c\td", tx.count_words) == 4
    assert one(spark, "# a\n## b\n#c", tx.count_headings) == 2
    assert one(spark, "Ünï_x y²-z", tx.tokenize) == re.findall(r"\w+", "ünï_x y²-z")


@pytest.mark.parametrize("n", [0, 1, 512, 513, 960, 961, 2000])
def test_windows_step_and_end(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, " ".join(words), lambda c: tx.split_by_tokens(c, 512, 64))
    if n == 0:
        assert got == []
        return
    want, start = [], 0
    while True:
        want.append(" ".join(words[start : start + 512]))
        if start + 512 >= n:
            break
        start += 448
    assert got == want == dx.windows(" ".join(words), 512, 64)


@pytest.mark.parametrize(("path", "content", "want"), [("a.md", b"", "markdown"), ("a.HTM", b"", "html"), ("a", b"%PDF-1", "pdf"), ("a", b"PK..word/doc", "docx"), ("a", b"  <!DOCTYPE html>", "html"), ("a", b"---\nx", "markdown"), ("a", b"hello", "txt")])
def test_formats(spark, path, content, want):
    df = spark.createDataFrame([(path, bytearray(content))], "p string, c binary")
    assert df.select(tx.detect_format(F.col("p"), F.col("c")).alias("f")).first().f == want


def test_text_and_markdown_extraction(spark):
    df = spark.createDataFrame([("Title\n\nOne\nTwo",), ("single",), ("x" * 130 + "\nrest",), ("  ",)], "text string")
    got = [(r.title, r.body) for r in dx.extract_text(df, F.lit("stem")).collect()]
    assert got == [("Title", "One\n\nTwo"), ("single", "single"), ("stem", "x" * 130 + "\nrest"), ("stem", "")]
    md = spark.createDataFrame([("---\ntitle: T\nlanguage: de\n---\nbody\n# H",), ("# Head\ntext",), ("no heading",)], "text string")
    got = [(r.title, r.language, r.body) for r in dx.extract_markdown(md, F.lit("stem")).collect()]
    assert got == [("T", "de", "body\n# H"), ("Head", "en", "# Head\ntext"), ("stem", "en", "no heading")]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<p>See <a href="/x">the <b>big</b> one</a> and <i>it</i>.</p>', "See [the **big** one](/x) and _it_."),
        ("<p>a</p><pre>a  b\n  c &lt;\n</pre><p>x<br>y</p>", "a\n\n    a  b\n      c <\n\nx  \ny"),
        ("<pre><code>def f():\n    return 1</code></pre>", "    def f():\n        return 1"),
        ("<ul><li>one<ul><li>in<li>in2</ul><li>two <p>para</p></ul><ol><li>f<li>s</ol>", "  * one\n    * in\n    * in2\n  * two\n    para\n\n  1. f\n  2. s"),
        ("<table><caption>C</caption><tr><th>A</th><th>B</th></tr><tr><td>1<td><a href=u>2</a></table><hr>", "C\n\nA | B\n---|---\n1 | [2](u)\n\n* * *"),
        ("<blockquote><p>q</p><p>r</p></blockquote><img src=i.png alt=pic>", "> q\n>\n> r\n\n![pic](i.png)"),
        ("<p>un<b>closed <p>next</b> text<div>d", "unclosed\n\nnext text\n\nd"),
        ("<a href=x><div>block link</div></a>after</p></b>", "block link\n\nafter"),
        ("<nav>n</nav><main></main><article>A</article><p>out</p>", "A"),
        ("<p>no <a>target</a> <b> </b> x</p><script>s()</script>", "no target x"),
        (None, ""),
    ],
)
def test_html_keeps_links_lists_tables_and_code(html, want):
    assert dx.html_to_markdown(html)[1] == want


def test_html_survives_any_tags():
    rng = random.Random(1)
    tags = ["p", "div", "ul", "ol", "li", "table", "tr", "td", "th", "pre", "b", "a", "code", "main", "article", "h2", "blockquote", "br", "hr", "nav"]
    for _ in range(2000):
        html = "".join(rng.choice(["<{}>", "</{}>", "w{} "]).format(rng.choice(tags)) for _ in range(rng.randrange(40)))
        title, text = dx.html_to_markdown(html)
        assert title is None and isinstance(text, str)


def test_html_extraction():
    page = "<html><head><title> T </title><style>p{}</style></head><body><nav>skip</nav><h2>Head</h2><p>One <b>two</b></p><script>no()</script><footer>end</footer></body></html>"
    assert dx.html_to_text(page) == ("T", "## Head\n\nOne two")
    assert dx.html_to_text("<body><p>out</p><article>in</article></body>")[1] == "in"
    assert dx.html_to_text("<body><article>a</article><main>m</main></body>")[1] == "m"
    assert dx.html_to_text(None) == (None, "")


def test_outline_keeps_the_odd_rules():
    body = "lost\n# A\ntext\n```\n# in fence\n```\n#### Deep\nx\n# B\ny"
    assert [(p, t) for p, t, *_ in dx.sections(body)] == [("a", "A"), ("in-fence", "in fence"), ("in-fence/deep", "Deep"), ("b", "B")]
    assert dx.sections("##\nTitle\nrest") == [("title", "Title", "rest", 8, 13)]
    assert dx.sections("no heading ")[0][:3] == ("content", "content", "no heading")


def test_fences_count_as_one_word():
    fence = "```\n" + "code " * 600 + "\n```"
    got = dx.windows("a b\n" + fence + "\n" + "w " * 511, 512, 64)
    assert fence in got[0] and len(got) == 2


def chunked(spark, *bodies):
    df = spark.createDataFrame([(f"d{i}", f"s{i}", "T", b) for i, b in enumerate(bodies)], "doc_id string, source_id string, title string, body string")
    return dx.chunk_documents(df)


def test_chunks_nest_and_number(spark):
    words = " ".join(f"w{i}" for i in range(2100))
    plain, headed = chunked(spark, words, "# H\n" + words), None
    rows = [r for r in plain.collect()]
    for doc in ("d0", "d1"):
        own = [r for r in rows if r.doc_id == doc]
        parents = {r.chunk_id: r for r in own if r.chunk_level == "parent"}
        kids = sorted((r for r in own if r.chunk_level == "child"), key=lambda r: r.chunk_index)
        assert len(parents) == 2 and [k.chunk_index for k in kids] == list(range(len(kids)))
        assert all(k.parent_chunk_id in parents and k.body_text in parents[k.parent_chunk_id].body_text for k in kids)
        assert all(k.token_count >= 32 for k in kids)
    bodies = lambda d: [r.body_text for r in sorted(rows, key=lambda r: (r.chunk_level, r.chunk_index)) if r.doc_id == d]
    assert bodies("d0") == bodies("d1") and headed is None


def test_short_children_leave_only_company(spark):
    rows = chunked(spark, " ".join(["w"] * 512), " ".join(["w"] * 961), "tiny", "").filter("chunk_level = 'child'").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {"d0": 1, "d1": 3, "d2": 1}


def test_files_jsonl_chats_and_index(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# Hello\n\nWorld")
    (tmp_path / "in/sub/b.txt").write_text("text")
    (tmp_path / "in/c.exe").write_text("no")
    files = src.scan_files(spark, str(tmp_path / "in"), max_bytes=5)
    assert {(r.uri.rsplit("/", 1)[1], r.format, r.content is None) for r in files.collect()} == {("a.md", "markdown", True), ("b.txt", "txt", False)}
    rows = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    src.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, src.read_jsonl(spark, str(tmp_path / "j"), "a long, b string").collect()), key=str) == [(1, None), (2, "x")]
    chats = spark.createDataFrame([(1, 1, None, "me", ["b", "c"]), (1, 0, "user", None, ["a"]), (2, 0, None, None, None)], "conv_id long, turn long, role string, author string, text array<string>")
    assert {r.conv_id: r.text for r in src.chats_to_documents(chats).collect()} == {1: "## user\n\na\n\n## me\n\nb\nc", 2: "## unknown\n\n"}
    src.write_index(str(tmp_path / "ix"), 4, chunks=chunked(spark, "a b", "c d"), manifest=rows)
    assert spark.read.parquet(str(tmp_path / "ix/chunks")).count() == 4 and spark.read.parquet(str(tmp_path / "ix/manifest")).count() == 2


def test_registered_extractor(spark):
    dx.register_extractor("pdf", lambda b: pd.DataFrame({"uri": b["uri"], "title": "t", "body": ["x" * len(c) for c in b["content"]]}))
    files = spark.createDataFrame([("a.pdf", "pdf", bytearray(b"abc")), ("b.docx", "docx", bytearray(b"q"))], "uri string, format string, content binary")
    assert [(r.uri, r.body, r.quality) for r in dx.extract_registered(files).collect()] == [("a.pdf", "xxx", "degraded")]
    dx.unregister_extractor("pdf")
    assert dx.extract_registered(files).count() == 0


def test_inbox_ingests_once(spark, tmp_path):
    box, sink, ck = tmp_path / "box", str(tmp_path / "sink"), str(tmp_path / "ck")
    box.mkdir()
    (box / "a.md").write_text("# Hello\n\nWorld")
    (box / "b.txt").write_text("Title\n\nbody text")
    (box / "c.pdf").write_bytes(b"%PDF")
    (box / "d.txt").write_text("  ")
    st.stream_inbox(spark, str(box), sink, ck).awaitTermination(120)
    docs = spark.read.parquet(f"{sink}/documents")
    assert {r.title for r in docs.collect()} == {"Hello", "Title"}
    assert {r.code for r in spark.read.parquet(f"{sink}/errors").collect()} == {"NO_EXTRACTOR", "EXTRACTION_FAILED"}
    (box / "e.txt").write_text("Another\n\nfile")
    st.stream_inbox(spark, str(box), sink, ck).awaitTermination(120)
    st.stream_inbox(spark, str(box), sink, str(tmp_path / "ck2")).awaitTermination(120)  # all again: nothing is new
    assert spark.read.parquet(f"{sink}/documents").count() == 3


def test_inbox_survives_failures_and_retires_old_chunks(spark, tmp_path):
    box, sink, ck = tmp_path / "box", str(tmp_path / "sink"), str(tmp_path / "ck")
    box.mkdir()
    (box / "a.txt").write_text("Title\n\nfirst words")
    (box / "b.txt").write_text("Other\n\ntext")

    def fail(docs, batch_id):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        st.stream_inbox(spark, str(box), sink, ck, fail).awaitTermination(120)
    st.stream_inbox(spark, str(box), sink, ck).awaitTermination(120)  # the same batch again
    docs, chunks, errors = st.read_inbox(spark, sink)
    assert docs.count() == 2 and chunks.filter("chunk_level = 'child'").count() == 2 and spark.read.parquet(f"{sink}/chunks").count() == 4
    (box / "c.txt").write_text("Title\n\nfirst words")
    (box / "a.txt").unlink()
    (box / "a.txt").write_text("Title\n\nother words now")
    st.stream_inbox(spark, str(box), sink, str(tmp_path / "ck2")).awaitTermination(120)
    docs, chunks, errors = st.read_inbox(spark, sink)
    assert docs.count() == 3 and errors.count() == 0
    assert sorted(r.body_text for r in chunks.filter("chunk_level = 'child'").collect()) == ["first words", "other words now", "text"]


def test_inbox_reads_no_history_and_takes_plugged_extractors(spark, tmp_path):
    box, sink, ck = tmp_path / "box", str(tmp_path / "sink"), str(tmp_path / "ck")
    box.mkdir()
    (box / "a.pdf").write_bytes(b"%PDF one")
    (box / "bad.pdf").write_bytes(b"%PDF broken")
    (box / "b.docx").write_bytes(b"PK..word/")

    def extract(files):
        if any(b"broken" in bytes(c) for c in files["content"]):
            raise ValueError("no such page")
        return files.assign(title="T", body=[bytes(c).decode()[5:] for c in files["content"]])

    st.stream_inbox(spark, str(box), sink, ck, extractors={"pdf": extract}).awaitTermination(120)
    docs, _, errors = st.read_inbox(spark, sink)
    assert [(r.title, r.body) for r in docs.collect()] == [("T", "one")]
    assert sorted((r.uri.rsplit("/", 1)[1], r.code) for r in errors.collect()) == [("b.docx", "NO_EXTRACTOR"), ("bad.pdf", "EXTRACTION_FAILED")]
    # The state alone knows the old files: without the sink's documents an unchanged one is skipped all the same.
    (tmp_path / "sink" / "documents").rename(tmp_path / "elsewhere")
    (box / "a.pdf").unlink()
    (box / "a.pdf").write_bytes(b"%PDF one")
    (box / "c.txt").write_text("Title\n\nnew")
    st.stream_inbox(spark, str(box), sink, ck, extractors={"pdf": extract}).awaitTermination(120)
    assert [r.title for r in spark.read.parquet(f"{sink}/documents").collect()] == ["Title"]


def test_sessions_of_a_stream_close_by_watermark_and_drop_late_rows(spark, tmp_path):
    rows = [("t", at(0)), ("t", at(1000)), ("u", at(10_000)), ("t", at(10_500)), ("u", at(40_000))]
    df = spark.createDataFrame([(k, t) for k, t in rows], "task_id string, ts timestamp")
    build = lambda s: st.working_sessions(s, 3600, "10 minutes")
    tick = {"ts": "2024-02-01"}
    whole = st.replay(df, str(tmp_path / "a"), build, ["2024-01-01 01:00:00"], tick)
    columns = ["task_id", "opened_at", "expires_at", "syncs"]
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, st.working_sessions(df).select(*columns).collect()))
    # A row behind the watermark comes too late: its session is closed. One within the delay still counts.
    path = str(tmp_path / "b")
    out = None
    for part in ([("t", at(0)), ("u", at(20_000))], [("t", at(100)), ("u", at(19_500))], [(None, at(90_000))]):
        spark.createDataFrame(part, df.schema).write.mode("append").parquet(f"{path}/in")
        out = st.run_to_table(build(spark.readStream.schema(df.schema).parquet(f"{path}/in")), f"{path}/out")
    assert sorted((r.task_id, r.opened_at, r.syncs) for r in out.collect()) == [("t", at(0), 1), ("u", at(19_500), 2)]


def test_chunk_sizes_and_preamble_are_parameters():
    how = dx.Chunking(size=4, overlap=1, parent_size=8, least=2, keep_preamble=True)
    rows = list(dx.chunks_of("d", "s", None, "before\n# A\n" + " ".join(map(str, range(11))), how))
    assert [(r[3], r[6], r[12]) for r in rows] == [
        ("parent", "content", "before"), ("child", "content", "before"),
        ("parent", "a", "0 1 2 3 4 5 6 7"), ("child", "a", "0 1 2 3"), ("child", "a", "3 4 5 6"), ("child", "a", "6 7"),
        ("parent", "a", "8 9 10"), ("child", "a", "8 9 10"),
    ]
    assert [r[5] for r in rows if r[3] == "child"] == [0, 1, 2, 3, 4] and rows[0][11] == "Document:  > content\n\nbefore"
    assert dx.windows("__FENCE_0__ a\n```\nx  y\n```\nb", 2) == ["__FENCE_0__ a", "```\nx  y\n``` b"]


def test_messages_without_a_conversation_stay_apart(spark):
    from sparkloom.sources.tables import chats_to_documents

    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (None, 1, "user", "x"), (None, 1, None, "y")]
    got = sorted((r.conv_id or 0, r.text, r.n_turns) for r in chats_to_documents(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(0, "## unknown\n\ny", 1), (0, "## user\n\nx", 1), (1, "## user\n\na\n\n## user\n\nb", 2)]


T0 = datetime.datetime(2024, 1, 1)


def at(seconds, micro=0):
    return T0 + datetime.timedelta(seconds=seconds, microseconds=micro)


def test_sessions_end_exactly_at_the_gap(spark):
    rows = [("t", at(0)), ("t", at(3599, 999999)), ("t", at(7199, 999999)), ("u", at(5))]
    got = sorted((r.task_id, r.opened_at, r.syncs) for r in st.working_sessions(spark.createDataFrame(rows, "task_id string, ts timestamp_ntz")).collect())
    assert got == [("t", at(0), 2), ("t", at(7199, 999999), 1), ("u", at(5), 1)]


def test_stream_changes_equal_the_batch_twin(spark, tmp_path):
    rows = [(i, f"u{i % 3}", f"f{(i // 5) % 2}", at(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, uri string, fingerprint string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = st.stream_changes(stream).writeStream.format("memory").queryName("changes_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("changes_out").collect())) == sorted(map(tuple, st.changes(df).collect()))


def test_stream_triggers(spark, tmp_path):
    from sparkloom.plans.records import automations

    df = spark.createDataFrame([("r1", "wf_1"), ("r2", "wf_2")], "task_id string, workflow_id string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = st.stream_triggers(stream, automations(spark)).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.task_id, r.automation_id) for r in spark.table("fired").collect()) == [("r1", "a1"), ("r1", "a2"), ("r2", "a2")]
