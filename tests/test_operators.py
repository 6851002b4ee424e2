"""Retrieval, indexing, memory, automation, routing and decisions on small hand-made cases."""

import datetime
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import automation as au
from sparkloom.operators import decisions as de
from sparkloom.operators import indexing as ix
from sparkloom.operators import memory as me
from sparkloom.operators import retrieval as rt


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{i}", f"d{i}", "", "", t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, title string, heading_path string, embed_text string")


def bm25(texts, query):
    docs = [t.lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.lower().split()) for d in docs]


def test_bm25_equals_the_formula(spark):
    texts = ["solar power plant", "solar panel on a roof roof", "budget plan", "the the the plan", "wind"]
    q = spark.createDataFrame([(1, "Solar solar roof plan"), (2, "nothing")], "query_id long, query string")
    got = {r.chunk_id: r.score for r in rt.keyword_search(q, rt.build_keyword_index(chunks(spark, *texts))).collect()}
    want = {f"c{i}": round(s, 9) for i, s in enumerate(bm25(texts, "solar solar roof plan")) if s > 0}
    assert got == pytest.approx(want)


def test_tiny_corpus_gives_nothing(spark):
    q = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert rt.keyword_search(q, rt.build_keyword_index(chunks(spark, "a"))).count() == 0


def test_vector_legs_agree_and_skip_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(f"c{i:03}", rng.normal(size=8).tolist()) for i in range(60)] + [("zero", [0.0] * 8), ("none", None), ("short", [1.0]), ("c900", None)]
    v = spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(5)], "query_id long, vector array<double>")
    a = sorted(map(tuple, rt.vector_search(q, v, 7).collect()))
    b = sorted(map(tuple, rt.vector_search_sql(q, v.filter("vector IS NOT NULL AND chunk_id <> 'zero'"), 7).collect()))
    assert [x[:2] for x in a] == [x[:2] for x in b] and len(a) == 35
    assert rt.vector_search(q.limit(0), v).count() == 0


def test_wrong_embedder_is_refused(spark):
    with pytest.raises(Exception, match="numbers a text"):
        rt.embed_chunks(chunks(spark, "a"), lambda t: np.zeros((len(t), 3))).count()


def test_fusion_caps_and_budget(spark):
    leg = lambda ids: spark.createDataFrame([(1, c, 1.0, i) for i, c in enumerate(ids, 1)], "query_id long, chunk_id string, score double, rank int")
    got = {r.chunk_id: r for r in rt.rrf({"vector": leg(["a", "b"]), "keyword": leg(["b", "c"])}).collect()}
    assert got["b"].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and set(got["b"].scores) == {"vector", "keyword", "fusion"}
    hits = spark.createDataFrame([(1, f"c{i}", "d0" if i < 3 else "d1", i + 1) for i in range(5)], "query_id long, chunk_id string, doc_id string, rank int")
    assert [r.chunk_id for r in rt.cap_per_doc(hits, 2, 3).orderBy("rank").collect()] == ["c0", "c1", "c3"]
    texts = spark.createDataFrame([(1, 1, "a b c"), (1, 2, "d e"), (1, 3, "f"), (2, 1, "a b c d e f g"), (2, 2, "x")], "query_id long, rank int, text string")
    assert sorted((r.query_id, r["rank"]) for r in rt.trim_to_budget(texts, 5).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_missing_parent_falls_back(spark):
    c = spark.createDataFrame([("p", "parent", None, "parent text", ""), ("a", "child", "p", "own", ""), ("b", "child", "gone", "own b", "")], "chunk_id string, chunk_level string, parent_chunk_id string, body_text string, title string")
    hits = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "lost", "excerpt")], "query_id long, chunk_id string, excerpt string")
    assert {r.chunk_id: r.text for r in rt.expand_parents(hits, c).collect()} == {"a": "parent text", "b": "own b", "lost": "excerpt"}


def test_diff_and_upsert(spark):
    old = spark.createDataFrame([("a", "d", "child", "1"), ("b", "d", "child", "1"), ("c", "d", "child", "1")], "chunk_id string, doc_id string, chunk_level string, content_hash string")
    new = spark.createDataFrame([("a", "d", "child", "1"), ("b", "d", "child", "2"), ("e", "d", "child", "1")], old.schema)
    assert {r.chunk_id: r.status for r in ix.diff_chunks(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "e": "added"}
    assert {r.chunk_id: r.status for r in ix.diff_snapshots(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "e": "added"}


def test_a_batch_leaves_other_documents_alone(spark):
    schema = "chunk_id string, doc_id string, chunk_level string, content_hash string"
    old = spark.createDataFrame([("a", "d1", "child", "1"), ("b", "d2", "child", "1"), ("c", "d3", "child", "1"), ("p", "d3", "parent", "1")], schema)
    new = spark.createDataFrame([("x", "d9", "child", "1")], schema)
    ids = lambda *d: spark.createDataFrame([(i,) for i in d], "doc_id string")
    found = lambda *more: {r.chunk_id: r.status for r in ix.diff_chunks(old, new, *more).collect()}
    assert found() == {"x": "added"}
    assert found(ids("d9", "d2")) == {"x": "added", "b": "removed"}  # d2 came in again, without text
    assert found(None, ids("d3")) == {"x": "added", "c": "removed"}
    vec = lambda *c: spark.createDataFrame([(i, [1.0]) for i in c], "chunk_id string, vector array<double>")
    merged = ix.merge_embeddings(ix.diff_chunks(old, new, None, ids("d3")), vec("a", "b", "c"), vec("x"))
    assert {r.chunk_id: r.cache_hit for r in merged.collect()} == {"a": True, "b": True, "x": False}


def test_running_sums_cross_their_runs(spark):
    rows = [("p", i, i % 7) for i in range(95)] + [(None, 3, 5), (None, 40, 2)]
    df = spark.createDataFrame(rows, "p string, pos int, x int")
    got = {(r.p, r.pos): r.total for r in ix.running_sum(df, ["p"], F.floor(F.col("pos") / 10), ["pos"], F.col("x"), "total").collect()}
    assert got == {(p, i): sum(x for q, j, x in rows if q == p and j <= i) for p, i, _ in rows}


def test_filters_and_many_queries(spark):
    v = spark.createDataFrame([(f"c{i}", [float(i % 5 - 2), 1.0, float(i)]) for i in range(40)], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i), -1.0]) for i in range(9)], "query_id long, vector array<double>")
    want = sorted(map(tuple, rt.vector_search(q, v, 3).collect()))
    block, rt.QUERY_BLOCK = rt.QUERY_BLOCK, 2
    rows, rt.ROW_BLOCK = rt.ROW_BLOCK, 7
    try:
        assert sorted(map(tuple, rt.vector_search(q, v, 3).collect())) == want
    finally:
        rt.QUERY_BLOCK, rt.ROW_BLOCK = block, rows
    only = spark.createDataFrame([("c1",), ("c2",), ("gone",)], "chunk_id string")
    assert {r.chunk_id for r in rt.vector_search(q, v, 3, only).collect()} == {"c1", "c2"}


def test_reprocess_gate(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", None)], "doc_id string, fingerprint string")
    state = spark.createDataFrame([("a", "1", "v2"), ("b", "1", "v1"), ("c", "1", "v2"), ("d", None, "v2")], "doc_id string, source_fingerprint string, pipeline_version string")
    assert {r.doc_id for r in ix.needs_reprocess(s, state, "v2").collect()} == {"b", "c"}


def test_filters_combine(spark):
    df = spark.createDataFrame([(1, ["x"], "ab"), (2, ["y"], "ac"), (3, None, None)], "n int, tags array<string>, s string")
    assert [r.n for r in ix.apply_filters(df, [("tags", "contains_any", ["x", "y"]), ("s", "prefix", "a"), ("n", "gte", 2)]).collect()] == [2]
    with pytest.raises(ValueError, match="unknown"):
        ix.apply_filters(df, [("n", "near", 1)])


def test_dimensions(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<double>")
    assert not ix.assert_dimensions(df, 2).first().ok and ix.assert_dimensions(df.limit(0), 2).first().ok


def test_uploads_stop_in_the_middle(spark):
    rows = [(1, 1, "a.md", 50), (1, 2, "b.exe", 10), (1, 3, "../c.md", 1), (1, 4, "d.md", 0), (1, 5, "e.md", 60), (1, 6, "f.md", 1), (2, 1, "g.xyz", 1), (2, 2, "h.md", 101)]
    df = spark.createDataFrame(rows, "batch_id int, pos int, name string, size long")
    got = {(r.batch_id, r.pos): r.verdict for r in ix.admit_uploads(df, 100, 100, 10, [".md"], [".exe"]).collect()}
    assert got == {(1, 1): "accepted", (1, 2): "rejected", (1, 3): "rejected", (1, 4): "rejected", (1, 5): "stopped", (1, 6): "stopped", (2, 1): "rejected", (2, 2): "rejected"}


# --- Memory

NOW = datetime.datetime(2024, 2, 1)
MEM = "memory_id string, memory_type string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, expires_at timestamp_ntz, task_id string, event_type string, title string, summary string, occurred_at timestamp_ntz, source_ref string, concept string, abstraction string, promoted_from string, confidence double, procedure_name string, version int, previous_version_id string, tags array<string>, workflow_id string, agent_id string"


def memory(memory_id, kind, days=0, **own):
    t = NOW - datetime.timedelta(days=days)
    names = [c.strip().split(" ")[0] for c in MEM.split(", ")]
    base = {"memory_id": memory_id, "memory_type": kind, "status": "active", "created_at": t, "updated_at": t, "occurred_at": t if kind == "episodic" else None, "expires_at": t + datetime.timedelta(minutes=60) if kind == "working" else None, "tags": []}
    return tuple((base | own).get(n) for n in names)


def memories(spark, *rows):
    return spark.createDataFrame(list(rows), MEM)


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def test_recommendation_edge_at_twenty_days(spark):
    m = memories(spark, memory("a", "episodic", 20), memory("b", "episodic", 21), memory("c", "semantic", 0, confidence=0.9))
    assert [r.memory_id for r in me.promotion_recommendations(m, now()).collect()] == (["a"] if 0.3 + 0.2 + max(0, 0.3 - 20 * 0.01) >= 0.6 else [])
    scores = {r.memory_id: r.importance for r in me.score_importance(m, now()).collect()}
    assert scores["c"] == 1.0 and scores["b"] == pytest.approx(0.59)


def test_contradictions_any_case_newer_first(spark):
    m = memories(spark, memory("a", "semantic", 2, concept="Budget", abstraction="Increase spending"), memory("b", "semantic", 1, concept="budget", abstraction="Reduce spending"), memory("c", "semantic", 0, concept="other", abstraction="x"), memory("d", "semantic", 0, concept="BUDGET", abstraction="Reduce spending", status="archived"))
    assert [tuple(r) for r in me.contradicting_pairs(m).collect()] == [("budget", "b", "a")]
    assert sorted((r.concept, r.abstraction, r.n, r.newest, r.sides) for r in me.detect_contradictions(m).collect()) == [("budget", "Increase spending", 1, "a", 2), ("budget", "Reduce spending", 1, "b", 2)]


def test_duplicates_and_empty_concepts(spark):
    m = memories(spark, memory("a", "episodic", title="t", summary="s"), memory("b", "episodic", 1, title="t", summary="s"), memory("c", "semantic", concept="", abstraction="z"))
    assert [(r.n, r.first) for r in me.detect_duplicates(m).collect()] == [(2, "a")] and {r.memory_id for r in me.duplicate_members(m).collect()} == {"a", "b"}
    assert [(r.cluster, r.n) for r in me.cluster_semantic(m).collect()] == [("other", 1)] and me.cluster_members(m).count() == 1


def test_promotion_rules_and_rerun(spark):
    m = memories(spark, memory("w", "working", task_id="t1"), memory("e", "episodic", title="T", summary="S", tags=["x"]), memory("x", "episodic", status="archived"), memory("s", "semantic"))
    req = [("w", "episodic", "workflow_completion", False), ("w", "semantic", "manual_approval", True), ("e", "semantic", "manual_approval", True), ("e", "semantic", "manual_approval", False), ("x", "semantic", "manual_approval", True), ("gone", "episodic", "manual_approval", True), ("w", "episodic", "manual_approval", False), ("w", "episodic", "other", True), ("e", "semantic", "other", True)]
    r = spark.createDataFrame(req, "source_memory_id string, target_type string, policy string, approved boolean")
    errors = Counter((x.error or "ok").split(":")[0] for x in me.promotion_results(m, r).collect())
    assert errors == Counter({"ok": 2, "Invalid promotion": 1, "Semantic promotion requires explicit user approval.": 1, "Cannot promote memory with status": 1, "Memory not found": 1, "Episodic promotion via manual_approval requires --approve.": 1, "Unsupported promotion policy": 1, "Semantic promotion requires manual_approval policy.": 1})
    out = {x.memory_id: x for x in me.promote(m, r, now()).collect()}
    assert len(out) == 6 and out["w"].status == out["e"].status == "promoted"
    new = {x.memory_type: x for k, x in out.items() if k not in ("w", "e", "x", "s")}
    assert new["semantic"].concept == "T" and new["semantic"].promoted_from == "e" and new["episodic"].source_ref == "t1"
    again = {x.memory_id for x in me.promote(m, r, now()).collect()}
    assert again == set(out)


def test_expiry_aging_and_forgetting(spark):
    m = memories(spark, memory("w", "working", 0), memory("v", "working", 1), memory("e", "episodic", 91), memory("f", "episodic", 90))
    assert {r.memory_id: r.status for r in me.expire_working(m, now()).collect()}["v"] == "expired"
    aged = {r.memory_id: (r.status, r.archived_at) for r in me.apply_aging(m, now()).collect()}
    assert aged["e"] == ("archived", NOW) and aged["f"][0] == "active"
    assert me.forget(m, now()).filter("status = 'archived'").count() == 0  # the base score is above the default floor


def test_task_bundle_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [memory(f"m{i:03}", rng.choice(["working", "episodic", "semantic", "procedural"]), rng.randrange(60), task_id=rng.choice(["t1", "t2"]), agent_id=rng.choice([None, "a1", "a2"]), workflow_id=rng.choice([None, "w1", "w2"])) for i in range(150)]
    tasks = [("t1", "a1", "w1"), ("t2", None, "w2"), ("t3", "a2", None), ("t4", None, None), ("t5", "zz", "zz")]
    got = {(r.task_id, r.memory_id) for r in me.retrieve_for_task(spark.createDataFrame(tasks, "task_id string, agent_id string, workflow_id string"), memories(spark, *rows), 4).collect()}
    want = set()
    for t, a, w in tasks:
        for kind in ("working", "episodic", "semantic", "procedural"):
            fit = [r for r in rows if r[1] == kind and (kind != "working" or r[6] == t) and (kind not in ("episodic", "procedural") or not (r[20] and w and r[20] != w)) and (kind != "episodic" or not (r[21] and a and r[21] != a))]
            want |= {(t, r[0]) for r in sorted(fit, key=lambda r: (-r[4].timestamp(), r[0]))[:4]}
    assert got == want


def test_task_bundle_with_tags_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    names = ["x", "y", "z", "rare"]
    rows = [memory(f"m{i:03}", rng.choice(["working", "episodic", "semantic", "procedural"]), rng.randrange(60), task_id=rng.choice(["t1", "t2"]), agent_id=rng.choice([None, "a1", "a2"]), workflow_id=rng.choice([None, "w1"]), tags=rng.choice([None, [], ["x"], ["x", "y"], ["y", "z", "y"], ["x", "y", "z"], ["rare", "x"]])) for i in range(200)]
    place = memories(spark, *rows).columns.index("tags")
    tasks = [("t1", "a1", "w1", ["x"]), ("t2", None, "w1", ["x", "y", "x"]), ("t3", "a2", None, ["rare", "x", "z"]), ("t4", None, None, None), ("t5", "zz", "zz", []), ("t6", None, None, ["nobody", "x"]), ("t7", "a1", "w1", ["x"]), ("t8", None, None, names[:3])]
    frame = spark.createDataFrame(tasks, "task_id string, agent_id string, workflow_id string, tags array<string>")
    got = {(r.task_id, r.memory_id) for r in me.retrieve_for_task(frame, memories(spark, *rows), 4).collect()}
    want = set()
    for t, a, w, g in tasks:
        for kind in ("working", "episodic", "semantic", "procedural"):
            fit = [r for r in rows if r[1] == kind and (kind != "working" or r[6] == t) and (kind not in ("episodic", "procedural") or not (r[20] and w and r[20] != w)) and (kind != "episodic" or not (r[21] and a and r[21] != a)) and (kind not in ("episodic", "semantic") or set(g or []) <= set(r[place] or []))]
            want |= {(t, r[0]) for r in sorted(fit, key=lambda r: (-r[4].timestamp(), r[0]))[:4]}
    assert got == want and len(want) > 30


def test_closing_runs_promotes_one_working_row(spark):
    m = memories(spark, memory("w2", "working", 0, task_id="t1"), memory("w1", "working", 0, task_id="t1"), memory("w3", "working", 0, task_id="t2"), memory("w4", "working", 0, status="expired", task_id="t3"))
    runs = spark.createDataFrame([("t1", "wf", "completed", NOW, 2), ("t1", "wf", "completed", NOW, 2), ("t2", "wf", "running", NOW, 1), ("t3", "wf", "failed", NOW, 0)], "task_id string, workflow_id string, status string, ended_at timestamp_ntz, steps long")
    out = me.close_runs(m, runs, now())
    got = {r.memory_id: r for r in out.collect()}
    assert out.count() == len(got) == 7
    assert {k: got[k].status for k in ("w1", "w2", "w3", "w4")} == {"w1": "promoted", "w2": "active", "w3": "active", "w4": "expired"}
    new = sorted((r.source_ref, r.event_type, r.title) for k, r in got.items() if not k.startswith("w"))
    assert new == [("t1", "workflow_execution", "Workflow wf completed"), ("t1", "workflow_execution", "Workflow wf completed"), ("t3", "failure", "Workflow wf failed")]
    # Told again, nothing is new but the next working row of the task, which follows.
    assert {r.memory_id for r in me.close_runs(out, runs, now()).collect()} >= set(got)


# --- Schedules, triggers, routing


@pytest.mark.parametrize(
    ("cron", "after", "want"),
    [
        ("0 9 * * *", "2026-07-11 08:00:00", "2026-07-11 09:00:00"),
        ("0 9 * * *", "2026-07-11 09:00:00", "2026-07-12 09:00:00"),
        ("*/15 * * * *", "2026-07-11 08:14:59", "2026-07-11 08:15:00"),
        ("5/20 * * * *", "2026-07-11 08:05:00", "2026-07-11 08:25:00"),
        ("0 0 29 2 *", "2024-01-01 00:00:00", "2024-02-29 00:00:00"),
        ("0 0 29 2 *", "2024-03-01 00:00:00", None),
        ("0 0 31 2 *", "2024-01-01 00:00:00", None),
        ("0 8 * * 0", "2024-01-03 00:00:00", "2024-01-08 08:00:00"),
        ("30 23 31 12 *", "2024-12-31 23:30:00", "2025-12-31 23:30:00"),
        ("1-3,50 * * * *", "2024-01-01 00:03:00", "2024-01-01 00:50:00"),
        ("bad", "2024-01-01 00:00:00", None),
        ("0 9 13 * 4", "2024-01-01 00:00:00", "2024-09-13 09:00:00"),
    ],
)
def test_cron(spark, cron, after, want):
    df = spark.createDataFrame([("cron", cron)], "schedule_type string, cron_expression string").selectExpr("*", "CAST(NULL AS timestamp_ntz) run_at", "CAST(NULL AS int) delay_seconds", "CAST(NULL AS int) interval_seconds")
    got = au.next_run(df, F.lit(after).cast("timestamp_ntz")).first().next_run
    assert (str(got) if got else None) == want


def test_routing_falls_back(spark):
    rows = [(1, [], 0, False, False, None), (2, ["local"], 0, True, False, None), (3, ["coding"], 150000, False, False, None), (4, [], 0, False, False, "mine"), (5, ["unknown"], 0, False, False, None)]
    r = spark.createDataFrame(rows, "request_id int, priorities array<string>, min_context int, structured boolean, multimodal boolean, override_provider string")
    got = {x.request_id: (x.provider, x.score) for x in au.route_requests(r, au.profiles(spark), ["ollama", "openai", "anthropic"]).collect()}
    assert got[1] == ("ollama", 1.0) and got[2] == ("ollama", 1.0) and got[3] == ("anthropic", 0.9) and got[4] == ("mine", 1.0) and got[5] == ("ollama", 0.5)
    none = {x.request_id: (x.provider, x.model, x.score) for x in au.route_requests(r, au.profiles(spark), []).collect()}
    assert none[1] == ("ollama", "default", 0.0) and none[4][0] == "mine"


def test_active_runs_end_before_start(spark):
    t = lambda m: NOW + datetime.timedelta(minutes=m)
    df = spark.createDataFrame([("a", "x", t(0), t(5)), ("a", "y", t(5), t(9)), ("a", "z", t(6), t(7))], "automation_id string, execution_id string, started_at timestamp_ntz, ended_at timestamp_ntz")
    assert {r.execution_id: r.active for r in au.active_runs(df, 1).collect()} == {"x": 1, "y": 1, "z": 2}


def test_decisions_without_evidence(spark):
    r = spark.createDataFrame([(1, "Should we expand solar capacity?", "creative", [], True), (2, "q", "weighted_scoring", ["One", "Two"], False)], "decision_id long, question string, strategy string, option_hints array<string>, require_knowledge boolean")
    t, e = de.strategies(spark), spark.createDataFrame([], "decision_id long, rank int, relevance double")
    options = de.generate_options(r, t)
    assert [x.title for x in options.filter("decision_id = 1").orderBy("option").collect()] == ["Creatively proceed with expand", "Creatively defer decision", "Creatively hybrid approach", "Creative alternative: reframe the problem"]
    got = {x.decision_id: x for x in de.decide(r, t, e).collect()}
    assert got[2].score == pytest.approx(round(0.35 * 2 / 3 + 0.30 * 0.65, 4)) and 0 <= got[1].confidence <= 1


def test_contradictions_are_all_pairs_of_a_concept(spark, tmp_path):
    from sparkloom.plans import records  # noqa: F401
    from sparkloom.plans.registry import QUERIES

    rows = [memory(f"m{i:03}", "semantic", i % 7, concept="Solar" if i % 2 else "solar", abstraction=f"rule {i % 3}") for i in range(60)] + [memory("z", "semantic", concept="solar", abstraction=None), memory("y", "semantic", concept="wind", abstraction="rule 1")]
    m = memories(spark, *rows)
    plain = m.filter("memory_id LIKE 'm%'").select("memory_id", "concept", "abstraction", "created_at").collect()
    want = sorted((a.concept, a.memory_id, b.memory_id) for a in plain for b in plain if a.abstraction != b.abstraction and (a.created_at > b.created_at or a.created_at == b.created_at and a.memory_id < b.memory_id))
    for block in (7, 1000):
        assert sorted(map(tuple, me.contradicting_pairs(m, block).collect())) == want and len(want) == 60 * 40 // 2
    spark.createDataFrame([(i, i % 5, "purchase", i, f'{{"k": {i}}}') for i in range(45)], "event_id long, user_id long, event_type string, at long, props string").withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["j5_contradictions"](spark, str(tmp_path))
    assert got.columns == ["concept", "memory_a", "memory_b"] and got.count() > 45
