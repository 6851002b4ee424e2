"""Memory records: search, lifecycle, promotion, insights, bundles. All take the wide memory table; now is as_of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import materialized, small
from .retrieval import top_k

TEXT_FIELDS = ("title", "summary", "concept", "abstraction", "procedure_name")
MAX_ITEMS = 10
#: Rows of a concept's block: two blocks meet in a task.
MEETING = 8_192


def _is(kind: str) -> Column:
    return F.col("memory_type") == kind


ACTIVE = "status = 'active'"


def memory_text() -> Column:
    return F.concat_ws(" ", "memory_id", "memory_type", *TEXT_FIELDS)


def search_memories(mem: DataFrame, query: str = "", types=None, task_id=None, agent_id=None, workflow_id=None, tags=(), since=None, until=None, limit: int = 50) -> DataFrame:
    """Active memories that match, newest updated first. Agent and workflow let rows without one pass; the task binds working rows only."""
    rows = mem.filter(ACTIVE)
    when = F.coalesce("occurred_at", "created_at")
    if types:
        rows = rows.filter(F.col("memory_type").isin(*types))
    if task_id:
        rows = rows.filter(~_is("working") | (F.col("task_id") == task_id))
    for column, value in (("agent_id", agent_id), ("workflow_id", workflow_id)):
        if value:
            rows = rows.filter(F.col(column).isNull() | (F.col(column) == value))
    if tags:
        rows = rows.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    if since is not None:
        rows = rows.filter(when >= since)
    if until is not None:
        rows = rows.filter(when <= until)
    if query:
        rows = rows.filter(F.contains(F.lower(memory_text()), F.lit(query.lower())))
    return rows.orderBy(F.desc("updated_at"), "memory_id").limit(limit)


def importance(as_of: Column) -> Column:
    """0.3 and more for type, recency and confidence, 1 at most; days are whole ones."""
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(86_400_000_000.0))
    base = F.lit(0.3) + F.when(_is("semantic"), F.lit(0.4)).when(_is("episodic"), F.lit(0.2)).otherwise(F.lit(0.0))
    score = base + F.greatest(F.lit(0.0), F.lit(0.3) - days * F.lit(0.01))
    return F.least(F.lit(1.0), F.when(_is("semantic"), score + F.col("confidence") * F.lit(0.2)).otherwise(score))


def score_importance(mem: DataFrame, as_of: Column) -> DataFrame:
    return mem.withColumn("importance", importance(as_of))


def score_confidence(mem: DataFrame) -> DataFrame:
    return mem.withColumn("score", F.when(_is("semantic"), F.col("confidence")).when(_is("episodic"), F.lit(0.6)).otherwise(F.lit(0.4)))


def _archive(mem: DataFrame, which: Column, as_of: Column) -> DataFrame:
    old = F.col("archived_at") if "archived_at" in mem.columns else F.lit(None).cast("timestamp_ntz")
    return mem.withColumns({"archived_at": F.when(which & _is("episodic"), as_of).otherwise(old), "status": F.when(which, F.lit("archived")).otherwise(F.col("status"))})


def apply_aging(mem: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return _archive(mem, F.expr(ACTIVE) & _is("episodic") & (F.col("occurred_at") < as_of - F.make_dt_interval(days=F.lit(days))), as_of)


def forget(mem: DataFrame, as_of: Column, least: float = 0.2) -> DataFrame:
    return _archive(mem, F.expr(ACTIVE) & (_is("episodic") | _is("working")) & (importance(as_of) < least), as_of)


def expire_working(mem: DataFrame, as_of: Column) -> DataFrame:
    return mem.withColumn("status", F.when(F.expr(ACTIVE) & _is("working") & (F.col("expires_at") <= as_of), F.lit("expired")).otherwise(F.col("status")))


def promotion_results(mem: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (source_memory_id, target_type, policy, approved, ...) with its error, null where it may go ahead, and the source's columns."""
    found = requests.join(mem, requests.source_memory_id == mem.memory_id, "left")
    # The error texts are results.
    target, policy, approved = F.col("target_type"), F.col("policy"), F.coalesce("approved", F.lit(False))
    error = (
        F.when(F.col("memory_id").isNull(), F.concat(F.lit("Memory not found: "), F.col("source_memory_id")))
        .when(~F.col("status").isin("active", "expired"), F.concat(F.lit("Cannot promote memory with status: "), F.col("status")))
        .when(~((_is("working") & (target == "episodic")) | (_is("episodic") & (target == "semantic"))), F.concat(F.lit("Invalid promotion: "), F.col("memory_type"), F.lit(" → "), target, F.lit(". Stages cannot be bypassed.")))
        .when((target == "semantic") & (policy != "manual_approval"), F.lit("Semantic promotion requires manual_approval policy."))
        .when((target == "semantic") & ~approved, F.lit("Semantic promotion requires explicit user approval."))
        .when((target == "episodic") & (policy == "manual_approval") & ~approved, F.lit("Episodic promotion via manual_approval requires --approve."))
        .when((target == "episodic") & ~policy.isin("manual_approval", "workflow_completion"), F.concat(F.lit("Unsupported promotion policy: "), policy))
    )
    new_id = F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("|", "source_memory_id", target), 256), 1, 20))
    return found.withColumns({"error": error, "target_memory_id": F.when(error.isNull(), new_id)})


def promote(mem: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """mem with the sources marked and the new rows added; ids are hashes of source and target, so a rerun makes the same."""
    good = promotion_results(mem, requests).filter("error IS NULL").dropDuplicates(["target_memory_id"])
    blank = {c: F.lit(None).cast(t) for c, t in mem.dtypes}
    for c in ("want_title", "want_summary"):
        if c not in good.columns:
            good = good.withColumn(c, F.lit(None).cast("string"))
    episodic = {"event_type": F.lit("workflow_execution"), "title": F.coalesce("want_title", F.concat(F.lit("Promoted from "), F.col("memory_id"))), "summary": F.coalesce("want_summary", F.lit("Working memory promoted to episodic.")), "occurred_at": F.col("created_at"), "source_ref": F.col("task_id")}
    semantic = {"concept": F.coalesce("want_concept", "title"), "abstraction": F.coalesce("want_abstraction", "summary"), "promoted_from": F.col("memory_id"), "confidence": F.lit(0.7)}
    shared = {"memory_id": F.col("target_memory_id"), "memory_type": F.col("target_type"), "status": F.lit("active"), "created_at": as_of, "updated_at": as_of, "tags": F.col("tags")}
    for c in ("want_concept", "want_abstraction"):
        if c not in good.columns:
            good = good.withColumn(c, F.lit(None).cast("string"))

    def rows(kind: str, own: dict) -> DataFrame:
        values = blank | shared | own
        return good.filter(F.col("target_type") == kind).select(*[values[c].alias(c) for c in mem.columns])

    marked = mem.join(good.select(F.col("memory_id").alias("done")).distinct(), F.col("memory_id") == F.col("done"), "left").withColumn("status", F.when(F.col("done").isNotNull(), F.lit("promoted")).otherwise(F.col("status"))).drop("done")
    return marked.unionByName(rows("episodic", episodic)).unionByName(rows("semantic", semantic))


def promotion_recommendations(mem: DataFrame, as_of: Column, least: float = 0.6) -> DataFrame:
    scored = score_importance(mem.filter(F.expr(ACTIVE) & _is("episodic")), as_of).filter(F.col("importance") >= least)
    return scored.select("memory_id", "title", F.round("importance", 2).alias("importance"), F.lit("High importance episodic memory").alias("reason")).orderBy(F.desc("importance"), "memory_id")


def _text_keys(mem: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("summary", "abstraction", "title", "concept")])
    return mem.filter(F.expr(ACTIVE) & F.col("memory_type").isin("episodic", "semantic")).select("memory_id", F.substring(F.sha2(F.substring(text, 1, 500), 256), 1, 16).alias("key"))


def _of_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows of the groups, with the groups' columns; group tables are small beside the rows, a hot group is split by adaptive execution."""
    return rows.join(groups.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key")).drop("_key")


def detect_duplicates(mem: DataFrame) -> DataFrame:
    """key, n, first (smallest id) of the groups of active episodic and semantic rows with the same first 500 characters of text."""
    return _text_keys(mem).groupBy("key").agg(F.count("*").alias("n"), F.min("memory_id").alias("first")).filter("n > 1")


def duplicate_members(mem: DataFrame) -> DataFrame:
    """A row a member of a duplicate group: key, memory_id, n, first."""
    return _of_groups(_text_keys(mem), detect_duplicates(mem), "key")


def _clustered(mem: DataFrame) -> DataFrame:
    first = F.lower(F.element_at(F.split(F.trim(F.regexp_replace("concept", r"\s+", " ")), " "), 1))
    return mem.filter(F.expr(ACTIVE) & _is("semantic")).select("memory_id", F.coalesce(F.nullif(first, F.lit("")), F.lit("other")).alias("cluster"))


def cluster_semantic(mem: DataFrame) -> DataFrame:
    """cluster, n, first of the active semantic rows by the first word of their concept."""
    return _clustered(mem).groupBy("cluster").agg(F.count("*").alias("n"), F.min("memory_id").alias("first"))


def cluster_members(mem: DataFrame) -> DataFrame:
    """A row a member of a cluster: cluster, memory_id, n, first."""
    return _of_groups(_clustered(mem), cluster_semantic(mem), "cluster")


def graph_edges(mem: DataFrame) -> DataFrame:
    up = mem.filter(_is("semantic") & F.col("promoted_from").isNotNull()).select(F.col("memory_id").alias("src"), F.col("promoted_from").alias("dst"))
    ref = mem.filter(_is("episodic") & (F.col("source_ref") != "")).select("memory_id", "source_ref")
    return up.union(up.select("dst", "src")).union(ref)


def relationship_graph(mem: DataFrame) -> DataFrame:
    """The adjacency lists as rows: src, dst, degree (of src); a hub's list is never gathered."""
    edges = graph_edges(mem)
    return _of_groups(edges, edges.groupBy("src").agg(F.count("*").alias("degree")), "src")


def _concepts(mem: DataFrame) -> DataFrame:
    """Active semantic rows of concepts (any case) with more than one abstraction."""
    rows = mem.filter(F.expr(ACTIVE) & _is("semantic")).select(F.lower("concept").alias("c"), "concept", "abstraction", "memory_id", "created_at")
    torn = rows.groupBy("c").agg(F.min("abstraction").alias("lo"), F.max("abstraction").alias("hi")).filter("lo <> hi").select(F.col("c").alias("torn"))
    return rows.join(torn, F.col("c") == F.col("torn"), "left_semi")


def detect_contradictions(mem: DataFrame) -> DataFrame:
    """concept (lower case), abstraction, n, newest (memory_id), sides: the sides of each concept that has more than one.

    All members of a side contradict all of every other side; contradicting_pairs writes the pairs out.
    """
    sides = _concepts(mem).filter("abstraction IS NOT NULL").groupBy("c", "abstraction").agg(F.count("*").alias("n"), F.min_by("memory_id", F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "memory_id")).alias("newest"))
    return _of_groups(sides, sides.groupBy("c").agg(F.count("*").alias("sides")), "c").withColumnRenamed("c", "concept")


def contradicting_members(mem: DataFrame) -> DataFrame:
    """memory_id, concept, side (the newest memory_id of its side), n_links: every row that contradicts others, and how many.

    A row contradicts all rows of its concept's other sides, so sides and members say all pairs, in rows as many as the members.
    """
    rows = _concepts(mem).filter("abstraction IS NOT NULL")
    sides = rows.groupBy("c", "abstraction").agg(F.count("*").alias("n"), F.min_by("memory_id", F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "memory_id")).alias("side"))
    totals = sides.groupBy(F.col("c").alias("of")).agg(F.sum("n").alias("total"))
    known = materialized(sides.join(totals, F.col("c") == F.col("of")).select("c", "abstraction", "side", (F.col("total") - F.col("n")).alias("n_links")), "sides")
    return rows.join(small(known), ["c", "abstraction"]).select("memory_id", "concept", "side", "n_links")


def contradicting_pairs(mem: DataFrame, block: int = MEETING) -> DataFrame:
    """Pairs of active semantic rows of one concept (any case) with different abstractions, the newer first.

    The result itself grows with the square of a concept's rows; detect_contradictions says the same in groups. A concept's rows
    are dealt into blocks of about so many, and each two of its blocks meet once, all meetings side by side: no task holds more
    than two blocks of a concept at once, however many rows it has.
    """
    rows = materialized(_concepts(mem).filter("abstraction IS NOT NULL AND created_at IS NOT NULL"), "concepts")
    sizes = materialized(rows.groupBy(F.col("c").alias("of")).agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("blocks")), "sizes")
    meetings = sizes.agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    dealt = _of_groups(rows, small(sizes).withColumnRenamed("of", "c"), "c").withColumn("own", F.pmod(F.xxhash64("memory_id"), F.col("blocks")).cast("int"))
    # A number of partitions, so that adaptive execution does not lay the small input of many pairs into one task.
    parts = max(mem.sparkSession.sparkContext.defaultParallelism, min(int(meetings), 2000))

    def side(name: str, others: Column, low: Column, high: Column) -> DataFrame:
        out = dealt.withColumn("other", F.explode(others)).select("c", low.alias("i"), high.alias("j"), *[F.col(x).alias(f"{name}_{x}") for x in ("concept", "abstraction", "memory_id", "created_at")])
        return out.repartition(parts, "c", "i", "j")

    own, other = F.col("own"), F.col("other")
    left, right = side("l", F.sequence(own, F.col("blocks") - 1), own, other), side("r", F.sequence(F.lit(0), own), other, own)
    newer = lambda x, y: (F.col(f"{x}_created_at") > F.col(f"{y}_created_at")) | ((F.col(f"{x}_created_at") == F.col(f"{y}_created_at")) & (F.col(f"{x}_memory_id") < F.col(f"{y}_memory_id")))
    # Inside a block each two rows meet twice, between blocks once.
    pairs = left.join(right.hint("merge"), ["c", "i", "j"]).filter((F.col("l_abstraction") != F.col("r_abstraction")) & (newer("l", "r") | ((F.col("i") < F.col("j")) & newer("r", "l"))))
    first = lambda x, y: F.when(newer("l", "r"), F.col(f"l_{x}")).otherwise(F.col(f"r_{x}")).alias(y)
    return pairs.select(first("concept", "concept"), first("memory_id", "memory_a"), F.when(newer("l", "r"), F.col("r_memory_id")).otherwise(F.col("l_memory_id")).alias("memory_b"))


def promotion_lineage(mem: DataFrame) -> DataFrame:
    """semantic_id, episodic_id, working_id: where semantic rows came from (two steps at most)."""
    s = mem.filter(_is("semantic")).select(F.col("memory_id").alias("semantic_id"), F.col("promoted_from").alias("episodic_id"))
    e = mem.filter(_is("episodic")).select(F.col("memory_id").alias("eid"), F.col("source_ref").alias("ref"))
    w = mem.filter(_is("working")).groupBy(F.col("task_id").alias("tid")).agg(F.min("memory_id").alias("working_id"))
    return s.join(e, F.col("episodic_id") == F.col("eid"), "left").join(w, F.col("ref") == F.col("tid"), "left").select("semantic_id", "episodic_id", "working_id")


def compress_episodic(mem: DataFrame, limit: int = 20, shown: int = 10) -> DataFrame:
    """count and digest of the newest active episodic rows."""
    newest = mem.filter(F.expr(ACTIVE) & _is("episodic")).orderBy(F.desc("created_at"), "memory_id").limit(limit)
    rows = newest.agg(F.count("*").alias("count"), F.reverse(F.sort_array(F.collect_list(F.struct("created_at", "memory_id", "summary")))).alias("r"))
    return rows.select("count", F.array_join(F.transform(F.slice("r", 1, shown), lambda x: F.concat(F.lit("- "), x.summary)), "\n").alias("digest"))


def build_timeline(mem: DataFrame, query: str = "", limit: int = 50) -> DataFrame:
    return search_memories(mem, query, ["episodic"], limit=limit).select("memory_id", "occurred_at", "event_type", "title", "summary").orderBy("occurred_at", "memory_id")


def procedure_versions(mem: DataFrame) -> DataFrame:
    """Versions of procedures with their predecessor's version; latest marks the newest of each name."""
    p = mem.filter(_is("procedural"))
    before = p.select(F.col("memory_id").alias("pid"), F.col("version").alias("previous_version"))
    # The newest of a name by an aggregate, so no procedure's history is sorted in one task.
    newest = p.groupBy("procedure_name").agg(F.max(F.struct("created_at", "memory_id")).alias("last")).select(F.col("procedure_name").alias("name"), F.col("last.memory_id").alias("last_id"))
    rows = p.join(before, F.col("previous_version_id") == F.col("pid"), "left").join(newest, (F.col("memory_id") == F.col("last_id")) & F.col("procedure_name").eqNullSafe(F.col("name")), "left")
    return rows.select("memory_id", "procedure_name", "version", "previous_version", F.col("last_id").isNotNull().alias("latest"))


def _newest(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The newest k rows of each combination of the keys (null is a value), or of all."""
    order = [F.desc("updated_at"), F.col("memory_id")]
    return top_k(rows, keys, order, k).drop("rank") if keys else rows.orderBy(*order).limit(k)


def _for_tasks(tasks: DataFrame, rows: DataFrame, keys: dict[str, str], k: int) -> DataFrame:
    """task_id and memory columns: for each task its newest k rows and maybe more.

    keys maps a memory's column to the task's; a memory without a value fits all tasks, and a task without one is not bound by
    it. For each set of keys that tasks may be bound by, memories are cut to the newest k of each value first; a task then looks
    up its own value and null. Only the k newest of all are broadcast, to tasks bound by nothing.
    """
    parts = []
    for mask in range(1 << len(keys)):
        bound = [m for i, m in enumerate(keys) if mask >> i & 1]
        mine = tasks
        for m, t in keys.items():
            mine = mine.filter(F.col(t).isNotNull() if m in bound else F.col(t).isNull())
        for m in bound:
            mine = mine.withColumn(f"_{m}", F.explode(F.array(F.col(keys[m]), F.lit(None).cast("string"))))
        part = _newest(rows, bound, k)
        on = reduce(lambda x, y: x & y, [F.col(f"_{m}").eqNullSafe(F.col(m)) for m in bound], F.lit(True))
        found = mine.join(part, on) if bound else mine.crossJoin(F.broadcast(part))
        parts.append(found.select("task_id", "memory_id", "memory_type", "updated_at"))
    return reduce(DataFrame.unionByName, parts)


def _holding_tags(tasks: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """task_id and memory columns: for each task with tags the newest k rows of each type that hold all of them; episodic ones as agent and workflow allow.

    Tasks that ask for the same are one request. A request looks up the rows of its rarest tag, and what these hold is verified; a
    tag that no row has ends the request.
    """
    asked = tasks.withColumn("tags", F.array_sort(F.array_distinct("tags"))).withColumn("ask", F.to_json(F.struct("tags", "agent_id", "workflow_id")))
    requests = asked.select("ask", "tags", "agent_id", "workflow_id").distinct()
    listed = rows.select("memory_id", "memory_type", "m_agent", "m_wf", "updated_at", "m_tags", F.explode(F.array_distinct("m_tags")).alias("tag"))
    counts = listed.groupBy("tag").agg(F.count("*").alias("n"))
    tags = requests.select("ask", F.explode("tags").alias("tag")).join(counts, "tag", "left")
    rarest = tags.groupBy("ask").agg(F.min_by("tag", F.struct("n", "tag")).alias("tag"), F.count_if(F.col("n").isNull()).alias("unknown")).filter("unknown = 0")
    found = requests.join(rarest, "ask").join(listed, "tag").filter(F.size(F.array_except("tags", "m_tags")) == 0)
    free = lambda m, t: F.col(m).isNull() | F.col(t).isNull() | (F.col(m) == F.col(t))
    found = found.filter(_is("semantic") | (free("m_agent", "agent_id") & free("m_wf", "workflow_id")))
    best = top_k(found, ["ask", "memory_type"], [F.desc("updated_at"), F.col("memory_id")], k)
    return asked.select("task_id", "ask").join(best, "ask").select("task_id", "memory_id", "memory_type", "updated_at")


def retrieve_for_task(tasks: DataFrame, mem: DataFrame, limit: int = MAX_ITEMS) -> DataFrame:
    """For each task (task_id, agent_id, workflow_id[, tags]) the newest memories of each type, with their rank.

    Working rows match the task; episodic rows match agent and workflow, procedural ones the workflow, a row without
    one matching all; semantic rows match all. Of a task with tags, episodic and semantic rows must hold all of them; null or
    no tags ask for nothing. A popular agent costs no more than a rare one.
    """
    tagged = None
    active = mem.filter(ACTIVE).select("memory_id", "memory_type", F.col("task_id").alias("m_task"), F.col("agent_id").alias("m_agent"), F.col("workflow_id").alias("m_wf"), F.col("tags").alias("m_tags"), "updated_at")
    if "tags" in tasks.columns:
        active = materialized(active, "active")
        has = F.coalesce(F.size("tags") > 0, F.lit(False))
        tagged = _holding_tags(tasks.filter(has), active.filter(_is("episodic") | _is("semantic")), limit)
        bound = tasks.filter(has).select("task_id", "agent_id", "workflow_id")
        tasks = tasks.filter(~has)
    else:
        bound = None
    tasks = tasks.select("task_id", "agent_id", "workflow_id")
    of = lambda kind: active.filter(_is(kind))
    if bound is not None:
        mine = bound.join(_newest(of("working").filter("m_task IS NOT NULL"), ["m_task"], limit), F.col("task_id") == F.col("m_task")).select("task_id", "memory_id", "memory_type", "updated_at")
        tagged = tagged.unionByName(mine).unionByName(_for_tasks(bound, of("procedural"), {"m_wf": "workflow_id"}, limit))
    working = tasks.join(_newest(of("working").filter("m_task IS NOT NULL"), ["m_task"], limit), F.col("task_id") == F.col("m_task")).select("task_id", "memory_id", "memory_type", "updated_at")
    found = working.unionByName(_for_tasks(tasks, of("episodic"), {"m_agent": "agent_id", "m_wf": "workflow_id"}, limit)).unionByName(_for_tasks(tasks, of("semantic"), {}, limit)).unionByName(_for_tasks(tasks, of("procedural"), {"m_wf": "workflow_id"}, limit))
    found = found if tagged is None else found.unionByName(tagged)
    return top_k(found, ["task_id", "memory_type"], [F.desc("updated_at"), F.col("memory_id")], limit).select("task_id", "memory_type", "rank", "memory_id")


def task_summaries(bundle: DataFrame, mem: DataFrame) -> DataFrame:
    """task_id and summary of a bundle: three lessons, three events, two procedures, the count of working rows."""
    rows = bundle.join(mem.select("memory_id", "concept", "abstraction", "event_type", "title", "procedure_name", "version"), "memory_id")
    line = (
        F.when(_is("semantic"), F.concat(F.lit("Lesson: "), "concept", F.lit(" — "), "abstraction"))
        .when(_is("episodic"), F.concat(F.lit("Past event ("), "event_type", F.lit("): "), "title"))
        .when(_is("procedural"), F.concat(F.lit("Procedure: "), "procedure_name", F.lit(" v"), F.col("version").cast("string")))
    )
    shown = F.when(_is("procedural"), F.col("rank") <= 2).when(_is("working"), F.lit(False)).otherwise(F.col("rank") <= 3)
    place = F.when(_is("semantic"), 1).when(_is("episodic"), 2).otherwise(3)
    rows = rows.withColumns({"line": F.when(shown, line), "place": place})
    grouped = rows.groupBy("task_id").agg(F.sort_array(F.collect_list(F.when(shown, F.struct("place", "rank", "line")))).alias("ls"), F.count_if(_is("working")).alias("w"))
    text = F.transform("ls", lambda x: x.line)
    active = F.concat(F.lit("Active working context: "), F.col("w").cast("string"), F.lit(" item(s)"))
    return grouped.select("task_id", F.array_join(F.when(F.col("w") > 0, F.array_append(text, active)).otherwise(text), "\n").alias("summary"))


def record_outcomes(runs: DataFrame) -> DataFrame:
    """Finished task runs (task_id, workflow_id, status, ended_at, steps) as episodic rows."""
    ok = F.col("status") == "completed"
    title = F.concat(F.lit("Workflow "), "workflow_id", F.lit(" "), F.col("status"))
    return runs.filter(F.col("status").isin("completed", "failed")).select(
        F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat(F.lit("outcome:"), "task_id"), 256), 1, 20)).alias("memory_id"), F.lit("episodic").alias("memory_type"), F.lit("active").alias("status"), F.when(ok, "workflow_execution").otherwise("failure").alias("event_type"),
        title.alias("title"), F.concat(F.lit("Task "), "task_id", F.lit(" "), F.col("status"), F.lit(" with "), F.col("steps").cast("string"), F.lit(" step(s)")).alias("summary"), F.col("ended_at").alias("occurred_at"), F.col("task_id").alias("source_ref"), F.array("workflow_id", "status").alias("tags"),
    )


def close_runs(mem: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """mem after finished task runs (as record_outcomes takes them): an episodic row a run, and the task's working memory promoted with the run's title.

    Of several active working rows of a task the first by id is promoted, as workflow_completion allows; a task without one gets the
    outcome only. A run told twice makes the same rows once.
    """
    done = materialized(record_outcomes(runs), "outcomes")
    first = mem.filter(F.expr(ACTIVE) & _is("working") & F.col("task_id").isNotNull()).groupBy("task_id").agg(F.min("memory_id").alias("source_memory_id"))
    told = done.groupBy("source_ref").agg(F.max_by("title", "occurred_at").alias("want_title"), F.max_by("summary", "occurred_at").alias("want_summary"))
    asks = told.join(first, F.col("source_ref") == F.col("task_id")).select("source_memory_id", F.lit("episodic").alias("target_type"), F.lit("workflow_completion").alias("policy"), F.lit(False).alias("approved"), "want_title", "want_summary")
    outcomes = done.dropDuplicates(["memory_id"]).join(mem.select("memory_id"), "memory_id", "left_anti").withColumns({"created_at": as_of, "updated_at": as_of})
    rows = outcomes.select(*[(F.col(c) if c in outcomes.columns else F.lit(None)).cast(t).alias(c) for c, t in mem.dtypes])
    return promote(mem, asks, as_of).unionByName(rows)
