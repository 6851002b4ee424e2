"""Schedules, triggers, run history, model routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import small
from .indexing import running_sum

# --- Schedules

CRON_DAYS = 366


def cron_values(field: Column, low: int, high: int) -> Column:
    """The values of low..high a cron field admits: *, lists, ranges, steps (every value, or from a start).

    A part is read once as start, end and step; one that cannot be read admits nothing, like a * inside a list.
    """

    def span(part: Column) -> Column:
        base, step = F.substring_index(part, "/", 1), F.when(part.contains("/"), F.nullif(F.substring_index(part, "/", -1).try_cast("int"), F.lit(0))).otherwise(1)
        stepped = part.contains("/")
        start = F.when(stepped & (base == "*"), F.lit(0)).when(stepped, base.try_cast("int")).otherwise(F.substring_index(base, "-", 1).try_cast("int"))
        end = F.when(stepped, F.lit(high)).otherwise(F.substring_index(base, "-", -1).try_cast("int"))
        return F.struct(start.alias("start"), end.alias("end"), step.alias("step"))

    spans = F.when(field == "*", F.array(F.struct(F.lit(low).alias("start"), F.lit(high).alias("end"), F.lit(1).alias("step")))).otherwise(F.transform(F.split(field, ","), span))
    return F.filter(F.sequence(F.lit(low), F.lit(high)), lambda v: F.exists(spans, lambda p: F.coalesce(v.between(p.start, p.end) & ((v - p.start) % p.step == 0), F.lit(False))))


def _cron_days(asked: DataFrame, dow_base: int) -> DataFrame:
    """asked (cron_expression, day) with the hours and minutes the expression admits and its first day on or after day, and after it."""
    f = F.split(F.trim(F.regexp_replace("expression", r"\s+", " ")), " ")
    part = lambda i, low, high: cron_values(F.get(f, F.lit(i)), low, high)
    one = asked.select(F.col("cron_expression").alias("expression")).distinct().select("expression", (F.size(f) == 5).alias("good"), part(0, 0, 59).alias("minutes"), part(1, 0, 23).alias("hours"), part(2, 1, 31).alias("dom"), part(3, 1, 12).alias("months"), part(4, 0, 6).alias("dow"))
    rows = asked.join(one, F.col("cron_expression") == F.col("expression"))
    ok = lambda d: F.array_contains("dom", F.dayofmonth(d)) & F.array_contains("months", F.month(d)) & F.array_contains("dow", F.pmod(F.weekday(d) + F.lit(dow_base), F.lit(7)))
    days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(CRON_DAYS)), lambda i: F.date_add("day", i)), ok)
    rows = rows.filter("good").withColumn("days", days)
    return rows.select("expression", F.col("day").alias("of"), "minutes", "hours", F.get("days", F.lit(0)).alias("first"), F.when(F.get("days", F.lit(0)) == F.col("day"), F.get("days", F.lit(1))).otherwise(F.get("days", F.lit(0))).alias("later"))


def next_cron(schedules: DataFrame, after: Column, dow_base: int = 0) -> DataFrame:
    """schedules with cron_next: the first minute after the given one that all five fields admit, within a year.

    Each distinct expression is read once, and its next days are looked for once for each date that rows start from; a row only
    chooses the hour and minute. Monday is day dow_base.
    """
    s = schedules.withColumn("_start", F.date_trunc("minute", after).cast("timestamp_ntz") + F.expr("INTERVAL 1 MINUTE")).withColumn("_day", F.to_date("_start"))
    known = _cron_days(s.select("cron_expression", F.col("_day").alias("day")).distinct(), dow_base)
    s = s.join(known, (F.col("cron_expression") == F.col("expression")) & (F.col("_day") == F.col("of")), "left")
    h, m = F.hour("_start"), F.minute("_start")
    first = lambda values, test: F.get(F.filter(values, test), F.lit(0))
    this_hour = F.when(F.array_contains("hours", h), first("minutes", lambda x: x >= m))
    next_hour = first("hours", lambda x: x > h)
    least = F.get("minutes", F.lit(0))
    today = F.when(F.col("first") == F.col("_day"), F.coalesce(h * 60 + this_hour, next_hour * 60 + least))
    at = lambda d, t: d.cast("timestamp_ntz") + F.make_dt_interval(mins=t)
    found = F.coalesce(at(F.col("_day"), today), at(F.col("later"), F.get("hours", F.lit(0)) * 60 + least))
    return s.withColumn("cron_next", F.when(found < F.col("_start") + F.expr("INTERVAL 525600 MINUTES"), found)).drop("_start", "_day", "expression", "of", "minutes", "hours", "first", "later")


def next_run(schedules: DataFrame, after: Column, dow_base: int = 0) -> DataFrame:
    """schedules (schedule_type, run_at, delay_seconds, interval_seconds, cron_expression) with next_run, null if there is none."""
    kind = F.col("schedule_type")
    plus = lambda c, default: after + F.make_dt_interval(secs=F.coalesce(F.nullif(c, F.lit(0)), F.lit(default)).cast("decimal(18,6)"))
    run = (
        F.when((kind == "one_time") & (F.col("run_at") > after), F.col("run_at"))
        .when(kind == "delayed", plus(F.col("delay_seconds"), 0))
        .when(kind == "recurring", plus(F.col("interval_seconds"), 3600))
    )
    is_cron = F.coalesce(kind == "cron", F.lit(False))
    cron = next_cron(schedules.filter(is_cron), after, dow_base).withColumnRenamed("cron_next", "next_run")
    return schedules.filter(~is_cron).withColumn("next_run", run).unionByName(cron)


def due(automations: DataFrame, as_of: Column) -> DataFrame:
    return automations.filter((F.col("status") == "enabled") & F.col("schedule_type").isNotNull() & (F.col("next_run_at") <= as_of))


# --- Triggers


def glob_to_regex(pattern: Column) -> Column:
    """A file-name glob as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def match_completions(completions: DataFrame, automations: DataFrame) -> DataFrame:
    """Finished workflows (task_id, workflow_id) and the enabled automations they fire; one without a source workflow fires for all."""
    a = automations.filter("status = 'enabled' AND trigger_type = 'workflow_completion'").select("automation_id", "source_workflow_id")
    bound = completions.join(a.filter("source_workflow_id <> ''"), F.col("workflow_id") == F.col("source_workflow_id"))
    free = completions.crossJoin(small(a.filter("source_workflow_id IS NULL OR source_workflow_id = ''")))
    return bound.unionByName(free).select("task_id", "workflow_id", "automation_id")


def match_file_events(events: DataFrame, automations: DataFrame, few: int = 10_000) -> DataFrame:
    """Changed paths and the enabled automations whose watched prefix and name glob fit.

    Up to few automations are broadcast; more are joined by shuffle on the prefixes of the path.
    """
    a = automations.filter("status = 'enabled' AND trigger_type = 'filesystem'").select("automation_id", F.coalesce("watch_path", F.lit("")).alias("watch"), glob_to_regex(F.coalesce(F.nullif("watch_pattern", F.lit("")), F.lit("*"))).alias("glob"))
    fits = F.rlike(F.regexp_extract("path", r"([^/]*)$", 1), F.col("glob"))
    if a.limit(few + 1).count() <= few:
        found = events.join(F.broadcast(a), F.startswith("path", F.col("watch")) & fits)
    else:
        prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left("path", n))
        found = events.withColumn("prefix", F.explode(prefixes)).join(a, F.col("prefix") == F.col("watch")).filter(fits)
    return found.select("event_id", "path", "automation_id")


# --- Runs


def active_runs(executions: DataFrame, limit: int) -> DataFrame:
    """For each start the number of its automation's runs open then (itself included), flagged over the limit; ends count before starts at equal times.

    A day's steps are summed in one task, with what the days before left open: an automation's history is never in one.
    """
    start = executions.select("automation_id", "execution_id", F.col("started_at").alias("at"), F.lit(1).alias("step"))
    end = executions.select("automation_id", "execution_id", F.col("ended_at").alias("at"), F.lit(-1).alias("step"))
    rows = running_sum(start.unionByName(end), ["automation_id"], F.unix_date(F.to_date("at")), ["at", "step", "execution_id"], F.col("step"), "active").filter("step = 1")
    return rows.select("automation_id", "execution_id", "active", (F.col("active") > limit).alias("over_limit"))


def run_history(executions: DataFrame, automation_id: str | None = None, limit: int = 50) -> DataFrame:
    rows = executions if automation_id is None else executions.filter(F.col("automation_id") == automation_id)
    return rows.orderBy(F.desc("started_at"), "execution_id").limit(limit)


# --- Routing

#: Provider, model, context length, local, latency, cost, reasoning, coding, structured output, multimodal; in order of preference.
PROFILES = (
    ("ollama", "llama3.2", 8192, True, 0.9, 1.0, 0.6, 0.6, False, False),
    ("openai", "gpt-4o", 128000, False, 0.6, 0.3, 0.9, 0.85, True, True),
    ("anthropic", "claude-sonnet-4-20250514", 200000, False, 0.55, 0.35, 0.95, 0.9, True, False),
    ("gemini", "gemini-2.0-flash", 1000000, False, 0.7, 0.5, 0.85, 0.8, False, True),
    ("deepseek", "deepseek-chat", 64000, False, 0.5, 0.7, 0.88, 0.92, False, False),
    ("groq", "llama-3.3-70b", 128000, False, 0.95, 0.6, 0.75, 0.5, False, False),
    ("openrouter", "auto", 128000, False, 0.5, 0.5, 0.8, 0.8, False, False),
)
PROFILE_SCHEMA = "provider string, model string, context_length int, is_local boolean, latency double, cost double, reasoning double, coding double, structured_ok boolean, multimodal_ok boolean"


def profiles(spark, rows=PROFILES) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{PROFILE_SCHEMA}, place int")


def route_requests(requests: DataFrame, models: DataFrame, healthy: list[str], default: str = "ollama", prefer_local: bool = True) -> DataFrame:
    """request_id, provider, model, score: the best healthy profile of each request.

    requests: request_id, priorities, min_context, structured, multimodal, override_provider. Models that fail a
    wish leave; where none is left all healthy ones stand; where none is healthy the default does. The table of
    models is a control table, broadcast while it is small.
    """
    wish = F.when((F.size("priorities") == 0) & F.lit(prefer_local), F.array(F.lit("local"))).otherwise(F.col("priorities"))
    r = requests.withColumn("wish", wish)
    m = models.filter(F.col("provider").isin(*healthy) if healthy else F.lit(False))
    pairs = r.join(small(m), F.lit(True), "left")
    ok = ((F.col("min_context") == 0) | (F.col("context_length") >= F.col("min_context"))) & (~F.col("structured") | F.col("structured_ok")) & (~F.col("multimodal") | F.col("multimodal_ok")) & (~F.array_contains("wish", "local") | F.col("is_local"))
    mean = (F.col("reasoning") + F.col("coding")) / 2
    of = lambda p: F.when(p == "latency", F.col("latency")).when(p == "cost", F.col("cost")).when(p == "coding", F.col("coding")).when(p == "reasoning", F.col("reasoning")).when(p == "local", F.when(F.col("is_local"), 1.0).otherwise(0.0)).when(p == "quality", mean)
    scores = F.filter(F.transform("wish", of), lambda x: x.isNotNull())
    score = F.when(F.size("wish") == 0, mean).when(F.size(scores) == 0, F.lit(0.5)).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / F.size(scores))
    rows = pairs.withColumns({"ok": F.coalesce(ok, F.lit(False)), "score": F.round(score, 9)})
    # The best of those that pass, else of all: one aggregation, no window.
    best = rows.groupBy("request_id").agg(F.max_by(F.struct("provider", "model", "score"), F.struct("ok", "score", -F.col("place"))).alias("b"), F.first("override_provider").alias("forced"))
    forced = F.col("forced").isNotNull()
    none = F.col("b.provider").isNull()
    return best.select("request_id", F.when(forced, F.col("forced")).when(none, F.lit(default)).otherwise(F.col("b.provider")).alias("provider"), F.when(forced | none, F.lit("default")).otherwise(F.col("b.model")).alias("model"), F.when(forced, 1.0).when(none, 0.0).otherwise(F.col("b.score")).alias("score"))
