"""Batch decision scoring: options, assumptions, tradeoffs, risks, scores, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..sources.tables import materialized, small

#: Strategy, dimensions, prefix, number of options, confidence of the first assumption, severity of risks.
STRATEGIES = (
    ("analytical", ["evidence strength", "feasibility", "cost of error"], "Analytically", 3, 0.7, "medium"),
    ("strategic", ["long-term impact", "competitive position", "resource commitment"], "Strategically", 3, 0.55, "medium"),
    ("operational", ["execution speed", "operational complexity", "maintenance burden"], "Operationally", 3, 0.65, "low"),
    ("creative", ["novelty", "adaptability", "stakeholder acceptance"], "Creatively", 4, 0.6, "medium"),
    ("first_principles", ["fundamental truth alignment", "dependency reduction", "reversibility"], "From first principles", 3, 0.5, "medium"),
    ("weighted_scoring", ["weighted impact", "weighted cost", "weighted risk"], "Score", 3, 0.6, "medium"),
)
STRATEGY_SCHEMA = "strategy string, dimensions array<string>, prefix string, n_options int, confidence double, severity string"
LIKELIHOOD, WIN, EVIDENCE_SIZE = 0.35, 0.08, 500
#: Texts of options and risks; {prefix}, {topic}, {hint} and {title} stand for the decision's own words.
CREATIVE = ("Creative alternative: reframe the problem", "Challenge the premise and explore an unconventional path.")
HINTED = "Pursue the approach: {hint}"
TEMPLATES = (
    ("{prefix} proceed with {topic}", "Take action aligned with {topic} based on available evidence."),
    ("{prefix} defer decision", "Gather more evidence before committing on {topic}."),
    ("{prefix} hybrid approach", "Combine incremental steps with a staged plan for {topic}."),
)
RISK = "Unforeseen factors may reduce effectiveness of '{title}'."


def _said(text: str, **words: Column) -> Column:
    """A fixed text with its words put in."""
    out = F.lit(text)
    for name, word in words.items():
        out = F.replace(out, F.lit("{" + name + "}"), word)
    return out


def strategies(spark, rows=STRATEGIES) -> DataFrame:
    """Strategies are rows: callers may add their own."""
    return spark.createDataFrame(list(rows), STRATEGY_SCHEMA)


def generate_options(requests: DataFrame, table: DataFrame) -> DataFrame:
    """decision_id, strategy, option (from 1), title, description: from the hints, else templates on the first keyword."""
    r = requests.join(small(table), "strategy")
    hinted = F.transform(F.slice(F.coalesce("option_hints", F.array().cast("array<string>")), 1, F.col("n_options")), lambda h: F.struct(F.substring(h, 1, 80).alias("title"), _said(HINTED, hint=h).alias("description")))
    topic = F.coalesce(F.get(tx.extract_keywords(F.col("question")), F.lit(0)), F.lit("the question"))
    pair = lambda t, d: F.struct(t.alias("title"), d.alias("description"))
    made = F.array(*[pair(*(_said(x, prefix=F.col("prefix"), topic=topic) for x in one)) for one in TEMPLATES])
    base = F.when(F.size(hinted) > 0, hinted).otherwise(F.slice(made, 1, F.col("n_options")))
    extra = F.array(pair(F.lit(CREATIVE[0]), F.lit(CREATIVE[1])))
    options = F.slice(F.when(F.col("strategy") == "creative", F.concat(base, extra)).otherwise(base), 1, F.col("n_options"))
    return r.select("decision_id", "strategy", F.posexplode(options).alias("i", "o")).select("decision_id", "strategy", (F.col("i") + 1).alias("option"), "o.title", "o.description")


def assumptions(requests: DataFrame, table: DataFrame, evidence: DataFrame) -> DataFrame:
    """decision_id, assumption (from 1), confidence."""
    seen = evidence.select("decision_id").distinct().withColumn("seen", F.lit(True))
    r = requests.join(small(table), "strategy").join(seen, "decision_id", "left")
    own = F.array(F.col("confidence"), F.greatest(F.lit(0.3), F.col("confidence") - 0.2))
    own = F.when(F.col("seen").isNull(), F.array_append(own, F.lit(0.4))).otherwise(own)
    own = F.when(F.col("strategy") == "first_principles", F.array_append(own, F.lit(0.6))).otherwise(own)
    return r.select("decision_id", F.posexplode(own).alias("i", "confidence")).select("decision_id", (F.col("i") + 1).alias("assumption"), "confidence")


def tradeoffs(requests: DataFrame, table: DataFrame, options: DataFrame) -> DataFrame:
    """decision_id, dimension, winner: dimension i is won by option i modulo their number."""
    n = options.groupBy("decision_id").agg(F.count("*").alias("n"))
    r = requests.join(small(table), "strategy").join(n, "decision_id")
    return r.select("decision_id", "n", F.posexplode("dimensions").alias("i", "dimension")).select("decision_id", "dimension", (F.col("i") % F.col("n") + 1).cast("int").alias("winner"))


def risks(options: DataFrame, table: DataFrame) -> DataFrame:
    return options.join(small(table).select("strategy", "severity"), "strategy").select("decision_id", "option", F.lit(LIKELIHOOD).alias("likelihood"), "severity", _said(RISK, title=F.col("title")).alias("description"))


def relevance(evidence: DataFrame) -> DataFrame:
    """decision_id, n_evidence, relevance: the mean relevance."""
    return evidence.groupBy("decision_id").agg(F.count("*").alias("n_evidence"), (F.sum("relevance") / F.count("*")).alias("mean_relevance"))


def score_options(requests: DataFrame, options: DataFrame, table: DataFrame, evidence: DataFrame) -> DataFrame:
    """options with wins and score."""
    wins = tradeoffs(requests, table, options).groupBy("decision_id", F.col("winner").alias("option")).agg(F.count("*").alias("wins"))
    titles = options.groupBy("decision_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("option", "title"))), lambda x: x.title), " ").alias("titles"))
    keywords = titles.select("decision_id", tx.extract_keywords(F.col("titles")).alias("kw"))
    o = options.join(small(table).select("strategy", "severity", F.size("dimensions").alias("n_dim")), "strategy").join(keywords, "decision_id").join(wins, ["decision_id", "option"], "left").join(relevance(evidence), "decision_id", "left")
    o = o.na.fill(0, ["wins", "n_evidence"]).na.fill(0.0, ["mean_relevance"])
    text = F.lower(F.concat_ws(" ", "title", "description"))
    overlap = F.size(F.filter("kw", lambda k: F.contains(text, k)))
    base = F.least(F.lit(1.0), F.lit(0.4) + overlap / F.greatest(F.size("kw"), F.lit(1)) * F.lit(0.3) + F.col("mean_relevance") * F.lit(0.3))
    penalty = F.lit(LIKELIHOOD) * F.when(F.col("severity") == "high", 0.3).otherwise(0.1)
    default = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + F.col("wins") * F.lit(WIN) - penalty))
    weighted = F.round(F.least(F.lit(1.0), F.lit(0.35) * F.col("mean_relevance") + F.lit(0.35) * F.col("wins") / F.greatest(F.col("n_dim"), F.lit(1)) + F.lit(0.30) * (1.0 - F.lit(LIKELIHOOD))), 4)
    score = F.round(F.when(F.col("strategy") == "weighted_scoring", weighted).otherwise(default), 9)
    return o.select("decision_id", "strategy", "option", "title", "description", "wins", score.alias("score"))


def decide(requests: DataFrame, table: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a decision: the best option, its score and the confidence."""
    requests = materialized(requests, "requests")  # five steps read them
    known = materialized(evidence.join(requests.filter("require_knowledge").select("decision_id"), "decision_id", "left_semi"), "evidence")
    options = materialized(generate_options(requests, table), "options")
    scored = score_options(requests, options, table, known)
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("decision_id").orderBy(F.desc("score"), "option"))).filter("r = 1").drop("r")
    sure = assumptions(requests, table, known).groupBy("decision_id").agg((F.sum("confidence") / F.count("*")).alias("sure"))
    out = best.join(sure, "decision_id").join(relevance(known), "decision_id", "left").join(requests.select("decision_id", "require_knowledge"), "decision_id").na.fill(0, ["n_evidence"]).na.fill(0.0, ["mean_relevance"])
    raw = F.lit(0.3) * F.col("sure") + F.lit(0.35) * F.col("mean_relevance") + F.lit(0.35) * F.col("score") - F.when(F.col("require_knowledge") & (F.col("n_evidence") == 0), 0.15).otherwise(0.0)
    return out.select("decision_id", "strategy", "option", "title", F.round("score", 6).alias("score"), "n_evidence", F.round(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 9), 4).alias("confidence"))


def evidence_of(bundle: DataFrame) -> DataFrame:
    """Evidence from context bundles: the first part of each text, relevance clamped to 0..1."""
    return bundle.select(F.col("query_id").alias("decision_id"), "rank", F.substring("text", 1, EVIDENCE_SIZE).alias("content"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("relevance"))


def list_decisions(decisions: DataFrame, needle: str = "", limit: int = 50, at: Column | None = None) -> DataFrame:
    rows = decisions.filter(F.contains(F.lower("question"), F.lit(needle.lower()))) if needle else decisions
    return rows.orderBy(F.desc("decision_id") if at is None else at.desc(), "decision_id").limit(limit)
