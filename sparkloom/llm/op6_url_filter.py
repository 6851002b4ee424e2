"""URL filter by rules and link-graph propagation (DataFrame functions only).

Rules name a host and a path prefix and decide first. For the other urls the hosts decide: trust flows
from the hosts of allowed pages along links by personalised PageRank, distrust flows from the hosts of
blocked pages along the reversed links, and a host whose distrust exceeds its trust by the threshold is
blocked. The two are compared in pages (scores times the number of seed pages, not rounded), so a verdict does not
change because unrelated hosts are added; the columns hold shares of all seeds, rounded to 9 digits.

A rule's path starts with the slash: one of a bare host fits every path but the empty one.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and takes no
part in the graph (verdict allow). A null html has no links. Repeated rows are judged alike; repeated
links count once for a pair of hosts. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, ROUNDS, THRESHOLD, MAX_RULES = 0.85, 8, 1e-6, 10_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null.

    The rules are a literal map from host to its (path, rule, verdict) entries; a row looks up the
    host's suffixes at label borders, so nothing is joined or shuffled.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit a literal map")
    by_host: dict[str, list] = {}
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        by_host.setdefault(h, []).append((f"/{p}" if p else "/", rule, verdict))
    entry = lambda p, r, v, h: F.struct(F.lit(len(h)).alias("hl"), F.lit(len(p)).alias("pl"), F.lit(p).alias("p"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
    pairs = [x for h, es in by_host.items() for x in (F.lit(h), F.array(*[entry(*e, h) for e in es]))]
    known = F.create_map(*pairs)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda a: a.isNotNull())), lambda r: F.startswith(path, r.p))
    best = F.array_max(fits)
    return F.when((F.size(fits) > 0) & (host != ""), F.struct(best.rule.alias("rule"), best.verdict.alias("verdict")))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) between different hosts, from absolute href values."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)href\s*=\s*[\"']?((?:https?:)?//[^\s\"'>]+)"), F.lit(1))
    out = pages.select("host", F.explode(hrefs).alias("href"))
    dst = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href")))
    return out.select(F.col("host").alias("src"), dst.alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank (host, score): seeds (host, seed) restart, mass moves along edges (src, dst).

    The mass of a host without links returns to nobody, so scores only fall short of one in sum.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = stored(edges.join(degree, "src").withColumn("share", 1.0 / F.col("degree")), "op6-edges")
    start = stored(seeds.select("host", (F.col("seed") * (1 - damping)).alias("base")), "op6-seeds")
    rank = seeds.select("host", F.col("seed").alias("score"))
    if weighted.isEmpty():  # nothing flows: only the restart is left
        return start.select("host", F.col("base").alias("score"))
    for _ in range(rounds):
        flow = weighted.join(rank, weighted.src == rank.host).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share") * damping).alias("score"))
        both = flow.select("host", "score").union(start.select("host", F.col("base").alias("score")))
        rank = stored(both.groupBy("host").agg(F.sum("score").alias("score")), "op6-rank")
    return rank


def judge_urls(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages (page_id, url, html)."""
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = url.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("by_rule"), "html")
    hosts = stored(ruled.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad")), "op6-hosts")
    edges = stored(host_edges(ruled), "op6-links")
    totals = hosts.agg(F.sum("good"), F.sum("bad")).first()
    seed = lambda c, total: hosts.filter(F.col(c) > 0).select("host", (F.col(c) / F.lit(float(total or 1))).alias("seed"))
    trust = propagate(edges, seed("good", totals[0]), rounds, damping)
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seed("bad", totals[1]), rounds, damping)
    scores = stored(
        reduce(lambda a, b: a.union(b), [hosts.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")), trust.select("host", F.col("score"), F.lit(0.0)), distrust.select("host", F.lit(0.0), F.col("score"))])
        .groupBy("host")
        .agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
        .select("host", F.round("t", 9).alias("trust"), F.round("d", 9).alias("distrust"), (F.col("d") * F.lit(float(totals[1] or 1)) - F.col("t") * F.lit(float(totals[0] or 1))).alias("excess")),
        "op6-scores",
    )
    judged = ruled.drop("html").join(scores, "host", "left")
    bad = F.coalesce("excess", F.lit(0.0)) > threshold
    verdict = F.coalesce(F.col("by_rule"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op6_url_filter(spark, sf_dir) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """The same in DuckDB SQL, the rounds written out."""
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda x: low(f"regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1)")
    values = []
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        values.append(f"('{verdict}', '{rule}', '{h}', '{'/' + p if p else '/'}')")
    ctes = [
        f"pg AS (SELECT row_number() OVER () AS rid, page_id, {host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages)",
        f"rl AS (SELECT * FROM (VALUES {', '.join(values)}) t(verdict, rule, h, p))",
        "fit AS (SELECT rid, arg_max(rule, [length(h), length(p)]) AS rule, arg_max(verdict, [length(h), length(p)]) AS by_rule FROM pg JOIN rl ON host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)",
        "rd AS (SELECT pg.*, fit.rule, fit.by_rule FROM pg LEFT JOIN fit ON pg.rid = fit.rid)",
        "hs AS (SELECT host, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad FROM rd WHERE host <> '' GROUP BY host)",
        f"ln AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, {host("CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']?((?:https?:)?//[^\\s\"''>]+)', 1)) AS href FROM rd)) WHERE src <> '' AND dst <> '' AND src <> dst)",
    ]
    for name, seed, src, dst in (("tr", "good", "src", "dst"), ("di", "bad", "dst", "src")):
        ctes += [
            f"{name}_w AS (SELECT {src} AS s, {dst} AS d, 1.0::DOUBLE / count(*) OVER (PARTITION BY {src}) AS share FROM ln)",
            f"{name}_s AS (SELECT host, {seed} / (SELECT CAST(sum({seed}) AS DOUBLE) FROM hs) AS seed FROM hs WHERE {seed} > 0)",
            f"{name}0 AS (SELECT host, CASE WHEN (SELECT count(*) FROM ln) = 0 THEN seed * {1 - DAMPING}::DOUBLE ELSE seed END AS score FROM {name}_s)",
        ]
        for i in range(ROUNDS):
            ctes.append(f"{name}{i + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT d AS host, score * share * {DAMPING}::DOUBLE AS score FROM {name}_w JOIN {name}{i} ON s = host UNION ALL SELECT host, seed * {1 - DAMPING}::DOUBLE FROM {name}_s) GROUP BY host)")
    ctes.append(f"sc AS (SELECT h.host, round(coalesce(t.score, 0.0::DOUBLE), 9) AS trust, round(coalesce(d.score, 0.0::DOUBLE), 9) AS distrust, coalesce(d.score, 0.0::DOUBLE) * (SELECT CAST(greatest(sum(bad), 1) AS DOUBLE) FROM hs) - coalesce(t.score, 0.0::DOUBLE) * (SELECT CAST(greatest(sum(good), 1) AS DOUBLE) FROM hs) AS excess FROM hs h LEFT JOIN tr{ROUNDS} t ON t.host = h.host LEFT JOIN di{ROUNDS} d ON d.host = h.host)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, rd.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(excess, 0.0::DOUBLE) > {THRESHOLD}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0.0::DOUBLE) AS trust, coalesce(distrust, 0.0::DOUBLE) AS distrust FROM rd LEFT JOIN sc ON sc.host = rd.host"


ORACLE = _oracle()
