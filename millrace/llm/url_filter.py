"""URL filters: allow and block rules by host and path, and trust spread over the link graph for the rest.

Rules fit a host and its subdomains where the path starts with the rule's; the longest fit decides. Pages that no
rule fits get their host's verdict: hosts of which most pages are allowed by rules are trusted seeds, hosts of which
most are blocked are blocked seeds; trust runs along the links between hosts (personalised PageRank), distrust runs
against them, and a host is blocked if its distrust is over ``RATIO`` times its trust. DataFrame functions only.

A kind's mass is ``MASS`` in all. Mass that reaches a host without links is not handed on. Rounds start at the restart
share, so masses only grow; they go on until no host is new and none grows by over a millionth of its mass, or until
less than one unit moves in all: then what is still to come is under 0.85/0.15 units, of ``MASS``, over all hosts
together. Verdicts compare the masses as they are, the columns have them rounded. ``OP9_SQL`` has ``ITERATIONS``
rounds and wants a scheme in links, so the two agree where no host links to another, as in the given pages.

Defined results: a null url or one without ``://`` has an empty host and path, which no rule and no link concerns,
and is allowed; repeated pages count as often as they stand; links of a host to itself and repeated links between
two hosts count once or not at all; null html has no links; a host without seeds around it is allowed; urls and pages
are read whole, however long; other columns of the pages, whatever their names, are not carried; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, bounded, column, cut

#: (host, path, verdict) of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MASS = 10**15
#: The rounds of ``OP9_SQL``.
ITERATIONS = 8
#: After 213 rounds under one of the 10**15 units is on the move, so this is not reached.
MAX_ROUNDS = 400
#: A host is settled when a round adds less than this share to its mass.
SETTLED = 1e-6
RATIO = 2


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules of itself and the domains above it, longest first."""
    parts = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("rule_host"))
    fits = above.join(rules, "rule_host")
    ranked = F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("rank"), (-F.length("rule_host")).alias("rank_host"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("path"), "verdict")
    return fits.groupBy("host").agg(F.sort_array(F.collect_set(ranked)).alias("rules"))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): distinct links between different hosts."""
    targets = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    links = pages.select(url_host(F.col(url_col)).alias("src"), F.explode(F.array_distinct(targets)).alias("to"))
    return links.select("src", ascii_lower(F.col("to")).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").distinct()


def spread(links: DataFrame, seeds: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(kind, host, mass) of the seeds (kind, host): kind ``trust`` runs along links, ``distrust`` against them."""
    forward = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"))
    edges = forward.union(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    degrees = edges.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree"))
    counts = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    share = seeds.join(F.broadcast(counts), "kind").select("kind", "host", F.expr(f"{MASS}L div n * 15 div 100").cast("double").alias("mass"))
    restart, edges, degrees = cut(share), cut(edges), cut(degrees)
    if not edges.limit(1).count():
        return restart
    rank = restart
    for _ in range(max_rounds):
        given = rank.join(degrees, ["kind", "host"]).select("kind", "host", (F.col("mass") * 0.85 / F.col("degree")).alias("mass"))
        moved = edges.join(given, ["kind", "host"]).select("kind", F.col("to").alias("host"), "mass").union(restart)
        both = moved.withColumn("old", F.lit(None).cast("double")).union(rank.select("kind", "host", F.lit(0.0), "mass"))
        grown = both.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.max("old").alias("old"))
        seen, growth = Observation(), F.col("mass") - F.coalesce("old", F.lit(0.0))
        new = F.col("old").isNull() | (growth > F.col("old") * SETTLED)
        rank = cut(grown.observe(seen, F.count_if(new).alias("changed"), F.sum(growth).alias("moved"))).select("kind", "host", "mass")
        if not seen.get["changed"] or (seen.get["moved"] or 0.0) < 1:
            return rank
    raise RuntimeError(f"trust did not settle in {max_rounds} rounds")


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url_col: str = "url", html_col: str = "html", max_rounds: int = MAX_ROUNDS, ratio: int = RATIO) -> DataFrame:
    """(page id, host, path, rule, verdict, trust, distrust) of each page; ``rules`` has rule_host, rule_path, verdict."""
    pages = pages.select(column(page_id).alias("page_id"), column(url_col).alias("url"), column(html_col).alias("html"))
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    fits = cut(host_rules(hosts.where("host <> ''").select("host"), rules))

    def ruled(df: DataFrame) -> DataFrame:
        first = F.filter("rules", lambda r: F.startswith(df["path"], r["path"]))
        return df.join(bounded(fits), "host", "left").withColumn("hit", F.when(F.size("rules") > 0, F.try_element_at(first, F.lit(1)))).drop("rules")

    votes = ruled(urls).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit.verdict") == "allow").alias("allowed"), F.count_if(F.col("hit.verdict") == "block").alias("blocked"))
    kind = F.when(F.col("allowed") * 2 > F.col("n"), "trust").when(F.col("blocked") * 2 > F.col("n"), "distrust")
    seeds = cut(votes.select(kind.alias("kind"), "host").where("kind IS NOT NULL"))
    rank = spread(host_links(pages), seeds, max_rounds)
    by_host = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("distrust"))
    judged = ruled(urls).join(bounded(cut(by_host)), "host", "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), own).alias("verdict"), *[F.round(k).cast("long").alias(k) for k in ("trust", "distrust")])


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def op9_url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages, rule_table(pages.sparkSession))


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    steps, last = [], "start"
    for i in range(ITERATIONS):
        steps.append(f"""r{i} AS MATERIALIZED (
  SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
    SELECT e.kind, e.dst AS host, ({last}.mass * 85 // 100) // d.degree AS mass FROM {last} JOIN degrees d USING (kind, host) JOIN edges e ON e.kind = {last}.kind AND e.src = {last}.host
    UNION ALL SELECT kind, host, mass * 15 // 100 FROM start) GROUP BY kind, host)""")
        last = f"r{i}"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {rules}
), u AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, html,
    {low.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fit AS MATERIALIZED (
  SELECT r, rule_host || rule_path AS rule, verdict FROM u JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
), votes AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE verdict = 'allow') AS allowed, count(*) FILTER (WHERE verdict = 'block') AS blocked
  FROM u LEFT JOIN fit USING (r) WHERE host <> '' GROUP BY host
), seeds AS (
  SELECT CASE WHEN allowed * 2 > n THEN 'trust' ELSE 'distrust' END AS kind, host FROM votes WHERE allowed * 2 > n OR blocked * 2 > n
), start AS MATERIALIZED (
  SELECT kind, host, {MASS} // count(*) OVER (PARTITION BY kind) AS mass FROM seeds
), links AS MATERIALIZED (
  SELECT DISTINCT host AS src, dst FROM (SELECT host, {low.format(chr(39) + chr(39) + " || unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*[\"'']?[a-z][a-z0-9+.-]*://([^/?#\"''\\s>]+)', 1))")} AS dst FROM u) WHERE host <> dst AND host <> '' AND dst <> ''
), edges AS MATERIALIZED (
  SELECT 'trust' AS kind, src, dst FROM links UNION ALL SELECT 'distrust', dst, src FROM links
), degrees AS MATERIALIZED (SELECT kind, src AS host, count(*) AS degree FROM edges GROUP BY kind, src
), {", ".join(steps)}, by_host AS (
  SELECT host, CAST(coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0) AS BIGINT) AS distrust FROM {last} GROUP BY host
)
SELECT page_id, u.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > {RATIO} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM u LEFT JOIN fit USING (r) LEFT JOIN by_host USING (host)
"""


OP9_SQL = _sql()
