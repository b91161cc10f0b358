"""URL filter: explicit rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host and shrunk through beta-binomial priors:
the corpus is the prior of a public suffix, the suffix of a registered domain, the domain of a host.
How strongly a level shrinks (its prior weight) is estimated from the spread between its groups by
the method of moments. A host is blocked when the lower bound of its posterior bad rate lies above
the tolerated rate, so a host that nobody labelled is judged by its domain and suffix and is only
blocked on evidence.

DataFrame functions only. Counts combine before the shuffle, so a host with a third of all pages
costs one row per task; the join back is an equi join that adaptive execution splits on a hot host.

Defined results: null urls and urls without ``://`` have empty host and path, fit no rule and are
judged by the corpus rate. Several labels of one page count once, as bad if one of them is. Repeated
page rows are judged each. Empty labels leave a flat prior: everything not ruled is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.tables import LOWER, UPPER, ascii_lower, read

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TOLERATED = 0.25   # bad rate that a host may have
Z = 1.645          # one-sided 95 % bound
WEIGHT = (1.0, 1000.0)  # range of a level's prior weight, in labelled pages


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null urls and urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null. The rule list is a short constant."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _weight(groups: DataFrame, n: str, bad: str, mean: str) -> Column:
    """Prior weight of a level by moments: excess of (bad - n mean)^2 over the binomial variance."""
    v = F.col(mean) * (1 - F.col(mean))
    excess = F.sum(F.pow(F.col(bad) - F.col(n) * F.col(mean), 2) - F.col(n) * v)
    room = F.sum(F.col(n) * (F.col(n) - 1) * v)
    rho = F.when(room > 0, excess / room)
    low, high = WEIGHT
    inside = F.when(rho <= 1 / (high + 1), F.lit(high)).when(rho >= 1 / (low + 1), F.lit(low)).otherwise(1 / rho - 1)
    return groups.agg(F.coalesce(inside, F.lit(low))).scalar()


def _shrink(groups: DataFrame, mean: str, out: str) -> DataFrame:
    """Posterior mean of each group under its parent's ``mean``."""
    w = _weight(groups, "n", "bad", mean)
    return groups.withColumn("_w", w).withColumn(out, (F.col("bad") + F.col("_w") * F.col(mean)) / (F.col("n") + F.col("_w")))


def host_posteriors(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, a, b: beta posterior of the bad rate for every host of ``pages`` (host, page_id).

    ``outcomes`` has page_id and bad (0/1), one row per page.
    """
    hosts = (
        pages.join(outcomes, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
        .withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0))
        .withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1.0)).scalar()
    suffixes = _shrink(suffixes.withColumn("rate", rate), "rate", "suffix_mean").select("suffix", "suffix_mean")
    domains = _shrink(domains.join(suffixes, "suffix"), "suffix_mean", "domain_mean").select("domain", "domain_mean")
    hosts = _shrink(hosts.join(domains, "domain"), "domain_mean", "host_mean")
    return hosts.select(
        "host",
        (F.col("bad") + F.col("_w") * F.col("domain_mean")).alias("a"),
        (F.col("n") - F.col("bad") + F.col("_w") * (1 - F.col("domain_mean"))).alias("b"),
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    tolerated: float = TOLERATED,
    z: float = Z,
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, bad_rate, bad_low per page row."""
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    judged = judged.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    low = F.round(mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9)
    return (
        judged.join(host_posteriors(judged.select("page_id", "host"), outcomes), "host")
        .select(
            "page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"),
            F.coalesce("_rule.verdict", F.when(low > tolerated, "block").otherwise("allow")).alias("verdict"),
            mean.alias("bad_rate"), low.alias("bad_low"),
        )
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """page_id, bad: a page is bad if a label calls it of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(read(spark, sf_dir, "pages"), page_outcomes(read(spark, sf_dir, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict")


def _check_rule() -> str:
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return f"CASE {cases.format(*[h + p for _, h, p in ordered])} END AS rule, CASE {cases.format(*[v for v, _, _ in ordered])} END AS ruled"


def _check_level(name: str, source: str, mean: str, out: str) -> str:
    low, high = WEIGHT
    return f"""
{name}_w AS (SELECT coalesce(CASE WHEN room > 0 THEN CASE WHEN excess / room <= {1 / (high + 1)!r} THEN {high} WHEN excess / room >= {1 / (low + 1)!r} THEN {low} ELSE 1 / (excess / room) - 1 END END, {low}) AS w
  FROM (SELECT sum(pow(bad - n * {mean}, 2) - n * {mean} * (1 - {mean})) AS excess, sum(n * (n - 1) * {mean} * (1 - {mean})) AS room FROM {source})),
{name} AS (SELECT s.*, w, (bad + w * {mean}) / (n + w) AS {out} FROM {source} s, {name}_w)"""


CHECK = f"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
ruled AS (SELECT page_id, host, path, {_check_rule()} FROM parsed),
outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
hosts0 AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, regexp_extract(host, '([^.]*\\.)?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix
  FROM ruled LEFT JOIN outcomes USING (page_id) GROUP BY host),
domains0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts0 GROUP BY 1, 2),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains0 GROUP BY 1),
suffixes1 AS (SELECT *, (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM suffixes0) AS rate FROM suffixes0),
{_check_level("suffixes", "suffixes1", "rate", "suffix_mean")},
domains1 AS (SELECT d.*, suffix_mean FROM domains0 d JOIN suffixes USING (suffix)),
{_check_level("domains", "domains1", "suffix_mean", "domain_mean")},
hosts1 AS (SELECT h.*, domain_mean FROM hosts0 h JOIN domains USING (domain)),
{_check_level("hosts", "hosts1", "domain_mean", "host_mean")},
posterior AS (SELECT host, bad + w * domain_mean AS a, n - bad + w * (1 - domain_mean) AS b FROM hosts)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN round(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) > {TOLERATED} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN posterior USING (host)
"""

QUERIES = {"op5_url_reputation": op5_url_reputation}
CHECKS = {"op5_url_reputation": CHECK}
