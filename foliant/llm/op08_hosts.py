"""URL filters: allow and block rules first, empirical-Bayes host reputation for the rest.

Labelled page outcomes are counted per host, registered domain and public
suffix.  Each level's bad rate is shrunk towards its parent's by a
beta-binomial prior whose strength is fitted to that level by moments; a page
without a rule is blocked when the lower bound of its host's posterior bad rate
reaches a threshold.  The bound is the posterior mean less ``z`` posterior
deviations, the normal approximation of the Beta's quantile.  Everything is
DataFrame expressions: one aggregation by host (partial sums first, so a host
with a third of all pages costs one row per task), then ever smaller
aggregations over hosts, domains and suffixes.

The public suffix of a host is its last label, or its last two where a generic
label stands before a country code (co.uk, com.mx, gov.in).  ``suffix_rules``
reads a list in the usual format of public suffix lists instead.

Edge cases: a null url, or one without ``://``, has empty host and path, fits
no rule, and gets the corpus-wide rate's verdict; empty tables give no rows;
columns beyond ``page_id`` and ``url`` are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Reputation:
    """Parameters of the method."""

    second_level: tuple[str, ...] = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gub", "mil", "ne", "net", "nic", "nom", "or", "org", "sch")  # generic labels before a country code
    rules_broadcast: int = 100_000  # rules of a suffix list that are sent to all tasks
    prior_bad: float = 1.0  # Beta prior of the corpus-wide bad rate
    prior_good: float = 1.0
    strength_least: float = 1.0  # limits of a level's fitted prior strength
    strength_most: float = 1000.0
    z: float = 1.645  # the bound is this many posterior deviations below the mean
    block_at: float = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule text, verdict); nulls where none fits."""
    text = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)) if text is None else text.when(fits, F.lit(rule_host + rule_path))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    return text, verdict


def suffix_of(host: Column, p: Reputation) -> Column:
    last_two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(last_two.rlike(rf"^(?:{'|'.join(p.second_level)})\.[a-z]{{2}}$"), last_two).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule, kind (plain, wild or exception) of a public suffix list: a rule a line, ``//`` before remarks, ``*.`` and ``!`` before a rule."""
    line = F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1))
    rows = spark.read.text(path).select(line.alias("r")).where("r <> '' and not startswith(r, '//')")
    kind = F.when(F.col("r").startswith("!"), "exception").when(F.col("r").startswith("*."), "wild").otherwise("plain")
    return rows.select(F.regexp_replace("r", r"^(!|\*\.)", "").alias("rule"), kind.alias("kind")).distinct()


def with_suffix(hosts: DataFrame, rules: DataFrame, p: Reputation) -> DataFrame:
    """``hosts(host, ...)`` with suffix by ``rules``: an exception's parent, else the longest rule that fits, else the last label."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.broadcast(rules) if rules.count() <= p.rules_broadcast else rules
    parent = lambda c: F.regexp_replace(c, r"^[^.]*\.", "")
    at = hosts.select("host", F.explode(ends).alias("end"))
    plain = at.join(known.where("kind = 'plain'").select(F.col("rule").alias("end")), "end").select("host", F.lit(False).alias("x"), F.col("end").alias("s"))
    wild = at.where(F.col("end").contains(".")).withColumn("rule", parent("end")).join(known.where("kind = 'wild'").select("rule"), "rule").select("host", F.lit(False).alias("x"), F.col("end").alias("s"))
    odd = at.join(known.where("kind = 'exception'").select(F.col("rule").alias("end")), "end").select("host", F.lit(True).alias("x"), parent("end").alias("s"))
    best = plain.union(wild).union(odd).groupBy("host").agg(F.max(F.struct("x", F.length("s").alias("n"), "s")).alias("b")).select("host", F.col("b.s").alias("_s"))
    return hosts.join(best, "host", "left").withColumn("suffix", F.coalesce("_s", F.regexp_extract("host", r"([^.]*)$", 1))).drop("_s")


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with the label before it; a host that is a bare suffix is its own domain."""
    lead = F.expr("substring(host, 1, greatest(length(host) - length(suffix) - 1, 0))")
    label = F.regexp_extract(lead, r"([^.]*)$", 1)
    return F.when(label == "", host).otherwise(F.concat(label, F.lit("."), suffix))


def _shrunk(level: DataFrame, keys: list[str], parent: str, p: Reputation) -> DataFrame:
    """Posterior mean of each row of a level (n, bad, and the parent's mean as ``parent``).

    The strength s of the prior Beta(parent * s, (1 - parent) * s) comes from the
    level's between-group variance by moments, over groups with an outcome."""
    # sum n (rate - m)^2 over sum n m (1 - m): 1/(1+s) plus sampling noise (groups / outcomes).
    x = level.withColumn("_m", F.col(parent))
    rate = F.col("bad") / F.col("n")
    fit = x.where("n > 0").agg(
        F.sum(F.round(F.col("n") * (rate - F.col("_m")) * (rate - F.col("_m")), 9)).alias("_between"),
        F.sum(F.round(F.col("n") * F.col("_m") * (1 - F.col("_m")), 9)).alias("_within"),
        F.sum("n").alias("_n"),
        F.count("*").alias("_groups"),
    )
    noise = F.col("_groups") / F.col("_n")
    rho = (F.col("_between") / F.when(F.col("_within") > 0, F.col("_within")) - noise) / F.when(noise < 1, 1 - noise)
    rho = F.greatest(F.lit(1.0 / (1 + p.strength_most)), F.least(F.lit(1.0 / (1 + p.strength_least)), F.coalesce(rho, F.lit(0.5))))
    fit = fit.select((1 / rho - 1).alias("_s"))
    return x.withColumn("_s", fit.scalar()).select(
        *keys,
        "n",
        "bad",
        ((F.col("bad") + F.col("_m") * F.col("_s")) / (F.col("n") + F.col("_s"))).alias("mean"),
        (F.col("n") + F.col("_s")).alias("weight"),
    )


def reputation(outcomes: DataFrame, p: Reputation = Reputation(), rules: DataFrame | None = None) -> DataFrame:
    """Host reputations from ``outcomes(host, bad)``; ``bad`` is 1, 0 or null (no outcome).  ``rules`` are those of a suffix list.

    Returns host, domain, suffix, n, bad, mean and bound, one row per distinct host."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), p)) if rules is None else with_suffix(hosts, rules, p)
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    total = hosts.agg(
        ((F.coalesce(F.sum("bad"), F.lit(0)) + p.prior_bad) / (F.coalesce(F.sum("n"), F.lit(0)) + p.prior_bad + p.prior_good)).alias("parent")
    )
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("parent", total.scalar())
    suffixes = _shrunk(suffixes, ["suffix"], "parent", p)
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", F.col("mean").alias("parent")), "suffix")
    domains = _shrunk(domains, ["domain", "suffix"], "parent", p)
    hosts = hosts.join(domains.select("domain", "suffix", F.col("mean").alias("parent")), ["domain", "suffix"])
    out = _shrunk(hosts, ["host", "domain", "suffix"], "parent", p)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return out.withColumn("bound", F.col("mean") - p.z * deviation)


def filter_urls(pages: DataFrame, rules=RULES, p: Reputation = Reputation(), suffixes: DataFrame | None = None) -> DataFrame:
    """Judge ``pages(page_id, url)``; outcomes are the verdicts of the rules, ``suffixes`` the rules of a suffix list."""
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", text).withColumn("_ruled", verdict)
    known = reputation(judged.select("host", F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0).alias("bad")), p, suffixes)
    return judged.join(known.select("host", "bound", "mean"), "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(F.col("_ruled"), F.when(F.round("bound", 9) >= p.block_at, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.round("mean", 6).alias("bad_rate"),
    )


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _level(name: str, source: str, keys: str) -> str:
    """SQL of one level: fit of the strength, then the posterior mean."""
    return f"""
{name}_fit AS (
  SELECT 1.0 / greatest(1.0 / 1001, least(0.5, coalesce((between_ / nullif(within_, 0) - g / n) / CASE WHEN g / n < 1 THEN 1 - g / n END, 0.5))) - 1 AS s
  FROM (SELECT sum(round(n * (bad / n - parent) * (bad / n - parent), 9)) AS between_, sum(round(n * parent * (1 - parent), 9)) AS within_,
        sum(n)::DOUBLE AS n, count(*)::DOUBLE AS g FROM {source} WHERE n > 0)),
{name} AS (
  SELECT {keys}, n, bad, (bad + parent * s) / (n + s) AS mean, n + s AS weight FROM {source}, {name}_fit)"""


SQL = f"""
WITH split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split),
labelled AS (
  SELECT *, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM ruled),
counted AS (
  SELECT host, count(said) AS n, coalesce(sum((said = 'block')::INT), 0) AS bad,
    CASE WHEN regexp_full_match(regexp_extract(host, '([^.]+\\.[^.]+)$', 1), '(?:{'|'.join(Reputation.second_level)})\\.[a-z]{{2}}')
      THEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix
  FROM labelled GROUP BY host),
hosts AS (
  SELECT *, CASE WHEN label = '' THEN host ELSE label || '.' || suffix END AS domain
  FROM (SELECT *, regexp_extract(substring(host, 1, greatest(length(host) - length(suffix) - 1, 0)), '([^.]*)$', 1) AS label FROM counted)),
suffix_in AS (
  SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) FROM hosts)::DOUBLE AS parent FROM hosts GROUP BY suffix),
{_level("suffixes", "suffix_in", "suffix")},
domain_in AS (
  SELECT h.domain, h.suffix, sum(h.n)::DOUBLE AS n, sum(h.bad)::DOUBLE AS bad, any_value(s.mean) AS parent FROM hosts h JOIN suffixes s USING (suffix) GROUP BY h.domain, h.suffix),
{_level("domains", "domain_in", "domain, suffix")},
host_in AS (
  SELECT h.host, h.n::DOUBLE AS n, h.bad::DOUBLE AS bad, d.mean AS parent FROM hosts h JOIN domains d USING (domain, suffix)),
{_level("known", "host_in", "host")}
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN round(mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)), 9) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(mean, 6) AS bad_rate
FROM labelled JOIN known USING (host)
"""
