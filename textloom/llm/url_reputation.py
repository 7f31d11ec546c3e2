"""URL filters: path rules by host, and an empirical-Bayes reputation of hosts.

Labelled pages give each host a number of bad outcomes among its labelled pages.  A beta-binomial
model shrinks that rate towards the rate of the registered domain, which is shrunk towards that of
its suffix, which is shrunk towards the rate of all pages.  An IP address is a group of its own at every
level.  At each level the strength of the prior
is estimated by moments from the spread of the groups around their parents.  A url that no rule
decides is blocked if the lower bound of its host's posterior rate is above a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

#: So many rules become one expression; more become a table that is joined by host.
EXPRESSION_RULES = 1000
#: Public suffixes of several labels, by which registered domains are told; others have one label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "co.in", "co.kr")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


#: The rules of the registered query.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


@dataclass(frozen=True)
class Bound:
    """A url is blocked if mean - z * deviation of its host's posterior is above ``most``.

    ``weakest`` and ``strongest`` limit the estimated strength of a prior, in pages.
    """

    most: float = 0.5
    z: float = 1.645
    weakest: float = 1.0
    strongest: float = 1000.0


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, of equally long ones the first; else null."""
    found = F.lit(None)
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        at = (host == rule.host) | host.endswith("." + rule.host) if rule.host else F.lit(True)
        found = F.when(at & path.startswith(rule.path), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def with_rules(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows(host, path, ...)`` with ``fits``: struct(rule, verdict) of the rule that decides, or null.

    A few rules are one expression.  Any number of them are joined by host: each distinct (host, path) asks
    for its host and all domains above, and the longest rule whose path fits is chosen.
    """
    if len(rules) <= EXPRESSION_RULES:
        return rows.withColumn("fits", matching_rule(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<rule:string,verdict:string>"))
    table = rows.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict, len(r.text), -i) for i, r in enumerate(rules)], "at string, below string, rule string, verdict string, size int, nth int")
    table = materialize(table, "rules")
    labels = F.split("host", r"\.", -1)
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.array(F.lit("")))
    asked = materialize(rows.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(above)).alias("at")), "asked-hosts")
    best = asked.join(table, "at").where(F.startswith("path", "below")).groupBy("host", "path").agg(F.max(F.struct("size", "nth", "rule", "verdict")).alias("m"))
    best = materialize(best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.struct("m.rule", "m.verdict").alias("fits")), "deciding-rules")
    discard(table, asked)
    return rows.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")


def bare_host(host: Column) -> Column:
    """A host without user information, port and trailing dot; an IPv6 address with its brackets."""
    named = F.regexp_replace(host, r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(named, r":[0-9]*$", ""), r"\.$", "")


_IP = r"^(?:[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|\[.*\])$"


def suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The longest public suffix of a host; an IP address is its own."""
    bare = bare_host(host)
    found = F.substring_index(bare, ".", -1)
    for s in sorted(suffixes, key=len):
        found = F.when((bare == s) | bare.endswith("." + s), F.lit(s)).otherwise(found)
    return F.when(bare.rlike(_IP), bare).otherwise(found)


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix with one more label, or all of a host that has none; an IP address is its own."""
    bare, end = bare_host(host), suffix(host, suffixes)
    own = F.substring_index(F.substring(bare, F.lit(1), F.greatest(F.length(bare) - F.length(end) - 1, F.lit(0))), ".", -1)
    return F.when((end == bare) | (own == ""), bare).otherwise(F.concat(own, F.lit("."), end))


def _shrink(both: DataFrame, bound: Bound) -> DataFrame:
    """Posterior mean of groups ``both(n, bad, prior)`` with the prior mean of their parents.

    Moments: the weighted spread of group rates around their parents, less what binomial noise
    explains, is the variance of the prior; its ratio to m(1 - m) gives the strength.
    """
    rate, vary = F.col("bad") / F.col("n"), F.col("prior") * (1 - F.col("prior"))
    sums = both.where("n > 0").agg(F.sum(F.col("n") * (rate - F.col("prior")) * (rate - F.col("prior"))), F.sum(vary), F.sum(F.col("n") * vary)).first()
    spread, noise, whole = (float(x or 0) for x in sums)
    # expected: spread = noise + rho * (whole - noise), where rho = 1 / (strength + 1)
    rho = (spread - noise) / (whole - noise) if whole != noise else 0.0
    strength = min(bound.strongest, max(bound.weakest, 1 / rho - 1)) if rho > 0 else bound.strongest
    return both.withColumn("strength", F.lit(strength)).withColumn("mean", (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))


def host_reputation(pages: DataFrame, outcomes: DataFrame, bound: Bound = Bound(), suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, mean, lower) of every host of ``pages(page_id, url)``.

    ``outcomes(page_id, bad)`` labels some pages; null labels and pages without a label count for
    nothing, repeated labels count as often as they come.  Hosts without labels have the mean of
    their parent.  Without any label the rate is 0 and nothing is blocked.
    """
    labels = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = pages.select("page_id", url_host(F.col("url")).alias("host")).join(labels, "page_id", "left")
    hosts = hosts.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.select("host", registered_domain(F.col("host"), suffixes).alias("domain"), suffix(F.col("host"), suffixes).alias("suffix"), "n", "bad"), "hosts")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    tops = hosts.groupBy("suffix").agg(*counts).withColumn("prior", F.lit(float(bad) / float(n) if n else 0.0))
    tops = materialize(_shrink(tops, bound).select("suffix", F.col("mean").alias("prior")), "suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(*counts).join(tops, "suffix")
    domains = materialize(_shrink(domains, bound).select("domain", F.col("mean").alias("prior")), "domains")
    own = _shrink(hosts.join(domains, "domain"), bound)
    size = F.col("n") + F.col("strength")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return own.select("host", "domain", "suffix", "mean", F.greatest(F.lit(0.0), F.col("mean") - bound.z * deviation).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, bound: Bound = Bound(), suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, lower_bound) of every row of ``pages``.

    A rule decides where one fits, with the longest first; elsewhere the host's posterior does.  A
    null url, or one without ``://``, has an empty host and path and is judged as a page of the empty
    host.  Repeated rows are returned as often as they come; other columns are ignored.
    """
    known = materialize(host_reputation(pages, outcomes, bound, suffixes).select(F.col("host").alias("_known"), "mean", "lower"), "reputation")
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    return with_rules(rows, rules).join(known, F.col("host") == F.col("_known"), "left").select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"),
        F.coalesce(F.col("fits.verdict"), F.when(F.col("lower") > bound.most, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.round("mean", 6).alias("bad_rate"), F.round("lower", 6).alias("lower_bound"),
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad) from ``labels``: bad pages are toxic or of low quality."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("long").alias("bad"))


def _sql_level(name: str, groups: str, parents: str, on: str) -> str:
    return f"""
{name}_b AS (SELECT g.*, p.mean AS prior FROM ({groups}) g JOIN {parents} p USING ({on})),
{name}_r AS (SELECT (sum(n * power(bad / n - prior, 2)) - sum(prior * (1 - prior)))
             / nullif(sum(n * prior * (1 - prior)) - sum(prior * (1 - prior)), 0) AS rho FROM {name}_b WHERE n > 0),
{name} AS (SELECT *, (bad + s * prior) / (n + s) AS mean FROM {name}_b,
           (SELECT CASE WHEN rho > 0 THEN least(1000.0, greatest(1.0, 1 / rho - 1)) ELSE 1000.0 END AS s FROM {name}_r))"""


def oracle() -> str:
    case = " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{r.text}'" for r in sorted(RULES, key=lambda r: -len(r.text)))
    verdict = " ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in RULES)
    ends = " ".join(f"WHEN b = '{x}' OR suffix(b, '.{x}') THEN '{x}'" for x in sorted(SUFFIXES, key=lambda x: -len(x)))
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
      FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY 1),
c AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
             regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS b FROM u LEFT JOIN l USING (page_id) GROUP BY host),
e AS (SELECT *, CASE WHEN regexp_matches(b, '{_IP}') THEN b {ends} ELSE string_split(b, '.')[-1] END AS suffix FROM c),
h AS (SELECT host, n, bad, suffix, CASE WHEN own = '' OR suffix = b THEN b ELSE own || '.' || suffix END AS domain
      FROM (SELECT *, string_split(left(b, greatest(length(b) - length(suffix) - 1, 0)), '.')[-1] AS own FROM e)),
t AS (SELECT 1 AS one, CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END AS mean FROM h),
{_sql_level("s", "SELECT suffix, 1 AS one, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix", "t", "one")},
{_sql_level("d", "SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix", "s", "suffix")},
{_sql_level("k", "SELECT * FROM h", "d", "domain")},
j AS (SELECT page_id, host, path, CASE {case} END AS rule, mean, greatest(0.0, mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1))) AS low
      FROM u JOIN (SELECT host, mean, n, s FROM k) USING (host))
SELECT page_id, host, path, rule, CASE {verdict} WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(mean, 6) AS bad_rate, round(low, 6) AS lower_bound FROM j
"""
