"""URL filters: rules by host and path, and an empirical-Bayes reputation of hosts where no rule fits.

Outcomes of labelled pages are counted by host and shrunk in three levels: the share of good pages of a suffix is drawn
towards the overall share, a registered domain towards its suffix and a host towards its domain, each through a beta prior
whose strength is estimated from how much the groups of that level differ (moments of the beta-binomial). A page without a
rule is allowed where the lower posterior bound of its host, a quantile of its beta posterior, reaches a threshold: where the
posterior probability of a share below the threshold, an incomplete beta function, is small. All of it is DataFrame aggregation over
one row per host, stored once; only the overall share and three strengths come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import fresh, materialize, quoted
from arbor.llm.decontaminate import LOWER, UPPER

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


#: Well-known public suffixes of two labels. Others can be given in Reputation.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.my", "com.sg", "com.tr", "com.tw",
    "com.ua", "edu.au", "gov.au", "gov.br", "gov.cn", "gov.uk", "ne.jp", "net.au", "net.cn", "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk",
)
#: A host that is an address: four numbers, or in brackets.
ADDRESS = r"^(\d+\.\d+\.\d+\.\d+$|\[)"
#: From so many pages on (prior included) the incomplete beta function is taken for that of a normal logit.
MANY = 40_000


@dataclass(frozen=True)
class Reputation:
    """bound: least lower posterior bound of allowed hosts; risk: the quantile that this bound is; weakest, strongest: limits of a
    prior's strength in pages; suffixes: those of two labels, under which domains are registered."""

    bound: float = 0.7
    risk: float = 0.05
    weakest: float = 1.0
    strongest: float = 10000.0
    suffixes: tuple[str, ...] = SUFFIXES


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without it."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.when(at > 0, F.substr(url, at + 3)), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    return F.coalesce(F.regexp_extract(F.when(at > 0, F.substr(url, at + 3)), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r":\d*$", "")


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: a label more than the suffix. Ports don't count, an address is a domain of its own."""
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(ADDRESS), bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix: the last two labels where they are known as one, else the last; ``address`` for addresses."""
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(ADDRESS), "address").when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))


def _log_gamma(z: Column) -> Column:
    """By Stirling's series for z + 8, exact to 1e-11 for positive z."""
    w = z + 8
    series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5)
    lower = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7)
    return series - F.log(lower)


def _fraction(a: Column, b: Column, x: float | Column) -> Column:
    """The continued fraction of the incomplete beta function, two terms a step, of as many steps as it needs."""
    start = 1 / (1 - (a + b) * x / (a + 1))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def term(acc: Column, t: Column) -> Column:
        d, c = 1 / (1 + t * acc["d"]), 1 + t / acc["c"]
        return state(c, d, acc["h"] * c * d)

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.get(F.transform(F.array(term(acc, even)), lambda half: term(half, odd)), F.lit(0))

    steps = F.sequence(F.lit(1), (20 + 2 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(steps, state(F.lit(1.0), start, start), step, lambda acc: acc["h"])


def share_below(a: Column, b: Column, x: float) -> Column:
    """Probability that a share with the posterior Beta(a, b) is below x."""
    front = F.exp(a * math.log(x) + b * math.log(1 - x) + _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b))
    exact = F.when((a + b + 2) * x < a + 1, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    z = (math.log(x / (1 - x)) - F.log(a / b)) / F.sqrt(1 / a + 1 / b)
    return F.when(a + b > MANY, 0.5 * (1 + F.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3)))).otherwise(exact)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none; among equally long ones the first.

    The rules are literals of the plan: their number is the caller's and doesn't grow with the data.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        rule_host = rule_host.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame, parent_mean: Column, p: Reputation) -> float:
    """Strength of the beta prior of groups ``(n, s)`` around their parents' means, by moments."""
    mean = F.greatest(F.least(parent_mean, F.lit(0.999)), F.lit(0.001))
    noise = mean * (1 - mean)
    r = groups.where("n > 0").agg(
        F.sum((F.col("s") - F.col("n") * mean) ** 2 / noise).alias("chi"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")
    ).first()
    if not r["pairs"]:
        return p.strongest
    rho = (r["chi"] - r["n"]) / r["pairs"]
    return float(f"{min(p.strongest, max(p.weakest, 1 / rho - 1 if rho > 0 else p.strongest)):.6g}")


def _shrunk(level: DataFrame, p: Reputation) -> tuple[DataFrame, float]:
    """``level(n, s, prior)`` with its mean, and the strength of the prior."""
    k = _strength(level, F.col("prior"), p)
    return level.withColumn("mean", (F.col("s") + k * F.col("prior")) / (F.col("n") + k)), k


def _below(level: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``level`` with the means of its parents as prior."""
    return level.join(parents.select(key, F.col("mean").alias("prior")), key)


def host_reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", p: Reputation | None = None) -> DataFrame:
    """``(host, n, s, below)`` of every host: labelled pages, good ones, probability of a share of good ones below ``p.bound``.

    outcomes(id, good boolean): rows with a null id or outcome are left out; more rows of one id all count.
    """
    p = p or Reputation()
    seen = outcomes.select(quoted(id_col).alias("id"), quoted("good").cast("int").alias("good")).where("id is not null and good is not null")
    seen = seen.groupBy("id").agg(F.count("*").alias("n"), F.sum("good").alias("s"))
    each = pages.select(quoted(id_col).alias("id"), host_of(quoted(url_col).cast("string")).alias("host")).join(seen, "id", "left")
    hosts = each.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    hosts = materialize(hosts.withColumn("domain", domain_of(F.col("host"), p.suffixes)).withColumn("suffix", suffix_of(F.col("host"), p.suffixes)), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = suffixes.agg(F.coalesce((F.sum("s") + 0.5) / (F.sum("n") + 1), F.lit(0.5))).first()[0]
    by_suffix, _ = _shrunk(suffixes.withColumn("prior", F.lit(total)), p)
    by_domain, _ = _shrunk(_below(domains, by_suffix, "suffix"), p)
    by_host, k = _shrunk(_below(hosts, by_domain.drop("suffix"), "domain"), p)
    a, b = F.col("s") + k * F.col("prior"), F.col("n") - F.col("s") + k * (1 - F.col("prior"))
    return by_host.select("host", "n", "s", a.alias("a"), b.alias("b")).select("host", "n", "s", share_below(F.col("a"), F.col("b"), p.bound).alias("below"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, p: Reputation | None = None) -> DataFrame:
    """``pages``, all columns, with host, path, rule and verdict (columns of these names are replaced).

    Null urls and urls without ``://`` have an empty host and path, fit no rule and share the empty host's reputation.
    Repeated rows stay; a host that holds many pages is counted before it is shuffled, and its join can be split.
    """
    p = p or Reputation()
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    bound, own, rule = fresh(pages, "host_below"), fresh(pages, "reputed_host"), fresh(pages, "url_rule")
    hosts = host_reputation(pages, outcomes, id_col, url_col, p).select(F.col("host").alias(own), F.col("below").alias(bound))
    url = quoted(url_col).cast("string")
    judged = pages.select(*map(quoted, kept), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.join(hosts, F.col("host") == F.col(own), "left").withColumn(rule, rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col(rule)["verdict"], F.when(F.col(bound) <= p.risk, "allow").otherwise("block"))
    return judged.select(*map(quoted, kept), "host", "path", F.col(rule)["rule"].alias("rule"), verdict.alias("verdict"))


_P = Reputation()
_MEAN = "greatest(least({0}, 0.999), 0.001)"


def _sql_level(name: str, level: str, parents: str, key: str) -> str:
    """One shrinking step in SQL: CTEs ``{name}_j`` (prior), ``{name}_k`` (strength) and ``{name}`` (mean)."""
    m = _MEAN.format("prior")
    return f"""{name}_j AS (SELECT l.*, coalesce(q.prior, 0.5) AS prior FROM {level} l LEFT JOIN {parents} q USING ({key})),
{name}_m AS (SELECT sum((s - n * {m}) ** 2 / ({m} * (1 - {m}))) AS chi, sum(n) AS n, sum(n * (n - 1)) AS pairs FROM {name}_j WHERE n > 0),
{name}_k AS (SELECT CASE WHEN coalesce(pairs, 0) = 0 THEN {_P.strongest}
  ELSE least({_P.strongest}, greatest({_P.weakest}, CASE WHEN chi > n THEN pairs / (chi - n) - 1 ELSE {_P.strongest} END)) END AS k FROM {name}_m),
{name} AS (SELECT j.*, k, (s + k * prior) / (n + k) AS mean FROM {name}_j j, {name}_k)"""


_TWO = "regexp_extract(bare, '([^.]*\\.)?[^.]*$')"
_KNOWN = f"{_TWO} IN ({', '.join(repr(x) for x in _P.suffixes)})"
_ADDRESS = f"regexp_matches(bare, '{ADDRESS}')"
_DOMAIN = f"CASE WHEN {_ADDRESS} THEN bare WHEN {_KNOWN} THEN regexp_extract(bare, '([^.]*\\.){{0,2}}[^.]*$') ELSE {_TWO} END"
_SUFFIX = f"CASE WHEN {_ADDRESS} THEN 'address' WHEN {_KNOWN} THEN {_TWO} ELSE regexp_extract(bare, '[^.]*$') END"
_RULE = "\n".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda x: -len(x[0]))
)
_VERDICT = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
SQL = f"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
seen AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS s FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, {_DOMAIN} AS domain, {_SUFFIX} AS suffix, n, s FROM (
  SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, coalesce(sum(n), 0) AS n, coalesce(sum(s), 0) AS s FROM p LEFT JOIN seen USING (page_id) GROUP BY host)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, 0 AS whole, sum(n) AS n, sum(s) AS s FROM domains GROUP BY suffix),
total AS (SELECT 0 AS whole, (sum(s) + 0.5) / (sum(n) + 1) AS prior FROM suffixes),
{_sql_level("by_suffix", "suffixes", "total", "whole")},
suffix_prior AS (SELECT suffix, mean AS prior FROM by_suffix),
{_sql_level("by_domain", "domains", "suffix_prior", "suffix")},
domain_prior AS (SELECT domain, mean AS prior FROM by_domain),
{_sql_level("by_host", "hosts", "domain_prior", "domain")},
ab AS (SELECT host, s + k * prior AS a, n - s + k * (1 - prior) AS b FROM by_host),
bounds AS (SELECT host, sum(exp((a + i) * ln({_P.bound}) + b * ln(1 - {_P.bound}) + lgamma(a + b + i) - lgamma(b) - lgamma(a + i + 1))) AS below
  FROM (SELECT *, unnest(range(0, CAST(400 + 8 * b AS BIGINT))) AS i FROM ab) GROUP BY host),
ruled AS (SELECT page_id, host, path, CASE {_RULE} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {_VERDICT} ELSE CASE WHEN below <= {_P.risk} THEN 'allow' ELSE 'block' END END AS verdict
FROM ruled JOIN bounds USING (host)
"""
