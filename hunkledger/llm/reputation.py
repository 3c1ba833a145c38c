"""URL filter by rules and by empirical-Bayes host reputation.

A rule names a host and the beginning of a path; it fits that host and all its subdomains.  The longest fitting rule
(host and path together, then the path) decides a page.  Where no rule fits, the host's reputation does:

* Labelled outcomes (by default what the rules decided, else a given column) are counted by host, registered domain and suffix.
* The share of good pages is shrunk level by level: all pages are the prior of the suffixes, a suffix that of its domains, a
  domain that of its hosts.  How strongly, the data say: at each level the beta-binomial's concentration is found from how much more the
  counts of its members vary than binomial ones would (method of moments), within ``LEAST_PRIOR`` and ``MOST_PRIOR`` pages.
* A page is blocked if even the upper bound of its host's posterior (``Z`` standard deviations above its mean) lies below ``GOOD_SHARE``:
  if the host is surely bad.  Hosts that no label speaks of keep their domain's share with a wide bound.

Counts are combined before they are shuffled.  A host, domain or suffix may hold any share of the rows: keys with more than one in
``SHARES`` of the rows, of which there are at most ``SHARES``, are broadcast; the others join by key.  The driver reads a few
sums for each level.

The suffix is the last label of the host, or the last two where the last is a country's and the one before it a common one
(``SECOND_LEVEL``); the domain is one label more.  An address of numbers is its own domain, without suffix.  Login and port do not count.

Defined results: a URL that is NULL or has no ``://`` has an empty host and path, fits no rule and is judged by the reputation of the empty host.
Repeated rows each get a result.  Without any labelled page every host has the share one half and nothing is blocked by reputation.
An empty table gives no rows.  Extra columns pass through; those named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

GOOD_SHARE = 0.5
Z = 1.6448536269514722
#: Pages that a prior may weigh, and what it weighs where counts tell nothing.
LEAST_PRIOR, MOST_PRIOR, USUAL_PRIOR = 1.0, 1_000.0, 10.0
#: A key with more than one in so many rows is joined by broadcast.
SHARES = 1_000
#: Labels that a country's suffix is often made with.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "net", "nom", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty without ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)([^?#]*+)", n), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rule(rules: tuple[Rule, ...], host: Column, path: Column, answer) -> Column:
    """``answer(rule)`` of the longest rule that fits; NULL if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.path), r.host, r.path))
    return F.coalesce(F.lit(None).cast("string"), *(F.when(fits(r, host, path), F.lit(answer(r))) for r in ordered))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$|\.$", "")
    labels = F.split(bare, r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    long_ = (F.length(last) == 2) & F.coalesce(second.isin(*SECOND_LEVEL), F.lit(False))
    ending = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(3)), ".")
    number = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | F.contains(bare, F.lit("["))
    suffix = F.when(number, "").when(long_, ending(2)).otherwise(last)
    return F.when(number, bare).when(long_, ending(3)).otherwise(ending(2)), suffix


def by_key(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Join rows to a table with one row for each key, whose ``held`` counts the rows of the key among ``total``."""
    often = F.col("held") * SHARES > total
    hot = F.broadcast(keyed.filter(often).drop("held"))
    rest = rows.join(F.broadcast(keyed.filter(often).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(keyed.filter(~often).drop("held"), key))


def concentration(members: DataFrame) -> float:
    """Pages that the prior weighs for members (n, good, prior) of one level."""
    inner = F.col("prior") * (1 - F.col("prior"))
    expected = F.col("n") * F.col("prior")
    spread, within, pairs = members.agg(
        F.sum((F.col("good") - expected) * (F.col("good") - expected)), F.sum(F.col("n") * inner), F.sum(F.col("n") * (F.col("n") - 1) * inner)
    ).first()
    if not pairs:
        return USUAL_PRIOR
    likeness = (spread - within) / pairs
    return min(max(1 / likeness - 1, LEAST_PRIOR), MOST_PRIOR) if likeness > 0 else MOST_PRIOR


def shrunk(members: DataFrame, weight: float) -> Column:
    return (F.col("good") + F.lit(weight) * F.col("prior")) / (F.col("n") + F.lit(weight))


def counted(rows: DataFrame, key: str, *above: str) -> DataFrame:
    """n labelled pages, good ones among them, and how many rows there are, by key."""
    firsts = [F.first(a).alias(a) for a in above]
    return rows.groupBy(key).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("held"), *firsts)


def reputation(outcomes: DataFrame) -> DataFrame:
    """From (host, good: 1, 0 or NULL if unlabelled): host, n labelled and good pages, held pages, and of the share of good pages the
    posterior mean ``share`` and the bound ``at_most``."""
    domain, suffix = domain_and_suffix(F.col("host"))
    pages = outcomes.select("host", F.col("good").isNotNull().cast("long").alias("n"), F.coalesce(F.col("good").cast("long"), F.lit(0)).alias("good"))
    hosts = stage(counted(pages, "host").withColumn("domain", domain).withColumn("suffix", suffix), "reputation-hosts")
    domains = stage(counted(hosts, "domain", "suffix"), "reputation-domains")
    suffixes = counted(domains, "suffix")
    n, good = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    suffixes = suffixes.withColumn("prior", F.lit((good + 1) / (n + 2)))
    suffixes = suffixes.select("suffix", shrunk(suffixes, concentration(suffixes)).alias("prior"), "held")
    domains = stage(by_key(domains.drop("held"), suffixes, "suffix", domains.count()).join(
        # how many hosts a domain has decides how its own join is made
        domains.select("domain", "held"), "domain"), "reputation-priors")
    domains = domains.select("domain", shrunk(domains, concentration(domains)).alias("prior"), "held")
    hosts = stage(by_key(hosts, domains, "domain", hosts.count()), "reputation-shares")
    weight = concentration(hosts)
    hosts = hosts.withColumn("share", shrunk(hosts, weight))
    deviation = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("n") + F.lit(weight) + 1))
    return hosts.select("host", "n", "good", "held", "share", (F.col("share") + F.lit(Z) * deviation).alias("at_most"))


_ADDED = ("host", "path", "rule", "verdict", "share", "at_most")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", label: str | None = None) -> DataFrame:
    """Add host, path, rule (NULL if none fits), verdict, and share and at_most, the posterior of the host.  ``label`` names a column with the outcomes of
    pages (1 good, 0 bad, NULL unknown); without one the rules' decisions are the outcomes."""
    good = F.lit(None) if label is None else F.col(label).cast("int")
    kept = [c for c in pages.columns if c not in _ADDED]
    host, path = host_and_path(F.col(url))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"), good.cast("int").alias("__good"))
    own = F.col("host"), F.col("path")
    rows = rows.withColumn("rule", by_rule(rules, *own, lambda r: r.name)).withColumn("__said", by_rule(rules, *own, lambda r: r.verdict))
    outcome = F.col("__good") if label is not None else F.when(F.col("__said") == "allow", 1).when(F.col("__said") == "block", 0)
    hosts = reputation(rows.select("host", outcome.alias("good")))
    total = hosts.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    rows = by_key(rows.drop("__good"), hosts.select("host", "held", "share", "at_most"), "host", total)
    told = F.when(F.col("at_most") < GOOD_SHARE, "block").otherwise("allow")
    return rows.select(*kept, "host", "path", "rule", F.coalesce("__said", told).alias("verdict"), "share", "at_most")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(answer) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r.name), -len(r.path), r.host, r.path))
    return " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{answer(r)}'" for r in ordered)


_WEIGHT = f"""CASE WHEN coalesce(sum(n * (n - 1) * prior * (1 - prior)), 0) = 0 THEN {USUAL_PRIOR}
    WHEN sum((good - n * prior) * (good - n * prior)) - sum(n * prior * (1 - prior)) <= 0 THEN {MOST_PRIOR}
    ELSE least(greatest(sum(n * (n - 1) * prior * (1 - prior)) / (sum((good - n * prior) * (good - n * prior)) - sum(n * prior * (1 - prior))) - 1, {LEAST_PRIOR}), {MOST_PRIOR}) END"""
_SECOND = ", ".join(f"'{s}'" for s in SECOND_LEVEL)

ORACLE = f"""
WITH cut AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
    FROM pages
), ruled AS (
    SELECT *, CASE {_rule_sql(lambda r: r.name)} END AS rule, CASE {_rule_sql(lambda r: r.verdict)} END AS said FROM cut
), hosts AS (
    SELECT host, count(said) AS n, count(*) FILTER (said = 'allow') AS good,
           regexp_replace(host, '^.*@|:[0-9]*$|\\.$', '', 'gs') AS bare FROM ruled GROUP BY host
), named AS (
    SELECT *, string_split(bare, '.') AS labels,
           regexp_full_match(bare, '[0-9]+(\\.[0-9]+){{3}}') OR contains(bare, '[') AS number,
           length(string_split(bare, '.')[-1]) = 2 AND len(string_split(bare, '.')) > 1 AND string_split(bare, '.')[-2] IN ({_SECOND}) AS long_
    FROM hosts
), placed AS (
    SELECT host, n, good,
           CASE WHEN number THEN '' WHEN long_ THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix,
           CASE WHEN number THEN bare WHEN long_ THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain
    FROM named
), domains AS (
    SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(good) AS good FROM placed GROUP BY domain
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(good) AS good, ((SELECT sum(good) FROM placed) + 1) / ((SELECT sum(n) FROM placed) + 2) AS prior
    FROM domains GROUP BY suffix
), suffix_weight AS (SELECT {_WEIGHT} AS w FROM suffixes),
domain_prior AS (
    SELECT d.*, (s.good + w * s.prior) / (s.n + w) AS prior FROM domains d JOIN suffixes s USING (suffix), suffix_weight
), domain_weight AS (SELECT {_WEIGHT} AS w FROM domain_prior),
host_prior AS (
    SELECT h.host, h.n, h.good, (d.good + w * d.prior) / (d.n + w) AS prior FROM placed h JOIN domain_prior d USING (domain), domain_weight
), host_weight AS (SELECT {_WEIGHT} AS w FROM host_prior),
shares AS (
    SELECT host, n, w, (good + w * prior) / (n + w) AS share FROM host_prior, host_weight
)
SELECT page_id, r.host, path, rule,
       coalesce(said, CASE WHEN share + {Z} * sqrt(share * (1 - share) / (n + w + 1)) < {GOOD_SHARE} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN shares USING (host)
"""
