"""URL filter: fixed rules first, then host reputation by empirical Bayes.

Labelled outcomes (bad or not) are counted for each host and shrunk through beta-binomial priors: a suffix towards the
overall rate, a registered domain towards its suffix, a host towards its domain. Each level's prior strength comes from
the moments of the rates between its groups. A host is blocked where the lower bound of its posterior exceeds a limit.
DataFrame operations only; a host, domain or suffix is one row in every join, so a hot one only lengthens the other side.

Defined cases: a url that is null or has no ``://`` has an empty host and path and takes the verdict of the empty host;
without any labelled outcome the overall rate is 0 and everything without a rule is allowed; of rules that fit the longest
wins; urls of any length are read whole; repeated rows stay; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.mx", "com.ar", "co.in", "co.kr", "com.cn", "com.tr", "co.za", "com.sg")


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


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path, both empty if there is no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def first_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of text and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; a numeric address is its own domain under an empty suffix."""
    last = lambda n: F.substring_index(host, ".", -n)
    numeric, two = host.rlike(r"^[0-9.]+(:[0-9]+)?$"), last(2).isin(*TWO_LABEL_SUFFIXES)
    domain = F.when(numeric, host).when(two, last(3)).otherwise(last(2))
    return domain, F.when(numeric, F.lit("")).when(two, last(2)).otherwise(last(1))


def strength(level: DataFrame, key: str, least: float = 1.0, most: float = 1000.0) -> tuple[float, float]:
    """The pooled rate and the beta prior's strength, by the method of moments over the groups of one level."""
    seen = level.filter("n > 0").groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total, bad, squares, sizes, groups = seen.agg(F.sum("n"), F.sum("bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n")), F.sum(F.col("n").cast("double") * F.col("n")), F.count("*")).first()
    if not total:
        return 0.0, most
    rate = bad / total
    between, free = squares / total - rate * rate, rate * (1 - rate)
    spread, noise = 1 - sizes / (float(total) * total), (groups - 1) / total
    if free <= 0 or spread - noise <= 0:
        return rate, most
    rho = (between / free - noise) / (spread - noise)
    return rate, min(most, max(least, 1 / rho - 1)) if rho > 0 else most


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, bad, rate and the posterior's bounds; outcomes: host, bad (1, 0 or null where not labelled)."""
    domain, suffix = domain_and_suffix(F.col("host"))
    # one row for each host, stored: the pages are read once for all levels
    hosts = checkpoint(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumns({"domain": domain, "suffix": suffix}))
    overall, s_suffix = strength(hosts, "suffix")
    s_domain, s_host = strength(hosts, "domain")[1], strength(hosts, "host")[1]
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    suffixes = domains.groupBy("suffix").agg(((F.sum("dbad") + s_suffix * overall) / (F.sum("dn") + s_suffix)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("dbad") + s_domain * F.col("suffix_rate")) / (F.col("dn") + s_domain)).alias("domain_rate"))
    a, b = F.col("bad") + s_host * F.col("domain_rate"), F.col("n") - F.col("bad") + s_host * (1 - F.col("domain_rate"))
    rate = a / (a + b)
    half = z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(domains, ["domain", "suffix"]).select("host", "n", "bad", rate.alias("rate"), (rate - half).alias("low"), (rate + half).alias("high"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, outcomes: DataFrame | None = None, limit: float = 0.8, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, rate and low of each page.

    outcomes: host and bad, 1 or 0; by default the pages that a rule judges are the labelled ones.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("found", first_rule(F.col("host"), F.col("path"), rules))
    own = ruled.select("host", F.when(F.col("found.verdict") == "block", 1).when(F.col("found.verdict") == "allow", 0).alias("bad"))
    if outcomes is not None:
        own = own.select("host", F.lit(None).cast("int").alias("bad")).unionByName(outcomes.select("host", F.col("bad").cast("int").alias("bad")))
    known = reputation(own, z).select("host", "rate", "low")
    return ruled.join(known, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("low") > limit, "block").otherwise("allow")).alias("verdict"), "rate", "low",
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)


def _level(key: str) -> str:
    """One row: the pooled rate and the prior's strength of a level."""
    return f"""
    SELECT CASE WHEN total > 0 THEN bad / total ELSE 0.0 END AS rate,
      CASE WHEN coalesce(total, 0) = 0 OR bad / total * (1 - bad / total) <= 0 OR spread - noise <= 0 OR rho <= 0 THEN 1000.0
           ELSE least(1000.0, greatest(1.0, 1 / rho - 1)) END AS s
    FROM (SELECT *, CASE WHEN bad / total * (1 - bad / total) > 0 AND spread - noise > 0
                    THEN ((squares / total - (bad / total) * (bad / total)) / (bad / total * (1 - bad / total)) - noise) / (spread - noise) ELSE 0 END AS rho
      FROM (SELECT sum(n)::DOUBLE AS total, sum(bad)::DOUBLE AS bad, sum(bad * bad / n::DOUBLE) AS squares,
                   1 - sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n)) AS spread, (count(*) - 1) / sum(n)::DOUBLE AS noise
            FROM (SELECT sum(n) AS n, sum(bad) AS bad FROM hosts WHERE n > 0 GROUP BY {key})))"""


ORACLE_SQL = rf"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed),
labelled AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 0 WHEN rule IS NOT NULL THEN 1 END AS is_bad,
    string_split(host, '.') AS labels FROM ruled),
hosts AS (
  SELECT host, count(is_bad) AS n, coalesce(sum(is_bad), 0)::BIGINT AS bad,
    any_value(CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') THEN host
         WHEN array_to_string(labels[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(labels[-3:], '.')
         ELSE array_to_string(labels[-2:], '.') END) AS domain,
    any_value(CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') THEN ''
         WHEN array_to_string(labels[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(labels[-2:], '.')
         ELSE labels[-1] END) AS suffix
  FROM labelled GROUP BY host),
p_suffix AS ({_level("suffix")}), p_domain AS ({_level("domain")}), p_host AS ({_level("host")}),
suffixes AS (
  SELECT suffix, (sum(bad) + any_value(p_suffix.s) * any_value(p_suffix.rate)) / (sum(n) + any_value(p_suffix.s)) AS suffix_rate
  FROM hosts, p_suffix GROUP BY suffix),
domains AS (
  SELECT domain, suffix, (sum(bad) + any_value(p_domain.s) * any_value(suffix_rate)) / (sum(n) + any_value(p_domain.s)) AS domain_rate
  FROM hosts JOIN suffixes USING (suffix), p_domain GROUP BY domain, suffix),
posterior AS (
  SELECT host, bad + s * domain_rate AS a, n - bad + s * (1 - domain_rate) AS b
  FROM hosts JOIN domains USING (domain, suffix), p_host)
SELECT page_id, l.host, path, rule,
  CASE WHEN is_bad = 0 THEN 'allow' WHEN is_bad = 1 THEN 'block'
       WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.8 THEN 'block' ELSE 'allow' END AS verdict
FROM labelled l JOIN posterior p ON l.host = p.host
"""
