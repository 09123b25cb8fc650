"""URL filters: explicit rules, then empirical-Bayes reputation of hosts. DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host. Rates shrink downwards through beta-binomial priors:
all pages -> suffix -> registered domain -> host. The strength of each prior (its pseudo-count) is estimated from the
spread of its children's rates by the method of moments. A host is blocked when the lower bound of its posterior
rate of bad pages exceeds a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import lower_ascii, materialise

#: Labels under which registries of two-letter country codes take names: such a label and a country code are one suffix
#: (co.uk, com.br, or.jp); every other suffix is the last label.
SECOND_LEVEL = (
    "ac", "co", "com", "ed", "edu", "gen", "go", "gob", "gouv", "gov", "govt", "gv", "id", "info", "ltd", "me", "mil", "ne", "net", "nom", "or", "org",
    "plc", "sch", "school", "web",
)
TWO_LABELS = rf"(^|[.])({'|'.join(SECOND_LEVEL)})[.][a-z]{{2}}$"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, with A-Z lower-cased; empty without ://."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.when(F.locate("://", F.coalesce(url, F.lit(""))) > 0, lower_ascii(host)).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", F.coalesce(url, F.lit(""))) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def suffix_of(host: Column) -> Column:
    return F.when(host.rlike(TWO_LABELS), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it; an IPv4 address is its own domain."""
    return (
        F.when(host.rlike(r"^[0-9.]+(:[0-9]+)?$"), host)
        .when(host.rlike(TWO_LABELS), F.substring_index(host, ".", -3))
        .otherwise(F.substring_index(host, ".", -2))
    )


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (struct verdict, text) that fits, else null. Equal lengths: the one listed first."""
    found = F.lit(None).cast("struct<verdict:string,text:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("text"))).otherwise(found)
    return found


def _strength(children: DataFrame, least: float = 1.0, most: float = 1000.0) -> float:
    """The prior's pseudo-count, from counts n and bad and the expected rate m of the children.

    Method of moments: strength = binomial noise per child / variance between children - 1, where the latter is the
    children's squared deviation beyond that noise. Bounded, so that one child or no spread is defined.
    """
    noise, seen = F.sum(F.expr("m * (1 - m)")), F.sum(F.expr("n * pow(bad / n - m, 2)"))
    between = (seen - noise) / F.greatest(F.sum("n") - F.sum(F.expr("n * n")) / F.sum("n"), F.lit(1e-9))
    strength = F.when(between > 0, noise / F.count("*") / between - 1).otherwise(most)
    found = children.agg(F.greatest(F.lit(least), F.least(F.lit(most), strength))).first()[0]
    return most if found is None else found


def reputations(spark: SparkSession, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, bad, rate, lower: posterior mean and lower bound of the rate of bad pages, a row for each host.

    outcomes: host, bad (boolean; rows where it is null, or the host is null or empty, don't count). The driver gets
    four numbers: the overall rate and the strength of each level's prior.
    """
    hosts = (
        outcomes.where("bad is not null and host <> ''")
        .groupBy("host")
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
        .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    )
    hosts = materialise(spark, hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = hosts.agg(F.sum("bad") / F.sum("n")).first()[0] or 0.0

    def shrunk(level: DataFrame) -> DataFrame:
        """level: keys, n, bad, m (the parent's rate); adds strength and the shrunk rate."""
        return level.withColumn("strength", F.lit(_strength(level))).withColumn("rate", F.expr("(bad + strength * m) / (n + strength)"))

    suffixes = shrunk(suffixes.withColumn("m", F.lit(overall)))
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("m")), "suffix"))
    hosts = shrunk(hosts.join(domains.select("suffix", "domain", F.col("rate").alias("m")), ["suffix", "domain"]))
    sd = F.expr("sqrt(rate * (1 - rate) / (n + strength + 1))")
    return hosts.select("host", "n", "bad", "rate", (F.col("rate") - z * sd).alias("lower"))


def url_filter(
    spark: SparkSession, pages: DataFrame, outcomes: DataFrame, rules: list[Rule], threshold: float = 0.2, z: float = 1.645, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict of each page; the rule's verdict, else block where the host's bound > threshold.

    Null urls and urls without :// have an empty host and path and are allowed, as are hosts without any outcome.
    Repeated rows give a row each, an empty table none; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    judged = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    bad_hosts = reputations(spark, outcomes, z).where(F.col("lower") > threshold).select("host", F.lit("block").alias("_verdict"))
    return judged.join(bad_hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_rule.text").alias("rule"),
        F.coalesce("_rule.verdict", "_verdict", F.lit("allow")).alias("verdict"),
    )
