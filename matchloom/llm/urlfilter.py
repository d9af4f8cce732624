"""URL filter by empirical-Bayes reputation of hosts, with DataFrame functions only.

Labelled page outcomes are counted per host. A host's rate of bad pages gets a beta prior around the rate of its
registered domain, that one a prior around the rate of its suffix, that one around the rate of all labelled pages. The
strength of the priors of each level is fitted to the spread of the level's own rates (method of moments). A host is
blocked if the lower bound of its posterior passes a limit; explicit rules come before that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): a host, then from the first / on a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


@dataclass(frozen=True)
class ReputationConfig:
    """limit: a host is blocked if the posterior rate of bad pages is above it, z standard deviations below the mean.

    second_level holds labels that, before a last label of two letters (a country's), make a suffix of two labels (such as
    co.uk), under which a registered domain has three; suffixes holds others of two labels.
    least and most bound the fitted strength of a prior, in pages.
    """

    limit: float = 0.5
    z: float = 1.645
    least: float = 2.0
    most: float = 1000.0
    second_level: tuple[str, ...] = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "sch")
    suffixes: tuple[str, ...] = ()


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as struct(size, host_size, rule, verdict); null if none does. rules is a parameter, not data."""
    if not rules:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        ok = (host == h) | F.endswith(host, F.lit("." + h))
        ok = ok & F.startswith(path, F.lit(slash + p))
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


#: The suffix of all hosts that are addresses.
ADDRESS = "#address"


def levels(host: Column, config: ReputationConfig) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, whatever user, port or last dot it has; an address is its own domain."""
    name = F.rtrim(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), F.lit("."))
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
    two = last(2).isin(*config.suffixes) if config.suffixes else F.lit(False)
    if config.second_level:
        two = two | (last(1).rlike("^[a-z]{2}$") & F.get(labels, F.size(labels) - 2).isin(*config.second_level))
    two = F.coalesce(two, F.lit(False))
    return F.when(address, name).when(two, last(3)).otherwise(last(2)), F.when(address, F.lit(ADDRESS)).when(two, last(2)).otherwise(last(1))


def strength(rows: DataFrame, n: str, bad: str, prior: str, config: ReputationConfig) -> DataFrame:
    """One row: the prior strength k of a level from the spread of its rates around their priors.

    With rate r = bad/n and prior mean m, E[(r-m)^2] = m(1-m)(1/n + (1-1/n)/(k+1)); both sides are summed with weight n.
    """
    v = F.col(prior) * (1 - F.col(prior))
    seen = F.sum(F.col(n) * (F.col(bad) / F.col(n) - F.col(prior)) ** 2)
    by_chance, by_spread = F.sum(v), F.sum(v * (F.col(n) - 1))
    rho = (seen - by_chance) / F.when(by_spread > 0, by_spread)
    k = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(config.most))
    return rows.agg(F.greatest(F.lit(config.least), F.least(F.lit(config.most), F.coalesce(k, F.lit(config.most)))).alias("k_"))


def reputation(hosts: DataFrame, config: ReputationConfig = ReputationConfig()) -> DataFrame:
    """hosts(host, n_labelled, n_bad) with domain, suffix, the beta posterior (alpha, beta), its mean and lower bound."""
    domain, suffix = levels(F.col("host"), config)
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), F.col("n_labelled").cast("double").alias("n_"), F.col("n_bad").cast("double").alias("bad_"))
    sums = [F.sum("n_").alias("n_"), F.sum("bad_").alias("bad_")]
    hosts = cut(hosts)  # each level is used twice
    domains = cut(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = cut(domains.groupBy("suffix").agg(*sums))
    whole = suffixes.agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in ((F.sum("n_"), "n_"), (F.sum("bad_"), "bad_"))]).select("n_", "bad_", F.lit(0.5).alias("prior_"), F.lit(1.0).alias("k_"))

    def shrunk(rows: DataFrame, above: DataFrame, key: str | None) -> DataFrame:
        """rows with prior_ and k_: the posterior of the level above, without what the row itself adds to it.

        A prior counts no more pages than there are behind it.
        """
        above = above.select(*([key] if key else []), *[F.col(c).alias(f"up_{c}") for c in ("n_", "bad_", "prior_", "k_")])
        rows = rows.join(above, key) if key else rows.join(F.broadcast(above))  # a single row
        behind = F.col("up_n_") - F.col("n_") + F.col("up_k_")
        rows = rows.withColumn("prior_", (F.col("up_bad_") - F.col("bad_") + F.col("up_k_") * F.col("up_prior_")) / behind).withColumn("behind_", behind)
        fitted = strength(rows.filter("n_ > 0"), "n_", "bad_", "prior_", config)  # a single row
        return cut(rows.drop("up_n_", "up_bad_", "up_prior_", "up_k_").join(F.broadcast(fitted)).withColumn("k_", F.least("k_", "behind_")).drop("behind_"))

    suffixes = shrunk(suffixes, whole, None)
    domains = shrunk(domains, suffixes, "suffix")
    hosts = shrunk(hosts, domains.drop("suffix"), "domain")
    alpha, beta = F.col("bad_") + F.col("k_") * F.col("prior_"), F.col("n_") - F.col("bad_") + F.col("k_") * (1 - F.col("prior_"))
    hosts = hosts.select("host", "domain", "suffix", F.col("n_").cast("long").alias("n_labelled"), F.col("bad_").cast("long").alias("n_bad"), alpha.alias("alpha"), beta.alias("beta"))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("alpha") + F.col("beta") + 1))
    return hosts.withColumn("posterior", mean).withColumn("bound", F.greatest(F.lit(0.0), mean - config.z * sd))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, config: ReputationConfig = ReputationConfig(), salt: int = 16) -> DataFrame:
    """Verdict on every row of pages(page_id, url, ...) from rules, else from the reputation of its host.

    labels(page_id, bad): labelled outcomes; several labels of a page all count, null ids or outcomes do not. Returns
    page_id, host, path, rule, verdict, posterior, bound. A null url, or one without ://, has an empty host and path and
    is judged as a page of the host ''. Rows repeated in full are judged alike; empty pages give an empty result;
    without labels every host keeps the prior. A hot host's rows are summed before the shuffle and salted in the join.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = labels.select(F.col("page_id").alias("id_"), F.col("bad").cast("int").alias("bad_")).filter("id_ is not null and bad_ is not null")
    seen = seen.groupBy("id_").agg(F.count("*").alias("n_"), F.sum("bad_").alias("b_"))
    hosts = rows.join(seen, rows.page_id == seen.id_, "left").groupBy("host").agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("n_labelled"), F.coalesce(F.sum("b_"), F.lit(0)).alias("n_bad"))
    known = reputation(hosts, config).select("host", "posterior", "bound").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    rows = rows.withColumn("salt_", F.pmod(F.xxhash64("page_id", "path"), F.lit(salt)).cast("int")).withColumn("rule_", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.join(known, ["host", "salt_"])
    verdict = F.coalesce(F.col("rule_")["verdict"], F.when(F.col("bound") > config.limit, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("rule_")["rule"].alias("rule"), verdict.alias("verdict"), "posterior", "bound")
