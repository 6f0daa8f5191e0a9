"""URL filter: allow and block rules, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host. Hosts shrink to their registered
domain, domains to their suffix, suffixes to the whole: each level is a
beta-binomial whose concentration is estimated by moments from the spread of
its members' rates around their parent's. A host is blocked when the lower
posterior bound of its bad rate exceeds ``max_bad``.

A registered domain is the last two labels of a host, or the last three under
a two-letter top level whose second level is one of ``SECOND_LEVEL``. A host
without a dot is its own domain with an empty suffix.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.tables import stage

# Rules as (host, path, verdict), and second-level labels of public suffixes.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
Z = 1.645


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    second = (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, -2).isin(*SECOND_LEVEL)
    return (
        F.when(F.size(parts) < 2, host)
        .when((F.size(parts) > 2) & second, F.substring_index(host, ".", -3))
        .otherwise(F.substring_index(host, ".", -2))
    )


def suffix_of(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"(?s)^[^.]*\.", "")).otherwise("")


def _concentration() -> Column:
    """Pseudo-count of a level's prior from its members' n and bad and the parent's totals (n_up, bad_up)."""
    p = F.col("bad_up") / F.col("n_up")
    spread = p * (1 - p)
    left = 1 - F.col("n") / F.col("n_up")
    observed = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2))
    chance = F.sum(left * spread)
    slope = F.sum((F.col("n") - 1) * left * spread)
    rho = F.when(slope > 0, (observed - chance) / slope)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(0.001)), F.lit(0.5))
    return (1 - rho) / rho


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, domain, suffix, n, bad (labelled pages), bad_rate and bad_low (posterior mean and lower bound).

    ``pages`` has page_id and host; ``outcomes`` has page_id, bad (0 or 1; null: not labelled); a
    page labelled several times counts once, as bad if any label says so.
    """
    once = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        pages.select("page_id", "host")
        .join(once, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("domain")))
    )
    hosts = stage(hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = stage(domains, "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    root = suffixes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    ).first()
    rate = (root["bad"] + 1) / (root["n"] + 2)

    def level(members: DataFrame, parents: DataFrame | None, key: str | None) -> float:
        if parents is None:
            up = members.withColumns({"n_up": F.lit(root["n"]), "bad_up": F.lit(root["bad"])})
        else:
            up = members.join(parents.select(key, F.col("n").alias("n_up"), F.col("bad").alias("bad_up")), key)
        return up.where("n > 0").agg(_concentration().alias("m")).first()["m"]

    shrunk = lambda m, prior: (F.col("bad") + m * prior) / (F.col("n") + m)
    m1, m2, m3 = level(suffixes, None, None), level(domains, suffixes, "suffix"), level(hosts, domains, "domain")
    suffixes = suffixes.select("suffix", shrunk(m1, F.lit(rate)).alias("up"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(m2, F.col("up")).alias("up"))
    a, b = F.col("bad") + m3 * F.col("up"), F.col("n") - F.col("bad") + m3 * (1 - F.col("up"))
    mean = a / (a + b)
    low = mean - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return hosts.join(domains, "domain").select(
        "host", "domain", "suffix", "n", "bad", mean.alias("bad_rate"), low.alias("bad_low")
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    max_bad: float = 0.5,
    z: float = Z,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_rate, bad_low.

    A url that is null or has no ``://`` has an empty host and path; such pages share one reputation.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputations(split, outcomes, z).select("host", "bad_rate", "bad_low")
    ruled = split.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return ruled.join(known, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), own).alias("verdict"),
        "bad_rate",
        "bad_low",
    )
