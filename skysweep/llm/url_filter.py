"""Judge urls by rules and, where no rule fits, by the reputation of their host.

Labelled pages give every host a number of bad outcomes. Small hosts say little by themselves, so each is shrunk towards its
registered domain, that towards its suffix and that towards all pages, by beta-binomial priors whose strength is estimated
from the spread at each level. A host is blocked when even the lower bound of its posterior is bad.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysweep.llm.common import stored

#: (verdict, rule): host and path prefix; the longest rule that fits decides.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Suffixes of two labels under which domains are registered.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
#: Share of bad pages above which a host is blocked, and the standard deviations by which the bound lies below the mean.
BAD_SHARE = 0.5
DEVIATIONS = 1.645
#: Limits of the correlation inside a group, so that a prior weighs between 1 and 999 pages.
LEAST_RHO, MOST_RHO = 0.001, 0.5
LEVELS = ("suffix", "domain", "host")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(part(1), upper, lower), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, null if none does, and its verdict."""
    rule = verdict = None
    for decision, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def domain_of(host: Column) -> Column:
    """Registered domain: one label more than the suffix, or the whole host if it has no more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    return F.when(F.substring_index(domain, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(domain, ".", -2)).otherwise(
        F.substring_index(domain, ".", -1)
    )


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``host`` and ``low``, the lower posterior bound of its share of bad pages.

    ``hosts`` has one row per host with ``seen`` labelled pages, ``bad`` of them bad. The prior mean m of a node comes from the
    other pages of its parent, shrunk in the same way, so no page counts twice. At every level the correlation rho is the one
    whose expected spread around these means, sum m (1 - m) (1 + (n - 1) rho), equals the spread found.
    """
    domain = domain_of(F.col("host"))
    nodes = hosts.select("host", domain.alias("domain"), suffix_of(domain).alias("suffix"), "seen", "bad")
    total = nodes.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        names = list(LEVELS[: depth + 1])
        counts = nodes.groupBy(*names).agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
        if above is None:
            mean = (F.lit(total["bad"]) - F.col("bad") + 1.0) / (F.lit(total["seen"]) - F.col("seen") + 2.0)
        else:
            others = (F.col("all_bad") - F.col("bad") + F.col("strength") * F.col("above")) / (F.col("all_seen") - F.col("seen") + F.col("strength"))
            counts, mean = counts.join(above, names[:-1]), others
        # Stored, as the estimate below and the next level both read it.
        counts = stored(counts.select(*names, "seen", "bad", mean.alias("m")))
        chance = F.col("m") * (1 - F.col("m"))
        spread = F.when(F.col("seen") > 0, F.col("seen") * F.pow(F.col("bad") / F.col("seen") - F.col("m"), F.lit(2.0)) - chance)
        room = F.when(F.col("seen") > 0, chance * (F.col("seen") - 1))
        found, scale = counts.agg(F.sum(spread), F.sum(room)).first()
        rho = min(max(found / scale, LEAST_RHO), MOST_RHO) if scale else LEAST_RHO
        strength = F.lit(1.0 / rho - 1.0)
        above = counts.select(
            *names, F.col("seen").alias("all_seen"), F.col("bad").alias("all_bad"), F.col("m").alias("above"), strength.alias("strength")
        )
    weight = F.col("seen") + strength
    mean = (F.col("bad") + strength * F.col("m")) / weight
    return counts.select("host", (mean - F.lit(DEVIATIONS) * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("low"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    ``outcomes`` has ``page_id`` and ``bad`` (boolean); an id with several outcomes is bad if any is, a null id or outcome
    is left out. Pages without a host share the empty host and its reputation. Repeated rows stay, and every one of them
    counts. Without outcomes no host is blocked. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    parts = stored(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")))
    labels = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = parts.join(labels, "page_id", "left").groupBy("host").agg(
        F.count("bad").alias("seen"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
    )
    reputation = stored(host_reputation(stored(labelled)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("low") > BAD_SHARE, "block").otherwise("allow")
    return parts.join(reputation, "host").select(
        F.col("page_id").alias(page_id), "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict")
    )


def label_outcomes(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Page outcomes from the table of labels: bad when toxic or of low quality."""
    return labels.select(F.col(doc_id).alias("page_id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
