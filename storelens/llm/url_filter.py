"""URL filters (operator 4): fixed rules first, then empirical-Bayes host reputation.

A labelled page is good or bad.  A host's rate of bad pages is shrunk towards
its registered domain's, that towards its suffix's, that towards the overall
rate, through beta-binomial priors whose strengths are estimated by moments
from the corpus.  A host is blocked when even the lower posterior bound of its
bad rate is above the threshold; the bound is the normal approximation of the
beta posterior's 5 % quantile.  Built-in functions only.

Rules see the host as the url has it.  Reputation goes by the server's name: user,
port and closing dot are cut, and an address (four numbers, or brackets) is its own
domain under the suffix ``ip``, so strangers share no more than the overall rate's level.

Defined cases: a null url, or one without ``://``, has empty host and path; an
unlabelled host takes its domain's posterior as its prior; without any label
nothing is blocked by reputation; equal rows get equal results; an empty table gives
an empty table; extra columns of either table, of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import ascii_lower, keep

Z = 1.645  # one-sided 95 % bound
THRESHOLD = 0.5  # block when the bad rate is above this with that confidence
LABEL_SUM = 2.0  # weight of the overall prior at the suffix level, in pages
STRENGTH = (0.5, 1000.0)  # limits of an estimated prior strength, in pages
# Labels that form a public suffix together with a two-letter country label (``co.uk``, ``com.br``).
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
NUMBERS = r"[0-9]{1,3}(\.[0-9]{1,3}){3}"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str  # "allow" or "block"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES: tuple[Rule, ...] = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def server_of(host: Column) -> Column:
    """The server's name in a host: without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def is_address(server: Column) -> Column:
    return server.rlike(f"^{NUMBERS}$") | F.startswith(server, F.lit("["))


def _two(server: Column, suffixes: Sequence[str]) -> Column:
    """Whether the last two labels are one suffix: by the rule of ``SECOND_LABELS``, or listed in ``suffixes``."""
    two = F.substring_index(server, ".", -2)
    return two.rlike(rf"^({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$") | (two.isin(*suffixes) if suffixes else F.lit(False))


def suffix_of(server: Column, suffixes: Sequence[str] = ()) -> Column:
    return F.when(is_address(server), F.lit("ip")).when(
        _two(server, suffixes), F.substring_index(server, ".", -2)).otherwise(F.substring_index(server, ".", -1))


def domain_of(server: Column, suffixes: Sequence[str] = ()) -> Column:
    """The registered domain: the suffix and one label more; an address as it is."""
    return F.when(is_address(server), server).when(
        _two(server, suffixes), F.substring_index(server, ".", -3)).otherwise(F.substring_index(server, ".", -2))


def match_rules(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits (null if none does)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):  # the longest ends up outermost
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def prior_strength(counts: DataFrame, parent: str) -> DataFrame:
    """One row: the strength of the prior that the children (rows with ``n``, ``bad``)
    share around their parent's rate, by the moments of the beta-binomial.

    With p the parent's rate: S = sum n (bad/n - p)^2 is expected at
    p(1-p) (K + rho (N - K)); rho = 1 / (strength + 1).  Sums run over exact
    integers of a millionth, so the result doesn't depend on the order of rows.
    """
    rate = F.col("bad") / F.col("n")
    micro = F.round(F.col("n") * F.pow(rate - F.col(parent), F.lit(2.0)) * 1e6).cast("long")
    noise = F.round(F.col(parent) * (1 - F.col(parent)) * 1e6).cast("long")
    sums = counts.where("n > 0").agg(F.sum(micro).alias("s"), F.sum(noise).alias("v"),
                                     F.sum(noise * (F.col("n") - 1)).alias("w"))
    rho = F.when(F.col("w") > 0, (F.col("s") - F.col("v")) / F.col("w"))
    low, high = STRENGTH
    return sums.select(F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), F.when(rho > 0, 1 / rho - 1).otherwise(high))),
                                  F.lit(high)).alias("strength"))


def reputation(outcomes: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """Per host of ``outcomes`` (host: a server's name; n, bad: its labelled pages and the bad ones among them, 0 if
    none): the posterior mean and lower bound of its bad rate.  ``suffixes``: further public suffixes of two labels."""
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # written once, one row a host: every level of priors below reads it again
    hosts = keep(hosts.select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "bad"), lasting=True)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    counts = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = counts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("rate"))  # one row
    rates = counts.select(
        "suffix", ((overall.scalar() * LABEL_SUM + F.col("bad")) / (LABEL_SUM + F.col("n"))).alias("suffix_rate"))
    domains = domains.join(rates, "suffix")
    s1 = prior_strength(domains, "suffix_rate")
    domains = domains.select("domain", "suffix_rate", "n", "bad", s1.scalar().alias("strength")).select(
        "domain", ((F.col("suffix_rate") * F.col("strength") + F.col("bad")) / (F.col("strength") + F.col("n"))).alias("domain_rate"))
    hosts = hosts.join(domains, "domain")
    s2 = prior_strength(hosts, "domain_rate")
    a = F.col("domain_rate") * F.col("strength") + F.col("bad")
    ab = F.col("strength") + F.col("n")
    mean = a / ab
    sd = F.sqrt(mean * (1 - mean) / (ab + 1))
    return hosts.select("*", s2.scalar().alias("strength")).select("host", "n", "bad", mean.alias("bad_rate"), (mean - Z * sd).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, page_id: str = "page_id",
          url: str = "url", threshold: float = THRESHOLD, suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's labelled pages and lower bound.

    ``outcomes`` has page_id and bad (0/1), one row for each label.
    """
    p = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    labelled = outcomes.groupBy(F.col("page_id").alias("__id")).agg(F.count("bad").alias("n"), F.sum("bad").alias("bad"))
    seen = p.join(labelled, F.col("page_id") == F.col("__id"), "left").groupBy(server_of(F.col("host")).alias("host")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rep = reputation(seen, suffixes).select(F.col("host").alias("__host"), F.col("n").alias("n_labelled"), "low")
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    # the host table has a row a host; a hot host is on the pages' side only, whose partition Spark can split
    return p.join(rep, server_of(F.col("host")) == F.col("__host"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        "n_labelled", F.round("low", 6).alias("bad_low"))
