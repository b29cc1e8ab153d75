"""URL filters by empirical-Bayes host reputation, with DataFrame functions only.

Labelled pages give each host successes (good pages) and trials. Rates shrink down a chain of beta-binomial priors:
the whole web to suffix, suffix to registered domain, domain to host. Each level's prior strength is fitted by moments
from the overdispersion of its groups around their parents' means. A url is blocked when the upper bound of its host's
posterior good rate lies below ``min_good``: unlabelled or rarely seen hosts get the benefit of their parents' rates.

Hosts are counted with map-side partial sums, so a host with a third of all pages is a few rows per task; the table of
hosts is written to the shared folder once, as the fits and the verdicts read it. The join of pages with hosts is a plain
equi-join whose larger side the planner can split.

Defined results: a null url or one without :// has an empty host and path and is judged by the empty host's posterior;
a page without a label is no trial, several labels of a page are as many trials, a null label is none; null page ids are
kept and match no label; repeated pages count each; extra columns are ignored; empty tables give empty results, and
without any label every rate is the neutral 1/2.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Public suffixes of two labels that are common; others count as one label. A fuller list comes as a table.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr")
#: Labels that a suffix of a table has at most.
SUFFIX_LABELS = 5
MIN_GOOD = 0.5
Z = 1.645


@dataclass(frozen=True)
class UrlRule:
    """allow or block a host, its subdomains and, below them, the paths with this prefix (with its slash)."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits, null where none does. The rules are code, so they become one expression."""
    text = action = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


ADDRESS = r"^[0-9.]+$|^\["


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")


def registered_domain(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host without user, port and final dot; an address or a bare suffix is its own domain."""
    name = _bare(host)
    last_two, last_three = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    address = name.rlike(ADDRESS)
    two = last_two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(address, F.lit("")).when(two, last_two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(two, last_three).otherwise(last_two)
    return suffix, domain


def placed(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts with suffix and domain, by a table (suffix) of public suffixes: the longest that ends the host counts, else its
    last label; null suffixes and those of over SUFFIX_LABELS labels aren't met. Without a table by ``registered_domain``."""
    if suffixes is None:
        suffix, domain = registered_domain(F.col("host"))
        return hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    known = suffixes.select("suffix").distinct()
    found = hosts.withColumn("_name", _bare(F.col("host")))
    for k in range(2, SUFFIX_LABELS + 1):
        of = known.filter(F.size(F.split("suffix", r"\.")) == k).select(F.col("suffix").alias(f"_s{k}"))
        found = found.join(of, F.substring_index("_name", ".", -k) == F.col(f"_s{k}"), "left")
    longest = F.coalesce(*[F.col(f"_s{k}") for k in range(SUFFIX_LABELS, 1, -1)], F.substring_index("_name", ".", -1))
    labels = F.size(F.split("suffix", r"\.")) + 1
    below = F.array_join(F.slice(F.split("_name", r"\."), -F.least(labels, F.size(F.split("_name", r"\."))), labels), ".")
    address = F.col("_name").rlike(ADDRESS)
    found = found.withColumn("suffix", F.when(address, F.lit("")).otherwise(longest))
    return found.withColumn("domain", F.when(address, F.col("_name")).otherwise(below)).select(*hosts.columns, "suffix", "domain")


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength a + b of a level: by moments, rho = sum((k - n m)^2 - n m (1 - m)) / sum(n (n - 1) m (1 - m))."""
    k, n, m = F.col("k"), F.col("n"), F.col(mean)
    row = groups.agg(
        F.sum((k - n * m) * (k - n * m) - n * m * (1 - m)).alias("over"),
        F.sum(n * (n - 1) * m * (1 - m)).alias("scale"),
    ).first()
    rho = row.over / row.scale if row.scale else 0.0
    return 1 / min(max(rho, 1e-4), 0.99) - 1


def reputation(hosts: DataFrame, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """host, n, k, posterior mean, lower and upper bound from a table of (host, n, k) with one row per host. The bounds are the
    mean less and plus z standard deviations of the posterior, not its quantiles."""
    hosts = placed(hosts.select("host", "n", "k"), suffixes)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    web = (total.k + 1) / (total.n + 2)

    def shrunk(groups: DataFrame, prior: Column, strength: float) -> Column:
        return (groups["k"] + F.lit(strength) * prior) / (groups["n"] + F.lit(strength))

    by_suffix = suffixes.withColumn("m0", F.lit(web))
    by_suffix = by_suffix.select("suffix", shrunk(by_suffix, F.col("m0"), _strength(by_suffix, "m0")).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix")
    by_domain = by_domain.select("domain", "suffix", shrunk(by_domain, F.col("suffix_mean"), _strength(by_domain, "suffix_mean")).alias("domain_mean"))
    by_host = hosts.join(by_domain, ["domain", "suffix"])
    s = _strength(by_host, "domain_mean")
    a = F.col("k") + F.lit(s) * F.col("domain_mean")
    b = F.col("n") - F.col("k") + F.lit(s) * (1 - F.col("domain_mean"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    mean = a / (a + b)
    return by_host.select("host", "n", "k", mean.alias("posterior_mean"), F.greatest(F.lit(0.0), mean - z * sd).alias("lower"), F.least(F.lit(1.0), mean + z * sd).alias("upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...], id_col: str = "page_id", url_col: str = "url", min_good: float = MIN_GOOD, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, posterior_mean, upper. outcomes: (id, good) with good 0 or 1; suffixes:
    (suffix), a list of public suffixes."""
    url = pages[url_col]
    parsed = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    trials = outcomes.select(outcomes["id"], outcomes["good"].cast("long").alias("good"))
    counted = parsed.select("page_id", "host").join(trials, F.col("page_id") == F.col("id"), "left")
    hosts = counted.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    known = reputation(materialize(hosts, "hosts"), z, suffixes).select("host", "posterior_mean", "upper")
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("upper") < min_good, "block").otherwise("allow")
    return parsed.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, judged).alias("verdict"), "posterior_mean", "upper")
