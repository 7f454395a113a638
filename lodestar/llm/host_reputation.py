"""URL filters [native]: explicit rules first, then empirical-Bayes reputation of the host.

A host's share of good pages is estimated by shrinking its labelled outcomes towards its
registered domain, that towards its suffix, and that towards all hosts. At each level the strength
of the beta prior is the one at which the beta-binomial variance between the children equals the
variance seen (method of moments). A page passes if the lower bound of its host's posterior
(mean less z standard deviations) reaches ``least``. A host without outcomes has the mean of its
registered domain, one whose domain has none that of its suffix, and else that of all hosts.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Registered
domain: its last two labels; suffix: its last label (no list of public suffixes is consulted).

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged
by the reputation of the empty host, which is that of the prior; pages without an outcome do not
count; null outcomes are left out; repeated pages count each; with no outcomes at all every share
is ``default_good``. Output columns that clash with columns of the input replace them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import lower_ascii, saved

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlRule:
    """host/path-prefix, such as ``example.net/en/``; fits the host and its subdomains."""

    action: str  # "allow" or "block"
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        at, prefix = self.pattern.split("/", 1)
        return ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{prefix}")


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    found = lambda k: F.coalesce(F.regexp_extract(F.col(url), _URL, k), F.lit(""))
    return pages.withColumns({"host": lower_ascii(found(1)), "path": found(2)})


def rule_for(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(pattern, action) of the longest rule that fits, as one ordered CASE; null if none does."""
    pattern = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        pattern = F.when(rule.fits(host, path), F.lit(rule.pattern)).otherwise(pattern)
        action = F.when(rule.fits(host, path), F.lit(rule.action)).otherwise(action)
    return pattern, action


def _levels(host: Column) -> dict[str, Column]:
    return {"domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def strength(children: DataFrame) -> float:
    """Pages that the prior of these children is worth. children: (n, k). One row reaches the driver.

    Between-variance v = (Q - (m - 1) p (1 - p)) / (N - sum n^2 / N) with Q = sum n (k/n - p)^2;
    strength = p (1 - p) / v - 1, within bounds; the strongest where no variance is left over."""
    r = children.agg(
        F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"),
    ).first()
    if not r["n"]:
        return STRONGEST
    n, k = float(r["n"]), float(r["k"])
    p = k / n
    within, room = p * (1 - p), n - r["nn"] / n
    between = (r["kk"] - k * k / n - (r["m"] - 1) * within) / room if room > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, within / between - 1)) if between > 0 else STRONGEST


def reputation(outcomes: DataFrame, default_good: float = 0.5, z: float = 1.645) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """outcomes (host, good 0/1) -> a row for each host: host, n, k, mean, bound; and the bounds of
    a host that was never seen: (domain, bound), (suffix, bound), and where neither was seen. Only
    aggregates travel; joins are by size, with skew left to AQE, since both sides of each are read
    from files."""
    hosts = outcomes.filter(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    hosts = saved(hosts.withColumns(_levels(F.col("host"))), "hosts")
    domains = saved(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = saved(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    of_all, of_suffix, of_domain = strength(suffixes), strength(domains), strength(hosts)
    r = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = r["k"] / r["n"] if r["n"] else default_good

    def shrunk(k: Column, n: Column, to: Column | float, by: float) -> Column:
        return (k + F.lit(by) * to) / (n + F.lit(by))

    def bound(mean: Column, weight: Column) -> Column:
        return mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (weight + 1))

    tops = saved(suffixes.select(F.col("suffix").alias("s"), shrunk(F.col("k"), F.col("n"), F.lit(overall), of_all).alias("up")), "suffix-means")
    middle = domains.join(tops, F.col("suffix") == F.col("s"))
    middle = saved(middle.select(F.col("domain").alias("d"), shrunk(F.col("k"), F.col("n"), F.col("up"), of_suffix).alias("up")), "domain-means")
    out = hosts.join(middle, F.col("domain") == F.col("d"))
    mean, weight = shrunk(F.col("k"), F.col("n"), F.col("up"), of_domain), F.col("n") + F.lit(of_domain)
    out = out.withColumn("mean", mean).withColumn("bound", bound(F.col("mean"), weight))
    of_unseen = bound(F.col("up"), F.lit(of_domain)).alias("bound")
    unseen = overall - z * (overall * (1 - overall) / (of_domain + 1)) ** 0.5
    return saved(out.select("host", "n", "k", "mean", "bound"), "reputation"), middle.select(F.col("d").alias("domain"), of_unseen), tops.select(F.col("s").alias("suffix"), of_unseen), unseen


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[UrlRule], least: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict, n_outcomes, bound. outcomes: (host, good)."""
    known, domains, suffixes, unseen = reputation(outcomes)
    df = parsed(pages)
    # back-off is worked out once for each host, so the pages meet one table only
    hosts = df.select(F.col("host").alias("__host")).distinct().withColumns(_levels(F.col("__host")))
    hosts = hosts.join(known.select("host", "n", F.col("bound").alias("own")), F.col("__host") == F.col("host"), "left")
    hosts = hosts.join(domains.select(F.col("domain").alias("d"), F.col("bound").alias("of_domain")), F.col("domain") == F.col("d"), "left")
    hosts = hosts.join(suffixes.select(F.col("suffix").alias("s"), F.col("bound").alias("of_suffix")), F.col("suffix") == F.col("s"), "left")
    found = F.coalesce("own", "of_domain", "of_suffix", F.lit(float(unseen)))
    hosts = saved(hosts.select("__host", F.coalesce("n", F.lit(0).cast("long")).alias("__n"), found.alias("__bound")), "host-bounds")
    pattern, action = rule_for(F.col("host"), F.col("path"), rules)
    joined = df.withColumns({"rule": pattern, "__action": action}).join(hosts, F.col("host") == F.col("__host"), "left")
    own = F.when(F.col("__bound") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return joined.withColumns({"verdict": F.coalesce(F.col("__action"), own), "n_outcomes": F.col("__n"), "bound": F.col("__bound")}).drop("__host", "__n", "__bound", "__action")
