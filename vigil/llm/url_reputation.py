"""URL filters: empirical-Bayes host reputation with explicit rules on top.

Labelled page outcomes (bad or not) are counted by host.  Beta-binomial priors
shrink the counts down the hierarchy corpus -> suffix -> registered domain -> host:
each level's prior mean is its parent's posterior mean, and each level's prior
strength is the method-of-moments (intra-class correlation) estimate over the
groups below the parent.  A host is blocked when the lower bound of its posterior
bad rate is above a limit, so hosts with little evidence pass unless the levels
above them are bad.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm._common import durable, name, small_side

#: Suffixes of two or three labels under which domains are registered: the default of a parameter that
#: takes any such list.  Hosts under a suffix that is not listed share the domain of their last two labels.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "ac.nz", "co.nz", "net.nz", "org.nz",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "co.kr", "or.kr", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.hk", "com.tw", "org.tw", "com.sg", "com.my",
    "ac.in", "co.in", "gov.in", "net.in", "org.in", "co.id", "co.th", "com.ph", "com.vn", "com.br", "gov.br", "net.br", "org.br", "com.ar", "com.co", "com.mx", "com.pe",
    "com.ua", "com.pl", "net.pl", "org.pl", "com.tr", "org.tr", "co.il", "org.il", "ac.za", "co.za", "org.za", "com.eg", "com.ng", "com.sa", "co.ke",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "herokuapp.com", "netlify.app", "vercel.app", "web.app", "pages.dev", "s3.amazonaws.com",
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    known = url.isNotNull() & (at > 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits.

    A rule ``(verdict, "host/path")`` fits its host and all subdomains if the path
    starts with the rule's path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Public suffix (the longest listed one, else the last label) and registered domain, one label more.

    User names and ports are left out; a host without a further label is its own domain,
    and an IPv4 address is its own suffix and domain.
    """
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    last = lambda n: F.substring_index(bare, ".", -n)
    listed = lambda n: last(n).isin(*[s for s in suffixes if s.count(".") == n - 1])
    address = bare.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    suffix = F.when(address, bare).when(listed(3), last(3)).when(listed(2), last(2)).otherwise(last(1))
    return suffix, F.when(address, bare).when(listed(3), last(4)).when(listed(2), last(3)).otherwise(last(2))


def _strength(groups: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Prior strength by parent from its groups' (n, k): 1/rho - 1 with rho from the ANOVA estimator."""
    n, k = F.col("n"), F.col("k")
    sums = groups.groupBy(*by).agg(
        F.sum("n").alias("N"),
        F.sum("k").alias("K"),
        F.sum(F.when(n > 0, k * k / n)).alias("kk"),
        F.sum(n * n).alias("nn"),
        F.sum((n > 0).cast("long")).alias("g"),
    )
    between = F.try_divide(F.col("kk") - F.try_divide(F.col("K") * F.col("K"), F.col("N")), F.col("g") - 1)
    within = F.try_divide(F.col("K") - F.col("kk"), F.col("N") - F.col("g"))
    n0 = F.try_divide(F.col("N") - F.try_divide(F.col("nn"), F.col("N")), F.col("g") - 1)
    rho = F.try_divide(between - within, between + (n0 - 1) * within)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(1 / (1 + high))), F.lit(1 / (1 + high))), F.lit(1 / (1 + low)))
    return sums.select(*by, "N", "K", (1 / rho - 1).alias("strength"))


def host_reputation(
    outcomes: DataFrame,
    *,
    host: str = "host",
    bad: str = "bad",
    base_rate: float = 0.05,
    base_strength: float = 20.0,
    strength_range: tuple[float, float] = (2.0, 2000.0),
    z: float = 1.645,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """One row per host: host, labelled, bad, bad_rate (posterior mean), bad_low, bad_high.

    ``outcomes`` has a row per page, with a null outcome where it has no label; a host
    without labels gets the prior that its registered domain, suffix and corpus give.
    A null or empty host takes no part; every row counts, repeated ones too.  ``base_rate``
    and ``base_strength`` are the prior of the whole corpus.  Where hosts of a domain differ
    no more than chance lets them, their strength is the largest of ``strength_range`` and
    they share one rate.  An empty table gives no rows.
    """
    low, high = strength_range
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = durable(
        outcomes.select(name(host).alias("host"), name(bad).cast("int").alias("bad"))
        .where(F.col("host") != "")
        .groupBy("host")
        .agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
        .select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "k")
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def posterior(prior: Column, strength: Column) -> Column:
        return (F.col("k") + strength * prior) / (F.col("n") + strength)

    corpus = _strength(suffixes, [], low, high).first()  # one row of three numbers
    m0 = ((corpus.K or 0.0) + base_strength * base_rate) / ((corpus.N or 0.0) + base_strength)
    level1 = suffixes.select("suffix", posterior(F.lit(m0), F.lit(corpus.strength)).alias("m1"))
    level1 = level1.join(_strength(domains, ["suffix"], low, high).select("suffix", F.col("strength").alias("s1")), "suffix")
    level2 = domains.join(level1, "suffix").select("domain", posterior(F.col("m1"), F.col("s1")).alias("m2"))
    level2 = level2.join(_strength(hosts, ["domain"], low, high).select("domain", F.col("strength").alias("s2")), "domain")
    alpha, beta = F.col("alpha"), F.col("beta")
    sd = F.sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))
    return (
        hosts.join(level2, "domain")
        .select(
            "host",
            "n",
            "k",
            (F.col("k") + F.col("s2") * F.col("m2")).alias("alpha"),
            (F.col("n") - F.col("k") + F.col("s2") * (1 - F.col("m2"))).alias("beta"),
        )
        .select(
            "host",
            F.col("n").cast("long").alias("labelled"),
            F.col("k").cast("long").alias("bad"),
            (alpha / (alpha + beta)).alias("bad_rate"),
            F.greatest(F.lit(0.0), alpha / (alpha + beta) - z * sd).alias("bad_low"),
            F.least(F.lit(1.0), alpha / (alpha + beta) + z * sd).alias("bad_high"),
        )
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = (),
    max_bad: float = 0.3,
    broadcast_hosts: int = 20_000,
    **reputation,
) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, verdict, labelled, bad_low.

    ``outcomes`` has columns host and bad (see host_reputation) and should hold every
    host of ``pages``.  verdict is the longest fitting rule's, else ``block`` where the
    lower bound of the host's bad rate is above ``max_bad``, else ``allow`` (also for
    null or odd urls).  ``max_bad`` states a loss: at 0.3 letting a bad page through costs
    7 where blocking a good one costs 3.  Each row is judged by itself, repeated ones too;
    input columns named like the outputs are replaced; an empty table gives no rows.
    """
    added = ("host", "path", "rule", "verdict", "labelled", "bad_low")
    kept = [c for c in pages.columns if c not in added]
    host, path = url_parts(name(url))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = (
        pages.select(F.struct(*[name(c) for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
        .withColumn("rule", rule)
        .withColumn("by_rule", verdict)
    )
    known = durable(host_reputation(outcomes, **reputation).select("host", "labelled", "bad_low"))
    low = F.coalesce(F.col("bad_low"), F.lit(0.0))
    return rows.join(small_side(known, broadcast_hosts), "host", "left").select(
        *[F.col("row")[c].alias(c) for c in kept],
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(low > max_bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("labelled", F.lit(0)).cast("long").alias("labelled"),
        "bad_low",
    )
