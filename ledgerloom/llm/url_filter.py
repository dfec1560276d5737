"""URL filters: explicit host and path rules, and empirical-Bayes host reputation for everything else.

Labelled page outcomes (bad or not) are counted by host and summed up to registered domain and suffix.
Each level's rate is shrunk to the level above: with the parent's posterior mean m and a concentration k
estimated for the level by moments (how far the children's rates scatter beyond sampling noise), a node
with b bad of n pages has the posterior Beta(k m + b, k (1 - m) + n - b). A page without a rule is blocked
when the lower bound of its host's posterior bad rate exceeds ``max_bad``; a host, domain or suffix
without labelled pages passes its parent's posterior on unchanged. DataFrame functions only.

Suffixes follow rules in the public-suffix notation (``co.uk``, ``*.ck``, ``!www.ck``), a parameter: an exception
beats the rest, then the longest rule holds, and without one the last label is the suffix. For domain and suffix a
host loses its user part, port and trailing dots; an IP address is its own domain and suffix. Rules for hosts, counts and
the output keep the host as it stands in the url.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import materialize
from .common import free_names

#: Common public suffixes beyond the single last label; give the whole public list as ``suffix_rules``.
SUFFIX_RULES = (
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk", "ac.id", "co.id", "go.id", "or.id",
    "ac.il", "co.il", "gov.il", "org.il", "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.th", "co.th", "go.th", "ac.za", "co.za",
    "gov.za", "org.za", "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "com.ar", "gob.ar", "org.ar", "com.br",
    "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.co", "com.eg", "com.hk", "org.hk", "com.mx",
    "gob.mx", "org.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "net.pl", "org.pl", "com.sa", "com.sg", "edu.sg",
    "com.tr", "gov.tr", "org.tr", "com.tw", "org.tw", "com.ua", "com.vn", "*.bd", "*.ck", "!www.ck", "*.kh", "*.mm", "*.np",
    "blogspot.com", "github.io", "gitlab.io", "netlify.app", "pages.dev", "vercel.app", "wordpress.com")

MAX_BAD = 0.5  # a host is blocked when its bad rate is above this ...
BOUND_Z = 1.64  # ... by a one-sided bound of so many posterior standard deviations (about 95 %)
K_RANGE = (1.0, 1000.0)  # a level's concentration, as estimated by moments, stays within these bounds

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; '' for null or no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user part, port and trailing dots."""
    return F.rtrim(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", ""), F.lit("."))


def _is_address(site: Column) -> Column:
    return site.rlike(r"^\[.*\]$") | site.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def _parts(host: Column, rules: Sequence[str]) -> Column:
    """struct<domain, suffix> of a host. The site and its labels are computed once, as lambda arguments."""
    plain, wild, exceptions = [], [], []
    for rule in sorted({r.strip().lower() for r in rules}):
        kind, name = (exceptions, rule[1:]) if rule.startswith("!") else (wild, rule[2:]) if rule.startswith("*.") else (plain, rule)
        kind.append(name)
    depth = max([r.count(".") + 1 for r in plain + exceptions] + [r.count(".") + 2 for r in wild], default=1)

    def last(labels: Column, n: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), ".")

    def among(name: Column, names: list[str]) -> Column:
        return name.isin(*names) if names else F.lit(False)

    def cut(labels: Column) -> Column:
        # the labels of each rule that fits the host's last n labels; an exception counts above all others
        fits = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda n: F.when(
            among(last(labels, n), exceptions), n - 1 + 2 * depth).when(
            among(last(labels, n), plain) | ((n > 1) & among(last(labels, n - 1), wild)), n).otherwise(1))
        longest = F.array_max(fits)
        n = F.when(longest > depth, longest - 2 * depth).otherwise(longest)
        return F.struct(last(labels, n + 1).alias("domain"), last(labels, n).alias("suffix"))

    def parts(site: Column) -> Column:
        return F.when(_is_address(site), F.struct(site.alias("domain"), site.alias("suffix"))).otherwise(
            F.element_at(F.transform(F.array(F.split(site, r"\.")), cut), 1))

    return F.element_at(F.transform(F.array(site_of(host)), parts), 1)


def suffix_of(host: Column, rules: Sequence[str] = SUFFIX_RULES) -> Column:
    return _parts(host, rules)["suffix"]


def domain_of(host: Column, rules: Sequence[str] = SUFFIX_RULES) -> Column:
    """The registered domain: the suffix and one label more; a host that is a suffix is its own domain."""
    return _parts(host, rules)["domain"]


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, action) of the longest of ``rules`` (host, path, action) that fits, else nulls."""
    text = action = None
    for h, p, verb in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(F.lit("." + h))) & path.startswith(F.lit(p))
        text = F.when(fits, F.lit(h + p)) if text is None else text.when(fits, F.lit(h + p))
        action = F.when(fits, F.lit(verb)) if action is None else action.when(fits, F.lit(verb))
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, action)


def _concentration(nodes: DataFrame, k_range: tuple[float, float]) -> DataFrame:
    """One row ``_k`` for the level: k = m(1-m)/v - 1, with v the scatter of the nodes' rates around their
    parents' means beyond binomial noise; within ``k_range``, and its upper end when there is no such scatter."""
    low, high = map(F.lit, k_range)
    gap = F.sum(F.col("_n") * F.pow(F.col("_b") / F.col("_n") - F.col("_m"), 2) - F.col("_m") * (1 - F.col("_m")))
    weight = F.sum(F.col("_n") - 1)
    spread = F.sum((F.col("_n") - 1) * F.col("_m") * (1 - F.col("_m")))
    rho = F.when((weight > 0) & (spread > 0), gap / spread)
    k = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, low), high)).otherwise(high)
    return nodes.agg(k.alias("_k"))


def host_reputation(outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad", suffix_rules: Sequence[str] = SUFFIX_RULES,
                    k_range: tuple[float, float] = K_RANGE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors (alpha, beta) by host, domain, suffix, and the one global row, from labelled outcomes.

    ``bad_col`` is 0 or 1; rows with a null outcome do not count. Hosts' counts are aggregated map-side, so a
    host with a third of all rows is one partial row a task. Counts and each level are written once under
    ``spark.checkpoint.dir``; what follows reads these small tables.
    """
    spark = outcomes.sparkSession
    h = F.col(f"`{host_col}`")
    hosts = (outcomes.where(F.col(f"`{bad_col}`").isNotNull()).groupBy(h.alias("host"))
             .agg(F.count("*").cast("double").alias("_n"), F.sum(F.col(f"`{bad_col}`")).cast("double").alias("_b")))
    hosts = materialize(spark, hosts.withColumn("_parts", _parts(F.col("host"), suffix_rules)).select("host", "_n", "_b", "_parts.domain", "_parts.suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"))
    world = hosts.agg((F.coalesce(F.sum("_b"), F.lit(0.0)) + 1).alias("alpha"), (F.coalesce(F.sum(F.col("_n") - F.col("_b")), F.lit(0.0)) + 1).alias("beta"))

    def shrunk(nodes: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
        mean = parents.select(*on, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("_m"))
        nodes = nodes.join(mean, on) if on else nodes.withColumn("_m", mean.scalar())
        return materialize(spark, nodes.withColumn("_k", _concentration(nodes, k_range).scalar()).withColumns({
            "alpha": F.col("_k") * F.col("_m") + F.col("_b"), "beta": F.col("_k") * (1 - F.col("_m")) + F.col("_n") - F.col("_b")}).drop("_k", "_m", "_n", "_b"))

    world = materialize(spark, world)
    by_suffix = shrunk(suffixes, world, [])
    by_domain = shrunk(domains, by_suffix, ["suffix"])
    by_host = shrunk(hosts, by_domain.drop("suffix"), ["domain"])
    return by_host.select("host", "alpha", "beta"), by_domain.select("domain", "alpha", "beta"), by_suffix.select("suffix", "alpha", "beta"), world


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), url_col: str = "url",
               max_bad: float = MAX_BAD, z: float = BOUND_Z, suffix_rules: Sequence[str] = SUFFIX_RULES,
               k_range: tuple[float, float] = K_RANGE) -> DataFrame:
    """``pages`` with host, path, rule (string or null), verdict ('allow' or 'block'), bad_rate (posterior mean)
    and bad_bound (the lower bound that is held against ``max_bad``).

    ``outcomes`` has a ``url`` and a ``bad`` flag for labelled pages. The longest fitting rule decides, else the
    host's posterior bound. A null url, or one without ``://``, has an empty host and path, for which no rule
    holds unless a rule's host is empty. Repeated pages are judged alike, empty tables give no rows, without
    labels every page without a rule is allowed. Other columns pass through; those already named like an
    output column, in any case of letters, are replaced.
    """
    names = ("host", "path", "rule", "verdict", "bad_rate", "bad_bound")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in names]
    host, path, rate, low, fallback = free_names(pages.columns, "_host", "_path", "_rate", "_bound", "_fallback")
    url = F.col(f"`{url_col}`")
    rows = pages.select(*kept, url_host(url).alias(host), url_path(url).alias(path))
    by_host, by_domain, by_suffix, world = host_reputation(outcomes.select(url_host(F.col("url")).alias("host"), F.col("bad")),
                                                           suffix_rules=suffix_rules, k_range=k_range)

    def level(frame: DataFrame, key: str) -> DataFrame:
        return frame.select(key, F.col("alpha").alias(f"a_{key}"), F.col("beta").alias(f"b_{key}"))

    # reputation is settled once for each distinct host, then joined to the pages
    hosts = rows.select(F.col(host).alias("host")).distinct().withColumn("parts", _parts(F.col("host"), suffix_rules)).select("host", "parts.domain", "parts.suffix")
    hosts = (hosts.join(level(by_host, "host"), "host", "left").join(level(by_domain, "domain"), "domain", "left")
             .join(level(by_suffix, "suffix"), "suffix", "left")
             .withColumns({"a_world": world.select("alpha").scalar(), "b_world": world.select("beta").scalar()}))
    a = F.coalesce("a_host", "a_domain", "a_suffix", "a_world")
    b = F.coalesce("b_host", "b_domain", "b_suffix", "b_world")
    mean = a / (a + b)
    bound = mean - F.lit(z) * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    hosts = hosts.select(F.col("host").alias(host), mean.alias(rate), bound.alias(low),
                         F.when(bound > max_bad, F.lit("block")).otherwise(F.lit("allow")).alias(fallback))

    text, action = matching_rule(F.col(host), F.col(path), rules)
    judged = rows.join(hosts, host)
    return judged.select(*kept, F.col(host).alias("host"), F.col(path).alias("path"), text.alias("rule"),
                         F.coalesce(action, F.col(fallback)).alias("verdict"), F.col(rate).alias("bad_rate"), F.col(low).alias("bad_bound"))
