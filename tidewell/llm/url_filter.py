"""URL filters: host rules, then empirical-Bayes reputation of the host.

Labelled pages have a good or bad outcome.  A host's bad rate is shrunk to that
of its registered domain, which is shrunk to that of its public suffix, which
is shrunk to the overall rate.  Each level's prior is a beta distribution whose
mean is the level above and whose strength is fitted to the level's own
outcomes by the method of moments for beta-binomial counts.  A page is blocked
when the lower posterior bound, the ``alpha`` quantile of its host's beta
posterior, reaches ``limit``.

Hosts count by their names: user info, port and a final dot are taken off, and
an address is its own domain, under no suffix.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_lookup, shuffle_width, written

# Rules as (verdict, host, path start).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

# Labels that are registries of their own under a country's code of two letters.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org", "sch")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """The name in a host part: without user info, port and final dot; brackets of an address stay."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(name, r"\.$", "")


def is_address(site: Column) -> Column:
    return site.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | site.startswith("[")


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (site, unique, and more) with domain and suffix.

    ``suffixes`` has a column ``rule``, as in the public suffix list: names, names
    after ``*.`` for any label there, and names after ``!`` for exceptions; the
    longest rule holds, an exception before all others.  Without it, a country's
    second-level registries (``SECOND_LEVELS``) are suffixes, and else the last
    label is.  A site that is a suffix itself is its own domain.
    """
    labels = F.split("site", r"\.")
    if suffixes is None:
        two = (F.size(labels) > 1) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVELS)
        hosts = hosts.withColumn("_n", F.when(two, 2).otherwise(1))
    else:
        rules = suffixes.select(F.lower(F.trim("rule")).alias("rule")).where("rule != ''").distinct()
        kind = F.when(F.col("rule").startswith("!"), "!").when(F.col("rule").startswith("*."), "*").otherwise("=")
        rules = rules.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("tail"), kind.alias("kind"))
        each = F.posexplode(F.expr("transform(sequence(1, size), k -> substring_index(site, '.', -k))")).alias("at", "tail")
        tails = hosts.select("site", F.size(labels).alias("size")).select("site", "size", each)
        exception, any_label = F.col("kind") == "!", F.col("kind") == "*"
        n = F.when(exception, F.col("at")).when(any_label, F.col("at") + 2).otherwise(F.col("at") + 1)
        fits = tails.join(rules, "tail").select("site", "size", F.struct(exception.alias("first"), n.alias("n")).alias("fit")).where("fit.n <= size")
        best = fits.groupBy("site").agg(F.max("fit").alias("fit"))
        hosts = hosts.join(best, "site", "left").withColumn("_n", F.coalesce("fit.n", F.lit(1))).drop("fit")
    address = is_address(F.col("site"))
    suffix = F.when(address, "").otherwise(F.expr("substring_index(site, '.', -_n)"))
    domain = F.when(address, F.col("site")).otherwise(F.expr("substring_index(site, '.', -_n - 1)"))
    return hosts.withColumn("suffix", suffix).withColumn("domain", domain).drop("_n")


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    x, a, b = (np.array(v, float) for v in np.broadcast_arrays(x, a, b))
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    log_gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a if x.size else x
    tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c = np.ones_like(x)
    d = 1 / tiny(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / tiny(1 + top * d)
            c = tiny(1 + top / c)
            h = h * d * c
        if not x.size or np.abs(d * c - 1).max() < 1e-14:
            break
    return np.where(turn, 1 - front * h, front * h)


def beta_quantile(alpha: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ``alpha`` quantile of beta distributions, by bisection."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(50):
        mid = (low + high) / 2
        under = beta_below(mid, a, b) < alpha
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def posterior(a: Column, b: Column, alpha: float, limit: float) -> Column:
    """Struct of doubt, the probability of a rate under ``limit``, and bound, the ``alpha`` quantile."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            x, y = x.to_numpy(float), y.to_numpy(float)
            yield pd.DataFrame({"doubt": beta_below(np.full(len(x), limit), x, y), "bound": beta_quantile(alpha, x, y)})

    return F.pandas_udf(run, "doubt double, bound double")(a, b)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null; ties go to the smaller rule."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def reputations(
    outcomes: DataFrame, limit: float = 0.5, alpha: float = 0.05, floor: float = 1.0, suffixes: DataFrame | None = None
) -> DataFrame:
    """Posterior of each host's bad rate from per-host sums.

    ``outcomes`` has site, n (labelled pages, may be 0) and bad, one row a site.
    Returns site, n, bad, rate, doubt, bound and blocked.  Hosts without labels
    have the posterior of their domain's prior.  ``floor`` is the least strength
    of a prior; a level whose outcomes vary no more than binomial counts do is
    shrunk with 1000 times that.
    """
    hosts, _ = written(with_domains(outcomes, suffixes), "domains")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = by_suffix.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior"))

    # Half of all domains share a suffix, and a third of all hosts may share a domain: their priors come by salted lookups.
    # Each level reads the one above twice, so that is written, lest the plan double with every level.
    def raised(level: DataFrame, up: str, name: str, above: DataFrame) -> DataFrame:
        rates, _ = written(above.select(up, F.col("rate").alias("_up")), f"{up}-rates")
        return salted_lookup(level, up, F.col(name), rates)

    def shrunk(level: DataFrame, prior: Column) -> DataFrame:
        # Moments: the spread of the rates beyond that of binomial counts gives the strength.
        rows = level.withColumn("prior", prior)
        err = (F.col("bad") - F.col("n") * F.col("prior")) ** 2
        var = F.col("prior") * (1 - F.col("prior"))
        extra = F.sum(F.when(F.col("n") > 1, err - F.col("n") * var))
        room = F.sum(F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) * var))
        rho = rows.agg((extra / F.when(room > 0, room)).alias("rho"))
        lowest = 1.0 / (1000.0 * floor + 1.0)
        strength = 1.0 / F.least(F.greatest(F.coalesce("rho", F.lit(lowest)), F.lit(lowest)), F.lit(1.0 / (floor + 1.0))) - 1.0
        out = rows.withColumn("rho", rho.scalar()).withColumn("strength", strength).drop("rho")
        return out.withColumn("rate", (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))

    by_suffix = shrunk(by_suffix, top.scalar())
    by_domain = shrunk(raised(domains, "suffix", "domain", by_suffix), F.col("_up"))
    by_host = shrunk(raised(hosts, "domain", "site", by_domain), F.col("_up"))
    good = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))
    seen = posterior(F.col("bad") + F.col("strength") * F.col("prior"), good, alpha, limit)
    return by_host.withColumn("seen", seen).select(
        "site", "n", "bad", "rate", "seen.doubt", "seen.bound", (F.col("seen.doubt") <= F.lit(alpha)).alias("blocked")
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules=RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    salts: int | None = None,
    **options,
) -> DataFrame:
    """A verdict on every page: a fitting rule's, else the host's reputation's.

    ``outcomes`` has ``id_col`` and bad (boolean), labels of some pages; labels
    of unknown pages count for nothing, a page with several labels counts each.
    Returns ``id_col``, host, path, rule, verdict, and the host's n, bad, rate,
    doubt and bound.  A null url, or one without ``://``, has empty host and
    path; such pages share the empty host.  Repeated rows are judged each.  Other
    columns of ``pages`` are not read.

    Hosts that hold a third of all pages are summed by (site, salt) first; the
    reputation goes back to those pairs, and the pages join on both.
    """
    salts = salts or shuffle_width(pages.sparkSession)
    url = F.col(url_col)
    salt = F.pmod(F.xxhash64(id_col, url_col), F.lit(salts)).cast("int")  # pages of null id are told apart by their urls
    read = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), salt.alias("_salt")).withColumn("_site", site_of(F.col("host")))
    labels = outcomes.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.count(F.when(F.col("bad").isNotNull(), 1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad")
    )
    labelled = read.where(F.col(id_col).isNotNull()).select(id_col, F.col("_site").alias("site"), "_salt").join(labels, id_col)
    labelled = labelled.groupBy("site", "_salt").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    pairs = read.select(F.col("_site").alias("site"), "_salt").distinct().join(labelled, ["site", "_salt"], "left")
    pairs, _ = written(pairs.select("site", "_salt", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")), "host-salts")
    hosts = pairs.groupBy("site").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    fetched = pairs.select("site", "_salt").join(reputations(hosts, **options), "site").withColumnRenamed("site", "_site")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return read.join(fetched, ["_site", "_salt"]).withColumn("_rule", rule).select(
        id_col,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.col("n").alias("host_labelled"),
        F.col("bad").alias("host_bad"),
        F.round("rate", 9).alias("host_rate"),
        F.round("doubt", 6).alias("host_doubt"),
        F.round("bound", 9).alias("host_bound"),
    )


def article_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose article is a labelled document.

    The last number in a page's path is its article's document; the page is bad
    if that document is toxic or of low quality.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})[^/]*/?$", 1)
    article = pages.select("page_id", number.alias("num"))
    article = article.where(F.col("num") != "").select("page_id", F.col("num").cast("long").alias("doc_id"))
    judged = labels.select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return article.join(judged, "doc_id").select("page_id", "bad")
