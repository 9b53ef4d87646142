"""URL filter: fixed rules first, then the reputation of hosts by empirical Bayes.

Outcomes of labelled pages are counted by host. A host's share of bad pages has a beta prior whose
mean is that of its registered domain and whose strength is estimated from how hosts differ; the
domain is shrunk towards its suffix and the suffix towards all pages in the same way. A url is
blocked if the lower bound of its host's posterior is above a limit, so a host needs evidence to
be blocked; one without labelled pages is judged by its domain, suffix or all pages. User, port and a
final dot are no part of what evidence is counted for, and an address is its own domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import common
from postwatch.session import fresh_dir

#: Fixed values of the contract: (host, path) of allowed and blocked places.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("host", "domain", "suffix")
#: Labels under which countries' registries register names, before an ending of two letters.
SECOND_LEVELS = ("ac co com edu go gob gouv gov ltd me mil ne net nhs nom or org plc sch").split()
#: Four numbers, or anything in brackets, and the suffix that all addresses share.
ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"
ADDRESSES = "(address)"


@dataclass(frozen=True)
class Limits:
    """A url is blocked if its host's bad share is above ``most_bad`` with ``deviations`` to spare."""

    most_bad: float = 0.25
    deviations: float = 1.645
    least_strength: float = 2.0
    most_strength: float = 1000.0


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end."""
    place = F.instr(url, "://")
    rest = F.substr(url, place + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(place > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    place = F.instr(url, "://")
    rest = F.substr(url, place + 3)
    return F.when(place > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda x: (-len(x[0] + x[1]), x))
    out = F.lit(None)
    for name, start, verdict in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
                     ).otherwise(out)
    return out


def site_of(host: Column) -> Column:
    """The host without user, port and final dot, which is what reputations are kept for."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.+$", "")


def is_address(site: Column) -> Column:
    return site.rlike(ADDRESS)


def suffix_of(site: Column) -> Column:
    """The last label, or the last two where a country's registry has such second levels."""
    labels = F.split(site, r"\.")
    last, before = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    country = (F.length(last) == 2) & before.isin(*SECOND_LEVELS) & (F.size(labels) > 2)
    return F.when(is_address(site), F.lit(ADDRESSES)).when(
        country, F.concat_ws(".", before, last)).otherwise(last)


def domain_of(site: Column) -> Column:
    """The suffix and the label before it; an address is its own domain."""
    labels, suffix = F.split(site, r"\."), suffix_of(site)
    wide = F.when(suffix.contains("."), F.lit(3)).otherwise(F.lit(2))
    size = F.size(labels)
    return F.when(is_address(site) | (size <= wide), site).otherwise(
        F.concat_ws(".", F.slice(labels, size - wide + 1, wide)))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, n, bad)`` of labelled pages: a page is bad if its document is toxic or of no quality.

    Pages and labels meet by id. Rows without an id or label teach nothing.
    """
    judged = labels.select(
        F.col("doc_id").cast("bigint").alias("page_id"),
        F.when((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1), 1)
        .when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"),
    ).filter("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.select(F.col("page_id").cast("bigint").alias("page_id"),
                        site_of(host_of(F.col("url"))).alias("host")).filter("host <> ''")
    return (seen.join(judged, "page_id").groupBy("host")
            .agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))


def shrunk(children: DataFrame, parents: DataFrame, parent: str, limits: Limits) -> DataFrame:
    """``children (key, parent, n, bad)`` with ``mean`` and ``strength`` of their priors joined.

    The strength of the prior under one parent is estimated by moments: if children differ no
    more than chance makes them, it is large, and they are all close to the parent.
    """
    rate, mean = F.col("bad") / F.col("n"), F.col("prior_mean")
    joined = children.join(parents.select(F.col("key").alias(parent),
                                          F.col("mean").alias("prior_mean")), parent)
    spread = joined.groupBy(parent).agg(
        F.count("*").alias("k"), F.sum("n").alias("total"),
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("between"),
        F.first("prior_mean").alias("m"))
    noise = F.col("m") * (1 - F.col("m"))
    # Expected: between = k * noise + excess * (total - k), excess = noise / (strength + 1).
    excess = (F.col("between") - F.col("k") * noise) / (F.col("total") - F.col("k"))
    strength = F.when((F.col("total") > F.col("k")) & (excess > 0), noise / excess - 1).otherwise(
        F.lit(limits.most_strength))
    spread = spread.select(parent, F.least(F.greatest(strength, F.lit(limits.least_strength)),
                                           F.lit(limits.most_strength)).alias("strength"))
    return joined.join(spread, parent)


def reputations(found: DataFrame, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """For each level ``(key, mean, bound)``: posterior mean of the bad share and its lower bound.

    Every level is the prior of the next, so each is written once and read from there.
    """
    spark, path = found.sparkSession, fresh_dir(found.sparkSession, "reputations")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    hosts = kept(found, "outcomes").select(F.col("host").alias("key"), "n", "bad").withColumns(
        {"domain": domain_of(F.col("key")), "suffix": suffix_of(F.col("key"))})
    domains = hosts.groupBy(F.col("domain").alias("key")).agg(
        F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy(F.col("suffix").alias("key")).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all", F.lit("all"))
    # One bad and one good page more, so that no mean is 0 or 1.
    everything = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(
        F.lit("all").alias("key"), ((F.coalesce("bad", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2))
        .alias("mean"), (F.coalesce("n", F.lit(0)) + 2).alias("weight"))
    out = {"all": everything.select("key", "mean", bound_of(F.col("mean"), F.col("weight"), limits))}
    for level, rows, parent, above in (("suffix", suffixes, "all", None),
                                       ("domain", domains, "suffix", "suffix"),
                                       ("host", hosts, "domain", "domain")):
        parents = out[above or "all"]
        posterior = shrunk(rows, parents, parent, limits).select(
            "key", ((F.col("bad") + F.col("strength") * F.col("prior_mean"))
                    / (F.col("n") + F.col("strength"))).alias("mean"),
            (F.col("n") + F.col("strength")).alias("weight"))
        out[level] = kept(
            posterior.select("key", "mean", bound_of(F.col("mean"), F.col("weight"), limits)), level)
    return out


def bound_of(mean: Column, weight: Column, limits: Limits) -> Column:
    """Lower bound of a beta posterior, by its mean and standard deviation."""
    deviation = F.sqrt(mean * (1 - mean) / (weight + 1))
    return F.greatest(mean - limits.deviations * deviation, F.lit(0.0)).alias("bound")


def judge(pages: DataFrame, labels: DataFrame, limits: Limits = Limits(), rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, bad_share, verdict)`` of every row of ``pages``.

    A null url or one without ``://`` has an empty host and path, no rule, and is judged by all
    pages, as is a host whose suffix no labelled page has. Without labelled pages everything
    without a rule is allowed. Repeated rows and null ids pass through; other columns of both
    tables are not read. ``bad_share`` is the posterior mean, rounded to six digits.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"),
                       F.coalesce("path", F.lit("")).alias("path"))
    levels = reputations(outcomes(pages, labels), limits)
    # One row for each host that any page has; pages are joined with that, not with each level.
    site = site_of(F.col("host"))
    known = rows.select("host").distinct().withColumns(
        {"site": site, "domain": domain_of(site), "suffix": suffix_of(site), "all": F.lit("all")})
    for level in ("host", "domain", "suffix", "all"):
        side = levels[level].select(F.col("key").alias("site" if level == "host" else level),
                                    F.struct("mean", "bound").alias(f"by_{level}"))
        known = known.join(F.broadcast(side) if level == "all" else side, "site" if level == "host" else level, "left")
    best = F.coalesce(*(F.col(f"by_{x}") for x in ("host", "domain", "suffix", "all")))
    path = fresh_dir(pages.sparkSession, "hosts")
    known.select("host", best.alias("best")).write.parquet(path)
    # Both sides of the last join come straight from a scan, so a busy host's pages can be split.
    known = pages.sparkSession.read.parquet(path)
    fitting = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("best.bound") > limits.most_bad, "block").otherwise("allow")
    return rows.join(known, "host", "left").select(
        "page_id", "host", "path", fitting["rule"].alias("rule"),
        F.round("best.mean", 6).alias("bad_share"),
        F.coalesce(fitting["verdict"], by_method).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "labels"))


def oracle(limits: Limits = Limits()) -> str:
    """The same computation as SQL."""
    shrink = """, {level}_in AS (
  SELECT c.*, p.mean AS m FROM {rows} AS c JOIN {parents} AS p ON c.{parent} = p.key
), {level}_spread AS (
  SELECT {parent}, count(*) AS k, sum(n) AS total, any_value(m) AS m,
         sum(n * (bad / n - m) * (bad / n - m)) AS between_
  FROM {level}_in GROUP BY {parent}
), {level}_strength AS (
  SELECT {parent}, least(greatest(CASE WHEN total > k AND between_ - k * m * (1 - m) > 0
    THEN m * (1 - m) / ((between_ - k * m * (1 - m)) / (total - k)) - 1
    ELSE {most} END, {least}), {most}) AS s
  FROM {level}_spread
), {level}_post AS (
  SELECT key, (bad + s * m) / (n + s) AS mean, n + s AS weight
  FROM {level}_in JOIN {level}_strength USING ({parent})
)"""
    steps = "".join(
        shrink.format(level=level, rows=rows, parents=parents, parent=parent,
                      most=limits.most_strength, least=limits.least_strength)
        for level, rows, parents, parent in (("suffix", "suffixes", "everything", "all_"),
                                             ("domain", "domains", "suffix_post", "suffix"),
                                             ("host", "hosts", "domain_post", "domain"))
    )
    names = {True: [], False: []}
    for host, path, verdict in sorted(RULES, key=lambda x: -len(x[0] + x[1])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        names[True].append(f"WHEN {fits} THEN '{host}{path}'")
        names[False].append(f"WHEN {fits} THEN '{verdict}'")
    labels = "string_split(site, '.')"
    address = f"regexp_matches(site, '{ADDRESS}')"
    seconds = ", ".join(f"'{x}'" for x in SECOND_LEVELS)
    suffix = f"""CASE WHEN {address} THEN '{ADDRESSES}'
      WHEN len({labels}) > 2 AND length({labels}[-1]) = 2 AND {labels}[-2] IN ({seconds})
      THEN {labels}[-2] || '.' || {labels}[-1] ELSE {labels}[-1] END"""
    domain = f"""CASE WHEN {address} THEN site ELSE
      array_to_string({labels}[-(CASE WHEN contains({suffix}, '.') THEN 3 ELSE 2 END):], '.') END"""
    return f"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN
    translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}')
    ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN
    regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), page AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS site
  FROM split
), judged AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END)::DOUBLE AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT site AS key, {domain} AS domain, {suffix} AS suffix, count(*)::DOUBLE AS n, sum(bad) AS bad
  FROM page JOIN judged USING (page_id) WHERE site <> '' GROUP BY site
), domains AS (
  SELECT domain AS key, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1
), suffixes AS (
  SELECT suffix AS key, 'all' AS all_, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1
), everything AS (
  SELECT 'all' AS key, (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean,
         coalesce(sum(n), 0) + 2 AS weight
  FROM suffixes
){steps}, placed AS (
  SELECT *, {domain} AS domain, {suffix} AS suffix FROM page
), rated AS (
  SELECT page_id, host, path, coalesce(h.mean, d.mean, s.mean, e.mean) AS mean,
         coalesce(h.weight, d.weight, s.weight, e.weight) AS weight
  FROM placed LEFT JOIN host_post h ON h.key = site LEFT JOIN domain_post d ON d.key = domain
  LEFT JOIN suffix_post s ON s.key = suffix CROSS JOIN everything e
)
SELECT page_id, host, path, CASE {" ".join(names[True])} END AS rule, round(mean, 6) AS bad_share,
  CASE {" ".join(names[False])}
  WHEN mean - {limits.deviations} * sqrt(mean * (1 - mean) / (weight + 1)) > {limits.most_bad}
  THEN 'block' ELSE 'allow' END AS verdict
FROM rated
"""


ORACLE = oracle()
