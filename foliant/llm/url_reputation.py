"""URL filter by empirical-Bayes host reputation.

Rules label some pages. Their outcomes are shrunk through beta-binomial priors: a host towards its
registered domain, that towards its suffix, that towards all pages. How strongly each level shrinks
is estimated from the spread of the level below (moments of a beta-binomial). A page that no rule
fits is blocked if the posterior lower bound of its host's share of blocked pages is high enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import LOWER, UPPER, Scratch, replaced

#: (verdict, host, path), fixed by the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Standard deviations that the bound lies below the posterior mean, the bound from which a host is
#: blocked, and the limits of a prior's weight in pages.
DEVIATIONS, BLOCK_FROM, LEAST_WEIGHT, MOST_WEIGHT = 1.2816, 0.5, 0.5, 1000.0


#: A suffix in a pattern: a country behind one of these second labels, or the last label. Hosts that are numbers
#: (IPv4) or in brackets (IPv6) are their own domain and suffix; ports don't count.
SUFFIX, NUMBERS = r"(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]*)", r"^[0-9.]+$|^\["


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host, by which hosts share their priors."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    part = lambda pattern: F.when(bare.rlike(NUMBERS), bare).otherwise(F.regexp_extract(bare, rf"(?:^|\.)({pattern})$", 1))
    return part(rf"(?:[^.]+\.)?{SUFFIX}"), part(SUFFIX)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def first_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _weights(groups: DataFrame, above: list[str]) -> float:
    """The prior's weight at a level: 1 / rho - 1 for the intraclass correlation rho of outcomes in groups.

    groups has n and bad for each group; groups are compared within their parent. One row of sums
    reaches the driver."""
    seen = groups.where("n > 0")
    parts = seen.groupBy(*above) if above else seen.groupBy()
    parts = parts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.expr("double(bad) * bad / n")).alias("sq"), F.sum(F.expr("double(n) * n")).alias("nn"))
    row = parts.agg(
        F.sum(F.expr("k - 1")).alias("between"),
        F.sum(F.expr("n - k")).alias("within"),
        F.sum(F.expr("sq - double(bad) * bad / n")).alias("ss_between"),
        F.sum(F.expr("bad - sq")).alias("ss_within"),
        F.sum(F.expr("n - nn / n")).alias("size"),
    ).first()
    if not row.between or not row.within:
        return LEAST_WEIGHT
    msb, msw, n0 = row.ss_between / row.between, row.ss_within / row.within, row.size / row.between
    if msb + (n0 - 1) * msw <= 0:
        return MOST_WEIGHT
    rho = (msb - msw) / (msb + (n0 - 1) * msw)
    return min(max(1 / rho - 1, LEAST_WEIGHT), MOST_WEIGHT) if rho > 0 else MOST_WEIGHT


def url_verdicts(spark: SparkSession, pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and bound (null where a rule decides), a row for each row.

    Null urls and those without :// have an empty host and path, and are judged together as one
    host. Rules are tried from the longest to the shortest; rules of one length in the order of
    their text. A host without labelled pages has its domain's rate, and so on upwards; without any
    labelled page the rate is a half and every page is allowed. Repeated rows count as often as
    they come; urls of any length are judged whole. An empty table gives an empty result. Columns named
    like the results are replaced."""
    outs = ("host", "path", "rule", "verdict", "bound")
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({"__host": host, "__path": path})
    rows = replaced(rows, *outs).withColumnsRenamed({"__host": "host", "__path": "path"})
    rule, said = first_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "__said": said})

    hosts = rows.groupBy("host").agg(F.count("__said").alias("n"), F.count(F.when(F.col("__said") == "block", 1)).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    scratch = Scratch(spark)
    hosts = scratch.save(hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    top = (total.bad or 0) / total.n if total.n else 0.5
    weight = {"suffix": _weights(suffixes, []), "domain": _weights(domains, ["suffix"]), "host": _weights(hosts, ["suffix", "domain"])}

    def shrunk(prior: Column, w: float) -> Column:
        return (F.col("bad") + F.lit(w) * prior) / (F.col("n") + F.lit(w))

    by_suffix = suffixes.select("suffix", shrunk(F.lit(top), weight["suffix"]).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select("suffix", "domain", shrunk(F.col("suffix_rate"), weight["domain"]).alias("domain_rate"))
    by_host = hosts.join(by_domain, ["suffix", "domain"]).withColumn("rate", shrunk(F.col("domain_rate"), weight["host"]))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(weight["host"]) + 1))
    by_host = scratch.save(by_host.select("host", (F.col("rate") - F.lit(DEVIATIONS) * spread).alias("__bound")), "bounds")

    # hosts are as many as the input has; Spark splits the join of two plain shuffles where a host is hot,
    # or broadcasts the small side by its size
    judged = rows.join(by_host, "host", "left")
    by_method = F.when(F.col("__bound") >= BLOCK_FROM, "block").otherwise("allow")
    judged = judged.withColumns({"verdict": F.coalesce("__said", by_method), "bound": F.when(F.col("__said").isNull(), F.col("__bound"))})
    return judged.drop("__said", "__bound")


def oracle(rules=RULES) -> str:
    """The same in DuckDB's SQL over the view pages."""
    fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[i]}'" for f in fits) + " END"
    weight = lambda name, table, above: f"""
{name}_parts AS (SELECT count(*) k, sum(n)::DOUBLE n, sum(bad)::DOUBLE bad, sum(bad::DOUBLE * bad / n) sq, sum(n::DOUBLE * n) nn FROM {table} WHERE n > 0 {above}),
{name}_sums AS (SELECT sum(k - 1) b, sum(n - k) w, sum(sq - bad * bad / n) ssb, sum(bad - sq) ssw, sum(n - nn / n) size FROM {name}_parts),
{name}_rho AS (SELECT b, w, ssb / nullif(b, 0) msb, ssw / nullif(w, 0) msw, size / nullif(b, 0) n0 FROM {name}_sums),
{name} AS (SELECT CASE WHEN coalesce(b, 0) = 0 OR coalesce(w, 0) = 0 THEN {LEAST_WEIGHT} WHEN msb + (n0 - 1) * msw <= 0 OR msb <= msw THEN {MOST_WEIGHT}
  ELSE least(greatest((msb + (n0 - 1) * msw) / (msb - msw) - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) END AS w FROM {name}_rho)"""  # noqa: E731
    return f"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
said AS (SELECT *, {case(1)} AS rule, {case(0)} AS said FROM parts),
bare AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM said),
hosts AS (SELECT host, CASE WHEN regexp_matches(any_value(bare), '{NUMBERS}') THEN any_value(bare) ELSE regexp_extract(any_value(bare), '(?:^|\\.)((?:[^.]+\\.)?{SUFFIX})$', 1) END AS domain,
  CASE WHEN regexp_matches(any_value(bare), '{NUMBERS}') THEN any_value(bare) ELSE regexp_extract(any_value(bare), '(?:^|\\.)({SUFFIX})$', 1) END AS suffix, count(said) AS n, count(*) FILTER (said = 'block') AS bad FROM bare GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad)::DOUBLE / sum(n) ELSE 0.5 END AS rate FROM suffixes),
{weight("ws", "suffixes", "HAVING count(*) > 0")},
{weight("wd", "domains", "GROUP BY suffix")},
{weight("wh", "hosts", "GROUP BY suffix, domain")},
rs AS (SELECT suffix, (bad + ws.w * top.rate) / (n + ws.w) AS r FROM suffixes, ws, top),
rd AS (SELECT domain, suffix, (bad + wd.w * r) / (n + wd.w) AS r FROM domains JOIN rs USING (suffix), wd),
rh AS (SELECT host, n + wh.w AS a, (bad + wh.w * r) / (n + wh.w) AS r FROM hosts JOIN rd USING (suffix, domain), wh),
bounds AS (SELECT host, r - {DEVIATIONS} * sqrt(r * (1 - r) / (a + 1)) AS bound FROM rh)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bound >= {BLOCK_FROM} THEN 'block' ELSE 'allow' END) AS verdict
FROM said JOIN bounds USING (host)"""
