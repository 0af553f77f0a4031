"""URL filter: rules first, then an empirical-Bayes host reputation; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: Fixed values: (verdict, rule host, rule path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(url):
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = ascii_lower(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _rate(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """One level of (key, parent, n, bad) with the beta prior strength kappa by moments around the level's mean."""
    of = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).alias(name)  # noqa: E731  of no rows, 0
    total = rows.agg(of("n", "N"), of("bad", "B"), F.count("*").alias("K"), of(F.col("n") * F.col("n"), "n2"), of(F.col("bad") * F.col("bad") / F.col("n"), "bp"))
    m = (F.col("B") + 1.0) / (F.col("N") + 2.0)
    spread = F.col("bp") - 2 * m * F.col("B") + m * m * F.col("N") - m * (1 - m) * (F.col("K") - 1)
    room = m * (1 - m) * F.greatest(F.coalesce(F.col("N") - F.try_divide("n2", "N"), F.lit(0.0)) - (F.col("K") - 1), F.lit(1.0))
    rho = F.least(F.greatest(F.coalesce(spread / room, F.lit(0.1)), F.lit(0.01)), F.lit(0.5))
    return total.select(m.alias("m0"), (1 / rho - 1).alias("kappa"))


def host_parts(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without user, port and final dot.

    The suffix is the last label, or the last two where a country's has a general one before it (as co.uk); the domain has one
    label more. An address in numbers is its own domain, under the suffix `address`; a host of one label is its own domain.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?$", "")
    name = F.rtrim(name, F.lit("."))
    two = name.rlike(r"(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{2}$")
    address = name.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") | name.startswith("[")
    suffix = F.when(address, "address").when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return domain, suffix


def reputation(hosts: DataFrame, z: float = 1.64) -> DataFrame:
    """(host, n, bad) per host -> host, posterior mean and the lower bound of its bad rate.

    Hosts are shrunk towards their registered domain, domains towards their suffix (see host_parts), suffixes
    towards the overall rate, each by a beta-binomial prior whose strength is estimated
    from that level's spread. The number of labelled hosts may be zero; then all means are the prior 1/2.
    """
    name, labels = host_parts(F.col("host"))
    hosts = hosts.select("host", "n", "bad", name.alias("domain"), labels.alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrink(rows, stats, mean, out):
        k = F.col("kappa")
        return rows.crossJoin(F.broadcast(stats)).withColumn(out, (F.col("bad") + k * mean) / (F.col("n") + k))  # stats: one row

    s = shrink(suffixes, _rate(suffixes.where("n > 0"), "suffix", ""), F.col("m0"), "ms").select("suffix", "ms")
    d = shrink(domains.join(s, "suffix"), _rate(domains.where("n > 0"), "domain", "suffix"), F.col("ms"), "md").select("domain", "md")
    h = shrink(hosts.join(d, "domain"), _rate(hosts.where("n > 0"), "host", "domain"), F.col("md"), "mean")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("kappa") + 1))
    return h.select("host", "mean", (F.col("mean") - z * sd).alias("bound"))


def url_filter(pages: DataFrame, outcomes: DataFrame, worst: float = 0.5) -> DataFrame:
    """Verdict for (page_id, url) with outcomes (page_id, bad 0/1) of some pages.

    The longest fitting rule decides; else a page is blocked iff the lower posterior bound of its host's bad rate is
    over `worst`. A null url or one without :// has an empty host and path and fits no rule. Repeated
    rows each get their verdict; repeated outcomes of a page count once, as the worst. Empty tables work.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcomes = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = (
        rows.join(outcomes, "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    blocked = cut(reputation(cut(counts)).where(F.col("bound") > worst).select("host", F.lit(True).alias("bad_host")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):  # a longer rule is set later
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rows.withColumns({"rule": rule, "v": verdict}).join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("v", F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: `labels.quality` = 0 is bad; its doc_id is read as the page_id."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_filter(table(spark, sf_dir, "pages", "page_id", "url"), labels)


def _level(name: str, rows: str) -> str:
    """The SQL of _rate() over `rows` (n, bad): one row of m0 and kappa."""
    return f"""{name}_t as (select coalesce(sum(n), 0) as nn, coalesce(sum(bad), 0) as bb, count(*) as kk, coalesce(sum(n * n), 0) as n2, coalesce(sum(cast(bad * bad as double) / n), 0) as bp from {rows} where n > 0),
{name}_m as (select *, (bb + 1.0::double) / (nn + 2.0::double) as m0 from {name}_t),
{name}_k as (select m0, 1 / least(greatest(coalesce((bp - 2 * m0 * bb + m0 * m0 * nn - m0 * (1 - m0) * (kk - 1)) / (m0 * (1 - m0) * greatest(coalesce(nn - cast(n2 as double) / nullif(nn, 0), 0) - (kk - 1), 1.0::double)), 0.1::double), 0.01::double), 0.5::double) - 1 as kappa from {name}_m)"""


def _rule_sql(value: str) -> str:
    """The longest fitting rule first."""
    arms = []
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])):
        fits = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
        arms.append(f"when {fits} then '{host + path if value == 'rule' else verdict}'")
    return "case " + " ".join(arms) + " end"


SQL = rf"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
pg as (select page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
oc as (select doc_id as page_id, max(1 - quality) as bad from labels where doc_id is not null and quality is not null group by doc_id),
hc as (select host, count(bad) as n, coalesce(sum(bad), 0) as bad, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?$', ''), '.') as name from pg left join oc using (page_id) group by host),
hp as (select *, string_split(name, '.') as l, regexp_matches(name, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') or starts_with(name, '[') as address, case when regexp_matches(name, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{{2}}$') then 2 else 1 end as k from hc),
hs as (select host, n, bad, case when address then name else array_to_string(l[-(k + 1):], '.') end as domain, case when address then 'address' else array_to_string(l[-k:], '.') end as suffix from hp),
ds as (select domain, suffix, sum(n) as n, sum(bad) as bad from hs group by domain, suffix),
ss as (select suffix, sum(n) as n, sum(bad) as bad from ds group by suffix),
{_level('s', 'ss')}, {_level('d', 'ds')}, {_level('h', 'hs')},
sm as (select suffix, (bad + kappa * m0) / (n + kappa) as ms from ss, s_k), dm as (select domain, (bad + kappa * ms) / (n + kappa) as md from ds join sm using (suffix), d_k),
hm as (select host, n, kappa, (bad + kappa * md) / (n + kappa) as mean from hs join dm using (domain), h_k),
bl as (select host from hm where mean - 1.64::double * sqrt(mean * (1 - mean) / (n + kappa + 1)) > 0.5)
select page_id, host, path, {_rule_sql('rule')} as rule, coalesce({_rule_sql('verdict')}, case when host in (select host from bl) then 'block' else 'allow' end) as verdict from pg"""
