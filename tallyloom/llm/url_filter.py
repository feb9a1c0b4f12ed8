"""URL filter: fixed rules first, else empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Second-level public suffixes below country codes that the suffix level tells apart.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")
#: A host is blocked when even the lower bound of its bad-page rate is above LIMIT.
Z, LIMIT = 1.645, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule whose host is the host or a parent of it and whose path begins the path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def domain_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    n = F.size(parts)
    second = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL)
    return F.when(second, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.expr("substring({0}, instr({0}, '.') + 1)".format("domain"))).otherwise(domain)


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, rate, low): posterior mean and lower bound of each host's rate of bad pages.

    Outcomes (page_id, bad 0/1) shrink through beta-binomial priors: a suffix to the mean of all pages, a
    registered domain to its suffix, a host to its domain. The priors' weight is estimated from the spread
    of host rates (method of moments). Counts are sums with map-side combine: a hot host is one row.
    """
    seen = pages.select("page_id", "host").where("host <> ''").join(outcomes, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    # Whole-number sums only, so that the order of addition changes nothing: rates are in millionths.
    rate = F.expr("case when n > 0 then (k * 1000000) div n end")
    total = hosts.agg(F.sum("n").alias("N"), F.sum("k").alias("K"), F.sum(F.when(F.col("n") > 0, 1)).alias("H"), F.sum(rate).alias("R"), F.sum(rate * rate).alias("RR"))
    total = total.select(
        ((F.coalesce("K", F.lit(0)) + 1) / (F.coalesce("N", F.lit(0)) + 2)).alias("base"),
        (F.col("R") / F.col("H") / 1e6).alias("m"),
        (F.col("RR") / F.col("H") / 1e12).alias("m2"),
    )
    total = total.select("base", F.coalesce(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.try_divide(F.col("m") * (1 - F.col("m")), F.col("m2") - F.col("m") * F.col("m")) - 1)), F.lit(10.0)).alias("w"))
    one = total.first()  # two numbers
    base, w = F.lit(one.base), F.lit(one.w)
    suffix = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select("suffix", w.alias("w"), ((F.col("k") + w * base) / (F.col("n") + w)).alias("p_suffix"))
    domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffix, "suffix").select("domain", "w", ((F.col("k") + F.col("w") * F.col("p_suffix")) / (F.col("n") + F.col("w"))).alias("p_domain"))
    a, b = F.col("k") + F.col("w") * F.col("p_domain"), F.col("n") - F.col("k") + F.col("w") * (1 - F.col("p_domain"))
    post = hosts.join(domain, "domain").select("host", a.alias("a"), b.alias("b"))
    mean, size = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    return post.select("host", mean.alias("rate"), (mean - Z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("low"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's bad rate and lower bound of every page.

    A page's outcome is the label of the document that its url numbers (/xx/NNN): bad if of low quality or
    toxic. Null urls and urls without :// have empty host and path, and are allowed where no rule fits, as
    are hosts never labelled. Repeated rows give repeated rows. Only page_id, url and the label columns are read.
    """
    split = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    number = F.regexp_extract("path", r"^/[a-z]+/([0-9]{1,18})", 1)
    number = F.when(number != "", number.cast("long"))
    bad = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).cast("long").alias("bad")).where("bad is not null and doc_id is not null")
    rep = reputation(split.select(number.alias("page_id"), "host"), bad.withColumnRenamed("doc_id", "page_id"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return split.withColumn("rule", name).withColumn("ruled", verdict).join(rep, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("low") > LIMIT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "rate", "low")


ORACLE_SQL = r"""
with split as (
  select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
bad as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is not null or toxic is not null then 0 end) as bad from labels group by doc_id),
seen as (select host, bad from split left join (select * from bad where bad is not null) b on try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})', 1), '') as bigint) = b.doc_id where host <> ''),
counted as (select host, count(bad) as n, coalesce(sum(bad), 0) as k, string_split(host, '.') as parts from seen group by host),
domains as (select *, case when len(parts) > 2 and length(parts[-1]) = 2 and parts[-2] in ('co', 'com', 'org', 'net', 'ac', 'gov', 'edu') then array_to_string(parts[-3:], '.') when len(parts) > 1 then array_to_string(parts[-2:], '.') else host end as domain from counted),
hosts as (select *, case when instr(domain, '.') > 0 then substr(domain, instr(domain, '.') + 1) else domain end as suffix, case when n > 0 then (k * 1000000) // n end as rate from domains),
sums as (select (coalesce(sum(k), 0) + 1)::double / (coalesce(sum(n), 0) + 2)::double as base, sum(rate)::double / count(rate) / 1e6 as m, sum(rate * rate)::double / count(rate) / 1e12 as m2 from hosts),
total as (select base, coalesce(least(1000.0, greatest(1.0, case when m2 - m * m <> 0 then m * (1 - m) / (m2 - m * m) end - 1)), 10.0)::double as w from sums),
s as (select suffix, w, (sum(k)::double + w * base) / (sum(n)::double + w) as p from hosts, total group by suffix, w, base),
d as (select domain, s.w, (sum(k)::double + s.w * s.p) / (sum(n)::double + s.w) as p from hosts join s using (suffix) group by domain, s.w, s.p),
post as (select host, hosts.k::double + d.w * d.p as a, (hosts.n - hosts.k)::double + d.w * (1 - d.p) as b from hosts join d using (domain)),
rep as (select host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as low from post),
ruled as (select *, case
  when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule from split)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' when low > 0.5 then 'block' else 'allow' end as verdict
from ruled left join rep using (host)
"""
