"""URL filter with empirical-Bayes host reputation.

Every page outcome that carries a label counts for its host. The share of good
pages is shrunk through beta-binomial priors along host -> registered domain ->
suffix -> all pages; the strength of each prior is estimated from the data by
the method of moments (Kleinman's estimator). A page whose url fits an explicit
rule takes the rule's verdict; any other page is blocked if the upper posterior
bound of its host's share of good pages lies below ``min_good``.

Everything is DataFrame expressions: two narrow scans, one join of ids, partial
aggregation by host (a hot host is summed map-side), and a join of the host
table, which adaptive execution splits where one host dominates.

Defined cases: null url or no ``://`` gives empty host and path, which form a
host of their own; labels with a null quality or toxic flag count as unlabelled;
several labels of one page count once, by the worst; repeated pages count each;
no labels at all gives the uniform prior, so nothing is blocked by reputation;
equal-length rules that fit together resolve to the alphabetically first. Only
the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Second-level labels under which a country suffix registers domains.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_GOOD, Z = 0.5, 1.645


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.regexp_replace(rest, "^[^/?#]*", "")
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, "^[^?#]*", 0)


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    df = df.withColumn("__u", F.col(url_col))
    host, path = url_parts(F.col("__u"))
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))}).drop("__u")


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null if none fits."""
    rule = action = F.lit(None).cast("string")
    for act, r in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, action = F.when(fits, r).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def host_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the last label, or the last two below a country code."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.when(n >= 2, F.element_at(labels, -2))
    two = (n >= 3) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    suffix = F.when(two, F.concat_ws(".", second, last)).otherwise(last)
    domain = F.when(two, F.concat_ws(".", F.element_at(labels, -3), suffix)).when(n >= 2, F.concat_ws(".", second, last)).otherwise(host)
    return domain, suffix


def _strength(groups: DataFrame) -> DataFrame:
    """Prior strength from the spread of shares over the groups, one row; groups has n, g."""
    tot = groups.agg(F.sum("n").alias("N"), F.sum("g").alias("G"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum(F.col("g") * F.col("g") / F.col("n")).alias("Q"))
    p = F.col("G") / F.col("N")
    spread = F.col("Q") - F.col("G") * F.col("G") / F.col("N")
    rho = (spread / (p * (1 - p)) - (F.col("k") - 1)) / (F.col("N") - F.col("N2") / F.col("N") - (F.col("k") - 1))
    ok = (F.col("k") > 1) & (F.col("G") > 0) & (F.col("G") < F.col("N")) & (F.col("N") - F.col("N2") / F.col("N") > F.col("k") - 1)
    rho = F.when(ok, F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.5))).otherwise(F.lit(0.01))
    return tot.select((1 / rho - 1).alias("kappa"))


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, posterior_mean, upper_bound) for all hosts of outcomes(host, good).

    good is 1, 0 or null (unlabelled). Posterior of a host: Beta(kappa * m + g,
    kappa * (1 - m) + n - g), m the posterior mean of its domain, and so on up.
    """
    domain, suffix = host_levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("g")).withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("g").alias("dg"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dg").alias("sg"))
    kappa = {
        "h": _strength(hosts.filter("n > 0").select("n", "g")).scalar(),
        "d": _strength(domains.filter("dn > 0").select(F.col("dn").alias("n"), F.col("dg").alias("g"))).scalar(),
        "s": _strength(suffixes.filter("sn > 0").select(F.col("sn").alias("n"), F.col("sg").alias("g"))).scalar(),
    }
    m0 = suffixes.agg(((F.coalesce(F.sum("sg"), F.lit(0)) + 1) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2)).alias("m")).scalar()
    s = suffixes.withColumn("sm", (F.col("sg") + kappa["s"] * m0) / (F.col("sn") + kappa["s"])).select("suffix", "sm")
    d = domains.join(s, "suffix").withColumn("dm", (F.col("dg") + kappa["d"] * F.col("sm")) / (F.col("dn") + kappa["d"])).select("domain", "dm")
    h = hosts.join(d, "domain").withColumn("total", F.col("n") + kappa["h"])
    mean = (F.col("g") + (F.col("total") - F.col("n")) * F.col("dm")) / F.col("total")
    return h.withColumn("posterior_mean", mean).select("host", "n", "posterior_mean", (F.col("posterior_mean") + z * F.sqrt(F.col("posterior_mean") * (1 - F.col("posterior_mean")) / (F.col("total") + 1))).alias("upper_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, min_good: float = MIN_GOOD, z: float = Z) -> DataFrame:
    """Verdict of every page(page_id, url), given outcomes(page_id, good)."""
    parts = with_parts(pages.select("page_id", "url"), "url").select("page_id", "host", "path")
    seen = outcomes.filter(F.col("good").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min("good").alias("good"))
    rep = host_reputation(parts.join(seen, "page_id", "left").select("host", "good"), z)
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("upper_bound") < min_good, "block").otherwise("allow"))
    return parts.join(rep, "host").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("n").alias("host_labelled"), F.round("posterior_mean", 4).alias("posterior_mean"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Page outcomes from labels(doc_id, quality, toxic): good if of quality and not toxic.

    The tables hold no labels of pages, so the label of number i stands for the
    outcome of page i: it has the volume, gaps and null flags of real outcomes, but
    says nothing true about the page. filter_urls() itself takes any outcomes.
    """
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))


def _sql_rules(rules=RULES) -> tuple[str, str]:
    rule, action = "NULL", "NULL"
    for act, r in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        h, _, p = r.partition("/")
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
        rule, action = f"CASE WHEN {fits} THEN '{r}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{act}' ELSE {action} END"
    return rule, action


def oracle() -> str:
    rule, action = _sql_rules()
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)

    def kappa(name: str, src: str, n: str, g: str) -> str:
        return f"""{name} AS (SELECT 1 / rho - 1 AS k FROM (SELECT CASE WHEN k > 1 AND G > 0 AND G < N AND N - N2 / N > k - 1
  THEN least(greatest(((Q - G * G / N) / ((G / N) * (1 - G / N)) - (k - 1)) / (N - N2 / N - (k - 1)), 0.001::DOUBLE), 0.5::DOUBLE) ELSE 0.01::DOUBLE END AS rho
  FROM (SELECT sum({n})::DOUBLE AS N, sum({g})::DOUBLE AS G, count(*)::DOUBLE AS k, sum({n} * {n})::DOUBLE AS N2, sum({g} * {g} / {n}::DOUBLE) AS Q FROM {src} WHERE {n} > 0)))"""

    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hp AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h0, regexp_extract(substring(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
parts AS (SELECT page_id, translate(h0, '{UPPER}', '{LOWER}') AS host, path FROM hp),
seen AS (SELECT doc_id AS page_id, min((quality = 1 AND toxic = 0)::INT) AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
hosts0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::BIGINT AS g, string_split(host, '.') AS l FROM parts LEFT JOIN seen USING (page_id) GROUP BY host),
hosts1 AS (SELECT *, len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({second}) AS two FROM hosts0),
hosts AS (SELECT host, n, g, CASE WHEN two THEN concat(l[-2], '.', l[-1]) ELSE l[-1] END AS suffix,
  CASE WHEN two THEN concat(l[-3], '.', l[-2], '.', l[-1]) WHEN len(l) >= 2 THEN concat(l[-2], '.', l[-1]) ELSE host END AS domain FROM hosts1),
domains AS (SELECT domain, suffix, sum(n) AS dn, sum(g) AS dg FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(dn) AS sn, sum(dg) AS sg FROM domains GROUP BY 1),
{kappa("kh", "hosts", "n", "g")},
{kappa("kd", "domains", "dn", "dg")},
{kappa("ks", "suffixes", "sn", "sg")},
m0 AS (SELECT (coalesce(sum(sg), 0) + 1)::DOUBLE / (coalesce(sum(sn), 0) + 2) AS m FROM suffixes),
s AS (SELECT suffix, (sg + (SELECT k FROM ks) * (SELECT m FROM m0)) / (sn + (SELECT k FROM ks)) AS sm FROM suffixes),
d AS (SELECT domain, (dg + (SELECT k FROM kd) * sm) / (dn + (SELECT k FROM kd)) AS dm FROM domains JOIN s USING (suffix)),
h AS (SELECT host, n, (g + (SELECT k FROM kh) * dm) / (n + (SELECT k FROM kh)) AS mean, n + (SELECT k FROM kh) AS total FROM hosts JOIN d USING (domain))
SELECT page_id, host, path, {rule} AS rule,
  coalesce({action}, CASE WHEN mean + {Z} * sqrt(mean * (1 - mean) / (total + 1)) < {MIN_GOOD} THEN 'block' ELSE 'allow' END) AS verdict,
  n AS host_labelled, round(mean, 4) AS posterior_mean
FROM parts JOIN h USING (host)"""
