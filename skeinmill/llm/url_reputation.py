"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, registered domain and
public suffix. Each level's beta-binomial prior is centred on the posterior mean
of the level above it (suffix on the global rate, domain on its suffix, host on
its domain) with a strength estimated by moments from that level's own groups.
A page is blocked when the lower posterior bound of its host's bad rate exceeds
``max_bad_rate``: sparse hosts fall back on their domain and are not blocked on
a few bad pages. Explicit allow and block rules come before the method.

Everything is DataFrame expressions; pages are aggregated to hosts before any
join, and the only row gathered on the driver holds four sums per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.runtime import settle, table

#: (host, path, verdict); fixed values of the task.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Public suffixes of two labels; every other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_rule(rules) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits host and path, or null. ``rules`` is configuration, a bounded list."""
    fits = [
        F.when(
            ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    if not fits:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def _domain_columns(hosts: DataFrame, suffixes) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    n = F.size("labels")
    tail = lambda k: F.array_join(F.slice("labels", F.greatest(F.lit(1), n - k + 1), F.lit(k)), ".")
    numeric = F.col("bare").rlike(r"^[0-9.]+$|^\[")
    two = tail(2).isin(*suffixes) if suffixes else F.lit(False)
    return (
        hosts.withColumn("bare", bare)
        .withColumn("labels", labels)
        .withColumn("suffix", F.when(numeric, F.col("bare")).when(two, tail(2)).otherwise(tail(1)))
        .withColumn("domain", F.when(numeric, F.col("bare")).when(two, tail(3)).otherwise(tail(2)))
        .drop("bare", "labels")
    )


def _strength(groups: DataFrame, n: str, k: str, least: float, most: float) -> float:
    """Prior strength by moments of the beta-binomial over groups with counts n and bad outcomes k."""
    sums = groups.where(F.col(n) > 0).agg(
        F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(k) * F.col(k) / F.col(n)).alias("kk")
    )
    r = sums.collect()[0]
    if not r["g"] or r["g"] < 2 or not 0 < r["k"] < r["n"]:
        return most
    p = r["k"] / r["n"]
    spread = r["kk"] - r["k"] * r["k"] / r["n"]
    scale = r["n"] - r["nn"] / r["n"]
    rho = (spread - p * (1 - p) * (r["g"] - 1)) / (p * (1 - p) * (scale - (r["g"] - 1))) if scale > r["g"] - 1 else 0.0
    return most if rho <= 0 else min(most, max(least, 1 / rho - 1))


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes=SUFFIXES, z: float = 1.645, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """One row per host of ``pages`` (host, page_id): n, k, posterior mean, lower and upper bound of the bad rate.

    ``outcomes`` has page_id and bad (0 or 1; null is no outcome); repeated outcomes of a page count once, as bad if any is.
    """
    known = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = pages.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n_h"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k_h"))
    hosts = settle(_domain_columns(hosts, suffixes), "host-counts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n_h").alias("n_d"), F.sum("k_h").alias("k_d"))
    tops = domains.groupBy("suffix").agg(F.sum("n_d").alias("n_s"), F.sum("k_d").alias("k_s"))
    s_h, s_d, s_s = (_strength(t, n, k, least, most) for t, n, k in ((hosts, "n_h", "k_h"), (domains, "n_d", "k_d"), (tops, "n_s", "k_s")))
    total = tops.agg(F.coalesce(F.sum("n_s"), F.lit(0)).alias("n"), F.coalesce(F.sum("k_s"), F.lit(0)).alias("k")).collect()[0]
    global_rate = (total["k"] + 1) / (total["n"] + 2)
    tops = tops.select("suffix", ((F.col("k_s") + s_s * global_rate) / (F.col("n_s") + s_s)).alias("m_s"))
    domains = domains.join(tops, "suffix").select("domain", "suffix", ((F.col("k_d") + s_d * F.col("m_s")) / (F.col("n_d") + s_d)).alias("m_d"))
    mean = (F.col("k_h") + s_h * F.col("m_d")) / (F.col("n_h") + s_h)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n_h") + s_h + 1))
    return (
        hosts.join(domains, ["domain", "suffix"])
        .withColumn("mean", mean)
        .select("host", "domain", "suffix", F.col("n_h").alias("n_labelled"), F.col("k_h").alias("n_bad"), "mean", (F.col("mean") - z * sd).alias("lower"), (F.col("mean") + z * sd).alias("upper"))
    )


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad_rate: float = 0.5, id_col: str = "page_id", url_col: str = "url", suffixes=SUFFIXES, z: float = 1.645
) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict (allow or block), bad_rate, bad_rate_lower.

    A null url, or one without ``://``, has an empty host and path, no rule, and
    the reputation of the empty host. Ids may be null or repeat: every row is
    judged by itself. Without outcomes every page outside a block rule is
    allowed. An empty table gives an empty result; other columns are ignored.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scores = host_reputation(parsed, outcomes, suffixes, z).select("host", F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_lower"))
    best = F.col("best")
    return (
        parsed.withColumn("best", _longest_rule(rules))
        .join(scores, "host", "left")
        .select(
            "page_id", "host", "path", best["rule"].alias("rule"),
            F.coalesce(best["verdict"], F.when(F.col("bad_rate_lower") > max_bad_rate, "block").otherwise("allow")).alias("verdict"),
            "bad_rate", "bad_rate_lower",
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels whose doc_id is the page's id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(F.when(F.col("quality").isNotNull(), (F.col("quality") == 0).cast("int")), F.when(F.col("toxic").isNotNull(), (F.col("toxic") == 1).cast("int")))
    return filter_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))).select("page_id", "host", "path", "rule", "verdict")


_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)
_STRENGTH = """CASE WHEN count(*) < 2 OR sum(k) <= 0 OR sum(k) >= sum(n) OR sum(n) - sum(n * n) / sum(n) <= count(*) - 1
  OR sum(k * k / n) - sum(k) * sum(k) / sum(n) <= (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * (count(*) - 1) THEN 1000.0
  ELSE least(1000.0, greatest(1.0, ((sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)))
    / (sum(k * k / n) - sum(k) * sum(k) / sum(n) - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * (count(*) - 1)) - 1)) END"""
ORACLE = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), o AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1
), h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM u LEFT JOIN o USING (page_id) GROUP BY 1),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h0),
h2 AS (SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^[0-9.]+$|^\[') AS ip FROM h1),
h3 AS (SELECT *, array_to_string(l[-2:], '.') IN ({_TWO}) AS two FROM h2),
h AS (SELECT host, n, k, CASE WHEN ip THEN bare WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
  CASE WHEN ip THEN bare WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM h3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
st AS (SELECT (SELECT {_STRENGTH} FROM h WHERE n > 0) AS sh, (SELECT {_STRENGTH} FROM d WHERE n > 0) AS sd, (SELECT {_STRENGTH} FROM s WHERE n > 0) AS ss,
  (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s) AS g),
ms AS (SELECT suffix, (k + ss * g) / (n + ss) AS m FROM s, st),
md AS (SELECT domain, suffix, (d.k + sd * ms.m) / (d.n + sd) AS m FROM d JOIN ms USING (suffix), st),
mh AS (SELECT host, h.n + sh AS w, (h.k + sh * md.m) / (h.n + sh) AS m FROM h JOIN md USING (domain, suffix), st),
r(rh, rp, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
b AS (SELECT u.page_id, u.host, u.path, max(struct_pack(n := length(rh) + length(rp), rule := rh || rp, v := v)) AS best
  FROM u LEFT JOIN r ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp) GROUP BY ALL)
SELECT page_id, b.host, path, best.rule AS rule,
  CASE WHEN best.rule IS NOT NULL THEN best.v WHEN m - 1.645 * sqrt(m * (1 - m) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM b LEFT JOIN mh USING (host)
"""
