"""URL rules as nested intervals of sorted keys, in built-in functions only.

A rule (host, path) covers the keys that begin with its reversed host labels followed by its path, an interval of the
sorted keys. Rules with the same number of labels nest by path; a URL has one key for each such number, of its last
labels and its whole path. In the sweep over sorted keys, a rule's start makes it the active one and its end brings
back the rule around it, which is the top of the stack of open rules; the last such event before a URL's key is
its innermost rule. URLs are dealt by top-level label and salt, and a label's rule events go to each of its salts, of
which there are so few that rule events stay below a quarter of the URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import ascii_lower, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
#: URLs that one salt of a top-level label holds on average at least.
SALT_ROWS = 2_000
#: A byte that no UTF-8 text has: after a rule's prefix it sorts behind every key that the prefix covers. Keys are compared as bytes.
_END = b"\xff"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_events(rules: DataFrame) -> DataFrame:
    """(top, depth, key, kind, active): each rule's start (kind 0) and end (kind 2); active is (rule, verdict) from there on.

    Of rules with the same host and path a blocking one counts; a rule with a null in it or an empty host covers nothing.
    """
    r = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").where("host <> '' and path is not null and verdict is not null")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.withColumn("rule", F.struct(F.concat("host", "path").alias("rule"), "verdict"))
    # the rule around a rule: the longest of its path's proper prefixes that is a rule of the same host
    shorter = r.where("path <> ''").select("host", "path", F.explode(F.expr("transform(sequence(0, length(path) - 1), n -> substring(path, 1, n))")).alias("outer"))
    around = shorter.join(r.select("host", F.col("path").alias("outer"), F.col("rule").alias("out")), ["host", "outer"]).groupBy("host", "path").agg(F.max_by("out", F.length("outer")).alias("around"))
    r = r.join(around, ["host", "path"], "left")
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    start = F.struct(F.lit(0).alias("kind"), F.lit(b"").alias("tail"), F.col("rule").alias("active"))
    end = F.struct(F.lit(2).alias("kind"), F.lit(_END).alias("tail"), F.coalesce("around", none).alias("active"))
    e = r.select(F.substring_index("host", ".", -1).alias("top"), F.size(F.split("host", r"\.")).alias("depth"), F.concat(_reversed(F.col("host")), "path").alias("prefix"), F.explode(F.array(start, end)).alias("e"))
    return e.select("top", "depth", F.concat(F.col("prefix").cast("binary"), "e.tail").alias("key"), "e.kind", "e.active")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    A rule fits its host and the subdomains, if the path starts with the rule's; of those that fit, the one with
    the most labels wins, then the longest path. A null URL and one without ``://`` have an empty host and path and the default
    verdict. Rows that repeat are judged each; an empty table of pages or rules is fine. All columns of ``pages`` move in the one
    exchange, so pass the narrow ones.
    """
    spark = pages.sparkSession
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    events = rule_events(rules)
    depths = sorted(r[0] for r in events.select("depth").distinct().collect())  # at most the labels of a host name
    n_pages, n_rules = pages.count(), rules.count()
    salts = max(1, n_pages // max(SALT_ROWS, 8 * n_rules))
    u = pages.select(F.struct(*own).alias("_row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    u = u.withColumn("_top", F.substring_index("_host", ".", -1)).withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int")).withColumn("_kind", F.lit(1))
    for d in depths:
        u = u.withColumn(f"_key{d}", F.concat(_reversed(F.substring_index("_host", ".", -d)), "_path").cast("binary"))
    salted = events.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    e = salted.select(F.col("top").alias("_top"), "_salt", F.col("kind").alias("_kind"), *[x for d in depths for x in (F.when(F.col("depth") == d, F.col("key")).alias(f"_key{d}"), F.when(F.col("depth") == d, F.col("active")).alias(f"_active{d}"))])
    x = u.unionByName(e, allowMissingColumns=True)
    for d in depths:
        sweep = Window.partitionBy("_top", "_salt").orderBy(F.col(f"_key{d}").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn(f"_got{d}", F.last(f"_active{d}", ignorenulls=True).over(sweep))
    best = F.coalesce(*[F.when(F.col(f"_got{d}.rule").isNotNull(), F.col(f"_got{d}")) for d in reversed(depths)], F.lit(None)) if depths else F.lit(None).cast("struct<rule:string,verdict:string>")
    x = x.where("_kind = 1").withColumn("_best", best)
    return x.select(*[F.col("_row")[c].alias(c) for c in own], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT u.*, h || q AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h) DESC NULLS LAST, length(q) DESC) AS n
 FROM u LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""
