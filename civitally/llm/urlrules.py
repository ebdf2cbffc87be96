"""URL rules by a sort-merge range join of keys and prefix intervals.

A rule is ``host/path`` with a verdict; it fits its host and all subdomains where
the url's path starts with the rule's path. The longest fitting rule wins (then
the one with the longer host, then block). Its canonical key is the reversed host
followed by the path, and all keys that it covers lie in the interval from the key
to the key with a byte above all UTF-8. A rule also covers subdomains, so a url
gives one key for each of its host's endings, as many labels as a rule has at most.

Keys, interval starts and interval ends are sorted together and swept once. Rules
of one host are nested or apart, so the active ones form a stack: a running sum of
starts and ends is its height, and the slot at that height holds the start that was
put there last. The sweep is dealt by reversed host; a host with many urls is dealt
over ``rows / hot_rows`` salts, to each of which its rules are copied.

Built-in expressions only. A null url, or one without ``://``, has an empty host and
path and fits no rule. Repeated rows and rows without page_id are judged like others,
an empty table gives an empty table, other columns take no part. Urls that fit no
rule get ``default``. Rules with a null or no host are left out; of equal rules with
different verdicts block wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civitally.config import Skew
from civitally.operators.ranking import hot_keys
from civitally.session import settle

# The rules of the registered query.
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path) of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def rule_keys(rules: DataFrame) -> DataFrame:
    """verdict, rule, labels, key (reversed host), path of each usable rule."""
    host = F.translate(F.regexp_extract("rule", r"^[^/]*", 0), UPPER, LOWER)
    return rules.filter(host != "").select(
        "verdict", "rule", F.size(F.split(host, r"\.")).alias("labels"),
        reversed_host(F.split(host, r"\.")).alias("key"),
        F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("path"),
    )


def url_keys(urls: DataFrame, most_labels: Column) -> DataFrame:
    """row, key, path: one key for each ending of the host, up to ``most_labels``."""
    labels = F.split("host", r"\.")
    endings = F.sequence(F.lit(1), F.least(F.size(labels), most_labels))
    return urls.filter((F.col("host") != "") & (most_labels > 0)).select(
        "row", "path", labels.alias("all"), F.explode(endings).alias("n")
    ).select("row", "path", reversed_host(F.slice("all", -F.col("n"), F.col("n"))).alias("key"))


def sweep(points: DataFrame, rules: DataFrame, skew: Skew) -> DataFrame:
    """row, verdict, rule, key of the innermost active rule at each point that has one."""
    hot = hot_keys(points, ["key"], skew)
    salted = points.join(hot, "key", "left").select(
        "key", F.coalesce(F.pmod(F.xxhash64("row"), F.col("_splits")), F.lit(0)).alias("salt"),
        F.encode("path", "utf-8").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("step"),
        "row", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"),
    )
    copied = rules.join(hot, "key", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1))
    )
    at, end = F.encode("path", "utf-8"), F.unhex(F.lit("FF"))
    edges = F.array(
        F.struct(at.alias("at"), F.lit(1).alias("step")),
        F.struct(F.concat(at, end).alias("at"), F.lit(-1).alias("step")),
    )
    events = copied.withColumn("edge", F.explode(edges)).select(
        "key", F.col("salt").cast("bigint"), F.col("edge.at").alias("at"), F.lit(0).alias("kind"),
        F.col("edge.step").alias("step"), F.lit(None).cast("bigint").alias("row"), "verdict", "rule",
    )
    order = [F.col("at"), F.col("kind"), F.col("verdict"), F.col("rule")]
    sofar = Window.partitionBy("key", "salt").orderBy(*order)
    slot = Window.partitionBy("key", "salt", "height").orderBy(*order)
    started = F.when(F.col("step") == 1, F.struct("verdict", "rule"))
    swept = (
        salted.unionByName(events)
        .withColumn("height", F.sum("step").over(
            sofar.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("top", F.last(started, ignorenulls=True).over(
            slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    return swept.filter((F.col("kind") == 1) & (F.col("height") > 0)).select(
        "row", "top.verdict", "top.rule", "key"
    )


def judge(
    pages: DataFrame, rules: DataFrame, default: str = DEFAULT, skew: Skew = Skew()
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = url_parts(F.col("url").cast("string"))
    urls = settle(pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"),
        F.monotonically_increasing_id().alias("row"),
    ), "urls")
    keyed = rule_keys(rules)
    most = F.coalesce(keyed.agg(F.max("labels")).scalar(), F.lit(0))
    found = sweep(url_keys(urls, most), keyed, skew)
    best = found.groupBy("row").agg(F.max(F.struct(
        F.length("rule").alias("longest"), F.length("key").alias("host_length"),
        (F.col("verdict") == "block").alias("block"), "verdict", "rule",
    )).alias("best"))
    return urls.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT rid, max_by(rhost || rpath, len(rhost || rpath)) AS rule, max_by(verdict, len(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (rid)
"""
