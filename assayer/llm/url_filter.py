"""URL rules by a sort-merge range join over reversed-host keys.

The key of a URL or rule is its host label by label from the right, then its path:
``net.example./en/``.  A rule is the interval of all keys that begin with its own.
URLs and rules are sorted together; a sweep down the order keeps a stack of the rules that
are open, one slot for each nesting depth, and what of the stack still covers a URL is exactly
the set of its rules.  The order is cut into ranges that are swept at once; the slots left open at
the end of the earlier ranges are handed to each (one row per range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", labels), F.lit("."), path)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def nested_rules(rules: DataFrame) -> DataFrame:
    """(key, rule, verdict, depth): one row per key; depth counts the other rules that enclose it.

    Of rules with one host and path that disagree, ``block`` holds.
    """
    keyed = rules.withColumn("key", _key(_labels(F.col("host")), F.col("path"))).groupBy("key").agg(
        F.min(F.concat("host", "path")).alias("rule"), F.max("verdict").alias("verdict"))
    keyed = stored(keyed)
    prefixes = keyed.where("length(key) > 1").select("key", F.explode(F.expr("sequence(1, length(key) - 1)")).alias("n"))
    prefixes = prefixes.select(F.col("key").alias("inner"), F.expr("left(key, n)").alias("key"))
    depths = prefixes.join(keyed.select("key"), "key").groupBy("inner").count()
    return stored(keyed.join(depths, keyed["key"] == depths["inner"], "left").select(
        "key", "rule", "verdict", F.coalesce(F.col("count"), F.lit(0)).cast("int").alias("depth")))


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """For every different ``key`` of ``points``: the rules that enclose it, outermost first, as ``stack``.

    Within one depth no rule encloses another, so of the rules of a depth only the last
    one before a key can be open there: that is the slot.
    """
    spark = points.sparkSession
    deepest = rules.agg(F.max("depth")).first()[0]
    opened = F.struct("key", "rule", "verdict")
    events = rules.select("key", F.lit(0).alias("kind"), "depth", opened.alias("opened")).unionByName(
        points.select("key").distinct().select("key", F.lit(1).alias("kind")), allowMissingColumns=True)
    events = events.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "kind")
    events = stored(events.withColumn("range", F.spark_partition_id()))
    depths = range(0 if deepest is None else deepest + 1)
    slots = [F.when(F.col("depth") == d, F.col("opened")) for d in depths]
    ends = events.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *[F.max(s).alias(f"last{d}") for d, s in enumerate(slots)])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = stored(ends.select("range", *[F.max(f"last{d}").over(earlier).alias(f"carried{d}") for d in depths]))
    so_far = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select("*", *[F.last(s, ignorenulls=True).over(so_far).alias(f"slot{d}") for d, s in enumerate(slots)])
    stack = [F.coalesce(f"slot{d}", f"carried{d}") for d in depths]
    none = F.array().cast("array<struct<key:string,rule:string,verdict:string>>")
    return swept.join(carried, "range").where("kind = 1").select(
        "key", F.array(*stack).alias("slots") if stack else none.alias("slots")).select(
        "key", F.expr("filter(slots, s -> s IS NOT NULL AND startswith(key, s.key))").alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` has ``host``, ``path`` and ``verdict``; a rule fits its host and all
    subdomains if the URL's path starts with the rule's.  The longest rule wins (of equally
    long ones that with the longer host); without a rule the verdict is ``default`` and the rule NULL.  NULL URLs and those without
    ``://`` have an empty host and path and no rule.  Other columns are ignored.
    """
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    pairs = urls.where("host <> ''").select("host", "path").distinct()
    labels = _labels(F.col("host"))
    keys = pairs.withColumn("n", F.explode(F.sequence(F.lit(1), F.size(labels)))).select(
        "host", "path", _key(F.slice(labels, F.lit(1), F.col("n")), F.col("path")).alias("key"))
    keys = stored(keys)
    found = stored(sweep(keys, nested_rules(rules)).where("size(stack) > 0").select(
        "key", F.element_at("stack", -1).alias("best")))
    chosen = stored(keys.join(found, "key").groupBy("host", "path").agg(F.max(F.struct(
        F.length("best.rule").alias("n"), F.length("best.key").alias("m"), F.col("best.rule").alias("rule"),
        F.col("best.verdict").alias("verdict"))).alias("best")).select(
        F.col("host").alias("__host"), F.col("path").alias("__path"), "best.rule", "best.verdict"))
    same = (urls["host"] == chosen["__host"]) & (urls["path"] == chosen["__path"])
    return urls.join(chosen, same, "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
