"""URL rules by a sort-merge range join, in DataFrame operations only.

A host's canonical key is its labels reversed and closed by a dot each (``www.example.com`` is
``com.example.www.``), so a rule's host with all its subdomains is one interval of keys, and the
intervals of a rule set are nested or disjoint. Rule keys and host keys are put in one global order
(range partitions, each with the last rule opened before it carried in). The rule opened last before a
host, with the rules around it, is the stack of active rules there: anything else that was opened
earlier has been closed. Of the stack, rules that do not enclose the host are popped, and of what is
left the longest rule (host first, then path) whose path starts the URL's path wins.

Hosts are swept once each, however many URLs they have, and joined back by a join that splits hot hosts.

Defined edge cases: a null URL or one without ``://`` has an empty host and path and matches no rule; an
empty rule table gives every URL the default verdict; rules that say the same host and path twice count
once (block before allow); repeated rows and null ids pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each host that has rules, its own rules and those of all hosts around it.

    An ancestor of a host is found by its key, so this is a join on equality over the rules alone.
    """
    keyed = rules.withColumn("key", host_key("host")).groupBy("key", "host", "path").agg(F.max("verdict").alias("verdict"))
    parts = F.split("key", r"\.")  # the last part is empty
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "."), F.lit(".")))
    around = keyed.select("key").distinct().select("key", F.explode(ups).alias("up"))
    one = F.struct(F.length("key").alias("host_length"), F.length("path").alias("path_length"), F.col("key").alias("rule_key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    every = keyed.select(F.col("key").alias("up"), one.alias("r"))
    return around.join(every, "up").groupBy("key").agg(F.sort_array(F.collect_list("r"), asc=False).alias("stack"))


def sweep(hosts: DataFrame, stacks: DataFrame) -> DataFrame:
    """(host, stack of active rules): ``hosts`` has one column, host, without repeats."""
    events = hosts.select(host_key(F.col("host")).alias("key"), "host", F.lit(None).cast("string").alias("opened"))
    events = events.unionByName(stacks.select("key", F.lit(None).cast("string").alias("host"), F.col("key").alias("opened")))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(events.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "url-sweep")
    # What each partition carries in: the last rule opened in an earlier one. One row per partition.
    ends = ranged.groupBy("part").agg(F.max("opened").alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.max("last").over(before).alias("carried"))
    # At equal keys the rule opens first: it covers its own host. Keys sort, so the last opened is the largest.
    order = Window.partitionBy("part").orderBy("key", F.col("opened").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    top = ranged.withColumn("top", F.last("opened", ignorenulls=True).over(order)).where(F.col("host").isNotNull())
    top = top.join(F.broadcast(carried), "part").select("host", "key", F.coalesce("top", "carried").alias("top"))
    met = top.join(stacks.withColumnRenamed("key", "top"), "top")
    return met.select("host", F.filter("stack", lambda r: F.startswith(F.col("key"), r["rule_key"])).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` without the URL's other columns touched, plus host, path, rule and verdict.

    ``rules`` has host, path (starting with a slash) and verdict ('allow' or 'block').
    """
    gone = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")]
    split = pages.drop(*gone).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    stacks = rule_stacks(rules)
    swept = written(sweep(split.select("host").distinct(), stacks), "url-stacks")
    met = split.join(swept, "host", "left")
    best = F.get(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return met.withColumn("_r", best).withColumns({"rule": F.col("_r")["rule"], "verdict": F.coalesce(F.col("_r")["verdict"], F.lit(default))}).drop("_r", "stack")
