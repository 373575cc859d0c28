"""Routing of requests by rules that match their metadata, and rules that contradict each other; both by joins on single entries, whatever the number of rules.

A rule (rule_index, match map, priority, target_id) matches a request whose metadata
hold all entries of its map; the highest priority wins, then the smallest index. A
rule without entries matches all. A null value matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import all_equal


def sorted_entries(match: Column) -> Column:
    return F.array_sort(F.map_entries(match))


def best_of_equals(rules: DataFrame) -> DataFrame:
    """Of rules that match the same requests, the one that wins."""
    one = F.max_by(F.struct("rule_index", "match", "priority", "target_id"), F.struct("priority", -F.col("rule_index")))
    return rules.groupBy(sorted_entries(F.col("match")).alias("entries")).agg(one.alias("r")).select("r.*")


def indexed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with entries, each under the one of them that the fewest requests have (key, value); a rule with an entry that no request has is left out."""
    entries = rules.select("rule_index", F.explode("match").alias("key", "value"))
    asked = requests.select(F.explode("metadata").alias("key", "value")).join(entries.select("key", "value").distinct(), ["key", "value"], "left_semi").groupBy("key", "value").agg(F.count("*").alias("n"))
    counted = entries.join(asked, ["key", "value"], "left")
    rarest = counted.groupBy("rule_index").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "value")).alias("e")).where("e.n > 0")
    return rules.join(rarest, "rule_index").select("rule_index", "match", "priority", "target_id", "e.key", "e.value")


def route(requests: DataFrame, rules: DataFrame, fallback: str) -> DataFrame:
    """request_id, target_id of requests (request_id, metadata map) by the rule that wins, else the fallback.

    Each rule meets only the requests that have its rarest entry, and its other entries are compared there; what a rule without entries would win is one row for all."""
    distinct = best_of_equals(rules)
    met = requests.select("request_id", "metadata", F.explode("metadata").alias("key", "value")).join(indexed(requests, distinct.where("size(match) > 0")), ["key", "value"]).where(all_equal(F.col("match"), F.col("metadata")))
    rank = lambda: F.struct("priority", -F.col("rule_index"))
    best = met.groupBy("request_id").agg(F.max(F.struct(rank().alias("rank"), "target_id")).alias("best"))
    always = distinct.where("size(match) = 0").agg(F.max(F.struct(rank().alias("rank"), "target_id")).alias("always"))  # one row
    every = requests.select("request_id").distinct().join(best, "request_id", "left").crossJoin(F.broadcast(always))
    return every.select("request_id", F.coalesce(F.greatest("best", "always")["target_id"], F.lit(fallback)).alias("target_id"))


def ambiguous_rules(rules: DataFrame, *by: str) -> DataFrame:
    """Rules of equal priority (in the same set, by the columns named) that one request could match both: rule_index, overlaps (with how many others) and first_overlap, the smallest of their indices.

    Two rules overlap if they agree wherever both name a key. Rules with the same names are one shape; for each pair of shapes, what decides is the rule's part on the keys that both have. So a rule is counted against the shapes of its set, by equal parts, and never against single rules: rows grow with rules times shapes."""
    group = [*by, "priority"]
    r = rules.select(*group, "rule_index", "match", F.array_sort(F.map_keys("match")).alias("shape"))
    shapes = r.select(*group, F.col("shape").alias("other")).distinct()
    shared = F.array_sort(F.array_intersect("shape", "other"))
    part = F.to_json(F.transform(shared, lambda k: F.element_at("match", k)), {"ignoreNullFields": "false"})
    parts = r.join(shapes, group).select(*group, "rule_index", "shape", "other", part.alias("part"))
    least = F.array_sort(F.array_compact(F.array(F.min("rule_index"), F.min("second"))))
    # The two smallest indices of a part: the second is the smallest of those that are not their task's first.
    first = parts.groupBy(*group, "shape", "other", "part").agg(F.min("rule_index").alias("first"))
    sides = parts.join(first, [*group, "shape", "other", "part"]).withColumn("second", F.when(F.col("rule_index") != F.col("first"), F.col("rule_index")))
    offered = sides.groupBy(*group, F.col("shape").alias("other"), F.col("other").alias("shape"), "part").agg(F.count("*").alias("n"), least.alias("least"))
    met = parts.join(offered, [*group, "shape", "other", "part"])
    own = F.col("shape") == F.col("other")
    other = F.get(F.filter("least", lambda i: i != F.col("rule_index")), F.lit(0))
    out = met.groupBy(*group, "rule_index").agg(F.sum(F.col("n") - own.cast("long")).alias("overlaps"), F.min(other).alias("first_overlap"))
    return out.where("overlaps > 0")
