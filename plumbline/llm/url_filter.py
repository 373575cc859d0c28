"""URL filters as a temporal join with dated lists; DataFrame functions only.

Dated entries (add or remove a domain or a url, on a block or an allow list)
become validity intervals. For each distinct host of the captures the intervals
of the host and of its parent domains are laid over each other into a timeline
of disjoint segments, each with the number of block and allow entries active in
it; urls get one of their own. An as-of join then finds, for each capture, the
one segment that holds its fetch time. Hot hosts are met once in the timelines,
and the captures side of the join can be split, as no aggregate stands on it.

Cases: a null url, or one without a host, is unlisted; a null fetch time is
before every entry; an entry without pattern or date is ignored, repeated
entries count once, and of an add and a remove at one moment the remove wins;
hosts compare in lower case and without a closing dot, and an IPv6 host with its
brackets; urls compare whole, whatever their length; repeated captures are judged
each; empty lists leave all captures unlisted, and an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)"


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """kind, list, pattern, valid_from, valid_to of entries (kind domain or url, list block or allow, pattern, action add or remove, at date); an open end is null."""
    known = entries.select("kind", "list", F.when(F.col("kind") == "domain", F.lower("pattern")).otherwise(F.col("pattern")).alias("pattern"), "action", "at").where("pattern is not null and at is not null").distinct()
    after = Window.partitionBy("kind", "list", "pattern").orderBy("at", "action")
    return known.withColumn("valid_to", F.lead("at").over(after)).where("action = 'add' and (valid_to is null or valid_to > at)").select("kind", "list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def timeline(active: DataFrame) -> DataFrame:
    """subject, valid_from, valid_to, n_block, n_allow: disjoint segments of (subject, list, valid_from, valid_to)."""
    one = lambda name: F.when(F.col("list") == name, F.lit(1)).otherwise(0)
    opens = active.select("subject", F.col("valid_from").alias("at"), one("block").alias("block"), one("allow").alias("allow"))
    closes = active.where("valid_to is not null").select("subject", F.col("valid_to").alias("at"), (-one("block")).alias("block"), (-one("allow")).alias("allow"))
    steps = opens.unionByName(closes).groupBy("subject", "at").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    by_time = Window.partitionBy("subject").orderBy("at")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("subject", F.col("at").alias("valid_from"), F.lead("at").over(by_time).alias("valid_to"), F.sum("block").over(so_far).alias("n_block"), F.sum("allow").over(so_far).alias("n_allow")).where("n_block > 0 or n_allow > 0")


def as_of(captures: DataFrame, segments: DataFrame, subject: str, prefix: str) -> DataFrame:
    """captures with the counts of the segment of their subject that holds their fetch time; at most one does."""
    s = segments.select(F.col("subject").alias(f"{prefix}_subject"), F.col("valid_from").alias(f"{prefix}_from"), F.col("valid_to").alias(f"{prefix}_to"), F.col("n_block").alias(f"{prefix}_block"), F.col("n_allow").alias(f"{prefix}_allow"))
    inside = (F.col(subject) == F.col(f"{prefix}_subject")) & (F.col("fetched") >= F.col(f"{prefix}_from")) & (F.col(f"{prefix}_to").isNull() | (F.col("fetched") < F.col(f"{prefix}_to")))
    return captures.join(s, inside, "left").drop(f"{prefix}_subject", f"{prefix}_from", f"{prefix}_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """id, host, n_block, n_allow, verdict: blocked, allowed (an allow entry wins over blocks) or unlisted."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(at_col).alias("fetched"))
    valid = intervals(entries)
    hosts = rows.where("host is not null").select("host").distinct()
    parents = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda k: F.array_join(F.slice(F.split("host", r"\."), -k, k), "."))).alias("pattern"))
    domains = timeline(parents.join(valid.where("kind = 'domain'"), "pattern").select(F.col("host").alias("subject"), "list", "valid_from", "valid_to"))
    urls = timeline(valid.where("kind = 'url'").select(F.col("pattern").alias("subject"), "list", "valid_from", "valid_to"))
    found = as_of(as_of(rows, domains, "host", "d"), urls, "url", "u")
    total = lambda name: (F.coalesce(F.col(f"d_{name}"), F.lit(0)) + F.coalesce(F.col(f"u_{name}"), F.lit(0))).cast("long")
    verdict = F.when(F.col("n_allow") > 0, "allowed").when(F.col("n_block") > 0, "blocked").otherwise("unlisted")
    return found.select(F.col("id").alias(id_col), "host", total("block").alias("n_block"), total("allow").alias("n_allow")).withColumn("verdict", verdict)
