"""Mixing sources to target weights by hierarchical budgets.

Documents hang under domain, language and source. Weights share a token budget
among the children of each node; a child never gets more than its documents give
in `max_epochs` epochs, and what it leaves goes to its siblings by their weights
before any of it goes back to the parent's siblings: each level fills its
children to one water level, computed in closed form with windows over the few
nodes. Only leaves whose own and whose ancestors' weights are above 0 give a node
its capacity, so no tokens are promised to what gets nothing. A leaf takes whole epochs and then a token-prefix of one more: its
documents in the order of a hash of seed, epoch and id, as long as they fit. The
running sum is taken in hash buckets, so a leaf with a third of all rows spreads
over 4096 tasks' worth of work, and the buckets' own sums in 64 runs of 64.

Cases: a null domain, language or source is a node of its own ("-"); a null text
has no tokens, and documents without tokens go with every epoch their leaf
begins; texts of any length count whole, and one longer than what is left of the
budget ends the prefix; a null id is drawn by its text; rows of one id come in
the order of their token counts; weights that are missing are 1, weights of 0 or
less get nothing; repeated rows count each; an empty table gives an empty
result; other columns, whatever their names, are ignored by mix() and kept by
take().
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, store

LEVELS = ["domain", "lang", "source"]
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def weight_of(level: str, weights: Mapping[str, int]) -> Column:
    given = F.coalesce(*(F.when(F.col(level) == k, F.lit(int(v))) for k, v in weights.items()), F.lit(1)) if weights else F.lit(1)
    return F.greatest(given, F.lit(0)).cast("long")


def fill(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Share `budget` (of the parent, on each row) among children with `capacity` and `weight`: adds granted.

    Ordered by capacity per weight, children are full up to the first that the water level does not reach."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("weight"), child)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(rest)
    able = children.where("weight > 0").withColumn("level", level)
    unmet = F.when(F.col("capacity") / F.col("weight") > F.col("level"), F.col("level"))
    water = F.first(unmet, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    granted = F.coalesce(F.least(F.col("capacity").cast("double"), F.floor(F.col("weight") * water).cast("double")), F.col("capacity").cast("double"))
    return able.withColumn("granted", F.greatest(granted, F.lit(0.0)).cast("long")).drop("level")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """leaf columns, tokens, leaf_budget. leaves: domain, lang, source, tokens; budget: an expression over total, the sum of all tokens."""
    able = F.lit(True)
    for level in LEVELS:
        able &= weight_of(level, weights.get(level, {})) > 0
    tree = leaves.withColumn("capacity", F.when(able, F.col("tokens") * max_epochs).otherwise(0))
    above = None
    for depth, level in enumerate(LEVELS):
        keys, parents = LEVELS[: depth + 1], LEVELS[:depth]
        nodes = tree.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("node_tokens")).withColumn("weight", weight_of(level, weights.get(level, {})))
        if above is None:
            everything = Window.partitionBy(F.lit(0))
            nodes = nodes.withColumn("total", F.sum("node_tokens").over(everything)).withColumn("budget", budget.cast("long")).drop("total")
        else:
            nodes = nodes.join(above, parents)
        above = fill(nodes, parents, level).select(*keys, F.col("granted").alias("budget"))
    return leaves.join(above, LEVELS, "left").select(*LEVELS, "tokens", F.coalesce("budget", F.lit(0)).alias("leaf_budget"))


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int = 1, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, row_col: str | None = None) -> DataFrame:
    """row_id (row_col, or a number given here), doc_id, domain, lang, source, tokens, leaf_budget, copies for every row: how often the mixture takes it."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), (tokens if tokens is not None else word_count(F.col(text_col))).alias("tokens"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))).alias("drawn_by"))
    rows = store(rows, "mixture")
    leaves = store(leaf_budgets(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), weights, budget, max_epochs).withColumnRenamed("tokens", "leaf_tokens"), "budgets")
    epochs = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("leaf_budget") / F.greatest("leaf_tokens", F.lit(1)))).otherwise(0).cast("long")
    drawn = rows.join(leaves, LEVELS).withColumn("epochs", epochs).withColumn("left", F.col("leaf_budget") - F.col("epochs") * F.col("leaf_tokens"))
    drawn = drawn.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("drawn_by")).cast("binary"))).withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    sums = drawn.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("bucket_tokens")).withColumn("run", F.floor(F.col("bucket") / 64).cast("int"))
    earlier = lambda *by: F.coalesce(F.sum("bucket_tokens").over(Window.partitionBy(*LEVELS, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sums.groupBy(*LEVELS, "run").agg(F.sum("bucket_tokens").alias("bucket_tokens")).select(*LEVELS, "run", earlier("run").alias("run_offset"))
    offsets = sums.withColumn("offset", earlier("run", "bucket")).join(runs, [*LEVELS, "run"]).select(*LEVELS, "bucket", (F.col("offset") + F.col("run_offset")).alias("offset"))
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("draw", "doc_id", "tokens", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.join(offsets, [*LEVELS, "bucket"]).withColumn("upto", F.col("offset") + F.sum("tokens").over(inside))
    copies = F.col("epochs") + F.when((F.col("left") > 0) & (F.col("upto") <= F.col("left")), 1).otherwise(0)
    return placed.select("row_id", "doc_id", *LEVELS, "tokens", "leaf_budget", copies.cast("long").alias("copies"))


def take(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int = 1, seed: int = 17) -> DataFrame:
    """The rows of docs that the mixture takes, each as often as it says, with the columns of docs."""
    rows, row = numbered(docs)
    mixture = mix(rows, domain, weights, budget, max_epochs, seed, row_col=row).where("copies > 0").select(F.col("row_id").alias(row), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(f"{row}_copy"))
    return rows.join(mixture.select(row), row).select(*(rows[c] for c in docs.columns))
