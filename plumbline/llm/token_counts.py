"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length; the histogram has a row for
each length that occurs. Sums over the longer rows then answer totals, quantiles
and truncated totals for every context limit without touching a document again.
The sums run in blocks of lengths, so that no task sees the whole histogram.

Cases: a null text is empty and has length 0; texts of any length are encoded
whole; repeated rows count each; ties in length are one row; an empty table gives
an empty histogram; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder_for, spec_of
from .common import store

BLOCK = 1024


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every document."""
    spec = spec_of(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(spec.value)
        for batch in batches:
            counts = [encoder.count(t.as_py()) for t in pc.fill_null(batch.column(1), "")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """length, n_docs, docs_longer, tokens_longer (of documents over that length), and for a context limit of that length: docs_within, tokens_truncated (each document cut there), tokens_total."""
    bins = store(counted.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK)), "lengths")
    whole = bins.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    down = Window.orderBy(F.col("block").desc())
    above, every = down.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    later = whole.select("block", zero(F.sum("d").over(above)).alias("d_above"), zero(F.sum("t").over(above)).alias("t_above"), F.sum("d").over(every).alias("docs"), F.sum("t").over(every).alias("tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = bins.join(later, "block").select(
        "length", "n_docs", (F.col("d_above") + zero(F.sum("n_docs").over(inside))).alias("docs_longer"), (F.col("t_above") + zero(F.sum(F.col("n_docs") * F.col("length")).over(inside))).alias("tokens_longer"), "docs", "tokens"
    )
    return longer.select("length", "n_docs", "docs_longer", "tokens_longer", (F.col("docs") - F.col("docs_longer")).alias("docs_within"), (F.col("tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("tokens_truncated"), F.col("tokens").alias("tokens_total"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, tokens_truncated for each context limit, whether a document has that length or not: from the last row not above the limit."""
    wanted = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    last = wanted.join(hist, F.col("length") <= F.col("context_limit"), "left").groupBy("context_limit").agg(F.max_by(F.struct("docs_longer", "tokens_truncated", "length"), "length").alias("h"))
    total = hist.agg(F.sum("n_docs").alias("all_docs"))
    over = F.coalesce(F.col("h.docs_longer"), F.col("all_docs"), F.lit(0))
    cut = F.coalesce(F.col("h.tokens_truncated"), F.lit(0)) + (F.col("context_limit") - F.coalesce(F.col("h.length"), F.lit(0))) * over
    return last.crossJoin(F.broadcast(total)).select("context_limit", over.alias("docs_over"), cut.alias("tokens_truncated"))


def quantiles(hist: DataFrame, fractions: list[float]) -> DataFrame:
    """fraction, length: the smallest length that so large a part of the documents does not exceed."""
    wanted = hist.sparkSession.createDataFrame([(float(x),) for x in fractions], "fraction double")
    reached = F.col("docs_within") >= F.col("fraction") * (F.col("docs_within") + F.col("docs_longer"))
    return wanted.join(hist, reached, "left").groupBy("fraction").agg(F.min("length").alias("length"))
