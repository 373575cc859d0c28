"""Filter interaction audit: what every order of a set of filters would remove, counted without running any order.

Duplicates are found by sorting: texts are dealt to tasks by ranges of (fingerprint,
id), so that a text which a third of all rows hold spreads over many tasks, each
task sorts by fingerprint, full text and id, and a row is compared with the row
before it, bytes with bytes. What a task cannot see, a group that began in a task
before it, is settled by a small second step: each task hands on the groups at its
two edges, and the least id of such a group over all tasks decides. The other
filters are computed in the same pass. A document becomes a mask of the filters
that it fails; masks are counted for each part, and all orders and steps follow
from at most 2^5 counters a part.

Cases: a null text is an empty one; a row whose id is null counts as larger than
any other, so it repeats an equal text with an id, and rows without ids do not
repeat each other; rows repeated in full have equal ids, so neither repeats the
other; a null language is the part ''; a document labelled twice is good or toxic
if any label says so, a document without labels is neither; texts of any length
are read whole; an empty table gives no parts and no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

FILTERS = "ABCDE"
#: A: fewer words than this. B: distinct words, in hundredths of all. C: capital letters, in hundredths of all characters. D: any of these characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"
#: Rows of a batch that are split into words at once.
AT_ONCE = 256

#: What a task tells: of each row its mask, and its group unless it surely repeats another; of each group at the task's edges (no mask) the fingerprint, text and least id.
TOLD = "part int, group long, doc_id long, lang string, mask int, print long, text string"


def quality_masks(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3 for failures of A to D."""
    trimmed = pc.ascii_trim_whitespace(texts)
    words = pc.ascii_split_whitespace(trimmed)
    n = np.where(np.asarray(pc.binary_length(trimmed)) > 0, np.asarray(pc.list_value_length(words)), 0).astype(np.int64)
    flat = pc.list_flatten(words)
    flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    doc = np.repeat(np.arange(len(n)), n)
    cells = np.unique(doc * max(1, len(flat.dictionary)) + np.asarray(flat.indices))
    distinct = np.bincount(cells // max(1, len(flat.dictionary)), minlength=len(n))
    capitals = np.asarray(pc.count_substring_regex(texts, "[A-Z]")).astype(np.int64)
    points = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    marked = np.asarray(pc.match_substring_regex(texts, MARKS).cast(pa.uint8())).astype(np.int64)
    return (n < LEAST_WORDS) + 2 * (100 * distinct < LEAST_DISTINCT * n) + 4 * (100 * capitals > MOST_CAPITALS * points) + 8 * marked


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a task, over its rows sorted by (print, text, id): TOLD, with bit 4 in the mask if a row before it has its text and a smaller id.

    Ids ascend within a group and nulls come last, so a group's first id is its least.
    Groups with the task's first or last fingerprint may go on in other tasks: those are its edges, as a rule two.
    """
    task, first, groups = 0, None, 0
    last: tuple[int, str | None] | None = None  # fingerprint and text of the row before
    least: int | None = None  # id that began its group
    edges: list[tuple[int, int, str, int | None]] = []  # groups with the fingerprint seen last: group, print, text, least

    def edge_rows(rows: list) -> pa.RecordBatch:
        no = [None] * len(rows)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string())
        columns = ([task] * len(rows), [r[0] for r in rows], [r[3] for r in rows], no, no, [r[1] for r in rows], [r[2] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "group", "doc_id", "lang", "mask", "print", "text"])

    for whole in batches:
        for batch in (whole.slice(k, AT_ONCE) for k in range(0, whole.num_rows, AT_ONCE)):
            part, doc, lang, prints, text = (batch.column(k) for k in range(5))
            n, p = batch.num_rows, np.asarray(prints)
            task, first = part[0].as_py(), int(p[0]) if first is None else first
            same = np.zeros(n, bool)
            same[1:] = (p[1:] == p[:-1]) & np.asarray(pc.equal(text.slice(1), text.slice(0, n - 1)).cast(pa.uint8())).astype(bool)
            same[0] = last == (int(p[0]), text[0].as_py())
            known = np.asarray(pc.is_valid(doc).cast(pa.uint8())).astype(bool)
            ids = np.asarray(pc.fill_null(doc, 0))
            began = np.maximum.accumulate(np.where(same, -1, np.arange(n)))  # -1: before this batch
            before = began < 0
            least_known = np.where(before, least is not None, known[began])
            least_id = np.where(before, least or 0, ids[began])
            repeats = least_known & (~known | (ids > least_id))
            group = groups + np.cumsum(~same)
            mask = quality_masks(text) + 16 * repeats
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([part.cast(pa.int32()), pa.array(group, pa.int64(), mask=repeats), doc, lang, pa.array(mask, pa.int32()), none, pa.nulls(n, pa.string())], names=["part", "group", "doc_id", "lang", "mask", "print", "text"])
            for k in np.flatnonzero(~same & ((p == first) | (p == p[-1]) | (p == (last[0] if last else first)))):
                if edges and edges[-1][1] != int(p[k]):
                    if edges[-1][1] == first:
                        yield edge_rows(edges)
                    edges = []
                edges.append((int(group[k]), int(p[k]), text[k].as_py(), doc[k].as_py()))
            groups, last = int(group[-1]), (int(p[-1]), text[n - 1].as_py())
            least = (int(least_id[-1]) if least_known[-1] else None)
            if edges and edges[-1][1] != last[0]:
                if edges[-1][1] == first:
                    yield edge_rows(edges)
                edges = []
    if edges:
        yield edge_rows(edges)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask for every row of docs: bits 0 to 4 for failures of A to E."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text")).withColumn("print", F.xxhash64("text"))
    by_id = F.col("id").asc_nulls_last()
    dealt = rows.repartitionByRange("print", by_id).sortWithinPartitions("print", "text", by_id)
    told = store(dealt.select(F.spark_partition_id().alias("part"), "id", "lang", "print", "text").mapInArrow(compared, TOLD), "audit")
    edges = told.where("mask is null").select("part", "group", "print", "text", F.col("doc_id").alias("least"))  # as a rule two a task
    over_all = edges.groupBy("print", "text").agg(F.min("least").alias("least_of_all"))
    began_before = edges.join(over_all, ["print", "text"]).select("part", "group", "least_of_all")
    at = told.where("mask is not null").join(began_before, ["part", "group"], "left")
    repeats = F.col("group").isNotNull() & F.col("least_of_all").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least_of_all")))
    return at.select("doc_id", F.col("lang").alias("part"), (F.col("mask") + F.when(repeats, 16).otherwise(0)).alias("mask"))


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, documents, good, toxic: counts that add up over any split of the rows."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = failed.join(known, "doc_id", "left").groupBy("part", "mask")
    return counted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def step_table() -> Column:
    """An array of all (filter_order, step, bit of the step's filter, bits of the filters before it): 120 orders of five steps."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        steps += [F.struct(F.lit(name).alias("filter_order"), F.lit(s + 1).alias("step"), F.lit(1 << k).alias("bit"), F.lit(sum(1 << j for j in order[:s])).alias("before")) for s, k in enumerate(order)]
    return F.array(*steps)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step what the step's filter does there, from the counters of the masks; every order has its rows, zeros included."""
    masks = counters(failures(docs), labels).groupBy("part").agg(F.collect_list(F.struct("mask", "documents", "good", "toxic")).alias("masks"))  # at most 32 a part
    rows = masks.select("part", "masks", F.explode(step_table()).alias("s")).select("part", "masks", "s.*")

    def total(column: str, where) -> Column:
        return F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda t, m: t + m[column])

    fails = lambda m: m["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m["mask"].bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    orders = 120  # of five filters; in an m-th part of them a filter comes first of the m that a document fails
    shapley = F.aggregate(F.filter("masks", fails), F.lit(0).cast("long"), lambda t, m: t + m["documents"] * (F.lit(orders) / F.bit_count(m["mask"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("documents", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("documents", here).alias("removed"),
        total("documents", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("documents", lambda m: m["mask"] == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
