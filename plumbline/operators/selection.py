"""Choosing: context under a budget, goals, reviews, tool policies, sets of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_within(items: DataFrame, budget: int | Column, *by: str, ordering: str = "priority") -> DataFrame:
    """Context items (position, priority, content, max_chars) of each group that fit its budget of characters: by falling priority, the last one cut. Adds rank, the order in which they go in."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    cut = items.withColumn("content", F.left("content", F.col("max_chars"))).withColumn("__size", F.length("content").cast("long"))
    first = Window.partitionBy(*by).orderBy(F.col("priority").desc(), "position")
    before = F.coalesce(F.sum("__size").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.least(F.col("__size"), limit - before), F.lit(0))
    kept = cut.withColumn("__room", room).where("__room > 0").withColumn("content", F.left("content", F.col("__room").cast("int")))
    place = first if ordering == "priority" else Window.partitionBy(*by).orderBy("position")
    return kept.withColumn("rank", F.row_number().over(place)).drop("__size", "__room")


def trace_of(events: DataFrame) -> list[str]:
    """What names a trace: its id, with its source where events have one."""
    return [c for c in ("source_name", "trace_id") if c in events.columns]


def latest_message(events: DataFrame, *by: str, role: str = "user") -> DataFrame:
    """Of each group, the message event of a role that is last by (timestamp, trace, sequence)."""
    trace = trace_of(events)
    chosen = F.max_by(F.struct(*trace, "sequence", "content"), F.struct("timestamp", *reversed(trace), "sequence"))
    return events.where((F.col("event_type") == "message.observed") & (F.col("role") == role)).groupBy(*by).agg(chosen.alias("m")).select(*by, "m.*")


def corrections(events: DataFrame, *by: str) -> DataFrame:
    """Feedback events with the messages that they name: each once, with how many correcting (made) and corrected (targets) messages there are; a correction is whole if either is one."""
    trace = trace_of(events)
    feedback = events.where("event_type = 'feedback.observed'").select(*trace, F.col("sequence").alias("feedback_sequence"), "message_id", "correction_of", *by)
    messages = events.where("event_type = 'message.observed'").groupBy(*trace, "message_id").agg(F.count("*").alias("n"), F.min_by(F.struct("content", "timestamp", "sequence"), "sequence").alias("m"))
    correcting = messages.select(*trace, "message_id", F.col("n").alias("made"), "m.content", "m.timestamp", "m.sequence")
    corrected = messages.select(*trace, F.col("message_id").alias("correction_of"), F.col("n").alias("targets"), F.col("m.sequence").alias("corrected_sequence"))
    joined = feedback.join(correcting, [*trace, "message_id"], "left").join(corrected, [*trace, "correction_of"], "left")
    return joined.withColumns({"made": F.coalesce("made", F.lit(0)), "targets": F.coalesce("targets", F.lit(0))})


def correction_faults(events: DataFrame) -> DataFrame:
    """The trace, feedback_sequence and fault of feedback events that do not name exactly one correcting and one corrected message."""
    fault = F.when(F.col("made") != 1, F.format_string("%d correcting messages", "made")).when(F.col("targets") != 1, F.format_string("%d corrected messages", "targets"))
    return corrections(events).select(*trace_of(events), "feedback_sequence", fault.alias("fault")).where("fault is not null")


def latest_correction(events: DataFrame, *by: str) -> DataFrame:
    """Of each group, the correcting message that is last, with the message it corrects and the feedback event of the pair, and how many corrections are whole in this way; correction_faults() names the others."""
    whole = corrections(events, *by).where("made = 1 and targets = 1")
    trace = trace_of(events)
    best = F.max_by(F.struct(*trace, "sequence", "corrected_sequence", "feedback_sequence", "content"), F.struct("timestamp", *reversed(trace), "sequence"))
    return whole.groupBy(*by).agg(best.alias("c"), F.count("*").alias("corrections")).select(*by, "c.*", "corrections")


def latest_review(reviews: DataFrame) -> DataFrame:
    """The decision of each proposal's last review."""
    return reviews.groupBy("proposal_id").agg(F.max_by("decision", "position").alias("decision"), F.count("*").alias("reviews"))


def strong_proposals(results: DataFrame) -> DataFrame:
    """Proposals (proposal_id, kind baseline or mutation, passed) that verify: the baseline passes, there are mutations, and each is detected."""
    return results.groupBy("proposal_id").agg((F.bool_and((F.col("kind") == "mutation") | F.col("passed")) & (F.count_if(F.col("kind") == "baseline") > 0) & (F.count_if(F.col("kind") == "mutation") > 0) & F.bool_and((F.col("kind") == "baseline") | ~F.col("passed"))).alias("strong"))


def may_materialize(proposals: DataFrame, reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Proposals whose last review approves and whose verification is strong."""
    return proposals.join(latest_review(reviews), "proposal_id", "left").join(strong_proposals(results), "proposal_id", "left").withColumn("ready", F.coalesce((F.col("decision") == "approve") & F.col("strong"), F.lit(False)))


def tool_violations(calls: DataFrame, policies: DataFrame, parallel_allowed: bool = True) -> DataFrame:
    """response_id, violations of responses (policies: response_id, declared array, max_calls, selection, selected_tool) given their calls (response_id, name)."""
    made = calls.groupBy("response_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
    p = policies.join(made, "response_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    unknown, wrong = F.array_except("names", "declared"), F.array_except("names", F.array("selected_tool"))
    each = F.array_compact(F.array(
        F.when(F.size(unknown) > 0, F.concat(F.lit("undeclared: "), F.array_join(unknown, ", "))),
        F.when(F.col("n") > F.col("max_calls"), F.format_string("%d calls over %d", F.col("n"), F.col("max_calls"))),
        F.when((F.col("selection") == "none") & (F.col("n") > 0), F.lit("calls despite none")),
        F.when((F.col("selection") == "required") & (F.col("n") == 0), F.lit("no call despite required")),
        F.when((F.col("selection") == "named") & (F.col("n") != 1), F.format_string("%d calls, named needs one", F.col("n"))),
        F.when((F.col("selection") == "named") & (F.size(wrong) > 0), F.concat(F.lit("outside the named tool: "), F.array_join(wrong, ", "))),
        F.when(F.lit(not parallel_allowed) & (F.col("n") > 1), F.lit("parallel calls")),
    ))
    return p.select("response_id", each.alias("violations")).where(F.size("violations") > 0)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """kind (the column's name), value, n: how often each value of each column occurs, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def first_occurrences(rows: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """The first row of each key in the order; rows whose key has a null part are all kept."""
    keyed = F.lit(True)
    for k in keys:
        keyed &= F.col(k).isNotNull()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.where(keyed).withColumn("__nth", nth).where("__nth = 1").drop("__nth").unionByName(rows.where(~keyed))
