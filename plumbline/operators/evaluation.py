"""Evaluation: partitions, sealed scores, paired comparison, promotion gates, rollback triggers, dialogue state."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import ID_PATTERN, digest_mismatch, mcnemar_value, tail_exceeds
from plumbline.operators.integrity import chained_digest

ROLES = ("train", "validation", "sealed_test")


def partition_faults(split: DataFrame, examples: DataFrame) -> DataFrame:
    """example_id, fault of a split (example_id, role) over labelled examples (example_id, outputs): overlap, repeated, unknown, missing, unlabelled, bad_role or bad_id. Empty if the split is sound."""
    per_id = split.groupBy("example_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"), F.bool_or(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).alias("odd"))
    both = per_id.join(examples.select("example_id", F.lit(True).alias("there"), F.col("outputs").isNull().alias("unlabelled")), "example_id", "full_outer")
    faults = F.array_compact(F.array(
        F.when(F.col("roles") > 1, "overlap"), F.when((F.col("n") > 1) & (F.col("roles") == 1), "repeated"), F.when(F.col("there").isNull(), "unknown"), F.when(F.col("n").isNull(), "missing"),
        F.when(F.col("n").isNotNull() & F.col("unlabelled"), "unlabelled"), F.when(F.col("odd"), "bad_role"), F.when(~F.coalesce(F.col("example_id").cast("string").rlike(ID_PATTERN), F.lit(False)), "bad_id"),
    ))
    return both.select("example_id", F.explode(faults).alias("fault"))


def partition_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("role").agg(F.count("*").alias("examples"), F.min("example_id").alias("first_id"), F.max("example_id").alias("last_id"))


def export_partition(split: DataFrame, examples: DataFrame, role: str) -> DataFrame:
    """The examples of a role; of the sealed test without their outputs."""
    chosen = examples.join(split.where(F.col("role") == role).select("example_id"), "example_id", "left_semi")
    return chosen.drop("outputs") if role == "sealed_test" else chosen


def coverage(expected: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one side has: missing predictions and unexpected ones."""
    missing = expected.select(*keys).join(predicted, list(keys), "left_anti").withColumn("fault", F.lit("missing"))
    return missing.unionByName(predicted.select(*keys).join(expected, list(keys), "left_anti").withColumn("fault", F.lit("unexpected")))


def sealed_score(split: DataFrame, examples: DataFrame, predictions: DataFrame, *by: str, role: str = "sealed_test") -> DataFrame:
    """correct, total and score of exact matches on a role; outputs and predictions are canonical texts, and nothing but the sums leaves. An example counts once however often it is predicted, and is right only if all its predictions are; repeated() and coverage() name what may not be there."""
    truth = examples.join(split.where(F.col("role") == role).select("example_id"), "example_id", "left_semi").select("example_id", F.col("outputs").alias("truth"))
    met = truth.join(predictions.select("example_id", "outputs", *by), "example_id")
    each = met.groupBy("example_id", *by).agg(F.bool_and(F.col("truth").eqNullSafe(F.col("outputs"))).alias("right"))
    return each.groupBy(*by).agg(F.count_if("right").alias("correct"), F.count("*").alias("total"), F.avg(F.col("right").cast("double")).alias("score"))


def paired_comparison(truth: DataFrame, baseline: DataFrame, candidate: DataFrame, *by: str) -> DataFrame:
    """Contingency of two variants on the same examples (example_id, outputs): both_correct, baseline_only_correct, candidate_only_correct, neither_correct and the two scores."""
    b = baseline.select("example_id", F.col("outputs").alias("b"))
    c = candidate.select("example_id", F.col("outputs").alias("c"))
    met = truth.select("example_id", "outputs", *by).join(b, "example_id").join(c, "example_id")
    right, left = F.col("c").eqNullSafe(F.col("outputs")), F.col("b").eqNullSafe(F.col("outputs"))
    return met.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(left & right).alias("both_correct"), F.count_if(left & ~right).alias("baseline_only_correct"), F.count_if(~left & right).alias("candidate_only_correct"), F.count_if(~left & ~right).alias("neither_correct"),
        F.avg(left.cast("double")).alias("baseline_score"), F.avg(right.cast("double")).alias("candidate_score"),
    )


GATE_COLUMNS = "role string, passed boolean, total long, absolute_improvement double, discordant_pairs long, one_sided_p_value double, reasons array<string>"


def promotion_checks(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each rule (role, min_total, min_candidate_score, min_absolute_improvement, min_discordant_pairs, max_one_sided_p_value) against the comparison of its role, in exact fractions.

    Both sides have a row for each role, of which there are few; they must name the same roles."""

    def judge(key: tuple, rule_rows, report_rows):  # noqa: ANN001, ANN202
        import pandas as pd

        if len(rule_rows) != 1 or len(report_rows) != 1:
            raise ValueError(f"role {key[0]!r} needs one rule and one comparison")
        rule, r = rule_rows.iloc[0], report_rows.iloc[0]
        n, c, b = int(r["total"]), int(r["candidate_only_correct"]), int(r["baseline_only_correct"])
        gain, score = Fraction(c - b, n), Fraction(int(r["both_correct"]) + c, n)
        as_written = lambda name: Fraction(str(float(rule[name])))
        failed = {
            "too few examples": n < rule["min_total"], "no gain": gain <= 0, "score too low": score < as_written("min_candidate_score"), "gain too small": gain < as_written("min_absolute_improvement"),
            "too few discordant pairs": c + b < rule["min_discordant_pairs"], "chance too likely": tail_exceeds(c, b, as_written("max_one_sided_p_value")),
        }
        reasons = [why for why, holds in failed.items() if holds]
        return pd.DataFrame([{"role": key[0], "passed": not reasons, "total": n, "absolute_improvement": float(gain), "discordant_pairs": c + b, "one_sided_p_value": mcnemar_value(c, b), "reasons": reasons}])

    return rules.groupBy("role").cogroup(evidence.groupBy("role")).applyInPandas(judge, GATE_COLUMNS)


def promotion_decision(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.bool_and("passed"), "promote").otherwise("reject").alias("decision"), F.count("*").alias("rules"), F.count_if("passed").alias("rules_passed"))


def materialize(decision: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (variant_id, variant_sha256, document) that a decision (variant_id, variant_sha256, decision) promotes, if their documents are still those decided on."""
    chosen = decision.where("decision = 'promote'").select("variant_id", "variant_sha256")
    return candidates.join(chosen, ["variant_id", "variant_sha256"], "left_semi").where(~digest_mismatch(F.col("document"), F.col("variant_sha256")))


def output_key_faults(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """example_id, missing, unexpected of outputs (JSON objects) whose keys are not exactly those named; what is no object lacks all."""
    found = F.coalesce(F.json_object_keys("outputs"), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, keys)).cast("array<string>")
    rows = outputs.select("example_id", F.array_sort(F.array_except(wanted, found)).alias("missing"), F.array_sort(F.array_except(found, wanted)).alias("unexpected"))
    return rows.where("size(missing) > 0 or size(unexpected) > 0")


def public_digest(examples: DataFrame, *by: str) -> DataFrame:
    """by, examples, public_sha256: the digest of each dataset (example_id, inputs map) of any size that can be told without its labels: of the sorted names of the inputs and the examples by id, in canonical JSON. The format itself takes datasets of up to 10,000 examples."""
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(c))) - 2)
    entries = F.array_sort(F.transform(F.map_entries("inputs"), lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))))
    one = F.concat(F.lit('{"id":'), quoted(F.col("example_id")), F.lit(',"inputs":{'), F.array_join(entries, ","), F.lit("}}"))
    names = F.array_join(F.transform(F.array_sort(F.map_keys("inputs")), quoted), ",")
    tail = F.concat(F.lit('],"input_fields":['), names, F.lit("]}"))
    return chained_digest(examples.select(*by, F.col("example_id").alias("key"), one.alias("line"), tail.alias("tail")), by, '{"examples":[', "examples", "public_sha256")


def payloads(examples: DataFrame) -> DataFrame:
    """example_id, fields (inputs and outputs as one map) and input_keys, sorted, of examples (inputs, outputs as maps)."""
    return examples.select("example_id", F.map_concat("inputs", "outputs").alias("fields"), F.array_sort(F.map_keys("inputs")).alias("input_keys"))


def breached(value: Column, operator: Column, threshold: Column) -> Column:
    return F.when(operator == "lt", value < threshold).when(operator == "lte", value <= threshold).when(operator == "gt", value > threshold).when(operator == "gte", value >= threshold)


def rollback_events(observations: DataFrame, triggers: DataFrame) -> DataFrame:
    """Observations (metric, observed_value, samples, window_seconds) that fire a trigger (trigger_id, metric, operator, threshold, min_samples, window_seconds): of the declared window, with enough samples, past the threshold."""
    fires = (F.col("samples") >= F.col("min_samples")) & breached(F.col("observed_value"), F.col("operator"), F.col("threshold"))
    return observations.join(triggers, ["metric", "window_seconds"]).where(fires)


def probe_states(updates: DataFrame, probes: DataFrame) -> DataFrame:
    """task_id, probe_id, expected: the constraints that hold after each probe's turn, as a sorted array of (key, value).

    Updates and probes of a task are laid in one order; the last set or revoke of each key before a probe counts. Keys are taken apart first, so the window over a task's key stays short."""
    keys = updates.select("task_id", "key").distinct()
    asked = probes.select("task_id", "probe_id", "turn").join(keys, "task_id").select("task_id", "key", "turn", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("value"), "probe_id")
    told = updates.select("task_id", "key", "turn", F.lit(0).alias("kind"), F.col("ord").cast("int").alias("ord"), "action", "value", F.lit(None).cast("string").alias("probe_id"))
    order = Window.partitionBy("task_id", "key").orderBy("turn", "kind", "ord")
    last = F.last(F.when(F.col("kind") == 0, F.struct("action", "value")), ignorenulls=True).over(order)
    held = told.unionByName(asked).withColumn("state", last).where("kind = 1 and state.action = 'set'")
    maps = held.groupBy("task_id", "probe_id").agg(F.array_sort(F.collect_list(F.struct("key", F.col("state.value").alias("value")))).alias("expected"))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return probes.select("task_id", "probe_id").join(maps, ["task_id", "probe_id"], "left").select("task_id", "probe_id", F.coalesce("expected", empty).alias("expected"))


def dialogue_faults(probes: DataFrame, declared: DataFrame, predictions: DataFrame, corpus_sha256: str | None = None) -> DataFrame:
    """task_id, probe_id, fault of predictions (task_id, probe_id, active_constraints, and public_corpus_sha256 where the corpus's is given): of no probe of the corpus, there twice, with a key that the task does not declare (task_id, key), or made for another corpus."""
    p = predictions.select("task_id", "probe_id", "active_constraints", *(["public_corpus_sha256"] if corpus_sha256 else []))
    unknown = p.join(probes.select("task_id", "probe_id"), ["task_id", "probe_id"], "left_anti").select("task_id", "probe_id", F.lit("unknown probe").alias("fault"))
    twice = p.groupBy("task_id", "probe_id").count().where("count > 1").select("task_id", "probe_id", F.lit("repeated").alias("fault"))
    used = p.select("task_id", "probe_id", F.explode("active_constraints").alias("c")).select("task_id", "probe_id", F.col("c.key").alias("key"))
    undeclared = used.join(declared.select("task_id", "key"), ["task_id", "key"], "left_anti").select("task_id", "probe_id", F.lit("undeclared key").alias("fault"))
    out = unknown.unionByName(twice).unionByName(undeclared)
    if corpus_sha256:
        out = out.unionByName(p.where(~F.col("public_corpus_sha256").eqNullSafe(corpus_sha256)).select("task_id", "probe_id", F.lit("another corpus").alias("fault")))
    return out.distinct()


def dialogue_score(expected: DataFrame, predictions: DataFrame) -> DataFrame:
    """task_id, total, submitted, correct, score, and a row with null task_id for all. predictions: task_id, probe_id, active_constraints as a sorted array of (key, value). A probe counts once however often it is predicted, and is right only if all its predictions are; dialogue_faults() names what may not be there."""
    given = predictions.groupBy("task_id", "probe_id").agg(F.min("active_constraints").alias("least"), F.max("active_constraints").alias("most"))
    met = expected.join(given, ["task_id", "probe_id"], "left")
    right = F.coalesce((F.col("least") == F.col("expected")) & (F.col("most") == F.col("expected")), F.lit(False))
    return met.rollup("task_id").agg(F.count("*").alias("total"), F.count("least").alias("submitted"), F.count_if(right).alias("correct"), F.avg(right.cast("double")).alias("score"))


def broken_supersedes(updates: DataFrame) -> DataFrame:
    """Updates that name another update than the active one of their key: after a revoke, or at first, there is none."""
    order = Window.partitionBy("task_id", "key").orderBy("turn", "ord")
    active = F.when(F.lag("action").over(order) == "set", F.lag("update_id").over(order))
    return updates.withColumn("active", active).where(~F.col("supersedes").eqNullSafe(F.col("active")) | ((F.col("action") == "revoke") & F.col("active").isNull()))


def public_corpus(updates: DataFrame, probes: DataFrame, turns: DataFrame) -> DataFrame:
    """What may be published of a dialogue corpus: turns and probes, no updates."""
    marked = probes.groupBy("task_id", "turn").agg(F.sort_array(F.collect_list("probe_id")).alias("probe_ids"))
    return turns.select("task_id", "turn", "role", "content").join(marked, ["task_id", "turn"], "left")


def dataset_signature(examples: DataFrame) -> DataFrame:
    """Whether all examples (inputs, outputs as maps) have the same keys, and inputs and outputs share none: examples, input_signatures, output_signatures, overlapping."""
    names = lambda c: F.array_sort(F.map_keys(c))
    return examples.agg(F.count("*").alias("examples"), F.count_distinct(names("inputs")).alias("input_signatures"), F.count_distinct(names("outputs")).alias("output_signatures"), F.count_if(F.arrays_overlap(F.map_keys("inputs"), F.map_keys("outputs"))).alias("overlapping"))
