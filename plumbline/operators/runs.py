"""What runs and checks mean: failure classes, run status, summaries, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import matrix_run_id, plus_seconds
from plumbline.schemas import IMPACT_RANK, STATUS_CODES, taxonomy


def failure_code(outcome: Column, exit_code: Column, errno: Column, complication: Column) -> Column:
    """Code of an observed outcome: exit, timeout, launch, capture, directory, sandbox_configuration, sandbox_runtime or skipped; null if there is none."""
    return (
        F.when(outcome == "exit", F.when(exit_code < 0, "signal_termination").otherwise("unexpected_exit"))
        .when(outcome == "timeout", F.when(complication.isin("sandbox_cleanup", "output_capture"), complication).otherwise("timeout"))
        .when(outcome == "launch", F.when(errno == 2, "command_not_found").when(errno.isin(1, 13), "permission_denied").otherwise("process_launch_error"))
        .when(outcome == "capture", "output_capture")
        .when(outcome == "directory", "working_directory_missing")
        .when(outcome.isin("sandbox_configuration", "sandbox_runtime"), outcome)
        .when(outcome == "skipped", "skipped_after_failure")
    )


def classified(checks: DataFrame, how: str = "left") -> DataFrame:
    """Checks (outcome, exit_code, errno, complication, blocked_by) with the record of those that failed beside them: code, category, impact, retryability, summary, caused_by_check_id, causes; code is null where there is none."""
    coded = checks.withColumn("code", failure_code(F.col("outcome"), F.col("exit_code"), F.col("errno"), F.col("complication")))
    late = (F.col("outcome") == "timeout") & (F.col("code") != "timeout")
    summary = F.when(late & (F.col("code") == "output_capture"), "command timed out and output capture became unreliable").otherwise(F.col("summary"))
    known = coded.join(F.broadcast(taxonomy(checks.sparkSession)), "code", how)  # twelve rows
    return known.withColumn("summary", summary).withColumn("caused_by_check_id", F.when(F.col("code") == "skipped_after_failure", F.col("blocked_by"))).withColumn("causes", F.when(late, F.array(F.lit("timeout"))).when(F.col("code").isNotNull(), F.array().cast("array<string>")))


def classify(checks: DataFrame) -> DataFrame:
    """Failed checks with their record, as of classified()."""
    return classified(checks.where(F.col("outcome").isNotNull()), "inner")


def inconsistent_records(records: DataFrame) -> DataFrame:
    """Records whose category, impact or retryability is not their code's, that name their own code as a cause or one twice, or whose blocking check is missing or out of place."""
    t = F.broadcast(taxonomy(records.sparkSession).select("code", F.col("category").alias("c"), F.col("impact").alias("i"), F.col("retryability").alias("r")))
    skipped = F.col("code") == "skipped_after_failure"
    wrong = F.col("c").isNull() | (F.col("category") != F.col("c")) | (F.col("impact") != F.col("i")) | (F.col("retryability") != F.col("r")) | F.array_contains("causes", F.col("code")) | (F.size(F.array_distinct("causes")) != F.size("causes")) | (skipped != F.col("caused_by_check_id").isNotNull())
    return records.join(t, "code", "left").where(wrong).drop("c", "i", "r")


def forbidden_codes(checks: DataFrame) -> DataFrame:
    """Checks (status, code) whose status does not allow their failure code; a passed check carries none, any other needs one."""
    allowed = F.coalesce(*(F.when(F.col("status") == s, F.array_contains(F.array(*map(F.lit, codes)), F.col("code")) if codes else F.lit(False)) for s, codes in STATUS_CODES.items()))
    return checks.where(F.when(F.col("status") == "passed", F.col("code").isNotNull()).otherwise(F.col("code").isNull() | ~F.coalesce(allowed, F.lit(False))))


def run_status(checks: DataFrame, runs: DataFrame, by: str = "run_key") -> DataFrame:
    """run_key, status of every run: error if a check has an infrastructure error, else failed if one did not pass, else passed, also without checks. by: the column of both that tells runs apart."""
    folded = checks.groupBy(F.col(by).alias("by")).agg(F.bool_or(F.coalesce(F.col("impact") == "infrastructure_error", F.lit(False))).alias("infra"), F.bool_or(F.col("status") != "passed").alias("bad"))
    return runs.select("run_key", F.col(by).alias("by")).join(folded, "by", "left").select("run_key", F.when(F.col("infra"), "error").when(F.col("bad"), "failed").otherwise("passed").alias("status"))


def failure_summary(records: DataFrame) -> DataFrame:
    """Per run_key: total, counts by impact, maps by_category and by_code, and the primary failure: infrastructure errors first, then by check_index. One aggregation to the kinds of failure of each run, of which there are at most as many as the taxonomy has, and one over these."""
    rank = F.coalesce(*(F.when(F.col("impact") == k, F.lit(v)) for k, v in IMPACT_RANK.items()))
    kinds = records.groupBy("run_key", "category", "code", "impact").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("rank"), "check_index", "check_id")).alias("first"))
    of = lambda impact: F.sum(F.when(F.col("impact") == impact, F.col("n")).otherwise(0))
    runs = kinds.groupBy("run_key").agg(F.sum("n").alias("total"), of("evaluation_failure").alias("evaluation_failures"), of("infrastructure_error").alias("infrastructure_errors"), of("not_evaluated").alias("not_evaluated"), F.min(F.struct("first", "code")).alias("p"), F.collect_list(F.struct("category", "code", "n")).alias("kinds"))

    def counts(field: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform("kinds", lambda k: k[field])))
        return F.map_from_entries(F.transform(names, lambda name: F.struct(name, F.aggregate(F.filter("kinds", lambda k: k[field] == name), F.lit(0).cast("long"), lambda t, k: t + k["n"]))))

    return runs.select("run_key", "total", "evaluation_failures", "infrastructure_errors", "not_evaluated", counts("category").alias("by_category"), counts("code").alias("by_code"), F.col("p.first.check_id").alias("primary_check_id"), F.col("p.code").alias("primary_code"))


def summary_of(failures: Column) -> Column:
    """failure_summary() of one run whose failures are an array of structs (check_index, check_id, category, code, impact); null if there are none."""
    rank = lambda impact: F.coalesce(*(F.when(impact == k, F.lit(v)) for k, v in IMPACT_RANK.items()))
    first = F.array_min(F.transform(failures, lambda f: F.struct(rank(f["impact"]).alias("rank"), f["check_index"], f["check_id"].alias("check_id"), f["code"].alias("code"))))
    of = lambda impact: F.size(F.filter(failures, lambda f: f["impact"] == impact))

    def counts(field: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(failures, lambda f: f[field])))
        return F.map_from_entries(F.transform(names, lambda name: F.struct(name, F.size(F.filter(failures, lambda f: f[field] == name)))))

    return F.when(F.size(failures) > 0, F.struct(F.size(failures).alias("total"), of("evaluation_failure").alias("evaluation_failures"), of("infrastructure_error").alias("infrastructure_errors"), of("not_evaluated").alias("not_evaluated"), counts("category").alias("by_category"), counts("code").alias("by_code"), first["check_id"].alias("primary_check_id"), first["code"].alias("primary_code")))


def variant_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Per variant: runs, passed, failed, errors, pass_rate, mean_duration_seconds."""
    of = lambda status: F.count_if(F.col("status") == status)
    return runs.groupBy(*keys, "variant_id").agg(F.count("*").alias("runs"), of("passed").alias("passed"), of("failed").alias("failed"), of("error").alias("errors"), F.avg(F.when(F.col("status") == "passed", 1.0).otherwise(0.0)).alias("pass_rate"), F.avg("duration_seconds").alias("mean_duration_seconds"))


def run_trace(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """run_key, sequence, event_type, timestamp, check_id, status of each run's events: start, each check at the running sum of durations but not after the end, and the end."""
    by_index = Window.partitionBy("run_key").orderBy("check_index")
    inner = checks.select("run_key", "check_index", "check_id", F.col("status").alias("check_status"), F.sum("duration_seconds").over(by_index.rowsBetween(Window.unboundedPreceding, 0)).alias("elapsed"), F.row_number().over(by_index).alias("place"))
    bounds = runs.select("run_key", "started_at", "finished_at", F.col("status").alias("run_status"), "check_count")
    middle = inner.join(bounds, "run_key").select("run_key", F.col("place").cast("int").alias("sequence"), F.lit("check.completed").alias("event_type"), F.least(plus_seconds(F.col("started_at"), F.col("elapsed")), F.col("finished_at")).alias("timestamp"), "check_id", F.col("check_status").alias("status"))
    none = F.lit(None).cast("string")
    edge = lambda sequence, kind, at, status: F.struct(sequence.cast("int").alias("sequence"), F.lit(kind).alias("event_type"), at.alias("timestamp"), none.alias("check_id"), status.alias("status"))
    edges = F.array(edge(F.lit(0), "run.started", F.col("started_at"), none), edge(F.col("check_count") + 1, "run.completed", F.col("finished_at"), F.col("run_status")))
    return bounds.select("run_key", F.explode(edges).alias("e")).select("run_key", "e.*").unionByName(middle)


def skipped_attribution(checks: DataFrame) -> DataFrame:
    """Skipped checks with blocked_by, the last check before them that was not skipped."""
    before = Window.partitionBy("run_key").orderBy("check_index").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("status") != "skipped", F.col("check_id")), ignorenulls=True).over(before)
    return checks.withColumn("blocked_by", last).where("status = 'skipped'")


def matrix(variants: DataFrame, repetitions: int, experiment_id: str) -> DataFrame:
    """variant_id, repetition, run_id for each variant and each of a stated number of repetitions."""
    planned = variants.select("variant_id", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    return planned.select("variant_id", "repetition", matrix_run_id(F.lit(experiment_id), F.col("variant_id"), F.col("repetition")).alias("run_id"))


def outside_experiment(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Runs that do not lie inside their experiment's time."""
    e = experiments.select("experiment_id", F.col("started_at").alias("from"), F.col("finished_at").alias("to"))
    return runs.join(e, "experiment_id").where((F.col("started_at") < F.col("from")) | (F.col("finished_at") > F.col("to"))).drop("from", "to")


def feedback(checks: DataFrame) -> DataFrame:
    """Optimizer feedback of each run: score, the share of checks that passed, and a line for each check."""
    line = F.format_string("%s: %s", F.col("check_id"), F.col("status"))
    return checks.groupBy("run_key").agg(F.avg(F.when(F.col("status") == "passed", 1.0).otherwise(0.0)).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("check_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("feedback"))
