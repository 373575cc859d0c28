"""Fixed schemas of the experiment store and the failure taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "store_metadata": "key string, value string",
    "sources": "source_sha256 string, artifact_kind string, source_name string, artifact_schema_version string, ingested_at timestamp",
    "runs": "run_key string, source_sha256 string, experiment_id string, run_id string, variant_id string, repetition int, capsule_id string, status string, started_at timestamp, finished_at timestamp, duration_seconds double, check_count int",
    "checks": "check_key string, run_key string, source_sha256 string, check_index int, check_id string, status string, exit_code int, duration_seconds double, cwd string, argv_json string, stdout_chars int, stderr_chars int, stdout_sha256 string, stderr_sha256 string, stdout_truncated boolean, stderr_truncated boolean, error_message string",
    "failure_records": "failure_key string, check_key string, run_key string, source_sha256 string, category string, code string, impact string, retryability string, summary string, details_json string, caused_by_check_id string, causes_json string",
    "variant_summaries": "summary_key string, source_sha256 string, experiment_id string, capsule_id string, variant_id string, runs int, passed int, failed int, errors int, pass_rate double, mean_duration_seconds double",
}
STORE_VERSION = "2"

#: Code, category, impact, retryability, summary.
TAXONOMY = [
    ("unexpected_exit", "task", "evaluation_failure", "no", "command returned an unexpected exit code"),
    ("signal_termination", "task", "evaluation_failure", "no", "command was terminated by a signal"),
    ("timeout", "resource", "evaluation_failure", "maybe", "command exceeded its declared time budget"),
    ("command_not_found", "dependency", "infrastructure_error", "after_fix", "command executable was not found"),
    ("permission_denied", "environment", "infrastructure_error", "after_fix", "command could not be started because permission was denied"),
    ("process_launch_error", "environment", "infrastructure_error", "unknown", "command process could not be started"),
    ("working_directory_missing", "environment", "infrastructure_error", "after_fix", "declared check working directory does not exist"),
    ("sandbox_configuration", "sandbox", "infrastructure_error", "after_fix", "sandbox configuration is incomplete"),
    ("sandbox_runtime", "sandbox", "infrastructure_error", "after_fix", "sandbox runtime could not execute the check"),
    ("sandbox_cleanup", "sandbox", "infrastructure_error", "after_fix", "timed-out container could not be cleaned up safely"),
    ("output_capture", "observability", "infrastructure_error", "after_fix", "command output could not be captured reliably"),
    ("skipped_after_failure", "control_flow", "not_evaluated", "after_fix", "check was skipped after an earlier check failed"),
]
#: Which impact names a run's primary failure first.
IMPACT_RANK = {"infrastructure_error": 0, "evaluation_failure": 1, "not_evaluated": 2}
#: The failure codes a check of each status may carry.
STATUS_CODES = {
    "passed": [],
    "failed": ["unexpected_exit", "signal_termination"],
    "timed_out": ["timeout", "sandbox_cleanup", "output_capture"],
    "error": ["command_not_found", "permission_denied", "process_launch_error", "working_directory_missing", "sandbox_configuration", "sandbox_runtime", "output_capture"],
    "skipped": ["skipped_after_failure"],
}


def taxonomy(spark: SparkSession) -> DataFrame:
    """The twelve failure codes; small enough to broadcast by definition."""
    return spark.createDataFrame(TAXONOMY, "code string, category string, impact string, retryability string, summary string")
