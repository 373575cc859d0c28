"""The registered queries of the evidence operators, with the same results in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import routing as routing_rules
from plumbline.operators import binding, evaluation, integrity, normalize, otlp, privacy, runs, selection, signatures, views
from plumbline.plans import evidence as ev
from plumbline.schemas import TAXONOMY
from plumbline.sources import artifacts as artifacts_of
from plumbline.sources import documents, store
from plumbline.streaming import rollback

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def map_text(column: str) -> Column:
    """A map of counts as text, in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


# The logical tables in SQL, for the queries below.
BASE = r"""
WITH r AS (
  SELECT sha256(sha256('source-' || (o_orderkey % 16)) || chr(31) || o_orderkey) AS run_key, sha256('source-' || (o_orderkey % 16)) AS source_sha256,
         'exp-' || (o_orderkey % 16) AS experiment_id, CAST(o_orderkey AS VARCHAR) AS run_id, c_mktsegment AS variant_id, CAST(o_orderkey % 5 AS INTEGER) AS repetition,
         o_orderpriority AS capsule_id, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'error' END AS status,
         o_orderdate AS started_at, o_orderdate + to_seconds(CAST(floor(o_totalprice / 100) AS BIGINT)) AS finished_at,
         CAST(floor(o_totalprice / 100) AS DOUBLE) AS duration_seconds, CAST(coalesce(n, 0) AS INTEGER) AS check_count, o_orderkey
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey),
l AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS check_index,
         sha256(sha256('source-' || (l_orderkey % 16)) || chr(31) || l_orderkey) AS run_key,
         CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_partkey % 8 IN (0, 1) THEN 'exit' WHEN l_partkey % 8 IN (2, 3) THEN 'timeout' WHEN l_partkey % 8 = 4 THEN 'launch' WHEN l_partkey % 8 = 5 THEN 'capture' WHEN l_partkey % 8 = 6 THEN 'directory' ELSE 'sandbox_runtime' END AS outcome
  FROM lineitem),
c AS (
  SELECT sha256(run_key || chr(31) || check_index || chr(31) || 'check-' || check_index) AS check_key, run_key, sha256('source-' || (l_orderkey % 16)) AS source_sha256, check_index, 'check-' || check_index AS check_id,
         CASE WHEN outcome IS NULL THEN 'passed' WHEN outcome = 'exit' THEN 'failed' WHEN outcome = 'timeout' THEN 'timed_out' ELSE 'error' END AS status,
         CAST(CASE WHEN outcome IS NULL THEN 0 WHEN outcome = 'exit' THEN CASE WHEN l_partkey % 8 = 0 THEN l_linenumber ELSE -9 END END AS INTEGER) AS exit_code,
         l_quantity AS duration_seconds, '.' AS cwd, '["check","' || l_partkey || '"]' AS argv_json, 0 AS stdout_chars, CAST(length(l_linestatus) AS INTEGER) AS stderr_chars,
         sha256('') AS stdout_sha256, sha256(l_linestatus) AS stderr_sha256, false AS stdout_truncated, false AS stderr_truncated, CASE WHEN outcome IS NOT NULL THEN l_returnflag END AS error_message,
         CASE outcome WHEN 'exit' THEN CASE WHEN l_partkey % 8 = 0 THEN 'unexpected_exit' ELSE 'signal_termination' END
           WHEN 'timeout' THEN CASE WHEN l_partkey % 8 = 2 THEN 'timeout' WHEN l_suppkey % 2 = 0 THEN 'sandbox_cleanup' ELSE 'output_capture' END
           WHEN 'launch' THEN CASE l_suppkey % 3 WHEN 0 THEN 'command_not_found' WHEN 1 THEN 'permission_denied' ELSE 'process_launch_error' END
           WHEN 'capture' THEN 'output_capture' WHEN 'directory' THEN 'working_directory_missing' WHEN 'sandbox_runtime' THEN 'sandbox_runtime' END AS code, outcome
  FROM l),
x(code, category, impact, retryability, summary) AS (VALUES @TAXONOMY),
f AS (
  SELECT sha256(check_key || chr(31) || c.code) AS failure_key, check_key, run_key, source_sha256, check_id, check_index, category, c.code, impact, retryability,
         CASE WHEN outcome = 'timeout' AND c.code = 'output_capture' THEN 'command timed out and output capture became unreliable' ELSE summary END AS summary,
         CASE WHEN exit_code IS NULL THEN '{}' ELSE '{"actual_exit_code":' || exit_code || '}' END AS details_json, CAST(NULL AS VARCHAR) AS caused_by_check_id,
         CASE WHEN outcome = 'timeout' AND c.code <> 'timeout' THEN '["timeout"]' ELSE '[]' END AS causes_json
  FROM c JOIN x ON x.code = c.code)
""".replace("@TAXONOMY", ", ".join(str(row) for row in TAXONOMY))


def store_view(name: str) -> Query:
    return lambda spark, sf_dir: views.view(ev.store_tables(spark, sf_dir), name)


VIEW_SQL = {
    "runs": "SELECT * EXCLUDE (o_orderkey) FROM r",
    "checks": "SELECT * EXCLUDE (code, outcome) FROM c",
    "failures": """SELECT r.run_key, r.experiment_id, r.run_id, r.variant_id, r.repetition, r.capsule_id, r.status AS run_status, c.check_id, c.status AS check_status, c.exit_code, c.duration_seconds, c.error_message,
       f.category AS failure_category, f.code AS failure_code, f.impact AS failure_impact, f.retryability, f.summary AS failure_summary, f.details_json AS failure_details_json, f.caused_by_check_id, f.causes_json
  FROM r LEFT JOIN c ON c.run_key = r.run_key LEFT JOIN f ON f.check_key = c.check_key WHERE r.status <> 'passed' OR c.status <> 'passed'""",
    "failure_taxonomy": """SELECT f.category AS failure_category, f.code AS failure_code, f.impact AS failure_impact, f.retryability, count(*) AS occurrences, count(DISTINCT f.run_key) AS runs, count(DISTINCT r.capsule_id) AS capsules, avg(c.duration_seconds) AS mean_duration_seconds
  FROM f JOIN c ON c.check_key = f.check_key JOIN r ON r.run_key = f.run_key GROUP BY ALL""",
    "variants": """SELECT experiment_id, capsule_id, variant_id, count(*) AS runs, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'error') AS errors,
       avg(CASE WHEN status = 'passed' THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(duration_seconds) AS mean_duration_seconds, source_sha256 FROM r GROUP BY ALL""",
    "capsules": """SELECT capsule_id, count(*) AS runs, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'error') AS errors,
       avg(CASE WHEN status = 'passed' THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(duration_seconds) AS mean_duration_seconds, min(started_at) AS first_started_at, max(finished_at) AS last_finished_at FROM r GROUP BY ALL""",
    "sources": """SELECT sha256('source-' || n) AS source_sha256, CASE WHEN n = 0 THEN 'run' ELSE 'experiment' END AS artifact_kind, 'source-' || n || '.json' AS source_name, '0.1' AS artifact_schema_version, TIMESTAMP '2024-01-01' + to_seconds(n) AS ingested_at
  FROM (SELECT DISTINCT o_orderkey % 16 AS n FROM orders)""",
}
for _name in views.VIEWS:
    register(f"view_{_name}", BASE + VIEW_SQL[_name])(store_view(_name))


@register("store_info", BASE + "SELECT 'runs' AS table_name, count(*) AS row_count FROM r UNION ALL SELECT 'checks', count(*) FROM c UNION ALL SELECT 'failure_records', count(*) FROM f UNION ALL SELECT 'variant_summaries', count(*) FROM (SELECT DISTINCT experiment_id, capsule_id, variant_id FROM r) UNION ALL SELECT 'sources', count(DISTINCT o_orderkey % 16) FROM r")
def store_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.info(ev.store_tables(spark, sf_dir))


@register("failure_classification", BASE + "SELECT check_key, code, category, impact, retryability, summary, causes_json FROM f")
def failure_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.failure_records(ev.outcomes(spark, sf_dir)).select("check_key", "code", "category", "impact", "retryability", "summary", "causes_json")


@register("taxonomy_consistency", BASE + "SELECT check_key, code FROM f WHERE check_index % 5 IN (1, 2, 3)")
def taxonomy_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records broken in three ways by their check's place: another category, themselves as a cause, a blocking check without being skipped."""
    way = F.col("check_index") % 5
    broken = runs.classify(ev.outcomes(spark, sf_dir)).withColumns({"category": F.when(way == 1, "control_flow").otherwise(F.col("category")), "causes": F.when(way == 2, F.array("code")).otherwise(F.col("causes")), "caused_by_check_id": F.when(way == 3, "check-0").otherwise(F.col("caused_by_check_id"))})
    return runs.inconsistent_records(broken).select("check_key", "code")


@register("status_code_compatibility", BASE + """, s AS (SELECT check_key, CASE check_index % 4 WHEN 1 THEN 'failed' WHEN 2 THEN 'passed' ELSE status END AS status, code FROM c)
SELECT * FROM s WHERE status = 'passed' AND code IS NOT NULL OR status = 'failed' AND (code IS NULL OR code NOT IN ('unexpected_exit', 'signal_termination'))""")
def status_code_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of which one half keep their status, a quarter are said to have failed, and a quarter to have passed."""
    c = ev.outcomes(spark, sf_dir)
    coded = c.withColumn("code", runs.failure_code(F.col("outcome"), F.col("exit_code"), F.col("errno"), F.col("complication")))
    turned = coded.withColumn("status", F.when(F.col("check_index") % 4 == 1, "failed").when(F.col("check_index") % 4 == 2, "passed").otherwise(F.col("status")))
    return runs.forbidden_codes(turned).select("check_key", "status", "code")


@register("run_status", BASE + "SELECT r.run_key, CASE WHEN bool_or(coalesce(f.impact = 'infrastructure_error', false)) THEN 'error' WHEN bool_or(coalesce(c.status <> 'passed', false)) THEN 'failed' ELSE 'passed' END AS status FROM r LEFT JOIN c ON c.run_key = r.run_key LEFT JOIN f ON f.check_key = c.check_key GROUP BY r.run_key")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_status(runs.classified(ev.outcomes(spark, sf_dir)), ev.orders(spark, sf_dir), "o_orderkey")


@register("failure_summary", BASE + """,
g AS (SELECT run_key, category, count(*) AS n FROM f GROUP BY ALL), h AS (SELECT run_key, code, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY CASE impact WHEN 'infrastructure_error' THEN 0 WHEN 'evaluation_failure' THEN 1 ELSE 2 END, check_index) AS k FROM f)
SELECT f.run_key, count(*) AS total, count(*) FILTER (f.impact = 'evaluation_failure') AS evaluation_failures, count(*) FILTER (f.impact = 'infrastructure_error') AS infrastructure_errors, count(*) FILTER (f.impact = 'not_evaluated') AS not_evaluated,
       any_value((SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM g WHERE g.run_key = f.run_key)) AS by_category, any_value((SELECT string_agg(code || '=' || n, ',' ORDER BY code) FROM h WHERE h.run_key = f.run_key)) AS by_code,
       any_value(p.check_id) AS primary_check_id, any_value(p.code) AS primary_code
FROM f JOIN p ON p.run_key = f.run_key AND p.k = 1 GROUP BY f.run_key""")
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = runs.failure_summary(ev.failure_records(ev.outcomes(spark, sf_dir)))
    return s.withColumn("by_category", map_text("by_category")).withColumn("by_code", map_text("by_code"))


@register("variant_summary", BASE + "SELECT variant_id, count(*) AS runs, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'error') AS errors, avg(CASE WHEN status = 'passed' THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(duration_seconds) AS mean_duration_seconds FROM r GROUP BY ALL")
def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.variant_summary(ev.runs(spark, sf_dir))


@register("run_trace", BASE + """,
e AS (SELECT run_key, check_id, status, row_number() OVER w AS sequence, sum(duration_seconds) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS elapsed FROM c WINDOW w AS (PARTITION BY run_key ORDER BY check_index))
SELECT run_key, CAST(0 AS INTEGER) AS sequence, 'run.started' AS event_type, started_at AS timestamp, NULL AS check_id, NULL AS status FROM r
UNION ALL SELECT e.run_key, CAST(sequence AS INTEGER), 'check.completed', least(started_at + to_microseconds(CAST(round(elapsed * 1000000) AS BIGINT)), finished_at), check_id, e.status FROM e JOIN r ON r.run_key = e.run_key
UNION ALL SELECT run_key, CAST(check_count + 1 AS INTEGER), 'run.completed', finished_at, NULL, status FROM r""")
def run_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_trace(ev.runs(spark, sf_dir), ev.outcomes(spark, sf_dir))


@register("skipped_attribution", BASE + ", s AS (SELECT run_key, check_index, check_id, CASE WHEN check_index > 2 AND exit_code IS NULL THEN 'skipped' ELSE status END AS status FROM c), t AS (SELECT *, last_value(CASE WHEN status <> 'skipped' THEN check_id END IGNORE NULLS) OVER (PARTITION BY run_key ORDER BY check_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blocked_by FROM s) SELECT run_key, check_index, check_id, blocked_by FROM t WHERE status = 'skipped'")
def skipped_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.outcomes(spark, sf_dir)
    s = c.withColumn("status", F.when((F.col("check_index") > 2) & F.col("exit_code").isNull(), "skipped").otherwise(F.col("status")))
    return runs.skipped_attribution(s).select("run_key", "check_index", "check_id", "blocked_by")


@register("experiment_matrix", "SELECT v AS variant_id, CAST(k AS INTEGER) AS repetition, 'bench.' || v || '.' || lpad(CAST(k AS VARCHAR), 3, '0') AS run_id FROM (SELECT DISTINCT c_mktsegment AS v FROM customer), range(1, 6) t(k)")
def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.matrix(ev.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("variant_id")).distinct(), 5, "bench")


@register("optimizer_feedback", BASE + "SELECT run_key, avg(CASE WHEN status = 'passed' THEN 1.0 ELSE 0.0 END) AS score, string_agg(check_id || ': ' || status, chr(10) ORDER BY check_index) AS feedback FROM c GROUP BY run_key")
def optimizer_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.feedback(ev.outcomes(spark, sf_dir))


@register("experiment_containment", BASE + ", e AS (SELECT experiment_id, min(started_at) AS a, max(started_at) AS b FROM r GROUP BY ALL) SELECT run_key FROM r JOIN e USING (experiment_id) WHERE started_at < a OR finished_at > b")
def experiment_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.runs(spark, sf_dir)
    spans = r.groupBy("experiment_id").agg(F.min("started_at").alias("started_at"), F.max("started_at").alias("finished_at"))
    return runs.outside_experiment(r, spans).select("run_key")


# Artifacts -------------------------------------------------------------------


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run artifact of each order, as JSON text."""
    c = runs.classified(ev.outcomes(spark, sf_dir))
    failed = F.col("code").isNotNull()
    failure = F.when(failed, F.struct("category", "code", "impact", "retryability", "summary", F.struct(F.col("exit_code").alias("actual_exit_code")).alias("details"), "caused_by_check_id", "causes")).alias("failure")
    check = F.struct(F.col("check_id").alias("id"), F.array(F.lit("check")).alias("argv"), "cwd", "status", "exit_code", "duration_seconds", F.lit("").alias("stdout"), F.col("check_id").alias("stderr"), "stdout_truncated", "stderr_truncated", F.col("error_message").alias("error"), failure)
    made = c.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("check_index", check.alias("check")))).alias("made"))
    failures = F.transform(F.filter("made", lambda x: x["check"]["failure"].isNotNull()), lambda x: F.struct(x["check_index"].alias("check_index"), x["check"]["id"].alias("check_id"), *(x["check"]["failure"][name].alias(name) for name in ("category", "code", "impact"))))
    made = made.select("o_orderkey", F.transform("made", lambda x: x["check"]).alias("checks"), runs.summary_of(failures).alias("failure_summary"))
    r = ev.orders(spark, sf_dir).join(made, "o_orderkey", "left")
    none = F.array().cast(made.schema["checks"].dataType)
    moment = lambda name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(name)
    doc = F.struct(F.concat(F.lit("capsule-"), F.col("run_id")).alias("capsule_id"), F.when(F.col("failure_summary.infrastructure_errors") > 0, "error").when(F.col("failure_summary").isNotNull(), "failed").otherwise("passed").alias("status"), moment("started_at"), moment("finished_at"), "duration_seconds", F.coalesce("checks", none).alias("checks"), "failure_summary")
    return r.select(F.col("run_id").alias("source_name"), F.to_json(doc).alias("document"))


@register("artifact_checks", BASE + "SELECT r.run_id AS source_name, c.check_index, c.check_id, c.status, c.exit_code, c.duration_seconds, CAST(length(c.check_id) AS INTEGER) AS stderr_chars, sha256(c.check_id) AS stderr_sha256 FROM r JOIN c ON c.run_key = r.run_key")
def artifact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.normalize(artifacts(spark, sf_dir))
    return rows["checks"].select("source_name", "check_index", "check_id", "status", "exit_code", "duration_seconds", "stderr_chars", "stderr_sha256")


STATUS = "CASE WHEN bool_or(coalesce(f.impact = 'infrastructure_error', false)) THEN 'error' WHEN bool_or(coalesce(c.status <> 'passed', false)) THEN 'failed' ELSE 'passed' END"


ARTIFACT_RUNS = BASE + f"SELECT r.run_id AS source_name, 'run' AS artifact_kind, 'capsule-' || r.run_id AS capsule_id, {STATUS} AS status, any_value(r.duration_seconds) AS duration_seconds, any_value(r.check_count) AS check_count FROM r LEFT JOIN c ON c.run_key = r.run_key LEFT JOIN f ON f.check_key = c.check_key GROUP BY r.run_id"


@register("artifact_runs", ARTIFACT_RUNS)
def artifact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.normalize(artifacts(spark, sf_dir))
    return rows["runs"].select("source_name", F.lit("run").alias("artifact_kind"), "capsule_id", "status", "duration_seconds", "check_count")


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{integrity.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("store_ingest", f"SELECT capsule_id, status, duration_seconds, check_count, 0 AS added_again FROM ({ARTIFACT_RUNS})")
def store_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a new store that has taken in every order's artifact, and then all of them once more, which adds none."""
    root = own_folder(spark, "store")
    store.initialize(spark, root)
    made = integrity.written_out(artifacts(spark, sf_dir))
    store.ingest(made, root)
    again = store.ingest(made.withColumn("source_name", F.concat(F.lit("again-"), F.col("source_name"))), root)
    integrity.forget(made)
    return store.load(spark, root)["runs"].select("capsule_id", "status", "duration_seconds", "check_count", F.lit(again).alias("added_again"))


@register("artifact_failures", BASE + "SELECT r.run_id AS source_name, f.check_id, f.category, f.code, f.impact, f.causes_json FROM f JOIN r ON r.run_key = f.run_key")
def artifact_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.normalize(artifacts(spark, sf_dir))["failure_records"].select("source_name", "check_id", "category", "code", "impact", "causes_json")


@register("artifact_faults", BASE + f"""
, g AS (SELECT r.run_id, any_value(r.o_orderkey) AS n, {STATUS} AS status, any_value(r.check_count) AS checks, count(f.code) AS failed FROM r LEFT JOIN c ON c.run_key = r.run_key LEFT JOIN f ON f.check_key = c.check_key GROUP BY r.run_id)
SELECT run_id AS source_name, CASE n % 12 WHEN 1 THEN 'not a strict JSON object' WHEN 2 THEN 'not a strict JSON object' WHEN 3 THEN 'not a strict JSON object' WHEN 4 THEN '/status: missing' WHEN 5 THEN '/note: unknown field' WHEN 6 THEN '/duration_seconds: not a finite number'
  WHEN 7 THEN '/started_at: not a time with its zone' WHEN 8 THEN 'run ends before it starts' WHEN 9 THEN 'run status is not that of the checks' WHEN 10 THEN 'failure summary is not that of the checks' ELSE 'failure details hold raw output' END AS fault
FROM g WHERE n % 12 BETWEEN 1 AND 9 OR n % 12 = 10 AND failed > 0 OR n % 12 = 11 AND failed > 0""")
def artifact_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts broken in eleven ways by the number of their order; every twelfth is whole."""
    d, way = F.col("document"), F.col("source_name").cast("long") % 12
    swap = lambda a, b: F.regexp_replace(d, a, b)
    broken = (
        F.when(way == 1, F.concat(F.lit("{broken"), d)).when(way == 2, swap(r"^\{", '{"capsule_id":"other",')).when(way == 3, swap(r'"duration_seconds":[0-9.E]+,"checks"', '"duration_seconds":NaN,"checks"'))
        .when(way == 4, swap(r'"status":"[a-z]+","started_at"', '"started_at"')).when(way == 5, swap(r"^\{", '{"note":1,')).when(way == 6, swap(r'"duration_seconds":[0-9.E]+,"checks"', '"duration_seconds":"1","checks"'))
        .when(way == 7, swap(r'("started_at":"[^"]+)Z"', '$1"')).when(way == 8, swap(r'"finished_at":"[^"]+', '"finished_at":"1901-01-01T00:00:00Z'))
        .when(way == 9, swap(r'"status":"[a-z]+","started_at"', F.when(d.rlike('"status":"passed","started_at"'), '"status":"failed","started_at"').otherwise('"status":"passed","started_at"')))
        .when(way == 10, swap(r'"total":', '"total":1')).when(way == 11, swap(r'"details":\{[^}]*\}', '"details":{"deep":[{"StdOut":1}]}')).otherwise(d)
    )
    faults = artifacts_of.artifact_faults(artifacts(spark, sf_dir).withColumn("document", broken))
    return faults.select("source_name", "fault")


# Normalization ---------------------------------------------------------------

MESSAGES = """
WITH m AS (
  SELECT 'conv-' || conv_id AS trace_id, conv_id, turn, 'm' || turn AS id, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text AS content, 1704067200 + conv_id * 60 + turn AS secs,
         CASE WHEN turn >= 2 AND turn % 2 = 0 AND conv_id % 2 = 0 THEN 'm' || (turn - 1) END AS correction_of
  FROM conversations),
e AS (
  SELECT trace_id, turn, 0 AS part, 'message.observed' AS event_type, secs, id AS message_id, role, content, NULL AS correction_of FROM m
  UNION ALL SELECT trace_id, turn, 1, 'feedback.observed', secs, id, NULL, NULL, correction_of FROM m WHERE correction_of IS NOT NULL
  UNION ALL SELECT trace_id, -1, 0, 'conversation.started', min(secs), NULL, NULL, NULL, NULL FROM m GROUP BY trace_id),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY turn, part) - 1 AS INTEGER) AS sequence FROM e)
"""


def by_source(sql: str, suffix: str = "") -> str:
    """The rows of each trace for each source that has it: every seventh conversation is there twice."""
    return f"SELECT source_name, s.* FROM ({sql}) s JOIN (SELECT DISTINCT 'conv-' || conv_id AS trace_id, 'conv-' || conv_id || '{suffix}' AS source_name FROM conversations UNION ALL SELECT DISTINCT 'conv-' || conv_id, 'again-conv-' || conv_id || '{suffix}' FROM conversations WHERE conv_id % 7 = 0) a USING (trace_id)"


@register("transcript_events", by_source(MESSAGES + "SELECT trace_id, sequence, event_type, secs, message_id, role, content, correction_of FROM n", ".json"))
def transcript_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.transcript_events(ev.again(ev.transcripts(spark, sf_dir))).withColumn("secs", F.unix_seconds("timestamp")).drop("timestamp")


@register("document_identity", by_source("SELECT DISTINCT 'conv-' || conv_id AS trace_id, 'document id of another source' AS fault FROM conversations WHERE conv_id % 7 = 0", ".json"))
def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound transcripts of which some come from two sources under one id."""
    return normalize.transcript_faults(ev.again(ev.transcripts(spark, sf_dir)))


@register("transcript_validation", "SELECT 'conv-' || conv_id AS trace_id, CASE conv_id % 3 WHEN 0 THEN 'repeated message id' WHEN 1 THEN 'time falls' ELSE 'correction out of place' END AS fault FROM conversations WHERE turn = CASE WHEN conv_id % 3 = 2 THEN 0 ELSE 1 END")
def transcript_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts broken in three ways by their number: the second message has the first one's id, or an earlier time, or the first message corrects the second."""
    way, turn = F.col("conv_id") % 3, F.col("turn")
    m = ev.messages(spark, sf_dir).withColumns({"id": F.when((way == 0) & (turn == 1), "m0").otherwise(F.col("id")), "timestamp": F.when((way == 1) & (turn == 1), F.timestamp_add("HOUR", F.lit(-1), "timestamp")).otherwise(F.col("timestamp")), "correction_of": F.when((way == 2) & (turn == 0), "m1")})
    return normalize.transcript_faults(ev.transcripts(spark, sf_dir, m)).drop("source_name")


@register("latest_user_message", MESSAGES + "SELECT trace_id, max(sequence) AS sequence, arg_max(content, secs) AS content FROM n WHERE event_type = 'message.observed' AND role = 'user' GROUP BY trace_id")
def latest_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalize.transcript_events(ev.transcripts(spark, sf_dir)).withColumn("group", F.col("trace_id"))
    return selection.latest_message(events, "group").select("trace_id", "sequence", "content")


@register("latest_correction", MESSAGES + ", f AS (SELECT * FROM n WHERE event_type = 'feedback.observed'), t AS (SELECT f.trace_id, c.sequence, d.sequence AS corrected_sequence, f.sequence AS feedback_sequence, c.content, row_number() OVER (PARTITION BY f.trace_id ORDER BY c.secs DESC, c.sequence DESC) AS k, count(*) OVER (PARTITION BY f.trace_id) AS corrections FROM f JOIN n c ON c.trace_id = f.trace_id AND c.message_id = f.message_id AND c.event_type = 'message.observed' JOIN n d ON d.trace_id = f.trace_id AND d.message_id = f.correction_of AND d.event_type = 'message.observed') SELECT trace_id, sequence, corrected_sequence, feedback_sequence, content, corrections FROM t WHERE k = 1")
def latest_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = normalize.transcript_events(ev.transcripts(spark, sf_dir)).withColumn("group", F.col("trace_id"))
    return selection.latest_correction(events, "group").drop("group", "source_name")


@register("trace_invariants", """
WITH n AS (SELECT user_id, sum(CASE WHEN value > 50 THEN 3 ELSE 2 END) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, 'gap' AS fault FROM n WHERE user_id % 2 = 0 AND n >= 3 UNION ALL SELECT user_id, 'falls' FROM n WHERE user_id % 3 = 0 AND n >= 3""")
def trace_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in the numbers and falling times of the export's events, where every second trace has lost its second event, and the third event of every third is at time zero."""
    e = otlp.events(ev.otlp(spark, sf_dir)).where("startswith(source_name, 'user-')").withColumn("user_id", F.conv("trace_id", 16, 10).cast("bigint") - 1)
    e = e.where("not (user_id % 2 = 0 and sequence = 1)").withColumn("ns", F.when((F.col("user_id") % 3 == 0) & (F.col("sequence") == 2), 0).otherwise(F.col("ns")))
    gaps = integrity.gaps(e, "sequence", "user_id").select("user_id", F.lit("gap").alias("fault"))
    return gaps.unionByName(integrity.out_of_order(e, "ns", "sequence", "user_id").select("user_id", F.lit("falls").alias("fault")))


@register("trace_identity", "SELECT 'conv-' || conv_id AS trace_id, 'context changes' AS fault FROM conversations WHERE conv_id % 4 = 1 GROUP BY conv_id HAVING count(*) > 1")
def trace_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces whose events name one capsule, but for those of every fourth, where each turn has its own."""
    e = ev.messages(spark, sf_dir).withColumn("capsule_id", F.when(F.col("conv_id") % 4 == 1, F.col("turn").cast("string")).otherwise("capsule")).withColumn("variant_id", F.lit(None).cast("string"))
    return normalize.identity_faults(e, "capsule_id", "variant_id")


@register("correction_faults", MESSAGES + ", f AS (SELECT trace_id, sequence AS feedback_sequence, CAST(substr(message_id, 2) AS BIGINT) AS t FROM n WHERE event_type = 'feedback.observed') SELECT trace_id, feedback_sequence, CASE WHEN t = 2 THEN '2 correcting messages' ELSE '0 corrected messages' END AS fault FROM f WHERE t IN (2, 4)")
def correction_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections where the third message of a trace is there twice and the fourth is missing."""
    e = normalize.transcript_events(ev.transcripts(spark, sf_dir))
    observed = F.col("event_type") == "message.observed"
    broken = e.where(~(observed & (F.col("message_id") == "m3"))).unionByName(e.where(observed & (F.col("message_id") == "m2")))
    return selection.correction_faults(broken).drop("source_name")


#: Spans of the broken exports, each with its fault.
SPANS = """
WITH s AS (
  SELECT user_id, event_id, event_id % 16 AS k, lpad(lower(printf('%x', user_id + 1)), 32, '0') AS trace_id, event_type, epoch_us(ts) * 1000 AS a, CAST(floor(value) AS BIGINT) * 1000000 AS d, value,
         CASE WHEN event_id % 16 = 14 THEN '00000000000000aa' ELSE lpad(lower(printf('%x', event_id + 1)), 16, '0') END AS span_id,
         '{"event.type":"' || event_type || '","x":' || CASE event_id % 7 WHEN 0 THEN '"s\\"' || event_id || '"' WHEN 1 THEN 'true' WHEN 2 THEN event_id || '' WHEN 3 THEN event_id || '.5' WHEN 4 THEN '"AAE="' WHEN 5 THEN '[' || event_id || ',"z",[]]' ELSE '{"a":' || event_id || ',"b":false}' END || '}' AS span_attributes
  FROM events WHERE value IS NOT NULL),
f AS (
  SELECT *, CASE WHEN k = 4 THEN 'trace id' WHEN k = 11 THEN 'span id' WHEN k = 6 THEN 'parent span id' WHEN k = 10 THEN 'time' WHEN k = 5 THEN 'ends before it starts' WHEN k = 7 THEN 'name' WHEN k = 9 THEN 'events'
         WHEN k = 1 THEN 'event time' WHEN k = 13 THEN 'event name' WHEN user_id % 11 = 0 THEN 'resource attributes' WHEN k IN (2, 3, 8) THEN 'attributes' WHEN k = 12 THEN 'event attributes'
         WHEN k = 14 AND count(*) OVER (PARTITION BY user_id, k) > 1 THEN 'span id repeats' END AS fault
  FROM s),
u AS (SELECT DISTINCT user_id, 'user-' || user_id AS source_name FROM s UNION ALL SELECT DISTINCT user_id, 'again-user-' || user_id FROM s WHERE user_id % 7 = 0),
x AS (SELECT source_name, f.* FROM f JOIN u USING (user_id)),
y AS (SELECT * FROM x WHERE fault IS NULL)
"""


@register("otlp_events", SPANS + """,
e AS (
  SELECT source_name, trace_id, span_id, a AS ns, 0 AS phase, 'span.started' AS event_type, event_type AS event_name, CAST(NULL AS BIGINT) AS duration_ns, '1' AS kind, NULL AS status, NULL AS event_attributes, span_attributes, user_id FROM y
  UNION ALL SELECT source_name, trace_id, span_id, a + d // 2, 1, 'span.event_observed', 'half', NULL, NULL, NULL, '{"share":0.5}', span_attributes, user_id FROM y WHERE value > 50
  UNION ALL SELECT source_name, trace_id, span_id, a + d, 2, 'span.completed', event_type, d, NULL, '{"code":1}', NULL, span_attributes, user_id FROM y)
SELECT source_name, trace_id, span_id, ns, event_type, event_name, duration_ns, kind, status, event_attributes, span_attributes, '{"service.name":"user-' || user_id || '"}' AS resource_attributes, 'r/1' AS resource_schema_url, 'events' AS scope_name, '2' AS scope_version, '{}' AS scope_attributes,
       CAST(row_number() OVER (PARTITION BY source_name, trace_id ORDER BY ns, phase, span_id) - 1 AS INTEGER) AS sequence FROM e""")
def otlp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound spans of exports of which many are broken, and of sources that share their trace ids."""
    return otlp.events(ev.otlp(spark, sf_dir, broken=True)).drop("timestamp", "parent_span_id", "scope_schema_url")


@register("otlp_attributes", SPANS.replace("event_id % 16 AS k", "-1 AS k").replace("CASE WHEN event_id % 16 = 14 THEN '00000000000000aa' ELSE", "CASE WHEN false THEN '' ELSE") + "SELECT source_name, span_id, span_attributes AS attributes FROM x")
def otlp_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.spans(ev.otlp(spark, sf_dir)).select("source_name", "span_id", "attributes")


@register("otlp_faults", SPANS + """SELECT source_name, fault, CASE WHEN fault = 'resource attributes' THEN '0/1: key repeats' WHEN fault = 'event attributes' THEN '1/0: 0 forms of a value' WHEN fault = 'attributes' THEN CASE k WHEN 2 THEN '0/1: 2 forms of a value' WHEN 3 THEN '0/1: key repeats' ELSE '0/1/intValue: over 64 bits' END END AS location, count(*) AS spans
FROM x WHERE fault IS NOT NULL GROUP BY ALL
UNION ALL SELECT DISTINCT 'empty-user-' || user_id, CASE user_id % 2 WHEN 0 THEN 'no spans' ELSE 'no export' END, NULL, 1 FROM s WHERE user_id % 13 = 0""")
def otlp_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of the broken exports, with the place of those in attributes."""
    place = F.when((F.col("fault") == "resource attributes") | F.col("location").isNull(), F.when(F.col("fault") == "resource attributes", F.lit("0/1: key repeats"))).otherwise(F.col("location"))
    return otlp.faults(ev.otlp(spark, sf_dir, broken=True)).withColumn("location", place).groupBy("source_name", "fault", "location").agg(F.count("*").alias("spans"))


def archive(spark: SparkSession, sf_dir: str, records: Column, name: str) -> DataFrame:
    """A document of each conversation with a record for each assistant turn; records is a struct over turn, content and asked, the user's turn before."""
    m = ev.messages(spark, sf_dir)
    asked = m.where("role = 'user'").select("trace_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("asked"))
    pairs = m.where("role = 'assistant'").join(asked, ["trace_id", "turn"])
    docs = pairs.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", records.alias("record")))), lambda x: x["record"]).alias(name))
    return docs.select("trace_id", F.col("trace_id").alias("source_name"), F.to_json(F.struct(F.col("trace_id").alias("id"), F.lit("capsule").alias("capsule_id"), F.col(name).alias(name))).alias("document"))


def turn_text() -> Column:
    return F.col("turn").cast("string")


PAIRS = """
WITH p AS (
  SELECT 'conv-' || a.conv_id AS trace_id, a.turn, a.text AS answer, u.text AS asked, CAST(row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) - 1 AS INTEGER) AS rec
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.turn % 2 = 1),
"""


def response_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda t, c: F.array(F.struct(F.lit(t).alias("type"), F.col(c).alias("text")))
    asked = F.struct(F.concat(F.lit("u"), turn_text()).alias("id"), F.lit("message").alias("type"), F.lit("user").alias("role"), text("input_text", "asked").alias("content"))
    none = F.lit(None).cast("string")
    items = F.array(
        F.struct(F.concat(F.lit("fc"), turn_text()).alias("id"), F.lit("function_call").alias("type"), none.alias("role"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"), F.concat(F.lit("call"), turn_text()).alias("call_id"), F.lit("search").alias("name"), F.lit("{}").alias("arguments"), none.alias("output")),
        F.struct(F.concat(F.lit("fo"), turn_text()).alias("id"), F.lit("function_call_output").alias("type"), none.alias("role"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"), F.concat(F.lit("call"), turn_text()).alias("call_id"), none.alias("name"), none.alias("arguments"), F.lit("found").alias("output")),
        F.struct(F.concat(F.lit("a"), turn_text()).alias("id"), F.lit("message").alias("type"), F.lit("assistant").alias("role"), text("output_text", "content").alias("content"), none.alias("call_id"), none.alias("name"), none.alias("arguments"), none.alias("output")),
    )
    response = F.struct(F.concat(F.lit("resp"), turn_text()).alias("id"), F.unix_seconds("timestamp").cast("double").alias("created_at"), F.lit("be brief").alias("instructions"), items.alias("output"))
    return archive(spark, sf_dir, F.struct(F.array(asked, asked).alias("input_items"), response.alias("response")), "responses")


@register("response_archive_events", by_source(PAIRS + """
e AS (
  SELECT trace_id, -1 AS rec, 0 AS k, 'conversation.started' AS event_type, NULL AS role, NULL AS content, NULL AS tool_name, CAST(NULL AS BOOLEAN) AS linked_call FROM p WHERE rec = 0
  UNION ALL SELECT trace_id, rec, 0, 'message.observed', 'system', 'be brief', NULL, NULL FROM p WHERE rec = 0
  UNION ALL SELECT trace_id, rec, 1, 'message.observed', 'user', asked, NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 2, 'tool.called', NULL, '{}', 'search', NULL FROM p
  UNION ALL SELECT trace_id, rec, 3, 'tool.completed', NULL, 'found', 'search', true FROM p
  UNION ALL SELECT trace_id, rec, 4, 'message.observed', 'assistant', answer, NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 5, 'artifact.observed', NULL, NULL, NULL, NULL FROM p)
SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY rec, k) - 1 AS INTEGER) AS sequence, event_type, role, content, tool_name, linked_call FROM e"""))
def response_archive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.response_events(ev.again(response_archive(spark, sf_dir))).select("source_name", "trace_id", "sequence", "event_type", "role", "content", "tool_name", "linked_call")


PLANTED = PAIRS + "q AS (SELECT trace_id, CAST(substr(trace_id, 6) AS BIGINT) AS n FROM p GROUP BY ALL HAVING count(*) > 1) "


def planted(documents: DataFrame, *changes: tuple[str, str]) -> DataFrame:
    """Archives in which the first of some replacements is made in those of every so-manieth conversation, the second in those of the next, and so on."""
    way = F.substring_index("source_name", "-", -1).cast("long") % len(changes)
    out = F.col("document")
    for k, (pattern, new) in enumerate(changes):
        out = F.when(way == k, F.regexp_replace("document", pattern, new)).otherwise(out)
    return documents.withColumn("document", out)


@register("response_archive_consistency", PLANTED + "SELECT trace_id, CASE n % 3 WHEN 0 THEN 'response id repeats' WHEN 1 THEN 'time falls' ELSE 'call id with other name' END AS fault FROM q")
def response_archive_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives where all responses have one id, times run backwards, or one call has a name for each turn."""
    docs = planted(response_archive(spark, sf_dir), ('"resp[0-9]+"', '"resp"'), ('"created_at":1(\\.[0-9]+E9)', '"created_at":-1$1'), ('"call_id":"call([0-9]+)","name":"search"', '"call_id":"call","name":"search$1"'))
    return normalize.response_faults(docs).drop("source_name")


def message_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record repeats the system prompt and has a message whose content is a plain text."""
    part = lambda t, text=None, i=None, name=None, use=None, content=None: F.struct(F.lit(t).alias("type"), (F.col(text) if text else F.lit(None).cast("string")).alias("text"), (i if i is not None else F.lit(None).cast("string")).alias("id"), F.lit(name).cast("string").alias("name"), (use if use is not None else F.lit(None).cast("string")).alias("tool_use_id"), F.lit(content).cast("string").alias("content"), F.when(F.lit(t) == "tool_use", F.struct(F.lit("x").alias("q"))).alias("input"))
    call = F.concat(F.lit("call"), turn_text())
    asked = F.struct(F.concat(F.lit("u"), turn_text()).alias("id"), F.lit("user").alias("role"), F.array(part("text", "asked"), part("tool_result", use=F.concat(F.lit("call"), (F.col("turn") - 2).cast("string")), content="found")).alias("content"))
    plain = F.struct(F.concat(F.lit("s"), turn_text()).alias("id"), F.lit("user").alias("role"), F.array(F.struct(F.lit("plain").alias("type"), F.concat(F.lit("[plain] "), turn_text()).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("name", "string"), ("tool_use_id", "string"), ("content", "string"), ("input", "struct<q:string>"))))).alias("content"))
    answer = F.struct(F.concat(F.lit("a"), turn_text()).alias("id"), F.array(part("thinking"), part("text", "content"), part("tool_use", i=call, name="search")).alias("content"))
    record = F.struct(F.concat(F.lit("req"), turn_text()).alias("request_id"), "timestamp", F.lit("be brief").alias("system"), F.array(asked, plain).alias("messages"), answer.alias("response"))
    docs = archive(spark, sf_dir, record, "records")
    return docs.withColumn("document", F.regexp_replace("document", r'\[\{"type":"plain","text":("[^"]*")\}\]', "$1"))


@register("message_archive_events", by_source(PAIRS + """
e AS (
  SELECT trace_id, -1 AS rec, 0 AS k, 'conversation.started' AS event_type, NULL AS role, NULL AS content, NULL AS tool_name, CAST(NULL AS BOOLEAN) AS linked_call FROM p WHERE rec = 0
  UNION ALL SELECT trace_id, rec, 0.5, 'message.observed', 'system', 'be brief', NULL, NULL FROM p WHERE rec = 0
  UNION ALL SELECT trace_id, rec, 1, 'message.observed', 'user', CASE WHEN asked = '' THEN '' ELSE asked || chr(10) END || '[tool_result:call' || (turn - 2) || ']', NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 2, 'tool.completed', NULL, 'found', CASE WHEN rec > 0 THEN 'search' END, rec > 0 FROM p
  UNION ALL SELECT trace_id, rec, 2.5, 'message.observed', 'user', '[plain] ' || turn, NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 3, 'message.observed', 'assistant', '[thinking]' || chr(10) || CASE WHEN answer = '' THEN '' ELSE answer || chr(10) END || '[tool_use:search]', NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 4, 'artifact.observed', NULL, NULL, NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 5, 'tool.called', NULL, '{"q":"x"}', 'search', NULL FROM p
  UNION ALL SELECT trace_id, rec, 6, 'artifact.observed', NULL, NULL, NULL, NULL FROM p
  UNION ALL SELECT trace_id, max(rec), 7, 'artifact.observed', NULL, NULL, NULL, NULL FROM p GROUP BY trace_id)
SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY rec, k) - 1 AS INTEGER) AS sequence, event_type, role, content, tool_name, linked_call FROM e"""))
def message_archive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.message_events(ev.again(message_archive(spark, sf_dir))).select("source_name", "trace_id", "sequence", "event_type", "role", "content", "tool_name", "linked_call")


@register("message_archive_consistency", PLANTED + """
SELECT trace_id, CASE n % 6 WHEN 0 THEN 'response id repeats' WHEN 1 THEN 'time falls' WHEN 2 THEN 'message id with other content' WHEN 3 THEN 'tool id with other definition' WHEN 4 THEN 'content is neither text nor array' ELSE 'tool call without id, name or input' END AS fault FROM q
UNION ALL SELECT trace_id, 'message id with other content' FROM q WHERE n % 6 = 0
UNION ALL SELECT trace_id, CASE CAST(substr(trace_id, 6) AS BIGINT) % 6 WHEN 4 THEN 'content is neither text nor array' ELSE 'tool call without id, name or input' END FROM p WHERE CAST(substr(trace_id, 6) AS BIGINT) % 6 IN (4, 5) GROUP BY trace_id HAVING count(*) = 1""")
def message_archive_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives broken in six ways: one id for all responses (and so for different messages), times that fall, one id for all plain messages, one tool id for different inputs, a content that is a number, a tool call without a name."""
    docs = planted(message_archive(spark, sf_dir), ('"id":"a[0-9]+"', '"id":"a"'), ("nothing of this", ""), ('"id":"s[0-9]+"', '"id":"s"'), ('"id":"call([0-9]+)","name":"search","input":\\{"q":"x"', '"id":"call","name":"search","input":{"q":"$1"'), ('"content":"\\[plain\\] ([0-9]+)"', '"content":$1'), ('"name":"search"', '"name":""'))
    way = F.substring_index("source_name", "-", -1).cast("long") % 6
    start = F.substring_index("document", '"request_id"', 2)  # the first record keeps its time
    fallen = F.concat(start, F.regexp_replace(F.right("document", F.length("document") - F.length(start)), '"timestamp":"2024', '"timestamp":"1999'))
    return normalize.message_faults(docs.withColumn("document", F.when(way == 1, fallen).otherwise(F.col("document")))).drop("source_name")


def content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers have a thought, code, and a part that holds a text, a null call in snake case and, to be ignored, a call in camel case."""
    call = F.struct(F.concat(F.lit("call"), turn_text()).alias("id"), F.lit("search").alias("name"), F.struct(F.lit("x").alias("q")).alias("args"))
    result = F.struct(F.concat(F.lit("call"), turn_text()).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("found").alias("response"))
    code = F.struct(F.concat(F.lit("code"), turn_text()).alias("id"), F.lit("PYTHON").alias("language"), F.lit("1+1").alias("code"))
    none = F.lit(None)
    part = lambda text=none, c=none, r=none, x=none, thought=none: F.struct(text.cast("string").alias("text"), c.cast("struct<id:string,name:string,args:struct<q:string>>").alias("functionCall"), r.cast("struct<id:string,name:string,response:string>").alias("function_response"), x.cast("struct<id:string,language:string,code:string>").alias("executable_code"), thought.cast("boolean").alias("thought"))
    asked = F.struct(F.concat(F.lit("u"), turn_text()).alias("id"), F.lit("user").alias("role"), F.array(part(F.col("asked")), part(r=result)).alias("parts"))
    content = F.struct(F.lit("model").alias("role"), F.array(part(F.lit("why"), thought=F.lit(True)), part(F.col("content")), part(c=call), part(x=code), part(F.lit("noted"), c=call, thought=F.lit(False))).alias("parts"))
    response = F.struct(F.concat(F.lit("resp"), turn_text()).alias("responseId"), F.array(F.struct(F.lit(0).alias("index"), F.lit("STOP").alias("finishReason"), content.alias("content"))).alias("candidates"))
    record = F.struct(F.concat(F.lit("req"), turn_text()).alias("request_id"), "timestamp", F.array(asked).alias("contents"), F.array(F.concat(F.lit("a"), turn_text())).alias("candidate_ids"), response.alias("response"))
    return archive(spark, sf_dir, record, "records").withColumn("document", F.regexp_replace("document", '"thought":false', '"function_call":null'))


@register("content_archive_events", by_source(PAIRS + """
e AS (
  SELECT trace_id, -1 AS rec, 0 AS k, 'conversation.started' AS event_type, NULL AS role, NULL AS content, NULL AS tool_name, CAST(NULL AS BOOLEAN) AS linked_call FROM p WHERE rec = 0
  UNION ALL SELECT trace_id, rec, 1, 'message.observed', 'user', asked || chr(10) || '[function_response:unknown]', NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 2, 'tool.completed', NULL, 'found', 'search', true FROM p
  UNION ALL SELECT trace_id, rec, 3, 'message.observed', 'model', '[thought]' || chr(10) || answer || chr(10) || '[function_call:search]' || chr(10) || '[executable_code]' || chr(10) || 'noted', NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 4, 'artifact.observed', NULL, NULL, NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 5, 'tool.called', NULL, '{"q":"x"}', 'search', NULL FROM p
  UNION ALL SELECT trace_id, rec, 6, 'tool.called', NULL, '1+1', 'code_execution', NULL FROM p
  UNION ALL SELECT trace_id, rec, 7, 'artifact.observed', NULL, 'STOP', NULL, NULL FROM p
  UNION ALL SELECT trace_id, rec, 8, 'artifact.observed', NULL, NULL, NULL, NULL FROM p
  UNION ALL SELECT trace_id, max(rec), 9, 'artifact.observed', NULL, NULL, NULL, NULL FROM p GROUP BY trace_id)
SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY rec, k) - 1 AS INTEGER) AS sequence, event_type, role, content, tool_name, linked_call FROM e"""))
def content_archive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.content_events(ev.again(content_archive(spark, sf_dir))).select("source_name", "trace_id", "sequence", "event_type", "role", "content", "tool_name", "linked_call")


@register("content_archive_consistency", PLANTED + """
SELECT trace_id, 'part with several fields' AS fault FROM q
UNION ALL SELECT trace_id, CASE n % 5 WHEN 0 THEN 'response id repeats' WHEN 1 THEN 'candidate ids don''t fit' WHEN 2 THEN 'call id with other definition' WHEN 3 THEN 'part without an observable field' ELSE 'candidate of another role' END FROM q WHERE n % 5 <> 3
UNION ALL SELECT trace_id, 'message id with other content' FROM q WHERE n % 5 = 1
UNION ALL SELECT trace_id, 'part with several fields' FROM p GROUP BY trace_id HAVING count(*) = 1
UNION ALL SELECT trace_id, CASE CAST(substr(trace_id, 6) AS BIGINT) % 5 WHEN 1 THEN 'candidate ids don''t fit' ELSE 'candidate of another role' END FROM p WHERE CAST(substr(trace_id, 6) AS BIGINT) % 5 IN (1, 4) GROUP BY trace_id HAVING count(*) = 1""")
def content_archive_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that all have a part with two fields, and are broken in further ways: one id for all responses, a candidate id too many (so that all candidates have one id), one call id for different arguments, a candidate of another role."""
    docs = planted(content_archive(spark, sf_dir), ('"resp[0-9]+"', '"resp"'), ('"candidate_ids":\\[', '"candidate_ids":["more",'), ('"id":"call([0-9]+)","name":"search","args":\\{"q":"x"', '"id":"call","name":"search","args":{"q":"$1"'), ("nothing of this", ""), ('"content":\\{"role":"model"', '"content":{"role":"user"'))
    return normalize.content_faults(docs).drop("source_name")


@register("capture_consistency", "WITH c AS (SELECT conv_id, turn, turn % 5 = 4 AS bad, text FROM conversations) SELECT 'cap-' || conv_id AS capture_id, 'o' || turn AS id, CASE WHEN turn % 7 = 6 THEN 'kind of another client' WHEN bad THEN 'digest' END AS fault FROM c")
def capture_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.messages(spark, sf_dir)
    o = F.struct("turn", F.concat(F.lit("o"), turn_text()).alias("id"), F.when(F.col("turn") % 7 == 6, "editor.selection").otherwise("browser.selection").alias("kind"), "timestamp", "content", F.sha2(F.when(F.col("turn") % 5 == 4, F.lit("other")).otherwise(F.col("content")), 256).alias("content_sha256"))
    docs = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(o)).alias("observations"))
    document = F.to_json(F.struct(F.concat(F.lit("cap-"), F.col("conv_id").cast("string")).alias("id"), F.lit("browser").alias("client"), "observations"))
    return normalize.capture_observations(docs.select(F.lit("capture").alias("source_name"), document.alias("document"))).select("capture_id", "id", "fault")


# Privacy ---------------------------------------------------------------------

RESIDUALS = r"""
SELECT DISTINCT location, kind, detector, NULL AS rule_id, sha256(raw) AS digest FROM (
  SELECT {key} AS location, 'email' AS kind, 'email' AS detector, unnest(regexp_extract_all({text}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,63}}\b')) AS raw FROM {table}
  UNION ALL SELECT {key}, 'secret', 'openai_api_key', unnest(regexp_extract_all({text}, '\bsk-[A-Za-z0-9_-]{{12,}}\b')) FROM {table}
  UNION ALL SELECT {key}, 'secret', 'github_token', unnest(regexp_extract_all({text}, '\bgh[pousr]_[A-Za-z0-9_]{{20,}}\b')) FROM {table}
  UNION ALL SELECT {key}, 'secret', 'bearer', unnest(regexp_extract_all({text}, '(?i)(\bBearer\s+)([A-Za-z0-9._~+/=-]{{12,}})', 2)) FROM {table}
  UNION ALL SELECT {key}, 'secret', 'assignment', unnest(regexp_extract_all({text}, '(?i)(\b(?:api[_-]?key|access[_-]?token|secret|password)\b\s*[:=]\s*["'']?)([^\s,"'']{{8,}})', 2)) FROM {table})
"""
NATIVE = ("assignment", "bearer", "openai_api_key", "github_token", "email")


@register("residual_scan", RESIDUALS.format(key="doc_id", text="text", table="documents"))
def residual_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.scan(ev.table(spark, sf_dir, "documents"), "doc_id", "text", only=NATIVE)


@register("residual_scan_phones")
def residual_scan_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones need a look behind, which the oracle's patterns don't have; the tests compare with Python's."""
    return privacy.scan(ev.table(spark, sf_dir, "documents"), "doc_id", "text", only=("phone",))


@register("redaction")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = privacy.redact(ev.table(spark, sf_dir, "documents"), "text")
    return r.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size("redactions").alias("redactions"))


@register("redaction_leaves_nothing", "SELECT source, count(*) AS found, CAST(0 AS BIGINT) AS left_over FROM (" + RESIDUALS.format(key="doc_id", text="text", table="documents") + ") r JOIN documents ON doc_id = location GROUP BY source")
def redaction_leaves_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by source before redaction (but for phones, see above), and after it with all detectors."""
    docs = ev.table(spark, sf_dir, "documents")
    sources = docs.select(F.col("doc_id").alias("location"), "source")
    before = privacy.scan(docs, "doc_id", "text", only=NATIVE).join(sources, "location").groupBy("source").agg(F.count("*").alias("found"))
    after = privacy.scan(privacy.redact(docs, "text"), "doc_id", "text").join(sources, "location").groupBy("source").agg(F.count("*").alias("left_over"))
    return before.join(after, "source", "left").select("source", "found", F.coalesce("left_over", F.lit(0)).alias("left_over"))


@register("event_redaction", """
WITH m AS (SELECT 'conv-' || conv_id AS trace_id, turn AS sequence, 'user' || conv_id || '@example.org' AS mail FROM conversations)
SELECT trace_id, sequence, 'write to <redacted:email:' || left(sha256(mail), 12) || '> now' AS content, '{"deep":[{"<redacted:email:' || left(sha256(mail), 12) || '>":1},"token <redacted:secret:' || left(sha256('sk-abcdefghijkl' || sequence), 12) || '>"]}' AS payload,
       '/events/' || sequence || '/content,/events/' || sequence || '/payload/<value:0>/0/<key:0>,/events/' || sequence || '/payload/<value:0>/1' AS places FROM m""")
def event_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a mail address in their text, and one as a key and a token as a value of their payload."""
    m = ev.messages(spark, sf_dir)
    mail = F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.org"))
    e = m.select("trace_id", F.col("turn").alias("sequence"), F.concat(F.lit("write to "), mail, F.lit(" now")).alias("content"), F.concat(F.lit('{"deep":[{"'), mail, F.lit('":1},"token sk-abcdefghijkl'), F.col("turn").cast("string"), F.lit('"]}')).alias("payload"))
    return privacy.redact_events(e, ["content"], ["payload"]).select("trace_id", "sequence", "content", "payload", F.array_join(F.transform("redactions", lambda r: r["location"]), ",").alias("places"))


@register("redaction_review")
def redaction_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ev.table(spark, sf_dir, "documents")
    r = privacy.review(privacy.redact(docs, "text"), privacy.scan(docs, "doc_id", "text"))
    return r.withColumn("counts_by_kind", map_text("counts_by_kind")).withColumn("counts_by_rule", map_text("counts_by_rule"))


def sensitive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose payloads hold a mail address and a mark of our own, escaped in JSON: after an escaped line break, as a key, and in a text that is no JSON."""
    m = ev.messages(spark, sf_dir)
    n = F.col("conv_id").cast("string")
    mail, mark = F.concat(F.lit("user"), n, F.lit("\\u0040example.org")), F.concat(F.lit("ACME"), n, F.lit("-ACME"), n)
    payload = F.concat(F.lit('{"a":["line\\n'), mail, F.lit('",{"'), mail, F.lit('":"'), mark, F.lit('"},{"k":1}],"b":"plain"}'))
    return m.select("trace_id", F.col("turn").alias("sequence"), F.concat(F.lit("token sk-abcdefghijkl"), F.col("turn").cast("string")).alias("content"), F.when(F.col("turn") % 5 == 4, F.concat(F.lit("{ "), mark)).otherwise(payload).alias("payload"))


#: A rule that only Python's expressions have.
MARKS = privacy.Policy(rules=(privacy.Rule("mark", r"(?P<tag>acme\d+)-(?P=tag)", "i"),))
EVENT_FINDINGS = """
WITH m AS (SELECT 'conv-' || conv_id AS trace_id, '/events/' || turn AS place, turn, 'user' || conv_id || '@example.org' AS mail, 'ACME' || conv_id || '-ACME' || conv_id AS mark FROM conversations),
f AS (
  SELECT trace_id, place || '/content' AS location, 'secret' AS kind, 'openai_api_key' AS detector, NULL AS rule_id, 'sk-abcdefghijkl' || turn AS raw FROM m
  UNION ALL SELECT trace_id, place || '/payload/<value:0>/0', 'email', 'email', NULL, mail FROM m WHERE turn % 5 <> 4
  UNION ALL SELECT trace_id, place || '/payload/<value:0>/1/<key:0>', 'email', 'email', NULL, mail FROM m WHERE turn % 5 <> 4
  UNION ALL SELECT trace_id, place || CASE WHEN turn % 5 = 4 THEN '/payload' ELSE '/payload/<value:0>/1/<value:0>' END, 'custom', 'custom:mark', 'mark', mark FROM m)
"""


@register("event_residuals", EVENT_FINDINGS + "SELECT trace_id, location, kind, detector, rule_id, sha256(raw) AS digest FROM f")
def event_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.event_residuals(sensitive_events(spark, sf_dir), ["content"], ["payload"], MARKS)


@register("review_only", EVENT_FINDINGS + "SELECT false AS redaction_enabled, CAST(0 AS BIGINT) AS total_redactions, count(*) AS residual_findings, 'pattern_matching_cannot_prove_complete_deidentification,redaction_disabled_review_only,custom_rules_are_trusted_python_regular_expressions,residual_sensitive_patterns_detected' AS warnings FROM f")
def review_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review of events that were left as they are."""
    r = privacy.apply_policy(sensitive_events(spark, sf_dir), ["content"], ["payload"], MARKS, enabled=False)[2]
    return r.select("redaction_enabled", "total_redactions", "residual_findings", F.array_join("warnings", ",").alias("warnings"))


# Evaluation ------------------------------------------------------------------

LABELLED = "WITH e AS (SELECT 'doc-' || doc_id AS example_id, '{\"toxic\":' || toxic || '}' AS outputs, '{\"toxic\":0}' AS b, '{\"toxic\":' || (CASE WHEN quality = 0 THEN 1 ELSE 0 END) || '}' AS c, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'sealed_test' END AS role FROM labels) "


@register("partition_verification", LABELLED + "SELECT count(DISTINCT role) AS roles, count(*) AS examples, CAST(0 AS BIGINT) AS faults FROM e")
def partition_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound split: its roles, its examples, and no faults."""
    split = ev.split(spark, sf_dir)
    faults = evaluation.partition_faults(split, ev.examples(spark, sf_dir)).agg(F.count("*").alias("faults"))
    return split.agg(F.count_distinct("role").alias("roles"), F.count("*").alias("examples")).crossJoin(faults)  # a row each


@register("partition_faults", LABELLED + "SELECT example_id, 'missing' AS fault FROM e WHERE role = 'validation' UNION ALL SELECT example_id, 'overlap' FROM e WHERE role = 'train' UNION ALL SELECT 'doc-' || doc_id, 'unknown' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def partition_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that lacks the validation role, has the training one twice over, and names unlabelled documents."""
    s = ev.split(spark, sf_dir)
    extra = ev.table(spark, sf_dir, "documents").join(ev.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("example_id"), F.lit("train").alias("role"))
    broken = s.where("role <> 'validation'").unionByName(s.where("role = 'train'").withColumn("role", F.lit("sealed_test"))).unionByName(extra)
    return evaluation.partition_faults(broken, ev.examples(spark, sf_dir))


@register("partition_counts", LABELLED + "SELECT role, count(*) AS examples, min(example_id) AS first_id, max(example_id) AS last_id FROM e GROUP BY role")
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.partition_counts(ev.split(spark, sf_dir))


@register("partition_export", LABELLED + "SELECT example_id FROM e WHERE role = 'sealed_test'")
def partition_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.export_partition(ev.split(spark, sf_dir), ev.examples(spark, sf_dir).select("example_id", "outputs"), "sealed_test")


@register("sealed_score", LABELLED + "SELECT 'baseline' AS variant_id, count(*) FILTER (b = outputs) AS correct, count(*) AS total, avg(CAST(b = outputs AS DOUBLE)) AS score FROM e WHERE role = 'sealed_test' UNION ALL SELECT 'candidate', count(*) FILTER (c = outputs), count(*), avg(CAST(c = outputs AS DOUBLE)) FROM e WHERE role = 'sealed_test'")
def sealed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sealed_score(ev.split(spark, sf_dir), ev.examples(spark, sf_dir), ev.predictions(spark, sf_dir), "variant_id")


@register("prediction_coverage", "SELECT 'doc-' || doc_id AS example_id, 'missing' AS fault FROM labels WHERE doc_id % 3 = 1 UNION ALL SELECT 'doc-' || doc_id, 'unexpected' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def prediction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents but those of the validation role, against the labelled ones."""
    named = ev.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("example_id"))
    held = ev.split(spark, sf_dir).where("role = 'validation'")
    return evaluation.coverage(ev.examples(spark, sf_dir), named.join(held, "example_id", "left_anti"), "example_id")


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.predictions(spark, sf_dir)
    truth = ev.examples(spark, sf_dir).select("example_id", "outputs").join(ev.split(spark, sf_dir), "example_id")
    return evaluation.paired_comparison(truth, p.where("variant_id = 'baseline'"), p.where("variant_id = 'candidate'"), "role")


@register("paired_comparison", LABELLED + "SELECT role, count(*) AS total, count(*) FILTER (b = outputs AND c = outputs) AS both_correct, count(*) FILTER (b = outputs AND c <> outputs) AS baseline_only_correct, count(*) FILTER (b <> outputs AND c = outputs) AS candidate_only_correct, count(*) FILTER (b <> outputs AND c <> outputs) AS neither_correct, avg(CAST(b = outputs AS DOUBLE)) AS baseline_score, avg(CAST(c = outputs AS DOUBLE)) AS candidate_score FROM e GROUP BY role")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir)


TAIL = "CASE WHEN c <= b THEN 1.0 ELSE list_sum(list_transform(range(c, c + b + 1), lambda k: exp(lgamma(c + b + 1) - lgamma(k + 1) - lgamma(c + b - k + 1) - (c + b) * ln(2)))) END"
GATES = LABELLED + f"""
, t AS (SELECT role, count(*) AS n, count(*) FILTER (c = outputs AND b = outputs) AS wins, count(*) FILTER (c = outputs AND b <> outputs) AS c, count(*) FILTER (b = outputs AND c <> outputs) AS b FROM e GROUP BY role),
g AS (SELECT *, {TAIL} AS p FROM t),
k AS (SELECT role, n, c + b AS pairs, (c - b) / n AS gain, p, concat_ws(',', CASE WHEN n < 10 THEN 'too few examples' END, CASE WHEN c <= b THEN 'no gain' END, CASE WHEN (wins + c) / n < 0.5 THEN 'score too low' END, CASE WHEN (c - b) / n < 0.01 THEN 'gain too small' END, CASE WHEN c + b < 5 THEN 'too few discordant pairs' END, CASE WHEN p > 0.05 THEN 'chance too likely' END) AS reasons FROM g)
"""


@register("promotion_gates", GATES + "SELECT role, reasons = '' AS passed, n AS total, round(gain, 9) AS absolute_improvement, pairs AS discordant_pairs, round(p, 6) AS one_sided_p_value, reasons FROM k")
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(spark, sf_dir).withColumns({"absolute_improvement": F.round("absolute_improvement", 9), "one_sided_p_value": F.round("one_sided_p_value", 6), "reasons": F.array_join("reasons", ",")})


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(r, 10, 0.5, 0.01, 5, 0.05) for r in evaluation.ROLES], "role string, min_total long, min_candidate_score double, min_absolute_improvement double, min_discordant_pairs long, max_one_sided_p_value double")
    return evaluation.promotion_checks(rules, comparison(spark, sf_dir))


@register("promotion_decision", GATES + "SELECT CASE WHEN bool_and(reasons = '') THEN 'promote' ELSE 'reject' END AS decision, count(*) AS rules, count(*) FILTER (reasons = '') AS rules_passed FROM k")
def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.promotion_decision(gates(spark, sf_dir))


@register("mcnemar_tails", f"WITH t AS (SELECT n_nationkey AS c, r_regionkey * 4 AS b FROM nation, region) SELECT c, b, round({TAIL}, 9) AS p FROM t")
def mcnemar_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact tail of each nation's number of wins against four times each region's."""
    pairs = ev.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c")).crossJoin(F.broadcast(ev.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 4).alias("b"))))  # 25 by 5 rows
    return pairs.select("c", "b", F.round(scalars.mcnemar_p("c", "b"), 9).alias("p"))


@register("promotion_materialized", "SELECT 'v' || n_nationkey AS variant_id FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0")
def promotion_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of which every third is promoted, while every second one's document was changed after the decision."""
    n = ev.table(spark, sf_dir, "nation")
    variant, plain = F.concat(F.lit("v"), F.col("n_nationkey").cast("string")), F.to_json(F.struct(F.col("n_name").alias("name")))
    decided = n.select(variant.alias("variant_id"), F.sha2(plain, 256).alias("variant_sha256"), F.when(F.col("n_nationkey") % 3 == 0, "promote").otherwise("reject").alias("decision"))
    documents = n.select(variant.alias("variant_id"), F.sha2(plain, 256).alias("variant_sha256"), F.when(F.col("n_nationkey") % 2 == 1, F.to_json(F.struct(F.lit("other").alias("name")))).otherwise(F.concat(F.lit(" "), plain)).alias("document"))
    return evaluation.materialize(decided, documents).select("variant_id")


def variant_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A variant document of each supplier, bound to the capsule of its nation; every fifth names another capsule, every seventh is no JSON. Keys stand in another order than the canonical one."""
    n, s = ev.table(spark, sf_dir, "nation"), ev.table(spark, sf_dir, "supplier")
    capsule = lambda key: F.concat(F.lit('{"id":"n'), key.cast("string"), F.lit('","goal":"g"}'))
    canonical = lambda key: F.concat(F.lit('{"goal":"g","id":"n'), key.cast("string"), F.lit('"}'))
    key = F.col("s_suppkey").cast("string")
    base = F.when(F.col("s_suppkey") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(canonical(F.col("s_nationkey")), 256))
    document = F.concat(F.lit('{"variant": {"tools":{},"id":"v'), key, F.lit('","env":{"K":"'), key, F.lit('"}}, "base_capsule_sha256":"'), base, F.lit('"'), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise("}"))
    return s.select(key.alias("source_name"), document.alias("document")), n.select(capsule(F.col("n_nationkey")).alias("document"))


#: Variants of variant_documents() in canonical form.
VARIANTS = """
WITH v AS (SELECT s_suppkey AS k, '{"env":{"K":"' || s_suppkey || '"},"id":"v' || s_suppkey || '","tools":{}}' AS variant, CASE WHEN s_suppkey % 5 = 0 THEN sha256('other') ELSE sha256('{"goal":"g","id":"n' || s_nationkey || '"}') END AS base FROM supplier),
x AS (SELECT k, base, sha256(variant) AS variant_sha256, sha256('{"base_capsule_sha256":"' || base || '","variant":' || variant || '}') AS document_sha256, k % 7 = 0 AS broken FROM v)
"""


@register("variant_binding", VARIANTS + """SELECT CAST(k AS VARCHAR) AS source_name, CASE WHEN NOT broken THEN 'v' || k END AS variant_id, CASE WHEN NOT broken THEN document_sha256 END AS document_sha256, CASE WHEN NOT broken THEN variant_sha256 END AS variant_sha256, CASE WHEN NOT broken THEN base END AS base_capsule_sha256,
CASE WHEN broken THEN '' ELSE 'env,tools' END AS dimensions, CASE WHEN broken THEN 'no strict JSON' WHEN k % 5 = 0 THEN 'capsule is another or missing' END AS fault FROM x""")
def variant_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.verify_variants(*variant_documents(spark, sf_dir)).withColumn("dimensions", F.array_join("dimensions", ","))


@register("promotion_receipts", VARIANTS + """,
p AS (SELECT *, '{"baseline_variant_id":"v1","baseline_variant_sha256":"' || (SELECT variant_sha256 FROM x WHERE k = 1) || '","candidate_variant_id":"v' || k || '","candidate_variant_sha256":"' || variant_sha256 || '","decision":"' || CASE WHEN k % 6 = 1 THEN 'reject' ELSE 'promote' END || '"}' AS decision FROM x),
q AS (SELECT *, CASE WHEN k % 6 = 2 THEN sha256('none') ELSE sha256(decision) END AS d, CASE WHEN k % 6 = 3 THEN 'v0' ELSE 'v' || k END AS active, CASE WHEN k % 6 = 4 THEN 'v2' ELSE 'v1' END AS target FROM p)
SELECT CAST(k AS VARCHAR) AS source_name, d AS promotion_decision_sha256, sha256('{"active_variant_id":"' || active || '","active_variant_sha256":"' || variant_sha256 || '","promotion_decision_sha256":"' || d || '","target_variant_id":"' || target || '","target_variant_sha256":"' || (SELECT variant_sha256 FROM x WHERE k = 1) || '"}') AS rollback_plan_sha256,
       active AS active_variant_id, target AS previous_variant_id,
       CASE k % 6 WHEN 2 THEN 'plan of no known decision' WHEN 1 THEN 'decision does not promote' WHEN 3 THEN 'active variant is not the candidate' WHEN 4 THEN 'target is not the baseline' ELSE CASE WHEN broken OR k % 5 = 0 THEN 'active variant is not verified' END END AS fault
FROM q""")
def promotion_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision and a rollback plan for each supplier's variant against the first one's, with a link broken at every step by turns."""
    v = binding.verify_variants(*variant_documents(spark, sf_dir)).where("fault is null").select("variant_id", "variant_sha256")
    s = ev.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    sha = lambda key: F.sha2(F.concat(F.lit('{"env":{"K":"'), key.cast("string"), F.lit('"},"id":"v'), key.cast("string"), F.lit('","tools":{}}')), 256)
    named = lambda key: F.concat(F.lit("v"), key.cast("string"))
    one = F.lit(1)
    decision = F.to_json(F.struct(named(one).alias("baseline_variant_id"), sha(one).alias("baseline_variant_sha256"), named(k).alias("candidate_variant_id"), sha(k).alias("candidate_variant_sha256"), F.when(k % 6 == 1, "reject").otherwise("promote").alias("decision")))
    digest = F.when(k % 6 == 2, F.sha2(F.lit("none"), 256)).otherwise(F.sha2(decision, 256))
    plan = F.to_json(F.struct(digest.alias("promotion_decision_sha256"), F.when(k % 6 == 3, "v0").otherwise(named(k)).alias("active_variant_id"), sha(k).alias("active_variant_sha256"), F.when(k % 6 == 4, "v2").otherwise("v1").alias("target_variant_id"), sha(one).alias("target_variant_sha256")))
    made = s.select(k.cast("string").alias("source_name"), F.concat(F.lit(" "), decision).alias("decision"), plan.alias("plan"))
    return binding.promotion_receipts(made.select(F.col("decision").alias("document")), made.select("source_name", F.col("plan").alias("document")), v).drop("active_variant_sha256", "previous_variant_sha256")


@register("memory_digest", BASE + ", z AS (" + VIEW_SQL["failure_taxonomy"] + """), y AS (SELECT failure_category, failure_code, occurrences, runs, capsules FROM z ORDER BY occurrences DESC, failure_category, failure_code LIMIT 5)
SELECT 'failure_taxonomy' AS view, count(*) AS row_count, sha256('{"rows":[' || string_agg('{"capsules":' || capsules || ',"failure_category":"' || failure_category || '","failure_code":"' || failure_code || '","occurrences":' || occurrences || ',"runs":' || runs || '}', ',' ORDER BY occurrences DESC, failure_category, failure_code)
       || '],"store_schema_version":"1","store_source_count":' || (SELECT count(DISTINCT o_orderkey % 16) FROM orders) || ',"view":"failure_taxonomy"}') AS memory_sha256 FROM y""")
def memory_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the taxonomy's first five rows, without its mean."""
    tables = ev.store_tables(spark, sf_dir)
    rows = views.query(tables, "failure_taxonomy", 5).select("failure_category", "failure_code", "occurrences", "runs", "capsules")
    return binding.view_digest(rows, "failure_taxonomy", "1", tables["sources"])


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset for each language: labelled documents, their source and number as inputs, their label as an output."""
    d = ev.table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(ev.table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.coalesce("lang", F.lit("-")).alias("dataset_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("example_id"), F.create_map(F.lit("source"), F.col("source"), F.lit("number"), F.col("doc_id").cast("string")).alias("inputs"), F.create_map(F.lit("toxic"), F.col("toxic").cast("string")).alias("outputs"))


DATASETS = "WITH e AS (SELECT coalesce(lang, '-') AS dataset_id, 'doc-' || doc_id AS example_id, source, CAST(doc_id AS VARCHAR) AS number, toxic FROM documents JOIN labels USING (doc_id)) "


@register("dataset_signature", DATASETS + "SELECT count(*) AS examples, CAST(1 AS BIGINT) AS input_signatures, CAST(1 AS BIGINT) AS output_signatures, CAST(0 AS BIGINT) AS overlapping FROM e")
def dataset_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.dataset_signature(datasets(spark, sf_dir))


@register("dataset_public_digest", DATASETS + """SELECT dataset_id, count(*) AS examples, sha256('{"examples":[' || string_agg('{"id":"' || example_id || '","inputs":{"number":"' || number || '","source":"' || source || '"}}', ',' ORDER BY example_id) || '],"input_fields":["number","source"]}') AS public_sha256 FROM e GROUP BY dataset_id""")
def dataset_public_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.public_digest(datasets(spark, sf_dir), "dataset_id")


@register("dataset_payloads", DATASETS + "SELECT example_id, 'number=' || number || ',source=' || source || ',toxic=' || toxic AS fields, 'number,source' AS input_keys FROM e")
def dataset_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.payloads(datasets(spark, sf_dir)).select("example_id", map_text("fields").alias("fields"), F.array_join("input_keys", ",").alias("input_keys"))


@register("output_keys", LABELLED + "SELECT example_id, CASE WHEN role = 'train' THEN 'toxic' ELSE '' END AS missing, CASE WHEN role = 'train' THEN 'tocsic' ELSE 'more' END AS unexpected FROM e WHERE role <> 'sealed_test'")
def output_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs whose key is misspelt in the training role, and that have a further one in validation."""
    o = ev.examples(spark, sf_dir).join(ev.split(spark, sf_dir), "example_id")
    broken = F.when(F.col("role") == "train", F.replace("outputs", F.lit("toxic"), F.lit("tocsic"))).when(F.col("role") == "validation", F.replace("outputs", F.lit("{"), F.lit('{"more":1,'))).otherwise(F.col("outputs"))
    return evaluation.output_key_faults(o.withColumn("outputs", broken), ["toxic"]).select("example_id", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


@register("rollback_triggers", """
WITH w AS (SELECT event_type AS metric, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, avg(value) AS observed_value, count(*) AS samples FROM events GROUP BY ALL),
t(trigger_id, metric, op, threshold, min_samples) AS (VALUES ('errors-high', 'error', 'gte', 50.0, 2), ('purchases-low', 'purchase', 'lt', 40.0, 1))
SELECT trigger_id, w.metric, window_start, observed_value, samples FROM w JOIN t ON t.metric = w.metric WHERE samples >= min_samples AND CASE op WHEN 'gte' THEN observed_value >= threshold ELSE observed_value < threshold END""")
def rollback_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = spark.createDataFrame([("errors-high", "error", "gte", 50.0, 2, 3600), ("purchases-low", "purchase", "lt", 40.0, 1, 3600), ("views-never", "view", "lt", 1e9, 1, 60)], "trigger_id string, metric string, operator string, threshold double, min_samples long, window_seconds int")
    events = ev.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "ts", "value")
    return evaluation.rollback_events(rollback.windowed_metrics(events, 3600), triggers).select("trigger_id", "metric", "window_start", "observed_value", "samples")


DIALOGUE = """
WITH t AS (SELECT 'user-' || user_id AS task_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS turn, event_type, value, event_id FROM events),
u AS (SELECT task_id, turn, 'u' || event_id AS update_id, CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END AS key, event_type <> 'error' AS sets, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value FROM t),
p AS (SELECT task_id, 'p' || turn AS probe_id, turn, event_type, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value FROM t WHERE turn % 10 = 0),
s AS (SELECT p.task_id, p.probe_id, u.key, arg_max(u.sets, u.turn) AS sets, arg_max(coalesce(u.value, '-'), u.turn) AS value FROM p JOIN u ON u.task_id = p.task_id AND u.turn <= p.turn GROUP BY ALL),
x AS (SELECT task_id, probe_id, string_agg(key || '=' || value, ',' ORDER BY key) AS expected FROM s WHERE sets GROUP BY ALL),
y AS (SELECT p.task_id, p.probe_id, coalesce(expected, '') AS expected, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN '' ELSE event_type || '=' || coalesce(value, '-') END AS given FROM p LEFT JOIN x USING (task_id, probe_id))
"""


def pairs_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))), ",")


@register("probe_states", DIALOGUE + "SELECT task_id, probe_id, expected FROM y")
def probe_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates, probes, _ = ev.dialogue(spark, sf_dir)
    return evaluation.probe_states(updates, probes).withColumn("expected", pairs_text("expected"))


@register("dialogue_score", DIALOGUE + "SELECT task_id, count(*) AS total, count(given) AS submitted, count(*) FILTER (given = expected) AS correct, avg(CAST(coalesce(given = expected, false) AS DOUBLE)) AS score FROM y GROUP BY ROLLUP (task_id)")
def dialogue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates, probes, known = ev.dialogue(spark, sf_dir)
    return evaluation.dialogue_score(evaluation.probe_states(updates, probes), known)


@register("prediction_faults", DIALOGUE + """SELECT task_id, probe_id, fault FROM (
  SELECT 'user-' || user_id AS task_id, 'p' || n AS probe_id, CASE WHEN n % 40 = 0 THEN 'repeated' WHEN n % 40 = 10 THEN 'undeclared key' END AS fault FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 10 = 0 AND event_type <> 'signup'
  UNION ALL SELECT DISTINCT 'user-' || user_id, 'none', 'unknown probe' FROM events WHERE user_id % 5 = 0) WHERE fault IS NOT NULL""")
def prediction_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of which some are there twice, some name a key of no update, and some a probe that is none."""
    updates, probes, known = ev.dialogue(spark, sf_dir)
    n = F.substring("probe_id", 2, 9).cast("int")
    odd = known.withColumn("active_constraints", F.when(n % 40 == 10, F.array(F.struct(F.lit("no such key").alias("key"), F.lit("1").alias("value")))).otherwise(F.col("active_constraints")))
    odd = odd.unionByName(odd.where(n % 40 == 0)).unionByName(updates.where("substring(task_id, 6) % 5 = 0").select("task_id").distinct().select("task_id", F.lit("none").alias("probe_id"), F.array().cast("array<struct<key:string,value:string>>").alias("active_constraints")))
    return evaluation.dialogue_faults(probes, updates.select("task_id", "key").distinct(), odd)


@register("supersede_check", DIALOGUE + ", a AS (SELECT *, lag(update_id) OVER w AS b, lag(sets) OVER w AS bs FROM u WINDOW w AS (PARTITION BY task_id, key ORDER BY turn)) SELECT task_id, update_id FROM a WHERE b IS NOT NULL AND bs OR (NOT sets AND NOT coalesce(bs, false))")
def supersede_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates name none that they supersede: each that follows an active one is at fault, and each revoke of nothing."""
    updates, _, _ = ev.dialogue(spark, sf_dir)
    return evaluation.broken_supersedes(updates.withColumn("supersedes", F.lit(None).cast("string"))).select("task_id", "update_id")


# Selection -------------------------------------------------------------------


@register("context_budget", """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, doc_id % 5 AS priority, left(text, 400) AS cut FROM documents),
b AS (SELECT *, coalesce(sum(length(cut)) OVER (PARTITION BY source ORDER BY priority DESC, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i)
SELECT source, doc_id, left(cut, CAST(least(length(cut), 2000 - before) AS BIGINT)) AS content, CAST(row_number() OVER (PARTITION BY source ORDER BY priority DESC, position) AS INTEGER) AS rank FROM b WHERE least(length(cut), 2000 - before) > 0""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ev.table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").alias("position"), (F.col("doc_id") % 5).alias("priority"), F.col("text").alias("content"), F.lit(400).alias("max_chars"))
    return selection.context_within(items, 2000, "source").select("source", "doc_id", "content", "rank")


@register("routing", "SELECT event_id AS request_id, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'careful' WHEN event_type = 'error' THEN 'errors' WHEN event_type = 'purchase' THEN 'sales' ELSE 'default' END AS target_id FROM events")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(0, {"type": "error"}, 5, "errors"), (1, {"type": "error", "even": "yes"}, 9, "careful"), (2, {"type": "purchase"}, 5, "sales"), (3, {"type": "purchase"}, 5, "late")], "rule_index int, match map<string,string>, priority int, target_id string")
    requests = ev.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("even"), F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no")).alias("metadata"))
    return routing_rules.route(requests, rules, "default")


#: Customers are requests with four entries; parts are rules of one to three entries.
RULES = """
WITH q AS (SELECT c_custkey AS request_id, 's' || c_mktsegment AS segment, 'n' || c_nationkey AS nation, 'm' || (c_custkey % 10) AS digit FROM customer),
r AS (
  SELECT p_partkey AS rule_index, p_size % 5 AS priority, 't' || p_partkey AS target_id, p_partkey % 97 AS rule_set,
         CASE WHEN p_partkey % 4 <> 1 THEN 's' || (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) FROM customer)[p_partkey % 7 + 1] END AS segment,
         CASE WHEN p_partkey % 3 <> 1 THEN 'n' || (p_partkey // 3) % 25 END AS nation, CASE WHEN p_partkey % 2 = 0 THEN 'm' || (p_partkey // 7) % 10 END AS digit
  FROM part)
"""


def rules_and_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, p = ev.table(spark, sf_dir, "customer"), ev.table(spark, sf_dir, "part")
    key, named = F.col("p_partkey"), lambda letter, column: F.concat(F.lit(letter), column.cast("string"))
    requests = c.select(F.col("c_custkey").alias("request_id"), F.create_map(F.lit("segment"), named("s", F.col("c_mktsegment")), F.lit("nation"), named("n", F.col("c_nationkey")), F.lit("digit"), named("m", F.col("c_custkey") % 10), F.lit("key"), named("k", F.col("c_custkey"))).alias("metadata"))
    segments = c.agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))  # one row of five
    entries = F.array(
        F.when(key % 4 != 1, F.struct(F.lit("segment").alias("key"), F.concat(F.lit("s"), F.coalesce(F.get("segments", (key % 7).cast("int")), F.lit("?"))).alias("value"))),
        F.when(key % 3 != 1, F.struct(F.lit("nation").alias("key"), named("n", F.floor(key / 3) % 25).alias("value"))), F.when(key % 2 == 0, F.struct(F.lit("digit").alias("key"), named("m", F.floor(key / 7) % 10).alias("value"))),
    )
    rules = p.crossJoin(F.broadcast(segments)).select(key.cast("int").alias("rule_index"), F.map_from_entries(F.array_compact(entries)).alias("match"), (F.col("p_size") % 5).cast("int").alias("priority"), named("t", key).alias("target_id"), (key % 97).cast("int").alias("rule_set"))
    return rules, requests


@register("routing_by_many_rules", RULES.replace("% 7 + 1] END AS segment", "% 7 + 1] END AS s0").replace("FROM part)", "FROM part), z AS (SELECT *, CASE WHEN rule_index % 4 <> 1 THEN coalesce(s0, 's?') END AS segment FROM r)") + """,
m AS (SELECT request_id, target_id, row_number() OVER (PARTITION BY request_id ORDER BY priority DESC, rule_index) AS k FROM q JOIN z ON (z.segment IS NULL OR z.segment = q.segment) AND (z.nation IS NULL OR z.nation = q.nation) AND (z.digit IS NULL OR z.digit = q.digit) WHERE rule_set >= 10)
SELECT q.request_id, coalesce(target_id, 'default') AS target_id FROM q LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (request_id)""")
def routing_by_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer against a rule of every part, but for those of ten sets."""
    rules, requests = rules_and_requests(spark, sf_dir)
    return routing_rules.route(requests, rules.where("rule_set >= 10"), "default")


@register("ambiguous_rules", RULES.replace("% 7 + 1] END AS segment", "% 7 + 1] END AS s0").replace("FROM part)", "FROM part), z AS (SELECT *, CASE WHEN rule_index % 4 <> 1 THEN coalesce(s0, 's?') END AS segment FROM r)") + """
SELECT a.rule_set, a.priority, a.rule_index, count(*) AS overlaps, min(b.rule_index) AS first_overlap
FROM z a JOIN z b ON a.rule_set = b.rule_set AND a.priority = b.priority AND a.rule_index <> b.rule_index AND coalesce(a.segment = b.segment, true) AND coalesce(a.nation = b.nation, true) AND coalesce(a.digit = b.digit, true)
GROUP BY ALL""")
def ambiguous_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of 97 sets that one request could match with another of their priority."""
    return routing_rules.ambiguous_rules(rules_and_requests(spark, sf_dir)[0], "rule_set")


@register("workflow_cycles", """
WITH n AS (SELECT o_custkey % 50 AS w, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS k, o_orderkey, count(*) OVER (PARTITION BY o_custkey % 50) AS many FROM orders)
SELECT 'w' || w AS workflow, o_orderkey AS node FROM n WHERE w % 5 = 0 AND k <= many // 2 AND many > 1 OR w % 5 = 1 AND many > 3""")
def workflow_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of fifty workflows is a chain of orders, where every node needs the one after it and some the one after that. In every fifth, the node in the middle needs the first one, so all up to it wait; in the next of five, the last two need each other; the others have no cycle."""
    w = F.col("o_custkey") % 50
    by = Window.partitionBy("w")
    n = ev.table(spark, sf_dir, "orders").select(w.alias("w"), "o_orderkey").withColumns({"k": F.row_number().over(by.orderBy("o_orderkey")) - 1, "many": F.count("*").over(by), "one": F.lead("o_orderkey", 1).over(by.orderBy("o_orderkey")), "two": F.lead("o_orderkey", 2).over(by.orderBy("o_orderkey")), "first": F.min("o_orderkey").over(by), "before": F.lag("o_orderkey").over(by.orderBy("o_orderkey"))})
    back = F.when((F.col("w") % 5 == 0) & (F.col("k") == F.floor(F.col("many") / 2)) & (F.col("many") > 1), F.col("first")).when((F.col("w") % 5 == 1) & (F.col("k") == F.col("many") - 1) & (F.col("many") > 3), F.col("before"))
    needs = F.explode(F.array("one", F.when(F.col("k") % 200 == 0, F.col("two")), back))
    edges = n.select(F.concat(F.lit("w"), F.col("w").cast("string")).alias("workflow"), F.col("o_orderkey").alias("node"), needs.alias("needs"))
    return integrity.cyclic(edges)


@register("tool_policy", """
WITH c AS (SELECT l_orderkey AS response_id, count(*) AS n, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY ALL)
SELECT response_id, concat_ws('; ', CASE WHEN bad THEN 'undeclared: R' END, CASE WHEN n > 4 THEN n || ' calls over 4' END, CASE WHEN o_orderstatus = 'F' THEN 'calls despite none' END) AS violations
FROM c JOIN orders ON o_orderkey = response_id WHERE bad OR n > 4 OR o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'no call despite required' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def tool_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = ev.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("response_id"), F.col("l_returnflag").alias("name"))
    policies = ev.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("response_id"), F.array(F.lit("A"), F.lit("N")).alias("declared"), F.lit(4).alias("max_calls"), F.when(F.col("o_orderstatus") == "F", "none").when(F.col("o_orderstatus") == "P", "required").otherwise("auto").alias("selection"), F.lit(None).cast("string").alias("selected_tool"))
    return selection.tool_violations(calls, policies).withColumn("violations", F.array_join("violations", "; "))


@register("duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.repeated(ev.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@register("first_occurrence", "SELECT conv_id, min(turn) AS turn, text FROM conversations GROUP BY conv_id, text")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_occurrences(ev.table(spark, sf_dir, "conversations"), ["turn"], "conv_id", "text").select("conv_id", "turn", "text")


@register("review_gate", "SELECT o_orderkey AS proposal_id, CASE WHEN o_orderkey % 3 = 0 THEN 'approve' ELSE 'reject' END AS decision, NOT coalesce(bad, true) AND n > 1 AS strong, o_orderkey % 3 = 0 AND NOT coalesce(bad, true) AND n > 1 AS ready FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS bad, count(*) AS n FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a proposal with two reviews; its first line is the baseline, the others are mutations, and a returned line went wrong."""
    proposals = ev.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("proposal_id"))
    second = F.when(F.col("proposal_id") % 3 == 0, "approve").otherwise("reject")
    reviews = proposals.select("proposal_id", F.explode(F.array(F.struct(F.lit(1).alias("position"), F.lit("approve").alias("decision")), F.struct(F.lit(2).alias("position"), second.alias("decision")))).alias("r")).select("proposal_id", "r.*")
    lines = ev.outcomes(spark, sf_dir).select("run_key", "check_index", "error_message")
    keyed = lines.join(ev.runs(spark, sf_dir).select("run_key", F.col("o_orderkey").alias("proposal_id")), "run_key")
    bad = F.coalesce(F.col("error_message") == "R", F.lit(False))
    results = keyed.select("proposal_id", F.when(F.col("check_index") == 0, "baseline").otherwise("mutation").alias("kind"), F.when(F.col("check_index") == 0, ~bad).otherwise(bad).alias("passed"))
    return selection.may_materialize(proposals, reviews, results).select("proposal_id", "decision", F.coalesce("strong", F.lit(False)).alias("strong"), "ready")


# Integrity -------------------------------------------------------------------


@register("manifest_verification", "SELECT 'pages/' || page_id || '.html' AS path, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 13 = 0 THEN 'size' WHEN page_id % 17 = 0 THEN 'digest' END AS fault FROM pages WHERE page_id % 11 = 0 OR page_id % 13 = 0 OR page_id % 17 = 0 UNION ALL SELECT 'extra/' || page_id, 'unexpected' FROM pages WHERE page_id % 19 = 0")
def manifest_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ev.tree(spark, sf_dir)
    changed = t.where("page_id % 11 <> 0").withColumn("size", F.when(F.col("page_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("sha256", F.when(F.col("page_id") % 17 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    extra = t.where("page_id % 19 = 0").withColumn("path", F.concat(F.lit("extra/"), F.col("page_id").cast("string")))
    return integrity.compare(t, changed.unionByName(extra))


@register("manifest_consistency", "SELECT 'pages/' || page_id || '.html' AS path, 'parent is a file' AS fault FROM pages")
def manifest_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree in which a file stands where the folder of all others is."""
    t = ev.tree(spark, sf_dir).select("path", "kind", "size", "sha256")
    return integrity.manifest_faults(t.unionByName(spark.createDataFrame([("pages", "file", 0, None)], "path string, kind string, size long, sha256 string")))


@register("tree_totals", "SELECT page_id % 7 AS tree, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS total_bytes, count(DISTINCT sha256(html)) AS distinct_contents FROM pages GROUP BY ALL")
def tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.tree_totals(ev.tree(spark, sf_dir), "tree")


def nodes_sql(html: str) -> str:
    """The Merkle nodes of each tree of pages, whose contents are an expression."""
    return f"""
e AS (SELECT page_id % 7 AS tree, 'pages/' || page_id || '.html' AS path, sha256('pages/' || page_id || '.html')[:3] AS p3, sha256('pages/' || page_id || '.html' || chr(31) || strlen({html}) || chr(31) || sha256({html}) || chr(31) || (page_id % 3 = 0)) AS d FROM pages),
l3 AS (SELECT tree, p3 AS prefix, sha256(string_agg(d, '' ORDER BY path)) AS digest, count(*) AS entries FROM e GROUP BY ALL),
l2 AS (SELECT tree, prefix[:2] AS above, sha256(string_agg(prefix || digest, '' ORDER BY prefix)) AS digest, sum(entries) AS entries FROM l3 GROUP BY ALL),
l1 AS (SELECT tree, above[:1] AS prefix, sha256(string_agg(above || digest, '' ORDER BY above)) AS digest, sum(entries) AS entries FROM l2 GROUP BY ALL),
l0 AS (SELECT tree, '' AS prefix, sha256(string_agg(prefix || digest, '' ORDER BY prefix)) AS digest, sum(entries) AS entries FROM l1 GROUP BY ALL)"""


def executable_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.tree(spark, sf_dir).withColumn("executable", F.col("page_id") % 3 == 0)


@register("tree_digest", "WITH " + nodes_sql("html") + " SELECT tree, digest AS tree_sha256 FROM l0")
def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.tree_digest(executable_tree(spark, sf_dir), "tree")


@register("tree_nodes", "WITH " + nodes_sql("html") + " SELECT tree, prefix, digest, CAST(entries AS BIGINT) AS entries FROM l3 UNION ALL SELECT tree, above, digest, entries FROM l2 UNION ALL SELECT tree, prefix, digest, entries FROM l1 UNION ALL SELECT tree, prefix, digest, entries FROM l0")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.tree_nodes(executable_tree(spark, sf_dir), "tree")


@register("tree_changes", "SELECT page_id % 7 AS tree, sha256('pages/' || page_id || '.html')[:k] AS prefix FROM pages, (SELECT unnest(range(4)) AS k) WHERE page_id < 7")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that change with one page of each tree: its leaf and those above."""
    t = executable_tree(spark, sf_dir)
    changed = t.withColumn("sha256", F.when(F.col("page_id") < 7, F.sha2(F.lit("changed"), 256)).otherwise(F.col("sha256")))
    return integrity.changed_nodes(integrity.tree_nodes(t, "tree"), integrity.tree_nodes(changed, "tree"), "tree").select("tree", "prefix")


@register("artifact_oracles", "SELECT page_id AS artifact_id, concat_ws(',', CASE WHEN strlen(html) < 1000 THEN 'min_bytes' END, CASE WHEN strlen(html) > 4000 THEN 'max_bytes' END, CASE WHEN page_id % 5 = 0 THEN 'sha256' END) AS failed FROM pages")
def artifact_oracles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ev.tree(spark, sf_dir).withColumnRenamed("page_id", "artifact_id")
    oracles = t.select("artifact_id", F.lit(1000).alias("min_bytes"), F.lit(4000).alias("max_bytes"), F.when(F.col("artifact_id") % 5 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), F.lit(True).alias("present"))
    return integrity.artifact_faults(t, oracles).withColumn("failed", F.array_join("failed", ","))


@register("oracle_mutations", "SELECT page_id AS artifact_id, 'presence' AS failed FROM pages UNION ALL SELECT page_id, 'sha256' FROM pages")
def oracle_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mutation of a sound oracle is noticed."""
    t = ev.tree(spark, sf_dir).withColumnRenamed("page_id", "artifact_id")
    oracles = t.select("artifact_id", F.lit(0).alias("min_bytes"), F.lit(1 << 30).alias("max_bytes"), "sha256", F.lit(True).alias("present"))
    found = [integrity.artifact_faults(t, integrity.mutate(oracles, m)) for m in ("invert_presence", "digest_mismatch")]
    return found[0].unionByName(found[1]).withColumn("failed", F.array_join("failed", ","))


ORACLES = "WITH o AS (SELECT page_id, page_id % 6 AS k, html, 'pages/' || page_id AS path FROM pages) "


def oracles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An oracle of each page's file, of one of six kinds; all but every seventh hold."""
    k, odd = F.col("page_id") % 6, F.col("page_id") % 7 == 0
    none = F.lit(None)
    o = ev.table(spark, sf_dir, "pages").select("page_id", "html")
    mode = F.when(k == 0, F.when(odd, "absent").otherwise("exists")).when(k == 1, "text_equals").when(k == 2, "text_contains").when(k == 3, "sha256").when(k == 4, F.when(odd, "exists").otherwise("absent"))
    expected = F.when(k == 1, F.when(odd, F.concat("html", F.lit(" "))).otherwise(F.col("html"))).when(k == 2, F.when(odd, F.lit("\x01 none")).otherwise(F.substring("html", 3, 20))).when(k == 3, F.when(odd, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("html", 256)))
    size = F.octet_length("html").cast("long")
    return o.select(F.col("page_id").alias("oracle_id"), F.when(k == 5, "artifact").otherwise("file").alias("kind"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.when(k == 4, ".none").otherwise("")).alias("path"), mode.alias("mode"), none.cast("string").alias("pointer"), expected.alias("expected"), none.cast("string").alias("sha256"), F.when(k == 5, size).alias("min_bytes"), F.when(k == 5, F.when(odd, size - 1).otherwise(size)).alias("max_bytes"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))


@register("file_oracles", "SELECT page_id AS oracle_id, page_id % 7 <> 0 AS passed FROM pages")
def file_oracles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.oracle_results(oracles(spark, sf_dir), page_files(spark, sf_dir)).select("oracle_id", "passed")


def json_oracles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An oracle of each event's properties: that /k is the value it has, that it is there, or that /none is not; every seventh asks for the opposite."""
    e = ev.table(spark, sf_dir, "events")
    k, odd = F.col("event_id") % 3, F.col("event_id") % 7 == 0
    mode = F.when(k == 0, "equals").when(k == 1, F.when(odd, "absent").otherwise("exists")).otherwise(F.when(odd, "exists").otherwise("absent"))
    value = F.get_json_object("props", "$.k")
    none = F.lit(None)
    return e.select(F.col("event_id").alias("oracle_id"), F.lit("json").alias("kind"), F.col("event_id").cast("string").alias("path"), mode.alias("mode"), F.when(k == 2, "/none").otherwise("/k").alias("pointer"), F.when(k == 0, F.when(odd, F.lit('{"other":1}')).otherwise(value)).alias("expected"), none.cast("string").alias("sha256"), none.cast("long").alias("min_bytes"), none.cast("long").alias("max_bytes"))


@register("json_oracles", "SELECT event_id AS oracle_id, event_id % 7 <> 0 AS passed FROM events")
def json_oracles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = ev.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").cast("binary").alias("content"))
    return integrity.oracle_results(json_oracles_of(spark, sf_dir), files).select("oracle_id", "passed")


@register("mutated_oracles", "SELECT page_id AS oracle_id, page_id % 7 = 0 AND page_id % 6 IN (0, 4) AS passed FROM pages")
def mutated_oracles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sound oracles none survives its mutation; an unsound one of presence is set right by it."""
    return integrity.oracle_results(integrity.mutated(oracles(spark, sf_dir)), page_files(spark, sf_dir)).select("oracle_id", "passed")


@register("span_depths", """
WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS n, user_id % 3 AS g FROM events)
SELECT event_id, CAST(n % 150 AS BIGINT) AS depth FROM t""")
def span_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 150 spans, each under the one before it in time; a span is its place and its event."""
    t = ev.table(spark, sf_dir, "events").select("event_id", "ts", F.coalesce(F.col("user_id") % 3, F.lit(3)).alias("g"))
    t = integrity.numbered(t, "g", F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    chain = Window.partitionBy("g", F.floor(F.col("n") / 150)).orderBy("n")
    span = F.struct("n", "event_id")
    spans = t.select(F.col("g").cast("string").alias("trace_id"), span.alias("span_id"), F.lag(span).over(chain).alias("parent_span_id"))
    depths = integrity.span_depths(spans).select("span_id.event_id", "depth")
    integrity.forget(t)
    return depths


@register("listing_digest", """SELECT page_id % 7 AS tree, count(*) AS entries, sha256('[' || string_agg('{"path":"pages/' || page_id || '.html","sha256":"' || sha256(html) || '","size":' || strlen(html) || '}', ',' ORDER BY 'pages/' || page_id || '.html') || ']') AS listing_sha256 FROM pages GROUP BY ALL""")
def listing_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.listing_digest(ev.tree(spark, sf_dir), "tree")


@register("manifest_totals", "WITH t AS (SELECT page_id % 7 AS tree, count(*) AS n FROM pages GROUP BY ALL) SELECT tree, 'total' AS fault FROM t WHERE tree % 2 = 0 UNION ALL SELECT tree, 'order' FROM t WHERE tree % 3 = 0 AND n > 1")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose total is one byte off in every second tree, and that run backwards in every third."""
    t = ev.tree(spark, sf_dir)
    claimed = integrity.tree_totals(t, "tree").select("tree", (F.col("total_bytes") + F.when(F.col("tree") % 2 == 0, 1).otherwise(0)).alias("total_bytes"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("path"))
    return integrity.total_faults(t.withColumn("position", F.when(F.col("tree") % 3 == 0, -place).otherwise(place)), claimed, "tree")


@register("pattern_counts", BASE + "SELECT 'origin' AS kind, CASE WHEN check_index % 2 = 0 THEN 'synthetic' ELSE 'sanitized_real_world' END AS value, count(*) AS patterns FROM f GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'code', code, count(*) FROM f GROUP BY ALL")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure records as patterns of a corpus, by origin, category and code."""
    f = ev.failure_records(ev.outcomes(spark, sf_dir)).withColumn("origin", F.when(F.col("check_index") % 2 == 0, "synthetic").otherwise("sanitized_real_world"))
    return selection.counts_by(f, "origin", "category", "code").withColumnRenamed("n", "patterns")


CAPSULES = "WITH c AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) "


def capsules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capsule of each region with a check for each of its nations; every second check leaves time and exit codes to the capsule."""
    n = ev.table(spark, sf_dir, "nation")
    own = F.col("n_nationkey") % 2 == 0
    check = F.struct(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("id"), F.array(F.lit("check"), F.lit("it")).alias("argv"), F.when(own, 5.0).alias("timeout_seconds"), F.when(own, F.array(F.lit(3), F.lit(0))).alias("expected_exit_codes"))
    docs = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", check.alias("c")))), lambda x: x["c"]).alias("commands"))
    doc = F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("id"), F.lit("be sound").alias("goal"), F.when(F.col("n_regionkey") == 0, F.struct(F.lit(9.0).alias("default_timeout_seconds"))).alias("limits"), F.struct("commands").alias("success"))
    return docs.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".json")).alias("source_name"), F.to_json(doc).alias("document"))


@register("capsule_checks", CAPSULES + "SELECT 'r' || n_regionkey AS capsule_id, CAST(i AS INTEGER) AS check_index, 'c' || n_nationkey AS check_id, CASE WHEN n_nationkey % 2 = 0 THEN 5.0 WHEN n_regionkey = 0 THEN 9.0 ELSE 30.0 END::DOUBLE AS timeout_seconds, CASE WHEN n_nationkey % 2 = 0 THEN '0,3' ELSE '0' END AS expected_exit_codes FROM c")
def capsule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.capsule_rows(capsules(spark, sf_dir)).select("capsule_id", "check_index", "check_id", "timeout_seconds", F.array_join("expected_exit_codes", ",").alias("expected_exit_codes"))


@register("capsule_faults", "SELECT 'r' || r_regionkey || '.json' AS source_name, CASE r_regionkey WHEN 0 THEN '/goal: missing' WHEN 1 THEN '/success/commands/0/argv: not an array' WHEN 2 THEN 'checks need the command tool' WHEN 3 THEN 'not a strict JSON object' ELSE 'check ids repeat' END AS fault FROM region")
def capsule_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capsules broken in five ways by their region."""
    k, d = F.regexp_extract("source_name", "([0-9]+)", 1).cast("int"), F.col("document")
    broken = F.when(k == 0, F.replace(d, F.lit('"goal":"be sound",'), F.lit(""))).when(k == 1, F.replace(d, F.lit('["check","it"]'), F.lit('"check"'))).when(k == 2, F.regexp_replace(d, r"\}$", ',"allowed_actions":{"tools":["browser"]}}')).when(k == 3, F.concat(d, F.lit("]"))).otherwise(F.regexp_replace(d, '"c[0-9]+"', '"c"'))
    return documents.capsule_faults(capsules(spark, sf_dir).withColumn("document", broken))


@register("experiment_variants", "SELECT 'x' || n_regionkey AS experiment_id, 'r' || n_regionkey AS capsule, 3 AS repetitions, 'v' || n_nationkey AS variant_id, sha256('{\"env\":{\"N\":\"' || n_nationkey || '\"},\"id\":\"v' || n_nationkey || '\"}') AS variant_sha256 FROM nation")
def experiment_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment of each region with a variant for each of its nations."""
    variant = F.struct(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("id"), F.create_map(F.lit("N"), F.col("n_nationkey").cast("string")).alias("env"))
    docs = ev.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(variant).alias("variants"))
    name = lambda k: F.concat(F.lit(k), F.col("n_regionkey").cast("string"))
    return documents.experiment_rows(docs.select(name("x").alias("source_name"), F.to_json(F.struct(name("x").alias("id"), name("r").alias("capsule"), F.lit(3).alias("repetitions"), "variants")).alias("document")))


@register("view_query_runs", BASE + VIEW_SQL["runs"] + " ORDER BY started_at, run_key LIMIT 50")
def view_query_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty runs in the view's order: a report of the top rows."""
    return views.query(ev.store_tables(spark, sf_dir), "runs", 50)


@register("view_export", BASE + VIEW_SQL["runs"] + " ORDER BY started_at, run_key LIMIT 50")
def view_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty runs as they stand in an exported file."""
    path = own_folder(spark, "export")
    views.export_parquet(ev.store_tables(spark, sf_dir), "runs", path, 50)
    return spark.read.parquet(path)


@register("trace_lines", MESSAGES + """SELECT '{"event_type":"' || event_type || '","sequence":' || sequence || ',"trace_id":"' || trace_id || '"}' AS value FROM n""")
def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all transcripts as lines of JSON in a file."""
    path = own_folder(spark, "trace")
    store.write_trace_jsonl(normalize.transcript_events(ev.transcripts(spark, sf_dir)).select("trace_id", "sequence", "event_type"), path)
    return spark.read.text(path)


@register("hidden_keys", """SELECT doc_id, '{"a":[{"k":' || doc_id || '}],"text":"' || coalesce(lang, '') || '"}' AS visible FROM documents""")
def hidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of each document's id and language without what is opaque at two depths."""
    d = ev.table(spark, sf_dir, "documents")
    json = F.concat(F.lit('{"thought_signature":"q","text":"'), F.coalesce("lang", F.lit("")), F.lit('","a":[{"encrypted_content":{"x":1},"k":'), F.col("doc_id").cast("string"), F.lit("}]}"))
    return d.select("doc_id", signatures.visible_json(json).alias("visible"))


@register("view_query_taxonomy", BASE + VIEW_SQL["failure_taxonomy"] + " ORDER BY occurrences DESC, failure_category, failure_code LIMIT 3")
def view_query_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.query_with_info(ev.store_tables(spark, sf_dir), "failure_taxonomy", 3)[1]


@register("time_functions", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, epoch_us(ts) AS micros, event_type <> 'error' OR user_id % 2 = 0 AS overlaps, user_id % 2 = 0 AS same FROM events")
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments as texts and from nanoseconds, rules that may match the same metadata, and numbers that are the same but for rounding."""
    e = ev.table(spark, sf_dir, "events")
    at = scalars.nanos_to_timestamp(F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") * 1000 + 7)
    even = F.col("user_id") % 2 == 0
    left, right = F.create_map(F.lit("type"), F.col("event_type"), F.lit("x"), F.lit("1")), F.create_map(F.lit("type"), F.when(even, F.col("event_type")).otherwise(F.when(F.col("event_type") == "error", "other").otherwise(F.col("event_type"))))
    return e.select("event_id", scalars.iso_utc(F.col("ts").cast("timestamp")).alias("iso"), F.unix_micros(at).alias("micros"), scalars.may_overlap(left, right).alias("overlaps"), scalars.same_within(F.lit(1.0) + F.col("event_id"), (F.lit(1.0) + F.col("event_id")) * F.when(even, 1 + 1e-15).otherwise(1 + 1e-9)).alias("same"))


@register("corpus_counts", "SELECT lang, source, count(*) AS documents, count(DISTINCT sha256(text)) AS distinct_texts FROM documents GROUP BY ALL")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"))


# Scalars ---------------------------------------------------------------------


@register("scalar_functions", r"""
SELECT doc_id, sha256(text) AS text_digest, sha256(doc_id || chr(31) || source) AS key, CAST(length(text) AS INTEGER) AS chars,
       CASE WHEN length(text) <= 200 THEN text ELSE left(text, 86) || chr(10) || '... <output truncated> ...' || chr(10) || right(text, 86) END AS shown,
       regexp_full_match(source, '[a-zA-Z0-9][a-zA-Z0-9_.-]{0,127}') AS valid, '<redacted:email:' || left(sha256(source), 12) || '>' AS mark, 'Hello ' || lang || ' from ' || source AS greeting, replace(replace(source || '/' || lang || '~', '~', '~0'), '/', '~1') AS pointer FROM documents""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ev.table(spark, sf_dir, "documents")
    variables = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return d.select(
        "doc_id", scalars.text_digest(F.col("text")).alias("text_digest"), scalars.composite_key(F.col("doc_id"), F.col("source")).alias("key"), F.length("text").alias("chars"), scalars.head_tail(F.col("text"), 200).alias("shown"),
        scalars.valid_id(F.col("source")).alias("valid"), scalars.placeholder(F.lit("email"), F.col("source")).alias("mark"), scalars.render_template(F.lit("Hello ${lang} from ${source}"), variables).alias("greeting"), scalars.pointer_escape(F.concat("source", F.lit("/"), "lang", F.lit("~"))).alias("pointer"),
    )


@register("json_functions", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS found, sha256('{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS digest FROM events")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.table(spark, sf_dir, "events").select("event_id", scalars.json_pointer("/k")("props").alias("found"), scalars.canonical_digest(F.col("props")).alias("digest"))


@register("path_globs", "SELECT page_id, (page_id % 10) = 7 OR page_id < 10 AS excluded FROM pages")
def path_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.tree(spark, sf_dir).select("page_id", scalars.excluded(F.col("path"), ["*7.html", "pages/[0-9].html"]).alias("excluded"))


FLAGSHIP = "view_failure_taxonomy"
