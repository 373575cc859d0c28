import datetime as dt
import hashlib
import json
import re
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import evaluation, integrity, normalize, privacy, runs, selection, views
from plumbline.queries import QUERIES
from plumbline.schemas import TAXONOMY
from plumbline.sources import documents, store
from plumbline.streaming import rollback

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def result(status="passed", code=None, exit_code=0, secret="", **changes):
    failure, summary = None, {"total": 0}
    if code:
        row = next(t for t in TAXONOMY if t[0] == code)
        failure = {"category": row[1], "code": code, "impact": row[2], "retryability": row[3], "summary": row[4], "details": {"b": 1, "a": exit_code}, "causes": []}
        summary = {"total": 1, "evaluation_failures": int(row[2] == "evaluation_failure"), "infrastructure_errors": int(row[2] == "infrastructure_error"), "not_evaluated": 0, "by_category": {row[1]: 1}, "by_code": {code: 1}, "primary_check_id": "unit", "primary_code": code}
    check = {"id": "unit", "argv": ["pytest", "-q"], "cwd": ".", "status": status, "exit_code": exit_code, "duration_seconds": 1.0, "stdout": secret, "stderr": "é🙂", "stdout_truncated": False, "stderr_truncated": False, "error": None, "failure": failure}
    return {"capsule_id": "cap", "status": status, "started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:00:02Z", "duration_seconds": 2.0, "checks": [check], "failure_summary": summary} | changes


def experiment(**changes):
    runs_of = [{"run_id": f"exp.{v}.001", "variant_id": v, "repetition": 1, "trace_id": f"exp.{v}.001", "result": r} for v, r in (("baseline", result()), ("profiled", result("failed", "unexpected_exit", 7, "secret output")))]
    return {"schema_version": "0.1", "experiment_id": "exp", "capsule_id": "cap", "started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:00:02Z", "duration_seconds": 2.0, "runs": runs_of, "summaries": [{"variant_id": v, "runs": 1, "passed": p, "failed": 1 - p, "errors": 0, "pass_rate": float(p), "mean_duration_seconds": 2.0} for v, p in (("baseline", 1), ("profiled", 0))]} | changes


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('store')}/s"
    store.initialize(spark, root)
    docs = spark.createDataFrame([("a.json", json.dumps(experiment())), ("b.json", json.dumps(result())), ("c.json", "{broken"), ("d.json", '{"a":1}')], "source_name string, document string")
    assert store.ingest(docs, root) == 2
    assert store.ingest(docs, root) == 0  # the same bytes add nothing
    assert {(r.source_name, r.fault) for r in store.rejected(spark, root).collect()} == {("c.json", "not a strict JSON object"), ("d.json", "/a: unknown field")}
    with pytest.raises(ValueError, match="c.json"):
        store.ingest(docs, root, strict=True)
    store.initialize(spark, root)
    return store.load(spark, root)


def test_store_counts_keys_and_no_raw_output(tables):
    assert {r.table_name: r.row_count for r in store.info(tables).collect()} == {"checks": 3, "failure_records": 1, "runs": 3, "sources": 2, "store_metadata": 1, "variant_summaries": 2}
    source = hashlib.sha256(json.dumps(experiment()).encode()).hexdigest()
    key = lambda *p: hashlib.sha256("\x1f".join(map(str, p)).encode()).hexdigest()
    run = key(source, "exp.profiled.001")
    check = key(run, 0, "unit")
    rows = {r.check_key: r for r in tables["checks"].collect()}
    assert check in rows and (rows[check].stderr_chars, rows[check].argv_json) == (2, '["pytest","-q"]')
    f = tables["failure_records"].first()
    assert (f.failure_key, f.details_json, f.causes_json) == (key(check, "unexpected_exit"), '{"a":7,"b":1}', "[]")
    assert all("secret output" not in str(r) for t in tables.values() for r in t.collect())


def test_views_and_their_limits(tables, tmp_path):
    assert {r.variant_id: r.pass_rate for r in views.query(tables, "variants").collect()} == {"baseline": 1.0, "profiled": 0.0}
    c = views.query(tables, "capsules").first()
    assert (c.runs, c.passed, c.failed) == (3, 2, 1)
    (f,) = views.query(tables, "failures").collect()
    assert (f.exit_code, f.failure_code, f.run_status) == (7, "unexpected_exit", "failed")
    (x,) = views.query(tables, "failure_taxonomy").collect()
    assert (x.occurrences, x.runs, x.capsules) == (1, 1, 1)
    for bad in (0, 10_001):
        with pytest.raises(ValueError):
            views.query(tables, "runs", bad)
    assert views.export_parquet(tables, "checks", f"file://{tmp_path}/out", 2) == 2
    plan = views.query(tables, "runs", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_taxonomy_rules(spark):
    rows = [("a", "exit", 1, None, None, None), ("b", "exit", -9, None, None, None), ("c", "timeout", None, None, None, None), ("d", "timeout", None, None, "output_capture", None), ("e", "launch", None, 2, None, None), ("f", "launch", None, 1, None, None), ("g", "launch", None, 5, None, None), ("h", "skipped", None, None, None, "unit"), ("i", None, 0, None, None, None)]
    got = {r.check_id: r for r in runs.classify(spark.createDataFrame(rows, "check_id string, outcome string, exit_code int, errno int, complication string, blocked_by string")).collect()}
    assert {k: v.code for k, v in got.items()} == {"a": "unexpected_exit", "b": "signal_termination", "c": "timeout", "d": "output_capture", "e": "command_not_found", "f": "permission_denied", "g": "process_launch_error", "h": "skipped_after_failure"}
    assert got["d"].causes == ["timeout"] and got["h"].caused_by_check_id == "unit" and got["d"].summary.startswith("command timed out")
    bad = [("x", "timeout", "task", "evaluation_failure", "maybe", None, []), ("y", "timeout", "resource", "evaluation_failure", "maybe", None, ["timeout"]), ("z", "timeout", "resource", "evaluation_failure", "maybe", "q", []), ("ok", "timeout", "resource", "evaluation_failure", "maybe", None, [])]
    found = runs.inconsistent_records(spark.createDataFrame(bad, "id string, code string, category string, impact string, retryability string, caused_by_check_id string, causes array<string>"))
    assert {r.id for r in found.collect()} == {"x", "y", "z"}
    checks = [("passed", None), ("passed", "timeout"), ("failed", "timeout"), ("timed_out", "timeout"), ("failed", None)]
    assert runs.forbidden_codes(spark.createDataFrame(checks, "status string, code string")).count() == 3


def test_primary_failure_and_status(spark):
    f = spark.createDataFrame([("r", "a", 0, "task", "unexpected_exit", "evaluation_failure"), ("r", "b", 1, "sandbox", "sandbox_runtime", "infrastructure_error"), ("r", "c", 2, "task", "unexpected_exit", "evaluation_failure")], "run_key string, check_id string, check_index int, category string, code string, impact string")
    s = runs.failure_summary(f).first()
    assert (s.total, s.primary_check_id, s.primary_code, s.by_code) == (3, "b", "sandbox_runtime", {"sandbox_runtime": 1, "unexpected_exit": 2})
    c = spark.createDataFrame([("p", "passed", None), ("q", "failed", "evaluation_failure"), ("r", "error", "infrastructure_error")], "run_key string, status string, impact string")
    all_runs = spark.createDataFrame([("p",), ("q",), ("r",), ("none",)], "run_key string")
    assert {r.run_key: r.status for r in runs.run_status(c, all_runs).collect()} == {"p": "passed", "q": "failed", "r": "error", "none": "passed"}


def test_run_ids_and_truncation(spark):
    long = "v" * 300
    row = spark.range(1).select(scalars.matrix_run_id(F.lit("e"), F.lit("v"), F.lit(7)).alias("a"), scalars.matrix_run_id(F.lit("e"), F.lit(long), F.lit(7)).alias("b"), scalars.head_tail(F.lit("x" * 50 + "y" * 50), 60).alias("c"), scalars.head_tail(F.lit("short"), 60).alias("d"), scalars.nanos_to_timestamp(F.lit(1704067200123456789)).cast("string").alias("t")).first()
    natural = f"e.{long}.007"
    assert row.a == "e.v.007" and row.b == f"{natural[:239]}.{hashlib.sha256(natural.encode()).hexdigest()[:16]}" and len(row.b) == 256
    assert row.c == "x" * 16 + scalars.TRUNCATED + "y" * 16 and row.d == "short" and row.t == "2024-01-01 00:00:00.123456"


def test_mcnemar_tail_values():
    assert [scalars.mcnemar_tail(*x) for x in ((5, 0), (3, 1), (0, 0), (1, 2))] == [Fraction(1, 32), Fraction(5, 16), 1, 1]


def test_gates_are_exact(spark):
    rules = spark.createDataFrame([("validation", 10, 0.7, 0.1, 5, 0.05)], "role string, min_total long, min_candidate_score double, min_absolute_improvement double, min_discordant_pairs long, max_one_sided_p_value double")
    report = lambda both, b, c, none: spark.createDataFrame([("validation", both + b + c + none, both, b, c)], "role string, total long, both_correct long, baseline_only_correct long, candidate_only_correct long")
    good = evaluation.promotion_checks(rules, report(20, 0, 5, 5))
    assert good.first().passed and evaluation.promotion_decision(good).first().decision == "promote"
    bad = evaluation.promotion_checks(rules, report(5, 2, 2, 0)).first()
    assert not bad.passed and len(bad.reasons) == 5
    edge = evaluation.promotion_checks(rules.withColumn("min_absolute_improvement", F.lit(0.1)), report(41, 0, 5, 4)).first()
    assert edge.passed and edge.absolute_improvement == 0.1  # 5 of 50 is exactly a tenth
    with pytest.raises(Exception, match="needs one rule"):
        evaluation.promotion_checks(rules, report(1, 0, 1, 0).withColumn("role", F.lit("train"))).collect()


def fold(updates, probes):
    out = {}
    for task, probe, turn in probes:
        state = {}
        for t, at, _, key, action, value in sorted(updates, key=lambda u: (u[1], u[2])):
            if t == task and at <= turn:
                state.pop(key, None) if action == "revoke" else state.__setitem__(key, value)
        out[task, probe] = sorted(state.items())
    return out


def test_probe_states_as_a_sequential_fold(spark):
    import random

    rng = random.Random(1)
    updates = [(f"t{k}", i, o, rng.choice("abc"), rng.choice(["set", "set", "revoke"]), f"v{i}{o}") for k in range(4) for i in range(20) for o in range(2)]
    probes = [(f"t{k}", f"p{i}", i) for k in range(5) for i in (0, 7, 19)]
    u = spark.createDataFrame(updates, "task_id string, turn int, ord int, key string, action string, value string")
    p = spark.createDataFrame(probes, "task_id string, probe_id string, turn int")
    states = evaluation.probe_states(u, p)
    assert {(r.task_id, r.probe_id): [(e.key, e.value) for e in r.expected] for r in states.collect()} == fold(updates, probes)
    right = states.select("task_id", "probe_id", F.col("expected").alias("active_constraints")).where("probe_id <> 'p0'")
    total = evaluation.dialogue_score(states, right).where("task_id is null").first()
    assert (total.total, total.submitted, total.correct) == (15, 10, 10)


def test_partition_faults(spark):
    split = spark.createDataFrame([("a", "train"), ("a", "validation"), ("b", "train"), ("b", "train"), ("c", "odd"), ("zz", "train"), ("u", "train")], "example_id string, role string")
    examples = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("u", None)], "example_id string, outputs string")
    got = {(r.example_id, r.fault) for r in evaluation.partition_faults(split, examples).collect()}
    assert got == {("a", "overlap"), ("b", "repeated"), ("c", "bad_role"), ("d", "missing"), ("zz", "unknown"), ("u", "unlabelled")}
    assert evaluation.export_partition(split, examples, "sealed_test").columns == ["example_id"]


TEXTS = ["write to jo.doe+x@mail.example.org now", "call (030) 123-4567 or +49 30 1234 5678", "é555-123-4567", "api_key = 'abcdef1234567' end", "Bearer abcdefghijklmnop.qrs", "sk-ABCDEFGHIJKLMNOP and ghp_" + "a" * 24, "<redacted:email:0123456789ab> nothing", "password: <redacted:secret:0123456789ab>", None, ""]


def test_redaction_and_residuals_as_pythons_patterns(spark):
    policy = privacy.Policy(rules=(privacy.Rule("ticket", r"t-\d+", "i"),), allow=("jo.doe+x@mail.example.org",))
    docs = spark.createDataFrame(list(enumerate([*TEXTS, "see T-123"])), "id long, text string")
    found = {(r.location, r.detector, r.digest) for r in privacy.scan(docs, "id", "text", policy).collect()}
    want = set()
    for i, text in enumerate([*TEXTS, "see T-123"]):
        left = re.sub(privacy.PLACEHOLDER, "", text or "")
        for name, _, pattern, group in [*privacy.DETECTORS, ("custom:ticket", "custom", r"(?i)t-\d+", 0)]:
            want |= {(i, name, hashlib.sha256(m.group(group).encode()).hexdigest()) for m in re.finditer(pattern, left) if m.group(group) not in policy.allow}
    assert found == want and len(found) >= 7
    redacted = privacy.redact(docs, "text", policy)
    assert privacy.scan(redacted, "id", "text", policy).count() == 0
    texts = {r.id: r.text for r in redacted.collect()}
    mark = hashlib.sha256(b"abcdef1234567").hexdigest()[:12]
    assert texts[3] == f"api_key = '<redacted:secret:{mark}>" + "' end" and texts[0] == TEXTS[0] and texts[2] == TEXTS[2] and texts[8] is None
    r = privacy.review(redacted, privacy.scan(redacted, "id", "text", policy), policy).first()
    assert r.total_redactions == r.unique_redacted_values == sum(r.counts_by_kind.values()) and r.counts_by_rule == {"ticket": 1}
    assert r.warnings == ["pattern_matching_cannot_prove_complete_deidentification", "custom_rules_are_trusted_python_regular_expressions", "allowlisted_values_are_retained_verbatim"]


def test_redaction_of_json_values_and_keys(spark):
    doc = json.dumps({"a@b.example": ["x", "c@d.example"], "n": 1})
    r = spark.createDataFrame([(doc,)], "d string").select(privacy.redact_json()("d").alias("r")).first().r
    assert [x.location for x in r.redactions] == ["/<key:0>", "/<value:0>/1"] and "@" not in r.text


def test_transcript_with_a_correction(spark):
    m = [{"id": "m0", "role": "user", "content": "hi", "timestamp": "2024-01-01T00:00:00Z"}, {"id": "m1", "role": "assistant", "content": "no", "timestamp": "2024-01-01T00:00:01Z"}, {"id": "m2", "role": "user", "content": "yes", "timestamp": "2024-01-01T00:00:02Z", "correction_of": "m1"}]
    doc = lambda messages: spark.createDataFrame([("t", json.dumps({"id": "t", "capsule_id": "c", "messages": messages}))], "source_name string, document string")
    events = normalize.transcript_events(doc(m)).sort("sequence").collect()
    assert [e.event_type for e in events] == ["conversation.started", "message.observed", "message.observed", "message.observed", "feedback.observed"]
    assert [e.sequence for e in events] == [0, 1, 2, 3, 4] and events[4].correction_of == "m1"
    assert normalize.transcript_faults(doc(m)).count() == 0
    bad = [dict(m[0]), dict(m[1], id="m0"), dict(m[2], correction_of="m9", timestamp="2023-01-01T00:00:00Z")]
    assert {r.fault for r in normalize.transcript_faults(doc(bad)).collect()} == {"repeated message id", "time falls", "correction out of place"}


def test_manifests_trees_and_cycles(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_bytes(b"one")
    (tmp_path / "y.txt").write_bytes(b"two")
    m = integrity.manifest(spark, f"file://{tmp_path}").cache()
    assert {(r.size, r.sha256) for r in m.collect()} == {(3, hashlib.sha256(b).hexdigest()) for b in (b"one", b"two")}
    assert integrity.compare(m, m).count() == 0 and integrity.compare(m, m.withColumn("size", F.col("size") + 1)).count() == 2
    a, b = integrity.tree_digest(m).first(), integrity.tree_digest(m.repartition(5)).first()
    assert a == b and a != integrity.tree_digest(m.where("path like '%x.txt'")).first()
    entries = spark.createDataFrame([("a", "file", 1, "s"), ("a/b", "file", 2, "s"), ("c", "file", 1, "q"), ("c", "file", 1, "q")], "path string, kind string, size long, sha256 string")
    assert {(r.path, r.fault) for r in integrity.manifest_faults(entries).collect()} == {("c", "repeated"), ("a/b", "parent is a file"), ("a", "one digest, two sizes"), ("a/b", "one digest, two sizes")}
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/cp")
    edges = spark.createDataFrame([("w", "a", None), ("w", "b", "a"), ("w", "c", "b"), ("v", "a", "c"), ("v", "b", "a"), ("v", "c", "b"), ("v", "d", None)], "workflow string, node string, needs string")
    assert {(r.workflow, r.node) for r in integrity.cyclic(edges).collect()} == {("v", "a"), ("v", "b"), ("v", "c")}
    spans = spark.createDataFrame([("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "o", "zz")], "trace_id string, span_id string, parent_span_id string")
    assert {r.span_id: r.depth for r in integrity.span_depths(spans).collect()} == {"a": 0, "b": 1, "c": 2, "o": 0}
    long = [("t", str(i), str(i - 1) if i else None) for i in range(200)] + [("u", "x", "y"), ("u", "y", "x"), ("u", "z", "y"), ("t", "9", "8")]
    deep = {(r.trace_id, r.span_id): r.depth for r in integrity.span_depths(spark.createDataFrame(long, "trace_id string, span_id string, parent_span_id string")).collect()}
    assert deep == {("t", str(i)): i for i in range(200)} | {("u", k): None for k in "xyz"}


def test_context_budget_cuts_the_last_item(spark):
    items = spark.createDataFrame([("g", 0, 1, "aaaa", 10), ("g", 1, 5, "bbbbbb", 4), ("g", 2, 5, "cc", 10), ("g", 3, 0, "dd", 10)], "g string, position int, priority int, content string, max_chars int")
    got = selection.context_within(items, 8, "g").sort("rank").collect()
    assert [r.content for r in got] == ["bbbb", "cc", "aa"]
    assert [r.content for r in selection.context_within(items, 8, "g", ordering="position").sort("rank").collect()] == ["aa", "bbbb", "cc"]


def test_named_tool_and_parallel_calls(spark):
    calls = spark.createDataFrame([("r", "a"), ("r", "b")], "response_id string, name string")
    p = spark.createDataFrame([("r", ["a", "b"], 5, "named", "a"), ("s", ["a"], 5, "named", "a")], "response_id string, declared array<string>, max_calls int, selection string, selected_tool string")
    got = {r.response_id: r.violations for r in selection.tool_violations(calls, p, parallel_allowed=False).collect()}
    assert got == {"r": ["2 calls, named needs one", "outside the named tool: b", "parallel calls"], "s": ["0 calls, named needs one"]}


def test_documents_strictly(spark):
    texts = {"kind": '{"id":"d","examples":[{"id":1,"inputs":{},"outputs":{}}]}', "ok": '{"id":"d","examples":[{"id":"e","inputs":{"q":"1"},"outputs":{"b":1,"a":2}}]}', "dup": '{"id":"d","id":"e"}', "nan": '{"id":NaN}', "extra": '{"id":"d","more":1}', "none": "{}", "list": "[1]", "deep": '{"id":' + "[" * 200 + "]" * 200 + "}"}
    docs = spark.createDataFrame(list(texts.items()), "source_name string, document string")
    got = {r.source_name: r.fault for r in documents.document_faults(docs, "dataset").collect()}
    assert got == {"kind": "/examples/0/id: not a text", "dup": "not a strict JSON object", "nan": "not a strict JSON object", "extra": "/more: unknown field", "none": "/id: missing", "list": "not a strict JSON object", "deep": "nested too deep"}
    assert documents.dataset_rows(docs.where("source_name = 'ok'")).first().outputs == '{"a":2,"b":1}'


def test_rollback_stream_fires_for_closed_windows(spark, tmp_path):
    events = [("err", T0 + dt.timedelta(seconds=s), v) for s, v in ((1, 10.0), (2, 30.0), (61, 1.0), (62, 1.0), (400, 0.0))]
    spark.createDataFrame(events, "metric string, ts timestamp, value double").write.parquet(f"file://{tmp_path}/in")
    triggers = spark.createDataFrame([("t", "err", "gte", 20.0, 2, 60)], "trigger_id string, metric string, operator string, threshold double, min_samples long, window_seconds int")
    stream = spark.readStream.schema("metric string, ts timestamp, value double").parquet(f"file://{tmp_path}/in")
    q = rollback.watch(stream, triggers, 60, "10 seconds").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    (r,) = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert (r.trigger_id, r.observed_value, r.samples) == ("t", 20.0, 2)


def test_trace_jsonl(spark, tmp_path):
    e = spark.createDataFrame([("t", 1, "b"), ("t", 0, "a")], "trace_id string, sequence int, event_type string")
    store.write_trace_jsonl(e, f"file://{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/t").collect()] == ['{"event_type":"a","sequence":0,"trace_id":"t"}', '{"event_type":"b","sequence":1,"trace_id":"t"}']


def with_check(**changes):
    r = result("failed", "unexpected_exit", 7)
    return r | {"checks": [r["checks"][0] | changes]}


def with_failure(**changes):
    r = result("failed", "unexpected_exit", 7)
    return r | {"checks": [r["checks"][0] | {"failure": r["checks"][0]["failure"] | changes}]}


def test_artifacts_that_may_not_be_stored(spark):
    from plumbline.sources.artifacts import artifact_faults

    skipped = result("failed", "unexpected_exit", 1)["checks"][0]
    late = skipped | {"id": "late", "status": "skipped", "failure": {"category": "control_flow", "code": "skipped_after_failure", "impact": "not_evaluated", "retryability": "after_fix", "summary": "s", "caused_by_check_id": "unit"}}
    halted = result("failed", "unexpected_exit", 1) | {"checks": [skipped, late], "failure_summary": {"total": 2, "evaluation_failures": 1, "infrastructure_errors": 0, "not_evaluated": 1, "by_category": {"task": 1, "control_flow": 1}, "by_code": {"unexpected_exit": 1, "skipped_after_failure": 1}, "primary_check_id": "unit", "primary_code": "unexpected_exit"}}
    runs_of = experiment()["runs"]
    cases = {
        "whole run": (result(), None), "whole failure": (result("failed", "unexpected_exit", 7), None), "whole experiment": (experiment(), None), "halted": (halted, None), "no summary": ({k: v for k, v in result().items() if k != "failure_summary"}, None),
        "negative": (result(duration_seconds=-1.0), "run ends before it starts"), "status": (result(status="odd"), "run status unknown"), "boolean": (result(duration_seconds=True), "/duration_seconds: not a finite number"), "zone": (result(started_at="2024-01-01T00:00:00"), "/started_at: not a time with its zone"),
        "no failure": (with_check(failure=None), "check status and failure disagree"), "other code": (with_check(status="timed_out"), "check status and failure disagree"), "category": (with_failure(category="resource"), "failure is not of its code"), "cause": (with_failure(causes=["unexpected_exit"]), "failure is not of its code"),
        "long details": (with_failure(details={"x": "y" * 5000}), "failure details are too long"), "raw output": (with_failure(details={"x": [{"Raw_Output": 1}]}), "failure details hold raw output"), "details": (with_failure(details=[1]), "/checks/0/failure/details: not an object"),
        "twice": (halted | {"checks": [skipped, late | {"id": "unit"}]}, "check ids repeat"), "order": (halted | {"checks": [late, skipped]}, "skipped checks out of place"), "blocked": (halted | {"checks": [skipped, late | {"failure": late["failure"] | {"caused_by_check_id": "x"}}]}, "skipped checks out of place"),
        "primary": (halted | {"failure_summary": halted["failure_summary"] | {"primary_check_id": "late"}}, "failure summary is not that of the checks"), "run ids": (experiment(runs=[runs_of[0], runs_of[1] | {"run_id": runs_of[0]["run_id"]}]), "run ids repeat"), "cells": (experiment(runs=[runs_of[0], runs_of[1] | {"variant_id": "baseline"}]), "matrix cells repeat"),
        "capsule": (experiment(capsule_id="other"), "run of another capsule"), "outside": (experiment(finished_at="2024-01-01T00:00:01Z"), "run outside the experiment"), "variants": (experiment(summaries=experiment()["summaries"][:1]), "summaries are not of the variants"),
        "rate": (experiment(summaries=[experiment()["summaries"][0] | {"pass_rate": 0.5}, experiment()["summaries"][1]]), "summary is not that of its runs"), "inner": (experiment(runs=[runs_of[0] | {"result": result(status="failed")}, runs_of[1]]), "summary is not that of its runs"), "repetition": (experiment(runs=[runs_of[0] | {"repetition": "1"}, runs_of[1]]), "/runs/0/repetition: not a whole number"),
    }
    docs = spark.createDataFrame([(name, json.dumps(doc)) for name, (doc, _) in cases.items()], "source_name string, document string")
    assert {r.source_name: r.fault for r in artifact_faults(docs).collect()} == {n: f for n, (_, f) in cases.items() if f}


@pytest.mark.parametrize("moment", ["1901-02-29T00:00:00Z", "2024-13-01T00:00:00Z", "2024-01-01T25:00:00Z", "2024-04-31 10:00:00+02:00", "0000-01-01T00:00:00Z"])
def test_a_time_that_no_calendar_has_is_a_fault(spark, moment):
    from plumbline.sources.artifacts import artifact_faults

    docs = spark.createDataFrame([("impossible", json.dumps(result(finished_at=moment))), ("leap", json.dumps(result(finished_at="2024-02-29T23:59:59.123456789z")))], "source_name string, document string")
    assert [(r.source_name, r.fault) for r in artifact_faults(docs).collect()] == [("impossible", "/finished_at: not a time with its zone")]


def test_artifacts_of_orders_on_leap_days_have_their_planted_faults(spark, tmp_path):
    import duckdb

    from plumbline.queries import ORACLE_SQL

    rows = ", ".join(f"({k}, 1, 'F', 1001.0 + {k}, TIMESTAMP '1996-02-29 00:00:00', '1-URGENT')" for k in range(24))
    lines = ", ".join(f"({k}, {k}, 1, 1, 1.0, 1.0, 0.0, 0.0, 'A', 'F', TIMESTAMP '1996-03-01 00:00:00')" for k in range(24))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice, o_orderdate, o_orderpriority FROM (VALUES {rows}) t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)")
    con.execute(f"CREATE TABLE lineitem AS SELECT l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_linenumber::INTEGER AS l_linenumber, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM (VALUES {lines}) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)")
    con.execute("CREATE TABLE customer AS SELECT 1::BIGINT AS c_custkey, 'BUILDING' AS c_mktsegment")
    for name in ("orders", "lineitem", "customer"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = {(r.source_name, r.fault) for r in QUERIES["artifact_faults"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(ORACLE_SQL["artifact_faults"]).fetchall()) and ("8", "run ends before it starts") in got


def test_two_ingests_of_one_source_show_it_once(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store.initialize(spark, root)
    docs = spark.createDataFrame([("b.json", json.dumps(result()))], "source_name string, document string")
    assert store.ingest(docs, root) == 1
    for name in (*store.ROW_TABLES, "sources"):  # what a second one at the same time leaves
        store.read_table(spark, root, name).where("ingest <> 'none'").drop("ingest").write.parquet(f"{root}/{name}/ingest=zzz")
    assert {r.table_name: r.row_count for r in store.info(store.load(spark, root)).collect()}["runs"] == 1
    counts, rows = views.query_with_info(store.load(spark, root), "sources")
    assert rows.count() == 1 and counts.where("table_name = 'sources'").first().row_count == 1


def sha(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_signatures_leave_out_what_is_hidden(spark):
    from plumbline.operators import signatures

    def signed(*contents):
        rows = [("assistant", c if isinstance(c, str) else json.dumps(c)) for c in contents]
        return [r.s for r in spark.createDataFrame(rows, "role string, content string").select(signatures.signature("role", "content").alias("s")).collect()]

    think = lambda text: [{"type": "thinking", "thinking": text, "signature": "s" + text}, {"type": "text", "text": "é", "citations": [{"encrypted_content": text, "u": 1}]}]
    a, b, c, d = signed(think("one"), think("two"), think(""), [*think("one"), {"type": "text", "text": "more"}])
    assert a == b and len({a, c, d}) == 3
    alone, listed, other = signed('"hello"', [{"text": "hello", "type": "text"}], '"hell"')
    assert alone == listed != other
    tool = lambda **k: [{"type": "tool_use", "id": "c", "name": "n", "input": {"data": 1, "signature": "x"} | k}]
    same, more, different = signed(tool(), tool(encrypted_content="z"), tool(data=2))
    assert len({same, more, different}) == 3 and signed(tool(encrypted_content="q")) == [more]
    snake, camel, thought, thoughts = signed([{"inline_data": {"mime_type": "a/b", "data": "AA"}}], [{"inlineData": {"mimeType": "a/b", "data": "BB"}, "thought": False}], [{"thought": True, "text": "x", "thought_signature": "q"}], [{"thought": True, "text": "y", "thoughtSignature": "r"}])
    assert snake == camel and thought == thoughts != snake
    assert signed("{}", "3", "nonsense") == [None] * 3
    assert [signatures.part_fault(p) for p in ({"thought": True}, {"text": "a", "inline_data": {}}, {"file_data": {}, "fileData": {}}, {}, 3)] == [None, "part with several fields", "two spellings of a part's field", "part without an observable field", "part is not an object"]
    assert spark.createDataFrame([('{"b":[{"encrypted_content":1,"a":2}]}',)], "d string").select(signatures.visible_json("d")).first()[0] == '{"b":[{"a":2}]}'


def test_a_system_prompt_that_changes_is_told_again(spark):
    record = lambda i, system, content: {"request_id": f"r{i}", "timestamp": f"2024-01-01T00:00:0{i}Z", "system": system, "messages": [{"id": f"u{i}", "role": "user", "content": content}], "response": {"id": f"a{i}", "content": [{"type": "text", "text": "ok"}]}}
    doc = {"id": "t", "records": [record(0, "be brief", "[not json]"), record(1, "be brief", [{"type": "text", "text": "two"}]), record(2, [{"type": "text", "text": "be long"}], "three"), record(3, None, "four")]}
    events = normalize.message_events(spark.createDataFrame([("t", json.dumps(doc))], "source_name string, document string")).sort("sequence").collect()
    told = [(e.role, e.content) for e in events if e.event_type == "message.observed"]
    assert told == [("system", "be brief"), ("user", "[not json]"), ("assistant", "ok"), ("user", "two"), ("assistant", "ok"), ("system", "be long"), ("user", "three"), ("assistant", "ok"), ("user", "four"), ("assistant", "ok")]
    assert normalize.message_faults(spark.createDataFrame([("t", json.dumps(doc))], "source_name string, document string")).count() == 0


def test_reasoning_keeps_its_summary_only(spark):
    item = {"id": "r", "type": "reasoning", "summary": [{"type": "summary_text", "text": "short"}], "encrypted_content": "hidden"}
    doc = {"id": "t", "responses": [{"input_items": [], "response": {"id": "x", "created_at": 1.5, "output": [item, {"id": "w", "type": "web_search_call"}]}}]}
    events = normalize.response_events(spark.createDataFrame([("t", json.dumps(doc))], "source_name string, document string")).sort("sequence").collect()
    assert [(e.event_type, e.artifact_kind, e.content, e.hidden_present) for e in events[1:3]] == [("artifact.observed", "reasoning_summary", "short", True), ("artifact.observed", "response_item", None, None)]
    assert events[1].timestamp.microsecond == 500_000


def test_events_under_a_policy(spark):
    e = spark.createDataFrame([("t", 0, "mail a@b.example", '{"to":["c@d.example"],"n":1}'), ("t", 1, None, None)], "trace_id string, sequence int, content string, payload string")
    done, records, review = privacy.apply_policy(e, ["content"], ["payload"])
    assert {(r.location, r.kind) for r in records.collect()} == {("/events/0/content", "email"), ("/events/0/payload/<value:0>/0", "email")}
    r = review.first()
    assert (r.total_redactions, r.residual_findings, r.redaction_enabled) == (2, 0, True) and "@" not in str(done.collect())
    same, records, review = privacy.apply_policy(e, ["content"], ["payload"], enabled=False)
    odd = spark.createDataFrame([("t", 0, None, json.dumps({"k": 'a "quoted" \\\\ and ' + "x" * 100_000, "to": "e@f.example"}))], e.schema)
    assert privacy.apply_policy(odd, ["content"], ["payload"], enabled=False)[2].first().residual_findings == 1
    assert records.count() == 0 and review.first().residual_findings == 2 and "redaction_disabled_review_only" in review.first().warnings
    assert sorted(map(str, same.collect())) == sorted(map(str, e.collect()))
    with pytest.raises(Exception, match="duplicate"):
        spark.createDataFrame([('{"a@b.example":1,"<redacted:email:%s>":2}' % hashlib.sha256(b"a@b.example").hexdigest()[:12],)], "d string").select(privacy.redact_json()("d")).collect()


def test_oracles_and_their_mutations(spark):
    schema = "oracle_id string, kind string, path string, mode string, pointer string, expected string, sha256 string, min_bytes long, max_bytes long"
    rows = [("gone", "file", "none", "text_equals", None, "x", None, None, None), ("bytes", "file", "bin", "text_contains", None, "x", None, None, None), ("json", "json", "doc", "equals", "/a/0", '{"y": 1, "x": 2}', None, None, None), ("odd", "json", "bin", "exists", "/a", None, None, None, None), ("size", "artifact", "bin", None, None, None, None, 2, 2), ("nokey", "json", "doc", "absent", "/a/7", None, None, None, None), ("nofile", "json", "none", "absent", "/a", None, None, None, None)]
    files = spark.createDataFrame([("bin", bytearray(b"\xff\xfe")), ("doc", bytearray(b'{"a":[{"x":2,"y":1}]}'))], "path string, content binary")
    oracles = spark.createDataFrame(rows, schema)
    got = {r.oracle_id: (r.passed, r.error) for r in integrity.oracle_results(oracles, files).collect()}
    assert got == {"gone": (False, "file does not exist"), "bytes": (False, "not UTF-8"), "json": (True, None), "odd": (False, "no JSON document"), "size": (True, None), "nokey": (True, None), "nofile": (False, "file does not exist")}
    changed = {r.oracle_id: r.passed for r in integrity.oracle_results(integrity.mutated(oracles.where("oracle_id in ('json', 'size', 'nokey')")), files).collect()}
    assert changed == {"json": False, "size": False, "nokey": False}


def test_splits_predictions_and_dialogues_as_rows(spark):
    frame = lambda doc: spark.createDataFrame([("s", json.dumps(doc))], "source_name string, document string")
    split = documents.split_rows(frame({"id": "s", "dataset_id": "d", "train": ["a"], "validation": [], "sealed_test": ["b", "c"]}))
    assert {(r.role, r.example_id) for r in split.collect()} == {("train", "a"), ("sealed_test", "b"), ("sealed_test", "c")}
    made = documents.prediction_rows(frame({"variant_id": "v", "role": "train", "predictions": [{"example_id": "a", "outputs": {"y": 1, "x": [2]}}]})).first()
    assert (made.variant_id, made.example_id, made.outputs) == ("v", "a", '{"x":[2],"y":1}')
    turns, updates, probes = documents.dialogue_rows(frame({"id": "d", "tasks": [{"id": "t", "turns": [{"id": "a", "role": "user", "content": "x", "updates": [{"id": "u", "key": "k", "action": "set", "value": "1"}]}, {"id": "b", "role": "user", "content": "y"}], "probes": [{"id": "p", "after_turn_id": "b"}]}]}))
    assert updates.first().update_id == "u" and probes.first().turn == 1
    public = {r.turn: r.probe_ids for r in evaluation.public_corpus(updates, probes, turns).collect()}
    assert public == {0: None, 1: ["p"]}
    assert normalize.provenance(spark.createDataFrame([("a/b.json", bytearray(b"x"))], "path string, content binary")).first().source_sha256 == hashlib.sha256(b"x").hexdigest()


def test_datasets_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(integrity, "BLOB", 5000)
    n = 12_000
    ids = spark.range(n).repartition(7).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("s\""), F.col("id") % 3).alias("source"), F.lit(1).alias("toxic"))
    ids.drop("toxic").write.parquet(f"{tmp_path}/documents.parquet")
    ids.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    lines = ",".join(json.dumps({"id": f"doc-{i}", "inputs": {"number": str(i), "source": f's"{i % 3}'}}, separators=(",", ":")) for i in sorted(range(n), key=lambda i: f"doc-{i}"))
    want = hashlib.sha256(('{"examples":[' + lines + '],"input_fields":["number","source"]}').encode()).hexdigest()
    assert [tuple(r) for r in QUERIES["dataset_public_digest"](spark, str(tmp_path)).collect()] == [("en", n, want)]


def test_chains_go_through_all_users(spark, tmp_path):
    events = [(i, 1000 - i // 2, None if i % 11 == 0 else i % 50) for i in range(2000)]
    spark.createDataFrame(events, "event_id long, ts long, user_id long").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got, want = {r.event_id: r.depth for r in QUERIES["span_depths"](spark, str(tmp_path)).collect()}, {}
    for g in (0, 1, 2, None):
        rows = sorted((ts, i) for i, ts, u in events if (u if u is None else u % 3) == g)
        want |= {i: n % 150 for n, (_, i) in enumerate(rows)}
    assert got == want


def test_numbers_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), (F.col("id") % 2).alias("g")).repartition(6)
        n = integrity.numbered(rows, "g", F.col("v"))
        both = n.withColumn("m", F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1).collect()
        assert len(both) == 3000 and all(r.n == r.m for r in both)
        assert spark.read.parquet(n._written_to).select("range_").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_listings_of_any_size(spark, tmp_path):
    n = 101_000
    listed = spark.range(n).repartition(5).select(F.concat(F.lit("é/"), F.col("id")).alias("path"), F.col("id").alias("size"), F.lit("ab").alias("sha256"), F.lit(None).cast("int").alias("tree"))
    lines = ",".join(f'{{"path":"é/{i}","sha256":"ab","size":{i}}}' for i in sorted(range(n), key=str))
    assert [tuple(r) for r in integrity.listing_digest(listed, "tree").collect()] == [(None, n, hashlib.sha256(f"[{lines}]".encode()).hexdigest())]
    far = [(k * 600_000, "x") for k in range(14)]
    spark.createDataFrame(far, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {(r.tree, r.entries) for r in QUERIES["listing_digest"](spark, str(tmp_path)).collect()} == {(t, 2) for t in range(7)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["runs", "checks", "failure_records"])
def test_a_document_is_parsed_once(spark, name):
    rows = store.normalize(spark.createDataFrame([("a", json.dumps(result()))], "source_name string, document string"))[name]
    plan = plan_of(rows.drop("details_json"))
    assert plan.count("ArrowEvalPython [judge(") == 1 and plan.count("from_json(") == 1


def test_artifacts_of_orders_are_dealt_out_by_their_number_only(spark, sf):
    from plumbline.queries import artifacts

    plan = plan_of(artifacts(spark, sf))
    assert plan.count("FileScan parquet") == 2 and "hashpartitioning(run_key" not in plan and "hashpartitioning(check_key" not in plan


def test_summary_of_an_array_of_failures(spark):
    rows = [("r", k, f"c{k}", t[1], t[0], t[2]) for k, t in enumerate(TAXONOMY[i] for i in (1, 0, 5, 3, 0, 11))]
    f = spark.createDataFrame(rows, "run_key string, check_index int, check_id string, category string, code string, impact string")
    want = runs.failure_summary(f).drop("run_key").first().asDict()
    got = f.agg(F.collect_list(F.struct("check_index", "check_id", "category", "code", "impact")).alias("f")).select(runs.summary_of(F.col("f")).alias("s")).first().s.asDict()
    assert got == want and (got["primary_check_id"], got["total"]) == ("c2", 6)
    assert f.where("false").agg(F.collect_list(F.struct("check_index", "check_id", "category", "code", "impact")).alias("f")).select(runs.summary_of(F.col("f")).alias("s")).first().s is None


@pytest.mark.parametrize("brackets", [126, 127, 128])
def test_depth_counts_what_lies_innermost(spark, brackets):
    rows = spark.createDataFrame([("a", '{"x":' + "[" * brackets + "1" + "]" * brackets + "}")], "source_name string, document string")
    fault = rows.select(documents.shape_fault()("document")).first()[0]
    assert fault == (None if brackets + 2 <= documents.MAX_DEPTH else "nested too deep")


def test_faults_do_not_deal_out_documents_and_name_a_content_once(spark):
    from plumbline.sources.artifacts import artifact_faults

    docs = spark.createDataFrame([(f"{n}{k}", d) for n, d in (("bad", "{"), ("good", json.dumps(result())), ("odd", "[]")) for k in (3, 1, 2)], "source_name string, document string")
    faults = artifact_faults(docs)
    assert "first(document" not in plan_of(faults)
    assert {(r.source_name, r.source_sha256, r.fault) for r in faults.collect()} == {(n, hashlib.sha256(d).hexdigest(), "not a strict JSON object") for n, d in (("bad1", b"{"), ("odd1", b"[]"))} and faults.count() == 2


def exchanged(df):
    """The columns by which a plan deals rows out."""
    return re.findall(r"hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan_of(df)))


def test_status_of_runs_deals_lines_out_by_number_only(spark, sf):
    plan = plan_of(QUERIES["run_status"](spark, sf))
    assert "hashpartitioning(run_key" not in plan and "hashpartitioning(check_key" not in plan and "Window" not in plan


def test_failures_of_tables_that_come_together_are_those_of_the_tables(spark, sf):
    from plumbline.plans import evidence as ev

    together = ev.store_tables(spark, sf)
    for name in ("failures", "failure_taxonomy"):
        alone, joined = views.view(dict(together), name), views.view(together, name)
        assert alone.columns == joined.columns and alone.exceptAll(joined).count() == joined.exceptAll(alone).count() == 0
    assert not any(x.startswith(("run_key", "check_key")) for x in exchanged(views.view(together, "failures")))


def test_taxonomy_counts_runs_and_capsules_once(spark):
    r = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("c", "z"), ("d", None)], "run_key string, capsule_id string")
    c = spark.createDataFrame([(f"{run}{k}", run, k, d) for run in "abcd" for k, d in ((0, 1.0), (1, None), (2, 4.0))], "check_key string, run_key string, check_index int, duration_seconds double")
    f = c.where("run_key <> 'a' or check_index < 2").select("check_key", "run_key", F.lit("task").alias("category"), F.when(F.col("check_index") == 1, "timeout").otherwise("unexpected_exit").alias("code"), F.lit("i").alias("impact"), F.lit("no").alias("retryability"), F.lit("s").alias("summary"), F.lit("{}").alias("details_json"), F.lit(None).cast("string").alias("caused_by_check_id"), F.lit("[]").alias("causes_json"))
    rows = {x.failure_code: (x.occurrences, x.runs, x.capsules, x.mean_duration_seconds) for x in views.failure_taxonomy({"runs": r, "checks": c, "failure_records": f}).collect()}
    assert rows == {"unexpected_exit": (9, 4, 3, 21.0 / 9), "timeout": (5, 4, 3, None)}


def test_taxonomy_deals_out_failures_and_runs_by_number_only(spark, sf):
    dealt = exchanged(QUERIES["view_failure_taxonomy"](spark, sf))
    assert not any(re.search("run_key|check_key", x) for x in dealt) and "Expand" not in plan_of(QUERIES["view_failure_taxonomy"](spark, sf))


def test_first_rows_of_the_taxonomy_deal_out_failures_and_runs_by_number_only(spark, sf):
    assert not any(re.search("run_key|check_key", x) for x in exchanged(QUERIES["view_query_taxonomy"](spark, sf)))


def test_digest_of_the_taxonomy_deals_out_failures_and_runs_by_number_only(spark, sf):
    assert not any(re.search("run_key|check_key", x) for x in exchanged(QUERIES["memory_digest"](spark, sf)))


def test_runs_of_artifacts_are_parsed_once_and_not_dealt_out_by_run_digests(spark, sf):
    plan = plan_of(QUERIES["artifact_runs"](spark, sf))
    assert plan.count("ArrowEvalPython [judge(") == 1 and plan.count("from_json(") == 1
    assert "hashpartitioning(run_key" not in plan and "hashpartitioning(check_key" not in plan
