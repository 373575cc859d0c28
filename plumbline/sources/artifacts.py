"""Artifacts of runs and experiments, and what is wrong with those that may not be stored.

A document must be strict JSON of the schema (`documents.shape_of`) and agree
with itself: what it says of its runs, checks, failures and summaries is compared
in the JVM, on the parsed document, with what follows from its parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import strict_or_none
from plumbline.schemas import IMPACT_RANK, STATUS_CODES, TAXONOMY
from plumbline.sources.documents import check_of, shape_of

MAX_DETAILS_BYTES = 4096
#: Keys that failure details never hold, in any case.
FORBIDDEN_DETAILS = ("stdout", "stderr", "output_text", "raw_output")
COMPACT = json.JSONEncoder(separators=(",", ":"))
RUN_STATUSES = ("passed", "failed", "error")

FAILURE = "struct<schema_version:string,category:string not null,code:string not null,impact:string not null,retryability:string not null,summary:string not null,details:string comment 'object',caused_by_check_id:string,causes:array<string>>"
CHECK = f"struct<id:string not null,argv:array<string> not null,cwd:string not null,status:string not null,exit_code:int,duration_seconds:double not null,stdout:string,stderr:string,stdout_truncated:boolean,stderr_truncated:boolean,error:string,failure:{FAILURE}>"
FAILURE_SUMMARY = "struct<schema_version:string,total:int,evaluation_failures:int,infrastructure_errors:int,not_evaluated:int,by_category:map<string,int>,by_code:map<string,int>,primary_check_id:string,primary_code:string>"
RESULT = f"capsule_id:string not null,status:string not null,started_at:timestamp not null,finished_at:timestamp not null,duration_seconds:double not null,checks:array<{CHECK}> not null,failure_summary:{FAILURE_SUMMARY}"
RUN = f"struct<run_id:string not null,variant_id:string not null,variant_sha256:string,repetition:int not null,trace_id:string not null,result:struct<{RESULT}> not null>"
SUMMARY = "struct<variant_id:string not null,runs:int not null,passed:int not null,failed:int not null,errors:int not null,pass_rate:double not null,mean_duration_seconds:double not null>"
EXPERIMENT = f"schema_version:string,experiment_id:string not null,capsule_id:string not null,started_at:timestamp not null,finished_at:timestamp not null,duration_seconds:double not null,runs:array<{RUN}> not null,summaries:array<{SUMMARY}> not null"
#: What both kinds are parsed with.
ARTIFACT = f"schema_version:string,experiment_id:string,{RESULT},runs:array<{RUN}>,summaries:array<{SUMMARY}>".replace(" not null", "")
RESULT_FIELDS = ("capsule_id", "status", "started_at", "finished_at", "duration_seconds", "checks", "failure_summary")

Faults = list[tuple[str, Column]]


def detail_fault(value: object) -> str | None:
    """What keeps failure details from being kept: a forbidden key at any depth, or too many bytes."""
    if not value:
        return None
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if any(k.casefold() in FORBIDDEN_DETAILS for k in v):
                return "failure details hold raw output"
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return "failure details are too long" if len(COMPACT.encode(value)) > MAX_DETAILS_BYTES else None


def details_in(artifact: dict) -> Iterator[object]:
    """The failure details of an artifact's checks, of both kinds."""
    for result in [artifact, *(r["result"] for r in artifact.get("runs") or ())]:
        for check in result.get("checks") or ():
            if check.get("failure") and check["failure"].get("details") is not None:
                yield check["failure"]["details"]


def judged():
    """UDF document -> (is_experiment, shape, details): the kind of an artifact, what keeps it from its schema, and the first fault of its failure details. A document is parsed once for all of it; details count at any depth, so this runs in Arrow batches in Python."""
    checks = {True: check_of(T.StructType.fromDDL(EXPERIMENT)), False: check_of(T.StructType.fromDDL(RESULT))}

    def of(text: str | None) -> tuple[bool, str | None, str | None]:
        value = strict_or_none(text)
        experiment = isinstance(value, dict) and "experiment_id" in value
        shape = shape_of(text, value, checks[experiment])
        return experiment, shape, None if shape else next((f for d in details_in(value) if (f := detail_fault(d))), None)

    @F.pandas_udf(T.StructType([T.StructField("is_experiment", T.BooleanType()), T.StructField("shape", T.StringType()), T.StructField("details", T.StringType())]))
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(t) for t in texts], columns=["is_experiment", "shape", "details"])

    return judge


def count_of(rows: Column, holds) -> Column:  # noqa: ANN001
    return F.size(F.filter(rows, holds))


def repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) < F.size(values)


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1e-12), 1e-12 * F.greatest(F.abs(a), F.abs(b)))


def taken_from(code: Column, nth: int) -> Column:
    """The category, impact or retryability (1, 2, 3) that a code has."""
    return F.element_at(F.create_map(*(F.lit(x) for row in TAXONOMY for x in (row[0], row[nth]))), code)


def rank(impact: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in IMPACT_RANK.items() for x in kv)), impact)


def wrong_check(c: Column) -> Column:
    f = c["failure"]
    allowed = F.element_at(F.create_map(*(x for s, codes in STATUS_CODES.items() for x in (F.lit(s), F.array(*map(F.lit, codes)).cast("array<string>")))), c["status"])
    return F.when(allowed.isNull() | (c["duration_seconds"] < 0), True).when(c["status"] == "passed", f.isNotNull()).otherwise(f.isNull() | ~F.array_contains(allowed, f["code"]))


def wrong_failure(f: Column) -> Column:
    causes = F.coalesce(f["causes"], F.array().cast("array<string>"))
    skipped = f["code"] == "skipped_after_failure"
    known = taken_from(f["code"], 1).isNotNull() & (f["category"] == taken_from(f["code"], 1)) & (f["impact"] == taken_from(f["code"], 2)) & (f["retryability"] == taken_from(f["code"], 3))
    return ~F.coalesce(known, F.lit(False)) | F.array_contains(causes, f["code"]) | repeats(causes) | (skipped != f["caused_by_check_id"].isNotNull()) | ~F.length(f["summary"]).between(1, 255)


def wrong_order(checks: Column) -> Column:
    """Skipped checks end a run, directly after the check that did not pass, which they name."""
    first = F.array_position(F.transform(checks, lambda c: c["status"]), "skipped").cast("int")
    before = F.get(checks, first - 2)
    rest = F.slice(checks, F.greatest(first, F.lit(1)), F.greatest(F.size(checks), F.lit(1)))
    right = (first > 1) & (before["status"] != "passed") & F.forall(rest, lambda c: (c["status"] == "skipped") & c["failure"]["caused_by_check_id"].eqNullSafe(before["id"]))
    return (first > 0) & ~F.coalesce(right, F.lit(False))


def wrong_summary(checks: Column, s: Column) -> Column:
    """A failure summary that does not follow from the checks; a missing one stands for no failures."""
    failed = F.filter(F.transform(checks, lambda c, i: F.struct(rank(c["failure"]["impact"]).alias("rank"), i.alias("at"), c["id"].alias("id"), c["failure"].alias("f"))), lambda x: x["f"].isNotNull())
    first = F.array_min(F.transform(failed, lambda x: F.struct(x["rank"], x["at"], x["id"].alias("id"), x["f"]["code"].alias("code"))))
    total = lambda name: F.coalesce(s[name], F.lit(0))
    of = lambda impact: count_of(failed, lambda x: x["f"]["impact"] == impact)

    def counts(name: str, field: str) -> Column:
        entries = F.map_entries(F.coalesce(s[name], F.create_map().cast("map<string,int>")))
        return F.forall(entries, lambda e: (e["value"] > 0) & (e["value"] == count_of(failed, lambda x: x["f"][field] == e["key"]))) & (F.aggregate(entries, F.lit(0), lambda n, e: n + e["value"]) == F.size(failed))

    right = (total("total") == F.size(failed)) & (total("evaluation_failures") == of("evaluation_failure")) & (total("infrastructure_errors") == of("infrastructure_error")) & (total("not_evaluated") == of("not_evaluated")) & counts("by_category", "category") & counts("by_code", "code") & s["primary_check_id"].eqNullSafe(first["id"]) & s["primary_code"].eqNullSafe(first["code"])
    return ~F.coalesce(right, F.lit(False))


def status_of(checks: Column) -> Column:
    return F.when(F.exists(checks, lambda c: F.coalesce(c["failure"]["impact"] == "infrastructure_error", F.lit(False))), "error").when(F.exists(checks, lambda c: c["status"] != "passed"), "failed").otherwise("passed")


def result_faults(r: Column) -> Faults:
    checks = r["checks"]
    failures = F.filter(F.transform(checks, lambda c: c["failure"]), lambda f: f.isNotNull())
    return [
        ("run status unknown", ~r["status"].isin(*RUN_STATUSES)),
        ("run ends before it starts", (r["finished_at"] < r["started_at"]) | (r["duration_seconds"] < 0)),
        ("check ids repeat", repeats(F.transform(checks, lambda c: c["id"]))),
        ("check status and failure disagree", F.exists(checks, wrong_check)),
        ("failure is not of its code", F.exists(failures, wrong_failure)),
        ("skipped checks out of place", wrong_order(checks)),
        ("failure summary is not that of the checks", wrong_summary(checks, r["failure_summary"])),
        ("run status is not that of the checks", r["status"] != status_of(checks)),
    ]


def first_of(faults: Faults) -> Column:
    return F.coalesce(*(F.when(F.coalesce(holds, F.lit(False)), name) for name, holds in faults))


def experiment_faults(a: Column) -> Faults:
    runs, summaries = a["runs"], a["summaries"]
    variants, named = F.transform(runs, lambda r: r["variant_id"]), F.transform(summaries, lambda s: s["variant_id"])

    def wrong(s: Column) -> Column:
        own = F.filter(runs, lambda r: r["variant_id"] == s["variant_id"])
        of = lambda status: count_of(own, lambda r: r["result"]["status"] == status)
        mean = F.aggregate(own, F.lit(0.0), lambda t, r: t + r["result"]["duration_seconds"]) / F.greatest(F.size(own), F.lit(1))
        return (s["runs"] != F.size(own)) | (s["passed"] != of("passed")) | (s["failed"] != of("failed")) | (s["errors"] != of("error")) | ~close(s["pass_rate"], s["passed"] / F.greatest(s["runs"], F.lit(1))) | ~close(s["mean_duration_seconds"], mean)

    return [
        ("experiment ends before it starts", (a["finished_at"] < a["started_at"]) | (a["duration_seconds"] < 0)),
        ("experiment without runs or summaries", (F.size(runs) < 1) | (F.size(summaries) < 1)),
        ("run ids repeat", repeats(F.transform(runs, lambda r: r["run_id"])) | repeats(F.transform(runs, lambda r: r["trace_id"]))),
        ("matrix cells repeat", repeats(F.transform(runs, lambda r: F.struct(r["variant_id"], r["repetition"])))),
        ("run of another capsule", F.exists(runs, lambda r: r["result"]["capsule_id"] != a["capsule_id"])),
        ("run outside the experiment", F.exists(runs, lambda r: (r["result"]["started_at"] < a["started_at"]) | (r["result"]["finished_at"] > a["finished_at"]))),
        ("summaries are not of the variants", repeats(named) | (F.array_sort(named) != F.array_sort(F.array_distinct(variants)))),
        ("summary is not that of its runs", F.exists(summaries, wrong)),
    ]


def judgements(documents: DataFrame) -> DataFrame:
    """Documents (source_sha256, source_name, document) with a (the parsed document), is_experiment and fault, which is null for those that may be stored. One with an experiment_id is an experiment, any other a single run."""
    rows = documents.select("source_sha256", "source_name", F.from_json("document", f"struct<{ARTIFACT}>").alias("a"), judged()("document").alias("j")).select("source_sha256", "source_name", "a", "j.*")
    results = F.when(F.col("is_experiment"), F.transform("a.runs", lambda r: r["result"])).otherwise(F.array(F.struct(*(F.col(f"a.{name}") for name in RESULT_FIELDS))))
    agrees = F.coalesce(F.when(F.col("is_experiment"), first_of(experiment_faults(F.col("a")))), F.get(F.array_compact(F.transform(results, lambda r: first_of(result_faults(r)))), 0))
    fault = F.coalesce("shape", F.when(F.col("shape").isNull(), agrees), "details")
    # From an explode, as what filters by the fault would else be pushed below the parsing, and have each document parsed again for each field that it compares.
    return rows.select("source_sha256", "source_name", "a", "is_experiment", F.explode(F.array(fault)).alias("fault"))


def parsed(artifacts: DataFrame) -> DataFrame:
    """The judgements of artifacts (source_name, document) by content: source_sha256 and the first source_name of each. Documents are told apart by their digests before anything is parsed."""
    return judgements(artifacts.groupBy(F.sha2("document", 256).alias("source_sha256")).agg(F.min("source_name").alias("source_name"), F.first("document").alias("document")))


def artifact_faults(artifacts: DataFrame) -> DataFrame:
    """source_name, source_sha256, fault of the artifacts that may not be stored, each content once. Documents are judged where they lie, and told apart by their digests after that: only these, names and faults are dealt out."""
    faults = judgements(artifacts.select(F.sha2("document", 256).alias("source_sha256"), "source_name", "document")).where("fault is not null")
    return faults.groupBy("source_sha256").agg(F.min(F.struct("source_name", "fault")).alias("first")).select("first.source_name", "source_sha256", "first.fault")
