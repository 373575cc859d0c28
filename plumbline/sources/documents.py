"""Strict JSON documents as rows: datasets, splits, predictions, dialogue corpora, capsules, experiments.

A document that is no strict JSON object, has fields its schema does not know,
values of another kind, or lacks one it needs is reported as a fault rather than
read as nulls.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import canonical_json, strict_or_none

MAX_BYTES, MAX_DEPTH = 10 << 20, 128
#: Field lists of the documents, as DDL; open values stay JSON text.
SCHEMAS = {
    "dataset": "schema_version string, id string not null, examples array<struct<id:string not null,inputs:map<string,string> not null,outputs:string not null comment 'object',metadata:string comment 'object'>> not null, metadata string comment 'object'",
    "split": "schema_version string, id string not null, dataset_id string not null, train array<string> not null, validation array<string> not null, sealed_test array<string> not null, metadata string comment 'object'",
    "predictions": "schema_version string, id string, variant_id string not null, variant_sha256 string, role string not null, predictions array<struct<example_id:string not null,outputs:string not null comment 'object'>> not null, metadata string comment 'object'",
    "dialogue": "schema_version string, id string not null, tasks array<struct<id:string not null,turns:array<struct<id:string not null,role:string not null,content:string not null,updates:array<struct<id:string not null,key:string not null,action:string not null,value:string,supersedes:string>>>> not null,probes:array<struct<id:string not null,after_turn_id:string not null>> not null>> not null, metadata string comment 'object'",
    "capsule": "schema_version string, id string not null, goal string not null, initial_state struct<working_directory:string>, allowed_actions struct<tools:array<string>,network:string>, limits struct<max_commands:int,default_timeout_seconds:double,max_output_chars:int>, sandbox string comment 'object', success struct<commands:array<struct<id:string not null,argv:array<string> not null,description:string,cwd:string,env:map<string,string>,timeout_seconds:double,expected_exit_codes:array<int>,continue_on_failure:boolean>> not null> not null, metadata string comment 'object'",
    "experiment": "schema_version string, id string not null, capsule string not null, workspace string, repetitions int, variants array<struct<id:string not null,description:string,env:map<string,string>,metadata:string comment 'object'>> not null, metadata string comment 'object'",
}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """source_name, document, size and digest of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_name"), F.when(F.col("length") <= MAX_BYTES, F.try_validate_utf8(F.col("content").cast("string"))).alias("document"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("source_sha256"))


def depth(value: object) -> int:
    """How deep a JSON value nests, without recursion."""
    deepest, todo = 0, [(value, 1)]
    while todo:
        v, d = todo.pop()
        deepest = max(deepest, d)
        if isinstance(v, dict | list):
            todo += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


MOMENT = re.compile(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d(:\d\d(\.\d+)?)?([Zz]|[+-]\d\d:?\d\d)")


def is_moment(text: str) -> bool:
    """Whether a text is a time with its zone, of a day that the calendar has."""
    if MOMENT.fullmatch(text) is None:
        return False
    try:
        datetime.fromisoformat(text.upper())
    except ValueError:
        return False
    return True


PLAIN: list[tuple[type[T.DataType] | tuple, str, object]] = [
    (T.BooleanType, "a boolean", lambda v: isinstance(v, bool)),
    (T.IntegralType, "a whole number", lambda v: isinstance(v, int) and not isinstance(v, bool)),
    (T.FractionalType, "a finite number", lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)),
    (T.TimestampType, "a time with its zone", lambda v: isinstance(v, str) and is_moment(v)),
    (T.StringType, "a text", lambda v: isinstance(v, str)),
]


#: What Python's own type says enough of.
SURE: dict[type[T.DataType], type] = {T.StringType: str, T.BooleanType: bool, T.IntegerType: int, T.LongType: int}
Check = Callable[[object], str | None]


def plain(name: str, fits: Callable[[object], bool]) -> Check:
    fault = f": not {name}"
    return lambda v: None if fits(v) else fault


def struct_check(kind: T.StructType) -> Check:
    names = frozenset(kind.names)
    fields = [(f.name, f.nullable, SURE.get(type(f.dataType)) if not f.metadata.get("comment") else None, check_of(f.dataType, f.metadata.get("comment"))) for f in kind]

    def check(value: object) -> str | None:
        if not isinstance(value, dict):
            return ": not an object"
        if not value.keys() <= names:
            return f"/{min(value.keys() - names)}: unknown field"
        for name, nullable, sure, fits in fields:
            v = value.get(name)
            if type(v) is sure:
                continue
            if v is None:
                if not nullable:
                    return f"/{name}: missing"
            elif fault := fits(v):
                return f"/{name}{fault}"
        return None

    return check


def array_check(kind: T.ArrayType) -> Check:
    fits = check_of(kind.elementType)

    def check(value: object) -> str | None:
        if not isinstance(value, list):
            return ": not an array"
        for k, v in enumerate(value):
            if fault := fits(v):
                return f"/{k}{fault}"
        return None

    return check


def map_check(kind: T.MapType) -> Check:
    fits = check_of(kind.valueType)

    def check(value: object) -> str | None:
        if not isinstance(value, dict):
            return ": not an object"
        for k, v in value.items():
            if fault := fits(v):
                return f"/{k}{fault}"
        return None

    return check


def check_of(kind: T.DataType, comment: str | None = None) -> Check:
    """What tells the place, from the value on, where a JSON value first departs from a schema, or null. It is made once for all values. Fields that are not null are needed; a text field with the comment json holds any value, with object an object."""
    if comment == "json":
        return lambda v: None
    if comment == "object":
        return plain("an object", lambda v: isinstance(v, dict))
    for composite, made in ((T.StructType, struct_check), (T.ArrayType, array_check), (T.MapType, map_check)):
        if isinstance(kind, composite):
            return made(kind)
    return plain(*next((n, f) for t, n, f in PLAIN if isinstance(kind, t)))


def shape_of(text: str | None, value: object, check: Check | None = None) -> str | None:
    """What keeps a text, parsed by strict_or_none, from being a JSON object, and one that passes the check if one is given."""
    if not isinstance(value, dict):
        return "not a strict JSON object"
    if text.count("{") + text.count("[") >= MAX_DEPTH and depth(value) > MAX_DEPTH:
        return "nested too deep"
    fault = check(value) if check else None
    return f"/{fault}" if fault and fault[0] == ":" else fault


def shape_fault(ddl: str | None = None):
    """UDF: shape_of() of JSON texts; null if nothing is wrong. Spark's own reader takes repeated keys, NaN and fields of other types, so this runs in Arrow batches in Python."""
    check = check_of(T.StructType.fromDDL(ddl)) if ddl else None

    @F.pandas_udf(T.StringType())
    def judge(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shape_of(t, strict_or_none(t), check))

    return judge


def document_faults(documents: DataFrame, kind: str) -> DataFrame:
    """source_name, fault: no strict JSON object, or the first place that departs from the kind's schema."""
    return documents.select("source_name", shape_fault(SCHEMAS[kind])("document").alias("fault")).where("fault is not null")


def parse(documents: DataFrame, kind: str) -> DataFrame:
    """The fields of documents, which should have no faults."""
    return documents.select("source_name", F.from_json("document", SCHEMAS[kind]).alias("d")).select("source_name", "d.*")


def dataset_rows(documents: DataFrame) -> DataFrame:
    e = parse(documents, "dataset").select(F.col("id").alias("dataset_id"), F.explode("examples").alias("e"))
    return e.select("dataset_id", F.col("e.id").alias("example_id"), "e.inputs", canonical_json("e.outputs").alias("outputs"))


def split_rows(documents: DataFrame) -> DataFrame:
    d = parse(documents, "split")
    return d.select("dataset_id", F.explode(F.create_map(*(x for r in ("train", "validation", "sealed_test") for x in (F.lit(r), F.coalesce(r, F.array().cast("array<string>")))))).alias("role", "ids")).select("dataset_id", "role", F.explode("ids").alias("example_id"))


def prediction_rows(documents: DataFrame) -> DataFrame:
    p = parse(documents, "predictions").select("variant_id", "role", F.explode("predictions").alias("p"))
    return p.select("variant_id", "role", F.col("p.example_id").alias("example_id"), canonical_json("p.outputs").alias("outputs"))


def dialogue_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """turns, updates and probes of dialogue corpora."""
    t = parse(documents, "dialogue").select(F.explode("tasks").alias("t")).select(F.col("t.id").alias("task_id"), "t.turns", "t.probes")
    turns = t.select("task_id", F.posexplode("turns").alias("turn", "u"))
    updates = turns.select("task_id", "turn", F.posexplode("u.updates").alias("ord", "x")).select("task_id", "turn", "ord", F.col("x.id").alias("update_id"), "x.key", "x.action", "x.value", "x.supersedes")
    after = turns.select("task_id", "turn", F.col("u.id").alias("after_turn_id"))
    probes = t.select("task_id", F.explode("probes").alias("p")).select("task_id", F.col("p.id").alias("probe_id"), F.col("p.after_turn_id").alias("after_turn_id")).join(after, ["task_id", "after_turn_id"])
    return turns.select("task_id", "turn", F.col("u.id").alias("turn_id"), "u.role", "u.content"), updates, probes.select("task_id", "probe_id", "turn")


def capsule_rows(documents: DataFrame) -> DataFrame:
    """capsule_id, check_index and the checks of capsules, with what a check leaves to its capsule: thirty seconds if neither says, the working directory, exit code 0."""
    c = parse(documents, "capsule").select(F.col("id").alias("capsule_id"), "limits", "initial_state", F.posexplode("success.commands").alias("check_index", "c"))
    return c.select("capsule_id", "check_index", F.col("c.id").alias("check_id"), "c.argv", F.coalesce("c.cwd", F.lit(".")).alias("cwd"), F.coalesce("initial_state.working_directory", F.lit(".")).alias("working_directory"), F.coalesce("c.timeout_seconds", "limits.default_timeout_seconds", F.lit(30.0)).alias("timeout_seconds"), F.array_sort(F.coalesce("c.expected_exit_codes", F.array(F.lit(0)))).alias("expected_exit_codes"), F.coalesce("c.continue_on_failure", F.lit(False)).alias("continue_on_failure"))


def capsule_faults(documents: DataFrame) -> DataFrame:
    """source_name, fault of capsules: shape, repeated check ids, more checks than the limit, or checks without the command tool."""
    d = parse(documents, "capsule")
    ids = F.transform("success.commands", lambda c: c["id"])
    fault = F.when(F.size(F.array_distinct(ids)) < F.size(ids), "check ids repeat").when(F.size(ids) > F.coalesce("limits.max_commands", F.lit(50)), "more checks than the limit").when(~F.array_contains(F.coalesce("allowed_actions.tools", F.array(F.lit("command"))), "command"), "checks need the command tool")
    return document_faults(documents, "capsule").unionByName(d.select("source_name", fault.alias("fault")).where("fault is not null"))


def experiment_rows(documents: DataFrame) -> DataFrame:
    """experiment_id, capsule, repetitions, variant_id, variant_sha256 (of the variant in canonical form) of experiments."""
    e = parse(documents, "experiment").select(F.col("id").alias("experiment_id"), "capsule", F.coalesce("repetitions", F.lit(1)).alias("repetitions"), F.explode("variants").alias("v"))
    return e.select("experiment_id", "capsule", "repetitions", F.col("v.id").alias("variant_id"), F.sha2(canonical_json(F.to_json("v")), 256).alias("variant_sha256"))
