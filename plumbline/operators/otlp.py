"""Trace exports in OTLP's JSON form, as spans and as events; what is out of shape becomes a row that says so, never an exception.

A document is parsed once in the JVM: resources and scopes by a fixed schema, spans
as VARIANT, as fields of another type than the format's are faults that a fixed
schema would turn into nulls. Only attribute lists, whose values nest without end,
go through an Arrow batch function, one call for all lists of a span; it returns
values and fault side by side.

Times are nanoseconds as bigint; those beyond it (after the year 2262) are faults.
Spans are kept apart by their source, so exports that share a trace id stay apart.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import canonical, nanos_to_timestamp, strict_json

# The forms of a value, of which it has exactly one.
FORMS = ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue")
INTEGER = re.compile("-?[0-9]+")
EXPORT = "resourceSpans array<struct<resource:struct<attributes:string>,schemaUrl:string,scopeSpans:array<struct<scope:struct<name:string,version:string,attributes:string>,schemaUrl:string,spans:array<variant>>>>>"


class AttributeFault(ValueError):
    """What is wrong with an attribute value, and where."""


def integer(raw: object, at: str) -> int:
    """64-bit integers come as numbers or as text."""
    if isinstance(raw, bool) or not (isinstance(raw, int) or isinstance(raw, str) and INTEGER.fullmatch(raw)):
        raise AttributeFault(f"{at}: no integer")
    number = int(raw)
    if not -(1 << 63) <= number < 1 << 63:
        raise AttributeFault(f"{at}: over 64 bits")
    return number


def values_of(raw: object, at: str) -> list:
    values = raw.get("values", []) if isinstance(raw, dict) else None
    if not isinstance(values, list):
        raise AttributeFault(f"{at}: no list of values")
    return values


def any_value(value: object, at: str = "") -> object:
    """The plain JSON value of an OTLP value."""
    forms = [f for f in FORMS if f in value] if isinstance(value, dict) else []
    if len(forms) != 1:
        raise AttributeFault(f"{at}: {len(forms)} forms of a value")
    form, raw, at = forms[0], value[forms[0]], f"{at}/{forms[0]}"
    if form == "arrayValue":
        return [any_value(v, f"{at}/{k}") for k, v in enumerate(values_of(raw, at))]
    if form == "kvlistValue":
        return attribute_map(values_of(raw, at), at)
    if form == "intValue":
        return integer(raw, at)
    if form == "doubleValue":
        if isinstance(raw, bool) or not isinstance(raw, int | float) or not math.isfinite(raw):
            raise AttributeFault(f"{at}: no finite number")
        return float(raw)
    if not isinstance(raw, bool if form == "boolValue" else str):
        raise AttributeFault(f"{at}: of another type")
    return raw


def attribute_map(items: object, at: str = "") -> dict[str, object]:
    """A list of keys and values as an object; a key twice is a fault."""
    out: dict[str, object] = {}
    for k, item in enumerate(items if isinstance(items, list) else [None]):
        key = item.get("key") if isinstance(item, dict) else None
        if not isinstance(key, str) or not key:
            raise AttributeFault(f"{at}/{k}: no key" if isinstance(items, list) else f"{at}: no list")
        if key in out:
            raise AttributeFault(f"{at}/{k}: key repeats")
        out[key] = any_value(item.get("value"), f"{at}/{k}")
    return out


@F.pandas_udf(T.StructType([T.StructField("values", T.ArrayType(T.StringType())), T.StructField("fault", T.StringType())]))
def decoded(lists: pd.Series) -> pd.DataFrame:
    """Of each row's attribute lists (JSON text, null where there is none): canonical JSON objects, and the first fault, whose location begins with the list's place."""

    def of(texts) -> tuple[list[str] | None, str | None]:
        try:
            return [canonical(attribute_map(strict_json(t), str(k))) if t is not None else "{}" for k, t in enumerate(texts)], None
        except AttributeFault as fault:
            return None, str(fault)
        except (ValueError, RecursionError):
            return None, "no JSON that can be read"

    return pd.DataFrame([of(t) if t is not None else (None, None) for t in lists], columns=["values", "fault"])


def field(span: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(span, f"$.{name}", kind)


def text_field(span: Column, name: str) -> Column:
    """A field that is text and not empty, else null."""
    return F.when(F.schema_of_variant(field(span, name)) == "STRING", F.nullif(field(span, name, "string"), F.lit("")))


def nanos_field(span: Column, name: str) -> Column:
    """A count of nanoseconds from 0, given as an integer or as its text, else null."""
    raw = field(span, name, "string")
    number = F.when(raw.rlike("^-?[0-9]+$"), raw.try_cast("bigint"))
    return F.when(number >= 0, number)


def is_hex(text: Column, digits: int) -> Column:
    """Hexadecimal of so many digits, not all of them zero."""
    return F.coalesce(text.rlike(f"^[0-9a-f]{{{digits}}}$") & ~text.rlike("^0+$"), F.lit(False))


def exports(documents: DataFrame) -> DataFrame:
    return documents.select("source_name", F.from_json("document", EXPORT).alias("d"))


def spans(documents: DataFrame) -> DataFrame:
    """One row per span: lower-case ids, times, kind and status (JSON text as given), attributes of the span, its resource and its scope (canonical JSON), its events, and what is wrong with it."""
    r = exports(documents).select("source_name", F.posexplode("d.resourceSpans").alias("i", "r")).withColumn("of_resource", decoded(F.array("r.resource.attributes")))
    s = r.select("source_name", "i", "of_resource", F.col("r.schemaUrl").alias("resource_schema_url"), F.posexplode("r.scopeSpans").alias("j", "s")).withColumn("of_scope", decoded(F.array("s.scope.attributes")))
    carried = ["source_name", "i", "j", "resource_schema_url", "of_resource", "of_scope"]
    p = s.select(*carried, F.col("s.scope.name").alias("scope_name"), F.col("s.scope.version").alias("scope_version"), F.col("s.schemaUrl").alias("scope_schema_url"), F.posexplode("s.spans").alias("k", "p"))
    events = field(F.col("p"), "events")
    listed = F.when(events.isNull(), F.array().cast("array<variant>")).otherwise(F.try_variant_get(F.col("p"), "$.events", "array<variant>"))
    p = p.withColumn("e", listed)
    p = p.withColumn("of_span", decoded(F.concat(F.array(F.to_json(field(F.col("p"), "attributes"))), F.transform(F.coalesce("e", F.array().cast("array<variant>")), lambda e: F.to_json(field(e, "attributes"))))))
    p = p.withColumns({
        "trace_id": F.lower(text_field(F.col("p"), "traceId")), "span_id": F.lower(text_field(F.col("p"), "spanId")), "parent": field(F.col("p"), "parentSpanId"), "parent_span_id": F.lower(text_field(F.col("p"), "parentSpanId")), "name": text_field(F.col("p"), "name"),
        "start_ns": nanos_field(F.col("p"), "startTimeUnixNano"), "end_ns": nanos_field(F.col("p"), "endTimeUnixNano"),
        "events": F.transform("e", lambda e, k: F.struct(nanos_field(e, "timeUnixNano").alias("ns"), text_field(e, "name").alias("name"), F.get("of_span.values", k + 1).alias("attributes"))),
    }).repartition("source_name", "trace_id")
    no_parent = F.col("parent").isNull() | F.is_variant_null("parent") | (field(F.col("p"), "parentSpanId", "string") == "")
    fault = (
        F.when(~is_hex(F.col("trace_id"), 32), "trace id")
        .when(~is_hex(F.col("span_id"), 16), "span id")
        .when(~no_parent & ~is_hex(F.col("parent_span_id"), 16), "parent span id")
        .when(F.col("start_ns").isNull() | F.col("end_ns").isNull(), "time")
        .when(F.col("end_ns") < F.col("start_ns"), "ends before it starts")
        .when(F.col("name").isNull(), "name")
        .when(F.col("events").isNull(), "events")
        .when(F.exists("events", lambda e: e["ns"].isNull()), "event time")
        .when(F.exists("events", lambda e: e["name"].isNull()), "event name")
        .when(F.col("of_resource.fault").isNotNull(), "resource attributes")
        .when(F.col("of_scope.fault").isNotNull(), "scope attributes")
        .when(F.col("of_span.fault").isNotNull(), F.when(F.col("of_span.fault").startswith("0"), "attributes").otherwise("event attributes"))
        .when(F.count("*").over(Window.partitionBy("source_name", "trace_id", "span_id")) > 1, "span id repeats")
    )
    return p.select(
        "source_name", "trace_id", "span_id", "parent_span_id", "name", F.to_json(field(F.col("p"), "kind")).alias("kind"), "start_ns", "end_ns", F.coalesce(F.to_json(field(F.col("p"), "status")), F.lit("{}")).alias("status"),
        F.get("of_span.values", F.lit(0)).alias("attributes"), F.get("of_resource.values", F.lit(0)).alias("resource_attributes"), "resource_schema_url", "scope_name", "scope_version", F.get("of_scope.values", F.lit(0)).alias("scope_attributes"), "scope_schema_url", "events",
        fault.alias("fault"), F.coalesce("of_span.fault", "of_resource.fault", "of_scope.fault").alias("location"),
    )


def faults(documents: DataFrame) -> DataFrame:
    """source_name, trace_id, span_id, fault, location of the spans that events() leaves out, and of documents without any span."""
    of_spans = spans(documents).where("fault is not null").select("source_name", "trace_id", "span_id", "fault", F.when(F.col("fault").endswith("attributes"), F.col("location")).alias("location"))
    held = F.aggregate(F.flatten(F.transform("d.resourceSpans", lambda r: F.coalesce(F.transform(r["scopeSpans"], lambda s: F.coalesce(F.size(s["spans"]), F.lit(0))), F.array(F.lit(0))))), F.lit(0), lambda a, n: a + n)
    empty = exports(documents).where(F.coalesce(held, F.lit(0)) == 0)
    none = F.lit(None).cast("string")
    return of_spans.unionByName(empty.select("source_name", none.alias("trace_id"), none.alias("span_id"), F.when(F.col("d.resourceSpans").isNull(), "no export").otherwise("no spans").alias("fault"), none.alias("location")))


def events(documents: DataFrame) -> DataFrame:
    """Of sound spans (faults() names the others): span.started, its events and span.completed, numbered in their trace by (nanoseconds, phase, span, place), with the attributes of all levels; equal times of one span keep the document's order."""
    sound = spans(documents).where("fault is null")
    none = F.lit(None)
    one = lambda ns, phase, kind, place, name, length, said: F.struct(ns.alias("ns"), F.lit(phase).alias("phase"), F.lit(kind).alias("event_type"), place.cast("int").alias("place"), name.alias("event_name"), length.cast("bigint").alias("duration_ns"), said.cast("string").alias("event_attributes"))
    inner = F.transform("events", lambda e, i: one(e["ns"], 1, "span.event_observed", i, e["name"], none, e["attributes"]))
    drafts = F.concat(F.array(one(F.col("start_ns"), 0, "span.started", F.lit(0), F.col("name"), none, none)), inner, F.array(one(F.col("end_ns"), 2, "span.completed", F.lit(0), F.col("name"), F.col("end_ns") - F.col("start_ns"), none)))
    levels = ["resource_attributes", "resource_schema_url", "scope_name", "scope_version", "scope_attributes", "scope_schema_url"]
    rows = sound.select("source_name", "trace_id", "span_id", "parent_span_id", "kind", "status", F.col("attributes").alias("span_attributes"), *levels, F.explode(drafts).alias("e")).select("*", "e.*").drop("e")
    rows = rows.withColumns({"kind": F.when(F.col("phase") == 0, F.col("kind")), "parent_span_id": F.when(F.col("phase") == 0, F.col("parent_span_id")), "status": F.when(F.col("phase") == 2, F.col("status")), "timestamp": nanos_to_timestamp(F.col("ns"))})
    place = F.row_number().over(Window.partitionBy("source_name", "trace_id").orderBy("ns", "phase", "span_id", "place"))
    return rows.withColumn("sequence", (place - 1).cast("int")).drop("phase", "place")
