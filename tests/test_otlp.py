import json

import pytest

from plumbline.operators import normalize, otlp


def export(spans, resource=None, scope=None):
    return json.dumps({"resourceSpans": [{"resource": {"attributes": resource or []}, "scopeSpans": [{"scope": {"name": "s", "attributes": scope or []}, "spans": spans}]}]})


def span(**k):
    return {"traceId": "A" * 32, "spanId": "b" * 16, "name": "n", "startTimeUnixNano": "5", "endTimeUnixNano": 9} | k


def documents(spark, *docs):
    return spark.createDataFrame([(f"s{k}", d) for k, d in enumerate(docs)], "source_name string, document string")


def text(key, value="v"):
    return {"key": key, "value": {"stringValue": value}}


def test_values():
    nested = {"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": "-7"}, {"boolValue": True}, {"doubleValue": 2}, {"bytesValue": "AA=="}, {"arrayValue": {}}]}}}]}}
    assert otlp.any_value(nested) == {"a": [-7, True, 2.0, "AA==", []]}
    for bad in ({}, None, 3, {"intValue": "1", "stringValue": "x"}, {"intValue": str(1 << 63)}, {"intValue": True}, {"intValue": "1.0"}, {"boolValue": "yes"}, {"stringValue": 1}, {"doubleValue": True}, {"doubleValue": float("inf")}, {"arrayValue": []}, {"arrayValue": {"values": {}}}, {"kvlistValue": {"values": [{"value": {"intValue": 1}}]}}):
        with pytest.raises(otlp.AttributeFault):
            otlp.any_value(bad)
    with pytest.raises(otlp.AttributeFault, match="1: key repeats"):
        otlp.attribute_map([text("a")] * 2)


def test_every_fault_is_a_row_and_sound_spans_stay(spark):
    event = lambda **k: {"timeUnixNano": "6", "name": "e"} | k
    broken = {
        "trace id": [{"traceId": "0" * 32}, {"traceId": 7}, {"traceId": None}],
        "span id": [{"spanId": "xyz"}, {"spanId": ""}],
        "parent span id": [{"parentSpanId": "0" * 16}, {"parentSpanId": 5}],
        "time": [{"startTimeUnixNano": "x"}, {"endTimeUnixNano": True}, {"startTimeUnixNano": "-1"}, {"endTimeUnixNano": 9.5}, {"startTimeUnixNano": str(1 << 70)}],
        "ends before it starts": [{"endTimeUnixNano": "1"}],
        "name": [{"name": ""}, {"name": 5}],
        "events": [{"events": {}}, {"events": None}, {"events": "x"}],
        "event time": [{"events": [event(), event(timeUnixNano="soon")]}, {"events": [event(timeUnixNano=None)]}],
        "event name": [{"events": [event(name="")]}],
        "attributes": [{"attributes": [text("a"), text("a")]}, {"attributes": {}}, {"attributes": [{"key": "a", "value": {"intValue": 1, "boolValue": True}}]}, {"attributes": [{"key": "a"}]}],
        "event attributes": [{"events": [event(), event(attributes=[{"key": "a", "value": {}}])]}],
    }
    spans, want = [span(spanId="f" * 16)], []
    for fault, cases in broken.items():
        for k in cases:
            spans.append(span(spanId=f"{len(spans):016x}") | k)
            want.append(fault)
    docs = documents(spark, export(spans), export([span(), span()]), export([span()], resource=[text("a"), text("a")]), export([span()], scope=[{"key": "", "value": {"intValue": 1}}]), "{", "[]", '{"resourceSpans":[]}', export([]), '{"resourceSpans":[{"resource":{},"resource":{}}]}')
    faults = [(r.source_name, r.fault) for r in otlp.faults(docs).collect()]
    assert sorted(f for s, f in faults if s == "s0") == sorted(want)
    assert sorted((s, f) for s, f in faults if s != "s0") == [("s1", "span id repeats"), ("s1", "span id repeats"), ("s2", "resource attributes"), ("s3", "scope attributes"), ("s4", "no export"), ("s5", "no export"), ("s6", "no spans"), ("s7", "no spans"), ("s8", "no spans")]
    assert [(r.source_name, r.span_id, r.sequence) for r in otlp.events(docs).sort("sequence").collect()] == [("s0", "f" * 16, 0), ("s0", "f" * 16, 1)]
    places = {r.location for r in otlp.faults(docs).where("fault = 'event attributes'").collect()}
    assert places == {"2/0: 0 forms of a value"}


def test_events_carry_every_level(spark):
    a = span(parentSpanId="C" * 16, kind=3, status={"code": 2, "message": "m"}, attributes=[text("sa")], events=[{"timeUnixNano": 7, "name": "late"}, {"timeUnixNano": "6", "name": "early", "attributes": [{"key": "n", "value": {"intValue": "4"}}]}])
    root = span(spanId="c" * 16, parentSpanId=None, startTimeUnixNano=5, endTimeUnixNano="9")
    events = otlp.events(documents(spark, export([a, root], resource=[text("ra")], scope=[text("ca")]))).sort("sequence").collect()
    assert [(e.event_type, e.event_name, e.ns, e.span_id[0]) for e in events] == [("span.started", "n", 5, "b"), ("span.started", "n", 5, "c"), ("span.event_observed", "early", 6, "b"), ("span.event_observed", "late", 7, "b"), ("span.completed", "n", 9, "b"), ("span.completed", "n", 9, "c")]
    assert {(e.resource_attributes, e.scope_name, e.scope_attributes, e.trace_id) for e in events} == {('{"ra":"v"}', "s", '{"ca":"v"}', "a" * 32)}
    assert [e.span_attributes for e in events] == ['{"sa":"v"}', "{}", '{"sa":"v"}', '{"sa":"v"}', '{"sa":"v"}', "{}"]
    assert events[0].kind == "3" and events[0].parent_span_id == "c" * 16 and events[1].parent_span_id is None and events[4].duration_ns == 4
    assert json.loads(events[4].status) == {"code": 2, "message": "m"} and events[0].status is None and events[5].status == "{}"
    assert events[2].event_attributes == '{"n":4}' and events[3].event_attributes == "{}" and events[0].event_attributes is None


def test_documents_with_one_id_are_two_traces_and_a_fault(spark):
    transcript = lambda n: json.dumps({"id": "t", "capsule_id": "c", "messages": [{"id": f"m{k}", "role": "user", "content": "x", "timestamp": f"2024-01-01T00:00:0{k}Z"} for k in range(n)]})
    docs = documents(spark, transcript(2), transcript(3))
    events = normalize.transcript_events(docs).sort("source_name", "sequence").collect()
    assert [(e.source_name, e.sequence) for e in events] == [("s0", k) for k in range(3)] + [("s1", k) for k in range(4)]
    assert sorted(map(tuple, normalize.transcript_faults(docs).collect())) == [("s0", "t", "document id of another source"), ("s1", "t", "document id of another source")]
    assert {r.fault for r in normalize.transcript_faults(docs.unionByName(docs)).collect()} >= {"document repeats"}
    same = documents(spark, export([span()]), export([span()]))
    assert otlp.faults(same).count() == 0 and [e.sequence for e in otlp.events(same).sort("source_name", "sequence").collect()] == [0, 1, 0, 1]
    assert otlp.events(documents(spark, export([span()])).limit(0)).count() == 0
