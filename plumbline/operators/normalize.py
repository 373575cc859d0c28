"""Evidence of five formats as one ordered stream of events.

Each importer takes documents (source_name, document: JSON text) and gives events:
trace_id, sequence, event_type, timestamp, and the attributes and payload of the
format. Documents are parsed with fixed schemas in the JVM; parts that are open
JSON stay as text. Trace exports are in otlp.py. Sequence numbers come from a window over the trace in the
order of the document's own positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import ID_PATTERN
from plumbline.operators.signatures import THINKING, TOOL_CALLS, TOOL_RESULTS, parts_fault, signature

TRANSCRIPT = "schema_version string, id string, capsule_id string, messages array<struct<id:string,role:string,content:string,timestamp:timestamp,name:string,tool_call_id:string,correction_of:string>>"
BLOCK = "type:string,text:string,refusal:string"
ITEM = f"id:string,type:string,role:string,status:string,call_id:string,name:string,arguments:string,output:string,content:array<struct<{BLOCK}>>,summary:array<struct<type:string,text:string>>,encrypted_content:string"
RESPONSES = f"id string, capsule_id string, responses array<struct<input_items:array<struct<{ITEM}>>,response:struct<id:string,created_at:double,instructions:string,output:array<struct<{ITEM}>>>>>"
PART = "type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean"
BLOCKS = f"array<struct<{PART}>>"
MESSAGES = "id string, capsule_id string, records array<struct<request_id:string,timestamp:timestamp,system:variant,messages:array<struct<id:string,role:string,content:variant>>,response:struct<id:string,content:variant>>>"
CALL = "struct<id:string,name:string,args:string,tool_type:string,toolType:string,code:string,language:string>"
ANSWER = "struct<id:string,name:string,response:string,output:string,outcome:string>"
DATA = "struct<mime_type:string,mimeType:string>"
GPART = f"text:string,thought:boolean,function_call:{CALL},functionCall:{CALL},function_response:{ANSWER},functionResponse:{ANSWER},tool_call:{CALL},toolCall:{CALL},tool_response:{ANSWER},toolResponse:{ANSWER},executable_code:{CALL},executableCode:{CALL},code_execution_result:{ANSWER},codeExecutionResult:{ANSWER},inline_data:{DATA},inlineData:{DATA},file_data:{DATA},fileData:{DATA}"
CONTENT = "struct<id:string,role:string,parts:array<variant>>"
CONTENTS = f"id string, capsule_id string, records array<struct<request_id:string,timestamp:timestamp,system_instruction:{CONTENT},contents:array<{CONTENT}>,candidate_ids:array<string>,response:struct<response_id:string,responseId:string,candidates:array<struct<index:int,finish_reason:string,finishReason:string,content:struct<role:string,parts:array<variant>>>>>>>"


def parsed(documents: DataFrame, schema: str) -> DataFrame:
    return documents.select("source_name", F.from_json("document", schema).alias("d")).select("source_name", "d.*")


def numbered(events: DataFrame, *order: str | Column) -> DataFrame:
    """Events with their sequence in the trace, from 0. A trace belongs to its source: documents of two sources with one id are two traces."""
    return events.withColumn("sequence", (F.row_number().over(Window.partitionBy("source_name", "trace_id").orderBy(*order)) - 1).cast("int"))


def identity_of_documents(documents: DataFrame, schema: str) -> DataFrame:
    """source_name, trace_id, fault of documents whose id another source has too, or that are there twice under one name."""
    d = parsed(documents, schema).where("id is not null").groupBy("source_name", F.col("id").alias("trace_id")).agg(F.count("*").alias("n"))
    ids = d.groupBy("trace_id").agg(F.count("*").alias("sources"))
    fault = F.when(F.col("n") > 1, "document repeats").when(F.col("sources") > 1, "document id of another source")
    return d.join(ids, "trace_id").select("source_name", "trace_id", fault.alias("fault")).where("fault is not null")


def provenance(files: DataFrame, policy_id: str = "default") -> DataFrame:
    """source_name, source_sha256, size and policy of binaryFile rows; names lose their folders."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_name"), F.sha2("content", 256).alias("source_sha256"), F.length("content").alias("size_bytes"), F.lit(policy_id).alias("policy_id"))


# Transcripts ---------------------------------------------------------------


def transcript_faults(documents: DataFrame) -> DataFrame:
    """source_name, trace_id, fault: document ids of two sources, repeated message ids, falling times, corrections that aren't a user's of an earlier assistant message."""
    m = parsed(documents, TRANSCRIPT).select("source_name", F.col("id").alias("trace_id"), F.posexplode("messages").alias("pos", "m")).select("source_name", "trace_id", "pos", "m.*")
    twice = m.groupBy("source_name", "trace_id", "id").count().where("count > 1").select("source_name", "trace_id", F.lit("repeated message id").alias("fault"))
    fell = m.withColumn("before", F.lag("timestamp").over(Window.partitionBy("source_name", "trace_id").orderBy("pos"))).where("timestamp < before").select("source_name", "trace_id", F.lit("time falls").alias("fault"))
    target = m.select("source_name", "trace_id", F.col("id").alias("correction_of"), F.col("pos").alias("target_pos"), F.col("role").alias("target_role"))
    fixes = m.where("correction_of is not null").join(target, ["source_name", "trace_id", "correction_of"], "left")
    odd = fixes.where("role <> 'user' or target_role is null or target_role <> 'assistant' or target_pos >= pos").select("source_name", "trace_id", F.lit("correction out of place").alias("fault"))
    return twice.unionByName(fell).unionByName(odd).unionByName(identity_of_documents(documents, TRANSCRIPT)).distinct()


def transcript_events(documents: DataFrame) -> DataFrame:
    """conversation.started, then each message, and after a message that corrects another its feedback event."""
    d = parsed(documents, TRANSCRIPT)
    start = d.select("source_name", F.col("id").alias("trace_id"), F.lit(-1).alias("pos"), F.lit(0).alias("part"), F.lit("conversation.started").alias("event_type"), F.col("messages")[0]["timestamp"].alias("timestamp"))
    m = d.select("source_name", F.col("id").alias("trace_id"), F.posexplode("messages").alias("pos", "m"))
    each = F.array_compact(F.array(F.struct(F.lit(0).alias("part"), F.lit("message.observed").alias("event_type")), F.when(F.col("m.correction_of").isNotNull(), F.struct(F.lit(1).alias("part"), F.lit("feedback.observed").alias("event_type")))))
    told = m.select("source_name", "trace_id", "pos", "m", F.explode(each).alias("e")).select("source_name", "trace_id", "pos", "e.part", "e.event_type", F.col("m.timestamp").alias("timestamp"), F.col("m.id").alias("message_id"), F.when(F.col("e.part") == 0, F.col("m.role")).alias("role"), F.when(F.col("e.part") == 0, F.col("m.content")).alias("content"), F.when(F.col("e.part") == 1, F.col("m.correction_of")).alias("correction_of"))
    return numbered(start.unionByName(told, allowMissingColumns=True), "pos", "part").drop("pos", "part")


# Archived model responses ----------------------------------------------------


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a trace without those whose key was seen before; rows without a key all stay."""
    nth = F.row_number().over(Window.partitionBy("source_name", "trace_id", key).orderBy(*order))
    return rows.withColumn("__nth", F.when(F.col(key).isNotNull(), nth).otherwise(1)).where("__nth = 1").drop("__nth")


def joined_lines(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda t: t != ""), "\n")


def response_events(documents: DataFrame) -> DataFrame:
    """Archived responses: instructions, input and output items, each item once by its id or call, and an artifact after each response. Tool results are linked to the calls of the whole archive."""
    d = parsed(documents, RESPONSES).select("source_name", F.col("id").alias("trace_id"), F.posexplode("responses").alias("rec", "r"))
    at = F.timestamp_micros(F.round(F.col("r.response.created_at") * 1_000_000).cast("bigint"))
    base = d.select("source_name", "trace_id", "rec", at.alias("timestamp"), F.col("r.response.id").alias("response_id"), "r")
    start = base.where("rec = 0").select("source_name", "trace_id", F.lit(-1).alias("rec"), F.lit(0).alias("section"), F.lit(0).alias("pos"), "timestamp", F.lit("conversation.started").alias("event_type"))
    notes = base.where("r.response.instructions is not null").select("source_name", "trace_id", "rec", F.lit(0).alias("section"), F.lit(0).alias("pos"), "timestamp", "response_id", F.lit("message.observed").alias("event_type"), F.lit("instructions").alias("origin"), F.lit("system").alias("role"), F.col("r.response.instructions").alias("content"), F.sha2("r.response.instructions", 256).alias("key"))
    items = base.select("source_name", "trace_id", "rec", "timestamp", "response_id", F.explode(F.array(F.struct(F.lit(1).alias("section"), F.lit("input_items").alias("origin"), F.col("r.input_items").alias("items")), F.struct(F.lit(2).alias("section"), F.lit("response.output").alias("origin"), F.col("r.response.output").alias("items")))).alias("s"))
    items = items.select("source_name", "trace_id", "rec", "timestamp", "response_id", "s.section", "s.origin", F.posexplode("s.items").alias("pos", "item"))
    key = F.when(F.length("item.id") > 0, F.concat(F.lit("id:"), F.col("item.id"))).when(F.length("item.call_id") > 0, F.concat_ws(":", F.lit("call"), F.col("item.type"), F.col("item.call_id")))
    seen = first_seen(items.withColumn("key", key), "key", "rec", "section", "pos")
    calls = items.where("item.type = 'function_call' and item.call_id <> '' and item.name <> ''").groupBy("source_name", "trace_id", F.col("item.call_id").alias("call_id")).agg(F.max("item.name").alias("call_name"))
    kind = F.col("item.type")
    text = joined_lines(F.transform("item.content", lambda b: F.when(b["type"].isin("input_text", "output_text"), b["text"]).when(b["type"] == "refusal", b["refusal"]).otherwise(F.concat(F.lit("["), b["type"], F.lit("]")))))
    told = seen.withColumn("call_id", F.col("item.call_id")).join(calls, ["source_name", "trace_id", "call_id"], "left").select(
        "source_name", "trace_id", "rec", "section", "pos", "timestamp", "response_id", "origin",
        F.when(kind == "message", "message.observed").when(kind == "function_call", "tool.called").when(kind == "function_call_output", "tool.completed").otherwise("artifact.observed").alias("event_type"),
        F.when(kind == "message", F.col("item.role")).alias("role"),
        F.when(kind == "message", text).when(kind == "function_call", F.col("item.arguments")).when(kind == "function_call_output", F.col("item.output")).when(kind == "reasoning", joined_lines(F.transform("item.summary", lambda b: b["text"]))).alias("content"),
        "call_id", F.coalesce("item.name", F.when(kind == "function_call_output", F.col("call_name"))).alias("tool_name"), F.when(kind == "function_call_output", F.col("call_name").isNotNull()).alias("linked_call"),
        F.when(kind == "reasoning", F.lit("reasoning_summary")).when(~kind.isin("message", "function_call", "function_call_output"), F.lit("response_item")).alias("artifact_kind"),
        F.when(kind == "reasoning", F.coalesce(F.length("item.encrypted_content") > 0, F.lit(False))).alias("hidden_present"),
    )
    end = base.select("source_name", "trace_id", "rec", F.lit(3).alias("section"), F.lit(0).alias("pos"), "timestamp", "response_id", F.lit("artifact.observed").alias("event_type"), F.lit("response").alias("artifact_kind"))
    notes = first_seen(notes, "key", "rec").drop("key")
    rows = start
    for more in (notes, told, end):
        rows = rows.unionByName(more, allowMissingColumns=True)
    return numbered(rows, "rec", "section", "pos").drop("rec", "section", "pos")


def conflicting_calls(documents: DataFrame) -> DataFrame:
    """Calls of an archive of responses that occur with different names."""
    d = parsed(documents, RESPONSES).select("source_name", F.col("id").alias("trace_id"), F.explode("responses").alias("r"))
    items = d.select("source_name", "trace_id", F.explode(F.concat(F.coalesce("r.input_items", F.array().cast(f"array<struct<{ITEM}>>")), F.coalesce("r.response.output", F.array().cast(f"array<struct<{ITEM}>>")))).alias("item"))
    return items.where("item.type = 'function_call' and item.call_id <> ''").groupBy("source_name", "trace_id", F.col("item.call_id").alias("call_id")).agg(F.count_distinct("item.name").alias("names")).where("names > 1")


def archive_order_faults(records: DataFrame) -> DataFrame:
    """source_name, trace_id, fault of archives' records (source_name, trace_id, rec, timestamp, response_id): missing or repeated response ids, missing or falling times."""
    twice = records.where("response_id <> ''").groupBy("source_name", "trace_id", "response_id").count().where("count > 1").select("source_name", "trace_id", F.lit("response id repeats").alias("fault"))
    before = F.lag("timestamp").over(Window.partitionBy("source_name", "trace_id").orderBy("rec"))
    each = records.withColumn("fault", F.when(F.coalesce(F.col("response_id"), F.lit("")) == "", "response without id").when(F.col("timestamp").isNull(), "record without time").when(F.col("timestamp") < before, "time falls"))
    return twice.unionByName(each.where("fault is not null").select("source_name", "trace_id", "fault"))


def definition_conflicts(calls: DataFrame, fault: str) -> DataFrame:
    """source_name, trace_id, fault of calls (source_name, trace_id, call_id, definition) whose id stands for more than one definition."""
    return calls.where("call_id is not null").groupBy("source_name", "trace_id", "call_id").agg(F.count_distinct("definition").alias("n")).where("n > 1").select("source_name", "trace_id", F.lit(fault).alias("fault"))


def signature_conflicts(messages: DataFrame) -> DataFrame:
    """source_name, trace_id, fault of messages (source_name, trace_id, message_id, signature) whose id stands for different contents."""
    return definition_conflicts(messages.select("source_name", "trace_id", F.col("message_id").alias("call_id"), F.col("signature").alias("definition")), "message id with other content")


def response_faults(documents: DataFrame) -> DataFrame:
    """source_name, trace_id, fault of archives of responses: ids and times of the responses, and calls that occur under different names."""
    d = parsed(documents, RESPONSES).select("source_name", F.col("id").alias("trace_id"), F.posexplode("responses").alias("rec", "r"))
    records = d.select("source_name", "trace_id", "rec", F.timestamp_micros(F.round(F.col("r.response.created_at") * 1_000_000).cast("bigint")).alias("timestamp"), F.col("r.response.id").alias("response_id"))
    named = conflicting_calls(documents).select("source_name", "trace_id", F.lit("call id with other name").alias("fault"))
    return archive_order_faults(records).unionByName(named).unionByName(identity_of_documents(documents, RESPONSES)).distinct()


def absent_if_null(json: Column) -> Column:
    return F.when(json != "null", json)


def blocks(content: Column) -> Column:
    """The blocks of a message's content, which is JSON text of a text or of an array."""
    alone = F.from_json(F.concat(F.lit('[{"type":"text","text":'), content, F.lit("}]")), BLOCKS)
    return F.when(content.startswith('"'), alone).when(content.startswith("["), F.from_json(content, BLOCKS))


def archived_messages(documents: DataFrame) -> DataFrame:
    """source_name, trace_id, records, rec, timestamp, response_id, pos, message_id, role, content (JSON text), origin of each message that the records of message archives hold, in their order: system, request, response. A system message is named by its content."""
    d = parsed(documents, MESSAGES).select("source_name", F.col("id").alias("trace_id"), F.size("records").alias("records"), F.posexplode("records").alias("rec", "r"))
    of = lambda i, role, content, origin: F.struct(i.alias("id"), role.alias("role"), content.alias("content"), F.lit(origin).alias("origin"))
    d = d.withColumn("system", absent_if_null(F.to_json("r.system")))
    d = d.withColumn("system_id", F.concat(F.lit("system:"), F.left(signature(F.when(F.col("system").isNotNull(), "system"), F.col("system")), F.lit(32))))
    shape = "array<struct<id:string,role:string,content:string,origin:string>>"
    system = F.when(F.col("system").isNotNull(), F.array(of(F.col("system_id"), F.lit("system"), F.col("system"), "request")))
    asked = F.transform("r.messages", lambda m: of(m["id"], m["role"], F.to_json(m["content"]), "request"))
    given = F.array(of(F.col("r.response.id"), F.lit("assistant"), F.to_json("r.response.content"), "response"))
    every = F.concat(*(F.coalesce(x.cast(shape), F.array().cast(shape)) for x in (system, asked, given)))
    return d.select("source_name", "trace_id", "records", "rec", F.col("r.timestamp").alias("timestamp"), F.col("r.response.id").alias("response_id"), F.posexplode(every).alias("pos", "m")).select("source_name", "trace_id", "records", "rec", "timestamp", "response_id", "pos", F.col("m.id").alias("message_id"), "m.role", "m.content", "m.origin")


def message_faults(documents: DataFrame) -> DataFrame:
    """source_name, trace_id, fault of message archives: ids and times of the records, contents that are neither text nor array, message ids with other contents, tool calls without id, name or input, and tool ids with other definitions."""
    m = archived_messages(documents).withColumn("blocks", blocks(F.col("content")))
    shape = m.where("blocks is null").select("source_name", "trace_id", F.lit("content is neither text nor array").alias("fault"))
    calls = m.select("source_name", "trace_id", F.explode("blocks").alias("b")).where(F.col("b.type").isin(*TOOL_CALLS)).select("source_name", "trace_id", F.col("b.id").alias("call_id"), "b.name", F.col("b.input").alias("input"), F.concat_ws("\x1f", "b.type", "b.name", "b.input").alias("definition"))
    bad = calls.where("coalesce(call_id, '') = '' or coalesce(name, '') = '' or not coalesce(startswith(input, '{'), false)").select("source_name", "trace_id", F.lit("tool call without id, name or input").alias("fault"))
    signed = m.where("blocks is not null").select("source_name", "trace_id", "message_id", signature("role", "content").alias("signature"))
    order = archive_order_faults(m.where("origin = 'response'").select("source_name", "trace_id", "rec", "timestamp", "response_id"))
    return order.unionByName(shape).unionByName(bad).unionByName(definition_conflicts(calls, "tool id with other definition")).unionByName(signature_conflicts(signed)).unionByName(identity_of_documents(documents, MESSAGES)).distinct()


def message_events(documents: DataFrame) -> DataFrame:
    """Archived message exchanges: system, request messages and the response, each message once by id, followed by events for its blocks; an artifact after each record and one at the end. message_faults() names what is out of shape; a message without readable content is told with null content."""
    m = archived_messages(documents).withColumn("content", blocks(F.col("content")))
    per_record = m.where("origin = 'response'").select("source_name", "trace_id", "records", "rec", "timestamp")
    calls = m.select("source_name", "trace_id", F.explode("content").alias("b")).where(F.col("b.type").isin(*TOOL_CALLS)).groupBy("source_name", "trace_id", F.col("b.id").alias("tool_use_id")).agg(F.max("b.name").alias("call_name"))
    m = first_seen(m, "message_id", "rec", "pos")
    show = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"].isin(*THINKING), "[thinking]").when(b["type"].isin(*TOOL_CALLS), F.concat(F.lit("[tool_use:"), F.coalesce(b["name"], F.lit("unknown")), F.lit("]"))).when(b["type"].isin(*TOOL_RESULTS), F.concat(F.lit("[tool_result:"), F.coalesce(b["tool_use_id"], F.lit("unknown")), F.lit("]"))).when(b["type"] == "mid_conversation_system", "[system]").otherwise(F.concat(F.lit("["), b["type"], F.lit("]")))
    said = m.select("source_name", "trace_id", "rec", "pos", F.lit(-1).alias("block"), "timestamp", "message_id", F.lit("message.observed").alias("event_type"), "role", joined_lines(F.transform("content", show)).alias("content"), "origin")
    b = m.select("source_name", "trace_id", "rec", "pos", "timestamp", "message_id", "origin", F.posexplode("content").alias("block", "b")).where("b.type <> 'text'")
    kind = F.col("b.type")
    done = b.withColumn("tool_use_id", F.coalesce("b.tool_use_id", "b.id")).join(calls, ["source_name", "trace_id", "tool_use_id"], "left").select(
        "source_name", "trace_id", "rec", "pos", "block", "timestamp", "message_id", "origin",
        F.when(kind.isin(*TOOL_CALLS), "tool.called").when(kind.isin(*TOOL_RESULTS), "tool.completed").otherwise("artifact.observed").alias("event_type"),
        F.when(kind.isin(*THINKING), "thinking_presence").when(~kind.isin(*TOOL_CALLS, *TOOL_RESULTS), "content_block").alias("artifact_kind"),
        F.when(kind.isin(*TOOL_CALLS), F.col("b.input")).when(kind.isin(*TOOL_RESULTS), F.col("b.content")).alias("content"),
        F.when(kind.isin(*TOOL_CALLS, *TOOL_RESULTS), F.col("tool_use_id")).alias("call_id"), F.when(kind.isin(*TOOL_CALLS), F.col("b.name")).when(kind.isin(*TOOL_RESULTS), F.col("call_name")).alias("tool_name"),
        F.when(kind.isin(*TOOL_RESULTS), F.col("call_name").isNotNull()).alias("linked_call"), F.when(kind.isin(*TOOL_RESULTS), F.coalesce("b.is_error", F.lit(False))).alias("is_error"),
    )
    far = F.lit(1 << 30)
    start = per_record.where("rec = 0").select("source_name", "trace_id", F.lit(-1).alias("rec"), F.lit(0).alias("pos"), F.lit(-1).alias("block"), "timestamp", F.lit("conversation.started").alias("event_type"))
    after = per_record.select("source_name", "trace_id", "rec", far.alias("pos"), F.lit(0).alias("block"), "timestamp", F.lit("artifact.observed").alias("event_type"), F.lit("message").alias("artifact_kind"))
    end = per_record.where("rec = records - 1").select("source_name", "trace_id", far.alias("rec"), far.alias("pos"), F.lit(1).alias("block"), "timestamp", F.lit("artifact.observed").alias("event_type"), F.lit("conversation").alias("artifact_kind"))
    rows = start
    for more in (said, done, after, end):
        rows = rows.unionByName(more, allowMissingColumns=True)
    return numbered(rows, "rec", "pos", "block").drop("rec", "pos", "block")


def either(part: Column, snake: str, camel: str) -> Column:
    """A field of a part (v, its fields, and keys, the names that it has) by the spelling that is there, snake case first, even if it holds null."""
    return F.when(F.array_contains(part["keys"], snake), part["v"][snake]).otherwise(part["v"][camel])


def read_parts(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(F.from_json(F.to_json(p), f"struct<{GPART}>").alias("v"), F.coalesce(F.json_object_keys(F.to_json(p)), F.array().cast("array<string>")).alias("keys")))


def archived_contents(documents: DataFrame) -> DataFrame:
    """source_name, trace_id, records, rec, timestamp, response_id, inputs, pos, message_id, role, parts (variants), origin of each content of content archives: system instruction, contents, candidates."""
    d = parsed(documents, CONTENTS).select("source_name", F.col("id").alias("trace_id"), F.size("records").alias("records"), F.posexplode("records").alias("rec", "r"))
    shape = "array<struct<id:string,role:string,parts:array<variant>,origin:string>>"
    system = F.when(F.col("r.system_instruction").isNotNull(), F.array(F.struct("r.system_instruction.id", "r.system_instruction.role", "r.system_instruction.parts", F.lit("request").alias("origin"))))
    asked = F.transform("r.contents", lambda c: F.struct(c["id"].alias("id"), c["role"].alias("role"), c["parts"].alias("parts"), F.lit("request").alias("origin")))
    given = F.transform("r.response.candidates", lambda c, i: F.struct(F.get("r.candidate_ids", i).alias("id"), F.lit("model").alias("role"), c["content"]["parts"].alias("parts"), F.lit("response").alias("origin")))
    every = F.concat(*(F.coalesce(x.cast(shape), F.array().cast(shape)) for x in (system, asked, given)))
    return d.select("source_name", "trace_id", "records", "rec", F.col("r.timestamp").alias("timestamp"), F.posexplode(every).alias("pos", "m")).select("source_name", "trace_id", "records", "rec", "timestamp", "pos", F.col("m.id").alias("message_id"), "m.role", "m.parts", "m.origin").where("parts is not null")


def content_faults(documents: DataFrame) -> DataFrame:
    """source_name, trace_id, fault of content archives: ids and times of the records, candidate ids that don't fit the candidates or repeat, candidates of another role, parts with two spellings, several fields or none, content ids with other contents, function calls without id, name or arguments, and call ids with other definitions."""
    d = parsed(documents, CONTENTS).select("source_name", F.col("id").alias("trace_id"), F.posexplode("records").alias("rec", "r"))
    order = archive_order_faults(d.select("source_name", "trace_id", "rec", F.col("r.timestamp").alias("timestamp"), F.coalesce("r.response.response_id", "r.response.responseId").alias("response_id")))
    ids, candidates = F.coalesce("r.candidate_ids", F.array().cast("array<string>")), F.col("r.response.candidates")
    fit = F.when(candidates.isNull(), "no candidates").when(F.size(ids) != F.size(candidates), "candidate ids don't fit").when(F.size(F.array_distinct(ids)) != F.size(ids), "candidate ids repeat").when(F.exists(candidates, lambda c: F.coalesce(c["content"]["role"], F.lit("model")) != "model"), "candidate of another role")
    fits = d.select("source_name", "trace_id", fit.alias("fault")).where("fault is not null")
    m = archived_contents(documents).withColumn("json", F.to_json("parts"))
    shape = m.select("source_name", "trace_id", parts_fault("json").alias("fault")).where("fault is not null")
    p = m.select("source_name", "trace_id", F.explode(read_parts(F.col("parts"))).alias("p")).select("source_name", "trace_id", either(F.col("p"), "function_call", "functionCall").alias("c")).where("c is not null")
    calls = p.select("source_name", "trace_id", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.coalesce("c.args", F.lit("{}")).alias("args"))
    bad = calls.where("coalesce(call_id, '') = '' or coalesce(name, '') = '' or not startswith(args, '{')").select("source_name", "trace_id", F.lit("function call without id, name or arguments").alias("fault"))
    twice = definition_conflicts(calls.select("source_name", "trace_id", "call_id", F.concat_ws("\x1f", "name", "args").alias("definition")), "call id with other definition")
    signed = signature_conflicts(m.select("source_name", "trace_id", "message_id", signature("role", "json").alias("signature")))
    out = order
    for more in (fits, shape, bad, twice, signed, identity_of_documents(documents, CONTENTS)):
        out = out.unionByName(more)
    return out.distinct()


def content_events(documents: DataFrame) -> DataFrame:
    """Archived content generations: system instruction, contents, candidates, each content once by id, followed by events for its parts; artifacts after each candidate, each record and at the end. content_faults() names what is out of shape."""
    d = parsed(documents, CONTENTS).select("source_name", F.col("id").alias("trace_id"), F.size("records").alias("records"), F.posexplode("records").alias("rec", "r"))
    every = archived_contents(documents).withColumn("parts", read_parts(F.col("parts")))
    m = first_seen(every, "message_id", "rec", "pos")
    field = lambda name, camel: lambda p: either(p, name, camel)
    call, answer, code, result = field("function_call", "functionCall"), field("function_response", "functionResponse"), field("executable_code", "executableCode"), field("code_execution_result", "codeExecutionResult")
    tool_call, tool_answer, data, file = field("tool_call", "toolCall"), field("tool_response", "toolResponse"), field("inline_data", "inlineData"), field("file_data", "fileData")

    def kind_of(p: Column) -> Column:
        kind = F.when(F.coalesce(p["v"]["thought"], F.lit(False)), "thought").when(p["v"]["text"].isNotNull(), "text")
        for name, value in (("function_call", call), ("function_response", answer), ("tool_call", tool_call), ("tool_response", tool_answer), ("executable_code", code), ("code_execution_result", result), ("inline_data", data), ("file_data", file)):
            kind = kind.when(value(p).isNotNull(), name)
        return kind.otherwise("provider_part")

    def show(p: Column) -> Column:
        kind = kind_of(p)
        marked = lambda value: F.concat(F.lit("["), kind, F.lit(":"), F.coalesce(value, F.lit("unknown")), F.lit("]"))
        mime = lambda c: F.coalesce(c["mime_type"], c["mimeType"])
        return F.when(kind == "text", p["v"]["text"]).when(kind == "function_call", marked(call(p)["name"])).when(kind == "function_response", marked(answer(p)["name"])).when(kind == "inline_data", marked(mime(data(p)))).when(kind == "file_data", marked(mime(file(p)))).otherwise(F.concat(F.lit("["), kind, F.lit("]")))

    def told(rows: DataFrame) -> DataFrame:
        return rows.select("source_name", "trace_id", "rec", "pos", "timestamp", "message_id", "origin", F.posexplode("parts").alias("part", "p")).withColumn("kind", kind_of(F.col("p"))).where("kind <> 'text'")

    said = m.select("source_name", "trace_id", "rec", "pos", F.lit(-1).alias("part"), "timestamp", "message_id", F.lit("message.observed").alias("event_type"), "role", F.array_join(F.transform("parts", show), "\n").alias("content"), "origin")
    p = F.col("p")
    is_call, is_answer = F.col("kind").isin("function_call", "tool_call", "executable_code"), F.col("kind").isin("function_response", "tool_response", "code_execution_result")
    made, met = F.coalesce(call(p)["id"], tool_call(p)["id"], code(p)["id"]), F.coalesce(answer(p)["id"], tool_answer(p)["id"], result(p)["id"])
    made_name = F.coalesce(call(p)["name"], tool_call(p)["tool_type"], tool_call(p)["toolType"], F.lit("code_execution"))
    calls = told(every).where(is_call).select("source_name", "trace_id", made.alias("call_id"), made_name.alias("call_name")).where("call_id is not null").groupBy("source_name", "trace_id", "call_id").agg(F.max("call_name").alias("call_name"))
    done = told(m).withColumn("call_id", F.when(is_call, made).when(is_answer, met)).join(calls, ["source_name", "trace_id", "call_id"], "left").select(
        "source_name", "trace_id", "rec", "pos", "part", "timestamp", "message_id", "origin", "call_id",
        F.when(is_call, "tool.called").when(is_answer, "tool.completed").otherwise("artifact.observed").alias("event_type"),
        F.when(F.col("kind") == "thought", "thought_presence").when(~is_call & ~is_answer, "part").alias("artifact_kind"),
        F.when(is_call, F.coalesce(call(p)["args"], tool_call(p)["args"], code(p)["code"])).when(is_answer, F.coalesce(answer(p)["response"], tool_answer(p)["response"], result(p)["output"])).alias("content"),
        F.when(is_call, made_name).when(is_answer, F.coalesce(answer(p)["name"], F.col("call_name"))).alias("tool_name"),
        F.when(is_answer, F.col("call_name").isNotNull()).alias("linked_call"),
    )
    far = F.lit(1 << 30)
    observed = F.lit("artifact.observed").alias("event_type")
    start = d.where("rec = 0").select("source_name", "trace_id", F.lit(-1).alias("rec"), F.lit(0).alias("pos"), F.lit(-1).alias("part"), F.col("r.timestamp").alias("timestamp"), F.lit("conversation.started").alias("event_type"))
    inputs = F.when(F.col("r.system_instruction").isNotNull(), 1).otherwise(0) + F.coalesce(F.size("r.contents"), F.lit(0))
    candidates = d.select("source_name", "trace_id", "rec", F.col("r.timestamp").alias("timestamp"), inputs.alias("inputs"), F.posexplode("r.response.candidates").alias("c", "candidate")).select("source_name", "trace_id", "rec", (F.col("inputs") + F.col("c")).alias("pos"), far.alias("part"), "timestamp", observed, F.lit("candidate").alias("artifact_kind"), F.coalesce("candidate.finish_reason", "candidate.finishReason").alias("content"))
    after = d.select("source_name", "trace_id", "rec", far.alias("pos"), F.lit(0).alias("part"), F.col("r.timestamp").alias("timestamp"), observed, F.lit("response").alias("artifact_kind"))
    end = d.where("rec = records - 1").select("source_name", "trace_id", far.alias("rec"), far.alias("pos"), F.lit(1).alias("part"), F.col("r.timestamp").alias("timestamp"), observed, F.lit("conversation").alias("artifact_kind"))
    rows = start
    for more in (said, done, candidates, after, end):
        rows = rows.unionByName(more, allowMissingColumns=True)
    return numbered(rows, "rec", "pos", "part").drop("rec", "pos", "part")


def identity_faults(events: DataFrame, *context: str) -> DataFrame:
    """source_name (if there is one), trace_id, fault of events whose context (capsule, experiment, variant, repetition, or what else is named) changes within their trace."""
    trace = [c for c in ("source_name", "trace_id") if c in events.columns]
    return events.groupBy(*trace).agg(F.count_distinct(F.struct(*context)).alias("n")).where("n > 1").select(*trace, F.lit("context changes").alias("fault"))


# Captures --------------------------------------------------------------------

CAPTURE = "schema_version string, id string, client string, observations array<struct<id:string,kind:string,timestamp:timestamp,content:string,content_sha256:string>>"


def capture_observations(documents: DataFrame) -> DataFrame:
    """One row per observation of capture envelopes, with its fault: a repeated id, a falling time, a kind of another client, a wrong digest, a bad id."""
    o = parsed(documents, CAPTURE).select(F.col("id").alias("capture_id"), "client", F.posexplode("observations").alias("position", "o")).select("capture_id", "client", "position", "o.*")
    by = Window.partitionBy("capture_id")
    fault = (
        F.when(~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False)), "bad id")
        .when(F.count("*").over(Window.partitionBy("capture_id", "id")) > 1, "repeated id")
        .when(F.col("timestamp") < F.lag("timestamp").over(by.orderBy("position")), "time falls")
        .when(~F.col("kind").startswith(F.col("client")), "kind of another client")
        .when(F.sha2("content", 256) != F.col("content_sha256"), "digest")
    )
    return o.withColumn("fault", fault)
