"""Signatures of what can be observed of an archived message: equal for the same content, without what must stay hidden.

Messages are JSON of any depth, so these run in Arrow batches in Python. The
names of fields and forms are fixed values of the archives' formats.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import canonical, strict_json

# Block types, part fields and keys of the formats.
THINKING = ("thinking", "redacted_thinking")
TOOL_CALLS = ("tool_use", "server_tool_use")
TOOL_RESULTS = ("tool_result", "web_search_tool_result", "web_fetch_tool_result", "code_execution_tool_result", "bash_code_execution_tool_result", "text_editor_code_execution_tool_result", "tool_search_tool_result")
PART_FIELDS = {"text": "text", "function_call": "functionCall", "function_response": "functionResponse", "tool_call": "toolCall", "tool_response": "toolResponse", "executable_code": "executableCode", "code_execution_result": "codeExecutionResult", "inline_data": "inlineData", "file_data": "fileData"}
#: Keys of what is opaque at any depth, and of what a message's own parts hold but do not show.
OPAQUE = ("encrypted_content", "thought_signature", "thoughtSignature")
UNSHOWN = ("thinking", "signature", "data", "redacted_data")
#: Keys under which a caller's own JSON begins.
OPEN = ("input", "args", "arguments", "response", "output", "metadata")
HUMP = re.compile("(?<=[a-z0-9])([A-Z])")


def visible(value: object) -> object:
    """A JSON value without the opaque keys, at every depth."""
    if isinstance(value, dict):
        return {k: visible(v) for k, v in value.items() if k not in OPAQUE}
    return [visible(v) for v in value] if isinstance(value, list) else value


def outline(value: object, own: bool = True) -> object:
    """What can be observed of a message's content, whatever its format. One rule: what is hidden becomes a flag that it is there. In the message's own parts (not in the JSON that callers put into them) both spellings of a field are one, and an absent field is as good as one that holds nothing."""
    if isinstance(value, list):
        return [outline(v, own) for v in value]
    if not isinstance(value, dict):
        return value
    secret = own and (value.get("type") in THINKING or bool(value.get("thought")))
    told: dict[str, object] = {}
    for key in sorted(value, key=lambda k: (bool(HUMP.search(k)), k)):
        name = HUMP.sub(r"_\1", key).lower() if own else key
        if name in told:
            continue
        hidden = key in OPAQUE or own and (name in UNSHOWN or secret and name == "text")
        told[name] = bool(value[key]) if hidden else outline(value[key], own and name not in OPEN)
    return {k: v for k, v in told.items() if not own or v is not None and v is not False and v not in ("", [], {})}


def part_fault(part: object) -> str | None:
    """What is wrong with a part: two spellings of a field, more than one field, or none that can be observed."""
    if not isinstance(part, dict):
        return "part is not an object"
    there = [(s, c) for s, c in PART_FIELDS.items() if part.get(s) is not None or part.get(c) is not None]
    if any(s != c and part.get(s) is not None and part.get(c) is not None for s, c in there):
        return "two spellings of a part's field"
    if len(there) > 1:
        return "part with several fields"
    return None if there or part.get("thought") else "part without an observable field"


def content_digest(role: str | None, text: str | None) -> str | None:
    try:
        content = None if text is None else strict_json(text)
    except ValueError:
        return None
    parts = [{"type": "text", "text": content}] if isinstance(content, str) else content
    if not isinstance(parts, list):
        return None
    return hashlib.sha256(canonical([role, outline(parts)], ensure_ascii=True).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def signature(roles: pd.Series, texts: pd.Series) -> pd.Series:
    """SHA-256 of what can be observed of a role's content (JSON text of a text or a list of parts) in canonical form; null where the content is neither."""
    return pd.Series([content_digest(r, t) for r, t in zip(roles, texts, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def parts_fault(texts: pd.Series) -> pd.Series:
    """The first fault of lists of parts (JSON text), or null."""

    def of(text: str | None) -> str | None:
        parts = None if text is None else strict_json(text)
        return next((f for p in parts if (f := part_fault(p))), None) if isinstance(parts, list) else None

    return texts.map(of)


@F.pandas_udf(T.StringType())
def visible_json(texts: pd.Series) -> pd.Series:
    """JSON texts in canonical form without any opaque key, at every depth."""
    return texts.map(lambda t: None if t is None else canonical(visible(strict_json(t))))
