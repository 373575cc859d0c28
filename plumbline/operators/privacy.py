"""Privacy: redaction, the scan for what is left, and the review of both."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import canonical, unique_object
from plumbline.operators.selection import trace_of

#: Detector, kind, pattern, group that holds the sensitive part.
DETECTORS = [
    ("assignment", "secret", r"(?i)(\b(?:api[_-]?key|access[_-]?token|secret|password)\b\s*[:=]\s*[\"']?)([^\s,\"']{8,})", 2),
    ("bearer", "secret", r"(?i)(\bBearer\s+)([A-Za-z0-9._~+/=-]{12,})", 2),
    ("openai_api_key", "secret", r"\bsk-[A-Za-z0-9_-]{12,}\b", 0),
    ("github_token", "secret", r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", 0),
    ("email", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}\b", 0),
    ("phone", "phone", r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?!\w)", 0),
]
#: Fixed value: what a redaction leaves in place of a match.
PLACEHOLDER = r"<redacted:[^>\r\n]+>"


@dataclass(frozen=True)
class Rule:
    """A pattern of the user's own; flags: i, m."""

    id: str
    pattern: str
    flags: str = ""

    def compile(self) -> re.Pattern[str]:
        return re.compile(self.pattern, sum({"i": re.I, "m": re.M}[f] for f in self.flags))


@dataclass(frozen=True)
class Policy:
    id: str = "default"
    secrets: bool = True
    emails: bool = True
    phones: bool = True
    rules: tuple[Rule, ...] = ()
    allow: tuple[str, ...] = field(default=())

    def digest(self) -> str:
        body = {"id": self.id, "redact_secrets": self.secrets, "redact_emails": self.emails, "redact_phones": self.phones, "custom_rules": [{"id": r.id, "pattern": r.pattern, "flags": r.flags} for r in self.rules], "allow_values": list(self.allow)}
        return hashlib.sha256(canonical(body, ensure_ascii=True).encode()).hexdigest()

    def steps(self) -> list[tuple[str, str | None, re.Pattern[str], int]]:
        """kind, rule, pattern, group in the order in which they are applied, each to what the one before left."""
        on = {"secret": self.secrets, "email": self.emails, "phone": self.phones}
        return [("custom", r.id, r.compile(), 0) for r in self.rules] + [(kind, None, re.compile(p), g) for _, kind, p, g in DETECTORS if on[kind]]


REDACTION = "kind:string,rule_id:string,digest:string,placeholder:string"


def substitution(policy: Policy):
    """Function (text, found) -> redacted text; what it replaces is added to found."""
    steps, allowed = policy.steps(), frozenset(policy.allow)

    def apply(text: str, found: list[dict]) -> str:
        for kind, rule, pattern, group in steps:

            def put(m: re.Match[str], kind: str = kind, rule: str | None = rule, group: int = group) -> str:
                raw = m.group(group)
                if raw in allowed or (raw.startswith("<redacted:") and raw.endswith(">")):
                    return m.group(0)
                digest = hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()
                mark = f"<redacted:{'custom:' + rule if rule else kind}:{digest[:12]}>"
                found.append({"kind": kind, "rule_id": rule, "digest": digest, "placeholder": mark})
                return m.group(0)[: m.start(group) - m.start(0)] + mark  # the sensitive part ends the match

            text = pattern.sub(put, text)
        return text

    return apply


def redactor(policy: Policy):
    """UDF text -> struct(text, redactions). A placeholder holds the match's own digest, which no built-in replacement can make; Arrow batches in Python."""
    apply = substitution(policy)

    def one(text: str | None) -> dict:
        found: list[dict] = []
        return {"text": None if text is None else apply(text, found), "redactions": found}

    @F.pandas_udf(f"text string, redactions array<struct<{REDACTION}>>")
    def redact(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=["text", "redactions"])

    return redact


def redact(rows: DataFrame, column: str, policy: Policy | None = None) -> DataFrame:
    """rows with `column` redacted, and an array `redactions` of what was replaced."""
    done = rows.withColumn("__redacted", redactor(policy or Policy())(F.col(column)))
    return done.withColumn(column, F.col("__redacted.text")).withColumn("redactions", F.col("__redacted.redactions")).drop("__redacted")


def kept_as_is(raw: Column, allow: tuple[str, ...]) -> Column:
    listed = raw.isin(*allow) if allow else F.lit(False)
    return listed | (raw.startswith("<redacted:") & raw.endswith(">"))


def finding(kind: str, detector: str, rule: str | None):
    return lambda raw: F.struct(F.lit(kind).alias("kind"), F.lit(detector).alias("detector"), F.lit(rule).cast("string").alias("rule_id"), F.sha2(raw, 256).alias("digest"))


def custom_findings(policy: Policy):
    """UDF text without placeholders -> array of (rule_id, digest) of what the user's own rules find. They are Python's regular expressions, so they run in Python, in Arrow batches."""
    rules, allowed = [(r.id, r.compile()) for r in policy.rules], frozenset(policy.allow)

    def of(text: str) -> list[dict]:
        raws = {(i, m.group(0)): None for i, p in rules for m in p.finditer(text) if m.group(0) not in allowed and not (m.group(0).startswith("<redacted:") and m.group(0).endswith(">"))}
        return [{"rule_id": i, "digest": hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()} for i, raw in raws]

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("digest", T.StringType())])))
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: of(t) if t else [])

    return find


def residual_findings(text: Column, policy: Policy | None = None, only: tuple[str, ...] = ()) -> Column:
    """Array of (kind, detector, rule_id, digest) of what the detectors, all of them, still find outside placeholders: the built-in ones in the JVM, where (?U) makes classes Unicode, as the patterns mean them, and the user's own as custom_findings()."""
    policy = policy or Policy()
    left = F.regexp_replace(text, PLACEHOLDER, "")
    lists = []
    for detector, kind, pattern, group in DETECTORS:
        if only and detector not in only:
            continue
        raws = F.regexp_extract_all(left, F.lit("(?U)" + pattern), F.lit(group))
        lists.append(F.transform(F.filter(F.array_distinct(raws), lambda r: ~kept_as_is(r, policy.allow)), finding(kind, detector, None)))
    if policy.rules and not only:
        lists.append(F.transform(custom_findings(policy)(left), lambda c: F.struct(F.lit("custom").alias("kind"), F.concat(F.lit("custom:"), c["rule_id"]).alias("detector"), c["rule_id"].alias("rule_id"), c["digest"].alias("digest"))))
    return F.concat(*lists)


def scan(rows: DataFrame, location: str, column: str, policy: Policy | None = None, only: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """location, kind, detector, rule_id, digest of each residual finding, once for each kind, rule, place and value; within: columns that a place belongs to, kept too."""
    found = rows.select(*within, F.col(location).alias("location"), F.explode(residual_findings(F.col(column), policy, only)).alias("f")).select(*within, "location", "f.*")
    first = F.min(F.struct(F.coalesce(*(F.when(F.col("detector") == d, F.lit(i)) for i, (d, *_) in enumerate(DETECTORS)), F.lit(len(DETECTORS))), "detector"))
    return found.groupBy(*within, "location", "kind", "rule_id", "digest").agg(first["detector"].alias("detector")).select(*within, "location", "kind", "detector", "rule_id", "digest")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("location", T.StringType()), T.StructField("text", T.StringType())])))
def json_strings(texts: pd.Series) -> pd.Series:
    """Every string of JSON texts, decoded, with its place: keys /<key:i>, values /<value:i>, items of lists by index. A text that is no JSON is one string. JSON nests without end, so this runs in Arrow batches in Python."""

    def walk(value: object, at: str, out: list[dict]) -> None:
        if isinstance(value, str):
            out.append({"location": at, "text": value.encode("utf-8", "replace").decode()})
        elif isinstance(value, list):
            for i, x in enumerate(value):
                walk(x, f"{at}/{i}", out)
        elif isinstance(value, Pairs):
            for i, (k, x) in enumerate(value.items):
                walk(k, f"{at}/<key:{i}>", out)
                walk(x, f"{at}/<value:{i}>", out)

    def of(text: str | None) -> list[dict]:
        out: list[dict] = []
        try:
            if text is not None:
                walk(json.loads(text, object_pairs_hook=Pairs), "", out)
        except (ValueError, RecursionError):
            out = [{"location": "", "text": text}]
        return out

    return texts.map(of)


class Pairs:
    """An object's keys and values as they stand, so that a repeated key hides nothing."""

    def __init__(self, items: list[tuple[str, object]]) -> None:
        self.items = items


def event_strings(events: DataFrame, texts: list[str], documents: list[str]) -> DataFrame:
    """The trace, location and text of every string in the events' columns of text and of JSON text: /events/<sequence>/<column>, and below it the place inside the JSON."""
    trace = trace_of(events)
    place = lambda c: F.concat(F.lit("/events/"), F.col("sequence").cast("string"), F.lit(f"/{c}"))
    of_text = [F.array(F.struct(place(c).alias("location"), F.col(c).alias("text"))) for c in texts]
    below = lambda c: lambda x: F.struct(F.concat(place(c), x["location"]).alias("location"), x["text"].alias("text"))
    of_json = [F.transform(json_strings(c), below(c)) for c in documents]
    return events.select(*trace, F.explode(F.concat(*of_text, *of_json)).alias("s")).select(*trace, "s.*").where("text is not null")


def event_residuals(events: DataFrame, texts: list[str], documents: list[str], policy: Policy | None = None) -> DataFrame:
    """The trace, location, kind, detector, rule_id, digest of what is found in any decoded string of the events, whether they were redacted before or not."""
    return scan(event_strings(events, texts, documents), "location", "text", policy, within=tuple(trace_of(events)))


def review(redacted: DataFrame, residuals: DataFrame, policy: Policy | None = None, enabled: bool = True) -> DataFrame:
    """One row that never holds a matched value: counts of redactions by kind and rule, residual findings, and warnings."""
    policy = policy or Policy()
    each = redacted.select(F.explode("redactions").alias("r")).select("r.*")
    totals = each.agg(F.count("*").alias("total_redactions"), F.count_distinct("digest").alias("unique_redacted_values"))

    def counts(column: str, name: str) -> DataFrame:  # few kinds, few rules
        return each.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    left = residuals.agg(F.count("*").alias("residual_findings"))
    one = totals.crossJoin(counts("kind", "counts_by_kind")).crossJoin(counts("rule_id", "counts_by_rule")).crossJoin(left)  # a row each
    # The warnings' names.
    warn = lambda text, when=True: F.when(F.lit(when) if isinstance(when, bool) else when, text)
    warnings = F.array_compact(F.array(
        warn("pattern_matching_cannot_prove_complete_deidentification"), warn("redaction_disabled_review_only", not enabled), warn("custom_rules_are_trusted_python_regular_expressions", bool(policy.rules)),
        warn("allowlisted_values_are_retained_verbatim", bool(policy.allow)), warn("residual_sensitive_patterns_detected", F.col("residual_findings") > 0),
    ))
    return one.select(F.lit(policy.id).alias("policy_id"), F.lit(policy.digest()).alias("policy_sha256"), F.lit(enabled).alias("redaction_enabled"), "*", F.lit(len(policy.allow)).alias("allow_value_count"), warnings.alias("warnings"), F.lit(True).alias("manual_review_recommended"))


def redact_json(policy: Policy | None = None):
    """UDF JSON text -> struct(text, redactions) with locations: strings are redacted at every depth, keys too (/<key:i> and /<value:i>, list items by index). A text that is no JSON is redacted as it stands."""
    apply = substitution(policy or Policy())

    def redacted(value: object, at: str, found: list[dict]) -> object:
        if isinstance(value, str):
            new: list[dict] = []
            text = apply(value, new)
            found += [r | {"location": at} for r in new]
            return text
        if isinstance(value, list):
            return [redacted(x, f"{at}/{i}", found) for i, x in enumerate(value)]
        if isinstance(value, dict):
            pairs = [(redacted(k, f"{at}/<key:{i}>", found), redacted(x, f"{at}/<value:{i}>", found)) for i, (k, x) in enumerate(value.items())]
            return unique_object(pairs)  # two keys that redaction made equal are an error
        return value

    def one(text: str | None) -> dict:
        found: list[dict] = []
        try:
            value = None if text is None else json.loads(text)
        except (ValueError, RecursionError):
            return {"text": redacted(text, "", found), "redactions": found}
        if text is not None:
            value = redacted(value, "", found)
            text = canonical(value)
            if not text.isascii() and any("\ud800" <= c <= "\udfff" for c in text):  # half a character, which only JSON can hold
                text = canonical(value, ensure_ascii=True)
        return {"text": text, "redactions": found}

    @F.pandas_udf(f"text string, redactions array<struct<{REDACTION},location:string>>")
    def walk(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["text", "redactions"])

    return walk


def located(redactions: Column, place: Column, inside: bool) -> Column:
    """Redactions with their locations; inside: they have one of their own, below the place."""
    return F.transform(redactions, lambda r: F.struct(r["kind"].alias("kind"), r["rule_id"].alias("rule_id"), r["digest"].alias("digest"), r["placeholder"].alias("placeholder"), (F.concat(place, r["location"]) if inside else place).alias("location")))


def redact_events(events: DataFrame, texts: list[str], documents: list[str], policy: Policy | None = None) -> DataFrame:
    """Events (trace_id, sequence) whose columns of text, and of JSON text at every depth, are redacted, with an array `redactions` of what was replaced and where: /events/<sequence>/<column>, and below it the place inside the JSON."""
    active = policy or Policy()
    none = F.array().cast(f"array<struct<{REDACTION},location:string>>")
    out, found = events, []
    for column in [*texts, *documents]:
        place = F.concat(F.lit("/events/"), F.col("sequence").cast("string"), F.lit(f"/{column}"))
        done = f"__{column}"
        out = out.withColumn(done, (redactor if column in texts else redact_json)(active)(F.col(column)))
        found.append(located(F.col(f"{done}.redactions"), place, column in documents))
    out = out.withColumn("redactions", F.concat(none, *found))
    for column in [*texts, *documents]:
        out = out.withColumn(column, F.col(f"__{column}.text")).drop(f"__{column}")
    return out


def apply_policy(events: DataFrame, texts: list[str], documents: list[str], policy: Policy | None = None, enabled: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events under a policy: the events (redacted, if enabled), the records of what was replaced (the trace, location, kind, rule_id, digest, placeholder), and the one row of the review, whose residual findings are those of the events returned. There is no limit on records."""
    active, trace = policy or Policy(), trace_of(events)
    empty = F.array().cast(f"array<struct<{REDACTION},location:string>>")
    done = redact_events(events, texts, documents, active) if enabled else events.withColumn("redactions", empty)
    records = done.select(*trace, F.explode("redactions").alias("r")).select(*trace, "r.location", "r.kind", "r.rule_id", "r.digest", "r.placeholder")
    return done.drop("redactions"), records, review(done, event_residuals(done, texts, documents, active), active, enabled)
