"""Scalar expressions shared by the operators; all of them stay inside the JVM unless they say otherwise."""

from __future__ import annotations

import fnmatch
import json
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The separator of keys, identifiers, the marker of cut outputs, the longest run id.
UNIT_SEPARATOR = "\x1f"
ID_PATTERN = "^[a-zA-Z0-9][a-zA-Z0-9_.-]{0,127}$"
TRUNCATED = "\n... <output truncated> ...\n"
MAX_RUN_ID = 256


def composite_key(*parts: Column) -> Column:
    """SHA-256 of the parts' texts, joined by the unit separator; a null part reads None."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256)


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def head_tail(text: Column, limit: int) -> Column:
    """Texts over the limit as their head and tail around a marker; the marker counts against the limit."""
    room = max(0, limit - len(TRUNCATED))
    head, tail = room // 2, room - room // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(TRUNCATED), F.right(text, F.lit(tail)) if tail else F.lit("")))


def matrix_run_id(experiment: Column, variant: Column, repetition: Column) -> Column:
    """experiment.variant.repetition in three digits; over the longest id, its start and 16 digits of its digest."""
    natural = F.concat_ws(".", experiment, variant, F.when(repetition < 1000, F.lpad(repetition.cast("string"), 3, "0")).otherwise(repetition.cast("string")))
    return F.when(F.length(natural) <= MAX_RUN_ID, natural).otherwise(F.concat(F.left(natural, F.lit(MAX_RUN_ID - 17)), F.lit("."), F.left(F.sha2(natural, 256), F.lit(16))))


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(ID_PATTERN), F.lit(False))


def placeholder(label: Column, raw: Column) -> Column:
    return F.concat(F.lit("<redacted:"), label, F.lit(":"), F.left(F.sha2(raw, 256), F.lit(12)), F.lit(">"))


def render_template(template: Column, variables: Column) -> Column:
    """Each ${name} replaced by its value in a map."""
    return F.aggregate(F.map_entries(variables), template, lambda text, e: F.replace(text, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))


def nanos_to_timestamp(nanos: Column) -> Column:
    """Timestamps hold microseconds; order and subtract the nanoseconds themselves."""
    return F.timestamp_micros(F.floor(nanos.cast("decimal(20,0)") / 1000).cast("long"))


def plus_seconds(start: Column, seconds: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(seconds * 1_000_000).cast("long"), start)


def iso_utc(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def same_within(a: Column, b: Column, relative: float = 1e-12) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def all_equal(match: Column, metadata: Column) -> Column:
    """Whether every entry of the map match stands in metadata."""
    return F.forall(F.map_entries(match), lambda e: F.coalesce(F.element_at(metadata, e["key"]) == e["value"], F.lit(False)))


def may_overlap(left: Column, right: Column) -> Column:
    """Whether some metadata could match both maps: they agree wherever both name a key."""
    return F.forall(F.array_intersect(F.map_keys(left), F.map_keys(right)), lambda k: F.element_at(left, k) == F.element_at(right, k))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of some shell patterns (case counts, * crosses slashes)."""
    return F.coalesce(F.greatest(F.lit(False), F.lit(False), *(path.rlike("^" + fnmatch.translate(p)[:-2] + "\\z") for p in patterns)), F.lit(False))


def canonical(value: object, ensure_ascii: bool = False) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ensure_ascii, allow_nan=False)


def unique_object(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """Object hook that refuses a repeated key."""
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate object key")
    return out


def no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


#: Made once: json.loads makes a decoder for each text.
STRICT = json.JSONDecoder(object_pairs_hook=unique_object, parse_constant=no_constant)


def strict_json(text: str) -> object:
    """JSON without repeated keys, NaN or infinities."""
    return STRICT.decode(text)


def strict_or_none(text: str | None) -> object:
    try:
        return strict_json(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Sorted, compact JSON of JSON texts; null where the text is no strict JSON. Arrow batches in Python."""
    return texts.map(lambda t: None if t is None or (v := strict_or_none(t)) is None and t.strip() != "null" else canonical(v))


def canonical_digest(json_text: Column) -> Column:
    return F.sha2(canonical_json(json_text), 256)


def pointer_tokens(pointer: str) -> list[str]:
    """RFC 6901 tokens of a pointer."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a JSON pointer starts with /")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]


def lookup(document: object, pointer: str) -> tuple[bool, object]:
    for token in pointer_tokens(pointer):
        if isinstance(document, dict) and token in document:
            document = document[token]
        elif isinstance(document, list) and token.isdigit() and (token == "0" or token[0] != "0") and int(token) < len(document):
            document = document[int(token)]
        else:
            return False, None
    return True, document


def json_pointer(pointer: str):
    """UDF: canonical JSON of what a pointer finds in a JSON text, or null. Arrow batches in Python: a token is a key or an index as the data have it."""
    pointer_tokens(pointer)

    @F.pandas_udf(T.StringType())
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical(got[1]) if (got := lookup(strict_or_none(t), pointer))[0] else None)

    return find


@F.pandas_udf(T.StructType([T.StructField("found", T.BooleanType()), T.StructField("value", T.StringType())]))
def value_at(texts: pd.Series, pointers: pd.Series) -> pd.DataFrame:
    """Whether a row's pointer finds something in its JSON text, and the canonical JSON of it; nothing is found in what is no strict JSON. Each row has its own pointer."""
    rows = []
    for text, pointer in zip(texts, pointers, strict=True):
        document = strict_or_none(text)
        found, value = lookup(document, pointer or "") if document is not None or (text or "").strip() == "null" else (False, None)
        rows.append({"found": found, "value": canonical(value) if found else None})
    return pd.DataFrame(rows, columns=["found", "value"])


def digest_mismatch(json_text: Column, claimed: Column) -> Column:
    """Whether a JSON document is not the one of a claimed digest: no strict JSON, or another one in canonical form."""
    return ~F.coalesce(canonical_digest(json_text) == claimed, F.lit(False))


def binomial_sum(n: int, most: int) -> int:
    """The sum of n over k for k up to most."""
    total = term = 1
    for k in range(most):
        term = term * (n - k) // (k + 1)
        total += term
    return total


def mcnemar_tail(candidate_only: int, baseline_only: int) -> Fraction:
    """Exact one-sided tail: the chance of so many wins among the discordant pairs if either side wins evenly."""
    if candidate_only <= baseline_only:
        return Fraction(1)
    n = candidate_only + baseline_only
    return Fraction(binomial_sum(n, baseline_only), 1 << n)


#: Up to so many lost pairs the exact sum is as quick as the bounds.
EXACT_UP_TO = 500


def mcnemar_bounds(candidate_only: int, baseline_only: int) -> tuple[float, float]:
    """Two numbers that the tail lies between, from its largest term and the ratios of the others; the time grows with the root of the number of pairs.

    The largest term is exp of n times a divergence, which Stirling's series gives to a few units in the last place: its remainder is below 1/(1260 m^5) for the smaller count m, and rounding below some units of the two logarithms' sizes. Terms that are left out are bounded by a geometric series."""
    c, b = candidate_only, baseline_only
    if c <= b:
        return 1.0, 1.0
    if b <= EXACT_UP_TO:
        p = float(mcnemar_tail(c, b))
        return p * (1 - 2.0**-52), min(1.0, p * (1 + 2.0**-52))
    n, x = c + b, (c - b) / (c + b)
    up, down = c * math.log1p(x), b * math.log1p(-x)
    series = sum(s * (1 / (12 * v) - 1 / (360 * v**3)) for s, v in ((1, n), (-1, c), (-1, b)))
    log_term = -(up + down) + 0.5 * math.log(n / (2 * math.pi * c * b)) + series
    total, term, k = 1.0, 1.0, b
    while term > total * 1e-17 and k > 0:  # n over k - 1 is n over k times k / (n - k + 1)
        term *= k / (n - k + 1)
        total, k = total + term, k - 1
    rest = term * b / (n - b + 1) / (1 - b / (n - b + 1)) if k else 0.0
    slack = 3 / (1260 * b**5) + 2.0**-50 * (abs(up) + abs(down) + 4) + 2.0**-51 * (b - k + 2)
    p = math.exp(log_term) * total
    return p * (1 - slack), min(1.0, math.exp(log_term) * (total + rest) * (1 + slack))


def tail_exceeds(candidate_only: int, baseline_only: int, most: Fraction) -> bool:
    """Whether the exact tail is over a threshold: by the bounds, and by the exact sum only where the threshold lies between them."""
    low, high = mcnemar_bounds(candidate_only, baseline_only)
    if Fraction(high) <= most:
        return False
    if Fraction(low) > most:
        return True
    return mcnemar_tail(candidate_only, baseline_only) > most


def mcnemar_value(candidate_only: int, baseline_only: int) -> float:
    """The tail to at least nine digits."""
    low, high = mcnemar_bounds(candidate_only, baseline_only)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def mcnemar_p(candidate_only: pd.Series, baseline_only: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_value(int(c), int(b)) for c, b in zip(candidate_only, baseline_only, strict=True)])
