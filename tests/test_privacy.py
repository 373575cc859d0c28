import hashlib
import json
import re

from plumbline.operators import privacy
from plumbline.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def events(spark, *payloads):
    return spark.createDataFrame([("t", k, "plain", p) for k, p in enumerate(payloads)], "trace_id string, sequence int, content string, payload string")


def found(spark, *payloads, policy=None):
    return sorted((r.location, r.detector, r.digest) for r in privacy.event_residuals(events(spark, *payloads), ["content"], ["payload"], policy).collect())


def test_strings_are_decoded_before_they_are_scanned(spark):
    mail = sha("bob@example.com")
    assert found(spark, r'{"k":"bob\u0040example.com"}', r'{"k":"line\nbob@example.com"}', r'{"bob\u0040example.com":[1,{"x":"y"}]}') == [("/events/0/payload/<value:0>", "email", mail), ("/events/1/payload/<value:0>", "email", mail), ("/events/2/payload/<key:0>", "email", mail)]
    assert found(spark, '{"k":["a","bob@example.com","bob@example.com bob@example.com"],"k":"bob@example.com"}') == [("/events/0/payload/<value:0>/1", "email", mail), ("/events/0/payload/<value:0>/2", "email", mail), ("/events/0/payload/<value:1>", "email", mail)]
    assert found(spark, "no json: bob@example.com", None, "3", '"bob@example.com"', r'{"k":"\ud800 bob@example.com"}') == [("/events/0/payload", "email", mail), ("/events/3/payload", "email", mail), ("/events/4/payload/<value:0>", "email", mail)]


def test_custom_rules_are_pythons_in_the_scan_too(spark):
    policy = privacy.Policy(rules=(privacy.Rule("tag", r"(?P<tag>ACME)-(?P=tag)"), privacy.Rule("line", r"^x+$", "im")), allow=("XXX",))
    text = "ACME-ACME acme-acme\nXX\nXXX\nbob@example.com"
    want = sorted([("a", "custom:tag", sha("ACME-ACME")), ("a", "custom:line", sha("XX")), ("a", "email", sha("bob@example.com"))])
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", "<redacted:custom:tag:000000000000>")], "id string, text string")
    assert sorted((r.location, r.detector, r.digest) for r in privacy.scan(rows, "id", "text", policy).collect()) == want
    redacted = privacy.redact(rows, "text", policy)
    assert privacy.scan(redacted, "id", "text", policy).count() == 0
    assert found(spark, json.dumps({"k": text}), policy=policy) == sorted(("/events/0/payload/<value:0>", *w[1:]) for w in want)


def test_review_only_counts_what_redaction_would_take(spark):
    e = events(spark, r'{"k":"bob\u0040example.com","l":"line\nbob@example.com"}', "token sk-abcdefghijklmnop", r'{"k":"\ud800 \u0062ob@example.com"}')
    done, records, review = privacy.apply_policy(e, ["content"], ["payload"], enabled=False)
    assert review.first().residual_findings == 4 and records.count() == 0 and done.collect() == e.collect()
    done, records, review = privacy.apply_policy(e, ["content"], ["payload"])
    assert (review.first().total_redactions, review.first().residual_findings) == (4, 0)
    assert json.loads(done.where("sequence = 2").first().payload)["k"].startswith("\ud800 <redacted:email:")
    twice = e.withColumn("source_name", e.trace_id).unionByName(e.selectExpr("*", "'other' as source_name"))
    assert privacy.apply_policy(twice, ["content"], ["payload"], enabled=False)[2].first().residual_findings == 8


def plainly(text):
    """Redaction of a text by Python alone: (text, number of replacements, digests)."""
    digests = []
    for _, kind, pattern, group in privacy.DETECTORS:

        def put(m, kind=kind, group=group):
            raw = m.group(group)
            if raw.startswith("<redacted:") and raw.endswith(">"):
                return m.group(0)
            digests.append((kind, sha(raw)))
            return m.group(0)[: m.start(group) - m.start()] + f"<redacted:{kind}:{sha(raw)[:12]}>" + m.group(0)[m.end(group) - m.start() :]

        text = re.sub(pattern, put, text)
    return text, digests


def left_over(text):
    out = set()
    text = re.sub(privacy.PLACEHOLDER, "", text)
    for _, kind, pattern, group in privacy.DETECTORS:
        out |= {(kind, sha(m.group(group))) for m in re.finditer(pattern, text)}
    return out


def test_queries_over_documents_against_python(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: plainly(t) for i, t in docs.items()}
    assert {(r.doc_id, r.text_sha256, r.redactions) for r in QUERIES["redaction"](spark, sf).collect()} == {(i, sha(t), len(d)) for i, (t, d) in want.items()}
    r = QUERIES["redaction_review"](spark, sf).first()
    every = [d for _, ds in want.values() for d in ds]
    kinds = sorted({k for k, _ in every})
    assert (r.total_redactions, r.unique_redacted_values) == (len(every), len({d for _, d in every})) and len(every) > 3
    assert r.counts_by_kind == ",".join(f"{k}={sum(x == k for x, _ in every)}" for k in kinds)
    assert r.residual_findings == sum(len(left_over(t)) for t in docs.values())
    phone = next(p for d, _, p, _ in privacy.DETECTORS if d == "phone")
    phones = {(i, sha(m.group())) for i, t in docs.items() for m in re.finditer(phone, re.sub(privacy.PLACEHOLDER, "", t))}
    assert {(r.location, r.digest) for r in QUERIES["residual_scan_phones"](spark, sf).collect()} == phones and phones
