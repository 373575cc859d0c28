import hashlib
import json

from plumbline.operators import binding


def sha(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def docs(spark, *texts):
    return spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(texts)], "source_name string, document string")


def test_variants_and_receipts(spark):
    capsule = {"id": "c", "n": [1, 2.5]}
    variant = {"id": "v", "prompt": {"é": 1}, "other": 2}
    bound = {"base_capsule_sha256": sha(capsule), "variant": variant}
    got = sorted(map(tuple, binding.verify_variants(docs(spark, json.dumps(bound), json.dumps(bound | {"base_capsule_sha256": "x"}), "{", None, "{}"), docs(spark, json.dumps(capsule), "nonsense", None)).select("source_name", "variant_id", "document_sha256", "variant_sha256", "fault").collect()), key=lambda r: r[0])
    assert got[0] == ("s0", "v", sha(bound), sha(variant), None)
    assert [r[-1] for r in got[1:]] == ["capsule is another or missing", "no strict JSON", "no strict JSON", "no variant"]
    decision = {"decision": "promote", "baseline_variant_id": "b", "baseline_variant_sha256": "1", "candidate_variant_id": "v", "candidate_variant_sha256": "2"}
    plan = {"promotion_decision_sha256": sha(decision), "active_variant_id": "v", "active_variant_sha256": "2", "target_variant_id": "b", "target_variant_sha256": "1"}
    known = spark.createDataFrame([("v", "2"), ("b", "1"), ("b", "1")], "variant_id string, variant_sha256 string")
    plans = docs(spark, json.dumps(plan), json.dumps(plan | {"target_variant_sha256": "9"}), "{", "{}")
    out = {r.source_name: r for r in binding.promotion_receipts(docs(spark, json.dumps(decision), json.dumps(decision, indent=1)), plans.unionByName(plans.limit(1)), known).collect()}
    assert {k: r.fault for k, r in out.items()} == {"s0": None, "s1": "target is not the baseline", "s2": "no strict JSON", "s3": "plan of no known decision"}
    assert out["s0"].rollback_plan_sha256 == sha(plan)
    assert binding.promotion_receipts(docs(spark, json.dumps(decision)), plans.limit(1), known.limit(1)).first().fault == "target is not verified"
    assert binding.verify_variants(plans.limit(0), plans.limit(0)).count() == 0


def test_digest_of_an_answer(spark):
    rows = spark.createDataFrame([(2, "é", 0.5), (1, None, 1e20)], "a int, b string, c double").coalesce(1)
    got = binding.view_digest(rows, "runs", "1", rows).first()
    want = {"view": "runs", "rows": [{"a": 2, "b": "é", "c": 0.5}, {"a": 1, "b": None, "c": 1e20}], "store_schema_version": "1", "store_source_count": 2}
    assert (got.row_count, got.memory_sha256) == (2, sha(want))
