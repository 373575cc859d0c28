"""Documents that name each other by the digests of their canonical form, and whether every link holds: variants and their capsules, decisions, rollback plans and receipts.

All of it is equi-joins on digests; a digest is of canonical JSON, which is made in
Arrow batches (`canonical_json`). A document that is no strict JSON has no digest, so
its own link fails, with a fault.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import canonical_digest, canonical_json

VARIANT = "base_capsule_sha256 string, variant struct<id:string>"
#: What can be set in a variant; a variant's dimensions are those of them that it has.
DIMENSIONS = ("context", "env", "prompt", "routing", "tools", "workflow")
DECISION = "decision string, baseline_variant_id string, baseline_variant_sha256 string, candidate_variant_id string, candidate_variant_sha256 string"
PLAN = "promotion_decision_sha256 string, active_variant_id string, active_variant_sha256 string, target_variant_id string, target_variant_sha256 string"



def verify_variants(documents: DataFrame, capsules: DataFrame) -> DataFrame:
    """Variant documents (source_name, document) against capsules (document): source_name, variant_id, document_sha256, variant_sha256, base_capsule_sha256, dimensions and fault, null where the document is bound to a capsule that is there."""
    known = capsules.select(canonical_digest(F.col("document")).alias("base_capsule_sha256")).where("base_capsule_sha256 is not null").distinct().withColumn("there", F.lit(True))
    d = documents.select("source_name", canonical_json("document").alias("c"))
    inner = F.get_json_object("c", "$.variant")
    d = d.select("source_name", "c", F.from_json("c", VARIANT).alias("v"), canonical_digest(inner).alias("variant_sha256"), F.array_sort(F.array_intersect(F.coalesce(F.json_object_keys(inner), F.array().cast("array<string>")), F.array(*map(F.lit, DIMENSIONS)))).alias("dimensions"))
    d = d.withColumn("base_capsule_sha256", F.col("v.base_capsule_sha256")).join(known, "base_capsule_sha256", "left")
    fault = F.when(F.col("c").isNull(), "no strict JSON").when(F.col("v.variant.id").isNull(), "no variant").when(F.col("there").isNull(), "capsule is another or missing")
    return d.select("source_name", F.col("v.variant.id").alias("variant_id"), F.sha2("c", 256).alias("document_sha256"), "variant_sha256", "base_capsule_sha256", "dimensions", fault.alias("fault"))


def promotion_receipts(decisions: DataFrame, plans: DataFrame, variants: DataFrame) -> DataFrame:
    """For each rollback plan (source_name, document) the first link that is broken, or none: plan to decision, decision to promotion, active variant to candidate, target to baseline, both variants to verified documents (variants: variant_id, variant_sha256). A row with null fault is a receipt: the digests of decision and plan, the variant that is active and the one before.

    decisions: documents. Equal documents are one; each plan is answered once, even where it stands twice under one name."""
    d = decisions.select(canonical_json("document").alias("c")).where("c is not null").distinct().select(F.sha2("c", 256).alias("promotion_decision_sha256"), F.from_json("c", DECISION).alias("d"))
    p = plans.select("source_name", canonical_json("document").alias("c")).distinct()
    p = p.select("source_name", F.sha2("c", 256).alias("rollback_plan_sha256"), F.from_json("c", PLAN).alias("p")).withColumn("promotion_decision_sha256", F.col("p.promotion_decision_sha256"))
    met = p.join(d, "promotion_decision_sha256", "left")
    sealed = variants.select("variant_id", "variant_sha256").distinct()
    side = lambda id_, sha, name: sealed.select(F.col("variant_id").alias(id_), F.col("variant_sha256").alias(sha), F.lit(True).alias(name))
    met = met.withColumns({"active_variant_id": F.col("p.active_variant_id"), "active_variant_sha256": F.col("p.active_variant_sha256"), "previous_variant_id": F.col("p.target_variant_id"), "previous_variant_sha256": F.col("p.target_variant_sha256")})
    met = met.join(side("active_variant_id", "active_variant_sha256", "a"), ["active_variant_id", "active_variant_sha256"], "left").join(side("previous_variant_id", "previous_variant_sha256", "b"), ["previous_variant_id", "previous_variant_sha256"], "left")
    same = lambda one, other: F.col(f"p.{one}_variant_id").eqNullSafe(F.col(f"d.{other}_variant_id")) & F.col(f"p.{one}_variant_sha256").eqNullSafe(F.col(f"d.{other}_variant_sha256"))
    fault = (
        F.when(F.col("rollback_plan_sha256").isNull(), "no strict JSON").when(F.col("d").isNull(), "plan of no known decision").when(~F.col("d.decision").eqNullSafe("promote"), "decision does not promote")
        .when(~same("active", "candidate"), "active variant is not the candidate").when(~same("target", "baseline"), "target is not the baseline").when(F.col("a").isNull(), "active variant is not verified").when(F.col("b").isNull(), "target is not verified")
    )
    return met.select("source_name", "promotion_decision_sha256", "rollback_plan_sha256", "active_variant_id", "active_variant_sha256", "previous_variant_id", "previous_variant_sha256", fault.alias("fault"))


def view_digest(rows: DataFrame, name: str, schema_version: str, sources: DataFrame) -> DataFrame:
    """row_count and memory_sha256 of a view's answer, in its order: the canonical JSON of the view's name, its rows, the store's version and its number of sources (sources: the store's table). An answer is at most as long as a view's limit, so it is one array."""
    ordered = rows.select(F.monotonically_increasing_id().alias("at"), canonical_json(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).alias("json"))
    listed = ordered.agg(F.count("*").alias("row_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "json"))), lambda x: x["json"]), ",").alias("rows"))
    body = F.concat(F.lit('{"rows":['), "rows", F.lit(f'],"store_schema_version":"{schema_version}","store_source_count":'), F.col("n").cast("string"), F.lit(f',"view":"{name}"}}'))
    return listed.crossJoin(sources.agg(F.count("*").alias("n"))).select(F.lit(name).alias("view"), "row_count", F.sha2(body, 256).alias("memory_sha256"))  # a row each
