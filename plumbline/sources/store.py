"""The experiment store as Parquet tables, and the artifacts that feed it.

Each ingest has a partition of its own in every table, and its sources are written
last; readers take the partitions whose sources are there, so an ingest that
breaks off leaves nothing to see, and running it again adds nothing twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import canonical_json, composite_key
from plumbline.schemas import STORE_VERSION, TABLES
from plumbline.sources.artifacts import parsed

ROW_TABLES = ("runs", "checks", "failure_records", "variant_summaries")
MAX_ARTIFACT_BYTES = 100 << 20
REJECTED = "source_name string, source_sha256 string, fault string"


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """source_name and document of JSON files; files over the size limit are an error."""
    files = spark.read.format("binaryFile").load(path)
    whole = F.when(F.col("length") <= MAX_ARTIFACT_BYTES, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(F.lit("artifact too large: "), F.col("path"))))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_name"), whole.alias("document"))


def measured(checks: Column) -> Column:
    """Checks with the lengths and digests of their outputs instead of these."""

    def one(c: Column) -> Column:
        for name in ("stdout", "stderr"):
            text = F.coalesce(c[name], F.lit(""))
            c = c.withField(f"{name}_chars", F.length(text)).withField(f"{name}_sha256", F.sha2(text, 256)).withField(f"{name}_truncated", F.coalesce(c[f"{name}_truncated"], F.lit(False)))
        return c.dropFields("stdout", "stderr")

    return F.transform(checks, one)


def without_outputs(parsed: DataFrame) -> DataFrame:
    """Parsed artifacts, without their checks' raw outputs."""
    a = F.col("a")
    a = a.withField("checks", measured(a["checks"])).withField("runs", F.transform(a["runs"], lambda r: r.withField("result", r["result"].withField("checks", measured(r["result"]["checks"])))))
    return parsed.withColumn("a", a)


def tables_of(a: DataFrame) -> dict[str, DataFrame]:
    """The rows of parsed artifacts: sources, runs, checks, failure_records, variant_summaries. Outputs are kept as lengths and digests only; rows also name their source_name, failures their check_id."""
    sources = a.select("source_sha256", F.when(F.col("is_experiment"), "experiment").otherwise("run").alias("artifact_kind"), "source_name", F.col("a.schema_version").alias("artifact_schema_version"), F.current_timestamp().alias("ingested_at"))
    result = lambda r: F.struct(*(r[c].alias(c) for c in ("capsule_id", "status", "started_at", "finished_at", "duration_seconds", "checks"))).alias("result")
    alone = F.array(F.struct(F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("variant_id"), F.lit(None).cast("int").alias("repetition"), result(F.col("a"))))
    of_experiment = F.transform("a.runs", lambda r: F.struct(r["run_id"].alias("run_id"), r["variant_id"].alias("variant_id"), r["repetition"].alias("repetition"), result(r["result"])))
    each = a.select("source_sha256", "source_name", F.col("a.experiment_id").alias("experiment_id"), F.explode(F.when(F.col("is_experiment"), of_experiment).otherwise(alone)).alias("r"))
    keyed = each.withColumn("run_key", composite_key(F.col("source_sha256"), F.coalesce("r.run_id", F.lit("standalone"))))
    runs = keyed.select("run_key", "source_sha256", "source_name", "experiment_id", "r.run_id", "r.variant_id", "r.repetition", "r.result.capsule_id", "r.result.status", "r.result.started_at", "r.result.finished_at", "r.result.duration_seconds", F.when(F.col("r.result.checks").isNull(), 0).otherwise(F.size("r.result.checks")).alias("check_count"))
    c = keyed.select("source_sha256", "source_name", "run_key", F.posexplode("r.result.checks").alias("check_index", "c"))
    c = c.withColumn("check_key", composite_key(F.col("run_key"), F.col("check_index"), F.col("c.id")))
    checks = c.select(
        "check_key", "run_key", "source_sha256", "source_name", "check_index", F.col("c.id").alias("check_id"), "c.status", "c.exit_code", "c.duration_seconds", "c.cwd", F.to_json("c.argv").alias("argv_json"),
        "c.stdout_chars", "c.stderr_chars", "c.stdout_sha256", "c.stderr_sha256", "c.stdout_truncated", "c.stderr_truncated", F.col("c.error").alias("error_message"),
    )
    failures = c.where("c.failure is not null").select(
        composite_key(F.col("check_key"), F.col("c.failure.code")).alias("failure_key"), "check_key", "run_key", "source_sha256", "source_name", F.col("c.id").alias("check_id"), "c.failure.category", "c.failure.code", "c.failure.impact", "c.failure.retryability", "c.failure.summary",
        canonical_json(F.coalesce("c.failure.details", F.lit("{}"))).alias("details_json"), "c.failure.caused_by_check_id", F.to_json(F.coalesce("c.failure.causes", F.array().cast("array<string>"))).alias("causes_json"),
    )
    s = a.where("is_experiment").select("source_sha256", F.col("a.experiment_id").alias("experiment_id"), F.col("a.capsule_id").alias("capsule_id"), F.explode("a.summaries").alias("s"))
    summaries = s.select(composite_key(F.col("source_sha256"), F.col("experiment_id"), F.col("s.variant_id")).alias("summary_key"), "source_sha256", "experiment_id", "capsule_id", "s.*")
    return {"sources": sources, "runs": runs, "checks": checks, "failure_records": failures, "variant_summaries": summaries}


def normalize(artifacts: DataFrame) -> dict[str, DataFrame]:
    """The rows of the artifacts that may be stored."""
    return tables_of(without_outputs(parsed(artifacts).where("fault is null")))


def initialize(spark: SparkSession, root: str) -> None:
    """Create an empty store; one that is there must have this version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/store_metadata")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        version = spark.read.schema(TABLES["store_metadata"]).parquet(f"{root}/store_metadata").where("key = 'schema_version'").first()
        if version is None or version.value != STORE_VERSION:
            raise ValueError("the store has another version")
        return
    for name in (*ROW_TABLES, "sources"):
        spark.createDataFrame([], TABLES[name]).write.parquet(f"{root}/{name}/ingest=none")
    spark.createDataFrame([], REJECTED).write.parquet(f"{root}/rejected/ingest=none")
    spark.createDataFrame([("schema_version", STORE_VERSION)], TABLES["store_metadata"]).write.parquet(f"{root}/store_metadata")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(f"{TABLES[name]}, ingest string").parquet(f"{root}/{name}")


def ingest(artifacts: DataFrame, root: str, strict: bool = False) -> int:
    """Add artifacts whose bytes the store does not know; returns how many sources are new. Those with a fault go to the table of rejected ones, or, if strict, nothing is added. Documents are parsed once, into a staging table."""
    spark, mark = artifacts.sparkSession, uuid.uuid4().hex
    known = read_table(spark, root, "sources").select(F.col("source_sha256").alias("k"))
    staged = f"{root}/_staging/{mark}"
    without_outputs(parsed(artifacts.join(known, F.sha2("document", 256) == F.col("k"), "left_anti"))).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.parquet(staged)
    rejected = rows.where("fault is not null").select("source_name", "source_sha256", "fault")
    try:
        if strict and (bad := rejected.limit(3).collect()):
            raise ValueError("artifacts may not be stored: " + "; ".join(f"{r.source_name}: {r.fault}" for r in bad))
        rejected.write.option("compression", "zstd").parquet(f"{root}/rejected/ingest={mark}")
        tables = tables_of(rows.where("fault is null"))
        for name in (*ROW_TABLES, "sources"):
            columns = [c.split()[0] for c in TABLES[name].split(", ")]
            tables[name].select(*columns).write.option("compression", "zstd").parquet(f"{root}/{name}/ingest={mark}")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.schema(TABLES["sources"]).parquet(f"{root}/sources/ingest={mark}").count()


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The store's tables: of each source the rows of one finished ingest, also where two at once have added it."""
    sources = read_table(spark, root, "sources")
    finished = sources.groupBy("source_sha256").agg(F.min("ingest").alias("ingest"))
    tables = {name: read_table(spark, root, name).join(finished, ["source_sha256", "ingest"], "left_semi").drop("ingest") for name in (*ROW_TABLES, "sources")}
    columns = lambda name: [c.split()[0] for c in TABLES[name].split(", ")]
    return {name: df.select(*columns(name)) for name, df in tables.items()} | {"store_metadata": spark.read.schema(TABLES["store_metadata"]).parquet(f"{root}/store_metadata")}


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """source_name, source_sha256, fault of the artifacts that ingests have turned away, each content once."""
    return spark.read.schema(f"{REJECTED}, ingest string").parquet(f"{root}/rejected").drop("ingest").dropDuplicates(["source_sha256"])


def info(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name and row_count of every table."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in sorted(tables.items())]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def write_trace_jsonl(events: DataFrame, path: str) -> None:
    """One compact JSON object with sorted keys per event, in the order of trace and sequence."""
    columns = sorted(events.columns)
    events.sort("trace_id", "sequence").select(canonical_json(F.to_json(F.struct(*columns))).alias("value")).write.text(path)
