"""Content addressing: manifests of trees and releases, and their checks."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import canonical_json, value_at


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, size, sha256 of the files under a folder that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def compare(sealed: DataFrame, found: DataFrame) -> DataFrame:
    """path, fault of a manifest (path, size, sha256) against another: missing, unexpected, size or digest. Empty if they agree."""
    a, b = sealed.select("path", F.col("size").alias("size_a"), F.col("sha256").alias("sha_a")), found.select("path", F.col("size").alias("size_b"), F.col("sha256").alias("sha_b"))
    fault = F.when(F.col("sha_b").isNull(), "missing").when(F.col("sha_a").isNull(), "unexpected").when(F.col("size_a") != F.col("size_b"), "size").when(F.col("sha_a") != F.col("sha_b"), "digest")
    return a.join(b, "path", "full_outer").select("path", fault.alias("fault")).where("fault is not null")


def manifest_faults(entries: DataFrame) -> DataFrame:
    """path, fault inside a manifest (path, kind file or directory, size, sha256): repeated paths, a parent that is a file, one digest with two sizes."""
    twice = entries.groupBy("path").count().where("count > 1").select("path", F.lit("repeated").alias("fault"))
    parents = entries.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("parent")).where("parent <> path")
    under = parents.join(entries.where("kind = 'file'").select(F.col("path").alias("parent")), "parent", "left_semi").select("path", F.lit("parent is a file").alias("fault")).distinct()
    sizes = entries.where("sha256 is not null").groupBy("sha256").agg(F.count_distinct("size").alias("sizes")).where("sizes > 1")
    unequal = entries.join(sizes, "sha256", "left_semi").select("path", F.lit("one digest, two sizes").alias("fault"))
    return twice.unionByName(under).unionByName(unequal)


def total_faults(entries: DataFrame, claimed: DataFrame, *by: str) -> DataFrame:
    """Trees (by, total_bytes as claimed) whose entries' sizes make another total, and entries listed (position) out of the order of their paths: by, fault."""
    summed = claimed.join(entries.groupBy(*by).agg(F.sum("size").alias("found")), list(by), "left").where(~F.coalesce("found", F.lit(0)).eqNullSafe(F.col("total_bytes"))).select(*by, F.lit("total").alias("fault"))
    return summed.unionByName(out_of_order(entries, "path", "position", *by).select(*by, F.lit("order").alias("fault")).distinct())


def tree_totals(entries: DataFrame, *by: str) -> DataFrame:
    return entries.groupBy(*by).agg(F.count("*").alias("files"), F.sum("size").alias("total_bytes"), F.count_distinct("sha256").alias("distinct_contents"))


def entry_digest(path: Column, size: Column, sha256: Column, *more: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", path, size.cast("string"), sha256, *(m.cast("string") for m in more)), 256)


def joined_digest(order: str, *parts: str) -> Column:
    """Of a group's rows in an order: the digest of their parts, one after the other."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.concat(*parts).alias("of")))), lambda x: x["of"]), ""), 256)


def tree_nodes(entries: DataFrame, *by: str, depth: int = 3) -> DataFrame:
    """The nodes (prefix, digest, entries) of each tree's Merkle tree over its entries (path, size, sha256, and executable where there is one): a leaf holds the entries whose path's digest begins with `depth` hexadecimal digits, in the order of their paths, and a node above holds the up to 16 nodes of one digit more; the root's prefix is empty.

    No group is larger than a leaf, and 16 times as many entries need one digit more; a changed entry changes `depth` + 1 nodes."""
    flag = [F.col("executable")] if "executable" in entries.columns else []
    e = entries.select(*by, "path", F.left(F.sha2("path", 256), F.lit(depth)).alias("prefix"), entry_digest(F.col("path"), F.col("size"), F.col("sha256"), *flag).alias("digest"))
    level = e.groupBy(*by, "prefix").agg(joined_digest("path", "digest").alias("digest"), F.count("*").alias("entries"))
    nodes = level
    for digits in range(depth - 1, -1, -1):
        level = level.groupBy(*by, F.left("prefix", F.lit(digits)).alias("above")).agg(joined_digest("prefix", "prefix", "digest").alias("digest"), F.sum("entries").alias("entries")).withColumnRenamed("above", "prefix")
        nodes = nodes.unionByName(level)
    return nodes


def tree_digest(entries: DataFrame, *by: str, depth: int = 3) -> DataFrame:
    """The digest of each tree, of any size: the root of tree_nodes()."""
    return tree_nodes(entries, *by, depth=depth).where("prefix = ''").select(*by, F.col("digest").alias("tree_sha256"))


def changed_nodes(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """Nodes (of tree_nodes) that only one side has or whose digests differ: what has to be sent or hashed again."""
    a, b = before.select(*by, "prefix", F.col("digest").alias("was")), after.select(*by, "prefix", F.col("digest").alias("now"))
    return a.join(b, [*by, "prefix"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


def leaf_proofs(entries: DataFrame, nodes: DataFrame, *by: str, depth: int = 3) -> DataFrame:
    """Whether entries, given as whole leaves, are what the stored nodes hold: leaf, ok, and steps, the node of each level above with the siblings that it is the digest of. Only the nodes on the way up are read, not the tree's other entries."""
    leaf = tree_nodes(entries, *by, depth=depth).where(F.length("prefix") == depth).select(*by, F.col("prefix").alias("leaf"), "digest")
    up = leaf.select(*by, "leaf", "digest", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")).withColumn("above", F.left("leaf", F.col("level")))
    children = nodes.where("prefix <> ''").select(*by, F.left("prefix", F.length("prefix") - 1).alias("above"), F.col("prefix").alias("child"), F.col("digest").alias("held"))
    met = up.join(children, [*by, "above"]).groupBy(*by, "leaf", "digest", "level", "above").agg(F.array_sort(F.collect_list(F.struct("child", "held"))).alias("siblings"))
    made = met.withColumn("made", F.sha2(F.array_join(F.transform("siblings", lambda x: F.concat(x["child"], x["held"])), ""), 256))
    sealed = nodes.select(*by, F.col("prefix").alias("above"), F.col("digest").alias("sealed"))
    own = F.exists("siblings", lambda x: (F.length(x["child"]) < depth) | ((x["child"] == F.col("leaf")) & (x["held"] == F.col("digest"))))
    return made.join(sealed, [*by, "above"]).groupBy(*by, "leaf").agg(F.bool_and((F.col("made") == F.col("sealed")) & own).alias("ok"), F.array_sort(F.collect_list(F.struct("level", "above", "sealed", "siblings"))).alias("steps"))


def artifact_faults(artifacts: DataFrame, oracles: DataFrame) -> DataFrame:
    """artifact_id, failed of each artifact (artifact_id, size, sha256) against its oracle (artifact_id, min_bytes, max_bytes, sha256, present): the predicates that do not hold; a mutated oracle should give some."""
    o = oracles.select("artifact_id", "min_bytes", "max_bytes", F.col("sha256").alias("expected"), "present")
    met = o.join(artifacts.select("artifact_id", "size", "sha256"), "artifact_id", "left")
    there = F.col("size").isNotNull()
    failed = F.array_compact(F.array(
        F.when(F.col("present") != there, "presence"), F.when(there & (F.col("size") < F.col("min_bytes")), "min_bytes"), F.when(there & (F.col("size") > F.col("max_bytes")), "max_bytes"), F.when(there & F.col("expected").isNotNull() & (F.col("sha256") != F.col("expected")), "sha256"),
    ))
    return met.select("artifact_id", failed.alias("failed"))


def oracle_results(oracles: DataFrame, files: DataFrame) -> DataFrame:
    """oracle_id, passed, error of oracles over files (path, content binary). An oracle has a kind (file, json or artifact), a path and, by kind: mode exists, absent, text_equals, text_contains or sha256 with an expected text; mode exists, absent or equals with a pointer and an expected JSON text; sha256, min_bytes and max_bytes."""
    there = F.col("content").isNotNull()
    text, digest = F.try_validate_utf8(F.col("content").cast("string")), F.sha2("content", 256)
    met = oracles.join(files.select("path", "content"), "path", "left").withColumn("text", text)
    met = met.withColumn("at", value_at("text", F.coalesce("pointer", F.lit("")))).withColumn("wanted", canonical_json("expected"))
    size = F.octet_length("content")
    mode, kind, expected = F.col("mode"), F.col("kind"), F.col("expected")
    error = F.when(mode.isin("exists", "absent") & (kind == "file"), None).when(~there, "file does not exist").when((kind == "file") & mode.startswith("text") & F.col("text").isNull(), "not UTF-8").when((kind == "json") & canonical_json("text").isNull(), "no JSON document")
    passed = (
        F.when(kind == "file", F.when(mode == "exists", there).when(mode == "absent", ~there).when(mode == "text_equals", F.col("text") == expected).when(mode == "text_contains", F.contains("text", expected)).otherwise(digest == expected))
        .when(kind == "json", F.when(mode == "exists", F.col("at.found")).when(mode == "absent", ~F.col("at.found")).otherwise(F.col("at.found") & (F.col("at.value") == F.col("wanted"))))
        .otherwise((F.col("sha256").isNull() | (digest == F.col("sha256"))) & (F.col("min_bytes").isNull() | (size >= F.col("min_bytes"))) & (F.col("max_bytes").isNull() | (size <= F.col("max_bytes"))))
    )
    return met.select("oracle_id", (error.isNull() & F.coalesce(passed, F.lit(False))).alias("passed"), error.alias("error"))


def mutated(oracles: DataFrame) -> DataFrame:
    """Oracles of oracle_results(), each changed so that a sound check must fail: presence turned round, a digest that no content has, or a value that holds the expected one."""
    presence, digest = F.col("mode").isin("exists", "absent"), F.lit("0" * 64)
    other = lambda c: F.when(c.eqNullSafe(digest), F.lit("1" * 64)).otherwise(digest)
    mode = F.when(presence, F.when(F.col("mode") == "exists", "absent").otherwise("exists")).when(F.col("kind") == "file", "sha256").otherwise(F.col("mode"))
    wrapped = F.concat(F.lit('{"__mutation__":'), F.coalesce("expected", F.lit("null")), F.lit("}"))
    expected = F.when(presence, None).when(F.col("kind") == "file", F.when(F.col("mode") == "sha256", other(F.col("expected"))).otherwise(digest)).when(F.col("kind") == "json", wrapped)
    return oracles.withColumns({"mode": mode, "expected": expected, "sha256": F.when(F.col("kind") == "artifact", other(F.col("sha256")))})


def mutate(oracles: DataFrame, operator: str) -> DataFrame:
    """Oracles changed so that a sound check must fail: invert_presence or digest_mismatch."""
    if operator == "invert_presence":
        return oracles.withColumn("present", ~F.col("present"))
    if operator == "digest_mismatch":
        return oracles.withColumn("sha256", F.sha2(F.concat(F.coalesce("sha256", F.lit("")), F.lit("mutated")), 256))
    raise ValueError(f"unknown mutation: {operator}")


def out_of_order(rows: DataFrame, column: str, order: str, *by: str) -> DataFrame:
    """Rows whose value lies before that of the row before them: timestamps that fall, paths that are not sorted."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("before", F.lag(column).over(w)).where(F.col(column) < F.col("before"))


def gaps(rows: DataFrame, sequence: str, *by: str) -> DataFrame:
    """Groups whose numbers are not 0, 1, 2 and so on, each once."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(sequence).alias("d"), F.min(sequence).alias("lo"), F.max(sequence).alias("hi")).where("lo <> 0 or hi <> n - 1 or d <> n").select(*by, "n")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one of spark.checkpoint.dir, or one of our own where that is unset and they are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return folder.rstrip("/")


_own: dict[str, str] = {}


def written_out(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here, and the size of what follows is estimated from files (estimates of repeated joins of checkpoints grow to numbers of a million digits)."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of written_out() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes of workflows (workflow, node, needs) that lie on a cycle or wait for one: what is left when nodes that need nothing are taken away again and again.

    In each round, nodes that need exactly one other are followed to where such steps lead, which takes as many joins as the longest row of them has bits; then edges go straight there, and edges to what needs nothing go. So a chain of any length is one round, and rounds are as many as branchings lie one under another. Each step is written out, and the one before it deleted; a null node or need is none."""
    left = written_out(edges.where("node is not null and needs is not null").select("workflow", "node", "needs").distinct())
    size = left.count()
    while size:
        single = written_out(left.groupBy("workflow", "node").agg(F.min("needs").alias("above"), F.count("*").alias("n")).where("n = 1").select("workflow", "node", "above"))
        reach, many = 1, single.count()
        while reach < many:
            further = single.select("workflow", F.col("node").alias("above"), F.col("above").alias("next"))
            last, single = single, written_out(single.join(further, ["workflow", "above"], "left").select("workflow", "node", F.coalesce("next", "above").alias("above")))
            forget(last)
            reach *= 2
        onward = single.select("workflow", F.col("node").alias("needs"), F.col("above").alias("next"))
        moved = left.join(onward, ["workflow", "needs"], "left").select("workflow", "node", F.coalesce("next", "needs").alias("needs")).distinct()
        last, left = left, written_out(moved.join(left.select("workflow", F.col("node").alias("needs")).distinct(), ["workflow", "needs"], "left_semi").select("workflow", "node", "needs"))
        forget(last, single)
        now = left.count()
        if now == size:  # all that is left needs something that is left
            break
        size = now
    return left.select("workflow", "node").distinct()


def span_depths(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, depth of spans under their roots, however deep; spans whose parent is missing are roots, a repeated span counts once, and spans of a cycle, or under one, have null depth. Each round doubles how far a span has looked up, so there are about as many rounds as the deepest depth has bits, each written out and the one before it deleted."""
    s = spans.groupBy("trace_id", "span_id").agg(F.min("parent_span_id").alias("parent"))
    known = s.select("trace_id", F.col("span_id").alias("parent"), F.lit(True).alias("there"))
    up = written_out(s.join(known, ["trace_id", "parent"], "left").select("trace_id", "span_id", F.when(F.col("there"), F.col("parent")).alias("above"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")))
    reach, size = 1, up.count()
    while reach <= size and not (waiting := up.where("above is not null")).isEmpty():
        higher = up.select("trace_id", F.col("span_id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        moved = waiting.join(higher, ["trace_id", "above"]).select("trace_id", "span_id", F.col("next").alias("above"), (F.col("depth") + F.col("more")).alias("depth"))
        last, up = up, written_out(up.where("above is null").unionByName(moved))
        forget(last)
        reach *= 2
    return up.select("trace_id", "span_id", F.when(F.col("above").isNull(), F.col("depth")).alias("depth"))


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with n, their place in their group (which no row lacks) from 0, as row_number() would count in the order (strict within a group). Rows are dealt by ranges of (group, order), so that a group is as many tasks as it needs; they are written out with their range, numbered in it, and the ranges before it added. The table is to be forgotten by the caller."""
    ranged = written_out(rows.repartitionByRange(group, *order).withColumn("range_", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "range_").agg(F.count("*").alias("rows_"))  # a row for each range, and group in it
    before = sizes.select(group, "range_", (F.sum("rows_").over(Window.partitionBy(group).orderBy("range_")) - F.col("rows_")).alias("before_"))
    placed = ranged.withColumn("place_", F.row_number().over(Window.partitionBy(group, "range_").orderBy(*order)))
    out = placed.join(F.broadcast(before), [group, "range_"]).withColumn("n", F.col("before_") + F.col("place_") - 1).drop("range_", "place_", "before_")
    out._written_to = ranged._written_to
    return out


#: Characters of lines that one row of chained_digest's stream holds, about.
BLOB = 1 << 18


def lines_packed(groups: int):
    """Function over sorted rows (by, key, line, tail) that packs a group's lines, with commas between, into rows of about `BLOB` characters: by, key (the first), number, entries, lines, tail (the smallest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, number = None, 0
        group, first, entries, lines, size, tail = None, None, 0, [], 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*group, first, number, entries, ",".join(lines) if lines else None, tail), schema, strict=True)], names=[f"c{i}" for i in range(len(schema))])

        for batch in batches:
            types = batch.schema.types
            schema = [*types[:groups], types[groups], pa.int64(), pa.int64(), pa.string(), pa.string()]
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if entries and (values[:groups] != group or size >= BLOB):
                    yield row()
                    number, entries, lines, size, tail = number + 1, 0, [], 0, None
                if not entries:
                    group, first = values[:groups], values[groups]
                entries += 1
                if values[-2] is not None:
                    lines.append(values[-2])
                    size += len(values[-2])
                if values[-1] is not None and (tail is None or values[-1] < tail):
                    tail = values[-1]
        if entries:
            yield row()

    return run


def lines_hashed(groups: int, head: str):
    """Function over sorted rows of lines_packed() that gives by, entries, sha256 of each group; what is held is one row and the state of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, group, entries, hashed, tail = None, None, 0, None, None

        def row() -> pa.RecordBatch:
            if hashed is not None:
                hashed.update((tail or "").encode())
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(group, types[:groups], strict=True)), pa.array([entries], pa.int64()), pa.array([hashed and hashed.hexdigest()], pa.string())], names=[f"c{i}" for i in range(groups + 2)])

        for batch in batches:
            types = batch.schema.types
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if values[:groups] != group:
                    if entries:
                        yield row()
                    group, entries, hashed, tail = values[:groups], 0, None, None
                more, lines, end = values[-3:]
                entries += more
                if lines is not None:
                    if hashed is None:
                        hashed = hashlib.sha256(head.encode())
                    else:
                        hashed.update(b",")
                    hashed.update(lines.encode())
                if end is not None and (tail is None or end < tail):
                    tail = end
        if entries:
            yield row()

    return run


def chained_digest(rows: DataFrame, by: tuple[str, ...], head: str, count: str, digest: str) -> DataFrame:
    """by, count, digest of rows (by, key, line, tail): of each group, whatever its size, the sha256 of head, its lines in the order of their keys with commas between, and its smallest tail; a null line counts but says nothing, a group of such alone has null.

    Rows are sorted by ranges, in as many tasks as they need, and packed; one task of a group reads what is packed in order, as a sha256 goes through its bytes one after another."""
    named = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = lambda *more: ", ".join([*(f"`{c}` {named[c]}" for c in by), *more])
    sorted_ = rows.select(*by, "key", "line", "tail").repartitionByRange(*by, "key").sortWithinPartitions(*by, "key", "line")
    packed = sorted_.mapInArrow(lines_packed(len(by)), shape(f"key {named['key']}", "number long", "entries long", "lines string", "tail string"))
    dealt = packed.repartition(*by).sortWithinPartitions(*by, "key", "number").drop("key", "number")
    return dealt.mapInArrow(lines_hashed(len(by), head), shape(f"`{count}` long", f"`{digest}` string"))


def listing_digest(entries: DataFrame, *by: str) -> DataFrame:
    """by, entries, listing_sha256: sha256 of each listing (path, size, sha256) of any size, in canonical JSON by path. The format itself takes listings of up to 100,000 entries."""
    json = F.concat(F.lit('{"path":'), F.to_json(F.array("path")).substr(F.lit(2), F.length(F.to_json(F.array("path"))) - 2), F.lit(',"sha256":"'), F.col("sha256"), F.lit('","size":'), F.col("size").cast("string"), F.lit("}"))
    return chained_digest(entries.select(*by, F.col("path").alias("key"), json.alias("line"), F.lit("]").alias("tail")), by, "[", "entries", "listing_sha256")
