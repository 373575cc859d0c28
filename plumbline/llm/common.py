"""What the operators share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


_own: dict[str, str] = {}
#: The folders of tables made by store(), by the identity of the DataFrame as long as it lives.
_stored: dict[int, tuple[weakref.ref, str]] = {}


#: The folders that store() has made and nothing has deleted, by application.
_made: dict[str, set[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, one of our own, but only if driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return path


def store(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as a table in the shared folder, partitioned by columns if any are named, and read it back: lineage ends here and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _made.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    _stored[id(out)] = (weakref.ref(out, lambda _, key=id(out): _stored.pop(key, None)), path)
    return out


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system's scheme, as tasks need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def place_of(folder: str) -> tuple[fs.FileSystem, str]:
    """In a task: pyarrow's file system of a qualified folder (file, hdfs, s3, gs), and the folder in it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, stored with a number for each row, and that column's name. Scans may be split differently each time; what is stored stays the same."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    return store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by store() that nothing reads any more."""
    spark, root = df.sparkSession, _stored.pop(id(df), (None, None))[1]
    if root:
        remove(spark, root)
        _made.get(spark.sparkContext.applicationId, set()).discard(root)


def free(spark: SparkSession) -> int:
    """Delete every table that store() made in this application and that is still there; returns how many. To be called when the operators' results have been read or written: they read these tables as long as they are lazy."""
    folders = _made.pop(spark.sparkContext.applicationId, set())
    for folder in folders:
        remove(spark, folder)
    return len(folders)
