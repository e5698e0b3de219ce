"""Sinks: JSON lines, CSV, one-row reports, manifests, checksums."""

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    """A chunk of results; the job's commit makes it whole or absent. Nulls are written."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, single: bool = True) -> None:
    """One file with a header, for submissions and reports, which are small; with single=False as many files as the
    table has partitions."""
    rows = df.orderBy(*order) if order else df
    (rows.coalesce(1) if single else rows).write.mode("overwrite").options(header=True, escape='"').csv(path)


def report(df: DataFrame) -> DataFrame:
    """The rows of a small report as one JSON document."""
    return df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    report(df).coalesce(1).write.mode("overwrite").text(path)


def manifest(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Provenance: what was kept of each source (key, repo, license, ..), also of those that gave nothing."""
    kept = rows.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("kept"))
    return sources.join(kept, "key", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


def checksums(spark: SparkSession, glob: str) -> DataFrame:
    """(file, sha256) of whole files."""
    return spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file of just this name, in any store that Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, removed when the process ends: in spark.checkpoint.dir, or where
    that is unset and everything is one process, in the local temp folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.gettempdir()
    path = f"{named}/scratch-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
