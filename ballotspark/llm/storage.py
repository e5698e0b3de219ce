"""Tables written to the folder that driver and executors share.

`spark.checkpoint.dir` names that folder; only where the session has none and runs in one process (tests, notebooks)
one is made under the local temp folder. A written table cuts lineage: a lost executor costs a re-read, not a
recomputation. Tables and their catalog entries are removed when the Python process ends, or earlier by `drop`.
"""

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Buckets of a table; Spark takes 100,000 at most.
MOST_BUCKETS = 1 << 14

#: Idle Python workers for each core that `give_back_heaps` reaches.
WORKERS = 4

_LOCAL: list[str] = []
_WRITTEN: dict[str, tuple[SparkSession, str | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="ballotspark-"))
    return f"file://{_LOCAL[0]}"


def _delete(path: str) -> None:
    spark, name = _WRITTEN.pop(path)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            _delete(path)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows of df, written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _WRITTEN[path] = spark, None
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int, compression: str = "zstd") -> DataFrame:
    """As `written`, dealt out by a key: grouping by it, or joining on it, moves only the other side. Beyond
    `MOST_BUCKETS` a bucket holds more, not fewer, rows."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{table}"
    df.write.option("compression", compression).option("path", path).bucketBy(max(1, min(buckets, MOST_BUCKETS)), key).saveAsTable(table)
    _WRITTEN[path] = spark, table
    out = spark.table(table)
    out._written_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table of `written` or `bucketed` that nothing reads any more."""
    path = getattr(df, "_written_path", None)
    if path in _WRITTEN:
        _delete(path)


def give_back() -> None:
    """Free memory to the system. A Python worker serves stages one after another, and what it keeps for itself counts
    beside the JVM and the workers of the next ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc's
        ctypes.CDLL(None).malloc_trim(0)


def _worker_gives_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    gc.collect()
    give_back()
    yield from ()


def give_back_heaps(spark: SparkSession) -> None:
    """Executors and their Python workers collect their garbage and give free memory to the system. A heap grows with
    what is thrown away, up to its limit, and else keeps that from stage to stage, beside the Python workers. One task
    for each core, for the workers some, as idle ones take turns: none is bound to an executor, so this is a relief and
    nothing relies on it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, WORKERS * n, 1, WORKERS * n).mapInArrow(_worker_gives_back, "id long").collect()
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()
