"""Scans: CSV, JSON lines, JSON maps, globs, logs. Paths are any that Spark can read."""

import json
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotspark.sources.schemas import SCHEMAS
from ballotspark.sources.sinks import scratch


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def latest(spark: SparkSession, glob: str) -> str | None:
    """The matching path that was changed last (of equal times the last by name), or None."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return max(((f.getModificationTime(), f.getPath().toString()) for f in found or []), default=(0, None))[1]


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """CSV with a header, columns by name, and line ends inside quotes. Columns that the file lacks are null."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    raw = spark.read.options(**options).csv(path)
    schema = T.StructType.fromDDL(SCHEMAS[table])
    return raw.select(*((F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its extension, else CSV with all columns as strings."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def read_first(spark: SparkSession, paths: list[str], table: str) -> DataFrame:
    """The first of the files that is there and can be read, with a warning for those that can't; without any, no rows
    of the same schema."""
    for path in paths:
        if exists(spark, path):
            try:
                df = read_csv(spark, path, table)
                df.head(1)
            except (AnalysisException, Py4JJavaError, PySparkException) as e:
                warnings.warn(f"{path} can't be read: {str(e).splitlines()[0]}", stacklevel=2)
                continue
            return df
    return spark.createDataFrame([], SCHEMAS[table])


def read_jsonl(spark: SparkSession, path: str, table: str, corrupt: str = "skip") -> DataFrame:
    """JSON lines. corrupt: skip (as for a file that is still being written), fail, or keep (in _corrupt_record)."""
    mode = {"skip": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}[corrupt]
    schema = SCHEMAS[table] + (", _corrupt_record STRING" if corrupt == "keep" else "")
    return spark.read.schema(schema).option("mode", mode).json(path)


def last_lines(spark: SparkSession, path: str, table: str) -> DataFrame:
    """JSON lines where the last line of an id counts. Lines of one file keep their order; files go by name."""
    schema = T.StructType.fromDDL(SCHEMAS[table])
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    parsed = lines.select(F.from_json("value", schema).alias("r"), "file", "line").where(F.col("r.id").isNotNull())
    return parsed.groupBy(F.col("r.id").alias("__id")).agg(F.max_by("r", F.struct("file", "line")).alias("r")).select("r.*")


def read_map(spark: SparkSession, path: str, value: str = "n_solved") -> DataFrame:
    """A JSON object {id: number} as (id, number)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "MAP<STRING,INT>")).alias("id", value))


#: The parts of a generation file's name.
ARM_NAME = r"gen_.*?_([ABC])_(chat|raw)_k(\d+)_t([\d.]+?)(?:_mt(\d+))?\.jsonl$"


def read_arms(spark: SparkSession, glob: str) -> DataFrame:
    """Generations of several files, with the arm that each file's name says (its stem, where the name has other parts).

    Two files of one arm are an error: pairs of their rows would be counted twice.
    """
    df = spark.read.schema(SCHEMAS["generations"]).option("mode", "DROPMALFORMED").json(glob).withColumn("file", F.col("_metadata.file_name"))
    part = lambda k: F.regexp_extract("file", ARM_NAME, k)
    name = F.concat(part(1), F.lit("-"), part(2), F.when(part(3) != "1", F.concat(F.lit("-k"), part(3))).otherwise(""), F.lit("-mt"), F.coalesce(F.nullif(part(5), F.lit("")), F.lit("1024?")))
    df = df.withColumn("arm", F.when(part(1) != "", name).otherwise(F.regexp_replace("file", r"\.jsonl$", "")))
    twice = [r["arm"] for r in df.groupBy("arm").agg(F.count_distinct("file").alias("n")).where("n > 1").orderBy("arm").collect()]
    if twice:
        raise ValueError(f"more than one file for {twice}")
    return df


def log_tail(spark: SparkSession, path: str, n: int, noise: str) -> DataFrame:
    """The last n lines that the pattern `noise` doesn't match, in order. Files go by name; a scan takes them by size, so
    a line's place is its file, where its piece of the file begins, and its number in the scan, which counts in a piece."""
    places = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")
    lines = spark.read.text(path).select("value", F.struct(*places).alias("line")).where(~F.col("value").rlike(noise))
    return lines.orderBy(F.desc("line")).limit(n).orderBy("line").select("line", "value")


def read_reports(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(report, path, value): every leaf of several report files; absent ones are left out."""
    rows = []
    for name, path in paths.items():
        if exists(spark, path):
            text = spark.read.text(path, wholetext=True).first()["value"]
            rows += [(name, p, v) for p, v in _leaves(json.loads(text), "")]
    return spark.createDataFrame(rows, "report STRING, path STRING, value STRING")


def _leaves(x, path: str):
    items = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
    if items is None:
        yield path, None if x is None else json.dumps(x, ensure_ascii=False) if not isinstance(x, str) else x
    else:
        for k, v in items:
            yield from _leaves(v, f"{path}.{k}" if path else str(k))


def numbered(df: DataFrame, name: str, order: str | list[str] | None = None) -> DataFrame:
    """df with a column that counts its rows from 0, in the order of columns or of the scan. Rows are counted by
    partition and only the partitions' offsets are added up, so nothing passes through one task.

    The placed rows are written to the scratch folder at once: a second run of the sort may cut its partitions at other
    rows, and offsets of one run don't fit the places of another.
    """
    placed = (df.sort(order) if order else df).withColumn("__row", F.monotonically_increasing_id())
    path = scratch(df.sparkSession, "numbered")
    placed.write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    part = F.shiftright("__row", 33)
    counts = rows.groupBy(part.alias("__part")).count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    out = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__before") + F.col("__row").bitwiseAND((1 << 33) - 1)).alias(name))


#: Other names of the columns, the first that a table has counts.
QUESTION_NAMES = ("question", "problem", "text", "query")
ID_NAMES = ("id", "idx", "index", "problem_id")
ANSWER_NAMES = ("answer", "gold", "label", "target")


def normalized_input(df: DataFrame, order: str | None = None) -> DataFrame:
    """(id, question, answer) of a table whose columns go by other names.

    Names are compared without case. Without an id, ids t-000000, t-000001, .. are made in the order of the column
    `order`, which the caller names as the source's order; without it they follow the scan. Without an answer it is null.
    """
    names = {c.lower(): c for c in df.columns}
    find = lambda *aliases: next((F.col(f"`{names[a]}`") for a in aliases if a in names), None)
    question, ident, answer = find(*QUESTION_NAMES), find(*ID_NAMES), find(*ANSWER_NAMES)
    if question is None:
        raise ValueError(f"no column for the question among {df.columns}")
    rows = df.select(*([F.col(order).alias("__order")] if order and ident is None else []), (F.lit(None) if ident is None else ident).cast("string").alias("id"), question.cast("string").alias("question"), (F.lit(None) if answer is None else answer).cast("string").alias("answer"))
    if ident is None:
        rows = numbered(rows, "__ordinal", "__order" if order else None).withColumn("id", F.format_string("t-%06d", "__ordinal"))
    return rows.select("id", "question", "answer")


def long_samples(generations: DataFrame, verifier: DataFrame | None = None) -> DataFrame:
    """(id, j, text, trunc, logp, orm) of parallel arrays, one row for each sample.

    Shorter arrays are filled with null, a missing trunc with false, and missing scores are null.
    """
    zipped = F.arrays_zip("outputs", F.coalesce("trunc", F.array().cast("array<boolean>")).alias("trunc"), F.coalesce("logp", F.array().cast("array<double>")).alias("logp"))
    size = F.size("outputs")
    out = generations.where(size > 0).select("id", size.alias("n"), F.posexplode(zipped).alias("j", "s")).where("j < n")
    out = out.select("id", "j", F.col("s.outputs").alias("text"), F.coalesce("s.trunc", F.lit(False)).alias("trunc"), F.col("s.logp").alias("logp"))
    if verifier is None:
        return out.withColumn("orm", F.lit(None).cast("double"))
    return out.join(verifier.select("id", F.posexplode("orm").alias("j", "orm")), ["id", "j"], "left")
