"""Votes over samples that keep arriving. An extension: batch results don't depend on it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotspark.functions.answers import extract_answer
from ballotspark.sources.schemas import SCHEMAS


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(id, text) of generation files that appear in a folder; each file is read once."""
    rows = spark.readStream.schema(SCHEMAS["generations"]).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(path)
    return rows.select("id", F.explode("outputs").alias("text"))


def running_votes(samples: DataFrame) -> DataFrame:
    """(id, ans, n): votes so far. Write in update mode; the checkpoint makes a restart resume without counting twice."""
    return samples.select("id", extract_answer(F.col("text")).alias("ans")).groupBy("id", "ans").agg(F.count("*").alias("n"))
