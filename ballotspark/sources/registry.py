"""Public data sets of worked solutions, and which of their columns are a problem and its solution."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DataSet(NamedTuple):
    repo: str
    split: str
    license: str
    question: str
    solution: str


#: Where each set comes from, its license and its columns.
SETS = {
    "orca": DataSet("microsoft/orca-math-word-problems-200k", "train", "MIT", "question", "answer"),
    "omi2": DataSet("nvidia/OpenMathInstruct-2", "train_1M", "CC-BY-4.0", "problem", "generated_solution"),
    "numina": DataSet("AI-MO/NuminaMath-1.5", "train", "Apache-2.0", "problem", "solution"),
}


def registered(df: DataFrame, key: str) -> DataFrame:
    """(src, question, solution) of a set's rows, which were read from wherever they are kept."""
    known = SETS[key]
    return df.select(F.lit(key).alias("src"), F.col(f"`{known.question}`").cast("string").alias("question"), F.col(f"`{known.solution}`").cast("string").alias("solution"))


def sources(spark) -> DataFrame:
    """(key, repo, license) of all sets, for a manifest."""
    return spark.createDataFrame([(k, s.repo, s.license) for k, s in SETS.items()], "key string, repo string, license string")
