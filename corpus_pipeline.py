"""From `documents` to training ids: quality, line dedup, near duplicates, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a table; `run` writes it to the shared folder and reads it again as
the next stage's docs. All but the last return the columns of documents. Before a stage, and between what it writes itself
and its result, executors and their Python workers give back what they don't need; the last stage also does so between
the words' encoding and the texts'.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotspark.llm import decontamination, jaccard_rtree, line_dedup, quality_mil, sentencepiece_lattice
from ballotspark.llm.queries import vocabulary_file
from ballotspark.llm.storage import give_back_heaps, written
from ballotspark.llm.tables import table


def relieved(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heaps(spark)
        out = stage(spark, docs, sf_dir)
        give_back_heaps(spark)
        return out

    return run


@relieved
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go."""
    return quality_mil.accepted(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")), 0.3)


@relieved
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key 10 documents or more hold go from every text; n_chars follows."""
    out = line_dedup.dedup(docs, line_dedup.build(docs, min_docs=10, min_chars=1))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@relieved
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles, the first by id stays."""
    return jaccard_rtree.one_of_each(docs, size=5, percent=80)


@relieved
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 10 consecutive words of a benchmark item (or a shorter item) go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


@relieved
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each remaining document, and text, what these ids decode to."""
    out = sentencepiece_lattice.encode(docs, vocabulary_file(), chunk_bytes=4 << 20, with_text=True, between=lambda: give_back_heaps(spark))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("sentencepiece", pieces)]

#: The classifier's scores can't be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
