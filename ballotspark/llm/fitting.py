"""Small numpy training tools that the two classifiers share."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotspark.llm.storage import written
from ballotspark.llm.tables import fold_of


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, most_bytes: int = 128 << 20) -> DataFrame:
    """(doc_id, text, y, lang) of at most `most` labelled rows outside the held-out fold, and of so many of these, in
    order of the hash, as have most_bytes of text together (one at least).

    The choice is by hash of the id, so it doesn't depend on the layout. Rows with a null id, label or text are left
    out; of repeated labels of an id the largest counts, of repeated documents the one whose text sorts first.
    The labels kept are at most `most` rows, so they are broadcast.
    """
    y = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold_of() != 0))
        .groupBy("doc_id").agg(F.max(column).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", lang.alias("lang")).join(F.broadcast(y), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "y", "r.text", "r.lang")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # numbers of at most `most` rows
    rows = written(rows.withColumn("size", F.octet_length("text")), "labelled")
    fits = rows.select(F.col("doc_id").alias("__id"), "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("upto")).where((F.col("upto") == 0) | (F.col("upto") + F.col("size") <= most_bytes))
    return rows.join(F.broadcast(fits.select("__id")), F.col("doc_id") == F.col("__id"), "left_semi").drop("size")


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """Probability that a positive scores above a negative; ties count half."""
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    _, first, same = np.unique(score[order], return_index=True, return_counts=True)
    ranks[order] = np.repeat(first + (same + 1) / 2, same)
    p = int(y.sum())
    return float((ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p)))
