"""Judging labels by what models agree on, and reports on refinement and teachers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotspark.operators.voting import majority

#: Shares of agreement that a sweep tries.
THRESHOLDS = [1.0, 0.95, 0.9, 0.85, 0.75, 0.6, 0.5]


def agreement(pool: DataFrame, tie: str = "answer_asc") -> DataFrame:
    """(id, mode, votes, n): the answer most samples have; n counts those without an answer too."""
    n = pool.groupBy("id").agg(F.count("*").alias("n"))
    votes = pool.where(F.col("ans").isNotNull()).groupBy("id", "ans").count()
    return majority(pool, tie).join(n, "id").join(votes, "id", "left").where(F.col("answer").isNull() | (F.col("ans") == F.col("answer"))).select("id", F.col("answer").alias("mode"), F.coalesce("count", F.lit(0)).alias("votes"), "n")


def verdicts(pool: DataFrame, labels: DataFrame, threshold: float = 1.0, tie: str = "answer_asc") -> DataFrame:
    """(id, verdict, final): relabel where the agreed answer is the suggested one, keep where it is the current one, else
    drop. labels is (id, current, suggested), either may be null."""
    return _judged(agreement(pool, tie).join(labels, "id"), F.lit(threshold)).select("id", "verdict", "final")


def _judged(rows: DataFrame, threshold) -> DataFrame:
    agreed = F.when(F.col("votes") / F.col("n") >= threshold, F.col("mode"))
    out = rows.withColumn("verdict", F.when(agreed == F.col("suggested"), "relabel").when(agreed == F.col("current"), "keep").otherwise("drop"))
    return out.withColumn("final", F.when(F.col("verdict") != "drop", F.col("mode")))


def verdict_sweep(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """(threshold, relabel, keep, drop, rate)."""
    grid = pool.sparkSession.createDataFrame([(t,) for t in THRESHOLDS], "threshold double")
    rows = agreement(pool).join(labels, "id").crossJoin(F.broadcast(grid))  # seven thresholds
    n = lambda v: F.sum((F.col("verdict") == v).cast("long")).alias(v)
    out = _judged(rows, F.col("threshold")).groupBy("threshold").agg(n("relabel"), n("keep"), n("drop"))
    return out.withColumn("rate", F.round((F.col("relabel") + F.col("keep")) / (F.col("relabel") + F.col("keep") + F.col("drop")), 4))


def third_values(pool: DataFrame, labels: DataFrame) -> DataFrame:
    """How many ids have a most frequent answer that is neither label."""
    third = F.col("mode").isNotNull() & ~F.col("mode").eqNullSafe(F.col("suggested")) & ~F.col("mode").eqNullSafe(F.col("current"))
    return agreement(pool).join(labels, "id").agg(F.count("*").alias("n"), F.coalesce(F.sum(third.cast("long")), F.lit(0)).alias("third_value"))


def suspects(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, gold, model_unanimous): every sample has an answer, all the same, and it isn't the label."""
    each = pool.groupBy("id").agg(F.count("*").alias("n"), F.count("ans").alias("read"), F.count_distinct("ans").alias("kinds"), F.min("ans").alias("model_unanimous"))
    return each.join(gold, "id").where((F.col("n") == F.col("read")) & (F.col("kinds") == 1) & (F.col("model_unanimous") != F.col("gold"))).select("id", "gold", "model_unanimous")


def scope(pool: DataFrame, gold: DataFrame, which: str = "maj_wrong") -> DataFrame:
    """(id, gold, our_maj, dead): ids whose vote is wrong, or with which='dead' those without a correct sample."""
    dead = pool.join(gold, "id").groupBy("id").agg((F.max(F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).cast("int")) == 0).alias("dead"))
    rows = majority(pool).join(gold, "id").join(dead, "id").select("id", "gold", F.col("answer").alias("our_maj"), "dead")
    return rows.where("dead") if which == "dead" else rows.where(~F.col("our_maj").eqNullSafe(F.col("gold")))


def three_way(cases: DataFrame, teacher: DataFrame) -> DataFrame:
    """(verdict, n) of cases (id, gold, our_maj) against a teacher's samples (id, j, ans)."""
    rows = cases.join(majority(teacher).withColumnRenamed("answer", "teacher"), "id")
    verdict = F.when(F.col("teacher").isNull(), "teacher_unread").when(F.col("teacher") == F.col("gold"), "teacher_is_gold").when(F.col("teacher") == F.col("our_maj"), "teacher_is_ours").otherwise("undecided")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def refine_lift(original: DataFrame, refined: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over ids that both have: how often samples written anew solve what none had solved, and bring new answers."""
    hit = lambda: F.max(F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).cast("int"))
    o = original.join(gold, "id").groupBy("id").agg(hit().alias("before"), F.collect_set("ans").alias("seen"))
    per_id = refined.join(o, "id").join(gold, "id").join(majority(original).withColumnRenamed("answer", "maj"), "id")
    new = F.col("ans").isNotNull() & ~F.coalesce(F.array_contains("seen", F.col("ans")), F.lit(False))
    other = F.col("ans").isNotNull() & ~F.col("ans").eqNullSafe(F.col("maj"))
    each = per_id.groupBy("id").agg(F.max("before").alias("before"), hit().alias("after"), F.count("*").alias("n"), F.sum(new.cast("long")).alias("new"), F.sum(other.cast("long")).alias("other"))
    total = each.agg(
        F.count("*").alias("ids"), F.sum("before").alias("pass0"), F.sum(1 - F.col("before")).alias("dead"), F.sum((1 - F.col("before")) * F.col("after")).alias("rescued"),
        F.sum("n").alias("refined"), F.round(F.sum("new") / F.sum("n"), 6).alias("new_rate"), F.round(F.sum("other") / F.sum("n"), 6).alias("other_rate"),
    )
    return total.withColumn("union_pass", F.round((F.col("pass0") + F.col("rescued")) / F.col("ids"), 6))


def teacher_yield(pool: DataFrame, gold: DataFrame, buckets: DataFrame, min_repeat: int = 2) -> DataFrame:
    """(bucket, n, any_correct, repeated, median_chars): median_chars is the upper median length of correct samples."""
    rows = pool.join(gold, "id").join(buckets, "id").withColumn("hit", F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)))
    each = rows.groupBy("bucket", "id").agg(F.sum(F.col("hit").cast("long")).alias("ok"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum((F.col("ok") > 0).cast("long")).alias("any_correct"), F.sum((F.col("ok") >= min_repeat).cast("long")).alias("repeated"))
    sizes = rows.where("hit").groupBy("bucket", F.length("text").alias("size")).count()
    spread = F.array_sort(F.flatten(F.collect_list(F.expr("array_repeat(size, cast(count as int))"))))
    chars = sizes.groupBy("bucket").agg(F.element_at(spread, F.floor(F.size(spread) / 2).cast("int") + 1).alias("median_chars"))
    return counts.join(chars, "bucket", "left")


def repeat_histogram(pool: DataFrame, gold: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket, n_ok, ids)."""
    rows = pool.join(gold, "id").join(buckets, "id")
    return rows.groupBy("bucket", "id").agg(F.sum(F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).cast("long")).alias("n_ok")).groupBy("bucket", "n_ok").agg(F.count("*").alias("ids"))
