"""Picking one answer of many samples: votes, weighted votes, and votes fused with standardised scores.

Pools have a row for each sample: id, j (order within id), ans (null if none was read), and as needed text, trunc, logp
and score. Every rule gives (id, answer) for each id of the pool, null where no sample has an answer. Ties go to the
smallest answer, or with tie='first_seen' to the answer seen first. Weights are compared to nine decimals, so that the
order in which partitions are summed can't decide.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotspark.functions.answers import path_hash, sort_fields

def by_id():
    return Window.partitionBy("id")


def _order(votes: DataFrame, tie: str) -> list[Column]:
    if tie == "first_seen":
        return [F.col("first_j")]
    if tie != "answer_asc":
        raise ValueError(f"unknown tie rule {tie}")
    return sort_fields(F.col("ans")) if dict(votes.dtypes)["ans"] == "string" else [F.col("ans")]


def winners(votes: DataFrame, tie: str = "answer_asc") -> DataFrame:
    """(id, answer): of (id, ans, weight, first_j) the answer of most weight."""
    key = F.when(F.col("ans").isNotNull(), F.struct((-F.round("weight", 9)).alias("w"), *_order(votes, tie)))
    return votes.groupBy("id").agg(F.min_by("ans", key).alias("answer"))


def vote(rows: DataFrame, weight: Column | None = None, tie: str = "answer_asc") -> DataFrame:
    """weight is an aggregate over the samples of one answer; their number by default."""
    weight = F.count("*") if weight is None else weight
    return winners(rows.groupBy("id", "ans").agg(weight.cast("double").alias("weight"), F.min("j").alias("first_j")), tie)


def with_zscores(pool: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pool with columns {name: new name} standardised within the id, over all its samples; 0 for null, and where fewer
    than two have a value. The moments are partial sums joined back, so that a large id can be split between tasks."""
    moments = [(f(c).alias(f"__{k}_{n}")) for n, c in enumerate(columns) for k, f in (("mu", F.avg), ("sd", F.stddev_samp), ("m", F.count))]
    out = pool.join(pool.groupBy("id").agg(*moments), "id")
    for n, (c, name) in enumerate(columns.items()):
        z = (F.col(c) - F.col(f"__mu_{n}")) / F.when(F.col(f"__sd_{n}") > 0, F.col(f"__sd_{n}")).otherwise(1.0)
        out = out.withColumn(name, F.when(F.col(f"__m_{n}") < 2, 0.0).otherwise(F.coalesce(z, F.lit(0.0))))
    return out.drop(*(f"__{k}_{n}" for n in range(len(columns)) for k in ("mu", "sd", "m")))


def with_zscore(pool: DataFrame, column: str, out: str = "z") -> DataFrame:
    return with_zscores(pool, {column: out})


def with_upper_median(rows: DataFrame, value: Column, out: str, keys: list[str]) -> DataFrame:
    """rows with the element at n // 2 of the group's sorted values. Rows are counted by value before they move, so a
    window sees as many rows as a group has different values."""
    counts = rows.groupBy(*keys, value.alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v"))
    whole = F.sum("__c").over(Window.partitionBy(*keys))
    run = counts.withColumn("__upto", upto).withColumn("__n", whole).where(F.col("__upto") > F.floor(F.col("__n") / 2))
    return rows.join(run.groupBy(*keys).agg(F.min("__v").alias(out)), keys)


def without_truncated(pool: DataFrame) -> DataFrame:
    """Whole samples only; all of them where every sample of the id is cut."""
    whole = pool.groupBy("id").agg(F.bool_and(F.coalesce("trunc", F.lit(False))).alias("__all"))
    return pool.join(whole, "id").where("__all OR NOT coalesce(trunc, false)").drop("__all")


def one_per_path(pool: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The first sample of each chain of arithmetic steps, by partial aggregation."""
    first = pool.groupBy(*keys, path_hash(F.col("text")).alias("__path")).agg(F.min_by(F.struct(*pool.columns), "j").alias("__s"))
    return first.select("__s.*")


def majority(pool: DataFrame, tie: str = "answer_asc") -> DataFrame:
    return vote(pool, tie=tie)


def no_trunc(pool: DataFrame, tie: str = "answer_asc") -> DataFrame:
    return vote(without_truncated(pool), tie=tie)


def path_unique(pool: DataFrame, tie: str = "answer_asc") -> DataFrame:
    return vote(one_per_path(pool), tie=tie)


def median_length(pool: DataFrame, tie: str = "answer_asc") -> DataFrame:
    """Samples count more the nearer their length is to the id's (upper) median."""
    size = F.length("text")
    sized = with_upper_median(pool, size, "__med", ["id"]).withColumn("__med", F.greatest("__med", F.lit(1)))
    return vote(sized, F.sum(1 / (1 + F.abs(size - F.col("__med")) / F.col("__med"))), tie)


def short(pool: DataFrame, tie: str = "answer_asc") -> DataFrame:
    return vote(pool, F.sum(1 / (1 + F.length("text") / 1000)), tie)


def combined(pool: DataFrame, tie: str = "answer_asc") -> DataFrame:
    return median_length(one_per_path(without_truncated(pool)), tie)


def logp_soft(pool: DataFrame, tie: str = "answer_asc") -> DataFrame:
    """Votes weighted by exp(z) of the log-probability, z within -6 and 6; the plain vote where there is none."""
    clamped = F.greatest(F.least("z", F.lit(6.0)), F.lit(-6.0))
    return vote(with_zscore(pool, "logp"), F.sum(F.exp(clamped)), tie)


def logp_best(pool: DataFrame, tie: str = "answer_asc") -> DataFrame:
    """The answer of the single most probable sample; the plain vote where no sample has a log-probability."""
    scores = answer_scores(pool, "logp")
    return winners(scores.withColumn("weight", F.when(F.col("scored") > 0, F.col("max_z")).otherwise(F.col("n"))), tie)


#: Rules by name; a caller may add its own.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "majority": majority, "logp_soft": logp_soft, "logp_best": logp_best, "no_trunc": no_trunc,
    "path_unique": path_unique, "median_length": median_length, "short": short, "combined": combined,
}

#: From this weight on only the score counts (best of n).
PURE_SCORE = 1e8


def answer_scores(pool: DataFrame, score: str = "score") -> DataFrame:
    """(id, ans, n, mean_z, max_z, first_j, scored): each answer's votes, the mean and the largest of its samples' z, and
    how many samples of the id have a score.

    z as in `with_zscore`, but from sums by answer: samples are added up before they are moved, so an id with a third of all
    samples costs no more than one with a few. Means and squares are joined as in Chan's formula, without cancellation.
    """
    x = F.col(score)
    by = pool.groupBy("id", "ans").agg(
        F.count("*").alias("n"), F.count(x).alias("m"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("var"), F.max(x).alias("top"), F.min("j").alias("first_j"),
    )
    by = by.withColumn("all", F.sum("m").over(by_id())).withColumn("mu", F.try_divide(F.sum(F.col("m") * F.col("mean")).over(by_id()), F.col("all")))
    spread = F.sum(F.col("m") * (F.col("var") + F.pow(F.col("mean") - F.col("mu"), 2))).over(by_id())
    by = by.withColumn("sd", F.sqrt(spread / F.nullif(F.col("all") - 1, F.lit(0))))
    sd, some = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), (F.col("all") >= 2) & (F.col("m") > 0)
    mean_z = F.when(some, F.col("m") * (F.col("mean") - F.col("mu")) / sd / F.col("n")).otherwise(0.0)
    top = (F.col("top") - F.col("mu")) / sd
    max_z = F.when(some, F.when(F.col("n") > F.col("m"), F.greatest(top, F.lit(0.0))).otherwise(top)).otherwise(0.0)
    return by.select("id", "ans", "n", mean_z.alias("mean_z"), max_z.alias("max_z"), "first_j", F.col("all").alias("scored"))


def fused_weight(gamma: Column | float, how: str) -> Column:
    """ln(votes) + gamma * mean or max of z; from PURE_SCORE on the largest z alone."""
    gamma = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    return F.when(gamma >= PURE_SCORE, F.col("max_z")).otherwise(F.log("n") + gamma * F.col("mean_z" if how == "mean" else "max_z"))


def fused(pool: DataFrame, gamma: float = 0.5, how: str = "mean", tie: str = "answer_asc", score: str = "score") -> DataFrame:
    """z of the score is over the whole pool of an id, samples without an answer too."""
    return winners(answer_scores(pool, score).withColumn("weight", fused_weight(gamma, how)), tie)


def best_of_n(pool: DataFrame, how: str = "max", score: str = "score") -> DataFrame:
    """The answer whose best (or with how='mean' whose average) sample scores highest."""
    return winners(answer_scores(pool, score).withColumn("weight", F.col("max_z" if how == "max" else "mean_z")))


def submission(pool: DataFrame, ids: DataFrame, gamma: float = 0.5, how: str = "mean", fallback: DataFrame | None = None, tie: str = "answer_asc") -> DataFrame:
    """(id, answer, fallback, unanimous, flipped) for every id of ids: the fused answer; where no sample has one, the
    fallback table's (id, answer), or 0."""
    plain = majority(pool, tie).withColumnRenamed("answer", "plain")
    best = fused(pool, gamma, how, tie).withColumnRenamed("answer", "best")
    kinds = pool.groupBy("id").agg(F.count_distinct("ans").alias("kinds"))
    out = ids.select("id").join(plain, "id", "left").join(best, "id", "left").join(kinds, "id", "left")
    spare = F.lit(0)
    if fallback is not None:
        out, spare = out.join(fallback.select("id", F.col("answer").alias("__spare")), "id", "left"), F.coalesce("__spare", F.lit(0))
    return out.select("id", F.coalesce("best", spare).alias("answer"), F.col("best").isNull().alias("fallback"), (F.coalesce("kinds", F.lit(0)) == 1).alias("unanimous"), F.coalesce(F.col("best") != F.col("plain"), F.lit(False)).alias("flipped"))
