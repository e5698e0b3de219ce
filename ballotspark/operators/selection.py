"""Choosing samples: representatives, samples near the median, balanced and stratified samples, quotas."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotspark.functions.answers import early_answer, has_latex
from ballotspark.operators.metrics import drawn, drawn_number
from ballotspark.operators.voting import one_per_path, with_upper_median
from ballotspark.sources.readers import numbered

MIN_CHARS = 100


def quota(n_solved: Column, k: Column | int) -> Column:
    """How many solutions a problem gives: fewer the easier it is, judged by the rate of correct samples."""
    rate = n_solved / (k if isinstance(k, Column) else F.lit(k))
    return F.when(n_solved == 0, 0).when(rate >= 0.5, 1).when(rate >= 0.25, 2).otherwise(F.least(n_solved, F.lit(4))).cast("int")


def difficulty(n_solved: Column, k: Column | int) -> Column:
    rate = n_solved / (k if isinstance(k, Column) else F.lit(k))
    return F.when(n_solved == 0, "unsolved").when(rate < 0.25, "hard").when(rate < 0.5, "medium").otherwise("easy")


def solved_bucket(n_solved: Column) -> Column:
    """By count of correct samples."""
    return F.when(n_solved == 0, "unsolved").when(n_solved <= 3, "hard").when(n_solved <= 7, "medium").otherwise("easy")


def near_median(rows: DataFrame, keep: Column, keys: list[str]) -> DataFrame:
    """Of each group the `keep` texts nearest to the (upper) median length, after texts with the same steps have been
    reduced to the first by j. Ties go to the first."""
    once = one_per_path(rows.withColumn("__keep", keep), tuple(keys))
    sized = with_upper_median(once, F.length("text"), "__med", keys)
    order = Window.partitionBy(*keys).orderBy(F.abs(F.length("text") - F.col("__med")), "j")
    return sized.withColumn("__rn", F.row_number().over(order)).where("__rn <= __keep").drop("__rn", "__med", "__keep")


def rejection_sample(pool: DataFrame, gold: DataFrame, k: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, j, text, gold): correct samples for training. Short texts and those that have a long answer early on go;
    how many a problem gives follows from its rate of correct samples, which counts all of them."""
    rows = pool.join(gold, "id").withColumn("hit", F.coalesce(F.col("ans") == F.col("gold"), F.lit(False)).cast("int"))
    rows = rows.join(rows.groupBy("id").agg(F.sum("hit").alias("n_solved")), "id")
    good = rows.where((F.col("hit") == 1) & (F.length("text") >= min_chars) & ~early_answer(F.col("text"), F.col("gold").cast("string")))
    return near_median(good, quota(F.col("n_solved"), k), ["id"]).select("id", "j", "text", "gold")


def negatives(pool: DataFrame, gold: DataFrame) -> DataFrame:
    return pool.join(gold, "id").where(~F.coalesce(F.col("ans") == F.col("gold"), F.lit(False))).select("id", "j", "text")


def median_outward(rows: DataFrame, most: int, min_chars: int = 0, max_chars: int = 1 << 30) -> DataFrame:
    """Of each id up to `most` texts: sorted by length (then j), from the middle upwards, then from the shortest."""
    fit = rows.where(F.length("text").between(min_chars, max_chars))
    ids = Window.partitionBy("id")
    n, rn = F.count("*").over(ids), F.row_number().over(ids.orderBy(F.length("text"), "j")) - 1
    return fit.withColumn("__n", n).withColumn("__rn", rn).where(F.pmod(F.col("__rn") - F.floor(F.col("__n") / 2), F.col("__n")) < most).drop("__n", "__rn")


def round_robin(pool: DataFrame, n: int) -> DataFrame:
    """(id, j, ans, place): n representatives of each id, taking in turn one sample of each answer, larger groups first
    (then the group seen first). Samples without an answer are a group."""
    group = Window.partitionBy("id", "ans")
    rows = pool.withColumn("__r", F.row_number().over(group.orderBy("j"))).withColumn("__size", F.count("*").over(group)).withColumn("__first", F.min("j").over(group))
    order = Window.partitionBy("id").orderBy("__r", F.desc("__size"), "__first")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("id", "j", "ans", "place")


def balanced_pairs(pool: DataFrame, gold: DataFrame, wrong_majority: DataFrame, per_side: int = 3, min_chars: int = MIN_CHARS, suspects: DataFrame | None = None, seed: str = "42") -> DataFrame:
    """(id, j, text, label, maj_wrong): of ids with right and wrong samples equally many of both, `per_side` at most.

    Truncated, short and unread samples don't count. wrong_majority is (id, maj_wrong). Ids of `suspects` are left out.
    """
    rows = pool.join(gold, "id").where(~F.coalesce("trunc", F.lit(False)) & (F.length("text") >= min_chars) & F.col("ans").isNotNull())
    if suspects is not None:
        rows = rows.join(suspects.select("id").distinct(), "id", "left_anti")
    rows = rows.withColumn("label", (F.col("ans") == F.col("gold")).cast("int"))
    ids = Window.partitionBy("id")
    pos, neg = F.sum("label").over(ids), F.sum(1 - F.col("label")).over(ids)
    rank = F.row_number().over(Window.partitionBy("id", "label").orderBy(drawn(seed, F.col("id"), F.col("j")), "j"))
    picked = rows.withColumn("__m", F.least(pos, neg, F.lit(per_side))).withColumn("__rn", rank).where("__rn <= __m")
    return picked.join(wrong_majority, "id", "left").select("id", "j", "text", "label", F.coalesce("maj_wrong", F.lit(False)).alias("maj_wrong"))


def per_bucket(rows: DataFrame, bucket: str, limit: int, seed: str = "42") -> DataFrame:
    """Up to `limit` rows of each bucket, in a reproducible random order."""
    order = Window.partitionBy(bucket).orderBy(drawn(seed, F.col("id")), "id")
    return rows.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= limit).drop("__rn")


def shard(rows: DataFrame, i: int, n: int, seed: str = "42") -> DataFrame:
    """Part i of n: every n-th row of the reproducible random order, so parts differ by one row at most. Rows are
    numbered by partition, no task sees all."""
    order = numbered(rows.withColumn("__k", drawn(seed, F.col("id"))), "__at", ["__k", "id"])
    return order.where(F.col("__at") % n == i).drop("__k", "__at")


def draw(rows: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """n rows in a reproducible random order by id."""
    return rows.withColumn("__k", drawn(seed, F.col("id"))).orderBy("__k", "id").limit(n).drop("__k")


def thinned(rows: DataFrame, keep: float, seed: str = "42") -> DataFrame:
    """rows (id, .., n_solved) where easy problems stay with probability `keep`. Easy is a rate of a half or more,
    against the largest count seen."""
    most = rows.agg(F.max("n_solved").alias("__most"))
    uniform = drawn_number(F.lit(1 << 30), seed, F.col("id")) / float(1 << 30)
    easy = F.coalesce(F.col("n_solved") / F.col("__most") >= 0.5, F.lit(False))
    return rows.crossJoin(F.broadcast(most)).where(~easy | (uniform < keep)).drop("__most")


def stratified_split(docs: DataFrame, n_val: int, seed: str = "42") -> DataFrame:
    """(id, stratum, part): exactly n_val rows of `val`, in proportion to four length quartiles x LaTeX; the rest is `train`.

    Quartile edges are interpolated and closed to the right; equal edges are one. Shares are rounded half to even; what
    is missing or too much is settled in the random order over all.
    """
    sized = docs.select("id", F.length("question").alias("size"), has_latex(F.col("question")).cast("int").alias("tex"))
    edges = sized.agg(F.percentile("size", F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75)))).alias("e"), F.min("size").alias("low"), F.count("*").alias("total"))
    inner = F.array_distinct(F.filter("e", lambda x: x > F.col("low")))
    rows = sized.crossJoin(F.broadcast(edges)).withColumn("stratum", F.concat_ws("_", F.size(F.filter(inner, lambda x: x < F.col("size"))), "tex"))
    counts = rows.groupBy("stratum").agg(F.count("*").alias("n_s"), F.first("total").alias("t")).withColumn("k", F.least(F.bround(n_val * F.col("n_s") / F.col("t")).cast("long"), "n_s"))
    order = drawn(seed, F.col("id"))
    ranked = rows.join(F.broadcast(counts.select("stratum", "k")), "stratum").withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy(order, "id")))
    # chosen first, then the others; the first n_val of all in the random order within these two
    near = ranked.withColumn("chosen", F.col("r") <= F.col("k")).withColumn("h", order)
    val = near.orderBy(F.desc("chosen"), "h", "id").limit(n_val).select(F.col("id").alias("__val"))
    return rows.join(val, F.col("id").eqNullSafe(F.col("__val")), "left").select("id", "stratum", F.when(F.col("__val").isNotNull(), "val").otherwise("train").alias("part"))


def only_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in a list."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def with_question(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """rows with their problem's question, '' where there is none."""
    known = problems.select("id", F.col("question").alias("__q")).groupBy("id").agg(F.max("__q").alias("__q"))
    return rows.join(known, "id", "left").withColumn("question", F.coalesce("__q", F.lit(""))).drop("__q")


def with_adopted(rows: DataFrame, adopted: DataFrame) -> DataFrame:
    """Training rows and those adopted from quarantine, in columns by name; a column that one side lacks is null."""
    return rows.unionByName(adopted, allowMissingColumns=True)


def repeated_correct(pool: DataFrame, gold: DataFrame, least: int = 2) -> DataFrame:
    """Correct samples of the ids that have `least` of them or more."""
    good = pool.join(gold, "id").where("ans = gold")
    return good.join(good.groupBy("id").count().where(F.col("count") >= least).select("id"), "id", "left_semi")


def parsed_plan(text: str, buckets: tuple[str, ...] = ("unsolved", "hard", "medium", "easy")) -> dict[str, int]:
    """'hard:8,easy:2' as {'hard': 8, 'easy': 2}; a bucket that isn't known is an error."""
    out = {}
    for part in filter(None, map(str.strip, text.split(","))):
        name, _, count = part.partition(":")
        if name.strip() not in buckets:
            raise ValueError(f"unknown bucket {name.strip()!r}")
        out[name.strip()] = int(count)
    return out


def parsed_shard(text: str) -> tuple[int, int]:
    """'1/4' as (1, 4)."""
    i, n = (int(x) for x in text.split("/"))
    if not 0 <= i < n:
        raise ValueError(f"no part {i} of {n}")
    return i, n


def parsed_list(text: str) -> list[str]:
    """Comma-separated names, without blanks and empty ones."""
    return [x.strip() for x in text.split(",") if x.strip()]
