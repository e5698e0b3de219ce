"""Checks that a result must pass. Each gives rows of (check, severity, n): n is how many rows offend, or the figure."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotspark.functions.answers import submission_integer
from ballotspark.operators.metrics import drawn


def submission_check(sub: DataFrame, ref: DataFrame, zero_share: float = 0.03) -> DataFrame:
    """(check, severity, n) of a submission (id, answer as text) against the ids that are asked for.

    severity is error where n > 0 must not be, ok where it isn't, warn for signs of trouble, info for figures.
    """
    answer = F.col("answer").cast("string")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    facts = sub.agg(
        F.count("*").alias("rows"), n(answer.isNull()).alias("null_answer"), n(answer.isNotNull() & ~submission_integer(answer)).alias("not_integer"),
        n(answer.try_cast("double") == 0).alias("zero"), F.count_distinct("answer").alias("distinct_answers"), (F.count("*") - F.count_distinct(F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("repeated_id"),
    )
    missing = ref.select("id").distinct().join(sub.select("id"), "id", "left_anti").agg(F.count("*").alias("missing_id"))
    extra = sub.select("id").distinct().join(ref.select("id"), "id", "left_anti").agg(F.count("*").alias("extra_id"))
    size = ref.agg(F.count("*").alias("ref_rows"))
    one = reduce(lambda a, b: a.crossJoin(b), [missing, extra, size], facts).withColumn("row_count_gap", F.abs(F.col("rows") - F.col("ref_rows")))  # one row each
    kinds = {k: F.when(F.col(k) > 0, "error").otherwise("ok") for k in ("row_count_gap", "missing_id", "extra_id", "repeated_id", "null_answer", "not_integer")}
    kinds |= {"zero": F.when(F.col("zero") > F.col("rows") * zero_share, "warn").otherwise("ok"), "distinct_answers": F.lit("info")}
    rows = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("severity"), F.col(k).cast("long").alias("n")) for k, v in kinds.items()))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def submission_report(sub: DataFrame, ref: DataFrame, envelope: DataFrame | None = None, examples: int = 3, zero_share: float = 0.03) -> DataFrame:
    """(check, severity, n, examples): `submission_check`, and the columns, the first ids that are missing or too many,
    the first values that are no integer, the range of answers, and with an envelope of training answers whether there
    are far fewer different ones. sub may have any columns; n and examples are null where a check has none."""
    wanted = list(sub.columns) == ["id", "answer"]
    spark = sub.sparkSession
    columns = spark.createDataFrame([("columns", "ok" if wanted else "error", 0 if wanted else 1, "" if wanted else ",".join(sub.columns))], "check string, severity string, n long, examples string")
    names = {c.lower(): c for c in reversed(sub.columns)}
    if "id" not in names or "answer" not in names:
        return columns
    rows = sub.select(F.col(f"`{names['id']}`").alias("id"), F.col(f"`{names['answer']}`").cast("string").alias("answer"))
    first = lambda df, c: df.orderBy(c).limit(examples).agg(F.array_join(F.sort_array(F.collect_list(F.col(c).cast("string"))), ",").alias("examples"))
    bad = rows.where(F.col("answer").isNotNull() & ~submission_integer(F.col("answer"))).select("answer").distinct()
    sides = id_differences(rows, ref)
    shown = [("missing_id", first(sides.where("side = 'missing'"), "id")), ("extra_id", first(sides.where("side = 'extra'"), "id")), ("not_integer", first(bad, "answer"))]
    named = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check"), "examples") for name, df in shown])
    out = submission_check(rows, ref, zero_share).join(F.broadcast(named), "check", "left")
    whole = F.when(submission_integer(F.col("answer")), F.col("answer").try_cast("double").cast("decimal(38,0)"))
    low, high = rows.agg(F.min(whole).alias("low"), F.max(whole).alias("high")), F.concat_ws("..", F.col("low").cast("string"), F.col("high").cast("string"))
    out = columns.unionByName(out).unionByName(low.select(F.lit("range").alias("check"), F.lit("info").alias("severity"), F.lit(None).cast("long").alias("n"), high.alias("examples")))
    if envelope is not None:
        few = collapsed(rows, envelope)
        out = out.unionByName(few.select(F.lit("collapsed").alias("check"), F.when(F.col("collapsed"), "error").otherwise("ok").alias("severity"), F.col("kinds").alias("n"), F.concat_ws("..", F.col("least").cast("string"), F.col("most").cast("string")).alias("examples")))
    return out


def id_differences(sub: DataFrame, ref: DataFrame) -> DataFrame:
    """(side, id): ids that only the reference has (missing), or only the submission (extra)."""
    a, b = sub.select("id").distinct(), ref.select("id").distinct()
    return b.join(a, "id", "left_anti").select(F.lit("missing").alias("side"), "id").unionByName(a.join(b, "id", "left_anti").select(F.lit("extra").alias("side"), "id"))


def distinct_envelope(train: DataFrame, n: int, draws: int = 50, seed: str = "0") -> DataFrame:
    """(least, most) distinct answers among n training answers, over `draws` draws without replacement.

    A draw is the n rows of smallest hash. Hashes are even, so n of N rows are below n / N of their range; rows beyond
    that and ten standard deviations can't be among them and are left out before anything moves.
    """
    from pyspark.sql import Window

    total = max(train.count(), 1)
    share = min(1.0, (n + 10 * n**0.5 + 50) / total)
    key = drawn(seed, F.col("draw"), F.col("id"))
    each = train.select("id", "answer").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__k", key)
    near = each if share == 1 else each.where(F.col("__k") <= f"{int(share * 16**12):012x}" + "f" * 20)
    rank = F.row_number().over(Window.partitionBy("draw").orderBy("__k", "id"))
    return near.withColumn("__rn", rank).where(F.col("__rn") <= n).groupBy("draw").agg(F.count_distinct("answer").alias("kinds")).agg(F.min("kinds").alias("least"), F.max("kinds").alias("most"))


def collapsed(sub: DataFrame, envelope: DataFrame, share: float = 0.7) -> DataFrame:
    """Whether a submission has far fewer different answers than training answers would have."""
    return sub.agg(F.count_distinct("answer").alias("kinds")).crossJoin(envelope).select("kinds", "least", "most", (F.col("kinds") < F.col("least") * share).alias("collapsed"))


def reordered(sub: DataFrame, ref: DataFrame, order: str) -> DataFrame:
    """The reference's ids in its order, with 0 where the submission has no answer."""
    return ref.select("id", order).join(sub.select("id", "answer"), "id", "left").orderBy(order).select("id", F.coalesce("answer", F.lit(0)).alias("answer"))


def flips(sub: DataFrame, plain: DataFrame, most: float = 0.25) -> DataFrame:
    """(n, flips, accepted): answers that differ from the plain vote's; none at all, or more than a quarter, is refused."""
    rows = sub.select("id", F.col("answer").alias("a")).join(plain.select("id", F.col("answer").alias("b")), "id")
    out = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")), F.lit(0)).alias("flips"))
    return out.withColumn("accepted", (F.col("flips") > 0) & (F.col("flips") <= F.col("n") * most))


def row_counts(generated: DataFrame, asked: DataFrame) -> DataFrame:
    """Whether every input has its generation."""
    return generated.agg(F.count_distinct("id").alias("generated")).crossJoin(asked.agg(F.count_distinct("id").alias("asked"))).withColumn("complete", F.col("generated") == F.col("asked"))


def uncovered(needed: DataFrame, pool: DataFrame, examples: int = 3) -> DataFrame:
    """(n, examples): ids without rows in the pool, and the first of them."""
    missing = needed.select("id").distinct().join(pool.select("id").distinct(), "id", "left_anti")
    first = missing.orderBy("id").limit(examples).agg(F.sort_array(F.collect_list("id")).alias("examples"))
    return missing.agg(F.count("*").alias("n")).crossJoin(first)


def input_check(df: DataFrame) -> DataFrame:
    """(null_questions, repeated_ids, ok)."""
    out = df.agg(F.coalesce(F.sum(F.col("question").isNull().cast("long")), F.lit(0)).alias("null_questions"), (F.count("*") - F.count_distinct("id")).alias("repeated_ids"))
    return out.withColumn("ok", (F.col("null_questions") == 0) & (F.col("repeated_ids") == 0))


def length_mismatch(generations: DataFrame, verifier: DataFrame) -> DataFrame:
    """Ids whose scores aren't as many as their samples."""
    return generations.select("id", F.size("outputs").alias("samples")).join(verifier.select("id", F.size("orm").alias("scores")), "id").where("samples <> scores")


def sampling_gates(solved: DataFrame, n_suspects: DataFrame, n_rows: DataFrame, coverage: tuple[float, float] = (0.85, 0.94), most_suspects: int = 500, least_rows: int = 8000) -> DataFrame:
    """(check, value, ok) of a sampling round; solved is (id, k, n_correct), the other two have one row each (n)."""
    cov = solved.agg(F.lit("coverage").alias("check"), F.avg((F.col("n_correct") > 0).cast("double")).alias("value")).withColumn("ok", F.col("value").between(*coverage))
    sus = n_suspects.select(F.lit("suspects").alias("check"), F.col("n").cast("double").alias("value")).withColumn("ok", F.col("value") < most_suspects)
    rows = n_rows.select(F.lit("training_rows").alias("check"), F.col("n").cast("double").alias("value")).withColumn("ok", F.col("value") >= least_rows)
    return cov.unionByName(sus).unionByName(rows)


def pair_gate(pairs: DataFrame, least: int = 2000) -> DataFrame:
    return pairs.agg(F.count_distinct("id").alias("mixed")).withColumn("ok", F.col("mixed") >= least)
