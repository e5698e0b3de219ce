"""Pools of candidate answers drawn from the driver's tables, so that every operator runs on them.

pool: (id, j, ans, score, trunc, logp, text). j orders the samples of an id and is unique within it.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as problems, their events as samples: ans from the JSON property k (null for errors)."""
    k = F.get_json_object("props", "$.k").cast("long")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), (F.row_number().over(order) - 1).alias("j"), F.when(F.col("event_type") != "error", k % 5).alias("ans"),
        F.col("value").alias("score"), (F.col("event_type") == "error").alias("trunc"), (-F.col("value") / 10).alias("logp"), F.col("event_type").alias("text"),
    )


def pool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as problems, their lines as samples. (l_orderkey, l_linenumber) isn't unique, so all columns order."""
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    order = Window.partitionBy("l_orderkey").orderBy(*columns)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.row_number().over(order) - 1).alias("j"), F.when(F.col("l_linestatus") != "X", F.col("l_quantity").cast("int") % 3).cast("long").alias("ans"),
        F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("trunc"), (-F.col("l_discount")).alias("logp"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"),
    )


def gold_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("gold")).distinct()


def gold_users(pool: DataFrame) -> DataFrame:
    return pool.select("id").distinct().withColumn("gold", F.col("id") % 5)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, truth, text): numbers of orders written into solutions in several ways; truth is what a reader gets."""
    n, k = F.col("o_custkey"), F.col("o_orderkey") % 8
    num = n.cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("We add up. \\boxed{"), num, F.lit("}")))
        .when(k == 1, F.concat(F.lit("So \\boxed{\\frac{"), (n * 2).cast("string"), F.lit("}{2}} holds")))
        .when(k == 2, F.concat(F.lit("\\boxed{1} then \\boxed{"), num, F.lit(".0}")))
        .when(k == 3, F.concat(F.lit("\\fbox{"), F.format_number(n, 0), F.lit("\\text{ units}}")))
        .when(k == 4, F.concat(F.lit("We get 3 + 4 = 7. The answer is "), num, F.lit(".")))
        .when(k == 5, F.concat(F.lit("first 12\nthen "), num))
        .when(k == 6, F.concat(F.lit("\\boxed{"), num, F.lit("/7}")))
        .otherwise(F.concat(F.lit("\\boxed{-"), num, F.lit(" cm^2}")))
    )
    truth = F.when(k == 6, F.when(n % 7 == 0, (n / 7).cast("long"))).when(k == 7, -n).otherwise(n)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), truth.cast("string").alias("truth"), text.alias("text"))
