import time

from pyspark.sql import functions as F

from ballotspark.functions import answers as A
from ballotspark.plans import queries as plans
from ballotspark.sources import adapters as P

SF = "/root/testdata/sf0.001"


def test_solution_integer_reads_every_order(spark):
    """Remainders 3 (thousands separator, \\fbox) and 4 (several numbers on the last line) too."""
    orders = {r["o_orderkey"]: r["o_custkey"] for r in P.table(spark, SF, "orders").select("o_orderkey", "o_custkey").collect()}
    want = {k: "1" if k % 8 == 2 else str(n) if k % 8 in (0, 3, 5) else None for k, n in orders.items()}
    got = [tuple(r) for r in plans.QUERIES["solution_integer"](spark, SF).select("id", "answer").collect()]
    assert len(got) == len(orders) and dict(got) == want
    assert {3, 4} <= {k % 8 for k, _ in got}


def test_final_integer_behind_long_lines(spark):
    """The cost follows the text's length: one line of 400,000 characters, and other line ends."""
    cases = [("we see " * 57_000 + "\nthen 12", "12"), ("1 2\r3", "3"), ("1\x1c2\x85", "2"), ("5\x1d", None), ("4\u2028x 1,0", "10"), ("", None), (None, None), ("7 8", None), ("1\n\\boxed{ 1,2 }\n3", "12"), ("\\boxed{x}\n3", None)]
    began = time.monotonic()
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", A.final_integer(F.col("t")).alias("a")).collect()
    assert {r["k"]: r["a"] for r in got} == {k: a for k, (_, a) in enumerate(cases)}
    assert time.monotonic() - began < 30
