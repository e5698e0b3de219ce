"""One case for each branch of the answer parser."""

import pytest
from pyspark.sql import functions as F

from ballotspark.functions import answers as A

EXTRACT = [
    (r"a \boxed{1} b \boxed{2}", "2"),
    (r"\boxed{3} \fbox{4}", "3"),
    (r"so \fbox{4}", "4"),
    (r"\boxed no brace, \fbox{7}", "7"),
    (r"\boxed{12", "12"),
    (r"\boxed{\frac{10}{5}}", "2"),
    (r"\boxed{\frac{1}{2}} the answer is 9", None),
    (r"\boxed{\frac63}", "2"),
    (r"\boxed{\frac20}", "20"),  # can't be read as a fraction, and holds one number
    (r"\boxed{6/3}", "2"),
    (r"\boxed{6/0}", None),
    (r"\boxed{1{,}000}", None),
    (r"\boxed{1,000}", "1000"),
    (r"\boxed{1\,000}", "1000"),
    (r"\boxed{3 \times 10^4}", "30000"),
    (r"\boxed{1.5 \cdot 10^{-1}}", None),
    (r"\boxed{2^{10}}", "2"),
    (r"\boxed{12\text{ cm}^2}", "12"),
    (r"\boxed{5.0}", "5"),
    (r"\boxed{5.5}", None),
    (r"\boxed{1e3}", "1000"),
    (r"\boxed{x=7}", "7"),
    (r"\boxed{1 or 2}", None),
    ("\\boxed{\u22124}", "-4"),
    (r"\boxed{-0}", "0"),
    (r"\boxed{007}", "7"),
    (r"\boxed{$25$ dollars}", "25"),
    (r"\boxed{\text{a {nested} b}}", None),
    (r"\boxed{{{8}}} tail", "8"),
    ("\\boxed{" + "9" * 50 + "}", "9" * 50),
    ("The answer is 3 or 4.", "4"),
    ("therefore, 5 apples. Hence 6", "6"),
    ("The answer is 2.5", None),
    ("total 9\nvalue 2.5", "9"),
    ("answer: " + "x" * 130 + " 8", "8"),
    ("nothing here", None),
    ("", None),
    (None, None),
]


def one(spark, texts, column):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("t")).alias("x")).collect()]


def test_extract_answer(spark):
    assert one(spark, [t for t, _ in EXTRACT], A.extract_answer) == [k for _, k in EXTRACT]


def test_fallback(spark):
    cases = [(r"\boxed{2.5}", "2"), (r"\boxed{3.5}", "4"), (r"\boxed{7/2}", "4"), (r"\boxed{1 or 2}", "2"), ("none", "0"), ("", "0"), (None, "0"), (r"\boxed{4}", "4")]
    assert one(spark, [t for t, _ in cases], A.extract_or_fallback) == [k for _, k in cases]


def test_final_integer(spark):
    cases = [(r"\boxed{12} then \boxed{13}", "12"), (r"\boxed{1,200}", "1200"), (r"\boxed{x} 5", None), (r"\boxed{5", "5"), ("a 1\nso 7.", "7"), ("is 1 or 2", None), ("1" * 18, None), ("", None), (None, None)]
    assert one(spark, [t for t, _ in cases], A.final_integer) == [k for _, k in cases]


def test_status_is_kept(spark):
    texts = ["5.5", "abc", "12", "", None]
    assert [r["status"] for r in one(spark, texts, A.to_answer)] == ["NOT_INT", "FAIL", "INT", "FAIL", "FAIL"]


def test_path_hash(spark):
    assert one(spark, ["1 + 2 = 3, then 3*1,000", "no steps", "x" * 100], A.path_hash) == ["1+2|3*1000", "no steps", "x" * 80]


def test_early_answer(spark):
    df = spark.createDataFrame([("it is 123 at once" + "." * 80, "123"), ("." * 80 + "123", "123"), ("it is 12" + "." * 90, "12"), ("it is 1234" + "." * 90, "123")], "t string, k string")
    assert [r[0] for r in df.select(A.early_answer(F.col("t"), F.col("k"))).collect()] == [True, False, False, False]


def test_keys_sort_as_numbers(spark):
    keys = ["-100", "-99", "-1", "0", "5", "10", "9" * 40]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k string")
    assert [r[0] for r in df.orderBy(*A.sort_fields(F.col("k"))).collect()] == keys


@pytest.mark.parametrize("path, tag", [("/a/b/My Model!", "My_Model_"), ("x/", "x"), ("", "model")])
def test_model_tag(spark, path, tag):
    assert one(spark, [path], A.model_tag) == [tag]


def test_with_box(spark):
    df = spark.createDataFrame([("so it is 4.  \n", "4"), (r"\boxed{4}", "4")], "t string, k string")
    assert [r[0] for r in df.select(A.with_box(F.col("t"), F.col("k"))).collect()] == ["so it is 4.\n\nThe final answer is \\boxed{4}.", r"\boxed{4}"]


def test_long_text(spark):
    long = "{" * 3000 + "}" * 3000 + " word 12 " * 40000 + r"\boxed{77}"
    assert one(spark, [long], A.extract_answer) == ["77"]
