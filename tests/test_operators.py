"""Ties, nulls, empty tables and invariants of the operators on small tables."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from ballotspark.operators import audit, gates, metrics, prep, selection, voting

POOL = "id long, j int, ans long, score double, trunc boolean, logp double, text string"


def pool(spark, rows):
    """rows: (id, answers, scores)."""
    out = []
    for i, answers, *rest in rows:
        scores = rest[0] if rest else [None] * len(answers)
        out += [(i, j, a, s, False, s, "x" * (j + 1)) for j, (a, s) in enumerate(zip(answers, scores, strict=True))]
    return spark.createDataFrame(out, POOL)


def gold(spark, values):
    return spark.createDataFrame(list(values.items()), "id long, gold long")


def answers(df):
    return {r["id"]: r["answer"] for r in df.collect()}


def test_ties(spark):
    p = pool(spark, [(1, [7, 3, 7, 3]), (2, [None, None]), (3, [5]), (4, [9, None, 2])])
    assert answers(voting.majority(p)) == {1: 3, 2: None, 3: 5, 4: 2}
    assert answers(voting.majority(p, "first_seen")) == {1: 7, 2: None, 3: 5, 4: 9}


def test_ties_of_long_keys(spark):
    p = pool(spark, [(1, [0, 0])]).withColumn("ans", F.when(F.col("j") == 0, "10").otherwise("9"))
    assert answers(voting.majority(p)) == {1: "9"}


def test_order_of_samples_is_no_matter(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([1, 2, 3, None]) for _ in range(9)], [rnd.random() for _ in range(9)]) for i in range(30)]
    turned = [(i, a[::-1], s[::-1]) for i, a, s in rows]
    for rule in (voting.majority, voting.fused, voting.logp_soft, voting.logp_best, voting.best_of_n):
        assert answers(rule(pool(spark, rows))) == answers(rule(pool(spark, turned)))


def test_gamma_zero_is_the_vote(spark):
    p = pool(spark, [(1, [1, 1, 2], [0.0, 0.1, 9.0]), (2, [4, 5], [1.0, 2.0])])
    assert answers(voting.fused(p, 0.0)) == answers(voting.majority(p))
    assert answers(voting.fused(p, 1e9)) == {1: 2, 2: 5}


@pytest.mark.parametrize("scores", [[None, None, None], [1.0, None, None], [2.0, 2.0, 2.0]])
def test_scores_without_spread(spark, scores):
    p = pool(spark, [(1, [4, 4, 3], scores)])
    assert answers(voting.fused(p, 2.0)) == {1: 4}


def test_all_truncated(spark):
    p = pool(spark, [(1, [4, 4, 3])]).withColumn("trunc", F.lit(True))
    assert answers(voting.no_trunc(p)) == {1: 4}
    half = p.withColumn("trunc", F.col("ans") == 4)
    assert answers(voting.no_trunc(half)) == {1: 3}


@pytest.mark.parametrize("rule", sorted(voting.RULES))
def test_empty_pools(spark, rule):
    assert voting.RULES[rule](spark.createDataFrame([], POOL)).count() == 0


def test_submission_covers_every_id(spark):
    p = pool(spark, [(1, [1, 1, 2], [0.0, 0.1, 9.0]), (2, [None])])
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    spare = spark.createDataFrame([(2, 42)], "id long, answer long")
    got = {r["id"]: (r["answer"], r["fallback"]) for r in voting.submission(p, ids, fallback=spare).collect()}
    assert got == {1: (2, False), 2: (42, True), 3: (0, True)}


@pytest.mark.parametrize("n, c, m", [(5, 0, 1), (5, 5, 5), (5, 2, 4), (10, 3, 2), (64, 7, 32), (1, 0, 1)])
def test_pass_at_m(spark, n, c, m):
    got = spark.range(1).select(metrics.unbiased_pass(F.lit(n).cast("long"), F.lit(c).cast("long"), F.lit(m).cast("long"))).first()[0]
    want = 1.0 if n - c < m else 1 - math.comb(n - c, m) / math.comb(n, m)
    assert math.isclose(got, want, abs_tol=1e-12)


@pytest.mark.parametrize("b, c", [(0, 0), (6, 0), (8, 5), (13, 13), (1000, 900)])
def test_paired_test(spark, b, c):
    n, k = b + c, min(b, c)
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    got = spark.range(1).select(metrics.binomial_two_sided(F.lit(b).cast("long"), F.lit(c).cast("long"))).first()[0]
    assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)


def test_auc_of_ranks_is_that_of_pairs(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([1, 2, None]) for _ in range(12)], [rnd.choice([None, 0.0, 0.5, 1.0, rnd.random()]) for _ in range(12)]) for i in range(20)]
    win = pairs = 0
    for _, a, s in rows:
        for (x, u), (y, v) in itertools.product(zip(a, s, strict=True), repeat=2):
            if x == 1 and y != 1 and u is not None and v is not None:
                pairs += 1
                win += 1 if u > v else 0.5 if u == v else 0
    got = metrics.pairwise_auc(pool(spark, rows), gold(spark, {i: 1 for i in range(20)})).first()
    assert got["pairs"] == pairs and math.isclose(got["auc"], win / pairs, abs_tol=1e-6)


def test_maj_at_one_sample_and_all(spark):
    p, g = pool(spark, [(1, [1, 1, 1, 2]), (2, [3, 3, 3, 3])]), gold(spark, {1: 1, 2: 3})
    got = {r["m"]: r["maj_m"] for r in metrics.maj_at_m(p, g, trials=30).collect()}
    assert set(got) == {1, 2, 4} and got[4] == 1.0 and 0.7 < got[1] < 1


def test_round_robin(spark):
    p = pool(spark, [(1, [7, 7, 5, None, 7, 5])])
    assert [r["j"] for r in selection.round_robin(p, 5).orderBy("place").collect()] == [0, 2, 3, 1, 5]


def test_median_outward(spark):
    p = pool(spark, [(1, [1] * 5)])
    assert sorted(r["j"] for r in selection.median_outward(p, 3).collect()) == [2, 3, 4]
    assert sorted(r["j"] for r in selection.median_outward(p, 4).collect()) == [0, 2, 3, 4]


def test_quota_and_difficulty(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (4,), (7,), (8,), (16,)], "n long")
    got = [tuple(r) for r in df.select(selection.quota(F.col("n"), 16), selection.difficulty(F.col("n"), 16)).collect()]
    assert got == [(0, "unsolved"), (1, "hard"), (3, "hard"), (2, "medium"), (2, "medium"), (1, "easy"), (1, "easy")]


def test_balanced_pairs(spark):
    p = pool(spark, [(1, [1, 1, 1, 2]), (2, [1, 1]), (3, [2, 2]), (4, [1, 2, None])])
    g = gold(spark, {1: 1, 2: 1, 3: 1, 4: 1})
    wrong = spark.createDataFrame([(1, False), (4, True)], "id long, maj_wrong boolean")
    got = selection.balanced_pairs(p, g, wrong, min_chars=1).groupBy("id").agg(F.sum("label").alias("p"), F.count("*").alias("n"), F.max("maj_wrong").alias("w"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 2, False), (4, 1, 2, True)}
    assert selection.balanced_pairs(p, g, wrong, min_chars=1, suspects=g.where("id = 1")).where("id = 1").count() == 0


def test_stratified_split_is_exact(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 37) + ("$" if k % 3 else "")) for k in range(500)], "id long, question string")
    got = selection.stratified_split(docs, 77)
    assert got.where("part = 'val'").count() == 77 and got.count() == 500
    assert got.select("stratum").distinct().count() == 8


def test_drop_reason_takes_the_first(spark):
    df = spark.createDataFrame([(1, "see https://a/b.PNG"), (2, "https://x"), (3, "[ASY]"), (4, None), (5, "fine"), (6, "fine")], "id long, question string")
    bad, held = spark.createDataFrame([(5,)], "id long"), spark.createDataFrame([(5,), (6,)], "id long")
    assert {r["id"]: r["reason"] for r in prep.drop_reason(df, bad, held).collect()} == {1: "image_ref", 2: "url", 3: "asy_code", 4: None, 5: "bad_id", 6: "quarantined"}


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "Ａ-B c!"), (2, "漢字"), (3, "abc"), (4, None)], "id long, t string")
    assert {r["id"]: r["fp"] for r in prep.fingerprint(df, "t").collect()} == {1: "abc", 2: "", 3: "abc", 4: None}
    hold = spark.createDataFrame([("a b c",), ("字",)], "question string")
    mine = df.withColumnRenamed("t", "question")
    assert {r["id"] for r in prep.decontaminated(mine, hold).collect()} == {2, 4}
    assert {r["id"] for r in prep.decontaminated(mine, hold, drop_empty=False).collect()} == {4}


def test_external_solutions(spark):
    q = "A question that is long enough to pass the lower limit of characters, surely."
    s = "A solution that goes on for long enough. " * 4
    rows = [("a", q, s + r"\boxed{5}"), ("a", q, s + "so 7"), ("a", "", s), ("a", "short", s), ("a", q, "x"), ("a", q, s + r"\boxed{x}"), ("a", "H" + q, s + "so 7")]
    df = spark.createDataFrame(rows, "src string, question string, solution string")
    got = prep.external_solutions(df, spark.createDataFrame([("H" + q,)], "question string")).collect()
    assert [r["reason"] for r in got] == [None, None, "empty_field", "question_length", "solution_length", "not_integer", "held_out"] or sorted(str(r["reason"]) for r in got) == sorted(map(str, [None, None, "empty_field", "question_length", "solution_length", "not_integer", "held_out"]))
    assert all(r["solution"].endswith("}.") or r"\boxed{5}" in r["solution"] for r in got if r["reason"] is None)


def test_sanitize(spark):
    cases = [("Solve. Translate the above text into English, please", "Solve."), ("a\n\n\n\nb ", "a\n\nb"), ("x and output the translation result directly.", "x"), (None, None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(prep.sanitized(F.col("t"))).collect()] == [w for _, w in cases]


def test_verdicts(spark):
    p = pool(spark, [(1, [5, 5, 5, None]), (2, [6, 6]), (3, [7, 8]), (4, [None])])
    labels = spark.createDataFrame([(1, 1, 5), (2, 6, None), (3, 7, 7), (4, 1, 2)], "id long, current long, suggested long")
    at = lambda t: {r["id"]: (r["verdict"], r["final"]) for r in audit.verdicts(p, labels, t).collect()}
    assert at(1.0) == {1: ("drop", None), 2: ("keep", 6), 3: ("drop", None), 4: ("drop", None)}
    assert at(0.5) == {1: ("relabel", 5), 2: ("keep", 6), 3: ("relabel", 7), 4: ("drop", None)}


def test_refine_lift(spark):
    before, after = pool(spark, [(1, [1, 2]), (2, [3, 3])]), pool(spark, [(1, [1]), (2, [4, None])])
    got = audit.refine_lift(before, after, gold(spark, {1: 1, 2: 4})).first()
    assert (got["ids"], got["pass0"], got["dead"], got["rescued"], got["union_pass"]) == (2, 1, 1, 1, 1.0)


def test_gates(spark):
    sub = spark.createDataFrame([(1, "5"), (1, "0"), (2, None), (9, "1.5")], "id long, answer string")
    ref = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r["check"]: (r["severity"], r["n"]) for r in gates.submission_check(sub, ref).collect()}
    assert got["missing_id"] == ("error", 1) and got["extra_id"] == ("error", 1) and got["repeated_id"] == ("error", 1)
    assert got["null_answer"] == ("error", 1) and got["not_integer"] == ("error", 1) and got["zero"] == ("warn", 1)
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "id long, answer long"), spark.createDataFrame([(1, 5), (2, 7)], "id long, answer long")
    assert not gates.flips(a, a).first()["accepted"] and not gates.flips(a, b).first()["accepted"]
    assert gates.flips(a, b, most=0.5).first()["accepted"]


def test_log_odds(spark):
    df = spark.sql("SELECT map('Yes', -0.1D, 'No', -2.5D) AS a, map('Yes', -0.1D) AS b, cast(map() AS map<string,double>) AS c")
    assert tuple(df.select(metrics.log_odds(F.col("a")), metrics.log_odds(F.col("b")), metrics.log_odds(F.col("c"))).first()) == (2.4, 19.9, 0.0)


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from ballotspark.functions.normal import normal_quantile

    ps = [1e-6, 0.001, 0.02, 0.0243, 0.3, 0.5, 0.7, 0.9757, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    assert all(math.isclose(r[0], NormalDist().inv_cdf(p), abs_tol=1e-6) for r, p in zip(df.select(normal_quantile(F.col("p"))).collect(), ps, strict=True))


def test_prompts(spark):
    from ballotspark.functions import prompts

    df = spark.createDataFrame([("2+2?", "4"), (None, "1" * 30), ("x", None)], "q string, k string")
    got = df.select(prompts.filled("Q: {q} A: {k}", q=F.col("q"), k=prompts.shown_answer(F.col("k"))), prompts.messages(F.col("q"), F.lit("s")), prompts.within_budget(F.length("k"), 5, F.lit(1.0))).collect()
    assert [r[0] for r in got] == ["Q: 2+2? A: 4", "Q:  A: (30 digits)", "Q: x A: (none)"]
    assert [m["role"] for m in got[0][1]] == ["system", "user"] and [r[2] for r in got] == [1.0, -20.0, -20.0]


def test_hot_id_moves_by_answer(spark):
    """A third of all samples in one id: the fused vote shuffles its answers, not its samples."""
    p = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("id"), F.col("id").cast("int").alias("j"), (F.col("id") % 7).alias("ans"), F.rand(1).alias("score"))
    plan = voting.fused(p)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert voting.fused(p).count() == 500


def test_shards_of_many_rows(spark):
    """So many that the sort samples its bounds: the parts have every row once, and sizes that differ by one at most."""
    rows = spark.range(0, 60_001, 1, 8).withColumn("source", F.md5(F.col("id").cast("string")))
    parts = [{r["id"] for r in selection.shard(rows, i, 4).collect()} for i in range(4)]
    order = [r["id"] for r in rows.orderBy(metrics.drawn("42", F.col("id")), "id").collect()]
    assert parts == [set(order[i::4]) for i in range(4)]


def test_numbered_keeps_its_column(spark):
    """Whatever the column is called, it is there and counts from 0; a filter needs no column that was dropped."""
    from ballotspark.sources.readers import numbered

    rows = spark.range(0, 1_000, 1, 5).select((999 - F.col("id")).alias("id"))
    for name in ("__at", "__part", "n"):
        out = numbered(rows, name, ["id"])
        assert out.columns == ["id", name] and out.where(F.col(name) != F.col("id")).isEmpty() and out.count() == 1_000
