"""Sources and sinks, and queries that have no fixture of their own, against SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from ballotspark.operators import metrics, selection
from ballotspark.plans import files, queries
from ballotspark.sources import readers, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations pages".split()
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == files.__name__] + [
    "maj_at_m", "mcnemar_pairs", "rule_league", "gamma_sweep", "rescue_break", "fusion_sim", "length_quantiles", "shard", "easy_downsample", "last_number", "solution_integer", "with_box", "model_tag", "early_answer",
    "generation_messages", "shown_answers", "token_budget", "external_solutions", "question_lookup", "adopted_rows", "repeated_correct", "pair_gate", "length_mismatch", "submission_report", "distinct_envelope",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v
    return sorted(names), sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_as_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLE_SQL[name])
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), [d[0] for d in want.description])


def test_votes_with_replacement(spark):
    """Two ids have fewer samples than the largest m."""
    rows = [(1, j, 1) for j in range(8)] + [(2, 0, 5)] + [(3, 0, None), (3, 1, 4)]
    pool = spark.createDataFrame(rows, "id long, j long, ans long")
    gold = spark.createDataFrame([(1, 1), (2, 5), (3, 0)], "id long, gold long")
    got = {r["m"]: r["maj_m"] for r in metrics.maj_at_m(pool, gold, trials=3).collect()}
    assert got == {1: pytest.approx(2 / 3, abs=1e-6), 2: pytest.approx(2 / 3, abs=1e-6), 4: pytest.approx(2 / 3, abs=1e-6), 8: pytest.approx(2 / 3, abs=1e-6)}


def test_binomial(spark):
    from pyspark.sql import functions as F

    pairs = [(0, 0), (0, 1), (8, 5), (5, 8), (60, 41), (500, 400), (3000, 2900), (100_000, 100_700)]
    got = spark.createDataFrame(pairs, "b long, c long").select(metrics.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).collect()
    for (b, c), r in zip(pairs, got, strict=True):
        n, k = b + c, min(b, c)
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)  # noqa: E731, B023
        want = 1.0 if not n else min(1.0, 2 * math.fsum(math.exp(log(i)) for i in range(k + 1)))
        assert r["p"] == pytest.approx(want, rel=1e-6)


def test_arguments():
    assert selection.parsed_plan("hard:8, easy:2,") == {"hard": 8, "easy": 2}
    assert selection.parsed_shard("1/4") == (1, 4)
    assert selection.parsed_list(" a, b,,c ") == ["a", "b", "c"]
    with pytest.raises(ValueError, match="impossible"):
        selection.parsed_plan("impossible:3")
    with pytest.raises(ValueError, match="no part"):
        selection.parsed_shard("4/4")


def test_first_file_warns(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_text("no gzip")
    (tmp_path / "b.csv").write_text("id,question,answer\nx,y,1\n")
    with pytest.warns(UserWarning, match="can't be read"):
        df = readers.read_first(spark, [f"{tmp_path}/none.csv", f"{tmp_path}/a.csv.gz", f"{tmp_path}/b.csv"], "problems")
    assert [tuple(r) for r in df.collect()] == [("x", "y", "1")]


def test_names_of_columns(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], "Query string, text string, label string, GOLD string")
    assert tuple(readers.normalized_input(df).first()) == ("t-000000", "b", "d")
    assert set(registry.SETS) == {r["key"] for r in registry.sources(spark).collect()}
