import json

import pytest
from pyspark.sql import functions as F

from ballotspark.sources import readers, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_line_ends_in_quotes(spark, tmp_path):
    path = put(tmp_path, "p.csv", 'id,question,extra\na,"one\ntwo ""x""",1\nb,plain,2\n')
    assert [tuple(r) for r in readers.read_csv(spark, path, "problems").orderBy("id").collect()] == [("a", 'one\ntwo "x"', None), ("b", "plain", None)]


def test_first_that_is_there(spark, tmp_path):
    path = put(tmp_path, "b.csv", "id\nx\n")
    assert readers.read_first(spark, [str(tmp_path / "a.csv"), path], "id_list").first()["id"] == "x"
    assert readers.read_first(spark, [str(tmp_path / "a.csv")], "id_list").count() == 0


def test_torn_last_line(spark, tmp_path):
    path = put(tmp_path, "g.jsonl", '{"id":"a","outputs":["x"]}\n{"id":"b","outputs":["y"],"trunc":[true]}\n{"id":"c","outp')
    assert sorted(r["id"] for r in readers.read_jsonl(spark, path, "generations").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, path, "generations", "fail").collect()


def test_last_line_of_an_id_counts(spark, tmp_path):
    path = put(tmp_path, "g.jsonl", '{"id":"a","outputs":["1"]}\n\n{"id":"a","outputs":["2"]}\nbroken\n{"id":"b","outputs":["3"]}\n')
    assert {r["id"]: r["outputs"] for r in readers.last_lines(spark, path, "generations").collect()} == {"a": ["2"], "b": ["3"]}


def test_json_map(spark, tmp_path):
    assert {tuple(r) for r in readers.read_map(spark, put(tmp_path, "m.json", '{"a": 3,\n "b": 0}')).collect()} == {("a", 3), ("b", 0)}


def test_arms(spark, tmp_path):
    line = '{"id":"a","outputs":["x"]}\n'
    for name in ("gen_val_A_chat_k1_t0.0_mt1024.jsonl", "gen_val_B_raw_k4_t0.8.jsonl", "gen_other_lp.jsonl"):
        put(tmp_path, name, line)
    assert {r["arm"] for r in readers.read_arms(spark, f"{tmp_path}/gen_*.jsonl").collect()} == {"A-chat-mt1024", "B-raw-k4-mt1024?", "gen_other_lp"}
    put(tmp_path, "gen_test_A_chat_k1_t0.0_mt1024.jsonl", line)
    with pytest.raises(ValueError, match="A-chat-mt1024"):
        readers.read_arms(spark, f"{tmp_path}/gen_*.jsonl")


def test_log_tail(spark, tmp_path):
    path = put(tmp_path, "l.log", "a\nnoise 1\nb\nc\nnoise 2\n")
    assert [r["value"] for r in readers.log_tail(spark, path, 2, "^noise").collect()] == ["b", "c"]


def test_log_tail_of_several_files(spark, tmp_path):
    """The last file is the largest, which a scan takes first, and is read in pieces."""
    put(tmp_path, "1.log", "a\nb\n")
    put(tmp_path, "2.log", "".join(f"line {k}\n" for k in range(5000)) + "noise\n")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = [r["value"] for r in readers.log_tail(spark, str(tmp_path), 5001, "^noise").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert got == ["b", *(f"line {k}" for k in range(5000))]


def test_normalized_input(spark):
    df = spark.createDataFrame([(1, "q1", "5"), (2, "q2", None)], "n int, Problem string, GOLD string")
    assert [tuple(r) for r in readers.normalized_input(df, "n").orderBy("id").collect()] == [("t-000000", "q1", "5"), ("t-000001", "q2", None)]
    with pytest.raises(ValueError, match="question"):
        readers.normalized_input(df.select("n"))


def test_made_ids_of_many_rows(spark):
    """So many that the sort samples its bounds; each run of it draws others."""
    df = spark.range(0, 60_000, 1, 8).select(F.xxhash64("id").alias("n"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("text"))
    got = [r["id"] for r in readers.normalized_input(df, "n").join(df, F.col("question") == F.col("text")).orderBy("n").select("id").collect()]
    assert got == [f"t-{k:06d}" for k in range(60_000)]


def test_long_samples(spark):
    g = spark.createDataFrame([("a", ["x", "y"], None, [0.5]), ("b", [], None, None)], "id string, outputs array<string>, trunc array<boolean>, logp array<double>")
    v = spark.createDataFrame([("a", [1.5])], "id string, orm array<double>")
    assert sorted(tuple(r) for r in readers.long_samples(g, v).select("id", "j", "text", "trunc", "logp", "orm").collect()) == [("a", 0, "x", False, 0.5, 1.5), ("a", 1, "y", False, None, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    sinks.write_jsonl(df, f"{tmp_path}/j")
    sinks.append_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    sinks.write_csv(df, f"{tmp_path}/c", ["id"])
    assert [r["id"] for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()] == ["a", "b"]
    assert len(json.loads(sinks.report(df).first()["value"])) == 2
    sinks.write_report(df, f"{tmp_path}/r.json")
    assert {r["value"] for r in readers.read_reports(spark, {"x": f"{tmp_path}/r.json", "y": f"{tmp_path}/none"}).where(F.col("path").endswith(".id")).collect()} == {"a", "b"}


def test_manifest_and_checksums(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",)], "src string")
    sources = spark.createDataFrame([("a", "MIT"), ("b", "CC")], "key string, license string")
    assert {r["key"]: r["kept"] for r in sinks.manifest(rows, sources).collect()} == {"a": 2, "b": 0}
    put(tmp_path, "f.bin", "abc")
    assert sinks.checksums(spark, f"{tmp_path}/*.bin").first()["sha256"].startswith("ba7816bf")
