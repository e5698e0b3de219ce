"""Queries of sources and sinks: tables are written as files in a shared folder and what is read back is compared."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotspark.plans import sql as S
from ballotspark.plans.queries import docs, li, query
from ballotspark.sources import adapters as P
from ballotspark.sources import readers as R
from ballotspark.sources import registry
from ballotspark.sources import sinks as W


def _problems(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as problems; line ends and quotes are in the texts."""
    return docs(spark, sf).select(F.concat(F.lit("train-"), "id").alias("id"), F.concat(F.lit('say "'), F.coalesce("question", F.lit("")), F.lit('", or\nnot')).alias("question"), F.length("question").cast("string").alias("answer"))


_PROBLEMS = """problems AS (SELECT 'train-' || doc_id AS id, 'say "' || coalesce(text, '') || '", or' || chr(10) || 'not' AS question, CAST(length(text) AS VARCHAR) AS answer FROM documents)"""


@query("csv_round_trip", f"WITH {_PROBLEMS} SELECT id, md5(question) AS question, answer FROM problems")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = W.scratch(spark, "csv")
    W.write_csv(_problems(spark, sf), path, single=False)
    return R.read_csv(spark, path, "problems").select("id", F.md5("question").alias("question"), "answer")


@query("first_file", f"WITH {_PROBLEMS} SELECT count(*) AS n, count(DISTINCT id) AS ids FROM problems")
def first_file(spark: SparkSession, sf: str) -> DataFrame:
    """The first of three places is absent, the second can't be read."""
    path = W.scratch(spark, "first")
    W.write_file(spark, f"{path}/broken.csv.gz", "no gzip file")
    W.write_csv(_problems(spark, sf), f"{path}/third", single=False)
    return R.read_first(spark, [f"{path}/absent", f"{path}/broken.csv.gz", f"{path}/third"], "problems").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("table_by_extension", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, kind FROM part, (SELECT unnest(['csv', 'parquet']) AS kind)")
def table_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = W.scratch(spark, "tables"), P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    W.write_csv(rows, f"{path}/part.csv", single=False)
    rows.write.parquet(f"{path}/part.parquet")
    each = [R.read_table(spark, f"{path}/part.{kind}").select(F.col("id").cast("string").alias("id"), "brand", F.lit(kind).alias("kind")) for kind in ("csv", "parquet")]
    return each[0].unionByName(each[1])


def _generations(spark: SparkSession, sf: str) -> DataFrame:
    pool = li(spark, sf)[0]
    one = pool.groupBy(F.col("id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("j", "text", "trunc", "logp"))).alias("s"))
    return one.select("id", F.col("s.text").alias("outputs"), F.col("s.trunc").alias("trunc"), F.col("s.logp").alias("logp"))


_LONG = f"WITH {S.LI} SELECT CAST(id AS VARCHAR) AS id, j, text, trunc, logp"


@query("jsonl_round_trip", f"{_LONG}, CASE WHEN id % 2 = 0 AND j < 2 THEN score END AS orm FROM pool")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Generations and scores as JSON lines, read and laid out as one row for each sample."""
    path, pool = W.scratch(spark, "jsonl"), li(spark, sf)[0]
    W.write_jsonl(_generations(spark, sf), f"{path}/generations")
    scores = pool.where("id % 2 = 0 AND j < 2").groupBy(F.col("id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("j", "score"))).alias("s"))
    W.write_jsonl(scores.select("id", F.col("s.score").alias("orm")), f"{path}/verifier")
    return R.long_samples(R.read_jsonl(spark, f"{path}/generations", "generations"), R.read_jsonl(spark, f"{path}/verifier", "verifier", "fail"))


@query("jsonl_torn_lines", "SELECT count(*) FILTER (doc_id % 7 <> 0) AS whole, count(*) FILTER (doc_id % 7 = 0) AS torn FROM documents")
def jsonl_torn_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh line is cut; some are blank."""
    path = W.scratch(spark, "torn")
    line = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "question", F.col("lang").alias("answer")))
    lines = docs(spark, sf).select(F.when(F.col("id") % 7 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value"), "id")
    lines.select("value").unionByName(lines.where("id % 5 = 0").select(F.lit("").alias("value"))).write.text(path)
    skipped = R.read_jsonl(spark, path, "problems").agg(F.count("id").alias("whole"))
    kept = R.read_jsonl(spark, path, "problems", "keep").agg(F.sum((F.col("_corrupt_record").isNotNull() & F.col("id").isNull()).cast("long")).alias("torn"))
    return skipped.crossJoin(kept)  # one row each


@query("jsonl_last_lines", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS answer FROM orders")
def jsonl_last_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two appended chunks; ids of the second count as it says."""
    path, rows = W.scratch(spark, "append"), P.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    W.append_jsonl(rows.withColumn("answer", F.lit("first")), f"{path}/a")
    W.append_jsonl(rows.where("id % 3 = 0").withColumn("answer", F.lit("second")), f"{path}/b")
    return R.last_lines(spark, f"{path}/*", "problems").select("id", "answer")


@query("appended_chunks", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def appended_chunks(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = W.scratch(spark, "chunks"), P.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("answer"))
    for k in range(3):
        W.append_jsonl(rows.where(F.col("id") % 3 == k), path)
    return R.read_jsonl(spark, path, "problems", "fail").groupBy(F.col("answer").alias("status")).agg(F.count("*").alias("n"))


@query("json_map", "SELECT n_name AS id, CAST(n_regionkey AS INT) AS n_solved FROM nation")
def json_map(spark: SparkSession, sf: str) -> DataFrame:
    path = W.scratch(spark, "map")
    nations = P.table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "n_regionkey")))).alias("value"))
    nations.coalesce(1).write.text(path)
    return R.read_map(spark, path)


@query("arm_files", "SELECT arm, count(*) AS n FROM region, (SELECT unnest(['A-chat-k16-mt1024?', 'C-raw-mt2048', 'gen_other']) AS arm) GROUP BY arm")
def arm_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose names tell the arm; one has another name."""
    path = W.scratch(spark, "arms")
    lines = "\n".join(r["v"] for r in P.table(spark, sf, "region").select(F.to_json(F.struct(F.col("r_name").alias("id"))).alias("v")).collect())  # five regions
    for name in ("gen_m_A_chat_k16_t0.8.jsonl", "gen_m_C_raw_k1_t0_mt2048.jsonl", "gen_other.jsonl"):
        W.write_file(spark, f"{path}/{name}", lines)
    return R.read_arms(spark, f"{path}/*.jsonl").groupBy("arm").agg(F.count("*").alias("n"))


@query("report_files", "SELECT r_name AS report, 'n' AS path, CAST(count(*) AS VARCHAR) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """A report for each region; their leaves side by side. One more is absent."""
    path, nations = W.scratch(spark, "reports"), P.table(spark, sf, "nation")
    places = {}
    for r in P.table(spark, sf, "region").collect():  # five regions
        places[r["r_name"]] = f"{path}/{r['r_regionkey']}"
        W.write_report(nations.where(F.col("n_regionkey") == r["r_regionkey"]).agg(F.count("*").alias("n")), places[r["r_name"]])
    return R.read_reports(spark, places | {"absent": f"{path}/absent"}).withColumn("path", F.regexp_replace("path", r"^\d+\.", ""))


@query("manifest", "SELECT key, license, CASE key WHEN 'orca' THEN (SELECT count(*) FROM documents WHERE lang = 'en') WHEN 'omi2' THEN (SELECT count(*) FROM documents WHERE lang = 'de') ELSE 0 END AS kept FROM (VALUES ('orca', 'MIT'), ('omi2', 'CC-BY-4.0'), ('numina', 'Apache-2.0')) t(key, license)")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two registered sets, and what was kept of each of three."""
    d = docs(spark, sf)
    rows = registry.registered(d.where("lang = 'en'").select("question", F.col("source").alias("answer")), "orca").unionByName(registry.registered(d.where("lang = 'de'").select(F.col("question").alias("problem"), F.col("source").alias("generated_solution")), "omi2"))
    path = W.scratch(spark, "manifest")
    W.write_jsonl(W.manifest(rows, registry.sources(spark)), path)
    return spark.read.schema("key string, license string, kept long").json(path)


@query("log_tail", "SELECT 'line ' || o_orderkey AS value FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderkey DESC LIMIT 20)")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    path = W.scratch(spark, "log")
    rows = P.table(spark, sf, "orders").orderBy("o_orderkey").select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "WARN line ").otherwise("line "), "o_orderkey").alias("value"))
    rows.write.text(path)
    return R.log_tail(spark, path, 20, "^WARN").select("value")


@query("normalized_input", "SELECT format('t-{:06d}', row_number() OVER (ORDER BY doc_id) - 1) AS id, md5(coalesce(text, '')) AS question, source AS answer FROM documents")
def normalized_input(spark: SparkSession, sf: str) -> DataFrame:
    """Columns by other names, in other cases; ids are made."""
    odd = docs(spark, sf).select(F.col("id").alias("ord"), F.col("question").alias("Query"), F.col("lang").alias("label"), F.col("source").alias("Gold"))
    return R.normalized_input(odd, "ord").select("id", F.md5(F.coalesce("question", F.lit(""))).alias("question"), "answer")


@query("file_checksums", "SELECT r_regionkey || '.txt' AS file, sha256(r_name || chr(10)) AS sha256 FROM region")
def file_checksums(spark: SparkSession, sf: str) -> DataFrame:
    path = W.scratch(spark, "sums")
    for r in P.table(spark, sf, "region").collect():  # five regions
        W.write_file(spark, f"{path}/{r['r_regionkey']}.txt", r["r_name"] + "\n")
    return W.checksums(spark, f"{path}/*.txt")


@query("first_prefix", "SELECT doc_id AS id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100)")
def first_prefix(spark: SparkSession, sf: str) -> DataFrame:
    from ballotspark.operators.prep import first_prefix as head

    return head(docs(spark, sf).select("id"), 100, "id")
