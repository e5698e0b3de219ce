"""The registered queries opN_<name>, and the SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotspark.llm import (
    backoff_lm,
    bm25_wand,
    bpe_transducer,
    decontamination,
    jaccard_rtree,
    line_dedup,
    quality_mil,
    sentencepiece_lattice,
    suffix_dedup,
    toxicity_cnn,
)
from ballotspark.llm.storage import written
from ballotspark.llm.tables import fold_of, table


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public vocabulary; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    items = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup(docs, line_dedup.build(docs, min_docs=10, min_chars=1))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_cnn.score(docs, toxicity_cnn.train(docs, table(spark, sf_dir, "labels")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.count_tokens(table(spark, sf_dir, "documents"), vocabulary_file())


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_lm.scores(table(spark, sf_dir, "documents"), fold_of() != 1)
    sums = (F.round(c, 6).alias(c) for c in ("base_score", "score"))  # beyond that, the order of additions shows
    return out.select("doc_id", (fold_of() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", *sums)


def op8_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the documents with an id divisible by 20, whole texts, against all documents."""
    docs = table(spark, sf_dir, "documents")
    queries = written(docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text"), "bm25-queries")
    out = bm25_wand.search(bm25_wand.index(docs), queries, k=10)
    return out.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.join(table(spark, sf_dir, "documents"), size=3, percent=90)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digest of what they decode to."""
    out = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), vocabulary_file(), with_text=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


#: A word character in a key is lower-cased only from A-Z, so not by lower().
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = f"regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS words
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM iw)
), grams AS (
  SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM dw, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), found AS (
  SELECT doc_id, item_id, s, size FROM grams JOIN windows USING (size, words)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT *, {_FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines
), often AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (FROM often)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (FROM often)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""

#: Bytes as hexadecimal digits, two each.
OP5_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
grams AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM docs WHERE n >= 50)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY md5(g)) AS least FROM grams) WHERE least < doc_id),
begun AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM hit),
spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM begun) GROUP BY doc_id, k
), kept AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS low, a AS high FROM spans
  UNION ALL SELECT doc_id, coalesce(max(b), 0), max(n) FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), texts AS (
  SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS h FROM kept JOIN docs USING (doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(texts.h)) AS kept_sha256
FROM docs JOIN texts USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

#: crc32 by bytes, with its table made from the polynomial.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
  lambda c, b: xor(c >> 8, crc.byte[(xor(c, b) & 255) + 1])))"""

OP7_SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS byte
), dw AS (
  SELECT doc_id, {_CRC} % 5 = 1 AS held_out, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents, crc
), pos AS (SELECT doc_id, held_out, unnest(list_append(w, '')) AS t, unnest(list_prepend(' ', w)) AS b FROM dw),
one AS (SELECT t, count(*) AS c FROM pos WHERE NOT held_out GROUP BY t),
begun AS (SELECT b, count(*) AS c FROM pos WHERE NOT held_out GROUP BY b),
two AS (SELECT b, t, count(*) AS c FROM pos WHERE NOT held_out GROUP BY b, t),
total AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM one),
weighed AS (
  SELECT doc_id, held_out, n, coalesce(one.c, 0) AS c1, (coalesce(one.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS p, coalesce(two.c, 0) AS c2, coalesce(begun.c, 0) AS ch
  FROM pos LEFT JOIN one ON one.t = pos.t LEFT JOIN begun ON begun.b = pos.b LEFT JOIN two ON two.b = pos.b AND two.t = pos.t, total
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens,
  round(sum(log10(p)), 6) AS base_score, round(sum(log10((c2 + 8 * p) / (ch + 8))), 6) AS score
FROM weighed GROUP BY doc_id, held_out
"""

OP9_SQL = f"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, s, s + least(3, len(w)) - 1), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS s FROM dw WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id AND 100 * least(na.n, nb.n) >= 90 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (max(na.n) + max(nb.n) - count(*))
), reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_other, doc_id)) AS component_id
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least_other FROM reach GROUP BY doc_id) USING (doc_id)
"""

OP8_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS average FROM dw),
qw AS (SELECT doc_id AS query_id, unnest(list_distinct(w)) AS word FROM dw WHERE doc_id % 20 = 0),
tf AS (SELECT doc_id, size, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM dw) WHERE word IN (SELECT word FROM qw) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
scored AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))), 9) AS score
  FROM qw JOIN tf USING (word) JOIN df USING (word), n GROUP BY query_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored
)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scores": op7_lm_scores,
    "op8_bm25_search": op8_bm25_search,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE_SQL = {
    "op1_decontamination": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op7_lm_scores": OP7_SQL,
    "op8_bm25_search": OP8_SQL,
    "op9_jaccard_join": OP9_SQL,
}
