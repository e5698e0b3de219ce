"""Benchmark decontamination by a positional inverted index (operator 1). DataFrame operations only.

The index has a posting (term, document, position) for every word of the training texts; it is stored once and serves
any benchmark. For each benchmark window the lists of its two rarest terms, by the stored counts, are intersected
first: shifted by a term's place in the item, a posting names a diagonal, the place in the document where the item
would begin, and both terms must name the same one. Each diagonal that is left asks for the item's other terms at
their places, again of the postings, and a window occurs where all of its places are there. Terms are 64-bit hashes
of words, and a text's key is one of its id and text.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ballotspark.llm.storage import written

#: Every ASCII character but digits and lower-case letters, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes beyond which a side isn't broadcast but joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a text in order; null has none. lower() only where the text is ASCII, as it must change A-Z alone."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(folded, SEPARATORS), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint, if a sum of bytes shows that df is small enough."""
    size = lambda c, t: F.coalesce(F.octet_length(c) if t == "string" else F.octet_length(F.to_json(c)) if t.startswith(("array", "struct")) else F.lit(0), F.lit(0)) + 16
    total = df.agg(F.coalesce(F.sum(reduce(lambda x, y: x + y, [size(F.col(c), t) for c, t in df.dtypes])), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def key_of() -> Column:
    """A row's key: rows with the same id stay apart by their text."""
    return F.xxhash64("doc_id", "text")


def index(docs: DataFrame) -> DataFrame:
    """Stored postings (doc_id, uid, pos, term, n_words) of docs (doc_id, text): one for each word, with n_words at a
    text's last word, or one row without position and term for a text without words. uid is the row's `key_of`."""
    tokens = docs.select("doc_id", key_of().alias("uid"), words(F.col("text")).alias("w"))
    tokens = tokens.select("doc_id", "uid", F.size("w").alias("n"), F.posexplode_outer("w").alias("pos", "word"))
    last = F.col("pos").isNull() | (F.col("pos") == F.col("n") - 1)
    return written(tokens.select("doc_id", "uid", "pos", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"), F.when(last, F.col("n")).alias("n_words")), "postings")


def items_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(ik, item_id, iw, size): the words of each distinct item that has any, its window's length, and a key (a hash).
    Null ids are left out."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    return items.withColumn("ik", F.xxhash64("item_id", "iw")).withColumn("size", F.least(F.lit(window), F.size("iw")))


def terms_of(items: DataFrame) -> DataFrame:
    """(ik, size, length, p, term): the words of each item by place."""
    return items.select("ik", "size", F.size("iw").alias("length"), F.posexplode("iw").alias("p", "word")).withColumn("term", F.xxhash64("word")).drop("word")


def matches(postings: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """hits (doc_id, uid, item_id, hit) in an index: the document's word positions that an occurrence of one of the
    item's windows covers.

    Items of fewer words than a window are one window; items without words, and those with a null id, match nothing.
    """
    items = items_of(benchmark, window)
    placed = terms_of(items)
    counts = postings.join(_small(placed.select("term").distinct()), "term").groupBy("term").count()
    counted = placed.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    # the two rarest places of every window; one pair serves all windows that share it
    starts = counted.withColumn("s", F.explode(F.expr("sequence(greatest(p - size + 1, 0), least(p, length - size))")))
    rarest = starts.groupBy("ik", "s").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "p", "term"))), 1, 2).alias("r"))
    pairs = rarest.where(F.col("r")[0]["count"] > 0).select("ik", F.transform("r", lambda x: F.struct(x.p.alias("p"), x.term.alias("term"))).alias("r")).distinct()
    ends = pairs.select("ik", F.xxhash64("ik", F.col("r.p")).alias("pair"), F.size("r").alias("need"), F.posexplode("r").alias("end", "x"))
    anchors = written(ends.select("ik", "pair", "need", "end", F.col("x.p").alias("p"), F.col("x.term").alias("term")), "anchors")
    shifted = postings.select("doc_id", "uid", "pos", "term").join(_small(anchors), "term").select("doc_id", "uid", "ik", "pair", "need", (F.col("pos") - F.col("p")).alias("d"), "end")
    both = shifted.groupBy("doc_id", "uid", "ik", "pair", "need", "d").agg(F.min("end").alias("low"), F.max("end").alias("high")).where((F.col("low") == 0) & (F.col("high") == F.col("need") - 1))
    diagonals = written(both.select("doc_id", "uid", "ik", "d").distinct(), "diagonals")
    # every term of the item, asked for at its place on the diagonal
    asked = diagonals.join(_small(placed.select("ik", "p", "term")), "ik").withColumn("pos", F.col("d") + F.col("p")).where("pos >= 0")
    near = postings.select("uid", "pos", "term").join(_small(diagonals.select("uid").distinct()), "uid", "left_semi")
    there = asked.join(near, ["uid", "pos", "term"]).groupBy("doc_id", "uid", "ik", "d").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    there = there.join(_small(items.select("ik", "item_id", "size")), "ik")
    first = F.filter(F.sequence(F.lit(0), F.size("ps") - F.col("size")), lambda i: F.get(F.col("ps"), i + F.col("size") - 1) == F.get(F.col("ps"), i) + F.col("size") - 1)
    hit = F.array_distinct(F.flatten(F.transform(first, lambda i: F.sequence(F.col("d") + F.get(F.col("ps"), i), F.col("d") + F.get(F.col("ps"), i) + F.col("size") - 1))))
    out = there.where(F.size("ps") >= F.col("size")).select("doc_id", "uid", "item_id", hit.alias("hit"))
    return written(out.where(F.size("hit") > 0), "hits")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (as strings, sorted), contaminated, uid of each row of docs.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Null and empty texts have no words;
    texts of any length are taken whole. Rows with the same id are judged each by its own text; repeated rows each give
    a row. Without items nothing is hit; an empty table gives none.
    """
    postings = index(docs)
    base, hits = postings.where(F.col("n_words").isNotNull()).select("doc_id", "uid", "n_words"), matches(postings, benchmark, window)
    places = hits.select("uid", F.explode("hit").alias("pos")).distinct().groupBy("uid").count()
    named = hits.select("uid", F.col("item_id").cast("string").alias("item")).distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    out = base.join(places.join(named, "uid"), "uid", "left")
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("count", F.lit(0)).cast("long")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), (n_hit > 0).alias("contaminated"), "uid")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark.

    Null and empty texts hold none. Repeated rows stay or go together; rows with the same id each by their own text. An
    empty table gives none, an empty benchmark keeps all.
    """
    bad = matches(index(docs), benchmark, window).select(F.col("uid").alias("__uid")).distinct()
    return docs.join(bad, key_of() == F.col("__uid"), "left_anti")


def proximity(postings: DataFrame, benchmark: DataFrame, span: int = 20) -> DataFrame:
    """(doc_id, uid, item_id, pos): places of an index from which `span` words hold every distinct word of an item.

    Positions are those of the first of the item's words in such a stretch. Items of more distinct words than `span`,
    without words or with a null id match nothing. Repeated rows of the index's documents count once.
    """
    items = items_of(benchmark, 1).withColumn("distinct", F.size(F.array_distinct("iw"))).where(F.col("distinct") <= span)
    wanted = terms_of(items).select("ik", "term").distinct().join(items.select("ik", "item_id", "distinct"), "ik")
    ahead = W.partitionBy("uid", "ik").orderBy("pos").rangeBetween(0, span - 1)
    found = postings.select("doc_id", "uid", "pos", "term").distinct().join(_small(wanted), "term")
    return found.withColumn("held", F.size(F.collect_set("term").over(ahead))).where(F.col("held") == F.col("distinct")).select("doc_id", "uid", "item_id", "pos")
