import re

from pyspark.sql import functions as F

from ballotspark.llm import decontamination as D
from tests.llm.conftest import collected

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans(D.UPPER, D.LOWER)


def split(text):
    return WORD.findall((text or "").translate(TO_LOWER))


def brute(rows, items, window=10):
    out = []
    for i, t in rows:
        w, hit, names = split(t), set(), set()
        for name, text in items:
            v = split(text)
            size = min(window, len(v))
            for s in range(len(v) - size + 1 if v and name is not None else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[s : s + size]:
                        hit.update(range(p, p + size))
                        names.add(str(name))
        out.append((i, len(w), len(hit), sorted(names), bool(hit)))
    return sorted(out, key=repr)


def items_from(rows):
    long = split(rows[3][1])
    return [(1, " ".join(long[:25])), (2, "Zzz " + " ".join(split(rows[10][1])[2:9]) + " qqq"), (3, " ".join(long[:4])), (10, "one"), (4, None), (5, "..."), (None, " ".join(long[:12])), (6, "word " * 11), (7, "absent words only here"), (1, "same id another text")]


def test_as_brute_force(spark, docs, rows):
    small = [r for r in rows if len(r[1] or "") < 5000]
    items = items_from(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collected(D.report(docs.where("coalesce(length(text), 0) < 5000"), bench), "doc_id", "n_words", "n_hit", "item_ids", "contaminated")
    assert got == brute(small, items)
    assert any(r[2] for r in got)


def test_a_long_text_of_one_word(spark, docs):
    bench = spark.createDataFrame([(6, "word " * 11)], "item_id long, text string")
    got = D.report(docs.where("doc_id = 9004"), bench).first()
    assert (got["n_words"], got["n_hit"]) == (20_001, 20_000)


def test_without_broadcasts(spark, docs, rows, monkeypatch):
    bench = spark.createDataFrame(items_from(rows), "item_id long, text string")
    want = collected(D.report(docs, bench), "doc_id", "n_hit")
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    assert collected(D.report(docs, bench), "doc_id", "n_hit") == want


def test_clean_keeps_columns_and_clean_rows(spark, docs, rows):
    bench = spark.createDataFrame(items_from(rows), "item_id long, text string")
    bad = {r[0] for r in brute([r for r in rows if len(r[1] or "") < 5000], items_from(rows)) if r[4]} | {9004}
    got = D.clean(docs, bench)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {i for i, _ in rows} - bad


def test_empty_tables(docs, none, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.report(none, bench).count() == 0
    assert D.report(docs, bench).where("contaminated").count() == 0
    assert D.clean(docs, bench).count() == docs.count()


def test_other_columns_are_ignored(spark, docs, rows):
    bench = spark.createDataFrame(items_from(rows), "item_id long, text string").withColumn("uid", F.lit(1)).withColumn("term", F.lit("x"))
    clash = docs.withColumn("uid", F.lit("x")).withColumn("pos", F.lit(3)).withColumn("item_id", F.lit(1)).withColumn("n_words", F.lit(0))
    assert collected(D.report(clash, bench), "doc_id", "n_hit") == collected(D.report(docs, bench), "doc_id", "n_hit")
    assert D.clean(clash, bench).columns == clash.columns


def test_one_index_for_many_benchmarks(spark, docs, rows):
    postings = D.index(docs)
    small = [r for r in rows if len(r[1] or "") < 5000]
    for items in (items_from(rows), [(5, " ".join(split(rows[20][1])[:12]))], [(6, "absent words only here")]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {(r["doc_id"], str(r["item_id"])) for r in D.matches(postings, bench).collect() if r["doc_id"] != 9004}
        assert got == {(i, x) for i, _, _, names, _ in brute(small, items) for x in names}


def near(rows, items, span):
    out = set()
    for i, t in rows:
        w = split(t)
        for name, text in items:
            need = set(split(text))
            if name is not None and need and len(need) <= span:
                out |= {(i, name, p) for p in range(len(w)) if w[p] in need and need <= set(w[p : p + span])}
    return sorted(out, key=repr)


def test_proximity_as_brute_force(spark, docs, rows):
    small = [r for r in rows if len(r[1] or "") < 5000]
    items = [(1, " ".join(split(rows[3][1])[5:9])), (2, " ".join(reversed(split(rows[10][1])[:6]))), (3, "one"), (4, "same text"), (5, None), (None, "one"), (6, " ".join(split(rows[3][1])[:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for span in (3, 8):
        got = collected(D.proximity(D.index(docs.where("coalesce(length(text), 0) < 5000")), bench, span).select("doc_id", "item_id", "pos").distinct(), "doc_id", "item_id", "pos")
        assert got == near(small, items, span)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b x x c"), (2, "c a b"), (3, "a b"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b c a b")], "item_id long, text string")
    assert collected(D.proximity(D.index(docs), bench, 6), "doc_id", "pos") == [(1, 0), (2, 0)]
    assert collected(D.proximity(D.index(docs), bench, 4), "doc_id", "pos") == [(2, 0)]
