"""The pipeline against the same five steps written plainly; the classifier's scores are taken as they are."""

import sentencepiece

import corpus_pipeline
from ballotspark.llm import quality_mil, storage
from ballotspark.llm.tables import table
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_jaccard import brute as near
from tests.llm.test_line_dedup import brute as lines

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]


def test_as_plain_steps(spark, model_file):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    accepted = {r["doc_id"] for r in quality_mil.score(docs, quality_mil.train(docs, labels)).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] in accepted]
    rows = sorted((i, t) for i, t, _, _ in lines(rows, 10))
    keep = {i for i, n, c in near(rows, 5, 80) if n == 0 or i == c}
    rows = [r for r in rows if r[0] in keep]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in contaminated(rows, items) if not r[4]}
    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    want = sorted((i, library.encode(t)) for i, t in rows if i in clean)
    got = sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
    assert 0 < len(got) < docs.count()


def test_each_stage_returns_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        docs = out


def test_heaps_are_given_back_before_a_stage_and_before_its_result(spark):
    """Whole collections of the JVM, which runs the tasks here too."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: next(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs, counts = table(spark, SF, "documents"), [whole()]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF)
        counts.append(whole())
    assert all(b - a >= 2 for a, b in zip(counts[:-1], counts[1:], strict=True))


def test_heaps_are_given_back_between_words_and_texts(spark, monkeypatch):
    """By the last stage three times; the words' encoding is written by then, and what was asked is gone."""
    calls, kept = [], set(storage._WRITTEN)
    new = lambda: [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage._WRITTEN if p not in kept and "/piece-" in p]
    monkeypatch.setattr(corpus_pipeline, "give_back_heaps", lambda _: calls.append(new()))
    corpus_pipeline.pieces(spark, table(spark, SF, "documents"), SF)
    assert calls == [[], ["piece-replies"], ["piece-replies"]]
