from ballotspark.streaming.votes import arriving, running_votes


def test_votes_resume(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    seen = {}

    def keep(batch, _):
        seen.update({(r["id"], r["ans"]): r["n"] for r in batch.collect()})

    def run():
        q = running_votes(arriving(spark, str(source))).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        q.awaitTermination()

    (source / "a.json").write_text('{"id":"p","outputs":["\\\\boxed{3}","so 3","none"]}\n')
    run()
    assert seen == {("p", "3"): 2, ("p", None): 1}
    (source / "b.json").write_text('{"id":"p","outputs":["\\\\boxed{4}","so 3"]}\n{"id":"q","out')
    run()
    assert seen == {("p", "3"): 3, ("p", "4"): 1, ("p", None): 1}
