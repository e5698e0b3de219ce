import numpy as np
from pyspark.sql import functions as F

from ballotspark.llm import line_dedup as L
from tests.llm.conftest import collected


def brute(rows, least):
    from collections import Counter

    held = Counter(k for _, t in rows for k in set(L.keys((t or "").encode())) if k)
    out = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if not x.strip().lower() or held[x.strip().lower()] < least]
        out.append((i, b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_as_brute_force(docs, rows):
    got = collected(L.dedup(docs, L.build(docs)), "doc_id", "text", "n_lines", "n_dropped")
    assert got == brute(rows, 10)
    assert sum(r[3] for r in got) > 10


def test_keys_go_to_the_filters(docs, rows, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 1)
    monkeypatch.setattr(L, "SALT_BYTES", 1 << 12)
    odd = docs.withColumn("t1", F.lit(1)).withColumn("t2", F.lit(2)).withColumn("__drop", F.lit(3)).withColumn("a b.c", F.lit("x"))
    for least in (2, 10):
        state = L.build(odd, min_docs=least)
        got = L.dedup(odd, state, broadcast_bytes=0)
        assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
        assert collected(got, "doc_id", "text", "n_lines", "n_dropped") == brute(rows, least)
        assert got.where("t1 = 1 AND t2 = 2 AND __drop = 3 AND `a b.c` = 'x'").count() == len(rows)


def test_state_is_kept(spark, docs, rows, tmp_path):
    some, rest = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0 OR doc_id IS NULL")
    L.save(L.build(some, min_docs=4), f"{tmp_path}/state")
    back = L.insert(L.load(spark, f"{tmp_path}/state"), rest)
    assert collected(L.dedup(docs, back), "doc_id", "text", "n_lines", "n_dropped") == brute(rows, 4)


def test_deleting_what_never_came(docs):
    some, rest = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0 OR doc_id IS NULL")
    state = L.build(some, min_docs=4)
    less = L.delete(state, rest)
    assert less.refs.where("n < 0").count() > 0
    assert collected(L.insert(less, rest).refs, "hi", "lo", "n") == collected(state.refs, "hi", "lo", "n")


def test_sets_of_keys():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 9, (2, 60)).astype(np.uint64)
    held = set(zip(hi[:30].tolist(), lo[:30].tolist(), strict=True))
    assert L.Keys(hi[:30], lo[:30]).holds(hi, lo).tolist() == [x in held for x in zip(hi.tolist(), lo.tolist(), strict=True)]
    assert not L.Keys(hi[:0], lo[:0]).holds(hi, lo).any()


def test_many_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 1)
    state = L.build(docs, min_docs=2)
    assert state.shards > 3
    assert collected(L.dedup(docs, state), "doc_id", "text", "n_lines", "n_dropped") == brute(rows, 2)


def test_insertions_and_deletions_are_reversible(docs, rows):
    some, rest = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0 OR doc_id IS NULL")
    state = L.build(some, min_docs=4)
    refs = collected(state.refs, "hi", "lo", "n")
    more = L.insert(state, rest)
    assert collected(more.refs, "hi", "lo", "n") == collected(L.build(docs, min_docs=4).refs, "hi", "lo", "n")
    assert collected(L.dedup(docs, more), "doc_id", "text", "n_lines", "n_dropped") == brute(rows, 4)
    back = L.delete(more, rest)
    assert collected(back.refs, "hi", "lo", "n") == refs
    mine = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    assert collected(L.dedup(some, back), "doc_id", "text", "n_lines", "n_dropped") == brute(mine, 4)


def test_columns_stay_and_clashing_ones_are_replaced(docs):
    clash = docs.withColumn("n_lines", F.lit("x")).withColumn("hi", F.lit(1)).withColumn("salt", F.lit(2))
    got = L.dedup(clash, L.build(clash))
    assert got.columns == [*docs.columns, "hi", "salt", "n_lines", "n_dropped"]
    assert collected(got, "doc_id", "n_dropped") == collected(L.dedup(docs, L.build(docs)), "doc_id", "n_dropped")


def test_empty_table(none):
    assert L.dedup(none, L.build(none)).count() == 0
    assert L.dedup(none, L.build(none), -1).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    hi, lo = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    f = L.CuckooFilter.of(hi, lo)
    assert f.contains(hi, lo).all()
    for a, b in zip(hi[:2500], lo[:2500], strict=True):
        f.delete(int(a), int(b))
    assert f.contains(hi[2500:], lo[2500:]).all()
    assert f.contains(hi[:2500], lo[:2500]).mean() < 0.01
    again = L.CuckooFilter.load(f.dump())
    assert (again.table == f.table).all()


def test_shards_in_python_and_spark(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-(1 << 62), 1 << 62, (200, 2))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in a], "hi long, lo long")
    want = {(r["hi"], r["lo"]): r["s"] for r in df.select("hi", "lo", L._shard(7).alias("s")).collect()}
    got = L.shard_of(a.view(np.uint64), 7)
    assert [want[(int(x), int(y))] for x, y in a] == got.tolist()


def colliding(state, template: str) -> bytes:
    """A key that the only filter holds though it never was inserted."""
    (held,) = [L.CuckooFilter.load(bytes(r["data"])) for r in state.filters.collect()]
    for start in range(0, 2_000_000, 50_000):
        names = [(template % k).encode() for k in range(start, start + 50_000)]
        d = np.array([L.digest(x) for x in names], np.uint64)
        if len(found := np.flatnonzero(held.contains(d[:, 0], d[:, 1]))):
            return names[found[0]]
    raise AssertionError("no key collides")


def test_keys_that_the_counts_lack_stay(spark):
    """Of documents outside the state, of deleted ones, and shorter than min_chars."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    known = frame([(k, "\n".join(f"a common line {j}" for j in range(3))) for k in range(4)])
    state = L.build(known, min_docs=3, min_chars=9)
    for template in ("new line %d", "%x"):
        key = colliding(state, template).decode()
        assert (len(key) < 9) == (template == "%x")
        new = frame([(10, f"{key}\na common line 1"), (11, f"{key}\nother")])
        want = [(10, key, 2, 1), (11, f"{key}\nother", 2, 0)]
        back = L.delete(L.insert(state, new, min_chars=9), new, min_chars=9)
        for s in (state, back):
            for size in (L.BROADCAST_BYTES, 0):
                assert collected(L.dedup(new, s, size), "doc_id", "text", "n_lines", "n_dropped") == want
