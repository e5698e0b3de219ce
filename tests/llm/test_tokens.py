import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ballotspark.llm import bpe_transducer as T
from ballotspark.llm import sentencepiece_lattice as P
from tests.llm.conftest import collected


@pytest.fixture(scope="module")
def library(model_file):
    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def odd_texts():
    rnd = random.Random(5)
    out = ["", " ", "  ", "a", " a  b\n\nc\t中文☃<s></s><unk><0x0A>", "▁x▁▁y", "a\0b", "a" * 700, "    " * 60, "x = 1;\n        return   y\n" * 5, "1234567890" * 9, "ﬁ é é", "\U0001f600 hi", "thethe" * 40]
    return out + ["".join(rnd.choice("abcdeth \n▁ e1.é") for _ in range(rnd.randrange(1, 200))) for _ in range(800)]


def test_counts_are_the_librarys(library, model_file):
    t = T.Transducer(T.Vocabulary(model_file))
    assert [t.count(x) for x in odd_texts()] == [len(library.encode(x)) for x in odd_texts()]


def test_chunk_maps_compose(library, model_file):
    t = T.Transducer(T.Vocabulary(model_file))
    for size in (1, 2, 7, 50):
        for x in filter(None, odd_texts()[:200]):
            maps = [t.chunk_map(*c) for c in T.chunks(x, size)]
            assert t.scan(maps) == len(library.encode(x))


def test_chunk_maps_hold_for_any_entry_state(library, model_file):
    """With no character before them to go by, maps still take every state to where reading goes; any bracketing does."""
    t, rnd = T.Transducer(T.Vocabulary(model_file)), random.Random(2)
    for x in filter(None, odd_texts()[:200]):
        maps = [t.chunk_map(c, "") for c, _ in T.chunks(x, 5)]
        assert t.scan(maps) == len(library.encode(x))
        while len(maps) > 1:
            k = rnd.randrange(len(maps) - 1)
            maps[k : k + 2] = [t.compose(maps[k], maps[k + 1])]
        whole = T.spaced(x)
        assert t.apply(maps[0], T.START) == t.read(whole)
        entry = t.read("▁anoth")[0]
        assert t.apply(maps[0], entry) == t.read(whole, entry)


def test_small_tables(library, model_file):
    t = T.Transducer(T.Vocabulary(model_file), most_states=10, most_words=10)
    assert [t.count(x) for x in odd_texts()[:100]] == [len(library.encode(x)) for x in odd_texts()[:100]]
    assert t.count("abcdefghij" * 400) == len(library.encode("abcdefghij" * 400))
    assert len(t.states) <= 12


def test_pairs_are_stable_as_merging_says(model_file):
    v = T.Vocabulary(model_file)
    rnd, names = random.Random(1), list(v.id)
    pairs = [(a, b) for a, b in ((rnd.choice(names), rnd.choice(names)) for _ in range(40_000)) if a[-1] + b[0] in v.inner]
    assert [v.stable(a, b) for a, b in pairs] == [v.merges(a + b) == [a, b] for a, b in pairs]


def test_count_table(docs, rows, library, model_file, none):
    got = collected(T.count_tokens(docs.withColumn("n_tokens", F.lit("x")), model_file), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in rows), key=repr)
    assert T.count_tokens(none, model_file).count() == 0


@pytest.mark.parametrize("chunk", [3, 100])
def test_texts_in_chunks_of_other_tasks(docs, rows, library, model_file, chunk):
    few = docs.where("doc_id is null or doc_id < 40 or (doc_id > 9000 and doc_id <> 9004)")
    got = collected(T.count_tokens(few, model_file, chunk=chunk), "doc_id", "n_bytes", "n_tokens")
    assert got == sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows if i is None or i < 40 or (i > 9000 and i != 9004)), key=repr)


def test_encoding_and_decoding(docs, rows, library, model_file):
    got = P.decode(P.encode(docs.withColumn("ids", F.lit(1)).withColumn("chunk", F.lit("x")), model_file, 1 << 14), model_file)
    assert sorted(((r["doc_id"], list(r["ids"]), r["text"]) for r in got.collect()), key=repr) == sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows), key=repr)


def test_odd_texts_round_trip(spark, library, model_file):
    df = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    for r in P.decode(P.encode(df, model_file), model_file).collect():
        t = odd_texts()[r["doc_id"]]
        assert list(r["ids"]) == library.encode(t)
        assert r["text"] == t.replace("▁", " ")


def test_words_without_a_cut(spark, library, model_file):
    """Words of several segments and steps are folded in the lattice as others are."""
    rnd, n = random.Random(3), P.LONG
    texts = ["ha" * 9000, "a" * n, "a" * (n + 1), "a" * (3 * n), "internationalisation" * 200 + " tail", " " * 3000, "".join(rnd.choice("aeinrst") for _ in range(30_000)), "a" * (n + 1) + " " + "a" * (n + 1)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGH+/") for _ in range(20_000)), "\0" + P.name(b"a" * (n + 1)).decode(), "и" * 2000 + "ß"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in P.decode(P.encode(df, model_file), model_file).collect():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]]), r["doc_id"]
        assert r["text"] == texts[r["doc_id"]]


def test_segments_cover_a_word(model_file):
    longest = P.vocabulary(model_file).longest
    word = bytes(97 + k % 26 for k in range(5 * P.LONG + 7))
    parts = list(P.segments(word, longest))
    assert len({p[0] for p in parts}) == 1 and sum(p[2] for p in parts) == len(word)
    assert {(base + s, text[s : s + longest]) for _, base, n, text in parts for s in range(n)} == {(s, word[s : s + longest].decode()) for s in range(len(word))}


def test_decode_any_ids(spark, library, model_file):
    df = spark.createDataFrame([(1, [5, 300, 29871]), (2, []), (3, None), (4, [1, 450, 2])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in P.decode(df, model_file).collect()}
    assert got == {1: library.decode([5, 300, 29871]), 2: "", 3: None, 4: library.decode([1, 450, 2])}


def test_empty_table(none, model_file):
    assert P.encode(none, model_file).count() == 0


def test_workers_give_memory_back():
    """What a chunk's work has freed goes back to the system, also below something that is still held."""
    import psutil

    from ballotspark.llm import chunks as C

    held = [bytes(3000) for _ in range(50_000)]
    last, used = held[-1], psutil.Process().memory_info().rss
    del held
    C.give_back()
    assert len(last) == 3000 and psutil.Process().memory_info().rss < used - 100_000_000


def test_heads_bound_every_piece(spark, model_file):
    """A position's substrings are exploded up to what its first characters allow, no longer."""
    v = P.vocabulary(model_file)
    most = {r["head"]: r["most"] for r in P.heads(spark, v).collect()}
    assert all(len(p) <= most.get(p[: P.HEAD], P.HEAD - 1) for p in v.id)
    text = "▁international"
    assert sum(min(most.get(text[k : k + P.HEAD], P.HEAD - 1), len(text) - k) for k in range(len(text))) < 0.8 * len(text) * (len(text) + 1) / 2


def test_pairs_are_worked_out_once(model_file, monkeypatch):
    v = P.vocabulary(model_file)
    ids = np.array(sorted(v.id.values()))[:: len(v.id) // 60]
    pairs = np.sort((ids[:, None] << P.BITS | ids).ravel())
    names = P.piece_names(model_file)
    want = [v.stable(names[p >> P.BITS], names[p & (1 << P.BITS) - 1]) for p in pairs.tolist()]
    for most in (1 << 20, 1000):
        monkeypatch.setattr(P, "MOST_PAIRS", most)
        monkeypatch.setattr(P, "_PAIRS", {})
        for part in (slice(0, None, 3), slice(1, None, 2), slice(None)):
            assert P.stable_pairs(model_file, pairs[part]).tolist() == want[part]
    monkeypatch.setattr(P, "MOST_PAIRS", 1 << 20)
    P.stable_pairs(model_file, pairs)
    monkeypatch.setattr(v, "apart", None)
    assert P.stable_pairs(model_file, pairs[::5]).tolist() == want[::5]
