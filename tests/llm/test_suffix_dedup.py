import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotspark.llm import blocks as B
from ballotspark.llm import suffix_dedup as S
from tests.llm.conftest import collected


def brute(rows, length):
    least: dict[bytes, int] = {}
    for i, t in rows:
        b, k = (t or "").encode(), S.LAST_ID if i is None else i
        for s in range(len(b) - length + 1):
            g = b[s : s + length]
            least[g] = min(least.get(g, S.LAST_ID), k)
    out = []
    for i, t in rows:
        b, k = (t or "").encode(), S.LAST_ID if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < k:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("chunk", [1 << 11, 1 << 22])
def test_as_brute_force(docs, rows, chunk):
    got = collected(S.remove_repeats(docs, 50, chunk), *COLUMNS)
    assert got == brute(rows, 50)
    assert sum(r[2] for r in got) > 1000


def test_segments(docs, rows, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 64)
    assert collected(S.remove_repeats(docs.where("doc_id < 60"), 50), *COLUMNS) == brute([r for r in rows if r[0] is not None and r[0] < 60], 50)


@pytest.mark.parametrize("length", [2, 10, 30, 84])
def test_pieces_of_one_text(spark, length):
    rnd = random.Random(length)
    words = ["".join(rnd.choices("abcdef", k=rnd.randrange(1, 9))) for _ in range(12)]
    base = " ".join(rnd.choices(words, k=300))
    rows = []
    for i in range(60):
        cut = [rnd.randrange(len(base)) for _ in range(rnd.randrange(1, 4))]
        rows.append((i, "".join(base[p : p + rnd.randrange(1, 200)] + rnd.choice(["", "é", "zz"]) for p in cut)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert collected(S.remove_repeats(df, length, 1 << 12), *COLUMNS) == brute(rows, length)


def test_empty_table_and_other_columns(docs, none):
    assert S.remove_repeats(none).count() == 0
    clash = docs.withColumn("chunk", F.lit(1)).withColumn("data", F.lit("x")).withColumn("n_bytes", F.lit(2))
    assert collected(S.remove_repeats(clash), *COLUMNS) == collected(S.remove_repeats(docs), *COLUMNS)


def test_kept_bytes(docs):
    for r in S.remove_repeats(docs, keep_text=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_suffix_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.arange(300)
    stop = np.minimum(start + rng.integers(1, 60, 300), 400)
    group = np.sort(rng.integers(0, 5, 300))
    order = S.suffix_sort(data, B.prefix_hashes(data), start, stop, group)
    raw = data.tobytes()
    assert [raw[start[k] : stop[k]] for k in order] == [x for g in range(5) for x in sorted(raw[start[k] : stop[k]] for k in np.flatnonzero(group == g))]
