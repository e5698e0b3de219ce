import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ballotspark.llm import backoff_lm as M
from ballotspark.llm.tables import fold_of


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute_order(rows, order, m):
    """A dictionary of states: each has its arcs and a failure arc; one token after another."""
    counts, begins = Counter(), 0
    for i, t in rows:
        if not held(i):
            x = ["begin", *tokens(t)]
            counts.update(tuple(x[a : a + k]) for k in range(1, order + 1) for a in range(len(x) - k + 1) if k > 1 or a)
            begins += 1
    one = {g[0]: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)
    seen = lambda h: begins if h == ("begin",) else counts[h]

    def p(h, w):
        return (counts[(*h, w)] + m * p(h[1:], w)) / (seen(h) + m) if h else (one.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))

    out = []
    for i, t in rows:
        state, total = ("begin",), 0.0
        for w in tokens(t):
            while state and not counts[(*state, w)]:
                total += math.log10(m / (seen(state) + m))
                state = state[1:]
            total += math.log10(p(state, w))
            state = (*state, w)[-(order - 1) :]
            while state and not seen(state):
                state = state[1:]
        out.append((i, total))
    return sorted(out, key=repr)


def test_longer_histories(docs, rows):
    for order, prior, chunk in ((3, 0.5, 1 << 12), (4, 2.0, 1 << 23), (2, 8.0, 1 << 23)):
        got = sorted(((r["doc_id"], r["score"]) for r in M.scores(docs, fold_of() != 1, prior, chunk, order).collect()), key=repr)
        want = brute_order(rows, order, prior)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)


def brute(rows):
    one, two, begins = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            x = tokens(t)
            one.update(x)
            two.update(zip(["begin", *x], x, strict=False))
            begins += 1
    n, v, m = sum(one.values()), len(one), M.PRIOR
    out = []
    for i, t in rows:
        x = tokens(t)
        p = [(one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in x]
        score = sum(math.log10((two[(a, w)] + m * q) / ((begins if a == "begin" else one[a]) + m)) for a, w, q in zip(["begin", *x], x, p, strict=False))
        out.append((i, len(x), sum(one[w] > 0 for w in x), n, sum(map(math.log10, p)), score))
    return sorted(out, key=repr)


def test_as_brute_force(docs, rows):
    for chunk in (1 << 12, 1 << 23):
        got = sorted((tuple(r) for r in M.scores(docs.withColumn("learn", F.lit("x")), fold_of() != 1, chunk_bytes=chunk).collect()), key=repr)
        want = brute(rows)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    from ballotspark.llm.tables import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    r = M.scores(docs, fold_of() != 1).where(fold_of() == 1).agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_weights_sum_to_one():
    """Over the whole vocabulary and the reserved unknown token, after a known and an unknown history."""
    vocabulary = [b"a", b"b", b"c", None]
    one, two = Counter({b"a": 3, b"b": 2, b"c": 1, None: 2}), Counter({(b"a", b"b"): 2, (b"a", None): 1})
    n, v, m = 8, 4, M.PRIOR
    p = {w: (one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in [*vocabulary, b"unknown"]}
    for history in (b"a", b"zz"):
        assert math.isclose(sum((two[(history, w)] + m * q) / (one[history] + m) for w, q in p.items()), 1)


def test_empty_table_and_nothing_to_learn(docs, none):
    assert M.scores(none, fold_of() != 1).count() == 0
    got = M.scores(docs, F.lit(False)).collect()
    assert len(got) == docs.count() and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
