import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotspark.llm import blocks as B
from ballotspark.llm import quality_mil as Q
from ballotspark.llm import toxicity_cnn as T
from ballotspark.llm.fitting import auc
from ballotspark.llm.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return docs, labels, Q.train(docs, labels), T.train(docs, labels)


def held_out(scored, labels, column):
    rows = scored.where("held_out").join(labels, "doc_id").select("score", F.col(column).alias("y")).toPandas()
    return auc(rows["y"].to_numpy(), rows["score"].to_numpy())


def test_quality_on_held_out_rows(trained):
    docs, labels, quality, _ = trained
    assert held_out(Q.score(docs, quality), labels, "quality") > 0.93


def test_toxicity_on_held_out_rows(trained):
    docs, labels, _, toxicity = trained
    assert held_out(T.score(docs, toxicity), labels, "toxic") > 0.7


def test_labels_and_other_columns_are_no_inputs(trained, spark):
    docs, _, quality, toxicity = trained
    some = docs.orderBy("doc_id").limit(60)
    other = some.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("zz").alias("source"), F.lit(1).alias("score"), F.lit(True).alias("held_out"))
    for m, model in ((Q, quality), (T, toxicity)):
        a, b = ({r["doc_id"]: r["score"] for r in m.score(d, model).collect()} for d in (some, other))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_awkward_rows(trained, docs, rows):
    for m, model in ((Q, trained[2]), (T, trained[3])):
        got = m.score(docs, model).collect()
        assert len(got) == len(rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in got)


def test_empty_tables_and_one_class(trained, none, docs, spark):
    for m, model in ((Q, trained[2]), (T, trained[3])):
        assert m.score(none, model).count() == 0
        nobody = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        assert m.score(docs, m.train(docs, nobody)).where("score = 0.5").count() == docs.count()
        ones = spark.createDataFrame([(k, 1, 1) for k in range(40)] + [(None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
        assert m.score(docs, m.train(docs, ones)).where("score = 1").count() == docs.count()


def test_held_out_rows_teach_nothing(trained, spark):
    docs, labels, _, _ = trained
    from ballotspark.llm.tables import fold_of

    turned = labels.withColumn("quality", F.when(fold_of() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    some = docs.limit(80)
    a, b = ({r["doc_id"]: r["score"] for r in Q.score(some, Q.train(docs, y)).collect()} for y in (labels, turned))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_accepted_keeps_columns(trained, docs):
    kept = Q.accepted(docs, trained[2])
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, (r["doc_id"] for r in Q.score(docs, trained[2]).where("predicted = 1").collect())))


def test_attention_finds_the_passage():
    """A small bag problem that attention solves: one passage in a bag decides. Few features carry noise, as 300 bags
    can't tell many apart."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 9, 400)
    first = np.cumsum(sizes) - sizes
    x = np.zeros((sizes.sum(), Q.WIDTH), np.float32)
    x[:, :6] = rng.standard_normal((len(x), 6))
    y = rng.integers(0, 2, 400).astype(np.float32)
    for k, (f, s) in enumerate(zip(first, sizes, strict=True)):
        x[f : f + s, 0] = -1
        if y[k]:
            x[f + rng.integers(s), 0] = 4
    model = Q.fit(x[: first[300]], first[:300], y[:300], epochs=60)
    rest = Q.forward(model, x[first[300] :], first[300:] - first[300])["score"]
    assert auc(y[300:], rest) > 0.97


def test_windows_stay_within_a_text():
    p = T.fit([np.arange(8, dtype=np.int32).reshape(4, 2), np.arange(8, 16, dtype=np.int32).reshape(4, 2)] * 8, np.array([1, 0] * 8, np.float32), epochs=2)
    ids = np.random.default_rng(0).integers(0, T.BUCKETS, (4, 50)).astype(np.int32)
    sizes = np.array([0, 1, 2, 0, 30, 17, 0])
    together = T.predict(p, ids, sizes)
    cut = np.cumsum(sizes)
    alone = np.concatenate([T.predict(p, ids[:, b - s : b], np.array([s])) for b, s in zip(cut, sizes, strict=True)])
    assert np.allclose(together, alone, atol=1e-6)


def test_thresholds_by_language():
    y, lang = np.array([0] * 30 + [1] * 30 + [1]), np.array(["a"] * 60 + ["b"])
    s = np.concatenate([np.linspace(0, 0.2, 30), np.linspace(0.3, 0.9, 30), [0.1]])
    got = T.calibrated(y, s, lang)
    assert 0.2 < got["a"] < 0.3 and "b" not in got and "" in got


def doubles(p):
    return {k: np.asarray(v, np.float64) if isinstance(v, np.ndarray) else v for k, v in p.items()}


def steps(loss, p, names, grads, rng, tries=12, eps=1e-6):
    """Finite differences against gradients, at some places of each parameter."""
    for k in names:
        flat, g = p[k].reshape(-1), grads[k].reshape(-1)
        for i in rng.integers(0, flat.size, tries):
            was = flat[i]
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert np.isclose((up - down) / (2 * eps), g[i], rtol=1e-4, atol=1e-7), (k, i)


def test_attention_gradients_are_the_loss_s():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 4, 2, 7])
    first, y = np.cumsum(sizes) - sizes, np.array([0.0, 1.0, 1.0, 0.0])
    x = rng.standard_normal((sizes.sum(), Q.WIDTH))
    p = doubles(Q.fit(x.astype(np.float32), first, y.astype(np.float32), epochs=3))

    def loss():
        s = Q.forward(p, x, first)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    steps(loss, p, ("c", "c0", "w", "V", "U", "W", "b"), Q.gradients(p, x, first, y), rng)


def test_filters_gradients_are_the_loss_s():
    rng = np.random.default_rng(5)
    sizes, y, weight = np.array([3, 0, 9, 1, 6]), np.array([1.0, 0.0, 0.0, 1.0, 1.0]), np.array([2.0, 1.0, 1.0, 2.0, 1.0])
    ids = rng.integers(0, 40, (4, sizes.sum())).astype(np.int32)
    cut = np.cumsum(sizes)
    p = doubles(T.fit([ids[:, b - n : b] for b, n in zip(cut, sizes, strict=True)], y.astype(np.float32), epochs=2))

    def loss():
        s = T.predict(p, ids, sizes)
        return -((y * np.log(s) + (1 - y) * np.log(1 - s)) * weight).mean()

    grads, de = T.gradients(p, ids, sizes, y, weight)
    for i in range(4):
        grads[f"E{i}"] = np.zeros_like(p[f"E{i}"])
        np.add.at(grads[f"E{i}"], ids[i], de)
    steps(loss, p, ("c", "c0", "K0", "K1", "K2", "b0", "b1", "b2"), grads, rng)
    for i in range(4):  # at words that occur
        view = {"E": p[f"E{i}"][:40]}
        steps(loss, view, ("E",), {"E": grads[f"E{i}"][:40]}, rng)


MASK = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_hash(word):
    return plain_mix(sum(int(B.LOWER_VALUES[b]) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word)) & MASK)


def plain_quality(model, text):
    """Passage by passage, in loops."""
    raw = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    groups = [found[k : k + Q.PASSAGE] for k in range(0, len(found), Q.PASSAGE)] or [[]]
    edge = [0, *(g[0][0] for g in groups[1:]), len(raw)]
    hidden, logit = [], []
    for g, a, b in zip(groups, edge[:-1], edge[1:], strict=True):
        x, part = np.zeros(Q.WIDTH), raw[a:b]
        for byte in part:
            x[Q.CLASS[byte]] += 1 / len(part)
        if g:
            own = [raw[s:e] for s, e in g]
            h, n = [plain_hash(w) for w in own], len(own)
            extra = [math.log1p(n), sum(map(len, own)) / n, (sum(len(w) ** 2 for w in own) / n) ** 0.5, sum(u == v for u, v in zip(h, h[1:], strict=False)) / n, len(set(h)) / n]
            extra.append(sum(any(Q.CLASS[c] not in (33, 34, 38) for c in w) for w in own) / n)
            x[Q.CLASSES : Q.CLASSES + 6] = extra
            for v in h:
                x[Q.CLASSES + 6 + v % Q.HASHED] += 1 / n
        x = (x - model["mean"]) * model["scale"]
        h = np.tanh(x @ model["W"] + model["b"])
        hidden.append(h)
        logit.append(float((np.tanh(h @ model["V"]) / (1 + np.exp(-(h @ model["U"])))) @ model["w"]))
    weight = [math.exp(v - max(logit)) for v in logit]
    z = sum(w / sum(weight) * h for w, h in zip(weight, hidden, strict=True))
    return 1 / (1 + math.exp(-float(z @ model["c"] + model["c0"][0])))


def plain_toxicity(model, text):
    raw = (text or "").encode()
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    e = []
    for w in found:
        h = plain_hash(w)
        keys = [h, h >> 32, plain_hash(w[:4]), plain_hash(w[:6])]
        e.append(sum(model[f"E{i}"][k % T.BUCKETS].astype(float) for i, k in enumerate(keys)))
    total = float(model["c0"][0])
    for k, width in enumerate(T.WIDTHS):
        for f in range(T.FILTERS):
            best = 0.0
            for s in range(len(e)):
                best = max(best, float(model[f"b{k}"][f]) + sum(float(e[s + j] @ model[f"K{k}"][j][:, f]) for j in range(width) if s + j < len(e)))
            total += best * float(model["c"][k * T.FILTERS + f])
    return 1 / (1 + math.exp(-total))


def test_scores_as_plain_loops(trained, spark):
    docs, _, quality, toxicity = trained
    some = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 3000").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(60).collect()]
    some += [(-1, None), (-2, ""), (-3, "\n "), (-4, "One  a a\tA\u00e9\u4e2d! " * 50)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    for m, model, plain in ((Q, quality, plain_quality), (T, toxicity, plain_toxicity)):
        got = {r["doc_id"]: r["score"] for r in m.score(df, model).collect()}
        for i, t in some:
            assert abs(got[i] - plain(model, t)) < 1e-4, (m.__name__, i)


def test_thresholds_are_of_rows_held_back(spark):
    """A word says how likely it is; one language is toxic far more often, and does best with a lower threshold."""
    rnd = np.random.default_rng(1)
    odds = {"aa": [0.3, 0.5, 0.7, 0.8, 0.9, 0.95], "bb": [0.01, 0.02, 0.05, 0.2, 0.5, 0.9]}
    rows, labels = [], []
    for i in range(3000):
        lang, s = "aa" if i % 2 else "bb", int(rnd.integers(0, 6))
        rows.append((i, " ".join(f"w{k}" for k in rnd.integers(0, 300, 6)) + f" vile{s}", lang))
        labels.append((i, int(rnd.random() < odds[lang][s])))
    model = T.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model["thresholds"]["aa"] < model["thresholds"]["bb"] - 0.1


def test_the_sample_is_bounded_in_bytes(spark):
    from ballotspark.llm.fitting import labelled

    docs = spark.createDataFrame([(k, "x" * 1000) for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    assert labelled(docs, labels, "quality", 100, 10_500).count() == 10
    assert labelled(docs, labels, "quality", 100, 1).count() == 1
    assert labelled(docs, labels, "quality", 7).count() == 7
