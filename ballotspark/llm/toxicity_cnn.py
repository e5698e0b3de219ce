"""Toxicity by a convolutional text classifier over hashed word embeddings (operator 4).

A word's embedding is the sum of one row from each of four tables, picked by two independent hashes of the lower-cased
word and by the hashes of its first 4 and 6 bytes: words share a whole embedding only if they collide twice, and words
of one stem share a part. Filters of several widths run over the whole
text, each keeps its maximum, and a logistic unit scores the maxima. Trained in numpy by Adam. A seventh of the
labelled rows, chosen by hash, teaches the net nothing: on these a threshold for each language is calibrated. The
language is never an input of a score.
"""

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotspark.llm import blocks as B
from ballotspark.llm.fitting import Adam, labelled, sigmoid
from ballotspark.llm.tables import fold_of

TABLES, BUCKETS, DIM, WIDTHS, FILTERS = 4, 1 << 15, 8, (1, 2, 3), 6
#: Letters, digits and everything that isn't ASCII; marks around a word don't count.
INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (tables x words), and the number of words of each row."""
    starts, ends, row = B.word_ranges(data, at, INSIDE)
    prefix = B.prefix_hashes(data, B.LOWER_VALUES)
    h = B.mix(B.range_hashes(prefix, starts, ends))
    keys = [h, h >> np.uint64(32), *(B.mix(B.range_hashes(prefix, starts, np.minimum(ends, starts + n))) for n in (4, 6))]
    return np.stack([(k & np.uint64(BUCKETS - 1)).astype(np.int32) for k in keys]), np.bincount(row, minlength=len(at) - 1)


def embedded(p: dict, ids: np.ndarray) -> np.ndarray:
    e = p["E0"][ids[0]]
    for i in range(1, TABLES):
        e += p[f"E{i}"][ids[i]]
    return e


def pooled(p: dict, e: np.ndarray, sizes: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Maxima (rows x filters) of max(0, filter); a window may reach past a text's end, over zeros. With `where`,
    also the word at which each maximum begins."""
    out, places = np.zeros((len(sizes), len(WIDTHS) * FILTERS), e.dtype), []
    full = np.flatnonzero(sizes)
    if not len(full):
        return out, [np.zeros((0, FILTERS), np.int64) for _ in WIDTHS]
    begin = (np.cumsum(sizes) - sizes)[full]
    last = begin + sizes[full] - 1
    for k, width in enumerate(WIDTHS):
        y = e @ p[f"K{k}"][0] + p[f"b{k}"]
        for j in range(1, width):
            z = e @ p[f"K{k}"][j]
            for back in range(j):  # the next text's first words aren't this one's
                z[np.minimum(begin + back, last)] = 0
            y[:-j] += z[j:]
        top = np.maximum.reduceat(y, begin, axis=0)
        out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
        if where:
            of = np.repeat(np.arange(len(full)), sizes[full])
            hit = y == top[of]
            place = np.zeros(top.shape, np.int64)
            for f in range(FILTERS):
                i = np.flatnonzero(hit[:, f])[::-1]
                place[of[i], f] = i  # the first of equal ones
            places.append(place)
    return out, places


def gradients(p: dict, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of the mean weighted log loss of these texts: by parameter, and by word for the embeddings."""
    e = embedded(p, ids)
    m, places = pooled(p, e, sizes, True)
    ds = ((sigmoid(m @ p["c"] + p["c0"]) - y) * weight / len(sizes)).astype(e.dtype)
    grads = {"c": m.T @ ds, "c0": ds.sum(keepdims=True)}
    dm = ds[:, None] * p["c"] * (m > 0)
    full = np.flatnonzero(sizes)
    stop = np.cumsum(sizes)[full]
    de = np.zeros_like(e)
    for k, width in enumerate(WIDTHS):
        g = dm[full, k * FILTERS : (k + 1) * FILTERS]
        grads[f"b{k}"] = g.sum(0)
        dk = np.zeros_like(p[f"K{k}"])
        for j in range(width):
            at = places[k] + j
            inside = at < stop[:, None]
            d, f = np.nonzero(inside & (g != 0))
            at = at[d, f]
            np.add.at(dk[j].T, f, g[d, f][:, None] * e[at])
            np.add.at(de, at, g[d, f][:, None] * p[f"K{k}"][j][:, f].T)
        grads[f"K{k}"] = dk
    return grads, de


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 1e-2, seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    p = {f"E{i}": (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32) for i in range(TABLES)}
    for k, width in enumerate(WIDTHS):
        p[f"K{k}"] = (rng.standard_normal((width, DIM, FILTERS)) / np.sqrt(width * DIM)).astype(np.float32)
        p[f"b{k}"] = np.zeros(FILTERS, np.float32)
    p["c"] = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
    p["c0"] = np.full(1, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), np.float32)
    dense = Adam({k: v for k, v in p.items() if k[0] != "E"}, rate)
    seen = {i: np.full((BUCKETS, 1), 1e-4, np.float32) for i in range(TABLES)}  # Adagrad by row: a batch touches few
    weight = np.where(y == 1, np.sqrt((1 - y.mean()) / max(y.mean(), 1e-3)), 1).astype(np.float32)
    for epoch in range(epochs):
        dense.rate = rate * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(y))
        for low in range(0, len(y), batch):
            rows = order[low : low + batch]
            sizes = np.array([docs[r].shape[1] for r in rows])
            ids = np.concatenate([docs[r] for r in rows], axis=1)
            grads, de = gradients(p, ids, sizes, y[rows], weight[rows])
            for k in grads:
                if k[0] == "K" or k == "c":
                    grads[k] += 1e-4 * p[k]
            dense.step(grads)
            used = np.flatnonzero(de.any(1))
            for i, h in enumerate(ids):
                rows_of, inverse = np.unique(h[used], return_inverse=True)
                g = np.zeros((len(rows_of), DIM), np.float32)
                np.add.at(g, inverse, de[used])
                seen[i][rows_of] += (g * g).mean(1, keepdims=True)
                p[f"E{i}"][rows_of] -= 0.1 * g / np.sqrt(seen[i][rows_of])
    return p


def predict(p: dict, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return sigmoid(pooled(p, embedded(p, ids), sizes)[0] @ p["c"] + p["c0"])


def calibrated(y: np.ndarray, score: np.ndarray, lang: np.ndarray, least: int = 20) -> dict[str, float]:
    """By language the threshold of best F1; the one over all for languages with fewer than `least` rows of a class."""

    def best(rows: np.ndarray) -> float:
        order = np.argsort(-score[rows], kind="stable")
        s, hits = score[rows][order], np.cumsum(y[rows][order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + y[rows].sum())
        f1[:-1][s[:-1] == s[1:]] = -1  # equal scores stay together
        k = int(f1.argmax())
        return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])

    out = {"": best(np.arange(len(y)))}
    for x in sorted(set(lang.tolist()) - {""}):
        rows = np.flatnonzero(lang == x)
        if min(y[rows].sum(), (1 - y[rows]).sum()) >= least:
            out[x] = best(rows)
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = 8000) -> dict:
    """Learned from at most `most` labelled rows outside the held-out fold, their whole texts as bucket numbers. Rows
    whose crc32(id) // 5 mod 7 is 0 are for the thresholds alone.

    With no labelled row, or labels of one class only, the score is that class's share (0.5 without labels).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in B.doc_blocks(batches):
            ids, sizes = words(data, at)
            x = [v.tobytes() for v in np.split(ids, np.cumsum(sizes)[:-1], axis=1)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), rows.column("lang"), pa.array(x, pa.binary())], ["doc_id", "y", "lang", "x"])

    rows = labelled(docs, labels, "toxic", most)
    got = rows.select("doc_id", "text", F.col("y").cast("int").alias("y"), "lang").mapInArrow(encode, f"doc_id {dict(rows.dtypes)['doc_id']}, y int, lang string, x binary").toArrow().sort_by("doc_id")
    y = np.array(got["y"].to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5, "thresholds": {"": 0.5}}
    docs_in = [np.frombuffer(v, np.int32).reshape(TABLES, -1) for v in got["x"].to_pylist()]
    apart = np.array([crc32(str(i).encode()) // 5 % 7 == 0 for i in got["doc_id"].to_pylist()])
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        return fit(docs_in, y) | {"thresholds": {"": 0.5}}  # too few rows to hold some back
    p = fit([x for x, a in zip(docs_in, apart, strict=True) if not a], y[~apart])
    s = np.concatenate([predict(p, x, np.array([x.shape[1]])) for x, a in zip(docs_in, apart, strict=True) if a])
    return p | {"thresholds": calibrated(y[apart], s, np.array([x or "" for x in got["lang"].to_pylist()])[apart])}


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, and by the calibrated thresholds lang_threshold and predicted_by_lang.

    Over every row of docs (doc_id, text, lang where there is one; others are ignored). Null and empty texts have no
    maxima and get the score of the bias; long texts are read whole. A null or unknown language takes the threshold over all languages.
    Repeated rows each give a row; an empty table gives none.
    """
    model = dict(model)
    by_lang = model.pop("thresholds")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in B.doc_blocks(batches):
            s = np.full(rows.num_rows, model["share"]) if "share" in model else predict(model, *words(data, at))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), rows.column("lang"), pa.array(np.clip(s, 0, 1).astype(np.float64))], ["doc_id", "held_out", "lang", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    out = docs.select("doc_id", "text", (fold_of() == 0).alias("held_out"), lang.alias("lang")).mapInArrow(scores, f"doc_id {kind}, held_out boolean, lang string, score double")
    limit = F.lit(by_lang[""])
    for x, t in by_lang.items():
        limit = F.when(F.col("lang") == x, t).otherwise(limit) if x else limit
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), limit.alias("lang_threshold"), (F.col("score") >= limit).cast("int").alias("predicted_by_lang"))
