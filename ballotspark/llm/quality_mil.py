"""Quality classifier by attention-based multiple-instance learning (operator 2).

A document is a bag of passages of 64 words, over its whole text. A passage is encoded from what it looks like
(shares of byte classes, word lengths, repetition, hashed words), through one learned tanh layer; a gated attention
network weighs the passages, and a logistic unit scores the weighted mean. Only documents have labels; which
passages speak for or against a document is learned from them.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotspark.llm import blocks as B
from ballotspark.llm.fitting import Adam, labelled, sigmoid
from ballotspark.llm.tables import fold_of

PASSAGE = 64
HASHED = 64
#: Byte classes: each ASCII punctuation mark its own, then digit, upper, lower, space, line end, other control, not ASCII.
CLASS = np.zeros(256, np.int64)
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
for _k, _b in enumerate(_marks):
    CLASS[_b] = _k
CLASS[48:58], CLASS[65:91], CLASS[97:123] = 32, 33, 34
CLASS[32], CLASS[10], CLASS[128:] = 35, 36, 38
CLASS[[*range(10), *range(11, 32), 127]] = 37
CLASSES = 39
WIDTH = CLASSES + 6 + HASHED


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages x WIDTH) and for each row the first passage's number; each row has at least one passage."""
    starts, ends, row = B.word_ranges(data, at)
    n_rows = len(at) - 1
    words = np.bincount(row, minlength=n_rows)
    count = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    x = np.zeros((first[-1], WIDTH), np.float32)
    if not len(data):
        return x, first[:-1]
    rank = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    of_word = first[row] + rank // PASSAGE
    # a passage's bytes reach from its first word to the next passage's; a row's first passage has its leading space
    begin = np.repeat(at[:-1], count)
    lead = rank % PASSAGE == 0
    begin[of_word[lead]] = np.where(rank[lead] == 0, at[:-1][row[lead]], starts[lead])
    n_bytes = np.diff(np.append(begin, at[-1]))
    of_byte = np.repeat(np.arange(len(begin)), n_bytes)
    x[:, :CLASSES] = np.bincount(of_byte * CLASSES + CLASS[data], minlength=len(begin) * CLASSES).reshape(-1, CLASSES)
    x[:, :CLASSES] /= np.maximum(1, n_bytes)[:, None]
    if not len(starts):
        return x, first[:-1]
    n = np.bincount(of_word, minlength=len(begin)).astype(np.float32)
    some = np.maximum(1, n)
    h = B.mix(B.range_hashes(B.prefix_hashes(data, B.LOWER_VALUES), starts, ends))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    order = np.lexsort((h, of_word))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    length = (ends - starts).astype(np.float32)
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum((CLASS[data] == 33) | (CLASS[data] == 34) | (CLASS[data] == 38), out=plain[1:])
    mixed = plain[ends] - plain[starts] < ends - starts
    sums = lambda v: np.bincount(of_word, v, len(begin)) / some
    x[:, CLASSES] = np.log1p(n)
    x[:, CLASSES + 1] = sums(length)
    x[:, CLASSES + 2] = sums(length * length) ** 0.5
    x[:, CLASSES + 3] = sums(again)
    x[:, CLASSES + 4] = np.bincount(of_word[order], new, len(begin)) / some
    x[:, CLASSES + 5] = sums(mixed)
    x[:, CLASSES + 6 :] = np.bincount(of_word * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=len(begin) * HASHED).reshape(-1, HASHED) / some[:, None]
    return x, first[:-1]


def forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict:
    x = (x - p["mean"]) * p["scale"]
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    logit = (t * s) @ p["w"]
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    e = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"x": x, "h": h, "t": t, "s": s, "a": a, "bag": bag, "z": z, "score": sigmoid(z @ p["c"] + p["c0"])}


def gradients(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss of these bags."""
    f = forward(p, x, first)
    ds = ((f["score"] - y) / len(first)).astype(f["score"].dtype)
    dz = ds[:, None] * p["c"]
    up = dz[f["bag"]]
    dh, da = f["a"][:, None] * up, (f["h"] * up).sum(1)
    dl = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[f["bag"]])
    dt = dl[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
    du = dl[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
    dh += dt @ p["V"].T + du @ p["U"].T
    pre = dh * (1 - f["h"] ** 2)
    return {"c": f["z"].T @ ds, "c0": ds.sum(keepdims=True), "w": (f["t"] * f["s"]).T @ dl, "V": f["h"].T @ dt, "U": f["h"].T @ du, "W": f["x"].T @ pre, "b": pre.sum(0)}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 128, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7) -> dict:
    """Trained by Adam on the log loss; y is 0 or 1 by bag. Classes are not reweighted: a score is a probability."""
    rng = np.random.default_rng(seed)
    p = {"mean": x.mean(0), "scale": 1 / (x.std(0) + 1e-3)}
    p |= {k: (rng.standard_normal(size) / np.sqrt(size[0])).astype(np.float32) for k, size in (("W", (x.shape[1], hidden)), ("V", (hidden, gate)), ("U", (hidden, gate)), ("w", (gate,)), ("c", (hidden,)))}
    p |= {"b": np.zeros(hidden, np.float32), "c0": np.zeros(1, np.float32)}
    adam = Adam({k: v for k, v in p.items() if k not in ("mean", "scale")}, rate)
    last = np.append(first[1:], len(x))
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(y))
        for low in range(0, len(y), batch):
            bags = order[low : low + batch]
            size = last[bags] - first[bags]
            begin = np.cumsum(size) - size
            grads = gradients(p, x[np.arange(size.sum()) + np.repeat(first[bags] - begin, size)], begin, y[bags])
            adam.step({k: g + decay * p[k] for k, g in grads.items()})
    return p


def train(docs: DataFrame, labels: DataFrame, most: int = 4000) -> dict:
    """Parameters learned from at most `most` labelled rows outside the held-out fold, encoded on the executors.

    With no labelled row, or labels of one class only, the score is that class's share (0.5 without labels).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in B.doc_blocks(batches):
            x, first = passages(data, at)
            last = np.append(first[1:], len(x))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y").cast(pa.int32()), pa.array([x[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())], ["doc_id", "y", "x"])

    rows = labelled(docs, labels, "quality", most)
    got = rows.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(encode, f"doc_id {dict(rows.dtypes)['doc_id']}, y int, x binary").toArrow().sort_by("doc_id")
    y = np.array(got["y"].to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5}
    bags = [np.frombuffer(v, np.float32).reshape(-1, WIDTH) for v in got["x"].to_pylist()]
    return fit(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1], y)


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row of docs (doc_id, text; others are ignored).

    Null and empty texts are one passage without words; long texts have as many passages as they need. Repeated rows
    each give a row; an empty table gives none.
    """

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in B.doc_blocks(batches):
            if "share" in model:
                s = np.full(rows.num_rows, model["share"])
            else:
                s = forward(model, *passages(data, at))["score"]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(np.clip(s, 0, 1).astype(np.float64))], ["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text", (fold_of() == 0).alias("held_out")).mapInArrow(scores, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold. docs needs a column text.

    Null and empty texts are judged as one passage without words, long texts whole. Repeated rows stay or go together;
    an empty table gives none.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in B.doc_blocks(batches):
            s = np.full(rows.num_rows, model["share"]) if "share" in model else forward(model, *passages(data, at))["score"]
            yield rows.filter(pa.array(s.astype(np.float64) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
