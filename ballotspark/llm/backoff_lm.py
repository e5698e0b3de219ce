"""Language-model scores by a weighted backoff automaton (operator 7).

N-grams smoothed with a Dirichlet prior at every order: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), where h' is h
without its first token, and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); c counts training tokens (an end for each text,
among them) and begins of texts. As an automaton: a state for each history that was learnt, an arc for each learnt
n-gram with its weight, and from each state a failure arc with weight m / (c(h) + m) to the state of the shorter
history; the state without history has an arc for every token, unknown ones too. One traversal from left to right
carries the state, takes failure arcs until an arc fits, and adds log10 weights. Each p(. | h) sums to 1 with the one
unknown token that p reserves.

The counts of the whole training part are never in one place: each chunk of texts sends its distinct n-grams with
their counts to partitions of the key space, and gets back the totals of just these, which are the states and arcs
that it can come to. The place of a token in its text fixes the longest history it can have, so all tokens of a chunk
are walked at once, order by order.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotspark.llm import blocks as B
from ballotspark.llm import chunks as C
from ballotspark.llm.storage import written

END, BEGIN = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
PRIOR = 8.0


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows one after another, each row with its end; and where the rows end."""
    h, row = B.word_hashes(data, at)
    n = np.bincount(row, minlength=len(at) - 1)
    stop = np.cumsum(n + 1)
    out = np.full(stop[-1] if len(stop) else 0, END, np.uint64)
    out[np.arange(len(h)) + row] = h
    return out, stop


def grams(h: np.ndarray, stop: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 1 .. order the key of the k-gram that ends at each token, and each token's place in its text, from 0. A
    begin stands before a text; a token at place i has no k-gram for k > i + 2, and the key there means nothing."""
    begin = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    place = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    token, out = B.mix(h ^ np.uint64(0xD6E8FEB86659FD93)), [h]
    for _ in range(1, order):
        before = np.empty_like(h)
        before[1:] = out[-1][:-1]
        if len(out) == 1:
            before[begin[: len(begin) if len(h) else 0]] = BEGIN
        elif len(h):
            before[0] = 0
        out.append(B.mix(before * np.uint64(0x9E3779B97F4A7C15) + token))
    return out, place


def grouped(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many of each are learnt from."""
    order = np.argsort(keys)
    keys, learn = keys[order], learn[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(learn.astype(np.int64), first)


def part_bounds(parts: int) -> np.ndarray:
    """First key of each part but the first."""
    return (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)


def totals(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Automaton:
    """The states and arcs that some texts can come to. learnt[k - 1]: (keys in order, counts) of their k-grams; those
    of k = 1 include the begin. A k-gram with a count is an arc, and for k below the order a state."""

    def __init__(self, learnt: list[tuple[np.ndarray, np.ndarray]], n: float, v: float, prior: float):
        self.learnt, self.n, self.v, self.prior = learnt, n, v, prior

    def plain(self, count: np.ndarray) -> np.ndarray:
        """p(w) of the state without history."""
        return (count + 0.5) / (self.n + 0.5 * (self.v + 1))

    def failure(self, state: np.ndarray) -> np.ndarray:
        """log10 weight of the failure arc of states with these counts."""
        return np.log10(self.prior / (state + self.prior))

    def walk(self, h: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: score by p(w) alone, the automaton's score, tokens that were learnt."""
        order, begin = len(self.learnt), np.concatenate([[0], stop[:-1]]).astype(np.int64)
        keys, place = grams(h, stop, order)
        arc = []
        for k, (key, (known, count)) in enumerate(zip(keys, self.learnt, strict=True)):
            got = count[np.minimum(np.searchsorted(known, key), len(known) - 1)] if len(known) else np.zeros(len(h))
            arc.append(np.where(place >= k - 1, got, 0))
        started = self.learnt[0][1][np.searchsorted(self.learnt[0][0], BEGIN)]
        weight, p = np.zeros(len(h)), self.plain(arc[0])
        # what an arc of each order weighs, from the shortest up
        weighs, state = [np.log10(p)], []
        for k in range(1, order):
            c = np.empty(len(h))
            c[1:] = arc[k - 1][:-1]
            c[begin] = started if k == 1 else 0
            state.append(c)
            p = (arc[k] + self.prior * p) / (c + self.prior)
            weighs.append(np.log10(p))
        walking = np.ones(len(h), bool)
        for k in range(order - 1, 0, -1):  # from the state of k tokens, if it is one
            here = walking & (state[k - 1] > 0)
            taken = here & (arc[k] > 0)
            weight[taken] += weighs[k][taken]
            failed = here & ~taken
            weight[failed] += self.failure(state[k - 1][failed])
            walking &= ~taken
        weight[walking] += weighs[0][walking]
        sums = lambda x: np.add.reduceat(x, begin)
        return sums(weighs[0]), sums(weight), sums((arc[0] > 0).astype(np.int64))


def scores(docs: DataFrame, learn_from, prior: float = PRIOR, chunk_bytes: int = C.CHUNK_BYTES, order: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    learn_from is a boolean column: the model learns from the whole texts of those rows, all of them. order is the
    longest n-gram, 2 or more. Null texts are empty; an empty text has its end as its only token; texts of any length
    are read whole. Repeated rows count and are scored each; other columns are ignored; an empty table gives none.
    Without rows to learn from, N and V are 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = C.chunked(docs.select("doc_id", learn_from.alias("learn"), "text"), "lm-chunks", chunk_bytes)
    parts = C.parts_of(chunks)
    bounds = part_bounds(parts)

    def lists(rows, h, stop):
        """(keys, counts to learn from) of each order's distinct n-grams."""
        learn = rows.field("learn").to_numpy(zero_copy_only=False).astype(bool)
        each = np.repeat(learn, np.diff(np.concatenate([[0], stop])))
        found, place = grams(h, stop, order)
        out = [grouped(np.concatenate([h, np.full(len(learn), BEGIN)]), np.concatenate([each, learn]))]
        for k in range(1, order):
            there = place >= k - 1
            out.append(grouped(found[k][there], each[there]))
        return out

    def question(chunk, rows, data, at):
        for k, (keys, counts) in enumerate(lists(rows, *tokens(data, at))):
            edge = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
            for part in np.flatnonzero(np.diff(edge)).tolist():
                mine = slice(edge[part], edge[part + 1])
                yield chunk, part, k, C.pack_longs(keys[mine]), C.pack_small(counts[mine])

    asked = C.ask(chunks, question, "chunk long, part int, size int, keys binary, counts binary")

    def work(table: pa.Table):
        part = table["part"][0].as_py()
        sizes = table["size"].to_numpy()
        for k in np.unique(sizes).tolist():
            mine = table.filter(pa.array(sizes == k))
            got = [(C.unpack_longs(a), C.unpack_small(b)) for a, b in zip(mine["keys"].to_pylist(), mine["counts"].to_pylist(), strict=True)]
            keys, counts = totals(got)
            if k == 0:
                real = keys != BEGIN
                yield -1, part, 0, None, int(counts[real].sum()), int((counts[real] > 0).sum())
            for chunk, (a, _) in zip(mine["chunk"].to_pylist(), got, strict=True):
                yield chunk, part, k, C.pack_small(counts[np.searchsorted(keys, a)]), 0, 0

    answers = written(C.answer(asked, work, "chunk long, part int, size int, block binary, n long, v long", parts), "lm-answers", "uncompressed")
    n, v = answers.where("chunk < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def finish(chunk, table: pa.Table) -> pa.Table:
        _, rows, data, at = chunk
        h, stop = tokens(data, at)
        blocks = sorted(zip(table["size"].to_pylist(), table["part"].to_pylist(), table["block"].to_pylist(), strict=True))
        learnt = [(keys, np.concatenate([np.zeros(0, np.int64), *(C.unpack_small(b) for size, _, b in blocks if size == k)]).astype(np.float64)) for k, (keys, _) in enumerate(lists(rows, h, stop))]
        base, score, hits = Automaton(learnt, n, v, prior).walk(h, stop)
        count = np.diff(np.concatenate([[0], stop]))
        return pa.table({"doc_id": rows.field("doc_id"), "n_tokens": count.astype(np.int64), "n_known": hits.astype(np.int64), "train_tokens": np.full(len(stop), n, np.int64), "base_score": base, "score": score})

    return C.finish(chunks, answers.where("chunk >= 0"), finish, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
