"""Removal of repeated byte strings by a hash-compared suffix sort (operator 5).

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Sorting every
suffix of a corpus moves far more data than the corpus, so the suffix array is sparse:

1. In each string of `length` bytes the k-gram of smallest hash is its anchor (leftmost among equals), so equal strings
   have their anchor at the same place. Neighbouring strings mostly share an anchor; such a run of strings is one
   record. Chunks of texts ask partitions of the key space which of their anchors occur in two documents.
2. Runs on such anchors are sent, as bytes, to their anchor's partition: once for each distinct content and chunk, with
   the smallest id that has it there; that chunk's other documents with the same content lose the run at once.
3. There the suffixes that begin at the anchors are sorted by mergesort. Two suffixes are compared by binary search for
   their longest common extension, over prefix polynomial hashes. The common extensions of neighbours give, for every
   reach to the right, the classes of equal strings; hashes extend them to the left. All equalities that remove
   something are verified on the bytes.
4. Each record gets back which of its strings have a smaller id elsewhere.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotspark.llm import blocks as B
from ballotspark.llm import chunks as C
from ballotspark.llm.backoff_lm import part_bounds
from ballotspark.llm.storage import written

GRAM = 24
LAST_ID = np.iinfo(np.int64).max


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i : i + w] for each i with a whole window: windows are doubled, the last two overlap."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


#: Starts that are worked on at once; a text may be longer.
SEGMENT = 1 << 16


def anchors(data: np.ndarray, low: int, high: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the strings that start in [low, high): the place of each one's anchor; and the hashes of all k-grams from low on."""
    gram = min(GRAM, length)
    piece = data[low : high + length - 1]
    prefix, n = B.prefix_hashes(piece), len(piece) - gram + 1
    h = B.mix((prefix[gram:] - prefix[:n]) * B.powers(len(prefix))[1][:n])
    order = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    place = (sliding_least(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return place + low, h


class Runs:
    """Runs of strings with one anchor, in one chunk: first and last start, anchor, row; key of the anchor.

    A run that two segments share is two runs; they have one key, so nothing is lost.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int):
        self.prefix = B.prefix_hashes(data)
        found = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
        n = len(data) - length + 1  # starts
        inside = np.zeros(max(n, 0) + 1, np.int8)  # strings within one row
        long = np.diff(at) >= length
        np.add.at(inside, at[:-1][long], 1)
        np.add.at(inside, at[1:][long] - length + 1, -1)
        inside = np.cumsum(inside[: max(n, 0)], dtype=np.int8) > 0
        for low in range(0, n, SEGMENT):
            high = min(low + SEGMENT, n)
            of = inside[low:high]
            if not of.any():
                continue
            place, h = anchors(data, low, high, length)
            goes_on = np.zeros(len(of) + 1, bool)  # the string before has the same anchor
            goes_on[1:-1] = of[1:] & of[:-1] & (place[1:] == place[:-1])
            first, last = np.flatnonzero(of & ~goes_on[:-1]), np.flatnonzero(of & ~goes_on[1:])
            found.append([first + low, last + low, place[first], h[place[first] - low]])
        self.first, self.last, self.anchor, self.key = (np.concatenate(x) for x in zip(*found, strict=True))
        self.row = np.searchsorted(at, self.first, "right") - 1

    def take(self, which: np.ndarray) -> "Runs":
        out = object.__new__(Runs)
        out.prefix = self.prefix
        out.first, out.last, out.anchor, out.row, out.key = (x[which] for x in (self.first, self.last, self.anchor, self.row, self.key))
        return out


def anchor_keys(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor keys (48 bits) in order, whether each is in two rows, and each run's number among them."""
    keys, inverse = np.unique(runs.key >> np.uint64(16), return_inverse=True)
    low = np.full(len(keys), np.iinfo(np.int64).max)
    high = np.full(len(keys), -1)
    np.minimum.at(low, inverse, runs.row)
    np.maximum.at(high, inverse, runs.row)
    return keys, low != high, inverse


class Records:
    """Distinct contents of the runs on shared anchors, in order of key: each with its smallest id in the chunk."""

    def __init__(self, runs: Runs, ids: np.ndarray, length: int):
        self.runs, stop = runs, runs.last + length
        content = B.mix(B.range_hashes(runs.prefix, runs.first, stop) ^ B.mix((stop - runs.first).astype(np.uint64) * np.uint64(64) + (runs.anchor - runs.first).astype(np.uint64)))
        mine = ids[runs.row]
        order = np.lexsort((mine, content, runs.key))
        k, c = runs.key[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        self.pick = order[new]  # the run of smallest id
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.id = mine[self.pick]
        self.later = mine > self.id[self.of]

    def verified(self, data: np.ndarray, length: int) -> None:
        """A run that is dropped for its hash alone has the bytes of the run it is dropped for."""
        r, p = self.runs, self.pick[self.of]
        size = r.last + length - r.first
        for low in range(0, len(p), 100_000):
            part = slice(low, low + 100_000)
            at = np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            if not np.array_equal(data[np.repeat(r.first[part], size[part]) + at], data[np.repeat(r.first[p[part]], size[part]) + at]):
                raise ValueError("two different strings have one 64-bit hash; use another byte table")


def extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, bits: int) -> np.ndarray:
    """Longest common extension to the right of places x and y, at most `most` (under 2**bits), by binary search."""
    _, down = B.powers(len(prefix))
    got = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        n = got + (1 << b)
        fits = n <= most
        n = np.where(fits, n, got)
        same = (prefix[x + n] - prefix[x]) * down[x] == (prefix[y + n] - prefix[y]) * down[y]
        got = np.where(fits & same, n, got)
    return got


def suffix_sort(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes [start, stop) within each group; group numbers are in order. Bottom-up mergesort: at each
    level every suffix finds its rank in its sibling run, all at once, by binary search with hash-compared suffixes."""
    n = len(start)
    order = np.arange(n)
    if not n:
        return order
    bits = int((stop - start).max()).bit_length()
    begin = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0, 1 for suffix x against y."""
        a, b = start[x], start[y]
        la, lb = stop[x] - a, stop[y] - b
        most = np.minimum(la, lb)
        same = extension(prefix, a, b, most, bits)
        over = same == most
        last = len(data) - 1
        ca, cb = data[np.minimum(a + same, last)].astype(np.int64), data[np.minimum(b + same, last)].astype(np.int64)
        return np.sign(np.where(over, la - lb, ca - cb))

    width = 1
    while True:
        live = np.flatnonzero(end - begin > width)  # places of groups with more than one run
        if not len(live):
            return order
        local = live - begin[live]
        half = local // width
        left = half % 2 == 0
        low = np.minimum(begin[live] + (half ^ 1) * width, end[live])
        high = np.minimum(low + width, end[live])
        a, b = low.copy(), high.copy()
        while True:
            todo = np.flatnonzero(a < b)
            if not len(todo):
                break
            mid = (a[todo] + b[todo]) // 2
            c = less(order[mid], order[live[todo]])
            go = np.where(left[todo], c < 0, c <= 0)
            a[todo] = np.where(go, mid + 1, a[todo])
            b[todo] = np.where(go, b[todo], mid)
        block = begin[live] + (half // 2) * 2 * width
        to = block + (local - half * width) + (a - low)
        moved = order.copy()
        moved[to] = order[live]
        order, width = moved, width * 2


def repeated(data: np.ndarray, first: np.ndarray, anchor: np.ndarray, stop: np.ndarray, key: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each record, a bit for each of its strings (by the anchor's distance from its start) that a record of a
    smaller id has too. Records are byte ranges [first, stop) of data; those of one anchor have one key.

    Records of equal content are one suffix to sort, with their smallest id; the others lose all their strings. A key with
    one content only needs no sorting.
    """
    n = len(first)
    if not n:
        return np.zeros(0, np.uint64)
    prefix = B.prefix_hashes(data)
    shape = ((stop - first) * 128 + anchor - first).astype(np.uint64)
    content = B.mix(B.range_hashes(prefix, first, stop) ^ B.mix(shape))
    order = np.lexsort((ids, content, key))
    k, c = key[order], content[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    pick = order[new]
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(new) - 1
    # every string of the record, from its last start to its first
    low, high = anchor + length - stop, anchor - first
    every = ((np.uint64(1) << (high - low + 1).astype(np.uint64)) - np.uint64(1)) << low.astype(np.uint64)
    later = np.flatnonzero(ids > ids[pick][of])
    size = stop - first
    for part in np.array_split(later, 1 + len(later) // 100_000):
        at = np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        mine, other = np.repeat(first[part], size[part]) + at, np.repeat(first[pick[of[part]]], size[part]) + at
        if not np.array_equal(data[mine], data[other]):
            raise ValueError("two different strings have one 64-bit hash; use another byte table")
    mixed = np.zeros(len(pick), bool)
    same = key[pick][1:] == key[pick][:-1]
    mixed[1:] |= same
    mixed[:-1] |= same
    masks = np.zeros(len(pick), np.uint64)
    some = pick[mixed]
    masks[mixed] = sorted_masks(data, prefix, first[some], anchor[some], stop[some], key[some], ids[some], length)
    out = masks[of]
    out[later] = every[later]
    return out


def sorted_masks(data: np.ndarray, prefix: np.ndarray, first: np.ndarray, anchor: np.ndarray, stop: np.ndarray, key: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """`repeated` for records of different contents, in order of key."""
    n, gram = len(first), min(GRAM, length)
    masks = np.zeros(n, np.uint64)
    if not n:
        return masks
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
    order = suffix_sort(data, prefix, anchor, stop, group)
    x, y = order[:-1], order[1:]
    most = np.minimum(stop[x] - anchor[x], stop[y] - anchor[y])
    common = extension(prefix, anchor[x], anchor[y], most, int(most.max(initial=1)).bit_length())
    common[group[x] != group[y]] = 0
    # collision verification: the common extensions hold on the bytes
    reach = np.arange(length)
    for low in range(0, len(x), 50_000):
        p = slice(low, low + 50_000)
        inside = reach < common[p][:, None]
        at = np.where(inside, reach, 0)
        if ((data[anchor[x[p]][:, None] + at] != data[anchor[y[p]][:, None] + at]) & inside).any():
            raise ValueError("two different strings have one 64-bit hash; use another byte table")
    for d in range(length - gram + 1):
        start = anchor[order] - d
        valid = np.flatnonzero((start >= first[order]) & (start + length <= stop[order]))
        if len(valid) < 2:
            continue
        right = np.cumsum(np.concatenate([[0], (common < length - d).astype(np.int64)]))[valid]
        which = order[valid]
        left = B.mix(B.range_hashes(prefix, anchor[which] - d, anchor[which]) + np.uint64(d))
        by = np.lexsort((ids[which], left, right))
        r, h, w = right[by], left[by], which[by]
        new = np.ones(len(by), bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        least = w[np.flatnonzero(new)[np.cumsum(new) - 1]]
        gone = np.flatnonzero(ids[w] > ids[least])
        for low in range(0, len(gone), 50_000):
            g = gone[low : low + 50_000]
            a, b = anchor[w[g]] - d, anchor[least[g]] - d
            if (data[a[:, None] + reach] != data[b[:, None] + reach]).any():
                raise ValueError("two different strings have one 64-bit hash; use another byte table")
        masks[w[gone]] |= np.uint64(1) << np.uint64(d)
    return masks


def repeated_in_slices(data: np.ndarray, size: np.ndarray, left: np.ndarray, key: np.ndarray, ids: np.ndarray, length: int, most: int = 1 << 20) -> np.ndarray:
    """`repeated` for records that lie one after another in data, some anchors at a time: about `most` bytes, unless one
    anchor has more. left is where a record's anchor begins."""
    masks, order, stop = np.zeros(len(size), np.uint64), np.argsort(key, kind="stable"), np.cumsum(size)
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(size[order])])
    low = 0
    while low < len(order):
        high = int(edge[k]) if (k := np.searchsorted(edge, np.searchsorted(before, before[low] + most))) < len(edge) else len(order)
        mine = order[low:high]
        n = size[mine]
        end = np.cumsum(n)
        content = data[np.arange(end[-1]) + np.repeat(stop[mine] - end, n)]
        masks[mine] = repeated(content, end - n, end - n + left[mine], end, key[low:high], ids[mine], length)
        low = high
    return masks


def remove_repeats(docs: DataFrame, length: int = 50, chunk_bytes: int = 4 << 20, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of each row of docs.

    docs has an integer doc_id and text; other columns are ignored. Null texts are empty. Rows with equal ids never
    count against each other; a null id counts as larger than all. Repeated rows each give a row; an empty table gives
    none. length is from 2 to 80.
    """
    if not 2 <= length <= GRAM + 60:
        raise ValueError("length must be from 2 to 84")
    chunks = C.chunked(docs.select("doc_id", "text"), "suffix-chunks", chunk_bytes)
    parts = C.parts_of(chunks, 8 << 20)  # what a part sorts is at most a few times its share of the text
    bounds = part_bounds(parts)
    bounds48 = bounds >> np.uint64(16)

    def ids_of(rows: pa.Array) -> np.ndarray:
        return rows.field("doc_id").fill_null(LAST_ID).cast(pa.int64()).to_numpy(zero_copy_only=False)

    def ask_shared(chunk, rows, data, at):
        keys, twice, _ = anchor_keys(Runs(data, at, length))
        cut = np.searchsorted(keys, bounds48)
        for part, (k, t) in enumerate(zip(np.split(keys, cut), np.split(twice, cut), strict=True)):
            if len(k):
                yield chunk, part, C.pack_longs(k), C.pack(np.packbits(t).tobytes())

    def tell_shared(table: pa.Table):
        got = [C.unpack_longs(k) for k in table["keys"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(C.unpack(t), np.uint8))[: len(k)].astype(bool) for t, k in zip(table["twice"].to_pylist(), got, strict=True)]
        keys, t = np.concatenate(got), np.concatenate(twice)
        order = np.argsort(keys, kind="stable")
        keys, t = keys[order], t[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        shared = (np.diff(np.append(edge, len(keys))) > 1) | np.logical_or.reduceat(t, edge)
        keys = keys[edge]
        for chunk, part, k in zip(table["chunk"].to_pylist(), table["part"].to_pylist(), got, strict=True):
            yield chunk, 1, part, C.pack(np.packbits(shared[np.searchsorted(keys, k)]).tobytes())

    reply = "chunk long, kind int, part int, block binary"
    asked = C.ask(chunks, ask_shared, "chunk long, part int, keys binary, twice binary")
    shared = written(C.answer(asked, tell_shared, reply, parts), "suffix-shared", "uncompressed")

    def records(rows, data, at, table: pa.Table) -> Records:
        runs = Runs(data, at, length)
        keys, _, number = anchor_keys(runs)
        flags = np.zeros(len(keys), bool)
        edge = np.concatenate([[0], np.searchsorted(keys, bounds48), [len(keys)]])
        for kind, part, block in zip(*(table[c].to_pylist() for c in ("kind", "part", "block")), strict=True):
            if kind == 1:
                flags[edge[part] : edge[part + 1]] = np.unpackbits(np.frombuffer(C.unpack(block), np.uint8))[: edge[part + 1] - edge[part]]
        return Records(runs.take(np.flatnonzero(flags[number])), ids_of(rows), length)

    send = "chunk long, part int, keys binary, data binary, sizes binary, lefts binary, ids binary"

    def ask_repeats(chunk, table: pa.Table) -> pa.Table:
        name, rows, data, at = chunk
        found = records(rows, data, at, table)
        found.verified(data, length)
        r = found.runs.take(found.pick)
        size, out = r.last + length - r.first, []
        edge = np.concatenate([[0], np.searchsorted(r.key, bounds), [len(r.key)]])
        for part in range(parts):
            p = slice(edge[part], edge[part + 1])
            if (total := int(size[p].sum())) == 0:
                continue
            at_ = np.arange(total) - np.repeat(np.cumsum(size[p]) - size[p], size[p])
            content = data[np.repeat(r.first[p], size[p]) + at_]
            out.append({"chunk": name, "part": part, "keys": C.pack_longs(r.key[p]), "data": C.pack(content.tobytes(), 3), "sizes": C.pack_small(size[p]), "lefts": C.pack_small((r.anchor - r.first)[p]), "ids": C.pack(found.id[p].tobytes(), 3)})
        return pa.Table.from_pylist(out, C._arrow(send))

    def tell_repeats(table: pa.Table):
        cols = [table[c].to_pylist() for c in ("chunk", "part", "keys", "data", "sizes", "lefts", "ids")]
        keys = [C.unpack_longs(x) for x in cols[2]]
        data = np.frombuffer(b"".join(C.unpack(x) for x in cols[3]), np.uint8)
        size = np.concatenate([C.unpack_small(x) for x in cols[4]])
        left = np.concatenate([C.unpack_small(x) for x in cols[5]])
        ids = np.concatenate([np.frombuffer(C.unpack(x), np.int64) for x in cols[6]])
        masks = repeated_in_slices(data, size, left, np.concatenate(keys), ids, length)
        for chunk, part, mask in zip(cols[0], cols[1], np.split(masks, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            yield chunk, 2, part, C.pack_small(mask)

    repeats = C.answer(C.finish(chunks, shared, ask_repeats, send), tell_repeats, reply, parts)

    def finish(chunk, table: pa.Table) -> pa.Table:
        _, rows, data, at = chunk
        found = records(rows, data, at, table)
        r = found.runs
        mine = sorted((p, b) for kind, p, b in zip(*(table[c].to_pylist() for c in ("kind", "part", "block")), strict=True) if kind == 2)
        masks = np.concatenate([C.unpack_small(b) for _, b in mine]).astype(np.uint64) if mine else np.zeros(0, np.uint64)
        masks = masks[found.of]
        cover = np.zeros(len(data) + 1, np.int32)
        np.add.at(cover, r.first[found.later], 1)
        np.add.at(cover, r.last[found.later] + length, -1)
        for d in range(length - min(GRAM, length) + 1):
            hit = np.flatnonzero(~found.later & ((masks >> np.uint64(d)) & np.uint64(1)).astype(bool))
            np.add.at(cover, r.anchor[hit] - d, 1)
            np.add.at(cover, r.anchor[hit] - d + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edges = at[:-1][np.diff(at) > 0]
        begins[edges] = gone[edges]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        out = {"doc_id": rows.field("doc_id"), "n_bytes": np.diff(at), "n_removed": total[at[1:]] - total[at[:-1]], "n_spans": spans[at[1:]] - spans[at[:-1]], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if keep_text else {}))

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return C.finish(chunks, shared.unionByName(repeats), finish, schema)
