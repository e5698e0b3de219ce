"""Reversible line dedup: sharded cuckoo filters over exact reference counts (operator 3).

State is two tables. `refs` (hi, lo, n) counts for each line key, by its 128-bit digest, the documents that hold it;
it is exact, and inserting or deleting documents adds or subtracts. `filters` (shard, n_keys, data) has a cuckoo
filter for the keys of each shard that have reached min_docs; keys that cross the limit are inserted or deleted, so
the state after deleting a batch is the state before it came. A line that its shard's filter doesn't hold needs no
look-up at all; hits are settled by the exact counts. While the bytes of filters and exceptions are within a bound they
go to where the texts are; beyond it each chunk of texts sends its distinct keys, once each, to their shards, where the
filter and the counted keys are, and gets back which ones go. `save` and `load` keep a state across runs.
"""

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ballotspark.llm import blocks as B
from ballotspark.llm import chunks as C
from ballotspark.llm.storage import written

#: Filters and exceptions of more bytes aren't broadcast; keys then go to the filters.
BROADCAST_BYTES = 32 << 20
SHARD_KEYS = 100_000
#: Text whose keys meet one copy of a shard's filter.
SALT_BYTES = 64 << 20


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, two buckets a key (partial-key cuckoo hashing)."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int, data: bytes | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if data is None else np.frombuffer(data, np.uint16).reshape(-1, self.SLOTS).copy()

    @classmethod
    def load(cls, data: bytes) -> "CuckooFilter":
        return cls(len(data) // (2 * cls.SLOTS), data)

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> "CuckooFilter":
        """All keys at a load of 80 % at most; a larger table if one finds no place."""
        buckets = 1
        while buckets * cls.SLOTS * 0.8 < len(hi):
            buckets *= 2
        while True:
            out = cls(buckets)
            if all(out.insert(int(hi[k]), int(lo[k])) for k in out._fill(np.asarray(hi), np.asarray(lo))):
                return out
            buckets *= 2

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _print(self, lo: np.ndarray) -> np.ndarray:
        return (np.asarray(lo).astype(np.uint64) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)

    def _other(self, bucket, fingerprint):
        return bucket ^ ((B.mix(np.asarray(fingerprint).astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64))

    def places(self, hi: np.ndarray, lo: np.ndarray):
        fingerprint = self._print(lo)
        one = (B.mix(np.asarray(hi).astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)
        return fingerprint, one, self._other(one, fingerprint)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fingerprint, one, two = self.places(hi, lo)
        return (self.table[one] == fingerprint[:, None]).any(1) | (self.table[two] == fingerprint[:, None]).any(1)

    def _fill(self, hi: np.ndarray, lo: np.ndarray) -> list[int]:
        """Put all keys that find a free slot there, many at once; the numbers of the others."""
        fingerprint, *homes = self.places(hi, lo)
        left = np.arange(len(hi))
        for home in homes:
            left = left[np.argsort(home[left], kind="stable")]
            bucket = home[left]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(left) else left
            rank = np.arange(len(left)) - np.repeat(first, np.diff(np.append(first, len(left))))
            used = (self.table[bucket] != 0).sum(1)  # slots are filled from the first
            fits = used + rank < self.SLOTS
            self.table[bucket[fits], (used + rank)[fits]] = fingerprint[left[fits]]
            left = left[~fits]
        return left.tolist()

    def insert(self, hi: int, lo: int) -> bool:
        fingerprint, one, two = (x[0] for x in self.places(np.array([hi], np.uint64), np.array([lo], np.uint64)))
        for b in (one, two):
            if len(free := np.flatnonzero(self.table[b] == 0)):
                self.table[b, free[0]] = fingerprint
                return True
        b = one
        for k in range(self.KICKS):
            slot = (k * 7 + int(b)) % self.SLOTS
            fingerprint, self.table[b, slot] = self.table[b, slot], fingerprint
            b = int(self._other(np.array([b]), np.array([fingerprint]))[0])
            if len(free := np.flatnonzero(self.table[b] == 0)):
                self.table[b, free[0]] = fingerprint
                return True
        return False

    def delete(self, hi: int, lo: int) -> None:
        """Of a key that was inserted; its fingerprint goes once."""
        fingerprint, one, two = (x[0] for x in self.places(np.array([hi], np.uint64), np.array([lo], np.uint64)))
        for b in (one, two):
            if len(held := np.flatnonzero(self.table[b] == fingerprint)):
                self.table[b, held[0]] = 0
                return
        raise KeyError("the filter doesn't hold this key")


class State(NamedTuple):
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int


def keys(text: bytes) -> list[bytes]:
    """The key of each line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip().lower() for x in text.split(b"\n")]


def digest(key: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _long(x) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _texts(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def line_refs(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(hi, lo, n): documents (rows) that hold each key of at least min_chars code points. Null text: one empty line,
    which has no key. Repeated rows count each; an empty table gives none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in B.doc_blocks(batches):
            held = Counter()
            for text in _texts(data, at):
                held.update({k for k in keys(text) if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars)})
            d = [digest(k) for k in held]
            yield pa.RecordBatch.from_arrays([_long([x[0] for x in d]), _long([x[1] for x in d]), pa.array(list(held.values()), pa.int64())], ["hi", "lo", "n"])

    return docs.select("text").mapInArrow(count, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("hi", "lo"), F.lit(shards))


def _filters(crossing: DataFrame, old: DataFrame | None, shards: int, refs: DataFrame, min_docs: int) -> DataFrame:
    """crossing: (hi, lo, up). Filters change in place; those which overflow are built anew from the counts' keys."""
    schema = "shard long, n_keys long, data binary"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.of(pdf["hi"].to_numpy().view(np.uint64), pdf["lo"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n_keys": [len(pdf)], "data": [f.dump()]})

    if old is None:
        return refs.where(F.col("n") >= min_docs).select("hi", "lo", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, schema)

    def change(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.load(left["data"].iloc[0]) if len(left) else CuckooFilter(1)
        n = int(left["n_keys"].iloc[0]) if len(left) else 0
        for hi, lo, up in right.sort_values("up")[["hi", "lo", "up"]].itertuples(index=False):
            if up and not f.insert(hi % (1 << 64), lo % (1 << 64)):
                n = -1  # full: build anew
                break
            if not up:
                f.delete(hi % (1 << 64), lo % (1 << 64))
            n += 1 if up else -1
        return pd.DataFrame({"shard": [int((left if len(left) else right)["shard"].iloc[0])], "n_keys": [n], "data": [f.dump()]})

    changed = written(old.groupBy("shard").cogroup(crossing.withColumn("shard", _shard(shards)).groupBy("shard")).applyInPandas(change, schema), "line-filters")
    full = changed.where("n_keys < 0").select("shard")
    anew = refs.where(F.col("n") >= min_docs).select("hi", "lo", _shard(shards).alias("shard")).join(full, "shard", "left_semi").groupBy("shard").applyInPandas(build, schema)
    return changed.where("n_keys > 0").unionByName(anew)


def build(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> State:
    """State of a corpus, an empty one too. The number of shards follows the number of keys that have reached min_docs."""
    refs = written(line_refs(docs, min_chars), "line-refs")
    shards = 1 + refs.where(F.col("n") >= min_docs).count() // SHARD_KEYS
    return State(refs, written(_filters(None, None, shards, refs, min_docs), "line-filters"), shards, min_docs)


def _changed(state: State, docs: DataFrame, sign: int, min_chars: int) -> State:
    batch = line_refs(docs, min_chars).select("hi", "lo", (F.lit(sign) * F.col("n")).alias("by"))
    both = written(state.refs.select("hi", "lo", "n", F.lit(0).cast("long").alias("by")).unionByName(batch.select("hi", "lo", F.lit(0).cast("long").alias("n"), "by")).groupBy("hi", "lo").agg(F.sum("n").alias("was"), F.sum("by").alias("by")), "line-both")
    was, now = F.col("was") >= state.min_docs, F.col("was") + F.col("by") >= state.min_docs
    crossing = both.where(was != now).select("hi", "lo", now.alias("up"))
    refs = both.select("hi", "lo", (F.col("was") + F.col("by")).alias("n")).where("n <> 0")
    return State(refs, written(_filters(crossing, state.filters, state.shards, refs, state.min_docs), "line-filters"), state.shards, state.min_docs)


def insert(state: State, docs: DataFrame, min_chars: int = 1) -> State:
    return _changed(state, docs, 1, min_chars)


def delete(state: State, docs: DataFrame, min_chars: int = 1) -> State:
    """Documents that were inserted before; afterwards the state is as if they had never come.

    Documents that weren't inserted lower the counts all the same, below 0 if need be; inserting them restores the
    state, so insertions and deletions may come in any order. Null texts, repeated rows and an empty table are as in
    `dedup`: one empty line, which isn't counted; a document each; no change.
    """
    return _changed(state, docs, -1, min_chars)


def save(state: State, path: str) -> None:
    """Keep a state in a folder that isn't there yet."""
    spark = state.refs.sparkSession
    state.refs.write.parquet(f"{path}/refs")
    state.filters.write.parquet(f"{path}/filters")
    spark.createDataFrame([(state.shards, state.min_docs)], "shards long, min_docs long").write.parquet(f"{path}/parameters")


def load(spark, path: str) -> State:
    p = spark.read.schema("shards long, min_docs long").parquet(f"{path}/parameters").first()
    refs = spark.read.schema("hi long, lo long, n long").parquet(f"{path}/refs")
    return State(refs, spark.read.schema("shard long, n_keys long, data binary").parquet(f"{path}/filters"), p["shards"], p["min_docs"])


class Keys:
    """A set of 128-bit keys in sorted arrays."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        order = np.lexsort((lo, hi))
        self.hi, self.lo = hi[order], lo[order]

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hi), bool)
        at, stop = np.searchsorted(self.hi, hi), np.searchsorted(self.hi, hi, "right")
        while (more := np.flatnonzero(at < stop)).size:  # keys of one hi are hardly ever two
            out[more] |= self.lo[at[more]] == lo[more]
            at[more] += 1
        return out


class Probe:
    """The filters of all shards at one place."""

    def __init__(self, filters: list, shards: int):
        self.shards, self.filters = shards, {int(s): CuckooFilter.load(bytes(d)) for s, d in filters}

    def __call__(self, hi: np.ndarray, lo: np.ndarray, shard: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hi), bool)
        for s in np.unique(shard):
            if int(s) in self.filters:
                rows = shard == s
                out[rows] = self.filters[int(s)].contains(hi[rows], lo[rows])
        return out


def _shards_of(d: np.ndarray, shards: int) -> np.ndarray:
    return np.zeros(len(d), np.int64) if shards == 1 else shard_of(d, shards)


def _digests(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct keys that aren't empty, and their digests."""
    held = list({k for t in texts for k in keys(t) if k})
    return held, np.array([digest(k) for k in held], np.uint64).reshape(-1, 2)


def _without(texts: list[bytes], gone: set[bytes]) -> tuple[list[list[bytes]], list[int]]:
    """Lines that stay, and how many there were."""
    split = [t.split(b"\n") for t in texts]
    return [[x for x in t if x.strip().lower() not in gone] for t in split] if gone else split, [len(t) for t in split]


def dedup(docs: DataFrame, state: State, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the lines gone whose key min_docs documents or more hold, and with n_lines and n_dropped.

    All columns of docs stay, whatever their names (a column named n_lines or n_dropped is replaced); null text becomes
    "" with one line. Texts and lines of any length are taken whole. Lines that stay are joined by line ends as they
    were. Repeated rows each stay; an empty table gives none.
    """
    docs = docs.drop("n_lines", "n_dropped")
    size = state.filters.agg(F.coalesce(F.sum(F.length("data") + 16), F.lit(0)).alias("x")).first()["x"]
    if size > broadcast_bytes:
        return _by_shard(docs, state)
    probe_of = [(r["shard"], r["data"]) for r in state.filters.collect()]
    shards = state.shards

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(probe_of, shards)
        for _, data, at in B.doc_blocks(batches, 2 << 20):
            _, d = _digests(_texts(data, at))
            d = d[probe(d[:, 0], d[:, 1], _shards_of(d, shards))]
            yield pa.RecordBatch.from_arrays([_long(d[:, 0]), _long(d[:, 1])], ["hi", "lo"])

    # Keys of these texts that the filters hold though the counts don't: about 1 in 8,000 of the others. They are looked
    # for in the texts, as a key that isn't in the counts at all (of a new document, or too short) can be one too.
    often = state.refs.where(F.col("n") >= state.min_docs).select("hi", "lo")
    wrong = docs.select("text").mapInArrow(passing, "hi long, lo long").distinct().join(often, ["hi", "lo"], "left_anti")
    wrong = written(wrong, "line-exceptions")
    if size + wrong.count() * 16 > broadcast_bytes:
        return _by_shard(docs, state)
    got = wrong.toArrow()
    exceptions = Keys(*(got[c].to_numpy().view(np.uint64) for c in ("hi", "lo")))
    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(probe_of, shards)
        for rows, data, at in B.doc_blocks(batches, 2 << 20):
            texts = _texts(data, at)
            held, d = _digests(texts)
            drop = probe(d[:, 0], d[:, 1], _shards_of(d, shards))
            hit = np.flatnonzero(drop)
            gone = {held[k] for k in hit[~exceptions.holds(d[hit, 0], d[hit, 1])].tolist()}
            yield _row_batch(rows, names, *_without(texts, gone))

    plain = docs.toDF(*(n if n == "text" else f"c{k}" for k, n in enumerate(names)))
    return plain.mapInArrow(rewrite, _out_schema(docs))


def _by_shard(docs: DataFrame, state: State) -> DataFrame:
    """The same rows where filters are too large to send: keys go to the shards' filters."""
    chunks = C.chunked(docs, "line-chunks")
    shards = state.shards
    salts = int(1 + chunks._text_bytes // (shards * SALT_BYTES))

    def question(chunk, rows, data, at):
        _, d = _digests(_texts(data, at))
        shard = _shards_of(d, shards)
        order = np.lexsort((d[:, 1], d[:, 0], shard))
        d, shard = d[order], shard[order]
        for mine in np.split(np.arange(len(d)), np.flatnonzero(np.diff(shard)) + 1):
            if len(mine):
                yield chunk, int(shard[mine[0]]), chunk % salts, C.pack_longs(d[mine, 0]), C.pack(d[mine, 1].tobytes())

    asked = C.ask(chunks, question, "chunk long, shard long, salt long, hi binary, lo binary")
    often = state.refs.where(F.col("n") >= state.min_docs).groupBy(_shard(shards).alias("shard")).agg(F.collect_list(F.struct("hi", "lo")).alias("held"))
    sides = state.filters.join(often, "shard").select("shard", "data", "held", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"))
    schema = "chunk long, hi binary, lo binary"
    arrow = C._arrow(schema)

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        held = right["held"].combine_chunks()
        held = held.flatten() if not isinstance(held, pa.ChunkedArray) else held.chunk(0).flatten()
        f, counted = CuckooFilter.load(right["data"][0].as_py()), Keys(*(held.field(c).to_numpy().view(np.uint64) for c in ("hi", "lo")))
        out = []
        for chunk, hi, lo in zip(*(left[c].to_pylist() for c in ("chunk", "hi", "lo")), strict=True):
            hi, lo = C.unpack_longs(hi), np.frombuffer(C.unpack(lo), np.uint64)
            hit = np.flatnonzero(f.contains(hi, lo))
            hit = hit[counted.holds(hi[hit], lo[hit])]
            if len(hit):
                out.append({"chunk": chunk, "hi": hi[hit].tobytes(), "lo": lo[hit].tobytes()})
        return pa.Table.from_pylist(out, arrow)

    answers = asked.groupBy("shard", "salt").cogroup(sides.groupBy("shard", "salt")).applyInArrow(settle, schema)
    out_schema = _out_schema(docs)
    names = docs.columns

    def rewrite(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_arrow_schema(out_schema).empty_table()
        _, rows, data, at = C.opened(left.combine_chunks().to_batches()[0])
        texts = _texts(data, at)
        held, d = _digests(texts)
        found = Keys(*(np.frombuffer(b"".join(right[c].to_pylist()), np.uint64) for c in ("hi", "lo")))
        gone = {held[k] for k in np.flatnonzero(found.holds(d[:, 0], d[:, 1])).tolist()}
        kept = {f.name: rows.field(k) for k, f in enumerate(rows.type)}
        batch = pa.RecordBatch.from_arrays([kept.get(n, pa.nulls(len(rows))) for n in names], names)
        return pa.Table.from_batches([_row_batch(batch, names, *_without(texts, gone))]).cast(to_arrow_schema(out_schema))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rewrite, out_schema)


def shard_of(d: np.ndarray, shards: int) -> np.ndarray:
    """As `_shard`: Spark's xxhash64 of two longs, seed 42, chained."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rotl = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(d), 42, np.uint64)
    for k in range(2):
        h = h + p5 + np.uint64(8)
        h ^= rotl(d[:, k] * p2, 31) * p1
        h = rotl(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return np.mod(h.view(np.int64), shards)


def _out_schema(docs: DataFrame) -> T.StructType:
    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]
    return T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _row_batch(rows: pa.RecordBatch, names: list[str], kept: list[list[bytes]], n_lines: list[int]) -> pa.RecordBatch:
    text = pa.array([b"\n".join(x) for x in kept], pa.binary()).cast(pa.string())
    columns = [text if n == "text" else rows.column(k) for k, n in enumerate(names)]
    n = pa.array(n_lines, pa.int64())
    return pa.RecordBatch.from_arrays([*columns, n, pa.array([a - len(x) for a, x in zip(n_lines, kept, strict=True)], pa.int64())], [*names, "n_lines", "n_dropped"])
