"""Texts in chunks, and questions that chunks put to keyed partitions.

A chunk holds the rows that came one after another in a scan task, up to some MB of text, compressed. Where an
operator needs something of the whole corpus for each word or n-gram, a chunk asks once for each distinct key: it
sends one sorted, packed block of keys to each of `parts` partitions of the key space, and gets one block of answers
back. So what is shuffled follows distinct keys by chunk, a key that fills a third of the corpus is one entry a chunk,
and no task holds more than a chunk or one part of the key space. Chunks are written to the shared folder before
they are asked about, so numbering is the same in every later pass, also after a lost executor.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotspark.llm import blocks as B
from ballotspark.llm.storage import bucketed, give_back

CHUNK_BYTES = 8 << 20
PART_BYTES = 24 << 20
BUCKET_BYTES = 32 << 20
#: Rows that a scan hands to Python at once.
BATCH_ROWS = 1000
#: Up to so much text, chunks and parts have the sizes that are asked for; beyond it both grow, up to these factors.
GROW_FROM, GROW_CHUNK, GROW_PART = 256 << 30, 4, 8


def pack(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_longs(x: np.ndarray) -> bytes:
    """Sorted (or small) 64-bit numbers: differences, byte by byte of the same weight, compressed."""
    x = x.astype(np.uint64)
    d = np.diff(x, prepend=np.uint64(0))
    return pack(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_longs(data: bytes) -> np.ndarray:
    raw = np.frombuffer(unpack(data), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(raw).view(np.uint64).ravel(), dtype=np.uint64)


def pack_small(x: np.ndarray) -> bytes:
    """Non-negative numbers, most of them small."""
    return pack(np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_small(data: bytes) -> np.ndarray:
    raw = np.frombuffer(unpack(data), np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(raw).view(np.uint64).ravel().astype(np.int64)


def grown(bytes_: int, total: int, most: int) -> int:
    """Size of a chunk or part. The messages between chunks and parts are their product, or one for each key if that
    is less; as both sizes grow with the root of the text, the product doesn't outgrow the text before they are at
    their largest."""
    return int(bytes_ * min(most, max(1.0, (total / GROW_FROM) ** 0.5)))


def chunked(docs: DataFrame, name: str, bytes_: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, rows, sizes, data) of docs, whose columns are `text` and some scalar ones, in buckets by chunk.

    rows holds those others as a list of structs; sizes are the texts' bytes; data the compressed texts. Null texts
    count as empty.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    keep = [f for f in docs.schema if f.name != "text"]
    bytes_ = grown(bytes_, total, GROW_CHUNK)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            rows = pa.concat_arrays([pa.StructArray.from_arrays(b.columns[: len(keep)], [f.name for f in keep]) for b, _, _ in held])
            sizes = np.concatenate([np.diff(at) for _, _, at in held]).astype(np.int32)
            data = pack(b"".join(d.tobytes() for _, d, _ in held), 3)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(rows)], rows), pa.ListArray.from_arrays([0, len(sizes)], pa.array(sizes)), pa.array([data], pa.binary())], ["chunk", "rows", "sizes", "data"])

        for block in B.doc_blocks(batches, bytes_ // 4):
            if held and size + len(block[1]) > bytes_:
                yield row()
                number, held, size = number + 1, [], 0
            held.append(block)
            size += len(block[1])
        if held:
            yield row()
        held.clear()
        give_back()

    ordered = docs.select(*(F.col(quoted(f.name)).alias(f"c{k}") for k, f in enumerate(keep)), "text")
    schema = T.StructType().add("chunk", "long").add("rows", T.ArrayType(T.StructType(keep))).add("sizes", T.ArrayType(T.IntegerType())).add("data", "binary")
    # rows that go to Python at once are held in the JVM and in the worker, in several copies
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(key)
    conf.set(key, str(min(int(was), BATCH_ROWS) if int(was) > 0 else BATCH_ROWS))
    try:
        out = bucketed(ordered.mapInArrow(packed, schema), name, "chunk", int(4 + total // max(bytes_, BUCKET_BYTES)), "uncompressed")
    finally:
        conf.set(key, was)
    out._text_bytes = total
    return out


def parts_of(chunks: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Partitions of the key space, in proportion to the text."""
    return int(4 + chunks._text_bytes // grown(part_bytes, chunks._text_bytes, GROW_PART))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def opened(batch: pa.RecordBatch, k: int = 0) -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
    """(chunk, rows, bytes, offsets) of row k."""
    sizes = batch.column("sizes")[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    return batch.column("chunk")[k].as_py(), batch.column("rows")[k].values, np.frombuffer(unpack(batch.column("data")[k].as_py()), np.uint8), at


def ask(chunks: DataFrame, question: Callable, schema: str = "chunk long, part int, block binary") -> DataFrame:
    """question(chunk, rows, bytes, offsets) yields the columns of `schema` as tuples, for each chunk."""
    names = [x.split()[0] for x in schema.split(", ")]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(question(*opened(batch, k)))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _arrow(schema))
                del rows
                give_back()

    return chunks.mapInArrow(asked, schema)


def answer(questions: DataFrame, work: Callable, schema: str, parts: int) -> DataFrame:
    """work(rows of one part, as an Arrow table) yields tuples of `schema`; one group for each part."""
    arrow = _arrow(schema)

    def one(table: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in work(table)], arrow)
        give_back()
        return out

    return questions.repartition(parts, "part").groupBy("part").applyInArrow(one, schema)


def finish(chunks: DataFrame, answers: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work((chunk, rows, bytes, offsets), its answers as an Arrow table) gives an Arrow table of `schema`."""
    arrow = _arrow(schema)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        out = work(opened(left.combine_chunks().to_batches()[0]), right).cast(arrow)
        give_back()
        return out

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(one, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([pa.field(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
