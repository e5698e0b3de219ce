"""SentencePiece encoding and decoding as a relational lattice (operator 10).

A text is cut into words where no piece can span: before a space that follows another character, and between any two
characters that stand side by side in no piece. Each distinct word of the corpus is encoded once: its substrings up to
the longest piece that starts with the same four characters are exploded and equi-joined to the piece table, the matches are the lattice's edges, edges are
grouped by word, and a higher-order aggregate folds the Viterbi recursion over them from left to right.

The vocabulary is of the BPE kind, whose encoding isn't the path of best total score; on its scores plain Viterbi
gives other results than the library. So an edge's weight depends on the edge before it, and is 0 or minus infinity:
two pieces may follow each other only if greedy merging of both together leaves them as they are. A path of such pairs
is the library's encoding, and each prefix has exactly one, so the fold keeps one back pointer for each position.
Which pairs are stable is a property of the vocabulary, worked out once for each pair that the lattices hold.

Characters that are no piece are words of their own and become their bytes' pieces.
"""

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from operator import add
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotspark.llm import blocks as B
from ballotspark.llm import chunks as C
from ballotspark.llm.bpe_transducer import SPACE, Vocabulary
from ballotspark.llm.storage import drop, written

_MARK = SPACE.encode()
BITS = 20
#: Bits of a piece's length in an edge.
LENGTH_BITS = 8
#: Words above this many bytes go to the lattice in segments of so many characters, under a name.
LONG = 1024
#: Edges that the fold takes between two cuts of its state.
STEP = 256
#: Characters that tell how long a piece at a position can be.
HEAD = 4
#: Rows of the piece table that may be broadcast.
MOST_PIECES = 1 << BITS
#: Pairs of pieces that a worker keeps.
MOST_PAIRS = 1 << 20


@lru_cache(2)
def vocabulary(model_file: str) -> Vocabulary:
    v = Vocabulary(model_file)
    if len(v.id) + len(v.byte_id) + 16 > MOST_PIECES or v.longest >> LENGTH_BITS or any(c not in v.id for p in v.id for c in p):
        raise ValueError("a vocabulary of under 2**20 pieces of under 256 characters is needed, with each character of a piece a piece itself")
    return v


def words(v: Vocabulary, unit: str) -> list[str]:
    out, low, inner = [], 0, v.inner
    for k in range(1, len(unit)):
        if unit[k - 1 : k + 1] not in inner:
            out.append(unit[low:k])
            low = k
    return [*out, unit[low:]]


def unit_words(v: Vocabulary, unit: bytes) -> list[bytes]:
    text = unit.decode().replace(" ", SPACE)
    if v.inner.issuperset(map(add, text, text[1:])):
        return [unit]
    return [w.encode().replace(_MARK, b" ") for w in words(v, text)]


@lru_cache(2)
def joints(model_file: str) -> np.ndarray:
    """For two bytes side by side, spaces being spaces: whether a piece may span them. Exact between ASCII characters;
    elsewhere it may be true where no piece does."""
    out = np.zeros((256, 256), bool)
    out[:, 0x80:0xC0] = True  # within a character
    for pair in vocabulary(model_file).inner:
        a, b = (c.replace(SPACE, " ").encode() for c in pair)
        out[a[-1], b[0]] = True
    return out.ravel()


class Cut:
    """The texts of a chunk as numbers of distinct units, and each unit's words."""

    def __init__(self, model_file: str, data: np.ndarray, at: np.ndarray):
        v, joint, hashes, starts, stops, per_row, held, base = vocabulary(model_file), joints(model_file), [], [], [], [], [], 0
        low = 0
        while low < len(at) - 1:  # about 1 MB at once
            high = max(low + 1, int(np.searchsorted(at, at[low] + (1 << 20), "right")) - 1)
            raw = data[at[low] : at[high]].tobytes()
            edge = (at[low : high + 1] - at[low]).tolist()
            texts = [b" " + raw[a:b].replace(_MARK, b" ") if b > a else b"" for a, b in zip(edge[:-1], edge[1:], strict=True)]
            raw = b"".join(texts)
            part, edge = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)])
            begin = np.zeros(len(part), bool)
            if len(part):
                begin[1:] = ~joint[(part[:-1].astype(np.uint16) << 8) | part[1:]]
                begin[edge[:-1][np.diff(edge) > 0]] = True
            start = np.flatnonzero(begin)
            stop = np.append(start[1:], len(part))
            per_row.append(np.searchsorted(start, edge[1:]) - np.searchsorted(start, edge[:-1]))
            hashes.append(B.mix(B.range_hashes(B.prefix_hashes(part), start, stop)))
            starts.append((start + base).astype(np.int32))
            stops.append((stop + base).astype(np.int32))
            held.append(raw)
            base += len(raw)
            low = high
        self.per_row, start, stop = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (per_row, starts, stops))
        raw, h = b"".join(held), np.concatenate([np.zeros(0, np.uint64), *hashes])
        del held, starts, stops, hashes
        self.number, distinct = pd.factorize(h)
        first = np.empty(len(distinct), np.int64)
        first[self.number[::-1]] = np.arange(len(start))[::-1]
        units = [raw[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        # the units' words: bytes, with spaces as spaces
        self.units = [(u,) if u.isascii() else unit_words(v, u) for u in units]
        self.words = list(dict.fromkeys(chain.from_iterable(self.units)))


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[start[k] : start[k] + size[k]] for each k of which, one after another."""
    n = size[which]
    return flat[np.arange(n.sum()) + np.repeat(start[which] - np.cumsum(n) + n, n)]


def name(word: bytes) -> bytes:
    """What a word is called in joins and groups: itself, or its digest if it is long. No word is of the form of a
    digest, as NUL is no piece and so is a word of its own."""
    return word if len(word) <= LONG else b"\0" + sha256(word).hexdigest().encode()


def segments(word: bytes, longest: int) -> Iterator[tuple[str, int | None, int | None, str | None]]:
    """(name, first position, positions, text) of a word's segments; text goes on for what pieces that start in the
    segment can reach. A word that is its own name has it only once, with nulls."""
    text = word.decode().replace(" ", SPACE)
    if len(word) <= LONG:
        yield text, None, None, None
        return
    called = name(word).decode()
    for low in range(0, len(text), LONG):
        yield called, low, min(LONG, len(text) - low), text[low : low + LONG + longest - 1]


def _by_part(found: list[bytes], parts: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for w in found:
        out[crc32(name(w)) % parts].append(w)
    return out


def _packed(found: list[bytes]) -> tuple[bytes, bytes]:
    return C.pack(b"".join(found), 3), C.pack_small(np.array([len(x) for x in found], np.int64))


def _unpacked(data: bytes, sizes: bytes) -> list[bytes]:
    raw, at = C.unpack(data), np.concatenate([[0], np.cumsum(C.unpack_small(sizes))]).astype(int).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """(piece, id) of the normal pieces: under 2**20 rows, as `vocabulary` checks."""
    return spark.createDataFrame(pa.table({"piece": list(v.id), "id": pa.array(list(v.id.values()), pa.int32())}))


def heads(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """(head, most): how long the longest piece is that starts so; shorter pieces than `HEAD` start no row."""
    most: dict[str, int] = {}
    for p in v.id:
        if len(p) >= HEAD:
            most[p[:HEAD]] = max(most.get(p[:HEAD], 0), len(p))
    return spark.createDataFrame(pa.table({"head": pa.array(list(most), pa.string()), "most": pa.array(list(most.values()), pa.int32())}))


#: The pairs a worker knows by model, sorted, and whether they are stable.
_PAIRS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def stable_pairs(model_file: str, pairs: np.ndarray) -> np.ndarray:
    """`Vocabulary.stable` of sorted distinct pairs, first id << BITS | second id."""
    known, good = _PAIRS.get(model_file, (np.zeros(0, np.int64), np.zeros(0, bool)))
    at = np.searchsorted(known, pairs)
    new = np.ones(len(pairs), bool)
    if len(known):
        new = known[np.minimum(at, len(known) - 1)] != pairs
    out = np.zeros(len(pairs), bool)
    out[~new] = good[at[~new]]
    if new.any():
        v, names, mask = vocabulary(model_file), piece_names(model_file), (1 << BITS) - 1
        both = ((names[p >> BITS], names[p & mask]) for p in pairs[new].tolist())
        out[new] = [a[-1] + b[0] not in v.inner or v.apart(a, b) for a, b in both]
        if len(known) + new.sum() > MOST_PAIRS:
            _PAIRS[model_file] = pairs, out
        else:
            _PAIRS[model_file] = np.insert(known, at[new], pairs[new]), np.insert(good, at[new], out[new])
    return out


def encode_words(distinct: DataFrame, v: Vocabulary, model_file: str, dealt_to: int) -> DataFrame:
    """(word, ids) of a table of the segments of distinct words (word, base, n, text), cut as `words` and `segments`
    do. Grouping needs no second shuffle: words are dealt out once and stay where their substrings are."""
    spark = distinct.sparkSession
    pieces = piece_table(spark, v)
    dealt = distinct.repartition(dealt_to, "word")
    whole = dealt.select("word", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("n", F.length("word")).alias("n"), F.coalesce("text", "word").alias("text"))
    at = whole.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("head", F.expr(f"substring(text, s + 1, {HEAD})"))
    at = at.join(F.broadcast(heads(spark, v)), "head", "left").select("word", "base", "text", "s", F.least(F.coalesce("most", F.lit(HEAD - 1)), F.length("text") - F.col("s")).alias("most"))
    sub = at.withColumn("l", F.explode(F.sequence(F.lit(1), F.col("most")))).withColumn("piece", F.expr("substring(text, s + 1, l)"))
    end = (F.col("base") + F.col("s") + F.col("l")).cast("long")
    code = F.shiftleft(end, LENGTH_BITS + BITS) + F.shiftleft(F.col("l").cast("long"), BITS) + F.col("id")
    lattice = sub.join(F.broadcast(pieces), "piece").select("word", code.alias("edge")).groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    mask, most = (1 << BITS) - 1, (1 << LENGTH_BITS) - 1

    @F.arrow_udf("array<array<bigint>>")
    def stable(edges: pa.Array) -> pa.Array:
        """For each STEP edges of a word: the pairs of edges that may follow each other, whose second is among them."""
        e = edges.flatten().to_numpy()
        held = np.asarray(pc.list_value_length(edges)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(held)])
        of = np.repeat(np.arange(len(held)), held)
        end, ident = e >> (LENGTH_BITS + BITS), e & mask
        start = end - ((e >> BITS) & most)
        size = int(end.max()) + 1 if len(e) else 1
        order = np.argsort(of * size + start, kind="stable")
        key = (of * size + start)[order]
        low, high = np.searchsorted(key, of * size + end, "left"), np.searchsorted(key, of * size + end, "right")
        n = high - low
        left = np.repeat(np.arange(len(e)), n)
        right = order[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
        pairs = (ident[left] << BITS) | ident[right]
        one, inverse = np.unique(pairs, return_inverse=True)
        good = stable_pairs(model_file, one)[inverse]
        steps = np.concatenate([[0], np.cumsum(-(-held // STEP))])
        step = steps[of] + (np.arange(len(e)) - at[of]) // STEP
        where = step[right[good]]
        by_step = pairs[good][np.argsort(where, kind="stable")]
        edge = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=steps[-1]))])
        return pa.ListArray.from_arrays(pa.array(steps.astype(np.int32)), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(by_step)))

    # A back pointer, for each position: id << LENGTH_BITS | length; the begin of the word has -1. An edge is
    # end << LENGTH_BITS + BITS | length << BITS | id. The state is the last pointers, from position `low` on, and those
    # that are done, by step; so a position costs the same in a word of any length.
    length, ident = f"(shiftright(x, {BITS}) & {most})", f"(x & {mask})"
    start = f"(shiftright(x, {LENGTH_BITS + BITS}) - {length})"
    left = f"(shiftright(get(back, cast({start} - a.low as int)), {LENGTH_BITS}))"
    fold = f"""aggregate(sequence(0, size(stable) - 1), named_struct('low', 0L, 'last', array(-1L), 'done', array(array(-1L))), (a, k) ->
      aggregate(slice(edges, k * {STEP} + 1, {STEP}), a.last, (back, x) ->
        if(a.low + size(back) = shiftright(x, {LENGTH_BITS + BITS}) and ({start} = 0 or array_contains(get(stable, k), shiftleft({left}, {BITS}) + {ident})),
           array_append(back, shiftleft({ident}, {LENGTH_BITS}) + {length}), back),
        back -> named_struct('low', a.low + greatest(0, size(back) - {v.longest}), 'last', slice(back, greatest(1, size(back) - {v.longest - 1}), {v.longest}),
                             'done', array_append(a.done, slice(back, size(a.last) + 1, size(back) - size(a.last))))),
      a -> flatten(a.done))"""
    trace = f"""aggregate(sequence(0, (size(back) - 2) div {STEP}), named_struct('p', size(back) - 1, 'done', array(cast(array() as array<int>))), (a, k) ->
      aggregate(slice(back, 1, least({STEP}, a.p)), named_struct('p', a.p, 'ids', cast(array() as array<int>)), (t, i) ->
        if(t.p > 0, named_struct('p', t.p - cast(get(back, t.p) & {most} as int), 'ids', array_append(t.ids, cast(shiftright(get(back, t.p), {LENGTH_BITS}) as int))), t),
        t -> named_struct('p', t.p, 'done', array_append(a.done, reverse(t.ids)))),
      a -> flatten(reverse(a.done)))"""
    known = lattice.withColumn("stable", stable("edges")).select("word", F.expr(fold).alias("back")).select("word", F.expr(trace).alias("ids"))
    fallback = F.array(*(F.lit(v.byte_id[b]) for b in range(256)))
    raw = F.encode(F.col("word"), "utf-8")
    byte = F.transform(F.sequence(F.lit(1), F.octet_length("word")), lambda i: F.get(fallback, F.conv(F.hex(raw.substr(i, F.lit(1))), 16, 10).cast("int")))
    single = distinct.where(F.length("word") == 1).join(F.broadcast(pieces), F.col("word") == F.col("piece"), "left_anti")
    return known.unionByName(single.select("word", byte.alias("ids")))


@lru_cache(2)
def piece_names(model_file: str) -> dict[int, str]:
    return {i: p for p, i in vocabulary(model_file).id.items()}


def encode(docs: DataFrame, model_file: str, chunk_bytes: int = C.CHUNK_BYTES, with_text: bool = False, between: Callable[[], None] | None = None) -> DataFrame:
    """doc_id, ids (the library's encoding of the whole text) of each row of docs (doc_id, text); with_text: and text,
    what these ids decode to, as `decode` gives it, without another pass through Python. between: called when the words
    are encoded, written then, and the texts not yet.

    Null and empty texts have no ids. Repeated rows each give a row; other columns are ignored; an empty table gives
    none.
    """
    v = vocabulary(model_file)
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = C.chunked(docs.select("doc_id", "text"), "piece-chunks", chunk_bytes)
    parts = C.parts_of(chunks, 12 << 20)

    def question(chunk, rows, data, at):
        for part, found in enumerate(_by_part(Cut(model_file, data, at).words, parts)):
            if found:
                yield chunk, part, *_packed(found)

    asked = written(C.ask(chunks, question, "chunk long, part int, words binary, sizes binary"), "piece-words", "uncompressed")

    def distinct(table: pa.Table):
        seen: set[bytes] = set()
        for data, sizes in zip(table["words"].to_pylist(), table["sizes"].to_pylist(), strict=True):
            seen.update(_unpacked(data, sizes))
        return (row for w in seen for row in segments(w, v.longest))

    known = encode_words(C.answer(asked, distinct, "word string, base int, n int, text string", parts), v, model_file, 2 * parts).withColumn("part", F.pmod(F.crc32(F.encode(F.replace("word", F.lit(SPACE), F.lit(" ")), "utf-8")), F.lit(parts)).cast("int"))
    reply = C._arrow("chunk long, part int, ids binary, sizes binary")

    def answers(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["ids"].combine_chunks()
        size = np.asarray(pc.list_value_length(ids)).astype(np.int64)
        flat, start = ids.flatten().to_numpy(), np.cumsum(size) - size
        of = {w.encode().replace(_MARK, b" "): k for k, w in enumerate(right["word"].to_pylist())}
        rows = []
        for chunk, part, data, sizes in zip(*(left[c].to_pylist() for c in ("chunk", "part", "words", "sizes")), strict=True):
            found = _unpacked(data, sizes)
            which = np.array([of[name(w)] for w in found], np.int64)
            got, n = gathered(flat, start, size, which), size[which]
            rows.append({"chunk": chunk, "part": part, "ids": C.pack_small(got), "sizes": C.pack_small(n)})
        del of
        C.give_back()
        return pa.Table.from_pylist(rows, reply)

    replies = asked.repartition(parts, "part").groupBy("part").cogroup(known.repartition(parts, "part").groupBy("part")).applyInArrow(answers, "chunk long, part int, ids binary, sizes binary")

    if between:
        replies = written(replies, "piece-replies", "uncompressed")
        drop(asked)
        between()

    def finish(chunk, table: pa.Table) -> pa.Table:
        _, rows, data, at = chunk
        cut = Cut(model_file, data, at)
        by_part = {p: (i, s) for p, i, s in zip(*(table[c].to_pylist() for c in ("part", "ids", "sizes")), strict=True)}
        place, flats, sizes = {}, [], []
        for part, mine in enumerate(_by_part(cut.words, parts)):
            if mine:
                place.update(zip(mine, range(len(place), len(place) + len(mine)), strict=True))
                flats.append(C.unpack_small(by_part[part][0]).astype(np.int32))
                sizes.append(C.unpack_small(by_part[part][1]))
        flat, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (flats, sizes))
        start = np.cumsum(size) - size
        # units of several words have their ids put together
        of_unit = np.array([place[w] for u in cut.units for w in u], np.int64)
        count = np.array([len(u) for u in cut.units], np.int64)
        unit_flat = gathered(flat, start, size, of_unit).astype(np.int32)
        unit_size = np.add.reduceat(size[of_unit], np.cumsum(count) - count) if len(count) else count
        unit_start = np.cumsum(unit_size) - unit_size
        edge = np.concatenate([[0], np.cumsum(cut.per_row)])
        batches = []
        for low in range(0, len(rows), 512):
            mine = cut.number[edge[low] : edge[min(low + 512, len(rows))]]
            stop = np.concatenate([[0], np.cumsum(unit_size[mine])])[edge[low : low + 513] - edge[low]]
            ids = gathered(unit_flat, unit_start, unit_size, mine)
            lists = pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(ids))
            batches.append(pa.table({"doc_id": rows.field("doc_id")[low : low + 512], "ids": lists} | ({"text": decoded(lists, model_file)} if with_text else {})))
        return pa.concat_tables(batches)

    return C.finish(chunks, replies, finish, f"doc_id {kind}, ids array<int>" + ", text string" * with_text)


@lru_cache(2)
def piece_bytes(model_file: str) -> pa.Array:
    """What each id stands for; control ids stand for nothing."""
    v = vocabulary(model_file)
    names = [b""] * (1 + max(*v.id.values(), *v.byte_id.values()))
    for p, i in v.id.items():
        names[i] = p.replace(SPACE, " ").encode()
    for b, i in v.byte_id.items():
        names[i] = bytes([b])
    return pa.array(names, pa.binary())


def decoded(ids: pa.Array, model_file: str) -> pa.Array:
    """The texts of lists of ids."""
    n = np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
    flat = piece_bytes(model_file).take(ids.flatten())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    raw = data.to_pybytes() if data is not None else b""
    edge = at[np.concatenate([[0], np.cumsum(n)])].tolist()
    texts = [None if null else raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode(errors="replace") for a, b, null in zip(edge[:-1], edge[1:], ids.is_null().to_pylist(), strict=True)]
    return pa.array(texts, pa.string())


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """encoded with a column `text`: the ids' pieces joined, spaces restored, the first space dropped.

    Byte pieces become their bytes; bytes that aren't UTF-8 become U+FFFD; control ids give nothing; null ids give
    null. A column `text` is replaced; all others stay.
    """
    encoded = encoded.drop("text")
    from pyspark.sql import types as T

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = part.column(part.schema.get_field_index("ids"))
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(ids, model_file)], [*part.schema.names, "text"])

    return encoded.mapInArrow(texts, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
