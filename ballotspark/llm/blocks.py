"""Whole texts as byte arrays: words, and 64-bit polynomial hashes of any byte range, without a loop per word.

A block is a run of documents whose UTF-8 bytes lie one after another. With P[i] the sum of value(byte k) * B**k
for k < i, the hash of [s, e) is (P[e] - P[s]) * B**-s modulo 2**64: equal strings have equal hashes wherever they
stand. Different strings agree by chance about once in 2**60 pairs; operators that must not rely on it compare bytes.
"""

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    # Arrays above 4 MB get pages of their own, which go back when they are freed; else a worker keeps its peak.
    ctypes.CDLL(None).mallopt(-3, 4 << 20)
except (AttributeError, OSError):  # another C library than glibc
    pass
# Arrow's own pool keeps what it once had, in each Python worker beside the JVM; the system's gives it back.
pa.set_memory_pool(pa.system_memory_pool())

#: Fixed odd multiplier, 5 modulo 8, and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = VALUES[LOWER]
#: Bytes of a word that ends at ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**k and B**-k for k < n at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    for low in range(0, len(data), 1 << 15):  # temporaries stay in cache
        part = slice(low, min(low + (1 << 15), len(data)))
        np.cumsum(values[data[part]] * up[part], out=out[part.start + 1 : part.stop + 1])
        out[part.start + 1 : part.stop + 1] += out[part.start]
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * down[starts]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def doc_blocks(batches, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows of a `text` column, of about `most` bytes unless one text is longer."""
    for batch in batches:
        data, at = text_buffers(batch.column("text"))
        low, n = 0, batch.num_rows
        while low < n:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


def word_ranges(data: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words: longest runs of bytes of `inside`, within a row each."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    of = inside[data]
    before = np.empty_like(of)
    before[0], before[1:] = False, of[:-1]
    edges = at[:-1]
    before[edges[edges < len(data)]] = False
    starts = np.flatnonzero(of & ~before)
    after = np.empty_like(of)
    after[-1], after[:-1] = False, of[1:]
    edges = at[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(of & ~after) + 1
    return starts, ends, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))


#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of these words, A-Z lower-cased. Eight bytes at a time are mixed in, so that no pattern makes
    different words agree; polynomials modulo 2**64 agree on the Thue-Morse words of 1024 letters, whatever the base."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data]
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the bytes from each place on
    n = ends - starts
    out = mix(n.astype(np.uint64))
    left, at = np.flatnonzero(n <= LONG_WORD), 0
    while len(left):
        out[left] = mix(out[left] * BASE + (eight[starts[left] + at] & _FIRST[np.minimum(n[left] - at, 8)]))
        at += 8
        left = left[n[left] > at]
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


#: Bytes of text that are hashed at once, so that tables by byte stay in cache.
RUN = 1 << 17


def runs(at: np.ndarray, most: int = RUN) -> Iterator[tuple[int, int]]:
    """(low, high) of rows of about `most` bytes together; a longer one is a run of its own."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high
        low = high


def word_hashes(data: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, A-Z lower-cased, and their row numbers."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in runs(at):
        part = data[at[low] : at[high]]
        starts, ends, row = word_ranges(part, at[low : high + 1] - at[low], inside)
        hashes.append(mix(range_hashes(prefix_hashes(part, LOWER_VALUES), starts, ends)))
        rows.append(row + low)
    return np.concatenate(hashes), np.concatenate(rows)
