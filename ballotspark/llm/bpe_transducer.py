"""Token counts by a deterministic transducer compiled from a SentencePiece BPE vocabulary (operator 6).

Why a finite transducer can count BPE tokens. Encoding s = t1 .. tn is stable exactly when every adjacent pair is:
encode(t_i + t_(i+1)) = [t_i, t_(i+1)], since merges inside two neighbours never depend on a third. So each prefix
of a text has one last token, the piece t that ends there and forms a stable pair with the last token of the prefix
before t; and the number of tokens of a prefix is one more than that of the prefix before its last token. Only the
longest suffix that begins some piece matters for what follows. A state is that suffix with, for every position in
it, the last token and the count relative to the newest position; reading a character moves to one other state and
emits the change of the count (it may be negative when a longer piece replaces several). States are determinised as
they are met and interned; a table that has grown too large is dropped and built again.

A word's transitions from the restart before it, a space after another character, are compiled to one, which carries
their count: no piece has a space after another character, so the state behind such a space is the same whatever came
before. The map of a chunk of text takes each entry state to an end state and a count. It is tabulated for the state
that the characters before the chunk lead to; from any other state only the chunk's head, up to its first restart, is
read, since all that follows is a constant. Maps compose associatively: chunks of a long text are rows of their own,
mapped in parallel, and their maps are composed by the up-sweep of a prefix scan.
"""

import heapq
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa

SPACE = "▁"


class Vocabulary:
    """Normal pieces of a SentencePiece BPE model, and its greedy merges on short strings."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE with byte fallback, identity normalisation and a dummy prefix is supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == p.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a space after another character")
        self.begins = {p[:k] for p in self.score for k in range(1, len(p))}
        #: Two characters that stand side by side in some piece; between all others a text can be cut.
        self.inner = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self._stable: dict[tuple[str, str], bool] = {}
        self._history: dict[str, tuple[list[float], list[str], list[str]]] = {}

    def merges(self, text: str) -> list[str]:
        """Greedy merging, best score first and leftmost among equals."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (joined := parts[a] + parts[b]) in self.score:
                heapq.heappush(queue, (-self.score[joined], a, b, joined))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def history(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """How greedy merging builds a piece: the score of each merge, and the first and the last part before each merge
        and at the end."""
        known = self._history.get(piece)
        if known is None:
            parts, scores, firsts, lasts = list(piece), [], [piece[0]], [piece[-1]]
            while len(parts) > 1:
                best = max(((self.score[x + y], -k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.score), default=None)
                if best is None:
                    break
                k = -best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                scores.append(best[0])
                firsts.append(parts[0])
                lasts.append(parts[-1])
            known = self._history[piece] = scores, firsts, lasts
        return known

    def stable(self, left: str | None, right: str) -> bool:
        """Whether these two pieces, side by side, stay as they are.

        Both are built as they would be alone, until a merge across the border between them is the best there is: better
        than the left one's next merge and no worse than the right one's, as the leftmost of equals goes first.
        """
        if left is None or left[-1] + right[0] not in self.inner:
            return True
        key = (left, right)
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > 150_000:
                self._stable.clear()
            known = self._stable[key] = self.apart(left, right)
        return known

    def apart(self, left: str, right: str) -> bool:
        """`stable` of two pieces that another may span, worked out."""
        (mine, _, lasts), (theirs, firsts, _) = self.history(left), self.history(right)
        if lasts[-1] != left or firsts[-1] != right:
            return False  # not even alone
        i = j = 0
        score, none = self.score, float("-inf")
        while True:
            a = mine[i] if i < len(mine) else none
            b = theirs[j] if j < len(theirs) else none
            across = score.get(lasts[i] + firsts[j])
            if across is not None and across > a and across >= b:
                return False
            if a == b == none:
                return True
            if a >= b:
                i += 1
            else:
                j += 1


#: (suffix, last tokens by position, counts relative to the newest)
State = tuple[str, tuple, tuple]

#: Before a text's first character, and, for what is to come, before any restart.
START: State = ("", (None,), (0,))

#: Characters before a chunk that tell its likely entry state.
LOOK = 256


class ChunkMap(NamedTuple):
    """From each state before a chunk to the state at its end and the count of its tokens."""

    table: dict[State, tuple[State, int]]
    #: What has to be read from states that the table lacks: all up to the first restart.
    head: str
    #: The count behind the head, and the end state; None where there is no restart.
    count: int | None
    end: State | None


class Transducer:
    """Lazily determinised; a table that has grown beyond most_states is dropped, within a word too."""

    def __init__(self, vocabulary: Vocabulary, most_states: int = 200_000, most_words: int = 300_000):
        self.v, self.most_states, self.most_words = vocabulary, most_states, most_words
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[State] = []
        self.known: dict[State, int] = {}
        self.moves: list[dict[str, tuple[int, int]]] = []

    def number(self, state: State) -> int:
        at = self.known.get(state)
        if at is None:
            at = self.known[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return at

    def step(self, state: int, c: str) -> tuple[int, int]:
        """Compile one transition: the next state and the emitted count."""
        suffix, last, counts = self.states[state]
        v, text = self.v, suffix + c
        if c not in v.score:  # no piece has it: its bytes
            end, count, text = None, counts[-1] + len(c.encode()), ""
        else:
            for k in range(len(text)):
                if (piece := text[k:]) in v.score and v.stable(last[k], piece):
                    end, count = piece, counts[k] + 1
                    break
            else:
                raise AssertionError("a single character is always a stable piece")
        last, counts = (*last, end), (*counts, count)
        keep = next((len(text) - k for k in range(len(text)) if text[k:] in v.begins), 0)
        text = text[len(text) - keep :]
        before = last[-keep - 1 :]
        if keep == 0 or (suffix and text == c and suffix[-1] + c not in v.inner):
            before = (None, *before[1:])  # nothing that began earlier can matter
        key = (text, before, tuple(x - count for x in counts[-keep - 1 :]))
        out = self.moves[state][c] = (self.number(key), count)
        return out

    def read(self, text: str, state: State = START) -> tuple[State, int]:
        """End state and emitted count of a text read from a state."""
        at, total = self.number(state), 0
        for c in text:
            move = self.moves[at].get(c)
            if move is None:
                if len(self.states) > self.most_states:
                    state = self.states[at]
                    self.reset()
                    at = self.number(state)
                move = self.step(at, c)
            at, n = move
            total += n
        return self.states[at], total

    def word(self, text: str) -> int:
        """What the transitions of a word, the spaces before it included, emit together."""
        n = self.words.get(text)
        if n is None:
            if len(self.words) > self.most_words:
                self.words.clear()
            n = self.read(text)[1]
            if len(text) < 64:
                self.words[text] = n
        return n

    def chunk_map(self, chunk: str, before: str) -> ChunkMap:
        """before: the last LOOK characters before the chunk, or all where there are fewer."""
        words = _WORDS.findall(chunk)
        rest = (sum(map(self.word, words[1:])), self.read(words[-1])[0]) if len(words) > 1 else (None, None)
        out = ChunkMap({}, words[0], *rest)
        self.apply(out, self.read(_WORDS.findall(before)[-1])[0] if before else START)
        return out

    def apply(self, m: ChunkMap, state: State) -> tuple[State, int]:
        found = m.table.get(state)
        if found is None:
            end, n = self.read(m.head, state)
            found = m.table[state] = (end, n) if m.end is None else (m.end, n + m.count)
        return found

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        table = {}
        for state, (middle, n) in a.table.items():
            end, more = self.apply(b, middle)
            table[state] = (end, n + more)
        if a.end is None:
            return ChunkMap(table, a.head + b.head, b.count, b.end)
        end, more = self.apply(b, a.end)
        return ChunkMap(table, a.head, a.count + more, end)

    def scan(self, maps: list[ChunkMap]) -> int:
        """The count of a text from its chunks' maps: the up-sweep of a prefix scan, as only the last prefix is asked for."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return self.apply(maps[0], START)[1]

    def count(self, text: str) -> int:
        """Tokens of a text, as the library gives them for the whole text."""
        return sum(map(self.word, _WORDS.findall(spaced(text)))) if text else 0


def spaced(text: str) -> str:
    """As pieces are written: a mark for each space and one before the text."""
    return SPACE + text.replace(" ", SPACE)


def chunks(text: str, size: int) -> Iterator[tuple[str, str]]:
    """Each chunk of a text that isn't empty, and the characters before it."""
    text = spaced(text)
    for low in range(0, len(text), size):
        yield text[low : low + size], text[max(0, low - LOOK) : low]


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(2)
def transducer(model_file: str) -> Transducer:
    """One for each Python worker."""
    return Transducer(Vocabulary(model_file))


def count_tokens(docs, model_file: str, limit: int = 4096, chunk: int = 1 << 16):
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text; others are ignored, whatever their names).

    Null and empty texts have 0 tokens; repeated rows, and rows that share a doc_id, each give a row; an empty table
    gives none. Texts of more than `chunk` characters are dealt out in chunks of that size, with the same result.
    """
    from pyspark.sql import functions as F

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([t.count(x) for x in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, text = batch.slice(k, 1), batch.column(1)[k].as_py()
                n_bytes = len(text.encode())
                for no, (piece, before) in enumerate(chunks(text, chunk)):
                    yield pa.RecordBatch.from_arrays(
                        [one.column(2), pa.array([no], pa.int64()), one.column(0), pa.array([n_bytes], pa.int64()), pa.array([piece]), pa.array([before])],
                        ["row", "no", "doc_id", "n_bytes", "piece", "before"],
                    )

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                made = [pickle.dumps(tuple(t.chunk_map(*x))) for x in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(made, pa.binary())], ["row", "no", "doc_id", "n_bytes", "map"])

    def composed(group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        n = transducer(model_file).scan([ChunkMap(*pickle.loads(x)) for x in group["map"].to_pylist()])
        return group.slice(0, 1).select(["doc_id", "n_bytes"]).append_column("n_tokens", pa.array([n], pa.int64()))

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~is_long).select("doc_id", "text").mapInArrow(counts, f"doc_id {kind}, n_bytes long, n_tokens long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that small chunks aren't put together again
    pieces = rows.where(is_long).mapInArrow(cut, f"row long, no long, doc_id {kind}, n_bytes long, piece string, before string").repartition(parts, "row", "no")
    mapped = pieces.mapInArrow(maps, f"row long, no long, doc_id {kind}, n_bytes long, map binary")
    out = short.unionByName(mapped.groupBy("row").applyInArrow(composed, f"doc_id {kind}, n_bytes long, n_tokens long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
