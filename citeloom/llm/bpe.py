"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The merges compile into a transducer that reads a pre-token byte by byte. Its state is the last token that can no
longer change and the bytes read since. For every position of those bytes it knows the last token of the encoding of
that prefix: the one token that ends there and may follow the last token of the prefix before it (two tokens may be
neighbours if the merges of their joint bytes give just these two). A position is open while the bytes from it on
can still grow into a token; once the encodings of all open positions agree on a boundary, everything up to it is
emitted. Tokens have a longest length, so the look-ahead is bounded. Transitions are worked out when first met and
kept up to a bound; beyond it the rest of a pre-token takes the same steps
without a table.

Decoding feeds tokens to a UTF-8 state machine whose state is the incomplete character; the step of a whole token
from a state is kept too. Ill-formed bytes become U+FFFD, one for each maximal ill-formed part.

Edge cases: null and empty texts have no tokens. A pre-token that is itself in the vocabulary is one token. Texts of
any length stream through; repeated rows, empty tables and other columns need no care, since rows are independent.
Ids that the vocabulary does not hold raise an error in decoding.
"""

from __future__ import annotations

import base64
import gc
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import small_batches

STATES, PIECES, STEPS = 60_000, 450_000, 400_000
NEVER = 1 << 60


class State:
    """The last settled token, the bytes after it, for each position of these the last token and the boundaries of the
    encoding that ends there (bits), and the positions from which a token can still grow with their trie nodes."""

    __slots__ = ("arcs", "before", "lasts", "marks", "open_at", "pending")

    def __init__(self, before: int, pending: bytes, lasts: tuple[int, ...], marks: tuple[int, ...], open_at: tuple[tuple[int, int], ...]):
        self.before, self.pending, self.lasts, self.marks, self.open_at = before, pending, lasts, marks, open_at
        self.arcs: dict[int, tuple[State, tuple[int, ...]]] = {}


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """token → id from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Pieces(dict):
    """pre-token → ids, filled when asked."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(self) < PIECES and len(piece) < 64:
            self[piece] = ids
        return ids


class Encoder:
    """Pre-token → ids. One per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = 1 + max(ranks.values())
        self.split = regex.compile(pattern).findall
        # The trie of all tokens: (node, byte) → node; for each node its token (-1: none) and whether it has children.
        self.child: dict[int, int] = {}
        self.token_at, self.grows = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.grows[node] = True
                node = self.child.setdefault(node << 8 | byte, len(self.grows))
                if node == len(self.grows):
                    self.token_at.append(-1)
                    self.grows.append(False)
            self.token_at[node] = rank
        self.spines: dict[bytes, tuple[tuple, tuple] | None] = {}
        self.neighbours: dict[int, bool] = {}
        self.pieces = Pieces(self.piece)
        self.states: dict[tuple[int, bytes], State] = {}
        self.start = self._state(-1, b"", (), (1,), ((0, 0),))

    def _state(self, before, pending, lasts, marks, open_at) -> State:
        key = (before, pending)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State(before, pending, lasts, marks, open_at)
        return state

    def merged(self, text: bytes, least: int = 1) -> list[bytes]:
        """The merges applied in the order of their ranks until ``least`` parts are left."""
        parts, none = [text[i : i + 1] for i in range(len(text))], len(self.ranks)
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spines(self, token: bytes) -> tuple[tuple, tuple] | None:
        """The parts at the left and right end of a token while it is merged, smallest first, each with the rank of
        the merge that takes it up; None for a token that merges never make."""
        if token not in self.spines:
            found = (((token, NEVER),), ((token, NEVER),))
            if len(token) > 1:
                halves = self.merged(token, 2)
                ends = [self._spines(half) for half in halves] if len(halves) == 2 else [None]
                if None in ends:
                    found = None
                else:
                    last, rank = ((token, NEVER),), self.ranks[token]
                    found = (
                        ends[0][0][:-1] + ((halves[0], rank), *last), ends[1][1][:-1] + ((halves[1], rank), *last),
                    )
            self.spines[token] = found
        return self.spines[token]

    def may_follow(self, first: int, second: int) -> bool:
        key = first * self.size + second
        known = self.neighbours.get(key)
        if known is None:
            known = self._may_follow(self.tokens.get(first), self.tokens[second])
            if len(self.neighbours) < STEPS:
                self.neighbours[key] = known
        return known

    def _may_follow(self, first: bytes | None, second: bytes) -> bool:
        """Whether the merges of the joint bytes give these two tokens: no merge across the border comes before those
        that take up its two parts. Of equal ranks the left one comes first."""
        right = self._spines(second)
        if right is None or first is None:
            return right is not None
        left, right = self._spines(first)[1], right[0]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            rank = self.ranks.get(a + b)
            if rank is not None and rank < a_until and rank <= b_until:
                return False
            if a_until <= b_until:
                if a_until == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _arc(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        text = state.pending + bytes((byte,))
        n, lasts, still, found = len(text), state.lasts, [], -1
        for at, node in state.open_at:
            below = self.child.get(node << 8 | byte)
            if below is not None:
                token = self.token_at[below]
                if found < 0 <= token and self.may_follow(lasts[at - 1] if at else state.before, token):
                    found, last = at, token
                if self.grows[below]:
                    still.append((at, below))
        if found < 0:
            raise ValueError("the ranks hold no token for a single byte")
        still.append((n, 0))
        agreed = state.marks[found] | 1 << n
        lasts, marks = (*lasts, last), (*state.marks, agreed)
        for at, _ in still:
            agreed &= marks[at]
        cut = agreed.bit_length() - 1
        if cut:
            arc = self._state(
                lasts[cut - 1], text[cut:], lasts[cut:], tuple([m >> cut for m in marks[cut:]]),
                tuple([(at - cut, node) for at, node in still]),
            ), self._tokens(lasts, cut)
        else:
            arc = self._state(state.before, text, lasts, marks, tuple(still)), ()
        state.arcs[byte] = arc
        return arc

    def _tokens(self, lasts: Sequence[int], end: int) -> tuple[int, ...]:
        out = []
        while end:
            last = lasts[end - 1]
            out.append(last)
            end -= len(self.tokens[last])
        return tuple(reversed(out))

    def _rest(self, state: State, rest: bytes) -> tuple[int, ...]:
        """What the transducer would emit for the rest of a pre-token, without keeping states."""
        lasts, still = [state.before, *state.lasts], state.open_at
        child, token_at, grows, neighbours, size = self.child.get, self.token_at, self.grows, self.neighbours.get, self.size
        for end, byte in enumerate(rest, len(lasts)):
            last, after = -1, []
            for at, node in still:
                below = child(node << 8 | byte)
                if below is not None:
                    token = token_at[below]
                    if last < 0 <= token:
                        follows = neighbours(lasts[at] * size + token)
                        if follows or follows is None and self.may_follow(lasts[at], token):
                            last = token
                    if grows[below]:
                        after.append((at, below))
            if last < 0:
                raise ValueError("the ranks hold no token for a single byte")
            after.append((end, 0))
            lasts.append(last)
            still = after
        return self._tokens(lasts[1:], len(lasts) - 1)

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        state, out = self.start, []
        for at, byte in enumerate(data):
            arc = state.arcs.get(byte)
            if arc is None:
                if len(self.states) >= STATES:
                    return (*out, *self._rest(state, data[at:]))
                arc = self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out.extend(arc[1])
        return (*out, *self._tokens(state.lasts, len(state.lasts)))

    def encode(self, text: str) -> np.ndarray:
        found = map(self.pieces.__getitem__, self.split(text))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32)


def utf8_step(state: bytes, byte: int) -> tuple[bytes, str]:
    """The incomplete character after a byte, and the text that the byte completes."""
    if not state:
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes([byte]), "") if 0xC2 <= byte <= 0xF4 else (b"", "�")
    lead = state[0]
    low, high = 0x80, 0xBF
    if len(state) == 1:  # fixed ranges of second bytes: no overlong forms, no surrogates, nothing above U+10FFFF
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
    if not low <= byte <= high:
        rest, text = utf8_step(b"", byte)
        return rest, "�" + text
    seen = state + bytes([byte])
    needed = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    return (b"", seen.decode()) if len(seen) == needed else (seen, "")


class Decoder:
    """ids → text, one token at a time."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.steps: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.complete: dict[int, str] = {}  # tokens that begin and end between characters

    def step(self, state: bytes, token: int) -> tuple[bytes, str]:
        known = self.steps.get((state, token))
        if known is None:
            end, out = state, []
            for byte in self.tokens[token]:
                end, text = utf8_step(end, byte)
                out.append(text)
            known = end, "".join(out)
            if len(self.steps) < STEPS:
                self.steps[state, token] = known
            if not state and not end:
                self.complete[token] = known[1]
        return known

    def decode(self, ids: Sequence[int]) -> str:
        out = list(map(self.complete.get, ids))
        if None not in out:
            return "".join(out)
        state = b""
        for at, text in enumerate(out):
            if state or text is None:
                state, out[at] = self.step(state, ids[at])
        return "".join(out) + ("�" if state else "")


def encode_texts(
    df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``df`` with an array of token ids in place of its text. The vocabulary file is read by the driver once.

    ``decoded`` names a column for the text that the ids decode to, worked out in the same task.
    """
    with open(vocabulary, "rb") as file:
        raw = df.sparkSession.sparkContext.broadcast(file.read())
    names = [out] + ([decoded] if decoded else [])
    kept = [c for c in df.columns if c not in (text, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(parse_ranks(raw.value), pattern)
        decoder = Decoder(encoder.tokens) if decoded else None
        for batch in batches:
            ids = [encoder.encode(value or "") for value in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
            if decoder:
                made.append(pa.array([decoder.decode(i.tolist()) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *names])
        del encoder, decoder
        gc.collect()  # the tables refer to each other; the worker lives on and serves other tasks

    small_batches(df.sparkSession)
    kinds = {out: T.ArrayType(T.IntegerType()), decoded: T.StringType()}
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, kinds[n]) for n in names])
    return df.select(*kept, text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the decoded text; null ids give an empty one."""
    with open(vocabulary, "rb") as file:
        raw = df.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder({rank: token for token, rank in parse_ranks(raw.value).items()})
        for batch in batches:
            lists = batch.column(ids)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            valid = lists.is_valid().to_pylist()
            spans = zip(ends[:-1].tolist(), ends[1:].tolist(), valid, strict=True)
            texts = pa.array([decoder.decode(flat[a:b].tolist() if v else ()) for a, b, v in spans], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], [*kept, out])

    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.StringType())])
    return df.select(*kept).mapInArrow(run, schema)


def token_digests(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Count and digests of ids and of the text decoded from them."""
    decoded = encode_texts(df.select(id_col, text), vocabulary, pattern, text, decoded="decoded")
    return decoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
