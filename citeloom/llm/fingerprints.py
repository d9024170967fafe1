"""Document fingerprints from prefix polynomial hashes.

For a text c_0 .. c_(n-1) the arrays P[i] = sum of c_j B^j below i, modulo two primes near 2^31, give the hash of any
span as (P[i + l] - P[i]) B^(-i), so spans compare in constant time and longest common extensions are found by binary
search. A fingerprint names the text (length and hash of the whole) and sketches its spans of ``SPAN`` code points:
span hashes fall into ``BINS`` bins and each bin keeps the least. The share of agreeing bins estimates the Jaccard
similarity J of the span sets; likeness is 2 J / (1 + J), the share of spans the texts have in common.

An edited text is compared with its original without hashing it anew: its arrays are those of the kept part, then
those of the inserted part shifted by a power of B, and only spans across the seam are new.

Documents meet their successor in descending order of ids in one range shuffle: a task streams through its range and
holds two texts. The ends of ranges, two rows per task, are joined afterwards.

Edge cases: a null text is empty. Texts shorter than a span have themselves as their only span; empty texts have none,
and likeness is 1 for equal fingerprints and 0 where one has no span. Null ids come last, equal ids are ordered by
text. A single document is its own successor. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import small_batches
from citeloom.session import materialize

SPAN, BINS, BIN_HEX = 12, 48, 5
PRIMES, BASES = (2147483647, 2147483629), (1103515243, 69069 * 7919)
U64 = np.uint64


class _Powers:
    """B^i and B^(-i) modulo a prime, longer on demand."""

    def __init__(self, prime: int, base: int):
        self.prime = prime
        self.up, self.down = self._start(base), self._start(pow(base, -1, prime))

    def _start(self, base: int) -> np.ndarray:
        return np.array([1, base], U64)

    def _grown(self, powers: np.ndarray, n: int) -> np.ndarray:
        while len(powers) < n:
            last = int(powers[-1]) * int(powers[1]) % self.prime
            powers = np.concatenate((powers, powers * U64(last) % U64(self.prime)))
        return powers

    def reach(self, n: int) -> None:
        self.up, self.down = self._grown(self.up, n), self._grown(self.down, n)


POWERS = tuple(_Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True))


class Hashed:
    """Prefix arrays of a text, or of code points."""

    def __init__(self, text: str | None, prefixes: list[np.ndarray] | None = None):
        if prefixes is None:
            codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1)
            prefixes = []
            for powers in POWERS:
                powers.reach(len(codes) + 1)
                sums = np.cumsum(codes * powers.up[: len(codes)] % U64(powers.prime), dtype=U64) % U64(powers.prime)
                prefixes.append(np.concatenate((np.zeros(1, U64), sums)))
        self.prefixes = prefixes
        self.n = len(prefixes[0]) - 1

    def spans(self, length: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """62-bit hashes of the spans of a length that start from ``first`` up to, not including, ``last``."""
        last = max(first, self.n - length + 1 if last is None else min(last, self.n - length + 1))
        halves = []
        for prefix, powers in zip(self.prefixes, POWERS, strict=True):
            prime = U64(powers.prime)
            powers.reach(self.n + 1)
            cut = prefix[first + length : last + length] + prime - prefix[first:last]
            halves.append(cut % prime * powers.down[first:last] % prime)
        return halves[0] << U64(31) | halves[1]

    def span(self, start: int, length: int) -> int:
        return int(self.spans(length, start, start + 1)[0])

    def common_extension(self, other: Hashed, at: int = 0, other_at: int = 0) -> int:
        """The longest span that both texts continue with from these positions."""
        low, high = 0, min(self.n - at, other.n - other_at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, middle) == other.span(other_at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spliced(self, kept: int, other: Hashed, taken: int) -> Hashed:
        """The first ``kept`` code points followed by the first ``taken`` of another text."""
        joined = []
        for own, others, powers in zip(self.prefixes, other.prefixes, POWERS, strict=True):
            powers.reach(kept + taken + 1)
            shifted = (others[1 : taken + 1] * powers.up[kept] % U64(powers.prime) + own[kept]) % U64(powers.prime)
            joined.append(np.concatenate((own[: kept + 1], shifted)))
        return Hashed(None, joined)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def least_by_bin(values: np.ndarray) -> np.ndarray:
    """The least mixed hash of each bin; the largest number marks an empty bin."""
    least = np.full(BINS, ~U64(0))
    if len(values):
        mixed = np.sort(_mixed(values))  # a bin is a range of the mixed hashes
        starts = np.searchsorted(mixed, np.array([(i << 64) // BINS for i in range(BINS)], U64))
        full = starts < np.append(starts[1:], len(mixed))
        least[full] = mixed[starts[full]]
    return least


def own_spans(hashed: Hashed) -> np.ndarray:
    return hashed.spans(min(SPAN, hashed.n)) if hashed.n else np.empty(0, U64)


def fingerprint(hashed: Hashed, least: np.ndarray) -> str:
    whole = hashed.span(0, hashed.n) if hashed.n else 0
    mask = (1 << 4 * BIN_HEX) - 1
    bins = "".join("-" * BIN_HEX if v == 0xFFFFFFFFFFFFFFFF else f"{v & mask:0{BIN_HEX}x}" for v in least.tolist())
    return f"{hashed.n:x}:{whole:016x}:{bins}"


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    a, b = a.rpartition(":")[2], b.rpartition(":")[2]
    same = seen = 0
    for i in range(0, len(a), BIN_HEX):
        x, y = a[i : i + BIN_HEX], b[i : i + BIN_HEX]
        if x[0] != "-" or y[0] != "-":
            seen += 1
            same += x == y
    share = same / seen if seen else 0.0
    return 2 * share / (1 + share)


class Document:
    """A text with its arrays and its fingerprint."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.hashed = Hashed(self.text)
        self.spans = own_spans(self.hashed)
        self.name = fingerprint(self.hashed, least_by_bin(self.spans))

    def against(self, after: Document) -> tuple:
        """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_prefix."""
        n = self.hashed.n
        cut = n // 3
        taken = min(cut, after.hashed.n)
        edited = self.hashed.spliced(n - cut, after.hashed, taken)
        if edited.n < SPAN or after.hashed.n < SPAN or n < SPAN:
            values = own_spans(edited)
        else:
            kept = max(0, n - cut - SPAN + 1)
            values = np.concatenate((
                self.spans[:kept], edited.spans(SPAN, kept, n - cut), after.spans[: max(0, taken - SPAN + 1)],
            ))
        name = fingerprint(edited, least_by_bin(values))
        digest = hashlib.sha256((self.text[: n - cut] + after.text[:taken]).encode("utf-8", "surrogatepass")).hexdigest()
        return (
            n, digest, self.name, name, likeness(self.name, name), likeness(self.name, after.name),
            self.hashed.common_extension(edited),
        )


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_prefix"]
KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_prefix long"


def edited_fingerprints(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_prefix) of every row.
    The edit replaces the last third by the beginning of the next document in descending order of ids."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before, before_id, started = TaskContext.get().partitionId(), None, None, False
        for frame in frames:
            rows = []
            for key, value in zip(frame["id"], frame["text"], strict=True):
                document = Document(value)
                if started:
                    rows.append(("row", part, before_id, None, *before.against(document)))
                else:
                    rows.append(("head", part, key, document.text, *[None] * len(NAMES)))
                started, before, before_id = True, document, key
            if rows:
                yield pd.DataFrame(rows, columns=["kind", "part", "id", "text", *NAMES], dtype=object)
        if started:
            rows = [("tail", part, before_id, before.text, *[None] * len(NAMES))]
            yield pd.DataFrame(rows, columns=["kind", "part", "id", "text", *NAMES], dtype=object)

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *Document(a).against(Document(b))) for k, a, b in zip(frame["id"], frame["text"], frame["after"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", *NAMES], dtype=object)

    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    # Range partitions keep their order, so part numbers order the ranges.
    ordered = rows.repartitionByRange(F.desc_nulls_last("id")).sortWithinPartitions(F.desc_nulls_last("id"), "text")
    done = materialize(ordered.mapInPandas(stream, f"kind string, part int, id {kind}, text string, {KINDS}"), "fingerprints")
    parts = sorted(r["part"] for r in done.where("kind = 'head'").select("part").collect())  # one number per task
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = done.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    tails = done.where("kind = 'tail'").select("part", "id", "text").join(follows, "part").join(heads, "next_part")
    closed = tails.select("id", "text", "after").mapInPandas(close, f"id {kind}, {KINDS}")
    return done.where("kind = 'row'").select("id", *NAMES).unionByName(closed).withColumnRenamed("id", id_col)
