"""Near duplicates by circulant MinHash, confirmed by exact Jaccard similarity.

Two permutations of the 32-bit numbers make all signature coordinates: the first scatters a shingle, the second is
applied to the scattered number after a circular shift by a step per coordinate. Bands of four coordinates give bucket
keys; at a similarity of 0.8 a pair shares none of 32 bands with a chance of 5 in 10^8.

Texts with equal shingle sets collapse to one representative first. Buckets then need components, not pairs: in each
of a few rounds every bucket whose members lie in more than one component compares them with one hub, and verified
links join components. What is left are buckets of texts that collide without being similar, such as those that share
a passage. Small ones pair their members across components; members of larger ones meet in blocks, in which one task
compares all sets of two blocks at once and returns links only. Every check compares full sets.

Edge cases: a null text, or one without words, has an empty set and is linked with nothing. A text shorter than a
shingle has its word sequence as its only shingle. Repeated rows of one id are one document; each gives a row. A row
with a null id is kept as its own component (null). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import small_batches
from citeloom.session import materialize

BANDS, ROWS = 32, 4
STAR_ROUNDS = 2
SMALL_BUCKET = 24
BLOCK = 512  # sets
SLICE = 8192  # shingles that are compared at once
WORDS = 100_000  # word hashes that a worker keeps
U32, U64 = np.uint32, np.uint64


def _scatter(x: np.ndarray) -> np.ndarray:
    """First permutation, of 64-bit numbers; its upper half is the scattered 32-bit number."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _permute(x: np.ndarray) -> np.ndarray:
    """Second permutation, of 32-bit numbers."""
    x ^= x >> U32(16)
    x *= U32(0x85EBCA6B)
    x ^= x >> U32(13)
    x *= U32(0xC2B2AE35)
    x ^= x >> U32(16)
    return x


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingle_sets(texts: list[str | None], width: int, words: dict[bytes, int]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text. Only ASCII letters are lower-cased, only ASCII space splits."""
    sets = []
    for text in texts:
        split = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not split:
            sets.append(np.empty(0, U64))
            continue
        hashed = np.fromiter(map(words.__getitem__, split), U64, len(split))
        n = min(width, len(hashed))
        mixed = np.full(len(hashed) - n + 1, n, U64)
        for i in range(n):
            mixed = _scatter(mixed * U64(0x9E3779B97F4A7C15) + hashed[i : i + len(mixed)])
        sets.append(np.unique(mixed))
    return sets


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64-bit bucket keys, one line of ``bands`` for each set that is not empty."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.empty((0, bands), np.int64)
    starts = np.cumsum([0] + [len(s) for s in full[:-1]])
    scattered = (_scatter(np.concatenate(full)) >> U64(32)).astype(U32)
    keys = np.empty((len(full), bands), U64)
    for band in range(bands):
        key = np.full(len(full), band + 1, U64)
        for row in range(rows):
            shift = U32((band * rows + row + 1) * 0x9E3779B1 & 0xFFFFFFFF)
            least = np.minimum.reduceat(_permute(scattered + shift), starts)
            key = _scatter(key * U64(0x9E3779B97F4A7C15) + least)
        keys[:, band] = key
    return keys.view(np.int64)


def signatures(documents: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(id, n_shingles, set_key, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = shingle_sets(batch.column(text).to_pylist(), width, words)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
            lines = iter(band_keys(sets))
            bands = [next(lines) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=[id_col, "n_shingles", "set_key", "bands"],
            )

    small_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text).mapInArrow(
        run, f"{id_col} {kind}, n_shingles long, set_key string, bands array<long>"
    )


def full_sets(documents: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(doc, shingles): the whole set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(text).to_pylist(), width, words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "shingles"]
            )

    small_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("doc"), text).mapInArrow(run, f"doc {kind}, shingles array<long>")


def _alike(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb") - shared).alias("u")).where(
        F.col("i") * 100 >= F.col("u") * percent
    ).select("a", "b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(doc, comp): the smallest vertex that each vertex of the edges (a, b) can reach.

    Minimum labels spread over edges and then jump to the labels of labels, so paths shorten by halves.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges"
    )
    labels = materialize(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels, both["a"] == labels["doc"]).groupBy(F.col("b").alias("doc")).agg(F.min("comp").alias("near"))
        nearer = materialize(
            labels.join(heard, "doc").select("doc", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), f"{name}-a{step}"
        )
        above = nearer.select(F.col("doc").alias("comp"), F.col("comp").alias("top"))
        jumped = materialize(nearer.join(above, "comp").select("doc", "was", F.col("top").alias("comp")), f"{name}-b{step}")
        labels = jumped.select("doc", "comp")
        if jumped.where("was <> comp").isEmpty():
            return labels


def _with_components(members: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return members.withColumn("comp", F.col("doc"))
    return members.join(found, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def _open(members: DataFrame) -> DataFrame:
    """Keys whose members lie in more than one component."""
    return members.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")
    ).where("lo < hi")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of one key in different components whose sizes permit the similarity."""
    other = members.select("key", F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    met = members.join(other, "key").where((F.col("doc") < F.col("b")) & (F.col("comp") != F.col("comp_b")))
    return met.where(_alike(F.col("n"), F.col("n_b"), percent)).select(F.col("doc").alias("a"), "b").distinct()


def similar_in_block(shingles: list[np.ndarray], comps: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Index pairs, one of ``left`` and one of ``right``, of similar sets in different components."""
    sizes = np.array([len(s) for s in shingles])
    owner = np.repeat(np.arange(len(shingles)), sizes)
    _, number, times = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    shared = times > 1  # others add nothing to an intersection
    place = np.cumsum(shared) - 1
    keep = shared[number]
    owner, number = owner[keep], place[number[keep]]
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    both = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for first in range(0, int(shared.sum()), SLICE):
        a, b = np.searchsorted(number, (first, first + SLICE))
        held = np.zeros((len(shingles), SLICE), np.float32)
        held[owner[a:b], number[a:b] - first] = 1
        both += held[rows] @ held[columns].T
    both = both.astype(np.int64)
    union = sizes[rows][:, None] + sizes[columns][None, :] - both
    fits = (100 * both >= percent * union) & (comps[rows][:, None] != comps[columns][None, :])
    return [(int(rows[i]), int(columns[j])) for i, j in zip(*np.nonzero(fits), strict=True)]


def _links_in_blocks(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Similar pairs (a, b) across the components of each key. A key is cut into blocks by a hash of the id, and a task
    compares two blocks, so it holds two blocks of sets and a row goes to as many tasks as its key has blocks."""
    kind = members.schema["doc"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        docs, own = frame["doc"].to_numpy(), frame["own"].to_numpy()
        comps = frame["comp"].to_numpy()
        found = []
        if (comps != comps[0]).any():
            i, j = frame["i"].iloc[0], frame["j"].iloc[0]
            found = similar_in_block([np.asarray(s) for s in frame["shingles"]], comps, own == i, own == j, percent)
        return pd.DataFrame({"a": [docs[x] for x, _ in found], "b": [docs[y] for _, y in found]})

    blocks = F.ceil(F.col("size") / block)
    own = F.pmod(F.xxhash64("doc", F.lit(1)), blocks)
    dealt = members.withColumns({"blocks": blocks, "own": own}).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    ).select("key", "doc", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.join(sets, "doc").groupBy("key", "i", "j").applyInPandas(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(
    documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text",
    star_rounds: int = STAR_ROUNDS, small_bucket: int = SMALL_BUCKET, block: int = BLOCK,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; ``percent`` is the least similarity in hundredths."""
    rows = documents.select(id_col, text)
    signed = materialize(signatures(rows, id_col, text, width), "near-signatures")
    classes = materialize(
        signed.where("set_key is not null").groupBy("set_key").agg(F.min(id_col).alias("doc")), "near-classes"
    )
    chosen = signed.join(classes, (signed["set_key"] == classes["set_key"]) & (signed[id_col] == classes["doc"]), "left_semi")
    banded = materialize(
        chosen.select(F.col(id_col).alias("doc"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key")).distinct(), "near-bands"
    )
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    members = materialize(banded.join(shared, "key", "left_semi"), "near-members")
    sets = materialize(
        full_sets(rows.join(members.select(F.col("doc").alias(id_col)).distinct(), id_col, "left_semi"), id_col, text, width),
        "near-sets",
    )

    links, found = None, None

    def join_links(pairs: DataFrame, name: str) -> None:
        nonlocal links, found
        fresh = materialize(_verified(pairs, sets, percent), f"near-links-{name}")
        links = fresh if links is None else links.unionByName(fresh)
        found = components(links, f"near-{name}")

    for number in range(star_rounds):
        placed = materialize(_with_components(members, found), f"near-placed-{number}")
        hub = F.min_by(F.struct("doc", "n", "comp"), F.xxhash64(F.col("doc"), F.lit(number)) if number else F.col("doc"))
        hubs = placed.groupBy("key").agg(hub.alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        hubs = materialize(hubs.where("lo < hi").select("key", "hub"), f"near-hubs-{number}")
        pairs = placed.join(hubs, "key").where(
            (F.col("comp") != F.col("hub.comp")) & _alike(F.col("n"), F.col("hub.n"), percent)
        ).select(F.col("doc").alias("a"), F.col("hub.doc").alias("b")).distinct()
        join_links(pairs, f"star-{number}")

    placed = materialize(_with_components(members, found), "near-rest")
    left = materialize(_open(placed).select("key", "size"), "near-open")
    small = placed.join(left.where(F.col("size") <= small_bucket), "key", "left_semi")
    join_links(_across(small, percent), "small")
    large = members.join(left.where(F.col("size") > small_bucket), "key")
    if not large.isEmpty():
        large = materialize(_with_components(large, found), "near-large")
        fresh = materialize(_links_in_blocks(large, sets, percent, block), "near-links-large")
        links = links.unionByName(fresh)
        found = components(links, "near-large")

    named = classes if found is None else classes.join(found, "doc", "left").select(
        "set_key", F.coalesce("comp", "doc").alias("doc"))
    named = materialize(named.select("set_key", F.col("doc").alias("component_id")), "near-named")
    out = signed.select(id_col, "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", F.col(id_col))
    return out.select(
        id_col, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept")
    )


def deduplicated(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents with one of each group; of rows that share an id one stays. Rows with a null id all stay."""
    marked = near_duplicates(documents, id_col=id_col, **options).select(F.col(id_col).alias("__id"), "kept")
    going = marked.where(~F.col("kept")).select("__id").distinct()
    left = documents.join(going, documents[id_col] == going["__id"], "left_anti")
    repeated = marked.where("__id is not null").groupBy("__id").count().where("count > 1")
    if repeated.isEmpty():
        return left
    columns = documents.columns
    again = left.join(repeated.select("__id"), left[id_col] == F.col("__id"), "left_semi")
    one = again.groupBy(id_col).agg(F.min(F.struct(*[c for c in columns if c != id_col])).alias("__row"))
    one = one.select(*[F.col(c) if c == id_col else F.col("__row")[c].alias(c) for c in columns])
    return left.join(repeated.select("__id"), left[id_col] == F.col("__id"), "left_anti").unionByName(one)
