"""Exact cosine nearest neighbours for many queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS
from citeloom.operators.topk import best_per_row, block_rows, hits_batch, merge_best, rank_within

HITS = "query_id {id_type}, chunk_id string, score double"
SCORE_DIGITS = 9


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two array columns."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def checked_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """Fail the job when a vector has another dimension than the table."""
    size = F.size("embedding")
    wrong = F.concat(F.lit(f"vector dimension is not {dimension}: "), size.cast("string"))
    return vectors.withColumn("embedding", F.when(size == dimension, F.col("embedding")).otherwise(F.raise_error(wrong)))


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _score_block(query_matrix: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int):
    # The same pair must score the same in every block shape, hence the rounding.
    return best_per_row(np.round(query_matrix @ _unit_rows(matrix).T, SCORE_DIGITS), ids, k)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def query_slices(queries: DataFrame, dimension: int, max_broadcast_bytes: int) -> Iterator[pa.Table]:
    """The query batch (query_id, vector) in slices that each fit ``max_broadcast_bytes``, by a hash of the id."""
    room = max(1, max_broadcast_bytes // (8 * max(dimension, 1)))
    head = queries.limit(room + 1).toArrow()
    if head.num_rows <= room:
        slices = iter([head])
    else:
        # Hash slices vary a little in size; half the room keeps every slice near the bound.
        n = math.ceil(2 * queries.count() / room)
        slices = (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow() for i in range(n))
    return (s for s in slices if s.num_rows)


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = DEFAULTS.vector_k, max_broadcast_bytes: int = DEFAULTS.max_broadcast_bytes,
) -> DataFrame:
    """Top-k vectors per query: (query_id, chunk_id, score, rank).

    ``queries`` holds (query_id, vector), ``vectors`` holds (chunk_id, embedding). Pairs are scored as matrix
    products and never become rows: each task emits at most k rows per query. A query batch that fits
    ``max_broadcast_bytes`` travels to the vectors, which are read in place without any shuffle; a larger
    one travels in slices, one after the other, and each reads the vectors once.
    """
    first = queries.select(F.size("vector").alias("n")).first()
    dimension = first["n"] if first else 0
    query_vectors = queries.select("query_id", "vector")
    schema = HITS.format(id_type=query_vectors.schema["query_id"].dataType.simpleString())
    corpus = checked_vectors(vectors.select("chunk_id", "embedding"), dimension)
    partial = corpus.sparkSession.createDataFrame([], schema)
    for at, head in enumerate(query_slices(query_vectors, dimension, max_broadcast_bytes) if first else ()):
        found = _against_broadcast(head, corpus, k, schema)
        partial = found if at == 0 else partial.unionByName(found)
    return rank_within(partial, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _against_broadcast(head: pa.Table, corpus: DataFrame, k: int, schema: str) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(
        (head.column("query_id").to_pandas().to_numpy(), _unit_rows(_matrix(head.column("vector"))))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = shared.value
        best, held, held_rows = None, [], 0
        step = block_rows(len(query_ids))

        def flush():
            nonlocal best, held, held_rows
            table = pa.Table.from_batches(held)
            ids = table.column("chunk_id").to_pandas().to_numpy(dtype=object)
            best = merge_best(best, _score_block(query_matrix, _matrix(table.column("embedding")), ids, k), k)
            held, held_rows = [], 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                held_rows += batch.num_rows
                if held_rows >= step:
                    flush()
        if held:
            flush()
        if best is not None:
            yield hits_batch(query_ids, best)

    return corpus.mapInArrow(score, schema)
