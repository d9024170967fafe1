"""Approximate nearest neighbours: vectors in cells around centroids, of which a query probes the nearest.

Centroids are fitted by k-means on a sample of about ``sample_rows`` vectors, a bound that is a parameter; every vector is then
assigned to its cell and stored in a table with one folder per cell. About ``tuning_vectors`` of them are searched exactly; how
many cells a query has to probe is read off from where their true neighbours lie. A batch of queries reads only the folders of the cells
that some query probes, and a task scores a vector only with the queries that probe its cell. The exact search stays
``vector.nearest``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS, Settings
from citeloom.operators.ordered import measured_broadcast
from citeloom.operators.topk import best_per_row, hits_batch, merge_best, rank_within
from citeloom.operators.vector import HITS, SCORE_DIGITS, _matrix, _unit_rows, checked_vectors, nearest, query_slices
from citeloom.session import materialize, shared_path


@dataclass(frozen=True)
class ProbedIndex:
    table: DataFrame        # chunk_id, embedding, cell; one folder per cell
    centroids: np.ndarray   # unit rows, one per cell
    probes: int             # cells that hold ``settings.tuned_recall`` of the true neighbours of the tuning vectors

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]


def build_index(vectors: DataFrame, cells: int | None = None, settings: Settings = DEFAULTS, seed: int = 7) -> ProbedIndex:
    """Cells for all ``vectors`` (chunk_id, embedding); by default about the square root of their number."""
    spark = vectors.sparkSession
    rows = vectors.select("chunk_id", "embedding")
    n = rows.count()
    first = rows.select(F.size("embedding").alias("n")).first()
    dimension = first["n"] if first else 0
    rows = checked_vectors(rows, dimension)
    cells = max(1, min(settings.most_cells, round(n**0.5))) if cells is None else cells
    # A hash of the id draws the sample, so a repeated run draws the same one.
    drawn = F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, settings.sample_vectors / max(n, 1)))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("embedding", lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)).cast("double"))
    sample = rows.where(drawn).select(array_to_vector(unit).alias("features"))
    if n == 0:
        centroids = np.zeros((1, dimension))
    else:
        fitted = KMeans(k=max(cells, 2), seed=seed, maxIter=10).fit(sample)
        centroids = _unit_rows(np.array([c.tolist() if hasattr(c, "tolist") else c for c in fitted.clusterCenters()]))
    shared = spark.sparkContext.broadcast(centroids)  # cells x dimension numbers, both bounded

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = (_unit_rows(_matrix(batch.column("embedding"))) @ shared.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["chunk_id", "embedding", "cell"])

    kind = rows.schema["embedding"].dataType.simpleString()
    assigned = rows.mapInArrow(assign, f"chunk_id string, embedding {kind}, cell int")
    # Several tasks write a cell, so that a cell with a large share of the vectors does not fill one.
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(settings.salts))
    path = shared_path(spark, "cells")
    assigned.repartition("cell", spread).write.partitionBy("cell").parquet(path)
    table = spark.read.schema(assigned.schema).parquet(path)
    return ProbedIndex(table, centroids, _tuned_probes(table, centroids, n, settings, seed))


def _tuned_probes(table: DataFrame, centroids: np.ndarray, n: int, settings: Settings, seed: int) -> int:
    drawn = F.pmod(F.xxhash64(F.lit(seed + 1), "chunk_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, settings.tuning_vectors / max(n, 1)))
    asked = table.where(drawn).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    true = nearest(asked, table, settings.vector_k, settings.max_broadcast_bytes).select("query_id", "chunk_id")
    true = measured_broadcast(materialize(true, "tuning"), settings.max_broadcast_bytes)
    found = table.select("chunk_id", "cell").join(true, "chunk_id").select("query_id", "cell").toArrow()  # tuning_vectors x k rows
    head = asked.toArrow()
    if not found.num_rows:
        return 1
    order = np.argsort(-(_unit_rows(_matrix(head.column("vector"))) @ centroids.T), axis=1, kind="stable")
    place = {q: np.argsort(cells) for q, cells in zip(head.column("query_id").to_pylist(), order, strict=True)}
    needed = np.sort([place[q][c] + 1 for q, c in zip(found.column("query_id").to_pylist(), found.column("cell").to_pylist(), strict=True)])
    return int(needed[min(len(needed), math.ceil(settings.tuned_recall * len(needed))) - 1])


def nearest_probed(
    queries: DataFrame, index: ProbedIndex, k: int = DEFAULTS.vector_k, probes: int | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Top-k vectors per query among those in its ``probes`` (by default as many as were tuned) nearest cells: (query_id, chunk_id, score, rank)."""
    spark, cells = index.table.sparkSession, len(index.centroids)
    probes = min(cells, index.probes if probes is None else probes)
    rows = queries.select("query_id", "vector")
    schema = HITS.format(id_type=rows.schema["query_id"].dataType.simpleString())
    partial = None
    for head in query_slices(rows, index.dimension, settings.max_broadcast_bytes) if index.centroids.size else ():
        unit = _unit_rows(_matrix(head.column("vector")))
        nearness = unit @ index.centroids.T
        near = np.argpartition(-nearness, probes - 1, axis=1)[:, :probes]
        asked = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((head.column("query_id").to_pandas().to_numpy(), unit, asked))
        found = index.table.where(F.col("cell").isin(sorted(asked))).mapInArrow(_scorer(shared, k), schema)
        partial = found if partial is None else partial.unionByName(found)
    if partial is None:
        partial = spark.createDataFrame([], schema)
    return rank_within(partial, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _scorer(shared, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, unit, asked = shared.value
        best = [(np.empty(0), np.empty(0, dtype=object))] * len(query_ids)
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            ids = batch.column("chunk_id").to_pandas().to_numpy(dtype=object)
            for c in np.unique(cell):
                at, wanted = np.flatnonzero(cell == c), asked[int(c)]
                rows = _unit_rows(_matrix(batch.column("embedding").take(pa.array(at))))
                block = best_per_row(np.round(unit[wanted] @ rows.T, SCORE_DIGITS), ids[at], k)
                for q, kept in zip(wanted, merge_best([best[q] for q in wanted], block, k), strict=True):
                    best[q] = kept
        if any(len(ids) for _, ids in best):
            yield hits_batch(query_ids, best)

    return score
