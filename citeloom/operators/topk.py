"""Top-k per query: the final ranking in Spark and the per-task reduction before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCORE_CELLS = 1 << 23

Best = list[tuple[np.ndarray, np.ndarray]]


def rank_within(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Top k per key; Spark keeps k rows per key and task before it shuffles."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def block_rows(n_queries: int) -> int:
    """Rows scored at a time, so that a score matrix stays near 64 MB."""
    return min(16_384, max(64, SCORE_CELLS // max(n_queries, 1)))


def best_per_row(scores: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """Scores and ids of the k best cells of every row, ties by id; cells of -inf never count."""
    if scores.shape[1] > k:
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        bar = np.take_along_axis(scores, top, axis=1).min(axis=1)
        tied = (scores >= bar[:, None]).sum(axis=1) > k
    else:
        top = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        bar, tied = np.full(len(scores), -np.inf), np.zeros(len(scores), dtype=bool)
    best = []
    for row, picks, low, has_tie in zip(scores, top, bar, tied):
        # On a tie at the bar every such cell stays in play, so the id decides and not the layout.
        pool = np.flatnonzero(row >= low) if has_tie else picks
        pool = pool[row[pool] > -np.inf]
        pool = pool[np.lexsort((ids[pool], -row[pool]))][:k]
        best.append((row[pool], ids[pool]))
    return best


def merge_best(best: Best | None, block: Best, k: int) -> Best:
    if best is None:
        return block
    merged = []
    for (s0, i0), (s1, i1) in zip(best, block):
        scores, ids = np.concatenate([s0, s1]), np.concatenate([i0, i1])
        keep = np.lexsort((ids, -scores))[:k]
        merged.append((scores[keep], ids[keep]))
    return merged


def hits_batch(query_ids: np.ndarray, best: Best, sign: float = 1.0, key: str = "query_id") -> pa.RecordBatch:
    counts = [len(ids) for _, ids in best]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(query_ids, counts)),
            pa.array(np.concatenate([ids for _, ids in best]), pa.string()),
            pa.array(sign * np.concatenate([scores for scores, _ in best])),
        ],
        names=[key, "chunk_id", "score"],
    )
