"""Job settings. Everything that changes a result is a parameter, never a global."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults that decide results.
    chunk_max_chars: int = 1200
    chunk_overlap_chars: int = 200
    vector_k: int = 12
    keyword_k: int = 12
    top_k: int = 8
    max_per_doc: int = 4
    rrf_k: int = 60
    relevance_threshold: float = 0.45
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    candidate_retry_days: int = 14
    candidate_max_retries: int = 5
    embed_batch_size: int = 16
    metadata_batch_size: int = 500
    embedding_dimension: int | None = None  # vectors of another length stop ingestion
    router_min_confidence: float = 0.55
    enable_decision_mode: bool = True
    eval_min_sources: int = 6

    # Execution knobs: they change the plan, never the rows.
    queue_batch_size: int | None = None  # ready candidates per pass; None takes all at once
    salts: int = 8
    max_broadcast_bytes: int = 64 * 1024 * 1024
    sample_vectors: int = 20_000  # that centroids are fitted on
    most_cells: int = 1024
    tuning_vectors: int = 200
    tuned_recall: float = 0.95
    postings_buckets: int = 64
    snapshot_parts: int = 64
    rows_per_salt: int = 1_000_000
    most_salts: int = 512
    chunk_rows_per_bucket: int = 200_000
    most_chunk_buckets: int = 4096
    pruned_ids: int = 10_000
    rows_per_numbering_bucket: int = 1_000_000


DEFAULTS = Settings()
