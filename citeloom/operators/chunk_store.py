"""The text of hits: chunks in buckets of their id, sorted by it, which hits meet without a scan or a shuffle of all chunks; or no stored
chunks at all, the documents of the hits are cut again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS, Settings
from citeloom.operators.chunking import chunk_sections
from citeloom.operators.ordered import measured_broadcast
from citeloom.session import shared_path


def store_chunks(chunks: DataFrame, settings: Settings = DEFAULTS, buckets: int | None = None) -> DataFrame:
    """The chunks as a table of ``buckets`` buckets (default: by the number of rows)."""
    if buckets is None:
        buckets = min(settings.most_chunk_buckets, max(8, -(-chunks.count() // settings.chunk_rows_per_bucket)))
    # One task writes one bucket; an exchange on the key keeps the number of files at the number of buckets.
    return store_buckets(chunks.repartition(buckets, "chunk_id"), "chunk_id", buckets, "chunks")


def store_buckets(dealt: DataFrame, key: str, buckets: int, name: str, in_order: bool = True) -> DataFrame:
    """Rows that are dealt out by ``key`` as a table of as many buckets, sorted by it unless only their place matters."""
    spark, table = dealt.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = dealt.write.bucketBy(buckets, key).option("compression", "zstd")
    writer = writer.sortBy(key) if in_order else writer
    writer.option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def with_payload(store: DataFrame, hits: DataFrame, columns: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """``hits`` (a stored table with chunk_id) with columns of their chunks.

    Up to ``pruned_ids`` different ids become a filter, so that only their buckets, and there the row groups around them, are
    read; more ids meet the buckets in a join that moves hits, not chunks.
    """
    payload = store.select("chunk_id", *columns)
    ids = [r["chunk_id"] for r in hits.select("chunk_id").distinct().limit(settings.pruned_ids + 1).collect()]
    if len(ids) > settings.pruned_ids:
        return payload.join(hits, "chunk_id")
    return payload.where(F.col("chunk_id").isin(ids)).join(measured_broadcast(hits, settings.max_broadcast_bytes), "chunk_id")


def cut_again(papers: DataFrame, hits: DataFrame, columns: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """``hits`` (a stored table with chunk_id) with columns of their chunks, cut anew from ``papers`` (as ``chunk_sections`` takes them).

    Only documents that a hit names are cut: their ids meet the rows where these are read, so no text is stored or moved for the rest.
    """
    owner = F.regexp_replace("chunk_id", r":\d+$", "")
    owners = measured_broadcast(hits.select(owner.alias("doc_id")).distinct(), settings.max_broadcast_bytes)
    chunks = chunk_sections(papers.join(owners, "doc_id", "left_semi"), settings.chunk_max_chars, settings.chunk_overlap_chars)
    return chunks.select("chunk_id", *columns).join(measured_broadcast(hits, settings.max_broadcast_bytes), "chunk_id")
