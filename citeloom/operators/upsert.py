"""Keyed snapshots: stored rows and a batch become the next snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import axv_doc_id
from citeloom.functions.text import strip
from citeloom.schemas import PAPERS


def _ordered_union(stored: DataFrame, batch: DataFrame, seq: str) -> DataFrame:
    old = stored.withColumn("__at", F.struct(F.lit(0).alias("phase"), F.lit(0).cast("long").alias("seq")))
    new = batch.withColumn("__at", F.struct(F.lit(1).alias("phase"), F.col(seq).cast("long").alias("seq"))).drop(seq)
    return old.unionByName(new, allowMissingColumns=True)


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str, keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Latest row per key; columns in ``keep_if_null`` keep their last value that was not null."""
    rest = [c for c in stored.columns if c not in keys and c not in keep_if_null]
    latest = F.max_by(F.struct(*rest), F.col("__at")).alias("__row")
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c) for c in keep_if_null]
    folded = _ordered_union(stored, batch, seq).groupBy(*keys).agg(latest, *kept)

    def out(c: str) -> Column:
        return F.col(c) if c in keys or c in keep_if_null else F.col("__row")[c].alias(c)

    return folded.select(*[out(c) for c in stored.columns])


def upsert_papers(papers: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """``batch`` carries ``authors`` as an array; the content hash survives a batch that has none."""
    rows = batch.withColumns(
        {
            "doc_id": strip(F.coalesce(F.nullif("doc_id", F.lit("")), axv_doc_id("arxiv_id_with_version"))),
            "authors_json": F.array_join("authors", ", "),
        }
    ).drop("authors")
    return upsert(papers, rows, ["arxiv_id"], seq, ["content_sha256"]).select(*PAPERS.fieldNames())


def upsert_chunks(chunks: DataFrame, batch: DataFrame, seq: str = "seq", replace_doc: bool = False) -> DataFrame:
    """New chunk values win. ``replace_doc`` also drops stored chunks of a re-ingested document."""
    default_id = F.when(F.col("arxiv_id") != "", axv_doc_id("arxiv_id"))
    rows = batch.withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), default_id))
    if replace_doc:
        chunks = chunks.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select(*chunks.columns)
    return upsert(chunks, rows, ["chunk_id"], seq)


def upsert_vectors(vectors: DataFrame, batch: DataFrame, seq: str = "seq", dimension: int | None = None) -> DataFrame:
    """New vectors win. With ``dimension`` a vector of another length stops the job instead of a later search."""
    if dimension is not None:
        wrong = F.concat(F.lit(f"vector of another dimension than {dimension}: "), F.col("chunk_id").cast("string"))
        fits = F.size("embedding") == dimension
        batch = batch.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(wrong)))
    return upsert(vectors, batch, ["chunk_id"], seq)


def upsert_metrics(metrics: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    return upsert(metrics, batch, ["arxiv_id"], seq)


def set_versions(papers: DataFrame, versions: DataFrame) -> DataFrame:
    """Version fields of stored papers from (arxiv_id, arxiv_id_with_version, version); others stay."""
    new = versions.select(
        "arxiv_id", F.col("arxiv_id_with_version").alias("__versioned"), F.col("version").alias("__version")
    )
    hit = F.col("__versioned").isNotNull()
    return (
        papers.join(new, "arxiv_id", "left")
        .withColumns(
            {
                "doc_id": F.when(hit, axv_doc_id("__versioned")).otherwise(F.col("doc_id")),
                "version": F.when(hit, F.col("__version")).otherwise(F.col("version")),
                "arxiv_id_with_version": F.coalesce("__versioned", "arxiv_id_with_version"),
            }
        )
        .select(*papers.columns)
    )


def changed_content(documents: DataFrame, known: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Documents (doc_id, text) to process again: new, with another text hash, or forced."""
    hashed = documents.withColumn("content_sha256", F.sha2("text", 256))
    changed = hashed.join(known.select("doc_id", "content_sha256"), ["doc_id", "content_sha256"], "left_anti")
    if forced is None:
        return changed
    again = hashed.join(forced.select("doc_id").distinct(), "doc_id", "left_semi")
    fresh = again.join(known.select("doc_id", "content_sha256"), ["doc_id", "content_sha256"], "left_semi")
    return changed.unionByName(fresh.select(*changed.columns))
