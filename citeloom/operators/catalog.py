"""Catalogue pages, paper details and corpus counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import has_version, public_paper_id
from citeloom.functions.text import blank_to_null, parse_authors, strip


def matches_search(search: str) -> Column:
    """Case-insensitive substring of id, document id or title; '%' and '_' act as wildcards."""
    pattern = F.lit(f"%{search.strip()}%")
    return F.ilike(F.col("arxiv_id"), pattern) | F.ilike(F.col("doc_id"), pattern) | F.ilike(F.col("title"), pattern)


def catalogue(papers: DataFrame, chunks: DataFrame, metrics: DataFrame, search: str = "") -> DataFrame:
    """Papers with chunk counts and metrics. Chunks are counted before the join."""
    shown = papers.filter(matches_search(search)) if search.strip() else papers
    counts = chunks.groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    facts = metrics.select("arxiv_id", "tier", "citation_count", "venue")
    return (
        shown.join(counts, "arxiv_id", "left")
        .join(facts, "arxiv_id", "left")
        .select(
            "doc_id", "arxiv_id", public_paper_id("arxiv_id", "doc_id").alias("public_id"), "title", "summary", "published",
            "updated", parse_authors("authors_json").alias("authors"), "pdf_url", "abs_url",
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "tier", "citation_count", "venue",
        )
    )


def catalogue_page(
    papers: DataFrame, chunks: DataFrame, metrics: DataFrame, offset: int, limit: int, search: str = ""
) -> tuple[DataFrame, DataFrame]:
    """One page, newest first, and the total in a frame of its own.

    The page is cut before the joins, so chunks and metrics are matched against a page of papers only.
    """
    shown = papers.filter(matches_search(search)) if search.strip() else papers
    newest = [F.desc("published"), F.desc("arxiv_id")]
    page = shown.orderBy(*newest).offset(offset).limit(limit)
    of_page = chunks.join(page.select("arxiv_id"), "arxiv_id", "left_semi")
    return catalogue(page, of_page, metrics).orderBy(*newest), shown.agg(F.count(F.lit(1)).alias("total"))


def paper_details(ids: DataFrame, papers: DataFrame, chunks: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers of an id table with metrics, and their chunks in order."""
    wanted = ids.select("arxiv_id").distinct()
    parts = chunks.join(wanted, "arxiv_id", "left_semi")
    details = catalogue(papers.join(wanted, "arxiv_id", "left_semi"), parts, metrics)
    return details, parts.orderBy("arxiv_id", "chunk_index")


def corpus_counts(papers: DataFrame, chunks: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per count: (metric, n)."""
    without = papers.join(metrics.select("arxiv_id"), "arxiv_id", "left_anti")

    def rows(df: DataFrame, name: str, value: Column = F.count(F.lit(1))) -> DataFrame:
        return df.agg(value.alias("n")).select(F.lit(name).alias("metric"), "n")

    return (
        rows(papers, "papers")
        .unionByName(rows(chunks, "chunks"))
        .unionByName(rows(chunks, "chunk_docs", F.count_distinct("arxiv_id")))
        .unionByName(rows(metrics, "metrics"))
        .unionByName(rows(without, "papers_without_metrics"))
    )


def orphan_files(files: DataFrame, papers: DataFrame) -> DataFrame:
    """File names on disk that no paper points to."""
    name = F.element_at(F.split(F.regexp_replace("pdf_path", "/+$", ""), "/"), -1)
    indexed = papers.filter(F.trim("pdf_path") != "").select(name.alias("file_name")).distinct()
    return files.select("file_name").distinct().join(indexed, "file_name", "left_anti")


def ingested_versions(papers: DataFrame) -> DataFrame:
    return papers.select(blank_to_null("arxiv_id_with_version").alias("arxiv_id_with_version")).filter(
        F.col("arxiv_id_with_version").isNotNull()
    ).distinct()


def legacy_unversioned(papers: DataFrame) -> DataFrame:
    """Base ids of papers stored without a version."""
    base = strip("arxiv_id")
    versioned = strip(F.coalesce("arxiv_id_with_version", F.lit("")))
    legacy = papers.filter((base != "") & ~base.contains(":") & ~has_version(versioned))
    return legacy.select(base.alias("arxiv_id")).distinct().orderBy("arxiv_id")


def paper_ids(papers: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = papers.select("arxiv_id").orderBy("arxiv_id")
    return ordered if limit is None else ordered.limit(limit)
