"""DOI resolution against a landed cache of work records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import axv_doc_id, normalize_paper_id
from citeloom.functions.text import blank_to_null


def open_access_location(best: Column, primary: Column, locations: Column) -> Column:
    """STRUCT<pdf_url, landing_page_url, license, is_oa, source> of the location to use."""

    def take(location: Column, source: str, with_pdf: bool = True) -> Column:
        pdf = blank_to_null(location["pdf_url"]) if with_pdf else F.lit(None).cast("string")
        return F.struct(
            pdf.alias("pdf_url"), blank_to_null(location["landing_page_url"]).alias("landing_page_url"),
            blank_to_null(location["license"]).alias("license"), location["is_oa"].alias("is_oa"),
            F.lit(source).alias("source"),
        )

    def has_pdf(location: Column) -> Column:
        return blank_to_null(location["pdf_url"]).isNotNull()

    open_one = F.get(F.filter(locations, lambda x: F.coalesce(x["is_oa"], F.lit(False)) & has_pdf(x)), F.lit(0))
    return (
        F.when(has_pdf(best), take(best, "best_oa_location"))
        .when(has_pdf(primary), take(primary, "primary_location"))
        .when(has_pdf(open_one), take(open_one, "locations"))
        .otherwise(take(F.coalesce(best, primary), "none", with_pdf=False))
    )


def resolve_dois(dois: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per DOI with ``cache_state``: resolved, missing (a cached 404) or uncached.

    ``dois`` holds (doi, seq); ``cache`` holds the cache key, the WORK fields and is joined on the hash.
    """
    unique = dois.groupBy("doi").agg(F.min("seq").alias("seq"))
    joined = unique.withColumn("cache_key", F.sha2("doi", 256)).join(cache, "cache_key", "left")
    known, negative = F.col("cached"), F.col("_status") == 404
    state = F.when(known.isNull(), "uncached").when(negative, "missing").otherwise("resolved")
    place = open_access_location(F.col("best_oa_location"), F.col("primary_location"), F.col("locations"))
    paper = F.nullif(normalize_paper_id(blank_to_null("ids.arxiv")), F.lit(""))
    return joined.select(
        "doi", "seq", state.alias("cache_state"), blank_to_null("id").alias("openalex_id"), paper.alias("arxiv_id"), place.alias("place"),
    ).select("doi", "seq", "cache_state", "openalex_id", "arxiv_id", "place.*")


def resolution_rows(resolved: DataFrame, resolved_at: int) -> DataFrame:
    """Resolved DOIs as document resolutions with ``seq``."""
    paper, pdf = F.col("arxiv_id"), F.col("pdf_url")
    return resolved.filter(F.col("cache_state") == "resolved").select(
        F.coalesce(axv_doc_id(paper), F.concat(F.lit("doi:"), "doi")).alias("doc_id"), paper.alias("arxiv_id"),
        paper.alias("arxiv_id_with_version"), "doi", pdf.alias("pdf_url"),
        F.when(paper.isNotNull(), 0.95).when(pdf.isNotNull(), 0.75).otherwise(0.30).alias("resolution_confidence"),
        F.lit("openalex_resolved").alias("source_kind"), F.lit(resolved_at).cast("long").alias("resolved_at_unix"), "seq",
    )


def resolution_totals(resolved: DataFrame) -> DataFrame:
    is_resolved = F.col("cache_state") == "resolved"
    return resolved.agg(
        F.count(F.lit(1)).alias("dois_processed"), F.count_if(is_resolved).alias("resolved_records"),
        F.count_distinct(F.when(is_resolved, F.col("pdf_url"))).alias("resolved_pdf_urls"),
        F.count_distinct(F.when(is_resolved, F.col("arxiv_id"))).alias("resolved_arxiv_ids"),
        F.count_if(~is_resolved).alias("unresolved"), F.count_if(F.col("cache_state") != "uncached").alias("cache_hits"),
    )


def pdf_url_list(resolved: DataFrame) -> DataFrame:
    """Distinct PDF URLs in the order of their first DOI."""
    urls = resolved.filter((F.col("cache_state") == "resolved") & F.col("pdf_url").isNotNull())
    return urls.groupBy("pdf_url").agg(F.min("doi").alias("doi")).orderBy("doi", "pdf_url").select("pdf_url")


def sorted_unique(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
