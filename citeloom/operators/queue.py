"""The ingest queue: ready list, full-text gate and results of ingestion attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS, Settings
from citeloom.functions.ids import ABS_URL_PREFIX, base_of_versioned, file_stem, retry_at
from citeloom.functions.text import blank_to_null
from citeloom.operators.ordered import keyed_join
from citeloom.schemas import CANDIDATES
from citeloom.session import materialize_observed

FAILED_ATTEMPTS = ("blocked", "failed")


def is_ready(now_unix: int) -> Column:
    return (F.col("status") == "ready") & (F.col("next_retry_unix").isNull() | (F.col("next_retry_unix") <= now_unix))


def ready_candidates(candidates: DataFrame, limit: int | None, now_unix: int) -> DataFrame:
    """Best ready candidates: highest priority, then longest untouched, then doc id. Without a limit all of them, in no
    order, so nothing is sorted."""
    ready = candidates.filter(is_ready(now_unix))
    if limit is None:
        return ready
    return ready.orderBy(F.desc("priority_score"), F.asc("updated_at"), F.asc("doc_id")).limit(limit)


def to_papers(selected: DataFrame, documents: DataFrame) -> DataFrame:
    """Selected candidates as papers to ingest; ``blocked_reason`` marks those without a PDF URL.

    A pass may take the whole queue, so neither side is small.
    """
    found = keyed_join(documents, selected.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id", "arxiv_id", "arxiv_id_with_version", "doi", "pdf_url", "provenance_kind"
    )
    joined = keyed_join(selected.select("doc_id", "best_pdf_url"), found, "doc_id", "left")
    versioned = F.coalesce(blank_to_null("arxiv_id_with_version"), F.col("doc_id"))
    paper = F.coalesce(blank_to_null("arxiv_id"), base_of_versioned(versioned))
    url = F.coalesce(F.nullif("best_pdf_url", F.lit("")), blank_to_null("pdf_url"))
    return joined.select(
        "doc_id", paper.alias("arxiv_id"), versioned.alias("arxiv_id_with_version"),
        blank_to_null("provenance_kind").alias("provenance_kind"),
        F.coalesce(F.nullif("doi", F.lit("")), F.col("doc_id")).alias("title"), url.alias("pdf_url"),
        F.when(paper.contains(":"), url).otherwise(F.concat(F.lit(ABS_URL_PREFIX), versioned)).alias("abs_url"),
        file_stem(versioned, "doc_id", paper).alias("file_stem"),
        F.when(url.isNull(), "missing_pdf_url").alias("blocked_reason"),
    )


def require_cached(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Block papers whose full text is not among (file_stem)."""
    known = files.select("file_stem").distinct().withColumn("__cached", F.lit(True))
    missing = F.when(F.col("__cached").isNull(), F.lit("cache_only_missing_pdf"))
    return (
        keyed_join(papers, known, "file_stem", "left")
        .withColumn("blocked_reason", F.coalesce("blocked_reason", missing))
        .drop("__cached")
    )


def apply_results(
    candidates: DataFrame, results: DataFrame, now_unix: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """Candidates after (doc_id, status, reason, seq) attempts.

    Attempts of one document count up in order; only their number and the last one matter, so they are
    aggregated before the join.
    """
    attempts = results.groupBy("doc_id").agg(
        F.max_by(F.struct("status", "reason"), "seq").alias("last"),
        F.count_if(F.col("status").isin(*FAILED_ATTEMPTS)).alias("failures"),
    )
    joined = keyed_join(candidates, attempts, "doc_id", "full")
    touched = F.col("last").isNotNull()
    retries = (F.coalesce("retry_count", F.lit(0)) + F.coalesce("failures", F.lit(0))).cast("int")
    failing = F.col("last.status").isin(*FAILED_ATTEMPTS)
    exhausted = retries >= max(settings.candidate_max_retries, 1)
    status = F.when(failing & exhausted, "failed").when(failing, "blocked").otherwise(F.col("last.status"))
    next_retry = F.when(failing & ~exhausted, retry_at(now_unix, settings.candidate_retry_days))
    return joined.select(
        "doc_id", F.when(touched, status).otherwise(F.col("status")).alias("status"), "best_pdf_url",
        F.coalesce("priority_score", F.lit(0.0)).alias("priority_score"), retries.alias("retry_count"),
        F.when(touched, next_retry).otherwise(F.col("next_retry_unix")).alias("next_retry_unix"),
        F.when(touched, F.col("last.reason")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(touched, F.lit(now_unix)).otherwise(F.col("updated_at")).cast("long").alias("updated_at"),
    ).select(*CANDIDATES.fieldNames())


def apply_results_to_documents(documents: DataFrame, candidates: DataFrame, results: DataFrame, now_unix: int) -> DataFrame:
    """Documents take the status their candidate ended with."""
    ended = keyed_join(candidates, results.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", F.col("status").alias("__status")
    )
    changed = F.col("__status").isNotNull()
    return (
        keyed_join(documents, ended, "doc_id", "left")
        .withColumns(
            {
                "status": F.coalesce("__status", "status"),
                "updated_at": F.when(changed, F.lit(now_unix).cast("long")).otherwise(F.col("updated_at")),
            }
        )
        .drop("__status")
    )


def outcome_counts() -> dict[str, Column]:
    """Counts over (outcome) of every selected candidate."""

    def n(*names: str) -> Column:
        return F.count_if(F.col("outcome").isin(*names))

    return {
        "selected": F.count(F.lit(1)), "queued": n("ingested", "failed"), "ingested": n("ingested"), "failed": n("failed"),
        "blocked": n("blocked"),
    }


def ingest_totals(outcomes: DataFrame) -> DataFrame:
    """One row of counts over (outcome) of every selected candidate."""
    return outcomes.agg(*[column.alias(name) for name, column in outcome_counts().items()])


def stored_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the outcomes as a table, their counts): the counts are observed while the table is written."""
    table, counts = materialize_observed(outcomes, "outcomes", **outcome_counts())
    schema = ", ".join(f"{name} long" for name in outcome_counts())
    return table, outcomes.sparkSession.createDataFrame([tuple(counts[name] for name in outcome_counts())], schema)
