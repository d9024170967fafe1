"""Canonical document state: references and resolutions folded into documents, sources and candidates.

A batch is applied as if row by row: first its references in order, then its resolutions in order, where a
resolution of a DOI to a paper first updates the DOI's own (alias) document. Every rule below is stated with
first, last and maximum values per document, which Spark aggregates partially before the shuffle. A document
that a third of all references point to therefore costs one row per task, and no group is ever collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS, Settings
from citeloom.functions.ids import (
    PDF_URL_PREFIX, base_of_versioned, has_version, provenance_class, reference_doc_id, retry_at,
)
from citeloom.functions.scoring import queue_priority
from citeloom.schemas import CANDIDATES, DOCUMENT_SOURCES, DOCUMENTS

STATE, REFERENCE, RESOLUTION = 0, 1, 2


@dataclass(frozen=True)
class GraphState:
    documents: DataFrame
    sources: DataFrame
    candidates: DataFrame

    @staticmethod
    def empty(spark) -> GraphState:
        return GraphState(*[spark.createDataFrame([], s) for s in (DOCUMENTS, DOCUMENT_SOURCES, CANDIDATES)])


def reference_operations(references: DataFrame, seq: str = "seq") -> DataFrame:
    """References as document operations: ids, first status, confidence and kind of full text."""
    kind, value = F.col("ref_type"), F.col("normalized_value")
    versioned = (kind == "arxiv") & has_version(value)
    pdf = kind == "pdf_url"
    ready = versioned | pdf
    return references.select(
        reference_doc_id(kind, value).alias("doc_id"),
        F.struct(F.lit(REFERENCE).alias("phase"), F.col(seq).cast("long").alias("seq"), F.lit(1).alias("own")).alias("at"),
        F.lit("reference").alias("op"),
        F.when(kind == "arxiv", base_of_versioned(value)).alias("arxiv_id"),
        F.when(kind == "arxiv", value).alias("arxiv_id_with_version"),
        F.when(kind == "doi", value).alias("doi"),
        F.when(versioned, F.concat(F.lit(PDF_URL_PREFIX), value, F.lit(".pdf"))).when(pdf, value).alias("pdf_url"),
        F.when(ready, "ready").otherwise("discovered").alias("status"),
        F.when(versioned, 0.9).when(pdf, 0.6).otherwise(0.0).alias("confidence"),
        F.when(versioned, "arxiv_versioned").when(pdf, "pdf_only").otherwise("metadata_only").alias("resolution_kind"),
        "source_kind", "source_ref", F.col("discovered_at_unix").alias("seen_at"),
    )


def resolution_operations(resolutions: DataFrame, now_unix: int, seq: str = "seq") -> DataFrame:
    """Resolutions as document operations; a DOI that became a paper adds its alias operation."""
    filled = F.col("pdf_url").isNotNull() & (F.col("pdf_url") != "")
    versioned = F.coalesce(F.col("arxiv_id_with_version") != "", F.lit(False))
    has_doi = F.coalesce(F.col("doi") != "", F.lit(False))
    common = [
        "arxiv_id", "arxiv_id_with_version", "doi", "pdf_url", F.col("resolution_confidence").alias("confidence"),
        F.coalesce(F.nullif("source_kind", F.lit("")), F.lit("openalex_resolved")).alias("source_kind"),
        F.lit(None).cast("string").alias("source_ref"),
        F.coalesce("resolved_at_unix", F.lit(now_unix)).cast("long").alias("seen_at"),
    ]
    kind = (
        F.when(versioned, "arxiv_versioned").when(filled & has_doi, "oa_pdf").when(filled, "pdf_only")
        .otherwise("metadata_only")
    )

    def at(own: int) -> Column:
        return F.struct(F.lit(RESOLUTION).alias("phase"), F.col(seq).cast("long").alias("seq"), F.lit(own).alias("own"))

    # Alias and own operation come from the same row, so one scan yields both.
    own = F.struct(
        F.col("doc_id").alias("doc_id"), at(1).alias("at"), F.lit("resolution").alias("op"),
        F.when(versioned | filled, "ready").otherwise("blocked").alias("status"), kind.alias("resolution_kind"),
        F.lit(None).cast("string").alias("merged_to"),
    )
    alias = F.struct(
        F.concat(F.lit("doi:"), "doi").alias("doc_id"), at(0).alias("at"), F.lit("alias").alias("op"),
        F.lit("resolved").alias("status"), F.lit("metadata_only").alias("resolution_kind"),
        F.concat(F.lit("merged_to:"), "doc_id").alias("merged_to"),
    )
    both = F.when(has_doi & F.col("doc_id").startswith("axv:"), F.array(alias, own)).otherwise(F.array(own))
    return resolutions.select(F.explode(both).alias("o"), *common).select("o.*", *[c for c in _COMMON])


_COMMON = (
    "arxiv_id", "arxiv_id_with_version", "doi", "pdf_url", "confidence", "source_kind", "source_ref", "seen_at",
)


def _state_at() -> Column:
    return F.struct(F.lit(STATE).alias("phase"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("own"))


def _where(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def last_filled(value: str, condition: Column | None = None) -> Column:
    present = F.col(value).isNotNull() if condition is None else condition & F.col(value).isNotNull()
    return F.max_by(value, F.when(present, F.col("at")))


def folded_status() -> Column:
    """Status after all operations of a document, from four order positions.

    Only a stored 'ingested' is sticky; an alias overrides even that. Every other operation sets its status,
    except that a bare discovery never lowers 'ready'.
    """
    bare = (F.col("op") == "reference") & (F.col("status") == "discovered")
    setter = F.max_by("status", F.when(~bare, F.col("at")))
    set_at, bare_at = F.max(F.when(~bare, F.col("at"))), F.max(F.when(bare, F.col("at")))
    lowered = bare_at.isNotNull() & (set_at.isNull() | (bare_at > set_at)) & (F.coalesce(setter, F.lit("")) != "ready")
    return F.when(lowered, "discovered").otherwise(setter)


def _was_ingested() -> Column:
    return F.coalesce(F.bool_or((F.col("op") == "state") & (F.col("status") == "ingested")), F.lit(False))


def _saw(op: str) -> Column:
    return F.coalesce(F.bool_or(F.col("op") == op), F.lit(False))


def fold_documents(documents: DataFrame, operations: DataFrame, now_unix: int) -> DataFrame:
    stored = documents.select(
        "doc_id", _state_at().alias("at"), F.lit("state").alias("op"), "arxiv_id", "arxiv_id_with_version", "doi",
        "pdf_url", "status", F.col("resolution_confidence").alias("confidence"), "provenance_kind",
        F.col("best_source_kind").alias("source_kind"), F.col("created_at").alias("seen_at"), "updated_at",
    )
    batch = operations.select(
        "doc_id", "at", "op", "arxiv_id", "arxiv_id_with_version", "doi", "pdf_url", "status", "confidence",
        provenance_class("source_kind").alias("provenance_kind"), "source_kind", "seen_at",
        F.lit(now_unix).cast("long").alias("updated_at"),
    )
    not_alias = F.col("op") != "alias"
    opened_by_alias = F.min_by("op", "at") == "alias"
    alias_provenance = F.min_by("provenance_kind", F.when(~not_alias, F.col("at")))
    return (
        stored.unionByName(batch)
        .groupBy("doc_id")
        .agg(
            *[last_filled(c).alias(c) for c in ("arxiv_id", "arxiv_id_with_version", "doi", "pdf_url")],
            F.when(_was_ingested() & ~_saw("alias"), "ingested").otherwise(folded_status()).alias("status"),
            F.max("confidence").alias("resolution_confidence"),
            # An alias sets the source class only of a document it creates.
            F.coalesce(
                last_filled("provenance_kind", not_alias), F.when(opened_by_alias, alias_provenance)
            ).alias("provenance_kind"),
            F.max_by("source_kind", "at").alias("best_source_kind"),
            F.min_by("seen_at", "at").alias("created_at"),
            F.max_by("updated_at", "at").alias("updated_at"),
        )
        .select(*DOCUMENTS.fieldNames())
    )


def fold_candidates(candidates: DataFrame, operations: DataFrame, now_unix: int, settings: Settings = DEFAULTS) -> DataFrame:
    stored = candidates.select(
        "doc_id", _state_at().alias("at"), F.lit("state").alias("op"), "status", F.col("best_pdf_url").alias("pdf_url"),
        F.col("priority_score").alias("priority"), "retry_count", "next_retry_unix", "last_error", "updated_at",
    )
    blocked = F.col("status") == "blocked"
    batch = operations.select(
        "doc_id", "at", "op", "status", "pdf_url",
        queue_priority("source_kind", "confidence", "resolution_kind").alias("priority"), F.lit(0).alias("retry_count"),
        F.when(blocked, retry_at(now_unix, settings.candidate_retry_days)).alias("next_retry_unix"),
        F.col("merged_to").alias("last_error"), F.lit(now_unix).cast("long").alias("updated_at"),
    )
    is_state, is_ref = F.col("op") == "state", F.col("op") == "reference"
    is_res, is_alias = F.col("op") == "resolution", F.col("op") == "alias"
    late = is_res | is_alias
    last_resolved = F.max_by("priority", F.when(is_res, F.col("at")))
    first_ref_pdf = F.min_by("pdf_url", F.when(is_ref & F.col("pdf_url").isNotNull(), F.col("at")))
    return (
        stored.unionByName(batch)
        .groupBy("doc_id")
        .agg(
            F.when(_was_ingested(), "ingested").otherwise(folded_status()).alias("status"),
            # References keep the first URL, aliases and resolutions bring the last.
            F.coalesce(
                last_filled("pdf_url", late), F.max(_where(is_state, F.col("pdf_url"))), first_ref_pdf
            ).alias("best_pdf_url"),
            F.coalesce(
                last_resolved, F.max(_where(is_state | is_ref, F.col("priority"))), F.lit(0.0)
            ).alias("priority_score"),
            F.coalesce(F.max(_where(is_state, F.col("retry_count"))), F.lit(0)).cast("int").alias("retry_count"),
            F.max_by("next_retry_unix", F.when(late | is_state, F.col("at"))).alias("next_retry_unix"),
            F.max_by("last_error", F.when(is_alias | is_state, F.col("at"))).alias("last_error"),
            F.max_by("updated_at", "at").alias("updated_at"),
        )
        .select(*CANDIDATES.fieldNames())
    )


def fold_sources(sources: DataFrame, operations: DataFrame, now_unix: int) -> DataFrame:
    """Lineage: who mentioned a document, first and last time."""
    stored = sources.select("*", _state_at().alias("at"))
    seen = operations.filter(F.col("op") == "reference").select(
        "doc_id", "source_kind", "source_ref", F.col("seen_at").alias("first_seen"),
        F.lit(now_unix).cast("long").alias("last_seen"), "at",
    )
    return (
        stored.unionByName(seen)
        .groupBy("doc_id", "source_kind", "source_ref")
        .agg(F.min_by("first_seen", "at").alias("first_seen"), F.max_by("last_seen", "at").alias("last_seen"))
    )


def operations_of(references: DataFrame | None, resolutions: DataFrame | None, now_unix: int) -> DataFrame:
    parts = []
    if references is not None:
        parts.append(reference_operations(references).withColumn("merged_to", F.lit(None).cast("string")))
    if resolutions is not None:
        parts.append(resolution_operations(resolutions, now_unix))
    if not parts:
        raise ValueError("a batch needs references or resolutions")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fold_batch(
    state: GraphState,
    references: DataFrame | None,
    resolutions: DataFrame | None,
    now_unix: int,
    settings: Settings = DEFAULTS,
) -> GraphState:
    """State after one batch. Both inputs carry ``seq``, their position in the batch."""
    operations = operations_of(references, resolutions, now_unix)
    return GraphState(
        fold_documents(state.documents, operations, now_unix),
        fold_sources(state.sources, operations, now_unix),
        fold_candidates(state.candidates, operations, now_unix, settings),
    )


def reference_events(references: DataFrame, run_id: str) -> DataFrame:
    return references.select(
        F.lit(run_id).alias("run_id"), "seq", "ref_type", "normalized_value", "source_kind", "source_ref", "discovered_at_unix"
    )


def resolution_events(resolutions: DataFrame, run_id: str, now_unix: int) -> DataFrame:
    return resolutions.select(
        F.lit(run_id).alias("run_id"), "seq", "doc_id", "arxiv_id", "arxiv_id_with_version", "doi", "pdf_url",
        "resolution_confidence", F.coalesce("resolved_at_unix", F.lit(now_unix)).cast("long").alias("resolved_at_unix"),
    )
