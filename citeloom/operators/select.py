"""Choosing papers to ingest: newest from a feed, explicit ids, and what is already there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions.ids import (
    ABS_URL_PREFIX, PDF_URL_PREFIX, axv_doc_id, canonical_paper_id, normalize_paper_id, paper_version,
)
from citeloom.functions.text import blank_to_null, strip
from citeloom.operators.ordered import first_per_key, last_per_key, running_totals


def requested_ids(raw: DataFrame) -> DataFrame:
    """Canonical ids of (raw_id, seq) in request order, empty ones and repeats dropped."""
    ids = raw.select(canonical_paper_id("raw_id").alias("requested_id"), "seq")
    return first_per_key(ids.filter(F.col("requested_id").isNotNull()), ["requested_id"], "seq")


def select_from_feed(feed: DataFrame, known: DataFrame, limit: int, scan_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Newest papers of a feed (arxiv_id_with_version, seq) that are not known yet.

    The feed is read in the order of ``seq``, which may be of any orderable type and have gaps, until ``limit`` papers
    are kept or ``scan_cap`` entries are read. Returns the kept papers and one row (requested, selected, scanned,
    skipped). Blank versions are always kept.
    """
    cap = max(limit * 10 if scan_cap is None else scan_cap, limit)
    # The cap counts entries, not values of seq; it also bounds what the steps below hold.
    head = feed.orderBy("seq").limit(cap).select(F.struct(*feed.columns).alias("__entry"))
    numbered = head.withColumn("__at", F.row_number().over(W.orderBy("__entry.seq")) - 1)
    scanned = numbered.select("__entry.*", F.col("__at").cast("long").alias("__at")).withColumn(
        # Blank versions get keys of their own that match nothing.
        "__versioned", F.coalesce(blank_to_null("arxiv_id_with_version"), F.concat(F.lit("none:"), F.col("__at").cast("string")))
    )
    firsts = scanned.groupBy("__versioned").agg(F.min("__at").alias("__first"))
    known_ids = known.select(blank_to_null("arxiv_id_with_version").alias("__versioned")).where("__versioned is not null")
    known_ids = known_ids.join(scanned.select("__versioned"), "__versioned", "left_semi").distinct().withColumn("__known", F.lit(True))
    flagged = (
        scanned.join(firsts, "__versioned", "left")
        .join(known_ids, "__versioned", "left")
        .withColumn("__fresh", F.col("__at") == F.col("__first"))
    )
    keep = F.col("__fresh") & F.col("__known").isNull()
    counted = running_totals(
        flagged.withColumns({"__keep": keep, "__skip": F.col("__fresh") & F.col("__known").isNotNull()}),
        "__at", {"__kept": F.col("__keep")},
    )
    # Reading stops behind the entry that fills the limit.
    read = counted.filter(F.col("__kept") - F.col("__keep").cast("long") < limit)
    chosen = read.filter("__keep").select(*feed.columns)
    stats = read.agg(
        F.lit(limit).alias("requested"), F.count_if("__keep").alias("selected"), F.count(F.lit(1)).alias("scanned"),
        F.count_if("__skip").alias("skipped"),
    )
    return chosen, stats


def match_requested(requested: DataFrame, fetched: DataFrame, upgrade: bool = False) -> DataFrame:
    """Requested ids (requested_id, seq) with fetched metadata, in request order.

    Exact version first, then the base id; of several fetched entries the last one wins. Ids without
    metadata still give a row with derived title and URLs. ``upgrade`` moves unversioned requests to the
    version that was found. ``fetched`` is PAPER_METADATA with ``seq``.
    """
    fields = ["arxiv_id_with_version", "version", "title", "summary", "published", "updated", "authors"]
    entry = F.struct(*fields)
    by_version = last_per_key(
        fetched.filter(F.col("arxiv_id_with_version") != "").select(
            F.col("arxiv_id_with_version").alias("__download"), entry.alias("__exact"), "seq"
        ), ["__download"], "seq",
    ).drop("seq")
    by_base = last_per_key(
        fetched.select(F.col("arxiv_id").alias("__base"), entry.alias("__any"), "seq"), ["__base"], "seq"
    ).drop("seq")
    asked = requested.select(
        "requested_id", "seq", normalize_paper_id("requested_id").alias("__base"), paper_version("requested_id").alias("__asked")
    ).withColumn("__download", F.when(F.col("__asked").isNotNull(), F.col("requested_id")).otherwise(F.col("__base")))
    joined = asked.join(by_version, "__download", "left").join(by_base, "__base", "left")
    joined = joined.withColumn("__source", F.coalesce("__exact", "__any"))
    newest = F.col("__source.arxiv_id_with_version")
    can_upgrade = F.lit(upgrade) & F.col("__asked").isNull() & paper_version(newest).isNotNull()
    joined = joined.withColumn("__id", F.when(can_upgrade, newest).otherwise(F.col("__download")))
    return joined.select(
        "requested_id", "seq", F.col("__base").alias("arxiv_id"), F.col("__id").alias("arxiv_id_with_version"),
        F.coalesce("__asked", paper_version("__id"), "__source.version").alias("version"), axv_doc_id("__id").alias("doc_id"),
        F.coalesce(F.nullif("__source.title", F.lit("")), F.concat(F.lit("arXiv:"), "__id")).alias("title"),
        F.coalesce("__source.summary", F.lit("")).alias("summary"), F.col("__source.published").alias("published"),
        F.col("__source.updated").alias("updated"),
        F.coalesce("__source.authors", F.array().cast("array<string>")).alias("authors"),
        F.concat(F.lit(PDF_URL_PREFIX), "__id", F.lit(".pdf")).alias("pdf_url"),
        F.concat(F.lit(ABS_URL_PREFIX), "__id").alias("abs_url"),
    )


def without_known_versions(papers: DataFrame, known: DataFrame) -> DataFrame:
    """Papers whose exact version is not stored; a blank version is never taken as known."""
    versions = known.select(F.col("arxiv_id_with_version").alias("__key"))
    # Blank versions get a key of their own that matches nothing, so they do not pile up in one task.
    alone = F.concat(F.lit("none:"), F.xxhash64(*papers.columns).cast("string"))
    keyed = papers.withColumn("__key", F.coalesce(F.nullif(strip("arxiv_id_with_version"), F.lit("")), alone))
    return keyed.join(versions, "__key", "left_anti").drop("__key")


def selection_totals(matched: DataFrame, remaining: DataFrame) -> DataFrame:
    """One row: requested, returned, resolved to a version, unresolved, skipped, to ingest."""
    unversioned = paper_version("requested_id").isNull()
    found = paper_version("arxiv_id_with_version").isNotNull()
    kept = remaining.select(F.count(F.lit(1)).alias("n")).scalar()
    return matched.agg(
        F.count(F.lit(1)).alias("requested_ids"), F.count("arxiv_id_with_version").alias("metadata_returned"),
        F.count_if(unversioned & found).alias("resolved_to_version"), F.count_if(unversioned & ~found).alias("unresolved"),
    ).select("*", (F.col("metadata_returned") - kept).alias("skipped_existing"), kept.alias("to_ingest"))


def migrate_legacy(legacy: DataFrame, resolved: DataFrame) -> DataFrame:
    """Legacy base ids with their resolved version: (arxiv_id, arxiv_id_with_version, version, outcome)."""
    latest = resolved.select("arxiv_id", "arxiv_id_with_version", "version")
    version = paper_version("arxiv_id_with_version")
    return legacy.join(latest, "arxiv_id", "left").select(
        "arxiv_id", "arxiv_id_with_version", F.coalesce("version", version).alias("version"),
        F.when(version.isNotNull(), "migrated").otherwise("unresolved").alias("outcome"),
    )
