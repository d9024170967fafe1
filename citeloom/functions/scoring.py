"""Score formulas as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import ColumnLike, col

# Queue weights.
SOURCE_WEIGHTS = {"curated_repo": 1.00, "arxiv_feed": 0.90, "openalex_resolved": 0.70, "scraped_pdf": 0.50}
RESOLUTION_WEIGHTS = {"arxiv_versioned": 0.40, "oa_pdf": 0.30, "pdf_only": 0.20, "metadata_only": 0.00}
OTHER_SOURCE_WEIGHT = 0.50
FRESHNESS_BONUS, CONFIDENCE_WEIGHT, RETRY_PENALTY = 0.2, 0.05, 0.15

# Ranking boosts.
TIER_BOOSTS = {0: 0.25, 1: 0.10, 2: 0.0}
PROVENANCE_BOOSTS = {"curated": 0.08, "canonical_api": 0.05, "scraped": 0.02}
DEFAULT_TIER = 2
PRIORITY_SECTIONS = (
    "(method|approach|implementation|supervision|loss|training|optimal matching|experiments?|ablation|results?)"
)


def by_value(c: ColumnLike, weights: dict, default: float) -> Column:
    """Small fixed lookup as a CASE, so no join is needed."""
    key, out = col(c), F.lit(None).cast("double")
    for value, weight in weights.items():
        out = F.when(key == value, F.lit(float(weight))).otherwise(out)
    return F.coalesce(out, F.lit(float(default)))


def queue_priority(
    source_kind: ColumnLike,
    confidence: ColumnLike,
    resolution_kind: ColumnLike,
    age_days: ColumnLike | None = None,
    retries: ColumnLike | None = None,
) -> Column:
    age = F.lit(0) if age_days is None else F.greatest(col(age_days), F.lit(0))
    tries = F.lit(0) if retries is None else F.greatest(col(retries), F.lit(0))
    freshness = F.greatest(F.lit(0.0), F.lit(FRESHNESS_BONUS) - age / F.lit(365.0))
    bounded = F.greatest(F.lit(0.0), F.least(col(confidence), F.lit(1.0)))
    return (
        by_value(source_kind, SOURCE_WEIGHTS, OTHER_SOURCE_WEIGHT)
        + by_value(resolution_kind, RESOLUTION_WEIGHTS, RESOLUTION_WEIGHTS["metadata_only"])
        + freshness
        + bounded * F.lit(CONFIDENCE_WEIGHT)
        - tries * F.lit(RETRY_PENALTY)
    )


@dataclass(frozen=True)
class TierThresholds:
    tier0_citations: int = 200
    tier0_per_year: float = 30.0
    tier1_citations: int = 20
    tier1_per_year: float = 3.0


def citations_per_year(citations: ColumnLike, year: ColumnLike, current_year: int) -> Column:
    age = F.lit(current_year) - F.coalesce(col(year), F.lit(current_year)) + F.lit(1)
    return F.greatest(col(citations), F.lit(0)) / F.greatest(age, F.lit(1))


def impact_score(citations: ColumnLike, year: ColumnLike, venue_listed: ColumnLike, current_year: int) -> Column:
    per_year = citations_per_year(citations, year, current_year)
    return (
        F.log1p(F.greatest(col(citations), F.lit(0)).cast("double"))
        + F.lit(0.5) * F.log1p(per_year)
        + F.when(col(venue_listed), F.lit(1.0)).otherwise(F.lit(0.0))
    )


def peer_reviewed(publication_types: ColumnLike) -> Column:
    kinds = F.coalesce(col(publication_types), F.array().cast("array<string>"))
    return (F.array_contains(kinds, "JournalArticle") | F.array_contains(kinds, "Conference")).cast("int")


def quality_tier(
    citations: ColumnLike,
    year: ColumnLike,
    venue_listed: ColumnLike,
    reviewed: ColumnLike,
    current_year: int,
    thresholds: TierThresholds = TierThresholds(),
) -> Column:
    count = F.greatest(col(citations), F.lit(0))
    per_year = citations_per_year(citations, year, current_year)
    top = (count >= thresholds.tier0_citations) | (per_year >= thresholds.tier0_per_year)
    solid = (count >= thresholds.tier1_citations) | (per_year >= thresholds.tier1_per_year)
    return F.when(col(venue_listed) & top, 0).when((col(reviewed) == 1) & solid, 1).otherwise(2)


def in_priority_section(title: ColumnLike, section_title: ColumnLike) -> Column:
    return F.concat_ws("\n", col(title), col(section_title)).rlike("(?i)" + PRIORITY_SECTIONS)
