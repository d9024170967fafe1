"""Citation metrics: which papers to refresh, catalogue look-up, tier and score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import catalogue_batch_key, catalogue_keys, is_curatable
from citeloom.functions.scoring import TierThresholds, impact_score, peer_reviewed, quality_tier
from citeloom.functions.text import strip
from citeloom.operators.ordered import keyed_join
from citeloom.schemas import METRICS


def stale_or_missing(ids: DataFrame, metrics: DataFrame, refresh_days: int, now_unix: int) -> DataFrame:
    """Ids without a metric row, without a time, or older than the cutoff."""
    cutoff = now_unix - max(refresh_days, 0) * 86400
    known = metrics.select("arxiv_id", F.col("updated_at").alias("__at"))
    return keyed_join(ids, known, "arxiv_id", "left").filter(F.col("__at").isNull() | (F.col("__at") < cutoff)).drop("__at")


def look_up(ids: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Metadata of each id: (arxiv_id, payload columns); ids the catalogue does not know drop out.

    ``catalogue`` holds (paper_key, payload...) with unique keys. The batch form of the id is tried first,
    then its other forms in order; all forms go through one equality join and the first one that hits wins.
    """
    payload = [c for c in catalogue.columns if c != "paper_key"]
    forms = F.array_distinct(F.concat(F.array(catalogue_batch_key("arxiv_id")), catalogue_keys("arxiv_id")))
    asked = ids.select("arxiv_id", F.posexplode(forms).alias("__pos", "paper_key")).filter(F.col("paper_key") != "")
    found = keyed_join(asked, catalogue, "paper_key", "inner").groupBy("arxiv_id").agg(
        F.min_by(F.struct(*payload), "__pos").alias("__hit")
    )
    return found.select("arxiv_id", *[F.col("__hit")[c].alias(c) for c in payload])


def metric_rows(
    found: DataFrame, venues: DataFrame, now_unix: int, current_year: int, thresholds: TierThresholds = TierThresholds()
) -> DataFrame:
    """METRICS rows from (arxiv_id, citationCount, year, venue, publicationTypes) and a venue list (venue)."""
    listed = venues.select("venue").distinct().withColumn("__listed", F.lit(True))
    types = F.filter(F.coalesce("publicationTypes", F.array().cast("array<string>")), lambda t: t != "")
    rows = found.select(
        "arxiv_id", F.coalesce("citationCount", F.lit(0)).cast("int").alias("citation_count"), F.col("year").cast("int").alias("year"),
        strip(F.coalesce("venue", F.lit(""))).alias("venue"), types.alias("types"),
    ).join(listed, "venue", "left")
    rows = rows.withColumns({"__listed": F.coalesce("__listed", F.lit(False)), "is_peer_reviewed": peer_reviewed("types")})
    return rows.withColumns(
        {
            "publication_types": F.to_json("types"),
            "score": impact_score("citation_count", "year", "__listed", current_year),
            "tier": quality_tier("citation_count", "year", "__listed", "is_peer_reviewed", current_year, thresholds),
            "updated_at": F.lit(now_unix).cast("long"),
        }
    ).select(*METRICS.fieldNames())


def curatable(ids: DataFrame) -> DataFrame:
    return ids.filter(is_curatable("arxiv_id"))


def tier_distribution(metrics: DataFrame) -> DataFrame:
    counted = metrics.filter(F.col("tier").isNotNull()).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("tier")


def top_venues(metrics: DataFrame, limit: int) -> DataFrame:
    named = metrics.filter(F.trim("venue") != "").groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
    return named.orderBy(F.desc("n"), F.asc("venue")).limit(max(limit, 0))
