"""Citation metrics: refresh selection, catalogue look-up, tiers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.checks import Registry, inputs as I
from citeloom.functions.scoring import TierThresholds
from citeloom.operators import curate
from citeloom.plans import corpus_jobs
from citeloom.schemas import PAPERS

CHECKS = Registry()
NOW, YEAR = 1_700_000_000, 1999
THRESHOLDS = TierThresholds(tier0_citations=35, tier0_per_year=9.0, tier1_citations=28, tier1_per_year=6.0)
_ID = f"""case when p_partkey % 9 = 0 then concat('10.', cast(1000 + p_partkey % 50 as string), '/p', cast(p_partkey as string))
  when p_partkey % 13 = 0 then concat('local-', cast(p_partkey as string)) else {I.paper_id('p_partkey')} end"""
_TYPES = "case when p_type like 'STANDARD%' then 'JournalArticle' when p_type like 'PROMO%' then 'Conference' else 'Preprint' end"

FACTS_SQL = f"""select p_partkey as n, {_ID} as arxiv_id, count(*)::int as citation_count,
    case when p_partkey % 8 > 0 then min(year(l_shipdate))::int end as year, max(p_brand) as venue, max({_TYPES}) as types
  from part join lineitem on p_partkey = l_partkey group by 1, 2"""
_VENUE = "case when p_brand like '%5' then concat('not ', p_brand) else p_brand end"
VENUES_SQL = f"select distinct {_VENUE} as venue from part"
_STORED_ID = f"case when p_size % 2 = 1 then concat('old-', cast(p_partkey as string)) else {_ID} end"
STORED_SQL = f"select {_STORED_ID} as arxiv_id, case when p_size % 3 = 0 then {NOW} - p_size * 86400 end as updated_at, p_size % 3 as keep from part"
CTES = {
    "facts": FACTS_SQL, "venues": VENUES_SQL, "stored": STORED_SQL,
    "ids": f"""select {_ID} as arxiv_id, p_partkey as n from part""",
    "curatable": r"""select * from ids where regexp_matches(arxiv_id, '(?i)^(doi:)?10\.\d{4,9}/\S+$') or regexp_matches(arxiv_id, '^\d{4}\.\d{4,5}$')""",
    "due": f"""select c.* from curatable c left join stored s using (arxiv_id) where s.updated_at is null or s.updated_at < {NOW} - 20 * 86400""",
    "scored": f"""select d.arxiv_id, citation_count, year, f.venue, types, f.venue in (select venue from venues) as listed,
        (types <> 'Preprint')::int as is_peer_reviewed, citation_count / greatest(1, {YEAR} - coalesce(year, {YEAR}) + 1) as cpy
      from due d join facts f on f.arxiv_id = d.arxiv_id where d.n % 10 > 0""",
    "tiered": """select *, ln(1 + citation_count) + 0.5 * ln(1 + cpy) + listed::int as score,
        case when listed and (citation_count >= 35 or cpy >= 9) then 0 when is_peer_reviewed = 1 and (citation_count >= 28 or cpy >= 6) then 1 else 2 end as tier
      from scored""",
    "merged": f"""select arxiv_id, citation_count, venue, tier, {NOW} as updated_at from tiered
      union all select arxiv_id, 0, '', 2, updated_at from stored where arxiv_id not in (select arxiv_id from tiered)""",
}


def papers(spark, sf_dir):
    base = I.table(spark, sf_dir, "part").select(F.expr(_ID).alias("arxiv_id"), "p_partkey", "p_size")
    missing = [F.lit(None).cast("string").alias(f.name) for f in PAPERS if f.name != "arxiv_id"]
    return base.select("arxiv_id", *missing)


def stored_metrics(spark, sf_dir):
    size = F.col("p_size")
    return I.table(spark, sf_dir, "part").select(
        F.expr(_STORED_ID).alias("arxiv_id"), F.lit(0).alias("citation_count"), F.lit(None).cast("int").alias("year"), F.lit("").alias("venue"),
        F.lit("[]").alias("publication_types"), F.lit(0).alias("is_peer_reviewed"), F.lit(0.0).alias("score"), F.lit(2).alias("tier"),
        F.when(size % 3 == 0, F.lit(NOW) - size * 86400).cast("long").alias("updated_at"),
    )


def metadata(spark, sf_dir):
    """Landed metadata keyed by one of the id forms in turn; every tenth paper is unknown."""
    facts = (
        I.table(spark, sf_dir, "part").join(I.table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
        .groupBy("p_partkey").agg(
            F.count(F.lit(1)).cast("int").alias("citationCount"), F.min(F.year("l_shipdate")).alias("y"), F.max("p_brand").alias("venue"),
            F.max(F.expr(_TYPES)).alias("types"),
        )
    )
    n, key = F.col("p_partkey"), F.expr(_ID)
    is_doi = n % 9 == 0
    form = (
        F.when(n % 10 == 0, F.concat(F.lit("UNKNOWN:"), key))
        .when(n % 3 == 0, F.concat(F.when(is_doi, "DOI:").otherwise("ARXIV:"), key))
        .when(n % 3 == 1, key)
        .otherwise(F.concat(F.when(is_doi, "https://doi.org/").otherwise("https://arxiv.org/abs/"), key))
    )
    return facts.select(
        form.alias("paper_key"), "citationCount", F.when(n % 8 > 0, F.col("y")).alias("year"), "venue",
        F.array("types").alias("publicationTypes"),
    )


def venues(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select(F.expr(_VENUE).alias("venue"))


def curated(spark, sf_dir):
    return corpus_jobs.curate_corpus(
        papers(spark, sf_dir), stored_metrics(spark, sf_dir), metadata(spark, sf_dir), venues(spark, sf_dir), NOW, YEAR,
        refresh_days=20, thresholds=THRESHOLDS,
    )


@CHECKS.query(I.with_sql(**CTES) + "select arxiv_id from due")
def due_papers(spark, sf_dir):
    """Curatable papers whose metrics are absent or stale."""
    ids = curate.curatable(papers(spark, sf_dir).select("arxiv_id"))
    return curate.stale_or_missing(ids, stored_metrics(spark, sf_dir), 20, NOW)


@CHECKS.query(I.with_sql(**CTES) + """select arxiv_id, citation_count, year, venue, '["' || types || '"]' as publication_types, is_peer_reviewed,
    round(score, 6) as score, tier from tiered""")
def metric_rows(spark, sf_dir):
    """Looked-up metadata with score and tier."""
    ids = curate.curatable(papers(spark, sf_dir).select("arxiv_id"))
    due = curate.stale_or_missing(ids, stored_metrics(spark, sf_dir), 20, NOW)
    found = curate.look_up(due, metadata(spark, sf_dir))
    rows = curate.metric_rows(found, venues(spark, sf_dir), NOW, YEAR, THRESHOLDS)
    return rows.drop("updated_at").withColumn("score", F.round("score", 6))


@CHECKS.query(I.with_sql(**CTES) + "select arxiv_id, citation_count, venue, tier, updated_at::bigint as updated_at from merged")
def curated_metrics(spark, sf_dir):
    """Stored metrics after the refresh."""
    return curated(spark, sf_dir).metrics.select("arxiv_id", "citation_count", "venue", "tier", "updated_at")


@CHECKS.query(I.with_sql(**CTES) + """select (select count(*) from ids) as total_ids, (select count(*) from due) as to_refresh,
    (select count(*) from tiered) as updated, (select count(*) from ids) - (select count(*) from tiered) as skipped,
    (select count(*) from ids) - (select count(*) from curatable) as skipped_non_curatable""")
def curation_totals(spark, sf_dir):
    """L11."""
    return curated(spark, sf_dir).totals


@CHECKS.query(I.with_sql(**CTES) + "select tier, count(*) as n from merged group by tier")
def tier_distribution(spark, sf_dir):
    """F2."""
    return curated(spark, sf_dir).tiers


@CHECKS.query(I.with_sql(**CTES) + "select venue, count(*) as n from merged where trim(venue) <> '' group by venue order by n desc, venue limit 10")
def top_venues(spark, sf_dir):
    """the ten largest venues."""
    return curate.top_venues(curated(spark, sf_dir).metrics, 10)


@CHECKS.query(VENUES_SQL)
def venue_list(spark, sf_dir):
    """The distinct venue list."""
    return venues(spark, sf_dir).distinct()
