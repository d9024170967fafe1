"""Choosing papers: feed selection, explicit ids, known versions; DOI resolution; the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.checks import Registry, inputs as I
from citeloom.operators import catalog, resolve, select
from citeloom.operators.ordered import id_batches, running_totals
from citeloom.plans import corpus_jobs
from citeloom.sources import files

CHECKS = Registry()

# --- events as a feed of versioned papers, orders as stored papers --------------------------------------------

_FEED_ID = "case when event_id % 17 = 0 then ' ' else concat('p', cast((event_id * 7) % 3001 as string), 'v', cast(user_id % 2 as string)) end"
_LIMIT, _CAP = 1500, 6000


def feed(spark, sf_dir):
    null = F.lit(None).cast("string")
    return I.table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), ((F.col("event_id") * 7) % 3001).cast("string")).alias("arxiv_id"), F.expr(_FEED_ID).alias("arxiv_id_with_version"),
        F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("version"), null.alias("doc_id"),
        F.col("event_type").alias("title"), F.col("props").alias("summary"), F.col("ts").cast("string").alias("published"),
        null.alias("updated"), F.array("event_type").alias("authors"), null.alias("pdf_url"), null.alias("abs_url"),
        F.col("event_id").alias("seq"),
    )


def stored_papers(spark, sf_dir):
    """Parts as stored papers: every third without version, every seventh keyed by a DOI."""
    n, null = F.col("p_partkey"), F.lit(None).cast("string")
    base = F.when(n % 7 == 0, F.concat(F.lit("doi:10.1/"), n.cast("string"))).otherwise(F.concat(F.lit("p"), n.cast("string")))
    version = F.when(n % 3 == 0, F.when(n % 2 == 0, base)).otherwise(F.concat(base, F.lit("v"), (n % 2).cast("string")))
    return I.table(spark, sf_dir, "part").select(
        base.alias("arxiv_id"), version.alias("arxiv_id_with_version"), F.concat(F.lit("axv:"), base).alias("doc_id"),
        null.alias("version"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"),
        F.concat(F.lit("20"), F.lpad((n % 24).cast("string"), 2, "0")).alias("published"), null.alias("updated"),
        F.concat_ws(", ", "p_brand", "p_type").alias("authors_json"), null.alias("pdf_url"), null.alias("abs_url"),
        F.when(n % 2 == 0, F.concat(F.lit("/pdf/"), base, F.lit(".pdf"))).otherwise(" ").alias("pdf_path"),
        F.col("p_partkey").alias("n"),
    )


STORED_SQL = """select *, 'axv:' || arxiv_id as doc_id, case when n % 3 = 0 then case when n % 2 = 0 then arxiv_id end
      else arxiv_id || 'v' || n % 2 end as versioned, case when n % 2 = 0 then '/pdf/' || arxiv_id || '.pdf' else ' ' end as pdf_path
    from (select p_partkey as n, case when p_partkey % 7 = 0 then 'doi:10.1/' || p_partkey else 'p' || p_partkey end as arxiv_id,
      p_name as title, p_brand, p_type, '20' || lpad((p_partkey % 24)::varchar, 2, '0') as published from part) x"""
FEED_CTES = {
    "feed": f"select event_id as seq, {_FEED_ID} as versioned, event_type as title from events",
    "stored": STORED_SQL,
    "known": "select distinct trim(versioned) as v from stored where trim(versioned) <> ''",
    "scanned": f"select seq, title, trim(versioned) as v, row_number() over (order by seq) as pos from feed qualify pos <= {_CAP}",
    "flagged": """select *, v = '' or row_number() over (partition by v order by seq) = 1 as fresh,
        v <> '' and v in (select v from known) as old from scanned""",
    "counted": "select *, sum(case when fresh and not old then 1 else 0 end) over (order by pos) as kept from flagged",
    "read": f"select * from counted where kept - case when fresh and not old then 1 else 0 end < {_LIMIT}",
}


@CHECKS.query(I.with_sql(**FEED_CTES) + "select seq, v as arxiv_id_with_version, title from read where fresh and not old")
def feed_selection(spark, sf_dir):
    """Newest papers that are not stored yet, within limit and scan cap."""
    chosen = corpus_jobs.select_latest(feed(spark, sf_dir), stored_papers(spark, sf_dir), _LIMIT, scan_cap=_CAP).papers
    return chosen.select("seq", F.trim("arxiv_id_with_version").alias("arxiv_id_with_version"), "title")


@CHECKS.query(I.with_sql(**FEED_CTES) + f"""select {_LIMIT} as requested, count(*) filter (fresh and not old) as selected, count(*) as scanned,
    count(*) filter (fresh and old) as skipped from read""")
def feed_selection_counts(spark, sf_dir):
    """G7."""
    return corpus_jobs.select_latest(feed(spark, sf_dir), stored_papers(spark, sf_dir), _LIMIT, scan_cap=_CAP).totals


_REQUEST = (
    "case c_custkey % 4 when 0 then concat('arXiv:p', cast(c_custkey % 700 as string)) when 1 then concat('p', cast(c_custkey as string), 'v1')"
    " when 2 then concat('https://arxiv.org/abs/p', cast(c_custkey % 900 as string), 'v9') else concat('q', cast(c_custkey as string)) end"
)
REQUEST_CTES = {
    "raw": f"select c_custkey as seq, {_REQUEST} as raw from customer",
    "ids": r"""select requested_id, min(seq) as seq from (select seq, regexp_replace(regexp_replace(raw, '^arXiv:', ''), '^https://arxiv.org/abs/', '') as requested_id
        from raw) r group by requested_id""",
    "asked": r"""select *, regexp_replace(requested_id, 'v\d+$', '') as base, nullif(regexp_extract(requested_id, '(v\d+)$', 1), '') as asked from ids""",
    "fetched": f"""select event_id as seq, 'p' || (event_id * 7) % 3001 as base, {_FEED_ID} as versioned, event_type as title, props as summary from events""",
    "by_version": "select versioned, arg_max(title, seq) as title, arg_max(summary, seq) as summary from fetched where versioned <> '' group by versioned",
    "by_base": "select base, arg_max(title, seq) as title, arg_max(summary, seq) as summary, arg_max(versioned, seq) as versioned from fetched group by base",
    "matched": r"""select a.requested_id, a.seq, a.base as arxiv_id, case when a.asked is null and regexp_matches(coalesce(v.versioned, b.versioned), 'v\d+$')
        then coalesce(v.versioned, b.versioned) else a.requested_id end as arxiv_id_with_version, a.asked,
        coalesce(v.title, b.title) as found_title, coalesce(v.summary, b.summary, '') as summary
      from asked a left join by_version v on v.versioned = a.requested_id left join by_base b on b.base = a.base""",
}


def requests(spark, sf_dir):
    return I.table(spark, sf_dir, "customer").select(F.expr(_REQUEST).alias("raw_id"), F.col("c_custkey").alias("seq"))


@CHECKS.query(I.with_sql(**REQUEST_CTES) + """select requested_id, seq, arxiv_id, arxiv_id_with_version,
    coalesce(nullif(found_title, ''), 'arXiv:' || arxiv_id_with_version) as title, summary,
    'https://arxiv.org/pdf/' || arxiv_id_with_version || '.pdf' as pdf_url from matched""")
def matched_requests(spark, sf_dir):
    """Requested ids with their metadata, in request order, upgraded to the version found."""
    matched = select.match_requested(select.requested_ids(requests(spark, sf_dir)), feed(spark, sf_dir), upgrade=True)
    return matched.select("requested_id", "seq", "arxiv_id", "arxiv_id_with_version", "title", "summary", "pdf_url")


_LEGACY_SQL = r"""select distinct arxiv_id from stored where not contains(arxiv_id, ':') and not regexp_matches(coalesce(versioned, ''), '(?i)v\d+$')"""
_MIGRATED = r"""select l.arxiv_id, case when regexp_matches(b.versioned, 'v\d+$') then b.versioned else l.arxiv_id end as arxiv_id_with_version,
    case when regexp_matches(b.versioned, 'v\d+$') then 'migrated' else 'unresolved' end as outcome from legacy l left join by_base b on b.base = l.arxiv_id"""
_SELECT_CTES = {
    **REQUEST_CTES, "stored": STORED_SQL, "legacy": _LEGACY_SQL, "migrated": _MIGRATED,
    "known": """select trim(versioned) as v from stored where trim(versioned) <> '' union
      select arxiv_id_with_version from migrated where outcome = 'migrated'""",
    "remaining": "select * from matched where arxiv_id_with_version not in (select v from known)",
}


@CHECKS.query(I.with_sql(**_SELECT_CTES) + "select requested_id, arxiv_id_with_version from remaining")
def explicit_selection(spark, sf_dir):
    """Explicit ids that are not stored in that version, after legacy rows got theirs."""
    chosen = corpus_jobs.select_by_ids(requests(spark, sf_dir), feed(spark, sf_dir), stored_papers(spark, sf_dir))
    return chosen.papers.select("requested_id", "arxiv_id_with_version")


@CHECKS.query(I.with_sql(**_SELECT_CTES) + r"""select count(*) as requested_ids, count(*) as metadata_returned,
    count(*) filter (asked is null and regexp_matches(arxiv_id_with_version, 'v\d+$')) as resolved_to_version,
    count(*) filter (asked is null and not regexp_matches(arxiv_id_with_version, 'v\d+$')) as unresolved,
    count(*) - (select count(*) from remaining) as skipped_existing, (select count(*) from remaining) as to_ingest from matched""")
def explicit_selection_counts(spark, sf_dir):
    """E17, F9."""
    return corpus_jobs.select_by_ids(requests(spark, sf_dir), feed(spark, sf_dir), stored_papers(spark, sf_dir)).totals


@CHECKS.query(I.with_sql(**_SELECT_CTES) + "select * from migrated")
def migrated_versions(spark, sf_dir):
    """Legacy ids with the version found for them."""
    chosen = corpus_jobs.select_by_ids(requests(spark, sf_dir), feed(spark, sf_dir), stored_papers(spark, sf_dir))
    return chosen.migrated.select("arxiv_id", "arxiv_id_with_version", "outcome")


@CHECKS.query(I.with_sql(**_SELECT_CTES) + r"""select s.arxiv_id, coalesce(m.arxiv_id_with_version, s.versioned) as arxiv_id_with_version,
    'axv:' || coalesce(m.arxiv_id_with_version, s.arxiv_id) as doc_id, regexp_extract(m.arxiv_id_with_version, '(v\d+)$', 1) as version
    from stored s left join migrated m on m.arxiv_id = s.arxiv_id and m.outcome = 'migrated'""")
def versioned_papers(spark, sf_dir):
    """Stored papers after the migration."""
    from citeloom.operators.upsert import set_versions

    papers = stored_papers(spark, sf_dir)
    moved = corpus_jobs.select_by_ids(requests(spark, sf_dir), feed(spark, sf_dir), papers).migrated.filter("outcome = 'migrated'")
    return set_versions(papers, moved).select("arxiv_id", "arxiv_id_with_version", "doc_id", "version")


@CHECKS.query(I.with_sql(stored=STORED_SQL) + _LEGACY_SQL)
def legacy_papers(spark, sf_dir):
    """D2."""
    return catalog.legacy_unversioned(stored_papers(spark, sf_dir))


@CHECKS.query(I.with_sql(stored=STORED_SQL) + "select distinct trim(versioned) as arxiv_id_with_version from stored where trim(versioned) <> ''")
def stored_versions(spark, sf_dir):
    """D1."""
    return catalog.ingested_versions(stored_papers(spark, sf_dir))


@CHECKS.query("""select floor((r - 1) / 500)::bigint as batch_no, count(*) as n, min(id) as first_id, max(id) as last_id from (
    select 'id' || lpad(o_orderkey::varchar, 12, '0') as id, row_number() over (order by o_orderkey) as r from orders) x group by 1""")
def numbered_batches(spark, sf_dir):
    """Ids in order, in batches of 500."""
    ids = I.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("id"), F.col("o_orderkey").alias("seq")
    )
    return id_batches(ids, "id", "seq", 500).select(
        "batch_no", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first_id"),
        F.element_at("ids", -1).alias("last_id"),
    )


@CHECKS.query("""select event_id, row_number() over (order by event_id) as scanned,
    (sum(case when event_type = 'error' then 1 else 0 end) over (order by event_id))::bigint as errors from events""")
def running_counts(spark, sf_dir):
    """Running totals over a whole table without a single-task sort."""
    totals = {"scanned": F.lit(1), "errors": F.col("event_type") == "error"}
    rows = I.table(spark, sf_dir, "events").select("event_id", "event_type")
    return running_totals(rows, "event_id", totals, bucket_rows=1000).drop("event_type")


# --- DOI resolution over a landed cache: parts are DOIs, every fifth is not cached ------------------------------

_DOI = "'10.' || (1000 + p_partkey % 50) || '/p' || p_partkey"


def work_cache(spark, sf_dir):
    n = F.col("p_partkey")
    doi = F.concat(F.lit("10."), (1000 + n % 50).cast("string"), F.lit("/p"), n.cast("string"))

    def place(prefix, with_pdf, oa):
        return F.struct(
            F.when(with_pdf, F.concat(F.lit(f" https://{prefix}.org/"), (n % 300).cast("string"))).alias("pdf_url"),
            F.concat(F.lit(f"https://{prefix}.org/l/"), n.cast("string")).alias("landing_page_url"),
            F.lit(" ").alias("license"), oa.alias("is_oa"),
        )

    best = F.when(n % 2 == 0, place("best", n % 4 == 0, F.lit(True)))
    primary = F.when(n % 3 == 0, place("prim", n % 9 == 0, F.lit(False)))
    work = F.struct(
        F.concat(F.lit("W"), n.cast("string")).alias("id"),
        F.struct(F.when(n % 6 == 1, F.concat(F.lit("https://arxiv.org/abs/p"), (n % 100).cast("string"), F.lit("v3"))).alias("arxiv")).alias("ids"),
        best.alias("best_oa_location"), primary.alias("primary_location"),
        F.array(place("shut", F.lit(True), F.lit(False)), place("open", n % 5 == 1, F.lit(True)), place("last", F.lit(True), F.lit(True))).alias("locations"),
    )
    value = (
        F.when((n % 10 == 7) | (n % 5 == 0), F.lit("{broken")).when(n % 10 == 3, F.lit('{"_status": 404}')).when(n % 10 == 9, F.lit("[1, 2]"))
        .otherwise(F.to_json(work))
    )
    # Writing and parsing the records is heavy per byte of the table, which may be one split.
    rows = I.text_table(spark, sf_dir, "part").select(F.sha2(doi, 256).alias("cache_key"), value.alias("value"))
    return files.parse_work_cache(rows)


def dois(spark, sf_dir):
    """Every part's DOI, mentioned once per line item."""
    n = F.col("l_partkey")
    return I.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("10."), (1000 + n % 50).cast("string"), F.lit("/p"), n.cast("string")).alias("doi"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


RESOLVE_CTES = {
    "dois": f"select {_DOI} as doi, p_partkey as n, (select min(l_orderkey * 10 + l_linenumber) from lineitem where l_partkey = p_partkey) as seq from part where p_partkey in (select l_partkey from lineitem)",
    "states": "select *, case when n % 5 = 0 or n % 10 in (7, 9) then 'uncached' when n % 10 = 3 then 'missing' else 'resolved' end as cache_state from dois",
    "resolved": """select doi, seq, cache_state, n,
      case when cache_state = 'resolved' then 'W' || n end as openalex_id,
      case when cache_state = 'resolved' and n % 6 = 1 then 'p' || n % 100 end as arxiv_id,
      case when cache_state <> 'resolved' then null when n % 4 = 0 then 'https://best.org/' || n % 300 when n % 9 = 0 then 'https://prim.org/' || n % 300
        when n % 5 = 1 then 'https://open.org/' || n % 300 else 'https://last.org/' || n % 300 end as pdf_url,
      case when cache_state <> 'resolved' then 'none' when n % 4 = 0 then 'best_oa_location' when n % 9 = 0 then 'primary_location' else 'locations' end as source
    from states""",
}


@CHECKS.query(I.with_sql(**RESOLVE_CTES) + "select doi, seq::bigint as seq, cache_state, openalex_id, arxiv_id, pdf_url, source from resolved")
def resolved_dois(spark, sf_dir):
    """DOIs against the cache with the open-access location to use."""
    return resolve.resolve_dois(dois(spark, sf_dir), work_cache(spark, sf_dir)).select(
        "doi", "seq", "cache_state", "openalex_id", "arxiv_id", "pdf_url", "source"
    )


@CHECKS.query(I.with_sql(**RESOLVE_CTES) + """select coalesce('axv:' || arxiv_id, 'doi:' || doi) as doc_id, doi,
    case when arxiv_id is not null then 0.95::double when pdf_url is not null then 0.75::double else 0.3::double end as resolution_confidence
    from resolved where cache_state = 'resolved'""")
def resolution_rows(spark, sf_dir):
    """J16, L15."""
    done = corpus_jobs.resolve_from_cache(dois(spark, sf_dir), work_cache(spark, sf_dir), 1_700_000_000)
    return done.resolutions.select("doc_id", "doi", "resolution_confidence")


@CHECKS.query(I.with_sql(**RESOLVE_CTES) + """select count(*) as dois_processed, count(*) filter (cache_state = 'resolved') as resolved_records,
    count(distinct pdf_url) as resolved_pdf_urls, count(distinct arxiv_id) as resolved_arxiv_ids,
    count(*) filter (cache_state <> 'resolved') as unresolved, count(*) filter (cache_state <> 'uncached') as cache_hits from resolved""")
def resolution_totals(spark, sf_dir):
    """F7."""
    return corpus_jobs.resolve_from_cache(dois(spark, sf_dir), work_cache(spark, sf_dir), 1_700_000_000).totals


@CHECKS.query(I.with_sql(**RESOLVE_CTES) + "select pdf_url, min(doi) as doi from resolved where pdf_url is not null group by pdf_url")
def resolved_pdf_urls(spark, sf_dir):
    """H8: distinct PDF URLs; their list is ordered by first DOI."""
    done = corpus_jobs.resolve_from_cache(dois(spark, sf_dir), work_cache(spark, sf_dir), 1_700_000_000)
    firsts = done.records.filter(F.col("pdf_url").isNotNull()).groupBy("pdf_url").agg(F.min("doi").alias("doi"))
    return done.pdf_urls.join(firsts, "pdf_url")


# --- catalogue ------------------------------------------------------------------------------------------------


def paper_chunks(spark, sf_dir):
    n = F.col("l_partkey")
    base = F.when(n % 7 == 0, F.concat(F.lit("doi:10.1/"), n.cast("string"))).otherwise(F.concat(F.lit("p"), n.cast("string")))
    return I.table(spark, sf_dir, "lineitem").select(
        base.alias("arxiv_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_index"), F.col("l_returnflag").alias("text")
    )


def paper_metrics(spark, sf_dir):
    n = F.col("p_partkey")
    return I.table(spark, sf_dir, "part").select(
        F.when(n % 2 == 0, F.concat(F.lit("other-"), n.cast("string"))).when(n % 7 == 0, F.concat(F.lit("doi:10.1/"), n.cast("string"))).otherwise(F.concat(F.lit("p"), n.cast("string"))).alias("arxiv_id"),
        F.when(n % 11 > 0, (n % 3).cast("int")).alias("tier"), F.col("p_size").alias("citation_count"),
        F.when(n % 13 == 0, " ").otherwise(F.col("p_brand")).alias("venue"),
    )


CATALOGUE_CTES = {
    "stored": STORED_SQL,
    "chunk": "select case when l_partkey % 7 = 0 then 'doi:10.1/' || l_partkey else 'p' || l_partkey end as arxiv_id, l_orderkey * 10 + l_linenumber as chunk_index from lineitem",
    "metrics": """select case when p_partkey % 2 = 0 then 'other-' || p_partkey when p_partkey % 7 = 0 then 'doi:10.1/' || p_partkey else 'p' || p_partkey end as arxiv_id,
      case when p_partkey % 11 > 0 then (p_partkey % 3)::int end as tier, p_size as citation_count,
      case when p_partkey % 13 = 0 then ' ' else p_brand end as venue from part""",
    "full_list": """select s.arxiv_id, s.doc_id, case when s.arxiv_id like 'doi:%' then s.arxiv_id else s.arxiv_id end as shown, title, published,
      p_brand || '|' || p_type as authors, coalesce(n_chunks, 0) as chunk_count, tier, citation_count, venue from stored s
      left join (select arxiv_id, count(*) as n_chunks from chunk group by 1) c on c.arxiv_id = s.arxiv_id
      left join metrics m on m.arxiv_id = s.arxiv_id""",
}
_LIST = "select arxiv_id, title, published, authors, chunk_count, tier, citation_count, venue from full_list"


def _listed(rows):
    return rows.select(
        "arxiv_id", "title", "published", F.array_join("authors", "|").alias("authors"), "chunk_count", "tier", "citation_count", "venue"
    )


@CHECKS.query(I.with_sql(**CATALOGUE_CTES) + _LIST)
def catalogue(spark, sf_dir):
    """All papers with chunk counts and metrics."""
    return _listed(catalog.catalogue(stored_papers(spark, sf_dir), paper_chunks(spark, sf_dir), paper_metrics(spark, sf_dir)))


@CHECKS.query(I.with_sql(**CATALOGUE_CTES) + _LIST + " where arxiv_id ilike '%7_3%' or doc_id ilike '%7_3%' or title ilike '%7_3%'"
              " order by published desc, arxiv_id desc limit 20 offset 10")
def catalogue_page(spark, sf_dir):
    """One page of a search, newest first."""
    page, _ = catalog.catalogue_page(
        stored_papers(spark, sf_dir), paper_chunks(spark, sf_dir), paper_metrics(spark, sf_dir), 10, 20, " 7_3 "
    )
    return _listed(page)


@CHECKS.query(I.with_sql(**CATALOGUE_CTES) + "select count(*) as total from stored where arxiv_id ilike '%7_3%' or doc_id ilike '%7_3%' or title ilike '%7_3%'")
def catalogue_total(spark, sf_dir):
    """H2."""
    return catalog.catalogue_page(
        stored_papers(spark, sf_dir), paper_chunks(spark, sf_dir), paper_metrics(spark, sf_dir), 10, 20, "7_3"
    )[1]


@CHECKS.query(I.with_sql(**CATALOGUE_CTES) + """select f.arxiv_id, f.chunk_count, f.tier, c.chunk_index from full_list f
    left join chunk c using (arxiv_id) where f.arxiv_id in (select 'p' || s_suppkey from supplier)""")
def paper_details(spark, sf_dir):
    """Papers of an id table with metrics and ordered chunks."""
    ids = I.table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("arxiv_id"))
    details, parts = catalog.paper_details(
        ids, stored_papers(spark, sf_dir), paper_chunks(spark, sf_dir), paper_metrics(spark, sf_dir)
    )
    return details.select("arxiv_id", "chunk_count", "tier").join(parts.select("arxiv_id", "chunk_index"), "arxiv_id", "left")


@CHECKS.query(I.with_sql(**CATALOGUE_CTES) + """select 'papers' as metric, count(*) as n from stored union all select 'chunks', count(*) from chunk
    union all select 'chunk_docs', count(distinct arxiv_id) from chunk union all select 'metrics', count(*) from metrics
    union all select 'papers_without_metrics', count(*) from stored where arxiv_id not in (select arxiv_id from metrics)""")
def corpus_counts(spark, sf_dir):
    """E2, F1."""
    return catalog.corpus_counts(stored_papers(spark, sf_dir), paper_chunks(spark, sf_dir), paper_metrics(spark, sf_dir))


@CHECKS.query(I.with_sql(**CATALOGUE_CTES) + """select distinct 'p' || l_partkey || '.pdf' as file_name from lineitem
    where 'p' || l_partkey || '.pdf' not in (select arxiv_id || '.pdf' from stored where trim(pdf_path) <> '')""")
def orphan_files(spark, sf_dir):
    """Files that no paper points to."""
    on_disk = I.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("file_name"))
    return catalog.orphan_files(on_disk, stored_papers(spark, sf_dir))


@CHECKS.query(I.with_sql(**CATALOGUE_CTES) + "select arxiv_id from stored order by arxiv_id limit 100")
def first_paper_ids(spark, sf_dir):
    """H3, H9: the first hundred ids."""
    return catalog.paper_ids(stored_papers(spark, sf_dir), 100)
