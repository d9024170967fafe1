"""Canonical state: references and resolutions folded row by row, the queue and its results.

The SQL applies operations one at a time in order, with a recursive query per document; the Spark job uses
partial aggregates. Both must end in the same state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.checks import Registry, inputs as I
from citeloom.checks.discovery import MENTION_CTES, reference_texts
from citeloom.config import Settings
from citeloom.operators import extract, graph, queue, upsert
from citeloom.plans import corpus_jobs
from citeloom.sources import files

CHECKS = Registry()
NOW = 1_700_000_000

# --- one batch: mentions as references, one resolution per document, stored rows for the labelled documents ---

_KIND_OF = I.SOURCE_KIND
_RES_DOI = (
    "case when doc_id % 3 = 0 then concat('10.5555/x', cast(doc_id % 7 as string))"
    " else concat('10.', cast(1000 + doc_id % 9000 as string), '/ab', cast(doc_id as string)) end"
)
_RES_PAPER = f"case when doc_id % 4 = 0 then concat({I.paper_id()}, 'v2') when doc_id % 12 = 1 then '2001.00001v1' end"
_RES_PDF = "case when doc_id % 5 < 2 then concat('https://oa.org/', cast(doc_id % 50 as string), '.pdf') end"
_RES_CONF = "case when doc_id % 4 = 0 then 0.95 when doc_id % 5 < 2 then 0.75 else 0.3 end"
_STATUS = (
    "case doc_id % 6 when 0 then 'ingested' when 1 then 'ready' when 2 then 'blocked' when 3 then 'failed' when 4 then 'discovered' else 'resolved' end"
)
_STORED_ID = (
    "case doc_id % 3 when 0 then concat('doi:10.', cast(1000 + doc_id % 9000 as string), '/ab', cast(doc_id as string))"
    " when 1 then concat('axv:', lpad(cast(2001 + cast(floor(doc_id / 100000) as bigint) % 7999 as string), 4, '0'), '.', lpad(cast(doc_id % 100000 as string), 5, '0'),"
    " 'v', cast(1 + doc_id % 3 as string)) else concat('doi:10.5555/y', cast(doc_id as string)) end"
)


def references(spark, sf_dir):
    mined = extract.mine_texts(reference_texts(spark, sf_dir))
    order = F.col("found_in").cast("long") * 100000 + F.when(F.col("kind") == "doi", 50000).otherwise(0) + F.col("position")
    rows = mined.withColumns({"seq": order, "n": F.col("found_in").cast("long"), "source": F.col("source_repo")})
    return rows.select(
        "seq", F.col("kind").alias("ref_type"), F.col("value").alias("normalized_value"), F.expr(_KIND_OF).alias("source_kind"),
        F.col("source_url").alias("source_ref"), (F.lit(NOW - 1000) + F.col("n") % 100).cast("long").alias("discovered_at_unix"),
    )


def resolutions(spark, sf_dir):
    rows = I.table(spark, sf_dir, "documents").select(
        F.expr(_RES_DOI).alias("doi"), F.expr(_RES_PAPER).alias("paper"), F.expr(_RES_PDF).alias("pdf_url"),
        F.expr(_RES_CONF).cast("double").alias("resolution_confidence"), F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(NOW - 10)).cast("long").alias("resolved_at_unix"),
    )
    return rows.select(
        F.coalesce(F.concat(F.lit("axv:"), "paper"), F.concat(F.lit("doi:"), "doi")).alias("doc_id"),
        F.regexp_replace("paper", r"v\d+$", "").alias("arxiv_id"), F.col("paper").alias("arxiv_id_with_version"), "doi", "pdf_url",
        "resolution_confidence", F.lit("openalex_resolved").alias("source_kind"), "resolved_at_unix", "seq",
    )


def stored_state(spark, sf_dir):
    labels = I.table(spark, sf_dir, "labels").withColumns({"key": F.expr(_STORED_ID), "state": F.expr(_STATUS)})
    null = F.lit(None).cast("string")
    documents = labels.select(
        F.col("key").alias("doc_id"), null.alias("arxiv_id"), null.alias("arxiv_id_with_version"), null.alias("doi"),
        F.when(F.col("doc_id") % 2 == 0, "https://old.org/a.pdf").alias("pdf_url"), F.col("state").alias("status"),
        F.lit(0.5).alias("resolution_confidence"), F.when(F.col("doc_id") % 5 > 0, "scraped").alias("provenance_kind"),
        F.lit("old").alias("best_source_kind"), F.lit(NOW - 9000).cast("long").alias("created_at"),
        F.lit(NOW - 5000).cast("long").alias("updated_at"),
    )
    candidates = labels.select(
        F.col("key").alias("doc_id"), F.col("state").alias("status"),
        F.when(F.col("doc_id") % 2 == 0, "https://old.org/a.pdf").alias("best_pdf_url"),
        (F.col("doc_id") % 3).cast("double").alias("priority_score"), (F.col("doc_id") % 4).cast("int").alias("retry_count"),
        F.when(F.col("state") == "blocked", F.lit(NOW + 50)).cast("long").alias("next_retry_unix"),
        F.when(F.col("state") == "failed", "boom").alias("last_error"), F.lit(NOW - 5000).cast("long").alias("updated_at"),
    )
    sources = labels.select(
        F.col("key").alias("doc_id"), F.lit("curated_repo").alias("source_kind"), F.lit("https://github.com/src0").alias("source_ref"),
        F.lit(NOW - 9000).cast("long").alias("first_seen"), F.lit(NOW - 5000).cast("long").alias("last_seen"),
    )
    return graph.GraphState(documents, sources, candidates)


_PROV = "case {0} when 'curated_repo' then 'curated' when 'arxiv_feed' then 'canonical_api' when 'openalex_resolved' then 'canonical_api' else 'scraped' end"
_PRIO = (
    "(case {0} when 'curated_repo' then 1.0::double when 'arxiv_feed' then 0.9::double when 'openalex_resolved' then 0.7::double else 0.5::double end"
    " + case {1} when 'arxiv_versioned' then 0.4::double when 'oa_pdf' then 0.3::double when 'pdf_only' then 0.2::double else 0::double end"
    " + 0.2::double + 0.05::double * {2})"
)
OPS_CTES = {
    **MENTION_CTES,
    "kinds": f"select doc_id, {_KIND_OF} as source_kind from documents",
    "refs": f"""select doc_id * 100000 + case kind when 'doi' then 50000 else 0 end + position as seq, kind, value, k.source_kind,
        'https://github.com/' || source as source_ref, {NOW} - 1000 + doc_id % 100 as seen_at from mentions join kinds k using (doc_id)""",
    "ref_ops": f"""select case kind when 'arxiv' then 'axv:' || value else 'doi:' || value end as doc, 1 as phase, seq, 1 as own, 'reference' as op,
        case kind when 'arxiv' then regexp_replace(value, 'v\\d+$', '') end as arxiv_id, case kind when 'arxiv' then value end as versioned,
        case kind when 'doi' then value end as doi, case when kind = 'arxiv' and regexp_matches(value, 'v\\d+$')
          then 'https://arxiv.org/pdf/' || value || '.pdf' end as pdf,
        case when kind = 'arxiv' and regexp_matches(value, 'v\\d+$') then 'ready' else 'discovered' end as status,
        case when kind = 'arxiv' and regexp_matches(value, 'v\\d+$') then 0.9::double else 0::double end as conf,
        case when kind = 'arxiv' and regexp_matches(value, 'v\\d+$') then 'arxiv_versioned' else 'metadata_only' end as rk,
        source_kind, source_ref, seen_at, null::varchar as error from refs""",
    "res": f"""select doc_id as seq, {_RES_DOI} as doi, {_RES_PAPER} as paper, {_RES_PDF} as pdf, ({_RES_CONF})::double as conf,
        case when doc_id % 2 = 0 then {NOW} - 10 else {NOW} end as seen_at from documents""",
    "res_ops": """select coalesce('axv:' || paper, 'doi:' || doi) as doc, 2 as phase, seq, 1 as own, 'resolution' as op,
        regexp_replace(paper, 'v\\d+$', '') as arxiv_id, paper as versioned, doi, pdf,
        case when paper is not null or pdf is not null then 'ready' else 'blocked' end as status, conf,
        case when paper is not null then 'arxiv_versioned' when pdf is not null then 'oa_pdf' else 'metadata_only' end as rk,
        'openalex_resolved' as source_kind, null::varchar as source_ref, seen_at, null::varchar as error from res
      union all select 'doi:' || doi, 2, seq, 0, 'alias', regexp_replace(paper, 'v\\d+$', ''), paper, doi, pdf, 'resolved', conf,
        'metadata_only', 'openalex_resolved', null::varchar, seen_at, 'merged_to:axv:' || paper from res where paper is not null""",
    "ops": f"""select *, {_PROV.format('source_kind')} as prov, {_PRIO.format('source_kind', 'rk', 'conf')} as prio,
        row_number() over (partition by doc order by phase, seq, own) as n from (select * from ref_ops union all select * from res_ops) o""",
    "stored": f"""select {_STORED_ID} as doc, {_STATUS} as status, case when doc_id % 2 = 0 then 'https://old.org/a.pdf' end as pdf,
        case when doc_id % 5 > 0 then 'scraped' end as prov, (doc_id % 3)::double as prio, doc_id % 4 as retries,
        case when {_STATUS} = 'blocked' then {NOW} + 50 end as next_retry, case when {_STATUS} = 'failed' then 'boom' end as error from labels""",
    "keys": "select doc from stored union select doc from ops",
    "docs": f"""select k.doc, 0 as n, s.doc is not null as known, s.status, null::varchar as arxiv_id, null::varchar as versioned, null::varchar as doi,
        s.pdf, case when s.doc is not null then 0.5::double end as conf, s.prov, case when s.doc is not null then 'old' end as best,
        case when s.doc is not null then {NOW} - 9000 end as created, case when s.doc is not null then {NOW} - 5000 end as updated
      from keys k left join stored s using (doc)
      union all select d.doc, o.n, true,
        case when not d.known then o.status when o.op = 'alias' then 'resolved' when d.status = 'ingested' then 'ingested'
          when o.op = 'reference' and d.status = 'ready' and o.status = 'discovered' then 'ready' else o.status end,
        coalesce(o.arxiv_id, d.arxiv_id), coalesce(o.versioned, d.versioned), coalesce(o.doi, d.doi), coalesce(o.pdf, d.pdf),
        greatest(d.conf, o.conf), case when d.known and o.op = 'alias' then d.prov else o.prov end, o.source_kind,
        case when d.known then d.created else o.seen_at end, {NOW}
      from docs d join ops o on o.doc = d.doc and o.n = d.n + 1""",
    "queue": f"""select k.doc, 0 as n, s.doc is not null as known, s.status, s.pdf, s.prio, s.retries, s.next_retry::bigint as next_retry, s.error,
        case when s.doc is not null then {NOW} - 5000 end as updated from keys k left join stored s using (doc)
      union all select q.doc, o.n, true,
        case when not q.known then o.status when q.status = 'ingested' then 'ingested'
          when o.op = 'reference' and q.status = 'ready' and o.status = 'discovered' then 'ready' else o.status end,
        case when o.op = 'reference' then coalesce(q.pdf, o.pdf) else coalesce(o.pdf, q.pdf) end,
        case o.op when 'reference' then greatest(q.prio, o.prio) when 'alias' then coalesce(q.prio, 0) else o.prio end,
        coalesce(q.retries, 0),
        case o.op when 'reference' then q.next_retry when 'alias' then null
          else case when o.status = 'blocked' then {NOW} + 14 * 86400 end end,
        case o.op when 'alias' then o.error else q.error end, {NOW}
      from queue q join ops o on o.doc = q.doc and o.n = q.n + 1""",
}
_LAST = " qualify row_number() over (partition by doc order by n desc) = 1"


@CHECKS.query(I.with_sql(**OPS_CTES) + f"""select doc as doc_id, arxiv_id, versioned as arxiv_id_with_version, doi, pdf as pdf_url, status,
    round(conf, 6) as resolution_confidence, prov as provenance_kind, best as best_source_kind, created::bigint as created_at,
    updated::bigint as updated_at from docs{_LAST}""")
def folded_documents(spark, sf_dir):
    """Documents after one batch."""
    state = graph.fold_batch(stored_state(spark, sf_dir), references(spark, sf_dir), resolutions(spark, sf_dir), NOW)
    return state.documents.withColumn("resolution_confidence", F.round("resolution_confidence", 6))


@CHECKS.query(I.with_sql(**OPS_CTES) + f"""select doc as doc_id, status, pdf as best_pdf_url, round(prio, 6) as priority_score,
    retries::int as retry_count, next_retry as next_retry_unix, error as last_error, updated::bigint as updated_at from queue{_LAST}""")
def folded_candidates(spark, sf_dir):
    """Candidates after one batch."""
    state = graph.fold_batch(stored_state(spark, sf_dir), references(spark, sf_dir), resolutions(spark, sf_dir), NOW)
    return state.candidates.withColumn("priority_score", F.round("priority_score", 6))


@CHECKS.query(I.with_sql(**OPS_CTES) + f"""select doc as doc_id, source_kind, source_ref, arg_min(first_seen, pos)::bigint as first_seen,
      max(last_seen)::bigint as last_seen from (
        select doc, source_kind, source_ref, seen_at as first_seen, {NOW} as last_seen, seq as pos from ref_ops
        union all select doc, 'curated_repo', 'https://github.com/src0', {NOW} - 9000, {NOW} - 5000, -1 from stored) s group by 1, 2, 3""")
def folded_sources(spark, sf_dir):
    """Who mentioned a document, first and last time."""
    return graph.fold_batch(stored_state(spark, sf_dir), references(spark, sf_dir), None, NOW).sources


_RESTORED = {
    **{k: v for k, v in OPS_CTES.items() if k not in ("stored", "keys", "docs", "queue")},
    "keys": "select distinct doc from ops", "stored": OPS_CTES["stored"] + " where false",
    "docs": OPS_CTES["docs"], "queue": OPS_CTES["queue"],
}


@CHECKS.query(I.with_sql(**_RESTORED) + f"""select d.status, q.status as queue_status, d.prov as provenance_kind, count(*) as n,
    round(sum(q.prio), 4) as priority from (select * from docs{_LAST}) d join (select * from queue{_LAST}) q using (doc) group by 1, 2, 3""")
def restored_state(spark, sf_dir):
    """The whole state recomputed from run artifacts, summarised."""
    state = corpus_jobs.restore_graph(spark, [references(spark, sf_dir)], [resolutions(spark, sf_dir)], NOW)
    queued = state.candidates.select("doc_id", F.col("status").alias("queue_status"), "priority_score")
    return state.documents.join(queued, "doc_id").groupBy("status", "queue_status", "provenance_kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("priority_score"), 4).alias("priority")
    )


@CHECKS.query(I.with_sql(**OPS_CTES) + """select 'run-1' as run_id, count(*) as n, count(distinct value) as n_values, min(seen_at)::bigint as first_at,
    max(seq)::bigint as last_seq from refs union all select 'run-1', count(*), count(distinct doi), min(seen_at), max(seq) from res""")
def logged_events(spark, sf_dir):
    """Reference and resolution events of a run, summarised."""
    refs = graph.reference_events(references(spark, sf_dir), "run-1")
    done = graph.resolution_events(resolutions(spark, sf_dir), "run-1", NOW)

    def summary(df, value, at):
        return df.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("n_values"), F.min(at).alias("first_at"),
            F.max("seq").cast("long").alias("last_seq"),
        )

    return summary(refs, "normalized_value", "discovered_at_unix").unionByName(summary(done, "doi", "resolved_at_unix"))


@CHECKS.query(f"""select o_orderkey as seq, nullif(trim(case o_custkey % 3 when 0 then ' ' when 1 then o_orderstatus else '' end), '') as doi,
    coalesce(case when o_custkey % 2 = 0 then o_totalprice end, 0) as resolution_confidence,
    coalesce(case when o_custkey % 4 = 0 then o_orderpriority end, 'openalex_resolved') as source_kind from orders""")
def cleaned_resolutions(spark, sf_dir):
    """Blanks, default confidence and default source of resolution artifacts."""
    custkey = F.col("o_custkey")
    raw = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.lit(" ").alias("arxiv_id"), F.lit("").alias("arxiv_id_with_version"), F.lit("\t").alias("pdf_url"),
        F.when(custkey % 3 == 0, " ").when(custkey % 3 == 1, F.col("o_orderstatus")).otherwise("").alias("doi"),
        F.when(custkey % 2 == 0, F.col("o_totalprice")).alias("resolution_confidence"),
        F.when(custkey % 4 == 0, F.col("o_orderpriority")).alias("source_kind"),
    )
    return files.clean_resolutions(raw).select("seq", "doi", "resolution_confidence", "source_kind")


_RUN = "concat(strftime(o_orderdate, '%Y%m%d'), case o_custkey % 3 when 0 then '-awesome' when 1 then '-visionbib' else '-openalex' end)"


@CHECKS.query(f"""select o_orderkey, {_RUN} as run_id from orders where {_RUN} = (select max({_RUN}) from orders where {_RUN} like '%-visionbib')""")
def latest_run_rows(spark, sf_dir):
    """A3: rows of the latest run of a kind."""
    suffix = F.when(F.col("o_custkey") % 3 == 0, "-awesome").when(F.col("o_custkey") % 3 == 1, "-visionbib").otherwise("-openalex")
    rows = I.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), suffix).alias("run_id")
    )
    return rows.filter(F.col("run_id") == files.latest_run(rows, "visionbib"))


# --- the queue over orders -----------------------------------------------------------------------------------

_ORDER_STATUS = "case o_orderstatus when 'F' then 'ingested' when 'O' then 'ready' else 'blocked' end"
_MID = 900_000_000


def order_candidates(spark, sf_dir):
    at = I.epoch("o_orderdate")
    return I.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("axv:"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.expr(_ORDER_STATUS).alias("status"),
        F.when(F.col("o_custkey") % 4 > 0, F.concat(F.lit("https://p.org/"), F.col("o_orderkey").cast("string"))).alias("best_pdf_url"),
        F.round(F.col("o_totalprice") / 1000, 0).alias("priority_score"), (F.col("o_custkey") % 6).cast("int").alias("retry_count"),
        F.when(F.col("o_custkey") % 3 > 0, at).alias("next_retry_unix"), F.lit(None).cast("string").alias("last_error"),
        (at + F.col("o_custkey") % 10).alias("updated_at"),
    )


_ORDER_QUEUE = f"""select 'axv:' || o_orderkey as doc_id, {_ORDER_STATUS} as status,
    case when o_custkey % 4 > 0 then 'https://p.org/' || o_orderkey end as best_pdf_url, round(o_totalprice / 1000, 0) as priority_score,
    (o_custkey % 6)::int as retry_count, case when o_custkey % 3 > 0 then epoch(o_orderdate)::bigint end as next_retry_unix,
    epoch(o_orderdate)::bigint + o_custkey % 10 as updated_at from orders"""
_READY = f"status = 'ready' and (next_retry_unix is null or next_retry_unix <= {_MID})"


@CHECKS.query(I.with_sql(q=_ORDER_QUEUE) + f"""select doc_id, priority_score, updated_at from q where {_READY}
    order by priority_score desc, updated_at, doc_id limit 10""")
def ready_queue(spark, sf_dir):
    """The next queue batch of ten."""
    return queue.ready_candidates(order_candidates(spark, sf_dir), 10, _MID).select("doc_id", "priority_score", "updated_at")


@CHECKS.query(I.with_sql(q=_ORDER_QUEUE) + f"""select status, {_READY.replace("'", "'")} as is_ready, count(*) as n from q group by 1, 2""")
def ready_counts(spark, sf_dir):
    """D4 over the whole queue."""
    rows = order_candidates(spark, sf_dir).withColumn("is_ready", queue.is_ready(_MID))
    return rows.groupBy("status", "is_ready").agg(F.count(F.lit(1)).alias("n"))


_DOCS = """select case o_orderstatus when 'P' then 'other:' else 'axv:' end || o_orderkey as doc_id, case o_custkey % 5 when 0 then null when 1 then ' ' else 'id' || o_orderkey || 'v2' end as versioned,
    case o_custkey % 7 when 0 then null else 'id' || o_orderkey end as arxiv_id, case o_custkey % 2 when 0 then '10.1/' || o_orderkey end as doi,
    case o_custkey % 8 when 0 then null when 4 then ' https://d.org/x ' else 'https://d.org/y' end as pdf_url from orders"""


def order_documents(spark, sf_dir):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    return I.table(spark, sf_dir, "orders").select(
        F.concat(F.when(F.col("o_orderstatus") == "P", "other:").otherwise("axv:"), key).alias("doc_id"),
        F.when(cust % 5 == 1, " ").when(cust % 5 > 1, F.concat(F.lit("id"), key, F.lit("v2"))).alias("arxiv_id_with_version"),
        F.when(cust % 7 > 0, F.concat(F.lit("id"), key)).alias("arxiv_id"),
        F.when(cust % 2 == 0, F.concat(F.lit("10.1/"), key)).alias("doi"),
        F.when(cust % 8 == 4, " https://d.org/x ").when(cust % 8 != 0, "https://d.org/y").alias("pdf_url"),
        F.lit("curated").alias("provenance_kind"), F.lit("ready").alias("status"), F.lit(1).cast("long").alias("updated_at"),
    )


PAPERS_SQL = """select q.doc_id, coalesce(nullif(trim(d.arxiv_id), ''), regexp_replace(coalesce(nullif(trim(d.versioned), ''), q.doc_id), 'v\\d+$', '')) as arxiv_id,
    coalesce(nullif(trim(d.versioned), ''), q.doc_id) as arxiv_id_with_version, coalesce(d.doi, q.doc_id) as title,
    coalesce(q.best_pdf_url, trim(d.pdf_url)) as pdf_url from q left join d on q.doc_id = d.doc_id"""
GATED_SQL = """select *, case when contains(arxiv_id, ':') then pdf_url else 'https://arxiv.org/abs/' || arxiv_id_with_version end as abs_url,
    case when pdf_url is null then 'missing_pdf_url' when not exists (select 1 from files f where f.stem = replace(arxiv_id_with_version, ':', '_'))
    then 'cache_only_missing_pdf' end as blocked_reason from papers"""


@CHECKS.query(I.with_sql(q=_ORDER_QUEUE, d=_DOCS, files="select distinct 'id' || l_orderkey || case when l_linenumber > 2 then 'v2' else 'v1' end as stem from lineitem",
                         papers=PAPERS_SQL) + GATED_SQL)
def gated_papers(spark, sf_dir):
    """Candidates as papers, with the reason where full text is missing."""
    version = F.when(F.col("l_linenumber") > 2, "v2").otherwise("v1")
    files_on_disk = I.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("id"), F.col("l_orderkey").cast("string"), version).alias("file_stem")
    )
    papers = queue.to_papers(order_candidates(spark, sf_dir), order_documents(spark, sf_dir))
    return queue.require_cached(papers, files_on_disk).select(
        "doc_id", "arxiv_id", "arxiv_id_with_version", "title", "pdf_url", "abs_url", "blocked_reason"
    )


_ATTEMPT = "case event_type when 'error' then 'failed' when 'click' then 'blocked' when 'view' then 'ingested' else 'ready' end"
_LIMITS = Settings(candidate_retry_days=3, candidate_max_retries=40)


def event_attempts(spark, sf_dir):
    return I.table(spark, sf_dir, "events").select(
        F.concat(F.lit("axv:"), F.col("user_id").cast("string")).alias("doc_id"), F.expr(_ATTEMPT).alias("status"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reason"), F.struct("ts", "event_id").alias("seq"),
    )


ATTEMPT_SQL = {
    "e": f"select 'axv:' || user_id as doc_id, {_ATTEMPT} as status, 'r' || event_id as reason, row_number() over w as n from events window w as (partition by user_id order by ts, event_id)",
    "q": _ORDER_QUEUE,
    "start": """select coalesce(q.doc_id, e.doc_id) as doc_id, q.status, coalesce(q.retry_count, 0) as retry_count, q.next_retry_unix,
        null::varchar as last_error, q.best_pdf_url, coalesce(q.priority_score, 0) as priority_score, q.updated_at
      from q full join (select distinct doc_id from e) e on q.doc_id = e.doc_id""",
    "run": f"""select s.*, 0 as n from start s
      union all select r.doc_id, case when e.status in ('blocked', 'failed') then case when r.retry_count + 1 >= 40 then 'failed' else 'blocked' end else e.status end,
        r.retry_count + case when e.status in ('blocked', 'failed') then 1 else 0 end,
        case when e.status in ('blocked', 'failed') and r.retry_count + 1 < 40 then {NOW} + 3 * 86400 end, e.reason, r.best_pdf_url, r.priority_score, {NOW}, e.n
      from run r join e on e.doc_id = r.doc_id and e.n = r.n + 1""",
    "ended": "select * from run qualify row_number() over (partition by doc_id order by n desc) = 1",
}


@CHECKS.query(I.with_sql(**ATTEMPT_SQL) + """select doc_id, status, best_pdf_url, priority_score, retry_count::int as retry_count, next_retry_unix,
    last_error, updated_at from ended""")
def attempt_results(spark, sf_dir):
    """Candidates after all attempts of their documents, applied in order."""
    return queue.apply_results(order_candidates(spark, sf_dir), event_attempts(spark, sf_dir), NOW, _LIMITS)


@CHECKS.query(I.with_sql(**ATTEMPT_SQL, d=_DOCS) + f"""select d.doc_id, case when e.doc_id is not null then coalesce(r.status, 'ready') else 'ready' end as status,
    case when e.doc_id is not null then {NOW} else 1 end::bigint as updated_at
    from d left join ended r using (doc_id) left join (select distinct doc_id from e) e using (doc_id)""")
def attempt_documents(spark, sf_dir):
    """Documents take the status of their candidate."""
    results = event_attempts(spark, sf_dir)
    ended = queue.apply_results(order_candidates(spark, sf_dir), results, NOW, _LIMITS)
    return queue.apply_results_to_documents(order_documents(spark, sf_dir), ended, results, NOW).select("doc_id", "status", "updated_at")


@CHECKS.query("""select count(*) as selected, count(*) filter (o_orderstatus <> 'P') as queued, count(*) filter (o_orderstatus = 'F') as ingested,
    count(*) filter (o_orderstatus = 'O') as failed, count(*) filter (o_orderstatus = 'P') as blocked from orders""")
def ingest_counts(spark, sf_dir):
    """F8: observed while the outcomes are written."""
    outcome = F.when(F.col("o_orderstatus") == "F", "ingested").when(F.col("o_orderstatus") == "O", "failed").otherwise("blocked")
    return queue.stored_outcomes(I.table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome")))[1]


# --- keyed snapshots -----------------------------------------------------------------------------------------


@CHECKS.query("""with e as (select 'u' || user_id as arxiv_id, event_id, case when event_id % 3 > 0 then 'h' || event_id end as sha, event_type, ts from events),
    p as (select * from (select arxiv_id, event_type, event_id, row_number() over (partition by arxiv_id order by event_id desc) as r from e) x where r = 1)
    select coalesce(c.c_custkey, substr(p.arxiv_id, 2)::bigint) as custkey, coalesce(p.event_type, c.c_name) as title,
      coalesce(p.event_id::varchar, '') as version, coalesce(h.sha, case when c.c_custkey is not null then 'old' end) as content_sha256
      from customer c full join p on p.arxiv_id = 'u' || c.c_custkey
      left join (select arxiv_id, arg_max(sha, event_id) as sha from e where sha is not null group by 1) h using (arxiv_id)""")
def upserted_papers(spark, sf_dir):
    """Latest paper row per id; the content hash survives batches without one."""
    null = F.lit(None).cast("string")
    rest = [null.alias(c) for c in ("summary", "published", "updated", "pdf_url", "abs_url", "pdf_path", "tei_path", "provenance_kind")]
    stored = I.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("arxiv_id"), null.alias("doc_id"), null.alias("arxiv_id_with_version"),
        F.lit("").alias("version"), F.col("c_name").alias("title"), F.lit("").alias("authors_json"), F.lit("old").alias("content_sha256"), *rest,
    )
    batch = I.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("arxiv_id"), null.alias("doc_id"), F.lit("x").alias("arxiv_id_with_version"),
        F.col("event_id").cast("string").alias("version"), F.col("event_type").alias("title"), F.array(F.lit("a"), F.lit("b")).alias("authors"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("h"), F.col("event_id").cast("string"))).alias("content_sha256"),
        F.col("event_id").alias("seq"), *rest,
    )
    return upsert.upsert_papers(stored, batch).select(
        F.substring("arxiv_id", 2, 20).cast("long").alias("custkey"), "title", "version", "content_sha256"
    )


@CHECKS.query("""select chunk_id, arg_max(title, pos) as title, arg_max(n, pos)::int as chunk_index from (
      select 'k' || p_partkey as chunk_id, p_name as title, p_size as n, -1 as pos from part
      union all select 'k' || l_partkey, l_returnflag || l_linestatus, l_linenumber, l_orderkey * 10 + l_linenumber from lineitem) x group by chunk_id""")
def upserted_chunks(spark, sf_dir):
    """Latest row per key wins."""
    blank = F.lit("").alias
    stored = I.table(spark, sf_dir, "part").select(
        F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("chunk_id"), blank("doc_id"), blank("arxiv_id"),
        F.col("p_name").alias("title"), blank("section_title"), F.col("p_size").alias("chunk_index"), blank("text"),
    )
    batch = I.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("chunk_id"), F.lit("d").alias("doc_id"), blank("arxiv_id"),
        F.concat("l_returnflag", "l_linestatus").alias("title"), blank("section_title"), F.col("l_linenumber").alias("chunk_index"),
        blank("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return upsert.upsert_chunks(stored, batch).select("chunk_id", "title", "chunk_index")


@CHECKS.query("""select d.doc_id, sha256(d.text) as content_sha256 from documents d left join labels l on l.doc_id = d.doc_id
    where l.doc_id is null or l.quality = 0 or l.toxic = 1""")
def changed_documents(spark, sf_dir):
    """New, changed and forced documents; labelled ones are known, low quality ones with another hash."""
    documents = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = I.table(spark, sf_dir, "labels")
    sha = F.when(F.col("quality") == 0, F.lit("other")).otherwise(F.sha2("text", 256))
    known = documents.join(labels, "doc_id").select("doc_id", sha.alias("content_sha256"))
    return upsert.changed_content(documents, known, labels.filter("toxic = 1").select("doc_id")).select("doc_id", "content_sha256")

