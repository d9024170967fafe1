"""Routing, grounding, prompts and evaluation over tables of questions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.checks import Registry, inputs as I
from citeloom.checks.retrieval import ENTITY_SQL, RARE_SQL
from citeloom.checks.scalars import ANSWER_TEXT
from citeloom.operators import evaluation, ground, hybrid, prompts, route
from citeloom.plans import answering
from citeloom.session import materialize

CHECKS = Registry()

# Benchmark passages as questions with cues in front, the same text in both engines.
QUESTION = (
    "concat(case item_id % 7 when 0 then 'Compare A1 vs B2 ' when 1 then 'How to implement ' when 2 then 'Report ablation results '"
    " when 3 then 'Which method should i use ' when 4 then 'What are the options ' else 'Explain ' end, text)"
)


def questions(spark, sf_dir):
    vectors = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return I.table(spark, sf_dir, "benchmark").join(vectors, "item_id").select(
        F.col("item_id").alias("query_id"), F.expr(QUESTION).alias("query"), "vector"
    )


QUESTIONS_SQL = f"""select item_id as query_id, {QUESTION} as query, cast(embedding as double[]) as vector
    from benchmark join embeddings on item_id = vec_id"""

# Line items as hit lists: an order is a question, a supplier a paper, the line number the rank.
HITS_SQL = """select l_orderkey as query_id, 's' || l_suppkey % 4 as arxiv_id, l_linenumber as rank, l_returnflag as section_title,
    round(l_quantity / 50, 2) as fused_score, 'c' || l_partkey || '-' || l_linenumber as chunk_id, l_linestatus as status from lineitem"""
ASKED_SQL = "select o_orderkey as query_id, case o_custkey % 5 when 0 then 'a versus b' when 1 then 'options' when 2 then 'recommend one' when 3 then 'plain' else 'benchmark' end as query from orders"


def order_hits(spark, sf_dir):
    return I.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("arxiv_id"),
        F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("section_title"),
        F.round(F.col("l_quantity") / 50, 2).alias("fused_score"), F.lit("T").alias("title"), F.col("l_linestatus").alias("text"),
        F.concat_ws("-", F.concat(F.lit("c"), F.col("l_partkey").cast("string")), "l_linenumber").alias("chunk_id"),
    )


def order_questions(spark, sf_dir):
    cust = F.col("o_custkey") % 5
    query = (
        F.when(cust == 0, "a versus b").when(cust == 1, "options").when(cust == 2, "recommend one").when(cust == 3, "plain")
        .otherwise("benchmark")
    )
    return I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), query.alias("query"))


# Several lines may share a line number, so ranks are made unique first.
LIST_CTES = {
    "raw": HITS_SQL,
    "hits": "select * replace (row_number() over (partition by query_id order by rank, chunk_id, arxiv_id, section_title, status) as rank) from raw",
    "asked": ASKED_SQL,
}


def ranked_hits(spark, sf_dir):
    rows = order_hits(spark, sf_dir).withColumnRenamed("rank", "line")
    order = [F.asc("line"), F.asc("chunk_id"), F.asc("arxiv_id"), F.asc("section_title"), F.asc("text")]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).drop("line")


@CHECKS.query(I.with_sql(**LIST_CTES) + """, docs as (select query_id, arxiv_id, max(fused_score) as best, count(*) as count from hits group by 1, 2),
    placed as (select *, row_number() over (partition by query_id order by best desc, count desc, arxiv_id) as position from docs),
    secs as (select query_id, arxiv_id, section_title, row_number() over (partition by query_id, arxiv_id order by count(*) desc, min(rank)) as p
      from hits group by 1, 2, 3)
    select query_id, position, arxiv_id, round(best, 6) as best_score, count,
      (select string_agg(section_title, ',' order by p) from secs s where s.query_id = d.query_id and s.arxiv_id = d.arxiv_id and p <= 3) as sections
    from placed d where position <= 6""")
def source_summaries(spark, sf_dir):
    """F10."""
    return route.summarize_sources(ranked_hits(spark, sf_dir)).select(
        "query_id", "position", "arxiv_id", "best_score", "count", F.array_join("top_sections", ",").alias("sections")
    )


FEATURE_CTES = {
    "per_doc": "select query_id, arxiv_id, count(*) as n from hits group by 1, 2",
    "features": """select query_id, max(n) / sum(n) as top1, list_sum(list_slice(list_sort(list(n), 'DESC'), 1, 2)) / sum(n) as top2, count(*) as docs,
        -sum(n / t * log2(n / t)) as entropy, list_sort(list(n), 'DESC') as counts
      from (select *, sum(n) over (partition by query_id) as t from per_doc) x group by query_id""",
    "spread": """select a.query_id, a.query, coalesce(top1, 0) as top1, coalesce(top2, 0) as top2, coalesce(docs, 0) as docs,
        coalesce(entropy, 0) as entropy, counts from asked a left join features f using (query_id)""",
}


@CHECKS.query(I.with_sql(**LIST_CTES, **FEATURE_CTES) + """select query_id, round(top1, 6) as top1_share, round(top2, 6) as top2_share,
    docs::int as num_docs, round(entropy, 6) as entropy, coalesce(array_to_string(counts, ','), '') as doc_counts from spread""")
def hit_distributions(spark, sf_dir):
    """how hits spread over papers, also for questions without hits."""
    features = route.distribution_features(order_questions(spark, sf_dir), ranked_hits(spark, sf_dir))
    return features.select(
        "query_id", F.round("top1_share", 6).alias("top1_share"), F.round("top2_share", 6).alias("top2_share"), "num_docs",
        F.round(F.abs("entropy"), 6).alias("entropy"), F.array_join(F.col("doc_counts").cast("array<string>"), ",").alias("doc_counts"),
    )


_MODE_SQL = {
    "k": "case mode when 'explain' then 8 when 'implement' then 10 when 'evidence' then 10 else 12 end",
    "q": "case mode when 'explain' then 6 when 'survey' then 3 when 'decision' then 3 else 4 end",
    "b": "case mode when 'explain' then 0.03 when 'compare' then 0.05 when 'survey' then 0.04 when 'decision' then 0.06 else 0.09 end",
}
ROUTE_CTES = {
    **FEATURE_CTES,
    "ruled": """select *, case when query like '%versus%' then 'compare' when query = 'benchmark' then 'evidence' when query like 'recommend%' then 'decision'
          when query = 'options' then 'survey' when docs >= 4 then 'survey' else 'explain' end as m0,
        case when query like '%versus%' then 0.98 when query = 'benchmark' then 0.92 when query like 'recommend%' then 0.9 when query = 'options' then 0.9
          when docs >= 4 then 0.62 else 0.86 end as c0,
        case when query like '%versus%' then 'cue_compare' when query = 'benchmark' then 'cue_evidence' when query like 'recommend%' then 'cue_decision'
          when query = 'options' then 'cue_survey' when docs >= 4 then 'summary_broad' else 'default_explain' end as r0 from spread""",
    "judged": """select *, case when m0 = 'compare' and not (docs >= 2 and coalesce(counts[2], 0) >= 2) then 'compare_insufficient_coverage'
        when m0 = 'decision' and docs < 3 then 'decision_requires_three_docs'
        when m0 in ('survey', 'decision') and top1 >= 0.82 and docs >= 1 then 'dominant_single_doc'
        when m0 = 'explain' and docs >= 4 and top1 <= 0.5 and top2 <= 0.82 then 'broad_retrieval_distribution'
        when m0 = 'survey' and docs <= 1 then 'survey_insufficient_docs' when m0 = 'survey' and docs < 3 then 'survey_low_doc_coverage' end as r1 from ruled""",
    "routed": """select query_id, r0 || coalesce(',' || r1, '') as reasons, case r1 when 'compare_insufficient_coverage' then
          case when docs >= 3 and top1 <= 0.7 then 'survey' else 'explain' end when 'decision_requires_three_docs' then 'survey'
          when 'dominant_single_doc' then 'explain' when 'broad_retrieval_distribution' then 'survey' when 'survey_insufficient_docs' then 'explain'
          else m0 end as mode,
        case r1 when 'compare_insufficient_coverage' then greatest(0.55, c0 - 0.2) when 'decision_requires_three_docs' then greatest(0.6, c0 - 0.05)
          when 'dominant_single_doc' then greatest(0.8, c0) else c0 end as confidence, r1 from judged""",
}


@CHECKS.query(I.with_sql(**LIST_CTES, **ROUTE_CTES) + f"""select query_id, mode, reasons, round(confidence::double, 6) as confidence, {_MODE_SQL['k']} as k,
    {_MODE_SQL['q']} as max_per_doc, ({_MODE_SQL['b']})::double as section_boost_hint, mode = 'compare' as require_cross_doc,
    coalesce(r1 in ('compare_insufficient_coverage', 'decision_requires_three_docs', 'survey_insufficient_docs'), false) as has_preface from routed""")
def routed_questions(spark, sf_dir):
    """L1, L2, L3, L4: modes by rules, corrected by how the hits spread."""
    routed = route.route_questions(order_questions(spark, sf_dir), ranked_hits(spark, sf_dir), "rules")
    return routed.select(
        "query_id", "mode", F.array_join("reason_codes", ",").alias("reasons"), F.round("confidence", 6).alias("confidence"), "k",
        "max_per_doc", "section_boost_hint", "require_cross_doc", F.col("preface").isNotNull().alias("has_preface"),
    )


@CHECKS.query(f"""select item_id as query_id, case item_id % 7 when 0 then 'compare' when 1 then 'implement' when 2 then 'evidence' when 3 then 'decision'
      when 4 then 'survey' else 'explain' end as mode, case item_id % 7 when 0 then 'Compare A1' else '' end as first_target from benchmark""")
def cue_modes(spark, sf_dir):
    """C14, L1: cue words of every question."""
    asked = I.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(QUESTION).alias("query"))
    return asked.select("query_id", route.rule_route("query", F.lit(0)).alias("v")).select(
        "query_id", "v.mode", F.coalesce(F.get("v.targets", F.lit(0)), F.lit("")).alias("first_target")
    )


@CHECKS.query(I.with_sql(**LIST_CTES, **ROUTE_CTES) + f"""select query_id, case when o_custkey % 3 = 0 then (o_custkey % 10)::int else {_MODE_SQL['k']} end as k,
    case when o_custkey % 4 = 0 then 2 else {_MODE_SQL['q']} end as max_per_doc, greatest(0.05::double, ({_MODE_SQL['b']})::double) as section_boost
    from routed join orders on o_orderkey = query_id""")
def effective_parameters(spark, sf_dir):
    """Request values over route defaults."""
    orders = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.when(F.col("o_custkey") % 3 == 0, (F.col("o_custkey") % 10).cast("int")).alias("k"),
        F.when(F.col("o_custkey") % 4 == 0, 2).alias("max_per_doc"), F.lit(0.05).alias("section_boost"),
    )
    routed = route.route_questions(order_questions(spark, sf_dir), ranked_hits(spark, sf_dir), "rules")
    return route.effective_parameters(orders, routed).select("query_id", "k", "max_per_doc", "section_boost")


TOP2_SQL = """select query_id, arxiv_id, count(*) as n, row_number() over (partition by query_id order by max(fused_score) desc, min(rank)) as place
    from hits group by 1, 2 qualify place <= 2"""
SUPPORT_CTES = {
    "top2": TOP2_SQL,
    "pairs": """select query_id, max(case when place = 1 then arxiv_id end) as a1, max(case when place = 1 then n end) as n1,
      max(case when place = 2 then arxiv_id end) as a2, max(case when place = 2 then n end) as n2 from top2 group by 1""",
    "support": """select a.query_id, query like '%versus%' and not coalesce(n1 >= 2 and n2 >= 2, false) as refused,
      case when query not like '%versus%' and n1 >= 2 and n2 = 1 then a2 end as dropped, a1, n1, a2, n2 from asked a left join pairs p using (query_id)""",
}


@CHECKS.query(I.with_sql(**LIST_CTES) + ", top2 as (" + TOP2_SQL + ") select * from top2")
def top_two_papers(spark, sf_dir):
    """F13."""
    return ground.top_two_papers(ranked_hits(spark, sf_dir))


@CHECKS.query(I.with_sql(**LIST_CTES, **SUPPORT_CTES) + """select query_id, refused as should_refuse, dropped as dropped_paper,
    case when refused and a1 is not null then 'Current top-paper source counts: ' || a1 || ' (' || n1 || ')' || coalesce(', ' || a2 || ' (' || n2 || ')', '') end as detail
    from support""")
def cross_doc_verdicts(spark, sf_dir):
    """Which comparisons lack support and which lone second papers drop out."""
    _, verdicts = ground.cross_doc_support(order_questions(spark, sf_dir), ranked_hits(spark, sf_dir))
    return verdicts.select(
        "query_id", "should_refuse", "dropped_paper", F.get("warnings", F.lit(1)).alias("detail")
    )


@CHECKS.query(I.with_sql(**LIST_CTES, **SUPPORT_CTES) + """select h.query_id, h.chunk_id, h.rank from hits h join support s using (query_id)
    where s.dropped is null or s.dropped <> h.arxiv_id""")
def cross_doc_hits(spark, sf_dir):
    """The hits that stay."""
    kept, _ = ground.cross_doc_support(order_questions(spark, sf_dir), ranked_hits(spark, sf_dir))
    return kept.select("query_id", "chunk_id", "rank")


@CHECKS.query(I.with_sql(**LIST_CTES) + """, merged as (select query_id, arxiv_id, lower(section_title) as sec, 'x' || rank % 2 as c, sum(fused_score::decimal(10, 2))::double as s, min(rank) as r
      from hits group by all), placed as (select *, row_number() over (partition by query_id order by s desc, r) as p from merged),
    kept as (select *, row_number() over (partition by query_id, arxiv_id order by p) as nth from placed)
    select query_id, arxiv_id, sec as section, c as chunk_id, round(s, 6) as fused_score,
      row_number() over (partition by query_id order by p) as rank from kept where nth <= 2""")
def merged_hits(spark, sf_dir):
    """Repeated hits merged, two per paper."""
    hits = ranked_hits(spark, sf_dir).withColumns(
        {
            "chunk_id": F.concat(F.lit("x"), (F.col("rank") % 2).cast("string")), "position": F.col("rank"),
            "fused_score": F.col("fused_score").cast("decimal(10,2)"), "vector_score": F.lit(0.5), "keyword_score": F.lit(-1.0),
            "sources": F.array(F.lit("vector")),
        }
    )
    return hybrid.merge_hits(hits, F.lit(2)).select(
        "query_id", "arxiv_id", F.lower("section_title").alias("section"), "chunk_id",
        F.round(F.col("fused_score").cast("double"), 6).alias("fused_score"), "rank",
    )


CITED_SQL = rf"""with a as (select conv_id, turn, {ANSWER_TEXT} as t from conversations),
    ps as (select conv_id, turn, i, p[i] as par from (select conv_id, turn, list_filter(list_transform(string_split_regex(trim(t), '\n\s*\n+'),
      lambda x: trim(x)), lambda x: x <> '') as p from a) b, unnest(range(1, len(p) + 1)) u(i)),
    judged as (select conv_id, turn, i, case when len(regexp_extract_all(par, '\[S(\d+)\]')) = 0 then 'Paragraph ' || i || ' has no inline [S#] citation.'
      when len(list_filter(regexp_extract_all(par, '\[S(\d+)\]', 1), lambda r: r::int < 1 or r::int > 5)) > 0
        then 'Paragraph ' || i || ' cites a source outside S1..S5.' end as fault
      from ps where not regexp_matches(par, '(?i)^(answer|citations?|sources?)\s*:\s*$') and not regexp_matches(par, '^#{{1,6}}\s+\S'))
    select a.conv_id, a.turn, coalesce(min(r), case when count(i) = 0 then 'Answer has no content paragraphs.' else '' end) as reason
    from a left join (select *, arg_min(fault, i) over (partition by conv_id, turn) as r from judged) j using (conv_id, turn) group by 1, 2"""


@CHECKS.query(CITED_SQL)
def citation_checks(spark, sf_dir):
    """The first paragraph at fault of every turn."""
    turns = I.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(ANSWER_TEXT).alias("t"))
    return turns.select("conv_id", "turn", ground.citation_check("t", F.lit(5))["reason"].alias("reason"))


@CHECKS.query(I.with_sql(**LIST_CTES) + """select query_id, string_agg('[' || rank || '] arXiv:' || arxiv_id || ' §' || section_title || chr(10) || status
    || chr(10) || chr(10), '' order by rank) as sources from hits group by query_id""")
def source_listings(spark, sf_dir):
    """Numbered sources of every question."""
    return prompts.context_blocks(ranked_hits(spark, sf_dir)).select("query_id", "sources")


@CHECKS.query(I.with_sql(**LIST_CTES) + r"""select a.query_id, 'You are answering a computer vision research question using paper excerpts.' || chr(10) ||
      'Use only the provided context. If context is insufficient, say so.' || chr(10) ||
      'Cite claims with inline citations in this format: arXiv:ID §Section.' || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10)
      || string_agg('[' || rank || '] arXiv:' || arxiv_id || ' §' || section_title || chr(10) || 'body' || chr(10) || chr(10), '' order by rank) || 'Answer:' as prompt
    from asked a join hits h on h.query_id = a.query_id group by a.query_id, query""")
def query_prompts(spark, sf_dir):
    """The plain prompt of every question."""
    hits = ranked_hits(spark, sf_dir).withColumn("text", F.lit("body"))
    return prompts.query_prompts(order_questions(spark, sf_dir), hits).select("query_id", "prompt")


# --- composites on retrieval ----------------------------------------------------------------------------------

EVAL_CTES = {
    **I.hybrid_ctes(24, 0.0, 0), "queries": QUESTIONS_SQL,
    "merged": """select *, row_number() over (partition by query_id order by position) as rank2 from (
        select *, row_number() over (partition by query_id, arxiv_id order by position) as nth from positioned where position <= 12) a where nth <= 4""",
    "named": f"""select *, row_number() over (partition by query_id order by rank2) as r from (select * exclude (rank2), rank2 from merged join
        (select query_id, query from queries) q using (query_id)) m
      where len({ENTITY_SQL.format('query')}) = 0 or len(list_filter({ENTITY_SQL.format('query')}, lambda x: regexp_matches(
        title || chr(10) || section_title || chr(10) || text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || x || '($|[^\\p{{L}}\\p{{N}}_])'))) > 0""",
    "kept": "select * from named where r <= 8",
    "judged": f"""select q.query_id, count(k.chunk_id) as n, coalesce(bool_or(contains(lower(title || chr(10) || section_title || chr(10) || text), 'paper')
          and (q.query_id % 2 = 0 or k.arxiv_id = {I.paper_id('q.query_id')})), false) as matched,
        coalesce(bool_or(len(list_filter({RARE_SQL.format('q.query')}, lambda w: contains(lower(title || chr(10) || text), w))) > 0), false) as overlap,
        coalesce(max(vscore), -1) as best, len(any_value({RARE_SQL.format('q.query')})) as rare
      from queries q left join kept k on k.query_id = q.query_id group by q.query_id""",
}


def eval_cases(spark, sf_dir):
    own = F.expr(I.paper_id("query_id"))
    return questions(spark, sf_dir).select(
        "*", F.when(F.col("query_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(own)).alias("must_include_arxiv_ids"),
        F.array(F.lit("PAPER")).alias("must_include_tokens"), F.lit(6).alias("min_sources"),
    )


_EVALUATED_SQL = """select query_id, note = '' as passed, n::int as n_sources, note from (select query_id, n, concat_ws('; ',
    case when n < 6 then 'sources=' || n || ' < min_sources=6' end,
    case when n = 0 or (rare > 0 and not overlap and best < 0.45) then 'retrieval deemed irrelevant' end,
    case when not matched then 'no chunk matched must_include constraints' end) as note from judged) x"""


@CHECKS.query(I.with_sql(**EVAL_CTES) + _EVALUATED_SQL)
def evaluated_cases(spark, sf_dir):
    """Retrieval checks of an evaluation suite made of all questions."""
    return answering.evaluate(I.corpus(spark, sf_dir), eval_cases(spark, sf_dir))


@CHECKS.query(I.with_sql(**EVAL_CTES) + f"select count(*) filter (passed) as passed, count(*) as cases from ({_EVALUATED_SQL}) e")
def evaluation_totals(spark, sf_dir):
    """F16: how many cases of the suite passed."""
    return evaluation.pass_counts(answering.evaluate(I.corpus(spark, sf_dir), eval_cases(spark, sf_dir)))


def citing_stub(prompt, **_):
    """Stands in for a model: cites well, except that every other draft forgets to."""
    if "Draft to rewrite" in prompt or len(prompt) % 2 == 0:
        return "P1: a [S1].\n\nP2: b [S1]."
    return "P1: no citation."


@CHECKS.query()
def answered_questions(spark, sf_dir):
    """Outcomes with a stub model; every question gets a row."""
    requests = questions(spark, sf_dir).select(
        "*", F.lit("auto").alias("mode"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("max_per_doc"),
        F.lit(0.0).alias("section_boost"),
    )
    return answering.answer_questions(I.corpus(spark, sf_dir), requests, citing_stub).select(
        "query_id", "mode", "status", "error", "n_sources", "citation_valid"
    )


@CHECKS.query(I.with_sql(**I.CHUNK_CTES) + r"""select chunk_id, 64 as dimension,
    case when regexp_matches(strip_accents(lower(text)), '[\p{L}\p{N}]') then 1.0::double else 0.0::double end as norm from chunks""")
def embedded_chunks(spark, sf_dir):
    """M1: hashed embeddings of every chunk; squared lengths are one."""
    from citeloom.operators.models import embed

    chunks = materialize(I.chunk_table(spark, sf_dir), "chunks")
    squares = F.aggregate(F.col("v"), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return embed(chunks, "text", "v").select("chunk_id", F.size("v").alias("dimension"), F.round(squares, 5).alias("norm"))


