"""Chunking, keyword search, vector search and hybrid retrieval."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from citeloom.checks import Registry, inputs as I
from citeloom.config import DEFAULTS
from citeloom.operators import hybrid, lexical, probes, relevance, vector
from citeloom.operators.relevance import entity_tokens, rare_terms

CHECKS = Registry()


@CHECKS.query(
    I.with_sql(**I.CHUNK_CTES)
    + "select chunk_id, doc_id, arxiv_id, title, section_title, chunk_index, text, char_start, char_end from chunks"
)
def chunk_documents(spark, sf_dir):
    """Sections to overlapping windows with a running index."""
    return I.chunk_table(spark, sf_dir)


@CHECKS.query(
    I.with_sql(**I.CHUNK_CTES, tokens=I.TOKENS_SQL, postings=I.POSTINGS_SQL)
    + "select term, count(*) as df, cast(sum(tf) as bigint) as cf from postings group by term"
)
def index_statistics(spark, sf_dir):
    """Index with term and document frequencies."""
    return lexical.term_statistics(lexical.forward_index(I.chunk_table(spark, sf_dir)))


@CHECKS.query(I.with_sql(**I.CHUNK_CTES, tokens=I.TOKENS_SQL, stats=I.STATS_SQL) + "select * from stats")
def index_totals(spark, sf_dir):
    return lexical.corpus_statistics(lexical.forward_index(I.chunk_table(spark, sf_dir)))


@CHECKS.query(I.with_sql(queries=I.QUERIES_SQL, qterms=I.QTERMS_SQL) + "select query_id, prefix, repeats from qterms")
def query_terms(spark, sf_dir):
    """C11: ASCII tokens of every query as prefix terms."""
    return lexical.query_terms(I.benchmark_queries(spark, sf_dir))


@CHECKS.query(
    I.with_sql(**I.CHUNK_CTES, queries=I.QUERIES_SQL, **I.LEXICAL_CTES)
    + "select query_id, chunk_id, round(score, 6) as score, rank from keyword_ranked where rank <= 12"
)
def keyword_search(spark, sf_dir):
    """BM25 top-k with prefix terms."""
    corpus = I.corpus(spark, sf_dir)
    hits = lexical.keyword_search(corpus.index, corpus.statistics, I.benchmark_queries(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@CHECKS.query(
    I.with_sql(**I.CHUNK_CTES, queries=I.QUERIES_SQL, **I.LEXICAL_CTES)
    + "select query_id, chunk_id, round(score, 6) as score, rank from keyword_ranked where rank <= 12"
)
def keyword_search_inverted(spark, sf_dir):
    """The same search in the least slices of queries, the way for query batches of any size."""
    corpus = I.corpus(spark, sf_dir)
    shuffled = replace(DEFAULTS, max_broadcast_bytes=0, rows_per_salt=500)
    hits = lexical.keyword_search(corpus.index, corpus.statistics, I.benchmark_queries(spark, sf_dir), settings=shuffled)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@CHECKS.query(
    I.with_sql(queries=I.QUERIES_SQL, vector_ranked=I.VECTOR_RANKED_SQL)
    + "select query_id, chunk_id, round(score, 6) as score, rank from vector_ranked where rank <= 12"
)
def vector_search(spark, sf_dir):
    """Exact cosine top-k."""
    hits = vector.nearest(I.benchmark_queries(spark, sf_dir), I.vector_table(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@CHECKS.query(
    I.with_sql(queries=I.QUERIES_SQL, vector_ranked=I.VECTOR_RANKED_SQL)
    + "select count(*) as n_hits, count(distinct query_id) as n_queries, true as recall_reached from vector_ranked where rank <= 12"
)
def vector_search_probed(spark, sf_dir):
    """E12, K4, H4 by probed cells: how many of the exact top 12 of every query are found, and whether 0.9 of them are."""
    queries, vectors = I.benchmark_queries(spark, sf_dir), I.vector_table(spark, sf_dir)
    exact = vector.nearest(queries, vectors).select("query_id", "chunk_id")
    probed = probes.nearest_probed(queries, probes.build_index(vectors)).select("query_id", "chunk_id", F.lit(1).alias("found"))
    both = exact.join(probed, ["query_id", "chunk_id"], "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_hits"), F.countDistinct("query_id").alias("n_queries"),
        (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
    )


@CHECKS.query(
    "select e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(f.embedding as double[])), 6) as similarity"
    " from embeddings e join embeddings f on f.vec_id = e.label"
)
def cosine_to_label_anchor(spark, sf_dir):
    """K3 as a column expression: every vector against the vector numbered like its label."""
    vectors = I.table(spark, sf_dir, "embeddings")
    anchors = vectors.select(F.col("vec_id").alias("label"), F.col("embedding").alias("anchor"))
    return vectors.join(anchors, "label").select(
        "vec_id", F.round(vector.cosine("embedding", "anchor"), 6).alias("similarity")
    )


_HIT_SQL = """select query_id, rank, chunk_id, doc_id, arxiv_id, section_title, round(fused_score, 6) as fused_score,
  round(vscore, 6) as vector_score, round(kscore, 6) as keyword_score,
  concat_ws(',', case when krank is not null then 'keyword' end, case when vrank is not null then 'vector' end) as sources
  from ranked where rank <= {k}"""


def _hit_columns(hits):
    return hits.select(
        "query_id", "rank", "chunk_id", "doc_id", "arxiv_id", "section_title", F.round("fused_score", 6).alias("fused_score"),
        F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"),
        F.array_join("sources", ",").alias("sources"),
    )


@CHECKS.query(I.with_sql(**I.hybrid_ctes(12, 0.0, 4)) + _HIT_SQL.format(k=8))
def hybrid_search(spark, sf_dir):
    """K10 with E9-E11, G1, G2, G4, H6, K5, K9: the flagship retrieval over all queries."""
    return _hit_columns(hybrid.retrieve(I.corpus(spark, sf_dir), I.benchmark_queries(spark, sf_dir)).hits)


@CHECKS.query(I.with_sql(**I.hybrid_ctes(12, 0.05, 2)) + _HIT_SQL.format(k=8))
def hybrid_search_section_boost(spark, sf_dir):
    """Methods and results sections first, at most two chunks per document."""
    found = hybrid.retrieve(
        I.corpus(spark, sf_dir), I.benchmark_queries(spark, sf_dir), section_boost=0.05, max_per_doc=2
    )
    return _hit_columns(found.hits)


@CHECKS.query(
    I.with_sql(**I.CHUNK_CTES, queries=I.QUERIES_SQL, **I.LEXICAL_CTES, vector_ranked=I.VECTOR_RANKED_SQL,
               fused=I.FUSED_SQL.format(k=12))
    + """select query_id, chunk_id, vrank as vector_rank, krank as keyword_rank,
      round(coalesce(1.0::double / (60 + vrank), 0) + coalesce(1.0::double / (60 + krank), 0), 9) as rrf from fused"""
)
def rank_fusion(spark, sf_dir):
    """Outer merge of both hit lists."""
    corpus, queries = I.corpus(spark, sf_dir), I.benchmark_queries(spark, sf_dir)
    fused = hybrid.fuse_ranks(
        vector.nearest(queries, corpus.vectors), lexical.keyword_search(corpus.index, corpus.statistics, queries)
    )
    rrf = hybrid.reciprocal_rank(F.col("vector_rank")) + hybrid.reciprocal_rank(F.col("keyword_rank"))
    return fused.select("query_id", "chunk_id", "vector_rank", "keyword_rank", F.round(rrf, 9).alias("rrf"))


_COMMON = str(list(relevance.COMMON_QUERY_TERMS))
RARE_SQL = (
    "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: not list_contains(" + _COMMON + ", x)"
    " and (length(x) >= 5 or regexp_matches(x, '[0-9]')))"
)
ENTITY_SQL = (
    "list_filter(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: length(x) >= 5 or regexp_matches(x, '[0-9]')"
    " or (regexp_matches(x, '[A-Z]') and regexp_matches(x, '[a-z]')) or lower(x) in ('loftr', 'superglue'))"
)
IRRELEVANT_SQL = f"""select q.query_id, case when h.overlap is null then true
    when len({RARE_SQL.format('q.query')}) = 0 then false
    else not h.overlap and coalesce(h.best, -1) < 0.45 end as is_irrelevant
  from queries q left join (select query_id, bool_or(len(list_filter({RARE_SQL.format('query')},
      lambda w: contains(lower(title || chr(10) || text), w))) > 0) as overlap, max(vscore) as best
    from shortlist join queries using (query_id) group by query_id) h using (query_id)"""


@CHECKS.query(
    I.with_sql(**I.hybrid_ctes(12, 0.0, 4), shortlist="select * from ranked where rank <= 8") + IRRELEVANT_SQL
)
def relevance_verdicts(spark, sf_dir):
    """Which queries the corpus cannot answer."""
    return hybrid.retrieve(I.corpus(spark, sf_dir), I.benchmark_queries(spark, sf_dir)).verdicts


_DISTINCT_IN_ORDER = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@CHECKS.query(
    f"""select conv_id, turn, array_to_string({_DISTINCT_IN_ORDER.format('rare')}, ' ') as rare_terms,
      array_to_string({_DISTINCT_IN_ORDER.format('entities')}, ' ') as entity_tokens
    from (select conv_id, turn, {RARE_SQL.format('text')} as rare,
      list_transform({ENTITY_SQL.format('text')}, lambda x: lower(x)) as entities from conversations) t"""
)
def query_term_classes(spark, sf_dir):
    """Rare terms and entity-like tokens of every turn."""
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(rare_terms("text"), " ").alias("rare_terms"),
        F.array_join(entity_tokens("text"), " ").alias("entity_tokens"),
    )


_ANSWER_SQL = """select query_id, row_number() over (partition by query_id order by rank) as rank, chunk_id, arxiv_id,
    section_title, round(fused_score, 6) as fused_score from (
      select *, row_number() over (partition by query_id order by pos2) as rank from (
        select *, row_number() over (partition by query_id, arxiv_id order by pos2) as nth from (
          select *, position as pos2 from ranked where rank <= 12) a) b where nth <= 3) c
    join queries using (query_id)
    where {filter}"""
_NAMED = f"""len({ENTITY_SQL.format('query')}) = 0 or len(list_filter({ENTITY_SQL.format('query')}, lambda x: regexp_matches(
    title || chr(10) || section_title || chr(10) || text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || x || '($|[^\\p{{L}}\\p{{N}}_])'))) > 0"""


def answer_requests(spark, sf_dir):
    return I.benchmark_queries(spark, sf_dir).select(
        "query_id", "query", "vector", F.lit(10).alias("k"), F.lit(3).alias("max_per_doc"), F.lit(0.04).alias("section_boost")
    )


@CHECKS.query(
    I.with_sql(**I.hybrid_ctes(24, 0.04, 0), named=_ANSWER_SQL.format(filter=_NAMED)) + "select * from named where rank <= 10"
)
def answer_sources(spark, sf_dir):
    """Sources for answering, filtered by the names in the question."""
    sources, _ = hybrid.retrieve_for_answer(I.corpus(spark, sf_dir), answer_requests(spark, sf_dir))
    return sources.select(
        "query_id", "rank", "chunk_id", "arxiv_id", "section_title", F.round("fused_score", 6).alias("fused_score")
    )


@CHECKS.query(
    I.with_sql(**I.hybrid_ctes(24, 0.04, 0), named=_ANSWER_SQL.format(filter="true")) + "select * from named where rank <= 3"
)
def maybe_relevant_sources(spark, sf_dir):
    """The first three merged hits, before the name filter."""
    _, maybe = hybrid.retrieve_for_answer(I.corpus(spark, sf_dir), answer_requests(spark, sf_dir))
    return maybe.select(
        "query_id", "rank", "chunk_id", "arxiv_id", "section_title", F.round("fused_score", 6).alias("fused_score")
    )


@CHECKS.query(
    I.with_sql(**I.hybrid_ctes(12, 0.0, 4))
    + """select query_id, rank, concat('arXiv:', arxiv_id, ' §', section_title) as citation,
      concat_ws(', ', case when krank is not null then 'keyword' end, case when vrank is not null then 'vector' end) as sources,
      replace(substr(text, 1, 140), chr(10), ' ') as preview from ranked where rank <= 8"""
)
def citation_list(spark, sf_dir):
    """Hits as shown to a reader."""
    found = hybrid.retrieve(I.corpus(spark, sf_dir), I.benchmark_queries(spark, sf_dir))
    return hybrid.citation_table(found.hits)
