"""Hybrid retrieval: rank fusion of vector and keyword hits, boosts, quotas and the relevance guard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS, Settings
from citeloom.functions.ids import citation_label
from citeloom.functions.scoring import DEFAULT_TIER, PROVENANCE_BOOSTS, TIER_BOOSTS, by_value, in_priority_section
from citeloom.functions.text import blank_to_null, preview
from citeloom.operators.chunk_store import cut_again, with_payload
from citeloom.operators.lexical import keyword_search
from citeloom.operators.ordered import measured_broadcast
from citeloom.operators.relevance import filter_by_entities, irrelevance
from citeloom.operators.vector import nearest
from citeloom.session import materialize

PAYLOAD = ["doc_id", "arxiv_id", "title", "section_title", "text"]


@dataclass(frozen=True)
class Corpus:
    """The tables a retrieval job reads."""

    chunks: DataFrame       # CHUNKS, a table of chunk_store.store_chunks, or any frame if ``papers`` is given
    vectors: DataFrame      # chunk_id, embedding
    index: DataFrame        # of lexical.forward_index
    statistics: DataFrame   # one row: n_chunks, total_tokens
    tiers: DataFrame | None = None        # arxiv_id, tier
    provenance: DataFrame | None = None   # doc_id, provenance_kind
    papers: DataFrame | None = None       # documents as chunk_sections takes them: hits are cut from them again, chunks need not be stored


@dataclass(frozen=True)
class Retrieval:
    hits: DataFrame       # ranked hits of the queries that have any
    verdicts: DataFrame   # query_id, is_irrelevant for all queries


def fuse_ranks(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Outer merge of two hit lists in one aggregation: ranks and scores of either list per (query, chunk)."""
    tagged = vector_hits.select("query_id", "chunk_id", "score", "rank", F.lit("vector").alias("source")).unionByName(
        keyword_hits.select("query_id", "chunk_id", "score", "rank", F.lit("keyword").alias("source"))
    )
    usable = tagged.filter(F.coalesce(F.col("chunk_id"), F.lit("")) != "")

    def of(source: str, field: str) -> Column:
        return F.min(F.when(F.col("source") == source, F.col(field)))

    return usable.groupBy("query_id", "chunk_id").agg(
        of("vector", "rank").alias("vector_rank"), of("vector", "score").alias("vector_score"),
        of("keyword", "rank").alias("keyword_rank"), of("keyword", "score").alias("keyword_score"),
    )


def reciprocal_rank(rank: Column, rrf_k: int = DEFAULTS.rrf_k) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + rank), F.lit(0.0))


def candidates(corpus: Corpus, queries: DataFrame, vector_k: int, keyword_k: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Fused hits with payload, tier and provenance.

    The hit list has at most (vector_k + keyword_k) rows per query. It is written once and measured; the chunks that it names are
    read from their buckets or cut again from their documents. Later passes (boosts, quotas, guard, routing) start from a table of known small size.
    """
    fused = fuse_ranks(
        nearest(queries, corpus.vectors, vector_k, settings.max_broadcast_bytes),
        keyword_search(corpus.index, corpus.statistics, queries, keyword_k, settings),
    )
    fused = materialize(fused, "fused")
    if corpus.papers is None:
        found = with_payload(corpus.chunks, fused, PAYLOAD, settings)
    else:
        found = cut_again(corpus.papers, fused, PAYLOAD, settings)
    found = materialize(found, "hits")
    found = _attach(found, corpus.tiers, "arxiv_id", "tier", "int", settings)
    return _attach(found, corpus.provenance, "doc_id", "provenance_kind", "string", settings)


def _attach(hits: DataFrame, table: DataFrame | None, key: str, value: str, value_type: str, settings: Settings) -> DataFrame:
    """Left lookup in a table that may be far larger than the hits: the hit keys select its rows first. A key with
    several rows gives its least value, so hits never multiply and the looked-up side has at most one row per hit."""
    if table is None:
        return hits.withColumn(value, F.lit(None).cast(value_type))
    keys = measured_broadcast(hits.select(key).distinct(), settings.max_broadcast_bytes)
    needed = table.select(key, value).join(keys, key, "left_semi").groupBy(key).agg(F.min(value).alias(value))
    return hits.join(needed, key, "left")


def doc_key() -> Column:
    return F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.col("arxiv_id"))


def apply_doc_quota(hits: DataFrame, max_per_doc: Column, doc: Column, order: str = "position") -> DataFrame:
    """At most ``max_per_doc`` hits per query and document in list order; zero or less means no quota."""
    nth = F.row_number().over(W.partitionBy("query_id", doc).orderBy(order))
    return hits.withColumn("__nth", nth).filter((max_per_doc <= 0) | (F.col("__nth") <= max_per_doc)).drop("__nth")


def dedupe_ranked(hits: DataFrame, order: str = "position") -> DataFrame:
    """First hit per query, document, section (case-folded) and chunk."""
    section = F.lower(F.coalesce(blank_to_null("section_title"), F.lit("")))
    nth = F.row_number().over(W.partitionBy("query_id", doc_key(), section, "chunk_id").orderBy(order))
    return hits.withColumn("__nth", nth).filter(F.col("__nth") == 1).drop("__nth")


def rank_candidates(found: DataFrame, limits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Score, boost, order and cut fused candidates.

    ``limits`` holds per query: vector_k, keyword_k, top_k, max_per_doc, section_boost.
    """
    rows = found.join(limits, "query_id")
    vector_rank = F.when(F.col("vector_rank") <= F.col("vector_k"), F.col("vector_rank"))
    keyword_rank = F.when(F.col("keyword_rank") <= F.col("keyword_k"), F.col("keyword_rank"))
    rows = rows.withColumns({"vector_rank": vector_rank, "keyword_rank": keyword_rank}).filter(
        F.col("vector_rank").isNotNull() | F.col("keyword_rank").isNotNull()
    )
    boost = F.when(
        (F.col("section_boost") > 0) & in_priority_section("title", "section_title"), F.col("section_boost")
    ).otherwise(F.lit(0.0))
    tier = by_value(F.coalesce("tier", F.lit(DEFAULT_TIER)), TIER_BOOSTS, 0.0)
    source = by_value("provenance_kind", PROVENANCE_BOOSTS, 0.0)
    rrf = reciprocal_rank(F.col("vector_rank"), settings.rrf_k) + reciprocal_rank(F.col("keyword_rank"), settings.rrf_k)
    in_list = W.partitionBy("query_id").orderBy(
        F.desc("fused_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank")
    )
    scored = rows.withColumns(
        {
            "fused_score": rrf + boost + tier + source,
            "vector_score": F.when(F.col("vector_rank").isNotNull(), F.col("vector_score")),
            "keyword_score": F.when(F.col("keyword_rank").isNotNull(), F.col("keyword_score")),
            "sources": F.filter(
                F.array(
                    F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("vector_rank").isNotNull(), "vector")
                ),
                lambda s: s.isNotNull(),
            ),
        }
    ).withColumn("position", F.row_number().over(in_list))
    kept = apply_doc_quota(dedupe_ranked(scored), F.col("max_per_doc"), doc_key())
    return (
        kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("position")))
        .drop("position", "vector_k", "keyword_k", "max_per_doc", "section_boost")
    )


def uniform_limits(queries: DataFrame, vector_k: int, keyword_k: int, top_k: int, max_per_doc: int, section_boost: float):
    return queries.select(
        "query_id", F.lit(vector_k).alias("vector_k"), F.lit(keyword_k).alias("keyword_k"), F.lit(top_k).alias("top_k"),
        F.lit(max_per_doc).alias("max_per_doc"), F.lit(float(section_boost)).alias("section_boost"),
    )


def retrieve(
    corpus: Corpus,
    queries: DataFrame,
    *,
    top_k: int | None = None,
    vector_k: int | None = None,
    keyword_k: int | None = None,
    max_per_doc: int | None = None,
    section_boost: float = 0.0,
    require_relevance: bool = False,
    settings: Settings = DEFAULTS,
) -> Retrieval:
    """Hybrid search for a table of queries (query_id, query, vector).

    With ``require_relevance`` an irrelevant query keeps its verdict row but loses its hits.
    """
    top_k = settings.top_k if top_k is None else top_k
    vector_k = settings.vector_k if vector_k is None else vector_k
    keyword_k = settings.keyword_k if keyword_k is None else keyword_k
    max_per_doc = settings.max_per_doc if max_per_doc is None else max_per_doc
    found = candidates(corpus, queries, vector_k, keyword_k, settings)
    limits = uniform_limits(queries, vector_k, keyword_k, top_k, max_per_doc, section_boost)
    ranked = rank_candidates(found, limits, settings)
    shortlist = ranked.filter(F.col("rank") <= F.greatest(F.col("top_k"), F.lit(3)))
    verdicts = irrelevance(queries, shortlist, settings.relevance_threshold)
    hits = ranked.filter(F.col("rank") <= F.col("top_k")).drop("top_k")
    if require_relevance:
        hits = hits.join(verdicts.filter(~F.col("is_irrelevant")).select("query_id"), "query_id", "left_semi")
    return Retrieval(hits, verdicts)


def merge_hits(hits: DataFrame, max_per_doc: Column) -> DataFrame:
    """Merge repeated hits of a query, order by fused score and apply the quota per paper.

    Fused scores add up, the vector score keeps its maximum and the keyword score its minimum, because
    BM25 is negative. ``position`` orders the input; the merged list is ranked anew.
    """
    section = F.lower(F.coalesce(blank_to_null("section_title"), F.lit("")))
    merged = hits.groupBy("query_id", "arxiv_id", section.alias("__section"), "chunk_id").agg(
        F.min_by("title", "position").alias("title"),
        F.min_by("section_title", "position").alias("section_title"),
        F.min_by("text", "position").alias("text"),
        F.sum("fused_score").alias("fused_score"),
        F.max("vector_score").alias("vector_score"),
        F.min("keyword_score").alias("keyword_score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.min("position").alias("__first"),
        F.first(max_per_doc).alias("__quota"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("fused_score"), F.asc("__first"))
    placed = merged.withColumn("position", F.row_number().over(order))
    kept = apply_doc_quota(placed, F.col("__quota"), F.col("arxiv_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("position"))
    return kept.withColumn("rank", rank).drop("position", "__first", "__section", "__quota")


def answer_limits(requests: DataFrame) -> DataFrame:
    """Branch sizes of an answer retrieval from its k: top max(k, 12), branches max(2 * top, 24), no quota."""
    top = F.greatest(F.col("k"), F.lit(12))
    branch = F.greatest(top * 2, F.lit(24))
    return requests.select(
        "query_id", branch.alias("vector_k"), branch.alias("keyword_k"), top.alias("top_k"),
        F.lit(0).alias("max_per_doc"), F.col("section_boost").cast("double").alias("section_boost"),
    )


def retrieve_for_answer(
    corpus: Corpus, requests: DataFrame, settings: Settings = DEFAULTS, found: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sources for answering: (sources, maybe_relevant).

    ``requests`` holds query_id, query, vector, k, max_per_doc and section_boost per question. ``found``
    lets a second pass over the same questions reuse the candidates of the first.
    """
    limits = answer_limits(requests)
    if found is None:
        found = answer_candidates(corpus, requests, settings)
    ranked = rank_candidates(found, limits, settings).filter(F.col("rank") <= F.col("top_k")).drop("top_k")
    quotas = requests.select("query_id", "k", F.col("max_per_doc").alias("quota"))
    merged = merge_hits(ranked.withColumnRenamed("rank", "position").join(quotas, "query_id"), F.col("quota"))
    maybe_relevant = merged.filter(F.col("rank") <= 3)
    named = filter_by_entities(merged, requests)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    sources = (
        named.withColumn("rank", rank).join(quotas.select("query_id", "k"), "query_id")
        .filter(F.col("rank") <= F.col("k")).drop("k")
    )
    return sources, maybe_relevant


def answer_candidates(corpus: Corpus, requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    widest = answer_limits(requests).agg(F.max("vector_k")).first()[0] or 24
    return candidates(corpus, requests, widest, widest, settings)


def citation_table(hits: DataFrame) -> DataFrame:
    """Hits as shown to a reader: rank, citation, sources and a preview."""
    return hits.select(
        "query_id", "rank", citation_label("arxiv_id", "section_title").alias("citation"),
        F.array_join(F.array_sort("sources"), ", ").alias("sources"), preview("text").alias("preview"),
    )
