"""Retrieval evaluation: what a suite of questions must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS
from citeloom.operators.relevance import haystack, irrelevance


def satisfies(ids: Column, tokens: Column) -> Column:
    """A hit has an allowed paper id and contains all tokens, ignoring case; empty lists allow everything."""
    text = F.lower(haystack("title", "section_title", "text"))
    return ((F.size(ids) == 0) | F.array_contains(ids, F.col("arxiv_id"))) & F.forall(
        tokens, lambda t: F.contains(text, F.lower(t))
    )


def retrieval_checks(cases: DataFrame, hits: DataFrame, threshold: float = DEFAULTS.relevance_threshold) -> DataFrame:
    """(query_id, n_sources, note) per case; an empty note means that retrieval passed.

    ``cases`` holds query_id, query, must_include_arxiv_ids, must_include_tokens and min_sources.
    """
    wanted = cases.select("query_id", "must_include_arxiv_ids", "must_include_tokens")
    found = hits.join(wanted, "query_id").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(satisfies(F.col("must_include_arxiv_ids"), F.col("must_include_tokens"))).alias("matched"),
    )
    judged = cases.join(found, "query_id", "left").join(irrelevance(cases, hits, threshold), "query_id")
    n = F.coalesce("n", F.lit(0)).cast("int")
    free = (F.size("must_include_arxiv_ids") == 0) & (F.size("must_include_tokens") == 0)
    few = F.concat(
        F.lit("sources="), n.cast("string"), F.lit(" < min_sources="), F.col("min_sources").cast("string")
    )
    note = F.concat_ws(
        "; ",
        F.when(n < F.col("min_sources"), few),
        F.when(F.col("is_irrelevant"), "retrieval deemed irrelevant"),
        F.when(~(free | F.coalesce("matched", F.lit(False))), "no chunk matched must_include constraints"),
    )
    return judged.select("query_id", n.alias("n_sources"), note.alias("note"))


def pass_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("note") == "").alias("passed"), F.count(F.lit(1)).alias("cases"))
