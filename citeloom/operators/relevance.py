"""Query-term tests on retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS
from citeloom.functions.text import ColumnLike, col

# Words that never make a query specific, and names that always do.
COMMON_QUERY_TERMS = (
    "about", "against", "between", "compare", "difference", "differences", "does", "each", "explain", "fails",
    "from", "idea", "into", "key", "method", "objective", "paper", "show", "shows", "summarize", "their", "them",
    "these", "this", "training", "when", "with",
)
ENTITY_NAMES = ("loftr", "superglue")
MIN_TOKEN_LENGTH = 5


def entity_tokens(question: ColumnLike) -> Column:
    """Lower-cased tokens that look like names: long, with a digit, in mixed case, or listed."""
    runs = F.regexp_extract_all(col(question), F.lit("[A-Za-z0-9]+"), F.lit(0))
    telling = F.filter(
        runs,
        lambda t: (F.length(t) >= MIN_TOKEN_LENGTH) | t.rlike("[0-9]") | (t.rlike("[A-Z]") & t.rlike("[a-z]"))
        | F.lower(t).isin(*ENTITY_NAMES),
    )
    return F.array_distinct(F.transform(telling, F.lower))


def rare_terms(query: ColumnLike) -> Column:
    runs = F.regexp_extract_all(F.lower(col(query)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(
        F.filter(
            runs,
            lambda t: ~t.isin(*COMMON_QUERY_TERMS) & ((F.length(t) >= MIN_TOKEN_LENGTH) | t.rlike("[0-9]")),
        )
    )


def haystack(*columns: ColumnLike) -> Column:
    return F.concat_ws("\n", *[F.coalesce(col(c), F.lit("")) for c in columns])


def names_any_entity(tokens: ColumnLike, text: Column) -> Column:
    """Some token occurs as a whole word; without tokens everything passes."""
    whole_word = F.exists(col(tokens), lambda t: F.rlike(text, F.concat(F.lit(r"(?iU)\b"), t, F.lit(r"\b"))))
    return (F.size(col(tokens)) == 0) | whole_word


def filter_by_entities(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Keep hits that name an entity of their query; nothing is filled in for what drops out."""
    tokens = queries.select("query_id", entity_tokens("query").alias("__tokens"))
    text = haystack("title", "section_title", "text")
    return hits.join(tokens, "query_id").filter(names_any_entity("__tokens", text)).drop("__tokens")


def irrelevance(queries: DataFrame, hits: DataFrame, threshold: float = DEFAULTS.relevance_threshold) -> DataFrame:
    """(query_id, is_irrelevant) for every query, also for those without hits.

    Irrelevant: no hits; or the query has rare terms, none occurs in a hit's title or text, and no vector
    score reaches the threshold.
    """
    asked = queries.select("query_id", rare_terms("query").alias("__rare"))
    text = F.lower(haystack("title", "text"))
    seen = (
        hits.select("query_id", "title", "text", "vector_score")
        .join(asked, "query_id")
        .select("query_id", F.exists("__rare", lambda t: F.contains(text, t)).alias("__overlap"), "vector_score")
        .groupBy("query_id")
        .agg(F.bool_or("__overlap").alias("__overlap"), F.max("vector_score").alias("__best"))
    )
    unsupported = ~F.col("__overlap") & (F.coalesce("__best", F.lit(-1.0)) < threshold)
    verdict = (
        F.when(F.col("__overlap").isNull(), True).when(F.size("__rare") == 0, False).otherwise(unsupported)
    )
    return asked.join(seen, "query_id", "left").select("query_id", verdict.alias("is_irrelevant"))
