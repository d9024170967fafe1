"""Grounding: cross-document support, citation checks and answer parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions.text import ColumnLike, col, strip
from citeloom.operators.route import COMPARE_CUE

# Citation mark, and paragraphs that need none.
CITATION = r"\[S(\d+)\]"
PREFACE = r"(?i)^(answer|citations?|sources?)\s*:\s*$"
HEADING = r"(?s)^#{1,6}\s+\S.*$"
NO_SUPPORT = (
    "Warning: need at least 2 sources from each of the top 2 papers (by score) for robust comparison grounding."
)


def paragraphs(text: ColumnLike) -> Column:
    parts = F.transform(F.split(strip(text), r"(?U)\n\s*\n+"), strip)
    return F.filter(parts, lambda p: p != "")


def citation_numbers(paragraph: ColumnLike) -> Column:
    return F.transform(F.regexp_extract_all(col(paragraph), F.lit(CITATION), F.lit(1)), lambda n: n.cast("long"))


def answer_parts(text: ColumnLike) -> Column:
    """ARRAY<STRUCT<type, value>>: text and citation parts in order, empty text left out."""
    between = F.split(col(text), r"\[S\d+\]")
    marks = F.regexp_extract_all(col(text), F.lit(CITATION), F.lit(1))

    def pair(part: Column, i: Column) -> Column:
        return F.array(
            F.when(part != "", F.struct(F.lit("text").alias("type"), part.alias("value"))),
            F.when(i < F.size(marks), F.struct(F.lit("citation").alias("type"), F.get(marks, i).cast("long").cast("string").alias("value"))),
        )

    return F.filter(F.flatten(F.transform(between, pair)), lambda p: p.isNotNull())


def citation_check(text: ColumnLike, source_count: ColumnLike) -> Column:
    """STRUCT<valid, reason>: every content paragraph cites, and only sources 1..n; first fault is reported."""
    n = col(source_count)

    def fault(paragraph: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        refs = citation_numbers(paragraph)
        return F.when(
            F.size(refs) == 0, F.concat(F.lit("Paragraph "), number, F.lit(" has no inline [S#] citation."))
        ).when(
            F.exists(refs, lambda r: (r < 1) | (r > n)),
            F.concat(F.lit("Paragraph "), number, F.lit(" cites a source outside S1..S"), n.cast("string"), F.lit(".")),
        )

    def is_content(paragraph: Column) -> Column:
        return ~paragraph.rlike(PREFACE) & ~paragraph.rlike(HEADING)

    parts = paragraphs(text)
    numbered = F.transform(parts, lambda p, i: F.struct(is_content(p).alias("content"), fault(p, i).alias("fault")))
    content = F.filter(numbered, lambda p: p["content"])
    faults = F.filter(content, lambda p: p["fault"].isNotNull())
    reason = (
        F.when(F.size(content) == 0, "Answer has no content paragraphs.")
        .when(F.size(faults) > 0, F.get(faults, F.lit(0))["fault"])
        .otherwise("")
    )
    return F.struct((reason == "").alias("valid"), reason.alias("reason"))


def top_two_papers(hits: DataFrame) -> DataFrame:
    """Per query the two papers with the best score and their number of hits (ties: first in the list)."""
    papers = hits.groupBy("query_id", "arxiv_id").agg(
        F.max("fused_score").alias("best"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("best"), F.asc("first")))
    return papers.withColumn("place", place).filter(F.col("place") <= 2).select("query_id", "place", "arxiv_id", "n")


def cross_doc_support(questions: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept hits, verdicts). A comparison needs two papers with two hits each, else it is refused; any other
    question loses a lone hit of the second paper when the first has two or more."""
    pair = top_two_papers(hits).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "arxiv_id", "n"))).alias("top")
    )
    judged = questions.select("query_id", F.col("query").rlike(COMPARE_CUE).alias("comparison")).join(pair, "query_id", "left")
    top = F.coalesce("top", F.array().cast("array<struct<place:int,arxiv_id:string,n:bigint>>"))
    supported = (F.size(top) >= 2) & F.forall(top, lambda t: t["n"] >= 2)
    details = F.concat(
        F.lit("Current top-paper source counts: "),
        F.array_join(F.transform(top, lambda t: F.concat(t["arxiv_id"], F.lit(" ("), t["n"].cast("string"), F.lit(")"))), ", "),
    )
    refused = F.col("comparison") & ~supported
    warnings = F.when(
        refused, F.filter(F.array(F.lit(NO_SUPPORT), F.when(F.size(top) > 0, details)), lambda w: w.isNotNull())
    ).otherwise(F.array().cast("array<string>"))
    lone = (
        ~F.col("comparison") & (F.size(top) >= 2) & (F.get(top, F.lit(0))["n"] >= 2) & (F.get(top, F.lit(1))["n"] == 1)
    )
    verdicts = judged.select(
        "query_id", refused.alias("should_refuse"), warnings.alias("warnings"),
        F.when(lone, F.get(top, F.lit(1))["arxiv_id"]).alias("dropped_paper"),
    )
    dropped = verdicts.filter(F.col("dropped_paper").isNotNull()).select("query_id", F.col("dropped_paper").alias("arxiv_id"))
    return hits.join(dropped, ["query_id", "arxiv_id"], "left_anti"), verdicts
