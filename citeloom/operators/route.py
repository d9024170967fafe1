"""Routing questions to an answer mode."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS, Settings
from citeloom.functions.text import ColumnLike, col, collapse_whitespace, section_or_untitled, strip
from citeloom.schemas import ROUTER_REPLY

# Cue patterns and, per mode, k, quota, cross-document need and section boost.
COMPARE_CUE = r"(?iU)\b(compare|comparison|versus|vs\.?|difference|different|better than|worse than)\b"
DECISION_CUE = (
    r"(?iU)\b(should i|which (?:approach|model|method)|what should i use|recommend|best choice|choose between)\b"
)
SURVEY_CUE = r"(?iU)\b(options?|methods?|approaches?|survey|landscape|alternatives?|what are .*options)\b"
IMPLEMENT_CUE = r"(?iU)\b(how to|implement|implementation|pipeline|steps?|pitfalls?|reproduce|training recipe)\b"
EVIDENCE_CUE = r"(?iU)\b(ablation|ablations|results?|report|reported|claims?|benchmark|metrics?|hpaches)\b"
TARGET = r"[A-Za-z0-9_.+\-/ ]{2,60}"
VERSUS_TARGETS = rf"(?iU)({TARGET}?)\s+(?:vs\.?|versus)\s+({TARGET})"
COMPARE_TARGETS = rf"(?iU)(?:compare|difference between)\s+({TARGET}?)\s+(?:and|with)\s+({TARGET})"
MODES = {
    "explain": (8, 6, False, 0.03),
    "compare": (12, 4, True, 0.05),
    "survey": (12, 3, False, 0.04),
    "implement": (10, 4, False, 0.09),
    "evidence": (10, 4, False, 0.09),
    "decision": (12, 3, False, 0.06),
}
MODE_ALIASES = {"single": "explain", "implementation": "implement"}
STRATEGIES = ("rules", "model", "hybrid")


def compare_targets(question: ColumnLike) -> Column:
    """The two things a question compares, or an empty array."""
    text = col(question)

    def side(pattern: str, group: int) -> Column:
        return F.regexp_replace(collapse_whitespace(F.regexp_extract(text, pattern, group)), r"^[ ,.;:]+|[ ,.;:]+$", "")

    def pair(pattern: str) -> Column:
        return F.array(side(pattern, 1), side(pattern, 2))

    return (
        F.when(text.rlike(VERSUS_TARGETS), pair(VERSUS_TARGETS))
        .when(text.rlike(COMPARE_TARGETS), pair(COMPARE_TARGETS))
        .otherwise(F.array().cast("array<string>"))
    )


def mode_name(value: ColumnLike) -> Column:
    """Known mode for a name or alias, else null."""
    name = F.lower(strip(value))
    for alias, mode in MODE_ALIASES.items():
        name = F.when(name == alias, mode).otherwise(name)
    return F.when(name.isin(*MODES), name)


def mode_default(mode: ColumnLike, field: int, cast: str) -> Column:
    out = F.lit(None).cast(cast)
    for name, values in MODES.items():
        out = F.when(col(mode) == name, F.lit(values[field])).otherwise(out)
    return out


def summarize_sources(hits: DataFrame, max_docs: int = 6) -> DataFrame:
    """Per query the best papers of a hit list with their count and three most frequent sections."""
    section = section_or_untitled("section_title")
    sections = (
        hits.groupBy("query_id", "arxiv_id", section.alias("section"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
        .groupBy("query_id", "arxiv_id")
        .agg(
            F.transform(
                F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "section"))), 1, 3),
                lambda s: s["section"],
            ).alias("top_sections")
        )
    )
    papers = hits.groupBy("query_id", "arxiv_id").agg(
        F.min_by("title", "rank").alias("title"), F.max("fused_score").alias("best"), F.count(F.lit(1)).alias("count")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("best"), F.desc("count"), F.asc("arxiv_id"))
    ranked = papers.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max_docs)
    return ranked.join(sections, ["query_id", "arxiv_id"]).select(
        "query_id", "position", "arxiv_id", "title", F.round("best", 6).alias("best_score"), "count", "top_sections"
    )


def distribution_features(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """How hits spread over papers, for every question: shares of the top one and two, papers, entropy, counts."""
    per_doc = hits.groupBy("query_id", "arxiv_id").agg(F.count(F.lit(1)).alias("n"))
    per_query = per_doc.groupBy("query_id").agg(F.sort_array(F.collect_list("n"), asc=False).alias("doc_counts"))
    total = F.aggregate("doc_counts", F.lit(0).cast("long"), lambda acc, n: acc + n)
    top2 = F.aggregate(F.slice("doc_counts", 1, 2), F.lit(0).cast("long"), lambda acc, n: acc + n)
    entropy = F.aggregate(
        F.transform("doc_counts", lambda n: n / total), F.lit(0.0), lambda acc, p: acc - p * F.log2(p)
    )
    features = per_query.select(
        "query_id", "doc_counts", (F.get("doc_counts", F.lit(0)) / total).alias("top1_share"),
        (top2 / total).alias("top2_share"), F.size("doc_counts").alias("num_docs"), entropy.alias("entropy"),
    )
    empty = {"top1_share": 0.0, "top2_share": 0.0, "num_docs": 0, "entropy": 0.0}
    return (
        questions.select("query_id").join(features, "query_id", "left").fillna(empty)
        .withColumn("doc_counts", F.coalesce("doc_counts", F.array().cast("array<long>")))
    )


def rule_route(question: ColumnLike, summary_docs: ColumnLike, enable_decision: bool = True) -> Column:
    """STRUCT<mode, confidence, reason, notes, targets> of the first rule that applies."""
    q = strip(question)

    def verdict(mode: str, confidence: float, reason: str, notes: str, targets: Column | None = None) -> Column:
        none = F.array().cast("array<string>")
        return F.struct(
            F.lit(mode).alias("mode"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"),
            F.lit(f"Rule router: {notes}").alias("notes"), (none if targets is None else targets).alias("targets"),
        )

    explicit = "explicit comparison cue."
    return (
        F.when(q.rlike(COMPARE_CUE), verdict("compare", 0.98, "cue_compare", explicit, compare_targets(q)))
        .when(q.rlike(IMPLEMENT_CUE), verdict("implement", 0.94, "cue_implement", "implementation/how-to cue."))
        .when(q.rlike(EVIDENCE_CUE), verdict("evidence", 0.92, "cue_evidence", "evidence/results cue."))
        .when(
            F.lit(enable_decision) & q.rlike(DECISION_CUE),
            verdict("decision", 0.9, "cue_decision", "explicit decision/recommendation cue."),
        )
        .when(q.rlike(SURVEY_CUE), verdict("survey", 0.9, "cue_survey", "survey/options cue."))
        .when(col(summary_docs) >= 4, verdict("survey", 0.62, "summary_broad", "broad question with many prelim docs."))
        .otherwise(verdict("explain", 0.86, "default_explain", "default explain mode."))
    )


def _post_check(enable_decision: bool) -> Column:
    """STRUCT<mode, confidence, note, preface, reason> correcting a first verdict by how hits spread; null keeps it.

    Thresholds, reason codes, notes and prefaces are fixed values.
    """
    mode, confidence = F.col("mode"), F.col("confidence")
    docs, top1, top2 = F.col("num_docs"), F.col("top1_share"), F.col("top2_share")
    second = F.coalesce(F.get("doc_counts", F.lit(1)), F.lit(0))
    covered = (docs >= 2) & (second >= 2)
    fallback = F.when((docs >= 3) & (top1 <= 0.7), "survey").otherwise("explain")

    def change(to: Column | str, conf: Column, reason: str, note: str, preface: Column | str | None = None) -> Column:
        to = F.lit(to) if isinstance(to, str) else to
        preface = F.lit(preface).cast("string") if preface is None or isinstance(preface, str) else preface
        return F.struct(
            to.alias("mode"), conf.cast("double").alias("confidence"), F.lit(note).alias("note"), preface.alias("preface"),
            F.lit(reason).alias("reason"),
        )

    sparse = F.concat(
        F.lit("Routing note: cross-paper comparison evidence was sparse, so this answer is downgraded to "), fallback, F.lit(" mode.")
    )
    return (
        F.when(
            (mode == "compare") & ~covered,
            change(fallback, F.greatest(F.lit(0.55), confidence - 0.2), "compare_insufficient_coverage",
                   "Downgraded from compare due low cross-paper coverage.", sparse),
        )
        .when(
            (mode == "decision") & F.lit(not enable_decision),
            change("survey", F.greatest(F.lit(0.6), confidence - 0.1), "decision_disabled",
                   "Decision mode disabled by settings; switched to survey.",
                   "Routing note: decision mode is disabled, so this answer uses survey mode."),
        )
        .when(
            (mode == "decision") & (docs < 3),
            change("survey", F.greatest(F.lit(0.6), confidence - 0.05), "decision_requires_three_docs",
                   "Decision mode requires >=3 docs; switched to survey.",
                   "Routing note: fewer than 3 distinct papers were retrieved, so this answer uses survey mode."),
        )
        .when(
            mode.isin("survey", "decision") & (top1 >= 0.82) & ~F.col("query").rlike(COMPARE_CUE) & (docs >= 1),
            change("explain", F.greatest(confidence, F.lit(0.8)), "dominant_single_doc",
                   "Post-check: one paper dominates retrieval."),
        )
        .when(
            (mode == "explain") & (docs >= 4) & (top1 <= 0.5) & (top2 <= 0.82),
            change("survey", F.greatest(F.lit(0.6), confidence), "broad_retrieval_distribution",
                   "Post-check: multiple similarly strong docs; switched to survey."),
        )
        .when(
            (mode == "survey") & (docs <= 1),
            change("explain", F.greatest(F.lit(0.6), confidence), "survey_insufficient_docs",
                   "Post-check: not enough distinct docs for survey mode.",
                   "Routing note: only one strong paper was retrieved, so this answer uses explain mode."),
        )
        .when(
            (mode == "survey") & (docs < 3),
            change("survey", confidence, "survey_low_doc_coverage",
                   "Survey mode warning: fewer than 3 distinct docs in prelim retrieval."),
        )
    )


def first_json_object(reply: ColumnLike) -> Column:
    """First {...} of a model reply when it is a complete JSON object; braces inside strings do not count."""

    def of(text: str | None) -> str | None:
        start = -1 if text is None else text.find("{")
        try:
            return None if start < 0 else text[start : json.JSONDecoder().raw_decode(text, start)[1]]
        except ValueError:
            return None

    @F.pandas_udf("string")
    def cut(replies: pd.Series) -> pd.Series:
        return replies.map(of)

    return cut(col(reply))


def parse_model_verdict(reply: ColumnLike) -> Column:
    """STRUCT<mode, k, max_per_doc, notes, targets> of a model reply, or null when it breaks the contract."""
    parsed = F.from_json(first_json_object(reply), ROUTER_REPLY)
    known = parsed["mode"].isin(*MODES, "single")
    k, quota = F.coalesce(parsed["k"], F.lit(10)), F.coalesce(parsed["max_per_doc"], F.lit(4))
    targets = F.coalesce(parsed["targets"], F.array().cast("array<string>"))
    cleaned = F.slice(F.filter(F.transform(targets, strip), lambda t: t != ""), 1, 4)
    notes = strip(F.coalesce(parsed["notes"], F.lit("")))
    verdict = F.struct(
        mode_name(parsed["mode"]).alias("mode"), k.alias("k"), quota.alias("max_per_doc"),
        F.coalesce(F.nullif(notes, F.lit("")), F.lit("LLM router decision.")).alias("notes"), cleaned.alias("targets"),
    )
    return F.when(known & k.between(8, 16) & quota.between(2, 8), verdict)


def unsure_questions(questions: DataFrame, hits: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Ids of the questions on which the rules alone are less sure than the router's threshold."""
    features = distribution_features(questions, hits).select("query_id", "num_docs")
    verdict = rule_route("query", F.least("num_docs", F.lit(6)), settings.enable_decision_mode)
    asked = questions.select("query_id", "query").join(features, "query_id")
    return asked.filter(verdict["confidence"] < settings.router_min_confidence).select("query_id")


def route_questions(
    questions: DataFrame,
    hits: DataFrame,
    strategy: str = "hybrid",
    model_replies: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Mode and retrieval parameters of every question (query_id, query) given its preliminary hits.

    ``model_replies`` (query_id, reply) is used by strategy 'model', and by 'hybrid' where the rules are unsure.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    features = distribution_features(questions, hits)
    asked = questions.select("query_id", "query").join(features, "query_id")
    ruled = asked.withColumn("v", rule_route("query", F.least("num_docs", F.lit(6)), settings.enable_decision_mode)).select(
        "*", "v.mode", "v.confidence", F.array("v.reason").alias("reasons"), "v.notes", "v.targets"
    ).drop("v").withColumns({"k": mode_default("mode", 0, "int"), "max_per_doc": mode_default("mode", 1, "int")})
    if strategy != "rules":
        unsure = F.lit(True) if strategy == "model" else F.col("confidence") < settings.router_min_confidence
        if model_replies is None:
            ruled = ruled.withColumn("m", F.lit(None).cast("struct<mode:string,k:int,max_per_doc:int,notes:string,targets:array<string>>"))
        else:
            replies = model_replies.select("query_id", parse_model_verdict("reply").alias("m"))
            ruled = ruled.join(replies, "query_id", "left")
        took, fell = unsure & F.col("m").isNotNull(), unsure & F.col("m").isNull()

        def pick(name: str, fallen: Column | None = None) -> Column:
            kept = F.col(name) if fallen is None else F.when(fell, fallen).otherwise(F.col(name))
            return F.when(took, F.col(f"m.{name}")).otherwise(kept)

        ruled = ruled.withColumn("__took", took).withColumns(
            {
                "confidence": F.when(took, F.lit(0.65)).otherwise(F.col("confidence")),
                "reasons": F.when(took, F.array(F.lit("llm_router")))
                .when(fell, F.concat("reasons", F.array(F.lit("llm_fallback")))).otherwise(F.col("reasons")),
                "notes": pick("notes", F.concat("notes", F.lit(" LLM router fallback triggered."))),
                "targets": pick("targets"), "mode": pick("mode"), "k": pick("k"), "max_per_doc": pick("max_per_doc"),
            }
        ).drop("m", "__took")
    return _finish(ruled.withColumn("c", _post_check(settings.enable_decision_mode)))


def _finish(checked: DataFrame) -> DataFrame:
    change = F.col("c")
    # A warning keeps mode and parameters; every other correction takes the defaults of its new mode.
    replaced = change.isNotNull() & (F.col("c.reason") != "survey_low_doc_coverage")
    out = checked.withColumns(
        {
            "confidence": F.coalesce("c.confidence", "confidence"),
            "notes": F.concat_ws(" ", "notes", "c.note"),
            "reason_codes": F.concat("reasons", F.filter(F.array("c.reason"), lambda r: r.isNotNull())),
            "preface": F.col("c.preface"), "__mode": F.coalesce("c.mode", "mode"),
        }
    ).withColumns(
        {
            "k": F.when(replaced, mode_default("__mode", 0, "int")).otherwise(F.col("k")),
            "max_per_doc": F.when(replaced, mode_default("__mode", 1, "int")).otherwise(F.col("max_per_doc")),
        }
    )
    return out.select(
        "query_id", F.col("__mode").alias("mode"), "targets", "k", "max_per_doc",
        mode_default("__mode", 2, "boolean").alias("require_cross_doc"), "notes", "confidence",
        mode_default("__mode", 3, "double").alias("section_boost_hint"), "preface", "reason_codes",
    )


def manual_route(requests: DataFrame, mode: ColumnLike) -> DataFrame:
    """Routes of requests that name their mode."""
    name = mode_name(mode)
    return requests.select("query_id", name.alias("mode")).select(
        "query_id", "mode", F.array().cast("array<string>").alias("targets"), mode_default("mode", 0, "int").alias("k"),
        mode_default("mode", 1, "int").alias("max_per_doc"), mode_default("mode", 2, "boolean").alias("require_cross_doc"),
        F.concat(F.lit("Manual mode override: "), "mode", F.lit(".")).alias("notes"), F.lit(1.0).alias("confidence"),
        mode_default("mode", 3, "double").alias("section_boost_hint"), F.lit(None).cast("string").alias("preface"),
        F.array(F.lit("manual_override")).alias("reason_codes"),
    )


def effective_parameters(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Request values override the route; the section boost is the larger of both.

    ``requests`` may carry k, max_per_doc and section_boost per query.
    """
    asked = requests.select(
        "query_id", F.col("k").alias("__k"), F.col("max_per_doc").alias("__quota"), F.col("section_boost").alias("__boost")
    )
    return routes.join(asked, "query_id").withColumns(
        {
            "k": F.coalesce("__k", "k"), "max_per_doc": F.coalesce("__quota", "max_per_doc"),
            "section_boost": F.greatest("__boost", "section_boost_hint"),
        }
    ).drop("__k", "__quota", "__boost")
