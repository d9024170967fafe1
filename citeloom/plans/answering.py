"""Answering and evaluation jobs over tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.config import DEFAULTS, Settings
from citeloom.operators import evaluation, ground, prompts
from citeloom.operators.hybrid import Corpus, answer_candidates, retrieve_for_answer
from citeloom.operators.models import Generator, generate
from citeloom.operators.relevance import irrelevance
from citeloom.operators.route import (
    effective_parameters, manual_route, mode_name, parse_model_verdict, route_questions, summarize_sources, unsure_questions,
)
from citeloom.session import materialize

NOT_FOUND = "Not found in indexed corpus."
NO_SOURCES = "No sources retrieved for this question"
WEAK_COMPARISON = "Refusing to answer comparison: need at least 2 sources from each of the top 2 papers."
REPAIRING = "Draft failed citation check; attempting repair"


def ask_router(questions: DataFrame, prelim: DataFrame, router: Generator, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, reply) of a model that chooses modes from the preliminary hits. A reply that breaks the contract, or
    none, is asked for once more with the strict prompt; what is then still broken falls to the rules."""
    summary = materialize(summarize_sources(prelim), "router-summary")

    def asked(rows: DataFrame, strict: bool) -> DataFrame:
        prompt = prompts.router_prompts(rows, summary, settings.enable_decision_mode, strict)
        replies = materialize(generate(prompt, router), "router-strict" if strict else "router")
        return replies.select("query_id", "reply", parse_model_verdict("reply").isNotNull().alias("usable"))

    first = asked(questions.select("query_id", "query"), False)
    broken = first.filter(~F.col("usable")).select("query_id")
    second = asked(questions.select("query_id", "query").join(broken, "query_id", "left_semi"), True)
    return first.filter("usable").unionByName(second).select("query_id", "reply")


def prepare_answers(
    corpus: Corpus, requests: DataFrame, strategy: str = "hybrid", model_replies: DataFrame | None = None,
    router_top_k: int = 12, settings: Settings = DEFAULTS, router: Generator | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prepared, sources, maybe_relevant) for requests.

    ``requests`` holds query_id, query, vector, mode ('auto' or a mode), k, max_per_doc (null = from the
    route) and section_boost. ``prepared`` has one row per request with route, warnings and an error where
    the request cannot be answered. ``router`` is a model that may choose modes. One candidate table serves the routing pass and the final pass.
    """
    prelim_request = requests.withColumns({"k": F.lit(router_top_k), "max_per_doc": F.lit(2)})
    widest = requests.withColumn("k", F.greatest(F.coalesce("k", F.lit(12)), F.lit(max(router_top_k, 12))))
    found = answer_candidates(corpus, widest, settings)
    prelim, maybe_relevant = retrieve_for_answer(corpus, prelim_request, settings, found)
    verdicts = irrelevance(requests, prelim, settings.relevance_threshold)
    automatic = requests.filter(F.lower("mode") == "auto")
    if router is not None and model_replies is None and strategy != "rules":
        unsure = automatic
        if strategy == "hybrid":  # the model is asked only where the rules are unsure
            unsure = automatic.join(unsure_questions(automatic, prelim, settings), "query_id", "left_semi")
        model_replies = ask_router(unsure, prelim, router, settings)
    routes = route_questions(automatic, prelim, strategy, model_replies, settings).unionByName(
        manual_route(requests.filter(F.lower("mode") != "auto"), "mode")
    )
    routed = materialize(effective_parameters(requests, routes).join(verdicts, "query_id"), "routes")
    final_request = requests.drop("k", "max_per_doc", "section_boost").join(
        routed.filter(F.col("mode").isNotNull()).select("query_id", "k", "max_per_doc", "section_boost"), "query_id"
    )
    sources, _ = retrieve_for_answer(corpus, final_request, settings, found)
    comparing = routed.filter(F.col("mode") == "compare").select("query_id")
    asked = requests.select("query_id", "query")
    kept, support = ground.cross_doc_support(asked.join(comparing, "query_id", "left_semi"), sources)
    sources = materialize(kept, "sources")
    n_sources = sources.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"))
    unknown = requests.filter(F.lower("mode") != "auto").filter(mode_name("mode").isNull()).select(
        "query_id", F.lit("Invalid mode").alias("bad_mode")
    )
    prepared = (
        asked.join(routed, "query_id", "left").join(support, "query_id", "left").join(n_sources, "query_id", "left")
        .join(unknown, "query_id", "left")
    )
    error = (
        F.when(F.col("bad_mode").isNotNull(), F.col("bad_mode"))
        .when(F.col("is_irrelevant"), NOT_FOUND)
        .when(F.coalesce("should_refuse", F.lit(False)), WEAK_COMPARISON)
        .when(F.coalesce("n_sources", F.lit(0)) == 0, NO_SOURCES)
    )
    prepared = prepared.select(
        "query_id", "query", "mode", "k", "max_per_doc", "section_boost", "confidence", "preface", "reason_codes",
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"), error.alias("error"),
    )
    return prepared, sources, maybe_relevant


def answer_questions(
    corpus: Corpus, requests: DataFrame, generator: Generator, no_refuse: bool = False, settings: Settings = DEFAULTS,
    **routing,
) -> DataFrame:
    """One outcome row per request: answer, citation verdict, warnings and status ok / refused / error.

    A draft that fails the citation check is repaired once; only failed drafts reach the model again.
    """
    prepared, sources, _ = prepare_answers(corpus, requests, settings=settings, **routing)
    answerable = prepared.filter(F.col("error").isNull())
    asked = prompts.answer_prompts(answerable, sources.join(answerable.select("query_id"), "query_id", "left_semi"))
    drafts = materialize(generate(asked, generator), "drafts").withColumn(
        "check", ground.citation_check(F.coalesce("reply", F.lit("")), "source_count")
    )
    failed = drafts.filter(F.col("error").isNull() & ~F.col("check.valid")).select(
        "query_id", "source_count", prompts.repair_prompt("prompt", "reply").alias("prompt")
    )
    repaired = materialize(generate(failed, generator), "repairs").select(
        "query_id", F.col("reply").alias("second"), F.col("error").alias("repair_error"), ground.citation_check(F.coalesce("reply", F.lit("")), "source_count").alias("recheck")
    )
    both = drafts.join(repaired, "query_id", "left")
    was_repaired = F.col("recheck").isNotNull()
    final = F.coalesce("recheck", "check")
    told = both.select(
        "query_id", F.coalesce("error", "repair_error").alias("model_error"), was_repaired.alias("repaired"), final.alias("final"),
        F.when(was_repaired & F.col("recheck.valid"), F.col("second")).otherwise(F.col("reply")).alias("answer"),
    )
    status = (
        F.when(F.coalesce("error", "model_error").isNotNull(), "error")
        .when(~F.col("final.valid") & F.lit(not no_refuse), "refused")
        .otherwise("ok")
    )
    return prepared.join(told, "query_id", "left").select(
        "query_id", "mode", status.alias("status"), F.coalesce("error", "model_error").alias("error"), "answer", "n_sources",
        F.col("final.valid").alias("citation_valid"), F.col("final.reason").alias("citation_reason"),
        F.when(F.col("repaired"), F.concat("warnings", F.array(F.lit(REPAIRING)))).otherwise(F.col("warnings")).alias("warnings"),
    )


def evaluate(
    corpus: Corpus, cases: DataFrame, k: int = 8, max_per_doc: int = 4, section_boost: float = 0.0,
    generator: Generator | None = None, settings: Settings = DEFAULTS,
) -> DataFrame:
    """(query_id, passed, n_sources, note) per case (query_id, query, vector and EVAL_CASES columns).

    Without a generator only retrieval is judged.
    """
    requests = cases.select(
        "query_id", "query", "vector", F.lit(k).alias("k"), F.lit(max_per_doc).alias("max_per_doc"),
        F.lit(section_boost).alias("section_boost"),
    )
    hits, _ = retrieve_for_answer(corpus, requests, settings)
    hits = materialize(hits, "eval-hits")
    checked = evaluation.retrieval_checks(cases, hits, settings.relevance_threshold)
    if generator is not None:
        passing = cases.join(checked.filter(F.col("note") == "").select("query_id"), "query_id", "left_semi")
        replies = generate(prompts.strict_prompts(passing, hits), generator)
        verdict = ground.citation_check(F.coalesce("reply", F.lit("")), "source_count")
        cited = replies.select("query_id", F.coalesce("error", verdict["reason"]).alias("citation_note"))
        checked = checked.join(cited, "query_id", "left").select(
            "query_id", "n_sources", F.when(F.col("note") == "", F.coalesce("citation_note", F.lit(""))).otherwise(F.col("note")).alias("note")
        )
    return checked.select("query_id", (F.col("note") == "").alias("passed"), "n_sources", "note")
