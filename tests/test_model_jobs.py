"""The model router with its strict retry, and errors of the repair call."""

from pyspark.sql import functions as F

from citeloom.operators import route
from citeloom.plans import answering

HITS = "query_id int, arxiv_id string, title string, section_title string, text string, fused_score double, rank int, vector_score double"


def hits(spark, n_queries):
    rows = [(q, d, f"T{d}", "S", "text", 1.0 - i / 100, i + 1, None) for q in range(n_queries) for i, d in enumerate(["a", "a", "b", "c"])]
    return spark.createDataFrame(rows, HITS)


def test_router_is_asked_once_more_in_strict_form(spark):
    def router(prompt, **_):
        if "good" in prompt:
            return '{"mode": "survey", "k": 9}'
        if "never" in prompt:
            raise RuntimeError("down")
        return '{"mode": "evidence", "k": 10}' if "Output JSON only." in prompt else "no idea"

    asked = spark.createDataFrame([(0, "good one"), (1, "later one"), (2, "never one")], "query_id int, query string")
    replies = answering.ask_router(asked, hits(spark, 3), router)
    verdicts = replies.select("query_id", route.parse_model_verdict("reply").alias("v")).select("query_id", "v.mode", "v.k")
    assert {tuple(r) for r in verdicts.collect()} == {(0, "survey", 9), (1, "evidence", 10), (2, None, None)}
    assert replies.count() == 3


def test_only_unsure_questions_go_to_the_model(spark):
    asked = spark.createDataFrame([(0, "Compare LoFTR vs SuperGlue"), (1, "thing")], "query_id int, query string")
    rules = route.route_questions(asked, hits(spark, 2), strategy="rules").select("query_id", "confidence").collect()
    unsure = {r.query_id for r in route.unsure_questions(asked, hits(spark, 2)).collect()}
    assert 0 not in unsure and all(r.confidence >= 0.55 for r in rules if r.query_id not in unsure)


def test_a_failing_repair_call_is_an_error(spark, sf_dir):
    from citeloom.checks import inputs as I

    corpus = I.corpus(spark, sf_dir)
    requests = I.benchmark_queries(spark, sf_dir).limit(2).select(
        "query_id", "query", "vector", F.lit("explain").alias("mode"), F.lit(8).alias("k"), F.lit(4).alias("max_per_doc"), F.lit(0.0).alias("section_boost")
    )

    def generator(prompt, **_):
        if "uncited" in prompt:
            raise RuntimeError("down")
        return "uncited draft"

    rows = answering.answer_questions(corpus, requests, generator).collect()
    failed = [r for r in rows if r.n_sources > 0 and "generation failed" in (r.error or "")]
    assert failed and all(r.status == "error" for r in failed)
