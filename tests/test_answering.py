from pyspark.sql import functions as F

from citeloom.operators import evaluation, ground, prompts, route

HITS = "query_id int, arxiv_id string, title string, section_title string, text string, fused_score double, rank int, vector_score double"


def hits(spark, docs, query_id=1):
    rows = [(query_id, d, f"T{d}", "S", "text", 1.0 - i / 100, i + 1, None) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, HITS)


def routed(spark, question, docs, **kw):
    asked = spark.createDataFrame([(1, question)], "query_id int, query string")
    return route.route_questions(asked, hits(spark, docs), **kw).first()


def test_dominant_paper_turns_survey_into_explain(spark):
    r = routed(spark, "What are the options here?", ["a"] * 9 + ["b"])
    assert (r["mode"], r["reason_codes"], r["k"]) == ("explain", ["cue_survey", "dominant_single_doc"], 8)


def test_compare_needs_coverage(spark):
    kept = routed(spark, "Compare LoFTR vs SuperGlue", ["a"] * 8 + ["b"] * 2 + ["c"])
    assert (kept["mode"], kept["require_cross_doc"], kept["confidence"]) == ("compare", True, 0.98)
    down = routed(spark, "Compare LoFTR vs SuperGlue", ["a"] * 8 + ["b"] + ["c"])
    assert (down["mode"], down["preface"]) == (
        "explain", "Routing note: cross-paper comparison evidence was sparse, so this answer is downgraded to explain mode.",
    )


def test_model_strategy_with_fallback(spark):
    reply = 'ok {"mode": "evidence", "k": 9, "targets": [" x ", ""]} done'
    replies = spark.createDataFrame([(1, reply)], "query_id int, reply string")
    r = routed(spark, "anything", ["a", "b", "c"], strategy="model", model_replies=replies)
    assert (r["mode"], r["k"], r["targets"], r["reason_codes"]) == ("evidence", 9, ["x"], ["llm_router"])
    broken = spark.createDataFrame([(1, "no json")], "query_id int, reply string")
    r = routed(spark, "anything", ["a", "b", "c"], strategy="model", model_replies=broken)
    assert r["reason_codes"][:2] == ["default_explain", "llm_fallback"]


def test_compare_targets(spark):
    asked = ["Explain LoFTR vs SuperGlue.", "difference between A1 and B2?", "compare  X y with Zed", "none"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").orderBy("i")
    got = [r[0] for r in df.select(route.compare_targets("q")).collect()]
    assert got == [["Explain LoFTR", "SuperGlue"], ["A1", "B2"], ["X y", "Zed"], []]


def test_citation_check(spark):
    cases = {
        "Answer:\n\nP1 [S1].\n\nP2 [S2][S1].": "", "P1 [S1].\n\nP2.": "Paragraph 2 has no inline [S#] citation.",
        "P1 [S3].": "Paragraph 1 cites a source outside S1..S2.", "# Head\n\nSources:": "Answer has no content paragraphs.",
        "": "Answer has no content paragraphs.", "a [S0]": "Paragraph 1 cites a source outside S1..S2.",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["c"]["reason"] for r in df.select("t", ground.citation_check("t", F.lit(2)).alias("c")).collect()}
    assert got == cases


def test_lone_second_paper_drops_out(spark):
    asked = spark.createDataFrame([(1, "Explain it")], "query_id int, query string")
    kept, _ = ground.cross_doc_support(asked, hits(spark, ["a", "a", "b"]))
    assert [r["arxiv_id"] for r in kept.collect()] == ["a", "a"]
    versus = spark.createDataFrame([(1, "a versus b")], "query_id int, query string")
    kept, verdict = ground.cross_doc_support(versus, hits(spark, ["a", "a", "b"]))
    row = verdict.first()
    assert row["should_refuse"] and row["warnings"][1] == "Current top-paper source counts: a (2), b (1)" and kept.count() == 3


def test_prompt_layout(spark):
    asked = spark.createDataFrame([(1, "Why?", "compare", "note")], "query_id int, query string, mode string, preface string")
    prompt = prompts.answer_prompts(asked, hits(spark, ["a", "b"])).first()["prompt"]
    assert prompt.startswith("You are a careful computer vision research assistant.\nPrompt policy: v2. Contrast papers directly")
    assert "Question:\nWhy?\n\nSources:\n[S1]\narxiv_id: a\ntitle: Ta\nsection: S\ntext: text\n\n[S2]\narxiv_id: b" in prompt
    assert "text: text\n\nMode: COMPARE\n" in prompt and '\n11. Start P1 with a short routing note' in prompt
    assert prompt.index("EVERY sentence") < prompt.index("For P2 or P3") < prompt.index("Do not output any text before P1.")
    assert prompt.endswith("P4: <2 sentences> [S#]\nAnswer:")


def test_eval_constraints(spark):
    cases = spark.createDataFrame(
        [(1, "loftr matching", ["a"], ["TEXT"], 2), (2, "loftr matching", [], [], 6)],
        "query_id int, query string, must_include_arxiv_ids array<string>, must_include_tokens array<string>, min_sources int",
    )
    found = hits(spark, ["a", "b"]).unionByName(hits(spark, ["c"], 2)).withColumn("vector_score", F.lit(0.9))
    got = {r["query_id"]: r["note"] for r in evaluation.retrieval_checks(cases, found).collect()}
    assert got == {1: "", 2: "sources=1 < min_sources=6"}
