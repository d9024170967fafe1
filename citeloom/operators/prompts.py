"""Prompt text per question from its ranked sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions.ids import citation_label
from citeloom.functions.text import collapse_whitespace, section_or_untitled

# Prompt wording.
FOCUS = {
    "explain": "Explain one paper/model mechanism clearly and grounded.",
    "compare": "Contrast papers directly: similarities, differences, tradeoffs.",
    "survey": "Map the method landscape and group approaches.",
    "implement": "Give grounded implementation steps and pitfalls.",
    "evidence": "Focus on claims, metrics, ablations, and experimental evidence.",
    "decision": "Make a recommendation with explicit tradeoff reasoning grounded in evidence.",
}
MODE_INSTRUCTIONS = {
    "explain": """Mode: EXPLAIN
Explain one method or paper mechanism clearly and compactly.
Prioritize mechanism, assumptions, and concrete takeaways grounded in sources.""",
    "compare": """Mode: COMPARE
Contrast at least two papers explicitly and attribute each claim to relevant sources.
Prioritize differences in objective, architecture, supervision, data regime, and failure modes.""",
    "survey": """Mode: SURVEY
Map the landscape of approaches and group them by idea family.
Cover tradeoffs and when to choose each option from available evidence.""",
    "implement": """Mode: IMPLEMENT
Provide practical implementation steps grounded only in cited sources.
Include assumptions, pipeline order, and common pitfalls explicitly.""",
    "evidence": """Mode: EVIDENCE
Focus on claims, metrics, ablations, and limitations supported by sources.
Call out missing evidence explicitly where claims are under-supported.""",
    "decision": """Mode: DECISION
Recommend a concrete approach with explicit trade-offs and confidence bounds.
State decision criteria and tie each criterion back to cited evidence.""",
}
ROLE = "You are a careful computer vision research assistant."
RULES_HEAD = """Rules:
1. Only use information supported by the sources.
2. Every sentence must include one or more inline citations like [S3] or [S3][S7].
3. Every paragraph must include at least one inline citation [S#].
4. The first paragraph must end with at least one citation.
5. If sources are insufficient, state what is missing and ask one clarifying question.
"""
MODE_RULES = RULES_HEAD + """6. Never cite a source outside S1..Sk. Never cite unrelated sources.
7. Do not add a separate 'Citations' footer.
8. Keep output compact and structured.
9. Do not fabricate details, metrics, or citations.
10. Use paper-accurate terminology."""
STRICT_RULES = RULES_HEAD + """6. Prefer comparisons and what each paper claims or shows.
7. Never cite a source outside S1..Sk. Never cite unrelated sources.
8. Do not add a separate 'Citations' footer.
9. Do not fabricate details, metrics, or citations.
10. Use paper-accurate terminology."""
PREFACE_RULE = (
    "\n11. Start P1 with a short routing note consistent with this sentence, then continue with content: "
)
FORMAT_HEAD = """Output format (MANDATORY):
Write EXACTLY 4 paragraphs labeled P1..P4, no headings{lists}.
Each paragraph must have 2 sentences.
EVERY sentence must end with one or more citations like [S1] or [S1][S2].
"""
GROUPED = "For P2 or P3, include concise semicolon-separated grouped tradeoffs/comparisons.\n"
GROUPED_MODES = ("compare", "survey", "decision")
FORMAT_TAIL = """Do not output any text before P1.

Template (follow exactly):
P1: <2 sentences> [S#]
P2: <2 sentences> [S#]
P3: <2 sentences> [S#]
P4: <2 sentences> [S#]
Answer:"""
REPAIR_HEAD = "\n\nDraft to rewrite:\n"
REPAIR_TAIL = (
    "\n\nRewrite the draft. Add inline [S#] citations to every paragraph and every non-trivial claim. "
    "Remove any claim not supported by sources."
)
QUERY_HEAD = """You are answering a computer vision research question using paper excerpts.
Use only the provided context. If context is insufficient, say so.
Cite claims with inline citations in this format: arXiv:ID §Section.

Question: """
ROUTER_HEAD = "You are a routing classifier for a CV paper RAG assistant.\nChoose exactly one answer mode from: {modes}.\n"
ROUTER_BODY = """Ground your choice in the question and retrieved-source summary.
Return one JSON object only. No markdown. No prose.
"""
ROUTER_STRICT = "Output JSON only.\n"
ROUTER_SCHEMA = (
    '{{"mode": "{modes}", "targets": ["string"], "k": "int (8-16)", "max_per_doc": "int (2-8)",'
    ' "require_cross_doc": "bool (true only for compare)", "notes": "short rationale"}}'
)


def source_blocks(hits: DataFrame) -> DataFrame:
    head = F.concat(F.lit("[S"), F.col("place").cast("string"), F.lit("]\narxiv_id: "), "arxiv_id", F.lit("\ntitle: "), "title")
    tail = F.concat(
        F.lit("\nsection: "), section_or_untitled("section_title"), F.lit("\ntext: "), collapse_whitespace("text"), F.lit("\n\n")
    )
    return _numbered_join(hits, F.concat(head, tail))


def context_blocks(hits: DataFrame) -> DataFrame:
    block = F.concat(
        F.lit("["), F.col("place").cast("string"), F.lit("] "), citation_label("arxiv_id", "section_title"), F.lit("\n"), "text",
        F.lit("\n\n"),
    )
    return _numbered_join(hits, block)


def _numbered_join(hits: DataFrame, block: Column) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    blocks = hits.withColumn("place", place).select("query_id", "place", block.alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "block")))
    return blocks.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["block"]), "").alias("sources"),
        F.count(F.lit(1)).alias("source_count"),
    )


def _by_mode(mode: str, texts: dict[str, str]) -> Column:
    out = F.lit(texts["explain"])
    for name, text in texts.items():
        out = F.when(F.col(mode) == name, F.lit(text)).otherwise(out)
    return out


def answer_prompts(routed: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, source_count, prompt) for (query_id, query, mode, preface)."""
    preface = F.when(
        F.coalesce("preface", F.lit("")) != "", F.concat(F.lit(PREFACE_RULE + '"'), "preface", F.lit('"'))
    ).otherwise("")
    prompt = F.concat(
        F.lit(ROLE + "\nPrompt policy: v2. "), _by_mode("mode", FOCUS), F.lit("\n\nQuestion:\n"), "query",
        F.lit("\n\nSources:\n"), "sources", _by_mode("mode", MODE_INSTRUCTIONS), F.lit("\n\n" + MODE_RULES), preface,
        F.lit("\n\n" + FORMAT_HEAD.format(lists="")),
        F.when(F.col("mode").isin(*GROUPED_MODES), F.lit(GROUPED)).otherwise(""), F.lit(FORMAT_TAIL),
    )
    return routed.join(source_blocks(hits), "query_id").select("query_id", "source_count", prompt.alias("prompt"))


def strict_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    prompt = F.concat(
        F.lit(ROLE + "\n\nQuestion:\n"), "query", F.lit("\n\nSources:\n"), "sources", F.lit(STRICT_RULES + "\n\n"),
        F.lit(FORMAT_HEAD.format(lists=", no bullet lists") + FORMAT_TAIL),
    )
    return questions.join(source_blocks(hits), "query_id").select("query_id", "source_count", prompt.alias("prompt"))


def query_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    prompt = F.concat(F.lit(QUERY_HEAD), "query", F.lit("\n\nContext:\n"), "sources", F.lit("Answer:"))
    return questions.join(context_blocks(hits), "query_id").select("query_id", "source_count", prompt.alias("prompt"))


def repair_prompt(prompt: Column | str, draft: Column | str) -> Column:
    prompt, draft = (F.col(c) if isinstance(c, str) else c for c in (prompt, draft))
    return F.concat(prompt, F.lit(REPAIR_HEAD), draft, F.lit(REPAIR_TAIL))


def router_prompts(questions: DataFrame, summary: DataFrame, enable_decision: bool = True, strict: bool = False) -> DataFrame:
    """(query_id, prompt) asking a model to choose the mode; ``summary`` comes from ``summarize_sources``."""
    modes = [m for m in FOCUS if enable_decision or m != "decision"]
    item = F.to_json(F.struct("arxiv_id", "title", "best_score", "count", "top_sections"))
    listed = summary.groupBy("query_id").agg(
        F.concat(
            F.lit("["),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("j")))), lambda s: s["j"]), ", "),
            F.lit("]"),
        ).alias("listed")
    )
    head = ROUTER_HEAD.format(modes=", ".join(modes)) + ROUTER_BODY + (ROUTER_STRICT if strict else "")
    head += "\nOutput schema:\n" + ROUTER_SCHEMA.format(modes="|".join(modes)) + "\n\nQuestion: "
    prompt = F.concat(
        F.lit(head), "query", F.lit("\n\nRetrieved source summary (top docs):\n"), F.coalesce("listed", F.lit("[]"))
    )
    return questions.join(listed, "query_id", "left").select("query_id", prompt.alias("prompt"))
